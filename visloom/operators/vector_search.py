"""Largest inner products through an inverted list of cells with exact bounds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from visloom.session import materialized

SAMPLE_ROWS = 16_384  # vectors the cells are fitted on, at most; they pass through the driver
MAX_CELLS = 1024  # cells, with their centres and radii part of each task
ROUNDS = 6  # of the fit
IMAGE_BLOCK = 16_384  # vectors of a cell that meet a block of texts in one task
TEXT_BLOCK = 1024  # texts that meet them
SLACK = 1e-9  # rounding room of the bounds; more cells cost time, never results


def fit_centres(vectors: DataFrame, column: str = "vector", rows: int = SAMPLE_ROWS, cells: int = MAX_CELLS) -> np.ndarray:
    """Centres of at most ``cells`` cells, by Lloyd rounds on the ``rows`` vectors of smallest hash.

    About the square root of the sample's size is used as the number of cells.
    """
    spread = F.xxhash64(column)
    count = vectors.count()
    if not count:
        return np.empty((0, 0))
    # A hash below its share of all hashes leaves about twice the rows; the exact number is cut from those.
    share = min(1.0, 2 * rows / count)
    drawn = vectors.select(column, spread.alias("__h")).where(F.pmod("__h", F.lit(1 << 20)) < share * (1 << 20))
    sample = np.array([r[0] for r in drawn.orderBy("__h").limit(rows).select(column).collect()], float)
    if not len(sample):
        sample = np.array([vectors.select(column).first()[0]], float)
    centres = sample[: min(cells, int(np.ceil(np.sqrt(len(sample)))))].copy()
    for _ in range(ROUNDS):
        nearest = ((centres**2).sum(1) - 2 * sample @ centres.T).argmin(1)
        for c in range(len(centres)):
            mine = sample[nearest == c]
            if len(mine):
                centres[c] = mine.mean(0)
    return centres


def in_cells(images: DataFrame, centres: np.ndarray, image_id: str = "image_id") -> DataFrame:
    """(image_id, vector, cell, gap): every vector with its nearest centre and the distance to it."""
    squares = (centres**2).sum(1)

    def assign(batches):
        for batch in batches:
            vectors = np.array(batch.column(1).to_pylist(), float).reshape(batch.num_rows, -1)
            cell = np.zeros(len(vectors), np.int32)
            for start in range(0, len(vectors), 1024):
                part = vectors[start : start + 1024]
                cell[start : start + 1024] = (squares - 2 * part @ centres.T).argmin(1)
            gap = np.sqrt(((vectors - centres[cell]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(cell), pa.array(gap)], [image_id, "vector", "cell", "gap"]
            )

    kind = images.schema[image_id].dataType.simpleString()
    rows = images.select(image_id, F.col("vector").cast("array<double>"))
    return rows.mapInArrow(assign, f"{image_id} {kind}, vector array<double>, cell int, gap double")


def _probes(texts: DataFrame, centres: np.ndarray, radius: np.ndarray, sizes: np.ndarray, k: int, text_id: str) -> DataFrame:
    """(text_id, vector, cell): the cells a text has to look into.

    Without a column ``least`` these are the cells of the largest centres that hold ``k`` vectors together.
    With it, they are all others in which a product can reach ``least``: no vector of a cell gives more
    than the centre's product plus the text's length times the cell's radius.
    """
    second = "least" in texts.columns
    held = np.flatnonzero(sizes)

    def pick(batches):
        for batch in batches:
            rows, cells = [], []
            vectors = np.array(batch.column(1).to_pylist(), float).reshape(batch.num_rows, -1)
            lengths = np.sqrt((vectors**2).sum(1))
            for row, vector in enumerate(vectors):
                products = centres[held] @ vector
                order = np.argsort(-products, kind="stable")
                first = int(np.searchsorted(np.cumsum(sizes[held][order]), k)) + 1
                if second:
                    least = batch.column(2)[row].as_py()
                    bounds = products + lengths[row] * radius[held] + SLACK * (1 + lengths[row])
                    chosen = [c for c in order[first:] if least is None or bounds[c] >= least]
                else:
                    chosen = order[:first]
                cells += [int(held[c]) for c in chosen]
                rows += [row] * len(chosen)
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at), pa.array(cells, pa.int32())], [text_id, "vector", "cell"]
            )

    kind = texts.schema[text_id].dataType.simpleString()
    columns = [text_id, F.col("vector").cast("array<double>"), *(["least"] if second else [])]
    return texts.select(*columns).mapInArrow(pick, f"{text_id} {kind}, vector array<double>, cell int")


def _best_of(probes: DataFrame, placed: DataFrame, sizes: np.ndarray, k: int, image_id: str, text_id: str) -> DataFrame:
    """(text_id, image_id, score): each text's ``k`` best of every block of a cell it looks into.

    Cells meet texts in blocks: a large cell is dealt into several by its vectors' ids, its
    texts into several by theirs, so no group grows with a crowded cell.
    """
    spark = placed.sparkSession
    counted = probes.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / TEXT_BLOCK).cast("int").alias("text_blocks"))
    blocks = [(int(c), int(-(-n // IMAGE_BLOCK))) for c, n in enumerate(sizes) if n]
    dealt = counted.join(F.broadcast(spark.createDataFrame(blocks, "cell int, image_blocks int")), "cell")

    def several(n: str):
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    def mine(key: str, n: str):
        return F.pmod(F.xxhash64(key), F.col(n)).cast("int")

    dealt = F.broadcast(dealt)  # one row per cell
    left = placed.join(dealt, "cell").select(
        "cell", mine(image_id, "image_blocks").alias("ib"), several("text_blocks").alias("tb"), image_id, "vector"
    )
    right = probes.join(dealt, "cell").select(
        "cell", several("image_blocks").alias("ib"), mine(text_id, "text_blocks").alias("tb"), text_id, "vector"
    )
    kinds = [placed.schema[image_id].dataType.simpleString(), probes.schema[text_id].dataType.simpleString()]

    def meet(images: pa.Table, texts: pa.Table) -> pa.Table:
        images = images.sort_by([(image_id, "ascending")])
        x = np.array(images.column("vector").to_pylist(), float).reshape(len(images), -1)
        asked = np.array(texts.column("vector").to_pylist(), float).reshape(len(texts), -1)
        rows, places, scores = [], [], []
        if len(x):
            columns = np.ascontiguousarray(x.T)
            for row, vector in enumerate(asked):
                score = np.zeros(len(x))
                for value, column in zip(vector, columns, strict=True):
                    score += value * column  # dimension by dimension, so that equal vectors give equal scores
                found = np.arange(len(x))
                if len(x) > k:
                    found = np.flatnonzero(score >= np.partition(score, len(x) - k)[len(x) - k])
                    found = found[np.argsort(-score[found], kind="stable")][:k]
                rows += [row] * len(found)
                places += found.tolist()
                scores += score[found].tolist()
        return pa.table(
            [texts.column(text_id).take(pa.array(rows, pa.int64())), images.column(image_id).take(pa.array(places, pa.int64())), pa.array(scores, pa.float64())],
            [text_id, image_id, "score"],
        )

    met = left.groupBy("cell", "ib", "tb").cogroup(right.groupBy("cell", "ib", "tb"))
    return met.applyInArrow(meet, f"{text_id} {kinds[1]}, {image_id} {kinds[0]}, score double")


def _ranked(rows: DataFrame, k: int, image_id: str, text_id: str) -> DataFrame:
    best = Window.partitionBy(text_id).orderBy(F.desc("score"), image_id)
    return rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def embedding_topk(
    images: DataFrame,
    texts: DataFrame,
    k: int,
    image_id: str = "image_id",
    text_id: str = "text_id",
    cells: int = MAX_CELLS,
    work: dict | None = None,
) -> DataFrame:
    """For each text vector the ``k`` images with the largest inner product, ties to the smaller image id.

    Columns text_id, image_id, score, rank. Image vectors lie in cells around centres fitted on a bounded sample;
    every image is placed. A text first looks into the cells of its best centres, which gives a
    score it cannot fall below, then into all other cells whose bound reaches it. So the result is exact, whatever
    the sample. Rows without a vector take no part. ``work`` receives the numbers of
    pairs ``scored`` and of all ``pairs``; where vectors have no clusters, bounds rule out little.
    """
    spark = images.sparkSession
    images = images.select(image_id, "vector").where(F.col("vector").isNotNull())
    texts = texts.select(text_id, "vector").where(F.col("vector").isNotNull())
    centres = fit_centres(images, cells=cells)
    kinds = [images.schema[image_id].dataType.simpleString(), texts.schema[text_id].dataType.simpleString()]
    if not len(centres):
        return spark.createDataFrame([], f"{text_id} {kinds[1]}, {image_id} {kinds[0]}, score double, rank int")
    placed = materialized(in_cells(images, centres, image_id), "vectors")
    radius, sizes = np.zeros(len(centres)), np.zeros(len(centres), np.int64)
    for cell, far, n in placed.groupBy("cell").agg(F.max("gap"), F.count(F.lit(1))).collect():
        radius[cell], sizes[cell] = far, n
    first = materialized(_probes(texts, centres, radius, sizes, k, text_id), "probes-first")
    found = materialized(_best_of(first, placed, sizes, k, image_id, text_id), "found-first")
    least = _ranked(found, k, image_id, text_id).where(F.col("rank") == k).select(text_id, F.col("score").alias("least"))
    bounded = texts.join(least, text_id, "left")
    second = materialized(_probes(bounded, centres, radius, sizes, k, text_id), "probes-second")
    if work is not None:
        asked = first.union(second).groupBy("cell").count().collect()
        work["scored"] = sum(int(sizes[c]) * n for c, n in asked)
        work["pairs"] = int(sizes.sum()) * texts.count()
    return _ranked(found.union(_best_of(second, placed, sizes, k, image_id, text_id)), k, image_id, text_id)

"""Ranked lexical search: hashed max-sketches bound every score, exact rescoring settles the rest.

A document's impacts (how much one occurrence pattern of a term is worth, whatever the query) fold
into a short array of coordinatewise maxima: each term raises PROBES hashed coordinates to its
impact. For any term the least of its coordinates is at least its impact, so one batched look-up of
all terms of all queries gives an upper bound of every score. The documents of the highest
bounds are scored exactly and give a threshold per query; whatever the bounds leave above it
is then scored exactly in descending order of bounds, while thresholds rise, until none is left.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from visloom.llm.common import Scratch, WordHashes, texts_as_bytes

# Terms are runs of ASCII letters, digits and all other characters from U+0080 on. In UTF-8 the latter
# are bytes from 0x80 on, so every other ASCII byte becomes a space and the text is split there.
TERM_BYTES = bytes(
    b if b >= 0x80 or chr(b).isdigit() or chr(b).islower() else ord(chr(b).lower()) if chr(b).isupper() else 0x20
    for b in range(256)
)

WIDTH = 16  # coordinates per distinct term of the document
PROBES = 6  # with 16 coordinates a term, an absent term is taken for a present one in 1 of 1,000 cases
STEP = 4000  # impacts (below 1,000,000) are kept in steps, rounded up: one byte each
SEEDS = 2  # the first thresholds come from the SEEDS * k highest bounds
HALVINGS = 1  # rounds that take the upper half of the remaining bounds before the last takes all
VOCABULARY = 200_000  # terms one task counts or remembers the hashes of at once
QUERY_TERMS = 200_000  # (query, term) pairs of a block of queries
SCORES_HELD = 1 << 18  # bounds held at once in a task
PORTION_ROWS = 1024  # texts a task takes out of Arrow memory at once

SKETCHES = "doc_id long, sketch binary"


def terms_of(text: bytes) -> list[bytes]:
    """The terms of a UTF-8 text, A-Z lower-cased."""
    return text.translate(TERM_BYTES).split()


def saturation(length: int, n_docs: int, n_terms: int) -> int:
    """The length part of a document's impacts."""
    return 100 - 90 + (90 * length * n_docs) // n_terms


def impacts(tf: np.ndarray, m: int) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def weight(df: int, n_docs: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def places(hashes: np.ndarray, width: int) -> np.ndarray:
    """PROBES coordinates (rows) of each term (columns) in a sketch of ``width``."""
    low, high = hashes & np.uint64(0xFFFFFFFF), (hashes >> np.uint64(32)) | np.uint64(1)
    probes = np.arange(PROBES, dtype=np.uint64)[:, None]
    spread = (low + probes * high) & np.uint64(0xFFFFFFFF)
    return ((spread * np.uint64(width)) >> np.uint64(32)).astype(np.int64)


def sketch_of(counts: Counter, m: int, hashes: WordHashes) -> np.ndarray:
    """Coordinatewise maxima of the impacts, in steps rounded up."""
    sketch = np.zeros(WIDTH * len(counts), np.uint8)
    tf = np.fromiter(counts.values(), np.int64, len(counts))
    levels = (-(-impacts(tf, m) // STEP)).astype(np.uint8)
    for row in places(hashes.of(list(counts)), len(sketch)):
        np.maximum.at(sketch, row, levels)
    return sketch


@dataclass
class Queries:
    """A block of queries: their ids, distinct terms, and (query, term, weight) sorted by query."""

    ids: list
    terms: list[bytes]
    term: np.ndarray
    starts: np.ndarray
    weights: np.ndarray

    @classmethod
    def of(cls, rows: list, n_docs: int) -> Queries:
        by_query: dict = {}
        for item_id, term, df in rows:
            by_query.setdefault(item_id, []).append((bytes(term), weight(df, n_docs)))
        terms = sorted({t for found in by_query.values() for t, _ in found})
        place = {t: k for k, t in enumerate(terms)}
        flat = [(place[t], w) for found in by_query.values() for t, w in found]
        sizes = [len(found) for found in by_query.values()]
        return cls(
            list(by_query),
            terms,
            np.array([p for p, _ in flat], np.int64),
            np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64),
            np.array([w for _, w in flat], np.int64),
        )

    def hashes(self) -> np.ndarray:
        return WordHashes().of(self.terms)

    def bounds(self, sketches: list[bytes], hashes: np.ndarray) -> np.ndarray:
        """Upper bounds of the scores: one row per sketch, one column per query."""
        out = np.zeros((len(sketches), len(self.ids)), np.int64)
        for row, raw in enumerate(sketches):
            sketch = np.frombuffer(raw, np.uint8)
            levels = sketch[places(hashes, len(sketch))].min(axis=0).astype(np.int64) * STEP
            out[row] = np.add.reduceat(levels[self.term] * self.weights, self.starts)
        return out

    def terms_by_query(self) -> list[list[tuple[bytes, int]]]:
        ends = [*self.starts[1:], len(self.term)]
        return [
            [(self.terms[t], int(w)) for t, w in zip(self.term[a:b], self.weights[a:b], strict=True)]
            for a, b in zip(self.starts, ends, strict=True)
        ]


def _item_terms(items: DataFrame) -> DataFrame:
    """Distinct (item_id, term) of the items."""

    def split(batches):
        for batch in batches:
            ids, texts = batch.column(0), texts_as_bytes(batch.column(1))
            found = [sorted(set(terms_of(t))) for t in texts]
            rows = np.repeat(np.arange(len(found)), [len(x) for x in found])
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(rows)), pa.array([t for x in found for t in x], pa.binary())], ["item_id", "term"]
            )

    rows = items.select("item_id", F.col("text").cast("string"))
    return rows.mapInArrow(split, f"item_id {rows.schema['item_id'].dataType.simpleString()}, term binary").distinct()


def _portions(batches):
    for batch in batches:
        for start in range(0, batch.num_rows, PORTION_ROWS):
            yield batch.slice(start, PORTION_ROWS)


def _counted(documents: DataFrame) -> DataFrame:
    """Partial counts (term, n): documents that hold the term; null stands for documents with a
    term at all, the empty term for all terms with repeats."""

    def count(batches):
        held: Counter = Counter()
        docs = total = 0

        def handed_on():
            terms = [None, b"", *held]
            yield pa.RecordBatch.from_arrays(
                [pa.array(terms, pa.binary()), pa.array([docs, total, *held.values()], pa.int64())], ["term", "n"]
            )

        for batch in _portions(batches):
            for text in texts_as_bytes(batch.column(0)):
                terms = terms_of(text)
                docs += bool(terms)
                total += len(terms)
                held.update(set(terms))
                if len(held) >= VOCABULARY:
                    yield from handed_on()
                    held.clear()
                    docs = total = 0
        yield from handed_on()

    return documents.select("text").mapInArrow(count, "term binary, n long").groupBy("term").agg(F.sum("n").alias("n"))


def _sketched(documents: DataFrame, n_docs: int, n_terms: int) -> DataFrame:
    """(doc_id, sketch) of the documents that hold a term."""

    def sketch(batches):
        hashes = WordHashes(VOCABULARY)
        for batch in _portions(batches):
            ids, sketches = [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), texts_as_bytes(batch.column(1)), strict=True):
                terms = terms_of(text)
                if terms:
                    ids.append(doc_id)
                    m = saturation(len(terms), n_docs, n_terms)
                    sketches.append(sketch_of(Counter(terms), m, hashes).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sketches, pa.binary())], ["doc_id", "sketch"])

    return documents.mapInArrow(sketch, SKETCHES)


BOUNDS = "query int, doc_id long, bound long"


def _bounds_of(batch: pa.RecordBatch, queries: Queries, hashes: np.ndarray):
    """(doc ids, matrix of bounds) in portions of at most SCORES_HELD bounds."""
    step = max(1, SCORES_HELD // len(queries.ids))
    ids = np.array(batch.column(0).to_pylist(), object)
    for start in range(0, len(ids), step):
        part = batch.column(1).slice(start, step).to_pylist()
        yield ids[start : start + step], queries.bounds(part, hashes)


def _as_rows(queries: np.ndarray, ids: np.ndarray, bounds: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(queries, pa.int32()), pa.array(ids.tolist(), pa.int64()), pa.array(bounds, pa.int64())],
        ["query", "doc_id", "bound"],
    )


def _highest(sketches: DataFrame, queries: Queries, n: int) -> DataFrame:
    """The ``n`` highest bounds of each query; a task hands on its own ``n`` best."""

    def best(batches):
        hashes = queries.hashes()
        ids, held = np.empty((0, len(queries.ids)), object), np.empty((0, len(queries.ids)), np.int64)
        for batch in batches:
            for docs, bounds in _bounds_of(batch, queries, hashes):
                held = np.concatenate([held, bounds])
                ids = np.concatenate([ids, np.repeat(docs[:, None], len(queries.ids), axis=1)])
                if len(held) > n:
                    top = np.argpartition(-held, n - 1, axis=0)[:n]
                    held, ids = np.take_along_axis(held, top, 0), np.take_along_axis(ids, top, 0)
        which = np.tile(np.arange(len(queries.ids)), len(held))
        found = held.ravel() > 0
        yield _as_rows(which[found], ids.ravel()[found], held.ravel()[found])

    return _first(sketches.mapInArrow(best, BOUNDS), n, F.desc("bound"), "doc_id")


def _first(rows: DataFrame, n: int, *order: Column | str) -> DataFrame:
    """Each query's first ``n`` rows, with their ``rank``; tasks keep only that many before the shuffle."""
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order)))
    return ranked.where(F.col("rank") <= n)


def _above(sketches: DataFrame, queries: Queries, least: np.ndarray) -> DataFrame:
    """(query, doc_id, bound) of all pairs whose bound reaches the query's threshold (and 1)."""
    least = np.maximum(least, 1)

    def pick(batches):
        hashes = queries.hashes()
        for batch in batches:
            for docs, bounds in _bounds_of(batch, queries, hashes):
                rows, which = np.nonzero(bounds >= least)
                yield _as_rows(which, docs[rows], bounds[rows, which])

    return sketches.mapInArrow(pick, BOUNDS).groupBy("query", "doc_id").agg(F.max("bound").alias("bound"))


def _scored(documents: DataFrame, pairs: DataFrame, queries: Queries, n_docs: int, n_terms: int) -> DataFrame:
    """(query, doc_id, score) of the pairs (query, doc_id), from the whole texts; scores above 0."""

    def score(batches):
        wanted = queries.terms_by_query()
        for batch in _portions(batches):
            out = []
            asked = zip(batch.column(0).to_pylist(), texts_as_bytes(batch.column(1)), batch.column(2).to_pylist(), strict=True)
            for doc_id, text, which in asked:
                terms = terms_of(text)
                if not terms:
                    continue
                tf, m = Counter(terms), saturation(len(terms), n_docs, n_terms)
                for q in which:
                    total = sum(w * ((1_000_000_000 * tf[t]) // (1000 * tf[t] + 8 * m)) for t, w in wanted[q] if t in tf)
                    if total > 0:
                        out.append((q, doc_id, total))
            columns = list(zip(*out, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64())],
                ["query", "doc_id", "score"],
            )

    asked = pairs.groupBy(F.col("doc_id").alias("__id")).agg(F.collect_set("query").alias("queries"))
    met = documents.join(asked, F.col("doc_id").eqNullSafe(F.col("__id"))).select("doc_id", "text", "queries")
    return met.mapInArrow(score, "query int, doc_id long, score long")


def ranked_search(items: DataFrame, documents: DataFrame, k: int = 10) -> DataFrame:
    """Per item of ``items`` (item_id, text) its ``k`` best ``documents`` (doc_id, text).

    Returns item_id, rank (from 1), doc_id, score: highest score first, equal scores by ascending
    doc_id (null last); only scores above 0. Rows that share an item_id are one item with the terms of
    all; documents that share a doc_id stay documents of their own. Texts without terms (null, empty)
    are in no count and no result. Empty tables give an empty result. Extra columns are ignored.

    Items are handled in blocks of about QUERY_TERMS distinct (item, term) pairs, at least one item; a block
    passes through the driver. Documents and sketches stay in tables; no document's bounds are
    kept unless they reach the threshold of their item.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark, "ranked-search")
    documents = documents.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    id_field = items.schema["item_id"].dataType.simpleString()
    empty = spark.createDataFrame([], f"item_id {id_field}, rank int, doc_id long, score long")

    counts = scratch.put(_counted(documents), "counts")
    totals = {r["term"]: r["n"] for r in counts.where("term IS NULL OR octet_length(term) = 0").collect()}
    n_docs, n_terms = totals.get(None, 0), totals.get(b"", 0)
    if not n_docs:
        return empty
    wanted = _item_terms(items).join(counts, "term").select("item_id", "term", F.col("n").alias("df"))
    wanted = scratch.put(wanted, "wanted")
    blocks = -(-wanted.count() // QUERY_TERMS)
    sketches = scratch.put(_sketched(documents, n_docs, n_terms), "sketches")
    found = empty
    for block in range(blocks):
        mine = wanted.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block)
        queries = Queries.of([tuple(r) for r in mine.collect()], n_docs)
        if queries.ids:
            best = _block_results(queries, documents, sketches, k, n_docs, n_terms, scratch, block)
            names = spark.createDataFrame(list(enumerate(queries.ids)), f"query int, item_id {id_field}")
            found = found.union(best.join(names, "query").select("item_id", "rank", "doc_id", "score"))
    return found


def _block_results(queries, documents, sketches, k, n_docs, n_terms, scratch, block) -> DataFrame:
    """(query, rank, doc_id, score) of a block of queries."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    spot = f"block{block}"

    def thresholds(best: DataFrame) -> np.ndarray:
        least = np.zeros(len(queries.ids), np.int64)
        for q, score in best.where(F.col("rank") == k).select("query", "score").collect():
            least[q] = score
        return least

    def rescored(pairs: DataFrame) -> DataFrame:
        return _scored(documents, pairs, queries, n_docs, n_terms)

    seeds = scratch.put(_highest(sketches, queries, SEEDS * k), f"{spot}-seeds")
    least = thresholds(_first(rescored(seeds), k, *order))
    rest = scratch.put(_above(sketches, queries, least), f"{spot}-rest")
    best = None
    ceiling = np.full(len(queries.ids), np.iinfo(np.int64).max)  # bounds from here on are done
    for turn in range(HALVINGS + 1):
        spans = documents.sparkSession.createDataFrame(
            [(q, int(a), int(b)) for q, (a, b) in enumerate(zip(least, ceiling, strict=True)) if a < b],
            "query int, least long, ceiling long",
        )
        open_ = rest.join(F.broadcast(spans), "query").where("bound >= least AND bound < ceiling")
        tops = open_.groupBy("query").agg(F.max("bound").alias("top")).collect()
        if not tops:
            break
        floor = least.copy()
        if turn < HALVINGS:
            for q, top in tops:
                floor[q] = (least[q] + top) // 2
        floors = documents.sparkSession.createDataFrame([(q, int(x)) for q, x in enumerate(floor)], "query int, floor long")
        asked = open_.join(F.broadcast(floors), "query").where("bound >= floor")
        now = rescored(asked).select("query", "doc_id", "score")
        pool = now if best is None else best.select("query", "doc_id", "score").union(now)
        best = scratch.put(_first(pool, k, *order), f"{spot}-best{turn}")
        least, ceiling = np.maximum(least, thresholds(best)), np.minimum(ceiling, floor)
    if best is None:
        return documents.sparkSession.createDataFrame([], "query int, rank int, doc_id long, score long")
    return best.select("query", "rank", "doc_id", "score")

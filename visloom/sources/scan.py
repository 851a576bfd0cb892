"""File scans with stable positions, source fallback, and configuration checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from visloom.schemas import CONFIGS
from visloom.session import for_small_files

MAX_BROADCAST_FILES = 100_000
CHUNK_ROWS = 1 << 20


def scan_with_index(
    spark: SparkSession,
    path: str | Sequence[str],
    columns: Sequence[str] | None = None,
    index: str = "index",
    max_broadcast_files: int = MAX_BROADCAST_FILES,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Parquet rows with their 0-based position in scan order (files by path, rows in place).

    The position is the row number inside the file plus the rows of earlier files, so
    no data row is shuffled or sorted. The rows per file come from a scan without
    columns. The per-file offsets are broadcast while the number of files, which is
    known from the listing, is small; beyond that they are joined by (file, chunk of
    rows), which keeps even a single huge file spread over tasks.
    """
    paths = [path] if isinstance(path, str) else list(path)
    df = spark.read.parquet(*paths)
    wanted = [F.col(c) for c in (columns or df.columns)]
    files = len(df.inputFiles())
    row = F.col("_metadata.row_index")
    if files == 1:
        return df.select(*wanted, row.alias(index))

    scan = df.select(*wanted, F.col("_metadata.file_path").alias("__file"), row.alias("__row"))
    per_file = df.select(F.col("_metadata.file_path").alias("__file")).groupBy("__file").agg(
        F.count(F.lit(1)).alias("__n")
    )
    # One row per file, so this unpartitioned window stays small.
    earlier = Window.orderBy("__file").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_file.withColumn("__before", F.coalesce(F.sum("__n").over(earlier), F.lit(0)))
    if files <= max_broadcast_files:
        joined = scan.join(F.broadcast(offsets.select("__file", "__before")), "__file")
    else:
        chunks = offsets.select(
            "__file", "__before", F.explode(F.sequence(F.lit(0), F.floor(F.col("__n") / chunk_rows))).alias("__chunk")
        )
        joined = scan.withColumn("__chunk", F.floor(F.col("__row") / chunk_rows)).join(chunks, ["__file", "__chunk"])
    return joined.withColumn(index, (F.col("__before") + F.col("__row")).cast("bigint")).drop(
        "__file", "__row", "__before", "__chunk"
    )


def first_available(
    spark: SparkSession, candidates: Sequence[str], columns: Sequence[str], fmt: str = "parquet", index: str | None = None
) -> DataFrame:
    """The first candidate that can be read and has the columns; the last error is raised.

    ``index`` names a column for the rows' positions (parquet only, see :func:`scan_with_index`).

    A candidate may fail in many ways (absent, unreadable, other columns), and all of
    them show here, since opening it reads its schema.
    """
    error: Exception | None = None
    for path in candidates:
        try:
            found = spark.read.format(fmt).load(path).select(*columns)
            return found if index is None else scan_with_index(spark, path, columns, index)
        except Exception as err:
            error = err
    if error is None:
        raise ValueError("no candidate sources given")
    raise error


def check_config(dataset: str, config: str) -> None:
    """Fail unless the configuration belongs to the set; the message lists the choices."""
    if dataset not in CONFIGS:
        raise ValueError(f"unknown dataset {dataset!r}; choices: {sorted(CONFIGS)}")
    if config not in CONFIGS[dataset]:
        raise ValueError(f"config {config!r} is not valid for {dataset}; choices: {sorted(CONFIGS[dataset])}")


def unknown_configs(df: DataFrame) -> DataFrame:
    """Rows whose (dataset, config) is on no list; the lists are short, so this is a filter."""
    known = F.lit(False)
    for dataset, configs in CONFIGS.items():
        known = known | ((F.col("dataset") == dataset) & F.col("config").isin(configs))
    return df.where(~F.coalesce(known, F.lit(False)))


def image_files(spark: SparkSession, path: str, pattern: str = "*.png") -> DataFrame:
    """Image files of a folder: path, length and content (read only when selected)."""
    return (
        for_small_files(spark)
        .read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", "true")
        .load(path)
        .select("path", "length", "content", F.element_at(F.split("path", "/"), -1).alias("filename"))
    )

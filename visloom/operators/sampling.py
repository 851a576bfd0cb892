"""Shuffles, skips, limits and samples that do not depend on the partitioning."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from visloom.functions.text import order_key
from visloom.operators.positions import random_positions


def shuffle(
    df: DataFrame, index: str = "index", seed: int = 42, buffer: int | None = None, out: str = "position"
) -> DataFrame:
    """Give each row its place after a seeded shuffle.

    Without ``buffer`` the whole table is mixed. With it, rows move only inside their
    block of ``buffer`` consecutive positions: the locality of a buffered shuffle over
    a stream, so a following ``take`` still sees only the first rows.
    """
    if buffer is None:
        return random_positions(df, index, seed, out)
    block = F.floor(F.col(index) / buffer)
    inside = Window.partitionBy("__block").orderBy(order_key(seed, F.col(index)), index)
    return (
        df.withColumn("__block", block)
        .withColumn(out, (F.col("__block") * buffer + F.row_number().over(inside) - 1).cast("bigint"))
        .drop("__block")
    )


def take(df: DataFrame, n: int, order: str = "position") -> DataFrame:
    """The first ``n`` rows by a dense position (0, 1, 2, …): a filter, in the order the data has."""
    return df.where(F.col(order) < n)


def skip_limit(df: DataFrame, skip: int = 0, limit: int | None = None, index: str = "index") -> DataFrame:
    """Rows ``skip`` .. ``skip+limit-1`` by position, as a range filter.

    ``limit=None`` means no limit and 0 means no rows; positions keep their values.
    """
    out = df.where(F.col(index) >= skip) if skip else df
    return out if limit is None else out.where(F.col(index) < skip + limit)


def materialize(df: DataFrame, limit: int | None, *, lazy: bool = False, index: str = "index") -> DataFrame:
    """Persist a slice for repeated reads; a lazy source needs a limit."""
    if lazy and limit is None:
        raise ValueError("materialising a lazy source requires a limit")
    return (df if limit is None else take(df, limit, index)).persist()


def sample_n(df: DataFrame, n: int, index: str = "index", seed: int = 42) -> DataFrame:
    """``n`` random rows without replacement, or all rows when there are fewer.

    The rows with the smallest hashes: buckets of hash prefixes are counted (at most 65,536 of them),
    all rows of the lower buckets are in, and only the last bucket is ordered.
    """
    hashed = df.withColumn("__hash", order_key(seed, F.col(index)))
    bucket = F.substring("__hash", 1, 4)
    counts = sorted(tuple(r) for r in hashed.groupBy(bucket.alias("b")).count().collect())
    before, last = 0, None
    for name, rows in counts:
        if before + rows > n:
            last = name
            break
        before += rows
    if last is None:
        return df
    rest = hashed.where(bucket == last).orderBy("__hash", index).limit(n - before)
    return hashed.where(bucket < last).unionByName(rest).drop("__hash")

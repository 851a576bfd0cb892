"""Lookups where the asking side may be heavily skewed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A key is hot from this many rows on, and gets one salt per so many rows.
HOT_ROWS = 1_000_000
HOT_KEYS = 65_536
MAX_SALTS = 65_536
SMALL_LIST = 100_000  # longer lists are tables like any other, not broadcast


def spread_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    *,
    spread: Sequence[str] | None = None,
    sizes: DataFrame | None = None,
    hot_rows: int = HOT_ROWS,
    hot_keys: int = HOT_KEYS,
    max_salts: int = MAX_SALTS,
) -> DataFrame:
    """Join ``left`` to a ``right`` side that has one row per key, salting hot left keys.

    The keys with ``hot_rows`` rows or more, the largest ``hot_keys`` of them, are found
    by one map-side combined count over the keys of ``left``, or taken from ``sizes`` (keys,
    ``rows``), so any other key has fewer than ``hot_rows`` rows or less than 1/``hot_keys`` of the
    table. Usually there are none, and the join is a plain one. Each hot key gets salts in
    proportion to its rows: its left rows are dealt out by a hash of the ``spread`` columns,
    its right row is copied once per salt. Null keys match nothing and are dealt out as well.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"unsupported join type: {how}")
    on = list(on)
    any_null = F.lit(False)
    for key in on:
        any_null = any_null | F.col(key).isNull()
    digest = F.xxhash64(*[F.col(c) for c in (spread or left.columns)])
    null_salt = F.when(any_null, F.pmod(digest, F.lit(max_salts)) + 1)
    if sizes is None:
        sizes = left.where(~any_null).groupBy(*on).agg(F.count(F.lit(1)).alias("rows"))
    salts = F.least(F.ceil(F.col("rows") / hot_rows), F.lit(max_salts)).cast("int")
    largest = sizes.where(F.col("rows") >= hot_rows).orderBy(F.desc("rows"), *on).limit(hot_keys)
    largest = largest.select(*on, salts.alias("__salts"))
    found = largest.collect()
    if not found:
        # Only the left rows without a key are dealt out; they find no partner anywhere.
        if how == "inner":
            return left.join(right, on)
        asking = left.withColumn("__salt", F.coalesce(null_salt, F.lit(0)).cast("int"))
        return asking.join(right.withColumn("__salt", F.lit(0)), [*on, "__salt"], how).drop("__salt")
    hot = F.broadcast(left.sparkSession.createDataFrame(found, largest.schema))
    asking = left.join(hot, on, "left").withColumn(
        "__salt",
        F.when(F.col("__salts").isNotNull(), F.pmod(digest, F.col("__salts"))).otherwise(F.coalesce(null_salt, F.lit(0))).cast("int"),
    )
    answers = right.join(hot, on, "left").withColumn(
        "__salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("__salts") - 1, F.lit(0))))
    )
    return asking.drop("__salts").join(answers.drop("__salts"), [*on, "__salt"], how).drop("__salt")


def listed(spark, column: str, values: Sequence, type_: str = "string") -> DataFrame:
    """A caller's list as a table (pos, column); broadcast if its length is small."""
    values = list(values)
    rows = spark.createDataFrame(list(enumerate(values)), f"pos bigint, {column} {type_}")
    return F.broadcast(rows) if len(values) <= SMALL_LIST else rows

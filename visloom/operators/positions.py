"""Global positions without a single-task window over the data.

Every ranking here is two-level: rows are numbered inside many small groups that
are balanced by construction, and only the group sizes are summed up in one place.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from visloom.functions.text import order_key

CHUNK = 1 << 20


def _before(n: str, partition: Sequence[str], group: Sequence[str]) -> Column:
    """Sum of ``n`` over the earlier groups of the partition."""
    earlier = Window.partitionBy(*partition).orderBy(*group).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(n).over(earlier), F.lit(0))


def _beside(rows: DataFrame, offsets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows with their group's other columns of ``offsets``; null keys meet null keys."""
    named = offsets.withColumnsRenamed({k: f"__of_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & rows[k].eqNullSafe(named[f"__of_{k}"])
    return rows.join(named, same).drop(*[f"__of_{k}" for k in keys])


def rerank(
    df: DataFrame, position: str, out: str = "index", partition: Sequence[str] = (), chunk: int = CHUNK
) -> DataFrame:
    """Close the gaps in a unique integer position: 0, 1, 2, … in the same order.

    Groups are blocks of ``chunk`` positions, so no group exceeds ``chunk`` rows even
    when one partition value holds most of the table. The block sizes are one row
    per million positions. Rank narrow rows and join the result: a block is one task's.
    """
    chunked = df.withColumn("__chunk", F.floor(F.col(position) / chunk))
    keys = [*partition, "__chunk"]
    sizes = chunked.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    offsets = sizes.select(*keys, _before("__n", partition, ["__chunk"]).alias("__before"))
    inside = Window.partitionBy(*keys).orderBy(position)
    ranked = chunked.withColumn("__rank", F.row_number().over(inside) - 1)
    return (
        _beside(ranked, offsets, keys)
        .withColumn(out, (F.col("__before") + F.col("__rank")).cast("bigint"))
        .drop("__chunk", "__rank", "__before")
    )


def random_positions(
    df: DataFrame,
    key: str,
    seed: int = 42,
    out: str = "position",
    lead: Sequence[str] = (),
    digits: int = 4,
) -> DataFrame:
    """Positions in md5 order of a unique key, after the optional ``lead`` columns.

    Groups are the first ``digits`` hex digits of the hash: even in size for unique
    keys, and 16**digits at most (65,536 by default) per lead value. Raise ``digits``
    with the table so that one group still fits a task.
    """
    hashed = df.withColumn("__hash", order_key(seed, F.col(key))).withColumn(
        "__bucket", F.substring("__hash", 1, digits)
    )
    group = [*lead, "__bucket"]
    sizes = hashed.groupBy(*group).agg(F.count(F.lit(1)).alias("__n"))
    within = _before("__n", lead, ["__bucket"])
    if lead:
        # One row per lead value here, one row per bucket inside each.
        leads = hashed.groupBy(*lead).agg(F.count(F.lit(1)).alias("__total"))
        starts = leads.select(*lead, _before("__total", [], lead).alias("__start"))
        offsets = _beside(sizes, starts, list(lead)).select(*group, (F.col("__start") + within).alias("__before"))
    else:
        offsets = sizes.select(*group, within.alias("__before"))
    inside = Window.partitionBy(*group).orderBy("__hash", key)
    ranked = hashed.withColumn("__rank", F.row_number().over(inside) - 1)
    return (
        _beside(ranked, offsets, group)
        .withColumn(out, (F.col("__before") + F.col("__rank")).cast("bigint"))
        .drop("__hash", "__bucket", "__rank", "__before")
    )

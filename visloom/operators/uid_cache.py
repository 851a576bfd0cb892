"""An ordered set of uids kept as a table (position, uid), positions 0..n-1."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visloom.operators.joins import listed, spread_join
from visloom.operators.positions import rerank


def parse_cache_text(text: Column) -> Column:
    """JSON list as strings; anything that is not a list reads as empty, null items drop out."""
    items = F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))
    return F.filter(items, lambda x: x.isNotNull())


def cache_from_text(df: DataFrame, text: str = "text") -> DataFrame:
    """Cache rows of stored JSON texts, as the texts have them: repeated uids stay."""
    keys = [c for c in df.columns if c != text]
    return df.select(*keys, F.posexplode(parse_cache_text(F.col(text))).alias("position", "uid"))


def _flagged(df: DataFrame, cache: DataFrame, how: str) -> DataFrame:
    cached = cache.groupBy("uid").agg(F.lit(True).alias("__cached"))  # repeats in the cache match once
    return spread_join(df, cached, ["uid"], how)


def members(df: DataFrame, cache: DataFrame) -> DataFrame:
    """Rows whose uid is cached."""
    return _flagged(df, cache, "inner").drop("__cached")


def non_members(df: DataFrame, cache: DataFrame) -> DataFrame:
    return _flagged(df, cache, "left").where(F.col("__cached").isNull()).drop("__cached")


def cache_extend(cache: DataFrame, new: DataFrame | Sequence[str]) -> DataFrame:
    """Append unseen uids in order of arrival; ``new`` is (pos, uid) or a list."""
    if not isinstance(new, DataFrame):
        new = listed(cache.sparkSession, "uid", new)
    arrivals = new.groupBy("uid").agg(F.min("pos").alias("__pos"))
    unseen = rerank(arrivals.join(cache.select("uid"), "uid", "left_anti"), "__pos", "__order")
    size = cache.agg(F.coalesce(F.max("position") + 1, F.lit(0))).scalar()
    added = unseen.select((size + F.col("__order")).cast("bigint").alias("position"), "uid")
    return cache.select(F.col("position").cast("bigint"), "uid").unionByName(added)


def cache_add(cache: DataFrame, uid: str) -> DataFrame:
    return cache_extend(cache, [uid])


def cache_remove(cache: DataFrame, uids: DataFrame | Sequence[str]) -> DataFrame:
    """Drop the first place of each uid and let later positions move up."""
    if not isinstance(uids, DataFrame):
        uids = listed(cache.sparkSession, "uid", uids)
    first = cache.join(uids.select("uid"), "uid", "left_semi").groupBy("uid").agg(F.min("position").alias("position"))
    kept = cache.join(first.select("position"), "position", "left_anti")
    return rerank(kept.withColumnRenamed("position", "__pos"), "__pos", "position").select("position", "uid")


def cache_clear(cache: DataFrame) -> DataFrame:
    return cache.where(F.lit(False))


def cache_get(cache: DataFrame, index: int) -> str:
    """The uid at ``index`` modulo the size; an empty cache is an ``IndexError``."""
    size = cache.agg(F.count(F.lit(1))).scalar()
    rows = cache.where(F.col("position") == F.pmod(F.lit(index), F.nullif(size, F.lit(0)))).take(1)
    if not rows:
        raise IndexError("UID cache is empty")
    return rows[0]["uid"]


def cache_get_many(cache: DataFrame, requests: DataFrame) -> DataFrame:
    """The same for a table of ``index`` values."""
    size = cache.agg(F.count(F.lit(1))).scalar()
    asked = requests.withColumn("position", F.pmod(F.col("index"), F.nullif(size, F.lit(0))).cast("bigint"))
    return spread_join(asked, cache, ["position"], "inner")


def cache_list(cache: DataFrame) -> DataFrame:
    return cache.orderBy("position")


def cache_cycle(cache: DataFrame, steps: int | Column, start: str | None = None) -> DataFrame:
    """The first ``steps`` uids of an endless walk that begins after ``start``.

    Each row works out its own visits, so nothing is joined: the uid at position p
    is met at step (p - begin) mod size and every ``size`` steps from there.
    """
    size = cache.agg(F.count(F.lit(1))).scalar()
    if start is None:
        begin = F.lit(0)
    else:
        begin = cache.where(F.col("uid") == start).agg(F.coalesce(F.min("position") + 1, F.lit(0))).scalar()
    steps = F.lit(steps) if isinstance(steps, int) else steps
    first = F.pmod(F.col("position") - begin, size)
    met = cache.withColumn("__size", size).withColumn("__first", first).withColumn("__steps", steps)
    visits = F.sequence(F.col("__first"), F.col("__steps") - 1, F.col("__size"))
    return met.where(F.col("__first") < F.col("__steps")).select(F.explode(visits).alias("step"), "uid")

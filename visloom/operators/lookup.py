"""Finding examples by UID, sample id or position."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visloom.functions.text import parse_sample_id
from visloom.operators.joins import listed, spread_join


def uid_index(df: DataFrame) -> DataFrame:
    """(uid, index); the last position wins for a repeated uid."""
    return df.groupBy("uid").agg(F.max("index").alias("index"))


def find_by_uid(df: DataFrame, uid: str, limit: int | None = None) -> DataFrame:
    """The first row with the uid, looking only at the first ``limit`` positions if given."""
    scope = df if limit is None else df.where(F.col("index") < limit)
    return scope.where(F.col("uid") == uid).orderBy("index").limit(1)


def fetch_by_uid(df: DataFrame, uid: str, limit: int | None = None):
    """The row itself; ``KeyError`` when the slice does not hold the uid."""
    rows = find_by_uid(df, uid, limit).take(1)
    if not rows:
        raise KeyError(f"no row of the slice has the uid {uid!r}")
    return rows[0]


def first_by_uid(df: DataFrame, wanted: DataFrame) -> DataFrame:
    """One row per wanted uid, the one with the lowest position.

    A short list is broadcast and filters the scan. Of a uid's copies each task keeps one, so
    only about as many rows are shuffled as uids are wanted.
    """
    matches = df.join(wanted, "uid", "left_semi")
    first = matches.groupBy("uid").agg(F.min_by(F.struct(*df.columns), "index").alias("__row"))
    return first.select("__row.*")


def _require(df: DataFrame, found: Column, message: Column) -> DataFrame:
    """Fail on the first row that was not found; a filter, so it is never pruned away."""
    return df.where(F.when(found, True).otherwise(F.raise_error(message).cast("boolean")))


def lookup_uids(df: DataFrame, uids: Sequence[str] | DataFrame, strict: bool = True) -> DataFrame:
    """Rows for requested uids, repeats kept; ``pos`` gives the request order.

    ``uids`` is a list or a table (pos, uid). A missing uid fails when ``strict``;
    otherwise it comes back with ``found`` false.
    """
    if isinstance(uids, DataFrame):
        requests, wanted = uids, uids.select("uid").distinct()
    else:
        requests = listed(df.sparkSession, "uid", uids)
        wanted = listed(df.sparkSession, "uid", sorted(set(uids))).select("uid")
    matches = first_by_uid(df, wanted).withColumn("found", F.lit(True))
    out = spread_join(requests, matches, ["uid"], "left", spread=["pos"])
    if strict:
        return _require(out, F.col("found").isNotNull(), F.concat(F.lit("UID not found: "), F.col("uid"))).drop("found")
    return out.withColumn("found", F.coalesce("found", F.lit(False)))


def parsed_ids(ids: DataFrame, strict: bool = True) -> DataFrame:
    """Split ``sample_id`` into its coordinates; malformed ids fail or stay null."""
    out = ids.withColumn("__id", parse_sample_id(F.col("sample_id")))
    if strict:
        message = F.concat(F.lit("malformed sample_id: "), F.col("sample_id"))
        out = _require(out, F.col("__id").isNotNull(), message)
    return out.select(*ids.columns, "__id.dataset", "__id.config", "__id.split", "__id.index")


def lookup_sample_ids(df: DataFrame, ids: Sequence[str] | DataFrame, strict: bool = True) -> DataFrame:
    """Rows of (dataset, config, split, index) for the given sample ids.

    The parts of a list of ids go into the scan as filters, so stored data is pruned by its
    partition columns; a table of ids is joined.
    """
    keys = ["dataset", "config", "split", "index"]
    if isinstance(ids, DataFrame):
        requests = ids
    else:
        requests = listed(df.sparkSession, "sample_id", ids)
        parts = [x.split(":") for x in ids]
        for k, key in enumerate(keys[:3]):
            df = df.where(F.col(key).isin(sorted({p[k] for p in parts if len(p) == 4})))
    wanted = parsed_ids(requests, strict).where(F.col("index").isNotNull())
    return spread_join(wanted, df, keys, "inner", spread=requests.columns)


def at_index(df: DataFrame, index: int) -> DataFrame:
    """The row at a position; out of bounds is an ``IndexError``."""
    hit = df.where(F.col("index") == index)
    if index < 0 or hit.isEmpty():
        raise IndexError(f"index {index} out of range")
    return hit


def lookup_indices(df: DataFrame, requests: DataFrame) -> DataFrame:
    """Rows for a table of requested positions, with ``in_bounds`` telling misses."""
    out = spread_join(requests, df.withColumn("in_bounds", F.lit(True)), ["index"], "left")
    return out.withColumn("in_bounds", F.coalesce("in_bounds", F.lit(False)))


def image_token_ids(vocab: DataFrame, special: Sequence[str]) -> DataFrame:
    """Distinct ids of the special tokens the vocabulary knows, ascending."""
    return (
        vocab.where(F.col("token").isin(list(special)) & F.col("token_id").isNotNull() & (F.col("token_id") != -1))
        .select("token_id")
        .distinct()
        .orderBy("token_id")
    )

"""Keyed tables in numbered versions, and the uid cache kept as one.

A commit writes its changed rows only. What a version consists of stands in one small file, its list, that
appears under the version's number in one step; so readers meet whole versions, and of two writers
that start from one version the second fails instead of undoing the first.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from visloom.operators.joins import listed
from visloom.operators.positions import rerank

MERGE_AT = 16  # changes a version may consist of before they are merged
KEEP_VERSIONS = 32  # versions that stay readable
EMPTY = {"base": None, "changes": [], "facts": {}}


class ConcurrentCommit(RuntimeError):
    """Another writer has made the version this commit was for; read again and repeat."""


class VersionedTable:
    """Rows with the unique ``key`` columns (null is a value) in ``folder``, a place every executor can reach.

    A version is a base and up to ``merge_at`` changes, later ones winning. Then the changes are merged into one,
    or, once they hold a quarter as many rows as the base, all of it into a new base: over time a row
    is rewritten a few times only. Data no kept version lists is deleted at the same time. A table nothing
    was committed to is version 0 and empty.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: StructType | str, key: Sequence[str], merge_at: int = MERGE_AT):
        self.spark, self.folder, self.key, self.merge_at = spark, folder.rstrip("/"), list(key), merge_at
        self.schema = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
        self._changed = StructType([*self.schema.fields]).add("__gone", "boolean")

    # What is stored where

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _fs(self):
        return self._path("log").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, name: str) -> list[str]:
        fs, path = self._fs(), self._path(name)
        return [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []

    def versions(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self._names("log") if n.endswith(".json"))

    def version(self) -> int:
        return max(self.versions(), default=0)

    def _list(self, version: int) -> dict:
        if version == 0:
            return EMPTY
        stream = self._fs().open(self._path(f"log/{version:020d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def fact(self, name: str, default=None):
        """A value the newest version was committed with."""
        return self._list(self.version())["facts"].get(name, default)

    def _publish(self, version: int, entry: dict) -> int:
        jvm = self.spark._jvm
        draft, final = self._path(f"log/{uuid.uuid4().hex}.draft"), self._path(f"log/{version:020d}.json")
        out = self._fs().create(draft, False)
        out.write(json.dumps(entry).encode())
        out.close()
        rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self.spark._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(rename, 0)
        try:
            context.rename(draft, final, none)  # fails where the number is taken
        except Exception as error:
            self._fs().delete(draft, False)
            if "FileAlreadyExists" in str(error):
                raise ConcurrentCommit(f"version {version} of {self.folder} has been written meanwhile") from error
            raise
        return version

    def _put(self, rows: DataFrame, version: int) -> dict:
        name = f"data/{version:020d}-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.folder}/{name}")
        return {"name": name, "rows": self.spark.read.parquet(f"{self.folder}/{name}").count()}

    def _scan(self, part: dict, schema: StructType) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{part['name']}")

    # Reading

    def _newest_changes(self, entry: dict) -> DataFrame:
        """The last change of each key; one row a key."""
        parts = [self._scan(p, self._changed).withColumn("__turn", F.lit(k)) for k, p in enumerate(entry["changes"])]
        if len(parts) == 1:
            return parts[0].drop("__turn")
        rest = [c for c in self._changed.names if c not in self.key]
        last = F.max_by(F.struct(*rest), "__turn").alias("last")
        return reduce(DataFrame.unionByName, parts).groupBy(*self.key).agg(last).select(*self.key, "last.*")

    def _rows(self, entry: dict) -> DataFrame:
        columns = self.schema.names
        base = self._scan(entry["base"], self.schema) if entry["base"] else self.spark.createDataFrame([], self.schema)
        if not entry["changes"]:
            return base
        newest = self._newest_changes(entry)
        touched = newest.select(*[F.col(k).alias(f"__{k}") for k in self.key])
        same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in self.key])
        return base.join(touched, same, "left_anti").unionByName(newest.where(~F.col("__gone")).select(*columns))

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of a version, the newest if none is given; later commits do not change the answer."""
        return self._rows(self._list(self.version() if version is None else version))

    # Writing

    def commit(
        self,
        upserts: DataFrame | None = None,
        deletes: DataFrame | None = None,
        batch: int | None = None,
        facts: Callable[[DataFrame], dict] | None = None,
        since: int | None = None,
    ) -> int:
        """Add or replace the rows ``upserts`` and remove those with the keys ``deletes``; returns the version.

        Both together may name a key once. ``batch`` numbers the batches of a stream: one that has been committed already is
        left out, so a restarted stream may repeat its last batch. ``facts`` makes small values from
        the written changes, to be stored with the version. ``since`` is the version the changes were worked out from
        (default: the newest). Changes without rows make no version.
        """
        number = self.version() if since is None else since
        entry = self._list(number)
        if batch is not None and batch <= entry["facts"].get("batch", -1):
            return number
        gone = F.lit(True).alias("__gone")
        parts = []
        if upserts is not None:
            parts.append(upserts.select(*[F.col(f.name).cast(f.dataType) for f in self.schema], F.lit(False).alias("__gone")))
        if deletes is not None:
            blank = [F.col(f.name).cast(f.dataType) if f.name in self.key else F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema]
            parts.append(deletes.select(*blank, gone))
        part = self._put(reduce(DataFrame.unionByName, parts), number + 1)
        if part["rows"] == 0:
            return number
        known = dict(entry["facts"])
        if facts:
            known.update(facts(self._scan(part, self._changed)))
        if batch is not None:
            known["batch"] = batch
        made = self._publish(number + 1, {"base": entry["base"], "changes": [*entry["changes"], part], "facts": known})
        if len(entry["changes"]) + 1 >= self.merge_at:
            made = self.compact()
        return made

    def clear(self) -> int:
        """A version without rows; the facts stay."""
        number = self.version()
        return self._publish(number + 1, {**EMPTY, "facts": self._list(number)["facts"]})

    def compact(self, keep: int = KEEP_VERSIONS) -> int:
        """Merge the changes (see the class) into a version with the same rows, and delete what is older than ``keep`` versions."""
        number = self.version()
        entry = self._list(number)
        if entry["changes"]:
            changed = sum(p["rows"] for p in entry["changes"])
            if entry["base"] is None or 4 * changed >= entry["base"]["rows"]:
                merged = {"base": self._put(self._rows(entry), number + 1), "changes": []}
            else:
                merged = {"base": entry["base"], "changes": [self._put(self._newest_changes(entry), number + 1)]}
            number = self._publish(number + 1, {**merged, "facts": entry["facts"]})
        self._vacuum(keep)
        return number

    def _vacuum(self, keep: int) -> None:
        """Delete the lists before the last ``keep`` and all data that the others do not name.

        Data of a commit under way carry the number of a version to come, and stay.
        """
        versions = self.versions()
        kept, fs = versions[-keep:], self._fs()
        for old in versions[:-keep]:
            fs.delete(self._path(f"log/{old:020d}.json"), False)
        named = set()
        for version in kept:
            entry = self._list(version)
            named |= {p["name"] for p in [entry["base"], *entry["changes"]] if p}
        for name in self._names("data"):
            if f"data/{name}" not in named and int(name.partition("-")[0]) <= versions[-1]:
                fs.delete(self._path(f"data/{name}"), True)


class StoredCache:
    """The uid cache (operators.uid_cache) as a versioned table: adding, removing and clearing write their change only.

    A place is a number that only grows, so a removal moves nothing; positions 0..n-1 are counted when the
    cache is read, as a table (position, uid) all operators of ``uid_cache`` take.
    """

    def __init__(self, spark: SparkSession, folder: str, merge_at: int = MERGE_AT):
        self.spark = spark
        self.table = VersionedTable(spark, folder, "place bigint, uid string", ["place"], merge_at)

    def read(self, version: int | None = None) -> DataFrame:
        return rerank(self.table.read(version), "place", "position").select("position", "uid")

    def _append(self, rows: DataFrame, version: int) -> int:
        """``rows`` holds (order, uid), order from 0."""
        first = self.table._list(version)["facts"].get("next", 0)
        placed = rows.select((F.col("order") + first).alias("place"), "uid")
        ends = lambda written: {"next": written.agg(F.max("place")).first()[0] + 1}
        return self.table.commit(upserts=placed, facts=ends, since=version)

    def load(self, cache: DataFrame) -> int:
        """Put the rows of a cache table (position, uid) behind those there are, repeats included."""
        return self._append(rerank(cache.select("uid", "position"), "position", "order"), self.table.version())

    def extend(self, new: DataFrame | Sequence[str]) -> int:
        """Append unseen uids in order of arrival; ``new`` is (pos, uid) or a list."""
        if not isinstance(new, DataFrame):
            new = listed(self.spark, "uid", new)
        version = self.table.version()
        arrivals = new.groupBy("uid").agg(F.min("pos").alias("__pos"))
        unseen = arrivals.join(self.table.read(version).select("uid"), "uid", "left_anti")
        return self._append(rerank(unseen, "__pos", "order"), version)

    def remove(self, uids: DataFrame | Sequence[str]) -> int:
        """Drop the first place of each uid; unknown ones do nothing."""
        if not isinstance(uids, DataFrame):
            uids = listed(self.spark, "uid", uids)
        version = self.table.version()
        asked = self.table.read(version).join(uids.select("uid"), "uid", "left_semi")
        return self.table.commit(deletes=asked.groupBy("uid").agg(F.min("place").alias("place")).select("place"), since=version)

    def clear(self) -> int:
        return self.table.clear()

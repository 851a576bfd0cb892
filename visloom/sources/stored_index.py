"""Stored indexes of a Parquet folder: positions → files, and UIDs → (file, row).

Both are small tables beside the data, built by one narrow scan and extended when files are added.
Look-ups then open only the files that can hold what is asked for. Positions count rows
in file order (by path), so appended files must sort behind the older ones.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from visloom.session import materialized

FILE, ROW = "_metadata.file_path", "_metadata.row_index"
BUCKETS = 256
CHUNK = 1 << 20
RANGES = "file string, rows bigint"


def _files(df: DataFrame) -> list[str]:
    """The files Spark has listed for a scan, named as in their metadata."""
    return [re.sub("^file:/+", "file:/", f) for f in df.inputFiles()]


def _stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A stored table, empty where nothing has been written yet."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        return spark.read.schema(schema).parquet(path)
    return spark.createDataFrame([], schema)


class PositionIndex:
    """Rows per file of the Parquet folder ``path``, stored in ``index``.

    ``refresh`` counts only files not yet known. The first position of each file is the sum
    of the earlier ones' rows, one row per file.
    """

    def __init__(self, spark: SparkSession, path: str, index: str):
        self.spark, self.path, self.index = spark, path, index

    def refresh(self) -> PositionIndex:
        known = [r["file"] for r in _stored(self.spark, self.index, RANGES).collect()]
        new = sorted(set(_files(self.spark.read.parquet(self.path))) - set(known))
        if known and new and new[0] < max(known):
            raise ValueError(f"{new[0]} sorts before indexed files: positions would move")
        if new:
            counted = self.spark.read.parquet(*new).select(F.col(FILE).alias("file")).groupBy("file")
            counted.agg(F.count(F.lit(1)).alias("rows")).coalesce(1).write.mode("append").parquet(self.index)
        return self

    def ranges(self) -> DataFrame:
        """(file, first, rows) of every file."""
        earlier = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
        stored = _stored(self.spark, self.index, RANGES)
        return stored.select("file", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("first"), "rows")

    def _read(self, ranges: list, columns: Sequence[str] | None) -> DataFrame:
        """The rows of some files with their positions."""
        if not ranges:
            empty = self.spark.read.parquet(self.path).where("false")
            return empty.select(*(columns or empty.columns), F.lit(0).cast("bigint").alias("index"))
        scan = self.spark.read.parquet(*[r["file"] for r in ranges])
        starts = self.spark.createDataFrame([(r["file"], r["first"]) for r in ranges], "__file string, __first bigint")
        rows = scan.select(*(columns or scan.columns), F.col(FILE).alias("__file"), F.col(ROW).alias("__row"))
        # The list of files is part of the scan already, so it is no longer than what the driver holds anyway.
        rows = rows.join(F.broadcast(starts), "__file").withColumn("index", F.col("__first") + F.col("__row"))
        return rows.drop("__file", "__first", "__row")

    def slice(self, skip: int = 0, limit: int | None = None, columns: Sequence[str] | None = None) -> DataFrame:
        """Rows ``skip`` .. ``skip + limit - 1``, from the files that hold some of them."""
        within = F.col("first") + F.col("rows") > skip
        index = F.col("index") >= skip
        if limit is not None:
            within, index = within & (F.col("first") < skip + limit), index & (F.col("index") < skip + limit)
        return self._read(self.ranges().where(within).collect(), columns).where(index)

    def at(self, index: int, columns: Sequence[str] | None = None) -> DataFrame:
        """The row at a position, from its file; out of bounds is an ``IndexError``."""
        hit = self.ranges().where((F.col("first") <= index) & (F.col("first") + F.col("rows") > index)).collect()
        if index < 0 or not hit:
            raise IndexError(f"index {index} out of range")
        return self._read(hit, columns).where(F.col("index") == index)

    def lookup(self, requests: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
        """Rows for a table of requested positions (index), with ``in_bounds`` telling misses.

        The files are found first: positions and row ranges meet by blocks of CHUNK positions.
        """
        ranges = self.ranges().where("rows > 0").withColumn("end", F.col("first") + F.col("rows"))
        chunks = F.sequence(F.floor(F.col("first") / CHUNK), F.floor((F.col("end") - 1) / CHUNK))
        asked = requests.select("index", F.floor(F.col("index") / CHUNK).alias("chunk")).distinct()
        met = ranges.withColumn("chunk", F.explode(chunks)).join(asked, "chunk")
        hit = met.where((F.col("index") >= F.col("first")) & (F.col("index") < F.col("end")))
        rows = self._read(hit.select("file", "first").distinct().collect(), columns).withColumn("in_bounds", F.lit(True))
        out = requests.join(rows, "index", "left")
        return out.withColumn("in_bounds", F.coalesce("in_bounds", F.lit(False)))


ENTRIES = "bucket int, uid string, file string, row bigint"


class UidIndex:
    """(uid → file, row) of the Parquet folder ``path``, stored in ``index``.

    Entries lie in folders by a hash of the uid, sorted by uid and with a bloom filter, so a look-up
    opens a bucket or two and skips row groups. ``refresh`` adds the files not yet indexed; their
    names are written after their entries, so a run that broke off is simply repeated.
    """

    def __init__(self, spark: SparkSession, path: str, index: str, uid: str = "uid", buckets: int = BUCKETS):
        self.spark, self.path, self.uid, self.buckets = spark, path, uid, buckets
        self.entries_path, self.files_path = f"{index.rstrip('/')}/entries", f"{index.rstrip('/')}/files"

    def _bucket(self, uid: Column) -> Column:
        return F.pmod(F.xxhash64(uid), F.lit(self.buckets)).cast("int")

    def refresh(self) -> UidIndex:
        known = {r["file"] for r in _stored(self.spark, self.files_path, "file string").collect()}
        new = sorted(set(_files(self.spark.read.parquet(self.path))) - known)
        if new:
            uid = F.col(self.uid).cast("string")
            found = self.spark.read.parquet(*new).where(uid.isNotNull())
            entries = found.select(self._bucket(uid).alias("bucket"), uid.alias("uid"), F.col(FILE).alias("file"), F.col(ROW).alias("row"))
            entries = entries.repartition("bucket").sortWithinPartitions("bucket", "uid")
            writer = entries.write.mode("append").partitionBy("bucket")
            writer.option("parquet.bloom.filter.enabled#uid", "true").parquet(self.entries_path)
            names = self.spark.createDataFrame([(f,) for f in new], "file string")
            names.coalesce(1).write.mode("append").parquet(self.files_path)
        return self

    def entries(self, uids: Sequence[str]) -> DataFrame:
        """(uid, file, row) of some uids: the first place of each, in file order."""
        wanted = sorted(set(uids))
        asked = self.spark.createDataFrame([(u,) for u in wanted], "uid string").select(self._bucket(F.col("uid")).alias("b"))
        buckets = sorted(r["b"] for r in asked.distinct().collect())
        stored = _stored(self.spark, self.entries_path, ENTRIES)
        hits = stored.where(F.col("bucket").isin(buckets) & F.col("uid").isin(wanted))
        return self._first(hits)

    def _first(self, hits: DataFrame) -> DataFrame:
        first = hits.groupBy("uid").agg(F.min(F.struct("file", "row")).alias("at"))
        return first.select("uid", "at.file", "at.row")

    def lookup_table(self, wanted: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
        """One row per distinct uid of a table that is found, its first place, from the files that hold some of them.

        Index and request meet by bucket and uid; the data is read by place, not searched.
        """
        asked = wanted.select(F.col("uid").cast("string")).distinct().withColumn("bucket", self._bucket(F.col("uid")))
        hits = _stored(self.spark, self.entries_path, ENTRIES).join(asked, ["bucket", "uid"], "left_semi")
        found = materialized(self._first(hits), "uid-places").select(F.col("file").alias("__file"), F.col("row").alias("__row"))
        names = [r[0] for r in found.select("__file").distinct().collect()]
        if not names:
            return self.spark.read.parquet(self.path).select(*(columns or ["*"])).where("false")
        scan = self.spark.read.parquet(*sorted(names))
        rows = scan.select(*(columns or scan.columns), F.col(FILE).alias("__file"), F.col(ROW).alias("__row"))
        return rows.join(found, ["__file", "__row"], "left_semi").drop("__file", "__row")

    def lookup(self, uids: Sequence[str], columns: Sequence[str] | None = None, strict: bool = True) -> DataFrame:
        """One row per distinct uid of a list, its first place; ``KeyError`` names missing ones if ``strict``."""
        found = self.entries(uids).collect()
        missing = sorted(set(uids) - {r["uid"] for r in found})
        if strict and missing:
            raise KeyError(f"no row has the uids {missing[:10]!r}")
        if not found:
            return self.spark.read.parquet(self.path).select(*(columns or ["*"])).where("false")
        scan = self.spark.read.parquet(*sorted({r["file"] for r in found}))
        places = self.spark.createDataFrame([(r["file"], r["row"]) for r in found], "__file string, __row bigint")
        # The list came from the caller; its uids are a filter of the scan, too.
        rows = scan.where(F.col(self.uid).cast("string").isin(sorted({r["uid"] for r in found})))
        rows = rows.select(*(columns or scan.columns), F.col(FILE).alias("__file"), F.col(ROW).alias("__row"))
        return rows.join(F.broadcast(places), ["__file", "__row"], "left_semi").drop("__file", "__row")

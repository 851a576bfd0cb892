"""Structured Streaming forms: normalise on arrival, running totals, dedup, log append."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from visloom.functions.scoring import exact
from visloom.sinks.versioned import VersionedTable

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def state_on_disk(spark: SparkSession) -> Iterator[None]:
    """Start streams with their state in RocksDB, outside the heap, unless the session names a store itself."""
    own = spark.conf.get(PROVIDER, None)
    if own is None:
        spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        if own is None:
            spark.conf.unset(PROVIDER)


def file_stream(spark: SparkSession, folder: str, pattern: str, schema, fmt: str = "parquet") -> DataFrame:
    """New files as a stream: those of a folder whose names match the glob ``pattern``, or inside folders of such names."""
    return spark.readStream.format(fmt).schema(schema).load(f"{folder.rstrip('/')}/{pattern}")


def running_totals(records: DataFrame, by: Sequence[str]) -> DataFrame:
    """Samples, tokens and bits so far, one state per group; batches are combined before the shuffle."""
    return records.groupBy(*by).agg(
        F.count(F.lit(1)).alias("samples"),
        F.sum("num_tokens").cast("bigint").alias("total_tokens"),
        F.sum(exact(F.col("total_surprisal_bits"))).cast("double").alias("total_surprisal_bits"),
    )


def _thinned(records: DataFrame, uid: str) -> DataFrame:
    """Without the rows whose uid an earlier row of the same Arrow batch has; no state is kept.

    A stream's dedup has no step before the shuffle, so this one sees to it that a uid with a third of all rows
    sends one row per batch of rows.
    """

    def first_of_batch(batches):
        import pyarrow as pa

        for batch in batches:
            numbered = pa.table([batch.column(uid), pa.array(range(batch.num_rows), pa.int64())], ["uid", "row"])
            firsts = numbered.group_by("uid").aggregate([("row", "min")])["row_min"]
            yield batch.take(pa.concat_arrays(firsts.chunks))

    return records.mapInArrow(first_of_batch, records.schema)


def first_seen(records: DataFrame, uid: str = "uid", keep_seconds: int | None = None) -> DataFrame:
    """Each uid once: over the life of the stream, or of the last ``keep_seconds``.

    One state per uid. With ``keep_seconds`` a uid is remembered for at least that long after its first row has
    arrived, and its state is dropped by one of the batches that follow; a copy that comes later counts as new. So the
    state holds recent arrivals only. Without, state is kept for every uid. Use :func:`first_seen_within` when an
    event time bounds how late a copy can come.
    """
    thinned = _thinned(records, uid)
    if keep_seconds is None:
        return thinned.dropDuplicates([uid])
    timed = thinned.withColumn("__arrived", F.current_timestamp()).withWatermark("__arrived", f"{keep_seconds} seconds")
    return timed.dropDuplicatesWithinWatermark([uid]).drop("__arrived")


def first_seen_within(records: DataFrame, event_time: str, delay: str, uid: str = "uid") -> DataFrame:
    """Each uid once within the watermark delay; older state is dropped."""
    timed = records.withColumn(event_time, F.col(event_time).cast("timestamp"))
    return timed.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([uid])


def run_to_files(stream: DataFrame, path: str, checkpoint: str, fmt: str = "parquet", **options: str) -> None:
    """Process what has arrived since the last call with this ``checkpoint``, appending to files.

    ``checkpoint`` belongs to ``path``: give the same pair on every call, and a restart goes on
    where the last call ended, each row written once.
    """
    writer = stream.writeStream.format(fmt).outputMode("append").options(**options)
    with state_on_disk(stream.sparkSession):
        query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
        query.awaitTermination()


def run_totals_to_table(totals: DataFrame, by: Sequence[str], path: str, checkpoint: str) -> DataFrame:
    """Bring the table of running totals in ``path`` up to date with what has arrived, and read it.

    The state lives in ``checkpoint``, which belongs to ``path``. A batch emits only the groups it changed, and
    they are committed to a versioned table under the batch's number: a batch repeated after a restart
    counts once, a reader never meets half of one, and old versions are deleted as changes are merged.
    """
    spark = totals.sparkSession
    table = VersionedTable(spark, path, totals.schema, by)

    def write(batch: DataFrame, number: int) -> None:
        table.commit(upserts=batch, batch=number)

    writer = totals.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
    with state_on_disk(spark):
        writer.trigger(availableNow=True).start().awaitTermination()
    return table.read()

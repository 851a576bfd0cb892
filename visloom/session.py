"""Session settings and the shared folder for checkpoints and written tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# AQE splits skewed join sides and coalesces small shuffle partitions at run time.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


# Shuffle bytes one task should hold; it then sorts and aggregates without spilling much.
PARTITION_BYTES = 128 << 20


def partitions_for(input_bytes: int) -> int:
    """Shuffle partitions for an input size; AQE merges those that turn out small."""
    return max(200, -(-input_bytes // PARTITION_BYTES))


def build_session(master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """Start (or reuse) a session; on a cluster leave ``master`` to spark-submit.

    Give ``shuffle_partitions`` from :func:`partitions_for` when the input is large.
    """
    builder = SparkSession.builder.appName("visloom")
    if master:
        builder = builder.master(master)
    settings = dict(DEFAULTS)
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach: ``spark.checkpoint.dir``.

    A session inside one process (tests, trials) that lacks the setting gets a temporary
    folder; any other session without it is an error, since executors do not share local disks.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if root:
        return root
    if not (sc.master == "local" or sc.master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="visloom-"))
    return sc.getCheckpointDir()


def materialized(df: DataFrame, name: str) -> DataFrame:
    """Write a table several later steps read, and read it back.

    The steps then scan only the columns they need and do not repeat the work before
    it; lost executors cost nothing, since the files are in the shared folder.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; nothing there is reused or overwritten."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


# Spark counts a file as 4 MB at least, so 32 files of a few bytes fill a task; opening one costs far less than reading that much.
FILE_COST = 64 << 10


def for_small_files(spark: SparkSession) -> SparkSession:
    """A session beside ``spark``, with the settings it has now, whose scans put many small files into a task.

    Tables read with it can be joined with others; the left one's session plans the scans.
    """
    beside = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if spark.conf.isModifiable(key) and beside.conf.get(key, None) != value:
            beside.conf.set(key, value)
    beside.conf.set("spark.sql.files.openCostInBytes", str(FILE_COST))
    return beside

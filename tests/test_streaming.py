import time

import pytest
from pyspark.sql import functions as F

from visloom.session import scratch_path, shared_dir
from visloom.sinks.versioned import VersionedTable
from visloom.streaming import streams


def test_dedup_across_batches(spark, tmp_path):
    schema = "uid string, n int"
    folder = f"{tmp_path}/in"
    rows = [("hot", i) for i in range(200)] + [("a", 1), ("b", 2)]
    spark.createDataFrame(rows, schema).repartition(4).write.parquet(folder)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    streams.run_to_files(streams.first_seen(stream).select("uid"), f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    assert sorted(r[0] for r in spark.read.parquet(f"{tmp_path}/out").collect()) == ["a", "b", "hot"]


def test_states_end(spark, tmp_path):
    """Batch and stream agree over two restarts, a hot uid among them; an ended state lets its uid in again."""
    schema, folder = "uid string, n int", f"{tmp_path}/in"
    arrivals = [[("hot", n) for n in range(300)] + [("a", 1), (None, 1)], [("hot", 1), ("b", 1)], [("a", 2), ("c", 1), (None, 2)]]
    spark.createDataFrame([], schema).write.parquet(folder)
    stream = spark.readStream.schema(schema).parquet(folder)

    def run(name, seconds):
        found = streams.first_seen(stream, keep_seconds=seconds).select("uid")
        streams.run_to_files(found, f"{tmp_path}/{name}", f"{tmp_path}/{name}-checkpoint")
        return sorted(str(r[0]) for r in spark.read.schema("uid string").parquet(f"{tmp_path}/{name}").collect())

    for rows in arrivals:
        spark.createDataFrame(rows, schema).repartition(3).write.mode("append").parquet(folder)
        day, moment = run("day", 86_400), run("moment", 1)
        time.sleep(3)
    assert day == ["None", "a", "b", "c", "hot"]
    assert set(moment) == set(day) and moment.count("a") == 2


def test_state_size_is_one_row_a_uid(spark, tmp_path):
    schema = "uid string, n int"
    spark.createDataFrame([(f"u{n % 7}", n) for n in range(500)], schema).repartition(6).write.parquet(f"{tmp_path}/in")
    found = streams.first_seen(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"))
    with streams.state_on_disk(spark):
        query = found.writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        query.awaitTermination()
    states = [o["numRowsTotal"] for p in query.recentProgress for o in p["stateOperators"]]
    assert max(states) == 7
    assert spark.conf.get(streams.PROVIDER, None) is None


def test_dedup_within_watermark(spark, sf):
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    stream = streams.file_stream(spark, sf, "events.parquet*", schema).select("ts", F.col("user_id").alias("uid"))
    target = scratch_path(spark, "within")
    streams.run_to_files(streams.first_seen_within(stream, "ts", "365 days").select("uid"), target, f"{target}-checkpoint")
    users = spark.read.parquet(f"{sf}/events.parquet").select("user_id").distinct().count()
    assert spark.read.parquet(target).count() == users


def test_totals_over_several_batches(spark, tmp_path):
    schema = "source string, num_tokens int, total_surprisal_bits double"
    spark.createDataFrame([("s", 2, 0.1)] * 30 + [("t", 1, 0.2)], schema).repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")

    def totals():
        out = streams.run_totals_to_table(
            streams.running_totals(stream, ["source"]), ["source"], f"{tmp_path}/totals", f"{tmp_path}/checkpoint"
        )
        return {r["source"]: (r["samples"], r["total_tokens"], round(r["total_surprisal_bits"], 6)) for r in out.collect()}

    assert totals() == {"s": (30, 60, 3.0), "t": (1, 1, 0.2)}
    assert totals() == {"s": (30, 60, 3.0), "t": (1, 1, 0.2)}  # nothing new
    spark.createDataFrame([("t", 2, 0.5)], schema).write.mode("append").parquet(f"{tmp_path}/in")
    assert totals() == {"s": (30, 60, 3.0), "t": (2, 3, 0.7)}
    # The last batch changed one group, and that is all it wrote.
    table = VersionedTable(spark, f"{tmp_path}/totals", "source string", ["source"])
    assert table._list(table.version())["changes"][-1]["rows"] == 1


def test_a_table_may_be_a_file_or_a_folder(spark, tmp_path):
    spark.range(7).repartition(3).write.parquet(f"{tmp_path}/in/t.parquet")
    spark.range(9).write.parquet(f"{tmp_path}/in/other.parquet")
    stream = streams.file_stream(spark, f"{tmp_path}/in", "t.parquet*", "id long")
    streams.run_to_files(stream, f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    assert sorted(r["id"] for r in spark.read.parquet(f"{tmp_path}/out").collect()) == list(range(7))


def test_restart_takes_up_new_files_once(spark, tmp_path):
    folder, out = f"{tmp_path}/in", f"{tmp_path}/out"
    spark.range(5).write.parquet(folder)
    stream = spark.readStream.schema("id long").parquet(folder)
    streams.run_to_files(stream, out, f"{tmp_path}/checkpoint")
    spark.range(5, 12).write.mode("append").parquet(folder)
    streams.run_to_files(stream, out, f"{tmp_path}/checkpoint")
    streams.run_to_files(stream, out, f"{tmp_path}/checkpoint")
    assert sorted(r["id"] for r in spark.read.parquet(out).collect()) == list(range(12))


def test_shared_dir_needs_a_setting_on_a_cluster(spark, monkeypatch):
    assert shared_dir(spark)

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        sparkContext = Context()
        conf = Conf()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(Session())

import pytest
from pyspark.sql import functions as F

from visloom.operators import lookup, sampling
from visloom.session import scratch_path
from visloom.sources import stored_index as si
from visloom.sources.scan import scan_with_index


@pytest.fixture
def folder(spark):
    """Five files of 40 rows, uids scattered over them and some repeated."""
    path = scratch_path(spark, "indexed")
    for part in range(5):
        write_part(spark, path, part)
    return path


def write_part(spark, path, part):
    rows = spark.range(part * 40, part * 40 + 40, numPartitions=1).select(
        F.concat(F.lit("u"), F.when(F.col("id") % 10 == 9, F.lit(9)).otherwise(F.col("id") * 7 % 400)).alias("uid"),
        F.col("id").alias("value"),
        F.when(F.col("id") % 3 == 0, "x").alias("file"),
    )
    rows.write.parquet(f"{path}/part={part:03d}")


def answers(frame, *columns):
    return sorted(tuple(r) for r in frame.select(*columns).collect())


def opened(frame):
    return sum("/indexed-" in f for f in frame.inputFiles())


def test_positions_open_only_their_files(spark, folder):
    index = si.PositionIndex(spark, folder, scratch_path(spark, "ranges")).refresh()
    plain = scan_with_index(spark, folder)
    for skip, limit in ((0, None), (0, 0), (35, 10), (40, 40), (199, 5), (300, 5), (10, 100)):
        want = answers(sampling.skip_limit(plain, skip, limit), "index", "value")
        assert answers(index.slice(skip, limit), "index", "value") == want
    assert opened(index.slice(35, 10)) == 2 and opened(index.slice(40, 40)) == 1
    assert answers(index.at(77), "index", "value") == [(77, 77)] and opened(index.at(77)) == 1
    for bad in (-1, 200):
        with pytest.raises(IndexError):
            index.at(bad)
    asked = spark.createDataFrame([(1, 41), (2, 79), (3, 41), (4, 500), (5, -2), (6, None)], "ask int, index long")
    got = index.lookup(asked, ["value"])
    assert opened(got) == 1
    want = lookup.lookup_indices(plain.select("value", "index"), asked)
    key = lambda r: r["ask"]
    columns = ["ask", "index", "value", "in_bounds"]
    assert sorted(got.select(*columns).collect(), key=key) == sorted(want.select(*columns).collect(), key=key)


def test_position_index_grows_with_the_folder(spark, folder):
    path = scratch_path(spark, "ranges")
    si.PositionIndex(spark, folder, path).refresh()
    write_part(spark, folder, 7)
    index = si.PositionIndex(spark, folder, path).refresh().refresh()
    assert index.ranges().count() == 6
    assert answers(index.slice(200, 3), "index", "value") == [(200, 280), (201, 281), (202, 282)]
    write_part(spark, folder, 5)
    with pytest.raises(ValueError):
        index.refresh()


def test_uids_open_only_their_files(spark, folder):
    index = si.UidIndex(spark, folder, scratch_path(spark, "uids"), buckets=8).refresh()
    plain = scan_with_index(spark, folder)
    for uid in ("u0", "u9", "u7", "u266"):
        want = answers(lookup.find_by_uid(plain, uid), "uid", "value")
        assert answers(index.lookup([uid]), "uid", "value") == want
        assert opened(index.lookup([uid])) == 1
    plan = index.entries(["u7"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: []" not in plan and "EqualTo(uid,u7)" in plan
    with pytest.raises(KeyError):
        index.lookup(["u7", "nowhere"])
    assert answers(index.lookup(["nowhere"], strict=False), "uid") == []
    table = spark.createDataFrame([("u7",), ("u9",), ("nowhere",), ("u7",), (None,)], "uid string")
    got = index.lookup_table(table)
    assert answers(got, "uid", "value") == answers(index.lookup(["u7", "u9"]), "uid", "value") and opened(got) == 1
    assert answers(index.lookup_table(table.where("uid = 'nowhere'")), "uid") == []
    assert answers(index.lookup(["u7", "nowhere", "u7"], strict=False), "uid") == [("u7",)]


def test_uid_index_grows_with_the_folder(spark, folder):
    path = scratch_path(spark, "uids")
    si.UidIndex(spark, folder, path, buckets=8).refresh()
    write_part(spark, folder, 7)
    index = si.UidIndex(spark, folder, path, buckets=8).refresh().refresh()
    late = spark.read.parquet(folder).where("value = 281").first()["uid"]
    want = answers(lookup.find_by_uid(scan_with_index(spark, folder), late), "uid", "value")
    assert answers(index.lookup([late]), "uid", "value") == want
    assert spark.read.parquet(f"{path}/entries").count() == 240

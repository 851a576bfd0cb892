"""Versioned tables against a dict, the stored cache against a list."""

import glob
import random

import pytest

from visloom.operators import uid_cache
from visloom.sinks.versioned import ConcurrentCommit, StoredCache, VersionedTable

SCHEMA = "k string, n int, v string"


def rows(spark, items):
    return spark.createDataFrame([(k, n, v) for (k, n), v in items], SCHEMA)


def held(df):
    found = df.collect()
    out = {(r["k"], r["n"]): r["v"] for r in found}
    assert len(out) == len(found)
    return out


def test_commits_follow_a_dict(spark, tmp_path):
    rng = random.Random(3)
    keys = [(k, n) for k in ("a", "b", None) for n in (1, 2, None)]
    table, want, seen = VersionedTable(spark, f"{tmp_path}/t", SCHEMA, ["k", "n"], merge_at=3), {}, {}
    assert table.version() == 0 and held(table.read()) == {}
    for turn in range(8):
        changed = rng.sample(keys, 4)
        put, cut = {k: f"{turn}" for k in changed[:3]}, changed[3:]
        version = table.commit(rows(spark, put.items()), spark.createDataFrame(cut, "k string, n int"))
        want = {k: v for k, v in {**want, **put}.items() if k not in cut}
        assert held(table.read()) == want and version == table.version()
        seen[version] = dict(want)
    assert all(held(table.read(v)) == rows_ for v, rows_ in seen.items())  # older versions stay as they were
    assert len(table._list(table.version())["changes"]) < 3
    table.clear()
    assert held(table.read()) == {}


def test_small_changes_leave_the_base_alone(spark, tmp_path):
    table = VersionedTable(spark, f"{tmp_path}/t", "id long, v long", ["id"], merge_at=2)
    table.commit(spark.range(1000).selectExpr("id", "id AS v"))
    table.compact()
    base = table._list(table.version())["base"]
    for turn in range(5):
        table.commit(spark.createDataFrame([(turn, -1)], "id long, v long"))
    assert table._list(table.version())["base"] == base
    assert table.read().selectExpr("sum(v)").first()[0] == sum(range(5, 1000)) - 5
    table.compact(keep=1)
    assert len(table.versions()) == 1 and len(glob.glob(f"{tmp_path}/t/data/*")) <= 2
    assert table.read().count() == 1000


def test_the_second_of_two_writers_fails(spark, tmp_path):
    table = VersionedTable(spark, f"{tmp_path}/t", "id long", ["id"])
    start = table.version()
    table.commit(spark.range(3), since=start)
    with pytest.raises(ConcurrentCommit):
        table.commit(spark.range(5), since=start)
    assert table.read().count() == 3 and not glob.glob(f"{tmp_path}/t/log/*.draft")


def test_a_repeated_batch_and_an_empty_one_make_no_version(spark, tmp_path):
    table = VersionedTable(spark, f"{tmp_path}/t", "id long, v int", ["id"])
    one = spark.createDataFrame([(1, 1)], "id long, v int")
    assert table.commit(one, batch=0) == 1
    assert table.commit(one.selectExpr("id", "9 AS v"), batch=0) == 1
    assert table.commit(one.where("false"), batch=1) == 1
    assert [tuple(r) for r in table.read().collect()] == [(1, 1)]


def test_stored_cache_follows_a_list(spark, tmp_path):
    rng = random.Random(11)
    cache, want = StoredCache(spark, f"{tmp_path}/c", merge_at=3), []
    listing = lambda: [r["uid"] for r in uid_cache.cache_list(cache.read()).collect()]
    cache.load(spark.createDataFrame([(0, "b"), (1, "a"), (2, "b")], "position long, uid string"))
    want = ["b", "a", "b"]
    assert listing() == want
    for turn in range(7):
        some = [rng.choice("abcdefgh") for _ in range(3)]
        if turn % 2:
            cache.remove(some)
            for uid in dict.fromkeys(some):
                if uid in want:
                    want.remove(uid)
        else:
            cache.extend(some)
            want += [u for u in dict.fromkeys(some) if u not in want]
        assert listing() == want
    assert [r["position"] for r in cache.read().orderBy("position").collect()] == list(range(len(want)))
    cache.clear()
    assert listing() == []
    cache.extend(["x", "x"])
    assert listing() == ["x"]

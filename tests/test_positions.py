import random

import pytest
from pyspark.sql import functions as F

from visloom.operators import lookup, sampling, uid_cache
from visloom.operators.joins import spread_join
from visloom.operators.positions import random_positions, rerank
from visloom.sources.scan import first_available, scan_with_index


@pytest.fixture(scope="module")
def scanned(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("scan") / "t")
    spark.range(0, 1000, 1, 7).select(F.col("id").alias("k")).write.parquet(folder)
    return folder


@pytest.mark.parametrize("limit", [100_000, 0])
def test_index_over_many_files(spark, scanned, limit):
    df = scan_with_index(spark, scanned, ["k"], max_broadcast_files=limit, chunk_rows=16)
    got = {r["k"]: r["index"] for r in df.collect()}
    assert sorted(got.values()) == list(range(1000))
    # Inside a file the order of rows is kept.
    files = spark.read.parquet(scanned).select("k", F.col("_metadata.file_path").alias("f")).collect()
    by_file = {}
    for r in files:
        by_file.setdefault(r["f"], []).append(r["k"])
    expected = [k for f in sorted(by_file) for k in sorted(by_file[f])]
    assert [k for k, _ in sorted(got.items(), key=lambda kv: kv[1])] == expected


def test_rerank_small_chunks(spark):
    kept = [p for p in range(500) if p % 3 and p % 7]
    df = spark.createDataFrame([(p, "a" if p < 400 else "b") for p in kept], "p bigint, g string").repartition(5)
    whole = {r["p"]: r["index"] for r in rerank(df, "p", chunk=10).collect()}
    assert whole == {p: i for i, p in enumerate(kept)}
    parts = {(r["g"], r["p"]): r["index"] for r in rerank(df, "p", partition=("g",), chunk=10).collect()}
    first = [p for p in kept if p < 400]
    second = [p for p in kept if p >= 400]
    assert parts == {("a", p): i for i, p in enumerate(first)} | {("b", p): i for i, p in enumerate(second)}


def test_random_positions_ignore_partitioning(spark):
    df = spark.range(300)
    one = {r["id"]: r["position"] for r in random_positions(df.coalesce(1), "id", digits=1).collect()}
    two = {r["id"]: r["position"] for r in random_positions(df.repartition(9), "id", digits=4).collect()}
    assert one == two and sorted(one.values()) == list(range(300))
    other = {r["id"]: r["position"] for r in random_positions(df, "id", seed=1).collect()}
    assert other != one


def test_buffered_shuffle_stays_in_block(spark):
    df = spark.range(100).select(F.col("id").alias("index"))
    rows = sampling.shuffle(df, buffer=25).collect()
    assert sorted(r["position"] for r in rows) == list(range(100))
    assert all(r["index"] // 25 == r["position"] // 25 for r in rows)
    assert any(r["index"] != r["position"] for r in rows)


def test_skip_limit(spark):
    df = spark.range(10).select(F.col("id").alias("index"))

    def got(**kw):
        return sorted(r[0] for r in sampling.skip_limit(df, **kw).collect())

    assert got(skip=3, limit=2) == [3, 4]
    assert got(skip=8) == [8, 9]
    assert got(limit=0) == []
    assert got(skip=20, limit=5) == []
    assert got() == list(range(10))


def test_materialize_and_sample(spark):
    df = spark.range(10).select(F.col("id").alias("index"))
    with pytest.raises(ValueError):
        sampling.materialize(df, None, lazy=True)
    assert sampling.materialize(df, 50).count() == 10
    assert sorted(r[0] for r in sampling.materialize(df, 3, lazy=True).collect()) == [0, 1, 2]
    assert sampling.sample_n(df, 99).count() == 10
    a = sorted(r[0] for r in sampling.sample_n(df, 4).collect())
    assert a == sorted(r[0] for r in sampling.sample_n(df.repartition(6), 4).collect()) and len(set(a)) == 4


@pytest.mark.parametrize("how", ["inner", "left"])
def test_spread_join_equals_plain_join(spark, how):
    rng = random.Random(1)
    left_rows = [(rng.choice(["hot"] * 8 + ["a", "b", None, "x"]), i) for i in range(400)]
    left = spark.createDataFrame(left_rows, "k string, i int")
    right = spark.createDataFrame([("hot", 1), ("a", 2), ("b", 3), ("unused", 4)], "k string, v int")
    got = spread_join(left, right, ["k"], how, hot_rows=50)
    few = spread_join(left, right, ["k"], how, spread=["i"], hot_rows=10, hot_keys=1, max_salts=3)
    assert sorted(map(repr, few.select("k", "i", "v").collect())) == sorted(map(repr, got.select("k", "i", "v").collect()))
    want = left.join(right, "k", how)
    assert sorted(map(repr, got.select("k", "i", "v").collect())) == sorted(map(repr, want.select("k", "i", "v").collect()))


def test_uid_lookups(spark):
    rows = [("a", 0), ("b", 1), ("a", 2), ("c", 3)]
    df = spark.createDataFrame(rows, "uid string, index bigint")
    assert {r["uid"]: r["index"] for r in lookup.uid_index(df).collect()} == {"a": 2, "b": 1, "c": 3}
    assert lookup.fetch_by_uid(df, "a")["index"] == 0
    with pytest.raises(KeyError):
        lookup.fetch_by_uid(df, "c", limit=3)
    found = lookup.lookup_uids(df, ["c", "a", "c"]).orderBy("pos").collect()
    assert [(r["pos"], r["uid"], r["index"]) for r in found] == [(0, "c", 3), (1, "a", 0), (2, "c", 3)]
    with pytest.raises(Exception, match="UID not found"):
        lookup.lookup_uids(df, ["a", "zz"]).count()
    assert lookup.lookup_uids(df, ["a", "zz"], strict=False).where("not found").count() == 1
    assert lookup.at_index(df, 1).first()["uid"] == "b"
    for k in (-1, 4):
        with pytest.raises(IndexError):
            lookup.at_index(df, k)


def test_sample_id_lookup(spark):
    df = spark.createDataFrame([("d", "c", "s", i, f"t{i}") for i in range(5)], "dataset string, config string, split string, index bigint, text string")
    got = lookup.lookup_sample_ids(df, ["d:c:s:00000003", "d:c:s:00000001"]).collect()
    assert {(r["pos"], r["text"]) for r in got} == {(0, "t3"), (1, "t1")}
    with pytest.raises(Exception, match="malformed sample_id"):
        lookup.lookup_sample_ids(df, ["d:c:s:x"]).count()


def cache_of(spark, uids):
    return spark.createDataFrame(list(enumerate(uids)), "position bigint, uid string")


def listing(df):
    rows = df.orderBy("position").collect()
    assert [r["position"] for r in rows] == list(range(len(rows)))
    return [r["uid"] for r in rows]


def test_uid_cache_follows_list_semantics(spark):
    cache = cache_of(spark, ["a", "b", "c"])
    assert listing(uid_cache.cache_extend(cache, ["d", "a", "e", "d", "b", "f"])) == list("abcdef")
    assert listing(uid_cache.cache_add(cache, "a")) == list("abc")
    assert listing(uid_cache.cache_remove(cache, ["b"])) == ["a", "c"]
    assert listing(uid_cache.cache_remove(cache, ["zz"])) == list("abc")
    assert listing(uid_cache.cache_remove(cache_of(spark, ["a", "b", "a"]), ["a"])) == ["b", "a"]
    assert uid_cache.members(cache, cache_of(spark, ["a", "a"])).count() == 1
    assert listing(uid_cache.cache_clear(cache)) == []
    assert listing(uid_cache.cache_extend(uid_cache.cache_clear(cache), ["x", "x"])) == ["x"]
    assert [uid_cache.cache_get(cache, i) for i in (0, 4, -1)] == ["a", "b", "c"]
    with pytest.raises(IndexError):
        uid_cache.cache_get(uid_cache.cache_clear(cache), 0)


@pytest.mark.parametrize("start, expected", [(None, "abcabca"), ("b", "cabcabc"), ("c", "abcabca"), ("zz", "abcabca")])
def test_uid_cycle(spark, start, expected):
    rows = uid_cache.cache_cycle(cache_of(spark, "abc"), 7, start).orderBy("step").collect()
    assert [r["step"] for r in rows] == list(range(7))
    assert "".join(r["uid"] for r in rows) == expected


def test_uid_cycle_short(spark):
    assert uid_cache.cache_cycle(cache_of(spark, "abc"), 2).count() == 2
    assert uid_cache.cache_cycle(uid_cache.cache_clear(cache_of(spark, "abc")), 5).count() == 0


def test_cache_texts(spark):
    texts = ['["a","b","a"]', "{}", "not json", "[1, 2]", "", None, "[]"]
    df = spark.createDataFrame(list(enumerate(texts)), "f int, text string")
    got = {}
    for r in uid_cache.cache_from_text(df).orderBy("f", "position").collect():
        got.setdefault(r["f"], []).append(r["uid"])
    assert got == {0: ["a", "b", "a"], 3: ["1", "2"]}


def test_first_available(spark, scanned):
    with open(f"{scanned}/../broken.parquet", "wb") as broken:
        broken.write(b"no parquet at all")
    assert first_available(spark, ["/nowhere", f"{scanned}/../broken.parquet", scanned], ["k"]).count() == 1000
    with pytest.raises(Exception):
        first_available(spark, ["/nowhere"], ["k"])
    with pytest.raises(ValueError):
        first_available(spark, [], ["k"])


def test_null_keys_keep_their_rows(spark):
    df = spark.createDataFrame([(k, None if k % 3 else "a") for k in range(0, 60, 2)], "p long, g string")
    got = rerank(df, "p", partition=["g"], chunk=7).collect()
    want = {k: n for r in (0, 1) for n, k in enumerate(k for k in range(0, 60, 2) if bool(k % 3) == bool(r))}
    assert {r["p"]: r["index"] for r in got} == want
    placed = random_positions(df, "p", lead=["g"], digits=1).collect()
    assert sorted(r["position"] for r in placed) == list(range(30))
    assert {r["g"] for r in placed if r["position"] < 20} == {None}

"""Components against all pairs, and the parts of the candidate search."""

import random
from collections import defaultdict
from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

from visloom.llm import near_dedup
from visloom.llm.common import Scratch, parity_allows, parity_sketches, table
from visloom.llm.graph import bucket_links, components


def shingles(text, width):
    w = (text or "").encode().lower().split()
    return {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()


def plain_components(rows, width, percent):
    """{doc_id: (set size, component)} by comparing all documents that share a shingle."""
    sets = {d: shingles(t, width) for d, t in rows if d is not None}
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for d in sorted(sets):
        shared = defaultdict(int)
        for s in sets[d]:
            for other in holders[s]:
                shared[other] += 1
            holders[s].append(d)
        for other, n in shared.items():
            if 100 * n >= percent * (len(sets[d]) + len(sets[other]) - n):
                a, b = sorted((root(d), root(other)))
                parent[b] = a
    return {d: (len(s), root(d)) for d, s in sets.items()}


def check(df, rows, width, percent=80):
    want = plain_components(rows, width, percent)
    got = {r["doc_id"]: r for r in near_dedup.near_duplicates(df, width, percent).collect()}
    assert len(got) == len(rows)
    for d, (n, component) in want.items():
        assert (got[d]["n_shingles"], got[d]["component_id"], got[d]["kept"]) == (n, component, d == component)


def test_all_documents(spark, sf):
    df = table(spark, sf, "documents")
    check(df, [(r["doc_id"], r["text"]) for r in df.collect()], 2)


def test_a_large_group_of_near_copies(docs):
    """Copies with a few words changed: similarities on both sides of the limit, chains included."""
    rng = random.Random(11)
    base = [f"w{rng.randrange(5000)}" for _ in range(120)]
    rows = []
    for k in range(250):
        words = list(base)
        for _ in range(rng.randrange(9)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(1000)}"
        rows.append((k, " ".join(words)))
    rows += [(1000 + k, " ".join(base).upper()) for k in range(30)]
    check(docs(rows), rows, 2)


def test_short_empty_and_repeated(docs):
    rows = [(5, "one"), (3, "ONE"), (9, "one two"), (8, "one\ttwo"), (7, ""), (6, " \n"), (4, None), (2, "é one"), (1, "É one")]
    check(docs(rows), rows, 2)
    got = near_dedup.near_duplicates(docs([(1, "a b c"), (1, "a b c"), (None, "a b c"), (2, "A B C")]), 2).collect()
    brief = sorted((r["doc_id"] or -1, r["component_id"] or -1, r["kept"]) for r in got)
    assert brief == [(-1, -1, True), (1, 1, True), (1, 1, True), (2, 1, False)]
    assert near_dedup.near_duplicates(docs([]), 2).collect() == []


def test_odd_sketch_estimates_and_loses_no_pair_at_the_limit():
    rng = np.random.default_rng(1)
    limit = near_dedup.most_odd_bits(0.8)
    far = 0
    for _ in range(100):
        a = rng.integers(0, 1 << 63, 900, dtype=np.uint64)
        b = np.concatenate([a[100:], rng.integers(0, 1 << 63, 100, dtype=np.uint64)])  # 800 of 1000: similarity 0.8
        c = np.concatenate([a[700:], rng.integers(0, 1 << 63, 700, dtype=np.uint64)])
        bits = lambda x: near_dedup.odd_sketch(near_dedup.minhash(x, near_dedup.FOR_SKETCH)).view(np.uint64)
        differ = lambda x, y: int(np.bitwise_count(bits(x) ^ bits(y)).sum())
        assert differ(a, b) <= limit
        far += differ(a, c) > limit
    assert far == 100


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 140)] + [(7, 7), (200, 199)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r["node"]: r["component"] for r in components(df, Scratch(spark, "t"), "c").collect()}
    assert got == {k: 0 for k in range(41)} | {k: 100 for k in range(100, 140)} | {199: 199, 200: 199}


def test_one_of_each_group_stays_with_all_columns(docs):
    text = " ".join(f"w{k}" for k in range(60))
    df = docs([(2, text), (1, text + " more"), (3, "something else"), (None, text), (4, None)])
    kept = near_dedup.keep_one_each(df)
    assert kept.columns == df.columns
    assert sorted((r["doc_id"] or -1) for r in kept.collect()) == [-1, 1, 3, 4]


def test_tables_that_nothing_reads_any_more_are_deleted(docs, spark, monkeypatch):
    made = []
    monkeypatch.setattr(near_dedup, "Scratch", lambda *a: made.append(Scratch(*a)) or made[-1])
    rng = random.Random(5)
    texts = [" ".join(f"w{rng.randrange(50)}" for _ in range(60)) for _ in range(4)]
    rows = [(4 * k + n, " ".join(t.split()[: 60 - k])) for n, t in enumerate(texts) for k in range(6)]
    df = near_dedup.near_duplicates(docs(rows), 2)
    left = {f.name for f in Path(made[0].root.removeprefix("file://")).iterdir()}
    assert "sizes" in left and not left & {"signed", "classes", "shared", "involved", "members", "sets", "heads1", "pairs1", "rest"}
    check(docs(rows), rows, 2)
    assert df.count() == len(rows)


def test_parity_sketches_lose_no_pair_and_tell_those_just_below_the_limit(spark):
    rng = np.random.default_rng(3)
    rows = []
    for differing in (0, 100, 111, 140, 200, 900):  # of 1,000 elements on each side; 111 is the limit of 80%
        for _ in range(20):
            a = rng.integers(0, 1 << 63, 1000, dtype=np.uint64)
            b = np.concatenate([a[differing:], rng.integers(0, 1 << 63, differing, dtype=np.uint64)])
            x, y = parity_sketches(np.concatenate([a, b]), np.array([0, 1000]), 64)
            rows.append((differing, 1000, 1000, x.tolist(), y.tolist()))
    df = spark.createDataFrame(rows, "differing int, n_a int, n_b int, parity_a array<long>, parity_b array<long>")
    passed = df.where(parity_allows(64, 80)).groupBy("differing").count().collect()
    assert {r["differing"]: r["count"] for r in passed} == {0: 20, 100: 20, 111: 20}


def test_sets_of_both_kinds_of_sketches_meet(docs, monkeypatch):
    """Sets on both sides of the size from which on sketches are sampled."""
    monkeypatch.setattr(near_dedup, "PARITY_MOST", 100)
    rng = random.Random(7)
    rows = []
    for group in range(6):
        base = [f"w{rng.randrange(5000)}" for _ in range(112)]
        for k in range(8):
            words = base[: 112 - 4 * k]
            words[rng.randrange(60)] = f"x{k}"
            rows.append((10 * group + k, " ".join(words)))
    check(docs(rows), rows, 2)


def test_nodes_ask_the_head_they_meet_most_often(spark):
    """A crowd shares 4 buckets, and each of its nodes another with each of 12 strangers, as one common word makes them."""
    crowd, strangers = range(100), range(-12, 0)
    members = [(band, band, n) for band in range(4) for n in crowd]
    members += [(1000 * n - s, 3 - s, x) for s in strangers for n in crowd for x in (n, s)]
    traits = [(n, [0, 1, 2, 3] + [1000 * n - s for s in range(-1, -13, -1)]) for n in crowd] + [(s, [None] * 16) for s in strangers]
    scratch, asked = Scratch(spark, "t"), []

    def confirm(pairs, name):
        found = scratch.put(pairs.where("a >= 0 AND b >= 0"), name)
        asked.append((pairs.where("a >= 0").count(), found.count()))
        return found

    links = bucket_links(
        spark.createDataFrame(members, "key long, band int, node long"),
        spark.createDataFrame(traits, "node long, bands array<int>"),
        F.lit(True),
        confirm,
        scratch,
        rounds=1,
    )
    # Four heads at most: who is none asks one of them, and few pairs are left for the last join.
    assert asked[0][1] >= 90
    labels = components(links, Scratch(spark, "t"), "c").collect()
    assert {r["node"] for r in labels} == set(crowd) and {r["component"] for r in labels} == {0}

"""Anchors against plain Python, edits against plain Python, likenesses on planted edits."""

import hashlib
import random

import xxhash
from pyspark.sql import functions as F

from visloom.llm import fingerprints
from visloom.llm.common import table


def plain_edits(rows):
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    place = lambda r: (r[0] is None, -(r[0] or 0), signed(xxhash.xxh64_intdigest((r[1] or "").encode(), seed=42)))
    order = sorted(rows, key=place)
    out = []
    for k, (doc_id, text) in enumerate(order):
        text, after = text or "", order[(k + 1) % len(order)][1] or ""
        cut = len(text) // 3
        out.append((doc_id, len(text), hashlib.sha256((text[: len(text) - cut] + after[:cut]).encode()).hexdigest()))
    return out


def brief_plain(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1:]))


def brief(df):
    return brief_plain((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in df.collect())


def test_edits_of_all_documents(spark, sf):
    df = table(spark, sf, "documents")
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    got = fingerprints.fingerprints(df)
    assert brief(got) == sorted(plain_edits(rows))
    likeness = got.agg(F.avg("near_edited"), F.avg("near_next"), F.min("near_next"), F.max("near_edited")).first()
    assert likeness[0] > 0.5 and likeness[1] < 0.2 and likeness[2] >= 0 and likeness[3] <= 1
    same = df.join(got, "doc_id").groupBy("text").agg(F.countDistinct("fingerprint").alias("n"))
    assert same.where("n > 1").count() == 0


def test_chunk_borders_change_nothing(docs, monkeypatch):
    rng = random.Random(3)
    rows = [(rng.randrange(10**6), " ".join(f"w{rng.randrange(99)}" for _ in range(rng.randint(0, 30)))) for _ in range(120)]
    rows = list({r[0]: r for r in rows}.values())
    for chunk, span in ((1, 7), (3, 2), (50, 1), (1000, 256)):
        monkeypatch.setattr(fingerprints, "CHUNK", chunk)
        monkeypatch.setattr(fingerprints, "SPAN", span)
        assert brief(fingerprints.fingerprints(docs(rows))) == sorted(plain_edits(rows))


def test_chunks_are_even_whatever_the_ids(docs, monkeypatch):
    monkeypatch.setattr(fingerprints, "CHUNK", 50)
    rows = [(k, f"text {k}") for k in range(1500)] + [(7, f"copy {k}") for k in range(1000)] + [(9_000_000_000, "far"), (-(1 << 63), "low")]
    rows += [(None, f"none {k}") for k in range(500)]
    df = docs(rows)
    chunked, n = fingerprints._chunks(df)
    sizes = [r["count"] for r in chunked.groupBy("chunk").count().collect()]
    assert len(sizes) == n > 40 and sum(sizes) == len(rows) and max(sizes) < 200
    assert brief(fingerprints.fingerprints(df)) == brief_plain(plain_edits(rows))


def test_edges(docs):
    assert fingerprints.fingerprints(docs([])).collect() == []
    one = fingerprints.fingerprints(docs([(7, "a b c d e f g")])).collect()[0]
    assert (one["near_next"], one["n_chars"]) == (1.0, 13)
    rows = [(1, ""), (2, None), (3, "é"), (3, "z y"), (3, "z y")]
    assert brief(fingerprints.fingerprints(docs(rows))) == sorted(plain_edits(rows))
    got = fingerprints.fingerprints(docs([(1, "a"), (None, "b"), (None, None), (2, "c")])).collect()
    assert len(got) == 4 and {r["doc_id"]: r["edited_sha256"] for r in got if r["doc_id"]}.keys() == {1, 2}


def test_closed_syncmers_do_not_depend_on_the_surroundings(spark):
    rng = random.Random(4)
    say = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    passage = say(60)
    texts = [passage, f"{say(7)} {passage} {say(5)}"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k long, text string")
    alone, within = (dict((a["h"], a["at"]) for a in r["a"]) for r in df.orderBy("k").select(fingerprints.anchors(F.col("text")).alias("a")).collect())
    common = alone.keys() & within.keys()
    assert len(alone) > 10 and len(common) == len(alone)
    assert {within[h] - alone[h] for h in common} == {7}
    # Closed: the smallest inner window is the first or the last one of each anchor.
    inner = df.where("k = 0").select(
        F.transform(F.sequence(F.lit(0), F.lit(58)), lambda i: F.xxhash64(F.get(F.split("text", " "), i), F.get(F.split("text", " "), i + 1))).alias("x")
    ).first()["x"]
    n = fingerprints.K - fingerprints.S + 1
    closed = {i for i in range(60 - fingerprints.K + 1) if min(inner[i : i + n]) in (inner[i], inner[i + n - 1])}
    assert set(alone.values()) == closed


def test_a_passage_keeps_its_anchors_in_a_long_text(spark):
    rng = random.Random(14)
    say = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    passage = say(60)
    df = spark.createDataFrame([(0, passage), (1, f"{say(5000)} {passage} {say(5000)}")], "k long, text string")
    alone, within = ({a["h"]: a["at"] for a in r["a"]} for r in df.orderBy("k").select(fingerprints.anchors(F.col("text")).alias("a")).collect())
    assert len(alone) > 10 and {within.get(h, -1) - at for h, at in alone.items()} == {5000}


def test_likeness_counts_only_anchors_in_order(spark):
    rng = random.Random(4)
    words = [f"w{rng.randrange(10**6)}" for _ in range(80)]
    turned = words[40:] + words[:40]
    rows = [(" ".join(words), " ".join(words)), (" ".join(words), " ".join(turned)), (" ".join(words), "other text")]
    df = spark.createDataFrame(rows, "a string, b string")
    near = [r[0] for r in df.select(fingerprints.likeness(fingerprints.anchors(F.col("a")), fingerprints.anchors(F.col("b")))).collect()]
    assert near[0] == 1.0 and near[2] == 0.0 and 0.3 < near[1] <= 0.98

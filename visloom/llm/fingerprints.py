"""Document fingerprints from closed syncmers of words.

A window of K words is an anchor if the smallest hash among its inner windows of S words stands
at its first or last place. Whether it is depends on the window alone, so equal stretches
of text have equal anchors wherever they stand. A fingerprint keeps all anchors
with their word positions; two fingerprints are compared by common anchors in the same order.
Everything is built-in DataFrame functions.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from visloom.functions.bind import bind
from visloom.llm.common import words_of

K, S = 6, 2
CHUNK = 1000  # documents next to each other that one chunk holds on average
MAX_CHUNKS = 65_536  # borders that pass through the driver; above CHUNK times as many rows chunks grow
SPAN = 256  # borders looked through at once


def anchors(text: Column) -> Column:
    """All anchors of a text, smallest hash first: array of (h, at).

    ``at`` is the anchor's first word, the first one if the anchor repeats. A text of 1 to
    K - 1 words is one anchor as a whole; a text without words has none.
    """

    def chosen(inner: Column, n: Column) -> Column:
        last = K - S
        ends = lambda i: F.least(F.get(inner, i), F.get(inner, i + last))
        between = lambda i: F.least(*[F.get(inner, i + k) for k in range(1, last)])
        places = F.filter(F.sequence(F.lit(0), n - K), lambda i: ends(i) <= between(i))
        name = lambda i: F.xxhash64(*[F.get(inner, i + k) for k in range(0, last + 1, S)])

        def each_once(s: Column) -> Column:
            return F.filter(s, lambda x, i: F.coalesce(F.get(s, i - 1)["h"] != x["h"], F.lit(True)))

        named = F.sort_array(F.transform(places, lambda i: F.struct(name(i).alias("h"), i.cast("int").alias("at"))))
        return bind(named, each_once)

    def of_words(w: Column) -> Column:
        inner = F.transform(
            F.sequence(F.lit(0), F.size(w) - S), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(S)])
        )
        whole = F.array(F.struct(F.xxhash64(F.array_join(w, " ")).alias("h"), F.lit(0).alias("at")))
        none = F.array().cast("array<struct<h:bigint,at:int>>")
        return (
            F.when(F.size(w) >= K, bind(inner, lambda x: chosen(x, F.size(w))))
            .when(F.size(w) > 0, whole)
            .otherwise(none)
        )

    return bind(words_of(text), of_words)


def as_text(found: Column) -> Column:
    """A fingerprint as a string: ``hash:position`` by position, 8 hex digits of each hash."""
    by_place = F.sort_array(F.transform(found, lambda x: F.struct(x["at"].alias("at"), x["h"].alias("h"))))
    digits = lambda x: F.lpad(F.hex(F.shiftrightunsigned(x["h"], 32)), 8, "0")
    return F.array_join(F.transform(by_place, lambda x: F.concat(digits(x), F.lit(":"), x["at"].cast("string"))), " ")


def likeness(one: Column, other: Column) -> Column:
    """Share of common anchors (0 to 1), counting only those in the same order in both.

    With J the Jaccard similarity of the anchors, the result is 2J / (1 + J), the share each has of the other when sizes are equal. Two
    fingerprints without anchors are alike, one without is unlike any other.
    """

    def compared(a: Column, b: Column) -> Column:
        side = lambda x, k: F.transform(x, lambda e: F.struct(e["h"].alias("h"), F.lit(k).alias("side"), e["at"].alias("at")))
        both = F.sort_array(F.concat(side(a, 0), side(b, 1)))

        def common(s: Column) -> Column:
            placed = F.transform(
                s,
                lambda x, i: F.when(F.get(s, i + 1)["h"] == x["h"], F.struct(x["at"].alias("x"), F.get(s, i + 1)["at"].alias("y"))),
            )
            return F.sort_array(F.filter(placed, lambda m: m.isNotNull()))

        def share(m: Column) -> Column:
            ordered = F.size(F.filter(m, lambda e, i: F.coalesce(e["y"] > F.get(m, i - 1)["y"], F.lit(True))))
            return ordered / (F.size(a) + F.size(b) - F.size(m))

        return bind(bind(bind(both, common), share), lambda j: 2 * j / (1 + j))

    both_empty = (F.size(one) == 0) & (F.size(other) == 0)
    either_empty = (F.size(one) == 0) | (F.size(other) == 0)
    found = bind(F.struct(one.alias("a"), other.alias("b")), lambda s: compared(s["a"], s["b"]))
    return F.when(both_empty, 1.0).when(either_empty, 0.0).otherwise(found)


def _place(doc_id: Column, text: Column) -> Column:
    """What rows are ordered by: doc_id descending (null last), then the hash of the text."""
    number = doc_id.cast("bigint")
    return F.struct(
        number.isNull().cast("int").alias("none"),
        F.coalesce(F.bitwise_not(number), F.lit(0)).cast("bigint").alias("back"),
        F.xxhash64(F.coalesce(text, F.lit(""))).alias("h"),
    )


def _borders(documents: DataFrame) -> list:
    """The first place of each of up to MAX_CHUNKS even ranges of places, ascending.

    Spark's range partitioning of the places alone (no texts) makes the ranges, so neither far-off
    ids nor a doc_id with many texts fill one of them.
    """
    places = documents.select(_place(F.col("doc_id"), F.col("text")).alias("place"))
    n = places.count()
    ranges = places.repartitionByRange(max(1, min(MAX_CHUNKS, -(-n // CHUNK))), "place.none", "place.back", "place.h")
    first = ranges.groupBy(F.spark_partition_id().alias("range")).agg(F.min("place").alias("place"))
    return sorted(tuple(r["place"]) for r in first.collect())


def _chunks(documents: DataFrame) -> tuple[DataFrame, int]:
    """doc_id, text, ``place``, ``chunk`` and ``leads`` (the place begins the chunk); the number of chunks.

    A chunk is looked up in two steps, among every SPAN-th border, then among those that follow it.
    """
    borders = _borders(documents)
    groups = [borders[k : k + SPAN] for k in range(0, len(borders), SPAN)]
    place = "struct<none:int,back:bigint,h:bigint>"
    named = lambda b: dict(zip(("none", "back", "h"), b, strict=True))
    tops = F.from_json(F.lit(json.dumps([named(g[0]) for g in groups])), f"array<{place}>")
    lists = F.from_json(F.lit(json.dumps([[named(b) for b in g] for g in groups])), f"array<array<{place}>>")
    rows = documents.select(
        F.col("doc_id").cast("bigint"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
        _place(F.col("doc_id"), F.col("text")).alias("place"),
    )

    def looked_up(at: Column) -> Column:
        def within(top: Column) -> Column:
            group = F.get(lists, top)
            step = F.size(F.filter(group, lambda b: b <= at)) - 1
            return F.struct((top * SPAN + step).cast("bigint").alias("chunk"), F.array_contains(group, at).alias("leads"))

        return bind(F.size(F.filter(tops, lambda b: b <= at)) - 1, within)

    found = rows.withColumn("found", bind(F.col("place"), looked_up))
    return found.select("doc_id", "text", "place", "found.chunk", "found.leads"), len(borders)


def _heads(chunked: DataFrame, n_chunks: int) -> DataFrame:
    """The first row of each chunk, with the chunk that comes before it (for the first: the last of all)."""
    before = F.pmod(F.col("chunk") - 1, F.lit(max(1, n_chunks))).alias("chunk")
    heads = chunked.where("leads").groupBy("chunk").agg(F.max("text").alias("text"), F.first("doc_id").alias("doc_id"), F.first("place").alias("place"))
    return heads.select("doc_id", "text", "place", before)


def fingerprints(documents: DataFrame) -> DataFrame:
    """Per row: n_chars, the edited text's digest, both fingerprints and two likenesses.

    The edited text has its last floor(n_chars / 3) code points replaced by the first as many (or
    all) of the next document in descending doc_id order; after the last comes the first. near_edited
    compares the text with its edited text, near_next with the next document.

    Null text is empty: n_chars 0, an empty fingerprint. Rows sharing a doc_id are ordered by the
    hash of their text; rows without a doc_id come last. A single row is its own next. An empty table gives none.

    Each text crosses the network once. One row per chunk is copied to the chunk before it. Only rows equal in
    doc_id and text are bound to stay together.
    """
    chunked, n_chunks = _chunks(documents)
    heads = _heads(chunked, n_chunks).withColumn("copy", F.lit(1))
    every = chunked.drop("leads").withColumn("copy", F.lit(0)).unionByName(heads)
    every = every.repartition("chunk").withColumn("own", anchors(F.col("text")))
    order = Window.partitionBy("chunk").orderBy("copy", "place")
    beside = every.withColumns({"next_text": F.lead("text").over(order), "next_own": F.lead("own").over(order)})
    cut = F.floor(F.length("text") / 3).cast("int")
    edited = F.concat(
        F.substring(F.col("text"), F.lit(1), F.length("text") - cut), F.substring(F.col("next_text"), F.lit(1), cut)
    )
    whole = beside.where("copy = 0").select("doc_id", F.length("text").cast("bigint").alias("n_chars"), "own", "next_own", edited.alias("edited"))
    read = whole.select("doc_id", "n_chars", "own", "next_own", F.sha2("edited", 256).alias("edited_sha256"), anchors(F.col("edited")).alias("other"))
    return read.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_text(F.col("own")).alias("fingerprint"),
        as_text(F.col("other")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("other")).alias("near_edited"),
        likeness(F.col("own"), F.col("next_own")).alias("near_next"),
    )

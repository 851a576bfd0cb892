"""Spelling variants: words one edit apart, found in a bit-sliced position index.

For every (position, letter) the index holds a bitset over the words of a block. One pass over a
word's letters carries three bitsets: the words equal so far, those with one letter replaced, and
those with one letter more, which are read one position later. A word with one letter less finds
its partner from the other side.

Blocks come from halving. Of two words one edit apart, the edit lies in the first or in the second
half of the shorter one, and all letters outside that half agree. A block holds the words that
agree outside a stretch [low, high) of the shorter length; a block of more than BLOCK_WORDS words is
cut into those of the two halves of its stretch, down to a single place. So no block grows with
the vocabulary, and a word stands in a number of blocks logarithmic in its length at most per cut.
"""

from __future__ import annotations

import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visloom.llm.common import Scratch

# Every code point of a run is one byte of Latin-1; all other characters become spaces there.
RUN_BYTES = bytes(
    (b | 0x20) if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0xC0 else 0x20 for b in range(256)
)

DAMAGED = 199  # a run loses a letter when this divides its checksum
LEAST_LENGTH = 6
LEAST_COUNT = 5
RATIO = 5  # a form occurs at least so many times as often
BLOCK_WORDS = 2048
VOCABULARY = 400_000  # words one task counts before it hands them on


def runs_of(text: str) -> list[bytes]:
    """The maximal runs of a text in Latin-1, A-Z lower-cased."""
    return text.encode("latin-1", "replace").translate(RUN_BYTES).split()


def damaged(run: bytes, start: int) -> bytes:
    """The run, without one code point if DAMAGED divides its checksum (``start``: that of what stands before it)."""
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), start)
    if h % DAMAGED:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(documents: DataFrame, least_length: int = LEAST_LENGTH) -> DataFrame:
    """(word, n): occurrences of the words of all texts, damaged runs included."""

    def count(batches):
        held: Counter = Counter()

        def handed_on():
            words = [w.decode("latin-1") for w in held]
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                start = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
                start = zlib.crc32(b":", start)
                for run, n in Counter(runs_of(text or "")).items():
                    if len(run) >= least_length:
                        word = damaged(run, start)
                        if len(word) >= least_length:
                            held[word] += n
                if len(held) >= VOCABULARY:
                    yield from handed_on()
                    held.clear()
        yield from handed_on()

    rows = documents.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _keyed(words: DataFrame) -> DataFrame:
    """Words with their block: shorter length, stretch, the letters before and after it."""
    length = F.col("length")
    after = F.col("size") - F.col("high")
    return words.withColumns(
        {
            "before": F.expr("substring(word, 1, low)"),
            "after": F.when(after > 0, F.expr("substring(word, length - (size - high) + 1, size - high)")).otherwise(""),
        }
    ).where(length >= F.col("size"))


BLOCK = ["size", "low", "high", "before", "after"]


def blocks(words: DataFrame, scratch: Scratch, limit: int = BLOCK_WORDS) -> DataFrame:
    """(word, length, block columns): every pair of words one edit apart shares a block.

    Words (word) of length L stand as the shorter one in the blocks of size L and as the longer
    one in those of size L - 1. Blocks of more than ``limit`` words are halved until they are small
    or their stretch is a single place.
    """
    length = F.length("word")
    start = words.select("word", length.alias("length"), F.explode(F.array(length, length - 1)).alias("size"))
    halves = _halved(start.where("size > 0").withColumns({"low": F.lit(0), "high": F.col("size")}))
    done, turn = None, 0
    while True:
        here = scratch.put(_keyed(halves), f"blocks{turn}")
        sizes = here.groupBy(*BLOCK).agg(
            F.count(F.lit(1)).alias("members"), F.min("length").alias("least"), F.max("length").alias("most")
        )
        # A block without a word of the shorter length, or of one word, holds no pair.
        sizes = scratch.put(sizes.where("members > 1 AND least = size"), f"sizes{turn}")
        large = (F.col("members") > limit) & (F.col("high") - F.col("low") > 1)
        small = here.join(sizes.where(~large).select(*BLOCK), BLOCK)
        done = small if done is None else done.unionByName(small)
        crowded = sizes.where(large).select(*BLOCK)
        if crowded.isEmpty():
            return done
        halves = _halved(here.join(crowded, BLOCK).drop("before", "after"))
        turn += 1


def _halved(words: DataFrame) -> DataFrame:
    """Every word once for each half of its stretch."""
    middle = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
    pieces = F.array(
        F.struct(F.col("low").cast("int").alias("low"), middle.alias("high")),
        F.struct(middle.alias("low"), F.col("high").cast("int").alias("high")),
    )
    cut = words.withColumn("piece", F.explode(pieces)).where("piece.low < piece.high")
    return cut.select("word", "length", F.col("size").cast("int"), "piece.low", "piece.high")


def neighbours(words: list[str], size: int) -> list[tuple[int, int]]:
    """Pairs (a, b) of places in ``words``: a has ``size`` letters, b is one replaced or one inserted letter away.

    ``words`` have ``size`` or ``size`` + 1 letters. Pairs of equal length come in both orders.
    """
    index: dict[tuple[int, str], int] = {}
    shorter = longer = 0
    for k, word in enumerate(words):
        bit = 1 << k
        if len(word) == size:
            shorter |= bit
        else:
            longer |= bit
        for spot in enumerate(word):
            index[spot] = index.get(spot, 0) | bit
    at = index.get
    everything = shorter | longer
    found = []
    for k, word in enumerate(words):
        if len(word) != size:
            continue
        equal, replaced, inserted = everything, 0, 0
        for p, letter in enumerate(word):
            here, later = at((p, letter), 0), at((p + 1, letter), 0)
            inserted = (inserted | equal) & later
            replaced = (replaced & here) | (equal & ~here)
            equal &= here
        # What is equal to the end and one letter longer has its letter inserted there.
        near = (replaced & shorter) | ((inserted | equal) & longer)
        while near:
            low = near & -near
            found.append((k, low.bit_length() - 1))
            near ^= low
    return found


def near_pairs(words: DataFrame, scratch: Scratch, limit: int = BLOCK_WORDS) -> DataFrame:
    """(word, near): all ordered pairs of ``words`` (word, distinct) that differ by exactly one edit."""

    def matched(size: int, block: list[str]):
        for a, b in neighbours(block, size):
            yield block[a], block[b]
            if len(block[b]) > size:
                yield block[b], block[a]

    def match(batches):
        """Rows come sorted by block; a block may go on in the next batch."""
        current, block = None, []
        for batch in batches:
            pairs = []
            columns = [batch.column(name).to_pylist() for name in [*BLOCK, "word"]]
            for *key, word in zip(*columns, strict=True):
                if key != current:
                    if current:
                        pairs += matched(current[0], block)
                    current, block = key, []
                block.append(word)
            yield _as_pairs(pairs)
        if current:
            yield _as_pairs(list(matched(current[0], block)))

    placed = blocks(words, scratch, limit).select(*BLOCK, "word")
    placed = placed.repartition(*BLOCK).sortWithinPartitions(*BLOCK)
    return placed.mapInArrow(match, "word string, near string").distinct()


def _as_pairs(pairs: list[tuple[str, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([a for a, _ in pairs], pa.string()), pa.array([b for _, b in pairs], pa.string())], ["word", "near"]
    )


def variant_forms(
    documents: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, ratio: int = RATIO
) -> DataFrame:
    """Per word of ``documents`` (doc_id, text): word, form, root, n, n_near, form_n.

    Words are the runs of ASCII letters and U+00C0 to U+00FF of the whole texts, A-Z lower-cased, with
    the damage described at :func:`damaged`, if they have ``least_length`` code points and occur
    ``least_count`` times. n_near counts the words one inserted, deleted or replaced code point
    away. ``form`` is the most frequent of them (ties: the smallest) if it occurs at least ``ratio`` times
    as often as the word, else null; ``root`` follows forms to the last.

    Null and empty texts hold no words; a null doc_id counts as the empty text in checksums; repeated rows
    count again. An empty table gives an empty result. Extra columns are ignored.
    """
    scratch = Scratch(documents.sparkSession, "spelling")
    counted = word_counts(documents, least_length).where(F.col("n") >= least_count)
    words = scratch.put(counted, "words")
    pairs = scratch.put(near_pairs(words.select("word"), scratch), "pairs")
    others = words.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    best = (
        pairs.join(others, "near")
        .groupBy("word")
        .agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    )
    frequent = -F.col("best.less") >= F.lit(ratio) * F.col("n")

    def when_frequent(value: Column) -> Column:
        return F.when(frequent, value)

    formed = words.join(best, "word", "left").select(
        "word",
        when_frequent(F.col("best.near")).alias("form"),
        "n",
        F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        when_frequent(-F.col("best.less")).alias("form_n"),
    )
    formed = scratch.put(formed, "formed")
    return formed.join(_roots(formed, scratch), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def _roots(formed: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, root) of the words that have a form; each round doubles the length of the steps.

    Along forms n grows by the ratio, so chains are short and have no loops.
    """
    steps = formed.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root"))
    turn = 0
    while True:
        steps = scratch.put(steps, f"roots{turn}")
        onward = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = steps.join(onward, "root")
        if moved.isEmpty():
            return steps
        steps = steps.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"))
        turn += 1

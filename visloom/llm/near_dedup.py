"""Near duplicates: MinHash bands find candidates, odd sketches and full sets decide.

Texts with equal shingle sets are one class from the start. One member of each class goes
into BANDS bands of ROWS MinHash values. Documents that share a band with another one get a sketch, a bitmap of parities. The population
count of two bitmaps' XOR tells how much the sets differ, and only pairs that may reach the
limit are compared on their full sets. A set of up to PARITY_MOST elements has a parity sketch of the elements themselves, which
is nearly exact and loses no pair; one of `percent` of that or more has an odd sketch of SAMPLES further MinHash values.
Sets in between have both, so any two sets similar enough have one kind in common.

No bucket emits all its pairs. In each round every document is held against one
representative of its buckets, and what is linked becomes one component. Only documents of
different components that still share a bucket are then compared with each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visloom.llm.common import (
    Scratch,
    WordHashes,
    mix,
    parity_allows,
    parity_sketches,
    shingle_hashes,
    sizes_allow,
    texts_as_bytes,
)
from visloom.llm.graph import bucket_links, components, confirmer

# 40 bands of 5 values: a pair at similarity 0.8 is missed with probability (1 - 0.8^5)^40 = 1.2e-7.
BANDS, ROWS = 40, 5
VALUES = BANDS * ROWS
SAMPLES = 2048  # MinHash values in an odd sketch: estimates 0.8 with a deviation of 0.009
SKETCH_WORDS = 64
SKETCH_BITS = 64 * SKETCH_WORDS
# Sets at the limit of 80% differ in a ninth of their elements together: up to here in 1,333, a third of the bits.
PARITY_MOST = 6000
DEVIATIONS = 4.5  # a pair at the limit passes its sketch unless it is off by so many standard deviations
STEP = 1 << 17  # hash values held at once: bounds the memory of a very long text

_seeds = np.random.default_rng(20240229)
MULTIPLIERS = _seeds.integers(0, 1 << 32, VALUES + SAMPLES, dtype=np.uint32) | np.uint32(1)
OFFSETS = _seeds.integers(0, 1 << 32, VALUES + SAMPLES, dtype=np.uint32)
FOR_BANDS, FOR_SKETCH = slice(0, VALUES), slice(VALUES, None)


def most_odd_bits(similarity: float) -> int:
    """XOR population count up to which a pair may have ``similarity``.

    Of the SAMPLES values a share of 1 - similarity differs (binomially), and each of them flips two
    random bits. The limit is the expected count plus DEVIATIONS standard deviations.
    """
    share = 1 - similarity
    flips = 2 * SAMPLES * share
    even = np.exp(-2 * flips / SKETCH_BITS)
    expected = SKETCH_BITS / 2 * (1 - even)
    sampled = 2 * np.sqrt(SAMPLES * similarity * share) * even
    folded = np.sqrt(SKETCH_BITS) / 2 * np.sqrt(1 - even * even)
    return int(expected + DEVIATIONS * np.hypot(sampled, folded))


def minhash(shingles: np.ndarray, which: slice) -> np.ndarray:
    """The chosen MinHash values of a non-empty set of 64-bit hashes."""
    keys = (shingles >> np.uint64(32)).astype(np.uint32)
    times, plus = MULTIPLIERS[which, None], OFFSETS[which, None]
    least = np.full(len(times), 0xFFFFFFFF, np.uint32)
    step = max(1, STEP // len(times))
    for start in range(0, len(keys), step):
        np.minimum(least, (times * keys[start : start + step] + plus).min(axis=1), out=least)
    return least


def band_keys(values: np.ndarray) -> np.ndarray:
    """One 64-bit key per band, the band's number included."""
    rows = values.reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, k])
    return key.view(np.int64)


def odd_sketch(values: np.ndarray) -> np.ndarray:
    """The parity of the number of (place, value) pairs that fall on each bit."""
    places = np.arange(len(values), dtype=np.uint64) << np.uint64(32)
    bits = mix(places | values.astype(np.uint64)) % np.uint64(SKETCH_BITS)
    odd = (np.bincount(bits.astype(np.int64), minlength=SKETCH_BITS) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64)


SIGNED = "doc_id long, n_shingles long, digest long, digest2 long, keys array<long>"


def _sets(batch: pa.RecordBatch, width: int, hashes: WordHashes) -> Iterator[tuple[int | None, np.ndarray]]:
    ids = batch.column("doc_id").to_pylist()
    for doc_id, text in zip(ids, texts_as_bytes(batch.column("text")), strict=True):
        yield doc_id, np.unique(shingle_hashes(hashes.of(text.lower().split()), width))


def signatures(documents: DataFrame, width: int) -> DataFrame:
    """Set size, set digest and band keys of every row."""

    def sign(batches):
        hashes = WordHashes()
        for batch in batches:
            rows = []
            for doc_id, shingles in _sets(batch, width, hashes):
                n = len(shingles)
                if n == 0:
                    rows.append((doc_id, 0, 0, 0, []))
                    continue
                digest = np.bitwise_xor.reduce(mix(shingles)).view(np.int64)
                digest2 = np.add.reduce(mix(shingles ^ np.uint64(0xA0761D6478BD642F))).view(np.int64)
                rows.append((doc_id, n, int(digest), int(digest2), band_keys(minhash(shingles, FOR_BANDS))))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            types = [pa.int64()] * 4 + [pa.list_(pa.int64())]
            names = [field.split()[0] for field in SIGNED.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    return documents.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(sign, SIGNED)


def full_sets(documents: DataFrame, width: int, percent: int = 80) -> DataFrame:
    """(node, shingles, parity, sketch): the whole set of each row as 64-bit hashes, and its sketches by size (else null)."""
    sampled_least = PARITY_MOST * percent // 100

    def parity(shingles):
        return parity_sketches(shingles, np.zeros(1, np.int64), SKETCH_WORDS)[0] if len(shingles) <= PARITY_MOST else None

    def sampled(shingles):
        return odd_sketch(minhash(shingles, FOR_SKETCH)) if len(shingles) >= sampled_least else None

    def fill(batches):
        hashes = WordHashes()
        for batch in batches:
            found = [(d, s) for d, s in _sets(batch, width, hashes) if len(s)]
            lists = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([d for d, _ in found], pa.int64()),
                    pa.array([s.view(np.int64) for _, s in found], lists),
                    pa.array([parity(s) for _, s in found], lists),
                    pa.array([sampled(s) for _, s in found], lists),
                ],
                ["node", "shingles", "parity", "sketch"],
            )

    return documents.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(
        fill, "node long, shingles array<long>, parity array<long>, sketch array<long>"
    )


def _close(percent: int):
    """Whether a pair may reach the limit, by its sizes and by each kind of sketch that both have."""
    differing = sum(
        (F.bit_count(F.get(F.col("sketch_a"), k).bitwiseXOR(F.get(F.col("sketch_b"), k))) for k in range(SKETCH_WORDS)),
        F.lit(0),
    )
    sampled = F.coalesce(differing <= most_odd_bits(percent / 100), F.lit(True))
    return sizes_allow(percent) & F.coalesce(parity_allows(SKETCH_WORDS, percent), F.lit(True)) & sampled


def near_duplicates(documents: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Per row of ``documents`` (doc_id, text): n_shingles, component_id, kept.

    Documents are linked if 100 · |A ∩ B| ≥ percent · |A ∪ B| for their sets of
    ``width``-word shingles (lower-cased; fewer words make one shingle). component_id is the smallest
    doc_id reachable over links, itself included; kept tells whether it is the document's own.

    A text without words (empty, null) has no shingles and no links. Rows sharing a doc_id
    are one document, linked if any of its texts is. A null doc_id takes part in nothing: its
    component_id is null and it is kept. An empty table gives an empty result.
    """
    scratch = Scratch(documents.sparkSession, "near-dedup")
    signed = scratch.put(signatures(documents, width), "signed")
    usable = signed.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())

    # Equal sets: every member is linked to the smallest doc_id of its class.
    classes = usable.groupBy("digest", "digest2").agg(
        F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.min_by("keys", "doc_id").alias("keys")
    )
    classes = scratch.put(classes, "classes")
    repeated = classes.where("copies > 1").select("digest", "digest2", "rep")
    equal = usable.join(repeated, ["digest", "digest2"]).where("doc_id <> rep")
    equal = scratch.put(equal.select(F.col("doc_id").alias("a"), F.col("rep").alias("b")), "equal")
    sizes = scratch.put(signed.select("doc_id", "n_shingles"), "sizes")
    scratch.drop("signed")

    # Buckets with at least two classes.
    banded = classes.select(F.posexplode("keys").alias("band", "key"), F.col("rep").alias("node"))
    shared = banded.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high"))
    shared = scratch.put(shared.where("low < high").select("key"), "shared")
    members = scratch.put(banded.join(shared, "key"), "members")
    scratch.drop("shared")
    involved = scratch.put(members.select(F.col("node").alias("__wanted")).distinct(), "involved")
    wanted = documents.join(involved, documents["doc_id"] == F.col("__wanted"), "left_semi")
    sets = scratch.put(full_sets(wanted, width, percent), "sets")
    # 32 bits of each band's key tell which bands two documents share.
    short = F.transform("keys", lambda k: F.shiftright(k, 32).cast("int")).alias("bands")
    known = classes.join(involved, F.col("rep") == F.col("__wanted"), "left_semi").select(F.col("rep").alias("node"), short)
    traits = scratch.put(sets.select("node", F.size("shingles").alias("n"), "parity", "sketch").join(known, "node"), "traits")
    scratch.drop("classes", "involved")
    links = bucket_links(
        members,
        traits,
        _close(percent),
        confirmer(sets, percent, scratch),
        scratch,
    )
    scratch.drop("members", "sets")
    labels = components(links.union(equal), scratch, "all")
    return sizes.join(labels, F.col("doc_id") == F.col("node"), "left").select(
        "doc_id",
        "n_shingles",
        F.coalesce("component", "doc_id").alias("component_id"),
        F.coalesce(F.coalesce("component", "doc_id") == F.col("doc_id"), F.lit(True)).alias("kept"),
    )


def keep_one_each(documents: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``documents`` whose document is kept, with all their columns."""
    gone = near_duplicates(documents, width, percent).where(~F.col("kept"))
    gone = gone.select(F.col("doc_id").alias("__gone")).distinct()
    return documents.join(gone, documents["doc_id"] == F.col("__gone"), "left_anti")

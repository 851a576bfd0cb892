"""Pieces against the library, plans against their promises."""

import random
import zlib
from collections import Counter

import numpy as np
from tokenizers import Tokenizer

from visloom.llm import packing
from visloom.llm.common import table
from visloom.llm.queries import WORD_BPE


def verify(df, capacity=packing.CAPACITY):
    """Every piece as the library's ids of the whole text give it; sequences without gaps or overflow."""
    plain = Tokenizer.from_file(WORD_BPE)
    rows = packing.packed(df, WORD_BPE, capacity).collect()
    want = Counter()
    for r in df.collect():
        ids = np.array([*plain.encode(r["text"] or "", add_special_tokens=False).ids, 0], "<u4")
        for k, a in enumerate(range(0, len(ids), capacity)):
            part = ids[a : a + capacity]
            want[r["doc_id"], k, a, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    ends = Counter()
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends[r["sequence_id"]]
        ends[r["sequence_id"]] += r["length"]
    assert all(e <= capacity for e in ends.values())
    return len(ends), -(-sum(ends.values()) // capacity)


def test_all_documents(spark, sf):
    used, bound = verify(table(spark, sf, "documents"))
    assert used <= bound + 1


def test_texts_of_all_kinds(docs):
    rng = random.Random(5)
    bits = [" ", "  ", "\n", "\t\n", "a", "AB", "'s", " 's", "12", "é", " ", "　", "<|endoftext|>", ".", "🙂", "é", "Σ"]
    texts = ["".join(rng.choices(bits, k=rng.randint(0, 40))) for _ in range(400)] + ["", None, "word " * 500]
    verify(docs([*enumerate(texts), (None, "no id"), (1, "again"), (1, "again")]), capacity=64)
    assert packing.packed(docs([]), WORD_BPE).collect() == []


def test_ids_can_be_carried(docs):
    got = packing.packed(docs([(1, "one two three")]), WORD_BPE, with_ids=True).collect()
    assert len(got) == 1 and zlib.crc32(got[0]["ids"]) == got[0]["ids_crc32"]


def test_plans_place_every_piece_once():
    rng = random.Random(2)
    for _ in range(60):
        capacity = rng.choice([10, 64, 300])
        counts = {rng.randint(1, capacity): rng.randint(1, 40) for _ in range(rng.randint(1, 30))}
        plan = packing.Plan(counts, capacity)
        ranks, filled = Counter(), Counter()
        for length, low, high, first, offset in plan.rows:
            assert low == ranks[length]
            ranks[length] = high
            for k in range(high - low):
                assert filled[first + k] == offset
                filled[first + k] += length
        assert ranks == counts and max(filled.values()) <= capacity and len(filled) == plan.sequences


def test_exact_complements_are_found():
    for counts in ({7: 4, 3: 4}, {5: 3, 3: 3, 2: 3}, {4: 2, 3: 2, 2: 2, 1: 2}, {5: 2}):
        plan = packing.Plan(counts, 10)
        assert plan.sequences * 10 == sum(k * n for k, n in counts.items())


def test_close_to_the_bound_on_mixed_lengths():
    rng = random.Random(1)
    counts = Counter(min(2047, int(rng.lognormvariate(5.6, 1.0)) + 1) for _ in range(20_000))
    plan = packing.Plan(counts, 2048)
    assert plan.sequences <= 1.002 * sum(k * n for k, n in counts.items()) / 2048 + 1
    assert len(plan.rows) < 20_000


def test_known_words_are_looked_up_and_not_walked_through():
    """What a group of texts costs depends on its own words, not on how many the table holds."""

    class Unwalked(dict):
        def keys(self):
            raise AssertionError("walked")

        __iter__ = items = values = keys

    class Table(packing.WordIds):
        keys = __iter__ = items = values = Unwalked.keys

    table = Table(WORD_BPE)
    table.parts = Unwalked()
    for words in ({b"Hello", b"it's"}, {b"Hello", b"World", "İx".encode()}):
        table.learn(words)
    tokenizer = Tokenizer.from_file(WORD_BPE)
    for word in (b"Hello", b"it's", b"World", "İx".encode()):
        assert table[word] == np.array(tokenizer.encode(word.decode(), add_special_tokens=False).ids, "<u4").tobytes()

"""Base scores by hand, and the automaton against a plain recursion over the same counts."""

import zlib
from collections import Counter
from math import isclose, log10

import pytest

from visloom.llm import lm_scoring
from visloom.llm.common import table


def plain_scores(rows, least=lm_scoring.LEAST, discount=lm_scoring.DISCOUNT):
    texts = [(d, [*(t or "").encode().lower().split(), b""]) for d, t in rows]
    held = lambda d: zlib.crc32(b"" if d is None else str(d).encode()) % 7 == 2
    train = [w for d, w in texts if not held(d)]
    one = Counter(x for w in train for x in w)
    total, kinds = sum(one.values()), len(one)
    good = {w for w, n in one.items() if n >= least}
    two = Counter(g for w in train for g in zip(w, w[1:]))
    two = {g: n for g, n in two.items() if n >= least}
    three = Counter(g for w in train for g in zip(w, w[1:], w[2:]))
    three = {g: n for g, n in three.items() if n >= least}
    p1 = lambda w: (one[w] + 1) / (total + kinds + 1)

    def p2(v, w):
        if v not in good:
            return p1(w)
        seen = [n for g, n in two.items() if g[0] == v]
        rest = 1 - sum(n - discount for n in seen) / one[v]
        return max(two.get((v, w), 0) - discount, 0) / one[v] + rest * p1(w)

    def p3(u, v, w):
        if (u, v) not in two:
            return p2(v, w)
        seen = [n for g, n in three.items() if g[:2] == (u, v)]
        rest = 1 - sum(n - discount for n in seen) / two[u, v]
        return max(three.get((u, v, w), 0) - discount, 0) / two[u, v] + rest * p2(v, w)

    out = {}
    for d, w in texts:
        base = sum(log10(p1(x)) for x in w)
        score = sum(
            log10(p1(w[i]) if i == 0 else p2(w[0], w[1]) if i == 1 else p3(w[i - 2], w[i - 1], w[i])) for i in range(len(w))
        )
        out[d] = (held(d), len(w), sum(one[x] > 0 for x in w), total, base, score)
    return out


ROWS = [(k, t) for k, t in enumerate(["a b a b c", "b a b C d", "a b", "", None, "zz a b c", "q a b c a b c", "a\x0bb\xa0c b"] * 3)]


def same(got, want):
    assert len(got) == len(want)
    for r in got:
        held, n, known, total, base, score = want[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held, n, known, total)
        assert isclose(r["base_score"], base, rel_tol=1e-9) and isclose(r["score"], score, rel_tol=1e-9)


@pytest.mark.parametrize("least", [lm_scoring.LEAST, 1, 4])
def test_small_corpus(docs, least):
    same(lm_scoring.lm_scores(docs(ROWS), least).collect(), plain_scores(ROWS, least))


def test_rare_ngrams_are_kept_in_a_large_corpus(docs):
    """Words, pairs and triples that occur three times among 800,000 tokens are 3.7e-6 of them: all have their states."""
    filler = "f " * 100_000
    texts = ["rare words meet", "rare words meet", *[filler] * 8, "rare words meet again"]
    ids = [k for k in range(40) if not lm_scoring.is_held_out(k)]
    rows = list(zip(ids, texts))
    rows.append((next(k for k in range(40) if lm_scoring.is_held_out(k)), "rare words meet"))
    same(lm_scoring.lm_scores(docs(rows)).collect(), plain_scores(rows))


def test_blocks_change_nothing(docs):
    same(lm_scoring.lm_scores(docs(ROWS), block_tokens=7).collect(), plain_scores(ROWS))


def test_probabilities_of_every_state_sum_to_one():
    """Every word of the vocabulary is tried from every state of a block that holds the whole training text."""
    import numpy as np
    import pyarrow as pa

    from visloom.llm.common import WordHashes

    text = [*b"a b c a b c a b d b d b d c a a a".split(), lm_scoring.END]
    batch = lm_scoring._block([0], [WordHashes().of(text)])
    b = lm_scoring._Block(next(lm_scoring._rows(batch)))
    told, masses = [], {}
    grams = [(1, b.words[b.codes], None, 0), (2, b.pairs, b.words[np.roll(b.codes, 1)], 1), (3, b.triples, np.roll(b.pairs, 1), 2)]
    for order, keys, contexts, depth in grams:
        wanted = b.deep[depth]
        found, first, n = np.unique(keys[wanted], return_index=True, return_counts=True)
        for k, i, c in zip(found, first, n):
            if order == 1 or c >= 2:
                told.append((order, k, int(c)))
                if order > 1:
                    of = contexts[wanted][i]
                    masses[of] = masses.get(of, 0) + c - lm_scoring.DISCOUNT
    answers = pa.table(
        {
            "gram_order": pa.array([o for o, _, _ in told], pa.int32()),
            "key": pa.array(np.array([k for _, k, _ in told], np.uint64).view(np.int64)),
            "n": pa.array([n for _, _, n in told], pa.int64()),
            "mass": pa.array([float(masses.get(k, 0)) for _, k, _ in told], pa.float64()),
        }
    )
    automaton = lm_scoring._Automaton(b, answers, len(text), len(b.words), 2)
    words = np.arange(len(b.words))
    states = len(automaton.shorter)
    assert states > 6
    unseen = 1 / (len(text) + len(b.words) + 1)  # the share of all words not in the vocabulary
    for state in range(states):
        _, price = automaton.step(np.full(len(words), state), words)
        left = unseen
        at = state
        while at:
            left *= 10 ** automaton.weight[at]
            at = automaton.shorter[at]
        assert isclose((10**price).sum() + left, 1, rel_tol=1e-9)


def test_edges(docs):
    assert lm_scoring.lm_scores(docs([])).collect() == []
    same(lm_scoring.lm_scores(docs([(None, "a a a")])).collect(), plain_scores([(None, "a a a")]))
    only_held = [(k, "x y") for k in range(40) if lm_scoring.is_held_out(k)]
    same(lm_scoring.lm_scores(docs(only_held)).collect(), plain_scores(only_held))


def test_held_out_texts_score_above_the_base(spark, sf):
    rows = lm_scoring.lm_scores(table(spark, sf, "documents")).where("held_out").collect()
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)


def test_a_block_asks_in_one_row_per_slice():
    """Rows per n-gram would cost memory and disk: keys go packed, and come out as they went in."""
    import numpy as np

    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 2**64 - 1, 5_000, dtype=np.uint64))
    counts = rng.integers(0, 9, len(keys))
    rows = lm_scoring._dealt(lm_scoring.PAIRS, 7, 4, keys, counts).to_pylist()
    assert [r["slice"] for r in rows] == list(range(16)) and {r["block"] for r in rows} == {7}
    back = [np.cumsum(lm_scoring._loose(r["keys"], r["size"], "<u8"), dtype=np.uint64) for r in rows]
    assert (np.concatenate(back) == keys).all() and sum(len(r["keys"]) + len(r["parts"]) for r in rows) < 8 * len(keys)
    assert (np.concatenate([lm_scoring._loose(r["parts"], r["size"], "<f8") for r in rows]) == counts).all()
    assert lm_scoring._dealt(lm_scoring.PAIRS, 7, 4, keys[:0], counts[:0]).num_rows == 0

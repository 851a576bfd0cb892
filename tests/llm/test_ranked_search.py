import math
import random
import re
from collections import Counter

import numpy as np

from visloom.llm import ranked_search as rs
from visloom.llm.common import WordHashes

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def plain_terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_ranking(items, docs, k=10):
    counted = [(d, Counter(plain_terms(t))) for d, t in docs]
    counted = [(d, c) for d, c in counted if c]
    n_docs, n_terms = len(counted), sum(c.total() for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    wanted = {}
    for item, text in items:
        wanted.setdefault(item, set()).update(plain_terms(text))
    out = []
    for item, terms in wanted.items():
        scores = []
        for d, c in counted:
            m = 100 - 90 + (90 * c.total() * n_docs) // n_terms
            s = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m))
                for t in terms
                if t in c
            )
            if s > 0:
                scores.append((s, d))
        scores.sort(key=lambda x: (-x[0], x[1] is None, x[1] or 0))
        out += [(item, r + 1, d, s) for r, (s, d) in enumerate(scores[:k])]
    return sorted(out, key=repr)


def ranked(spark, docs, items, rows, k=10):
    frame = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    got = rs.ranked_search(frame, docs(rows), k)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in got.collect()), key=repr)


def test_equals_plain_ranking(spark, docs):
    rng = random.Random(5)
    words = [f"{a}{b}" for a in "abcdefgh" for b in ("x", "Y", "é", "ßa", "12", "日本")]
    weights = [1 / (k + 1) for k in range(len(words))]
    rows = [(d, " ".join(rng.choices(words, weights, k=rng.choice([1, 3, 20, 200])))) for d in range(300)]
    rows += [(1000 + d, rows[7][1]) for d in range(40)]  # ties
    rows += [(5, "ax ax bY"), (None, "ax bx"), (400, None), (401, ""), (402, "-- ?"), (403, "Zebra " * 30000 + "only")]
    items = [(i, " ".join(rng.choices(words, k=12))) for i in range(30)]
    items += [(50, rows[7][1]), (51, None), (52, "!!"), (53, "unheard"), (54, "only zebra"), (54, "ax"), (None, "bY Ax")]
    assert ranked(spark, docs, items, rows) == plain_ranking(items, rows)
    assert ranked(spark, docs, items[:3], rows, k=1) == plain_ranking(items[:3], rows, k=1)


def test_blocks_of_queries(spark, docs, monkeypatch):
    monkeypatch.setattr(rs, "QUERY_TERMS", 3)
    rows = [(d, f"t{d % 7} t{d % 5} common") for d in range(50)]
    items = [(i, f"t{i} common") for i in range(6)]
    assert ranked(spark, docs, items, rows) == plain_ranking(items, rows)


def test_bounds_are_never_below_scores():
    rng = random.Random(2)
    for n in (1, 5, 300):
        counts = Counter(rng.choices([b"w%d" % k for k in range(200)], k=n))
        m = rs.saturation(n, 10, 400)
        sketch = rs.sketch_of(counts, m, WordHashes())
        found = sketch[rs.places(WordHashes().of(list(counts)), len(sketch))].min(axis=0).astype(np.int64) * rs.STEP
        exact = rs.impacts(np.array(list(counts.values()), np.int64), m)
        assert (found >= exact).all()


def test_empty_tables(spark, docs):
    assert ranked(spark, docs, [(1, "a")], []) == []
    assert ranked(spark, docs, [], [(1, "a")]) == []
    assert ranked(spark, docs, [(1, "a")], [(1, None), (2, "--")]) == []

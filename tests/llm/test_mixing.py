"""Raking against its marginals, sampling against its probabilities."""

import math
import random
from collections import Counter

from pyspark.sql import functions as F

from visloom.llm import mixing
from visloom.llm.common import Scratch, table


def test_marginals_meet_their_targets(spark):
    rng = random.Random(5)
    rows = [(f"s{s}", f"l{k}", f"t{t}", rng.randint(1, 10**6)) for s in range(4) for k in range(3) for t in range(2)]
    cells = spark.createDataFrame(rows, "k_source string, k_lang string, k_topic string, tokens long")
    want = {"source": [0.1, 0.2, 0.3, 0.4], "lang": [0.5, 0.3, 0.2], "topic": [0.9, 0.1]}
    targets = {
        d: spark.createDataFrame([(f"{d[0]}{k}", x) for k, x in enumerate(v)], f"k_{d} string, target double") for d, v in want.items()
    }
    fitted = mixing.raked(cells, targets, Scratch(spark, "t"))
    for d, v in want.items():
        got = {r[0]: r[1] for r in fitted.groupBy(f"k_{d}").agg(F.sum("share")).collect()}
        assert all(math.isclose(got[f"{d[0]}{k}"], x, abs_tol=2e-4) for k, x in enumerate(v))
    # Raking keeps the odds ratios of the table it started from.
    share = {r[:3]: (r["tokens"], r["share"]) for r in fitted.collect()}
    odds = lambda k: math.log(share["s0", "l0", "t0"][k] * share["s1", "l1", "t0"][k] / share["s0", "l1", "t0"][k] / share["s1", "l0", "t0"][k])
    assert math.isclose(odds(0), odds(1), rel_tol=1e-6, abs_tol=1e-9)


def plain_raking(tokens, powers=mixing.POWERS):
    """Shares, residuals of the worst marginal and whether the cyclic rounds settled, by dictionaries."""
    whole = sum(tokens.values())
    share = {c: n / whole for c, n in tokens.items()}
    targets = []
    for k, d in enumerate(mixing.DIMENSIONS):
        has = Counter()
        for c, n in tokens.items():
            has[c[k]] += n
        raised = {v: n ** powers[d] if n else 0.0 for v, n in has.items()}
        targets.append({v: x / sum(raised.values()) for v, x in raised.items()})

    def marginal(share, k):
        has = Counter()
        for c, x in share.items():
            has[c[k]] += x
        return has

    was, together = math.inf, False
    for _ in range(mixing.MAX_ROUNDS):
        new = dict(share)
        for k in range(3):
            has = marginal(share if together else new, k)
            new = {c: x * ((targets[k][c[k]] / has[c[k]] if has[c[k]] else 0.0) ** (1 / 3 if together else 1)) for c, x in new.items()}
        total = sum(new.values()) if together else 1.0
        share = {c: x / total for c, x in new.items()}
        off = max(abs(marginal(share, k)[v] - t) for k in range(3) for v, t in targets[k].items())
        if off <= mixing.TOLERANCE or (together and abs(was - off) <= mixing.TOLERANCE / 10):
            break
        together, was = together or off > mixing.STALLED * was, off
    return share, off, not together


def compare(rows):
    """Weights of a result against plain raking of its own cells."""
    cell = lambda r: (r["source"], r["lang"], r["topic"])
    tokens = Counter()
    for r in rows:
        tokens[cell(r)] += r["n_tokens"]
    share, off, settled = plain_raking(tokens)
    whole = sum(tokens.values())
    for r in rows:
        want = share[cell(r)] * whole / tokens[cell(r)] if tokens[cell(r)] else 0.0
        assert math.isclose(r["weight"], want, rel_tol=1e-6, abs_tol=1e-9)
    assert math.isclose(max(r["off_target"] for r in rows), off, rel_tol=1e-6, abs_tol=1e-9)
    return off, settled


def test_contradicting_targets_end_at_the_closest_marginals(docs):
    rng = random.Random(8)
    say = lambda n: " ".join("".join(rng.choices("abcdefgh", k=7)) for _ in range(n))
    rows = [(k, say(20 + 60 * (k % 6)), "de" if k % 6 > 3 else "en", f"s{k % 6}") for k in range(240)]
    got = mixing.mixed(docs(rows)).collect()
    off, settled = compare(got)
    assert not settled and mixing.TOLERANCE < off < 0.05
    shares = Counter()
    for r in got:
        shares[r["lang"]] += r["weight"] * r["n_tokens"]
    assert math.isclose(sum(shares.values()), sum(r["n_tokens"] for r in got), rel_tol=1e-6)


def test_a_round_makes_small_plans(docs, monkeypatch):
    """A plan that nests the dimensions' factors has every step several times, which the driver has to hold."""
    joins, put = [], Scratch.put

    def counted(self, df, name):
        joins.append(df._jdf.queryExecution().optimizedPlan().toString().count("Join "))
        return put(self, df, name)

    monkeypatch.setattr(Scratch, "put", counted)
    rows = [(k, "word " * (20 + 60 * (k % 6)), "de" if k % 6 > 3 else "en", f"s{k % 6}") for k in range(24)]
    off, settled = compare(mixing.mixed(docs(rows)).collect())
    assert not settled and max(joins) <= len(mixing.DIMENSIONS)


def test_the_rate_is_met_beside_vanishing_shares(spark):
    rows = [("a", 1000, 0.5), ("b", 4000, 0.5 - 1e-21), ("c", 5000, 1e-21)]
    cells = spark.createDataFrame(rows, "k string, tokens long, share double")
    for keep in (0.1, 0.45, 0.8):
        rate = mixing.sampling_rate(cells, keep)
        assert math.isclose(sum(min(n, rate * 10_000 * s) for _, n, s in rows), keep * 10_000, rel_tol=1e-6)


def test_all_documents(spark, sf):
    df = table(spark, sf, "documents")
    rows = mixing.mixed(df).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(r["doc_id"] for r in df.collect())
    words = {r["doc_id"]: len((r["text"] or "").encode().split()) for r in df.collect()}
    assert all(r["n_tokens"] == words[r["doc_id"]] and 0 <= r["probability"] <= 1 for r in rows)
    whole = sum(r["n_tokens"] for r in rows)
    assert math.isclose(sum(r["probability"] * r["n_tokens"] for r in rows), mixing.KEEP * whole, rel_tol=1e-3)
    compare(rows)
    again = mixing.mixed(df.repartition(3)).collect()
    assert {r["doc_id"] for r in again if r["sampled"]} == {r["doc_id"] for r in rows if r["sampled"]}


def test_everything_is_kept_if_all_is_asked_for(docs):
    df = docs([(k, "alpha beta gamma " * (k + 1), "en" if k % 2 else "de", f"s{k % 3}") for k in range(30)])
    assert mixing.sample_mix(df, keep=1.0).count() == 30


def test_edges(docs):
    assert mixing.mixed(docs([])).collect() == []
    rows = [(1, None), (2, ""), (3, "some longer words"), (3, "some longer words"), (None, "word"), (4, "word", None, None), (5, "word", "", "")]
    got = mixing.mixed(docs(rows)).collect()
    assert len(got) == len(rows)
    assert all(r["probability"] == 0 and not r["sampled"] and r["topic"] is None for r in got if r["n_tokens"] == 0)
    kept = mixing.sample_mix(docs(rows), keep=1.0)
    assert kept.columns == docs(rows).columns and sorted(r["doc_id"] for r in kept.collect()) == [3, 3, 4, 5]

"""Counts against plain Python, fits against numpy, verdicts on planted junk."""

import random
import re
from collections import Counter

import numpy as np

from visloom.llm import quality
from visloom.llm.common import Scratch, table

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_counts(text):
    words = WORD.findall(text or "")
    windows = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
    again = {k + j for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for j in range(3)}
    seen, repeated = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            repeated += line in seen
            seen.add(line)
    n = len(words)
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), repeated, len(again), n < 50 or 2 * len(again) > n)


NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def test_counts_of_all_documents(spark, sf):
    df = table(spark, sf, "documents")
    want = {r["doc_id"]: plain_counts(r["text"]) for r in df.collect()}
    got = quality.quality_verdicts(df).collect()
    assert {r["doc_id"]: tuple(r[n] for n in NAMES) for r in got} == want
    assert all(not r["kept"] for r in got if r["base_failed"])


def test_counts_of_odd_texts(docs):
    rng = random.Random(7)
    bits = ["a", "b", "a b a", " ", "\n", "\t", "\x0b", "\r\n", "é", " ", "#", "<|>", "\n\n", "a\n", "🙂"]
    texts = ["".join(rng.choices(bits, k=rng.randint(0, 60))) for _ in range(300)] + [None, "", "x " * 3000, "y" * 100_000]
    got = quality.statistics(docs(list(enumerate(texts)))).collect()
    assert {r["doc_id"]: tuple(r[n] for n in NAMES) for r in got} == {k: plain_counts(t) for k, t in enumerate(texts)}


def factor(s):
    """The inverse Cholesky factor of a scatter whose pivots are at least the squared floors."""
    low = np.zeros_like(s)
    for j in range(len(s)):
        low[j, j] = np.sqrt(max(s[j, j] - low[j, :j] @ low[j, :j], quality.FLOORS[j] ** 2))
        for i in range(j + 1, len(s)):
            low[i, j] = (s[i, j] - low[i, :j] @ low[j, :j]) / low[j, j]
    return np.linalg.inv(low)


def distances(x, m, s):
    return np.square((x - m) @ factor(s).T).sum(axis=1)


def plain_fit(x):
    """Centre and scaled scatter of one group, with numpy."""
    q = lambda a, p: np.quantile(a, p)
    middle = np.array([q(c, 0.5) for c in x.T])
    spread = np.array([q(np.abs(c - m), 0.5) for c, m in zip(x.T, middle, strict=True)])
    best = None
    for start in (np.diag(np.square(1.4826 * spread)), np.eye(x.shape[1])):
        m, s = middle, start
        for step in range(quality.MAX_STEPS):
            far = np.floor(np.log1p(distances(x, m, s)) * quality.STEPS_PER_UNIT + 0.5)
            core = x[far <= q(far, quality.CORE)]
            m, s = core.mean(axis=0), np.cov(core.T, bias=True).reshape(len(m), len(m))
        det = -2 * np.log(np.diag(factor(s))).sum()
        if best is None or det < best[0]:
            best = (det, m, s)
    _, m, s = best
    return m, s * max(1.0, np.median(distances(x, m, s)) / quality.CHI2_MEDIAN)


def plain_distances(groups):
    """Distances per group, each fit leaning on its language's and that on all rows'."""

    def lean(n, fit, above):
        own = n / (n + quality.PRIOR)
        return tuple(own * a + (1 - own) * b for a, b in zip(fit, above, strict=True))

    top = plain_fit(np.concatenate(list(groups.values())))
    out = {}
    for (lang, source), x in groups.items():
        same = np.concatenate([v for k, v in groups.items() if k[0] == lang])
        out[lang, source] = distances(x, *lean(len(x), plain_fit(x), lean(len(same), plain_fit(same), top)))
    return out


def test_fits_match_numpy(spark):
    rng = np.random.default_rng(3)
    step = lambda a: np.round(a * quality.STEPS_PER_UNIT) / quality.STEPS_PER_UNIT
    shape = rng.normal(size=(5, 5)) * 2
    groups = {}
    for g, n in ((("en", "a"), 400), (("en", "b"), 9), (("de", None), 200), ((None, "b"), 45), (("fr", "c"), 1)):
        x = rng.normal(size=(n, 5)) @ shape + 5
        x[: n // 9] += 60  # junk
        groups[g] = step(x)
    rows = [(*g, *map(float, r)) for g, x in groups.items() for r in x]
    df = spark.createDataFrame(rows, "lang string, source string, x0 double, x1 double, x2 double, x3 double, x4 double")
    fits = quality.covariance_fits(df, Scratch(spark, "t"))
    assert fits.count() == len(groups)
    far = quality._with_fit(df, fits, ["lang", "source"]).select("lang", "source", quality._distance().alias("d")).collect()
    for g, want in plain_distances(groups).items():
        got = sorted(r["d"] for r in far if (r["lang"], r["source"]) == g)
        assert np.allclose(got, sorted(want), rtol=0.05)
        assert sum(d > quality.CUTOFF for d in got) == len(want) // 9


def test_each_statistic_can_reject_alone():
    ranges = [np.log1p(20_000) - np.log1p(400), np.log1p(100) - np.log1p(6), np.log1p(100), np.log1p(100), np.log1p(50)]
    assert all((r / f) ** 2 > quality.CUTOFF for r, f in zip(ranges, quality.FLOORS, strict=True))


def test_junk_goes_and_prose_stays(docs):
    rng = random.Random(9)
    say = lambda n: " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 9))) for _ in range(n))
    rows = [(k, say(rng.randint(60, 400)), "en", "hot") for k in range(300)]
    rows += [(1000 + k, " ".join(w + "$$$" for w in say(100).split()), "en", "hot") for k in range(30)]
    rows += [(2000 + k, say(200), "xx", None) for k in range(5)] + [(3000, None), (3001, ""), (3001, "")]
    rows += [(4000 + k, say(200), "en", "small") for k in range(40)]
    rows += [(5000 + k, " ".join(w + "$$##|||" for w in say(100).split()), "en", "small") for k in range(5)]
    rows += [(6000, " ".join(w + "$$##|||" for w in say(100).split()), "yy", "alone")]
    line = say(30)
    rows += [(7000, "\n".join([say(30)] + 26 * [line]), "en", "small")]  # already over the plain limit
    got = quality.quality_verdicts(docs(rows)).collect()
    assert len(got) == len(rows)
    assert all((r["distance"] is None) == r["base_failed"] for r in got)
    kept = {r["doc_id"] for r in got if r["kept"]}
    assert kept == set(range(300)) | {2000 + k for k in range(5)} | {4000 + k for k in range(40)}
    stays = quality.keep_good(docs(rows))
    assert stays.columns == docs(rows).columns and {r["doc_id"] for r in stays.collect()} == kept
    assert quality.quality_verdicts(docs([])).collect() == []

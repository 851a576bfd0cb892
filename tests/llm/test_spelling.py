import random
import re
import zlib
from collections import Counter

from visloom.llm import spelling as sp
from visloom.llm.common import Scratch


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain_forms(docs, least_length=6, least_count=5, ratio=5):
    n = Counter()
    for d, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    words = {w: c for w, c in n.items() if len(w) >= least_length and c >= least_count}
    near = {w: [x for x in words if one_edit(w, x)] for w in words}
    form = {}
    for w in words:
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= ratio * words[w] else None
    out = []
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, words[w], len(near[w]), words.get(form[w])))
    return sorted(out, key=repr)


def formed(docs, rows):
    got = sp.variant_forms(docs(rows))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted((tuple(r) for r in got.collect()), key=repr)


def varied(rng, word):
    k = rng.randrange(len(word) + 1)
    letter = rng.choice("abéÀ×z")
    return rng.choice([word[:k] + letter + word[k:], word[:k] + letter + word[k + 1 :], word[: max(0, k - 1)] + word[k:]])


def test_equals_plain_forms(spark, docs):
    rng = random.Random(3)
    stems = ["".join(rng.choices("abcdé", k=rng.randrange(5, 9))) for _ in range(25)]
    words = stems + [varied(rng, s) for s in stems for _ in range(6)]
    words += [varied(rng, w) for w in words]
    rows = [(d, " ".join(rng.choices(words, [1 / (k + 1) for k in range(len(words))], k=150)).title()) for d in range(60)]
    rows += [(7, rows[3][1]), (None, rows[5][1]), (900, None), (901, ""), (902, "123 !? 日本"), (903, "abcabcab " * 50000), (904, "ab" * 300 + " ") ]
    rows += [(910 + k, "x" * 70 + "y" * 70 + " " + "x" * 70 + "y" * 71) for k in range(6)]
    want = plain_forms(rows)
    assert sum(r[1] is not None for r in want) > 20
    assert len({r[2] for r in want if r[1] is not None and r[2] != r[1]}) > 0  # chains of forms
    assert formed(docs, rows) == want


def test_small_blocks_lose_no_pair(spark):
    rng = random.Random(9)
    words = sorted({"".join(rng.choices("ab", k=rng.randrange(6, 10))) for _ in range(600)})
    frame = spark.createDataFrame([(w,) for w in words], "word string")
    got = sorted(tuple(r) for r in sp.near_pairs(frame, Scratch(spark, "t"), limit=4).collect())
    assert got == sorted((a, b) for a in words for b in words if one_edit(a, b))


def test_recurrences_track_all_edits():
    words = ["abcdef", "abcdeg", "xbcdef", "abcdefz", "aabcdef", "abcxdef", "abcdefgh", "abdcef", "bcdefa"]
    words = [w for w in words if len(w) in (6, 7)]
    pairs = {(words[a], words[b]) for a, b in sp.neighbours(words, 6)}
    assert pairs == {(a, b) for a in words for b in words if len(a) == 6 and one_edit(a, b) and len(b) >= 6}


def test_empty_table(spark, docs):
    assert formed(docs, []) == []
    assert formed(docs, [(1, None)]) == []

import random
import zlib

import numpy as np
import pytest

from visloom.llm import language_id as li

SYLLABLES = {
    "en": "the th ing and er ou wh ly tion ed st".split(),
    "de": "der die sch ung ich ein ge ver cht ß ü".split(),
    "fr": "le que eau ment aux ez é è oi ç ou".split(),
    "es": "el los que ción ado ñ mente as os rr ll".split(),
    "pl": "cz sz ow ski prz ł ę ą ie ny".split(),
}


def text_of(rng, lang, n=40):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randrange(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def labelled():
    rng = random.Random(1)
    rows = [(d, text_of(rng, lang := rng.choice(list(SYLLABLES))), lang) for d in range(800)]
    # Wrong labels on held-out rows must not matter.
    return [(d, t, lang if zlib.crc32(str(d).encode()) % 4 != 2 else "de") for d, t, lang in rows], rows


def predicted(spark, docs, rows, **kw):
    got = li.predicted_languages(docs(rows), **kw)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"]
    return got.collect()


def test_held_out_accuracy(spark, docs, labelled):
    rows, truth = labelled
    got = {r["doc_id"]: r for r in predicted(spark, docs, rows)}
    held = [d for d, *_ in truth if got[d]["held_out"]]
    assert {d for d, *_ in truth if zlib.crc32(str(d).encode()) % 4 == 2} == set(held)
    lang = {d: x for d, _, x in truth}
    assert np.mean([got[d]["lang_pred"] == lang[d] for d in held]) >= 0.97
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_nulls_and_texts_without_letters(spark, docs, labelled):
    rows, _ = labelled
    english = text_of(random.Random(4), "en")
    odd = [
        (9001, None, "en"),
        (9002, "", "en"),
        (9003, "12 !? 34", "en"),
        (9004, english, None),
        (None, english, "en"),
        (9005, english, "en"),
        (9005, english, "en"),
        (9006, english.upper(), None),
        (9007, (english + " ") * 20000, None),
    ]
    got = predicted(spark, docs, rows + odd)
    by_id = {}
    for r in got:
        by_id.setdefault(r["doc_id"], []).append((r["lang_pred"], r["score"]))
    assert by_id[9001] == by_id[9002] == by_id[9003] == [("und", 0.0)]
    assert len(by_id[9005]) == 2 and by_id[9005][0] == by_id[9005][1] == by_id[None][0]
    assert [by_id[d][0][0] for d in (9004, 9005, 9006, 9007)] == ["en"] * 4


def test_few_or_no_labels(spark, docs):
    assert predicted(spark, docs, []) == []
    only = predicted(spark, docs, [(1, "some words", "en"), (3, "more words", None)])
    assert {r["lang_pred"] for r in only} == {"en"}
    none = predicted(spark, docs, [(1, "some words", None)])
    assert [(r["lang_pred"], r["score"]) for r in none] == [("und", 0.0)]


def test_sample_is_bounded_and_does_not_depend_on_partitions(spark, docs, labelled):
    rows, _ = labelled
    frame = docs(rows).select("doc_id", "text", "lang")
    first, second = (li.machines(f, rows=20) for f in (frame.repartition(3), frame.repartition(11)))
    assert [d[:3] for d in first] == [d[:3] for d in second]
    assert all(d == e for d, e in zip(first, second, strict=True))


def test_pieces_of_a_long_text_count_like_the_whole(monkeypatch):
    text = "Ein  Wort, und -- noch éin Wort. " * 7
    whole = li.counts_of(text)
    for size in (1, 2, 5, 33):
        monkeypatch.setattr(li, "PIECE", size)
        assert (li.counts_of(text) == whole).all()


def test_families():
    assert li.family_of("en") == li.family_of("de-AT") == "germanic"
    assert li.family_of("fr") == "romance" and li.family_of("xx") == li.OTHER

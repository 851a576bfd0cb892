import random

import pytest
from pyspark.sql import functions as F

from visloom.functions import boxes as bx
from visloom.operators.terms import term_slices
from visloom.operators import detection, evaluation

SCHEMA = "box_id bigint, image_id string, label string, x1 double, y1 double, x2 double, y2 double"


def overlap(a, b):
    w = max(0.0, min(a[2], b[2]) - max(a[0], b[0]))
    h = max(0.0, min(a[3], b[3]) - max(a[1], b[1]))
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h
    return w * h / union if union > 0 else 0.0


def brute_pairs(pred, true, threshold):
    return [
        (t, p, overlap(t[3:], p[3:]))
        for t in true
        for p in pred
        if t[1:3] == p[1:3] and overlap(t[3:], p[3:]) >= threshold
    ]


def brute_matches(pred, true, threshold):
    """A plain loop over proposals: truths propose in order of their wishes, predictions keep the best."""
    first = {}
    for side in (true, pred):
        for box in sorted(side, reverse=True):
            first[id(side), box[1:]] = box[0]
    wishes, wanted = {}, {}
    for t, p, v in sorted(brute_pairs(pred, true, threshold), key=lambda x: (-x[2], first[id(pred), x[1][1:]], x[1][0])):
        wishes.setdefault(t[0], []).append(p[0])
        wanted[p[0], t[0]] = (-v, first[id(true), t[1:]], t[0])
    free, kept = list(wishes), {}
    while free:
        t = free.pop()
        while wishes[t]:
            p = wishes[t].pop(0)
            if p not in kept or wanted[p, t] < wanted[p, kept[p]]:
                if p in kept:
                    free.append(kept[p])
                kept[p] = t
                break
    return {(t, p) for p, t in kept.items()}


def random_boxes(rng, n, start):
    out = []
    for i in range(n):
        w, h = (10 ** rng.uniform(-3, 0) for _ in range(2))
        x, y = rng.uniform(-0.2, 1), rng.uniform(-0.2, 1)
        out.append((start + i, rng.choice(["hot", "hot", "img"]), rng.choice("ab"), x, y, x + w, y + h))
    return out


def near(rng, box, box_id):
    w, h = box[5] - box[3], box[6] - box[4]
    x, y = box[3] + rng.uniform(-0.4, 0.4) * w, box[4] + rng.uniform(-0.4, 0.4) * h
    return (box_id, box[1], box[2], x, y, x + w * rng.uniform(0.6, 1.6), y + h * rng.uniform(0.6, 1.6))


def test_a_crowded_image_does_not_meet_all_its_pairs(spark):
    """2,000 boxes of side 0.07 in one image: 4,000,000 pairs, some thousand of which overlap."""
    rng = random.Random(1)
    rows = [(k, "i", "a", x, y, x + 0.07, y + 0.07) for k in range(2000) for x, y in [(rng.random(), rng.random())]]
    boxes = spark.createDataFrame(rows, "box_id long, image_id string, label string, x1 double, y1 double, x2 double, y2 double")
    truth, pred = detection._prepared(boxes, boxes, 0.5)
    left, right = detection._with_grid(truth, pred, 0.5)
    grid = ["image_id", "label", "lw", "lh", "cx", "cy"]
    candidates = left.select(*grid, "truth_id").join(right.select(*grid, "pred_id"), grid).count()
    overlapping = detection._overlaps(truth, pred, 0.5).count()
    assert candidates <= 20 * overlapping


@pytest.mark.parametrize("threshold", [0.2, 0.3, 0.5, 0.9, 1.0])
def test_matches_equal_brute_force(spark, threshold):
    rng = random.Random(int(threshold * 10))
    true = random_boxes(rng, 150, 0)
    pred = [near(rng, rng.choice(true), 1000 + i) for i in range(250)]
    pred += [(2000 + i, *rng.choice(true)[1:]) for i in range(60)]
    true += [(500 + i, *rng.choice(true)[1:]) for i in range(60)]
    true.append((900, "hot", "a", 0.5, 0.5, 0.5, 0.7))
    pred.append((901, "hot", "a", 0.5, 0.5, 0.5, 0.7))
    p, t = spark.createDataFrame(pred, SCHEMA), spark.createDataFrame(true, SCHEMA)
    got = detection.match_boxes(p, t, threshold).collect()
    assert {(r["truth_id"], r["pred_id"]) for r in got} == brute_matches(pred, true, threshold)

    touching = {q[0] for _, q, _ in brute_pairs(pred, true, threshold)}
    matched = brute_matches(pred, true, threshold)
    scores = {r["image_id"]: r for r in detection.image_scores(p, t, threshold).collect()}
    for image in ("hot", "img"):
        mine = [q for q in pred if q[1] == image]
        truths = {q[0] for q in true if q[1] == image}
        row = scores[image]
        hits = sum(1 for a, _ in matched if a in truths)
        assert (row["expected"], row["predicted"], row["matched"]) == (len(truths), len(mine), hits)
        touches = sum(1 for q in mine if q[0] in touching)
        assert row["duplicates"] == touches - hits and row["wrong"] == len(mine) - touches
        assert row["reward"] == pytest.approx(hits - 0.5 * row["duplicates"] - 0.5 * row["wrong"])


def test_second_choices(spark):
    """Two truths want the same prediction; the one turned down gets its second one."""
    true = [(1, "i", "a", 0.0, 0.0, 10.0, 10.0), (2, "i", "a", 1.0, 0.0, 11.0, 10.0)]
    pred = [(11, "i", "a", 0.2, 0.0, 10.2, 10.0), (12, "i", "a", 2.8, 0.0, 12.8, 10.0)]
    p, t = spark.createDataFrame(pred, SCHEMA), spark.createDataFrame(true, SCHEMA)
    got = {(r["truth_id"], r["pred_id"]) for r in detection.match_boxes(p, t).collect()}
    assert got == {(1, 11), (2, 12)} == brute_matches(pred, true, 0.5)
    score = detection.image_scores(p, t).first()
    assert (score["matched"], score["duplicates"], score["wrong"]) == (2, 0, 0)


def test_rounds_of_crowded_images_are_few(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(k, f"i{k % 3}", "a", x, y, x + 0.1, y + 0.1) for k in range(900) for x, y in [(rng.random(), rng.random())]]
    boxes = spark.createDataFrame(rows, SCHEMA)
    moved = [(k, i, a, x + rng.gauss(0, 0.02), y, x2, y2) for k, i, a, x, y, x2, y2 in rows]
    written = []
    keep = detection.materialized
    monkeypatch.setattr(detection, "materialized", lambda df, name: written.append(name) or keep(df, name))
    got = detection.match_boxes(spark.createDataFrame(moved, SCHEMA), boxes).collect()
    assert {(r["truth_id"], r["pred_id"]) for r in got} == brute_matches(moved, rows, 0.5)
    assert sum(n.startswith("box-matches") for n in written) <= 12


@pytest.mark.parametrize("threshold", [0.5, 0.7, 0.9])
def test_grid_rows_are_few(spark, threshold):
    """At most 8 rows a box on either side, whatever the sizes."""
    rng = random.Random(3)
    boxes = spark.createDataFrame(random_boxes(rng, 2000, 0), SCHEMA)
    truth, pred = detection._prepared(boxes, boxes, threshold)
    for side, name in zip(detection._with_grid(truth, pred, threshold), ("truth_id", "pred_id"), strict=True):
        assert side.groupBy(name).count().agg(F.max("count")).first()[0] <= 8


def test_threshold_is_checked(spark):
    empty = spark.createDataFrame([], SCHEMA)
    for bad in (0, 1.5):
        with pytest.raises(ValueError):
            detection.match_boxes(empty, empty, bad)


def test_image_without_truth_or_prediction(spark):
    one = spark.createDataFrame([(1, "only-true", "a", 0.0, 0.0, 1.0, 1.0)], SCHEMA)
    two = spark.createDataFrame([(2, "only-pred", "a", 0.0, 0.0, 1.0, 1.0)], SCHEMA)
    rows = {r["image_id"]: r for r in detection.image_scores(two, one).collect()}
    assert rows["only-true"]["expected"] == 1 and rows["only-true"]["reward"] == 0
    assert rows["only-pred"]["wrong"] == 1 and rows["only-pred"]["reward"] == -0.5
    total = detection.precision_recall(detection.image_scores(two, one)).first()
    assert total["precision"] == 0 and total["recall"] == 0


def test_geometry(spark):
    df = spark.createDataFrame([(0.1, 0.2, 0.55, 1.0)], "x1 double, y1 double, x2 double, y2 double")
    b = bx.box(*[F.col(c) for c in df.columns])
    row = df.select(
        bx.to_pixels(b, F.lit(961), F.lit(541)).alias("px"),
        bx.crop_rect(b, F.lit(100), F.lit(50), 0.2).alias("crop"),
        bx.coord_bin(b["y2"], 10).alias("last"),
        bx.coord_bin(b["x1"], 10).alias("first"),
        bx.iou(b, b).alias("same"),
        bx.contains(b, F.lit(0.1), F.lit(0.2)).alias("edge"),
    ).first()
    assert tuple(row.px) == (96, 108, 528, 541)
    assert tuple(row.crop) == (0, 0, 75, 50)
    assert (row["last"], row["first"]) == (9, 1) and row.same == pytest.approx(1.0) and row.edge


def test_iou_is_symmetric_and_bounded(spark):
    rng = random.Random(3)
    rows = [(*a[3:], *b[3:]) for a, b in zip(random_boxes(rng, 80, 0), random_boxes(rng, 80, 0))]
    names = ["ax1", "ay1", "ax2", "ay2", "bx1", "by1", "bx2", "by2"]
    df = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names))
    a, b = bx.box(*[F.col(n) for n in names[:4]]), bx.box(*[F.col(n) for n in names[4:]])
    for r, raw in zip(df.select(bx.iou(a, b), bx.iou(b, a)).collect(), rows):
        assert r[0] == pytest.approx(r[1]) and 0 <= r[0] <= 1 and r[0] == pytest.approx(overlap(raw[:4], raw[4:]))


def test_accuracy_counts_unreadable_as_wrong(spark):
    rows = [("a", "r", "It is true", "True"), ("b", "r", "dunno", "True"), ("c", "r", "False", "True"), ("d", "r", "False", "False")]
    df = spark.createDataFrame(rows, "uid string, run string, response string, label string")
    row = evaluation.accuracy(evaluation.with_verdict(df), ["run"]).first()
    assert (row["n"], row["n_correct"], row["unparsed"]) == (4, 2, 1)
    assert (row["tp"], row["fp"], row["tn"], row["fn"]) == (1, 0, 1, 1) and row["accuracy"] == 0.5


def test_ablation_and_hard_subset(spark):
    rows = [("a", "base", True), ("a", "tool", True), ("b", "base", False), ("b", "tool", True), ("c", "base", True), ("c", "tool", False), ("d", "base", True)]
    df = spark.createDataFrame(rows, "uid string, run string, correct boolean")
    row = evaluation.ablation(df, "base", "tool").first()
    assert (row["n"], row["wins"], row["losses"]) == (3, 1, 1) and row["delta"] == pytest.approx(0)
    assert {r["uid"] for r in evaluation.hard_subset(df).collect()} == {"b", "c"}


def test_latest_correction_wins(spark):
    pred = spark.createDataFrame([("a", "True"), ("b", None), ("c", "False")], "uid string, pred string")
    fixes = spark.createDataFrame([("a", 1, "True"), ("a", 2, "False"), ("b", 1, "True")], "uid string, revision int, corrected string")
    got = {r["uid"]: (r["final"], r["was_corrected"]) for r in evaluation.apply_corrections(pred, fixes, ["uid"]).collect()}
    assert got == {"a": ("False", True), "b": ("True", True), "c": ("False", False)}


def test_terms_are_whole_words(spark):
    accented = spark.createDataFrame([(3, "édog dogö dog_ 1dog")], "id int, text string")
    assert term_slices(accented, "text", ["dog"]).count() == 0
    df = spark.createDataFrame([(1, "A Dog and a television"), (2, "dogma")], "id int, text string")
    got = {(r["id"], r["term"]) for r in term_slices(df, "text", ["dog", "television"]).collect()}
    assert got == {(1, "dog"), (1, "television")}
    odd = spark.createDataFrame([(1, "a.b or c++ (x"), (2, "axb Hot DOG")], "id int, text string")
    terms = ["a.b", "c++", "(x", "hot dog", "Dog", "dog"]
    got = {(r["id"], r["term"]) for r in term_slices(odd, "text", terms).collect()}
    assert got == {(1, "a.b"), (1, "c++"), (1, "(x"), (2, "hot dog"), (2, "Dog"), (2, "dog")}


def test_many_terms_at_once(spark):
    """100,000 terms of one to four words and odd ones, against a look at every place of every text."""
    rng = random.Random(4)
    words = [f"w{n}" for n in range(60)] + ["Ähre", "c++", "#tag", "a_b", "ß1"]
    terms = list({" ".join(rng.choices(words, k=rng.randint(1, 4))) for _ in range(101_000)})
    terms += ["++", "(", "w1  w2", "W1", "", None]
    texts = [rng.choice(" ,.\n(").join(rng.choices(words, k=rng.randint(0, 60))) for _ in range(60)] + ["", None, "w1  w2+++w1", "w1 w2" * 400]
    texts += [t.upper().replace("SS1", "ß1") for t in texts[:10]]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    table = spark.createDataFrame([(t,) for t in terms + terms[:50]], "term string")
    is_word = lambda c: c == "_" or c.isalnum()

    def mentions(text, term):
        at = text.find(term)
        while at >= 0:
            end = at + len(term)
            if not (at and is_word(text[at - 1])) and not (end < len(text) and is_word(text[end])):
                return True
            at = text.find(term, at + 1)
        return False

    want = set()
    for k, text in enumerate(texts):
        low = (text or "").lower()
        want |= {(k, t) for t in terms if t and t.lower() in low and mentions(low, t.lower())}
    rows = [(r["id"], r["term"]) for r in term_slices(df, "text", table).select("id", "term").collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want
    plan = term_slices(df, "text", table)._jdf.queryExecution().toString()
    assert "w59 w" not in plan


def test_runs_are_cut_without_functions_per_token(spark):
    """Texts of several batches, null and empty ones, in groups smaller than a text; no lambda runs for each token."""
    texts = ["Ab, cd", None, "", "c++ ab\ncd", "ab " * 40 + "++", "漢字 ab", "👍👍 cd"]
    df = spark.createDataFrame(list(enumerate(texts * 3)), "id int, text string").repartition(2)
    terms = ["AB", "ab, cd", "++", "漢字 ab", "👍", "👍👍", "cd", "ab\ncd"]
    said = term_slices(df, "text", terms)
    want = {0: {"AB", "ab, cd", "cd"}, 3: {"AB", "cd", "ab\ncd"}, 4: {"AB", "++"}, 5: {"AB", "漢字 ab"}, 6: {"👍", "👍👍", "cd"}}
    got = [(r["id"], r["term"]) for r in said.select("id", "term").collect()]
    assert sorted(got) == sorted((k + 7 * n, t) for k, found in want.items() for t in found for n in range(3))
    plan = said._jdf.queryExecution().optimizedPlan().toString()
    assert "lambdafunction" not in plan.split("Generate")[1].split("Join")[0]

import pytest

from visloom import schemas
from visloom.operators import pairs
from visloom.sinks.files import image_manifest
from visloom.sources.pairs import load_pairs

LEFT = ("a.png", 10, 20, "/tmp/own.png")
RIGHT = ("b.png", 30, 40, None)


def raw(spark, rows):
    return spark.createDataFrame(rows, schemas.PAIR_RAW)


def row(uid="u", sentence=" hi \n", label="true", nested=True, right=RIGHT):
    image = (LEFT, right) if nested else None
    return (uid, None, None, sentence, label, image, None if nested else LEFT, None if nested else right)


def test_both_layouts(spark):
    out = pairs.normalize_pairs(raw(spark, [row(), row("v", nested=False)])).orderBy("uid").collect()
    assert [[m.slot for m in r.metadata.images] for r in out] == [["left", "right"], ["image0", "image1"]]
    assert [i.path for i in out[1].images] == ["a.png", "b.png"]
    assert out[0].sentence == "hi" and out[0].label == "True" and out[0].metadata.sentence == " hi \n"
    assert out[0].metadata.label_raw == "true" and out[0].metadata.split == "train"


@pytest.mark.parametrize(
    "bad, reason",
    [
        (row(right=None), "missing image"),
        (row(label="maybe"), "unexpected label"),
        (row(label=None), "unsupported label type"),
        (row(label="1"), "unexpected label"),
    ],
)
def test_strict_and_lenient(spark, bad, reason):
    frame = raw(spark, [row(), bad])
    # Even a count, which needs no column, runs into the check.
    with pytest.raises(Exception, match=reason):
        pairs.normalize_pairs(frame).count()
    assert pairs.normalize_pairs(frame, strict=False).count() == 1
    assert [r.reason for r in pairs.rejected_pairs(frame).collect()] == [reason]


def test_fallback_uid_is_stable(spark):
    frame = raw(spark, [row(uid=None), row(uid="")])
    uids = {r.uid for r in pairs.normalize_pairs(frame, split="dev").collect()}
    again = {r.uid for r in pairs.normalize_pairs(frame.repartition(5), split="dev").collect()}
    assert uids == again and len(uids) == 1 and uids.pop().startswith("dev-")


def test_random_order_keeps_origin(spark):
    frame = raw(spark, [row(f"u{i}") for i in range(40)])
    out = pairs.normalize_pairs(frame, randomize_order=True).collect()
    swapped = 0
    for r in out:
        first = r.metadata.images[0]
        assert first.slot == "left"
        assert (r.images[0].path == "a.png") == (first.origin_slot == "left")
        swapped += first.origin_slot == "right"
    assert 5 < swapped < 35
    other = pairs.normalize_pairs(frame, randomize_order=True, seed=7).collect()
    assert [r.images for r in out] != [r.images for r in other]


def test_manifest_names_stay_inside(spark):
    evil = ("c.png", 1, 1, "../../x/evil.png")
    dots = ("d.png", 1, 1, "..")
    frame = raw(spark, [("u", None, None, "s", "true", (evil, dots), None, None), row("v")])
    names = {(r.uid, r.idx): r.out_name for r in image_manifest(pairs.normalize_pairs(frame)).collect()}
    assert names == {("u", 0): "evil.png", ("u", 1): "u_right.png", ("v", 0): "own.png", ("v", 1): "v_right.png"}


def test_sources_in_order(spark, tmp_path):
    raw(spark, [row("second")]).write.parquet(f"{tmp_path}/two/split=train")
    raw(spark, [row("third")]).write.parquet(f"{tmp_path}/three/split=train")
    found = load_pairs(spark, [f"{tmp_path}/one", f"{tmp_path}/two", f"{tmp_path}/three"])
    assert [r.uid for r in found.collect()] == ["second"]
    with pytest.raises(Exception):
        load_pairs(spark, [f"{tmp_path}/one"])


def test_splits(spark):
    frame = raw(spark, [row(uid=None)])
    splits = pairs.pair_splits(("train", frame), ("dev", frame))
    assert list(splits) == ["train", "dev"]
    assert sorted(r.uid.split("-")[0] for r in pairs.split_union(splits).collect()) == ["dev", "train"]

import pandas as pd
import pytest
from pyspark.sql import functions as F

from visloom.functions import chat
from visloom.operators import sft
from visloom.schemas import GUI_RAW, IMAGE
from visloom.sources import gui
from visloom.sources.scan import check_config

SCHEMA = f"index bigint, dataset string, image {IMAGE}, system string, user string, assistant string"
SHOT = ("s.png", 10, 20, None)


def records(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def messages(df):
    parts = [F.col(c) for c in ("dataset", "image", "system", "user", "assistant")]
    return df.withColumn("messages", chat.gui_messages(*parts))


def test_stage_one_never_has_system(spark):
    df = records(spark, [(0, "stage1", SHOT, "sys", "do it", "ok"), (1, "stage2", SHOT, "sys", "do it", "ok"), (2, "stage2", SHOT, "", "u", "a")])
    out = messages(df).orderBy("index").collect()
    assert [[m.role for m in r.messages] for r in out] == [["user", "assistant"], ["system", "user", "assistant"], ["user", "assistant"]]
    user = out[0].messages[0].content
    assert [(c.type, c.text) for c in user] == [("image", None), ("text", "do it")]
    assert user[0].image.path == "s.png"


def test_rendering_and_labels(spark):
    df = records(spark, [(0, "stage2", SHOT, "be brief", "click  the\nbutton", "click(x=1) now")])
    row = sft.sft_examples(sft.with_rendering(messages(df))).first()
    assert row.tokens == [
        "<|system|>", "be", "brief", "<|end|>", "<|user|>", "<image>", "click", "the", "button", "<|end|>",
        "<|assistant|>", "click(x=1)", "now", "<|end|>",
    ]
    assert row.response_start == 11
    assert row.labels[:11] == [-100] * 11 and row.labels[11:] == row.input_ids[11:]
    assert all(i > 0 for i in row.input_ids)


def test_single_turn_has_no_prompt(spark):
    one = spark.range(1).select(chat.conversation(F.array(F.lit(None).cast(IMAGE)), F.lit("hi")).alias("messages"))
    row = sft.with_rendering(one).first()
    assert row.response_start == 0 and row.tokens == ["<|user|>", "<image>", "hi", "<|end|>"]


def test_scoring_mask(spark):
    df = spark.createDataFrame([([5, 6, 0, 7, 0], 2), ([5, 6], 0)], "ids array<int>, p int")
    got = [r[0] for r in df.select(chat.scoring_labels(F.col("ids"), F.col("p"))).collect()]
    assert got == [[-100, -100, -100, 7, -100], [-100, 6]]


@pytest.mark.parametrize("multiple, widths", [(8, [8, 16]), (None, [3, 9])])
def test_padding(spark, multiple, widths):
    rows = [(0, [1, 2, 3], [-100, 2, 3]), (1, [1], [1]), (2, list(range(1, 10)), list(range(1, 10)))]
    df = spark.createDataFrame(rows, "index bigint, input_ids array<int>, labels array<int>")
    out = sft.pad_batches(df, 2, multiple=multiple).orderBy("index").collect()
    assert [r.padded_length for r in out] == [widths[0], widths[0], widths[1]]
    for r, (_, ids, labels) in zip(out, rows):
        gap = r.padded_length - len(ids)
        assert r.input_ids == ids + [0] * gap
        assert r.attention_mask == [1] * len(ids) + [0] * gap
        assert r.labels == labels + [-100] * gap


def test_length_cap(spark):
    df = records(spark, [(0, "stage1", SHOT, None, "u " * 50, "a " * 50)])
    rendered = sft.with_rendering(messages(df))
    row = sft.sft_examples(rendered, max_length=60).first()
    assert len(row.input_ids) == len(row.labels) == 60 and row.n_tokens == 105
    assert sft.over_length(rendered, 104).count() == 1 and sft.over_length(rendered, 105).count() == 0


def test_user_hooks(spark):
    df = spark.createDataFrame([(i, f"w{i} x") for i in range(6)], "index bigint, text string")

    def tokenise(batches):
        for pdf in batches:
            yield pd.DataFrame({"index": pdf["index"], "input_ids": [[len(t) for t in s.split()] for s in pdf["text"]]})

    ids = sft.map_batches(df, tokenise, "index bigint, input_ids array<int>")
    padded = sft.pad_batches(ids.withColumn("labels", F.col("input_ids")), 4)

    def stack(pdf):
        return pd.DataFrame({"batch": [pdf["batch"].iloc[0]], "rows": [len(pdf)]})

    got = sft.collate(padded, stack, "batch bigint, rows bigint").orderBy("batch").collect()
    assert [(r.batch, r.rows) for r in got] == [(0, 4), (1, 2)]


def test_gui_defaults_and_errors(spark, tmp_path):
    rows = [
        ([SHOT], [(None, "u", None)], None, "stage2", "coat", "train"),
        ([SHOT, SHOT], [("s", "u2", "a"), ("s", "x", "y")], "", "stage2", "coat", "train"),
        ([SHOT], [("s", "u3", "a")], "web", "stage2", "aitw-l2", "train"),
    ]
    spark.createDataFrame(rows, GUI_RAW).write.partitionBy("dataset", "config", "split").parquet(f"{tmp_path}/g")
    got = gui.load_stage2(spark, f"{tmp_path}/g", "coat").orderBy("user").collect()
    assert [(r.system, r.user, r.assistant, r.source) for r in got] == [("", "u", "", "coat"), ("s", "u2", "a", "")]
    assert gui.load_stage1(spark, f"{tmp_path}/g", "guienv").count() == 0
    with pytest.raises(ValueError, match="choices"):
        gui.load_stage1(spark, f"{tmp_path}/g", "coat")
    empty = spark.createDataFrame([([], [("s", "u", "a")], "w", "stage1", "guienv", "train")], GUI_RAW)
    with pytest.raises(Exception, match="without images or texts"):
        gui.normalize_gui(empty, "stage1").count()


def test_config_lists():
    check_config("stage1", "guienv")
    with pytest.raises(ValueError):
        check_config("stage3", "guienv")
    with pytest.raises(ValueError):
        check_config("stage2", "guienv")

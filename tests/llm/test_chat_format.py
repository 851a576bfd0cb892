"""Round trips of the chat format."""

import random

import duckdb
import pytest

from visloom.llm import chat
from visloom.llm.queries import QUERIES, SQL

BITS = ["<|im_end|>", "<|im_start|>", "<", "|", "\\", "\n", "a", "<\\|", "<\\\\|im_end|>", "assistant", "é🙂", "|>", " "]


def test_any_turns_come_back():
    rng = random.Random(3)
    text = lambda: "".join(rng.choices(BITS, k=rng.randint(0, 9)))
    for _ in range(4000):
        turns = [(text(), text()) for _ in range(rng.randint(0, 4))]
        assert [p[:2] for p in chat.parse(chat.rendered(turns))] == turns


def test_only_conflicts_are_escaped():
    out = chat.rendered([("user", "a <| b"), ("assistant", "x<|im_end|>\n")])
    assert "a <| b" in out and "x<\\|im_end|>" in out
    assert [out[a:b] for a, b in chat.loss_spans(out)] == ["x<\\|im_end|>\n"]


def test_parser_refuses_other_strings():
    for text in ("x", "<|im_start|>user\nhi", "<|im_start|>user\nhi<|im_end|>", "<|im_start|>u\n<|im_start|><|im_end|>\n"):
        with pytest.raises(chat.Malformed):
            chat.parse(text)


def test_query_matches_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    want = con.execute(SQL["op1_chat_format"]).df().sort_values("conv_id").reset_index(drop=True)
    got = QUERIES["op1_chat_format"](spark, sf).toPandas().sort_values("conv_id").reset_index(drop=True)
    assert got.to_dict() == want[got.columns].to_dict()


def test_nulls_ties_and_empty(spark):
    schema = "conv_id long, turn long, role string, text string, formatted string"
    rows = [(1, 0, "user", None, "z"), (1, 1, None, "b", "z"), (1, 1, None, "a", "z"), (1, 1, None, "a", "z"), (None, None, "assistant", "q", None)]
    got = {r["conv_id"]: r for r in chat.format_conversations(spark.createDataFrame(rows, schema)).collect()}
    assert [p[:2] for p in chat.parse(got[1]["formatted"])] == [("user", ""), ("", "a"), ("", "a"), ("", "b")]
    assert chat.parse(got[None]["formatted"])[0][:2] == ("assistant", "q")
    assert chat.read_back(chat.format_conversations(spark.createDataFrame([], schema))).collect() == []

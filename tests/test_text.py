from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from visloom.functions import text as tx
from visloom.functions.answers import (
    action_args,
    action_calls,
    action_lists,
    action_name,
    action_number,
    action_texts,
    blocks,
    true_false,
)
from visloom.functions.images import png_header, png_size


def column(spark, values, expr, type_="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {type_}")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("v"))).collect()]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(), min_size=30, max_size=60))
def test_strip_is_python_strip(spark, values):
    padded = [f"　\t {v}\x85\x1f\n" for v in values] + values
    assert column(spark, padded, tx.strip) == [v.strip() for v in padded]


def test_prompt_strips_and_fills(spark):
    got = column(spark, [" a cat {x} \n"], lambda c: tx.pair_prompt(c, "S: {statement}!"))
    assert got == ["S: a cat {x}!"]
    assert column(spark, ["x"], tx.pair_prompt)[0].endswith("Statement: x\nAnswer with either True or False.")


def test_uid_choice(spark):
    rows = [("u", "d", "i"), ("", "d", "i"), ("0", "", "i"), (None, None, ""), (None, None, None)]
    df = spark.createDataFrame([(n, *r) for n, r in enumerate(rows)], "n int, u string, d string, i string")
    got = df.orderBy("n").select(tx.example_uid(F.col("u"), F.col("d"), F.col("i"))).collect()
    assert [r[0] for r in got] == ["u", "d", "0", "", None]
    numbers = df.select(tx.example_uid(F.lit(0), F.lit(0.0), F.lit(7)), tx.example_uid(F.lit(5), F.col("d"), F.col("i")))
    assert tuple(numbers.first()) == ("7", "5")


def test_labels(spark):
    assert column(spark, [" TRUE ", "false", "yes", None, "1"], tx.clean_label) == ["True", "False", None, None, None]
    assert column(spark, [True, False], tx.clean_label, "boolean") == ["True", "False"]


def test_sample_id_round_trip(spark):
    rows = [("stage1", "coat", "train", 0), ("a", "", "c", 42), ("a", "b", "c", 1234567890123)]
    df = spark.createDataFrame(rows, "dataset string, config string, split string, index bigint")
    made = df.withColumn("sid", tx.make_sample_id(*[F.col(c) for c in df.columns]))
    back = made.withColumn("p", tx.parse_sample_id(F.col("sid"))).select("sid", "p.*").collect()
    assert [tuple(r)[1:] for r in back] == rows
    assert [r[0] for r in back] == ["stage1:coat:train:00000000", "a::c:00000042", "a:b:c:1234567890123"]


def test_bad_sample_ids(spark):
    bad = ["a:b:c", "a:b:c:d:1", "a:b:c:x", "a:b:c:1.5", ""]
    assert column(spark, bad, tx.parse_sample_id) == [None] * 5


def test_answers(spark):
    texts = ["The answer is TRUE.", "untrue", "False or true", "", None]
    assert column(spark, texts, true_false) == ["True", None, "False", None, None]


def test_actions(spark):
    calls = ["click(x=0.5, y=6.963e-1)", "scroll(dy=-3)", "click x=1", "click(x=1.2.3, x=2)"]
    assert column(spark, calls, action_name) == ["click", "scroll", None, "click"]
    args = column(spark, calls, action_args)
    assert args[0] == {"x": 0.5, "y": 0.6963} and args[1] == {"dy": -3.0} and args[3] == {"x": 2.0}
    assert column(spark, calls, lambda c: action_number(c, "x")) == [0.5, None, 1.0, None]


def test_action_arguments_of_all_kinds(spark):
    calls = [
        'type(text="hello, x=1 (ok)")',
        "pyautogui.click(\n  x=0.1,\n  y=2)",
        "press(keys=['ctrl', \"a\", 3])",
        r'write(message="say \"hi\"", interval=0.5)',
    ]
    assert column(spark, calls, action_name) == ["type", "click", "press", "write"]
    assert column(spark, calls, action_args) == [{}, {"x": 0.1, "y": 2.0}, {}, {"interval": 0.5}]
    assert column(spark, calls, action_texts) == [{"text": "hello, x=1 (ok)"}, {}, {}, {"message": 'say "hi"'}]
    assert column(spark, calls, action_lists)[2] == {"keys": ["ctrl", "a", "3"]}
    block = 'pyautogui.click(x=1, y=2)\ntype(text="a) b(") scroll(dy=-3)'
    assert column(spark, [block], action_calls) == [["pyautogui.click(x=1, y=2)", 'type(text="a) b(")', "scroll(dy=-3)"]]


def test_blocks(spark):
    text = "<think>a\nb</think>x<think></think><code>c</code><think>open"
    assert column(spark, [text], lambda c: blocks(c, "think")) == [["a\nb", ""]]


def test_png_header_round_trip(spark):
    df = spark.createDataFrame([(960, 540), (1, 70000)], "w int, h int")
    sizes = df.select(png_size(png_header(F.col("w"), F.col("h"))).alias("s")).select("s.*").collect()
    assert [tuple(r) for r in sizes] == [(960, 540), (1, 70000)]
    assert spark.createDataFrame([(bytearray(b"GIF89a"),)], "c binary").select(png_size(F.col("c"))).first()[0] is None

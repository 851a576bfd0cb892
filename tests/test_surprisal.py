import math

import pytest
from pyspark.sql import functions as F

from visloom.functions.scoring import log_softmax, target_logprob
from visloom.operators import counts, surprisal
from visloom.sinks.files import write_jsonl, write_run


def test_log_softmax_is_stable(spark):
    z = [1000.0, 1001.0, 998.0]
    df = spark.createDataFrame([(z,)], "z array<double>")
    top = max(z)
    norm = top + math.log(sum(math.exp(v - top) for v in z))
    got = df.select(log_softmax(F.col("z")), target_logprob(F.col("z"), F.lit(2))).first()
    assert got[0] == pytest.approx([v - norm for v in z]) and got[1] == pytest.approx(998.0 - norm)


def test_causal_shift(spark):
    flat = [0.0, 0.0, 0.0, 0.0]
    rows = [("s", 0, 1, [0.0, 5.0, 0.0, 0.0]), ("s", 1, 2, flat), ("s", 2, 3, flat)]
    df = spark.createDataFrame(rows, "sample_id string, pos int, token_id bigint, logits array<double>")
    got = {r["pos"]: r["logprob"] for r in surprisal.causal_logprobs(df).collect()}
    assert set(got) == {1, 2}
    assert got[1] == pytest.approx(0 - math.log(math.exp(5) + 3)) and got[2] == pytest.approx(-math.log(4))


def scored(spark):
    rows = [("a", 0, 7, 1.0), ("a", 1, 9, 2.5), ("a", 2, 7, 0.25), ("b", 0, 9, 4.0)]
    return spark.createDataFrame(rows, "sample_id string, pos int, token_id bigint, surprisal_bits double")


def test_sample_stats(spark):
    samples = spark.createDataFrame([("a",), ("b",), ("none",)], "sample_id string")
    out = surprisal.sample_surprisal(scored(spark), samples, F.col("token_id") == 7)
    got = {r["sample_id"]: r.asDict() for r in out.collect()}
    a = got["a"]
    assert (a["num_tokens"], a["num_image_tokens"], a["num_text_tokens"]) == (3, 2, 1)
    assert (a["image_surprisal_bits"], a["text_surprisal_bits"], a["total_surprisal_bits"]) == (1.25, 2.5, 3.75)
    assert a["avg_surprisal_bits"] == 1.25 and a["total_surprisal_nats"] == pytest.approx(3.75 * math.log(2))
    assert all(v == 0 for k, v in got["none"].items() if k != "sample_id")
    summary = surprisal.run_summary(out).first()
    assert summary["samples"] == 3 and summary["total_tokens"] == 4
    assert summary["mean_bits_per_token"] == pytest.approx(7.75 / 4) and summary["mean_bits_per_sample"] == pytest.approx(7.75 / 3)


def test_empty_run(spark):
    out = surprisal.sample_surprisal(scored(spark).where("false"))
    row = surprisal.run_summary(out).first()
    assert row["samples"] == 0 and row["mean_bits_per_token"] == 0 and row["mean_bits_per_sample"] == 0


def test_weighted_equals_expanded(spark):
    many = scored(spark).unionByName(scored(spark)).unionByName(scored(spark))
    once = scored(spark).withColumn("times", F.lit(3))
    columns = ["sample_id", "num_tokens", "total_surprisal_bits"]
    plain = surprisal.sample_surprisal(many).select(columns).orderBy("sample_id").collect()
    assert plain == surprisal.sample_surprisal(once, weight="times").select(columns).orderBy("sample_id").collect()


def test_details_in_order(spark):
    rows = scored(spark).withColumn("token", F.concat(F.lit("t"), "token_id")).repartition(4)
    got = {r["sample_id"]: [tuple(d) for d in r["token_details"]] for r in surprisal.token_details(rows).collect()}
    assert got["a"] == [(7, "t7", 1.0), (9, "t9", 2.5), (7, "t7", 0.25)]


def test_pair_bits_against_a_loop(spark):
    train, test = "a b a b c".split(), "a b d".split()
    df = spark.createDataFrame([("tr", train), ("te", test)], "sample_id string, tokens array<string>")
    pairs = counts.explode_pairs(df, "sample_id")
    table = counts.pair_table(pairs, F.col("sample_id") == "tr", F.col("sample_id") == "te")
    bits = {(r["prev"], r["token"]): r["surprisal_bits"] for r in counts.pair_bits(table, 0.5).collect()}
    n, ctx = {}, {}
    for p, t in zip(train, train[1:]):
        n[p, t] = n.get((p, t), 0) + 1
        ctx[p] = ctx.get(p, 0) + 1
    v = len({t for _, t in n}) + 1
    want = {(p, t): -math.log2((n.get((p, t), 0) + 0.5) / (ctx.get(p, 0) + 0.5 * v)) for p, t in zip(test, test[1:])}
    assert bits == pytest.approx(want, abs=1e-6)
    rows = counts.score_pairs(pairs.where("sample_id = 'te'"), counts.pair_bits(table, 0.5), table)
    assert rows.count() == 2


def test_adapter_params(spark):
    rows = [
        ("model.text_model.0.q_proj", "Linear", 2048, 2048),
        ("model.text_model.0.v_proj", "Linear", 2048, 256),
        ("model.text_model.0.v_proj.extra", "Linear", 9, 9),
        ("model.vision.0.q_proj", "Linear", 100, 100),
        ("model.text_model.0.q_proj", "Conv2d", 7, 7),
    ]
    df = spark.createDataFrame(rows, "name string, kind string, in_features bigint, out_features bigint")

    def params(suffixes, fragments):
        out = surprisal.adapter_params(df, suffixes, fragments, [8, 16])
        return [r["params"] for r in out.orderBy("rank").collect()]

    assert params(["q_proj", "v_proj"], ["text_model"]) == [8 * 6400, 16 * 6400]
    assert params(["q_proj"], []) == [8 * 4296, 16 * 4296]
    assert params([], ["text_model"]) == [0, 0]
    mapped = surprisal.params_map(surprisal.adapter_params(df, ["q_proj"], [], [8])).first()[0]
    assert mapped == {"8": 8 * 4296}
    full = surprisal.adapter_capacity(surprisal.adapter_params(df, ["q_proj"], [], [8]), F.lit(1e6)).first()
    assert full["load"] == pytest.approx(1e6 / (2 * 8 * 4296)) and full["min_rank"] == math.ceil(1e6 / (2 * 4296))


def test_json_lines_keep_nulls(spark, tmp_path):
    df = spark.createDataFrame([("a", None), ("b", 1)], "k string, v int")
    write_jsonl(df, f"{tmp_path}/out")
    lines = sorted(r[0] for r in spark.read.text(f"{tmp_path}/out").collect())
    assert lines == ['{"k":"a","v":null}', '{"k":"b","v":1}']
    data, meta = write_run(df, df.limit(1), str(tmp_path), "stage1_coat_train_20240101_000000")
    assert data.endswith("_000000.jsonl") and meta.endswith("_000000_meta.json")
    assert spark.read.json(data).count() == 2


def test_samples_without_tokens_have_empty_details(spark):
    rows = spark.createDataFrame([("a", 0, 5, "x", 1.5)], "sample_id string, pos int, token_id long, token string, surprisal_bits double")
    samples = spark.createDataFrame([("a",), ("b",)], "sample_id string")
    got = {r["sample_id"]: [tuple(d) for d in r["token_details"]] for r in surprisal.token_details(rows, samples).collect()}
    assert got == {"a": [(5, "x", 1.5)], "b": []}

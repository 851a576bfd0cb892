import pytest
from pyspark.sql import functions as F

from visloom.operators.pairs import normalize_pairs
from visloom.operators.sft import map_batches
from visloom.operators.surprisal import token_surprisal
from visloom.plans import fixtures as fx
from visloom.plans import flows


@pytest.fixture(scope="module")
def root(spark, sf, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("gui") / "raw")
    raw = fx.gui_raw(spark, sf).drop("conv_id", "turn")
    raw.repartition(3).write.partitionBy("dataset", "config", "split").parquet(folder)
    return folder


def test_surprisal_run(spark, root, tmp_path):
    data, meta = flows.surprisal_run(
        spark, root, "stage2", "coat", str(tmp_path), timestamp="20240101_000000", skip=1, limit=3, description="try"
    )
    assert data.endswith("stage2_coat_train_20240101_000000.jsonl")
    rows = spark.read.json(data).orderBy("index").collect()
    assert [r["index"] for r in rows] == [1, 2, 3]
    assert [r["sample_id"] for r in rows] == [f"stage2:coat:train:{i:08d}" for i in (1, 2, 3)]
    assert all(r["num_tokens"] > 0 and r["total_surprisal_bits"] > 0 and r["system_len"] >= 0 for r in rows)
    summary = spark.read.json(meta).first()
    assert (summary["samples"], summary["skip"], summary["limit"], summary["description"]) == (3, 1, 3, "try")
    assert summary["total_surprisal_bits"] == pytest.approx(sum(r["total_surprisal_bits"] for r in rows))
    assert summary["total_tokens"] == sum(r["num_tokens"] for r in rows)


def test_run_with_a_user_scorer(spark, root, tmp_path):
    def score(tokens):
        def uniform(batches):
            import pandas as pd

            for pdf in batches:
                out = []
                for sid, toks, start in zip(pdf["sample_id"], pdf["tokens"], pdf["response_start"]):
                    out += [(sid, i, toks[i], -1.0) for i in range(start, len(toks))]
                yield pd.DataFrame(out, columns=["sample_id", "pos", "token", "logprob"])

        narrow = tokens.select("sample_id", "tokens", "response_start")
        rows = map_batches(narrow, uniform, "sample_id string, pos int, token string, logprob double")
        return token_surprisal(rows)

    data, meta = flows.surprisal_run(spark, root, "stage1", "seeclick", str(tmp_path), timestamp="t", scorer=score)
    rows = spark.read.json(data)
    assert "system_len" not in rows.columns
    for r in rows.collect():
        assert r["total_surprisal_nats"] == pytest.approx(r["num_tokens"], rel=1e-5)
    assert spark.read.json(meta).first()["total_surprisal_nats"] > 0


def test_run_with_token_details(spark, root, tmp_path):
    data, _ = flows.surprisal_run(spark, root, "stage1", "seeclick", str(tmp_path), timestamp="d", details=True)
    for r in spark.read.json(data).collect():
        assert len(r["token_details"]) == r["num_tokens"]
        assert sum(d["surprisal_bits"] for d in r["token_details"]) == pytest.approx(r["total_surprisal_bits"])


def test_run_rejects_unknown_config(spark, root, tmp_path):
    with pytest.raises(ValueError):
        flows.surprisal_run(spark, root, "stage1", "coat", str(tmp_path), timestamp="t")


def test_training_table(spark, sf):
    raw = fx.pairs_raw(spark, sf)
    rows = flows.training_table(raw, take=40, batch_size=4, buffer=50, strict=False).orderBy("position").collect()
    assert [r["position"] for r in rows] == list(range(len(rows))) and 25 < len(rows) <= 40
    for r in rows:
        assert r["padded_length"] % 8 == 0 and len(r["input_ids"]) == len(r["labels"]) == r["padded_length"]
        scored = [i for i, x in enumerate(r["labels"]) if x != -100]
        assert scored == list(range(r["response_start"], min(r["n_tokens"], 2048)))
    again = flows.training_table(raw.repartition(5), take=40, batch_size=4, buffer=50, strict=False)
    assert [r["uid"] for r in again.orderBy("position").collect()] == [r["uid"] for r in rows]


def test_gallery(spark, sf):
    pairs = normalize_pairs(fx.pairs_raw(spark, sf), split="dev", strict=False)
    some = [r["uid"] for r in pairs.orderBy("index").limit(3).collect()]
    asked = [some[2], some[0], some[2]]
    assert [r["uid"] for r in flows.gallery(pairs, asked).orderBy("pos").collect()] == asked
    assert flows.gallery(pairs, n=5).count() == 5
    assert all(r["index"] < 10 for r in flows.gallery(pairs, n=50, limit=10).collect())
    assert flows.gallery(pairs.where(F.lit(False)), n=5).count() == 0

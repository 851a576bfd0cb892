"""Structured Streaming queries, driven to completion over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from visloom.functions.scoring import target_logprob
from visloom.operators import surprisal
from visloom.operators.pairs import normalize_pairs
from visloom.operators.evaluation import generation_log
from visloom.plans import fixtures as fx
from visloom.plans.registry import query
from visloom.session import scratch_path
from visloom.streaming import streams


def _stream(spark, sf, name):
    schema = fx.table(spark, sf, name).schema
    return streams.file_stream(spark, sf, f"{name}.parquet*", schema)


@query(
    "stream_normalize",
    fx.with_ctes(
        fx.SQL_RAW,
        select=f"""SELECT doc_id, coalesce(nullif(raw_uid, ''), nullif(identifier, ''), id,
    concat('dev-', substr(md5(sentence), 1, 8))) AS uid, {fx.sql_strip('sentence')} AS sentence,
  CASE WHEN doc_id % 2 = 0 THEN 'True' ELSE 'False' END AS label, CASE WHEN two_part THEN 'left' ELSE 'image0' END AS slot
FROM raw WHERE NOT missing AND doc_id % 10 <> 3""",
    ),
)
def stream_normalize(spark, sf):
    """The normalisation of the batch path, applied to arriving files."""
    doc = F.col("doc_id")
    label = F.when(doc % 10 == 3, "maybe").when(doc % 2 == 0, " true\n").otherwise("FALSE")
    raw = fx.pair_records(_stream(spark, sf, "documents"), label)
    pairs = normalize_pairs(raw, split=fx.SPLIT, strict=False)
    records = pairs.select("doc_id", "uid", "sentence", "label", F.get("metadata.images", 0)["slot"].alias("slot"))
    folder = scratch_path(spark, "stream-pairs")
    streams.run_to_files(records, folder, f"{folder}-checkpoint")
    return spark.read.schema(records.schema).parquet(folder)


@query(
    "stream_totals",
    fx.with_ctes(
        fx.SQL_LOGITS,
        select="""SELECT token_id AS label, count(*) AS samples, count(*) AS total_tokens,
  round(sum(((norm - z[token_id + 1]) / ln(2::DOUBLE))::DECIMAL(38, 15))::DOUBLE, 6) AS total_surprisal_bits FROM logits GROUP BY token_id""",
    ),
)
def stream_totals(spark, sf):
    logits = F.col("embedding").cast("array<double>")
    scored = _stream(spark, sf, "embeddings").select(
        F.col("label").cast("bigint").alias("label"),
        F.lit(1).alias("num_tokens"),
        target_logprob(logits, F.col("label")).alias("logprob"),
    )
    records = surprisal.token_surprisal(scored).withColumnRenamed("surprisal_bits", "total_surprisal_bits")
    folder = scratch_path(spark, "stream-totals")
    totals = streams.run_totals_to_table(streams.running_totals(records, ["label"]), ["label"], folder, f"{folder}-checkpoint")
    return totals.withColumn("total_surprisal_bits", F.round("total_surprisal_bits", 6))


@query("stream_dedup", "SELECT DISTINCT concat('dev-', sha256(text)) AS uid FROM documents")
def stream_dedup(spark, sf):
    """Different texts as they arrive, told apart by the whole digest."""
    uid = F.concat(F.lit("dev-"), F.sha2("text", 256))
    records = _stream(spark, sf, "documents").select(uid.alias("uid"), "doc_id")
    folder = scratch_path(spark, "stream-uids")
    unique = streams.first_seen(records).select("uid")
    streams.run_to_files(unique, folder, f"{folder}-checkpoint")
    return spark.read.schema(unique.schema).parquet(folder)


@query("stream_dedup_ttl", "SELECT DISTINCT concat('dev-', sha256(text)) AS uid FROM documents")
def stream_dedup_ttl(spark, sf):
    """The same with states that end a day after a text was first met."""
    uid = F.concat(F.lit("dev-"), F.sha2("text", 256))
    records = _stream(spark, sf, "documents").select(uid.alias("uid"), "doc_id")
    folder = scratch_path(spark, "stream-uids")
    unique = streams.first_seen(records, keep_seconds=86_400).select("uid")
    streams.run_to_files(unique, folder, f"{folder}-checkpoint")
    return spark.read.schema(unique.schema).parquet(folder)


@query(
    "stream_append_log",
    """SELECT text AS response, concat(conv_id, '-', turn) AS uid, turn AS index, 64 AS max_new_tokens FROM conversations
WHERE role = 'assistant'""",
)
def stream_append_log(spark, sf):
    answers = _stream(spark, sf, "conversations").where(F.col("role") == "assistant")
    log = generation_log(
        answers.select(
            F.lit("What comes next?").alias("question"),
            F.lit(None).cast("string").alias("system"),
            F.lit(0.0).alias("temperature"),
            F.lit(1.0).alias("top_p"),
            F.lit(64).alias("max_new_tokens"),
            F.col("text").alias("response"),
            F.lit(None).cast("string").alias("metadata"),
            F.concat_ws("-", "conv_id", "turn").alias("uid"),
            F.col("turn").alias("index"),
            F.lit("train").alias("split"),
            F.lit(None).cast("array<string>").alias("images"),
        )
    )
    folder = scratch_path(spark, "stream-log")
    streams.run_to_files(log, folder, f"{folder}-checkpoint", "json", ignoreNullFields="false")
    back = spark.read.schema(log.schema).json(folder)
    return back.select("response", "uid", "index", "max_new_tokens")

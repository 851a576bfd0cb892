"""Whole jobs: a surprisal run, a training table, a gallery."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from visloom.functions import chat
from visloom.functions.text import PAIR_PROMPT, hashed_token_id, make_sample_id
from visloom.operators import counts, evaluation, lookup, sampling, sft, surprisal
from visloom.operators.pairs import normalize_pairs, with_reject_reason
from visloom.operators.positions import rerank
from visloom.session import materialized
from visloom.sinks.files import write_jsonl, write_run
from visloom.sources.gui import normalize_gui
from visloom.sources.pairs import raw_pairs
from visloom.sources.scan import check_config, scan_with_index

Scorer = Callable[[DataFrame], DataFrame]


def count_scores(tokens: DataFrame, trained: Column | None = None, alpha: float = 1.0) -> DataFrame:
    """Response tokens (sample_id, pos, prev, token, surprisal_bits) scored by pair counts.

    ``tokens`` has sample_id, tokens and response_start; ``trained`` marks the records
    to learn from (all of them by default).
    """
    marked = tokens.withColumn("__trained", F.lit(True) if trained is None else trained)
    pairs = counts.explode_pairs(marked, "__trained", "response_start")
    table = counts.pair_table(pairs, F.col("__trained"), F.col("pos") >= F.col("response_start"))
    table = materialized(table, "pair-table")
    rows = counts.explode_pairs(tokens, "sample_id", start=F.col("response_start"))
    return counts.score_pairs(rows, counts.pair_bits(table, alpha), table)


def gui_tokens(spark: SparkSession, root: str, stage: str, config: str, split: str, skip: int, limit: int | None) -> DataFrame:
    """Rendered records of one configuration, cut to a position range before any costly step."""
    check_config(stage, config)
    raw = scan_with_index(spark, f"{root}/dataset={stage}/config={config}/split={split}", ["images", "texts", "source"])
    raw = sampling.skip_limit(raw, skip, limit).withColumn("config", F.lit(config))
    records = normalize_gui(raw, stage, keep=("index", "config"))
    if stage == "stage1":
        records = records.withColumn("system", F.lit(None).cast("string"))
    records = records.withColumns({"dataset": F.lit(stage), "split": F.lit(split)})
    sid = make_sample_id(F.col("dataset"), F.col("config"), F.col("split"), F.col("index"))
    parts = [F.col(c) for c in ("dataset", "image", "system", "user", "assistant")]
    messages = records.withColumn("sample_id", sid).withColumn("messages", chat.gui_messages(*parts))
    return sft.with_rendering(messages).drop("messages", "image", "user")


def surprisal_run(
    spark: SparkSession,
    root: str,
    stage: str,
    config: str,
    folder: str,
    *,
    timestamp: str,
    split: str = "train",
    skip: int = 0,
    limit: int | None = None,
    scorer: Scorer = count_scores,
    model: str = "pair counts",
    params: Column | None = None,
    description: str | None = None,
    details: bool = False,
) -> tuple[str, str]:
    """Score one configuration and write its records and metadata; returns both paths.

    With ``details`` each record carries its ``token_details``: token_id, token and bits of its response tokens
    in order, an empty list for a response without tokens.

    ``scorer`` turns (sample_id, tokens, response_start, …) into token rows with
    sample_id, token and surprisal_bits: the pair counts by default, or a model applied
    with :func:`visloom.operators.sft.map_batches`.
    """
    tokens = materialized(gui_tokens(spark, root, stage, config, split, skip, limit), "tokens")
    samples = tokens.withColumnRenamed("response_start", "prompt_tokens")
    is_image = F.col("token").isin(chat.IMAGE_TOKENS)
    scored = scorer(tokens)
    if details:
        scored = materialized(scored, "scored")
    records = surprisal.surprisal_records(samples, scored, is_image)
    if details:
        if "token_id" not in scored.columns:
            scored = scored.withColumn("token_id", hashed_token_id(F.col("token")))
        records = surprisal.token_details(scored, records)
    records = materialized(records, "records")
    if stage == "stage1":
        records = records.drop("system_len")
    summary = surprisal.run_summary(records).withColumns(
        {"dataset": F.lit(stage), "config": F.lit(config), "split": F.lit(split)}
    )
    meta = surprisal.run_metadata(summary, timestamp, model, limit, skip, params, description)
    return write_run(records, meta, folder, f"{stage}_{config}_{split}_{timestamp}")


def training_table(
    raw: DataFrame,
    *,
    split: str = "train",
    shuffle: bool = True,
    buffer: int | None = 10_000,
    seed: int = 42,
    take: int | None = None,
    template: str = PAIR_PROMPT,
    batch_size: int = 1,
    max_length: int | None = sft.MAX_LENGTH,
    strict: bool = True,
) -> DataFrame:
    """Padded training batches from raw pair records that carry ``index``.

    Order, take and the places without rejected records are decided on two narrow
    columns; only the taken records are normalised, rendered and padded.
    """
    order = with_reject_reason(raw).select("index", F.col("reason").isNull().alias("__good"))
    order = sampling.shuffle(order, seed=seed, buffer=buffer) if shuffle else order.withColumn("position", F.col("index"))
    if take is not None:
        order = sampling.take(order, take)
    if not strict:
        kept = order.where("__good").withColumnRenamed("position", "__place")
        order = rerank(kept, "__place", "position")
    pairs = normalize_pairs(
        raw.join(order.select("index", "position"), "index"), split=split, template=template, strict=strict
    )
    messages = chat.attach_response(chat.conversation(F.col("images"), F.col("prompt")), F.col("label"))
    rendered = sft.with_rendering(pairs.select("position", "uid", messages.alias("messages")))
    examples = sft.sft_examples(rendered.drop("messages"), max_length).drop("tokens")
    return sft.pad_batches(examples, batch_size, index="position")


def training_run(spark: SparkSession, candidates: Sequence[str], split: str = "train", **options) -> DataFrame:
    """Training batches from the first pair source that works: load, shuffle, take, normalise, render, pad."""
    return training_table(raw_pairs(spark, candidates, split), split=split, **options)


def evaluation_run(
    raw: DataFrame,
    predict: Callable[[DataFrame], DataFrame],
    folder: str,
    *,
    split: str = "dev",
    take: int | None = 512,
    shuffle: bool = True,
    buffer: int | None = None,
    seed: int = 42,
    template: str = PAIR_PROMPT,
    by: Sequence[str] = (),
) -> tuple[DataFrame, DataFrame]:
    """Answer a slice of the raw pair records (with ``index``), judge it and write both results.

    The slice is taken by position before anything is rendered; records that cannot be used
    are left out. ``predict`` gets the normalised examples and returns (position, response),
    for a model by :func:`visloom.operators.sft.map_batches`. Returns the judged predictions and the
    accuracy (per ``by``, if given), as read from ``folder``/predictions.jsonl and accuracy.jsonl.
    """
    order = raw.select("index")
    order = sampling.shuffle(order, seed=seed, buffer=buffer) if shuffle else order.withColumn("position", F.col("index"))
    if take is not None:
        order = sampling.take(order, take)
    pairs = normalize_pairs(raw.join(order, "index"), split=split, template=template, strict=False)
    gold = pairs.select("position", "index", "uid", "label", *by)
    # The position is unique, which a uid need not be: each answer meets its own example.
    judged = evaluation.with_verdict(predict(pairs).select("position", "response").join(gold, "position"))
    predictions = f"{folder}/predictions.jsonl"
    write_jsonl(judged, predictions)
    stored = raw.sparkSession.read.schema(judged.schema).json(predictions)
    summary = evaluation.accuracy(stored, by)
    write_jsonl(summary, f"{folder}/accuracy.jsonl")
    return stored, raw.sparkSession.read.schema(summary.schema).json(f"{folder}/accuracy.jsonl")


def gallery(
    pairs: DataFrame, uids: Sequence[str] | None = None, n: int = 4, seed: int = 42, limit: int | None = None
) -> DataFrame:
    """Requested samples in request order, or ``n`` random ones, optionally from the first ``limit``."""
    scope = pairs if limit is None else pairs.where(F.col("index") < limit)
    return lookup.lookup_uids(scope, uids) if uids else sampling.sample_n(scope, n, seed=seed)

"""Surprisal in bits: per token, per sample, per run, and against adapter capacity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visloom.functions.scoring import bits_to_nats, exact, nats_to_bits, target_logprob
from visloom.functions.text import make_sample_id

# Fixed value: what one trainable parameter can hold.
BITS_PER_PARAMETER = 2.0

RECORD_COLUMNS = [
    "sample_id",
    "dataset",
    "config",
    "split",
    "index",
    "source",
    "prompt_tokens",
    "response_tokens",
    "total_surprisal_bits",
    "total_surprisal_nats",
    "avg_surprisal_bits",
    "avg_surprisal_nats",
    "num_tokens",
    "num_image_tokens",
    "num_text_tokens",
    "image_surprisal_bits",
    "text_surprisal_bits",
    "assistant_len",
    "system_len",
]


def causal_logprobs(scores: DataFrame) -> DataFrame:
    """(sample_id, pos, token_id, logprob): the logits at ``pos - 1`` score the token at ``pos``.

    ``scores`` holds (sample_id, pos, token_id, logits). The shift is a join on
    (sample_id, pos), so a long sample is spread over tasks like everything else.
    """
    targets = scores.select("sample_id", "pos", "token_id")
    context = scores.select("sample_id", (F.col("pos") + 1).alias("pos"), "logits")
    return targets.join(context, ["sample_id", "pos"]).select(
        "sample_id", "pos", "token_id", target_logprob(F.col("logits"), F.col("token_id")).alias("logprob")
    )


def token_surprisal(tokens: DataFrame) -> DataFrame:
    """Add ``surprisal_nats`` and ``surprisal_bits`` to rows with ``logprob``."""
    nats = -F.col("logprob")
    return tokens.withColumn("surprisal_nats", nats).withColumn("surprisal_bits", nats_to_bits(nats))


def _ratio(total: Column, count: Column) -> Column:
    return F.coalesce(F.try_divide(total, count), F.lit(0.0))


def sample_surprisal(
    tokens: DataFrame, samples: DataFrame | None = None, is_image: Column | None = None, weight: str | None = None
) -> DataFrame:
    """Token counts and bit sums per sample; samples without tokens get zeros.

    ``tokens`` has sample_id and surprisal_bits; ``is_image`` marks image tokens and
    ``weight`` names a multiplicity column when equal tokens were combined before.
    """
    image = F.lit(False) if is_image is None else F.coalesce(is_image, F.lit(False))
    times = F.lit(1) if weight is None else F.col(weight)
    bits = exact(F.col("surprisal_bits") * times.cast("double"))
    none = exact(F.lit(0.0))
    sums = tokens.groupBy("sample_id").agg(
        F.sum(times).cast("bigint").alias("num_tokens"),
        F.sum(F.when(image, times).otherwise(0)).cast("bigint").alias("num_image_tokens"),
        F.sum(F.when(image, bits).otherwise(none)).cast("double").alias("image_surprisal_bits"),
        F.sum(F.when(~image, bits).otherwise(none)).cast("double").alias("text_surprisal_bits"),
    )
    if samples is not None:
        sums = samples.join(sums, "sample_id", "left").fillna(
            0, ["num_tokens", "num_image_tokens", "image_surprisal_bits", "text_surprisal_bits"]
        )
    total = F.col("image_surprisal_bits") + F.col("text_surprisal_bits")
    return (
        sums.withColumn("num_text_tokens", F.col("num_tokens") - F.col("num_image_tokens"))
        .withColumn("total_surprisal_bits", total)
        .withColumn("total_surprisal_nats", bits_to_nats(total))
        .withColumn("avg_surprisal_bits", _ratio(total, F.col("num_tokens")))
        .withColumn("avg_surprisal_nats", bits_to_nats(_ratio(total, F.col("num_tokens"))))
    )


def token_details(tokens: DataFrame, samples: DataFrame | None = None) -> DataFrame:
    """Per sample the scored tokens in order, as array(token_id, token, surprisal_bits).

    With ``samples`` (sample_id, …) every sample has a row, one without tokens an empty array.
    """
    entry = F.struct("pos", "token_id", "token", "surprisal_bits")
    ordered = F.array_sort(F.collect_list(entry))
    details = tokens.groupBy("sample_id").agg(
        F.transform(
            ordered,
            lambda t: F.struct(
                t["token_id"].alias("token_id"),
                t["token"].alias("token"),
                t["surprisal_bits"].alias("surprisal_bits"),
            ),
        ).alias("token_details")
    )
    if samples is None:
        return details
    kind = details.schema["token_details"].dataType
    return samples.join(details, "sample_id", "left").withColumn(
        "token_details", F.coalesce("token_details", F.array().cast(kind))
    )


def surprisal_records(samples: DataFrame, tokens: DataFrame, is_image: Column | None = None, **kw) -> DataFrame:
    """One record per sample: id, coordinates, counts, bits and text lengths.

    ``samples`` has dataset, config, split, index, source, prompt_tokens, assistant
    and system; the texts are reduced to their lengths before anything is joined.
    """
    system_len = F.when(F.col("dataset") == "stage2", F.char_length(F.coalesce("system", F.lit(""))))
    narrow = samples.select(
        make_sample_id(F.col("dataset"), F.col("config"), F.col("split"), F.col("index")).alias("sample_id"),
        "dataset",
        "config",
        "split",
        "index",
        "source",
        "prompt_tokens",
        F.char_length(F.coalesce("assistant", F.lit(""))).alias("assistant_len"),
        system_len.alias("system_len"),
    )
    scored = sample_surprisal(tokens, narrow, is_image, **kw)
    return scored.withColumn("response_tokens", F.col("num_tokens")).select(*RECORD_COLUMNS)


def run_totals(records: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Samples, tokens and bit sums of a run, or of each group in ``by``."""

    def bits(column: str) -> Column:
        return F.coalesce(F.sum(exact(F.col(column))).cast("double"), F.lit(0.0))

    return records.groupBy(*by).agg(
        F.count(F.lit(1)).alias("samples"),
        F.coalesce(F.sum("num_tokens"), F.lit(0)).cast("bigint").alias("total_tokens"),
        bits("total_surprisal_bits").alias("total_surprisal_bits"),
        bits("image_surprisal_bits").alias("image_bits_total"),
        bits("text_surprisal_bits").alias("text_bits_total"),
    )


def run_summary(records: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Totals plus nats and the means, which are 0 for an empty run."""
    total = F.col("total_surprisal_bits")
    return (
        run_totals(records, by)
        .withColumn("total_surprisal_nats", bits_to_nats(total))
        .withColumn("mean_bits_per_token", _ratio(total, F.col("total_tokens")))
        .withColumn("mean_bits_per_sample", _ratio(total, F.col("samples")))
    )


def run_prefix(dataset: Column, config: Column, split: Column, timestamp: Column) -> Column:
    """Name shared by a run's record file and its metadata."""
    return F.concat_ws("_", dataset, config, split, timestamp)


def run_metadata(
    summary: DataFrame,
    timestamp: str,
    model: str,
    limit: int | None = None,
    skip: int = 0,
    params: Column | None = None,
    description: str | None = None,
) -> DataFrame:
    """A summary per (dataset, config, split) as run metadata rows."""
    name = run_prefix(F.col("dataset"), F.col("config"), F.col("split"), F.lit(timestamp))
    return summary.select(
        F.lit(timestamp).alias("timestamp"),
        F.lit(model).alias("model"),
        "dataset",
        "config",
        "split",
        F.lit(limit).cast("bigint").alias("limit"),
        F.lit(skip).cast("bigint").alias("skip"),
        "samples",
        "total_tokens",
        "total_surprisal_bits",
        "total_surprisal_nats",
        "mean_bits_per_token",
        "mean_bits_per_sample",
        "image_bits_total",
        "text_bits_total",
        (F.lit(None).cast("map<string,bigint>") if params is None else params).alias("lora_param_counts"),
        F.concat(name, F.lit(".jsonl")).alias("output_file"),
        F.lit(description).cast("string").alias("description"),
    )


def adapter_width(modules: DataFrame, suffixes: Sequence[str], fragments: Sequence[str] = ()) -> DataFrame:
    """Σ(in + out) over the linear modules an adapter would attach to, as one row ``width``.

    A name must end with one of ``suffixes`` (none given: nothing matches) and contain
    one of ``fragments`` (none given: no such condition).
    """
    name = F.col("name")
    ends = F.lit(False)
    for suffix in suffixes:
        ends = ends | name.endswith(suffix)
    holds = F.lit(not fragments)
    for fragment in fragments:
        holds = holds | name.contains(fragment)
    chosen = modules.where((F.col("kind") == "Linear") & ends & holds)
    return chosen.agg(
        F.coalesce(F.sum(F.col("in_features") + F.col("out_features")), F.lit(0)).cast("bigint").alias("width")
    )


def adapter_params(
    modules: DataFrame, suffixes: Sequence[str], fragments: Sequence[str], ranks: Sequence[int]
) -> DataFrame:
    """Trainable parameters per rank: rank · Σ(in + out)."""
    return adapter_width(modules, suffixes, fragments).select(
        "width", F.explode(F.array(*[F.lit(r) for r in ranks])).alias("rank")
    ).withColumn("params", (F.col("width") * F.col("rank")).cast("bigint"))


def params_map(params: DataFrame) -> DataFrame:
    """The counts as one map from rank (as text) to parameters."""
    entries = F.array_sort(F.collect_list(F.struct("rank", "params")))
    return params.agg(
        F.map_from_entries(
            F.transform(entries, lambda e: F.struct(e["rank"].cast("string"), e["params"]))
        ).alias("lora_param_counts")
    )


def adapter_capacity(params: DataFrame, total_bits: Column) -> DataFrame:
    """Per rank: capacity, how full the data would make it, and the least rank that holds it."""
    capacity = F.col("params") * F.lit(BITS_PER_PARAMETER)
    return (
        params.withColumn("total_bits", total_bits)
        .withColumn("capacity_bits", capacity)
        .withColumn("load", F.coalesce(F.try_divide(F.col("total_bits"), capacity), F.lit(0.0)))
        .withColumn(
            "min_rank",
            F.ceil(F.try_divide(F.col("total_bits"), F.col("width") * F.lit(BITS_PER_PARAMETER))).cast("bigint"),
        )
    )

"""Training examples: rendered tokens, response-only labels, padded batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from visloom.functions import chat

MAX_LENGTH = 2048


def with_rendering(df: DataFrame, messages: str = "messages") -> DataFrame:
    """Add ``tokens`` and ``response_start`` for a conversation column.

    Everything before the answer counts as prompt, the opening of the last turn
    included; a conversation of one turn has no prompt.
    """
    turns = F.col(messages)
    parts = df.withColumn("__prompt", chat.render_prompt(turns)).withColumn("__last", chat.render_last(turns))
    start = F.when(F.size(messages) > 1, F.size("__prompt") + 1).otherwise(0)
    return (
        parts.withColumn("tokens", F.concat("__prompt", "__last"))
        .withColumn("response_start", F.least(start, F.size("tokens")))
        .drop("__prompt", "__last")
    )


def sft_examples(df: DataFrame, max_length: int | None = MAX_LENGTH) -> DataFrame:
    """Add ``input_ids``, ``labels`` and the full ``n_tokens`` to rendered rows.

    Ids and labels are cut to ``max_length`` as in training; ``n_tokens`` keeps the
    length before the cut.
    """
    ids = df.withColumn("n_tokens", F.size("tokens")).withColumn("input_ids", chat.token_ids(F.col("tokens")))
    ids = ids.withColumn("labels", chat.response_labels(F.col("input_ids"), F.col("response_start")))
    if max_length is None:
        return ids
    return ids.withColumn("input_ids", F.slice("input_ids", 1, max_length)).withColumn(
        "labels", F.slice("labels", 1, max_length)
    )


def pad_batches(
    examples: DataFrame,
    batch_size: int,
    index: str = "index",
    partition: tuple[str, ...] = (),
    multiple: int | None = 8,
    pad_id: int = 0,
) -> DataFrame:
    """Pad ids, mask and labels of each batch to its longest example, rounded up.

    A batch is ``batch_size`` consecutive positions, so the window that finds the
    longest example never holds more rows than that.
    """
    batched = examples.withColumn("batch", F.floor(F.col(index) / batch_size).cast("bigint"))
    longest = F.max(F.size("input_ids")).over(Window.partitionBy(*partition, "batch"))
    step = multiple or 1
    sized = batched.withColumn("padded_length", (F.ceil(longest / step) * step).cast("int"))
    length = F.col("padded_length")
    mask = F.transform("input_ids", lambda _: F.lit(1))
    return (
        sized.withColumn("attention_mask", chat.padded(mask, length, 0))
        .withColumn("labels", chat.padded(F.col("labels"), length, chat.IGNORE))
        .withColumn("input_ids", chat.padded(F.col("input_ids"), length, pad_id))
    )


def over_length(df: DataFrame, max_length: int = MAX_LENGTH) -> DataFrame:
    """Rows whose rendering is longer than the training limit."""
    return df.where(F.size("tokens") > max_length)


def map_batches(df: DataFrame, fn: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """User hook for a tokeniser or scorer: ``fn`` gets Arrow batches, never single rows."""
    return df.mapInPandas(fn, schema)


def collate(batched: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str, *keys: str) -> DataFrame:
    """User hook for a collator over padded batches; a group is one batch."""
    return batched.groupBy(*keys, "batch").applyInPandas(fn, schema)

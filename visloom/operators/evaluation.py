"""Scoring predictions: accuracy, variants against a baseline, slices, corrections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visloom.functions.answers import true_false
from visloom.functions.boxes import contains
from visloom.operators.joins import spread_join


def join_predictions(predictions: DataFrame, gold: DataFrame) -> DataFrame:
    """Predictions of one or several runs with the gold label of their uid.

    A uid given twice with one label counts once; with different labels it is an error.
    """
    least, most = F.min(F.struct("label")), F.max(F.struct("label"))
    unique = gold.groupBy("uid").agg(least.alias("__least"), most.alias("__most"))
    message = F.concat(F.lit("different gold labels for the uid "), F.col("uid"))
    label = F.when(F.col("__least") == F.col("__most"), F.col("__least.label")).otherwise(F.raise_error(message))
    return spread_join(predictions, unique.select("uid", label.alias("label")), ["uid"])


def with_verdict(joined: DataFrame) -> DataFrame:
    """Add ``pred`` and ``correct``; an answer that cannot be read counts as wrong."""
    pred = true_false(F.col("response"))
    return joined.withColumn("pred", pred).withColumn(
        "correct", F.coalesce(F.col("pred") == F.col("label"), F.lit(False))
    )


def accuracy(judged: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Accuracy and confusion counts per group."""
    yes, no = F.col("label") == "True", F.col("label") == "False"
    return judged.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("correct").alias("n_correct"),
        F.count_if(F.col("pred").isNull()).alias("unparsed"),
        F.count_if(yes & (F.col("pred") == "True")).alias("tp"),
        F.count_if(no & (F.col("pred") == "True")).alias("fp"),
        F.count_if(no & (F.col("pred") == "False")).alias("tn"),
        F.count_if(yes & (F.col("pred") == "False")).alias("fn"),
        F.avg(F.col("correct").cast("double")).alias("accuracy"),
    )


def generation_log(generated: DataFrame) -> DataFrame:
    """Log records; ``split`` stays null unless the input came from the dataset."""
    from_dataset = F.col("uid").isNotNull() | F.col("index").isNotNull()
    return generated.select(
        "question",
        "system",
        F.col("temperature").cast("double").alias("temperature"),
        F.col("top_p").cast("double").alias("top_p"),
        F.col("max_new_tokens").cast("int").alias("max_new_tokens"),
        "response",
        "metadata",
        "uid",
        "index",
        F.when(from_dataset, F.col("split")).alias("split"),
        "images",
    )


def ablation(judged: DataFrame, baseline: str, variant: str, run: str = "run", key: str = "uid") -> DataFrame:
    """One row: items both runs answered, their accuracies, the gap, wins and losses.

    The two verdicts of an item meet in one aggregation on its key, not in a self-join.
    """

    def verdict(name: str) -> Column:
        return F.max(F.when(F.col(run) == name, F.col("correct").cast("int")))

    both = (
        judged.where(F.col(run).isin(baseline, variant))
        .groupBy(key)
        .agg(verdict(baseline).alias("base"), verdict(variant).alias("var"))
        .where(F.col("base").isNotNull() & F.col("var").isNotNull())
    )
    return both.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.col("base").cast("double")).alias("base_accuracy"),
        F.avg(F.col("var").cast("double")).alias("variant_accuracy"),
        F.count_if(F.col("var") > F.col("base")).alias("wins"),
        F.count_if(F.col("var") < F.col("base")).alias("losses"),
    ).withColumn("delta", F.col("variant_accuracy") - F.col("base_accuracy"))


def hard_subset(judged: DataFrame, at_most: float = 0.5, key: str = "uid") -> DataFrame:
    """Items whose pass rate over all runs is low or modest."""
    return (
        judged.groupBy(key)
        .agg(F.count(F.lit(1)).alias("attempts"), F.avg(F.col("correct").cast("double")).alias("pass_rate"))
        .where(F.col("pass_rate") <= at_most)
    )


def apply_corrections(predictions: DataFrame, corrections: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Replace predicted labels by the latest human correction where there is one."""
    latest = corrections.groupBy(*keys).agg(F.max_by("corrected", "revision").alias("corrected"))
    return (
        spread_join(predictions, latest, keys, "left")
        .withColumn("was_corrected", F.col("corrected").isNotNull())
        .withColumn("final", F.coalesce("corrected", "pred"))
        .drop("corrected")
    )


def click_hits(clicks: DataFrame, grounding: DataFrame, key: str = "sample_id") -> DataFrame:
    """Clicks (key, x, y) against target boxes; a target without a readable click is a miss."""
    inside = contains(F.col("bbox_norm"), F.col("x"), F.col("y"))
    return grounding.join(clicks, key, "left").withColumn("hit", F.coalesce(inside, F.lit(False)))


def hit_rate(hits: DataFrame, by: Sequence[str]) -> DataFrame:
    return hits.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("hit").alias("n_hit"),
        F.avg(F.col("hit").cast("double")).alias("hit_rate"),
    )

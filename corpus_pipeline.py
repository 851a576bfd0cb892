"""The corpus pipeline: documents → quality → near duplicates → shared passages → mix → packed sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from visloom.llm import mixing, near_dedup, packing, quality, substring_dedup
from visloom.llm.common import Scratch, table
from visloom.llm.queries import WORD_BPE


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the rules do not reject."""
    return quality.keep_good(docs)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (5-word shingles, Jaccard 0.8)."""
    return near_dedup.keep_one_each(docs)


def substring_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that documents share stay in one of them only."""
    return substring_dedup.drop_repeated_passages(docs)


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample with raked source, language and topic weights."""
    return mixing.sample_mix(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all token pieces in sequences of 2048."""
    return packing.packed(docs, WORD_BPE)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", minhash_near_dedup),
    ("substring_dedup", substring_removal),
    ("mixing", mix_to_targets),
    ("packing", best_fit_packing),
]

# Robust fits, component search, raking and packing iterate: no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each written and read again before the next."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        done = scratch.put(stage(spark, docs, sf_dir), name)
        if k:
            scratch.drop(STAGES[k - 1][0])
        docs = done
    return docs

"""Loading the image-pair set from the first source that works."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from visloom.operators.pairs import normalize_pairs
from visloom.sources.scan import first_available

COLUMNS = ["uid", "identifier", "id", "sentence", "label", "image", "image0", "image1"]


def raw_pairs(spark: SparkSession, candidates: Sequence[str], split: str = "train") -> DataFrame:
    """The raw records of the first source that works, with their position as ``index``."""
    return first_available(spark, [f"{c}/split={split}" for c in candidates], COLUMNS, index="index")


def load_pairs(
    spark: SparkSession, candidates: Sequence[str], split: str = "train", *, lazy: bool = True, **options
) -> DataFrame:
    """Normalised pair examples with ``index``; ``lazy=False`` persists them for repeated reads."""
    pairs = normalize_pairs(raw_pairs(spark, candidates, split), split=split, **options)
    return pairs if lazy else pairs.persist()

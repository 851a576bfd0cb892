"""GUI action records (two stages) and grounding records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from visloom.functions.boxes import box
from visloom.sources.scan import check_config


def normalize_gui(raw: DataFrame, stage: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """First image and first text of each record, with empty strings for missing texts.

    A record without images or texts fails. The source defaults to the config only
    when it is absent. Stage 2 adds ``system``; ``keep`` names columns to pass through.
    """
    problem = F.raise_error(F.lit("GUI record without images or texts")).cast("boolean")
    usable = (F.size("images") > 0) & (F.size("texts") > 0)
    first = F.get("texts", 0)

    def text(name: str):
        return F.coalesce(first[name], F.lit("")).alias(name)

    fields = [F.get("images", 0).alias("image")]
    if stage == "stage2":
        fields.append(text("system"))
    fields += [text("user"), text("assistant"), F.coalesce("source", "config").alias("source")]
    return raw.where(F.when(usable, True).otherwise(problem)).select(*keep, *fields)


def load_gui(
    spark: SparkSession, root: str, stage: str, config: str, split: str = "train", keep: tuple[str, ...] = ()
) -> DataFrame:
    """Records of one configuration, read from ``root/dataset=…/config=…/split=…``.

    The three coordinates are partition columns, so only matching folders are listed.
    """
    check_config(stage, config)
    raw = spark.read.parquet(root).where(
        (F.col("dataset") == stage) & (F.col("config") == config) & (F.col("split") == split)
    )
    return normalize_gui(raw, stage, keep)


def load_stage1(spark: SparkSession, root: str, config: str, split: str = "train") -> DataFrame:
    return load_gui(spark, root, "stage1", config, split)


def load_stage2(spark: SparkSession, root: str, config: str, split: str = "train") -> DataFrame:
    return load_gui(spark, root, "stage2", config, split)


def normalize_grounding(raw: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Grounding records: image, bbox_norm, instruction, source, data_type."""
    b = [F.get("bbox", i) for i in range(4)]
    return raw.select(
        *keep,
        "image",
        box(*b).alias("bbox_norm"),
        "instruction",
        F.coalesce("data_source", F.lit("")).alias("source"),
        F.coalesce("data_type", F.lit("")).alias("data_type"),
    )


def load_grounding(spark: SparkSession, root: str, split: str = "train") -> DataFrame:
    return normalize_grounding(spark.read.parquet(root).where(F.col("split") == split))


def sample_view(df: DataFrame) -> DataFrame:
    """What a sample inspection shows: the id, the text fields present and the image size."""
    shown = [c for c in ("system", "user", "assistant", "source", "data_type") if c in df.columns]
    size = F.struct(F.col("image.width").alias("width"), F.col("image.height").alias("height"))
    return df.select("sample_id", *shown, size.alias("image_size"))

"""Normalising image-pair records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visloom.functions import text as tx
from visloom.functions.bind import bind
from visloom.functions.images import image_info


def pair_images(image: str = "image", first: str = "image0", second: str = "image1") -> Column:
    """Both layouts, struct(left, right) or two columns, as one ordered array."""
    nested = F.col(image)
    return F.when(nested.isNotNull(), F.array(nested["left"], nested["right"])).otherwise(
        F.array(F.col(first), F.col(second))
    )


def place_order(images: Column, seed: int, uid: Column) -> Column:
    """The original places 0..n-1 in an order drawn from (seed, uid)."""


    def keyed(u: Column) -> Column:
        return F.transform(
            images, lambda _, i: F.struct(F.md5(F.concat_ws(":", F.lit(str(seed)), u, i)).alias("h"), i.alias("i"))
        )

    return F.transform(F.array_sort(bind(uid, keyed)), lambda r: r["i"])


def reject_reason() -> Column:
    """Why a record cannot be used, or null; the first failing rule is named."""
    missing = F.exists(F.col("images"), lambda img: img.isNull())
    return (
        F.when(missing, "missing image")
        .when(F.col("label").isNull(), "unsupported label type")
        .when(tx.clean_label(F.col("label")).isNull(), "unexpected label")
        .when(F.col("sentence").isNull(), "missing sentence")
    )


def with_reject_reason(raw: DataFrame) -> DataFrame:
    """Raw records with ``images`` unified and a ``reason`` column."""
    return raw.withColumn("images", pair_images()).withColumn("reason", reject_reason())


def normalize_pairs(
    raw: DataFrame,
    *,
    split: str = "train",
    template: str = tx.PAIR_PROMPT,
    seed: int = 42,
    randomize_order: bool = False,
    strict: bool = True,
) -> DataFrame:
    """Typed pair examples: uid, sentence, label, images, prompt, metadata.

    ``strict`` fails on the first bad record; the check is a filter on every row, so
    the optimiser cannot drop it. Otherwise bad records are left out: read them with
    :func:`rejected_pairs`. Further input columns (a position, say) pass through.
    """
    checked = with_reject_reason(raw)
    if strict:
        problem = F.concat(F.lit("bad pair record: "), F.col("reason"))
        checked = checked.where(
            F.when(F.col("reason").isNull(), True).otherwise(F.raise_error(problem).cast("boolean"))
        )
    else:
        checked = checked.where(F.col("reason").isNull())

    shape = {"uid", "identifier", "id", "sentence", "label", "image", "image0", "image1", "images", "reason"}
    extra = [c for c in raw.columns if c not in shape]
    uid = F.coalesce(
        tx.example_uid(F.col("uid"), F.col("identifier"), F.col("id")),
        tx.fallback_uid(F.lit(split), F.col("sentence")),
    )
    typed = checked.withColumn("uid", uid).withColumn("two_part", F.col("image").isNotNull())
    origins = None
    if randomize_order:
        typed = typed.withColumn("places", place_order(F.col("images"), seed, F.col("uid"))).withColumn(
            "images", F.transform("places", lambda p: F.get(F.col("images"), p))
        )
        origins = F.transform(
            F.col("places"),
            lambda p: F.when(F.col("two_part"), F.when(p == 0, "left").otherwise("right")).otherwise(
                F.concat(F.lit("image"), p.cast("string"))
            ),
        )
    metadata = F.struct(
        "uid",
        "identifier",
        F.lit(split).alias("split"),
        "sentence",
        F.col("label").alias("label_raw"),
        image_info(F.col("images"), F.col("two_part"), origins).alias("images"),
    )
    return typed.select(
        *extra,
        "uid",
        tx.strip(F.col("sentence")).alias("sentence"),
        tx.clean_label(F.col("label")).alias("label"),
        "images",
        tx.pair_prompt(F.col("sentence"), template).alias("prompt"),
        metadata.alias("metadata"),
    )


def rejected_pairs(raw: DataFrame) -> DataFrame:
    """The records :func:`normalize_pairs` leaves out, with the reason."""
    return with_reject_reason(raw).where(F.col("reason").isNotNull())


def sample_summary(pairs: DataFrame) -> DataFrame:
    """What an inspection shows; the two urls are part of the shape but never known."""
    return pairs.select(
        "uid",
        "label",
        "sentence",
        F.col("metadata.images").alias("image_info"),
        F.lit(None).cast("string").alias("left_url"),
        F.lit(None).cast("string").alias("right_url"),
    )


def gallery_summary(pairs: DataFrame) -> DataFrame:
    return pairs.select("uid", "label", "sentence", "metadata")


def split_union(splits: dict[str, DataFrame]) -> DataFrame:
    """Splits keyed by name as one table with a ``split`` column."""
    frames = [df.withColumn("split", F.lit(name)) for name, df in splits.items()]
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def pair_splits(
    train: tuple[str, DataFrame], dev: tuple[str, DataFrame] | None = None, **options
) -> dict[str, DataFrame]:
    """Normalised train split and, when given, dev split, keyed by split name."""
    wanted = [train] if dev is None else [train, dev]
    return {name: normalize_pairs(raw, split=name, **options) for name, raw in wanted}

"""Box geometry on struct(x1, y1, x2, y2) columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.struct(
        x1.cast("double").alias("x1"),
        y1.cast("double").alias("y1"),
        x2.cast("double").alias("x2"),
        y2.cast("double").alias("y2"),
    )


def to_pixels(b: Column, width: Column, height: Column) -> Column:
    """Pixel box; fractions are cut off, not rounded."""
    return F.struct(
        (b["x1"] * width).cast("int").alias("x1"),
        (b["y1"] * height).cast("int").alias("y1"),
        (b["x2"] * width).cast("int").alias("x2"),
        (b["y2"] * height).cast("int").alias("y2"),
    )


def _area(b: Column) -> Column:
    return (b["x2"] - b["x1"]) * (b["y2"] - b["y1"])


def iou(a: Column, b: Column) -> Column:
    """Intersection over union, 0 for an empty union."""
    wide = F.greatest(F.lit(0.0), F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]))
    high = F.greatest(F.lit(0.0), F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]))
    shared = wide * high
    union = _area(a) + _area(b) - shared
    return F.when(union > 0, shared / union).otherwise(0.0)


def contains(b: Column, x: Column, y: Column) -> Column:
    return x.between(b["x1"], b["x2"]) & y.between(b["y1"], b["y2"])


def coord_bin(value: Column, bins: int) -> Column:
    """Bin 0..bins-1 of a normalised coordinate; 1.0 falls into the last bin."""
    return F.greatest(F.lit(0), F.least(F.floor(value * bins), F.lit(bins - 1))).cast("int")


def crop_rect(b: Column, width: Column, height: Column, margin: float = 0.0) -> Column:
    """Pixel rectangle around a box, widened by ``margin`` and kept inside the image."""

    def low(value: Column, size: Column) -> Column:
        return F.greatest(F.lit(0), F.floor((value - margin) * size)).cast("int")

    def high(value: Column, size: Column) -> Column:
        return F.least(size, F.ceil((value + margin) * size)).cast("int")

    return F.struct(
        low(b["x1"], width).alias("left"),
        low(b["y1"], height).alias("top"),
        high(b["x2"], width).alias("right"),
        high(b["y2"], height).alias("bottom"),
    )

"""Image headers without an image library."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from visloom.functions.bind import bind

# The PNG signature followed by the start of its header chunk.
PNG_START = "89504E470D0A1A0A0000000D49484452"


def _be_int(content: Column, offset: int) -> Column:
    return F.conv(F.hex(F.substring(content, offset, 4)), 16, 10).cast("int")


def png_size(content: Column) -> Column:
    """Struct(width, height) from the first bytes of a PNG file; null for other bytes."""
    is_png = F.hex(F.substring(content, 1, 16)) == PNG_START
    return F.when(
        is_png, F.struct(_be_int(content, 17).alias("width"), _be_int(content, 21).alias("height"))
    )


def _int(content: Column, offset: Column | int, length: int, little: bool = False) -> Column:
    """An unsigned number of ``length`` bytes from the 1-based ``offset``; null beyond the end."""
    at = F.lit(offset) if isinstance(offset, int) else offset
    digits = F.hex(F.substring(content, at, F.lit(length)))
    if little:
        digits = F.concat(*[F.substring(digits, 2 * k + 1, 2) for k in reversed(range(length))])
    return F.when(F.length(digits) == 2 * length, F.conv(digits, 16, 10).cast("int"))


def _size(width: Column, height: Column) -> Column:
    return F.when((width > 0) & (height > 0), F.struct(width.cast("int").alias("width"), height.cast("int").alias("height")))


def gif_size(content: Column) -> Column:
    """Struct(width, height) of a GIF file; null for other bytes."""
    is_gif = F.hex(F.substring(content, 1, 6)).isin("474946383761", "474946383961")
    return F.when(is_gif, _size(_int(content, 7, 2, little=True), _int(content, 9, 2, little=True)))


def webp_size(content: Column) -> Column:
    """Struct(width, height) of a WebP file of any of its three kinds; null for other bytes."""
    is_webp = (F.hex(F.substring(content, 1, 4)) == "52494646") & (F.hex(F.substring(content, 9, 4)) == "57454250")
    kind = F.hex(F.substring(content, 13, 4))
    extended = _size(_int(content, 25, 3, little=True) + 1, _int(content, 28, 3, little=True) + 1)
    low, high = _int(content, 22, 2, little=True), _int(content, 24, 2, little=True)
    width = low.bitwiseAND(0x3FFF) + 1
    height = F.shiftright(low, 14) + F.shiftleft(high.bitwiseAND(0xFFF), 2) + 1
    lossless = F.when(F.hex(F.substring(content, 21, 1)) == "2F", _size(width, height))
    key_frame = F.hex(F.substring(content, 24, 3)) == "9D012A"
    lossy = _size(
        _int(content, 27, 2, little=True).bitwiseAND(0x3FFF), _int(content, 29, 2, little=True).bitwiseAND(0x3FFF)
    )
    return F.when(
        is_webp,
        F.when(kind == "56503858", extended)
        .when(kind == "5650384C", lossless)
        .when((kind == "56503820") & key_frame, lossy),
    )


# JPEG markers that start a frame, stand alone, and end the headers.
JPEG_FRAMES = "FFC0 FFC1 FFC2 FFC3 FFC5 FFC6 FFC7 FFC9 FFCA FFCB FFCD FFCE FFCF".split()
JPEG_ALONE = "FF01 FFD0 FFD1 FFD2 FFD3 FFD4 FFD5 FFD6 FFD7 FFD8".split()
JPEG_ENDS = "FFD9 FFDA".split()
JPEG_STEPS = 1024  # a profile takes 255 segments at most; fill bytes count as steps


def jpeg_size(content: Column) -> Column:
    """Struct(width, height) of a JPEG file: a walk from marker to marker up to the frame header.

    Null for other bytes, for a broken chain of segments and for a file that ends before its frame header.
    """
    start = F.struct(F.lit(3).alias("at"), F.lit(True).alias("open"), F.lit(None).cast("int").alias("frame"))

    def step(state: Column, _: Column) -> Column:
        at = state["at"]
        marker = F.hex(F.substring(content, at, F.lit(2)))

        def go_on(to: Column) -> Column:
            return F.struct(to.cast("int").alias("at"), F.lit(True).alias("open"), state["frame"].alias("frame"))

        def stop(frame: Column) -> Column:
            return F.struct(at.alias("at"), F.lit(False).alias("open"), frame.cast("int").alias("frame"))

        length = _int(content, at + 2, 2)
        return (
            F.when(~state["open"], state)
            .when(marker.isin(JPEG_FRAMES), stop(at))
            .when(marker == "FFFF", go_on(at + 1))
            .when(marker.isin(JPEG_ALONE), go_on(at + 2))
            .when(marker.isin(JPEG_ENDS) | ~marker.startswith("FF") | (F.coalesce(length, F.lit(0)) < 2), stop(F.lit(None)))
            .otherwise(go_on(at + 2 + length))
        )

    walked = F.aggregate(F.sequence(F.lit(1), F.lit(JPEG_STEPS)), start, step)
    frame = bind(walked, lambda w: _size(_int(content, w["frame"] + 7, 2), _int(content, w["frame"] + 5, 2)))
    return F.when(F.hex(F.substring(content, 1, 3)) == "FFD8FF", frame)


def image_size(content: Column) -> Column:
    """Struct(width, height) from the header of a PNG, JPEG, GIF or WebP file, undecoded; null for anything else."""
    return bind(content, lambda c: F.coalesce(png_size(c), jpeg_size(c), gif_size(c), webp_size(c)))


def png_header(width: Column, height: Column) -> Column:
    """The first 24 bytes of a PNG file with the given size."""
    return F.unhex(
        F.concat(F.lit(PNG_START), F.lpad(F.hex(width), 8, "0"), F.lpad(F.hex(height), 8, "0"))
    )


def image_info(images: Column, two_part: Column, origins: Column | None = None) -> Column:
    """Per image: its place (left/right or image0/image1), size and file name."""

    def info(img: Column, i: Column) -> Column:
        slot = F.when(two_part, F.when(i == 0, "left").otherwise("right")).otherwise(
            F.concat(F.lit("image"), i.cast("string"))
        )
        origin = slot if origins is None else F.get(origins, i)
        return F.struct(
            slot.alias("slot"),
            origin.alias("origin_slot"),
            img["width"].alias("width"),
            img["height"].alias("height"),
            img["filename"].alias("filename"),
        )

    return F.transform(images, info)

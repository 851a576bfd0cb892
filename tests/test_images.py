import struct

import pytest
from pyspark.sql import functions as F

from visloom.functions.images import image_size
from visloom.session import scratch_path
from visloom.sinks import files
from visloom.sources.scan import image_files


def jpeg(width, height, *segments, frame=0xC0):
    out = b"\xff\xd8"
    for marker, body in segments:
        out += bytes([0xFF, marker]) + struct.pack(">H", len(body) + 2) + body
    return out + bytes([0xFF, frame]) + struct.pack(">HBHH", 17, 8, height, width) + b"\x03" + bytes(9)


def webp(kind, body):
    return b"RIFF" + struct.pack("<I", len(body) + 12) + b"WEBP" + kind + struct.pack("<I", len(body)) + body


CASES = {
    "png": (b"\x89PNG\r\n\x1a\n\x00\x00\x00\rIHDR" + struct.pack(">II", 70000, 3) + b"rest", (70000, 3)),
    "gif": (b"GIF87a" + struct.pack("<HH", 500, 300) + b"x", (500, 300)),
    "jpeg": (jpeg(640, 480), (640, 480)),
    "jpeg with a thumbnail": (jpeg(640, 480, (0xE1, jpeg(9, 9)), (0xC4, b"x" * 40), frame=0xC2), (640, 480)),
    "jpeg with a long profile": (jpeg(1, 65535, *[(0xE2, b"p" * 65000)] * 60), (1, 65535)),
    "jpeg with fill bytes": (b"\xff\xd8\xff\xff\xff" + jpeg(7, 8)[2:], (7, 8)),
    "webp lossy": (webp(b"VP8 ", b"\0\0\0\x9d\x01\x2a" + struct.pack("<HH", 176 | 0x4000, 144 | 0xC000)), (176, 144)),
    "webp lossless": (webp(b"VP8L", b"\x2f" + struct.pack("<I", (16384 - 1) | (9999 - 1) << 14 | 1 << 28)), (16384, 9999)),
    "webp extended": (webp(b"VP8X", bytes(4) + (99999).to_bytes(3, "little") + (4).to_bytes(3, "little")), (100000, 5)),
    "jpeg without frame": (b"\xff\xd8\xff\xda\x00\x08", None),
    "jpeg cut off": (jpeg(640, 480)[:8], None),
    "jpeg with a broken chain": (b"\xff\xd8\xff\xe0\x00\x04ab" + b"zz" + jpeg(1, 1)[2:], None),
    "gif cut off": (b"GIF89a\x01", None),
    "webp of another kind": (webp(b"ABCD", bytes(20)), None),
    "text": (b"hello, this is no image at all", None),
    "nothing": (b"", None),
    "null": (None, None),
}


def test_sizes_of_all_formats(spark):
    frame = spark.createDataFrame([(n, c) for n, (c, _) in CASES.items()], "name string, content binary")
    got = {r["name"]: tuple(r["size"]) if r["size"] else None for r in frame.select("name", image_size(F.col("content")).alias("size")).collect()}
    assert got == {n: size for n, (_, size) in CASES.items()}


def manifest(spark):
    rows = [("a/b", 0, "x.png", "p1"), ("a/b", 1, "x.png", "p2"), ("..", 0, "x.png", "p1"), ("c", 0, "y.png", "p3")]
    return spark.createDataFrame(rows, "uid string, idx int, out_name string, path string")


def test_equal_names_all_survive(spark):
    images = spark.createDataFrame([(p, p.encode()) for p in ("p1", "p2", "p3", "p4")], "path string, content binary")
    folder = scratch_path(spark, "export")
    files.export_samples(manifest(spark), images, folder)
    got = {(r["uid"], r["idx"]): (bytes(r["content"]), r["length"]) for r in files.exported(spark, folder).collect()}
    assert got == {("a/b", 0): (b"p1", 2), ("a/b", 1): (b"p2", 2), ("..", 0): (b"p1", 2), ("c", 0): (b"p3", 2)}
    # What a lost attempt left behind is on no list.
    stray = folder.removeprefix("file://") + "/files/lost/s-c"
    import os

    os.makedirs(stray)
    with open(f"{stray}/y.png", "wb") as out:
        out.write(b"half")
    assert files.exported(spark, folder).count() == 4


def test_an_export_is_read_without_listing_its_folders(spark):
    rows = [(f"u{k}", 0, "_x.png" if k == 3 else "x.png", f"p{k % 40}") for k in range(200)]
    images = spark.createDataFrame([(f"p{k}", f"p{k}".encode()) for k in range(40)], "path string, content binary")
    folder = scratch_path(spark, "export")
    files.export_samples(spark.createDataFrame(rows, "uid string, idx int, out_name string, path string"), images, folder)
    found = files.exported(spark, folder)
    # Of the folder, only the list's parts are known to the driver.
    assert all(f.endswith(".parquet") for f in found.inputFiles())
    assert {(r["uid"], bytes(r["content"])) for r in found.collect()} == {(uid, path.encode()) for uid, _, _, path in rows}


def test_large_files_leave_in_several_batches(spark, monkeypatch):
    monkeypatch.setattr(files, "LOADED_BYTES", 100)
    images = spark.range(30).select(F.concat(F.lit("p"), "id").alias("path"), F.encode(F.repeat(F.lit("b"), F.col("id").cast("int") * 9), "utf-8").alias("content"))
    listed = spark.range(30).select(F.concat(F.lit("u"), "id").alias("uid"), F.lit(0).alias("idx"), F.lit("x.png").alias("out_name"), F.concat(F.lit("p"), "id").alias("path"))
    folder = scratch_path(spark, "export")
    files.export_samples(listed, images, folder)
    lost = files.saved_list(spark, folder).where("uid = 'u7'").first()["file"]
    import os

    os.remove(folder.removeprefix("file://") + f"/{lost}")
    got = {r["uid"]: (len(r["content"]), r["length"]) for r in files.exported(spark, folder).collect()}
    assert got == {f"u{k}": (9 * k, 9 * k) for k in range(30) if k != 7}


def test_image_without_bytes_is_an_error(spark):
    images = spark.createDataFrame([("p1", b"x")], "path string, content binary")
    folder = scratch_path(spark, "export")
    with pytest.raises(Exception, match="no bytes for the image"):
        files.export_samples(manifest(spark), images, folder)


def test_many_small_files_share_a_task(spark):
    images = spark.range(400).select(F.format_string("%d.png", "id").alias("out_name"), F.encode(F.col("id").cast("string"), "utf-8").alias("content"))
    folder = scratch_path(spark, "images")
    files.export_images(images, folder)
    found = image_files(spark, folder)
    assert found.rdd.getNumPartitions() <= 8  # 13 when 32 files fill a task
    assert {(r["filename"], bytes(r["content"]), r["length"]) for r in found.collect()} == {
        (f"{k}.png", str(k).encode(), len(str(k))) for k in range(400)
    }
    here, beside = spark.conf.getAll, found.sparkSession.conf.getAll
    assert {k: v for k, v in here.items() if beside.get(k) != v and "openCostInBytes" not in k} == {}
    joined = spark.createDataFrame([("7.png",)], "filename string").join(found, "filename")
    assert [bytes(r["content"]) for r in joined.collect()] == [b"7"]

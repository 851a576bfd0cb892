"""Shared pieces of the text operators: words, hashes, tables in the shared folder."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from visloom.session import shared_dir

# White space between words is \x20 and \x09-\x0D. ``bytes.split()`` splits at exactly
# these, and ``bytes.lower()`` changes A-Z only.
SPACE = "[\\x20\\x09-\\x0D]+"

WORDS_KEPT = 400_000
PARITY_SEED = np.uint64(0x8BB84B93962EACC9)
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make this package importable in the Python workers, wherever they run.

    Spark's own file service carries the archive; it goes out once per application.
    """
    sc = spark.sparkContext
    if sc.applicationId not in _SHIPPED:
        package = Path(__file__).resolve().parents[1]
        archive = os.path.join(tempfile.mkdtemp(prefix="ship-"), f"{package.name}.zip")
        with zipfile.ZipFile(archive, "w") as out:
            for source in sorted(package.rglob("*.py")):
                out.write(source, source.relative_to(package.parent))
        sc.addPyFile(archive)
        _SHIPPED.add(sc.applicationId)


class Scratch:
    """Tables written once below ``spark.checkpoint.dir`` and read by several later steps.

    ``drop`` deletes tables nothing reads any more; what the returned DataFrame still
    reads stays.
    """

    def __init__(self, spark: SparkSession, name: str):
        ship(spark)
        self.spark = spark
        root = re.sub("^file:/(?!/)", "file:///", shared_dir(spark))
        self.root = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def put(self, df: DataFrame, name: str) -> DataFrame:
        """Write a table and read it back; the shuffle files of its making go when it is written."""
        conf = self.spark.conf
        was = conf.get(CLEANUP, "false")
        conf.set(CLEANUP, "true")
        try:
            df.write.parquet(self.path(name))
        finally:
            conf.set(CLEANUP, was)
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: Column) -> Column:
    """The words of a text (null: none) as an array, in JVM code."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bounded number of words."""

    def __init__(self, limit: int = WORDS_KEPT):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection: no two values meet)."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """One hash per window of ``size`` words; fewer words make one shingle of all; none make none."""
    n = len(hashes)
    if n == 0:
        return hashes
    width = min(size, n)
    out = np.full(n - width + 1, width, np.uint64)
    for k in range(width):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + hashes[k : n - width + 1 + k])
    return out


def parity_sketches(values: np.ndarray, starts: np.ndarray, n_words: int) -> np.ndarray:
    """One row of ``n_words`` 64-bit words per set: for each bit, the parity of the number of elements that fall on it.

    ``values`` holds the sets one after the other, none empty; ``starts`` is where each begins. An element that two sets share
    flips the same bit in both, so two rows never differ in more bits than the sets differ in elements.
    """
    bits = mix(values ^ PARITY_SEED) % np.uint64(64 * n_words)
    flags = np.uint64(1) << (bits & np.uint64(63))
    words = (bits >> np.uint64(6)).astype(np.int64)
    out = np.zeros((len(starts), n_words), np.uint64)
    of = np.repeat(np.arange(len(starts)), np.diff(starts, append=len(values)))
    np.bitwise_xor.at(out, (of, words), flags)
    return out.view(np.int64)


def parity_allows(n_words: int, percent: int) -> Column:
    """Whether a pair can have 100 · |A ∩ B| ≥ percent · |A ∪ B|, by sizes (n) and parity sketches (parity), suffixes _a and _b.

    Such sets differ in at most (100 - percent) / (100 + percent) of |A| + |B| elements, and their sketches in no more
    bits: no pair is lost. Null where one has no parity sketch.
    """
    differing = sum(
        (F.bit_count(F.get(F.col("parity_a"), k).bitwiseXOR(F.get(F.col("parity_b"), k))) for k in range(n_words)), F.lit(0)
    )
    sizes = F.col("n_a") + F.col("n_b")
    return (100 + percent) * differing <= (100 - percent) * sizes


def sizes_allow(percent: int) -> Column:
    """Whether sets of these sizes (n_a, n_b) can be so similar."""
    return 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")


def texts_as_bytes(column) -> list[bytes]:
    """An Arrow string column as UTF-8 bytes; null as empty."""
    import pyarrow as pa

    return [b"" if v is None else v for v in column.cast(pa.binary()).to_pylist()]

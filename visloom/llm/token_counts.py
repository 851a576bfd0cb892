"""Token counts by batch encoding, with lengths as the only result.

Texts are split at safe boundaries: before a single space that follows a character other than
white space. A byte-level pre-tokenizer never joins what stands on the two sides, so counts
of the segments add up. Segments not seen before are encoded in batches of equal bytes.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visloom.llm.common import ship

SEGMENTS_KEPT = 250_000
BATCH_BYTES = 1 << 17  # text given to the tokenizer at once
LIMIT = 1024
DOUBLED = re.compile(r"\s ")
SAFE = re.compile(r"(?<=\S) ")


class SegmentLengths(dict):
    """Token counts of segments, each with the space before it.

    At most ``limit`` segments are remembered; later new ones live for one batch of rows.
    """

    def __init__(self, path: str, limit: int = SEGMENTS_KEPT):
        super().__init__()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.limit = limit
        self.now: dict[str, int] = {}

    def __missing__(self, segment: str) -> int:
        return self.now[segment]

    def lengths(self, texts: list[str]) -> list[int]:
        return [len(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, segments: set[str]) -> None:
        new = sorted(segments.difference(self.keys()))
        self.now = {}
        start = size = 0
        for k, segment in enumerate(new):
            size += len(segment) + 1
            if size >= BATCH_BYTES or k == len(new) - 1:
                part = new[start : k + 1]
                for s, n in zip(part, self.lengths([" " + s for s in part]), strict=True):
                    (self if len(self) < self.limit else self.now)[s] = n
                start, size = k + 1, 0

    def counts(self, texts: list[str]) -> list[int]:
        """Tokens of each whole text."""
        split = [t.split(" ") if DOUBLED.search(t) is None else SAFE.split(t) for t in texts]
        first = self.lengths([s[0] for s in split])  # the only segments without a space before them
        self.learn(set().union(*(s[1:] for s in split)))
        at = self.__getitem__
        return [n + sum(map(at, s[1:])) for n, s in zip(first, split, strict=True)]


_TABLES: dict[str, SegmentLengths] = {}  # one per worker process, kept between its tasks


def token_counts(documents: DataFrame, tokenizer: str, limit: int = LIMIT) -> DataFrame:
    """Per row: doc_id, n_bytes (UTF-8), n_tokens of the whole text, over_limit (n_tokens > ``limit``).

    ``tokenizer`` is a tokenizers file with a byte-level pre-tokenizer. No begin, end or added
    special tokens; special strings inside texts count as the library's default has them.
    Null and empty texts have no tokens. Repeated rows and null doc_ids are counted like any other.
    """
    ship(documents.sparkSession)

    def count(batches):
        if tokenizer not in _TABLES:
            _TABLES[tokenizer] = SegmentLengths(tokenizer)
        table = _TABLES[tokenizer]
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            counts = []
            start = size = 0
            for k, text in enumerate(texts):  # groups of rows balanced by their size
                size += len(text)
                if size >= 8 * BATCH_BYTES or k == len(texts) - 1:
                    counts += table.counts(texts[start : k + 1])
                    start, size = k + 1, 0
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"]
            )

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = documents.select(
        F.col("doc_id").cast("bigint"), text.alias("text"), F.octet_length(text).cast("bigint").alias("n_bytes")
    )
    counted = rows.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long")
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))

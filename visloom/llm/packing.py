"""Best-fit packing of token pieces into sequences by exact complements.

Only the histogram of lengths decides which lengths meet, and it has at most CAPACITY
entries whatever the input. The plan made from it says how many sequences of each pattern
there are; pieces of a length are numbered and take the plan's places by number.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from itertools import chain, filterfalse

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from visloom.llm.common import Scratch, texts_as_bytes

CAPACITY = 2048
END = 0  # id after each document
SALTS = 16  # groups a length is numbered in
WORDS_KEPT = 500_000
PARTS_AT_ONCE = 500  # parts of words given to the tokenizer at once
GROUP_BYTES = 1 << 20  # text split at once

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, uid long, ids binary"


# What the tokenizer's pre-tokenizer cuts a lower-cased word into (fixed values of its file), and the
# words it may be applied to here: no white space, nothing that NFC or lower-casing treats by context.
PARTS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
PLAIN = regex.compile("[!-~\u00a1-\u024f]+")
WORD_END = "</w>"


class WordIds(dict):
    """Ids (little-endian unsigned 32-bit) of the words of a tokenizer that drops white space.

    Its ids of a text are the ids of the words one after the other, and those of a plain word the ids
    of its parts. Parts not seen before are encoded many at a time, each ending with a word-end
    id; any other word is encoded by itself. The tables stop growing at ``limit`` entries;
    later ones live for one batch.
    """

    def __init__(self, path: str, limit: int = WORDS_KEPT):
        super().__init__()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.limit = limit
        self.parts: dict[str, bytes] = {}
        self.now: dict[bytes, bytes] = {}
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith(WORD_END)]] = True

    def __missing__(self, word: bytes) -> bytes:
        return self.now[word]

    def encoded(self, texts: list[str]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, "<u4") for e in found]

    def part_ids(self, parts: list[str]) -> list[bytes]:
        """Ids of each part, from one text that holds them all; one by one if it does not come apart evenly."""
        ids = self.encoded([" ".join(parts)])[0]
        stops = np.flatnonzero(self.ends[ids]) + 1
        if len(stops) != len(parts) or (len(ids) and stops[-1] != len(ids)):
            return [x.tobytes() for x in self.encoded(parts)]
        whole, ends = ids.tobytes(), (4 * stops).tolist()
        return [whole[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def learn(self, words: set[bytes]) -> None:
        # Only what is asked is looked up: a difference with the keys of a table walks through the whole table.
        single, cut, other = {}, {}, {}
        for w in filterfalse(self.__contains__, words):
            t = w.decode()
            if t.isascii() and t.isalpha():  # ASCII letters alone are one part
                single[w] = t.lower()
            elif not PLAIN.fullmatch(t) or "<|" in t:
                other[w] = t
            elif len(parts := PARTS.findall(t.lower())) == 1:
                single[w] = parts[0]
            else:
                cut[w] = parts
        asked = set(single.values()).union(chain.from_iterable(cut.values()))
        missing = list(filterfalse(self.parts.__contains__, asked))
        seen: dict[str, bytes] = {}
        for k in range(0, len(missing), PARTS_AT_ONCE):
            group = missing[k : k + PARTS_AT_ONCE]
            seen.update(zip(group, self.part_ids(group), strict=True))
        if len(self.parts) < self.limit:
            self.parts.update(seen)
            known = self.parts.__getitem__
        else:
            seen.update((p, self.parts[p]) for p in asked.difference(seen))
            known = seen.__getitem__
        learned = dict(zip(single, map(known, single.values()), strict=True))
        learned.update((w, b"".join(map(known, parts))) for w, parts in cut.items())
        learned.update((w, x.tobytes()) for w, x in zip(other, self.encoded(list(other.values())), strict=True))
        if len(self) < self.limit:
            self.update(learned)
            self.now = {}
        else:
            self.now = learned


_TABLES: dict[str, WordIds] = {}  # one per worker process, kept between its tasks


def word_ids(path: str) -> WordIds:
    if path not in _TABLES:
        _TABLES[path] = WordIds(path)
    return _TABLES[path]


def by_size(rows: Iterable[tuple]) -> Iterator[list[tuple]]:
    """Rows of (key, text) in groups of about GROUP_BYTES of text, so that few words are held at once."""
    group, size = [], 0
    for row in rows:
        group.append(row)
        size += len(row[1])
        if size >= GROUP_BYTES:
            yield group
            group, size = [], 0
    if group:
        yield group


def token_pieces(documents: DataFrame, tokenizer: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Each text's ids and END, cut into pieces of ``capacity``; the last piece may be shorter.

    Null text is empty: its one piece is END alone. ``uid`` is unset here.
    """

    def encode(batches):
        table = word_ids(tokenizer)
        end = np.array([END], "<u4").tobytes()
        for batch in batches:
            rows = []
            for group in by_size(zip(batch.column(0).to_pylist(), texts_as_bytes(batch.column(1)), strict=True)):
                split = [text.split() for _, text in group]
                table.learn(set().union(*split))
                for (doc_id, _), words in zip(group, split, strict=True):
                    whole = b"".join([*map(table.__getitem__, words), end])
                    for piece, at in enumerate(range(0, len(whole), 4 * capacity)):
                        part = whole[at : at + 4 * capacity]
                        ids = part if with_ids else None
                        rows.append((doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part), None, ids))
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            names = [field.split()[0] for field in PIECES.split(", ")]
            columns = list(zip(*rows, strict=True)) or [[]] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    rows = documents.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return rows.mapInArrow(encode, PIECES)


class Plan:
    """Places for the pieces of every length, from the number of pieces per length.

    Long lengths come first. The gap beside a length is filled exactly by one length, a pair
    or a triple, looked up among the sums of lengths that are still there; a combination is used as
    often as its counts allow. What no combination fills is then placed best fit.
    ``rows``: (length, from_rank, to_rank, first_sequence, offset).
    """

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity = capacity
        self.left = np.zeros(capacity + 1, np.int64)
        for length, n in counts.items():
            self.left[length] = n
        self.rank = np.zeros(capacity + 1, np.int64)
        self.sequences = 0
        self.rows: list[tuple[int, int, int, int, int]] = []
        for length in range(capacity, 0, -1):
            while self.left[length] and (fill := self.exact([length])) is not None:
                self.use([length, *fill])
        for length in range(capacity, 0, -1):
            while self.left[length]:
                self.use(self.best_fit(length))

    def free(self, taken: list[int]) -> np.ndarray:
        """Counts without the lengths a pattern already holds."""
        free = self.left.copy()
        for length in taken:
            free[length] -= 1
        return free

    def pair(self, free: np.ndarray, total: int, most: int) -> list[int] | None:
        """Two free lengths of at most ``most`` with this sum, the larger as large as can be."""
        high = np.arange(min(most, total - 1), (total - 1) // 2, -1)
        low = total - high
        good = (free[high] > 0) & (free[low] > 0) & ((high != low) | (free[high] > 1))
        k = int(good.argmax()) if len(good) else 0
        return [int(high[k]), int(low[k])] if len(good) and good[k] else None

    def exact(self, taken: list[int]) -> list[int] | None:
        """Up to three free lengths that fill what the pattern leaves, or None."""
        gap = self.capacity - sum(taken)
        if gap == 0:
            return []
        free = self.free(taken)
        if free[gap] > 0:
            return [gap]
        if (found := self.pair(free, gap, gap - 1)) is not None:
            return found
        for first in range(gap - 2, (gap + 2) // 3 - 1, -1):
            if free[first] > 0:
                free[first] -= 1
                found = self.pair(free, gap - first, min(first, gap - first - 1))
                free[first] += 1
                if found is not None:
                    return [first, *found]
        return None

    def best_fit(self, length: int) -> list[int]:
        """The length and, again and again, the largest one that still fits; exactly where possible."""
        taken = [length]
        while sum(taken) < self.capacity:
            if len(taken) > 1 and (fill := self.exact(taken)) is not None:
                return taken + fill
            fitting = np.flatnonzero(self.free(taken)[: self.capacity - sum(taken) + 1] > 0)
            if not len(fitting):
                break
            taken.append(int(fitting[-1]))
        return taken

    def use(self, pattern: list[int]) -> None:
        times = int(min(self.left[x] // pattern.count(x) for x in pattern))
        offset = 0
        for length in pattern:
            rank = int(self.rank[length])
            self.rows.append((length, rank, rank + times, self.sequences, offset))
            self.rank[length] += times
            self.left[length] -= times
            offset += length
        self.sequences += times


def packed(documents: DataFrame, tokenizer: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids, if asked for).

    Sequences hold at most ``capacity`` tokens; their pieces follow each other without gaps
    from offset 0. Only documents of more than ``capacity`` tokens are cut. Empty and null texts are
    one token. Repeated rows are packed as often as they occur, null doc_ids too. An empty
    table gives no rows.

    The driver sees the histogram of lengths (``capacity`` rows at most) and broadcasts the plan,
    which has a few rows per length. Pieces are numbered inside SALTS groups of a length.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark, "packing")
    pieces = token_pieces(documents, tokenizer, capacity, with_ids).withColumn("uid", F.monotonically_increasing_id())
    pieces = scratch.put(pieces if with_ids else pieces.drop("ids"), "pieces")
    narrow = pieces.select("uid", "doc_id", "piece", "start", "length", "ids_crc32")
    narrow = narrow.withColumn("salt", F.pmod(F.xxhash64("uid"), F.lit(SALTS)).cast("int"))
    sizes = scratch.put(narrow.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n")), "sizes")
    counts = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = Plan(counts, capacity)
    places = spark.createDataFrame(
        plan.rows, "length long, from_rank long, to_rank long, first_sequence long, offset long"
    )
    earlier = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("length", "salt", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    inside = Window.partitionBy("length", "salt").orderBy("uid")
    ranked = narrow.withColumn("place", F.row_number().over(inside) - 1).join(F.broadcast(starts), ["length", "salt"])
    ranked = ranked.withColumn("rank", F.col("before") + F.col("place"))
    at = (
        (ranked["length"] == places["length"])
        & (F.col("rank") >= F.col("from_rank"))
        & (F.col("rank") < F.col("to_rank"))
    )
    out = ranked.join(F.broadcast(places), at).select(
        "uid",
        "doc_id",
        "piece",
        "start",
        ranked["length"],
        "ids_crc32",
        (F.col("first_sequence") + F.col("rank") - F.col("from_rank")).alias("sequence_id"),
        "offset",
    )
    if with_ids:
        out = out.join(pieces.select("uid", "ids"), "uid")
    return out.drop("uid")

"""Language-model scores from a weighted backoff automaton over n-grams of words.

States are the empty context, frequent words and frequent word pairs; arcs carry smoothed
log-probabilities and lead to the longest state the text allows; every other state has a failure
arc with its backoff weight to the next shorter one. A text is scored in one left-to-right traversal.

An n-gram is frequent from LEAST occurrences in the training texts on, whatever the corpus. A block gets
the states and arcs of its own texts by asking for them, and nothing is broadcast or collected.

The corpus is kept as blocks: the texts of up to BLOCK tokens coded by a vocabulary of their own.
A block asks for each of its words, pairs and triples once. Its keys are sorted and dealt by their leading bits into
slices of about SLICE tokens of the corpus; one row holds all a block asks of a slice. A slice adds up what the blocks
brought and answers each of them in the order of its keys, so answers need no keys.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visloom.llm.common import Scratch, WordHashes, mix, texts_as_bytes

LEAST = 2  # occurrences from which on an n-gram has states and arcs, whatever the corpus
DISCOUNT = 0.75
BLOCK = 1 << 20  # tokens
SLICE = 1 << 21  # tokens of the corpus for each slice of the keys
WORDS, PAIRS, TRIPLES, WORD_MASSES, PAIR_MASSES = range(1, 6)  # what is asked for
FOLDS, HELD_OUT = 7, 2
END = b""  # no word is empty
ASKED = "kind int, slice long, block long, size int, keys binary, parts binary"
CODEC = pa.Codec("zstd", compression_level=1)
TOLD = "kind int, slice long, block long, size int, totals binary, once binary, n_new long, n_all double"
BLOCKS = "block long, doc_ids array<long>, held_out array<boolean>, sizes array<int>, codes binary, words array<long>, counts array<int>"


def is_held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS == HELD_OUT


def _packed(values: np.ndarray) -> bytes:
    """The first bytes of all values, then the second ones, and so on, compressed: high bytes are mostly zero."""
    return CODEC.compress(values.view(np.uint8).reshape(-1, values.itemsize).T.tobytes(), asbytes=True)


def _loose(packed: pa.Buffer, size: int, dtype: str) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    planes = np.frombuffer(CODEC.decompress(packed, size * width), np.uint8).reshape(width, size)
    return np.ascontiguousarray(planes.T).view(dtype).ravel()


def _block(doc_ids: list, parts: list[np.ndarray]) -> pa.RecordBatch:
    """One row: documents as codes into the block's own vocabulary, frequent words first, with its training counts."""
    words, codes, n = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
    order = np.argsort(-n, kind="stable")
    rank = np.empty(len(words), np.int64)
    rank[order] = np.arange(len(words))
    words, codes = words[order], rank[codes]
    sizes = np.array([len(p) for p in parts], np.int32)
    held = np.array([is_held_out(d) for d in doc_ids])
    counts = np.bincount(codes[np.repeat(~held, sizes)], minlength=len(words)).astype(np.int32)
    columns = [
        pa.array([None], pa.int64()),
        pa.array([doc_ids], pa.list_(pa.int64())),
        pa.array([held.tolist()], pa.list_(pa.bool_())),
        pa.array([sizes], pa.list_(pa.int32())),
        pa.array([_packed(codes.astype("<u4"))], pa.binary()),
        pa.array([words.view(np.int64)], pa.list_(pa.int64())),
        pa.array([counts], pa.list_(pa.int32())),
    ]
    return pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in BLOCKS.split(", ")])


def coded_blocks(documents: DataFrame, block_tokens: int = BLOCK) -> DataFrame:
    """The texts, lower-cased A-Z, as blocks of coded tokens; each text ends with END."""

    def code(batches):
        hashes = WordHashes()
        doc_ids, parts, total = [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), texts_as_bytes(batch.column(1)), strict=True):
                parts.append(hashes.of([*text.lower().split(), END]))
                doc_ids.append(doc_id)
                total += len(parts[-1])
                if total >= block_tokens:
                    yield _block(doc_ids, parts)
                    doc_ids, parts, total = [], [], 0
        if parts:
            yield _block(doc_ids, parts)

    rows = documents.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return rows.mapInArrow(code, BLOCKS).withColumn("block", F.monotonically_increasing_id())


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    """One block at a time: lists as Arrow arrays, so that no Python object is made per word."""
    for k in range(batch.num_rows):
        cells = {name: batch.column(name)[k] for name in batch.schema.names}
        yield {n: c.values if isinstance(c, pa.ListScalar) else c.as_buffer() if n == "codes" else c.as_py() for n, c in cells.items()}


def _unpacked(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes, sizes and the held-out mark of each token of a block row."""
    sizes = row["sizes"].to_numpy().astype(np.int64)
    held = np.repeat(row["held_out"].to_numpy(zero_copy_only=False), sizes)
    return _loose(row["codes"], int(sizes.sum()), "<u4"), sizes, held


def _longer(context: np.ndarray, word: np.ndarray, order: int) -> np.ndarray:
    """64-bit keys of n-grams from the keys of their contexts (words: their hashes) and last words."""
    return mix(mix(context + np.uint64(order)) * np.uint64(0x9E3779B97F4A7C15) + word)


class _Answers:
    """What a block has been told of its words or n-grams, looked up by key; 0 for keys not told."""

    def __init__(self, told: pa.Table, order: int):
        rows = told.filter(pa.compute.equal(told.column("gram_order"), order))
        keys = rows.column("key").to_numpy().view(np.uint64)
        sorting = np.argsort(keys)
        self.keys = keys[sorting]
        self.n = rows.column("n").to_numpy()[sorting]
        self.mass = rows.column("mass").to_numpy()[sorting] if "mass" in rows.column_names else np.zeros(len(keys))

    def of(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts, and masses that followers seen take of the context."""
        if not len(self.keys):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys))
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        hit = self.keys[at] == keys
        return np.where(hit, self.n[at], 0), np.where(hit, self.mass[at], 0.0)


class _Block:
    """A block's tokens, and the keys of the pair and triple each of them ends (where ``deep`` allows)."""

    def __init__(self, row: dict):
        self.codes, self.sizes, self.held = _unpacked(row)
        words = row["words"].to_numpy().view(np.uint64)
        order = np.argsort(words)
        rank = np.empty(len(words), np.uint32)
        rank[order] = np.arange(len(words))
        self.words, self.codes = words[order], rank[self.codes]
        starts = np.cumsum(self.sizes) - self.sizes
        self.starts = starts
        place = np.arange(len(self.codes)) - np.repeat(starts, self.sizes)
        self.deep = [place >= k for k in range(3)]
        tokens = self.words[self.codes]
        self.pairs = np.zeros(len(tokens), np.uint64)
        self.pairs[1:] = _longer(tokens[:-1], tokens[1:], 2)
        self.triples = np.zeros(len(tokens), np.uint64)
        self.triples[1:] = _longer(self.pairs[:-1], tokens[1:], 3)

    def asked(self, keys: np.ndarray, contexts: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct n-grams among the ``wanted`` tokens in ascending order, their contexts and training counts."""
        keys, contexts, train = keys[wanted], contexts[wanted], ~self.held[wanted]
        found, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
        return found, contexts[first], np.bincount(inverse[train], minlength=len(found))


class _Grams:
    """A block's n-grams, as far as it has been told of the shorter ones."""

    def __init__(self, b: _Block, told: pa.Table, least: float):
        self.b, self.least = b, least
        self.told = {}
        for kind in set(told.column("kind").to_pylist()):
            rows = told.filter(pa.compute.equal(told.column("kind"), kind)).sort_by("slice")
            totals, once = _cells_of(rows, "totals", "<f8"), _cells_of(rows, "once", "u1")
            self.told[kind] = np.concatenate(totals), np.concatenate(once) > 0

    def _told(self, kind: int, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Totals of the n-grams asked for, and whether this block is the one to answer for them."""
        return self.told[kind] if size else (np.zeros(0), np.zeros(0, bool))

    def words(self) -> None:
        self.word_n, _ = self._told(WORDS, len(self.b.words))
        self.common = self.word_n >= self.least

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Keys and training counts of pairs of frequent words."""
        good = self.common[self.b.codes]
        contexts = np.roll(self.b.words[self.b.codes], 1)
        self.pair_keys, self.pair_contexts, n = self.b.asked(self.b.pairs, contexts, good & np.roll(good, 1) & self.b.deep[1])
        return self.pair_keys, n

    def told_of_pairs(self) -> None:
        """Only the frequent pairs stay."""
        n, once = self._told(PAIRS, len(self.pair_keys))
        frequent = n >= self.least
        self.pair_keys, self.pair_contexts = self.pair_keys[frequent], self.pair_contexts[frequent]
        self.pair_n, self.pair_once = n[frequent], once[frequent]

    def triples(self) -> tuple[np.ndarray, np.ndarray]:
        """Keys and training counts of triples of two frequent pairs."""
        at = np.minimum(np.searchsorted(self.pair_keys, self.b.pairs), max(len(self.pair_keys) - 1, 0))
        good = (self.pair_keys[at] == self.b.pairs) & self.b.deep[1] if len(self.pair_keys) else np.zeros(len(at), bool)
        del at
        found = self.b.asked(self.b.triples, np.roll(self.b.pairs, 1), good & np.roll(good, 1) & self.b.deep[2])
        self.triple_keys, self.triple_contexts, n = found
        return self.triple_keys, n

    def told_of_triples(self) -> None:
        """Only the frequent triples stay."""
        n, once = self._told(TRIPLES, len(self.triple_keys))
        frequent = n >= self.least
        self.triple_keys, self.triple_contexts = self.triple_keys[frequent], self.triple_contexts[frequent]
        self.triple_n, self.triple_once = n[frequent], once[frequent]

    def _taken(self, keys: np.ndarray, contexts: np.ndarray, n: np.ndarray, once: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys, and what frequent followers this block answers for take of each after the discount."""
        return keys, np.bincount(np.searchsorted(keys, contexts[once]), n[once] - DISCOUNT, len(keys))

    def word_masses(self) -> tuple[np.ndarray, np.ndarray]:
        return self._taken(self.b.words[self.common], self.pair_contexts, self.pair_n, self.pair_once)

    def pair_masses(self) -> tuple[np.ndarray, np.ndarray]:
        return self._taken(self.pair_keys, self.triple_contexts, self.triple_n, self.triple_once)

    def answers(self) -> pa.Table:
        """All the block has been told: order, key, n, and the mass that followers seen take."""
        mass = np.zeros(len(self.b.words))
        mass[self.common], _ = self._told(WORD_MASSES, int(self.common.sum()))
        masses = mass, self._told(PAIR_MASSES, len(self.pair_keys))[0], np.zeros(len(self.triple_keys))
        keys = self.b.words, self.pair_keys, self.triple_keys
        return pa.table(
            {
                "gram_order": np.repeat(np.arange(1, 4, dtype=np.int32), [len(k) for k in keys]),
                "key": np.concatenate(keys).view(np.int64),
                "n": np.concatenate([self.word_n, self.pair_n, self.triple_n]).astype(np.int64),
                "mass": np.concatenate(masses),
            }
        )


class _Automaton:
    """States, arcs and failure arcs of all n-grams of a block.

    State 0 is the empty context. Each frequent word and each frequent pair has a state. A state has an
    arc for every word it was frequently followed by, with the log-probability of that word there, leading to
    the longest state the text then allows. For any other word its failure arc leads to the next shorter context
    at the price of the log-weight; the empty context has an arc for every word.
    """

    def __init__(self, b: _Block, answers: pa.Table, n_tokens: int, kinds: int, least: int):
        self.n_words = len(b.words)
        count, mass = _Answers(answers, 1).of(b.words)
        self.known = count > 0
        single = (count + 1) / (n_tokens + kinds + 1)
        self.single = np.log10(single)
        frequent = np.flatnonzero(count >= least)
        self.word_state = np.zeros(self.n_words, np.int64)
        self.word_state[frequent] = 1 + np.arange(len(frequent))

        pair_n, pair_mass = _Answers(answers, 2).of(b.pairs)
        is_pair = b.deep[1] & (pair_n > 0)
        before = np.roll(b.codes, 1).astype(np.int64)
        place = np.flatnonzero(is_pair)
        _, first, number = np.unique(before[place] * self.n_words + b.codes[place], return_index=True, return_inverse=True)
        first = place[first]
        v, w, n, taken = before[first], b.codes[first], pair_n[first], pair_mass[first]
        pair_p = np.maximum(n - DISCOUNT, 0) / count[v] + (1 - mass[v] / count[v]) * single[w]
        states = 1 + len(frequent) + np.arange(len(first))

        pair_of = np.full(len(b.codes), -1)
        pair_of[place] = number
        del pair_n, pair_mass, is_pair, before, place, number  # a block's arrays are large
        triple_n, _ = _Answers(answers, 3).of(b.triples)
        context = np.roll(pair_of, 1)
        place = np.flatnonzero(b.deep[2] & (context >= 0) & (triple_n > 0))
        _, once = np.unique(context[place] * self.n_words + b.codes[place], return_index=True)
        once = place[once]
        uv, vw = context[once], pair_of[once]
        rest = 1 - taken / n
        triple_p = np.maximum(triple_n[once] - DISCOUNT, 0) / n[uv] + rest[uv] * pair_p[vw]

        # Failure arcs: a pair falls back to its second word, a word to the empty context.
        self.shorter = np.concatenate([[0], np.zeros(len(frequent), np.int64), self.word_state[w]])
        self.weight = np.log10(np.concatenate([[1.0], 1 - mass[frequent] / count[frequent], rest]))
        arcs = np.concatenate([self.word_state[v] * self.n_words + w, states[uv] * self.n_words + b.codes[once]])
        sorting = np.argsort(arcs)
        self.arcs = arcs[sorting]
        self.price = np.log10(np.concatenate([pair_p, triple_p]))[sorting]
        self.target = np.concatenate([states, states[vw]])[sorting]

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next state and the log-probability of one word from each state."""
        price, next_state = np.zeros(len(state)), np.zeros(len(state), np.int64)
        open_ = np.arange(len(state))
        while len(open_):
            at, words = state[open_], word[open_]
            key = at * self.n_words + words
            spot = np.minimum(np.searchsorted(self.arcs, key), len(self.arcs) - 1) if len(self.arcs) else None
            hit = (self.arcs[spot] == key) & (at > 0) if spot is not None else np.zeros(len(at), bool)
            if spot is not None:
                price[open_[hit]] += self.price[spot[hit]]
                next_state[open_[hit]] = self.target[spot[hit]]
            empty = at == 0
            price[open_[empty]] += self.single[words[empty]]
            next_state[open_[empty]] = self.word_state[words[empty]]
            fails = ~hit & ~empty
            open_, at = open_[fails], at[fails]
            price[open_] += self.weight[at]
            state = state.copy()
            state[open_] = self.shorter[at]
        return next_state, price

    def traverse(self, b: _Block) -> np.ndarray:
        """The log-probability of each text, read from left to right with its state carried along.

        All texts of the block advance together, one word at a time; those that have ended stand still.
        """
        order = np.argsort(-b.sizes, kind="stable")
        starts, longest = b.starts[order], int(b.sizes.max(initial=0))
        going = np.searchsorted(-b.sizes[order], -np.arange(longest), side="left")
        state, total = np.zeros(len(order), np.int64), np.zeros(len(order))
        codes = b.codes.astype(np.int64)
        for t in range(longest):
            m = going[t]
            state[:m], price = self.step(state[:m], codes[starts[:m] + t])
            total[:m] += price
        out = np.empty(len(order))
        out[order] = total
        return out


def _cells_of(rows: pa.Table, name: str, dtype: str) -> list[np.ndarray]:
    return [_loose(x.as_buffer(), n, dtype) for x, n in zip(rows.column(name), rows.column("size").to_pylist(), strict=True)]


def _cells(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A packed cell from each of ``ends`` to the next."""
    return pa.array([_packed(values[i:k]) for i, k in zip(ends[:-1], ends[1:], strict=True)], pa.binary())


def _dealt(kind: int, block: int, bits: int, keys: np.ndarray, parts: np.ndarray) -> pa.Table:
    """One ASKED row per slice the ascending keys fall into."""
    slices = (keys >> np.uint64(64 - bits)).astype(np.int64)
    begins = np.flatnonzero(np.diff(slices, prepend=-1))
    ends = np.append(begins, len(keys))
    rows = len(begins)
    columns = [pa.array(np.full(rows, kind, np.int32)), pa.array(slices[begins]), pa.array(np.full(rows, block, np.int64))]
    steps = np.diff(keys, prepend=np.uint64(0))
    steps[begins] = keys[begins]
    columns += [pa.array(np.diff(ends).astype(np.int32)), _cells(steps, ends), _cells(parts.astype("<f8"), ends)]
    return pa.table(columns, _names(ASKED))


def _names(schema: str) -> list[str]:
    return [f.split()[0] for f in schema.split(", ")]


def _empty(schema: str) -> pa.Table:
    types = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary()}
    return pa.table([pa.array([], types[f.split()[1]]) for f in schema.split(", ")], _names(schema))


def _asked(blocks: DataFrame, told: DataFrame, least: float, bits: int, kinds: tuple[int, ...]) -> DataFrame:
    """ASKED rows of these kinds, of all blocks."""

    def ask(block: pa.Table, answers: pa.Table) -> pa.Table:
        parts = []
        for batch in block.to_batches():
            for row in _rows(batch):
                g = _Grams(_Block(row), answers, least)
                for kind, asked in _steps(g, kinds):
                    parts.append(_dealt(kind, row["block"], bits, *asked))
        return pa.concat_tables(parts) if parts else _empty(ASKED)

    return blocks.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(ask, ASKED)


def _steps(g: _Grams, kinds: tuple[int, ...]) -> Iterator[tuple[int, tuple[np.ndarray, np.ndarray]]]:
    """What a block asks for, of these kinds, once it knows all there is before them."""
    g.words()
    pairs = g.pairs()
    if PAIRS in kinds:
        yield PAIRS, pairs
        return
    g.told_of_pairs()
    triples = g.triples()
    if TRIPLES in kinds:
        yield TRIPLES, triples
        yield WORD_MASSES, g.word_masses()
        return
    g.told_of_triples()
    if PAIR_MASSES in kinds:
        yield PAIR_MASSES, g.pair_masses()


def _asked_words(blocks: DataFrame, bits: int) -> DataFrame:
    def ask(batches):
        for batch in batches:
            for row in _rows(batch):
                keys, n = row["words"].to_numpy().view(np.uint64), row["counts"].to_numpy()
                order = np.argsort(keys)
                yield from _dealt(WORDS, row["block"], bits, keys[order], n[order]).to_batches()

    return blocks.select("block", "words", "counts").mapInArrow(ask, ASKED)


def _totals(asked: DataFrame) -> DataFrame:
    """TOLD: per ASKED row the totals of its keys over all blocks, in their order; ``once`` marks a key in one block only.

    n_new and n_all count and add up the keys marked that occur in training texts. Keys are hashes and a block brings each of
    them once, so slices are even and no n-gram makes a large one.
    """

    def add(group: pa.Table) -> pa.Table:
        keys = np.concatenate([np.cumsum(x, dtype=np.uint64) for x in _cells_of(group, "keys", "<u8")])
        parts = np.concatenate(_cells_of(group, "parts", "<f8"))
        ends = np.append(0, np.cumsum(group.column("size").to_numpy()))
        order = np.argsort(keys, kind="stable")
        new = np.diff(keys[order], prepend=~keys[order[:1]]) != 0
        sums = np.add.reduceat(parts[order], np.flatnonzero(new))
        totals, once = np.empty(len(keys)), np.empty(len(keys), np.uint8)
        totals[order] = sums[np.cumsum(new) - 1]
        once[order] = new
        counted = np.where(once, totals, 0.0)
        n_all = np.add.reduceat(counted, ends[:-1])
        n_new = np.add.reduceat((counted > 0).astype(np.int64), ends[:-1])
        columns = [group.column(c).combine_chunks() for c in ("kind", "slice", "block", "size")]
        return pa.table([*columns, _cells(totals, ends), _cells(once, ends), pa.array(n_new), pa.array(n_all)], _names(TOLD))

    return asked.groupBy("kind", "slice").applyInArrow(add, TOLD)


def lm_scores(documents: DataFrame, least: int = LEAST, block_tokens: int = BLOCK) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Training texts are those whose crc32(doc_id as text) mod 7 is not 2 (null doc_id: the empty
    text). Tokens are lower-cased words and one end per text. base_score sums
    log10((c + 1) / (N + V + 1)); score is the automaton's log10 probability. Probabilities of a
    context sum to one: discounted counts give the rest of their mass to the shorter context.

    Null and empty texts are one end token. Repeated rows count as often as they occur. Without
    training texts all counts are 0. An empty table gives no rows.
    """
    scratch = Scratch(documents.sparkSession, "lm")
    blocks = scratch.put(coded_blocks(documents, block_tokens), "blocks")
    size = blocks.select(F.explode("sizes").alias("n")).agg(F.sum("n")).first()[0] or 0
    bits = max(4, (size // SLICE).bit_length())
    told = scratch.put(_totals(_asked_words(blocks, bits)), "words")
    kinds, n_tokens = told.agg(F.sum("n_new"), F.sum("n_all").cast("bigint")).first()
    kinds, n_tokens = kinds or 0, n_tokens or 0
    texts = blocks.drop("counts", "doc_ids")
    for step in ((PAIRS,), (TRIPLES, WORD_MASSES), (PAIR_MASSES,)):
        asked = _asked(texts, told.select("kind", "slice", "block", "size", "totals", "once"), least, bits, step)
        told = told.unionByName(scratch.put(_totals(asked), f"told{step[0]}"))
    told = told.select("kind", "slice", "block", "size", "totals", "once")

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"

    def score(block: pa.Table, answers: pa.Table) -> pa.Table:
        parts = []
        for batch in block.to_batches():
            for row in _rows(batch):
                b = _Block(row)
                g = _Grams(b, answers, least)
                for _ in _steps(g, ()):
                    pass
                automaton = _Automaton(b, g.answers(), n_tokens, kinds, least)
                del g
                single, known = automaton.single[b.codes], automaton.known[b.codes]
                sums = lambda x: np.add.reduceat(x, b.starts)
                columns = [row["doc_ids"], row["held_out"], b.sizes, sums(known.astype(np.int64)), [n_tokens] * len(b.sizes)]
                columns += [sums(single), automaton.traverse(b)]
                parts.append(
                    pa.table(
                        [x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip(columns, types, strict=True)], names
                    )
                )
        return pa.concat_tables(parts) if parts else _empty(schema)

    names = _names(schema)
    types = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
    return blocks.drop("counts").groupBy("block").cogroup(told.groupBy("block")).applyInArrow(score, schema)

"""Which texts mention which terms, for term tables of any length.

Texts and terms are cut into the same tokens once: whole words, and every other character for itself. A term is
mentioned where its tokens stand in the text, so a text's runs of as many tokens as some term has are joined
with the terms. No term stands in the plan, and Spark broadcasts the terms only where their size allows it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKENS_AT_ONCE = 1 << 17  # tokens of texts whose runs are held at once, or those of one text
WORD = r"[\p{L}\p{N}_]"
TOKEN = rf"{WORD}+|[^\p{{L}}\p{{N}}_]"


def tokens(text: Column) -> Column:
    """Lower-case tokens whose concatenation is the lower-case text."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def _is_word(token: Column) -> Column:
    return token.rlike(f"^{WORD}")


def shape(found: Column) -> Column:
    """(n, head, tail) of a term's tokens: how many, and whether the first and the last are words."""
    return F.struct(
        F.size(found).alias("n"), _is_word(F.get(found, F.lit(0))).alias("head"), _is_word(F.element_at(found, -1)).alias("tail")
    )


def runs(text: Column, shapes: Column) -> Column:
    """The different runs of tokens in a text that have one of the ``shapes`` and stand between word boundaries.

    A word is a token, so only a run that begins or ends with another character has to look at its neighbour.
    Spark cuts the tokens and says which characters are no part of words; the runs are cut out of the tokens' bytes.
    """
    at_once = TOKENS_AT_ONCE

    def of_texts(found: pa.Array, other: pa.Array, wanted: list[dict]) -> pa.Array:
        token, sizes = found.flatten().cast(pa.large_string()), pc.list_value_length(found).fill_null(0).to_numpy()
        ends, count = np.cumsum(sizes, dtype=np.int64), len(token)
        coded, others = token.dictionary_encode(), set("".join(other.drop_null().to_pylist()))
        word = np.array([t not in others for t in coded.dictionary.to_pylist()], bool)[coded.indices.to_numpy()]
        text_of, left = np.repeat(np.arange(len(sizes)), sizes), np.repeat(ends, sizes) - np.arange(count)
        is_first = np.repeat(ends - sizes, sizes) == np.arange(count)
        heads = {True: word, False: ~word & ~(np.append(False, word[:-1])[:count] & ~is_first)}
        tails = {True: word, False: ~word & ~(np.append(word[1:], False)[:count] & (left > 1))}
        keys, known, base = [], [], 0
        if count:
            bounds = np.frombuffer(token.buffers()[1], np.int64)[token.offset : token.offset + count + 1]
            data = np.frombuffer(token.buffers()[2], np.uint8)
        for n in sorted({s["n"] for s in wanted}) if count else []:
            at = np.flatnonzero(left >= n)
            whole = np.zeros(len(at), bool)
            for s in wanted:
                if s["n"] == n:
                    whole |= heads[s["head"]][at] & tails[s["tail"]][at + n - 1]
            at = at[whole]
            lengths = bounds[at + n] - bounds[at]
            starts = np.append(0, np.cumsum(lengths))
            cut = data[np.repeat(bounds[at] - starts[:-1], lengths) + np.arange(starts[-1])]
            run = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(starts), pa.py_buffer(cut)).dictionary_encode()
            keys.append((text_of[at], base + run.indices.to_numpy()))
            known.append(run.dictionary)
            base += len(run.dictionary)  # runs of other lengths are other runs
        if not base:
            return pa.array([[]] * len(sizes), pa.list_(pa.string()))
        pairs = np.unique(np.concatenate([t * base + r for t, r in keys]))
        offsets = np.searchsorted(pairs, np.arange(len(sizes) + 1) * base).astype(np.int32)
        return pa.ListArray.from_arrays(offsets, pa.concat_arrays(known).take(pa.array(pairs % base)).cast(pa.string()))

    @F.arrow_udf("array<string>")
    def cut_out(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for found, other, shapes in batches:
            upto = np.cumsum(pc.list_value_length(found).fill_null(0).to_numpy(), dtype=np.int64)
            start = 0
            while start < len(found):
                before = upto[start - 1] if start else 0
                stop = max(start + 1, int(np.searchsorted(upto, before + at_once, "right")))
                yield of_texts(found[start:stop], other[start:stop], shapes[start].as_py() or [])
                start = stop

    return cut_out(tokens(text), F.regexp_replace(F.lower(text), f"{WORD}+", ""), shapes)


def term_slices(df: DataFrame, text: str, terms: DataFrame | Sequence[str]) -> DataFrame:
    """One row per (row, term its ``text`` mentions between word boundaries), any letter case.

    ``terms`` is a list or a table with a column ``term``; repeats count once, and terms of any number of words
    and with any characters may be mixed. Null and empty terms are nowhere, null texts mention nothing. A
    column ``term`` of ``df`` gives way. Rows repeat all columns of ``df``: select the narrow ones afterwards,
    and Spark does not carry the text along.
    """
    if not isinstance(terms, DataFrame):
        terms = df.sparkSession.createDataFrame([(t,) for t in terms], "term string")
    known = terms.select(F.col("term").alias("__term"), tokens(F.col("term")).alias("__tokens")).where(F.size("__tokens") > 0)
    known = known.select("__term", F.array_join("__tokens", "").alias("__low"), shape(F.col("__tokens")).alias("__shape")).distinct()
    shapes = known.agg(F.collect_set("__shape")).scalar()  # as many as there are lengths of terms
    said = df.withColumn("__shapes", shapes).withColumn("__run", F.explode(runs(F.col(text), F.col("__shapes"))))
    met = said.join(known.select("__term", "__low"), F.col("__run") == F.col("__low"))
    return met.select(*[F.col(c) for c in df.columns if c != "term"], F.col("__term").alias("term"))

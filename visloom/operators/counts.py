"""Count-based token log-probabilities: the stand-in for a neural scorer.

Surprisal needs log p(token | context) from some model. A table of log-probabilities
produced elsewhere can be used directly; where there is none, adjacent-pair counts
with additive smoothing give one from the data itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visloom.functions.bind import bind
from visloom.operators.joins import spread_join


def adjacent_pairs(tokens: Column, start: Column) -> Column:
    """array(pos, prev, token) for every position from ``start`` on."""

    def paired(all_tokens: Column) -> Column:
        return F.transform(
            all_tokens,
            lambda t, i: F.struct(i.alias("pos"), F.get(all_tokens, i - 1).alias("prev"), t.alias("token")),
        )

    return F.slice(bind(tokens, paired), F.greatest(start, F.lit(1)) + 1, F.size(tokens))


def explode_pairs(df: DataFrame, *keys: str, tokens: str = "tokens", start: Column | int = 1) -> DataFrame:
    """Token rows (keys, pos, prev, token) of rendered samples, from ``start`` on."""
    first = F.lit(start) if isinstance(start, int) else start
    return df.select(*keys, F.inline(adjacent_pairs(F.col(tokens), first)))


def pair_table(pairs: DataFrame, trained: Column, asked: Column) -> DataFrame:
    """(prev, token, n, asked): occurrences to learn from and occurrences to score.

    One pass and one shuffle serve both sides; counts combine before the shuffle, so
    frequent pairs stay cheap. Two data sets are scored against each other by
    unioning their pairs with a flag column.
    """
    return pairs.groupBy("prev", "token").agg(
        F.count_if(trained).alias("n"), F.count_if(asked).alias("asked")
    )


def pair_counts(table: DataFrame) -> DataFrame:
    return table.where(F.col("n") > 0).select("prev", "token", "n")


def pair_bits(table: DataFrame, alpha: float = 1.0) -> DataFrame:
    """Bits of each distinct asked (prev, token) under smoothed counts, with its ``asked``.

    p = (n(prev, token) + α) / (n(prev) + α·V), V being the number of distinct trained
    tokens plus one for everything unseen. ``table`` is read several times: write it
    first (see :func:`visloom.session.materialized`).
    """
    known = pair_counts(table)
    contexts = known.groupBy("prev").agg(F.sum("n").alias("prev_n"))
    vocabulary = known.select("token").distinct().agg(F.count(F.lit(1)) + 1).scalar()
    wanted = table.where(F.col("asked") > 0)
    joined = spread_join(wanted, contexts, ["prev"], "left", spread=["token"])
    p = (F.col("n") + F.lit(alpha)) / (F.coalesce("prev_n", F.lit(0)) + F.lit(alpha) * vocabulary)
    return joined.select("prev", "token", "asked", (-F.log2(p)).alias("surprisal_bits"))


def score_pairs(pairs: DataFrame, bits: DataFrame, table: DataFrame) -> DataFrame:
    """Attach ``surprisal_bits`` to token rows; the dominant pairs, known by their counts, are salted."""
    spread = [c for c in pairs.columns if c not in ("prev", "token")]
    sizes = table.select("prev", "token", F.col("asked").alias("rows"))
    return spread_join(pairs, bits.drop("asked"), ["prev", "token"], "inner", spread=spread, sizes=sizes)

"""Mixing sources to target weights by iterative proportional fitting.

Documents are counted into cells (source, language, topic) by tokens. Raking turns the
cells' shares until the totals per source, per language and per topic equal their targets.
Documents are then sampled with a probability that is calibrated per cell.
Everything is built-in DataFrame functions; only scalars reach the driver.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visloom.functions.bind import bind
from visloom.llm.common import Scratch, words_of

TOPICS = 8
DIMENSIONS = ("source", "lang", "topic")
# Target shares are the present shares raised to these powers: 1 keeps them, 0 evens them out.
POWERS = {"source": 0.5, "lang": 0.7, "topic": 0.5}
KEEP = 0.5  # share of all tokens the sample is to have
MAX_ROUNDS = 30
TOLERANCE = 1e-4  # largest error of a marginal share
STALLED = 0.95  # a round that leaves more than this part of the error says the targets contradict each other
GRID = 64  # candidates for the sampling rate tried at once
EXACT = 1e-9  # relative error of the sampling rate
SEED = 42


def topic_of(words: Column, topics: int = TOPICS) -> Column:
    """A bucket of the smallest hash among the words of 6 letters or more (of all, if there are none).

    Similar vocabularies agree on it with the probability of their similarity. No words: null.
    """
    low = F.array_min(F.transform(words, lambda w: F.when(F.length(w) >= 6, F.xxhash64(F.lower(w)))))
    return F.pmod(F.coalesce(low, F.array_min(F.transform(words, lambda w: F.xxhash64(F.lower(w))))), F.lit(topics))


def _key(column: str) -> Column:
    """A never-null text key in which null and the empty string differ."""
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit("null"))


def token_cells(documents: DataFrame) -> DataFrame:
    """One narrow row per document: doc_id, source, lang, topic, n_tokens and the three keys."""
    counted = documents.select(
        "doc_id",
        "source",
        "lang",
        bind(words_of(F.col("text")), lambda w: F.struct(topic_of(w).alias("topic"), F.size(w).alias("n"))).alias("found"),
    )
    flat = counted.select(
        "doc_id", "source", "lang", F.col("found.topic").cast("int").alias("topic"), F.col("found.n").cast("bigint").alias("n_tokens")
    )
    return flat.withColumns({f"k_{d}": _key(d) for d in DIMENSIONS})


def default_targets(cells: DataFrame, powers: Mapping[str, float] = POWERS) -> dict[str, DataFrame]:
    """Per dimension a table (k_<dimension>, target) of present token shares raised to a power."""
    out = {}
    for d in DIMENSIONS:
        totals = cells.groupBy(f"k_{d}").agg(F.sum("tokens").alias("tokens"))
        raised = totals.withColumn("raised", F.when(F.col("tokens") > 0, F.pow(F.col("tokens"), F.lit(powers[d]))).otherwise(0.0))
        whole = raised.agg(F.sum("raised").alias("whole"))
        out[d] = raised.join(F.broadcast(whole)).select(  # one row
            f"k_{d}", F.when(F.col("whole") > 0, F.col("raised") / F.col("whole")).otherwise(0.0).alias("target")
        )
    return out


def residuals(cells: DataFrame, targets: Mapping[str, DataFrame]) -> DataFrame:
    """Per marginal (dimension, key): its ``share``, its ``target`` (none: 0) and ``off``, the difference."""
    out = None
    for d in DIMENSIONS:
        has = cells.groupBy(F.col(f"k_{d}").alias("key")).agg(F.sum("share").alias("share"))
        both = has.join(targets[d].withColumnRenamed(f"k_{d}", "key"), "key", "left")
        target = F.coalesce("target", F.lit(0.0))
        one = both.select(F.lit(d).alias("dimension"), "key", "share", target.alias("target"), F.abs(F.col("share") - target).alias("off"))
        out = one if out is None else out.unionByName(one)
    return out


def _factors(cells: DataFrame, target: DataFrame, key: str) -> DataFrame:
    totals = cells.groupBy(key).agg(F.sum("share").alias("has"))
    factor = F.when(F.col("has") > 0, F.coalesce("target", F.lit(0.0)) / F.col("has")).otherwise(0.0)
    return totals.join(target, key, "left").select(key, factor.alias(f"by_{key}"))


def raked(cells: DataFrame, targets: Mapping[str, DataFrame], scratch: Scratch) -> DataFrame:
    """Cells with ``share``: proportional fitting of their tokens to the target marginals.

    A round scales the cells once per dimension, until no marginal is off by more than TOLERANCE. Targets
    that contradict the empty cells cannot be met: such rounds go round in circles, each dimension undoing the
    others. Once a round leaves more than STALLED of the error, all dimensions scale at once, by the
    cube roots of their factors, which leads to the marginals closest to all targets together (in summed
    relative entropy); that ends when the error hardly changes any more, or after MAX_ROUNDS in all.
    ``residuals`` tells what is left. A value without a target keeps no share.
    """
    keys = [f"k_{d}" for d in DIMENSIONS]
    shares = lambda df, share: df.select(*keys, "tokens", share.alias("share"))
    whole = cells.agg(F.sum("tokens").alias("whole"))
    present = F.when(F.col("whole") > 0, F.col("tokens") / F.col("whole")).otherwise(0.0)
    current = scratch.put(shares(cells.join(F.broadcast(whole)), present), "shares0")  # one row
    was, together = float("inf"), False
    for turn in range(1, MAX_ROUNDS + 1):
        step = current
        for d in DIMENSIONS:
            # Factors are written: a plan that held them would hold the steps before it twice per dimension.
            factors = scratch.put(_factors(current if together else step, targets[d], f"k_{d}"), f"factors{turn}-{d}")
            by = F.col(f"by_k_{d}")
            step = shares(step.join(factors, f"k_{d}"), F.col("share") * (F.pow(by, 1 / len(DIMENSIONS)) if together else by))
        fitted = scratch.put(step, f"shares{turn}")
        scratch.drop(f"shares{turn - 1}", *[f"factors{turn}-{d}" for d in DIMENSIONS])
        if together:
            total = fitted.agg(F.sum("share")).first()[0] or 0.0
            fitted = shares(fitted, F.col("share") / total if total > 0 else F.lit(0.0))
        off = residuals(fitted, targets).agg(F.max("off")).first()[0] or 0.0
        current = fitted
        if off <= TOLERANCE or (together and abs(was - off) <= TOLERANCE / 10):
            break
        together, was = together or off > STALLED * was, off
    return current


def sampling_rate(cells: DataFrame, keep: float) -> float:
    """The factor r at which the expected sample, Σ min(tokens, r · share · whole), has ``keep`` of all tokens.

    Cells that would need more than they have give all of it. The sum rises with r, so each pass over the
    cells tries GRID factors at once, evenly on a logarithmic scale, and narrows the bracket to EXACT.
    """
    whole, least = cells.agg(
        F.sum("tokens"), F.min(F.when(F.col("share") > 0, F.col("share") / F.col("tokens")))
    ).first()
    if not whole or not least or keep <= 0:
        return 0.0
    # At ``high`` every cell gives all; the sum is at most r · whole, so ``low`` is not above the rate.
    low, high = keep, max(keep, min(1 / (least * whole) * (1 + EXACT), 1e300) if least * whole > 1e-300 else 1e300)
    while high > low * (1 + EXACT):
        step = (high / low) ** (1 / GRID)
        tries = [*[low * step ** (k + 1) for k in range(GRID - 1)], high]
        sums = cells.agg(
            *[F.sum(F.least(F.col("tokens").cast("double"), F.lit(r * whole) * F.col("share"))) for r in tries]
        ).first()
        k = next((k for k, s in enumerate(sums) if s >= keep * whole), GRID - 1)
        low, high = ([low, *tries])[k], tries[k]
    return high


def mixed(
    documents: DataFrame,
    targets: Mapping[str, DataFrame] | None = None,
    keep: float = KEEP,
    seed: int = SEED,
) -> DataFrame:
    """Per row of ``documents``: its cell, n_tokens, ``weight``, ``probability`` and ``sampled``.

    ``targets`` gives per dimension a table (k_<dimension>, target); by default the present
    token shares raised to POWERS. ``weight`` is the cell's target share over its present
    share, ``probability`` is min(1, rate · weight), and a row is sampled if a hash of (seed, doc_id) falls
    below it, so a repeated task draws the same rows. Rows sharing a doc_id are drawn
    together if their cells agree. ``off_target`` is the largest difference between share and target among
    the cell's three marginals: above TOLERANCE, the targets contradict the cells that exist.

    Null source, language or topic (texts without words) are values of their own. Rows without
    tokens weigh nothing and are drawn at their cell's probability, 0. An empty table gives none.
    """
    scratch = Scratch(documents.sparkSession, "mixing")
    rows = scratch.put(token_cells(documents), "rows")
    keys = [f"k_{d}" for d in DIMENSIONS]
    cells = scratch.put(rows.groupBy(*keys).agg(F.sum("n_tokens").alias("tokens")), "cells")
    if targets is None:
        targets = {d: scratch.put(t, f"target-{d}") for d, t in default_targets(cells).items()}
    fitted = raked(cells, targets, scratch)
    rate = sampling_rate(fitted, keep)
    whole = fitted.agg(F.sum("tokens")).first()[0] or 0
    weight = F.when(F.col("tokens") > 0, F.col("share") * whole / F.col("tokens")).otherwise(0.0)
    left = scratch.put(residuals(fitted, targets), "residuals")
    placed = fitted
    for d in DIMENSIONS:
        placed = placed.join(
            left.where(F.col("dimension") == d).select(F.col("key").alias(f"k_{d}"), F.col("off").alias(f"off_{d}")), f"k_{d}"
        )
    off = F.greatest(*[f"off_{d}" for d in DIMENSIONS]).alias("off_target")
    weights = placed.select(*keys, weight.alias("weight"), F.least(F.lit(1.0), rate * weight).alias("probability"), off)
    weights = scratch.put(weights, "weights")
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id")), 11) / F.lit(float(1 << 53))
    return rows.join(weights, keys).select(
        "doc_id", "source", "lang", "topic", "n_tokens", "weight", "probability", "off_target", (draw < F.col("probability")).alias("sampled")
    )


def sample_mix(documents: DataFrame, **options) -> DataFrame:
    """The rows of ``documents`` whose doc_id is sampled, with all their columns; null doc_ids are never drawn."""
    drawn = mixed(documents, **options).where("sampled").select(F.col("doc_id").alias("__drawn")).distinct()
    return documents.join(drawn, documents["doc_id"] == F.col("__drawn"), "left_semi")

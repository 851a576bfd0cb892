"""Log-probabilities from logit arrays, and the unit change between nats and bits."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from visloom.functions.bind import bind

LN2 = math.log(2.0)


def log_normalizer(logits: Column) -> Column:
    """log(sum(exp(z))), shifted by the maximum so that exp never overflows."""

    def shifted(z: Column, top: Column) -> Column:
        return top + F.log(F.aggregate(z, F.lit(0.0), lambda acc, x: acc + F.exp(x - top)))

    return bind(logits, lambda z: bind(F.array_max(z), lambda top: shifted(z, top)))


def log_softmax(logits: Column) -> Column:
    return bind(log_normalizer(logits), lambda norm: F.transform(logits, lambda z: z - norm))


def target_logprob(logits: Column, target: Column) -> Column:
    """Log-probability of one target id without building the whole log-softmax."""
    return F.element_at(logits, (target + 1).cast("int")) - log_normalizer(logits)


def nats_to_bits(nats: Column) -> Column:
    return nats / F.lit(LN2)


def bits_to_nats(bits: Column) -> Column:
    return bits * F.lit(LN2)


def exact(value: Column) -> Column:
    """A decimal with 15 places, as many as doubles near 1 have: sums do not depend on the order of the rows."""
    return value.cast("decimal(38,15)")

"""Naming an intermediate value inside an expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once.

    A column used inside a lambda of ``transform`` or ``aggregate`` is computed again
    for every element; as the lambda's own variable it is computed once per row.
    """
    return F.get(F.transform(F.array(value), body), 0)

"""Threshold classification of a numeric column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: temperature classes, (name, exclusive upper bound in degC)
DEFAULT_TEMP_RULES: list[tuple[str, float]] = [
    ("low", 5),
    ("mid", 25),
    ("high", 2147483647),
]
# --- end of fixed values ----------------------------------------------------


def classify(value: Column, rules: Sequence[tuple[str, float]] = DEFAULT_TEMP_RULES) -> Column:
    """Name of the first rule whose bound is strictly above ``value``.

    Null, NaN, or a value at/above the last bound gives null (the row has no
    class and is dropped by the aggregations).
    """
    expr = None
    for name, bound in rules:
        cond = value < F.lit(float(bound))
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
    return expr if expr is not None else F.lit(None).cast("string")


def temperature_from_tenths(datavalue: Column) -> Column:
    """Weather value text in tenths of a degree -> degrees (double)."""
    return datavalue.try_cast("double") / F.lit(10.0)

"""Sums of doubles that do not depend on the order of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

#: A double counts in whole parts of 1/PARTS, which fit a 64-bit integer up to LARGEST.
PARTS = 10**12
LARGEST = 9e6


def terms(df: DataFrame, value: str) -> tuple[Column, Column]:
    """(whole, rest): what to add up for ``value``.

    Integers are their own whole.  A double up to ``LARGEST`` is a whole number
    of parts, rounded once per row, so its sums are the same in any order; NaN,
    infinities and larger values go to ``rest`` and are added as doubles.
    """
    c = F.col(value)
    if not isinstance(df.schema[value].dataType, (DoubleType, FloatType)):
        return c.cast("long"), F.lit(None).cast("double")
    plain = F.abs(c) <= LARGEST        # NaN is greater than any number
    return F.when(plain, F.round(c * F.lit(float(PARTS))).cast("long")).cast("decimal(20,0)"), F.when(~plain, c)


def total(df: DataFrame, value: str, whole: Column, rest: Column) -> Column:
    """The sum of ``value`` in ``df`` from the sums of its ``terms``."""
    parts = PARTS if isinstance(df.schema[value].dataType, (DoubleType, FloatType)) else 1
    return F.coalesce(whole.cast("double"), F.lit(0.0)) / F.lit(float(parts)) + F.coalesce(rest, F.lit(0.0))

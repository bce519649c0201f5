"""Arithmetic as IEEE 754 has it, where Spark's own differs.

Under ANSI rules Spark raises on division by zero and on casts of NaN, gives
null for logarithms of what isn't positive, and takes NaN for the greatest
number. Here division and logarithms give infinities and NaN, and truncation
clamps first.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN, INF = float("nan"), float("inf")


def number(c: Column) -> Column:
    return c.cast("double")


def divide(a: Column, b: Column) -> Column:
    a, b = number(a), number(b)
    zero = F.when(F.isnan(a) | (a == 0), NAN).when(a > 0, INF).otherwise(-INF)
    return F.when(a.isNull() | b.isNull(), None).when(b == 0, zero).otherwise(F.try_divide(a, b))


def ln(c: Column) -> Column:
    c = number(c)
    return F.when(F.isnan(c) | (c < 0), NAN).when(c == 0, -INF).otherwise(F.ln(c))


def real(c: Column) -> Column:
    """Whether there is a number that isn't NaN."""
    return c.isNotNull() & ~F.isnan(number(c))


def truncated(c: Column, low: float, high: float) -> Column:
    """A double cut to a whole number, after clamping it: no cast can overflow."""
    return F.least(F.greatest(c, F.lit(float(low))), F.lit(float(high))).cast("int")

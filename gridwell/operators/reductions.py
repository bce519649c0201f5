"""Reductions of a field to one value. All that are asked for at once take one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import INF, number, real

STATISTICS = {
    "n": F.count, "minimum": F.min, "maximum": F.max, "mean": F.avg, "total": F.sum,
    "variance": F.var_pop, "deviation": F.stddev_pop, "skewness": F.skewness, "kurtosis": F.kurtosis,
}


def nan_count(field: Column) -> Column:
    return F.count_if(F.isnan(number(field))).cast("double")


def inf_count(field: Column) -> Column:
    return F.count_if(F.abs(number(field)) == INF).cast("double")


def extreme(df: DataFrame, field: str | Column, keys: list[str], greatest: bool = False, carry: list[str] = ()) -> DataFrame:
    """One row: value, keys and carry of the least (greatest) element.

    NaN and null lose against any number; of equal values the element with the
    least keys wins. Without any number there is no row.
    """
    value = number(F.col(field) if isinstance(field, str) else field)
    rows = df.select(value.alias("value"), *dict.fromkeys([*keys, *carry])).filter(real(F.col("value")))
    rank = -F.col("value") if greatest else F.col("value")
    names = list(dict.fromkeys([*keys, *carry]))
    best = rows.agg(F.min(F.struct(rank.alias("rank"), *keys, *(c for c in names if c not in keys), "value")).alias("best"))
    return best.filter("best IS NOT NULL").select("best.value", *(f"best.{k}" for k in names))


def reduce_fields(df: DataFrame, **aggregates: Column) -> DataFrame:
    """One row with every aggregate, from one pass over df."""
    return df.agg(*(c.alias(n) for n, c in aggregates.items()))


def statistics(df: DataFrame, field: str, digits: int = 4) -> DataFrame:
    """A summary of one field; population moments, kurtosis in excess of the normal's."""
    v = F.when(real(F.col(field)), number(F.col(field)))
    return df.agg(*(f(v).alias(n) if n == "n" else F.round(f(v), digits).alias(n) for n, f in STATISTICS.items()))


def bounds(df: DataFrame, axes: list[str]) -> DataFrame:
    """One row with the least and greatest coordinate on each axis."""
    return df.agg(*(f(c).alias(f"{n}_{c}") for c in axes for n, f in (("min", F.min), ("max", F.max))))

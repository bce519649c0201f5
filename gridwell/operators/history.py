"""Operators over a query's results in time: a table (cycle, time, value).

Results are few, one for each evaluation, so windows over them are small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

INF = float("inf")


def by_cycle():
    return Window.orderBy("cycle")


def named(history: DataFrame, name: str) -> DataFrame:
    return history.filter(F.col("name") == name)


def indexed(results: DataFrame) -> DataFrame:
    """results with index, from 0 on, and back, from 0 at the latest."""
    return results.withColumns({"index": F.row_number().over(by_cycle()) - 1, "back": F.row_number().over(Window.orderBy(F.desc("cycle"))) - 1})


def lagged(results: DataFrame, relative_index: int) -> DataFrame:
    """Each result with the one so many evaluations before, or the first."""
    first = F.first("value").over(by_cycle().rowsBetween(Window.unboundedPreceding, 0))
    return results.withColumn("past", F.coalesce(F.lag("value", relative_index).over(by_cycle()), first))


def at(results: DataFrame, relative_index: int | None = None, absolute_index: int | None = None) -> DataFrame:
    """One row: the value so many evaluations ago, or at an index from the first on.

    Beyond the first result, the first is taken.
    """
    if (relative_index is None) == (absolute_index is None):
        raise ValueError("history: give either relative_index or absolute_index")
    given = relative_index if absolute_index is None else absolute_index
    if given < 0:
        raise ValueError("history: an index can't be negative")
    wanted = F.col("index") == given if relative_index is None else F.col("back") <= given
    rows = indexed(results).filter(wanted)
    return rows.orderBy("index").limit(1).select("value")


def between(results: DataFrame, **ends) -> DataFrame:
    """Results from first_* to last_*, by one of relative_index, absolute_index,
    absolute_time and absolute_cycle; ends beyond the results are clamped."""
    pairs = {k.split("_", 1)[1] for k in ends}
    if len(pairs) != 1 or len(ends) != 2:
        raise ValueError("history_range: exactly one pair of first_* and last_*")
    by = pairs.pop()
    column = {"relative_index": "back", "absolute_index": "index", "absolute_time": "time", "absolute_cycle": "cycle"}
    if by not in column:
        raise ValueError(f"history_range: unknown ends {by}")
    low, high = sorted((ends[f"first_{by}"], ends[f"last_{by}"]))
    if by != "relative_index" and ends[f"first_{by}"] > ends[f"last_{by}"]:
        raise ValueError("history_range: first is after last")
    return indexed(results).filter(F.col(column[by]).between(low, high)).select("cycle", "time", "value")


def collected(results: DataFrame) -> DataFrame:
    """One row: the values as an array, by cycle."""
    pairs = F.array_sort(F.collect_list(F.struct("cycle", "value")))
    return results.agg(F.transform(pairs, lambda p: p["value"]).alias("values"))


def gradients(results: DataFrame, window_length: float = 1, unit: str = "index") -> DataFrame:
    """Each result with the slope over a window that ends at it.

    By index, the window goes so many results back, or to the first, and the
    slope is per result. By time or cycle, it starts at the first result not
    before its begin and the slope is per the gap there really is. A first
    result has the slope minus infinity.
    """
    if unit not in ("index", "time", "cycle"):
        raise ValueError("gradient: unit is index, time or cycle")
    rows = indexed(results)
    if unit == "index":
        n = int(window_length)
        start = F.coalesce(F.lag("value", n).over(by_cycle()), F.first("value").over(by_cycle().rowsBetween(Window.unboundedPreceding, 0)))
        gap: Column = F.least(F.lit(n), F.col("index")).cast("double")
    else:
        # said in SQL: frames of the API hold whole numbers only
        frame = f"OVER (ORDER BY CAST({unit} AS DOUBLE) RANGE BETWEEN CAST({float(window_length)!r} AS DOUBLE) PRECEDING AND CURRENT ROW)"
        start, gap = F.expr(f"first(value) {frame}"), F.col(unit).cast("double") - F.expr(f"first(CAST({unit} AS DOUBLE)) {frame}")
    rows = rows.withColumns({"start": start, "gap": gap})
    slope = F.when(F.col("index") == 0, -INF).otherwise(F.try_divide(F.col("value") - F.col("start"), F.col("gap")))
    return rows.select("cycle", "time", "value", slope.alias("gradient"))


def gradient(results: DataFrame, window_length: float = 1, unit: str = "index") -> DataFrame:
    """One row: the slope at the latest result; none has minus infinity."""
    last = gradients(results, window_length, unit).agg(F.max_by("gradient", "cycle").alias("gradient"))
    return last.select(F.coalesce("gradient", F.lit(-INF)).alias("gradient"))


def successive(results: DataFrame, **ends) -> DataFrame:
    """Slopes in time between successive results of a range; fewer than two give one, minus infinity."""
    rows = between(results, **ends) if ends else results
    slope = F.try_divide(F.col("value") - F.lag("value").over(by_cycle()), F.col("time") - F.lag("time").over(by_cycle()))
    made = rows.select("cycle", "time", slope.alias("gradient"), F.count("*").over(Window.partitionBy()).alias("n"), F.row_number().over(by_cycle()).alias("i"))
    return made.filter("n < 2 OR i > 1").select("cycle", "time", F.when(F.col("n") < 2, -INF).otherwise(F.col("gradient")).alias("gradient"))


def before(history: DataFrame, time: float) -> DataFrame:
    """Results of before a time: those at or after it are from a run that was restarted since."""
    return history.filter(F.col("time") < time)

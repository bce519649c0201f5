"""Data that comes in cycles.

A stream's batches are cycles: each is published to an engine, whose queries add
to its history and whose triggers may fire. Windowed aggregates with a watermark
are Spark's own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.actions import Engine
from ..plans.evaluate import Data


def replay(stream: DataFrame, engine: Engine, actions: list[dict], checkpoint: str, time: str = "ts", keys: tuple[str, ...] = (), data: Callable[[DataFrame], Data] | None = None) -> StreamingQuery:
    """Runs actions on each batch; its cycle is the batch's number, its time the
    greatest value of the time column, in seconds. data: makes what is published of a
    batch, such as a mesh with the batch's fields; else its rows are.

    After a restart Spark may give a batch again: its results take the place of
    those that its cycle had.
    """

    def each(batch: DataFrame, cycle: int) -> None:
        if batch.isEmpty():
            return
        now = batch.agg(F.max(F.unix_micros(F.col(time).cast("timestamp")) / 1e6)).first()[0]
        made = data(batch) if data is not None else Data(batch, keys=keys)
        made.state = {**made.state, "cycle": cycle, "time": float(now or 0.0)}
        engine.publish(made)
        engine.execute(actions)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed(stream: DataFrame, time: str, length: str, late: str, by: list[str], *aggregates) -> DataFrame:
    """Aggregates in windows of time; rows later than the watermark allows are dropped."""
    out = stream.withWatermark(time, late).groupBy(F.window(time, length), *by).agg(*aggregates)
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *by, *(c for c in out.columns if c != "window" and c not in by))


def by_day(events: DataFrame, value: str = "value", time: str = "ts", how=F.max) -> DataFrame:
    """(cycle, time, value): one result a day, as a query each day would have it."""
    day = F.datediff(F.to_date(time), F.lit("2024-01-01")).cast("long")
    rows = events.groupBy(day.alias("cycle")).agg(how(value).alias("value"))
    return rows.select("cycle", (F.col("cycle") * 86400.0).alias("time"), "value")



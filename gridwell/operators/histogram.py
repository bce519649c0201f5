"""Histograms, and what is read from them.

A histogram is a table (bin, count) with a row for each bin, empty ones too. It
carries its bounds, so everything else follows from it alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import number, real, truncated


@dataclass(frozen=True)
class Histogram:
    bins: DataFrame  # (bin int, value double)
    num_bins: int
    min_val: float
    max_val: float

    @property
    def width(self) -> float:
        return (self.max_val - self.min_val) / self.num_bins

    def with_values(self, bins: DataFrame) -> Histogram:
        return Histogram(bins, self.num_bins, self.min_val, self.max_val)


def field_bounds(df: DataFrame, field: str) -> tuple[float, float]:
    v = number(F.col(field))
    low, high = df.filter(real(v)).agg(F.min(v), F.max(v)).first()
    if low is None:
        raise ValueError(f"field {field} has no values")
    return low, high


def histogram(df: DataFrame, field: str, num_bins: int = 256, min_val: float | None = None, max_val: float | None = None) -> Histogram:
    """Values outside the bounds count in the first or last bin; NaN and null don't count."""
    if min_val is None or max_val is None:
        low, high = field_bounds(df, field)
        min_val, max_val = low if min_val is None else min_val, high if max_val is None else max_val
    if not min_val < max_val:
        raise ValueError(f"histogram: min_val {min_val} must be less than max_val {max_val}")
    v = number(F.col(field))
    place = truncated((v - F.lit(float(min_val))) * F.lit(num_bins / (max_val - min_val)), 0, num_bins - 1)
    counts = df.filter(real(v)).groupBy(place.alias("bin")).agg(F.count("*").cast("double").alias("value"))
    every = df.sparkSession.range(num_bins).select(F.col("id").cast("int").alias("bin"))
    return Histogram(every.join(counts, "bin", "left").select("bin", F.coalesce("value", F.lit(0.0)).alias("value")), num_bins, float(min_val), float(max_val))


def _share() -> Column:
    # the bins of one histogram: a small table whatever the field's size
    return F.col("value") / F.sum("value").over(Window.partitionBy())


def pdf(h: Histogram) -> Histogram:
    return h.with_values(h.bins.select("bin", _share().alias("value")))


def cdf(h: Histogram) -> Histogram:
    running = F.sum("value").over(Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
    return h.with_values(h.bins.select("bin", (running / F.sum("value").over(Window.partitionBy())).alias("value")))


def entropy(h: Histogram) -> DataFrame:
    """One row: minus the sum of p ln p over bins that aren't empty."""
    p = h.bins.select(_share().alias("p")).filter("p > 0")
    return p.agg((-F.sum(F.col("p") * F.ln("p"))).alias("entropy"))


MODES = ("linear", "lower", "higher", "nearest", "midpoint")


def quantile(c: Histogram, q: float, interpolation: str = "linear") -> DataFrame:
    """One row: where the cumulative histogram c reaches q.

    The first bin with a share of q or more is taken. ``lower`` is its left
    edge, ``higher`` its right one; ``linear`` goes between them by the shares
    below and at the bin; ``nearest`` is the edge nearer to that; ends are clamped.
    """
    if not 0 <= q <= 1:
        raise ValueError("quantile: q must be between 0 and 1")
    if interpolation not in MODES:
        raise ValueError(f"quantile: interpolation must be one of {', '.join(MODES)}")
    before = F.coalesce(F.lag("value").over(Window.orderBy("bin")), F.lit(0.0))
    rows = c.bins.select("bin", "value", before.alias("below")).filter(F.col("value") >= q)
    best = rows.agg(F.min(F.struct("bin", "value", "below")).alias("b")).select("b.*")
    low = F.lit(c.min_val) + F.col("bin") * c.width
    step = F.col("value") - F.col("below")
    part = F.when(step > 0, (F.lit(q) - F.col("below")) / F.when(step > 0, step)).otherwise(0.0)
    linear = low + F.greatest(part, F.lit(0.0)) * c.width
    edge = {
        "lower": low, "higher": low + c.width, "midpoint": low + c.width / 2, "linear": linear,
        "nearest": F.when(part < 0.5, low).otherwise(low + c.width),
    }
    return best.select(edge[interpolation].alias("quantile"))


def bin_at(h: Histogram, index: int) -> DataFrame:
    """One row: the value of a bin by its number."""
    if not 0 <= index < h.num_bins:
        raise ValueError(f"bin: index {index} is outside of 0 to {h.num_bins - 1}")
    return h.bins.filter(F.col("bin") == index).select("value")


def bin_of(h: Histogram, val: float) -> DataFrame:
    """One row: the value of the bin that holds val; the greatest value belongs to the last bin."""
    if not h.min_val <= val <= h.max_val:
        raise ValueError(f"bin: {val} is outside of the histogram")
    return bin_at(h, min(int((val - h.min_val) * (h.num_bins / (h.max_val - h.min_val))), h.num_bins - 1))

"""Data binning: a reduction for each cell of a grid over one to many axes."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import number, real, truncated

COORDINATES = ("x", "y", "z")


@dataclass(frozen=True)
class Axis:
    """Either num_bins equal bins from min_val to max_val, or the edges in bins.

    Without bounds an axis goes from the least value to the greatest plus 1, a
    coordinate's a billionth or so over its greatest. clamp moves what is
    outside to the edge bins; else it isn't counted.
    """

    var: str
    num_bins: int = 256
    min_val: float | None = None
    max_val: float | None = None
    clamp: bool = False
    bins: tuple[float, ...] = field(default=())

    def __post_init__(self):
        if self.bins:
            if self.min_val is not None or self.max_val is not None:
                raise ValueError("axis: bins exclude min_val and max_val")
            if len(self.bins) < 2 or any(a >= b for a, b in zip(self.bins, self.bins[1:], strict=False)):
                raise ValueError("axis: bins must be two or more ascending edges")
        elif self.num_bins < 1:
            raise ValueError("axis: num_bins must be 1 or more")

    @property
    def size(self) -> int:
        return len(self.bins) - 1 if self.bins else self.num_bins

    def edges(self, i: Column) -> tuple[Column, Column]:
        """The bounds of bin i."""
        if self.bins:
            known = F.array(*(F.lit(float(e)) for e in self.bins))
            return F.get(known, i), F.get(known, i + 1)
        step = (self.max_val - self.min_val) / self.num_bins
        return F.lit(float(self.min_val)) + i * F.lit(step), F.lit(float(self.min_val)) + (i + 1) * F.lit(step)

    def index(self) -> Column:
        """The bin of a row, or null. Cut towards zero, so a value less than one
        bin below the first one counts in it."""
        v = number(F.col(self.var))
        if self.bins:
            known = F.array(*(F.lit(float(e)) for e in self.bins))
            at = F.size(F.filter(known, lambda e: e <= v)) - 1
            at = F.when(v == self.bins[-1], self.size - 1).otherwise(at)
            at = F.greatest(F.least(at, F.lit(self.size - 1)), F.lit(0)) if self.clamp else F.when((at >= 0) & (at < self.size), at)
        else:
            at = truncated((v - F.lit(float(self.min_val))) * F.lit(self.num_bins / (self.max_val - self.min_val)), -1, self.num_bins)
            at = F.greatest(F.least(at, F.lit(self.size - 1)), F.lit(0)) if self.clamp else F.when((at >= 0) & (at < self.size), at)
        return F.when(real(v), at)


def bounded(df: DataFrame, axes: list[Axis]) -> list[Axis]:
    """axes with their bounds; those that are missing come from one pass over df."""
    open_ = [a for a in axes if not a.bins and (a.min_val is None or a.max_val is None)]
    if not open_:
        return axes
    cut = lambda f, a: f(F.when(real(F.col(a.var)), number(F.col(a.var))))
    row = df.agg(*(f.alias(f"{n}{k}") for k, a in enumerate(open_) for n, f in (("a", cut(F.min, a)), ("b", cut(F.max, a))))).first()
    known = {}
    for k, a in enumerate(open_):
        low, high = row[f"a{k}"], row[f"b{k}"]
        if low is None:
            raise ValueError(f"axis: {a.var} has no values")
        high = high + (high - low) * 1e-8 if a.var in COORDINATES else high + 1.0
        known[a] = replace(a, min_val=low if a.min_val is None else a.min_val, max_val=high if a.max_val is None else a.max_val)
    return [known.get(a, a) for a in axes]


def reducer(op: str, v: Column) -> Column:
    """The reduction as an aggregate; variances are population ones."""
    known = {
        "sum": F.sum, "min": F.min, "max": F.max, "avg": F.avg, "count": F.count, "var": F.var_pop, "std": F.stddev_pop, "pdf": F.sum,
        "rms": lambda c: F.sqrt(F.avg(c * c)),
    }
    if op not in known:
        raise ValueError(f"binning: unknown reduction {op}; known are {', '.join(known)}")
    return known[op](v).cast("double")


@dataclass(frozen=True)
class Binning:
    grid: DataFrame  # (b0, b1, ..., bin, value): the first axis goes fastest in bin
    axes: list[Axis]
    op: str
    var: str


def names(axes: list[Axis]) -> list[str]:
    return [f"b{k}" for k in range(len(axes))]


def placed(df: DataFrame, axes: list[Axis]) -> DataFrame:
    """Rows that every axis has a bin for, with these bins."""
    rows = df.withColumns({n: a.index() for n, a in zip(names(axes), axes, strict=True)})
    return rows.filter(reduce(lambda x, y: x & y, (F.col(n).isNotNull() for n in names(axes))))


def binning(df: DataFrame, var: str, op: str, axes: list[Axis], empty_bin_val: float = 0.0, component: str | None = None) -> Binning:
    """The reduction of var in each cell of the axes' grid, empty cells too.

    An empty var stands for 1 on each row, with count, sum and pdf. The rows are
    reduced before they are shuffled, and the grid is no larger than its bins.
    """
    if not axes:
        raise ValueError("binning: at least one axis")
    if not var and op not in ("count", "sum", "pdf"):
        raise ValueError(f"binning: {op} needs a reduction variable")
    axes = bounded(df, axes)
    v = F.lit(1.0) if not var else number(F.col(var)[component] if component else F.col(var))
    made = placed(df, axes).groupBy(*names(axes)).agg(reducer(op, v).alias("value"))
    if op == "pdf":
        made = made.withColumn("value", F.col("value") / F.sum("value").over(Window.partitionBy()))
    total, stride, at = 1, 1, {}
    for n, a in zip(names(axes), axes, strict=True):
        at[n] = (F.floor(F.col("bin") / stride) % a.size).cast("int")
        stride *= a.size
        total *= a.size
    grid = df.sparkSession.range(total).select(F.col("id").alias("bin")).withColumns(at)
    grid = grid.join(made, names(axes), "left").select(*names(axes), "bin", F.coalesce("value", F.lit(float(empty_bin_val))).alias("value"))
    return Binning(grid, axes, op, var)


def painted(df: DataFrame, b: Binning, output: str = "binned", default: float = 0.0) -> DataFrame:
    """df with each row's cell's value; rows outside of the grid get the default."""
    rows = df.withColumns({n: a.index() for n, a in zip(names(b.axes), b.axes, strict=True)})
    grid = b.grid.select(*names(b.axes), F.col("value").alias(output))
    out = rows.join(grid, names(b.axes), "left").withColumn(output, F.coalesce(output, F.lit(float(default))))
    return out.drop(*names(b.axes))


def _one_axis(b: Binning) -> Axis:
    if len(b.axes) != 1:
        raise ValueError("this needs a binning over one axis")
    return b.axes[0]


def bin_rows(b: Binning) -> DataFrame:
    """(bin, min, max, center, value) of a binning over one axis."""
    low, high = _one_axis(b).edges(F.col("b0"))
    return b.grid.select("bin", low.alias("min"), high.alias("max"), ((low + high) / 2).alias("center"), "value")


def bin_at(b: Binning, index: int) -> DataFrame:
    if not 0 <= index < _one_axis(b).size:
        raise ValueError(f"bin: no bin {index}")
    return bin_rows(b).filter(F.col("bin") == index)


def point_and_axis(b: Binning, threshold: float, point: float, miss_value: float = float("nan"), direction: int = 1) -> DataFrame:
    """One row: the nearest bin ahead of point, in the direction, with a value above the threshold."""
    ahead = (F.col("center") - point) * direction
    rows = bin_rows(b).filter((F.col("value") > threshold) & (ahead >= 0))
    best = rows.agg(F.min(F.struct(F.abs(F.col("center") - point).alias("away"), "bin", "min", "max", "center", "value")).alias("b"))
    miss = {c: F.coalesce(f"b.{c}", F.lit(float(miss_value))).alias(c) for c in ("min", "max", "center", "value")}
    return best.select(*miss.values())


def max_from_point(b: Binning, point: float) -> DataFrame:
    """One row: the greatest value, of equal ones the nearest to point, and the signed distance to it."""
    away = F.col("center") - point
    best = bin_rows(b).agg(F.min(F.struct((-F.col("value")).alias("rank"), F.abs(away).alias("near"), "bin", "value", away.alias("distance"))).alias("b"))
    return best.select("b.bin", "b.value", "b.distance")



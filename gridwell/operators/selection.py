"""Selection of elements: filters that Spark can push down to the scan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import number, real
from .histogram import histogram

XYZ = ("x", "y", "z")


def threshold(df: DataFrame, field: str, min_value: float, max_value: float, invert: bool = False) -> DataFrame:
    """Rows with a value in the closed range, or all others; null and NaN are in no range."""
    inside = F.col(field).between(min_value, max_value) & ~F.isnan(number(F.col(field)))
    return df.filter(~F.coalesce(inside, F.lit(False)) if invert else inside)


def isovolume(df: DataFrame, field: str, min_value: float, max_value: float) -> DataFrame:
    return threshold(df, field, min_value, max_value)


def sphere(center, radius: float, axes=XYZ) -> Column:
    """Negative inside, by squares."""
    return reduce(lambda a, b: a + b, ((F.col(c) - float(p)) * (F.col(c) - float(p)) for c, p in zip(axes, center, strict=False))) - float(radius) ** 2


def cylinder(center, axis, radius: float, axes=XYZ) -> Column:
    """Negative inside of an endless cylinder around a line."""
    size = sum(float(a) ** 2 for a in axis) ** 0.5
    unit = [float(a) / size for a in axis]
    away = [F.col(c) - float(p) for c, p in zip(axes, center, strict=False)]
    along = reduce(lambda a, b: a + b, (d * u for d, u in zip(away, unit, strict=False)))
    return reduce(lambda a, b: a + b, (d * d for d in away)) - along * along - float(radius) ** 2


def box(low, high, axes=XYZ) -> Column:
    """Negative inside, zero on the border."""
    sides = [s for c, a, b in zip(axes, low, high, strict=False) for s in (F.lit(float(a)) - F.col(c), F.col(c) - float(b))]
    return F.greatest(*sides)


def plane(point, normal, axes=XYZ) -> Column:
    """Negative on the side that the normal comes from."""
    return reduce(lambda a, b: a + b, ((F.col(c) - float(p)) * float(n) for c, p, n in zip(axes, point, normal, strict=False)))


def multi_plane(planes, axes=XYZ) -> Column:
    """Negative where it is for every plane."""
    return F.greatest(*(plane(p, n, axes) for p, n in planes)) if len(planes) > 1 else plane(*planes[0], axes)


def inside(df: DataFrame, implicit: Column, invert: bool = False) -> DataFrame:
    """Rows on the inner side of an implicit function, border included; or all others."""
    return df.filter(implicit > 0 if invert else implicit <= 0)


def cells_inside(cells: DataFrame, vertices: DataFrame, implicit: Column, every: bool = True, invert: bool = False) -> DataFrame:
    """Cells of which every (or any) vertex is inside; conn is an array of vertex ids."""
    at = vertices.select("domain_id", "vertex_id", (implicit > 0 if invert else implicit <= 0).alias("in"))
    corners = cells.select("domain_id", "cell_id", F.explode("conn").alias("vertex_id")).join(at, ["domain_id", "vertex_id"])
    keep = corners.groupBy("domain_id", "cell_id").agg((F.bool_and if every else F.bool_or)("in").alias("in")).filter("in")
    return cells.join(keep.select("domain_id", "cell_id"), ["domain_id", "cell_id"], "left_semi")


def cells_in_range(cells: DataFrame, vertices: DataFrame, field: str, min_value: float, max_value: float, every: bool = False, invert: bool = False) -> DataFrame:
    """Cells by a field on their vertices: any of them in range, or every one."""
    ok = F.coalesce(F.col(field).between(min_value, max_value), F.lit(False))
    corners = cells.select("domain_id", "cell_id", F.explode("conn").alias("vertex_id")).join(vertices.select("domain_id", "vertex_id", ok.alias("in")), ["domain_id", "vertex_id"])
    keep = corners.groupBy("domain_id", "cell_id").agg((F.bool_and if every else F.bool_or)("in").alias("in")).filter(~F.col("in") if invert else F.col("in"))
    return cells.join(keep.select("domain_id", "cell_id"), ["domain_id", "cell_id"], "left_semi")


def strip_ghosts(df: DataFrame, field: str = "ghosts", min_value: int = 0, max_value: int = 0) -> DataFrame:
    """Rows with a ghost flag in range; a table without the field stays as it is."""
    return df.filter(F.col(field).between(min_value, max_value)) if field in df.columns else df


def clean_grid(vertices: DataFrame, cells: DataFrame) -> DataFrame:
    """Vertices that a cell uses."""
    used = cells.select("domain_id", F.explode("conn").alias("vertex_id")).distinct()
    return vertices.join(used, ["domain_id", "vertex_id"], "left_semi")


def radical_inverse(i: Column, base: int = 7, digits: int = 22) -> Column:
    """The digits of a whole number, mirrored at the point: an even spread over [0, 1)."""
    terms = [(F.floor(i / F.lit(base**k)) % base) * F.lit(1.0 / base ** (k + 1)) for k in range(digits)]
    return reduce(lambda a, b: a + b, terms)


def acceptance(counts: list[float], rate: float) -> list[float]:
    """Each bin's share of rows to keep, so that bins come to be as full as can be.

    Bins go from the emptiest on; each gives what is left, divided by the bins
    that are left, or all it has.
    """
    left, out = rate * sum(counts), [0.0] * len(counts)
    for k, (n, i) in enumerate(sorted((n, i) for i, n in enumerate(counts))):
        taken = min(n, left / (len(counts) - k))
        out[i] = taken / n if n else 0.0
        left -= taken
    return out


SALTS = 4096


def numbered(df: DataFrame, keys: list[str], domain: str | None = None, output: str = "index") -> DataFrame:
    """Rows with a number from 0 on in their domain, in order of a hash of keys, then keys.

    No window spans a domain: rows are numbered within a salt, and salts start
    where the ones before end. The table of salts has at most SALTS rows a domain.
    """
    by = [domain] if domain else []
    salt = F.conv(F.substring(F.md5(F.concat_ws(":", *(F.col(k).cast("string") for k in keys))), 1, 3), 16, 10).cast("int")
    rows = df.withColumn("__salt", salt)
    sizes = rows.groupBy(*by, "__salt").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(*by).orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(*by, "__salt", before.alias("__start"))
    place = F.row_number().over(Window.partitionBy(*by, "__salt").orderBy(*keys)) - 1
    out = rows.join(starts, [*by, "__salt"]).withColumn(output, F.col("__start") + place)
    return out.drop("__salt", "__start")


def sample_by_histogram(df: DataFrame, field: str, bins: int = 128, rate: float = 0.1, domain: str | None = None, keys: list[str] = (), index: str | None = None) -> DataFrame:
    """Rows so that all parts of the field's range are kept alike.

    A row stays if the radical inverse of its index in its domain is below its
    bin's share. index names a column with that; else rows are numbered by
    ``numbered``. One number a bin comes to the driver.
    """
    if not 0 < rate <= 1:
        raise ValueError("histsampling: sample_rate must be above 0 and at most 1")
    if bins < 1:
        raise ValueError("histsampling: bins must be positive")
    rows = df.filter(real(F.col(field)))
    h = histogram(rows, field, bins)
    share = acceptance([r["value"] for r in h.bins.orderBy("bin").collect()], rate)
    if index is None:
        rows = numbered(rows, list(keys), domain, "__index")
    at = F.least(F.greatest(((number(F.col(field)) - h.min_val) / F.lit(h.width)), F.lit(0.0)), F.lit(float(bins - 1))).cast("int")
    kept = rows.filter(radical_inverse(F.col(index or "__index").cast("long")) < F.get(F.array(*map(F.lit, share)), at))
    return kept.drop("__index")


def select_fields(df: DataFrame, fields: list[str]) -> DataFrame:
    unknown = [f for f in fields if f not in df.columns]
    if unknown:
        raise ValueError(f"unknown fields {unknown}; known are {df.columns}")
    return df.select(*fields)

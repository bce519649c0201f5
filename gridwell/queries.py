"""The registered queries: each applies one operator to whole tables.

Each has SQL that says the same, written without a look at how the query is
planned. Sums of doubles are rounded on both sides, as their order differs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import numeric, vectors
from .operators import binning as bn
from .operators import fields as fl
from .operators import geometry as gm
from .operators import histogram as hg
from .operators import history as hs
from .operators import mesh as ms
from .operators import reductions as rd
from .operators import selection as sl
from .plans.actions import Engine
from .plans.evaluate import Data, Evaluator, History
from .sources import tables
from .streaming import cycles

QUERIES: dict = {}
SQL: dict[str, str] = {}
LINE_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def query(sql: str | None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


# -- reductions

_KEYS = ", ".join(LINE_KEYS)


@query(f"SELECT l_extendedprice AS value, {_KEYS} FROM lineitem ORDER BY l_extendedprice, {_KEYS} LIMIT 1")
def field_min(spark, sf):
    return rd.extreme(read(spark, sf, "lineitem"), "l_extendedprice", LINE_KEYS)


@query(f"SELECT l_extendedprice AS value, {_KEYS} FROM lineitem ORDER BY l_extendedprice DESC, {_KEYS} LIMIT 1")
def field_max(spark, sf):
    return rd.extreme(read(spark, sf, "lineitem"), "l_extendedprice", LINE_KEYS, greatest=True)


@query("SELECT round(sum(l_quantity), 4) AS total, round(avg(l_quantity), 4) AS mean, count(*) AS n FROM lineitem")
def field_sum_avg(spark, sf):
    q = F.col("l_quantity")
    return rd.reduce_fields(read(spark, sf, "lineitem"), total=F.round(F.sum(q), 4), mean=F.round(F.avg(q), 4), n=F.count("*"))


@query("""SELECT count(l_quantity) AS n, round(min(l_quantity), 4) AS minimum, round(max(l_quantity), 4) AS maximum, round(avg(l_quantity), 4) AS mean,
 round(sum(l_quantity), 4) AS total, round(var_pop(l_quantity), 4) AS variance, round(stddev_pop(l_quantity), 4) AS deviation,
 round((avg(l_quantity ** 3) - 3 * avg(l_quantity) * avg(l_quantity ** 2) + 2 * avg(l_quantity) ** 3) / stddev_pop(l_quantity) ** 3, 4) AS skewness,
 round((avg(l_quantity ** 4) - 4 * avg(l_quantity) * avg(l_quantity ** 3) + 6 * avg(l_quantity) ** 2 * avg(l_quantity ** 2) - 3 * avg(l_quantity) ** 4) / var_pop(l_quantity) ** 2 - 3, 4) AS kurtosis
 FROM lineitem""")
def field_statistics(spark, sf):
    return rd.statistics(read(spark, sf, "lineitem"), "l_quantity")


@query("""SELECT (count(*) FILTER (WHERE l_discount = 0))::DOUBLE AS nans, (count(*) FILTER (WHERE l_discount = 0 AND l_tax = 0))::DOUBLE AS nan_both,
 (count(*) FILTER (WHERE l_discount = 0 AND l_tax <> 0))::DOUBLE AS infs FROM lineitem""")
def nan_inf_count(spark, sf):
    ratio = numeric.divide(F.col("l_tax"), F.col("l_discount"))
    hole = F.when(F.col("l_discount") == 0, F.lit(float("nan"))).otherwise(F.col("l_quantity"))
    return rd.reduce_fields(read(spark, sf, "lineitem"), nans=rd.nan_count(hole), nan_both=rd.nan_count(ratio), infs=rd.inf_count(ratio))


@query("SELECT min(l_quantity) AS min_x, max(l_quantity) AS max_x, min(l_discount) AS min_y, max(l_discount) AS max_y, min(l_tax) AS min_z, max(l_tax) AS max_z FROM lineitem")
def field_bounds(spark, sf):
    return rd.bounds(_points(spark, sf), ["x", "y", "z"])


def _points(spark, sf) -> DataFrame:
    """lineitem as points: quantity, discount and tax for x, y and z."""
    return read(spark, sf, "lineitem").select(*LINE_KEYS, "l_extendedprice", F.col("l_quantity").alias("x"), F.col("l_discount").alias("y"), F.col("l_tax").alias("z"))


# -- histograms

_HIST = """WITH m AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders),
c AS (SELECT least(greatest(trunc((o_totalprice - lo) * (64 / (hi - lo))), 0), 63)::INT AS bin, count(*)::DOUBLE AS n FROM orders, m GROUP BY 1),
h AS (SELECT b.bin::INT AS bin, coalesce(c.n, 0)::DOUBLE AS value FROM range(64) AS b(bin) LEFT JOIN c ON c.bin = b.bin),
p AS (SELECT bin, value / sum(value) OVER () AS value FROM h),
d AS (SELECT bin, sum(value) OVER (ORDER BY bin) / sum(value) OVER () AS value FROM h),
e AS (SELECT bin, value, coalesce(lag(value) OVER (ORDER BY bin), 0) AS below FROM d),
"""


def _orders_histogram(spark, sf) -> hg.Histogram:
    return hg.histogram(read(spark, sf, "orders"), "o_totalprice", 64)


@query(_HIST + "z AS (SELECT 1) SELECT bin, value FROM h")
def histogram(spark, sf):
    return _orders_histogram(spark, sf).bins


@query(_HIST + "z AS (SELECT 1) SELECT bin, round(value, 9) AS value FROM p")
def hist_pdf(spark, sf):
    return hg.pdf(_orders_histogram(spark, sf)).bins.select("bin", F.round("value", 9).alias("value"))


@query(_HIST + "z AS (SELECT 1) SELECT bin, round(value, 9) AS value FROM d")
def hist_cdf(spark, sf):
    return hg.cdf(_orders_histogram(spark, sf)).bins.select("bin", F.round("value", 9).alias("value"))


@query(_HIST + "z AS (SELECT 1) SELECT round(-sum(value * ln(value)) FILTER (WHERE value > 0), 6) AS entropy FROM p")
def hist_entropy(spark, sf):
    return hg.entropy(_orders_histogram(spark, sf)).select(F.round("entropy", 6).alias("entropy"))


_QUANTILES = {
    "linear": "low + greatest((0.3 - below) / (value - below), 0) * width", "lower": "low", "higher": "low + width",
    "midpoint": "low + width / 2", "nearest": "CASE WHEN (0.3 - below) / (value - below) < 0.5 THEN low ELSE low + width END",
}
for _mode, _said in _QUANTILES.items():
    query(_HIST + f"""f AS (SELECT e.*, lo + bin * ((hi - lo) / 64) AS low, (hi - lo) / 64 AS width FROM e, m WHERE value >= 0.3 ORDER BY bin LIMIT 1)
SELECT round({_said}, 4) AS quantile FROM f""", f"hist_quantile_{_mode}")(  # fmt: skip
        lambda spark, sf, mode=_mode: hg.quantile(hg.cdf(_orders_histogram(spark, sf)), 0.3, mode).select(F.round("quantile", 4).alias("quantile"))
    )


@query(_HIST + "z AS (SELECT 1) SELECT value FROM h WHERE bin = 5")
def hist_bin_by_index(spark, sf):
    return hg.bin_at(_orders_histogram(spark, sf), 5)


@query(_HIST + "z AS (SELECT 1) SELECT value FROM h, m WHERE bin = least(trunc((100000 - lo) * (64 / (hi - lo))), 63)")
def hist_bin_by_value(spark, sf):
    return hg.bin_of(_orders_histogram(spark, sf), 100000.0)


# -- binnings

PRICE = "l_extendedprice"
QUANTITY = bn.Axis("l_quantity", 10, 1.0, 51.0)
DISCOUNT = bn.Axis("l_discount", 5, 0.0, 0.105)
_B1 = "trunc((l_quantity - 1) * (10 / 50.0))::INT"
_B2 = "trunc((l_discount - 0.0::DOUBLE) * (5 / 0.105::DOUBLE))::INT"
_GRID1 = "SELECT b.b0::INT AS b0, b.b0 AS bin, coalesce(g.value, {empty}) AS value FROM range({n}) AS b(b0) LEFT JOIN g ON g.b0 = b.b0"
_REDUCE = {
    "sum": "sum({v})", "min": "min({v})", "max": "max({v})", "avg": "avg({v})", "count": "count({v})::DOUBLE", "var": "var_pop({v})", "std": "stddev_pop({v})",
    "rms": "sqrt(avg({v} * {v}))", "pdf": "sum({v}) / sum(sum({v})) OVER ()",
}
_DIGITS = {"pdf": 9, "var": 1}


def _rounded(b: bn.Binning, digits: int = 3) -> DataFrame:
    return b.grid.withColumn("value", F.round("value", digits))


for _op, _said in _REDUCE.items():
    query(
        f"WITH g AS (SELECT {_B1} AS b0, round({_said.format(v=PRICE)}, {_DIGITS.get(_op, 3)}) AS value FROM lineitem WHERE {_B1} BETWEEN 0 AND 9 GROUP BY 1) " + _GRID1.format(empty=0.0, n=10),
        f"binning_{_op}_1d",
    )(lambda spark, sf, op=_op: _rounded(bn.binning(read(spark, sf, "lineitem"), PRICE, op, [QUANTITY]), _DIGITS.get(op, 3)))


@query(f"""WITH g AS (SELECT {_B1} AS b0, {_B2} AS b1, round(avg({PRICE}), 3) AS value FROM lineitem WHERE {_B1} BETWEEN 0 AND 9 AND {_B2} BETWEEN 0 AND 4 GROUP BY 1, 2)
SELECT (b.bin % 10)::INT AS b0, (b.bin // 10)::INT AS b1, b.bin, coalesce(g.value, 0.0) AS value FROM range(50) AS b(bin) LEFT JOIN g ON g.b0 = b.bin % 10 AND g.b1 = b.bin // 10""")
def binning_avg_2d(spark, sf):
    return _rounded(bn.binning(read(spark, sf, "lineitem"), PRICE, "avg", [QUANTITY, DISCOUNT]))


@query("""WITH e AS (SELECT CASE WHEN l_quantity < 5 THEN 0 WHEN l_quantity < 20 THEN 1 ELSE 2 END AS b0, l_tax FROM lineitem WHERE l_quantity BETWEEN 1 AND 50),
g AS (SELECT b0, round(sum(l_tax), 3) AS value FROM e GROUP BY 1) """ + _GRID1.format(empty=0.0, n=3))
def binning_rectilinear(spark, sf):
    return _rounded(bn.binning(read(spark, sf, "lineitem"), "l_tax", "sum", [bn.Axis("l_quantity", bins=(1.0, 5.0, 20.0, 50.0))]))


@query("""WITH g AS (SELECT least(greatest(trunc((l_quantity - 10) * (4 / 20.0)), 0), 3)::INT AS b0, count(*)::DOUBLE AS value FROM lineitem GROUP BY 1) """ + _GRID1.format(empty=0.0, n=4))
def binning_clamp(spark, sf):
    return bn.binning(read(spark, sf, "lineitem"), "", "count", [bn.Axis("l_quantity", 4, 10.0, 30.0, clamp=True)]).grid


@query("""WITH g AS (SELECT trunc((l_quantity - 0) * (8 / 80.0))::INT AS b0, round(max(l_tax), 3) AS value FROM lineitem GROUP BY 1) """ + _GRID1.format(empty=-1.0, n=8))
def binning_empty_val(spark, sf):
    return _rounded(bn.binning(read(spark, sf, "lineitem"), "l_tax", "max", [bn.Axis("l_quantity", 8, 0.0, 80.0)], empty_bin_val=-1.0))


@query("""WITH m AS (SELECT min(p_size)::DOUBLE AS lo, max(p_size) + 1.0::DOUBLE AS hi FROM part),
g AS (SELECT trunc((p_size - lo) * (6 / (hi - lo)))::INT AS b0, count(*)::DOUBLE AS value FROM part, m GROUP BY 1) """ + _GRID1.format(empty=0.0, n=6))
def binning_default_bounds(spark, sf):
    return bn.binning(read(spark, sf, "part"), "", "count", [bn.Axis("p_size", 6)]).grid


@query(f"""SELECT {_KEYS}, l_quantity, coalesce(round(avg({PRICE}) FILTER (WHERE {_B1} BETWEEN 0 AND 9) OVER (PARTITION BY {_B1}), 3), 0.0) AS binned FROM lineitem""")
def binning_paint(spark, sf):
    rows = read(spark, sf, "lineitem")
    b = bn.binning(rows, PRICE, "avg", [QUANTITY])
    return bn.painted(rows.select(*LINE_KEYS, "l_quantity"), b).withColumn("binned", F.round("binned", 3))


_BINS = f"""WITH g AS (SELECT {_B1} AS bin, count(*)::DOUBLE AS value FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1),
b AS (SELECT r.bin, 1 + r.bin * 5.0 AS min, 1 + (r.bin + 1) * 5.0 AS max, 1 + r.bin * 5.0 + 2.5 AS center, coalesce(g.value, 0) AS value FROM range(10) AS r(bin) LEFT JOIN g ON g.bin = r.bin) """


def _returned(spark, sf) -> bn.Binning:
    return bn.binning(read(spark, sf, "lineitem").filter("l_returnflag = 'R'"), "", "count", [QUANTITY])


@query(_BINS + "SELECT bin, min::DOUBLE AS min, max::DOUBLE AS max, center::DOUBLE AS center, value FROM b WHERE bin = 3")
def binning_bin(spark, sf):
    return bn.bin_at(_returned(spark, sf), 3)


@query(_BINS + "SELECT min::DOUBLE AS min, max::DOUBLE AS max, center::DOUBLE AS center, value FROM b WHERE value > 10 AND center >= 20 ORDER BY center - 20 LIMIT 1")
def point_and_axis(spark, sf):
    return bn.point_and_axis(_returned(spark, sf), 10, 20.0)


@query(_BINS + "SELECT min::DOUBLE AS min, max::DOUBLE AS max, center::DOUBLE AS center, value FROM b WHERE value > 10 AND center <= 20 ORDER BY 20 - center LIMIT 1")
def point_and_axis_behind(spark, sf):
    return bn.point_and_axis(_returned(spark, sf), 10, 20.0, direction=-1)


@query(_BINS + "SELECT bin, value, (center - 20)::DOUBLE AS distance FROM b ORDER BY value DESC, abs(center - 20), bin LIMIT 1")
def max_from_point(spark, sf):
    return bn.max_from_point(_returned(spark, sf), 20.0)


# -- history

_DAYS = """WITH r AS (SELECT date_diff('day', DATE '2024-01-01', ts::DATE)::BIGINT AS cycle, max(value) AS value FROM events GROUP BY 1),
h AS (SELECT cycle, cycle * 86400.0::DOUBLE AS time, value, row_number() OVER (ORDER BY cycle) - 1 AS i, row_number() OVER (ORDER BY cycle DESC) - 1 AS back FROM r) """


def _days(spark, sf) -> DataFrame:
    return cycles.by_day(read(spark, sf, "events"))


@query(_DAYS + "SELECT cycle, time, value, coalesce(lag(value, 2) OVER (ORDER BY cycle), first(value) OVER (ORDER BY cycle)) AS past FROM h")
def history_lagged(spark, sf):
    return hs.lagged(_days(spark, sf), 2)


@query(_DAYS + "SELECT value FROM h WHERE back = 3")
def history_relative(spark, sf):
    return hs.at(_days(spark, sf), relative_index=3)


@query(_DAYS + "SELECT value FROM h WHERE i = 4")
def history_absolute(spark, sf):
    return hs.at(_days(spark, sf), absolute_index=4)


for _ends, _where in {
    "index": ({"first_absolute_index": 2, "last_absolute_index": 9}, "i BETWEEN 2 AND 9"),
    "relative": ({"first_relative_index": 0, "last_relative_index": 4}, "back BETWEEN 0 AND 4"),
    "time": ({"first_absolute_time": 86400.0, "last_absolute_time": 864000.0}, "time BETWEEN 86400 AND 864000"),
    "cycle": ({"first_absolute_cycle": 5, "last_absolute_cycle": 12}, "cycle BETWEEN 5 AND 12"),
}.items():
    query(_DAYS + f"SELECT cycle, time, value FROM h WHERE {_where[1]}", f"history_range_{_ends}")(lambda spark, sf, ends=_where[0]: hs.between(_days(spark, sf), **ends))


@query(_DAYS + """SELECT cycle, time, value, CASE WHEN i = 0 THEN '-infinity'::DOUBLE ELSE round((value - coalesce(lag(value, 3) OVER (ORDER BY cycle), first(value) OVER (ORDER BY cycle))) / least(3, i), 9) END AS gradient FROM h""")
def history_gradient_index(spark, sf):
    return hs.gradients(_days(spark, sf), 3).withColumn("gradient", F.round("gradient", 9))


@query(_DAYS + """, w AS (SELECT *, first(value) OVER p AS v0, first(time) OVER p AS t0 FROM h WINDOW p AS (ORDER BY time RANGE BETWEEN 200000 PRECEDING AND CURRENT ROW))
SELECT cycle, time, value, CASE WHEN i = 0 THEN '-infinity'::DOUBLE ELSE round((value - v0) / (time - t0) * 1e6, 6) END AS gradient FROM w""")
def history_gradient_time(spark, sf):
    return hs.gradients(_days(spark, sf), 200000.0, "time").withColumn("gradient", F.round(F.col("gradient") * 1e6, 6))


@query(_DAYS + ", d AS (SELECT cycle, time, (value - lag(value) OVER (ORDER BY cycle)) / (time - lag(time) OVER (ORDER BY cycle)) AS g FROM h) SELECT cycle, time, round(g * 1e6, 6) AS gradient FROM d WHERE g IS NOT NULL")
def history_gradient_range(spark, sf):
    return hs.successive(_days(spark, sf)).withColumn("gradient", F.round(F.col("gradient") * 1e6, 6))


@query(_DAYS + "SELECT cycle, time, value FROM h WHERE time < 864000")
def history_restart(spark, sf):
    return hs.before(_days(spark, sf), 864000.0)


@query(_DAYS + ", w AS (SELECT cycle, value - lag(value) OVER (ORDER BY cycle) AS step FROM h) SELECT cycle, coalesce(step > 10, false) AS fires FROM w")
def trigger_fire(spark, sf):
    rows = hs.lagged(_days(spark, sf), 1)
    return rows.select("cycle", (F.col("value") - F.col("past") > 10).alias("fires"))


# -- derived fields


def _with_ids(df: DataFrame, *columns) -> DataFrame:
    return df.select(*LINE_KEYS, *columns)


_LINE = f"SELECT {_KEYS}, {{}} FROM lineitem"


@query(_LINE.format("round(l_extendedprice * (1 - l_discount) + l_tax / l_quantity, 6) AS net"))
def derived_arith(spark, sf):
    data = Data(read(spark, sf, "lineitem"), keys=tuple(LINE_KEYS))
    f = Evaluator(data).run("price = field('l_extendedprice')\nprice * (1 - field('l_discount')) + field('l_tax') / field('l_quantity')")
    return _with_ids(data.cells, F.round(f.column, 6).alias("net"))


@query(_LINE.format("CASE WHEN l_quantity > 25 AND l_discount < 0.05 THEN l_tax ELSE -1.0 END AS picked"))
def derived_if(spark, sf):
    data = Data(read(spark, sf, "lineitem"))
    f = Evaluator(data).run("if field('l_quantity') > 25 and field('l_discount') < 0.05 then field('l_tax') else -1.0")
    return _with_ids(data.cells, f.column.alias("picked"))


@query(_LINE.format("least(l_quantity, 10.0) AS low, greatest(l_discount, l_tax) AS high"))
def derived_minmax(spark, sf):
    data = Data(read(spark, sf, "lineitem"))
    ev = Evaluator(data)
    return _with_ids(data.cells, ev.run("min(field('l_quantity'), 10.0)").column.alias("low"), ev.run("max(field('l_discount'), field('l_tax'))").column.alias("high"))


@query(_LINE.format("round(pow(l_quantity, 2), 6) AS squared, round(sqrt(l_quantity), 6) AS root, round(abs(l_tax - 0.04), 6) AS away, round(sin(l_quantity), 6) AS wave"))
def derived_functions(spark, sf):
    data = Data(read(spark, sf, "lineitem"))
    ev = Evaluator(data)
    said = {"squared": "pow(field('l_quantity'), 2)", "root": "sqrt(field('l_quantity'))", "away": "abs(field('l_tax') - 0.04)", "wave": "sin(field('l_quantity'))"}
    return _with_ids(data.cells, *(F.round(ev.run(e).column, 6).alias(n) for n, e in said.items()))


@query(_LINE.format("round(l_discount + l_tax, 6) AS both"))
def add_fields(spark, sf):
    return _with_ids(fl.add_fields(read(spark, sf, "lineitem"), ["l_discount", "l_tax", "not_there"], "both"), F.round("both", 6).alias("both"))


@query(_LINE.format("round(pow(l_quantity, 1.5), 5) AS powered"))
def power_of_field(spark, sf):
    return _with_ids(fl.power_of_field(read(spark, sf, "lineitem"), "l_quantity", 1.5, "powered"), F.round("powered", 5).alias("powered"))


for _kind, _said in {"log_e": "ln", "log_10": "log10", "log_2": "log2"}.items():
    query(f"SELECT s_suppkey, round({_said}(greatest(s_acctbal, 1.0)), 6) AS logged FROM supplier", _kind)(
        lambda spark, sf, kind=_kind: fl.log(read(spark, sf, "supplier"), "s_acctbal", kind, "logged", 1.0).select("s_suppkey", F.round("logged", 6).alias("logged"))
    )


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 5) AS size FROM embeddings")
def vector_magnitude(spark, sf):
    return fl.vector_magnitude(read(spark, sf, "embeddings"), "embedding", "size").select("vec_id", F.round("size", 5).alias("size"))


@query("SELECT vec_id, round(embedding[4]::DOUBLE, 6) AS part FROM embeddings")
def vector_component(spark, sf):
    return fl.vector_component(read(spark, sf, "embeddings"), "embedding", 3, "part").select("vec_id", F.round("part", 6).alias("part"))


@query("WITH e AS (SELECT vec_id, embedding AS a, list_reverse(embedding) AS b FROM embeddings) SELECT vec_id, round(list_sum(list_transform(range(1, len(a) + 1), lambda i: a[i]::DOUBLE * b[i]::DOUBLE)), 5) AS product FROM e")
def vector_dot(spark, sf):
    e = read(spark, sf, "embeddings")
    return e.select("vec_id", F.round(vectors.array_dot(F.col("embedding"), F.reverse("embedding")), 5).alias("product"))


@query(_LINE.format("round(sqrt(l_quantity * l_quantity + l_discount * l_discount + l_tax * l_tax), 6) AS size, l_tax AS z"))
def composite_vector(spark, sf):
    rows = fl.composite_vector(read(spark, sf, "lineitem"), ["l_quantity", "l_discount", "l_tax"], "v")
    return _with_ids(fl.vector_magnitude(rows, "v", "size"), F.round("size", 6).alias("size"), F.col("v.z").alias("z"))


@query("SELECT n_nationkey, n_regionkey AS domain_ids FROM nation")
def add_domain_ids(spark, sf):
    return fl.add_domain_ids(read(spark, sf, "nation"), "n_regionkey").select("n_nationkey", "domain_ids")


# -- selection


@query(_LINE.format("l_quantity") + " WHERE l_quantity BETWEEN 10 AND 12")
def threshold(spark, sf):
    return _with_ids(sl.threshold(read(spark, sf, "lineitem"), "l_quantity", 10, 12), "l_quantity")


@query(_LINE.format("l_quantity") + " WHERE NOT (l_quantity BETWEEN 3 AND 48)")
def threshold_invert(spark, sf):
    return _with_ids(sl.threshold(read(spark, sf, "lineitem"), "l_quantity", 3, 48, invert=True), "l_quantity")


_XYZ = f"SELECT {_KEYS} FROM lineitem WHERE "


@query(_XYZ + "l_quantity BETWEEN 10 AND 20 AND l_discount BETWEEN 0.02 AND 0.06 AND l_tax BETWEEN 0 AND 0.05")
def threshold_box(spark, sf):
    return sl.inside(_points(spark, sf), sl.box((10, 0.02, 0), (20, 0.06, 0.05))).select(*LINE_KEYS)


@query(_XYZ + "pow(l_quantity - 25, 2) + pow(l_discount - 0.05, 2) + pow(l_tax - 0.04, 2) - 9.5 <= 0")
def threshold_sphere(spark, sf):
    return sl.inside(_points(spark, sf), sl.sphere((25, 0.05, 0.04), 9.5**0.5)).select(*LINE_KEYS)


@query(_XYZ + "pow(l_quantity - 25, 2) + pow(l_discount - 0.05, 2) - 20.25 > 0")
def threshold_cylinder(spark, sf):
    return sl.inside(_points(spark, sf), sl.cylinder((25, 0.05, 0), (0, 0, 1), 4.5), invert=True).select(*LINE_KEYS)


@query(_XYZ + "(l_quantity - 30) * 1 + (l_discount - 0.03) * 100 + 0 <= 0")
def threshold_plane(spark, sf):
    return sl.inside(_points(spark, sf), sl.plane((30, 0.03, 0), (1, 100, 0))).select(*LINE_KEYS)


@query(_XYZ + "l_quantity - 30 <= 0 AND 0.045 - l_discount <= 0")
def threshold_multi_plane(spark, sf):
    planes = [((30, 0, 0), (1, 0, 0)), ((0, 0.045, 0), (0, -1, 0))]
    return sl.inside(_points(spark, sf), sl.multi_plane(planes)).select(*LINE_KEYS)


@query(_LINE.format("l_tax") + " WHERE l_tax BETWEEN 0.02 AND 0.03")
def isovolume_rows(spark, sf):
    return _with_ids(sl.isovolume(read(spark, sf, "lineitem"), "l_tax", 0.02, 0.03), "l_tax")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 3 BETWEEN 0 AND 1")
def ghost_strip(spark, sf):
    rows = read(spark, sf, "orders").withColumn("ghosts", (F.col("o_orderkey") % 3).cast("int"))
    return sl.strip_ghosts(rows, "ghosts", 0, 1).select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice BETWEEN (SELECT avg(o_totalprice) FROM orders) AND 400000")
def param_expression(spark, sf):
    engine = Engine().publish(Data(read(spark, sf, "orders"), keys=("o_orderkey",)))
    engine.execute([{"action": "add_pipelines", "pipelines": {"p": {"f": {"type": "threshold", "params": {"field": "o_totalprice", "min_value": "avg(field('o_totalprice'))", "max_value": 400000.0}}}}}])
    return engine.pipelines["p"].cells.select("o_orderkey", "o_totalprice")


_INVERSE = " + ".join(f"((i // {7**k}) % 7) * {1.0 / 7 ** (k + 1)!r}::DOUBLE" for k in range(22))


@query(f"""WITH i AS (SELECT p_partkey, p_retailprice AS v, row_number() OVER (ORDER BY ('0x' || substr(md5(p_partkey::VARCHAR), 1, 3))::INT, p_partkey) - 1 AS i FROM part),
m AS (SELECT min(v) AS lo, max(v) AS hi FROM i), b AS (SELECT p_partkey, i, least(greatest((v - lo) / ((hi - lo) / 16), 0), 15)::DOUBLE AS at,
 least(greatest(trunc((v - lo) * (16 / (hi - lo))), 0), 15)::INT AS bin FROM i, m),
c AS (SELECT r.k::INT AS bin, (SELECT count(*) FROM b WHERE b.bin = r.k) AS n FROM range(16) AS r(k)),
s AS (SELECT bin, n, sum(n) OVER () AS total, coalesce(sum(n) OVER (ORDER BY n, bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, row_number() OVER (ORDER BY n, bin) - 1 AS k FROM c),
l AS (SELECT *, (0.1 * total - before) / (16 - k) AS level FROM s), g AS (SELECT *, max(CASE WHEN level <= n THEN level END) OVER () AS share FROM l),
a AS (SELECT bin, CASE WHEN n > 0 THEN least(n, share) / n ELSE 0 END AS p FROM g)
SELECT p_partkey FROM b JOIN a ON a.bin = trunc(b.at)::INT WHERE {_INVERSE} < p""")
def histsampling(spark, sf):
    return sl.sample_by_histogram(read(spark, sf, "part"), "p_retailprice", 16, 0.1, keys=["p_partkey"]).select("p_partkey")


@query("SELECT o_orderkey, o_orderstatus FROM orders")
def field_selection(spark, sf):
    return sl.select_fields(read(spark, sf, "orders"), ["o_orderkey", "o_orderstatus"])


# -- meshes: the orders are the vertices of a grid, 5 by 6 in each layer, with f = x * y + z + w and w the root of their price

_V = "v AS (SELECT id, (id % 5)::INT AS i, ((id // 5) % 6)::INT AS j, (id // 30)::INT AS k, (id % 5) * 0.5::DOUBLE AS x, ((id // 5) % 6) * 1.0::DOUBLE AS y, (id // 30) * 2.0::DOUBLE AS z, w FROM (SELECT o_orderkey AS id, sqrt(o_totalprice) / 100 AS w FROM orders))"
_F = "f AS (SELECT *, x * y + z + w AS f FROM v)"
_C = "c AS (SELECT i + 4 * j + 20 * k AS id, i, j, k, x + 0.25 AS x, y + 0.5 AS y, z + 1.0 AS z, (x + 0.25) * (y + 0.5) + (z + 1.0) + w AS f, x AS x0, y AS y0, z AS z0 FROM v WHERE i < 4 AND j < 5 AND k < (SELECT max(k) FROM v))"
_CV = "cv AS (SELECT c.id AS cell_id, f.* FROM c JOIN f ON f.i BETWEEN c.i AND c.i + 1 AND f.j BETWEEN c.j AND c.j + 1 AND f.k BETWEEN c.k AND c.k + 1)"
_MESH = f"WITH {_V}, {_F}, {_C}, {_CV}"


def _mesh(spark, sf) -> ms.Mesh:
    orders = read(spark, sf, "orders").select(F.col("o_orderkey").alias("vertex_id"), (F.sqrt("o_totalprice") / 100).alias("w"))
    m = ms.uniform(spark, (5, 6, orders.count() // 30), spacing=(0.5, 1.0, 2.0))
    f = F.col("x") * F.col("y") + F.col("z") + F.col("w")
    lowest = m.cells.withColumn("vertex_id", F.col("conn")[0])
    m.vertices, m.cells = (ms.joined(df, orders, ["vertex_id"]).withColumn("f", f) for df in (m.vertices, lowest))
    m.cells = m.cells.drop("vertex_id")
    return m


@query(_MESH + " SELECT cell_id, round(avg(f), 6) AS f FROM cv GROUP BY 1")
def mesh_recenter_v2e(spark, sf):
    return ms.to_cells(_mesh(spark, sf), "f").select("cell_id", F.round("f", 6).alias("f"))


@query(_MESH + " SELECT cv.id AS vertex_id, round(avg(c.f), 6) AS f FROM cv JOIN c ON c.id = cv.cell_id GROUP BY 1")
def mesh_recenter_e2v(spark, sf):
    return ms.to_vertices(_mesh(spark, sf), "f").select("vertex_id", F.round("f", 6).alias("f"))


_SLOPE = "(coalesce(lead({f}) OVER {w}, {f}) - coalesce(lag({f}) OVER {w}, {f})) / (coalesce(lead({c}) OVER {w}, {c}) - coalesce(lag({c}) OVER {w}, {c}))"
_WINDOWS = "WINDOW wi AS (PARTITION BY j, k ORDER BY i), wj AS (PARTITION BY i, k ORDER BY j), wk AS (PARTITION BY i, j ORDER BY k)"


def _slope(f: str, c: str) -> str:
    return _SLOPE.format(f=f, c=c, w={"x": "wi", "y": "wj", "z": "wk"}[c])


@query(_MESH + f" SELECT id AS vertex_id, round({_slope('f', 'x')}, 6) AS dx, round({_slope('f', 'y')}, 6) AS dy, round({_slope('f', 'z')}, 6) AS dz FROM f {_WINDOWS}")
def mesh_gradient(spark, sf):
    out = ms.gradient(_mesh(spark, sf).vertices, "f")
    return out.select("vertex_id", *(F.round(F.col(f"gradient.{c}"), 6).alias(f"d{c}") for c in "xyz"))


_VEC = _MESH + ", u AS (SELECT *, x * y + w AS p, y * z AS q, z * x AS r FROM f)"


def _vector_mesh(spark, sf) -> DataFrame:
    x, y, z, w = (F.col(c) for c in "xyzw")
    return _mesh(spark, sf).vertices.withColumn("v", vectors.vector(x * y + w, y * z, z * x))


@query(_VEC + f" SELECT id AS vertex_id, round({_slope('p', 'x')} + {_slope('q', 'y')} + {_slope('r', 'z')}, 6) AS value FROM u {_WINDOWS}")
def mesh_divergence(spark, sf):
    return ms.divergence(_vector_mesh(spark, sf), "v").select("vertex_id", F.round("divergence", 6).alias("value"))


_CURL = _VEC + f" SELECT id AS vertex_id, round({_slope('r', 'y')} - {_slope('q', 'z')}, 6) AS x, round({_slope('p', 'z')} - {_slope('r', 'x')}, 6) AS y, round({_slope('q', 'x')} - {_slope('p', 'y')}, 6) AS z FROM u {_WINDOWS}"


@query(_CURL)
def mesh_vorticity(spark, sf):
    return ms.vorticity(_vector_mesh(spark, sf), "v").select("vertex_id", *((F.round(F.col(f"vorticity.{c}"), 6) + 0.0).alias(c) for c in "xyz"))


_SQUARES = " + ".join(f"d{a}{b} * d{b}{a}" for a in "pqr" for b in "pqr")
_ALL = ", ".join(f"{_slope(a, c)} AS d{a}{b}" for a in "pqr" for b, c in zip("pqr", "xyz", strict=True))


@query(_VEC + f", d AS (SELECT id, {_ALL} FROM u {_WINDOWS}) SELECT id AS vertex_id, round(-0.5 * ({_SQUARES}), 4)::DOUBLE + 0.0::DOUBLE AS value FROM d")
def mesh_qcriterion(spark, sf):
    return ms.qcriterion(_vector_mesh(spark, sf), "v").select("vertex_id", (F.round("qcriterion", 4) + 0.0).alias("value"))


@query(_MESH + " SELECT min(x)::DOUBLE AS min_x, max(x)::DOUBLE AS max_x, min(y)::DOUBLE AS min_y, max(y)::DOUBLE AS max_y, min(z)::DOUBLE AS min_z, max(z)::DOUBLE AS max_z FROM v")
def mesh_bounds(spark, sf):
    return rd.bounds(_mesh(spark, sf).vertices, ["x", "y", "z"])


@query(_MESH + " SELECT id AS cell_id, 0.5::DOUBLE AS dx, 1.0::DOUBLE AS dy, 2.0::DOUBLE AS dz, 1.0::DOUBLE AS volume FROM c")
def mesh_measures(spark, sf):
    return ms.measures(_mesh(spark, sf)).select("cell_id", "dx", "dy", "dz", "volume")


_AT = "CASE WHEN x / 0.5 BETWEEN 0 AND 4 AND y BETWEEN 0 AND 5 AND z / 2.0 BETWEEN 0 AND km THEN least(floor(x / 0.5), 3)::INT + 4 * least(floor(y), 4)::INT + 20 * least(floor(z / 2.0), km - 1)::INT END"
_TOP = "m AS (SELECT max(k) AS km FROM v)"


@query(_MESH + f""", {_TOP}, p AS (SELECT s::INT AS sample, -1 + s * (3.5 / 11.0::DOUBLE) AS x, 0.5::DOUBLE + s * (4 / 11.0::DOUBLE) AS y, 1.0::DOUBLE + s * (89 / 11.0::DOUBLE) AS z FROM range(12) AS r(s)),
l AS (SELECT p.*, {_AT} AS at FROM p, m)
SELECT l.sample, round(l.x, 6)::DOUBLE AS x, round(coalesce(c.f, -1), 6)::DOUBLE AS f FROM l LEFT JOIN c ON c.id = l.at""")
def lineout(spark, sf):
    return ms.lineout(_mesh(spark, sf), 10, (-1, 0.5, 1), (2.5, 4.5, 90), ["f"], -1.0).select("sample", F.round("x", 6).alias("x"), F.round("f", 6).alias("f"))


@query(_MESH + f""", {_TOP}, p AS (SELECT id AS point_id, -0.75 + (id % 5) * 0.75 AS x, 0.25 + ((id // 5) % 4) * 1.5 AS y, 1.0 + (id // 20) * 30.0 AS z FROM range(60) AS r(id)),
l AS (SELECT p.*, {_AT} AS at FROM p, m)
SELECT l.point_id, round(coalesce(c.f, 0), 6)::DOUBLE AS f FROM l LEFT JOIN c ON c.id = l.at""")
def uniform_grid(spark, sf):
    return ms.uniform_grid(_mesh(spark, sf), ["f"], (5, 4, 3), (-0.75, 0.25, 1.0), (0.75, 1.5, 30.0)).select("point_id", F.round("f", 6).alias("f"))


@query(_MESH + " SELECT l::INT AS level, round(min(f) + l * (max(f) - min(f)) / 5, 6) AS value FROM f, range(1, 5) AS r(l) GROUP BY l")
def contour_levels(spark, sf):
    return ms.contour_levels(_mesh(spark, sf).vertices, "f", 4).select("level", F.round("value", 6).alias("value"))


@query(_MESH + ", r AS (SELECT cell_id, min(f) AS lo, max(f) AS hi FROM cv GROUP BY 1) SELECT cell_id, v.value::DOUBLE AS value FROM r, (VALUES (6.25), (12.5)) AS v(value) WHERE lo < v.value AND hi >= v.value")
def contour_cells(spark, sf):
    return ms.contour_cells(_mesh(spark, sf), "f", [6.25, 12.5]).select("cell_id", "value")


_ACROSS = "((x - 1) + (y - 2.5) * 0.5 + (z - 40) * 0.25)"
ACROSS = ((1, 2.5, 40), (1, 0.5, 0.25))


@query(_MESH + f" SELECT cell_id FROM cv GROUP BY 1 HAVING min{_ACROSS} <= 0 AND max{_ACROSS} >= 0")
def slice_cells(spark, sf):
    return ms.slice_cells(_mesh(spark, sf), sl.plane(*ACROSS)).select("cell_id")


@query(_MESH + " SELECT id AS cell_id, 'x' AS axis FROM c WHERE i = 1 UNION ALL SELECT id, 'y' FROM c WHERE j = 2 UNION ALL SELECT id, 'z' FROM c WHERE k = 20")
def three_slice(spark, sf):
    return ms.three_slice(_mesh(spark, sf), (0.85, 2.5, 41.0)).select("cell_id", "axis")


@query(_MESH + " SELECT cell_id FROM cv GROUP BY 1 HAVING bool_or(f BETWEEN 10 AND 14)")
def threshold_vertex_field(spark, sf):
    m = _mesh(spark, sf)
    return sl.cells_in_range(m.cells, m.vertices, "f", 10, 14).select("cell_id")


@query(_MESH + " SELECT cell_id FROM cv GROUP BY 1 HAVING bool_and((x - 1) * (x - 1) + (y - 2.5) * (y - 2.5) + (z - 40) * (z - 40) <= 25)")
def threshold_cells_sphere(spark, sf):
    m = _mesh(spark, sf)
    return sl.cells_inside(m.cells, m.vertices, sl.sphere((1, 2.5, 40), 5.0)).select("cell_id")


@query(_MESH + " SELECT DISTINCT cv.id AS vertex_id FROM cv JOIN c ON c.id = cv.cell_id WHERE c.f BETWEEN 8 AND 9")
def clean_grid(spark, sf):
    m = _mesh(spark, sf)
    return sl.clean_grid(m.vertices, sl.threshold(m.cells, "f", 8, 9)).select("vertex_id")


@query(_MESH + """ SELECT count(*) AS faces, count(DISTINCT cell_id) AS cells FROM (
SELECT id AS cell_id FROM c WHERE i IN (0, 3) UNION ALL SELECT id FROM c WHERE j IN (0, 4) UNION ALL SELECT id FROM c WHERE k = 0 OR k = (SELECT max(k) FROM c))""")
def mesh_boundary(spark, sf):
    return ms.boundary(_mesh(spark, sf).cells).agg(F.count("*").alias("faces"), F.countDistinct("cell_id").alias("cells"))


@query(_MESH + """, t(odd, part, corners) AS (VALUES (0, 0, [0, 1, 3, 4]), (0, 1, [1, 2, 3, 6]), (0, 2, [1, 4, 5, 6]), (0, 3, [3, 4, 6, 7]), (0, 4, [1, 3, 4, 6]),
(1, 0, [1, 0, 2, 5]), (1, 1, [0, 3, 2, 7]), (1, 2, [0, 5, 4, 7]), (1, 3, [2, 5, 7, 6]), (1, 4, [0, 2, 5, 7]))
SELECT c.id AS cell_id, t.part::INT AS part, array_to_string(list_transform(t.corners, lambda n: c.i + 5 * c.j + 30 * c.k + [0, 1, 6, 5, 30, 31, 36, 35][n + 1]), ' ') AS conn FROM c JOIN t ON t.odd = (c.i + c.j + c.k) % 2""")
def triangulate(spark, sf):
    return ms.split(_mesh(spark, sf).cells).select("cell_id", "part", F.array_join(F.transform("conn", lambda v: v.cast("string")), " ").alias("conn"))


@query(f"SELECT {_KEYS}, round(l_quantity * 2 + 1, 6) AS x, round(l_discount * 3 - l_tax, 6) AS y, round(l_tax + 0.5, 6) AS z FROM lineitem")
def transform_affine(spark, sf):
    matrix = [2, 0, 0, 1, 0, 3, -1, 0, 0, 0, 1, 0.5, 0, 0, 0, 1]
    return ms.transform(_points(spark, sf), matrix=matrix).select(*LINE_KEYS, *(F.round(c, 6).alias(c) for c in "xyz"))


@query(f"SELECT {_KEYS}, round(-l_discount, 6) AS x, round(l_quantity, 6) AS y FROM lineitem")
def transform_rotate(spark, sf):
    return ms.transform(_points(spark, sf), rotate=(90.0, (0, 0, 1))).select(*LINE_KEYS, (F.round("x", 6) + 0.0).alias("x"), F.round("y", 6).alias("y"))


@query(f"SELECT {_KEYS}, round(50 - l_quantity, 6) AS x FROM lineitem")
def reflect(spark, sf):
    return ms.reflect(_points(spark, sf), 25, "x").select(*LINE_KEYS, F.round("x", 6).alias("x"))


@query("""WITH m AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi, count(*) AS n FROM orders),
s AS (SELECT o_orderkey, least(floor((o_totalprice - lo) / (hi - lo) * 65536), 65535)::INT AS place FROM orders, m),
g AS (SELECT place, count(*) AS c FROM s GROUP BY place),
c AS (SELECT place, (sum(c) OVER (ORDER BY place) - c)::BIGINT AS before FROM g)
SELECT o_orderkey, (before * 4 // n)::INT AS new_domain_id FROM s JOIN c USING (place), m""")
def partition_domains(spark, sf):
    return ms.partition(read(spark, sf, "orders"), 4, "o_totalprice").select("o_orderkey", "new_domain_id")


@query("WITH f AS (SELECT o_orderkey AS i FROM orders WHERE o_orderstatus = 'F') SELECT o_custkey AS i, (o_custkey IN (SELECT i // 2 FROM f))::INT AS ghost FROM (SELECT DISTINCT o_custkey FROM orders)")
def nestset_ghosts(spark, sf):
    """Customers' keys as places of a coarse grid, keys of finished orders as those of one twice as fine."""
    orders = read(spark, sf, "orders")
    coarse = orders.select(F.col("o_custkey").alias("i")).distinct()
    return ms.paint_ghosts(coarse, orders.filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("i")), 2, axes=1)


@query("""WITH t AS (SELECT l_orderkey AS cell_id, l_returnflag AS material, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2), f AS (SELECT *, q / sum(q) OVER (PARTITION BY cell_id) AS vol_frac FROM t)
SELECT cell_id, first(material ORDER BY vol_frac DESC, material) AS material, round(max(vol_frac), 9) AS vol_frac FROM f GROUP BY 1""")
def mir_dominant(spark, sf):
    q = read(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("cell_id"), F.col("l_returnflag").alias("material")).agg(F.sum("l_quantity").alias("q"))
    rows = q.select(F.lit(0).alias("domain_id"), "cell_id", "material", (F.col("q") / F.sum("q").over(Window.partitionBy("cell_id"))).alias("vol_frac"))
    return ms.dominant_material(rows).select("cell_id", "material", F.round("vol_frac", 9).alias("vol_frac"))


@query("SELECT 'n' AS domain, n_nationkey AS key, n_name AS name, NULL::INT AS only_there FROM nation UNION ALL SELECT 'r', r_regionkey, r_name, r_regionkey FROM region")
def union_domains(spark, sf):
    n = read(spark, sf, "nation").select(F.lit("n").alias("domain"), F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"))
    r = read(spark, sf, "region").select(F.lit("r").alias("domain"), F.col("r_regionkey").alias("key"), F.col("r_name").alias("name"), F.col("r_regionkey").alias("only_there"))
    return tables.union_domains([n, r])


@query("""SELECT p_partkey, p_size AS s_size, p_brand AS s_brand, '[' || p_partkey || ',' || p_size || ']' AS pair FROM part""")
def flatten_rows(spark, sf):
    rows = read(spark, sf, "part").select("p_partkey", F.struct(F.col("p_size").alias("size"), F.col("p_brand").alias("brand")).alias("s"), F.array("p_partkey", "p_size").alias("pair"))
    return tables.flattened(rows)


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def windowed_counts(spark, sf):
    out = cycles.windowed(read(spark, sf, "events"), "ts", "1 hour", "10 minutes", ["event_type"], F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.select("start", "event_type", "n", "total")


@query("""WITH q AS (SELECT count(*) AS n, avg(l_quantity) AS a FROM lineitem) SELECT 'sum' AS name, round((SELECT sum(l_quantity) FROM lineitem), 4) AS value
UNION ALL SELECT 'shifted', round(a * 2 + 1, 4) FROM q UNION ALL SELECT 'spread', (SELECT max(l_quantity) - min(l_quantity) FROM lineitem)""")
def query_actions(spark, sf):
    engine = Engine(history=History()).publish(Data(read(spark, sf, "lineitem"), keys=tuple(LINE_KEYS), state={"cycle": 1, "time": 1.0}))
    q = {"sum": "sum(field('l_quantity'))", "mean": "avg(field('l_quantity'))", "shifted": "mean * 2 + 1", "spread": "max(field('l_quantity')).value - min(field('l_quantity')).value"}
    info = engine.execute([{"action": "add_queries", "queries": {n: {"params": {"expression": e, "name": n}} for n, e in q.items()}}])
    rows = [(n, round(info["expressions"][n], 4)) for n in ("sum", "shifted", "spread")]
    return spark.createDataFrame(rows, "name string, value double")


# -- geometry: a plane cuts boxes, so areas and volumes are sums over their corners

_BOX = """, o AS (SELECT c.*, {d} AS d FROM c), e(sign, a) AS (VALUES {corners}),
s AS (SELECT o.id AS cell_id, sum(e.sign * greatest(o.d - e.a, 0) ** {power}) AS total FROM o, e GROUP BY 1)"""


def _box(d: str, sides: tuple, power: int) -> str:
    """Sums over a box's corners of powers of how far each lies below a plane."""
    corners = ", ".join(f"({(-1) ** sum(k)}, {sum(s for s, on in zip(sides, k, strict=True) if on)}::DOUBLE)" for k in ((a, b, c) for a in (0, 1) for b in (0, 1) for c in (0, 1)))
    return _BOX.format(d=d, corners=corners, power=power)


# x + 2 y + 3 z over cells of 0.5 by 1 by 2
_TILTED = "x0 + 2 * y0 + 3 * z0"


@query(" UNION ALL ".join(f"(SELECT * FROM ({_MESH}{_box(f'{level} - ({_TILTED})', (0.5, 2, 6), 2)} SELECT cell_id, {level}::DOUBLE AS level, round(sqrt(14) / 12 * total, 5) AS area FROM s) WHERE area > 0.00002)" for level in (20.25, 41.5)))
def contour_triangles(spark, sf):
    shapes = gm.measure(gm.contour(_mesh(spark, sf), F.col("x") + 2 * F.col("y") + 3 * F.col("z"), [20.25, 41.5]))
    return shapes.groupBy("cell_id", "level").agg(F.round(F.sum("size"), 5).alias("area")).filter("area > 0.00002")


_BELOW = "-((x0 - 1) + (y0 - 2.5) * 0.5 + (z0 - 40) * 0.25)"


@query(_MESH + _box(_BELOW, (0.5, 0.5, 0.5), 3) + " SELECT cell_id, round(total / 0.75, 5) + 0.0 AS fraction FROM s")
def clip_fractions(spark, sf):
    return gm.clipped_volume(_mesh(spark, sf), sl.plane(*ACROSS)).select("cell_id", (F.round("fraction", 5) + 0.0).alias("fraction"))


def _whole(shapes: DataFrame) -> DataFrame:
    """Sizes by cell, and whether the field x at each corner is the corner's x."""
    off = F.aggregate(F.transform("x", lambda v, k: F.abs(v - F.get("points", k * 3))), F.lit(0.0), lambda a, b: F.greatest(a, b))
    return shapes.withColumn("off", off).groupBy("cell_id").agg(F.round(F.sum("size"), 5).alias("size"), (F.max("off") < 1e-9).alias("same"))


@query(_MESH + _box(_BELOW, (0.5, 0.5, 0.5), 3) + " SELECT cell_id, round(total / 0.75, 5) + 0.0 AS size, true AS same FROM s WHERE total > 0.00002")
def clip_cells(spark, sf):
    pieces = gm.clipped(_mesh(spark, sf), sl.plane(*ACROSS), fields=("x",))
    return _whole(gm.volume(pieces)).filter("size > 0.00002 / 0.75")


_UP, _DOWN = f"3 + {_BELOW}", f"-2 + {_BELOW}"


@query(_MESH + _box(_UP, (0.5, 0.5, 0.5), 3) + ", t AS (SELECT * FROM s)" + _box(_DOWN, (0.5, 0.5, 0.5), 3).replace(", o AS", ", o2 AS").replace(", e(", ", e2(").replace("s AS (", "s2 AS (").replace("o.", "o2.").replace("e.", "e2.").replace("FROM o, e", "FROM o2, e2")
       + " SELECT cell_id, round((t.total - s2.total) / 0.75, 5) + 0.0 AS size, true AS same FROM t JOIN s2 USING (cell_id) WHERE round((t.total - s2.total) / 0.75, 5) > 0.0001")
def isovolume_cells(spark, sf):
    value = (F.col("x") - 1) + (F.col("y") - 2.5) * 0.5 + (F.col("z") - 40) * 0.25
    pieces = gm.clipped(_mesh(spark, sf), value, 3.0, -2.0, fields=("x",))
    return _whole(gm.volume(pieces)).filter("size > 0.0001")


@query(_MESH + _box(_BELOW, (0.5, 0.5, 0.5), 2) + " SELECT cell_id, round(total * sqrt(1.3125) / 0.25, 5) + 0.0 AS size, true AS same FROM s WHERE round(total * sqrt(1.3125) / 0.25, 5) > 0.0001")
def slice_areas(spark, sf):
    shapes = gm.measure(gm.contour(_mesh(spark, sf), sl.plane(*ACROSS), [0.0], fields=("x",)))
    return _whole(shapes).filter("size > 0.0001")


# steps of 0.1 by Runge and Kutta: for speeds that are linear in place, powers of the step up to the fourth


@query("""WITH RECURSIVE r AS (SELECT o_orderkey AS seed_id, 0 AS step, sqrt(o_totalprice) / 100 AS x, 0.0::DOUBLE AS y, 0.0::DOUBLE AS z FROM orders
UNION ALL SELECT seed_id, step + 1, x * (1 - 0.005 + 0.0001 / 24) - y * (0.1 - 0.001 / 6), y * (1 - 0.005 + 0.0001 / 24) + x * (0.1 - 0.001 / 6), z + 0.01 FROM r WHERE step < 20)
SELECT seed_id, step::INT AS step, round(x, 6) AS x, round(y, 6) + 0.0 AS y, round(z, 6) AS z FROM r""")
def streamlines(spark, sf):
    seeds = read(spark, sf, "orders").select(F.col("o_orderkey").alias("seed_id"), (F.sqrt("o_totalprice") / 100).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"))
    return gm.advect(seeds, _swirl, 20, 0.1).select("seed_id", "step", F.round("x", 6).alias("x"), (F.round("y", 6) + 0.0).alias("y"), F.round("z", 6).alias("z"))


def _swirl(at):
    import numpy as np

    return np.stack([-at[:, 1], at[:, 0], np.full(len(at), 0.1)], 1)


@query("""WITH RECURSIVE r AS (SELECT o_orderkey AS seed_id, 0 AS step, 0.2 + (o_orderkey % 7) * 0.2::DOUBLE AS x, 0.5 + (o_orderkey % 5) * 0.7::DOUBLE AS y, 1.0 + (o_orderkey % 40)::DOUBLE AS z FROM orders WHERE o_orderkey % 10 = 0
UNION ALL SELECT seed_id, step + 1, x + 0.1 * (0.1 * y * (1 - 0.00005 / 6) + 0.1 * (0.1 - 0.05 * x) * (0.05 - 0.000005 / 24)), y + 0.1 * ((0.1 - 0.05 * x) * (1 - 0.00005 / 6) - 0.05 * 0.1 * y * (0.05 - 0.000005 / 24)), z + 0.05 FROM r WHERE step < 10)
SELECT seed_id, step::INT AS step, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z FROM r""")
def field_streamlines(spark, sf):
    m = _mesh(spark, sf)
    m.vertices = m.vertices.withColumn("v", vectors.vector(F.col("y") * 0.1, 0.1 - F.col("x") * 0.05, F.lit(0.5)))
    key = F.col("o_orderkey")
    seeds = read(spark, sf, "orders").filter(key % 10 == 0).select(key.alias("seed_id"), (0.2 + (key % 7) * 0.2).alias("x"), (0.5 + (key % 5) * 0.7).alias("y"), (1.0 + (key % 40)).alias("z"))
    return gm.paths(seeds, m, "v", 10, 0.1).select("seed_id", "step", *(F.round(c, 6).alias(c) for c in "xyz"))


@query(_MESH + """, m AS (SELECT min(z) AS low, (max(z) - min(z)) / 4 AS step, min(f) AS least, max(f) - min(f) AS width FROM c),
b AS (SELECT round((z - low) / step)::INT AS level, least(trunc((f - least) * (16 / width)), 15)::INT AS bin FROM c, m),
n AS (SELECT level, bin, count(*) AS n FROM b WHERE level BETWEEN 1 AND 3 GROUP BY 1, 2),
e AS (SELECT level, -sum(p * ln(p)) AS entropy FROM (SELECT level, n / sum(n) OVER (PARTITION BY level) AS p FROM n) GROUP BY 1)
SELECT level, round(low + level * step, 6) AS position, round(entropy, 6) AS entropy FROM e, m ORDER BY round(entropy, 9) DESC, level LIMIT 1""")
def auto_slice(spark, sf):
    return ms.auto_slice(_mesh(spark, sf), "f", 3, "z", 16).select("level", F.round("position", 6).alias("position"), F.round("entropy", 6).alias("entropy"))


def flagship(spark, sf: str) -> DataFrame:
    """Mean price by quantity and discount, over a grid."""
    return QUERIES["binning_avg_2d"](spark, sf)


from . import fieldwork as fieldwork  # noqa: E402  these register their queries, which are built on those above
from . import meshwork as meshwork  # noqa: E402
from . import programs as programs  # noqa: E402

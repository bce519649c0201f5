"""Registered queries that go through programs: expressions and actions.

Each returns rows of names and values, or the rows that a pipeline leaves.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import vectors
from .operators import geometry as gm
from .operators import mesh as ms
from .operators import selection as sl
from .plans.actions import Engine, load_session
from .plans.evaluate import Data, Evaluator, History
from .queries import _BELOW, _CURL, _HIST, _KEYS, _MESH, ACROSS, LINE_KEYS, _box, _mesh, query, read
from .sources import tables
from .streaming import cycles


def _values(spark: SparkSession, found: dict) -> DataFrame:
    return spark.createDataFrame([(k, round(float(v), 6)) for k, v in found.items()], "name string, value double")


def _all(of: str, **said) -> str:
    return " UNION ALL ".join(f"SELECT '{k}' AS name, round(({v})::DOUBLE, 6) AS value {of}" for k, v in said.items())


_SCALARS = {
    "abs": ("abs(tax - 1)", "abs(tax - 1)"), "exp": ("exp(tax)", "exp(tax)"), "pow": ("pow(quantity, 2)", "quantity * quantity"), "log": ("log(quantity)", "ln(quantity)"),
    "min": ("min(tax, quantity)", "least(tax, quantity)"), "max": ("max(tax, 3)", "greatest(tax, 3)"), "modulo": ("17 % 5 + tax", "2 + tax"), "unary": ("-quantity + 1", "1 - quantity"),
    "compare": ("if tax >= quantity or not tax == quantity and 1 != 2 then 5 else 6", "CASE WHEN tax >= quantity OR tax <> quantity THEN 5 ELSE 6 END"),
    "ordered": ("if tax <= quantity and quantity > 3 and not tax > quantity then tax else quantity", "CASE WHEN tax <= quantity AND quantity > 3 THEN tax ELSE quantity END"),
    "nan": ("max(replace([1, nan(), tax], nan(), 7))", "7"), "vector": ("magnitude(vector(quantity, tax, 2))", "sqrt(quantity * quantity + tax * tax + 4)"),
    "vectors": ("magnitude(vector(quantity, 2, 3) - vector(tax, 0, 1) + vector(0, 1, 0))", "sqrt((quantity - tax) * (quantity - tax) + 9 + 4)"),
    "attribute": ("vector(quantity, tax, 2).y", "tax"), "array_sum": ("sum([1, tax, quantity])", "1 + tax + quantity"), "array_avg": ("avg([1, tax, quantity])", "(1 + tax + quantity) / 3"),
    "array_min": ("min([1, tax, quantity])", "least(1, tax, quantity)"), "array_max": ("max([1, tax, quantity])", "greatest(1, tax, quantity)"),
    "index": ("places = [1, tax, quantity]\nplaces[2]", "quantity"), "state": ("cycle() + time() * tax", "12 + 2.5 * tax"),
}


@query("WITH a AS (SELECT avg(l_tax) AS tax, avg(l_quantity) AS quantity FROM lineitem) " + _all("FROM a", **{k: v for k, (_, v) in _SCALARS.items()}))
def scalar_expressions(spark, sf):
    """Every operator and function on scalars, vectors and arrays, of two means."""
    data = Data(read(spark, sf, "lineitem"), keys=tuple(LINE_KEYS), state={"cycle": 12, "time": 2.5})
    ev = Evaluator(data, History())
    ev.query("tax", "avg(field('l_tax'))")
    ev.query("quantity", "avg(field('l_quantity'))")
    return _values(spark, {k: ev.run(e) for k, (e, _) in _SCALARS.items()})


_OF_HISTOGRAM = {
    "entropy": ("entropy(prices)", "SELECT -sum(value * ln(value)) FILTER (WHERE value > 0) FROM p"), "pdf": ("bin(pdf(prices), 5)", "SELECT value FROM p WHERE bin = 5"),
    "cdf": ("bin(cdf(prices), 40)", "SELECT value FROM d WHERE bin = 40"), "bin": ("bin(prices, 7)", "SELECT value FROM h WHERE bin = 7"),
    "bin_of": ("bin(prices, val=100000.0)", "SELECT value FROM h, m WHERE bin = least(trunc((100000 - lo) * (64 / (hi - lo))), 63)"), "counts": ("sum(prices.value)", "SELECT sum(value) FROM h"),
    "linear": ("quantile(cdf(prices), 0.3, 'linear')", "SELECT low + greatest((0.3 - below) / (value - below), 0) * width FROM f"), "lower": ("quantile(cdf(prices), 0.3, 'lower')", "SELECT low FROM f"),
    "higher": ("quantile(cdf(prices), 0.3, 'higher')", "SELECT low + width FROM f"), "midpoint": ("quantile(cdf(prices), 0.3, 'midpoint')", "SELECT low + width / 2 FROM f"),
}


@query(_HIST + "f AS (SELECT e.*, lo + bin * ((hi - lo) / 64) AS low, (hi - lo) / 64 AS width FROM e, m WHERE value >= 0.3 ORDER BY bin LIMIT 1) " + _all("", **{k: f"({v})" for k, (_, v) in _OF_HISTOGRAM.items()}))
def histogram_expressions(spark, sf):
    """What expressions make of a histogram, by the overloads that take one."""
    ev = Evaluator(Data(read(spark, sf, "orders"), keys=("o_orderkey",)), History())
    ev.query("prices", "histogram(field('o_totalprice'), num_bins=64)")
    return _values(spark, {k: ev.run(e) for k, (e, _) in _OF_HISTOGRAM.items()})


@query(f"SELECT {_KEYS}, round(3.5 * l_tax, 6) AS constant, round(exp(l_tax) + ln(l_quantity), 6) AS curves, round(sqrt(l_quantity * l_quantity + l_tax * l_tax + l_discount * l_discount), 6) AS size FROM lineitem")
def field_expressions(spark, sf):
    """Fields that expressions make: constants, functions, magnitudes of vectors."""
    data = Data(read(spark, sf, "lineitem"), keys=tuple(LINE_KEYS))
    ev = Evaluator(data)
    said = {"constant": "constant_field(3.5) * field('l_tax')", "curves": "exp(field('l_tax')) + log(field('l_quantity'))", "size": "magnitude(vector(field('l_quantity'), field('l_tax'), field('l_discount')))"}
    return data.cells.select(*LINE_KEYS, *(F.round(ev.run(e).column, 6).alias(k) for k, e in said.items()))


def _mesh_data(spark, sf) -> Data:
    m = _mesh(spark, sf)
    return Data(m.cells, m.vertices, mesh=m, topology="grid")


@query(_CURL)
def expression_curl(spark, sf):
    data = _mesh_data(spark, sf)
    x, y, z, w = (F.col(c) for c in "xyzw")
    data.vertices = data.vertices.withColumn("v", vectors.vector(x * y + w, y * z, z * x))
    data.mesh.vertices = data.vertices
    curl = Evaluator(data).run("curl(field('v'))")
    return data.vertices.select("vertex_id", *((F.round(curl.column[c], 6) + 0.0).alias(c) for c in "xyz"))


@query(_MESH + " SELECT c.id AS cell_id, round(avg(cv.w) + c.x * 1.0 + 7.0, 6) AS value FROM cv JOIN c ON c.id = cv.cell_id GROUP BY c.id, c.x")
def expression_mesh(spark, sf):
    """A vertex field brought to the cells, and attributes of the cells."""
    data = _mesh_data(spark, sf)
    data.cells = data.mesh.cells = data.cells.drop("w")
    f = Evaluator(data).run("recenter(field('w'), 'element') + topo('grid').cell.x * topo('grid').cell.volume + topo('grid').cell.surface_area")
    return data.cells.select("cell_id", F.round(f.column, 6).alias("value"))


@query(f"SELECT {_KEYS}, round(ln(l_quantity + l_tax), 6) AS logged, round((l_quantity + l_tax) * (l_quantity + l_tax), 4) AS squared FROM lineitem WHERE l_quantity + l_tax BETWEEN 10 AND (SELECT avg(l_quantity) FROM lineitem) AND l_discount >= 0.03")
def chained_pipelines(spark, sf):
    """A pipeline that starts from another one: expression, threshold, clip by a field, noop, logarithm, power."""
    steps = {
        "first": {
            "a": {"type": "expression", "params": {"expression": "field('l_quantity') + field('l_tax')", "name": "both"}},
            "b": {"type": "threshold", "params": {"field": "both", "min_value": 10.0, "max_value": "avg(field('l_quantity'))"}},
        },
        "second": {
            "pipeline": "first", "c": {"type": "clip_with_field", "params": {"field": "l_discount", "clip_value": 0.03}}, "d": {"type": "noop", "params": {}},
            "e": {"type": "log", "params": {"field": "both", "output_name": "logged"}}, "f": {"type": "power_of_field", "params": {"field": "both", "exponent": 2, "output_field": "squared"}},
        },
    }
    rows = read(spark, sf, "lineitem")
    top = rows.agg(F.avg("l_quantity")).first()[0]  # what the expression says before rows go
    steps["first"]["b"]["params"]["max_value"] = top
    engine = Engine().publish(Data(rows, keys=tuple(LINE_KEYS)))
    engine.execute([{"action": "add_pipelines", "pipelines": steps}])
    return engine.pipelines["second"].cells.select(*LINE_KEYS, F.round("logged", 6).alias("logged"), F.round("squared", 4).alias("squared"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, coalesce(round(avg(l_tax) OVER (PARTITION BY trunc((l_quantity - 1) * (10 / 50.0))), 6), 0) AS binned FROM lineitem""")
def binning_pipeline(spark, sf):
    step = {"type": "binning", "params": {"reduction_op": "avg", "reduction_field": "l_tax", "output_field": "binned", "axes": [{"field": "l_quantity", "num_bins": 10, "min_val": 1.0, "max_val": 51.0}]}}
    engine = Engine().publish(Data(read(spark, sf, "lineitem"), keys=tuple(LINE_KEYS)))
    engine.execute([{"action": "add_pipelines", "pipelines": {"p": {"f": step}}}])
    return engine.pipelines["p"].cells.select(*LINE_KEYS, F.round("binned", 6).alias("binned"))


@query(_MESH + " SELECT cell_id, round(avg(f), 6) AS f FROM cv GROUP BY 1")
def recenter_pipeline(spark, sf):
    data = _mesh_data(spark, sf)
    data.cells = data.mesh.cells = data.cells.drop("f")
    engine = Engine().publish(data)
    engine.execute([{"action": "add_pipelines", "pipelines": {"p": {"f": {"type": "recenter", "params": {"field": "f", "association": "element"}}}}}])
    return engine.pipelines["p"].cells.select("cell_id", F.round("f", 6).alias("f"))


_STATISTICS = {"n": "count(*)", "minimum": "min(o_totalprice)", "maximum": "max(o_totalprice)", "mean": "avg(o_totalprice)", "deviation": "stddev_pop(o_totalprice)"}


@query("WITH m AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders), c AS (SELECT least(trunc((o_totalprice - lo) * (16 / (hi - lo))), 15)::INT AS bin, count(*) AS n FROM orders, m GROUP BY 1) "
       + _all("FROM orders", **{k: f"round({v}, 2)" for k, v in _STATISTICS.items()}) + " UNION ALL SELECT 'bin' || bin, n::DOUBLE FROM c")
def statistics_and_histogram_extracts(spark, sf):
    engine = Engine().publish(Data(read(spark, sf, "orders"), keys=("o_orderkey",)))
    found = engine.execute([{"action": "add_extracts", "extracts": {"s": {"type": "statistics", "params": {"field": "o_totalprice"}}, "h": {"type": "histogram", "params": {"field": "o_totalprice", "bins": 16}}}}])["extracts"]
    return _values(spark, {k: round(found["s"][k], 2) for k in _STATISTICS} | {f"bin{k}": n for k, n in enumerate(found["h"]["counts"]) if n})


@query("""WITH d AS (SELECT date_diff('day', DATE '2024-01-01', ts::DATE)::BIGINT AS cycle, max(value) AS value FROM events GROUP BY 1), h AS (SELECT cycle, value, lag(value) OVER (ORDER BY cycle) AS past FROM d),
t AS (SELECT * FROM h WHERE past IS NOT NULL ORDER BY cycle LIMIT 12) SELECT cycle, coalesce(value - past > 0.05, false) AS fired, CASE WHEN value - past > 0.05 THEN round(value * 2, 6) END AS doubled FROM t""")
def engine_triggers(spark, sf):
    """A trigger over the first days, by the jump since the day before; when it fires it runs a query of its own."""
    days = cycles.by_day(read(spark, sf, "events")).orderBy("cycle").limit(13).collect()
    history, out = History(), []
    for day in days:  # one run for each cycle, as a simulation publishes it
        data = Data(spark.createDataFrame([(0, day["value"])], "cell_id long, value double"), keys=("cell_id",), state={"cycle": day["cycle"], "time": float(day["time"])})
        engine = Engine(history=history).publish(data)
        inner = [{"action": "add_queries", "queries": {"q": {"params": {"expression": "max(field('value')).value * 2", "name": "doubled"}}}}]
        top = {"action": "add_queries", "queries": {"q": {"params": {"expression": "max(field('value')).value", "name": "top"}}}}
        trigger = {"action": "add_triggers", "triggers": {"t": {"params": {"condition": "top - history('top', relative_index=1) > 0.05", "actions": inner}}}}
        info = engine.execute([top, trigger])
        fired = info["triggers"]["t"]
        out.append((day["cycle"], fired, round(info["fired"][0]["expressions"]["doubled"], 6) if fired else None))
    return spark.createDataFrame(out[1:], "cycle long, fired boolean, doubled double")


@query("SELECT 'rows' AS name, count(*)::DOUBLE AS value FROM nation UNION ALL SELECT 'seen', 2.0")
def engine_commands(spark, sf):
    """Commands and extracts that call functions."""
    engine = Engine(callbacks={"rows": lambda data: data.cells.count()}).publish(Data(read(spark, sf, "nation"), keys=("n_nationkey",)))
    info = engine.execute([
        {"action": "add_commands", "commands": {"c": {"params": {"callback": "rows"}}}},
        {"action": "add_extracts", "extracts": {"e": {"type": "python", "params": {"function": lambda data: math.sqrt(4)}}}},
    ])
    return _values(spark, {"rows": info["commands"]["c"], "seen": info["extracts"]["e"]})


@query(_MESH + " SELECT count(*)::BIGINT AS cells FROM c")
def published_mesh(spark, sf):
    """A mesh published with its topology, and a pipeline that names it."""
    engine = Engine().publish(_mesh_data(spark, sf))
    engine.execute([{"action": "add_pipelines", "pipelines": {"p": {"f": {"type": "triangulate", "params": {"topology": "grid"}}}}}])
    pieces = ms.spread(engine.pipelines["p"].cells.select("parent_cell"), "parent_cell")
    return pieces.groupBy("parent_cell").count().filter("count = 5").agg(F.count("*").alias("cells"))


@query("""WITH RECURSIVE r AS (SELECT id AS seed_id, 0 AS step, 0.5 + id * 0.25::DOUBLE AS x, 0.5 + id * 1.0::DOUBLE AS y, 1.0 + id * 2.0::DOUBLE AS z FROM range(4) AS r(id)
UNION ALL SELECT seed_id, step + 1, x + 0.05, y, z + 0.1 FROM r WHERE step < 8 AND x + 0.05 <= 2.0)
SELECT seed_id, step::INT AS step, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z FROM r""")
def streamline_pipeline(spark, sf):
    """Particles from a line of seeds, carried by a vertex field of the mesh."""
    data = _mesh_data(spark, sf)
    data.vertices = data.mesh.vertices = data.vertices.withColumn("v", vectors.vector(F.lit(0.5), F.lit(0.0), F.lit(1.0)))
    seeds = {"type": "line", "start": {"x": 0.5, "y": 0.5, "z": 1.0}, "end": {"x": 1.25, "y": 3.5, "z": 7.0}, "num_seeds": 4}
    engine = Engine().publish(data)
    engine.execute([{"action": "add_pipelines", "pipelines": {"p": {"f": {"type": "streamline", "params": {"field": "v", "num_steps": 8, "step_size": 0.1, "seeds": seeds}}}}}])
    return engine.pipelines["p"].cells.select("seed_id", "step", *(F.round(c, 6).alias(c) for c in "xyz"))


def _wedges(spark, sf) -> ms.Mesh:
    """The mesh with each cell as two wedges, of which nothing but their vertices is known."""
    m = _mesh(spark, sf)
    at = lambda *k: F.array(*(F.col("conn")[i] for i in k))
    halves = m.cells.select("cell_id", F.explode(F.array(at(0, 1, 2, 4, 5, 6), at(0, 2, 3, 4, 6, 7))).alias("conn"), "f")
    cells = halves.select((F.col("cell_id") * 2 + (F.col("conn")[1] - F.col("conn")[0] != 1).cast("int")).alias("cell_id"), "conn", "f")
    return ms.explicit(m.vertices.drop("domain_id", "i", "j", "k"), cells)


@query(_MESH + _box(_BELOW, (0.5, 0.5, 0.5), 3) + " SELECT cell_id, round(total / 0.75, 5) + 0.0 AS size FROM s WHERE round(total / 0.75, 5) > 0.0001")
def explicit_mesh(spark, sf):
    """Wedges cut by a plane: together they have what is left of each box."""
    pieces = gm.volume(gm.clipped(_wedges(spark, sf), sl.plane(*ACROSS)))
    return pieces.groupBy(F.floor(F.col("cell_id") / 2).alias("cell_id")).agg((F.round(F.sum("size"), 5) + 0.0).alias("size")).filter("size > 0.0001")


@query(_MESH + " SELECT 2 * id + h AS cell_id, round(x0 + CASE WHEN h = 0 THEN 1.0 / 3 ELSE 0.5 / 3 END, 6) AS x, round(y0 + CASE WHEN h = 0 THEN 1.0 / 3 ELSE 2.0 / 3 END, 6) AS y FROM c, (VALUES (0), (1)) AS t(h)")
def explicit_centres(spark, sf):
    return _wedges(spark, sf).cells.select("cell_id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query(_MESH + " SELECT (SELECT count(*) * 2 FROM c WHERE i IN (0, 3)) // 2 + (SELECT count(*) FROM c WHERE j IN (0, 4)) + 2 * (SELECT count(*) FROM c WHERE k = 0 OR k = (SELECT max(k) FROM c)) AS faces FROM (SELECT 1)")
def explicit_boundary(spark, sf):
    return ms.boundary(_wedges(spark, sf).cells).agg(F.count("*").alias("faces"))


@query(_MESH + """, p AS (SELECT s::INT AS sample, 0.1 + s * (1.73 / 38.0::DOUBLE) AS x, 0.3 + s * (5.41 / 38.0::DOUBLE) AS y, 1.1 + s * (77.3 / 38.0::DOUBLE) AS z FROM range(39) AS r(s)),
l AS (SELECT p.*, CASE WHEN y <= 5 THEN floor(x / 0.5)::INT + 4 * floor(y)::INT + 20 * floor(z / 2.0)::INT END AS place FROM p)
SELECT l.sample, CASE WHEN c.id IS NOT NULL THEN 2 * c.id + (l.y - c.y0 > (l.x - c.x0) / 0.5)::INT END AS cell_id, round(coalesce(c.f, -1), 6) AS f FROM l LEFT JOIN c ON c.id = l.place""")
def explicit_lineout(spark, sf):
    """Points on a line that are looked up in a mesh of wedges."""
    return ms.lineout(_wedges(spark, sf), 37, (0.1, 0.3, 1.1), (1.83, 5.71, 78.4), ["f"], -1.0).select("sample", "cell_id", F.round("f", 6).alias("f"))


@query(_MESH + """
SELECT min(id) AS vertex_id, round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(avg(z), 6) AS z, round(min_by(w, id), 6) AS w FROM f GROUP BY floor(x / 1.5), floor(y / 1.5), floor(z / 1.5)""")
def merged_points(spark, sf):
    return ms.merge_points(_mesh(spark, sf), 1.5).vertices.select("vertex_id", *(F.round(c, 6).alias(c) for c in "xyzw"))


@query(_MESH + """, s AS (SELECT id AS seed_id, x, y, z, x + 0.1 * 4 * 0.25 AS ex, z + 0.1 * 4 * 0.5 AS ez FROM v), m AS (SELECT max(x) AS mx, max(z) AS mz FROM v)
SELECT seed_id, CASE WHEN ex <= mx + 1e-9 AND ez <= mz + 1e-9 THEN round(ex - x, 6) END AS dx, CASE WHEN ex <= mx + 1e-9 AND ez <= mz + 1e-9 THEN round(ez - z, 6) END AS dz FROM s, m""")
def flow_maps(spark, sf):
    """Where a steady wind carries the vertices in four steps; those on the far sides leave."""
    m = _mesh(spark, sf)
    m.vertices = m.vertices.withColumn("v", vectors.vector(F.lit(0.25), F.lit(0.0), F.lit(0.5)))
    out = gm.flow_map(m, "v", 4, 0.1)
    return out.select("seed_id", *(F.round(F.col(f"end.{c}") - F.col(f"start.{c}"), 6).alias(f"d{c}") for c in "xz"))


@query(_MESH + """, a AS (SELECT (x + 2 * y + 2 * z) / 3 AS d, f FROM c), m AS (SELECT min(d) AS low, (max(d) - min(d)) / 5 AS step, min(f) AS least, max(f) - min(f) AS width FROM a),
b AS (SELECT round((d - low) / step)::INT AS level, least(trunc((f - least) * (256 / width)), 255)::INT AS bin FROM a, m),
n AS (SELECT level, bin, count(*) AS n FROM b WHERE level BETWEEN 1 AND 4 GROUP BY 1, 2),
e AS (SELECT level, -sum(p * ln(p)) AS entropy FROM (SELECT level, n / sum(n) OVER (PARTITION BY level) AS p FROM n) GROUP BY 1)
SELECT level, round(low + level * step, 6) AS position, round(entropy, 6) AS entropy FROM e, m ORDER BY round(entropy, 9) DESC, level LIMIT 1""")
def auto_slice_normal(spark, sf):
    return ms.auto_slice(_mesh(spark, sf), "f", 4, (1, 2, 2)).select("level", F.round("position", 6).alias("position"), F.round("entropy", 6).alias("entropy"))


@query(_MESH + """ SELECT cell_id, round((avg(f) FILTER (WHERE a = 1) - avg(f) FILTER (WHERE a = 0)) / 0.5, 6) AS dx, round(avg(f) FILTER (WHERE b = 1) - avg(f) FILTER (WHERE b = 0), 6) AS dy,
 round((avg(f) FILTER (WHERE d = 1) - avg(f) FILTER (WHERE d = 0)) / 2, 6) AS dz FROM (SELECT cv.cell_id, cv.f, cv.i - c.i AS a, cv.j - c.j AS b, cv.k - c.k AS d FROM cv JOIN c ON c.id = cv.cell_id) GROUP BY 1""")
def cell_gradient(spark, sf):
    """The slopes of a vertex field in each cell, by its corners."""
    data = _mesh_data(spark, sf)
    data.cells = data.mesh.cells = data.cells.drop("f")
    engine = Engine().publish(data)
    engine.execute([{"action": "add_pipelines", "pipelines": {"p": {"f": {"type": "gradient", "params": {"field": "f", "output_name": "d", "use_cell_gradient": "true"}}}}}])
    return engine.pipelines["p"].cells.select("cell_id", *(F.round(F.col("d")[c], 6).alias(f"d{c}") for c in "xyz"))


@query(_MESH + " SELECT id AS vertex_id, 1.0::DOUBLE AS dx, 2.0::DOUBLE AS dy, -3.0::DOUBLE AS dz FROM v")
def explicit_gradient(spark, sf):
    """The slopes of a linear field at the vertices of a mesh of wedges."""
    m = _wedges(spark, sf)
    found = ms.any_slopes(m, {"d": F.col("x") + 2 * F.col("y") - 3 * F.col("z")})
    return found.select("vertex_id", *(F.round(F.col("d")[c], 6).alias(f"d{c}") for c in "xyz"))


def _through_files(spark, sf, table: str, keys: tuple, extract: dict, read_back) -> DataFrame:
    """What read_back makes of an extract's files, before these go."""
    path = tables.scratch_path(spark)
    try:
        data = _mesh_data(spark, sf) if table == "mesh" else Data(read(spark, sf, table), keys=keys)
        Engine().publish(data).execute([{"action": "add_extracts", "extracts": {"e": {"type": extract["type"], "params": {**extract["params"], "path": path}}}}])
        rows = read_back(path)
        return spark.createDataFrame(rows.collect(), rows.schema)  # some hundreds of rows
    finally:
        tables.remove(spark, path)


@query("SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def relay_roundtrip(spark, sf):
    """Chosen fields written and loaded again."""
    extract = {"type": "relay", "params": {"fields": ["o_orderpriority", "o_totalprice"], "protocol": "csv"}}
    kinds = "o_orderpriority string, o_totalprice double"
    of = lambda path: tables.load(spark, path, "csv", kinds).groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    return _through_files(spark, sf, "orders", ("o_orderkey",), extract, of)


@query(_MESH + " SELECT (SELECT count(*) FROM c) AS cells, (SELECT count(*) FROM c) AS hexahedra, round((SELECT sum(f) FROM c), 2) AS total")
def vtk_roundtrip(spark, sf):
    """VTK files read as text: their cells, the cells' kinds, and a field's sum."""

    def of(path):
        text = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", r"(?s)^.*\nCELLS (\d+) .*\nCELL_TYPES \d+\n(.*)\nPOINT_DATA .*\nSCALARS f double 1\nLOOKUP_TABLE default\n([^A-Z]*).*$", "$1|$2|$3").alias("v"))
        part = F.split("v", r"\|")
        kinds, values = F.split(part[1], "\n"), F.filter(F.split(part[2], "\n"), lambda x: x != "")
        rows = text.select(part[0].cast("long").alias("n"), F.size(F.filter(kinds, lambda x: x == "12")).cast("long").alias("h"), F.aggregate(values, F.lit(0.0), lambda a, x: a + x.cast("double")).alias("f"))
        return rows.agg(F.sum("n").alias("cells"), F.sum("h").alias("hexahedra"), F.round(F.sum("f"), 2).alias("total"))

    return _through_files(spark, sf, "mesh", (), {"type": "vtk", "params": {}}, of)


@query("SELECT 'kept' AS name, round(max(o_totalprice) * 2, 6) AS value FROM orders UNION ALL SELECT 'cycle', 4.0")
def session_roundtrip(spark, sf):
    """Results of a run, saved and loaded for another one."""
    path = tables.scratch_path(spark)
    try:
        data = Data(read(spark, sf, "orders"), keys=("o_orderkey",), state={"cycle": 4, "time": 2.0})
        said = {"action": "add_queries", "queries": {"q": {"params": {"expression": "max(field('o_totalprice')).value", "name": "top"}}}}
        Engine().publish(data).execute([said, {"action": "save_session", "file_name": path}])
        history = load_session(spark, path)
        return _values(spark, {"kept": Evaluator(data, history).run("top * 2"), "cycle": history.of("top")[0][0]})
    finally:
        tables.remove(spark, path)

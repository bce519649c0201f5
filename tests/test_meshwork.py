"""Chained mesh actions, material interfaces and particles, against closed forms and brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridwell.functions import vectors
from gridwell.operators import geometry as gm
from gridwell.operators import materials as mt
from gridwell.operators import mesh as ms
from gridwell.operators import particles as pt
from gridwell.operators import selection as sl
from gridwell.plans.actions import ActionError, Engine
from gridwell.plans.evaluate import Data, Evaluator
from gridwell.queries import QUERIES, _mesh
from gridwell.sources import tables


def after(data, *steps):
    engine = Engine().publish(data)
    engine.execute([{"action": "add_pipelines", "pipelines": {"p": {f"f{k}": {"type": n, "params": p} for k, (n, p) in enumerate(steps)}}}])
    return engine.pipelines["p"]


@pytest.mark.parametrize(("rows", "parts"), [("1", 1), ("1", 7), ("10000", 3)])
def test_shares_of_cells_in_any_layout(spark, rows, parts):
    """A batch may hold nothing but cells outside: one cell a batch."""
    m = ms.uniform(spark, (5, 4, 3))
    m.cells = m.cells.repartition(parts)
    usual = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    try:
        got = {r["cell_id"]: r["fraction"] for r in gm.clipped_volume(m, sl.plane((1.5, 0, 0), (1, 0, 0))).collect()}
        assert gm.clipped_volume(ms.Mesh(m.vertices, m.cells.limit(0)), sl.plane((0, 0, 0), (1, 0, 0))).collect() == []
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", usual)
    assert got == pytest.approx({k: [1.0, 0.5, 0.0, 0.0][k % 4] for k in range(24)})


def test_tetrahedra_are_cells_of_their_own(spark):
    m = ms.uniform(spark, (4, 4, 4))
    data = Data(m.cells, m.vertices.withColumn("s", F.col("x") + F.col("y") + F.col("z")), mesh=ms.Mesh(m.vertices.withColumn("s", F.col("x") + F.col("y") + F.col("z")), m.cells, dims=m.dims, origin=m.origin, spacing=m.spacing))
    area = lambda d: gm.measure(d.cells).agg(F.sum("size")).first()[0]
    level = ("contour", {"field": "s", "iso_values": 4.4})
    whole = area(after(data, level))
    assert whole > 5 and area(after(data, ("triangulate", {}), level)) == pytest.approx(whole)
    cut = after(data, ("triangulate", {}))
    assert cut.cells.count() == cut.cells.select("cell_id").distinct().count() == 27 * 5 and "i" not in cut.cells.columns
    assert ms.measures(cut.mesh).agg(F.sum("volume")).first()[0] == pytest.approx(27)
    assert after(data, ("triangulate", {}), ("triangulate", {})).cells.count() == 27 * 5


def test_grids_that_moved_know_where_they_are(spark):
    m = ms.uniform(spark, (4, 4, 4))
    m.cells = m.cells.withColumn("f", F.col("x"))
    volume = lambda d: {round(r[0], 9) for r in d.cells.select(Evaluator(d).run("topo('mesh').cell.volume * constant_field(1.0)").column).collect()}
    data = Data(m.cells, m.vertices, mesh=m)
    big = after(data, ("scale", {"x_scale": 2, "y_scale": 2, "z_scale": 2}))
    assert volume(big) == {8.0} and big.mesh.spacing == (2, 2, 2)
    at = lambda d, x, y: [r["f"] for r in ms.lineout(d.mesh, 0, (x, y, 0.5), (x, y, 0.5), ["f"], -1.0).collect()]
    assert at(big, 4.5, 0.5) == [2.5, 2.5] and at(big, 6.5, 0.5) == [-1.0, -1.0]
    assert at(after(data, ("reflect", {"point": 0, "axis": "x"})), -2.2, 0.5) == [2.5, 2.5]
    turned = after(data, ("transform", {"rotate": {"angle": 90, "axis": {"x": 0, "y": 0, "z": 1}}}))
    assert not turned.mesh.spacing and at(turned, -0.5, 2.2) == [2.5, 2.5] and at(turned, 0.5, 2.2) == [-1.0, -1.0]
    # slopes of a turned grid aren't those along its lines
    turned.vertices = turned.mesh.vertices = turned.mesh.vertices.withColumn("s", 3 * F.col("x") - F.col("y"))
    got = after(Data(turned.cells, turned.vertices, mesh=turned.mesh), ("gradient", {"field": "s", "output_name": "d"})).vertices.select("d.*").collect()
    assert all(tuple(r) == pytest.approx((3, -1, 0)) for r in got)


def test_points_in_several_domains_come_once(spark):
    m = ms.uniform(spark, (3, 3, 3))
    m.cells = m.cells.withColumn("f", F.col("x")).union(m.cells.withColumn("f", F.col("x") + 100).withColumn("domain_id", F.lit(1)))
    assert [r["f"] for r in ms.lineout(m, 1, (0.5, 0.5, 0.5), (0.5, 0.5, 0.5), ["f"]).collect()] == [0.5] * 3


def test_vtk_kinds_on_each_number_of_axes(spark, tmp_path):
    points = [(k, float(k & 1), float(k >> 1 & 1), float(k >> 2 & 1)) for k in range(8)]
    vertices = spark.createDataFrame(points, "vertex_id long, x double, y double, z double")
    for axes, cells, kinds in ((ms.XYZ, [[0, 1, 2, 4], [0, 1, 3, 2, 4], [0, 1, 2, 4, 5, 6], [0, 1, 3, 2, 4, 5, 7, 6]], ["10", "14", "13", "12"]), (("x", "y"), [[0, 1, 2], [0, 1, 3, 2]], ["5", "9"])):
        m = ms.explicit(vertices, spark.createDataFrame(list(enumerate(cells)), "cell_id long, conn array<long>").coalesce(1), axes)
        path = str(tmp_path / f"v{len(axes)}")
        tables.write_vtk(m, path)
        text = "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())
        found = [x for part in text.split("CELL_TYPES ")[1:] for x in part.split("POINT_DATA")[0].split()[1:]]
        assert sorted(found) == sorted(kinds)


# -- materials


@pytest.mark.parametrize("corners", [3, 4])
def test_shares_below_a_level(corners):
    rng = np.random.default_rng(corners)
    values, level = rng.integers(0, 4, (300, corners)).astype(float), rng.choice([-1.0, 0.5, 1.0, 1.7, 3.0, 5.0], 300)
    got = mt.share_below(values, level)
    points = rng.random((300, corners, corners - 1))
    owner, shape = gm.below(values - level[:, None], points, 0.0)
    want = np.bincount(owner, mt._sizes(shape), minlength=300) / mt._sizes(points)
    assert np.allclose(got, want, atol=1e-9)


def pieces_of(spark, mesh, rows, **more):
    table = spark.createDataFrame(rows, "domain_id int, cell_id long, material string, vol_frac double")
    shapes = gm.volume(mt.interfaces(mesh, table, **more), len(mesh.axes))
    return shapes, {(r["cell_id"], r["material"]): r["size"] for r in shapes.groupBy("cell_id", "material").agg(F.sum("size").alias("size")).collect()}


def test_pieces_have_the_volumes_of_their_materials(spark):
    rng = np.random.default_rng(3)
    m = ms.uniform(spark, (4, 4, 4), spacing=(1, 2, 0.5))
    rows = []
    for cell in range(27):
        names = [list("abcde")[k] for k in range(5) if cell % (k + 2) == 0]
        rows += [(0, cell, n, float(s)) for n, s in zip(names, rng.dirichlet(np.ones(max(1, len(names)))), strict=False)]
    shapes, got = pieces_of(spark, m, rows)
    want = {(c, n): s for _, c, n, s in rows}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
    # fractions that don't add up, nulls, zeros and repeated rows; cells without any have no pieces
    _, got = pieces_of(spark, m, [(0, 1, "a", 3.0), (0, 1, "b", 0.5), (0, 1, "b", 0.5), (0, 1, "c", 0.0), (0, 2, "a", None), (0, 99, "a", 1.0)])
    assert got == {(1, "a"): pytest.approx(0.75), (1, "b"): pytest.approx(0.25)}
    assert pieces_of(spark, m, [])[1] == {}


def test_interfaces_follow_what_lies_around(spark):
    """Between a column of one material and one of another, the mixed cells between are cut across."""
    m = ms.uniform(spark, (4, 3))
    rows = [(0, k, n, s) for k in range(6) for n, s in ((("left", 1.0),), (("left", 0.25), ("right", 0.75)), (("right", 1.0),))[k % 3]]
    shapes, got = pieces_of(spark, m, rows)
    assert got[1, "left"] == pytest.approx(0.25)
    side = shapes.filter("cell_id IN (1, 4) AND material = 'left'").select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(2)), lambda k: F.get("points", k * 2))).alias("x")).agg(F.min("x"), F.max("x")).first()
    assert side[0] == pytest.approx(1.0) and side[1] == pytest.approx(1.25, abs=1e-4)
    # a vertex field goes on to the pieces
    m.vertices = m.vertices.withColumn("g", 2 * F.col("x") + F.col("y"))
    shapes, _ = pieces_of(spark, m, rows, fields=("g",))
    off = F.aggregate(F.transform("g", lambda g, k: F.abs(g - 2 * F.get("points", 2 * k) - F.get("points", 2 * k + 1))), F.lit(0.0), lambda a, b: F.greatest(a, b))
    assert shapes.agg(F.max(off)).first()[0] < 1e-9


def test_mir_asks_for_what_it_needs(spark):
    m = ms.uniform(spark, (2, 2, 2))
    table = spark.createDataFrame([(0, 0, "a", 0.4), (0, 0, "b", 0.6)], "domain_id int, cell_id long, material string, vol_frac double")
    data = Data(m.cells, m.vertices, mesh=m, state={"matsets": {"mats": table}})
    assert {r["material"] for r in after(data, ("mir", {"matset": "mats"})).cells.collect()} == {"a", "b"}
    assert [r["material"] for r in after(data, ("mir", {"matset": "mats", "dominant": True})).cells.collect()] == ["b"]
    for bad in ({}, {"matset": "mats", "materials": table}, {"matset": "other"}):
        with pytest.raises(ActionError):
            after(data, ("mir", bad))


# -- particles


def test_a_block_finds_the_field_as_brute_force_does():
    rng = np.random.default_rng(5)
    for d in (2, 3):
        corners = np.concatenate([rng.random((400, 1, d)) + 0.2 * rng.random((400, d + 1, d)), rng.random((400, d + 1, 1))], 2)
        corners[:5, 1] = corners[:5, 0]  # without a volume
        block = pt.Block(corners, d)
        places = rng.random((500, d)) * 1.4 - 0.1
        got = block.at(places)[:, 0]
        for q, v in zip(places, got, strict=True):
            share = np.einsum("nij,nj->ni", block.inverse, q - block.p[:, 0])
            inside = np.flatnonzero((share >= -1e-9).all(1) & (share.sum(1) <= 1 + 1e-9))
            if not len(inside):
                assert np.isnan(v)
            else:
                k = inside[0]
                assert v == pytest.approx((1 - share[k].sum()) * block.v[k, 0, 0] + share[k] @ block.v[k, 1:, 0])
    assert np.isnan(pt.Block(np.zeros((0, 4, 6)), 3).at(np.zeros((2, 3)))).all()


def wheel(mesh):
    mesh.vertices = mesh.vertices.withColumn("v", vectors.vector(-F.col("y"), F.col("x"), F.lit(0.05)))
    return mesh


def paths(rows):
    return {(r["seed_id"], r["step"]): (r["x"], r["y"], r["z"]) for r in rows.collect()}


def test_paths_through_many_blocks(spark, monkeypatch):
    m = wheel(ms.uniform(spark, (7, 7, 3), origin=(-3, -3, 0), spacing=(1, 1, 1)))
    at = [(1, 1.0, 0.0, 0.5), (2, 0.0, -2.5, 1.0), (3, 2.9, 2.9, 1.0), (4, 9.0, 0.0, 0.0), (5, None, 0.0, 0.0), (6, 3.0, 3.0, 2.0)]
    seeds = spark.createDataFrame(at, "seed_id long, x double, y double, z double")
    h, steps = 0.25, 8

    def speed(p):
        return np.array([-p[1], p[0], 0.05]) if (abs(p[:2]) <= 3 + 1e-9).all() and -1e-9 <= p[2] <= 2 + 1e-9 else np.full(3, np.nan)

    want = {}
    for k, *p in at:
        p = np.array(p, float)
        for step in range(steps + 1):
            if not np.isfinite(p).all():
                break
            want[k, step] = tuple(p)
            a = speed(p)
            b = speed(p + h / 2 * a)
            c = speed(p + h / 2 * b)
            p = p + h / 6 * (a + 2 * b + 2 * c + speed(p + h * c))
    assert 10 < len(want) < 6 * (steps + 1)
    for block, chunk in ((4096, 4096), (90, 2)):
        monkeypatch.setattr(pt, "BLOCK", block)
        monkeypatch.setattr(pt, "CHUNK", chunk)
        got = paths(pt.streamlines(seeds, m, "v", steps, h))
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
    assert paths(pt.streamlines(seeds, m, "v", 0, h)).keys() == {(k, 0) for k, x, *_ in at if x is not None}
    assert paths(pt.streamlines(seeds.limit(0), m, "v", 3, h)) == {}


def test_boxes_of_a_graded_mesh_are_halved(spark, monkeypatch):
    """Very many cells in one corner, few elsewhere: no block gets more than its bound."""
    monkeypatch.setattr(pt, "BLOCK", 60)
    edges = [0.01 * k for k in range(9)] + [1.0, 2.0]
    m = ms.rectilinear(spark, edges, edges, [0.0, 1.0])
    rows = gm.simplices(m, F.lit(0.0)).drop("values")
    boxes, dealt = pt.dealt(rows, m, lambda df: df.cache())
    most = dealt.groupBy("level", "place").count().agg(F.max("count")).first()[0]
    assert len(boxes.heavy) > 1 and most <= 60 and dealt.select("cell_id", "part").distinct().count() == rows.count()
    got = paths(pt.streamlines(spark.createDataFrame([(1, 0.005, 0.005, 0.5)], "seed_id long, x double, y double, z double"), ms.Mesh(m.vertices.withColumn("v", vectors.vector(F.lit(0.3), F.lit(0.3), F.lit(0.0))), m.cells), "v", 5, 1.0))
    assert got[1, 5] == pytest.approx((1.505, 1.505, 0.5))


def test_the_action_takes_any_mesh_and_any_size(spark, monkeypatch):
    m = wheel(ms.uniform(spark, (5, 5, 3), origin=(-2, -2, 0)))
    m.cells = m.cells.drop("i", "j", "k")
    data = Data(m.cells, m.vertices, mesh=m)
    step = ("streamline", {"field": "v", "num_steps": 4, "step_size": 0.1, "seeds": {"type": "point", "location": [1.0, 0.0, 0.5]}})
    small = paths(after(data, step).cells)
    monkeypatch.setattr(gm, "FIELD_VALUES", 10)
    assert paths(after(data, step).cells) == {k: pytest.approx(v) for k, v in small.items()} and len(small) == 5
    ends = gm.flow_map(m, "v", 2, 0.1).collect()
    assert len(ends) == 75 and 10 < sum(r["end"] is not None for r in ends) < 75


def test_grids_of_any_size_are_linear_between_vertices(spark, monkeypatch):
    """A uniform grid whose field doesn't go to every task: the same paths, by blocks of any size, and no simplices."""
    m = ms.uniform(spark, (6, 4, 9), origin=(-1, 0, 2), spacing=(0.5, 1, 0.25))
    m.vertices = m.vertices.withColumn("v", vectors.vector(F.col("y") * F.col("z") / 9, F.col("x") * F.col("z") / 9, F.sin(F.col("x") * 3 + F.col("y")) / 3))
    seeds = m.vertices.filter("vertex_id % 3 = 0").select(F.col("vertex_id").alias("seed_id"), *((F.col(c) * 0.9 + 0.07).alias(c) for c in "xyz"))
    small = paths(gm.paths(seeds, m, "v", 7, 0.3))
    monkeypatch.setattr(gm, "FIELD_VALUES", 10)
    monkeypatch.setattr(gm, "simplices", None)
    for block, chunk, rows in ((4096, 4096, 1 << 18), (7, 1, 40)):
        for name, value in (("BLOCK", block), ("CHUNK", chunk), ("ROWS_A_TASK", rows)):
            monkeypatch.setattr(pt, name, value)
        assert paths(gm.paths(seeds, m, "v", 7, 0.3)) == {k: pytest.approx(v, abs=1e-9) for k, v in small.items()}
        ends = {r["seed_id"]: tuple(r["end"]) for r in gm.carried_for(seeds, m, "v", 7, 0.3).collect()}
        assert ends == {k: pytest.approx(v, abs=1e-9) for (k, step), v in small.items() if step == 7}
    assert len({k for k, _ in small}) == 72 > len(ends) > 10


def test_charged_particles_turn_about_the_magnetic_field(spark):
    m = ms.uniform(spark, (3, 3, 3), origin=(-4, -4, -4), spacing=(4, 4, 4))
    zero = F.lit(0.0)
    m.vertices = m.vertices.withColumns({"E": vectors.vector(zero, zero, zero), "B": vectors.vector(zero, zero, F.lit(3.0))})
    seeds = spark.createDataFrame([(1, 0.0, 1.0, 0.0, 6.0, 0.0, 0.5, 2.0, 1.0, 7.0)], "seed_id long, x double, y double, z double, px double, py double, pz double, mass double, charge double, weighting double")
    rows = pt.charged(seeds, m, "E", "B", 200, 0.02).orderBy("step").toPandas()
    assert np.allclose(np.hypot(rows.px, rows.py), 6) and (rows.weighting == 7).all() and len(rows) == 201
    # radius: momentum over charge times field; period: 2 pi times mass over charge times field
    assert (rows.x.max() - rows.x.min()) / 2 == pytest.approx(2.0, rel=1e-3)
    angle = np.unwrap(np.arctan2(rows.py, rows.px))
    assert -(angle[200] - angle[0]) / (200 * 0.02) == pytest.approx(3 * 1 / 2, rel=1e-3)
    # near the speed of light the mass is greater
    slow = pt.charged(seeds, m, "E", "B", 50, 0.02, speed_of_light=3.0).orderBy("step").toPandas()
    turn = np.unwrap(np.arctan2(slow.py, slow.px))
    gamma = np.sqrt(1 + (36 + 0.25) / 4 / 9)
    assert -(turn[50] - turn[0]) == pytest.approx(1.5 / gamma, rel=1e-3)


# -- polygons, polyhedra, several topologies


def test_sides_of_polygons_share_their_vertices(spark):
    at = [(k, float(x), float(y), 2.0 * x + y) for k, (x, y) in enumerate([(0, 0), (2, 0), (3, 1), (2, 2), (0, 2), (-1, 1), (5, 0), (5, 2)])]
    vertices = spark.createDataFrame(at, "vertex_id long, x double, y double, g double")
    cells = spark.createDataFrame([(0, [0, 1, 2, 3, 4, 5], 7.0), (1, [1, 6, 7, 3, 2], 8.0)], "cell_id long, conn array<long>, f double")
    m = ms.explicit(vertices, cells, ("x", "y"))
    assert {r["cell_id"]: r["area"] for r in ms.measures(m).collect()} == pytest.approx({0: 6.0, 1: 5.0})
    out = after(Data(m.cells, m.vertices, mesh=m), ("sides", {}))
    rows = {r["cell_id"]: r for r in ms.measures(out.mesh).collect()}
    assert set(rows) == {*range(6), *range(6, 11)} and sum(r["area"] for r in rows.values()) == pytest.approx(11)
    assert {(r["parent_cell"], r["f"]) for r in rows.values()} == {(0, 7.0), (1, 8.0)}
    assert all(r["g"] == pytest.approx(2 * r["x"] + r["y"]) for r in out.vertices.collect()) and out.vertices.count() == 10
    assert ms.boundary(m.cells, 2).count() == 7 and ms.boundary(out.cells, 2).count() == 7
    size = lambda mesh: gm.measure(gm.contour(mesh, F.col("x"), [1.5, 2.5]), 2).agg(F.sum("size")).first()[0]
    assert size(out.mesh) == pytest.approx(4)
    assert after(Data(m.cells, m.vertices, mesh=m), ("triangulate", {})).cells.count() == 4 + 3


def test_a_prism_of_five_sides_as_a_polyhedron(spark):
    import math

    ring = [(math.cos(2 * math.pi * k / 5), math.sin(2 * math.pi * k / 5)) for k in range(5)]
    vertices = spark.createDataFrame([(5 * z + k, x, y, 2.0 * z) for z in (0, 1) for k, (x, y) in enumerate(ring)], "vertex_id long, x double, y double, z double")
    faces = spark.createDataFrame([(10, [0, 1, 2, 3, 4]), (11, [5, 6, 7, 8, 9]), *((k, [k, (k + 1) % 5, (k + 1) % 5 + 5, k + 5]) for k in range(5))], "face_id long, conn array<long>")
    from gridwell.operators import polytopes as pg

    solid = pg.Polyhedra(vertices, spark.createDataFrame([(3, [10, 11, 0, 1, 2, 3, 4], 1.5)], "cell_id long, faces array<long>, f double"), faces)
    data = Data.of_polyhedra(solid)
    assert data.cells.count() == 5 + 5 + 5 * 4 and {r["f"] for r in data.cells.collect()} == {1.5}
    volume = 2 * 5 / 2 * math.sin(2 * math.pi / 5)
    assert ms.measures(data.mesh).agg(F.sum("volume")).first()[0] == pytest.approx(volume)
    half = after(data, ("clip", {"plane": {"point": [0, 0, 0.5], "normal": [0, 0, -1]}, "cut": True}))
    assert gm.volume(half.cells).agg(F.sum("size")).first()[0] == pytest.approx(volume / 4)
    assert pg.polyhedron_boundary(solid).count() == 7


def test_sides_of_polyhedra_come_from_one_join(spark):
    """Cells' fields come with their faces; their sides, four times as many, aren't joined again."""
    from gridwell.operators import polytopes as pg

    vertices = spark.createDataFrame([(k, float(x), float(y), float(z)) for k, (x, y, z) in enumerate([(0, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 1)])], "vertex_id long, x double, y double, z double")
    faces = spark.createDataFrame([(k, f) for k, f in enumerate([[0, 1, 2], [0, 1, 3], [0, 2, 3], [1, 2, 3]])], "face_id long, conn array<long>")
    cells = spark.createDataFrame([(5, [0, 1, 2, 3], 1.5, "a")], "cell_id long, faces array<long>, f double, name string")
    sides = pg.polyhedron_sides(pg.Polyhedra(vertices, cells, faces)).cells.select("parent_cell", "cell_id", "conn", "f", "name")
    assert {(r["parent_cell"], r["f"], r["name"]) for r in sides.collect()} == {(5, 1.5, "a")} and sides.select("cell_id").distinct().count() == 12
    assert sides._jdf.queryExecution().optimizedPlan().toString().count("Join Inner") == 1



def test_topologies_are_told_apart(spark):
    a, b = ms.uniform(spark, (3, 3)), ms.uniform(spark, (4, 4))
    a.cells, b.cells = a.cells.withColumns({"f": F.col("x"), "both": F.lit(1.0)}), b.cells.withColumns({"g": F.col("x"), "both": F.lit(2.0)})
    data = Data.of_topologies({"a": Data(a.cells, a.vertices, mesh=a), "b": Data(b.cells, b.vertices, mesh=b)})
    ask = lambda text: Evaluator(data).run(text)
    assert ask("sum(field('f'))") == 4 and ask("sum(field('g'))") == 13.5 and ask("sum(field('both'))") == 4
    assert ask("sum(field('both') * topo('b').cell.area)") == 18
    for bad in ("sum(field('f') + field('g'))", "sum(field('f') * topo('b').cell.area)", "sum(topo('a').cell.x + topo('b').cell.x)"):
        with pytest.raises(ValueError):
            ask(bad)
    out = after(data, ("threshold", {"field": "g", "min_value": 1.0, "max_value": 2.0}), ("expression", {"expression": "field('f') + 1", "name": "more"}))
    assert out.topology == "a" and "more" in out.cells.columns and out.topologies()["b"].cells.count() == 3 and out.cells.count() == 4
    with pytest.raises(ActionError):
        after(data, ("threshold", {"field": "g", "min_value": 1.0, "max_value": 2.0, "topology": "c"}))


# -- domains put together anew


def two_domains(spark):
    """A row of six boxes, as two domains of three with vertices of their own."""
    m = ms.uniform(spark, (4, 2, 2))
    right = ms.uniform(spark, (4, 2, 2), origin=(3, 0, 0), domain_id=1)
    mesh = ms.Mesh(m.vertices.union(right.vertices), m.cells.union(right.cells))
    mesh.vertices = mesh.vertices.withColumn("g", 10 * F.col("domain_id") + F.col("x"))
    return mesh


def domains(mesh):
    """Per domain: x of the centres in order of cells; how many vertices; whether the corners lie around the centres."""
    rows = mesh.cells.select("domain_id", "cell_id", "x", F.posexplode("conn").alias("k", "vertex_id")).join(mesh.vertices.select("domain_id", "vertex_id", F.col("x").alias("vx")), ["domain_id", "vertex_id"]).collect()
    assert len(rows) == 8 * mesh.cells.count()
    for r in rows:
        assert r["vx"] == pytest.approx(r["x"] + (0.5 if r["k"] in (1, 2, 5, 6) else -0.5))
    cells, n = {}, {r["domain_id"]: (r["n"], r["low"], r["high"]) for r in mesh.vertices.groupBy("domain_id").agg(F.count("*").alias("n"), F.min("vertex_id").alias("low"), F.max("vertex_id").alias("high")).collect()}
    assert all(low == 0 and high == k - 1 for k, low, high in n.values())
    for r in sorted({(r["domain_id"], r["cell_id"], r["x"]) for r in rows}):
        assert r[1] == len(cells.setdefault(r[0], []))
        cells[r[0]].append(r[2])
    return {d: (c, n[d][0]) for d, c in cells.items()}


def test_domains_are_cut_and_put_together(spark):
    from gridwell.operators import partition as pn

    m = two_domains(spark)
    row = [k + 0.5 for k in range(6)]
    assert domains(pn.partitioned(m)) == {0: (row[:3], 16), 1: (row[3:], 16)}
    assert domains(pn.partitioned(m, target=1)) == {0: (row, 28)}
    assert domains(pn.partitioned(m, target=3)) == {0: (row[:3], 16), 1: (row[3:5], 12), 2: (row[5:], 8)}
    assert domains(pn.partitioned(m, target=6)) == {k: ([row[k]], 8) for k in range(6)}
    chosen = [{"type": "explicit", "domain_id": 1, "elements": [0, 2]}, {"type": "ranges", "ranges": [0, 0, 2, 2]}]
    assert domains(pn.partitioned(m, chosen)) == {0: ([3.5, 5.5], 16), 1: ([0.5, 2.5], 16)}
    assert domains(pn.partitioned(m, [{"type": "logical", "start": [1, 0, 0], "end": [2, 0, 0]}], 1)) == {0: ([1.5, 2.5, 4.5, 5.5], 24)}
    m.cells = m.cells.withColumn("side", F.when(F.col("x") > 1, F.col("x") % 2))
    assert domains(pn.partitioned(m, [{"type": "field", "field": "side"}])) == {0: ([2.5, 4.5], 16), 1: ([1.5, 3.5, 5.5], 24)}
    assert pn.partitioned(m, [{"type": "explicit", "elements": []}]).cells.count() == 0
    for bad in ({"target": 0}, {"selections": [{"type": "other"}]}):
        with pytest.raises(ValueError):
            pn.partitioned(m, **bad)
    out = pn.partitioned(m, target=1)
    assert {r["g"] for r in out.vertices.filter("x = 3").collect()} == {3.0}  # of two at one place, the first domain's
    assert {(r["original_domain_id"], r["original_cell_id"]) for r in out.cells.collect()} == {(d, c) for d in (0, 1) for c in range(3)}
    data = after(Data(m.cells, m.vertices, mesh=m), ("partition", {"target": 1, "mapping": 0}))
    assert "original_cell_id" not in data.cells.columns and "side" in data.cells.columns and data.cells.count() == 6


def test_unused_vertices_go_and_the_rest_is_numbered(spark):
    m = two_domains(spark)
    out = after(Data(m.cells, m.vertices, mesh=m), ("threshold", {"box": {"min": {"x": 0.9, "y": -1, "z": -1}, "max": {"x": 4.1, "y": 2, "z": 2}}}), ("clean_grid", {}))
    rows = out.cells.collect()
    assert {(r["domain_id"], r["cell_id"]) for r in rows} == {(0, 1), (0, 2), (1, 0)}
    found = {(r["domain_id"], r["vertex_id"]): r for r in out.vertices.collect()}
    assert sorted(found) == [(0, k) for k in range(12)] + [(1, k) for k in range(8)]
    for r in rows:
        assert [found[r["domain_id"], v]["x"] - r["x"] for v in r["conn"]] == pytest.approx([-0.5, 0.5, 0.5, -0.5] * 2)
    assert found[0, 0]["original_vertex_id"] == 1


# -- quality


def test_quality_of_known_shapes():
    from gridwell.operators import shapes as sh

    corners = {n: np.array(p, float) for n, p in {
        8: [(0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0), (0, 0, 1), (1, 0, 1), (1, 1, 1), (0, 1, 1)],
        6: [(0, 0, 0), (1, 0, 0), (0.5, 3**0.5 / 2, 0), (0, 0, 1), (1, 0, 1), (0.5, 3**0.5 / 2, 1)],
        5: [(0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0), (0.5, 0.5, 0.5**0.5)],
        4: [(1, 1, 1), (-1, 1, -1), (1, -1, -1), (-1, -1, 1)],
    }.items()}
    for n, p in corners.items():
        p = p if np.linalg.det([p[k] - p[0] for k in ((1, 3, 4) if n == 8 else (1, 2, 3) if n in (4, 6) else (1, 3, 4))]) > 0 else p[[0, 2, 1, *range(3, n)]]
        got = {m: v[0] for m, v in sh.measured(p[None]).items()}
        assert got["scaled_jacobian"] == pytest.approx(1) and got["edge_ratio"] == pytest.approx(1), n
        stretched = {m: v[0] for m, v in sh.measured(p[None] * np.array([1, 1, 3.0])).items()}
        assert stretched["edge_ratio"] > 1 and (n == 5 or stretched["scaled_jacobian"] <= 1 + 1e-9)
        folded = p.copy()
        folded[[0, 1]] = folded[[1, 0]]
        assert sh.measured(folded[None])["scaled_jacobian"][0] < 0.01
    box = {m: v[0] for m, v in sh.measured(corners[8][None] * np.array([1, 2, 3.0])).items()}
    assert box["jacobian"] == pytest.approx(6) and box["skew"] == pytest.approx(0) and box["diagonal_ratio"] == pytest.approx(1) and box["edge_ratio"] == pytest.approx(3)
    triangle = {m: v[0] for m, v in sh.measured(np.array([[[0, 0], [1, 0], [0, 1.0]]])).items()}
    assert triangle["min_angle"] == pytest.approx(45) and triangle["max_angle"] == pytest.approx(90) and np.isnan(triangle["skew"])
    rhombus = {m: v[0] for m, v in sh.measured(np.array([[[0, 0], [2, 0], [3, 3**0.5], [1, 3**0.5]]])).items()}
    assert rhombus["skew"] == pytest.approx(0.5) and rhombus["scaled_jacobian"] == pytest.approx(3**0.5 / 2) and rhombus["diagonal_ratio"] == pytest.approx(3**-0.5)
    assert np.isnan(sh.measured(np.zeros((2, 7, 3)))["edge_ratio"]).all()


def test_points_in_a_graded_mesh_are_found_in_halved_boxes(spark, monkeypatch):
    edges = [0.001 * k for k in range(12)] + [1.0, 2.0]
    m = ms.rectilinear(spark, edges, edges, [0.0, 1.0])
    rng = np.random.default_rng(4)
    places = np.concatenate([rng.random((60, 3)) * [0.02, 0.02, 1], rng.random((40, 3)) * [2.2, 2.2, 1]])
    points = spark.createDataFrame([(k, *map(float, p)) for k, p in enumerate(places)] + [(1000, None, 0.0, 0.0)], "p long, x double, y double, z double")
    of = lambda: {r["p"]: r["cell_id"] for r in ms.locate(points, m, "p").collect()}
    usual = of()
    at = lambda v: int(np.searchsorted(edges, v, "right")) - 1
    assert usual == {k: at(x) + 13 * at(y) for k, (x, y, _) in enumerate(places) if x <= 2 and y <= 2}
    monkeypatch.setattr(ms, "CROWDED", 3)
    monkeypatch.setattr(pt, "BLOCK", 100)
    assert of() == usual


def test_boxes_go_by_the_shape_of_a_long_grid(spark, monkeypatch):
    """Few cells across and very many along: simplices reach into a few boxes each, however long the grid is."""
    assert pt.boxes_along([2.0, 5.0, 60000.0], [0.5, 1.0, 2.0], 700) == [1, 1, 700]
    assert pt.boxes_along([10.0, 10.0], [1.0, 1.0], 25) == [5, 5]
    monkeypatch.setattr(pt, "BLOCK", 200)
    m = ms.uniform(spark, (3, 3, 401), spacing=(0.5, 1.0, 2.0))
    rows = gm.simplices(m, F.lit(0.0)).drop("values").cache()
    boxes, dealt = pt.dealt(rows, m, lambda df: df.cache())
    assert dealt.count() < 1.5 * rows.count() and dealt.groupBy("level", "place").count().agg(F.max("count")).first()[0] <= 200


def test_centres_no_one_asks_for_are_not_made(spark):
    m = ms.uniform(spark, (3, 3, 3))
    other = ms.explicit(m.vertices.drop("domain_id", "i", "j", "k"), m.cells.select("cell_id", "conn"))
    assert "Join" not in other.cells.select("domain_id", "cell_id", "conn")._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(other.cells.select("cell_id", "x", "y", "z").collect()) == sorted(m.cells.select("cell_id", "x", "y", "z").collect())


def test_vertices_come_once_to_cells_that_go_together(spark, monkeypatch):
    """Whatever the groups of ids, cells get the same corners; a vertex that isn't there is left out."""
    m = ms.uniform(spark, (4, 3, 3))
    m.vertices = m.vertices.filter("vertex_id <> 5")
    found = []
    for n in (64, 1, 5):
        monkeypatch.setattr(ms, "TOGETHER", n)
        found.append(sorted(ms.gathered(m, v=F.col("vertex_id")).collect(), key=lambda r: r["cell_id"]))
    assert found[0] == found[1] == found[2]
    conn = {r["cell_id"]: [v for v in r["conn"] if v != 5] for r in m.cells.collect()}
    assert {r["cell_id"]: [c["v"] for c in r["c"]] for r in found[0]} == conn


def test_shuffles_of_large_tables_have_more_tasks(spark, monkeypatch):
    m = ms.uniform(spark, (5, 5, 5))
    monkeypatch.setattr(ms, "BYTES_A_TASK", 32)
    many = ms.spread(m.cells, "cell_id")
    assert many.rdd.getNumPartitions() == 64 * 8 // 32
    monkeypatch.setattr(ms, "BYTES_A_TASK", 1 << 22)
    assert ms.spread(m.cells, "cell_id") is m.cells


def test_vtk_files_have_bounded_cells_and_each_vertex_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "CELLS_A_FILE", 60)
    m = ms.uniform(spark, (6, 6, 13))  # 300 cells, 25 in a layer of 36 vertices
    path = str(tmp_path / "vtk")
    tables.write_vtk(m, path)
    texts = [r["value"] for r in spark.read.text(path, wholetext=True).collect()]
    points = [int(t.split("POINTS ")[1].split()[0]) for t in texts]
    cells = [int(t.split("CELLS ")[1].split()[0]) for t in texts]
    assert sum(cells) == 300 and all(n % 60 == 0 for n in cells)
    assert all(p <= 4.5 * 36 / 60 * n for p, n in zip(points, cells, strict=True))


def test_shares_of_steep_simplices_far_from_a_level():
    """Rounding within a steep simplex was magnified by how far the level lies from it."""
    steep = np.array([[-0.9999996909435319, -0.9999991123851416, -0.999999094914303, -0.9999990160443527]])
    assert mt.share_below(steep, np.array([-0.49999945741327894]))[0] == 1.0


def test_levels_of_pieces_are_found_in_few_steps(monkeypatch):
    noise = np.random.default_rng(1)
    owner, values, size = np.repeat(np.arange(50), 3), np.sort(noise.random((150, 4)), 1), noise.random(150)
    wanted = np.bincount(owner, size) * noise.random(50)
    calls, share = [], mt._share_below
    monkeypatch.setattr(mt, "_share_below", lambda *a: calls.append(1) or share(*a))
    levels = mt._levels(owner, values.T.copy(), size, wanted)
    assert np.allclose(np.bincount(owner, size * mt.share_below(values, levels[owner])), wanted, rtol=0, atol=1e-13) and len(calls) < 40


def test_joins_of_large_tables_have_more_tasks(spark, monkeypatch):
    m = ms.uniform(spark, (5, 5, 5))
    monkeypatch.setattr(ms, "BYTES_A_TASK", 32)
    rows = ms.joined(m.cells, m.cells.select("domain_id", "cell_id", F.col("x").alias("v")), ["domain_id", "cell_id"])
    assert rows.count() == 64 and rows.rdd.getNumPartitions() == 2 * 64 * 8 // 32


def test_meshes_of_large_tables_have_more_tasks(spark, monkeypatch):
    """The tables under the mesh of the queries come together in tasks by size, and so do pieces counted by cell."""
    sf = "/root/testdata/sf0.001"
    monkeypatch.setattr(ms, "BYTES_A_TASK", 2048)
    m = _mesh(spark, sf)
    assert m.cells.rdd.getNumPartitions() > 12 and m.vertices.rdd.getNumPartitions() > 12
    plan = QUERIES["published_mesh"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [parent_cell" in plan


def test_shares_of_clipped_cells_come_from_one_pass(spark):
    """A cell's simplices meet in its own row: no shuffle of them adds them up."""
    rows = gm.clipped_volume(ms.uniform(spark, (4, 3, 3)), F.col("x") - 1.25)
    assert rows._jdf.queryExecution().optimizedPlan().nodeName() == "MapInArrow"
    assert sorted({round(r["fraction"], 9) for r in rows.collect()}) == [0.0, 0.25, 1.0]


def _piped(data, steps):
    engine = Engine().publish(data)
    engine.execute([{"action": "add_pipelines", "pipelines": {"p": steps}}])
    return engine.pipelines["p"]


def test_measures_one_after_another_come_from_one_pass(spark):
    m = ms.uniform(spark, (4, 3, 3), spacing=(0.5, 1.0, 2.0))
    steps = [("mesh_quality", {"metric": n}) for n in ("volume", "edge_ratio", "skew")]
    after = lambda data, *steps: _piped(data, {f"s{k}": {"type": t, "params": p} for k, (t, p) in enumerate(steps)})
    out = after(Data(m.cells, m.vertices, mesh=m), *steps, ("mesh_quality", {"metric": "volume", "output_name": "again"}))
    assert out.cells._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert {(r["volume"], r["edge_ratio"], r["skew"], r["again"]) for r in out.cells.collect()} == {(1.0, 4.0, 0.0, 1.0)}
    moved = after(out, ("scale", {"x_scale": 2, "y_scale": 1, "z_scale": 1}), ("mesh_quality", {"metric": "volume", "output_name": "larger"}))
    assert {(r["volume"], r["larger"]) for r in moved.cells.collect()} == {(1.0, 2.0)}

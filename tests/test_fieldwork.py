"""Rays, tree grids and flows over cycles, against closed forms and brute force."""

from math import exp
from xml.etree import ElementTree

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridwell.functions import vectors
from gridwell.operators import flows as fw
from gridwell.operators import mesh as ms
from gridwell.operators import rays as ry
from gridwell.operators import trees as tr
from gridwell.plans.actions import ActionError, Engine
from gridwell.plans.evaluate import Data
from gridwell.sources import tables


def extracted(data, **extract):
    engine = Engine().publish(data)
    return engine.execute([{"action": "add_extracts", "extracts": {"e": extract}}])["extracts"]["e"]


def by_hand(camera, px, py, low, high):
    """Where a ray comes into a box and leaves it."""
    x, y = (px + 0.5 - camera.width / 2) * camera.pixel, (py + 0.5 - camera.height / 2) * camera.pixel
    over = x * np.array(camera.right) + y * np.array(camera.above)
    start, way = np.array(camera.position), np.array(camera.ahead)
    start, way = (start + over, way) if camera.parallel else (start, (way + over) / np.linalg.norm(way + over))
    with np.errstate(all="ignore"):
        a, b = (np.array(low) - start) / way, (np.array(high) - start) / way
    return max(np.minimum(a, b).max(), 0.0), np.maximum(a, b).min()


CAMERAS = {
    "parallel": {"position": (-4, -5, -6), "look_at": (1.5, 1.4, 1.3), "up": (0, 0, 1), "scale": 3},
    "spreading": {"position": (-4, -5, -6), "look_at": (1.5, 1.4, 1.3), "up": (0, 0, 1), "fov": 25},
    "inside": {"position": (1.3, 1.4, 1.6), "look_at": (3, 2.2, 1.1), "up": (0, 0, 1), "fov": 70},
}


@pytest.mark.parametrize("name", CAMERAS)
@pytest.mark.parametrize("kind", ["boxes", "tetrahedra"])
def test_rays_by_brute_force(spark, name, kind):
    m = ms.uniform(spark, (4, 4, 4))
    m.cells = m.cells.withColumn("f", F.col("cell_id") % 5 + 1.0)
    if kind == "tetrahedra":
        m = ms.Mesh(m.vertices, m.cells)
    camera = ry.Camera.looking(**CAMERAS[name], width=9, height=7)
    got = {(r["px"], r["py"]): r for r in ry.integrals(m, camera, "f", "f").collect()}
    first = {(r["px"], r["py"]): r for r in ry.first_met(m, camera, ["f"]).collect()}
    hits = 0
    for px in range(9):
        for py in range(7):
            parts = []
            for c in range(27):
                low = np.array([c % 3, c // 3 % 3, c // 9])
                near, far = by_hand(camera, px, py, low, low + 1)
                if far - near > 1e-9:
                    parts.append((near, far, c % 5 + 1.0))
            if not parts:
                assert (px, py) not in got or got[px, py]["path"] < 1e-6
                continue
            hits += 1
            depth, sent = 0.0, 0.0
            for near, far, f in sorted(parts):
                sent += exp(-depth) * (1 - exp(-f * (far - near)))
                depth += f * (far - near)
            r = got[px, py]
            assert r["path"] == pytest.approx(sum(b - a for a, b, _ in parts), abs=1e-6)
            assert r["depth"] == pytest.approx(depth, abs=1e-6) and r["transmitted"] == pytest.approx(exp(-depth), abs=1e-6)
            assert r["emitted"] == pytest.approx(sent, abs=1e-6)
            assert first[px, py]["distance"] == pytest.approx(min(parts)[0], abs=1e-6) and first[px, py]["f"] == min(parts)[2]
    assert hits > 10 and (name != "inside" or hits == 63)


def test_rays_in_faces_count_once(spark):
    """Rays along faces and edges of cells, through boxes and through tetrahedra."""
    m = ms.uniform(spark, (4, 4, 4))
    m.cells = m.cells.withColumn("f", F.lit(2.0))
    camera = ry.Camera.looking((1, 1, 9), (1, 1, 0), width=3, height=3, scale=1.5)  # pixels at 0, 1 and 2
    for mesh in (m, ms.Mesh(m.vertices, m.cells), ms.Mesh(m.vertices.withColumn("g", F.lit(2.0)), m.cells.drop("f"))):
        rows = ry.integrals(mesh, camera, "f" if "f" in mesh.cells.columns else "g").collect()
        assert len(rows) == 9 and all(r["path"] == pytest.approx(3, abs=1e-6) and r["depth"] == pytest.approx(6, abs=1e-6) for r in rows)


def test_rays_over_odd_values_and_meshes(spark):
    m = ms.uniform(spark, (3, 2, 2))
    m.cells = m.cells.withColumn("f", F.when(F.col("cell_id") == 0, F.lit(None).cast("double")).otherwise(F.lit(float("nan"))))
    camera = ry.Camera.over(m, 4, 2)
    assert {(r["depth"], r["transmitted"], r["emitted"]) for r in ry.integrals(m, camera, "f", "f").collect()} == {(0.0, 1.0, 0.0)}
    none = ms.Mesh(m.vertices, m.cells.limit(0), m.axes, m.dims, m.origin, m.spacing)
    assert ry.integrals(none, camera, "f").collect() == [] and ry.first_met(ms.Mesh(m.vertices, m.cells.limit(0)), camera, ["f"]).collect() == []
    with pytest.raises(ValueError, match="in space"):
        ry.integrals(ms.uniform(spark, (3, 3)), camera, "f")
    with pytest.raises(ValueError, match="no field g"):
        ry.first_met(m, camera, ["g"])
    with pytest.raises(ValueError, match="either"):
        ry.Camera.looking((0, 0, 0), (1, 0, 0))
    with pytest.raises(ValueError, match="direction"):
        ry.Camera.looking((0, 0, 0), (0, 0, 0), scale=1)


def test_a_mirrored_grid_is_seen_from_the_other_side(spark):
    m = ms.uniform(spark, (3, 2, 2))
    m.cells = m.cells.withColumn("f", F.col("x"))
    camera = ry.Camera.looking((-9, 0.4, 0.4), (0, 0.4, 0.4), width=1, height=1, scale=0.1)
    assert [r["f"] for r in ry.first_met(m, camera, ["f"]).collect()] == [0.5]
    assert [(r["f"], r["distance"]) for r in ry.first_met(ms.mirrored(m, 1, "x"), camera, ["f"]).collect()] == [(1.5, 9.0)]


def test_ray_actions(spark, tmp_path):
    m = ms.uniform(spark, (3, 3, 3))
    m.vertices = m.vertices.withColumn("g", F.col("x") + F.col("z"))
    data = Data(m.cells.withColumn("f", F.lit(0.5)), m.vertices, mesh=ms.Mesh(m.vertices, m.cells.withColumn("f", F.lit(0.5)), m.axes, m.dims, m.origin, m.spacing))
    engine = Engine().publish(data)
    engine.execute([{"action": "add_pipelines", "pipelines": {"p": {"a": {"type": "project_2d", "params": {"image_width": 2, "image_height": 2}}}}}])
    assert {(r["px"], r["py"]): round(r["g"], 6) for r in engine.pipelines["p"].cells.collect()} == {(0, 0): 2.5, (0, 1): 2.5, (1, 0): 3.5, (1, 1): 3.5}
    path = extracted(data, type="xray", params={"absorption": "f", "filename": str(tmp_path / "x"), "image_width": 2, "image_height": 2})
    assert {round(r["depth"], 9) for r in tables.load(spark, path).collect()} == {1.0}
    with pytest.raises(ActionError, match="camera"):
        extracted(data, type="xray", params={"absorption": "f", "filename": "x", "camera": {"position": [0, 0, 0]}})


# -- tree grids


def tree_of(values, blank):
    """The levels of an octree over a cube of values (k, j, i), by hand: value or None, from the root down."""
    level = {(i, j, k): (None if values[k][j][i] in (blank, None) else values[k][j][i]) for k in range(len(values)) for j in range(len(values)) for i in range(len(values))}
    out = [level]
    while len(level) > 1:
        groups = {}
        for (i, j, k), v in level.items():
            groups.setdefault((i // 2, j // 2, k // 2), []).append(v)
        known = {p: [v for v in vs if v is not None] for p, vs in groups.items()}
        level = {p: sum(vs) / len(vs) if vs else None for p, vs in known.items()}
        out.append(level)
    return out[::-1]


def in_order(level, bits):
    key = lambda p: sum((p[a] >> b & 1) << (3 * b + a) for b in range(bits) for a in range(3))
    return [level[p] for p in sorted(level, key=key)]


def test_a_tree_file_by_hand(spark, tmp_path):
    m = ms.uniform(spark, (5, 5, 5), origin=(1, 2, 3), spacing=(0.5, 0.5, 0.25))
    m.cells = m.cells.withColumn("f", F.when((F.col("i") < 2) & (F.col("j") < 2) & (F.col("k") < 2), 7.0).otherwise(F.col("cell_id").cast("double"))).withColumn("s", F.lit("x"))
    data = Data(m.cells, m.vertices.withColumn("g", F.lit(1.0)), mesh=m)
    (path,) = extracted(data, type="htg", params={"path": str(tmp_path / "t"), "blank_value": 7.0})
    levels = tree_of([[[7.0 if max(i, j, k) < 2 else float(i + 4 * j + 16 * k) for i in range(4)] for j in range(4)] for k in range(4)], 7.0)
    wanted = [v for depth, level in enumerate(levels) for v in in_order(level, depth)]
    rows = tr.load(spark, path).orderBy("place").collect()
    assert {r["tree"] for r in rows} == {"d0_h2_0_0_0"}
    assert [None if r["masked"] else r["value"] for r in rows] == pytest.approx(wanted) and {r["value"] for r in rows if r["masked"]} == {7.0}
    assert [r["level"] for r in rows] == [0] + [1] * 8 + [2] * 64
    text = spark.read.text(path, wholetext=True).first()["value"]
    tree = ElementTree.fromstring(text)
    said = {a.get("Name"): a.text.split() for a in tree.iter("DataArray")}
    assert said["Descriptor"] == ["1"] * 9 and said["NbVerticesByLevel"] == ["1", "8", "64"]
    assert list(map(float, said["XCoordinates"])) == [1, 3] and list(map(float, said["ZCoordinates"])) == [3, 4]


def test_trees_go_to_files_that_hang_together(spark, tmp_path):
    """A grid of 5 by 3 by 9 cells: nodes beyond it are masked leaves, and leaves of a file are the roots of others."""
    m = ms.uniform(spark, (6, 4, 10))
    m.cells = m.cells.withColumn("f", F.col("cell_id") + 0.5)
    found = {(r["height"], r["i"], r["j"], r["k"]): r["value"] for r in tr.nodes(m, "f").collect()}
    assert sum(h == 0 for h, *_ in found) == 135 and max(h for h, *_ in found) == 4
    for (h, i, j, k), v in found.items():
        if h:
            below = [found[c] for c in ((h - 1, 2 * i + a, 2 * j + b, 2 * k + c) for a in (0, 1) for b in (0, 1) for c in (0, 1)) if c in found]
            assert v == pytest.approx(sum(below) / len(below))
    whole = tr.load(spark, tr.write(m, "f", str(tmp_path / "one"), -1.0))
    parts = tr.load(spark, tr.write(m, "f", str(tmp_path / "many"), -1.0, 1))
    for rows, heights in ((whole, 4), (parts, 1)):
        leaves = rows.filter(~F.col("masked") & F.expr("level > 0")).withColumn("h", F.regexp_extract("tree", r"_h(\d+)_", 1).cast("int") - F.col("level"))
        assert sorted(r["value"] for r in leaves.filter("h = 0").collect()) == [c + 0.5 for c in range(135)]
        assert rows.agg(F.max("level")).first()[0] == heights
    assert parts.select("tree").distinct().count() == sum(h > 0 for h, *_ in found)


def test_trees_of_odd_grids(spark, tmp_path):
    one = ms.uniform(spark, (2, 2, 2))
    one.cells = one.cells.withColumn("f", F.lit(4.0))
    rows = tr.load(spark, tr.write(one, "f", str(tmp_path / "one"), -1.0)).collect()
    assert [(r["level"], r["value"], r["masked"]) for r in rows] == [(0, 4.0, False)]
    m = ms.uniform(spark, (3, 3, 3))
    m.cells = m.cells.withColumn("f", F.lit(None).cast("double"))
    rows = tr.load(spark, tr.write(m, "f", str(tmp_path / "null"), -1.0)).collect()
    assert len(rows) == 9 and all(r["masked"] and r["value"] == -1.0 for r in rows)
    none = ms.Mesh(m.vertices, m.cells.limit(0), m.axes, m.dims, m.origin, m.spacing)
    assert tr.nodes(none, "f").collect() == [] and tr.files(none, "f", 0.0).collect() == []
    with pytest.raises(ValueError, match="uniform grid"):
        tr.nodes(ms.Mesh(m.vertices, m.cells), "f")
    with pytest.raises(ActionError, match="blank_value"):
        extracted(Data(m.cells, m.vertices, mesh=m), type="htg", params={"path": "x"})


# -- flows over cycles


def blown(spark, wind, dims=(5, 4, 3)):
    m = ms.uniform(spark, dims)
    return ms.Mesh(m.vertices.withColumn("v", vectors.vector(*(F.lit(float(w)) for w in wind))), m.cells, m.axes, m.dims, m.origin, m.spacing)


def test_intervals_of_flows(spark, tmp_path):
    """Cycles of different winds: particles go on from where they were, and begin anew after each interval."""
    path, winds = str(tmp_path / "f"), [(0.5, 0, 0), (0, 1, 0), (1, 0, 0), (0, 0, 1), (2, 0, 0)]
    for n, wind in enumerate(winds):
        rows = {r["seed_id"]: r for r in fw.advanced(blown(spark, wind), "v", path, n, 2, 4, 0.25).collect()}
        assert {r["cycles"] for r in rows.values()} == {n % 2 + 1} and len(rows) == 60
    got = {(r["cycle"], r["seed_id"]): r["end"] and tuple(round(r["end"][c], 9) for c in "xyz") for r in fw.flows(spark, path, 2).collect()}
    wanted = {}
    for c, (dx, dy, dz) in {1: (0.5, 1, 0), 3: (1, 0, 1)}.items():
        for v in range(60):
            end = (v % 5 + dx, v // 5 % 4 + dy, v // 20 + dz)
            wanted[c, v] = end if all(a <= b for a, b in zip(end, (4, 3, 2), strict=True)) else None
    assert got == wanted


def test_a_cycle_that_comes_again(spark, tmp_path):
    path = str(tmp_path / "f")
    step = lambda n, wind: {r["seed_id"]: r["end"] and r["end"]["x"] for r in fw.advanced(blown(spark, wind), "v", path, n, 3, 2, 0.25).collect()}
    step(7, (1, 0, 0))
    once = step(8, (2, 0, 0))
    assert step(8, (2, 0, 0)) == once and once[0] == pytest.approx(1.5)
    (tmp_path / "f" / "cycle=9").mkdir()  # a table that was never finished
    assert step(9, (1, 0, 0))[0] == pytest.approx(2.0) and step(10, (1, 0, 0))[0] == pytest.approx(0.5)
    assert {r["cycle"] for r in fw.flows(spark, path, 3).collect()} == {9}
    with pytest.raises(ValueError, match="one cycle"):
        fw.advanced(blown(spark, (1, 0, 0)), "v", path, 1, 0, 1, 0.1)


def test_flows_of_wedges_and_of_a_stream(spark, tmp_path):
    """A stream's batches as cycles: each is the wind on a mesh that isn't a grid."""
    from gridwell.streaming.cycles import replay

    source, path = tmp_path / "s", str(tmp_path / "f")
    grid = ms.uniform(spark, (4, 3, 3))
    for n, wind in enumerate((0.5, 1.0)):
        spark.createDataFrame([(f"2024-01-0{n + 1} 00:00:00", wind)], "ts string, w double").coalesce(1).write.mode("append").json(str(source))
    stream = spark.readStream.schema("ts string, w double").option("maxFilesPerTrigger", 1).json(str(source))

    def mesh_of(batch):
        wind = batch.agg(F.max("w")).first()[0]
        m = ms.Mesh(grid.vertices.drop("i", "j", "k").withColumn("v", vectors.vector(F.lit(wind), F.lit(0.0), F.lit(0.0))), grid.cells.drop("i", "j", "k"))
        return Data(m.cells, m.vertices, mesh=m)

    engine = Engine()
    step = {"type": "lagrangian", "params": {"field": "v", "num_steps": 2, "step_size": 0.5, "write_frequency": 2, "path": path}}
    replay(stream, engine, [{"action": "add_pipelines", "pipelines": {"p": {"f": step}}}], str(tmp_path / "c"), data=mesh_of).awaitTermination()
    got = {r["seed_id"]: r["end"] and round(r["end"]["x"] - r["start"]["x"], 9) for r in fw.flows(spark, path, 2).collect()}
    assert got == {v: 1.5 if v % 4 <= 1 else None for v in range(36)}
    with pytest.raises(ActionError, match="path"):
        Engine().publish(mesh_of(spark.createDataFrame([("x", 1.0)], "ts string, w double"))).execute([{"action": "add_pipelines", "pipelines": {"p": {"f": {"type": "lagrangian", "params": {"field": "v", "step_size": 1.0, "write_frequency": 2}}}}}])


# -- fields of vertices in actions


def test_binnings_have_one_home(spark):
    m = ms.uniform(spark, (3, 3, 3))
    data = Data(m.cells.withColumn("f", F.lit(1.0)), m.vertices.withColumn("g", F.col("x")), mesh=m)
    data.mesh = ms.Mesh(data.vertices, data.cells, m.axes, m.dims, m.origin, m.spacing)
    engine = Engine().publish(data)

    def binned(var, axis):
        step = {"type": "binning", "params": {"reduction_op": "sum", "reduction_field": var, "output_field": "b", "axes": [{"field": axis, "num_bins": 2, "min_val": 0.0, "max_val": 4.0}]}}
        engine.execute([{"action": "add_pipelines", "pipelines": {"p": {"a": step}}}])
        return engine.pipelines["p"]

    assert {r["b"] for r in binned("g", "x").vertices.collect()} == {9.0, 18.0} and {r["b"] for r in binned("f", "x").cells.collect()} == {8.0}
    with pytest.raises(ActionError, match="one association"):
        binned("f", "g")


def test_trees_tell_heights_up_to_the_greatest(spark, monkeypatch):
    """A tree that is higher than the queries' SQL knows: both tell what that has."""
    from gridwell import fieldwork

    monkeypatch.setattr(fieldwork, "TALLEST", 4)
    sf = "/root/testdata/sf0.001"
    assert {r["height"] for r in fieldwork.tree_nodes(spark, sf).select("height").distinct().collect()} == set(range(5))
    assert {(r["height"], r["root"]) for r in fieldwork.tree_files(spark, sf).collect()} == {*((h, False) for h in range(4)), (3, True)}


def test_tree_nodes_tell_all_heights(spark, monkeypatch):
    """Whatever tree_files tells of, and however long an axis is."""
    import duckdb

    from gridwell import fieldwork
    from gridwell.queries import SQL

    monkeypatch.setattr(fieldwork, "TALLEST", 4)
    sf = "/root/testdata/sf0.001"
    assert {r["height"] for r in fieldwork.tree_nodes(spark, sf).select("height").distinct().collect()} == set(range(7))
    assert {(r["height"], r["root"]) for r in fieldwork.tree_files(spark, sf).collect()} == {*((h, False) for h in range(4)), (3, True)}
    assert tr.height(ms.uniform(spark, (2, 2, (1 << 22) + 2))) == 23
    c = duckdb.connect()
    c.execute(f"CREATE VIEW orders AS SELECT range AS o_orderkey, 1.0::DOUBLE AS o_totalprice FROM range({30 * ((1 << 17) + 2)})")
    assert c.execute(f"SELECT max(height), count(*) FILTER (height = 18) FROM ({SQL['tree_nodes']})").fetchone() == (18, 1)

"""Declarative actions, sources and streams."""

import json

import pytest
from pyspark.sql import functions as F

from gridwell.operators import binning as bn
from gridwell.operators import geometry as gm
from gridwell.operators import mesh as ms
from gridwell.operators import selection as sl
from gridwell.plans.actions import ActionError, Engine, Options, load_session
from gridwell.plans.evaluate import Data
from gridwell.sources import tables
from gridwell.streaming import cycles


@pytest.fixture()
def engine(spark, tmp_path):
    m = ms.uniform(spark, (5, 5, 5), spacing=(1, 1, 1))
    m.vertices = m.vertices.withColumn("v", F.col("x") + F.col("y"))
    m.cells = m.cells.withColumn("f", F.col("x") * 2)
    return Engine(Options(default_dir=str(tmp_path), timings=True)).publish(Data.of_mesh(m, cycle=1, time=1.0))


def pipeline(kind, **params):
    return [{"action": "add_pipelines", "pipelines": {"p": {"f": {"type": kind, "params": params}}}}]


@pytest.mark.parametrize(
    ("kind", "params", "cells"),
    [
        ("threshold", {"field": "f", "min_value": 0, "max_value": 3}, 32), ("threshold", {"field": "v", "min_value": 0, "max_value": 0.5}, 4),
        ("threshold", {"box": {"min": {"x": 0, "y": 0, "z": 0}, "max": {"x": 2, "y": 2, "z": 2}}}, 8), ("exathreshold", {"field": "f", "min_value": "avg(field('f'))", "max_value": 99}, 32),
        ("isovolume", {"field": "f", "min_value": 1, "max_value": 1}, 16), ("log", {"field": "f", "output_name": "l"}, 64), ("log10", {"field": "f"}, 64),
        ("add_fields", {"fields": ["f", "x"], "output_field": "s"}, 64), ("power_of_field", {"field": "f", "exponent": 2, "output_field": "s"}, 64),
        ("composite_vector", {"field1": "x", "field2": "y", "output_name": "s"}, 64), ("gradient", {"field": "v"}, 64), ("recenter", {"field": "v", "association": "element"}, 64),
        ("clip", {"plane": {"point": {"x": 2, "y": 0, "z": 0}, "normal": {"x": 1, "y": 0, "z": 0}}}, 32), ("scale", {"x_scale": 2}, 64), ("transform", {"translate": {"x": 1, "y": 0, "z": 0}}, 64),
        ("histsampling", {"field": "f", "bins": 4, "sample_rate": 1.0}, 64), ("binning", {"reduction_op": "sum", "reduction_field": "f", "output_field": "b", "axes": [{"field": "x", "num_bins": 2}]}, 64),
        ("binning", {"reduction_op": "sum", "var": "f", "output_field": "b", "output_type": "bins", "axes": [{"var": "x", "num_bins": 2}]}, 2), ("triangulate", {}, 320),
        ("expression", {"expression": "field('f') + 1", "name": "s"}, 64), ("noop", {"field": "f"}, 64), ("3slice", {}, 3 * 16 * 2), ("partition", {"target": 2}, 64), ("mesh_boundary", {}, 96),
        ("add_domain_ids", {"output": "d"}, 64), ("uniform_grid", {"field": "f"}, 125), ("clean_grid", {}, 64), ("reflect", {"point": 0, "axis": "x"}, 64), ("threshold", {"field": "none", "min_value": 0, "max_value": 1}, 0),
    ],
)
def test_transforms(engine, kind, params, cells):
    engine.execute(pipeline(kind, **params))
    assert engine.pipelines["p"].cells.count() == cells


def test_a_missing_field_empties_the_rest(engine):
    steps = {"a": {"type": "threshold", "params": {"field": "none", "min_value": 0, "max_value": 1}}, "b": {"type": "expression", "params": {"expression": "field('f') + 1", "name": "g"}}}
    engine.execute([{"action": "add_pipelines", "pipelines": {"p": steps}}])
    out = engine.pipelines["p"]
    assert (out.cells.count(), out.vertices.count()) == (0, 0)
    assert "g" not in out.cells.columns


def test_what_is_not_there_is_an_error(engine):
    for actions in (
        pipeline("triangulate", topology="other"), pipeline("mir", matset="m"), pipeline("partition", target=2, by=["x", "y"]), pipeline("partition", target=0),
        pipeline("streamline", field="v", num_steps=1, step_size=1, seeds={"type": "point"}), [{"action": "add_commands", "commands": {"c": {"params": {"callback": "c", "mpi_behavior": "all"}}}}],
        [{"action": "add_extracts", "extracts": {"e": {"type": "relay", "params": {"path": "p", "topologies": ["other"]}}}}],
    ):
        with pytest.raises(ActionError):
            engine.execute(actions)
    engine.execute(pipeline("triangulate", topology="mesh"))


def test_cuts_keep_fields(engine):
    """Pieces of a clip fill half of the mesh, and fields are what they are at the pieces' corners."""
    half = {"point": {"x": 1.7, "y": 0, "z": 0}, "normal": {"x": 1, "y": 0, "z": 0}}
    for invert, size in ((True, 1.7 * 16), (False, 2.3 * 16)):
        engine.execute(pipeline("clip", plane=half, invert=invert, cut=True))
        pieces = engine.pipelines["p"].cells
        assert gm.volume(pieces).agg(F.sum("size")).first()[0] == pytest.approx(size)
        off = pieces.select(F.posexplode("v").alias("k", "v"), "points").select(F.abs(F.col("v") - F.get("points", F.col("k") * 3) - F.get("points", F.col("k") * 3 + 1)).alias("off"))
        assert off.agg(F.max("off")).first()[0] < 1e-9
    engine.execute(pipeline("isovolume", field="v", min_value=2.0, max_value=4.0))
    assert gm.volume(engine.pipelines["p"].cells).agg(F.sum("size")).first()[0] == pytest.approx((8 - 2) * 4)


def test_three_slices_are_whole(engine):
    engine.execute(pipeline("3slice", x_offset=0.3, z_offset=-0.2))
    shapes = gm.measure(engine.pipelines["p"].cells)
    assert {r["axis"]: r["a"] for r in shapes.groupBy("axis").agg(F.sum("size").alias("a")).collect()} == pytest.approx({"x": 16, "y": 16, "z": 16})
    off = F.abs(F.get("points", F.lit(0)) - 2.6)
    assert shapes.filter("axis = 'x'").agg(F.max(off)).first()[0] < 1e-9


def test_neighbours_are_cut_alike(engine):
    """Every triangle inside a cut grid belongs to two tetrahedra."""
    engine.execute(pipeline("triangulate"))
    faces = F.array(*(F.array_sort(F.array(*(F.col("conn")[k] for k in f))) for f in ((0, 1, 2), (0, 1, 3), (0, 2, 3), (1, 2, 3))))
    once = engine.pipelines["p"].cells.select(F.explode(faces).alias("f")).groupBy("f").count().filter("count = 1").count()
    assert once == 6 * 16 * 2  # the outer faces, two triangles each


@pytest.mark.parametrize(
    ("seeds", "n"),
    [
        ({"type": "point", "location": {"x": 1, "y": 1, "z": 1}}, 1), ({"type": "point_list", "points": [[1, 1, 1], [2, 2, 2], [9, 9, 9]]}, 2),
        ({"type": "line", "start": [0, 0, 0], "end": [1, 1, 1], "num_seeds": 3}, 3), ({"type": "box", "min": [0, 0, 0], "max": [1, 1, 1], "num_seeds": 2}, 8),
    ],
)
def test_streamlines_in_a_field(engine, seeds, n):
    """x goes at the speed of y: places after two steps, and the end of what leaves the grid."""
    vertices = engine.data.vertices.withColumn("u", F.struct(F.col("y").alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z")))
    engine.data.vertices = engine.data.mesh.vertices = vertices
    engine.execute(pipeline("streamline", field="u", num_steps=2, step_size=0.5, seeds=seeds))
    rows = engine.pipelines["p"].cells.collect()
    start = {r["seed_id"]: r for r in rows if r["step"] == 0}
    assert len([r for r in rows if r["step"] == 1]) == n
    for r in rows:
        s = start[r["seed_id"]]
        assert (r["x"], r["y"], r["z"]) == pytest.approx((s["x"] + 0.5 * r["step"] * s["y"], s["y"], s["z"]))


def test_vtk_files(engine, tmp_path):
    engine.execute([{"action": "add_extracts", "extracts": {"v": {"type": "vtk", "params": {"path": "mesh"}}}}])
    files = sorted((tmp_path / "mesh").glob("part-*"))
    cells = 0
    for f in files:
        lines = f.read_text().split("\n")
        at = {x.split(" ")[0]: (k, x.split(" ")) for k, x in enumerate(lines) if x and x.split(" ")[0].isupper()}
        n, points = int(at["CELLS"][1][1]), int(at["POINTS"][1][1])
        k = at["CELLS"][0] + 1
        assert all(len(x.split(" ")) == 9 and x.startswith("8 ") and max(map(int, x.split(" ")[1:])) < points for x in lines[k : k + n])
        assert lines[at["CELL_TYPES"][0] + 1 : at["CELL_TYPES"][0] + 1 + n] == ["12"] * n
        place = [list(map(float, x.split(" "))) for x in lines[at["POINTS"][0] + 1 : at["POINTS"][0] + 1 + points]]
        k = lines.index("SCALARS v double 1") + 2
        assert [float(x) for x in lines[k : k + points]] == [p[0] + p[1] for p in place]
        cells += n
    assert cells == 64


def test_partitions_agree(engine, spark):
    rows = spark.range(1000).select(F.col("id").alias("k"), ((F.col("id") * 37) % 101).cast("double").alias("v"))
    of = lambda df: {r["k"]: r["new_domain_id"] for r in ms.partition(df, 4, "v").collect()}
    found = of(rows)
    assert found == of(rows.repartition(7)) == of(rows.orderBy("v").coalesce(1))
    sizes = [sum(d == k for d in found.values()) for k in range(4)]
    assert min(sizes) > 200
    same = rows.withColumn("v", F.lit(3.0))
    assert set(of(same).values()) == {0}
    assert ms.partition(rows.limit(0), 4, "v").count() == 0


def test_unknown_parameters_and_types(engine):
    for actions in (pipeline("threshold", field="f", surprise=1), pipeline("nothing"), [{"action": "nothing"}]):
        with pytest.raises(ActionError):
            engine.execute(actions)


def test_queries_triggers_extracts_and_sessions(engine, spark, tmp_path):
    said = {"q": {"params": {"expression": "max(field('f')).value", "name": "q"}}}
    inner = [{"action": "add_extracts", "extracts": {"s": {"type": "statistics", "params": {"field": "f"}}}}]
    info = engine.execute(
        [
            {"action": "add_queries", "queries": said},
            {"action": "add_pipelines", "pipelines": {"a": {"f": {"type": "threshold", "params": {"field": "f", "min_value": "q / 2", "max_value": 99.0}}}, "b": {"pipeline": "a", "g": {"type": "add_domain_ids", "params": {"output": "d"}}}}},
            {"action": "add_triggers", "triggers": {"yes": {"params": {"condition": "q > 6", "actions": inner}}, "no": {"params": {"condition": "q > 60", "actions": inner}}}},
            {"action": "add_extracts", "extracts": {"e": {"pipeline": "b", "type": "relay", "params": {"path": "out", "fields": ["f", "d"], "num_files": 1}}, "c": {"type": "flatten", "params": {"path": "flat"}}, "h": {"type": "histogram", "params": {"field": "f", "bins": 4}}, "p": {"type": "python", "params": {"function": lambda d: d.cells.count()}}, "v": {"type": "vtk", "params": {"path": "vtk"}}}},
            {"action": "save_session", "file_name": "s.json"},
            {"action": "save_info", "file_name": "i.json"},
        ]
    )
    assert info["expressions"] == {"q": 7.0}
    assert info["triggers"] == {"yes": True, "no": False}
    assert info["fired"][0]["extracts"]["s"]["n"] == 64
    assert info["extracts"]["h"]["counts"] == [16.0] * 4
    assert info["extracts"]["p"] == 64
    assert "query q" in info["timings"]
    out = tables.load(spark, str(tmp_path / "out"))
    assert out.columns == ["f", "d"]
    assert out.count() == 32
    assert tables.load(spark, str(tmp_path / "flat/cells"), "csv").count() == 64
    assert json.loads((tmp_path / "i.json").read_text())["expressions"]["q"] == 7.0
    again = load_session(spark, str(tmp_path / "s.json"))
    assert again.of("q") == [(1, 1.0, 7.0)]


def test_restart_forgets_later_results(engine, spark):
    engine.history.add("q", 5, 9.0, 1.0)
    engine.history.add("q", 1, 0.5, 2.0)
    Engine(history=engine.history).publish(engine.data)
    assert engine.history.of("q") == [(1, 0.5, 2.0)]


def test_commands(engine):
    engine.callbacks["two"] = lambda data: 2
    assert engine.execute([{"action": "add_commands", "commands": {"c": {"params": {"callback": "two"}}}}])["commands"] == {"c": 2}
    with pytest.raises(ActionError):
        engine.execute([{"action": "add_commands", "commands": {"c": {"params": {"shell_command": "true"}}}}])


def test_contour_area_and_clip(spark):
    m = ms.uniform(spark, (9, 9, 9), (-1, -1, -1), (0.25, 0.25, 0.25))
    area = gm.measure(gm.contour(m, F.col("x"), [0.1])).agg(F.sum("size")).first()[0]
    assert area == pytest.approx(4.0)
    ball = gm.measure(gm.contour(m, sl.sphere((0, 0, 0), 0.8), [0.0])).agg(F.sum("size")).first()[0]
    assert ball == pytest.approx(4 * 3.14159 * 0.64, rel=0.06)
    volume = gm.clipped_volume(m, sl.plane((0.1, 0, 0), (1, 0, 0))).agg(F.sum("fraction")).first()[0] * 0.25**3
    assert volume == pytest.approx(4 * 1.1, rel=1e-3)


def test_particles_go_in_circles(spark):
    import numpy as np

    seeds = spark.createDataFrame([(1, 1.0, 0.0)], "seed_id long, x double, y double")
    path = gm.advect(seeds, lambda p: np.stack([-p[:, 1], p[:, 0]], 1), 100, 0.05, ("x", "y"))
    assert path.select((F.col("x") ** 2 + F.col("y") ** 2).alias("r")).agg(F.max("r"), F.min("r")).first() == pytest.approx((1, 1), abs=1e-5)


def test_binning_rules(spark):
    df = spark.createDataFrame([(-0.5,), (0.0,), (float("nan"),), (None,), (9.9,), (10.0,), (-30.0,)], "v double")
    grid = lambda **k: [r["value"] for r in bn.binning(df, "", "count", [bn.Axis("v", 2, 0.0, 10.0, **k)]).grid.orderBy("bin").collect()]
    assert grid() == [2.0, 1.0]
    assert grid(clamp=True) == [3.0, 2.0]
    edges = bn.binning(df, "", "count", [bn.Axis("v", bins=(0.0, 5.0, 10.0))]).grid.orderBy("bin").collect()
    assert [r["value"] for r in edges] == [1.0, 2.0]
    with pytest.raises(ValueError, match="edges"):
        bn.Axis("v", bins=(1.0, 1.0))
    with pytest.raises(ValueError, match="needs"):
        bn.binning(df, "", "avg", [bn.Axis("v")])


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "v double, k long")
    from gridwell.operators import reductions as rd

    assert rd.extreme(empty, "v", ["k"]).count() == 0
    assert bn.binning(empty, "v", "sum", [bn.Axis("v", 2, 0.0, 1.0)]).grid.count() == 2
    with pytest.raises(ValueError, match="no values"):
        bn.binning(empty, "v", "sum", [bn.Axis("v", 2)])


def test_stream_of_cycles(spark, tmp_path):
    rows = spark.createDataFrame([(k, float(k), f"2024-01-0{1 + k // 3} 00:00:0{k}") for k in range(9)], "id long, v double, t string").select("id", "v", F.to_timestamp("t").alias("ts"))
    for k in range(3):
        rows.filter(F.col("id") % 3 == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    engine = Engine(Options())
    said = [{"action": "add_queries", "queries": {"m": {"params": {"expression": "max(field('v')).value", "name": "m"}}}}]
    cycles.replay(stream, engine, said, str(tmp_path / "check")).awaitTermination()
    assert sorted(v for _, _, v in engine.history.of("m")) == [6.0, 7.0, 8.0]
    counts = cycles.windowed(stream, "ts", "1 day", "1 hour", [], F.count("*").alias("n"))
    q = counts.writeStream.format("memory").queryName("days").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r["n"] for r in spark.table("days").collect()) == [3, 3, 3]


@pytest.mark.parametrize("by_cell", [True, False])
def test_slopes_of_linear_fields(spark, engine, by_cell):
    """On boxes by cells, and on tetrahedra without any order, they are exact."""
    m = engine.data.mesh
    cells = ms.split(m.cells).select((F.col("cell_id") * 5 + F.col("part")).alias("cell_id"), "conn")
    mesh = m if by_cell else ms.explicit(m.vertices.drop("domain_id", "i", "j", "k"), cells)
    x, y, z = (F.col(c) for c in "xyz")
    mesh.vertices = mesh.vertices.withColumn("s", 2 * x - y + 3 * z).withColumn("u", F.struct((x + 4 * y).alias("x"), (2 * y - z).alias("y"), (5 * x).alias("z")))
    wanted = {"gradient": (2, -1, 3), "divergence": 3, "vorticity": (1, -5, -4), "qcriterion": -0.5 * (1 + 4)}
    for kind, value in wanted.items():
        e = Engine().publish(Data.of_mesh(mesh))
        e.execute(pipeline(kind, field="s" if kind == "gradient" else "u", output_name="d", **({"use_cell_gradient": "true"} if by_cell else {})))
        out = e.pipelines["p"].cells if by_cell else e.pipelines["p"].vertices
        found = [tuple(r["d"]) if isinstance(value, tuple) else r["d"] for r in out.select("d").collect()]
        assert len(found) == (64 if by_cell else 125)
        assert all(f == pytest.approx(value) for f in found)

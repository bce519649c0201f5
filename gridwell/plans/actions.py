"""Actions: pipelines, extracts, queries, triggers and commands, as nested dicts.

An engine is given data (publish) and a list of actions (execute). Queries run
first, so that parameters of transforms may use their results; triggers run
their own actions on the same data. Parameters are checked: an unknown one is an
error. A transform of a field that isn't there gives an empty table.
"""

from __future__ import annotations

import json
import logging
import subprocess
import time as clock
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import binning as bn
from ..operators import extrema as xt
from ..operators import fields as fl
from ..operators import flows as fw
from ..operators import geometry as gm
from ..operators import histogram as hg
from ..operators import materials as mt
from ..operators import mesh as ms
from ..operators import moments as mo
from ..operators import particles as pt
from ..operators import partition as pn
from ..operators import polytopes as pg
from ..operators import rays as ry
from ..operators import reductions as rd
from ..operators import selection as sl
from ..operators import shapes as sh
from ..operators import trees as tr
from ..sources import tables
from .evaluate import Data, Evaluator, History, plain, quoted

log = logging.getLogger(__name__)


class ActionError(ValueError):
    pass


@dataclass
class Options:
    """ghost_fields: names of ghost flags; flags above ghost_max are garbage, which
    goes before anything runs. default_dir: where relative paths lie. timings:
    seconds of each step in info. shell: whether commands may run shell lines."""

    ghost_fields: tuple[str, ...] = ("ghosts",)
    ghost_max: int = 1
    default_dir: str = ""
    session_name: str = "session"
    timings: bool = False
    shell: bool = False


TRANSFORMS: dict[str, tuple[Callable, set[str]]] = {}
EXTRACTS: dict[str, tuple[Callable, set[str]]] = {}


def operator(name: str, params: str, kind: dict = TRANSFORMS):
    """Registers a transform (or extract) under a name, with the parameters it takes."""

    def add(f):
        kind[name] = (f, set(params.split()))
        return f

    return add


def _implicit(data: Data, p: dict):
    axes = data.mesh.axes if data.mesh is not None else tuple(c for c in ("x", "y", "z") if c in data.cells.columns)
    at = lambda v: [float(v[c]) for c in axes] if isinstance(v, dict) else v
    shapes = {
        "sphere": lambda s: sl.sphere(at(s["center"]), s["radius"], axes),
        "cylinder": lambda s: sl.cylinder(at(s["center"]), at(s["axis"]), s["radius"], axes),
        "box": lambda s: sl.box(at(s["min"]), at(s["max"]), axes),
        "plane": lambda s: sl.plane(at(s["point"]), at(s["normal"]), axes),
        "multi_plane": lambda s: sl.multi_plane([(at(s[f"point{k}"]), at(s[f"normal{k}"])) for k in (1, 2)], axes),
    }
    given = [k for k in shapes if k in p]
    if len(given) != 1:
        raise ActionError(f"exactly one of {', '.join(shapes)} is needed")
    return shapes[given[0]](p[given[0]])


def _with_cells(data: Data, cells: DataFrame) -> Data:
    out = Data(cells, data.vertices, data.keys, data.state, data.mesh, data.topology)
    if data.mesh is not None:
        out.mesh = ms.Mesh(data.vertices, cells, data.mesh.axes, data.mesh.dims, data.mesh.origin, data.mesh.spacing)
        out.vertices = out.mesh.vertices
    return out


def _with_vertices(data: Data, vertices: DataFrame) -> Data:
    out = _with_cells(data, data.cells)
    out.vertices = vertices
    if out.mesh is not None:
        out.mesh.vertices = vertices
    return out


def _on(data: Data, name: str) -> str:
    return "element" if name in data.cells.columns else "vertex"


def _map(data: Data, name: str, f) -> Data:
    """The table that holds a field, put through f."""
    return _with_cells(data, f(data.cells)) if _on(data, name) == "element" else _with_vertices(data, f(data.vertices))


@operator("threshold", "field min_value max_value invert sphere cylinder box plane multi_plane topology all_in_range")
def _(data, p):
    if "field" not in p:
        shape = _implicit(data, p)
        if data.vertices is None:
            return _with_cells(data, sl.inside(data.cells, shape, p.get("invert", False)))
        return _with_cells(data, sl.cells_inside(data.cells, data.vertices, shape, True, p.get("invert", False)))
    if _on(data, p["field"]) == "element":
        return _with_cells(data, sl.threshold(data.cells, p["field"], p["min_value"], p["max_value"], p.get("invert", False)))
    return _with_cells(data, sl.cells_in_range(data.cells, data.vertices, p["field"], p["min_value"], p["max_value"], p.get("all_in_range", False), p.get("invert", False)))


@operator("clip", "sphere cylinder box plane multi_plane invert cut topology")
def _(data, p):
    """cut: the pieces of cells with their fields; else whole cells, with clip_fraction for the share that is left."""
    shape = _implicit(data, p)
    if data.vertices is None:
        return _with_cells(data, sl.inside(data.cells, shape, not p.get("invert", False)))
    if p.get("cut"):
        return _pieces(data, shape if p.get("invert") else -shape)
    fractions = gm.clipped_volume(data.mesh, shape if p.get("invert") else -shape).filter("fraction > 0")
    return _with_cells(data, ms.joined(data.cells, fractions.withColumnRenamed("fraction", "clip_fraction"), ["domain_id", "cell_id"]))


@operator("clip_with_field", "field clip_value invert cut topology")
def _(data, p):
    v = F.col(p["field"]) - float(p["clip_value"])
    if p.get("cut") and _on(data, p["field"]) == "vertex":
        return _pieces(data, v if p.get("invert") else -v)
    if _on(data, p["field"]) == "element":
        return _with_cells(data, data.cells.filter(v <= 0 if p.get("invert") else v >= 0))
    fractions = gm.clipped_volume(data.mesh, v if p.get("invert") else -v).filter("fraction > 0")
    return _with_cells(data, ms.joined(data.cells, fractions.withColumnRenamed("fraction", "clip_fraction"), ["domain_id", "cell_id"]))


@operator("isovolume", "field min_value max_value topology")
def _(data, p):
    """A vertex field cuts cells to pieces with their fields; by an element field whole cells stay."""
    if _on(data, p["field"]) == "vertex":
        return _pieces(data, F.col(p["field"]), float(p["max_value"]), float(p["min_value"]))
    return TRANSFORMS["threshold"][0](data, p)


@operator("ghost_stripper", "field min_value max_value")
def _(data, p):
    return _with_cells(data, sl.strip_ghosts(data.cells, p["field"], p.get("min_value", 0), p.get("max_value", 0)))


@operator("clean_grid", "topology")
def _(data, p):
    """The vertices that cells use, numbered from 0 in each domain, and conn with it."""
    if data.mesh is not None:
        return _of_mesh(data, pn.compacted(data.mesh))
    return _with_vertices(data, sl.clean_grid(data.vertices, data.cells))


@operator("noop", "field")
def _(data, p):
    return data


@operator("histsampling", "field bins sample_rate keys index")
def _(data, p):
    domain = "domain_id" if "domain_id" in data.cells.columns else None
    keys = p.get("keys") or data.key_columns("element") or [p["field"]]
    return _with_cells(data, sl.sample_by_histogram(data.cells, p["field"], p.get("bins", 128), p.get("sample_rate", 0.1), domain, keys, p.get("index")))


@operator("binning", "reduction_op reduction_field var output_field output_type axes component empty_bin_val")
def _(data, p):
    """By fields of cells at their centres, or by those of vertices where they are."""
    axes = [bn.Axis(a.get("field") or a["var"], a.get("num_bins", 256), a.get("min_val"), a.get("max_val"), a.get("clamp", False), tuple(a.get("bins", ()))) for a in p["axes"]]
    var = p.get("reduction_field") or p.get("var") or ""
    named = [v for v in (var, *(a.var for a in axes)) if v]
    homes = [t for t in (data.cells, data.vertices) if t is not None and all(v in t.columns for v in named)]
    if not homes:
        raise ActionError(f"binning: {', '.join(named)} aren't all fields of one association")
    b = bn.binning(homes[0], var, p["reduction_op"], axes, p.get("empty_bin_val", 0.0), p.get("component"))
    if p.get("output_type", "mesh") == "bins":
        return Data(b.grid.withColumnRenamed("value", p["output_field"]), None, ("bin",), data.state)
    put = _with_cells if homes[0] is data.cells else _with_vertices
    return put(data, bn.painted(homes[0], b, p["output_field"], p.get("empty_bin_val", 0.0)))


@operator("expression", "expression name")
def _(data, p):
    f = Evaluator(data, data.state.get("history")).run(p["expression"])
    if not hasattr(f, "column"):
        raise ActionError("expression: the result must be a field")
    out = data.cells if f.assoc == "element" else data.vertices
    return (_with_cells if f.assoc == "element" else _with_vertices)(data, out.withColumn(p["name"], f.column))


@operator("add_fields", "fields output_field")
def _(data, p):
    return _map(data, p["fields"][0], lambda df: fl.add_fields(df, p["fields"], p["output_field"]))


@operator("power_of_field", "field exponent output_field")
def _(data, p):
    return _map(data, p["field"], lambda df: fl.power_of_field(df, p["field"], p["exponent"], p["output_field"]))


for _name, _kind in {"log": "log_e", "log10": "log_10", "log2": "log_2"}.items():

    @operator(_name, "field output_name clamp_min_value")
    def _(data, p, kind=_kind):
        return _map(data, p["field"], lambda df: fl.log(df, p["field"], kind, p.get("output_name"), p.get("clamp_min_value")))


@operator("vector_magnitude", "field output_name")
def _(data, p):
    return _map(data, p["field"], lambda df: fl.vector_magnitude(df, p["field"], p.get("output_name")))


@operator("vector_component", "field component output_name")
def _(data, p):
    return _map(data, p["field"], lambda df: fl.vector_component(df, p["field"], p["component"], p["output_name"]))


@operator("composite_vector", "field1 field2 field3 output_name")
def _(data, p):
    names = [p[k] for k in ("field1", "field2", "field3") if k in p]
    return _map(data, names[0], lambda df: fl.composite_vector(df, names, p["output_name"]))


@operator("recenter", "field association")
def _(data, p):
    to = p["association"]
    if (to == "element") == (_on(data, p["field"]) == "element"):
        return data
    if to == "vertex":
        made = ms.to_vertices(data.mesh, p["field"])
        return _with_cells(_with_vertices(data, data.vertices.join(made, ["domain_id", "vertex_id"], "left")), data.cells.drop(p["field"]))
    made = ms.to_cells(data.mesh, p["field"])
    return _with_vertices(_with_cells(data, data.cells.join(made, ["domain_id", "cell_id"], "left")), data.vertices.drop(p["field"]))


for _name, _make in {"gradient": ms.gradient, "divergence": ms.divergence, "vorticity": ms.vorticity, "qcriterion": ms.qcriterion}.items():

    @operator(_name, "field output_name use_cell_gradient")
    def _(data, p, name=_name, make=_make):
        """On a regular grid along its lines; on another mesh, or with
        use_cell_gradient, from the vertices of each cell: then a field of the cells."""
        by_cell = str(p.get("use_cell_gradient", "false")).lower() == "true"
        output, axes = p.get("output_name", f"{p['field']}_{name}"), data.mesh.axes
        if not by_cell and data.mesh.dims:
            return _map(data, p["field"], lambda df: make(df, p["field"], axes, output))
        if _on(data, p["field"]) == "element":
            data = TRANSFORMS["recenter"][0](data, {"field": p["field"], "association": "vertex"})
        fields = {output: F.col(p["field"])} if name == "gradient" else ms.components(p["field"], axes)
        rows = ms.any_slopes(data.mesh, fields, "element" if by_cell else "vertex")
        rows = rows if name == "gradient" else rows.withColumn(output, ms.of_jacobian(name, axes)).drop(*fields)
        return _with_cells(data, rows) if by_cell else _with_vertices(data, rows)


@operator("scale", "x_scale y_scale z_scale")
def _(data, p):
    s = [p.get("x_scale", 1), p.get("y_scale", 1), p.get("z_scale", 1)]
    return _moved(data, scale=s)


@operator("transform", "scale translate rotate matrix")
def _(data, p):
    at = lambda v: [v[c] for c in ("x", "y", "z")] if isinstance(v, dict) else v
    rotate = p.get("rotate")
    return _moved(data, scale=at(p.get("scale")), translate=at(p.get("translate")), matrix=p.get("matrix"), rotate=(rotate["angle"], at(rotate["axis"])) if rotate else None)


def _of_mesh(data: Data, mesh: ms.Mesh) -> Data:
    """data with another mesh in place of its own."""
    return Data(mesh.cells, mesh.vertices, data.keys, data.state, mesh, data.topology)


def _moved(data: Data, **how) -> Data:
    if data.mesh is not None:
        return _of_mesh(data, ms.moved(data.mesh, **how))
    axes = tuple(c for c in ("x", "y", "z") if c in data.cells.columns)
    out = _with_cells(data, ms.transform(data.cells, axes=axes, **how))
    return _with_vertices(out, ms.transform(data.vertices, axes=axes, **how)) if data.vertices is not None else out


@operator("reflect", "point axis")
def _(data, p):
    if data.mesh is not None:
        return _of_mesh(data, ms.mirrored(data.mesh, p["point"], p["axis"]))
    out = _with_cells(data, ms.reflect(data.cells, p["point"], p["axis"]))
    return _with_vertices(out, ms.reflect(data.vertices, p["point"], p["axis"])) if data.vertices is not None else out


@operator("triangulate", "topology")
def _(data, p):
    return _of_mesh(data, ms.triangulated(data.mesh)) if data.mesh is not None else _with_cells(data, ms.split(data.cells, 3))


def _scalars(data: Data) -> tuple[str, ...]:
    """The numeric fields on vertices, which a cut interpolates."""
    known = {"domain_id", "vertex_id", "i", "j", "k", *data.mesh.axes}
    kinds = ("double", "float", "integer", "long", "short", "byte")
    return tuple(f.name for f in data.vertices.schema.fields if f.name not in known and f.dataType.typeName() in kinds)


def _pieces(data: Data, value, most: float = 0.0, least: float | None = None) -> Data:
    """What is left of the cells, cut where a function leaves its bounds."""
    return Data(gm.clipped(data.mesh, value, most, least, _scalars(data)), None, ("domain_id", "cell_id"), data.state)


@operator("contour", "field levels iso_values use_contour_tree")
def _(data, p):
    """use_contour_tree: the levels lie beside the saddles of the extrema that stand out most, in place of even steps."""
    by_tree = str(p.get("use_contour_tree", "false")).lower() == "true"
    if by_tree and "levels" not in p:
        raise ActionError("contour: use_contour_tree goes with levels")
    if ("levels" in p) == ("iso_values" in p):
        raise ActionError("contour: either levels or iso_values")
    if _on(data, p["field"]) == "element":
        data = TRANSFORMS["recenter"][0](data, {"field": p["field"], "association": "vertex"})
    if by_tree:
        values = xt.relevant_levels(data.mesh, p["field"], int(p["levels"]))
        if not values:  # a field without two maxima or minima
            return Data(gm.contour(data.mesh, F.col(p["field"]), [0.0], _scalars(data)).limit(0), None, ("domain_id", "cell_id"), data.state)
    elif "levels" in p:
        values = [r["value"] for r in ms.contour_levels(data.vertices, p["field"], p["levels"]).orderBy("level").collect()]
    else:
        values = p["iso_values"] if isinstance(p["iso_values"], list) else [p["iso_values"]]
    return Data(gm.contour(data.mesh, F.col(p["field"]), values, _scalars(data)), None, ("domain_id", "cell_id"), data.state)


@operator("bflow_pmt", "field threshold gen_segment fanin persistence")
def _(data, p):
    """The merge tree of a field's maxima; with gen_segment 1, the vertices at or above
    threshold with the maximum that each belongs to (-1 for those below), as
    ``segment``. persistence: lesser maxima join those they merge into. fanin, which
    says how blocks are put together, changes no result."""
    if _on(data, p["field"]) == "element":
        data = TRANSFORMS["recenter"][0](data, {"field": p["field"], "association": "vertex"})
    if not int(p.get("gen_segment", 1)):
        tree = xt.extrema(data.mesh, p["field"]).filter(F.col("value") >= float(p["threshold"]))
        return Data(tree.filter(F.col("persistence").isNull() | (F.col("persistence") >= float(p.get("persistence", 0)))), None, ("domain_id", "vertex_id"), data.state)
    found = xt.segments(data.mesh, p["field"], float(p.get("persistence", 0)), float(p["threshold"]))
    rows = data.vertices.join(found, ["domain_id", "vertex_id"], "left")
    return _with_vertices(data, rows.withColumn("segment", F.coalesce("segment", F.lit(-1).cast("long"))))


@operator("slice", "point normal sphere cylinder box plane topology")
def _(data, p):
    shape = _implicit(data, {"plane": {"point": p["point"], "normal": p["normal"]}} if "point" in p else p)
    return Data(gm.contour(data.mesh, shape, [0.0], _scalars(data)), None, ("domain_id", "cell_id"), data.state)


@operator("3slice", "x_offset y_offset z_offset topology")
def _(data, p):
    row = rd.bounds(data.vertices, list(data.mesh.axes)).first()
    at = [(row[f"min_{c}"] + row[f"max_{c}"]) / 2 + p.get(f"{c}_offset", 0.0) * (row[f"max_{c}"] - row[f"min_{c}"]) / 2 for c in data.mesh.axes]
    normals = {c: [float(c == x) for x in data.mesh.axes] for c in data.mesh.axes}
    parts = [gm.contour(data.mesh, sl.plane(at, n, data.mesh.axes), [0.0], _scalars(data)).withColumn("axis", F.lit(c)) for c, n in normals.items()]
    return Data(reduce(DataFrame.unionByName, parts), None, ("domain_id", "cell_id"), data.state)


@operator("auto_slice", "field levels axis normal")
def _(data, p):
    normal = p.get("normal") or p.get("axis") or data.mesh.axes[-1]
    normal = [normal[c] for c in data.mesh.axes] if isinstance(normal, dict) else normal
    return Data(ms.auto_slice(data.mesh, p["field"], p["levels"], normal), None, ("level",), data.state)


@operator("merge_points", "delta")
def _(data, p):
    return _of_mesh(data, ms.merge_points(data.mesh, p["delta"]))


@operator("lagrangian", "field num_steps step_size x_res y_res z_res write_frequency path")
def _(data, p):
    """The flow of one cycle; with write_frequency that of so many cycles, whose particles are kept at
    path in between: no rows until an interval is whole."""
    asked = [p.get(f"{c}_res") for c in data.mesh.axes]
    if any(asked) and not all(asked):
        raise ActionError("lagrangian: a resolution for each axis, or none")
    if "write_frequency" in p:
        if "path" not in p or "cycle" not in data.state:
            raise ActionError("lagrangian: write_frequency needs a path, and data with a cycle")
        often = int(p["write_frequency"])
        rows = fw.advanced(data.mesh, p["field"], p["path"], int(data.state["cycle"]), often, int(p.get("num_steps", 1)), float(p["step_size"]), asked if all(asked) else None)
        return Data(rows.filter(F.col("cycles") == often).drop("cycles"), None, ("seed_id",), data.state)
    return Data(gm.flow_map(data.mesh, p["field"], int(p["num_steps"]), float(p["step_size"]), asked if all(asked) else None), None, ("seed_id",), data.state)


@operator("uniform_grid", "field dims origin spacing invalid_value")
def _(data, p):
    m = data.mesh
    at = lambda v, d: [v[c] for c in m.axes] if isinstance(v, dict) else (v or d)
    return Data(ms.uniform_grid(m, [p["field"]], at(p.get("dims"), m.dims), at(p.get("origin"), m.origin), at(p.get("spacing"), (1.0,) * len(m.axes)), p.get("invalid_value", 0.0)), None, ("point_id",), data.state)


@operator("partition", "target by selections mapping merge_tolerance")
def _(data, p):
    """With selections, mapping or merge_tolerance, new domains of their own; else the
    cells get a new_domain_id by ranges of a column. mapping 0: without the columns
    that say where cells and vertices come from."""
    if {"selections", "mapping", "merge_tolerance"} & set(p):
        if data.mesh is None or "by" in p:
            raise ActionError("partition: selections need a mesh, and no by")
        out = pn.partitioned(data.mesh, p.get("selections"), p.get("target"), float(p.get("merge_tolerance", pn.MERGE)))
        if not int(p.get("mapping", 1)):
            out.cells, out.vertices = (df.drop("original_domain_id", "original_cell_id", "original_vertex_id") for df in (out.cells, out.vertices))
        return _of_mesh(data, out)
    by = p.get("by") or next((c for c in (*data.key_columns("element"), "x") if c in data.cells.columns), None)
    by = by[0] if isinstance(by, list | tuple) and len(by) == 1 else by
    if not isinstance(by, str) or by not in data.cells.columns:
        raise ActionError("partition: by is the name of one numeric column")
    if not isinstance(p["target"], int) or p["target"] < 1:
        raise ActionError("partition: target is a number of domains from 1 on")
    return _with_cells(data, ms.partition(data.cells, p["target"], by))


@operator("streamline", "field num_steps step_size seeds")
def _(data, p):
    """seeds: {"type": "point", "location": ...}, {"type": "point_list", "points": [...]},
    {"type": "line", "start": ..., "end": ..., "num_seeds": n} or {"type": "box",
    "min": ..., "max": ..., "num_seeds": n along each axis}."""
    axes = data.mesh.axes
    at = lambda v: [float(v[c]) for c in axes] if isinstance(v, dict) else [float(x) for x in v]
    s = p["seeds"]
    kinds = {"point": {"location"}, "point_list": {"points"}, "line": {"start", "end", "num_seeds"}, "box": {"min", "max", "num_seeds"}}
    if s.get("type") not in kinds or set(s) - {"type"} != kinds[s["type"]]:
        raise ActionError("streamline: seeds are " + "; ".join(f"{k} with {', '.join(sorted(v))}" for k, v in kinds.items()))
    spark = data.cells.sparkSession
    if s["type"] in ("point", "point_list"):
        points = [at(s["location"])] if s["type"] == "point" else [at(x) for x in s["points"]]
        seeds = spark.createDataFrame([(k, *x) for k, x in enumerate(points)], f"seed_id long, {', '.join(f'{c} double' for c in axes)}")
    else:
        n, line = int(s["num_seeds"]), s["type"] == "line"
        low, high = (at(s["start"]), at(s["end"])) if line else (at(s["min"]), at(s["max"]))
        part = lambda k: (F.col("id") if line else F.floor(F.col("id") / n**k) % n) / max(1, n - 1)
        seeds = spark.range(n if line else n ** len(axes)).select(F.col("id").alias("seed_id"), *((F.lit(a) + part(k) * (b - a)).alias(c) for k, (c, a, b) in enumerate(zip(axes, low, high, strict=True))))
    if _on(data, p["field"]) == "element":
        data = TRANSFORMS["recenter"][0](data, {"field": p["field"], "association": "vertex"})
    steps, size = int(p["num_steps"]), float(p["step_size"])
    return Data(gm.paths(seeds, data.mesh, p["field"], steps, size), None, ("seed_id", "step"), data.state)


@operator("warpx_streamline", "b_field e_field charge_field mass_field momentum_field weighting_field num_steps step_size speed_of_light")
def _(data, p):
    """The vertices are charged particles: of fields for charge, mass, momentum (a vector)
    and weighting, in the fields of e_field and b_field, in SI units unless
    speed_of_light says otherwise (null: without relativity)."""
    of = lambda name: p.get(f"{name.lower()}_field", name)
    needed = [of(n) for n in ("B", "E", "Charge", "Mass", "Momentum", "Weighting")]
    if lacking := [n for n in needed if n not in data.vertices.columns]:
        raise ActionError(f"warpx_streamline: no vertex field {', '.join(lacking)}")
    momentum = {f"p{c}": F.col(of("Momentum"))[c] for c in data.mesh.axes}
    seeds = data.vertices.select(F.col("vertex_id").alias("seed_id"), *data.mesh.axes, *(v.alias(n) for n, v in momentum.items()), *(F.col(of(n.title())).alias(n) for n in ("mass", "charge", "weighting")))
    paths = pt.charged(seeds, data.mesh, of("E"), of("B"), int(p["num_steps"]), float(p["step_size"]), p.get("speed_of_light", pt.SPEED_OF_LIGHT))
    return Data(paths, None, ("seed_id", "step"), data.state)


def _camera(data: Data, p: dict) -> ry.Camera:
    """By the parameters camera, image_width and image_height; without a camera, one that looks down on the mesh."""
    size = {"width": p.get("image_width", 512), "height": p.get("image_height", 512)}
    if data.mesh is None or len(data.mesh.axes) != 3:
        raise ActionError("rays need a mesh in space")
    if not (c := p.get("camera")):
        return ry.Camera.over(data.mesh, **size)
    at = lambda v: [float(v[x]) for x in ("x", "y", "z")] if isinstance(v, dict) else [float(x) for x in v]
    if (lacking := {"position", "look_at"} - set(c)) or set(c) - {"position", "look_at", "up", "fov", "parallel_scale"}:
        raise ActionError(f"a camera has position, look_at, up, and fov or parallel_scale; lacking: {sorted(lacking)}")
    fov = c.get("fov", None if "parallel_scale" in c else 60.0)
    return ry.Camera.looking(at(c["position"]), at(c["look_at"]), at(c.get("up", (0, 1, 0))), fov=fov, scale=c.get("parallel_scale"), **size)


@operator("project_2d", "fields camera image_width image_height topology")
def _(data, p):
    """Where the ray of each pixel comes into the mesh, and the fields there; all numeric ones of the vertices, if none are named."""
    fields = list(p.get("fields") or _scalars(data))
    return Data(ry.first_met(data.mesh, _camera(data, p), fields), None, ("px", "py"), data.state)


@operator("add_domain_ids", "output topology")
def _(data, p):
    return _with_cells(data, fl.add_domain_ids(data.cells, output=p["output"]))


@operator("add_mpi_ranks", "output topology")
def _(data, p):
    return _with_cells(data, fl.add_ranks(data.cells, p.get("output", "mpi_rank")))


@operator("mir", "materials matset dominant")
def _(data, p):
    """materials: a table (domain_id, cell_id, material, vol_frac), or matset: its name in
    the state. The pieces of each cell by material, with the vertex fields; dominant:
    whole cells, with the material that has most of each."""
    if ("materials" in p) == ("matset" in p):
        raise ActionError("mir: either materials or matset")
    known = data.state.get("matsets", {})
    if "matset" in p and p["matset"] not in known:
        raise ActionError(f"mir: unknown matset {p['matset']}; known are {', '.join(known)}")
    table = p["materials"] if "materials" in p else known[p["matset"]]
    if p.get("dominant"):
        return _with_cells(data, data.cells.join(ms.dominant_material(table), ["domain_id", "cell_id"], "left"))
    if data.mesh is None:
        raise ActionError("mir: this needs a mesh; without one, only dominant")
    return Data(mt.interfaces(data.mesh, table, _scalars(data)), None, ("domain_id", "cell_id"), data.state)


@operator("mesh_quality", "metric output_name topology")
def _(data, p):
    """A measure of each cell's shape, or its length, area or volume, as a field of the cells."""
    sizes = {1: "length", 2: "area", 3: "volume"}[len(data.mesh.axes)]
    if p["metric"] not in (sizes, *sh.MEASURES):
        raise ActionError(f"mesh_quality: unknown metric {p['metric']}; known are {', '.join((sizes, *sh.MEASURES))}")
    name = p.get("output_name", p["metric"])
    mesh, asked, *seen = data.measured or (data.mesh, {})
    if name in data.cells.columns or any(a is not b for a, b in zip(seen, (data.cells, data.vertices, data.mesh), strict=False)):
        mesh, asked = data.mesh, {}
    asked = {**asked, name: p["metric"]}
    found = sh.quality(mesh, sizes if sizes in asked.values() else None)
    found = found.select("domain_id", "cell_id", *(F.col(m).alias(n) for n, m in asked.items()))
    out = _with_cells(data, ms.joined(mesh.cells if len(asked) > 1 else data.cells, found, ["domain_id", "cell_id"], "left"))
    out.measured = mesh, asked, out.cells, out.vertices, out.mesh  # another measure that follows comes from the same pass
    return out


@operator("sides", "topology")
def _(data, p):
    """Polygons as the triangles around their centres; parent_cell is the cell of each."""
    return _of_mesh(data, pg.polygon_sides(data.mesh))


@operator("mesh_boundary", "topology")
def _(data, p):
    return Data(ms.boundary(data.cells, len(data.mesh.axes) if data.mesh is not None else 3), None, ("domain_id", "cell_id"), data.state)


@operator("relay", "path protocol fields num_files topologies", EXTRACTS)
def _(engine, data, p):
    """One topology, or each of several that are named, in folders by name."""
    known, path = data.topologies(), engine.path(p["path"])
    save = lambda d, to: tables.save(tables.flattened(d.cells), to, p.get("protocol", "parquet"), p.get("fields"), p.get("num_files"))
    if len(p.get("topologies") or ()) > 1:
        return [save(known[name], f"{path}/{name}") for name in p["topologies"]]
    return save(known[p["topologies"][0]] if p.get("topologies") else data, path)


@operator("flatten", "path protocol fields", EXTRACTS)
def _(engine, data, p):
    return tables.flatten(data.mesh if data.mesh is not None else data.cells, engine.path(p["path"]), p.get("protocol", "csv"), p.get("fields"))


@operator("vtk", "path topology", EXTRACTS)
def _(engine, data, p):
    if data.mesh is None:
        raise ActionError("vtk: this needs a mesh")
    return tables.write_vtk(data.mesh, engine.path(p["path"]))


@operator("xray", "absorption emission unit_scalar filename camera image_width image_height topology", EXTRACTS)
def _(engine, data, p):
    """Absorption (and emission) along the ray of each pixel, as a table at filename."""
    found = ry.integrals(data.mesh, _camera(data, p), p["absorption"], p.get("emission"), float(p.get("unit_scalar", 1.0)))
    return tables.save(found, engine.path(p["filename"]))


@operator("htg", "path fields blank_value heights topology", EXTRACTS)
def _(engine, data, p):
    """Fields of a uniform grid's cells as tree grids, each in a folder by its name; all
    numeric ones, if none are named. Those of vertices are passed over."""
    if "blank_value" not in p or not p.get("path"):
        raise ActionError("htg: needs a path and a blank_value")
    if data.mesh is None or len(data.mesh.axes) != 3 or not data.mesh.spacing:
        raise ActionError("htg: needs a uniform grid in space")
    known = {"domain_id", "cell_id", *ms.IJK, *data.mesh.axes}
    kinds = ("double", "float", "integer", "long", "short", "byte")
    numeric = [f.name for f in data.cells.schema.fields if f.name not in known and f.dataType.typeName() in kinds]
    fields = [f for f in p.get("fields") or numeric if f in numeric]
    return [tr.write(data.mesh, f, f"{engine.path(p['path'])}/{f}", float(p["blank_value"]), int(p.get("heights", tr.HEIGHTS))) for f in fields]


@operator("view", "name", EXTRACTS)
def _(engine, data, p):
    data.cells.createOrReplaceTempView(p.get("name", "published"))
    return p.get("name", "published")


@operator("python", "function", EXTRACTS)
def _(engine, data, p):
    return p["function"](data)


@operator("learn", "fields threshold path topology", EXTRACTS)
def _(engine, data, p):
    """Which domains stand out by the fourth moments of some fields: the cells with
    spatial_metric at path, a row for each domain at path_small, and whether any is
    above the threshold."""
    fields = list(p.get("fields") or ())
    if lacking := [f for f in fields if f not in data.cells.columns] or not fields:
        raise ActionError(f"learn: needs fields of the cells; not there: {lacking}")
    path = engine.path(p.get("path", "spatial_metric"))
    found = mo.spatial_metric(data.cells, fields).withColumnRenamed("domain", "domain_id")
    tables.save(found, f"{path}_small")
    small = tables.load(data.cells.sparkSession, f"{path}_small")
    tables.save(data.cells.join(small.select("domain_id", "spatial_metric"), "domain_id", "left"), path)
    low, high = small.agg(F.min("spatial_metric"), F.max("spatial_metric")).first()
    return {"path": path, "min": low, "max": high, "triggered": high is not None and high > float(p.get("threshold", 0.7))}


@operator("statistics", "field", EXTRACTS)
def _(engine, data, p):
    return rd.statistics(data.table(_on(data, p["field"])), p["field"]).first().asDict()


@operator("histogram", "field bins", EXTRACTS)
def _(engine, data, p):
    h = hg.histogram(data.table(_on(data, p["field"])), p["field"], p.get("bins", 128))
    return {"min_val": h.min_val, "max_val": h.max_val, "counts": [r["value"] for r in h.bins.orderBy("bin").collect()]}


NUMERIC = ("threshold", "persistence", "min_value", "max_value", "clip_value", "iso_values", "exponent", "clamp_min_value", "sample_rate", "empty_bin_val")
FIELDS = ("field", "field1", "field2", "field3", "reduction_field")


@dataclass
class Engine:
    """Publishes data and executes actions on it; one for each run of a program."""

    options: Options = field(default_factory=Options)
    history: History = field(default_factory=History)
    callbacks: dict[str, Callable] = field(default_factory=dict)
    info: dict[str, Any] = field(default_factory=dict)
    data: Data | None = None
    pipelines: dict[str, Data] = field(default_factory=dict)
    first: bool = True

    def path(self, name: str) -> str:
        return name if "://" in name or name.startswith("/") or not self.options.default_dir else f"{self.options.default_dir}/{name}"

    def publish(self, data: Data) -> Engine:
        others = {name: self._stripped(d) for name, d in data.others.items()}
        data = self._stripped(data)
        data.others = others
        data.state = {**data.state, "history": self.history}
        self.data = data
        if self.first and self.history.entries:
            self.history.drop_from(float(data.state.get("time", 0.0)))
        self.first = False
        return self

    def _stripped(self, data: Data) -> Data:
        for g in self.options.ghost_fields:
            data = _with_cells(data, sl.strip_ghosts(data.cells, g, 0, self.options.ghost_max))
        return data

    def execute(self, actions: list[dict] | str) -> dict:
        """actions: the list, or its JSON. Returns what came of it."""
        actions = json.loads(actions) if isinstance(actions, str) else actions
        known = {"add_pipelines": "pipelines", "add_extracts": "extracts", "add_queries": "queries", "add_triggers": "triggers", "add_commands": "commands", "save_info": None, "save_session": None, "execute": None, "reset": None}
        asked: dict[str, dict] = {}
        later = []
        for a in actions:
            name = a.get("action")
            if name not in known:
                raise ActionError(f"unknown action {name}; known are {', '.join(known)}")
            if known[name]:
                asked.setdefault(known[name], {}).update(a[known[name]])
            else:
                later.append(a)
        self.info = {"actions": actions, "expressions": {}, "extracts": {}, "triggers": {}, "commands": {}, "timings": {}}
        for name, p in asked.get("queries", {}).items():
            self._timed(f"query {name}", lambda p=p: self._query(p))
        self.pipelines = {}
        for name in asked.get("pipelines", {}):
            self._pipeline(name, asked["pipelines"], [])
        for name, p in asked.get("commands", {}).items():
            self.info["commands"][name] = self._command(p)
        for name, p in asked.get("triggers", {}).items():
            self.info["triggers"][name] = self._trigger(p)
        for name, p in asked.get("extracts", {}).items():
            self.info["extracts"][name] = self._timed(f"extract {name}", lambda p=p: self._extract(p))
        for a in later:
            self._after(a)
        return self.info

    def _timed(self, what: str, f):
        began = clock.time()
        out = f()
        if self.options.timings:
            self.info["timings"][what] = clock.time() - began
        return out

    def _query(self, p: dict) -> None:
        p = p.get("params", p)
        self._checked("query", p, {"expression", "name"})
        value = Evaluator(self.data, self.history).query(p["name"], p["expression"])
        self.info["expressions"][p["name"]] = plain(value)

    @staticmethod
    def _named(what: str, p: dict, data: Data) -> None:
        """An error where a parameter asks for a topology or matset that isn't there."""
        asked = [p[k] for k in ("topology",) if k in p] + list(p.get("topologies") or ())
        if other := [t for t in asked if t not in data.topologies()]:
            raise ActionError(f"{what}: unknown topology {', '.join(map(str, other))}; known is {', '.join(data.topologies())}")

    @staticmethod
    def _faced(data: Data, p: dict) -> Data:
        """The topology that a step is about: by its name, or by the fields that it names."""
        if not data.others:
            return data
        names = {p[k] for k in ("topology",) if k in p} or {p[k] for k in FIELDS if isinstance(p.get(k), str)} | {f for f in p.get("fields") or () if isinstance(f, str)}
        return data.facing(names | (quoted(p["expression"]) if "expression" in p and "topology" not in p else set()))

    @staticmethod
    def _checked(what: str, p: dict, known: set[str]) -> None:
        if unknown := set(p) - known:
            raise ActionError(f"{what}: surprise parameters {', '.join(sorted(unknown))}; known are {', '.join(sorted(known))}")

    def _resolved(self, p: dict, data: Data) -> dict:
        """Numbers that are given as expressions, evaluated to one scalar each."""
        out = dict(p)
        for k in NUMERIC:
            if isinstance(out.get(k), str):
                value = Evaluator(data, self.history).run(out[k])
                value = value["value"] if hasattr(value, "attrs") and "value" in value.attrs else value
                if isinstance(value, bool) or not isinstance(value, int | float):
                    raise ActionError(f"{k}: the expression must give one number")
                out[k] = value
        return out

    def _pipeline(self, name: str, specs: dict, above: list[str]) -> Data:
        if name in self.pipelines:
            return self.pipelines[name]
        if name in above:
            raise ActionError(f"pipeline {name} starts from itself")
        spec = specs[name]
        data = self._pipeline(spec["pipeline"], specs, [*above, name]) if "pipeline" in spec else self.data
        for step, s in spec.items():
            if step == "pipeline":
                continue
            kind = s["type"].removeprefix("exa")
            if kind not in TRANSFORMS:
                raise ActionError(f"unknown transform {kind}; known are {', '.join(sorted(TRANSFORMS))}")
            apply, known = TRANSFORMS[kind]
            p = s.get("params") or {}
            self._checked(kind, p, known)
            self._named(kind, p, data)
            data = self._faced(data, p)
            name_, rest = data.topology, data.others
            missing = [p[k] for k in FIELDS if isinstance(p.get(k), str) and p[k] not in data.fields()]
            if missing and kind not in ("ghost_stripper", "noop"):
                log.warning("%s: no field %s; its result, and so the pipeline's, is empty", kind, ", ".join(missing))
                data = _with_cells(data, data.cells.limit(0))
                data = _with_vertices(data, data.vertices.limit(0)) if data.vertices is not None else data
                break  # later steps would make fields of nothing
            data = apply(data, self._resolved(p, data))
            data.topology, data.others = name_, rest  # other topologies pass untouched
        self.pipelines[name] = data
        return data

    def _source(self, p: dict) -> Data:
        name = p.get("pipeline")
        if name is not None and name not in self.pipelines:
            raise ActionError(f"unknown pipeline {name}")
        return self.pipelines[name] if name else self.data

    def _extract(self, p: dict):
        kind = p["type"]
        if kind not in EXTRACTS:
            raise ActionError(f"unknown extract {kind}; known are {', '.join(sorted(EXTRACTS))}")
        apply, known = EXTRACTS[kind]
        params = p.get("params") or {}
        self._checked(kind, params, known)
        self._named(kind, params, self._source(p))
        return apply(self, self._faced(self._source(p), params), params)

    def _command(self, p: dict):
        p = p.get("params", p)
        self._checked("command", p, {"callback", "shell_command"})
        if "callback" in p:
            if p["callback"] not in self.callbacks:
                raise ActionError(f"unknown callback {p['callback']}")
            return self.callbacks[p["callback"]](self.data)
        if not self.options.shell:
            raise ActionError("shell commands are off; see Options.shell")
        return [subprocess.run(line, shell=True, check=False, capture_output=True, text=True).stdout for line in p["shell_command"].splitlines() if line.strip()]

    def _trigger(self, p: dict) -> bool:
        p = p.get("params", p)
        self._checked("trigger", p, {"condition", "callback", "actions", "actions_file"})
        if "callback" in p:
            fired = self.callbacks[p["callback"]](self.data)
        else:
            fired = Evaluator(self.data, self.history).run(p["condition"])
        if not isinstance(fired, bool):
            raise ActionError("a trigger's condition must be true or false")
        if fired:
            actions = p.get("actions")
            if actions is None and "actions_file" in p:
                spark = self.data.cells.sparkSession
                actions = "\n".join(r["value"] for r in spark.read.text(p["actions_file"], wholetext=True).collect())
            inner = Engine(self.options, self.history, self.callbacks, first=False)
            self.info.setdefault("fired", []).append(inner.publish(self.data).execute(actions or []))
        return fired

    def _after(self, a: dict) -> None:
        spark = self.data.cells.sparkSession
        if a["action"] == "save_info":
            tables.save_info(spark, self.path(a.get("file_name", "info.json")), {k: v for k, v in self.info.items() if k != "actions"})
        elif a["action"] == "save_session":
            names = a.get("expression_selection")
            entries = [(n, c, t, plain(v)) for n, c, t, v in self.history.entries if not names or n in names]
            tables.write_text(spark, self.path(a.get("file_name", f"{self.options.session_name}.json")), json.dumps(entries))
        elif a["action"] == "reset":
            self.pipelines = {}


def load_session(spark, path: str) -> History:
    """A history that save_session wrote."""
    text = spark.read.text(path, wholetext=True).first()["value"]
    return History([tuple(e) for e in json.loads(text)])

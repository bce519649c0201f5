"""Rays through a mesh: integrals along them, and what they meet first.

Cells are put onto the image, not rays into the mesh: a cell's place on the image is
arithmetic, so it is dealt to the pixels it may cover without any join, and the exact
part of each ray within it is a column expression (a numpy kernel for tetrahedra). What is left is an aggregation by
pixel, most of it before the shuffle. No pixel passes through the driver.

Boxes of a uniform grid need no vertices for fields of cells; all other cells are cut
to tetrahedra. A ray that runs in a face of a grid belongs to the cell above it;
through tetrahedra rays go ``BESIDE`` a pixel's middle, so that none runs in a face.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from math import radians, tan

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import number
from . import geometry as gm
from . import mesh as meshes
from .reductions import bounds

#: How far rays through tetrahedra lie from a pixel's middle, in pixels.
BESIDE = (1e-9, 2.3e-9)
#: Pairs of a tetrahedron and a pixel that a task looks at together.
PAIRS = 1 << 18
NEAR = 1e-6
ENDLESS = float("inf")


def _cross(a, b):
    return tuple(a[(k + 1) % 3] * b[(k + 2) % 3] - a[(k + 2) % 3] * b[(k + 1) % 3] for k in range(3))


def _unit(a):
    size = sum(x * x for x in a) ** 0.5
    if not size:
        raise ValueError("a camera needs a direction, and an up that isn't along it")
    return tuple(x / size for x in a)


@dataclass
class Camera:
    """Where rays begin and go. One ray for each pixel: px from the left, py from below.
    pixel: its side, in the units of the mesh if rays are parallel, else at a distance of 1."""

    position: tuple[float, ...]
    ahead: tuple[float, ...]
    right: tuple[float, ...]
    above: tuple[float, ...]
    width: int
    height: int
    pixel: float
    parallel: bool

    @classmethod
    def looking(cls, position, look_at, up=(0, 1, 0), width: int = 512, height: int = 512, fov: float | None = None, scale: float | None = None) -> Camera:
        """fov: the angle from the image's lower to its upper end, in degrees; or scale, for
        parallel rays: half of the image's height."""
        if (fov is None) == (scale is None):
            raise ValueError("a camera has either a fov or a scale")
        if min(int(width), int(height)) < 1:
            raise ValueError("an image has at least one pixel")
        ahead = _unit([float(b) - float(a) for a, b in zip(position, look_at, strict=True)])
        right = _unit(_cross(ahead, up))
        half = float(scale) if scale is not None else tan(radians(fov) / 2)
        return cls(tuple(map(float, position)), ahead, right, _cross(right, ahead), int(width), int(height), 2 * half / int(height), scale is not None)

    @classmethod
    def over(cls, mesh: meshes.Mesh, width: int = 512, height: int = 512) -> Camera:
        """Parallel rays against the last axis from above the mesh; the image just holds it."""
        ends = bounds(mesh.vertices, list(mesh.axes)).first()
        low, high = ([float(ends[f"{e}_{c}"] or 0.0) for c in mesh.axes] for e in ("min", "max"))
        middle = [(a + b) / 2 for a, b in zip(low, high, strict=True)]
        pixel = max((high[0] - low[0]) / int(width), (high[1] - low[1]) / int(height)) or 1.0
        top = high[2] + ((high[2] - low[2]) or 1.0)
        return cls.looking([*middle[:2], top], middle[:2] + [low[2]], width=width, height=height, scale=pixel * int(height) / 2)

    def ray(self) -> tuple[list[Column], list[Column]]:
        """Begin and direction (of length 1) of the ray of columns px and py."""
        x, y = ((F.col(c) + (0.5 - n / 2)) * self.pixel for c, n in zip(("px", "py"), (self.width, self.height), strict=True))
        over = [x * u + y * v for u, v in zip(self.right, self.above, strict=True)]
        if self.parallel:
            return [F.lit(p) + o for p, o in zip(self.position, over, strict=True)], [F.lit(w) for w in self.ahead]
        way = [F.lit(w) + o for w, o in zip(self.ahead, over, strict=True)]
        size = F.sqrt(reduce(lambda a, b: a + b, (w * w for w in way)))
        return [F.lit(p) for p in self.position], [w / size for w in way]

    def rays(self, px: np.ndarray, py: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for pixels of tetrahedra, beside their middles."""
        x, y = ((p + (0.5 - n / 2 + s)) * self.pixel for p, n, s in zip((px, py), (self.width, self.height), BESIDE, strict=True))
        over = x[:, None] * np.array(self.right) + y[:, None] * np.array(self.above)
        if self.parallel:
            return np.array(self.position) + over, np.broadcast_to(np.array(self.ahead), over.shape)
        way = np.array(self.ahead) + over
        return np.broadcast_to(np.array(self.position), over.shape), way / np.linalg.norm(way, axis=1, keepdims=True)

    def dealt(self, rows: DataFrame, low: list[Column], high: list[Column]) -> DataFrame:
        """rows for each pixel (px, py) that a box may cover: those that the ends of its places
        ahead and across allow. What reaches behind the place of perspective rays may be
        anywhere on the image."""
        named = {}
        for name, axis in (("d", self.ahead), ("x", self.right), ("y", self.above)):
            for end, pairs in (("0", zip(low, high, strict=True)), ("1", zip(high, low, strict=True))):
                named[f"__{name}{end}"] = reduce(lambda a, b: a + b, (((a if w >= 0 else b) - p) * w for (a, b), w, p in zip(pairs, axis, self.position, strict=True)))
        rows = rows.withColumns(named).filter("__d1 > 0")
        behind, ends = F.lit(False) if self.parallel else F.col("__d0") <= 0, {}
        for name, n in (("x", self.width), ("y", self.height)):
            least, most = F.col(f"__{name}0"), F.col(f"__{name}1")
            if not self.parallel:
                least, most = (f(F.try_divide(v, F.col("__d0")), F.try_divide(v, F.col("__d1"))) for f, v in ((F.least, least), (F.greatest, most)))
            first, last = F.ceil(least / self.pixel + (n / 2 - 0.5 - NEAR)), F.floor(most / self.pixel + (n / 2 - 0.5 + NEAR))
            ends |= {f"__{name}2": F.when(behind, 0).otherwise(F.greatest(first, F.lit(0))).cast("int"), f"__{name}3": F.when(behind, n - 1).otherwise(F.least(last, F.lit(n - 1))).cast("int")}
        rows = rows.withColumns(ends).filter("__x2 <= __x3 AND __y2 <= __y3").drop(*named)
        rows = rows.withColumn("px", F.explode(F.sequence("__x2", "__x3"))).withColumn("py", F.explode(F.sequence("__y2", "__y3")))
        return rows.drop(*ends)


def _boxes(mesh: meshes.Mesh, camera: Camera, fields: list[str]) -> DataFrame:
    sides = [(F.lit(o) + F.col(n) * s, F.lit(o) + (F.col(n) + 1) * s) for o, n, s in zip(mesh.origin, meshes.IJK, mesh.spacing, strict=True)]
    named = {f"__{e}{k}": f(*pair) for k, pair in enumerate(sides) for e, f in (("low", F.least), ("high", F.greatest))}
    rows = mesh.cells.select("domain_id", "cell_id", *(number(F.col(f)).alias(f"__f{k}") for k, f in enumerate(fields)), *(v.alias(n) for n, v in named.items()))
    rows = camera.dealt(rows, *([F.col(f"__{e}{k}") for k in range(3)] for e in ("low", "high")))
    begin, way = camera.ray()
    enter, leave = [F.lit(0.0)], []
    for k, (p, w) in enumerate(zip(begin, way, strict=True)):
        low, high = F.col(f"__low{k}"), F.col(f"__high{k}")
        there, a, b = (low <= p) & (p < high), F.try_divide(low - p, w), F.try_divide(high - p, w)
        enter.append(F.when(w != 0, F.least(a, b)).otherwise(F.when(there, -ENDLESS).otherwise(ENDLESS)))
        leave.append(F.when(w != 0, F.greatest(a, b)).otherwise(F.when(there, ENDLESS).otherwise(-ENDLESS)))
    ends = {f"{f}_{e}": F.col(f"__f{k}") for k, f in enumerate(fields) for e in ("near", "far")}
    rows = rows.withColumns({"near": F.greatest(*enter), "far": F.least(*leave)}).filter("near < far")
    return rows.select("px", "py", "domain_id", "cell_id", "near", "far", *(v.alias(n) for n, v in ends.items()))


def _tetrahedra(mesh: meshes.Mesh, camera: Camera, fields: list[str]) -> DataFrame:
    """The shares of a tetrahedron's corners are linear along a ray, which is inside while none is below 0."""
    on_cells = [f for f in fields if f in mesh.cells.columns]
    on_vertices = [f for f in fields if f not in on_cells]
    rows = gm.simplices(mesh, F.lit(0.0), tuple(on_vertices)).drop("values")
    if on_cells:
        held = mesh.cells.select("domain_id", "cell_id", F.array(*(number(F.col(f)) for f in on_cells)).alias("held"))
        rows = rows.join(held, ["domain_id", "cell_id"])
    width, eye = 3 + len(on_vertices), np.array(camera.position)
    axes = np.array([camera.right, camera.above, camera.ahead])
    size = np.array([camera.width, camera.height])

    def boxes(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first and last pixel, each way, that tetrahedra may cover."""
        at = (p - eye) @ axes.T
        depth = at[:, :, 2]
        behind = np.zeros(len(p), bool) if camera.parallel else (depth <= 0).any(1)
        with np.errstate(all="ignore"):
            place = at[:, :, :2] / (1.0 if camera.parallel else depth[:, :, None]) / camera.pixel + size / 2
        first = np.clip(np.ceil(place.min(1) - 0.5 - NEAR), 0, size)
        last = np.clip(np.floor(place.max(1) - 0.5 + NEAR), -1, size - 1)
        first, last = (np.where(behind[:, None], x, y) for x, y in ((0, first), (size - 1, last)))
        return first, np.where((depth > 0).any(1)[:, None], last, first - 1)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            points = np.asarray(batch.column(3).flatten(), float).reshape(-1, 4, width)
            held = np.asarray(batch.column(4).flatten(), float).reshape(-1, len(on_cells)) if on_cells else None
            edges = np.swapaxes(points[:, 1:, :3] - points[:, :1, :3], 1, 2)
            kept = np.flatnonzero(np.isfinite(edges).all((1, 2)) & (np.abs(np.linalg.det(np.nan_to_num(edges))) > 0))
            points, inverse = points[kept], np.linalg.inv(edges[kept])
            first, last = boxes(points[:, :, :3])
            side = np.maximum(last - first + 1, 0).astype(np.int64)
            ends = np.cumsum(side.prod(1))
            for begin in range(0, int(ends[-1]) if len(ends) else 0, PAIRS):
                pair = np.arange(begin, min(begin + PAIRS, int(ends[-1])))
                who = np.searchsorted(ends, pair, "right")
                place = pair - (ends - side.prod(1))[who]
                px, py = first[who, 0] + place % side[who, 0], first[who, 1] + place // side[who, 0]
                start, way = camera.rays(px, py)
                share = np.einsum("nij,nj->ni", inverse[who], start - points[who, 0, :3])
                grow = np.einsum("nij,nj->ni", inverse[who], way)
                share, grow = (np.column_stack([x, n - x.sum(1)]) for x, n in ((share, 1.0), (grow, 0.0)))
                with np.errstate(all="ignore"):
                    cross = -share / grow
                near = np.maximum(np.where(grow > 0, cross, np.where((grow == 0) & (share < 0), ENDLESS, -ENDLESS)).max(1), 0.0)
                far = np.where(grow < 0, cross, ENDLESS).min(1)
                hit = np.flatnonzero(near < far)
                who, near, far = who[hit], near[hit], far[hit]
                value = {}
                for k, f in enumerate(on_vertices):
                    corners = points[who][:, [1, 2, 3, 0], 3 + k]
                    value[f] = [((share[hit] + t[:, None] * grow[hit]) * corners).sum(1) for t in (near, far)]
                for k, f in enumerate(on_cells):
                    value[f] = [held[kept[who], k]] * 2
                source = pa.array(kept[who])
                columns = [pa.array(px[hit].astype(np.int32)), pa.array(py[hit].astype(np.int32)), batch.column(0).take(source), batch.column(1).take(source), pa.array(near), pa.array(far)]
                columns += [pa.array(v) for f in fields for v in value[f]]
                yield pa.RecordBatch.from_arrays(columns, names=[f"c{k}" for k in range(len(columns))])

    ids = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in ("domain_id", "cell_id"))
    values = "".join(f", `{f}_{e}` double" for f in fields for e in ("near", "far"))
    rows = rows.select("domain_id", "cell_id", "part", "points", *(["held"] if on_cells else []))
    return rows.mapInArrow(run, f"px int, py int, {ids}, near double, far double{values}")


def segments(mesh: meshes.Mesh, camera: Camera, fields: list[str] = ()) -> DataFrame:
    """(px, py, domain_id, cell_id, near, far, each field at both ends as <field>_near and
    <field>_far): the parts of rays within cells, by their distance from where the ray
    begins. Fields of vertices are linear in tetrahedra; those of cells are what they are."""
    if len(mesh.axes) != 3:
        raise ValueError("rays need a mesh in space")
    fields = list(fields)
    if lacking := [f for f in fields if f not in mesh.cells.columns and f not in mesh.vertices.columns]:
        raise ValueError(f"no field {', '.join(lacking)}")
    boxes = bool(mesh.spacing) and all(n in mesh.cells.columns for n in meshes.IJK)
    if boxes and all(f in mesh.cells.columns for f in fields):
        return _boxes(mesh, camera, fields)
    return _tetrahedra(mesh, camera, fields)


def integrals(mesh: meshes.Mesh, camera: Camera, absorption: str, emission: str | None = None, unit: float = 1.0) -> DataFrame:
    """(px, py, path, depth, transmitted[, emitted]) of the pixels whose ray meets the mesh:
    the way within it, the integral of absorption (times unit) along that, and the share
    of light behind the mesh that is left, exp(-depth).

    emission adds what the cells themselves send to the pixel, dimmed by all that lies
    before them; within a cell both fields are taken as their mean there. Where absorption is
    null or NaN nothing is absorbed; the same with emission.
    """
    fields = [absorption] + ([emission] if emission and emission != absorption else [])
    mean = lambda f: F.nanvl(F.coalesce((F.col(f"{f}_near") + F.col(f"{f}_far")) / 2, F.lit(0.0)), F.lit(0.0))
    way = F.col("far") - F.col("near")
    rows = segments(mesh, camera, fields).select("px", "py", "near", "domain_id", "cell_id", way.alias("way"), (mean(absorption) * float(unit) * way).alias("d"), *([mean(emission).alias("e")] if emission else []))
    sums = [F.sum("way").alias("path"), F.sum("d").alias("depth")]
    if emission:
        nearer = Window.partitionBy("px", "py").orderBy("near", "domain_id", "cell_id").rowsBetween(Window.unboundedPreceding, -1)
        sent = F.col("e") * F.col("way") * F.when(F.col("d") == 0, 1.0).otherwise(-F.expm1(-F.col("d")) / F.col("d"))
        rows = rows.withColumn("sent", sent * F.exp(-F.coalesce(F.sum("d").over(nearer), F.lit(0.0))))
        sums.append(F.sum("sent").alias("emitted"))
    out = rows.groupBy("px", "py").agg(*sums)
    return out.select("px", "py", "path", "depth", F.exp(-F.col("depth")).alias("transmitted"), *(["emitted"] if emission else []))


def first_met(mesh: meshes.Mesh, camera: Camera, fields: list[str]) -> DataFrame:
    """(px, py, distance, domain_id, cell_id, fields) of the pixels whose ray meets the mesh:
    the place where it comes in, and the fields there; the least cell among equals."""
    found = segments(mesh, camera, fields)
    kept = F.struct("near", "domain_id", "cell_id", *(F.col(f"{f}_near").alias(f"__{k}") for k, f in enumerate(fields)))
    out = found.groupBy("px", "py").agg(F.min_by(kept, F.struct("near", "domain_id", "cell_id")).alias("m"))
    return out.select("px", "py", F.col("m.near").alias("distance"), "m.domain_id", "m.cell_id", *(F.col(f"m.__{k}").alias(f) for k, f in enumerate(fields)))

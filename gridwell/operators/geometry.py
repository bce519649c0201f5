"""Geometry that isn't relational: numpy kernels over batches of simple cells."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import mesh as meshes


def _numbers(mesh: meshes.Mesh, fields: tuple[str, ...]) -> Column:
    """A vertex's coordinates and fields."""
    return F.array(*(F.col(c).cast("double") for c in (*mesh.axes, *fields)))


def simplices(mesh: meshes.Mesh, value: Column, fields: tuple[str, ...] = (), levels: list[float] | None = None) -> DataFrame:
    """(domain_id, cell_id, part, values, points) of tetrahedra or triangles. A
    corner's numbers in points are its coordinates and then the vertex fields.
    levels: only of cells whose values reach from below to above one of these."""
    rows = meshes.gathered(mesh, v=value.cast("double"), p=_numbers(mesh, fields))
    if levels is not None:
        v = F.transform("c", lambda c: c["v"])
        rows = rows.withColumns({"low": F.array_min(v), "high": F.array_max(v)})
        rows = rows.filter(F.exists(F.array(*(F.lit(float(x)) for x in levels)), lambda x: (F.col("low") <= x) & (F.col("high") >= x)))
    rows = rows.select("domain_id", "cell_id", "c", F.posexplode("parts").alias("part", "f"))
    return rows.select(
        "domain_id", "cell_id", "part", F.transform("f", lambda k: F.get("c", k)["v"]).alias("values"), F.flatten(F.transform("f", lambda k: F.get("c", k)["p"])).alias("points")
    )


def _cut(values: np.ndarray, points: np.ndarray, rows: np.ndarray, level: float):
    """Gives the points (with fields) where edges of some simplices cross a level."""

    def on(a: int, b: int) -> np.ndarray:
        va, vb = values[rows, a], values[rows, b]
        t = ((level - va) / (vb - va))[:, None]
        return points[rows, a] + t * (points[rows, b] - points[rows, a])

    return on


def _masks(values: np.ndarray, level: float):
    """(rows, corners above, others) of the simplices that have the same corners above a level."""
    n = values.shape[1]
    mask = ((values > level) * (1 << np.arange(n))).sum(1)
    for m in range(2**n):
        rows = np.flatnonzero(mask == m)
        if len(rows):
            yield rows, [k for k in range(n) if m >> k & 1], [k for k in range(n) if not m >> k & 1]


def crossing(values: np.ndarray, points: np.ndarray, level: float) -> tuple[np.ndarray, np.ndarray]:
    """Which simplices a level passes through, and the points on their edges, as
    triangles (of tetrahedra) or segments (of triangles): (owner, corners)."""
    n = values.shape[1]
    owners, shapes = [], []
    for rows, high, low in _masks(values, level):
        if not high or not low:
            continue
        on = _cut(values, points, rows, level)
        if n == 3 or len(high) != 2:
            cycles = [[on(a, b) for a in high for b in low]]
        else:
            (a, b), (c, d) = high, low
            ring = [on(a, c), on(a, d), on(b, d), on(b, c)]
            cycles = [ring[:3], [ring[0], ring[2], ring[3]]]
        for cycle in cycles:
            owners.append(rows)
            shapes.append(np.stack(cycle, 1))
    if not owners:
        return np.zeros(0, np.int64), np.zeros((0, n - 1, points.shape[2]))
    return np.concatenate(owners), np.concatenate(shapes)


def below(values: np.ndarray, points: np.ndarray, level: float) -> tuple[np.ndarray, np.ndarray]:
    """The parts of simplices where a linear function isn't above a level, as simplices: (owner, corners)."""
    n = values.shape[1]
    owners, shapes = [], []
    for rows, high, low in _masks(values, level):
        if not low:
            continue
        on, at = _cut(values, points, rows, level), lambda k, rows=rows: points[rows, k]
        if not high:
            pieces = [[at(k) for k in low]]
        elif len(low) == 1:  # a corner
            pieces = [[at(low[0]), *(on(h, low[0]) for h in high)]]
        elif n == 3:  # two corners of a triangle: a quadrilateral
            (a, b), h = low, high[0]
            pieces = [[at(a), at(b), on(h, b)], [at(a), on(h, b), on(h, a)]]
        else:  # a prism between two triangles
            if len(low) == 3:
                one, two = [at(k) for k in low], [on(high[0], k) for k in low]
            else:
                (a, b), (c, d) = low, high
                one, two = [at(a), on(c, a), on(d, a)], [at(b), on(c, b), on(d, b)]
            pieces = [[one[0], one[1], one[2], two[2]], [one[0], one[1], two[1], two[2]], [one[0], two[0], two[1], two[2]]]
        for piece in pieces:
            owners.append(rows)
            shapes.append(np.stack(piece, 1))
    if not owners:
        return np.zeros(0, np.int64), np.zeros((0, n, points.shape[2]))
    return np.concatenate(owners), np.concatenate(shapes)


def _lists(numbers: np.ndarray) -> pa.Array:
    """Rows of numbers as lists."""
    flat = numbers.reshape(len(numbers), -1)
    return pa.ListArray.from_arrays(pa.array(np.arange(0, flat.size + 1, flat.shape[1]), pa.int32()), pa.array(flat.reshape(-1)))


def _shapes(batch: pa.RecordBatch, owner: np.ndarray, shape: np.ndarray, axes: int, fields: tuple[str, ...], **more) -> pa.RecordBatch:
    """Rows of shapes: the corners' coordinates, and each field's values there."""
    take = pa.array(owner)
    columns = [batch.column(0).take(take), batch.column(1).take(take), *(pa.array(v) for v in more.values()), _lists(shape[:, :, :axes]), *(_lists(shape[:, :, axes + k]) for k in range(len(fields)))]
    return pa.RecordBatch.from_arrays(columns, names=["domain_id", "cell_id", *more, "points", *fields])


def _schema(fields, *more: str) -> str:
    return ", ".join(["domain_id int", "cell_id long", *more, "points array<double>", *(f"`{f}` array<double>" for f in fields)])


def _arrays(batch: pa.RecordBatch, n: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    return np.asarray(batch.column(3).flatten()).reshape(-1, n), np.asarray(batch.column(4).flatten()).reshape(-1, n, width)


def _parts(corners: pa.Array, parts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The row of each simplex of some cells, and where its corners are among all cells'."""
    count = corners.value_lengths().to_numpy()
    cell = np.repeat(np.arange(len(count)), parts.value_lengths().to_numpy() // n)
    return cell, np.asarray(parts.flatten()).reshape(-1, n) + (np.cumsum(count) - count)[cell, None]


def _wide(shape: np.ndarray) -> np.ndarray:
    """Which triangles or segments have an area or a length."""
    d = shape[:, 1:] - shape[:, :1]
    if d.shape[1] == 1:
        return (d[:, 0] ** 2).sum(1) > 0
    a, b = d[:, 0], d[:, 1]
    return (a**2).sum(1) * (b**2).sum(1) - (a * b).sum(1) ** 2 > 0


def contour(mesh: meshes.Mesh, value: Column, levels: list[float], fields: tuple[str, ...] = ()) -> DataFrame:
    """(domain_id, cell_id, level, points, fields): the triangles or segments of
    each level, with vertex fields interpolated to their corners.

    Only cells that a level passes through reach the kernel.
    """
    axes, n = len(mesh.axes), len(mesh.axes) + 1
    rows = simplices(mesh, value, fields, levels)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            values, points = _arrays(batch, n, axes + len(fields))
            for level in levels:
                owner, shape = crossing(values, points, level)
                whole = _wide(shape[:, :, :axes])  # where a corner lies on the level, some are points
                owner, shape = owner[whole], shape[whole]
                if len(owner):
                    yield _shapes(batch, owner, shape, axes, fields, level=np.full(len(owner), level))

    return rows.mapInArrow(run, _schema(fields, "level double"))


def clipped(mesh: meshes.Mesh, value: Column, most: float = 0.0, least: float | None = None, fields: tuple[str, ...] = ()) -> DataFrame:
    """(domain_id, cell_id, points, fields): the parts of cells where a function,
    linear on their simplices, isn't above most (nor below least), as simplices
    with vertex fields interpolated to their corners."""
    axes, n = len(mesh.axes), len(mesh.axes) + 1
    rows = simplices(mesh, value, fields)
    width = axes + len(fields)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            values, points = _arrays(batch, n, width)
            both = np.concatenate([points, values[:, :, None]], 2)  # the function goes on to the second cut
            owner, shape = below(values, both, most)
            if least is not None and len(owner):
                again, shape = below(-shape[:, :, width], shape, -least)
                owner = owner[again]
            if len(owner):
                yield _shapes(batch, owner, shape[:, :, :width], axes, fields)

    return rows.mapInArrow(run, _schema(fields))


def volume(shapes: DataFrame, axes: int = 3) -> DataFrame:
    """shapes that are simplices, with their volume (tetrahedra) or area (triangles), as size."""
    p = lambda i, k: F.get("points", F.lit(i * axes + k))
    d = [[p(i, k) - p(0, k) for k in range(axes)] for i in range(1, axes + 1)]
    if axes == 2:
        return shapes.withColumn("size", F.abs(d[0][0] * d[1][1] - d[0][1] * d[1][0]) / 2)
    (a, b, c), (u, v, w), (x, y, z) = d
    return shapes.withColumn("size", F.abs(a * (v * z - w * y) - b * (u * z - w * x) + c * (u * y - v * x)) / 6)


def measure(shapes: DataFrame, axes: int = 3) -> DataFrame:
    """shapes with their area (triangles in space) or length (segments in a plane)."""
    p = lambda i, k: F.get("points", F.lit(i * axes + k))
    d = lambda i: [p(i, k) - p(0, k) for k in range(axes)]
    if axes == 2:
        return shapes.withColumn("size", F.sqrt(sum(x * x for x in d(1))))
    (a, b, c), (u, v, w) = d(1), d(2)
    cross = (b * w - c * v, c * u - a * w, a * v - b * u)
    return shapes.withColumn("size", F.sqrt(sum(x * x for x in cross)) / 2)


def clipped_volume(mesh: meshes.Mesh, implicit: Column) -> DataFrame:
    """(domain_id, cell_id, fraction): the share of each cell where the implicit
    function, taken as linear on its simplices, isn't positive."""
    axes, n = len(mesh.axes), len(mesh.axes) + 1
    rows = meshes.gathered(mesh, v=implicit.cast("double"), p=_numbers(mesh, ()))
    rows = rows.select("domain_id", "cell_id", F.transform("c", lambda c: c["v"]).alias("values"), F.flatten(F.transform("c", lambda c: c["p"])).alias("points"), F.flatten("parts").alias("parts"))

    def size(p: np.ndarray) -> np.ndarray:
        return np.abs(np.linalg.det(p[:, 1:] - p[:, :1]))

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            cell, place = _parts(batch.column(2), batch.column(4), n)
            values, points = np.asarray(batch.column(2).flatten(), float)[place], np.asarray(batch.column(3).flatten()).reshape(-1, axes)[place]
            owner, shape = below(values, points, 0.0)
            add = lambda which, what: np.bincount(cell[which], what, minlength=batch.num_rows).astype(float)  # noqa: E731  of no pieces it counts in integers
            whole, inside = add(slice(None), size(points)), add(owner, size(shape))
            share = np.divide(inside, whole, out=np.zeros_like(whole), where=whole > 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(share, mask=whole == 0)], names=["domain_id", "cell_id", "fraction"])

    return rows.mapInArrow(run, "domain_id int, cell_id long, fraction double")


def sampled_velocity(mesh: meshes.Mesh, field: str):
    """A function of places (n, axes) that gives a vertex vector field of a uniform
    grid there, linear between vertices; outside of the grid nothing (NaN).

    The field goes to every task, so its size is checked: FIELD_VALUES numbers at most.
    """
    axes, dims, d = list(mesh.axes), mesh.dims, len(mesh.axes)
    if not mesh.spacing:
        raise ValueError("this needs a uniform grid")
    if not goes_to_tasks(mesh):
        raise ValueError(f"a field of more than {FIELD_VALUES} numbers is too large to go to every task")
    rows = mesh.vertices.select("vertex_id", *(F.col(field)[c].cast("double").alias(f"v{k}") for k, c in enumerate(axes))).toArrow()
    grid = np.zeros((int(np.prod(dims)), d))
    grid[rows["vertex_id"].to_numpy()] = np.stack([rows[f"v{k}"].to_numpy() for k in range(d)], 1)
    shared = mesh.vertices.sparkSession.sparkContext.broadcast(grid)
    origin, spacing = np.array(mesh.origin), np.array(mesh.spacing)
    strides = np.cumprod([1, *dims[:-1]])

    def velocity(at: np.ndarray) -> np.ndarray:
        place = (at - origin) / spacing
        inside = ((place >= 0) & (place <= np.array(dims) - 1)).all(1)
        low = np.clip(np.floor(np.where(np.isfinite(place), place, 0)), 0, np.array(dims) - 2).astype(np.int64)
        part, out = place - low, np.zeros((len(at), d))
        for corner in range(1 << d):
            bits = np.array([corner >> k & 1 for k in range(d)])
            out += np.prod(np.where(bits, part, 1 - part), 1)[:, None] * shared.value[(low + bits) @ strides]
        return np.where(inside[:, None], out, np.nan)

    return velocity


#: Numbers of a vector field that may go to every task: 64 MB.
FIELD_VALUES = 1 << 23


def advect(seeds: DataFrame, velocity, steps: int, step_size: float, axes=meshes.XYZ) -> DataFrame:
    """(seed_id, step, x, y, z): paths of particles by fourth-order Runge-Kutta steps.

    velocity takes an array (n, axes) of places and gives one of speeds; it goes
    to the workers by pickle. Particles are independent; one that leaves the
    field (where it has no speed) ends.
    """
    names = list(axes)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = np.asarray(batch.column(0))
            at = np.stack([np.asarray(batch.column(1 + k), float) for k in range(len(names))], 1)
            for step in range(steps + 1):
                there = np.isfinite(at).all(1)
                ids, at = ids[there], at[there]
                if not len(at):
                    break
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.full(len(at), step), pa.int32()), *(pa.array(at[:, k]) for k in range(len(names)))], names=["seed_id", "step", *names])
                a = velocity(at)
                b = velocity(at + step_size / 2 * a)
                c = velocity(at + step_size / 2 * b)
                d = velocity(at + step_size * c)
                at = at + step_size / 6 * (a + 2 * b + 2 * c + d)

    return seeds.select("seed_id", *(F.col(c).cast("double").alias(c) for c in names)).mapInArrow(run, f"seed_id long, step int, {', '.join(c + ' double' for c in names)}")


def goes_to_tasks(mesh: meshes.Mesh) -> bool:
    """Whether a vector field of the mesh is one of a uniform grid, and small enough for every task."""
    return bool(mesh.spacing) and int(np.prod(mesh.dims)) * len(mesh.axes) <= FIELD_VALUES


def flow_seeds(mesh: meshes.Mesh, resolution=None) -> DataFrame:
    """(seed_id, x, y, z): the mesh's vertices, or those of a grid of a resolution (vertices
    on each axis) over a uniform grid's room."""
    if resolution and not mesh.spacing:
        raise ValueError("a resolution needs a uniform grid")
    vertices = mesh.vertices
    if resolution:
        spacing = [s * (n - 1) / max(1, m - 1) for s, n, m in zip(mesh.spacing, mesh.dims, resolution, strict=True)]
        vertices = meshes.uniform(mesh.vertices.sparkSession, tuple(resolution), mesh.origin, spacing).vertices
    return vertices.select(F.col("vertex_id").alias("seed_id"), *mesh.axes)


def paths(seeds: DataFrame, mesh: meshes.Mesh, field: str, steps: int, step_size: float, ends: bool = False) -> DataFrame:
    """(seed_id, step, x, y, z): paths of particles in a vertex vector field of any mesh and any
    size; ends: no more than the last step is needed."""
    from .particles import streamlines

    if goes_to_tasks(mesh):
        return advect(seeds, sampled_velocity(mesh, field), steps, step_size, mesh.axes)
    return streamlines(seeds, mesh, field, steps, step_size, ends)


def carried_for(seeds: DataFrame, mesh: meshes.Mesh, field: str, steps: int, step_size: float) -> DataFrame:
    """(seed_id, end) of the particles that are still in the mesh after some steps."""
    path = paths(seeds, mesh, field, steps, step_size, ends=True)
    return path.filter(F.col("step") == steps).select("seed_id", F.struct(*mesh.axes).alias("end"))


def flow_map(mesh: meshes.Mesh, field: str, steps: int, step_size: float, resolution=None) -> DataFrame:
    """(seed_id, start, end) of particles that a vertex vector field carries for some
    steps: places at both ends, as structs; end is null for particles that leave the
    mesh. Seeds are those of flow_seeds."""
    seeds = flow_seeds(mesh, resolution)
    return seeds.select("seed_id", F.struct(*mesh.axes).alias("start")).join(carried_for(seeds, mesh, field, steps, step_size), "seed_id", "left")

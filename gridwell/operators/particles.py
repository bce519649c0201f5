"""Particles in fields of any size, on any mesh: a frontier that meets blocks of cells.

Space is dealt to boxes, and a box with more than ``BLOCK`` simplices to smaller
ones. A block is one row: all simplices that reach into a box, with the field at
their corners. A particle is a row too: its place, how far it has come within a step,
and the place where it needs the field next. Each round joins the particles
that still move with the blocks they stand in; a worker moves them as far as the block
goes and hands them on, in the midst of a step if need be. Rounds end when no particle
moves, so there are as many as the longest path crosses boxes.

Of a whole uniform grid, boxes are known by arithmetic, a block is some rows of
vertices, and the field is linear between these. Vertices and particles of a box come to a
worker one after another, so no task holds more than one block and one batch.

Neither field nor particles pass through the driver. Each round is a table in the
shared folder, which cuts its lineage.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce
from math import ceil, prod

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import remove, scratch_path
from . import geometry as gm
from . import mesh as meshes
from .reductions import bounds

#: Simplices of a block, and particles that meet a block together.
BLOCK, CHUNK = 4096, 4096
#: Halvings of a box along each axis.
DEEPEST = 12
#: Boxes that are looked up by name; beyond these all blocks are read.
NAMED = 1000
NEAR = 1e-9
SPEED_OF_LIGHT = 299_792_458.0  # metres a second


@dataclass
class Stepper:
    """How particles move. A state is a row of numbers that begins with the place; it is
    asked for the place where a stage needs the field, and told what is there. After a whole
    step the first numbers, as many as wanted, are what there is to know."""

    stages: int
    size: int
    wanted: int

    def place(self, state: np.ndarray, stage: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def told(self, state: np.ndarray, stage: np.ndarray, value: np.ndarray) -> np.ndarray:
        raise NotImplementedError


class RungeKutta(Stepper):
    """Fourth order: the speeds at the beginning, twice in the middle, and at the end of a step."""

    def __init__(self, axes: int, step_size: float):
        super().__init__(4, 4 * axes, axes)
        self.axes, self.h = axes, step_size

    def place(self, state, stage):
        d, of = self.axes, np.array([0.0, 0.5, 0.5, 1.0])[stage] * self.h
        last = state.reshape(len(state), 4, d)[np.arange(len(state)), np.maximum(stage, 1)]
        return state[:, :d] + of[:, None] * np.where((stage > 0)[:, None], last, 0.0)

    def told(self, state, stage, value):
        d, out = self.axes, state.copy().reshape(len(state), 4, self.axes)
        mid = np.flatnonzero(stage < 3)
        out[mid, stage[mid] + 1] = value[mid]
        end = np.flatnonzero(stage == 3)
        a, b, c = (out[end, k] for k in (1, 2, 3))
        out[end, 0] += self.h / 6 * (a + 2 * b + 2 * c + value[end])
        return out.reshape(len(state), 4 * d)


class Boris(Stepper):
    """A charged particle in an electric and a magnetic field: half the electric push, the
    turn about the magnetic field, the other half, with momentum over mass kept by its
    size. A state is place, momentum, mass, charge and weight. speed_of_light: beyond
    it nothing moves; None: without relativity."""

    def __init__(self, step_size: float, speed_of_light: float | None = None):
        super().__init__(1, 9, 9)
        self.h, self.c = step_size, speed_of_light

    def place(self, state, stage):
        return state[:, :3]

    def _slowed(self, u: np.ndarray) -> np.ndarray:
        return 1.0 if self.c is None else np.sqrt(1 + (u**2).sum(1, keepdims=True) / self.c**2)

    def told(self, state, stage, value):
        out, mass, charge = state.copy(), state[:, 6:7], state[:, 7:8]
        electric, magnetic = value[:, :3], value[:, 3:]
        push = charge * self.h / (2 * mass) * electric
        u = state[:, 3:6] / mass + push
        t = charge * self.h / (2 * mass * self._slowed(u)) * magnetic
        turned = u + np.cross(u + np.cross(u, t), 2 * t / (1 + (t**2).sum(1, keepdims=True))) + push
        out[:, 3:6] = turned * mass
        out[:, :3] += turned / self._slowed(turned) * self.h
        return out


class Block:
    """Simplices of a box, found by a grid of about as many places."""

    def __init__(self, corners: np.ndarray, d: int):
        self.p, self.v = corners[:, :, :d], corners[:, :, d:]
        edges = np.swapaxes(self.p[:, 1:] - self.p[:, :1], 1, 2)
        whole = np.abs(np.linalg.det(edges)) > 0
        self.p, self.v = self.p[whole], self.v[whole]
        self.inverse = np.linalg.inv(edges[whole])
        low, high = self.p.min(1), self.p.max(1)
        self.low, n = (low.min(0), len(low)) if len(low) else (np.zeros(d), 0)
        self.each = max(1, round(n ** (1 / d)))
        wide = (high.max(0) - self.low) / self.each if n else np.ones(d)
        self.wide = np.where(wide > 0, wide, 1.0)
        near = NEAR * self.each * self.wide
        a, b = self._place(low - near), self._place(high + near)
        count = (b - a + 1).prod(1)
        who = np.repeat(np.arange(n), count)
        at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        cell = np.zeros(len(who), np.int64)
        for k in range(d):
            side = (b - a + 1)[who, k]
            cell = cell * self.each + a[who, k] + at % side
            at = at // side
        order = np.lexsort((who, cell))
        self.who, self.begin = who[order], np.searchsorted(cell[order], np.arange(self.each**d + 1))

    def _place(self, at: np.ndarray) -> np.ndarray:
        return np.clip(np.floor((at - self.low) / self.wide), 0, self.each - 1).astype(np.int64)

    def at(self, places: np.ndarray) -> np.ndarray:
        """The field at places, linear in each simplex; NaN where there is none."""
        out = np.full((len(places), self.v.shape[2]), np.nan)
        if not len(self.p) or not len(places):
            return out
        cell = np.zeros(len(places), np.int64)
        for k in range(places.shape[1]):
            cell = cell * self.each + self._place(places)[:, k]
        at, end, left = self.begin[cell], self.begin[cell + 1], np.arange(len(places))
        while len(left := left[at[left] < end[left]]):
            s = self.who[at[left]]
            share = np.einsum("nij,nj->ni", self.inverse[s], places[left] - self.p[s, 0])
            first = 1 - share.sum(1)
            inside = (share >= -NEAR).all(1) & (first >= -NEAR)
            i, s = left[inside], s[inside]
            out[i] = first[inside, None] * self.v[s, 0] + np.einsum("ni,nij->nj", share[inside], self.v[s, 1:])
            at[left] += 1
            left = left[~inside]
        return out


@dataclass
class Boxes:
    """Boxes of one width along each axis over a mesh, those of too many simplices halved
    along each axis, and so on. A box is (level, place): its place among all of its level, if all
    were halved. heavy has a table of the places of each level that are halved."""

    low: list[float]
    wide: list[float]
    each: list[int]
    heavy: list[DataFrame]

    def index(self, value: Column, k: int, level: int) -> Column:
        at = F.floor((value - self.low[k]) / self.wide[k] * float(1 << level))
        return F.least(F.greatest(at, F.lit(0).cast("long")), F.lit((self.each[k] << level) - 1).cast("long"))

    def linear(self, index: list[Column], level: int) -> Column:
        out = F.lit(0).cast("long")
        for n, x in zip(self.each, index, strict=True):
            out = out * F.lit(n << level) + x
        return out

    def beyond(self, k: int, level: int) -> int:
        """How many boxes of a level have one place along the axes up to k."""
        return prod(n << level for n in self.each[k + 1 :])

    def of(self, rows: DataFrame, places: list[Column]) -> DataFrame:
        """rows with the box that a place is in; beyond the mesh, that next to it."""
        at = lambda level: self.linear([self.index(p, k, level) for k, p in enumerate(places)], level)
        rows = rows.withColumns({"level": F.lit(0), "place": at(0)})
        for level, halved in enumerate(self.heavy):
            deeper = (F.col("level") == level) & F.coalesce("halved", F.lit(False))
            rows = rows.join(halved.withColumn("halved", F.lit(True)), "place", "left")
            rows = rows.withColumns({"place": F.when(deeper, at(level + 1)).otherwise(F.col("place")), "level": F.when(deeper, F.lit(level + 1)).otherwise(F.col("level"))}).drop("halved")
        return rows

    def spread(self, rows: DataFrame, ends: list[tuple[Column, Column]], level: int) -> DataFrame:
        """A row (with place) for each box of a level that something between two ends along
        each axis reaches into; if rows have a place, one of the level above, within that."""
        names = [f"__i{k}" for k in range(len(ends))]
        for k, (a, b) in enumerate(ends):
            near = NEAR * self.each[k] * abs(self.wide[k])
            first, last = self.index(a - near, k, level), self.index(b + near, k, level)
            if level:
                above = F.floor(F.col("place") / F.lit(float(self.beyond(k, level - 1)))) % (self.each[k] << level - 1)
                first, last = F.greatest(first, 2 * above), F.least(last, 2 * above + 1)
            rows = rows.withColumn(names[k], F.explode(F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<long>"))))
        return rows.withColumn("place", self.linear([F.col(n) for n in names], level)).drop(*names)


def boxes_along(room: list[float], extent: list[float], count: float) -> list[int]:
    """How many boxes go along each axis, some count in all, where a simplex has such an extent on
    average: as many simplices along every side of a box, or all that there are."""
    across = [max(1.0, w / e) if w > 0 and e > 0 else 1.0 for w, e in zip(room, extent, strict=True)]
    side, left = 1.0, sorted(across)
    for k, n in enumerate(left):  # axes with fewer simplices than a box's side stay whole
        side = max(1.0, prod(left[k:]) / max(count, 1.0)) ** (1 / (len(left) - k))
        if n > side:
            break
    return [max(1, ceil(n / side - 1e-9)) for n in across]


def dealt(rows: DataFrame, mesh: meshes.Mesh, kept) -> tuple[Boxes, DataFrame]:
    """Boxes for simplices (points), and the simplices by box, (level, place). Boxes of
    more than BLOCK simplices are halved, DEEPEST times at most, since many may meet
    at one point. kept: writes a table."""
    d = len(mesh.axes)
    width = F.size("points") / (d + 1)
    at = lambda i, k: F.get("points", (F.lit(i) * width + k).cast("int"))
    ends = [(F.least(*(at(i, k) for i in range(d + 1))), F.greatest(*(at(i, k) for i in range(d + 1)))) for k in range(d)]
    room = bounds(mesh.vertices, list(mesh.axes)).first()
    mean = rows.agg(F.count("*").alias("n"), *(F.avg(b - a).alias(f"e{k}") for k, (a, b) in enumerate(ends))).first()
    low = [float(room[f"min_{c}"] or 0.0) for c in mesh.axes]
    size = [float(room[f"max_{c}"] or 0.0) - a for c, a in zip(mesh.axes, low, strict=True)]
    each = boxes_along(size, [mean[f"e{k}"] or 0.0 for k in range(d)], 2 * mean["n"] / BLOCK)  # half full, as some reach into several
    wide = [w / n or 1.0 for w, n in zip(size, each, strict=True)]
    boxes, light, left = Boxes(low, wide, each, []), [], rows
    for level in range(DEEPEST + 1):
        left = boxes.spread(left, ends, level)
        heavy = kept(left.groupBy("place").count().filter(F.col("count") > BLOCK).select("place"))
        if level == DEEPEST or prod(n << level + 1 for n in each) >= 1 << 53 or heavy.isEmpty():
            return boxes, reduce(DataFrame.unionByName, [*light, left.withColumn("level", F.lit(level))])
        light.append(left.join(heavy, "place", "left_anti").withColumn("level", F.lit(level)))
        boxes.heavy.append(heavy)
        left = kept(left.join(heavy, "place", "left_semi"))


@dataclass
class GridBoxes:
    """Boxes of some cells along each axis of a uniform grid, by their place among all."""

    origin: np.ndarray
    spacing: np.ndarray
    cells: np.ndarray
    side: np.ndarray
    each: np.ndarray

    @classmethod
    def of(cls, mesh: meshes.Mesh) -> GridBoxes:
        cells = [n - 1 for n in mesh.dims]
        each = boxes_along([float(n) for n in cells], [1.0] * len(cells), prod(cells) / BLOCK)
        side = [ceil(n / e) for n, e in zip(cells, each, strict=True)]
        return cls(*map(np.array, (mesh.origin, mesh.spacing, cells, side, [ceil(n / k) for n, k in zip(cells, side, strict=True)])))

    def box(self, at: np.ndarray) -> np.ndarray:
        """The boxes of places; beyond the grid, those next to it."""
        place = np.clip(np.floor((at - self.origin) / (self.spacing * self.side)), 0, self.each - 1)
        return np.where(np.isfinite(place), place, 0).astype(np.int64) @ self._strides(self.each)

    def box_of(self, places: list[Column]) -> Column:
        out = F.lit(0).cast("long")
        for k, p in enumerate(places):
            at = F.floor((p - float(self.origin[k])) / float(self.spacing[k] * self.side[k]))
            out = out + F.least(F.greatest(at, F.lit(0).cast("long")), F.lit(int(self.each[k] - 1)).cast("long")) * int(self._strides(self.each)[k])
        return out

    @staticmethod
    def _strides(counts: np.ndarray) -> np.ndarray:
        return np.cumprod([1, *counts[:-1]])

    def vertices(self, mesh: meshes.Mesh, values: list[Column]) -> DataFrame:
        """(box, at, x): vertices of boxes with their place in these; those between boxes are in each."""
        strides, rows = self._strides(np.array(mesh.dims)), mesh.vertices.select("vertex_id", F.array(*(v.cast("double") for v in values)).alias("x"))
        box, at = F.lit(0).cast("long"), F.lit(0).cast("long")
        for k, n in enumerate(mesh.dims):
            i, side, last = F.floor(F.col("vertex_id") / int(strides[k])) % n, int(self.side[k]), int(self.each[k] - 1)
            between = F.sequence(F.greatest(F.ceil(i / side) - 1, F.lit(0).cast("long")), F.least(F.floor(i / side), F.lit(last).cast("long")))
            rows = rows.withColumn(f"__b{k}", F.explode(between))
            box = box + F.col(f"__b{k}") * int(self._strides(self.each)[k])
            at = at + (i - F.col(f"__b{k}") * side) * int(self._strides(self.side + 1)[k])
        return rows.select(box.alias("box"), at.alias("at"), "x")

    def field(self, box: int, values: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The field at places in a box with these values at its vertices; beyond the grid NaN."""
        first = box // self._strides(self.each) % self.each * self.side
        place = (at - self.origin) / self.spacing
        inside = ((place >= -NEAR) & (place <= self.cells + NEAR)).all(1)
        low = np.clip(np.floor(np.where(np.isfinite(place), place, 0)), first, np.minimum(first + self.side, self.cells) - 1).astype(np.int64)
        part, out, strides = place - low, np.zeros((len(at), values.shape[1])), self._strides(self.side + 1)
        for corner in range(1 << at.shape[1]):
            bits = np.array([corner >> k & 1 for k in range(at.shape[1])])
            out += np.prod(np.where(bits, part, 1 - part), 1)[:, None] * values[(low - first + bits) @ strides]
        return np.where(inside[:, None], out, np.nan)


def _whole_grid(mesh: meshes.Mesh) -> bool:
    """Whether a mesh is a uniform grid of one domain with all of its vertices and cells."""
    if not mesh.spacing or min(mesh.spacing) <= 0 or min(mesh.dims) < 2:
        return False
    for rows, key, n in ((mesh.vertices, "vertex_id", prod(mesh.dims)), (mesh.cells, "cell_id", prod(k - 1 for k in mesh.dims))):
        domain = [F.min("domain_id"), F.max("domain_id")] if "domain_id" in rows.columns else [F.lit(0), F.lit(0)]
        count, low, high, *ends = rows.agg(F.count(key), F.min(key), F.max(key), *domain).first()
        if (count, low, high) != (n, 0, n - 1) or ends[0] != ends[1]:
            return False
    return True


def _moved(field, within, stepper: Stepper, steps: int, ids, step, stage, state):
    """(ids, step, stage, moving, state, q) of particles as far as a block goes: at each whole step,
    and where they leave it. field: gives its values at places; within: which places are in the block."""
    out, here = [], np.ones(len(ids), bool)  # they were dealt to this box, whatever rounding says at its edge
    while len(ids):
        q = stepper.place(state, stage)
        here |= within(q)
        if not here.all():
            out.append((ids[~here], step[~here], stage[~here], np.ones(np.count_nonzero(~here), bool), state[~here], q[~here]))
            ids, step, stage, state, q = (x[here] for x in (ids, step, stage, state, q))
        value = field(q)
        there = np.isfinite(value).all(1)
        ids, step, stage, state, q, value = (x[there] for x in (ids, step, stage, state, q, value))
        state = stepper.told(state, stage, value)
        stage = stage + 1
        whole = stage == stepper.stages
        stage, step = np.where(whole, 0, stage).astype(np.int32), (step + whole).astype(np.int32)
        if whole.any():
            out.append((ids[whole], step[whole], stage[whole], np.zeros(np.count_nonzero(whole), bool), state[whole], q[whole]))
        left = ~(whole & (step >= steps)) & np.isfinite(state).all(1)
        ids, step, stage, state = (x[left] for x in (ids, step, stage, state))
        here = np.zeros(len(ids), bool)
    return [np.concatenate(c) for c in zip(*out, strict=True)] if out else []


#: Rows of particles and vertices for each task of a round on a grid.
ROWS_A_TASK = 1 << 18


def _on_grid(begin: DataFrame, mesh: meshes.Mesh, values: list[Column], stepper: Stepper, steps: int, kept, ends: bool) -> list[DataFrame]:
    """The tables of all rounds on a whole uniform grid: (seed_id, step, stage, moving, state, box)."""
    boxes, d, nv, chunk = GridBoxes.of(mesh), len(mesh.axes), len(values), 4 * CHUNK
    size = prod(int(n) for n in boxes.side + 1)

    def run(batches):
        here, known = None, None
        for batch in batches:
            box, salt, kind, ids, step, stage = (np.asarray(batch.column(k)) for k in range(6))
            x = batch.column(6)
            cuts = np.flatnonzero(np.diff(box) | np.diff(salt) | np.diff(kind)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(box)], strict=True):
                if a == b:
                    continue
                if here != (box[a], salt[a]):
                    here, known = (box[a], salt[a]), np.full((size, nv), np.nan)
                rows = np.asarray(x.slice(a, b - a).flatten(), float).reshape(b - a, -1)
                if not kind[a]:
                    known[ids[a:b]] = rows
                    continue
                one, block = int(box[a]), known
                found = _moved(lambda q, one=one, block=block: boxes.field(one, block, q), lambda q, one=one: boxes.box(q) == one, stepper, steps, ids[a:b], step[a:b], stage[a:b], rows)
                if not found:
                    continue
                on, next_box = found[3], boxes.box(found[5])
                for which, width in ((on, stepper.size), (~on & (found[1] == steps if ends else True), stepper.wanted)):
                    if which.any():
                        columns = [*(pa.array(c[which]) for c in found[:4]), gm._lists(found[4][which][:, :width]), pa.array(next_box[which])]
                        yield pa.RecordBatch.from_arrays(columns, names=["seed_id", "step", "stage", "moving", "state", "box"])

    schema = "seed_id long, step int, stage int, moving boolean, state array<double>, box long"
    field = kept(boxes.vertices(mesh, values))
    field = field.select("box", F.lit(0).alias("kind"), F.col("at").alias("id"), F.lit(0).alias("step"), F.lit(0).alias("stage"), "x")
    rounds = [kept(begin.withColumn("box", boxes.box_of([F.get("q", F.lit(k)) for k in range(d)])).drop("q"))]
    usual = int(begin.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while True:
        moving = rounds[-1].filter("moving")
        # a row for each box that particles stand in
        counts = kept(moving.groupBy("box").agg(F.ceil(F.count("*") / chunk).alias("salts"), F.count("*").alias("n")))
        n, blocks = counts.agg(F.sum("n"), F.sum("salts")).first()
        if not n:
            return rounds
        met = F.broadcast(counts.drop("n"))
        particles = moving.join(met, "box").select("box", F.pmod(F.xxhash64("seed_id", "step"), "salts").alias("salt"), F.lit(1).alias("kind"), F.col("seed_id").alias("id"), "step", "stage", F.col("state").alias("x"))
        vertices = field.join(met, "box").select("box", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), "kind", "id", "step", "stage", "x")
        rows = vertices.unionByName(particles)
        tasks = min(blocks, max(usual, (n + blocks * size) // ROWS_A_TASK + 1))
        rows = rows.repartition(tasks, "box", "salt").sortWithinPartitions("box", "salt", "kind")
        rounds.append(kept(rows.mapInArrow(run, schema)))


def carried(seeds: DataFrame, mesh: meshes.Mesh, values: list[Column], stepper: Stepper, steps: int, ends: bool = False) -> DataFrame:
    """(seed_id, step, state) of particles from 0 to so many steps, or (ends) after the last one alone.

    seeds: (seed_id, state). values: the field's components, vertex columns. A
    particle that needs the field where there is no cell ends with its last whole
    step. Repeated ids are particles of their own; null places end at once.
    """
    spark, d, nv = seeds.sparkSession, len(mesh.axes), len(values)
    root, setting = scratch_path(spark), "spark.sql.execution.arrow.maxRecordsPerBatch"
    usual = spark.conf.get(setting)
    names = [f"__v{k}" for k in range(nv)]
    known = mesh.vertices.select("domain_id", "vertex_id", *mesh.axes, *(v.cast("double").alias(n) for n, v in zip(names, values, strict=True)))
    frontier_schema = "seed_id long, step int, stage int, moving boolean, state array<double>, q array<double>"
    width = d + nv

    def run(batches):
        for batch in batches:
            for data, box, chunk in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2), strict=True):
                block = Block(np.asarray(data.values).reshape(-1, d + 1, width), d)
                part = chunk.values
                ids, step, stage = (np.asarray(part.field(k)).copy() for k in ("seed_id", "step", "stage"))
                state = np.asarray(part.field("state").flatten()).reshape(-1, stepper.size).copy()
                low, high = np.array(box["low"]), np.array(box["high"])
                columns = _moved(block.at, lambda q, low=low, high=high: ((q >= low) & (q < high)).all(1), stepper, steps, ids, step, stage, state)
                if columns:
                    yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in columns[:4]), *map(gm._lists, columns[4:])], names=["seed_id", "step", "stage", "moving", "state", "q"])

    def kept(rows: DataFrame, name: str = "") -> DataFrame:
        name = name or uuid.uuid4().hex
        rows.write.parquet(f"{root}/{name}")
        return spark.read.schema(rows.schema).parquet(f"{root}/{name}")

    def told(rows: DataFrame) -> DataFrame:
        """What there is to know, on its own when the tables go."""
        rows = rows.filter((~F.col("moving") & (F.col("step") == steps)) if ends else F.expr("NOT moving OR (step = 0 AND stage = 0)"))
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(scratch_path(spark))
        return rows.select("seed_id", "step", F.slice("state", 1, stepper.wanted).alias("state")).checkpoint()

    try:
        whole = F.forall("state", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
        begin = seeds.filter(whole).select(F.col("seed_id").cast("long"), F.lit(0).alias("step"), F.lit(0).alias("stage"), F.lit(steps > 0).alias("moving"), "state", F.slice("state", 1, d).alias("q"))
        if _whole_grid(mesh):
            return told(reduce(DataFrame.unionByName, _on_grid(begin, mesh, values, stepper, steps, kept, ends)))
        simplices = kept(gm.simplices(meshes.Mesh(known, mesh.cells, mesh.axes), F.lit(0.0), tuple(names)).drop("values"), "simplices")
        boxes, inside = dealt(simplices, mesh, kept)
        placed = lambda rows: boxes.of(rows, [F.get("q", F.lit(k)) for k in range(d)]).drop("q")
        # of simplices in one box, in one order
        packed = inside.groupBy("level", "place").agg(F.sort_array(F.collect_list(F.struct("domain_id", "cell_id", "part", "points"))).alias("s"))
        packed = packed.select("level", "place", F.flatten(F.transform("s", lambda s: s["points"])).alias("block"))
        blocks = kept(packed.sortWithinPartitions("place", "level"), "blocks")
        fold, edges = F.pow(F.lit(2.0), F.col("level")), []
        for k in range(d):
            side = fold.cast("long") * boxes.each[k]
            i = F.expr("place") if k == d - 1 else F.floor(F.col("place") / (F.pow(fold, F.lit(d - 1 - k)) * float(boxes.beyond(k, 0))))
            edge = lambda j, k=k: F.lit(boxes.low[k]) + j * (F.lit(boxes.wide[k]) / fold)
            edges.append((F.when(i % side == 0, F.lit(float("-inf"))).otherwise(edge(i % side)), F.when(i % side == side - 1, F.lit(float("inf"))).otherwise(edge(i % side + 1))))
        limits = F.struct(F.array(*(a for a, _ in edges)).alias("low"), F.array(*(b for _, b in edges)).alias("high"))
        n, rounds = 0, [kept(placed(begin), "0")]
        while asked := [r[0] for r in rounds[-1].filter("moving").select("place").distinct().limit(NAMED + 1).collect()]:
            at = rounds[-1].filter("moving").drop("moving")
            counts = at.groupBy("level", "place").agg(F.count("*").alias("n"))
            salt = F.pmod(F.xxhash64("seed_id", "step"), F.ceil(F.col("n") / CHUNK))
            chunks = at.join(counts, ["level", "place"]).groupBy("level", "place", salt.alias("salt")).agg(F.collect_list(F.struct("seed_id", "step", "stage", "state")).alias("chunk"))
            near = blocks.filter(F.col("place").isin(asked)) if len(asked) <= NAMED else blocks
            met = near.join(chunks, ["level", "place"]).select("block", limits.alias("box"), "chunk")
            n += 1
            spark.conf.set(setting, "8")
            rounds.append(kept(placed(met.mapInArrow(run, frontier_schema)), str(n)))
            spark.conf.set(setting, usual)
        last = spark.read.schema(rounds[0].schema).parquet(*(f"{root}/{k}" for k in range(n + 1)))
        return told(last)
    finally:
        spark.conf.set(setting, usual)
        remove(spark, root)


def streamlines(seeds: DataFrame, mesh: meshes.Mesh, field: str, steps: int, step_size: float, ends: bool = False) -> DataFrame:
    """(seed_id, step, x, y, z): paths (or their ends) in a vertex vector field of any mesh, linear
    in its simplices or between a uniform grid's vertices, by fourth-order Runge-Kutta steps."""
    d, zero = len(mesh.axes), [F.lit(0.0)] * (3 * len(mesh.axes))
    begin = seeds.select("seed_id", F.array(*(F.col(c).cast("double") for c in mesh.axes), *zero).alias("state"))
    rows = carried(begin, mesh, [F.col(field)[c] for c in mesh.axes], RungeKutta(d, step_size), steps, ends)
    return rows.select("seed_id", "step", *(F.get("state", F.lit(k)).alias(c) for k, c in enumerate(mesh.axes)))


def charged(seeds: DataFrame, mesh: meshes.Mesh, electric: str, magnetic: str, steps: int, step_size: float, speed_of_light: float | None = None) -> DataFrame:
    """(seed_id, step, x, y, z, px, py, pz, weighting): charged particles in two vertex
    vector fields, by the Boris push. seeds: (seed_id, x, y, z, px, py, pz, mass, charge,
    weighting)."""
    if len(mesh.axes) != 3:
        raise ValueError("charged particles need a mesh in space")
    begin = seeds.select("seed_id", F.array(*(F.col(c).cast("double") for c in ("x", "y", "z", "px", "py", "pz", "mass", "charge", "weighting"))).alias("state"))
    rows = carried(begin, mesh, [F.col(f)[c] for f in (electric, magnetic) for c in mesh.axes], Boris(step_size, speed_of_light), steps)
    at = {c: F.get("state", F.lit(k)) for k, c in enumerate(("x", "y", "z", "px", "py", "pz"))} | {"weighting": F.get("state", F.lit(8))}
    return rows.select("seed_id", "step", *(v.alias(c) for c, v in at.items()))

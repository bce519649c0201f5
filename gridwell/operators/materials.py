"""Material interfaces: cells cut to pieces of one material each.

Fractions are given for cells. At a vertex, a material's fraction is the mean over
the cells around it, so that an interface follows what lies next to a cell. Within
a cell one material after another, by name, takes the part of what is left where
its vertex fractions are greatest, down to the level at which that part has
exactly the volume that the cell's fraction says; the last one takes the rest.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import geometry as gm
from . import mesh as meshes

#: Steps of the search for a level, most of which takes some ten.
STEPS = 200
#: How much a place counts beside fractions, so that no function is level anywhere.
TILT = 1e-6


def share_below(values: np.ndarray, level: np.ndarray) -> np.ndarray:
    """The share of each simplex where a linear function with these values at its
    corners isn't above a level; by the recurrence of splines over sorted values."""
    return _share_below(np.sort(values, 1).T.copy(), level)


def _share_below(v: np.ndarray, level: np.ndarray) -> np.ndarray:
    """The same of values that rise, with a row for each corner."""
    share = [(level >= x).astype(float) for x in v]
    for n in range(1, len(v)):
        for k in range(len(v) - n):
            low, wide = v[k], v[k + n] - v[k]
            # a level beyond a steep simplex would magnify what rounding leaves
            t = np.clip((level - low) / np.where(wide > 0, wide, 1), 0, 1) * (wide > 0)
            share[k] = share[k + 1] + t * (share[k] - share[k + 1])
    return share[0]


def _sizes(p: np.ndarray) -> np.ndarray:
    return np.abs(np.linalg.det(p[:, 1:] - p[:, :1])) / (2 if p.shape[1] == 3 else 6)


def _spread(values: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest value of each owner; 0 for those without a row."""
    low, high = np.full(n, np.inf), np.full(n, -np.inf)
    np.minimum.at(low, owner, values.min(1))
    np.maximum.at(high, owner, values.max(1))
    there = np.isfinite(low)
    return np.where(there, low, 0.0), np.where(there, high, 0.0)


def _unit(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Values put between 0 and 1 for each owner."""
    low, high = _spread(values, owner, n)
    wide = np.where(high > low, high - low, 1)
    return (values - low[owner, None]) / wide[owner, None]


def _levels(owner: np.ndarray, ordered: np.ndarray, size: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Of each owner, the least level within rounding below which its simplices have the
    wanted size; ordered: a row for each corner, of values that rise. By Chandrupatla's
    method, on the owners whose level isn't known yet."""
    n = len(wanted)
    low, high = _spread(ordered.T, owner, n)
    out, ids = high.copy(), np.arange(n)
    near = np.finfo(float).eps * np.maximum(np.abs(low), np.abs(high))

    def beyond(level):
        return np.bincount(owner, size * _share_below(ordered, level[owner]), minlength=len(ids)) - wanted

    a, b = low, high
    fa, fb = beyond(a), beyond(b)
    c, fc, t = a, fa, np.full(n, 0.5)
    for step in range(STEPS):
        if step:  # the new end, a, has the value that it was asked for
            a = a + t * (b - a)
            was_a, fa = fa, beyond(a)
            same = (fa >= 0) == (was_a >= 0)
            c, fc, b, fb = np.where(same, old, b), np.where(same, was_a, fb), np.where(same, b, old), np.where(same, fb, was_a)
        wide = np.abs(b - a)
        out[ids] = np.where(fa >= 0, np.where(fb >= 0, np.minimum(a, b), a), np.where(fb >= 0, b, np.maximum(a, b)))
        on = (wide > near) & (fa != 0) & (fb != 0) & ((fa >= 0) != (fb >= 0))
        if not on.any():
            break
        if not on.all():
            place, there = np.cumsum(on) - 1, on[owner]
            owner, ordered, size = place[owner[there]], ordered[:, there], size[there]
            ids, wanted, near, wide, a, b, c, fa, fb, fc = (x[on] for x in (ids, wanted, near, wide, a, b, c, fa, fb, fc))
        old = a
        with np.errstate(divide="ignore", invalid="ignore"):
            xi, phi = (a - b) / (c - b), (fa - fb) / (fc - fb)
            curve = fa / (fb - fa) * fc / (fb - fc) + (c - a) / (b - a) * fa / (fc - fa) * fb / (fc - fb)
            t = np.where((phi**2 < xi) & ((1 - phi) ** 2 < 1 - xi), curve, 0.5)
            least = np.minimum(near / wide / 2, 0.5)
        t = np.clip(np.where(np.isfinite(t), t, 0.5), least, 1 - least)
    return out


def shared_out(owner: np.ndarray, points: np.ndarray, fractions: np.ndarray, shares: np.ndarray, count: np.ndarray, axes: int):
    """(owner, slot, corners) of the pieces. owner: the cell of each simplex; points: its
    corners; fractions: at its corners, of each of its cell's materials; shares: those
    of cells, which add up to 1; count: how many materials each cell has."""
    n, width, direction = len(count), points.shape[2], np.sqrt(np.array([1.0, 2.0, 3.0])[:axes])
    rest = np.concatenate([points, fractions], 2)
    total = np.bincount(owner, _sizes(points[:, :, :axes]), minlength=n)
    owners, slots, shapes = [], [], []

    def give(which, slot, shape):
        owners.append(which)
        slots.append(np.full(len(which), slot))
        shapes.append(shape[:, :, :width])

    for slot in range(shares.shape[1]):
        last = count[owner] == slot + 1
        give(owner[last], slot, rest[last])
        owner, rest = owner[~last], rest[~last]
        if not len(owner):
            break
        size = _sizes(rest[:, :, :axes])
        # greatest fractions first: a function that rises from these
        h = -_unit(rest[:, :, width + slot], owner, n) + TILT * _unit(rest[:, :, :axes] @ direction, owner, n)
        h = h - _levels(owner, np.sort(h, 1).T.copy(), size, shares[:, slot] * total)[owner, None]
        which, shape = gm.below(h, rest, 0.0)
        give(owner[which], slot, shape)
        which, rest = gm.below(-h, rest, 0.0)
        owner = owner[which]
    return np.concatenate(owners), np.concatenate(slots), np.concatenate(shapes)


def interfaces(mesh: meshes.Mesh, materials: DataFrame, fields: tuple[str, ...] = ()) -> DataFrame:
    """(domain_id, cell_id, material, vol_frac, points, fields): pieces of cells, as
    simplices, with vertex fields interpolated to their corners.

    materials: (domain_id, cell_id, material, vol_frac). A cell's fractions count
    by their share of the cell's sum; those of 0 or less, or null, don't count, and a
    cell without any has no pieces. vol_frac of a piece is its material's in the cell.
    """
    keys, axes = ["domain_id", "cell_id"], len(mesh.axes)
    each = materials.filter("vol_frac > 0").groupBy(*keys, "material").agg(F.sum("vol_frac").alias("f"))
    of_cell = each.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("material", "f"))).alias("m"), F.sum("f").alias("whole"))
    of_cell = of_cell.select(*keys, F.transform("m", lambda x: x["material"]).alias("names"), F.transform("m", lambda x: x["f"] / F.col("whole")).alias("shares"))
    around = meshes.joined(mesh.cells.select(*keys, "conn"), of_cell, keys).withColumn("vertex_id", F.explode("conn"))
    rows = around.select("domain_id", "vertex_id", F.explode(F.arrays_zip("names", "shares")).alias("s")).groupBy("domain_id", "vertex_id", "s.names").agg(F.sum("s.shares").alias("f"))
    fractions = rows.groupBy("domain_id", "vertex_id").agg(F.collect_list(F.struct("names", "f")).alias("__f"), F.sum("f").alias("__n"))  # shares around add up to the cells around
    known = meshes.joined(mesh.vertices, fractions, ["domain_id", "vertex_id"])
    cells = meshes.gathered(meshes.Mesh(known, mesh.cells, mesh.axes), p=gm._numbers(mesh, fields), m=F.col("__f.names"), f=F.col("__f.f"), n=F.col("__n"))
    cells = meshes.joined(cells, of_cell, keys)
    at_corners = F.flatten(F.transform("c", lambda c: F.transform("names", lambda m: F.coalesce(F.get(c["f"], (F.array_position(c["m"], m) - 1).cast("int")), F.lit(0.0)) / c["n"])))
    cells = cells.select(*keys, "names", "shares", at_corners.alias("fractions"), F.flatten(F.transform("c", lambda c: c["p"])).alias("points"), F.flatten("parts").alias("parts"))
    width, k = axes + len(fields), axes + 1
    material = materials.schema["material"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            size = lambda c: c.value_lengths().to_numpy()
            before = lambda n: np.concatenate([[0], np.cumsum(n)[:-1]])
            count, corners, parts = size(batch.column(2)), size(batch.column(5)) // width, size(batch.column(6)) // k
            shares, points = np.zeros((len(count), count.max())), np.asarray(batch.column(5).flatten()).reshape(-1, width)
            cell, slot = np.repeat(np.arange(len(count)), count), np.arange(count.sum()) - np.repeat(before(count), count)
            shares[cell, slot] = np.asarray(batch.column(3).flatten())
            owner = np.repeat(np.arange(len(count)), parts)
            place = np.asarray(batch.column(6).flatten()).reshape(-1, k)
            flat, start = np.asarray(batch.column(4).flatten()), before(corners * count)
            there = start[owner, None, None] + (place * count[owner, None])[:, :, None] + np.minimum(np.arange(count.max()), count[owner, None] - 1)[:, None, :]
            owner, slot, shape = shared_out(owner, points[place + before(corners)[owner, None]], flat[there], shares, count, axes)
            wide = _sizes(shape[:, :, :axes]) > 0
            owner, slot, shape = owner[wide], slot[wide], shape[wide]
            names = batch.column(2).flatten().take(pa.array(before(count)[owner] + slot))
            yield gm._shapes(batch, owner, shape, axes, fields, material=names, vol_frac=shares[owner, slot])

    return cells.mapInArrow(run, gm._schema(fields, f"material {material}", "vol_frac double"))

"""Merge trees: extrema of a vertex field, where each one's surroundings merge into
others', and how much it stands out (its persistence).

Every vertex points to its highest neighbour, so it flows up to one maximum; what
flows to one is its basin. Where basins touch, the highest place on the way from
one to the other is their saddle. A basin whose highest saddle leads to a basin with a
higher maximum ends there: between its maximum and that saddle it is alone. All
such basins end at once and become one with those, and again, until none touch. So
the tree comes from joins and aggregations over all vertices alone; no task gets a
block or a border whole. Higher neighbours are found within groups of cells and come
together for each vertex. Minima are maxima of the field turned over.

Vertices are neighbours where they share an edge of the simplices that their cells are
cut to. Of equal values the one with the greater id counts as higher.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import number
from ..sources.tables import Kept
from . import mesh as meshes

#: Saddles that are few enough to be put in order by the driver.
FEW = 100_000


#: Groups of cells that one step of the kernel takes.
AT_ONCE = 256


def _local(mesh: meshes.Mesh, value: Column) -> DataFrame:
    """(domain_id, id, v, highs): the vertices that have higher neighbours in a group
    of cells, with these as structs (v, id). Other groups may have the same vertex."""
    d = len(mesh.axes)
    rows = meshes.grouped(mesh, v=value.cast("double"))
    rows = rows.select("domain_id", F.col("cells.conn").cast("array<array<bigint>>").alias("conn"), F.col("cells.odd").alias("odd"), F.col("ids").cast("array<bigint>").alias("ids"), F.col("at.v").alias("v"))

    def ends(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The group, id and value of each vertex, and the lower and higher ends of edges among these."""
        conn, odd, ids, v = (part.column(k) for k in range(1, 5))
        each = conn.flatten()
        group = np.repeat(np.arange(len(part)), conn.value_lengths().to_numpy())
        cell = np.repeat(np.arange(len(each)), each.value_lengths().fill_null(0).to_numpy())
        corner, there = each.flatten(), each.flatten().is_valid().to_numpy(zero_copy_only=False)
        corner, ids, v, odd = corner.fill_null(0).to_numpy(), ids.flatten().to_numpy(), v.flatten().to_numpy(zero_copy_only=False).astype(float), odd.flatten().fill_null(False).to_numpy(zero_copy_only=False)
        owner = np.repeat(np.arange(len(part)), part.column(3).value_lengths().to_numpy())
        names, which = np.unique(ids, return_inverse=True)
        key = owner * len(names) + which
        order = np.argsort(key)
        name = np.minimum(np.searchsorted(names, corner), len(names) - 1)
        at = np.minimum(np.searchsorted(key, group[cell] * len(names) + name, sorter=order), len(key) - 1)
        place = order[at]
        found = there & (names[name] == corner) & (owner[place] == group[cell]) & (ids[place] == corner)
        place, count = place[found], np.bincount(cell[found], minlength=len(each))
        begin, kind, a, b = np.cumsum(count) - count, count * 2 + odd, [], []
        for k in np.unique(kind):
            first = begin[kind == k]
            for x, y in meshes.pairs(int(k) // 2, bool(k % 2), d):
                a.append(place[first + x])
                b.append(place[first + y])
        a, b = (np.concatenate([*x, np.zeros(0, np.int64)]) for x in (a, b))
        known = ~(np.isnan(v[a]) | np.isnan(v[b])) & (a != b)
        a, b = a[known], b[known]
        up = (v[a] < v[b]) | ((v[a] == v[b]) & (ids[a] < ids[b]))
        low, high = np.divmod(np.unique(np.where(up, a, b) * len(ids) + np.where(up, b, a)), len(ids))
        return owner, ids, v, low, high

    def run(batches):
        for batch in batches:
            for part in (batch.slice(k, AT_ONCE) for k in range(0, batch.num_rows, AT_ONCE)):
                owner, ids, v, low, high = ends(part)
                first = np.flatnonzero(np.diff(low, prepend=-1))
                at = low[first]
                highs = pa.StructArray.from_arrays([pa.array(v[high]), pa.array(ids[high])], ["v", "id"])
                lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(low)), pa.int32()), highs)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(owner[at])), pa.array(ids[at]), pa.array(v[at]), lists], names=["domain_id", "id", "v", "highs"])

    return rows.mapInArrow(run, f"domain_id {rows.schema['domain_id'].dataType.simpleString()}, id long, v double, highs array<struct<v: double, id: long>>")


def _edges(mesh: meshes.Mesh, value: Column) -> DataFrame:
    """(domain_id, low, high): edges between vertices with values, as structs (v, id), the lower end first."""
    return _local(mesh, value).select("domain_id", F.struct("v", "id").alias("low"), F.explode("highs").alias("high"))


def _stars(mesh: meshes.Mesh, value: Column) -> DataFrame:
    """(domain_id, id, v, highs): each vertex that has higher neighbours, with all of these."""
    rows = meshes.spread(_local(mesh, value), "domain_id", "id")
    return rows.groupBy("domain_id", "id").agg(F.first("v").alias("v"), F.array_distinct(F.flatten(F.collect_list("highs"))).alias("highs"))


def _ends(pointers: DataFrame, tables: Kept) -> DataFrame:
    """(domain_id, id, to) of pointers that lead on, to structs (v, id), followed to where none
    leads on. Each round doubles how far they see; those at their end aren't joined again."""
    pointers = now = tables(pointers)
    done = None
    while True:
        further = pointers.select("domain_id", F.col("id").alias("__to"), F.col("to").alias("next"))
        step = tables(meshes.joined(now.withColumn("__to", F.col("to.id")), further, ["domain_id", "__to"], "left").drop("__to"))
        here = step.filter("next IS NULL").select("domain_id", "id", "to")
        done = here if done is None else done.unionByName(here)
        on = step.filter("next IS NOT NULL").select("domain_id", "id", F.col("next").alias("to"))
        if on.isEmpty():
            return tables(done)
        now = on
        pointers = done.unionByName(on)


def _named(rows: DataFrame, labels: DataFrame, column: str) -> DataFrame:
    """rows with the label of a column's vertex in place of it, where it has one."""
    found = labels.select("domain_id", F.col("id").alias("__id"), F.col("to").alias("__to"))
    rows = meshes.joined(rows.withColumn("__id", F.col(column)["id"]), found, ["domain_id", "__id"], "left")
    return rows.withColumn(column, F.coalesce("__to", column)).drop("__id", "__to")


def _small(saddles: list) -> list[tuple]:
    """The rest of the tree, of few saddles, from the highest one down: (domain_id, end, saddle, into)."""
    up: dict = {}

    def top(x):
        while x in up:
            up[x] = up.get(up[x], up[x])
            x = up[x]
        return x

    out = []
    for domain, a, b, w in sorted(saddles, key=lambda r: (tuple(r[3]), tuple(r[1]), tuple(r[2])), reverse=True):
        a, b = sorted((top((domain, *a)), top((domain, *b))), key=lambda x: x[1:])
        if a != b:
            up[a] = b
            out.append((domain, a[1:], tuple(w), b[1:]))
    return out


def _tree(mesh: meshes.Mesh, value: Column, tables: Kept) -> tuple[DataFrame, DataFrame]:
    """Pairs (domain_id, end, saddle, into), of structs (v, id), and basins (domain_id, id, to)."""
    spark, keys = mesh.vertices.sparkSession, ["domain_id", "a", "b"]
    stars = tables(_stars(mesh, value))
    basins = _ends(stars.select("domain_id", "id", F.array_max("highs").alias("to")), tables)
    # the highest neighbour is in a vertex's own basin; each other one may be in another
    touching = _named(stars.select("domain_id", F.struct("v", "id").alias("w"), F.struct("v", "id").alias("a"), F.array_remove("highs", F.array_max("highs")).alias("highs")), basins, "a")
    touching = _named(touching.select("domain_id", "w", "a", F.explode("highs").alias("b")), basins, "b")
    touching = touching.filter("a.id <> b.id").select("domain_id", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "w")
    saddles, pairs = tables(meshes.spread(touching, *keys).groupBy(*keys).agg(F.max("w").alias("w"))), []
    kind, domain = (stars.select(c).schema[0].dataType.simpleString() for c in (F.struct("v", "id"), "domain_id"))
    while True:
        if saddles.count() <= FEW:
            pairs.append(spark.createDataFrame(_small(saddles.collect()), f"domain_id {domain}, end {kind}, saddle {kind}, into {kind}"))
            break
        both = saddles.unionByName(saddles.select("domain_id", F.col("b").alias("a"), F.col("a").alias("b"), "w"))
        best = both.groupBy("domain_id", "a").agg(F.max(F.struct("w", "b")).alias("s"))
        over = tables(best.filter("s.b > a").select("domain_id", F.col("a").alias("end"), F.col("s.w").alias("saddle"), F.col("s.b").alias("into")))
        pairs.append(over)
        lead = _ends(over.select("domain_id", F.col("end.id").alias("id"), F.col("into").alias("to")), tables)
        left = _named(_named(saddles, lead, "a"), lead, "b").filter("a.id <> b.id")
        left = left.select("domain_id", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "w")
        saddles = tables(meshes.spread(left, *keys).groupBy(*keys).agg(F.max("w").alias("w")))
    out = pairs[0]
    for p in pairs[1:]:
        out = out.unionByName(p)
    return out, basins


def _value(field: str | Column, minima: bool) -> Column:
    v = number(F.col(field) if isinstance(field, str) else field)
    return -v if minima else v


def extrema(mesh: meshes.Mesh, field: str | Column, minima: bool = False) -> DataFrame:
    """(domain_id, vertex_id, value, saddle_id, saddle, persistence, into): a row for
    each maximum (or minimum) of a vertex field. Its surroundings merge at a saddle
    into those of another one, in the end that of vertex ``into``; the highest of each
    connected part never merges, and has nulls there. Vertices without a number, and
    those of no cell, take no part."""
    sign = F.lit(-1.0 if minima else 1.0)
    with Kept(mesh.vertices.sparkSession) as tables:
        pairs, basins = _tree(mesh, _value(field, minima), tables)
        rows = pairs.select("domain_id", F.col("end.id").alias("vertex_id"), (F.col("end.v") * sign).alias("value"), F.col("saddle.id").alias("saddle_id"), (F.col("saddle.v") * sign).alias("saddle"), F.col("into.id").alias("into"))
        tops = basins.select("domain_id", F.col("to.id").alias("vertex_id"), (F.col("to.v") * sign).alias("value")).distinct()
        alone = tops.join(rows.select("domain_id", "vertex_id"), ["domain_id", "vertex_id"], "left_anti")
        out = rows.unionByName(alone, allowMissingColumns=True).withColumn("persistence", F.abs(F.col("value") - F.col("saddle")))
        return tables.last(out.select("domain_id", "vertex_id", "value", "saddle_id", "saddle", "persistence", "into"))


def segments(mesh: meshes.Mesh, field: str | Column, persistence: float = 0.0, least: float | None = None, minima: bool = False) -> DataFrame:
    """(domain_id, vertex_id, segment): the maximum (or minimum) that each vertex belongs
    to. Those whose persistence is below a bound join the one they merge into;
    vertices below ``least`` (above it, for minima) have no row."""
    with Kept(mesh.vertices.sparkSession) as tables:
        pairs, basins = _tree(mesh, _value(field, minima), tables)
        minor = tables(pairs.filter(F.col("end.v") - F.col("saddle.v") < F.lit(float(persistence))).select("domain_id", F.col("end.id").alias("id"), F.col("into").alias("to")))
        lead = _ends(minor, tables)
        tops = basins.select("domain_id", F.col("to.id").alias("id"), F.col("to.id").alias("to")).distinct()
        rows = basins.select("domain_id", "id", F.col("to.id").alias("to")).unionByName(tops)
        found = lead.select("domain_id", F.col("id").alias("to"), F.col("to.id").alias("segment"))
        rows = rows.join(found, ["domain_id", "to"], "left").select("domain_id", F.col("id").alias("vertex_id"), F.coalesce("segment", "to").alias("segment"))
        if least is not None:
            high = mesh.vertices.filter(_value(field, minima) >= F.lit(float(-least if minima else least))).select("domain_id", "vertex_id")
            rows = rows.join(high, ["domain_id", "vertex_id"])
        return tables.last(rows)


#: How far a level lies from its saddle, so that its contour has no corner there.
BESIDE = 1e-5


def relevant_levels(mesh: meshes.Mesh, field: str | Column, levels: int) -> list[float]:
    """The values next to the saddles of the most persistent extrema, in order: a little
    above those of maxima, below those of minima. As many as asked for, or fewer
    where the field has fewer or some agree."""
    both = [extrema(mesh, field, minima).filter("saddle IS NOT NULL").withColumn("level", F.col("saddle") + (-BESIDE if minima else BESIDE)) for minima in (False, True)]
    most = both[0].unionByName(both[1]).orderBy(F.desc("persistence"), "level", "vertex_id").limit(levels).collect()
    return sorted({r["level"] for r in most})

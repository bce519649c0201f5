"""Meshes put together anew: chosen elements of any domains as new domains, with
vertices merged and numbered from 0 in each.

Numbers come from an order of rows over the whole cluster: each task counts its own,
and only the tasks' counts meet on the driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import Kept
from . import mesh as meshes

#: Places closer than this are one vertex, unless another tolerance is given.
MERGE = 1e-8


def numbered(rows: DataFrame, order: list[str], name: str, kept: Kept) -> DataFrame:
    """rows with their place in an order, from 0."""
    rows = kept(rows.orderBy(*order).withColumn("__at", F.monotonically_increasing_id()))  # a task's number, then the row's in it
    rows, counts, begin = rows.withColumn("__task", F.shiftrightunsigned("__at", 33)), [], 0
    for r in sorted(rows.groupBy("__task").count().collect()):  # a row a task
        counts.append((r["__task"], begin))
        begin += r["count"]
    first = rows.sparkSession.createDataFrame(counts, "__task long, __begin long")
    return rows.join(F.broadcast(first), "__task").withColumn(name, F.col("__begin") + F.col("__at").bitwiseAND((1 << 33) - 1)).drop("__at", "__task", "__begin")


def _from_zero(rows: DataFrame, name: str) -> DataFrame:
    """rows whose numbers begin with 0 in each domain."""
    least = rows.groupBy("domain_id").agg(F.min(name).alias("__first"))
    return rows.join(least, "domain_id").withColumn(name, F.col(name) - F.col("__first")).drop("__first")


def compacted(mesh: meshes.Mesh) -> meshes.Mesh:
    """The mesh with the vertices that its cells use, numbered from 0 in each domain in
    order of their old ids, which stay as original_vertex_id; conn has the new ones."""
    keys = ["domain_id", "vertex_id"]
    with Kept(mesh.cells.sparkSession) as kept:
        used = mesh.cells.select("domain_id", F.explode("conn").alias("vertex_id")).distinct().join(mesh.vertices, keys)
        known = kept.last(_from_zero(numbered(used, keys, "__new", kept), "__new"))
    corners = mesh.cells.select("domain_id", "cell_id", F.posexplode("conn").alias("corner", "vertex_id")).join(known.select(*keys, "__new"), keys)
    conn = corners.groupBy("domain_id", "cell_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("corner", "__new"))), lambda x: x["__new"]).alias("conn"))
    cells = mesh.cells.drop("conn").join(conn, ["domain_id", "cell_id"]).select(*mesh.cells.columns)
    vertices = known.withColumn("original_vertex_id", F.col("vertex_id")).withColumn("vertex_id", F.col("__new")).drop("__new")
    return meshes.Mesh(vertices, cells, mesh.axes)


def _chosen(cells: DataFrame, s: dict) -> tuple[Column, Column]:
    """Whether a cell is in a selection, and what parts the selection (0: one part)."""
    domain = s.get("domain_id", "any")
    where = F.lit(True) if domain == "any" else F.col("domain_id") == domain
    whole, kind = F.lit(0.0), s["type"]
    if kind == "explicit":
        where &= F.col("cell_id").isin([int(x) for x in s["elements"]])
    elif kind == "ranges":
        ends = s["ranges"]
        where &= reduce(lambda a, b: a | b, (F.col("cell_id").between(a, b) for a, b in zip(ends[::2], ends[1::2], strict=True)), F.lit(False))
    elif kind == "logical":
        names = [n for n in meshes.IJK if n in cells.columns]
        if not names:
            raise ValueError("a logical selection needs a regular grid")
        where &= reduce(lambda a, b: a & b, (F.col(n).between(a, b) for n, a, b in zip(names, s["start"], s["end"], strict=False)))
    elif kind == "field":
        where &= F.col(s["field"]).isNotNull()
        whole = F.col(s["field"]).cast("double")
    else:
        raise ValueError(f"unknown selection {kind}; known are explicit, ranges, logical, field")
    return where, whole


def partitioned(mesh: meshes.Mesh, selections: list[dict] | None = None, target: int | None = None, merge_tolerance: float = MERGE) -> meshes.Mesh:
    """A mesh of new domains.

    selections: {"type": "explicit", "elements": ids}, {"type": "ranges", "ranges":
    [first, last, first, last, ...]}, {"type": "logical", "start", "end": places on a grid,
    both included} or {"type": "field", "field": a numeric field, each value a domain},
    each with a domain_id or "any". A cell goes to the first one that has it; those in
    none go. None: each domain is one. target: so many domains, of neighbouring
    selections put together, or of selections cut evenly by their cells' order.

    Vertices of one new domain whose places, rounded to merge_tolerance, agree become
    one: the first of them, by domain and id, with its fields. New cells and vertices are
    numbered from 0 in each domain; where they come from stands in original_domain_id,
    original_cell_id and original_vertex_id. Cells keep their centres and fields.
    """
    if target is not None and target < 1:
        raise ValueError("a target is a number of domains from 1 on")
    cells = mesh.cells.drop(*meshes.IJK)
    chosen = [_chosen(mesh.cells, s) for s in selections] if selections is not None else [(F.lit(True), F.col("domain_id").cast("double"))]
    which = F.when(F.lit(False), F.struct(F.lit(0).alias("s"), F.lit(0.0).alias("v")))
    for k, (where, whole) in enumerate(chosen):
        which = which.when(where, F.struct(F.lit(k).alias("s"), whole.alias("v")))
    with Kept(mesh.cells.sparkSession) as kept:
        taken = kept(mesh.cells.select("domain_id", "cell_id", "conn", which.alias("key")).filter("key IS NOT NULL"))
        parts = numbered(taken.groupBy("key").count(), ["key"], "part", kept)
        n = parts.count()
        rank = numbered(taken.join(parts.select("key", "part", "count"), "key"), ["part", "domain_id", "cell_id"], "rank", kept)
        if target is not None and n:
            first = rank.groupBy("part").agg(F.min("rank").alias("first"))
            upto = lambda p: F.floor(p * F.lit(target) / F.lit(n))
            share = F.greatest(upto(F.col("part") + 1) - upto(F.col("part")), F.lit(1))
            new = upto(F.col("part")) + F.floor((F.col("rank") - F.col("first")) * share / F.col("count"))
            rank = rank.join(first, "part").withColumn("new", new)
        else:
            rank = rank.withColumn("new", F.col("part"))
        placed = kept(_from_zero(rank.select(F.col("new").cast("int").alias("domain_id"), "rank", F.col("domain_id").alias("original_domain_id"), F.col("cell_id").alias("original_cell_id"), "conn").withColumn("cell_id", F.col("rank")), "cell_id"))
        corners = placed.select("domain_id", "cell_id", "original_domain_id", F.posexplode("conn").alias("corner", "original_vertex_id"))
        old = mesh.vertices.drop(*meshes.IJK).withColumnsRenamed({"domain_id": "original_domain_id", "vertex_id": "original_vertex_id"})
        places = [F.round(F.col(c) / F.lit(float(merge_tolerance))).alias(f"__{c}") if merge_tolerance > 0 else F.col(c).alias(f"__{c}") for c in mesh.axes]
        at = kept(corners.join(old.select("original_domain_id", "original_vertex_id", *places), ["original_domain_id", "original_vertex_id"]))
        same = ["domain_id", *(f"__{c}" for c in mesh.axes)]
        merged = at.groupBy(*same).agg(F.min(F.struct("original_domain_id", "original_vertex_id")).alias("o")).select(*same, "o.*")
        merged = kept(_from_zero(numbered(merged, ["domain_id", "original_domain_id", "original_vertex_id"], "vertex_id", kept), "vertex_id"))
        vertices = kept.last(merged.drop(*same[1:]).join(old, ["original_domain_id", "original_vertex_id"]))
        conn = at.join(merged.select(*same, "vertex_id"), same).groupBy("domain_id", "cell_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("corner", "vertex_id"))), lambda x: x["vertex_id"]).alias("conn"))
        cells = cells.drop("conn").withColumnsRenamed({"domain_id": "original_domain_id", "cell_id": "original_cell_id"})
        out = placed.drop("conn", "rank").join(conn, ["domain_id", "cell_id"])
        return meshes.Mesh(vertices, kept.last(out).join(cells, ["original_domain_id", "original_cell_id"]), mesh.axes)

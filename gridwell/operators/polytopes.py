"""Polygons and polyhedra: cells of any number of vertices or faces.

A polygon is a cell of a mesh in a plane whose conn has its vertices in turn. A
polyhedron has a list of faces, and a face, which neighbours share, its vertices
in turn. Both are cut to sides: triangles between an edge and the centre of its
polygon, or tetrahedra between an edge, the centre of its face and the centre of its
cell. Sides are an explicit mesh, on which every other operator works; they keep
their cell's fields and its id. A cell must see all of its edges from its centre, the
mean of its vertices, as convex ones do.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import mesh as meshes


@dataclass
class Polyhedra:
    """vertices (vertex_id, coordinates, fields), cells (cell_id, faces: ids, fields) and
    faces (face_id, conn), with a domain_id in all or none."""

    vertices: DataFrame
    cells: DataFrame
    faces: DataFrame
    axes: tuple[str, ...] = meshes.XYZ

    def __post_init__(self):
        keyed = ((self.vertices, "vertex_id"), (self.cells, "cell_id"), (self.faces, "face_id"))
        self.vertices, self.cells, self.faces = (meshes.one_domain(df, key) for df, key in keyed)


def _ring(conn: Column) -> Column:
    """Edges of a ring of vertices, as pairs in turn."""
    return F.transform(conn, lambda v, k: F.struct(v.alias("a"), F.get(conn, (k + 1) % F.size(conn)).alias("b")))


def _numeric(vertices: DataFrame, axes) -> list[str]:
    kinds = ("double", "float", "integer", "long", "short", "byte")
    return [f.name for f in vertices.schema.fields if f.name not in {"domain_id", "vertex_id", *meshes.IJK} and (f.name in axes or f.dataType.typeName() in kinds)]


def _centres(of: DataFrame, key: str, vertices: DataFrame, names: list[str]) -> DataFrame:
    """(domain_id, key, fields): the means over each one's different vertices; of has (domain_id, key, vertex_id)."""
    at = vertices.select("domain_id", "vertex_id", *names)
    return of.distinct().join(at, ["domain_id", "vertex_id"]).groupBy("domain_id", key).agg(*(F.avg(n).alias(n) for n in names))


def _above(rows: DataFrame, key: str) -> Column:
    """The number after the greatest id."""
    return F.lit((rows.agg(F.max(key)).first()[0] or 0) + 1)


def polygon_sides(mesh: meshes.Mesh) -> meshes.Mesh:
    """The triangles of a mesh of polygons. Their ids go on from one cell to the next by
    the most edges that any has; the cell's own stays as parent_cell. Each polygon's
    centre is a vertex, with the means of numeric fields."""
    if len(mesh.axes) != 2:
        raise ValueError("polygons lie in a plane")
    names, edges = _numeric(mesh.vertices, mesh.axes), mesh.cells.select("*", F.posexplode(_ring(F.col("conn"))).alias("part", "edge"))
    centre = F.col("cell_id") + _above(mesh.vertices, "vertex_id")
    stride = mesh.cells.agg(F.max(F.size("conn"))).first()[0] or 1
    cells = edges.withColumns({"parent_cell": F.col("cell_id"), "conn": F.array(F.col("edge.a"), F.col("edge.b"), centre), "cell_id": F.col("cell_id") * stride + F.col("part")}).drop("part", "edge", *meshes.IJK)
    corners = mesh.cells.select("domain_id", "cell_id", F.explode("conn").alias("vertex_id"))
    added = _centres(corners, "cell_id", mesh.vertices, names).withColumn("vertex_id", centre).drop("cell_id")
    vertices = mesh.vertices.select("domain_id", "vertex_id", *names).unionByName(added.select("domain_id", "vertex_id", *(F.col(n).cast("double").alias(n) for n in names)), allowMissingColumns=True)
    return meshes.explicit(vertices, cells, mesh.axes)


def polyhedron_sides(solid: Polyhedra) -> meshes.Mesh:
    """The tetrahedra of polyhedra, as polygon_sides has triangles. Centres of faces are
    shared by the cells on both sides, so neighbours fit together."""
    names = _numeric(solid.vertices, solid.axes)
    faces = solid.faces.select("domain_id", "face_id", "conn")
    corners = faces.select("domain_id", "face_id", F.explode("conn").alias("vertex_id"))
    above = _above(solid.vertices, "vertex_id")
    beyond = above + _above(faces, "face_id")
    fields = [c for c in solid.cells.columns if c not in {"domain_id", "cell_id", "faces", "conn", "parent_cell"}]
    # a cell's fields go with its faces: they are a quarter of its sides, which so come without a shuffle
    own = [F.struct(*(F.col(c) for c in fields)).alias("own")] if fields else []
    of_cells = solid.cells.select("domain_id", "cell_id", *own, F.posexplode("faces").alias("place", "face_id")).join(faces, ["domain_id", "face_id"])
    edges = of_cells.select("domain_id", "cell_id", *(["own"] if fields else []), "place", "face_id", F.posexplode(_ring(F.col("conn"))).alias("turn", "edge"))
    longest, most = faces.agg(F.max(F.size("conn"))).first()[0] or 1, solid.cells.agg(F.max(F.size("faces"))).first()[0] or 1
    part, stride = F.col("place") * longest + F.col("turn"), longest * most
    conn = F.array(F.col("edge.a"), F.col("edge.b"), F.col("face_id") + above, F.col("cell_id") + beyond)
    ids = {"parent_cell": F.col("cell_id"), "cell_id": F.col("cell_id") * stride + part}
    sides = edges.select("domain_id", *(v.alias(n) for n, v in ids.items()), conn.alias("conn"), *(F.col("own")[c].alias(c) for c in fields))
    inside = of_cells.select("domain_id", "cell_id", F.explode("conn").alias("vertex_id"))
    added = [
        _centres(corners, "face_id", solid.vertices, names).withColumn("vertex_id", F.col("face_id") + above).drop("face_id"),
        _centres(inside, "cell_id", solid.vertices, names).withColumn("vertex_id", F.col("cell_id") + beyond).drop("cell_id"),
    ]
    vertices = reduce(DataFrame.unionByName, [solid.vertices.select("domain_id", "vertex_id", *(F.col(n).cast("double").alias(n) for n in names)), *added])
    return meshes.explicit(vertices, sides, solid.axes)


def polyhedron_boundary(solid: Polyhedra) -> DataFrame:
    """(domain_id, face_id, cell_id, conn): the faces that one cell alone has."""
    rows = solid.cells.select("domain_id", "cell_id", F.explode("faces").alias("face_id")).groupBy("domain_id", "face_id").agg(F.count("*").alias("n"), F.min("cell_id").alias("cell_id"))
    return rows.filter("n = 1").drop("n").join(solid.faces.select("domain_id", "face_id", "conn"), ["domain_id", "face_id"])

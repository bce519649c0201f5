"""Meshes: tables of vertices and cells.

vertices(domain_id, vertex_id, x, y[, z], fields), cells(domain_id, cell_id, conn,
centres, fields). Regular grids also have i, j, k, so that a neighbour is an
equi-join or a window away.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numeric import number
from .reductions import bounds

IJK, XYZ = ("i", "j", "k"), ("x", "y", "z")


@dataclass
class Mesh:
    vertices: DataFrame
    cells: DataFrame
    axes: tuple[str, ...] = XYZ
    dims: tuple[int, ...] = ()  # vertices on each axis of a regular grid
    origin: tuple[float, ...] = ()
    spacing: tuple[float, ...] = ()


#: Bytes that the tables under a mesh take, as Spark estimates them, for each task of a shuffle, and most tasks.
BYTES_A_TASK, MOST_TASKS = 1 << 22, 100_000


def _tasks(rows: DataFrame) -> int:
    """Tasks for a shuffle of rows by the tables under them, each counted once."""
    leaves = rows._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = {str(leaves.apply(k).canonicalized().hashCode()): int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size())}
    return sum(x for x in sizes.values() if x < 1 << 60) // BYTES_A_TASK  # a table of unknown size has the greatest


def spread(rows: DataFrame, *keys: str, like: DataFrame | None = None) -> DataFrame:
    """rows dealt by keys to more tasks than ``spark.sql.shuffle.partitions``, where the
    tables that they (or like) come from are too large for so few; else as they are."""
    usual = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = min(_tasks(rows if like is None else like), MOST_TASKS)
    return rows.repartition(n, *keys) if n > usual else rows


def joined(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Two large tables joined, in as many tasks as the tables under both need."""
    usual, n = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(_tasks(left) + _tasks(right), MOST_TASKS)
    deal = lambda rows: rows.repartition(n, *keys) if n > usual else rows
    return deal(left).join(deal(right), keys, how)


def one_domain(df: DataFrame, key: str, domain_id: int = 0) -> DataFrame:
    """df with a domain_id. It is no literal: Spark would leave that out of the keys of
    joins but not of groups, and then find neither what is dealt by both nor what no one needs."""
    return df if "domain_id" in df.columns else df.withColumn("domain_id", (F.pmod(F.xxhash64(key), F.lit(1)) + domain_id).cast("int"))


def _unravel(id_: Column, dims) -> list[Column]:
    out, stride = [], 1
    for n in dims:
        out.append((F.floor(id_ / stride) % n).cast("int"))
        stride *= n
    return out


def uniform(spark: SparkSession, dims, origin=None, spacing=None, domain_id: int = 0) -> Mesh:
    """A uniform grid of 1 to 3 axes; the first axis goes fastest in ids."""
    d = len(dims)
    origin, spacing = tuple(map(float, origin or (0,) * d)), tuple(map(float, spacing or (1,) * d))
    total = reduce(lambda a, b: a * b, dims)
    rows = one_domain(spark.range(total), "id", domain_id).select("domain_id", F.col("id").alias("vertex_id"), *(c.alias(n) for n, c in zip(IJK, _unravel(F.col("id"), dims), strict=False)))
    vertices = rows.select("*", *((F.lit(o) + F.col(n) * s).alias(c) for n, c, o, s in zip(IJK, XYZ, origin, spacing, strict=False)))
    sides = [n - 1 for n in dims]
    cells = one_domain(spark.range(reduce(lambda a, b: a * b, sides)), "id", domain_id).select("domain_id", F.col("id").alias("cell_id"), *(c.alias(n) for n, c in zip(IJK, _unravel(F.col("id"), sides), strict=False)))
    strides = [reduce(lambda a, b: a * b, dims[:k], 1) for k in range(d)]
    base = reduce(lambda a, b: a + b, (F.col(n).cast("long") * s for n, s in zip(IJK, strides, strict=False)))
    corners = {1: [(0,), (1,)], 2: [(0, 0), (1, 0), (1, 1), (0, 1)], 3: [(0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0), (0, 0, 1), (1, 0, 1), (1, 1, 1), (0, 1, 1)]}[d]
    conn = F.array(*(base + sum(c * s for c, s in zip(k, strides, strict=True)) for k in corners))
    centres = ((F.lit(o) + (F.col(n) + 0.5) * s).alias(c) for n, c, o, s in zip(IJK, XYZ, origin, spacing, strict=False))
    return Mesh(vertices, cells.select("*", conn.alias("conn"), *centres), XYZ[:d], tuple(dims), origin, spacing)


def rectilinear(spark: SparkSession, *coordinates, domain_id: int = 0) -> Mesh:
    """A grid with the given coordinates on each axis."""
    mesh = uniform(spark, [len(c) for c in coordinates], domain_id=domain_id)
    known = [F.array(*(F.lit(float(v)) for v in c)) for c in coordinates]
    at = {c: F.get(a, F.col(n)) for c, a, n in zip(XYZ, known, IJK, strict=False)}
    middle = {c: (F.get(a, F.col(n)) + F.get(a, F.col(n) + 1)) / 2 for c, a, n in zip(XYZ, known, IJK, strict=False)}
    return Mesh(mesh.vertices.withColumns(at), mesh.cells.withColumns(middle), mesh.axes, mesh.dims)


def explicit(vertices: DataFrame, cells: DataFrame, axes=XYZ) -> Mesh:
    """A mesh of any cells: vertices (vertex_id, coordinates, fields) and cells
    (cell_id, conn: their vertices' ids, fields), with a domain_id in both or
    neither. Cells get their centres: the means of their vertices."""
    vertices, cells = one_domain(vertices, "vertex_id"), one_domain(cells, "cell_id")
    corners = with_vertices(cells.select("domain_id", "cell_id", F.explode("conn").alias("vertex_id")), vertices.select("domain_id", "vertex_id", *axes))
    centres = corners.groupBy("domain_id", "cell_id").agg(*(F.avg(c).alias(c) for c in axes))
    # a left join: Spark leaves it out where centres aren't asked for
    return Mesh(vertices, cells.drop(*axes).join(centres, ["domain_id", "cell_id"], "left"), tuple(axes))


def with_vertices(corners: DataFrame, at: DataFrame, *keys: str) -> DataFrame:
    """corners (domain_id, cell_id, vertex_id, ..) with the columns of their vertices, dealt by cells, or by keys."""
    by = ["domain_id", "vertex_id"]
    return spread(spread(corners, *by).join(spread(at, *by, like=corners), by), *(keys or ("domain_id", "cell_id")), like=corners)


#: Ids of cells that go together. Vertices come once to each group, and are looked up in it one by one.
TOGETHER = 64


def grouped(mesh: Mesh, **columns: Column) -> DataFrame:
    """(domain_id, __group, cells, ids, at): each group of TOGETHER cell ids with its
    cells (cell_id, odd, conn), their vertices' ids, and columns of these."""
    keys = ["domain_id", "__group"]
    own = F.struct("cell_id", is_odd(mesh.cells).alias("odd"), "conn").alias("cell")
    cells = spread(mesh.cells.select("domain_id", F.floor(F.col("cell_id") / TOGETHER).alias("__group"), own), *keys, like=mesh.cells)
    cells = cells.groupBy(*keys).agg(F.collect_list("cell").alias("cells"))
    used = cells.select(*keys, F.explode(F.array_distinct(F.flatten("cells.conn"))).alias("vertex_id"))
    at = mesh.vertices.select("domain_id", "vertex_id", F.struct(*(v.alias(k) for k, v in columns.items())).alias("at"))
    there = with_vertices(used, at, *keys).groupBy(*keys).agg(F.collect_list("vertex_id").alias("ids"), F.collect_list("at").alias("at"))
    return cells.join(there, keys)  # both lists as they are: what is made of one here would be made again for each corner


def gathered(mesh: Mesh, **columns: Column) -> DataFrame:
    """(domain_id, cell_id, c, parts): of each cell, columns of its vertices in order of
    its corners, and how it is cut: rows of places among its corners.

    Cells whose ids follow each other mostly share vertices: these come once to each
    group of TOGETHER ids, not once to each corner. All else happens where it lies."""
    rows = grouped(mesh, **columns)

    def corners(cell: Column) -> Column:
        found = F.transform(cell["conn"], lambda v: F.get("at", (F.array_position("ids", v) - 1).cast("int")))
        return F.struct(cell["cell_id"].alias("cell_id"), cell["odd"].alias("odd"), F.filter(found, lambda x: x.isNotNull()).alias("c"))

    rows = rows.select("domain_id", F.inline(F.transform("cells", corners))).filter(F.size("c") > 0)
    whole = F.array(F.transform("c", lambda _, k: k))
    return rows.select("domain_id", "cell_id", "c", F.coalesce(pieces(F.size("c"), F.col("odd"), len(mesh.axes)), whole).alias("parts"))


def sized(rows: DataFrame, axes) -> DataFrame:
    """Cells as gathered with their places (p): with their extents and length, area or volume."""
    d = len(axes)
    along = lambda k: F.transform("c", lambda c: c["p"][k])
    rows = rows.withColumns({f"d{c}": F.array_max(along(k)) - F.array_min(along(k)) for k, c in enumerate(axes)})
    name = {1: "length", 2: "area", 3: "volume"}[d]
    if d == 1:
        return rows.withColumn(name, F.col("dx"))
    place = lambda f, i, k: F.get(F.get("c", F.get(f, F.lit(i)))["p"], F.lit(k))
    turned = lambda f: _det([[place(f, i, k) - place(f, 0, k) for k in range(d)] for i in range(1, d + 1)])
    size = (lambda f: turned(f) / 2) if d == 2 else (lambda f: F.abs(turned(f)) / 6)  # triangles of a polygon that isn't convex turn both ways
    return rows.withColumn(name, F.abs(F.aggregate("parts", F.lit(0.0), lambda n, f: n + size(f))))


def measures(mesh: Mesh) -> DataFrame:
    """cells with the extent on each axis (dx, dy, dz), and length, area or volume:
    that of the simplices they are cut to, which is a cell's own if its faces are flat."""
    rows = sized(gathered(mesh, p=F.array(*(F.col(c).cast("double") for c in mesh.axes))), mesh.axes)
    return joined(mesh.cells, rows.drop("c", "parts"), ["domain_id", "cell_id"])


def to_vertices(mesh: Mesh, field: str, output: str | None = None) -> DataFrame:
    """(domain_id, vertex_id, field): the mean over the cells around each vertex."""
    rows = mesh.cells.select("domain_id", F.explode("conn").alias("vertex_id"), F.col(field).alias("v"))
    return rows.groupBy("domain_id", "vertex_id").agg(F.avg("v").alias(output or field))


def to_cells(mesh: Mesh, field: str, output: str | None = None) -> DataFrame:
    """(domain_id, cell_id, field): the mean over each cell's vertices."""
    rows = mesh.cells.select("domain_id", "cell_id", F.explode("conn").alias("vertex_id"))
    rows = rows.join(mesh.vertices.select("domain_id", "vertex_id", F.col(field).alias("v")), ["domain_id", "vertex_id"])
    return rows.groupBy("domain_id", "cell_id").agg(F.avg("v").alias(output or field))


def slopes(grid: DataFrame, fields: dict[str, Column], axes=XYZ) -> DataFrame:
    """Rows of a regular grid with a struct of slopes for each field, under its name:
    central differences inside, one-sided ones on the border.

    A window runs along one line of the grid at a time, so no task holds more
    than some lines; each axis has one window over all fields.
    """
    rows = grid.withColumns({f"__v{k}": number(v) for k, v in enumerate(fields.values())})
    names = IJK[: len(axes)]
    for n, c in zip(names, axes, strict=True):
        w = Window.partitionBy("domain_id", *(x for x in names if x != n)).orderBy(n)
        over = lambda x, w=w: F.coalesce(F.lead(x).over(w), F.col(x)) - F.coalesce(F.lag(x).over(w), F.col(x))
        rows = rows.withColumns({f"__step_{c}": over(c), **{f"__d{k}_{c}": over(f"__v{k}") for k in range(len(fields))}})
    of = lambda k: F.struct(*(F.try_divide(f"__d{k}_{c}", f"__step_{c}").alias(c) for c in axes))
    kept = [c for c in grid.columns if c not in fields]
    return rows.select(*kept, *(of(k).alias(name) for k, name in enumerate(fields)))


def gradient(grid: DataFrame, field: str | Column, axes=XYZ, output: str = "gradient") -> DataFrame:
    """Rows of a regular grid with a struct of the field's slopes."""
    return slopes(grid, {output: F.col(field) if isinstance(field, str) else field}, axes)


def cell_slopes(mesh: Mesh, fields: dict[str, Column]) -> DataFrame:
    """(domain_id, cell_id, a struct of slopes for each field) on any mesh: the plane
    through a cell's vertices by least squares, which on boxes is the slope in
    the middle. Vertex fields; a cell without room along an axis has no slopes."""
    axes, d = mesh.axes, len(mesh.axes)
    corners = mesh.cells.select("domain_id", "cell_id", F.explode("conn").alias("vertex_id"))
    at = mesh.vertices.select("domain_id", "vertex_id", *(number(F.col(c)).alias(f"__x{k}") for k, c in enumerate(axes)), *(number(v).alias(f"__v{k}") for k, v in enumerate(fields.values())))
    both = lambda a, b: F.covar_pop(a, b).alias(f"{a}{b}")
    sums = [both(f"__x{a}", f"__x{b}") for a in range(d) for b in range(a, d)] + [both(f"__x{a}", f"__v{k}") for a in range(d) for k in range(len(fields))]
    rows = with_vertices(corners, at).groupBy("domain_id", "cell_id").agg(*sums)
    spread = [[F.col(f"__x{min(a, b)}__x{max(a, b)}") for b in range(d)] for a in range(d)]
    whole = spread[0][0] if d == 1 else _det(spread)

    def slope(k: int, axis: int) -> Column:
        with_f = [[F.col(f"__x{a}__v{k}") if b == axis else spread[a][b] for b in range(d)] for a in range(d)]
        return F.try_divide(with_f[0][0] if d == 1 else _det(with_f), whole)

    return rows.select("domain_id", "cell_id", *(F.struct(*(slope(k, i).alias(c) for i, c in enumerate(axes))).alias(name) for k, name in enumerate(fields)))


def any_slopes(mesh: Mesh, fields: dict[str, Column], on: str = "vertex") -> DataFrame:
    """The vertices, or cells, of any mesh with a struct of slopes for each vertex
    field: of cells by cell_slopes, at vertices the mean over the cells around them."""
    found = cell_slopes(mesh, fields)
    if on == "element":
        return joined(mesh.cells.drop(*fields), found, ["domain_id", "cell_id"], "left")
    corners = joined(mesh.cells.select("domain_id", "cell_id", "conn"), found, ["domain_id", "cell_id"]).withColumn("vertex_id", F.explode("conn")).drop("conn")
    means = spread(corners, "domain_id", "vertex_id").groupBy("domain_id", "vertex_id").agg(*(F.struct(*(F.avg(F.col(name)[c]).alias(c) for c in mesh.axes)).alias(name) for name in fields))
    return joined(mesh.vertices.drop(*fields), means, ["domain_id", "vertex_id"], "left")


def components(vector: str, axes) -> dict[str, Column]:
    """The fields whose slopes make a vector field's jacobian."""
    return {f"__g_{c}": F.col(vector)[c] for c in axes}


def of_jacobian(kind: str, axes) -> Column:
    """Divergence, vorticity (on two axes its z alone) or Q-criterion (-1/2 of the
    trace of the gradient's square: what rotation has over strain), of columns
    __g_<component>."""
    g = lambda a, b: F.col(f"__g_{a}")[b]
    if kind == "divergence":
        return reduce(lambda a, b: a + b, (g(c, c) for c in axes))
    if kind == "vorticity":
        z = g("y", "x") - g("x", "y")
        parts = [z.alias("z")] if len(axes) == 2 else [(g("z", "y") - g("y", "z")).alias("x"), (g("x", "z") - g("z", "x")).alias("y"), z.alias("z")]
        return F.struct(*parts)
    return reduce(lambda a, b: a + b, (g(a, b) * g(b, a) for a in axes for b in axes)) * -0.5


def _on_grid(kind: str):
    def of(grid: DataFrame, vector: str, axes=XYZ, output: str = kind) -> DataFrame:
        fields = components(vector, axes)
        return slopes(grid, fields, axes).withColumn(output, of_jacobian(kind, axes)).drop(*fields)

    return of


divergence, vorticity, qcriterion = map(_on_grid, ("divergence", "vorticity", "qcriterion"))


def transform(df: DataFrame, scale=None, translate=None, matrix=None, rotate=None, axes=XYZ) -> DataFrame:
    """Coordinates scaled, moved, turned (angle in degrees, axis) or put through a
    4 by 4 matrix of 16 numbers; exactly one of these."""
    given = [x for x in (scale, translate, matrix, rotate) if x is not None]
    if len(given) != 1:
        raise ValueError("transform: exactly one of scale, translate, matrix and rotate")
    if scale is not None:
        return df.withColumns({c: F.col(c) * float(s) for c, s in zip(axes, scale, strict=False)})
    if translate is not None:
        return df.withColumns({c: F.col(c) + float(s) for c, s in zip(axes, translate, strict=False)})
    if rotate is not None:
        matrix = rotation(*rotate)
    if len(matrix) != 16:
        raise ValueError("transform: a matrix has 16 numbers")
    at = [*(F.col(c) for c in axes), *[F.lit(0.0)] * (3 - len(axes)), F.lit(1.0)]
    return df.withColumns({c: reduce(lambda a, b: a + b, (at[k] * float(matrix[4 * r + k]) for k in range(4))) for r, c in enumerate(axes)})


def rotation(angle: float, axis) -> list[float]:
    """The matrix that turns by an angle in degrees around an axis through the origin."""
    from math import cos, radians, sin

    size = sum(a * a for a in axis) ** 0.5
    x, y, z = (a / size for a in axis)
    c, s = cos(radians(angle)), sin(radians(angle))
    t = 1 - c
    return [t * x * x + c, t * x * y - s * z, t * x * z + s * y, 0, t * x * y + s * z, t * y * y + c, t * y * z - s * x, 0, t * x * z - s * y, t * y * z + s * x, t * z * z + c, 0, 0, 0, 0, 1]


def reflect(df: DataFrame, point, axis: str) -> DataFrame:
    return df.withColumn(axis, F.lit(2.0 * float(point)) - F.col(axis))


#: Faces of cells with so many vertices, in space and in a plane.
FACES = {
    3: {8: [(0, 1, 2, 3), (4, 5, 6, 7), (0, 1, 5, 4), (1, 2, 6, 5), (2, 3, 7, 6), (3, 0, 4, 7)], 4: [(0, 1, 2), (0, 1, 3), (0, 2, 3), (1, 2, 3)], 5: [(0, 1, 2, 3), (0, 1, 4), (1, 2, 4), (2, 3, 4), (3, 0, 4)], 6: [(0, 1, 2), (3, 4, 5), (0, 1, 4, 3), (1, 2, 5, 4), (2, 0, 3, 5)]},
    2: {4: [(0, 1), (1, 2), (2, 3), (3, 0)], 3: [(0, 1), (1, 2), (2, 0)]},
}


def boundary(cells: DataFrame, axes: int = 3) -> DataFrame:
    """Faces (edges in a plane) that only one cell has, as sorted vertex ids."""
    of = lambda table: F.array(*(F.array_sort(F.array(*(F.get("conn", F.lit(k)) for k in f))) for f in table))
    faces = F.when(F.lit(False), F.array(F.col("conn")))
    for n, table in FACES[axes].items():
        faces = faces.when(F.size("conn") == n, of(table))
    if axes == 2:  # polygons
        ring = F.transform("conn", lambda v, k: F.array_sort(F.array(v, F.get("conn", (k + 1) % F.size("conn")))))
        faces = F.when(F.size("conn") > 4, ring).otherwise(faces)
    rows = cells.select("domain_id", "cell_id", F.explode(faces).alias("face"))
    return spread(rows, "domain_id", "face").groupBy("domain_id", "face").agg(F.count("*").alias("n"), F.min("cell_id").alias("cell_id")).filter("n = 1").drop("n")


TETS = [(0, 1, 3, 4), (1, 2, 3, 6), (1, 4, 5, 6), (3, 4, 6, 7), (1, 3, 4, 6)]
#: The other way to cut a hexahedron: its neighbours' cut, so that faces that two cells share are cut alike.
MIRRORED = [(1, 0, 2, 5), (0, 3, 2, 7), (0, 5, 4, 7), (2, 5, 7, 6), (0, 2, 5, 7)]
#: How a cell with so many vertices is cut, in space and in a plane: wedges, pyramids, quadrilaterals.
IN_SPACE = {6: [(0, 1, 2, 5), (0, 1, 5, 4), (0, 4, 5, 3)], 5: [(0, 1, 2, 4), (0, 2, 3, 4)]}
IN_PLANE = {4: [(0, 1, 2), (0, 2, 3)]}


def pieces(size: Column, odd: Column, axes: int = 3) -> Column:
    """How a cell with so many vertices is cut, as rows of places among its vertices:
    hexahedra, wedges, pyramids, quadrilaterals and convex polygons to simplices; null for
    simplices. odd: hexahedra are cut the other way."""
    of = lambda table: F.array(*(F.array(*map(F.lit, f)) for f in table))
    parts = F.when(size == 8, F.when(odd, of(MIRRORED)).otherwise(of(TETS)))
    for n, table in (IN_SPACE if axes == 3 else IN_PLANE).items():
        parts = parts.when(size == n, of(table))
    if axes == 2:  # a polygon: triangles from its first vertex
        parts = F.when(size > 4, F.transform(F.sequence(F.lit(1), F.greatest(size - 2, F.lit(1))), lambda k: F.array(F.lit(0), k, k + 1))).otherwise(parts)
    return parts


def pairs(n: int, odd: bool, axes: int = 3) -> set[tuple[int, int]]:
    """The edges of the simplices that a cell with n vertices is cut to, as places among its vertices."""
    if axes != 3 and n > 4:
        table = [(0, k, k + 1) for k in range(1, n - 1)]
    else:
        table = (MIRRORED if odd else TETS) if n == 8 else (IN_SPACE if axes == 3 else IN_PLANE).get(n, [range(n)])
    return {(min(p), max(p)) for f in table for p in combinations(tuple(f)[: axes + 1], 2)}


def is_odd(cells: DataFrame) -> Column:
    """Which cells of a regular grid are cut the other way; elsewhere none."""
    places = [F.col(c) for c in IJK if c in cells.columns]
    return reduce(lambda a, b: a + b, places) % 2 == 1 if places else F.lit(False)


def split(cells: DataFrame, axes: int = 3) -> DataFrame:
    """Cells cut to triangles (in a plane) or tetrahedra (in space): (.., part, conn).

    Simplices stay. On a regular grid (with i, j, k) the cut of hexahedra
    alternates from cell to cell, so that neighbours cut the face between them
    along the same diagonal.
    """
    places = pieces(F.size("conn"), is_odd(cells), axes)
    parts = F.coalesce(F.transform(places, lambda f: F.transform(f, lambda k: F.get("conn", k))), F.array("conn"))
    kept = [c for c in cells.columns if c != "conn"]
    return cells.select(*kept, F.posexplode(parts).alias("part", "conn"))


def triangulated(mesh: Mesh, stride: int = 8) -> Mesh:
    """The mesh with its cells cut to simplices, which are cells of their own: their
    ids are stride times their cell's, which stays as parent_cell, and their part."""
    if len(mesh.axes) == 2:
        stride = max(stride, mesh.cells.agg(F.max(F.size("conn"))).first()[0] or 0)
    cells = split(mesh.cells, len(mesh.axes))
    ids = {"parent_cell": F.col("cell_id"), "cell_id": F.col("cell_id") * stride + F.col("part")}
    return explicit(mesh.vertices.drop(*IJK), cells.withColumns(ids).drop("part", *IJK), mesh.axes)


def moved(mesh: Mesh, scale=None, translate=None, matrix=None, rotate=None) -> Mesh:
    """The mesh with its vertices and centres put through transform. A grid that is
    scaled or moved stays one; turned, its lines no longer run along the axes."""
    how = {"scale": scale, "translate": translate, "matrix": matrix, "rotate": rotate}
    vertices, cells = (transform(df, axes=mesh.axes, **how) for df in (mesh.vertices, mesh.cells))
    if matrix is not None or rotate is not None:
        return Mesh(vertices, cells, mesh.axes)
    by = [float(s) for s in scale or (1,) * 3]
    to = [float(s) for s in translate or (0,) * 3]
    origin = tuple(o * s + m for o, s, m in zip(mesh.origin, by, to, strict=False))
    return Mesh(vertices, cells, mesh.axes, mesh.dims, origin, tuple(w * s for w, s in zip(mesh.spacing, by, strict=False)))


def mirrored(mesh: Mesh, point: float, axis: str) -> Mesh:
    """The mesh on the other side of a point of an axis."""
    place = mesh.axes.index(axis)
    flip = lambda values, f: tuple(f(v) if k == place else v for k, v in enumerate(values))
    origin, spacing = flip(mesh.origin, lambda o: 2.0 * float(point) - o), flip(mesh.spacing, lambda s: -s)
    return Mesh(reflect(mesh.vertices, point, axis), reflect(mesh.cells, point, axis), mesh.axes, mesh.dims, origin, spacing)


def cell_ranges(mesh: Mesh, value: Column) -> DataFrame:
    """cells with the least and greatest value on their vertices."""
    rows = mesh.cells.select("domain_id", "cell_id", F.explode("conn").alias("vertex_id"))
    rows = rows.join(mesh.vertices.select("domain_id", "vertex_id", value.alias("v")), ["domain_id", "vertex_id"])
    return rows.groupBy("domain_id", "cell_id").agg(F.min("v").alias("low"), F.max("v").alias("high"))


def contour_levels(df: DataFrame, field: str, levels: int) -> DataFrame:
    """(level, value): levels values evenly between the field's least and greatest, without these."""
    b = bounds(df.select(number(F.col(field)).alias("f")), ["f"])
    at = F.explode(F.sequence(F.lit(1), F.lit(levels))).alias("level")
    return b.select("*", at).select("level", (F.col("min_f") + F.col("level") * (F.col("max_f") - F.col("min_f")) / (levels + 1)).alias("value"))


def contour_cells(mesh: Mesh, field: str, values: list[float]) -> DataFrame:
    """(domain_id, cell_id, value) of the cells that each contour passes through."""
    known = F.array(*(F.lit(float(v)) for v in values))
    hit = F.filter(known, lambda v: (F.col("low") < v) & (F.col("high") >= v))
    return cell_ranges(mesh, number(F.col(field))).select("domain_id", "cell_id", F.explode(hit).alias("value"))


def slice_cells(mesh: Mesh, implicit: Column) -> DataFrame:
    """(domain_id, cell_id) of the cells that an implicit surface passes through."""
    return cell_ranges(mesh, implicit).filter("low <= 0 AND high >= 0").select("domain_id", "cell_id")


def three_slice(mesh: Mesh, at) -> DataFrame:
    """(domain_id, cell_id, axis) of cells on planes across each axis."""
    from .selection import plane

    out = []
    for k, c in enumerate(mesh.axes):
        normal = [float(i == k) for i in range(len(mesh.axes))]
        out.append(slice_cells(mesh, plane(at, normal, mesh.axes)).withColumn("axis", F.lit(c)))
    return reduce(DataFrame.unionByName, out)


def auto_slice(mesh: Mesh, field: str, levels: int, normal, bins: int = 256) -> DataFrame:
    """One row: of levels planes across a normal (or an axis), the one with the
    greatest entropy of the field on its cells; position is the distance from
    the origin along the normal."""
    normal = [float(c == normal) for c in mesh.axes] if isinstance(normal, str) else [float(x) for x in normal]
    size = sum(x * x for x in normal) ** 0.5
    if not size:
        raise ValueError("auto_slice: a normal has a direction")
    along = reduce(lambda a, b: a + b, (F.col(c) * (x / size) for c, x in zip(mesh.axes, normal, strict=True)))
    f = number(F.col(field))
    low, high, least, most = mesh.cells.agg(F.min(along), F.max(along), F.min(f), F.max(f)).first()
    step, width = (high - low) / (levels + 1), (most - least) or 1.0
    rows = mesh.cells.select(F.round((along - low) / F.lit(step or 1.0)).cast("int").alias("level"), F.least(((f - least) * F.lit(bins / width)).cast("int"), F.lit(bins - 1)).alias("bin"))
    counts = rows.filter(F.col("level").between(1, levels)).groupBy("level", "bin").agg(F.count("*").alias("n"))
    p = F.col("n") / F.sum("n").over(Window.partitionBy("level"))
    scores = counts.withColumn("p", p).groupBy("level").agg((-F.sum(F.col("p") * F.ln("p"))).alias("entropy"))
    best = scores.agg(F.min(F.struct((-F.round("entropy", 9)).alias("rank"), "level", "entropy")).alias("b"))
    return best.select("b.level", (F.lit(low) + F.col("b.level") * step).alias("position"), "b.entropy")


def merge_points(mesh: Mesh, delta: float) -> Mesh:
    """The mesh with vertices that lie in one box of a grid of width delta made one:
    it has the least id among them, the mean place, and the fields of that least one."""
    box = [F.floor(F.col(c) / float(delta)).alias(f"__{c}") for c in mesh.axes]
    rows = mesh.vertices.select("*", *box)
    keys = ["domain_id", *(f"__{c}" for c in mesh.axes)]
    merged = rows.groupBy(*keys).agg(F.min("vertex_id").alias("__into"), *(F.avg(c).alias(f"__at_{c}") for c in mesh.axes))
    placed = rows.join(merged, keys)
    vertices = placed.filter("vertex_id = __into").withColumns({c: F.col(f"__at_{c}") for c in mesh.axes}).select(mesh.vertices.columns)
    corners = mesh.cells.select("domain_id", "cell_id", F.posexplode("conn").alias("corner", "vertex_id")).join(placed.select("domain_id", "vertex_id", "__into"), ["domain_id", "vertex_id"])
    conn = corners.groupBy("domain_id", "cell_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("corner", "__into"))), lambda x: x["__into"]).alias("conn"))
    return Mesh(vertices, mesh.cells.drop("conn").join(conn, ["domain_id", "cell_id"]), mesh.axes)


def _det(rows: list[list[Column]]) -> Column:
    if len(rows) == 2:
        (a, b), (c, d) = rows
        return a * d - b * c
    (a, b, c), (d, e, f), (g, h, i) = rows
    return a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)


#: Vertices in one box beyond which points are looked up in boxes of several sizes.
CROWDED = 4096


def locate(points: DataFrame, mesh: Mesh, key: str, near: float = 1e-9) -> DataFrame:
    """(key, domain_id, cell_id) of the points that lie in a cell, on any mesh; the
    least cell where several hold a point.

    Points and simplices of cells meet by boxes, and an exact test decides: those of
    a grid as wide along each axis as the widest simplex, which so reaches into two; where
    vertices crowd in some of these, by boxes that are halved until none holds too many.
    """
    from .geometry import simplices

    axes, d = mesh.axes, len(mesh.axes)
    rows = simplices(mesh, F.lit(0.0)).select("domain_id", "cell_id", "points")
    at = lambda i, k: F.get("points", F.lit(i * d + k))
    corner = [[at(i, k) for i in range(d + 1)] for k in range(d)]
    ends = rows.agg(*(F.min(F.least(*c)).alias(f"low{k}") for k, c in enumerate(corner)), *(F.max(F.greatest(*c) - F.least(*c)).alias(f"wide{k}") for k, c in enumerate(corner))).first()
    low, width = [float(ends[f"low{k}"] or 0.0) for k in range(d)], [float(ends[f"wide{k}"] or 0.0) or 1.0 for k in range(d)]
    place = lambda v, k: F.floor((v - low[k]) / width[k])
    asked = points.select(key, *(F.col(c).cast("double").alias(f"__p{k}") for k, c in enumerate(axes)))
    most = mesh.vertices.groupBy(*(place(F.col(c), k).alias(f"__b{k}") for k, c in enumerate(axes))).count().agg(F.max("count")).first()[0] or 0
    if most > CROWDED:
        return _in_halved_boxes(asked, rows, mesh, key, near)
    for k in range(d):
        rows = rows.withColumn(f"__b{k}", F.explode(F.sequence(place(F.least(*corner[k]) - near, k), place(F.greatest(*corner[k]) + near, k))))
    asked = asked.withColumns({f"__b{k}": place(F.col(f"__p{k}"), k) for k in range(d)})
    return _holding(asked.join(rows, [f"__b{k}" for k in range(d)]), d, key, near)


def _holding(met: DataFrame, d: int, key: str, near: float) -> DataFrame:
    """Of points and the simplices next to them: the least cell that holds each point."""
    at = lambda i, k: F.get("points", F.lit(i * d + k))
    edges = [[at(i, k) - at(0, k) for k in range(d)] for i in range(1, d + 1)]
    away = [F.col(f"__p{k}") - at(0, k) for k in range(d)]
    met = met.withColumn("__size", _det(edges))
    shares = [F.try_divide(_det([away if j == i else e for j, e in enumerate(edges)]), F.col("__size")) for i in range(d)]
    inside = reduce(lambda a, b: a & b, (x >= -near for x in shares)) & (reduce(lambda a, b: a + b, shares) <= 1 + near)
    return met.filter(inside).groupBy(key).agg(F.min(F.struct("domain_id", "cell_id")).alias("c")).select(key, "c.domain_id", "c.cell_id")


def _in_halved_boxes(asked: DataFrame, rows: DataFrame, mesh: Mesh, key: str, near: float) -> DataFrame:
    from ..sources.tables import Kept
    from .particles import dealt

    d = len(mesh.axes)
    with Kept(mesh.cells.sparkSession) as kept:
        boxes, inside = dealt(kept(rows), mesh, kept)
        places = [F.col(f"__p{k}") for k in range(d)]
        there = asked.filter(reduce(lambda a, b: a & b, (p.isNotNull() & ~F.isnan(p) for p in places)))
        return kept.last(_holding(boxes.of(there, places).join(inside, ["level", "place"]), d, key, near))


def _located(points: DataFrame, mesh: Mesh, fields: list[str], empty: float, key: str) -> DataFrame:
    """points with cell_id and the fields of the cell they lie in. On a uniform grid
    their place is arithmetic, so the join is on cell ids; else they are looked up."""
    if mesh.spacing:
        inside, cell, stride = F.lit(True), F.lit(0).cast("long"), 1
        for c, n, o, s in zip(mesh.axes, mesh.dims, mesh.origin, mesh.spacing, strict=True):
            at = (F.col(c) - o) / s
            inside &= (at >= 0) & (at <= n - 1)
            cell = cell + F.least(F.floor(at), F.lit(n - 2)) * stride
            stride *= n - 1
        met = points.withColumn("cell_id", F.when(inside, cell)).join(mesh.cells.select("domain_id", "cell_id", *(F.col(f).alias(f"__{f}") for f in fields)), "cell_id", "left")
        first = F.min_by(F.struct("cell_id", *(F.col(f"__{f}").alias(f) for f in fields)), F.coalesce("domain_id", F.lit(0))).alias("c")  # where several domains have the cell
        out = met.groupBy(*points.columns).agg(first).select(*points.columns, "c.*")
    else:
        found = locate(points, mesh, key).join(mesh.cells.select("domain_id", "cell_id", *fields), ["domain_id", "cell_id"])
        out = points.join(found.drop("domain_id"), key, "left")
    return out.withColumns({f: F.coalesce(number(F.col(f)), F.lit(float(empty))) for f in fields})


def lineout(mesh: Mesh, samples: int, start, end, fields: list[str], empty_val: float = 0.0) -> DataFrame:
    """samples + 2 points from start to end with the fields of the cells they lie in."""
    n = samples + 1
    points = mesh.cells.sparkSession.range(n + 1).select(F.col("id").cast("int").alias("sample"), *((F.lit(float(a)) + F.col("id") * F.lit((float(b) - float(a)) / n)).alias(c) for c, a, b in zip(mesh.axes, start, end, strict=True)))
    return _located(points, mesh, fields, empty_val, "sample")


def uniform_grid(mesh: Mesh, fields: list[str], dims, origin, spacing, invalid_value: float = 0.0) -> DataFrame:
    """Points of another uniform grid with the fields of the cells they lie in."""
    other = uniform(mesh.cells.sparkSession, dims, origin, spacing).vertices.select(F.col("vertex_id").alias("point_id"), *mesh.axes)
    return _located(other, mesh, fields, invalid_value, "point_id")


def paint_ghosts(coarse: DataFrame, fine: DataFrame, factor: int, axes: int = 3, output: str = "ghost") -> DataFrame:
    """coarse cells with 1 where finer cells lie over them: a fine cell's place is
    divided by the refinement factor, and the join is on that."""
    names = IJK[:axes]
    under = fine.select(*(F.floor(F.col(n) / factor).cast("int").alias(n) for n in names)).distinct().withColumn(output, F.lit(1))
    return coarse.join(under, list(names), "left").withColumn(output, F.coalesce(output, F.lit(0)))


def dominant_material(materials: DataFrame) -> DataFrame:
    """(domain_id, cell_id, material, vol_frac): of each cell, the material with the
    greatest fraction, the first by name among equals."""
    best = F.min(F.struct((-F.col("vol_frac")).alias("rank"), "material", "vol_frac")).alias("b")
    return materials.groupBy("domain_id", "cell_id").agg(best).select("domain_id", "cell_id", "b.material", "b.vol_frac")


#: Steps of a histogram that parts a column's range.
STEPS = 1 << 16


def partition(cells: DataFrame, target: int, by: str) -> DataFrame:
    """cells dealt to target domains of much the same size by ranges of a numeric
    column, as a column new_domain_id; rows without a number go to the first.

    The ranges end where a histogram of STEPS equal steps says that a domain is
    full, so the same rows always get the same domains, however they are stored.
    No row is moved.
    """
    v = number(F.col(by))
    step = lambda low, high: F.when(F.lit(high > low), F.least(F.floor((v - F.lit(low)) / F.lit((high - low) or 1.0) * STEPS), F.lit(STEPS - 1))).otherwise(0)
    low, high = cells.agg(F.min(v), F.max(v)).first()
    if low is None:
        return cells.withColumn("new_domain_id", F.lit(0))
    at = step(low, high).cast("int")
    counts = cells.filter(v.isNotNull()).groupBy(at.alias("at")).count().orderBy("at").collect()  # STEPS rows at most
    total, seen, ends = sum(r["count"] for r in counts), 0, []
    for r in counts:
        domain = seen * target // total
        while len(ends) < domain:
            ends.append(r["at"])  # the first step of the next domain
        seen += r["count"]
    domain = reduce(lambda a, b: a + b, ((at >= e).cast("int") for e in ends), F.lit(0))
    return cells.withColumn("new_domain_id", F.coalesce(domain, F.lit(0)))

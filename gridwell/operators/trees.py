"""Tree grids: a uniform grid in space as the leaves of an octree, and its files.

A node of height h is the cube of cells with the same i, j and k divided by 2^h; its
value is the mean of its children's values. Each height is one aggregation of the one
below, an eighth of its rows, and a table of its own, so all heights together cost
little more than the first. Where the sides aren't equal powers of 2, what lies beyond
the grid is blank.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import number
from . import mesh as meshes

#: Heights of a file: it has up to 8^6 leaves.
HEIGHTS = 6
#: Bits of a place along an axis of a file; three of them fit a key, so a file has no more heights.
BITS = 21


def morton(i: Column, j: Column, k: Column, bits: int = BITS) -> Column:
    """The bits of three places by turns: children of a node are eight keys in a row."""
    bit = lambda v, b, at: F.shiftleft(F.shiftright(v.cast("long"), b).bitwiseAND(1), at)
    return reduce(lambda a, b: a + b, (bit(v, b, 3 * b + n) for b in range(bits) for n, v in enumerate((i, j, k))))


def height(mesh: meshes.Mesh) -> int:
    """The height of the root over all cells of a grid."""
    if len(mesh.axes) != 3 or not mesh.spacing:
        raise ValueError("a tree grid needs a uniform grid in space")
    return (max(mesh.dims) - 2).bit_length()


def nodes(mesh: meshes.Mesh, field: str, blank: float | None = None) -> DataFrame:
    """(domain_id, height, i, j, k, value, children) of all nodes that have cells, a field of
    cells being the values at height 0. Null values and blank ones are null and count in no
    mean; a node of nothing else is null too. children: an array of eight, by the last
    bits of k, j and i, with whether there are cells (there) and their value."""
    from ..sources.tables import Kept

    top, v = height(mesh), number(F.col(field)).cast("double")
    v = v if blank is None else F.when(v == float(blank), None).otherwise(v)
    child = "array<struct<there: boolean, value: double>>"
    with Kept(mesh.cells.sparkSession) as kept:
        level = kept(mesh.cells.select("domain_id", F.lit(0).alias("height"), *(F.col(n).cast("long").alias(n) for n in meshes.IJK), v.alias("value"), F.lit(None).cast(child).alias("children")))
        levels = [level]
        for h in range(1, top + 1):
            octant = (F.col("i") % 2 + 2 * (F.col("j") % 2) + 4 * (F.col("k") % 2)).cast("int")
            above = [F.shiftright(n, 1).alias(n) for n in meshes.IJK]
            # eight rows at most; where domains or rows repeat a place, the first by value
            rows = level.select("domain_id", *above, octant.alias("o"), "value").groupBy("domain_id", *meshes.IJK)
            found = rows.agg(F.avg("value").alias("value"), *(F.struct((F.count(F.when(F.col("o") == o, 1)) > 0).alias("there"), F.min(F.when(F.col("o") == o, F.col("value"))).alias("value")).alias(f"c{o}") for o in range(8)))
            level = kept(found.select("domain_id", F.lit(h).alias("height"), *meshes.IJK, "value", F.array(*(f"c{o}" for o in range(8))).cast(child).alias("children")))
            levels.append(level)
        return kept.last(reduce(DataFrame.unionByName, levels))


def _data(name: str, kind: str, values: Column, n: Column) -> Column:
    head = F.format_string(f'<DataArray type="{kind}" Name="{name}" NumberOfTuples="%d" format="ascii">', n)
    return F.concat_ws("\n", head, F.array_join(values, " "), F.lit("</DataArray>"))


def files(mesh: meshes.Mesh, field: str, blank: float, heights: int = HEIGHTS) -> DataFrame:
    """(tree, text) of files for tree grids (VTK's HyperTreeGrid, in text).

    A file is one tree of so many heights at most. A tree that is higher goes to several:
    the leaves of one are the roots of others, down to the cells. tree says where: domain,
    height of the root, its i, j and k. Nodes without cells are leaves with the blank value;
    blank nodes are masked. No task holds more than a file.
    """
    if heights < 1:
        raise ValueError("a file has at least one height below its root")
    top, heights = height(mesh), min(heights, BITS)
    found = nodes(mesh, field, blank)
    if not top:  # one cell, which has no children
        found = found.withColumn("children", F.array().cast("array<struct<there: boolean, value: double>>"))
    h = F.col("height")
    root = F.least(F.lit(top), F.ceil(h / heights) * heights).cast("int") if top else F.lit(0)
    floor = F.floor((root - 1) / heights) * heights
    rows = found.filter(h > 0 if top else h == 0).withColumns({"root": root, "floor": floor.cast("int")})
    for n in meshes.IJK:
        rows = rows.withColumn(f"r{n}", F.expr(f"shiftright({n}, root - height)"))
    key = morton(*(F.expr(f"{n} - shiftleft(r{n}, root - height)") for n in meshes.IJK), bits=heights)
    rows = rows.withColumn("n", F.struct((F.col("root") - h).alias("level"), key.alias("key"), "value", "children", (h - 1 > F.col("floor")).alias("deeper")))
    place = ["domain_id", "root", "ri", "rj", "rk"]
    rows = rows.groupBy(*place).agg(F.sort_array(F.collect_list("n")).alias("n"))
    first = F.array(F.struct(F.lit(True).alias("there"), F.get("n", F.lit(0))["value"].alias("value")))
    children = F.flatten(F.transform("n", lambda p: p["children"]))
    deeper = F.flatten(F.transform("n", lambda p: F.when(p["deeper"], F.transform(p["children"], lambda c: c["there"].cast("int"))).otherwise(F.array().cast("array<int>"))))
    levels = F.array_max(F.transform("n", lambda p: p["level"]))
    by_level = F.transform(F.sequence(F.lit(0), levels), lambda x: F.size(F.filter("n", lambda p: p["level"] == x)) * 8) if top else F.array().cast("array<int>")
    rows = rows.withColumns({"all": F.concat(first, children), "by": F.concat(F.array(F.lit(1)), by_level), "deeper": F.concat(F.array(F.lit(int(top > 0))), deeper) if top else F.array().cast("array<int>")})
    count = F.size("all")
    text = lambda values: F.transform(values, lambda v: v.cast("string"))
    ends = []
    for name, o, s, r in zip("XYZ", mesh.origin, mesh.spacing, ("ri", "rj", "rk"), strict=True):
        side = F.expr("shiftleft(1L, root)") * float(s)
        begin = F.lit(float(o)) + F.col(r) * side
        ends.append(_data(f"{name}Coordinates", "Float64", text(F.array(begin, begin + side)), F.lit(2)))
    grid = F.lit('<VTKFile type="HyperTreeGrid" version="1.0" byte_order="LittleEndian" header_type="UInt32">\n<HyperTreeGrid BranchFactor="2" TransposedRootIndexing="0" Dimensions="2 2 2">\n<Grid>')
    tree = F.format_string('</Grid>\n<Trees>\n<Tree Index="0" NumberOfLevels="%d" NumberOfVertices="%d">', F.size("by"), count)
    body = [
        _data("Descriptor", "Bit", text(F.col("deeper")), F.size("deeper")),
        _data("NbVerticesByLevel", "Int64", text(F.col("by")), F.size("by")),
        _data("Mask", "Bit", F.transform("all", lambda c: c["value"].isNull().cast("int").cast("string")), count),
        F.lit("<CellData>"),
        _data(field.replace('"', ""), "Float64", F.transform("all", lambda c: F.coalesce(c["value"], F.lit(float(blank))).cast("string")), count),
        F.lit("</CellData>\n</Tree>\n</Trees>\n</HyperTreeGrid>\n</VTKFile>"),
    ]
    name = F.format_string("d%d_h%d_%d_%d_%d", *place)
    return rows.select(name.alias("tree"), F.concat_ws("\n", grid, *ends, tree, *body).alias("text"))


def write(mesh: meshes.Mesh, field: str, path: str, blank: float, heights: int = HEIGHTS) -> str:
    """The files of a tree grid, each in a folder by its name, tree=d<domain>_h<height>_<i>_<j>_<k>."""
    files(mesh, field, blank, heights).write.mode("overwrite").partitionBy("tree").text(path)
    return path


def load(spark: SparkSession, path: str) -> DataFrame:
    """(tree, level, place, value, masked) of the nodes in files: level from the root, place in the file."""
    rows = spark.read.text(path, wholetext=True)
    data = lambda name: F.split(F.regexp_extract("value", rf'(?s)<DataArray [^>]*Name="{name}"[^>]*>\n(.*?)\n</DataArray>', 1), " ")
    values = F.split(F.regexp_extract("value", r"(?s)<CellData>\n<DataArray [^>]*>\n(.*?)\n</DataArray>", 1), " ")
    rows = rows.select("tree", data("NbVerticesByLevel").cast("array<long>").alias("by"), F.posexplode(F.arrays_zip(values.alias("v"), data("Mask").alias("m"))).alias("place", "n"))
    ends = F.transform("by", lambda _, k: F.aggregate(F.slice("by", 1, k + 1), F.lit(0).cast("long"), lambda s, x: s + x))
    return rows.select("tree", F.size(F.filter(ends, lambda e: e <= F.col("place"))).alias("level"), "place", F.col("n.v").cast("double").alias("value"), (F.col("n.m") == "1").alias("masked"))

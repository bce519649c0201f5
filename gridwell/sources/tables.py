"""Reading and writing tables of elements."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.selection import select_fields

FORMATS = ("parquet", "csv", "json", "orc")


def scratch_path(spark: SparkSession) -> str:
    """A new path in the folder that driver and executors share, ``spark.checkpoint.dir``;
    without that setting one on this machine, if all of Spark runs on it."""
    root = spark.conf.get("spark.checkpoint.dir", "")
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.gettempdir()
    return f"{root.rstrip('/')}/gridwell-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


class Kept:
    """Tables of one run, in the shared folder: each cuts the lineage of what follows."""

    def __init__(self, spark):
        self.spark, self.root = spark, scratch_path(spark)

    def __enter__(self):
        return self

    def __call__(self, rows: DataFrame) -> DataFrame:
        path = f"{self.root}/{uuid.uuid4().hex}"
        rows.write.parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def last(self, rows: DataFrame) -> DataFrame:
        """rows, on their own when the tables go."""
        if self.spark.sparkContext.getCheckpointDir() is None:
            self.spark.sparkContext.setCheckpointDir(scratch_path(self.spark))
        return self(rows).checkpoint()

    def __exit__(self, *_):
        remove(self.spark, self.root)


def load(spark: SparkSession, path: str, protocol: str = "parquet", schema=None) -> DataFrame:
    if protocol not in FORMATS:
        raise ValueError(f"unknown protocol {protocol}; known are {', '.join(FORMATS)}")
    reader = spark.read.format(protocol)
    reader = reader.schema(schema) if schema is not None else reader
    return reader.options(**({"header": True, "inferSchema": schema is None} if protocol == "csv" else {})).load(path)


def union_domains(domains: list[DataFrame]) -> DataFrame:
    """Domains under each other; a field that one lacks is null there."""
    out = domains[0]
    for d in domains[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out


def save(df: DataFrame, path: str, protocol: str = "parquet", fields: list[str] | None = None, num_files: int | None = None, by: list[str] = ()) -> str:
    """Writes chosen fields, in num_files files, in folders by the columns of by."""
    if protocol not in FORMATS:
        raise ValueError(f"unknown protocol {protocol}; known are {', '.join(FORMATS)}")
    df = select_fields(df, [*fields, *(c for c in by if c not in fields)]) if fields else df
    df = df.repartition(num_files) if num_files else df
    writer = df.write.mode("overwrite").format(protocol)
    writer = writer.partitionBy(*by) if by else writer
    (writer.option("header", True) if protocol == "csv" else writer).save(path)
    return path


def flattened(df: DataFrame) -> DataFrame:
    """Structs as columns of their own, arrays as JSON, so any format can hold them."""
    out = []
    for f in df.schema.fields:
        kind = f.dataType.typeName()
        if kind == "struct":
            out += [F.col(f"`{f.name}`.`{n}`").alias(f"{f.name}_{n}") for n in f.dataType.names]
        else:
            out.append(F.to_json(f.name).alias(f.name) if kind in ("array", "map") else F.col(f"`{f.name}`"))
    return df.select(*out)


def flatten(mesh_or_table, path: str, protocol: str = "csv", fields: list[str] | None = None) -> list[str]:
    """Writes a table, or a mesh's vertices and cells, as flat tables."""
    tables = {"vertices": mesh_or_table.vertices, "cells": mesh_or_table.cells} if hasattr(mesh_or_table, "cells") else {"table": mesh_or_table}
    return [save(flattened(df), f"{path}/{n}", protocol, [c for c in fields if c in flattened(df).columns] if fields else None) for n, df in tables.items()]


def write_text(spark: SparkSession, path: str, text: str) -> str:
    """A small file, wherever Spark's file systems reach."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    stream = at.getFileSystem(conf).create(at, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    return path


def save_info(spark: SparkSession, path: str, info: dict) -> str:
    return write_text(spark, path, json.dumps(info, indent=1, default=str))


#: VTK's numbers for cells by how many vertices they have, on so many axes:
#: lines; triangles, quadrilaterals; tetrahedra, pyramids, wedges, hexahedra.
VTK_CELLS = {1: {2: 3}, 2: {3: 5, 4: 9}, 3: {3: 5, 4: 10, 5: 14, 6: 13, 8: 12}}

#: Ids of cells that go to one VTK file together.
CELLS_A_FILE = 1 << 15


def write_vtk(mesh, path: str) -> str:
    """A mesh as VTK files for unstructured grids, one a task: cells with their
    vertices, and the numeric fields of both. Returns the folder.

    Cells whose ids follow each other go together, CELLS_A_FILE ids at a time, with those
    vertices that they need, once each: so no task holds more than some such groups,
    however large a domain is. The files are rows of a table of texts, which Spark writes.
    """
    axes, keys = mesh.axes, ["domain_id", "cell_id"]
    numeric = ("double", "float", "integer", "long", "short", "byte")
    of = lambda df, known: [f.name for f in df.schema.fields if f.name not in known and f.dataType.typeName() in numeric]
    cell_fields = of(mesh.cells, {*keys, "i", "j", "k", *axes})
    vertex_fields = of(mesh.vertices, {"domain_id", "vertex_id", "i", "j", "k", *axes})
    number = lambda c: F.col(c).cast("double")
    group = F.floor(F.col("cell_id") / CELLS_A_FILE).alias("group")
    files = max(1, -(-mesh.cells.select("cell_id").count() // CELLS_A_FILE))
    cells = mesh.cells.filter("domain_id IS NOT NULL AND cell_id IS NOT NULL").select("domain_id", group, "conn", F.array(*map(number, cell_fields)).cast("array<double>").alias("numbers"))
    points = mesh.vertices.select("domain_id", "vertex_id", F.array(*(number(c) for c in (*axes, *vertex_fields))).alias("numbers"))
    needed = cells.select("domain_id", "group", F.explode("conn").alias("vertex_id")).distinct().join(points, ["domain_id", "vertex_id"])
    # of each group vertices come first
    rows = needed.select("domain_id", "group", F.lit(0).alias("kind"), F.array("vertex_id").alias("ids"), "numbers").unionByName(cells.select("domain_id", "group", F.lit(1).alias("kind"), F.col("conn").alias("ids"), "numbers"))
    rows = rows.repartition(files, "domain_id", "group").sortWithinPartitions("domain_id", "group", "kind").select("domain_id", "kind", "ids", "numbers")

    def run(batches):
        import pyarrow as pa

        at: dict[tuple, int] = {}
        places, inside, lines, kinds = [], [], [], []
        for batch in batches:
            for domain, kind, ids, numbers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kind == 0:
                    if (domain, ids[0]) not in at:
                        at[domain, ids[0]] = len(at)
                        places.append(numbers)
                elif here := [at[domain, v] for v in ids or () if (domain, v) in at]:
                    inside.append(numbers)
                    lines.append(" ".join(map(str, [len(here), *here])))
                    kinds.append(VTK_CELLS[len(axes)].get(len(here), 7))
        if not lines:
            return
        d = len(axes)
        text = ["# vtk DataFile Version 3.0", "mesh", "ASCII", "DATASET UNSTRUCTURED_GRID", f"POINTS {len(places)} double"]
        text += [" ".join(map(repr, [*p[:d], *[0.0] * (3 - d)])) for p in places]
        text += [f"CELLS {len(lines)} {sum(x.count(' ') + 1 for x in lines)}", *lines, f"CELL_TYPES {len(kinds)}", *map(str, kinds)]
        for what, n, names, values in (("POINT_DATA", len(places), vertex_fields, [p[d:] for p in places]), ("CELL_DATA", len(lines), cell_fields, inside)):
            text.append(f"{what} {n}")
            for k, name in enumerate(names):
                text += [f"SCALARS {name.replace(' ', '_')} double 1", "LOOKUP_TABLE default", *("nan" if v[k] is None else repr(v[k]) for v in values)]
        yield pa.RecordBatch.from_arrays([pa.array(["\n".join(text)])], names=["value"])

    rows.mapInArrow(run, "value string").write.mode("overwrite").text(path)
    return path

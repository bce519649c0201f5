"""Basis flows over cycles: particles that go on from where the last cycle left them.

Each cycle's places are a table in a shared folder, so a cycle may be given again (after a
lost driver, say): it goes on from the cycle before it and overwrites its own table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import geometry as gm
from . import mesh as meshes


def _cycles(spark, path: str) -> list[int]:
    """The cycles whose tables are whole."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(at):
        return []
    names = [(s.getPath().getName(), s.getPath()) for s in system.listStatus(at)]
    done = lambda p: system.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))
    return sorted(int(n[6:]) for n, p in names if n.startswith("cycle=") and n[6:].lstrip("-").isdigit() and done(p))


def advanced(mesh: meshes.Mesh, field: str, path: str, cycle: int, write_frequency: int, steps: int, step_size: float, resolution=None) -> DataFrame:
    """(seed_id, start, end, cycles) of the particles after a cycle, in which a vertex vector
    field carried them for some steps; cycles is how many of an interval are done. When
    that reaches write_frequency the interval's flow is whole, and the next cycle starts with
    new seeds. end is null for particles that left the mesh; they stay out until then.

    path is a folder for this flow alone. Tables of whole intervals stay in it, and the last two.
    Cycles come in rising order, or the last one again. Seeds are told apart by vertex ids
    alone, so domains need ids that differ.
    """
    from ..sources.tables import remove

    if write_frequency < 1:
        raise ValueError("a flow is written after one cycle or more")
    spark = mesh.vertices.sparkSession
    table = lambda c: f"{path}/cycle={c}"
    known = _cycles(spark, path)
    earlier = [c for c in known if c < cycle]
    last = spark.read.parquet(table(earlier[-1])) if earlier else None
    row = last.select("cycles").first() if last is not None else None
    done = row["cycles"] if row else write_frequency
    place = F.struct(*(F.col(c).cast("double").alias(c) for c in mesh.axes))
    if done >= write_frequency:
        rows, done = gm.flow_seeds(mesh, resolution).select("seed_id", place.alias("start"), place.alias("at")), 0
    else:
        rows = last.select("seed_id", "start", F.col("end").alias("at"))
    moving = rows.filter("at IS NOT NULL").select("seed_id", "at.*")
    ends = gm.carried_for(moving, mesh, field, steps, step_size)
    out = rows.join(ends, "seed_id", "left").select("seed_id", "start", "end", F.lit(done + 1).alias("cycles"))
    out.write.mode("overwrite").parquet(table(cycle))
    for c in earlier[:-1]:
        found = spark.read.parquet(table(c)).select("cycles").first()
        if found is None or found["cycles"] < write_frequency:
            remove(spark, table(c))
    return spark.read.parquet(table(cycle))


def flows(spark, path: str, write_frequency: int) -> DataFrame:
    """(cycle, seed_id, start, end) of all whole intervals; cycle is the last of each."""
    rows = spark.read.parquet(*(f"{path}/cycle={c}" for c in _cycles(spark, path)))
    cycle = F.regexp_extract(F.input_file_name(), r"cycle=(-?\d+)/", 1).cast("long")
    return rows.filter(F.col("cycles") >= write_frequency).select(cycle.alias("cycle"), "seed_id", "start", "end")

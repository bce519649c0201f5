"""What the training-data operators share: scratch tables, words and hashes."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters that are none of these six ASCII separators.
WORD_SQL = r"[^\x20\x09-\x0D]+"
WORD = re.compile(WORD_SQL)
#: Most word hashes that a worker remembers; beyond it, it starts anew.
WORD_CACHE = 150_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a session on one machine without that setting (a test) gets a folder of
    its own; on a cluster executors wouldn't see it, so there it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", "")
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="gridwell-")
        atexit.register(shutil.rmtree, own, True)
        found = "file://" + own
        spark.conf.set("spark.checkpoint.dir", found)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


class Scratch:
    """Tables written to the shared folder for the length of a ``with`` block.

    ``table`` writes a large intermediate result as Parquet (compressed, with
    column pruning) and reads it back, which cuts the lineage. ``keep`` makes a
    small result independent of those tables by a reliable checkpoint, which
    Spark's own cleaner removes. Leaving the block deletes the tables.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/gridwell-{uuid.uuid4().hex}"

    def __enter__(self) -> Scratch:
        return self

    def table(self, df: DataFrame, name: str, rows: int = 0) -> DataFrame:
        """rows: how many rows of a batch Python may get while this is written, where they are wide."""
        path, setting = f"{self.root}/{name}", "spark.sql.execution.arrow.maxRecordsPerBatch"
        usual = self.spark.conf.get(setting)
        try:
            if rows:
                self.spark.conf.set(setting, str(rows))
            df.write.parquet(path)
        finally:
            self.spark.conf.set(setting, usual)
        return self.spark.read.schema(df.schema).parquet(path)

    def keep(self, df: DataFrame) -> DataFrame:
        shared_dir(self.spark)
        return df.checkpoint(eager=True)

    def drop(self, name: str = "") -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
        path.getFileSystem(conf).delete(path, True)

    def __exit__(self, *_) -> None:
        self.drop()


#: Bytes of input for each task of a shuffle of whole texts, and most tasks.
BYTES_A_TASK, MOST_TASKS = 1 << 28, 100_000


def tasks(df: DataFrame) -> int:
    """How many tasks a shuffle of df's texts takes: ``spark.sql.shuffle.partitions``,
    or more where the tables that df reads are too large for so few."""
    usual = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size())]
    known = sum(x for x in sizes if x < 1 << 60)  # a table of unknown size has the greatest
    return max(usual, min(known // BYTES_A_TASK, MOST_TASKS))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def word_count(text: Column) -> Column:
    """Words of a text, null: 0; JVM side."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_SQL)), F.lit(0)).cast("long")


class WordHashes(dict):
    """word -> 64-bit hash, remembered while there is room."""

    def __missing__(self, word: str) -> int:
        if len(self) >= WORD_CACHE:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]


def scramble(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (splitmix64's finish)."""
    x = x.copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def window_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n successive words; n words at least must be there."""
    size = len(hashes) - n + 1
    out = np.zeros(size, np.uint64)
    for i in range(n):
        out += hashes[i : i + size] * _ODD[i % 8]
        out = (out << np.uint64(7)) | (out >> np.uint64(57))
    return scramble(out)


def lean(run):
    """run, a function of batches, after which the worker gives back the memory that
    Arrow holds on to: a worker stays for later stages."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()

    return wrapped


#: Ids that go to every task; beyond these, rows meet their ids by a shuffle.
BROADCAST_IDS = 1 << 20


def only(rows: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """The rows whose key is among ids (one column, of the same name)."""
    ids = ids.filter(F.col(key).isNotNull()).distinct()
    return rows.join(F.broadcast(ids) if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else ids, key, "left_semi")


#: Buckets whose sums travel together.
SLICE = 1 << 13


def bucket_sums(texts: DataFrame, size: int, make) -> tuple[np.ndarray, int]:
    """How often each of so many buckets comes up in all rows of a column of texts,
    and how many rows there are.

    make() is called once in each task and returns the function that gives the
    buckets of a text's UTF-8 bytes (null: of an empty text). Each task adds up
    its own rows, the sums meet on the cluster by packed slices of buckets, and
    one number a bucket comes to the driver.
    """

    def run(batches):
        of, total, n = make(), np.zeros(size, np.int64), 0
        for batch in batches:
            for raw in binaries(batch.column(0)):
                np.add.at(total, of(raw), 1)
                n += 1
        slices, data = [-1], [zlib.compress(np.array([n], np.int64).tobytes(), 1)]
        for k in range(0, size, SLICE):
            part = total[k : k + SLICE]
            if part.any():
                slices.append(k // SLICE)
                data.append(zlib.compress(part.tobytes(), 1))
        yield pa.RecordBatch.from_arrays([pa.array(slices, pa.int32()), pa.array(data, pa.binary())], names=["slice", "sums"])

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                part = np.frombuffer(zlib.decompress(data.as_buffer()), np.int64)
                if k in sums:
                    sums[k] += part
                else:
                    sums[k] = part.copy()
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["slice", "sums"])

    schema = "slice int, sums binary"
    parts = min(-(-size // SLICE), int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    found = texts.select(F.coalesce(F.col(texts.columns[0]).cast("string"), F.lit(""))).mapInArrow(lean(run), schema).repartition(parts, "slice").mapInArrow(lean(add), schema).collect()
    out, n = np.zeros(size, np.int64), 0
    for k, data in found:
        sums = np.frombuffer(bytes(data), np.int64)
        if k < 0:
            n = int(sums[0])
        else:
            out[k * SLICE : k * SLICE + len(sums)] = sums
    return out, n


def binaries(column: pa.Array):
    """The bytes of each entry of a string or binary column, without a copy; null: none."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column) or data is None:
        return (np.zeros(0, np.uint8) for _ in range(len(column)))
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].tolist()
    data = np.frombuffer(data, np.uint8)
    if column.null_count:
        there = column.is_valid().to_pylist()
        return (data[a:b] if ok else data[:0] for a, b, ok in zip(at, at[1:], there, strict=False))
    return (data[a:b] for a, b in zip(at, at[1:], strict=False))


#: Spark's name for each Arrow type in use.
ARROW = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary()}
#: Rows that Python holds at once: whole texts may be long.
ROWS_AT_ONCE = 256


def per_text(docs: DataFrame, carry: list[str], text: str, fields: str, make, raw: bool = False) -> DataFrame:
    """docs' columns carry, with fields that a Python function makes of each text.

    make() is called once in each task and returns the function, which takes a
    text (null: empty; with raw: its UTF-8 bytes) and returns a tuple in the order
    of fields. Only carry and text are read.
    """
    named = [f.strip().split(" ") for f in fields.split(",")]
    kinds = [ARROW[k] for _, k in named]
    names = [*carry, *(n for n, _ in named)]
    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry] + [f"{n} {k}" for n, k in named])

    def run(batches):
        of = make()
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(k, ROWS_AT_ONCE)
                texts = part.column(len(carry))
                columns = zip(*(map(of, binaries(texts)) if raw else (of(t.as_py() or "") for t in texts)), strict=True)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(carry)], *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names=names)

    return docs.select(*carry, F.col(text).cast("string").alias("__text")).mapInArrow(lean(run), schema)

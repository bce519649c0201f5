"""Whitening of embeddings: centred scatter on the cluster, Jacobi rotations on the driver.

Entries become integers (so many steps of ``1 / SCALE``, moved by ``OFFSET``), so
sums, means and deviations are exact. A first pass adds up the entries, a second
one the products of centred entries, and the driver turns that matrix, one number
for each pair of dimensions, until nothing is left beside its diagonal: the
eigenvalues come out with small relative errors, the small ones too. The
whitening matrix goes to every task; a third pass measures what it leaves.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, lean, read

SCALE, OFFSET = 64, 1_000_000
#: Entries further out than this many steps count as this many.
FARTHEST = 1 << 61
#: Numbers that Python works on at once.
AT_ONCE = 1 << 20
#: Sweeps over all pairs; six to ten are usual.
SWEEPS = 60
LONGEST = (1 << 63) - 1


def vectors(column: pa.Array):
    """(places in the column, matrix) of the vectors of each length, without those
    that are null or empty or hold null or non-finite entries."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)  # null entries become NaN
    size = np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
    end = np.cumsum(size)
    for d in np.unique(size[size > 0]):
        rows = np.flatnonzero(size == d)
        each = max(1, AT_ONCE // int(d))
        for k in range(0, len(rows), each):
            part = rows[k : k + each]
            values = flat[(end[part] - d)[:, None] + np.arange(d)]
            whole = np.isfinite(values).all(1)
            if whole.any():
                yield part[whole], values[whole]


def steps(values: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(SCALE * values), -FARTHEST, FARTHEST).astype(np.int64) + OFFSET


@dataclass
class Centre:
    """How many vectors there are, and the sum of each dimension."""

    n: int
    sums: list[int]

    def __post_init__(self):
        near = [(2 * s + self.n) // (2 * self.n) for s in self.sums]  # the integer next to the mean
        self.near, self.rest = np.array(near, np.int64), [s - self.n * m for s, m in zip(self.sums, near, strict=True)]

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exactly: 64-bit integers where they hold it, else Python's."""
        y = x - self.near
        if len(y) and self.n * (int(np.abs(y).max()) + 1) > LONGEST >> 1:
            return y.astype(object) * self.n - np.array(self.rest, object)
        return y * self.n - np.array(self.rest, np.int64)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (self.deviations(x) / self.n).astype(float)

    def squares(self, x: np.ndarray) -> list[int | None]:
        """Of each row, the sum of its squared deviations; null where no long holds it."""
        m = self.deviations(x)
        if m.dtype != object and int(np.abs(m).max()) <= isqrt(LONGEST // m.shape[1]):
            return (m * m).sum(1).tolist()
        return [s if s <= LONGEST else None for s in (sum(int(v) ** 2 for v in row) for row in m)]


@dataclass
class Whitening:
    centre: Centre
    eigenvalues: np.ndarray  # falling
    directions: np.ndarray  # a column for each eigenvalue
    known: np.ndarray  # which eigenvalues aren't 0 within rounding
    identity_error: float | None = None

    @property
    def explained(self) -> list[float | None]:
        total = float(self.eigenvalues.sum())
        return [float(e) / total if total > 0 else None for e in self.eigenvalues]

    def matrix(self, components: int) -> np.ndarray:
        e, k = self.eigenvalues[:components], self.known[:components]
        return self.directions[:, :components] * np.where(k, 1 / np.sqrt(np.where(k, e, 1)), 0)


def _rounds(d: int):
    """All pairs of d things in rounds of pairs that have nothing in common (the circle method)."""
    ring = list(range(d)) + ([-1] if d % 2 else [])
    for _ in range(len(ring) - 1):
        pairs = [(min(a, b), max(a, b)) for a, b in zip(ring[: len(ring) // 2], ring[::-1], strict=False) if min(a, b) >= 0]
        yield np.array([p for p, _ in pairs], int), np.array([q for _, q in pairs], int)
        ring = [ring[0], ring[-1], *ring[1:-1]]


def jacobi(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix.

    Cyclic Jacobi: a sweep turns each pair of axes once, by the angle that clears
    their entry. It ends when each entry is within rounding of 0 beside its two
    diagonal ones, which keeps small eigenvalues accurate. Pairs without an axis
    in common are turned together. A vector's largest entry is positive."""
    a, d = np.array(matrix, float), len(matrix)
    v = np.eye(d)
    rounds = list(_rounds(d)) if d > 1 else []
    for _ in range(SWEEPS):
        turned = False
        for p, q in rounds:
            x, y, z = a[p, p], a[q, q], a[p, q]
            big = np.abs(z) > np.finfo(float).eps * np.sqrt(np.abs(x) * np.abs(y))
            if not big.any():
                continue
            turned, p, q, x, y, z = True, p[big], q[big], x[big], y[big], z[big]
            half = (y - x) / (2 * z)
            t = np.where(half < 0, -1.0, 1.0) / (np.abs(half) + np.hypot(half, 1))
            c = 1 / np.hypot(t, 1)
            s = t * c
            a[p], a[q] = c[:, None] * a[p] - s[:, None] * a[q], s[:, None] * a[p] + c[:, None] * a[q]
            for m in (a, v):
                m[:, p], m[:, q] = c * m[:, p] - s * m[:, q], s * m[:, p] + c * m[:, q]
            a[p, q] = a[q, p] = 0
        if not turned:
            break
    order = np.argsort(-np.diag(a), kind="stable")
    v = v[:, order] / np.linalg.norm(v[:, order], axis=0)
    return np.diag(a)[order], v * np.where(v[np.abs(v).argmax(0), np.arange(d)] < 0, -1, 1)


def centre(rows: DataFrame, column: str) -> Centre | None:
    """The count and the exact sums of the vectors of the most frequent length (of
    the longest among equals); None where there is no vector."""

    def run(batches):
        n: dict[int, int] = {}
        high: dict[int, np.ndarray] = {}
        low: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, values in vectors(batch.column(0)):
                x, d = steps(values), values.shape[1]
                n[d] = n.get(d, 0) + len(x)
                high[d] = high.get(d, 0) + (x >> 32).sum(0)
                low[d] = low.get(d, 0) + (x & 0xFFFFFFFF).sum(0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(n), pa.int32()), pa.array(list(n.values()), pa.int64()), pa.array([high[d] for d in n], pa.list_(pa.int64())), pa.array([low[d] for d in n], pa.list_(pa.int64()))],
            names=["d", "n", "high", "low"],
        )

    with Scratch(rows.sparkSession) as scratch:
        parts = scratch.table(rows.select(column).mapInArrow(lean(run), "d int, n long, high array<long>, low array<long>"), "sums")
        most = parts.groupBy("d").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
        if most is None:
            return None
        each = parts.filter(F.col("d") == most["d"]).select(F.posexplode(F.arrays_zip("high", "low")).alias("k", "s"))
        whole = lambda c: F.sum(F.col(f"s.{c}").cast("decimal(38,0)")).alias(c)
        sums = each.groupBy("k").agg(whole("high"), whole("low")).orderBy("k").collect()  # a row for each dimension
    return Centre(most["n"], [(int(r["high"]) << 32) + int(r["low"]) for r in sums])


def scatter(rows: DataFrame, column: str, d: int, size: int, make) -> tuple[np.ndarray, np.ndarray]:
    """Sums, and sums of products, of what make gives for each matrix of d-dimensional
    vectors in steps (a matrix with size columns). Each task adds up its own rows;
    the sums meet by row of the result, in order of tasks, so reruns agree."""

    def run(batches):
        total, products = np.zeros(size), np.zeros((size, size))
        for batch in batches:
            for _, values in vectors(batch.column(0)):
                if values.shape[1] == d:
                    y = make(steps(values))
                    total += y.sum(0)
                    products += y.T @ y
        data = [x.tobytes() for x in (*products, total)]
        yield pa.RecordBatch.from_arrays([pa.array(range(size + 1), pa.int32()), pa.array([TaskContext.get().partitionId()] * (size + 1), pa.int32()), pa.array(data, pa.binary())], names=["k", "task", "data"])

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, data in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                sums[k] = sums.get(k, 0) + np.frombuffer(data)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["k", "data"])

    parts = min(size + 1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    out = np.zeros((size + 1, size))
    for k, data in rows.select(column).mapInArrow(lean(run), "k int, task int, data binary").repartition(parts, "k").sortWithinPartitions("k", "task").mapInArrow(lean(add), "k int, data binary").collect():
        out[k] = np.frombuffer(bytes(data))
    return out[:size], out[size]


def covariance(products: np.ndarray, sums: np.ndarray, n: int) -> np.ndarray:
    """Of values whose mean is 0 but for rounding, which goes too."""
    out = products / n - np.outer(sums / n, sums / n)
    return (out + out.T) / 2


def fit(rows: DataFrame, column: str = "embedding", components: int = 32) -> Whitening | None:
    """The whitening of all vectors; None where there is none."""
    middle = centre(rows, column)
    if middle is None:
        return None
    d = len(middle.sums)
    v = covariance(*scatter(rows, column, d, d, middle.centred), middle.n)
    e, u = jacobi(v)
    # an eigenvalue's rounding error grows with the spread of the dimensions that its vector takes in
    known = e > 16 * d * np.finfo(float).eps * (np.abs(u) * np.sqrt(np.diag(v))[:, None]).sum(0) ** 2
    model = Whitening(middle, e, u, known)
    k = min(components, d)
    matrix = model.matrix(k)
    left = covariance(*scatter(rows, column, d, k, lambda x: middle.centred(x) @ matrix), middle.n)
    kept = known[:k]
    if kept.any():
        model.identity_error = float(np.abs(left - np.eye(k))[np.ix_(kept, kept)].max())
    return model


def whitened(rows: DataFrame, model: Whitening, column: str = "embedding", components: int = 32, carry: tuple[str, ...] = ("*",)) -> DataFrame:
    """Rows with a vector, as (row, deviation, whitened): the columns named by carry in
    ``row``, so none can clash; the sum of (n * x - S) ** 2 over dimensions, null
    where no long holds it; and the first components, null for those without a
    variance. Rows are treated one by one: repeated ones get the same values,
    null ids stay. Left out are null and empty vectors, those with null or
    non-finite entries, and those of another length than most have."""
    d = len(model.centre.sums)
    k = min(components, d)
    matrix, known, middle = model.matrix(k), model.known[:k], model.centre
    wide = rows.select(F.col(column).alias("v"), F.struct(*carry).alias("row"))

    def run(batches):
        for batch in batches:
            for places, values in vectors(batch.column(0)):
                if values.shape[1] != d:
                    continue
                x = steps(values)
                w = middle.centred(x) @ matrix
                flat = pa.array(w.reshape(-1), mask=np.tile(~known, len(w)))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, w.size + 1, k), pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([batch.column(1).take(pa.array(places)), pa.array(middle.squares(x), pa.int64()), lists], names=["row", "deviation", "whitened"])

    return wide.mapInArrow(lean(run), f"row {wide.schema['row'].dataType.simpleString()}, deviation long, whitened array<double>")


def op11_embedding_whitening(spark, sf_dir: str) -> DataFrame:
    """A row for each vector and component; an empty table gives no rows."""
    rows, key = read(spark, sf_dir, "embeddings"), "vec_id"
    columns = "component int, n long, deviation long, whitened double, explained double, identity_error double"
    model = fit(rows)
    if model is None:
        return spark.createDataFrame([], f"{key} {rows.schema[key].dataType.simpleString()}, {columns}")
    out = whitened(rows, model, carry=(key,)).select(F.col("row")[key].alias(key), "deviation", F.posexplode("whitened").alias("k", "whitened"))
    shares = F.array(*(F.lit(x).cast("double") for x in model.explained[:32]))
    return out.select(
        key, (F.col("k") + 1).cast("int").alias("component"), F.lit(model.centre.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(shares, F.col("k")).alias("explained"), F.lit(model.identity_error).cast("double").alias("identity_error"),
    )

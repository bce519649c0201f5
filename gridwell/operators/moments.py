"""Fourth-order moments of fields by domain, and which domains stand out by them.

Fields are put between 0 and 1 over all rows. Each task adds up the products of
all pairs of fields (and 1) with all pairs, for each domain that it sees: one
matrix, which holds every moment up to the fourth. Matrices of a domain are added
where they meet, and centred at the end, so rows are read once and a domain of any
size costs no task more than its share.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import number

KINDS = ("raw", "central", "cumulant")
#: Domains whose moments are no more than this, of fields between 0 and 1, have none
#: to speak of: what is left when they are centred is rounding.
NOTHING = 1e-14


def tensor(sums: np.ndarray, fields: int, kind: str = "central") -> np.ndarray:
    """The moments (fields, four times) of a matrix of sums: raw, about the mean, or
    without what normally distributed fields of the same covariance would have."""
    z = fields + 1
    m = sums / sums[0, 0]
    if kind != "raw":
        to = np.eye(z)
        to[0, 1:] = -m[0, 1:z]  # x - mean, of 1 and x
        both = np.kron(to, to)
        m = both.T @ m @ both
    whole = m.reshape(z, z, z, z)
    out = whole[1:, 1:, 1:, 1:]
    if kind == "cumulant":
        c = whole[0, 0, 1:, 1:]
        out = out - np.einsum("ab,cd->abcd", c, c) - np.einsum("ac,bd->abcd", c, c) - np.einsum("ad,bc->abcd", c, c)
    return out


def feature_moments(t: np.ndarray) -> np.ndarray | None:
    """Each field's share of the principal vectors of a tensor, weighed by their sizes; None where there are none."""
    u, s, _ = np.linalg.svd(t.reshape(len(t), -1), full_matrices=False)
    return (u**2 * s).sum(1) / s.sum() if s.sum() > NOTHING else None


def sums(df: DataFrame, fields: list[str], domain: str = "domain_id") -> DataFrame:
    """(domain, n, sums) of rows whose fields are all numbers; sums: a matrix of doubles, as bytes."""
    if not fields:
        raise ValueError("moments of at least one field")
    values = [number(F.col(f)) for f in fields]
    ends = df.agg(*(F.min(F.when(~F.isnan(v), v)).alias(f"a{k}") for k, v in enumerate(values)), *(F.max(F.when(~F.isnan(v), v)).alias(f"b{k}") for k, v in enumerate(values))).first()
    unit = lambda k, v: (v - F.lit(ends[f"a{k}"] or 0.0)) / F.lit(((ends[f"b{k}"] or 0.0) - (ends[f"a{k}"] or 0.0)) or 1.0)
    rows = df.select(F.col(domain).alias("domain"), F.array(*(unit(k, v) for k, v in enumerate(values))).alias("x"))
    rows = rows.filter(F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))))
    kind, width = rows.schema["domain"].dataType.simpleString(), len(fields)

    def run(batches):
        found: dict = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.asarray(batch.column(1).flatten()).reshape(-1, width)
            z = np.concatenate([np.ones((len(x), 1)), x], 1)
            pairs = (z[:, :, None] * z[:, None, :]).reshape(len(z), -1)
            codes = batch.column(0).dictionary_encode()
            at = codes.indices.fill_null(-1).to_numpy(zero_copy_only=False)
            for k in np.unique(at):
                part, name = pairs[at == k], codes.dictionary[k].as_py() if k >= 0 else None
                found[name] = found.get(name, 0) + part.T @ part
        task = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array(list(found), batch_type), pa.array([task] * len(found), pa.int32()), pa.array([m.tobytes() for m in found.values()], pa.binary())], names=["domain", "task", "sums"])

    def add(batches):
        last, total = None, None
        for batch in batches:
            names, data = [], []
            for name, m in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if total is not None and name != last:
                    names.append(last)
                    data.append(total)
                    total = None
                last, total = name, np.frombuffer(m) + (0 if total is None else total)
            yield made(names, data)
        if total is not None:
            yield made([last], [total])

    def made(names, data):
        return pa.RecordBatch.from_arrays([pa.array(names, batch_type), pa.array([int(round(m[0])) for m in data], pa.int64()), pa.array([m.tobytes() for m in data], pa.binary())], names=["domain", "n", "sums"])

    from pyspark.sql.pandas.types import to_arrow_type

    batch_type = to_arrow_type(rows.schema["domain"].dataType)
    return rows.mapInArrow(run, f"domain {kind}, task int, sums binary").repartition("domain").sortWithinPartitions("domain", "task").mapInArrow(add, f"domain {kind}, n long, sums binary")


def co_moments(df: DataFrame, fields: list[str], domain: str = "domain_id", kind: str = "central") -> DataFrame:
    """(domain, a, b, c, d, value): the fourth moments of the fields, by their places in the list."""
    if kind not in KINDS:
        raise ValueError(f"unknown kind {kind}; known are {', '.join(KINDS)}")
    n, side = len(fields), (len(fields) + 1) ** 2
    places = np.indices((n,) * 4).reshape(4, -1)

    def run(batches):
        for batch in batches:
            for k, data in enumerate(batch.column(2).to_pylist()):
                t = tensor(np.frombuffer(data).reshape(side, side), n, kind)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([k] * n**4)), *(pa.array(p, pa.int32()) for p in places), pa.array(t.reshape(-1))], names=["domain", *"abcd", "value"])

    found = sums(df, fields, domain)
    return found.mapInArrow(run, f"domain {found.schema['domain'].dataType.simpleString()}, a int, b int, c int, d int, value double")


def spatial_metric(df: DataFrame, fields: list[str], domain: str = "domain_id", kind: str = "central") -> DataFrame:
    """(domain, n, feature_moments, spatial_metric): the Hellinger distance of each
    domain's feature moments from their mean over domains. A domain without moments
    has none and a distance of 0."""
    if kind not in KINDS:
        raise ValueError(f"unknown kind {kind}; known are {', '.join(KINDS)}")
    n, side = len(fields), (len(fields) + 1) ** 2

    def run(batches):
        for batch in batches:
            out = [feature_moments(tensor(np.frombuffer(m).reshape(side, side), n, kind)) for m in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([None if f is None else f.tolist() for f in out], pa.list_(pa.float64()))], names=["domain", "n", "feature_moments"])

    found = sums(df, fields, domain)
    rows = found.mapInArrow(run, f"domain {found.schema['domain'].dataType.simpleString()}, n long, feature_moments array<double>")
    means = rows.agg(*(F.avg(F.get("feature_moments", F.lit(k))).alias(f"m{k}") for k in range(n))).first()
    mean = F.array(*(F.lit(means[f"m{k}"]).cast("double") for k in range(n)))
    apart = F.aggregate(F.zip_with("feature_moments", mean, lambda a, b: F.pow(F.sqrt(a) - F.sqrt(b), 2)), F.lit(0.0), lambda s, x: s + x)
    return rows.withColumn("spatial_metric", F.coalesce(F.sqrt(apart / 2), F.lit(0.0)))

"""Fourth moments and the metric of domains, against numpy over whole tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridwell.operators import mesh as ms
from gridwell.operators import moments as mo
from gridwell.plans.actions import ActionError, Engine
from gridwell.plans.evaluate import Data

SF = "/root/testdata/sf0.001"


def brute(x, kind):
    c = x if kind == "raw" else x - x.mean(0)
    t = np.einsum("na,nb,nc,nd->abcd", c, c, c, c) / len(c)
    if kind == "cumulant":
        v = c.T @ c / len(c)
        t = t - np.einsum("ab,cd->abcd", v, v) - np.einsum("ac,bd->abcd", v, v) - np.einsum("ad,bc->abcd", v, v)
    return t


@pytest.mark.parametrize("kind", mo.KINDS)
def test_tensors_of_embeddings(spark, kind):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("label", *(F.col("embedding")[k].cast("double").alias(f"e{k}") for k in range(4))).repartition(5)
    table = rows.toPandas()
    x = table[[f"e{k}" for k in range(4)]].to_numpy()
    x = (x - x.min(0)) / (x.max(0) - x.min(0))
    got = {(r["domain"], r["a"], r["b"], r["c"], r["d"]): r["value"] for r in mo.co_moments(rows, [f"e{k}" for k in range(4)], "label", kind).collect()}
    for label in table.label.unique():
        t = brute(x[(table.label == label).to_numpy()], kind)
        assert all(got[label, *at] == pytest.approx(v, abs=1e-12) for at, v in np.ndenumerate(t))
    assert len(got) == table.label.nunique() * 4**4


def test_domains_that_stand_out(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = []
    for domain in range(6):
        a, b, c = rng.normal(size=(3, 400))
        if domain == 4:
            a[::40] += 12.0  # one field with a heavy tail
        rows += [(domain, 1000 * domain + k, float(x), float(y), float(z)) for k, (x, y, z) in enumerate(zip(a, b, c, strict=True))]
    rows += [(7, 1, 0.0, 0.0, 0.0), (0, 2, None, 1.0, 1.0), (0, 3, float("nan"), 1.0, 1.0)]
    cells = spark.createDataFrame(rows, "domain_id int, cell_id long, a double, b double, c double").repartition(7)
    got = {r["domain"]: r for r in mo.spatial_metric(cells, ["a", "b", "c"]).collect()}
    x = np.array([r[2:] for r in rows if r[2] is not None and r[2] == r[2]], float)
    domain = np.array([r[0] for r in rows if r[2] is not None and r[2] == r[2]])
    x = (x - x.min(0)) / (x.max(0) - x.min(0))
    want = {d: mo.feature_moments(brute(x[domain == d], "central")) for d in range(6)}
    mean = np.mean(list(want.values()), 0)
    for d, f in want.items():
        assert got[d]["n"] == 400 and got[d]["feature_moments"] == pytest.approx(f.tolist()) and sum(f) == pytest.approx(1)
        assert got[d]["spatial_metric"] == pytest.approx(np.sqrt(((np.sqrt(f) - np.sqrt(mean)) ** 2).sum() / 2))
    assert got[7]["feature_moments"] is None and got[7]["spatial_metric"] == 0
    assert max(got, key=lambda d: got[d]["spatial_metric"]) == 4
    engine = Engine().publish(Data(cells))
    learn = lambda **p: engine.execute([{"action": "add_extracts", "extracts": {"e": {"type": "learn", "params": p}}}])["extracts"]["e"]
    high = got[4]["spatial_metric"]
    said = learn(fields=["a", "b", "c"], path=str(tmp_path / "m"), threshold=high * 0.99)
    assert said["triggered"] and said["max"] == pytest.approx(high) and not learn(fields=["a", "b", "c"], path=str(tmp_path / "m"), threshold=high * 1.01)["triggered"]
    written = spark.read.parquet(str(tmp_path / "m"))
    assert written.count() == len(rows) and written.filter("domain_id = 4").select("spatial_metric").distinct().count() == 1
    for bad in ({"fields": []}, {"fields": ["none"]}, {}):
        with pytest.raises(ActionError):
            learn(path=str(tmp_path / "m"), **bad)


def test_moments_of_nothing(spark):
    empty = spark.createDataFrame([], "domain_id int, a double")
    assert mo.spatial_metric(empty, ["a"]).collect() == [] and mo.co_moments(empty, ["a"]).collect() == []
    for call in (lambda: mo.co_moments(empty, []), lambda: mo.co_moments(empty, ["a"], kind="other"), lambda: mo.spatial_metric(empty, ["a"], kind="other")):
        with pytest.raises(ValueError):
            call()

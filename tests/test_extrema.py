"""Merge trees against a sweep over all vertices from the highest down."""

import collections

import pytest
from pyspark.sql import functions as F

from gridwell.operators import extrema as xt
from gridwell.operators import mesh as ms
from gridwell.plans.actions import ActionError, Engine
from gridwell.plans.evaluate import Data


def swept(edges):
    """(end -> saddle of each maximum that merges, those that never do)"""
    near = collections.defaultdict(set)
    for _, a, b in edges:
        near[tuple(a)].add(tuple(b))
        near[tuple(b)].add(tuple(a))
    up, out = {}, {}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for x in sorted(near, reverse=True):
        roots = sorted({top(y) for y in near[x] if y in up})
        up[x] = roots[-1] if roots else x
        for r in roots[:-1]:
            up[r], out[r] = roots[-1], x
    return out, {x for x in near if top(x) == x}, near


def noisy(spark, dims, step=0.5):
    m = ms.uniform(spark, dims)
    noise = F.pmod(F.xxhash64("vertex_id"), F.lit(1000)) / 100
    m.vertices = m.vertices.withColumn("g", F.when(F.col("vertex_id") % 31 != 7, F.round(noise / step) * step))
    return m


@pytest.mark.parametrize(("dims", "minima", "few"), [((12, 11), False, 100_000), ((6, 5, 5), True, 4), ((9, 8), True, 0)])
def test_pairs_of_extrema_and_saddles(spark, monkeypatch, dims, minima, few):
    """Many equal values, some missing, whether the driver orders the last saddles or rounds do."""
    m = noisy(spark, dims)
    monkeypatch.setattr(xt, "FEW", few)
    sign = -1 if minima else 1
    out, tops, _ = swept(xt._edges(m, xt._value("g", minima)).collect())
    want = {k[1]: (sign * k[0], s[1], sign * s[0]) for k, s in out.items()} | {k[1]: (sign * k[0], None, None) for k in tops}
    got = {r["vertex_id"]: (r["value"], r["saddle_id"], r["saddle"]) for r in xt.extrema(m, "g", minima).collect()}
    assert got == want and len(out) > 2


def test_segments_flow_up_and_minor_ones_join(spark):
    m = noisy(spark, (10, 9), 0.01)
    _, _, near = swept(xt._edges(m, xt._value("g", False)).collect())
    value = {x[1]: x[0] for x in near}

    def end(x):
        best = max([x, *near[x]])
        return x if best == x else end(best)

    basin = {x[1]: end(x)[1] for x in near}
    got = {r["vertex_id"]: r["segment"] for r in xt.segments(m, "g").collect()}
    assert got == basin
    tree = {r["vertex_id"]: r for r in xt.extrema(m, "g").collect()}

    def major(k):
        return k if tree[k]["persistence"] is None or tree[k]["persistence"] >= 3 else major(tree[k]["into"])

    got = {r["vertex_id"]: r["segment"] for r in xt.segments(m, "g", persistence=3.0, least=2.0).collect()}
    assert got == {k: major(b) for k, b in basin.items() if value[k] >= 2} and len(set(got.values())) < len(set(basin.values()))


def test_extrema_of_next_to_nothing(spark):
    m = ms.uniform(spark, (3, 3))
    m.vertices = m.vertices.withColumns({"flat": F.lit(1.0), "none": F.lit(None).cast("double"), "one": F.col("x")})
    assert [(r["vertex_id"], r["value"], r["saddle"]) for r in xt.extrema(m, "flat").collect()] == [(8, 1.0, None)]
    assert xt.extrema(m, "none").collect() == [] and xt.segments(m, "none").collect() == []
    assert [r["vertex_id"] for r in xt.extrema(m, "one", minima=True).collect()] == [6]
    assert xt.relevant_levels(m, "one", 3) == []
    two = ms.Mesh(m.vertices.union(m.vertices.withColumn("domain_id", F.lit(1))), m.cells.union(m.cells.withColumn("domain_id", F.lit(1))), m.axes)
    assert {(r["domain_id"], r["vertex_id"]) for r in xt.extrema(two, "one").collect()} == {(0, 8), (1, 8)}


def test_levels_beside_saddles(spark):
    """Two hills of 5 and 3 over a pass of 1, in a plain of 0 with a hole of -2 in it."""
    m = ms.uniform(spark, (9, 9))
    at = lambda x, y: (F.col("x") == x) & (F.col("y") == y)
    hill = F.when(at(2, 4), 5.0).when(at(6, 4), 3.0).when((F.col("y") == 4) & F.col("x").between(3, 5), 1.0).when(at(4, 7), -2.0).when((F.col("y") == 0), -3.0).otherwise(0.0)
    m.vertices = m.vertices.withColumn("h", hill)
    assert xt.relevant_levels(m, "h", 2) == pytest.approx([0 - 1e-5, 1 + 1e-5])
    assert xt.relevant_levels(m, "h", 1) == pytest.approx([0 - 1e-5]) or xt.relevant_levels(m, "h", 1) == pytest.approx([1 + 1e-5])
    engine = Engine().publish(Data(m.cells, m.vertices, mesh=m))
    run = lambda **p: engine.execute([{"action": "add_pipelines", "pipelines": {"p": {"f": {"type": "contour", "params": {"field": "h", **p}}}}}])
    run(levels=2, use_contour_tree="true")
    assert {round(r["level"], 4) for r in engine.pipelines["p"].cells.collect()} == {0.0, 1.0}
    with pytest.raises(ActionError):
        run(iso_values=[1.0], use_contour_tree="true")


def test_edges_come_once_from_a_group_of_cells(spark):
    """Neighbouring cells share edges; a cell that names a vertex twice has none from it to itself."""
    m = ms.uniform(spark, (6, 5))
    value = F.col("x") + F.col("y")
    rows = xt._edges(m, value).collect()
    assert len(rows) == len(set(rows)) == 5 * 5 + 6 * 4 + 5 * 4
    cells = spark.createDataFrame([(0, [0, 1, 1]), (1, [0, 1, 6])], "cell_id long, conn array<long>")
    rows = xt._edges(ms.explicit(m.vertices.drop("domain_id", "i", "j", "k"), cells, ("x", "y")), value).collect()
    assert sorted((r["low"]["id"], r["high"]["id"]) for r in rows) == [(0, 1), (0, 6), (1, 6)]

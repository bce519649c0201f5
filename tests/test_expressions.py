"""Exact values of expressions over a grid of 5 by 5 vertices whose 16 elements hold their index."""

import math

import pytest
from pyspark.sql import functions as F

from gridwell.operators import mesh as ms
from gridwell.plans.evaluate import Data, Evaluator, History
from gridwell.plans.language import ExpressionError, parse


@pytest.fixture(scope="module")
def data(spark):
    m = ms.uniform(spark, (5, 5), (-10, -10), (10, 10))
    index = F.col("cell_id").cast("double")
    holes = F.when(F.col("cell_id") == 0, float("nan")).when(F.col("cell_id") == 1, float("-inf")).otherwise(index)
    m.cells = m.cells.withColumn("f", index).withColumn("g", holes).cache()
    m.vertices = m.vertices.cache()
    return Data.of_mesh(m, cycle=100, time=2.1)


@pytest.mark.parametrize(
    ("text", "value"),
    [
        ("(2.0 + 1) / 0.5", 6.0),
        ("7 / 2", 3),
        ("-7 / 2", -3),
        ("-7 % 2", -1),
        ("1 + 2 * 3", 7),
        ("not (1 > 2) and True", True),
        ("if 3 > 2 then 1.5 else 2.5", 1.5),
        ("a = 3\nb = a + 1\nb * a", 12),
        ("vector(1, 2, 2) + vector(0, 0, 0)", {"x": 1.0, "y": 2.0, "z": 2.0}),
        ("magnitude(vector(1, 2, 2))", 3.0),
        ("max([1, 5, 2])", 5.0),
        ("replace([1.0, nan()], nan(), 0)", [1.0, 0.0]),
        ("cycle()", 100),
        ("time()", 2.1),
        ("max(field('f')).position.x", 25.0),
        ("min(field('f')).value", 0.0),
        ("max(field('f')).element.index", 15),
        ("sum(field('f'))", 120.0),
        ("avg(field('f') * 2 + 1)", 16.0),
        ("field_nan_count(field('g'))", 1.0),
        ("field_inf_count(field('g'))", 1.0),
        ("histogram(field('f'), num_bins=3).value", [5.0, 5.0, 6.0]),
        ("entropy(histogram(field('f')))", -math.log(1 / 16)),
        ("bin(cdf(histogram(field('f'))), val=5.0)", 0.375),
        ("bin(pdf(histogram(field('f'))), val=5)", 1 / 16),
        ("bin(pdf(histogram(field('f'))), val=4.5)", 0.0),
        ("quantile(cdf(histogram(field('f'), num_bins=240)), 3.0/16.0, 'lower')", 2.0),
        ("bounds().max.x", 30.0),
        ("sum(topo('mesh').cell.volume)", None),
        ("sum(topo('mesh').cell.area)", 1600.0),
        ("sum(if field('f') > 7 then 1 else 0)", 8.0),
        ("max(abs(field('f') - 20)).value", 20.0),
        ("binning('f', 'sum', [axis('x', num_bins=4)]).value", [24.0, 28.0, 32.0, 36.0]),
        ("bin(binning('f', 'max', [axis('f', min_val=0, max_val=16, num_bins=2)]), 1).value", 15.0),
        ("avg(gradient(field('f')).x)", 0.1),
        ("max(recenter(field('f'))).value", 15.0),
        ("sum(binning_value(binning('f', 'max', [axis('y', num_bins=4)])))", 144.0),
        ("avg(magnitude(vector(field('f'), field('f'), field('f'))))", 7.5 * math.sqrt(3)),
    ],
)
def test_values(data, text, value):
    from gridwell.plans.evaluate import plain

    if value is None:
        with pytest.raises(ExpressionError):
            Evaluator(data).run(text)
        return
    got = plain(Evaluator(data).run(text))
    if isinstance(value, float):
        assert got == pytest.approx(value, rel=1e-9)
    else:
        assert got == value


@pytest.mark.parametrize("text", ["1 +", "field('nothing')", "1.5 % 2", "unknown", "abs()", "if 1 then 2 else 3", "[1, 2][2]", "[1][0 - 1]", "histogram(field('f'), min_val=2, max_val=1)", "vector(1, 2, 3) * vector(1, 2, 3)"])
def test_errors(data, text):
    with pytest.raises(ExpressionError):
        Evaluator(data).run(text)


def test_statements_and_calls():
    statements, result = parse("a = max(1, 2)\n# a remark\nb = histogram(field('f'),\n  num_bins=3)\nb.value[1] + a")
    assert [n for n, _ in statements] == ["a", "b"]
    assert type(result).__name__ == "Binary"


HISTORY = [("val", 100, 2.0, 1.0), ("val", 200, 4.0, 2.0), ("val", 300, 6.0, 3.0), ("val", 400, 8.0, 4.0)]


@pytest.mark.parametrize(
    ("text", "value"),
    [
        ("history(val, 3)", 1.0), ("history(val, 9)", 1.0), ("history('val', absolute_index=2)", 3.0), ("val", 4.0),
        ("gradient('val')", 1.0), ("gradient('val', 2)", 1.0), ("gradient('val', 2, 'time')", 0.5), ("gradient('val', 3, 'time')", 0.5),
        ("gradient('val', 10, 'time')", 0.5), ("gradient('val', 100, 'cycle')", 0.01), ("gradient('val', 150, 'cycle')", 0.01),
        ("history_range('val', first_absolute_index=1, last_absolute_index=2)", [2.0, 3.0]),
        ("history_range('val', first_absolute_time=3.5, last_absolute_time=100)", [2.0, 3.0, 4.0]),
        ("gradient_range('val', first_relative_index=0, last_relative_index=2)", [0.5, 0.5]),
    ],
)
def test_history(data, text, value):
    got = Evaluator(data, History(HISTORY)).run(text)
    assert got == pytest.approx(value)


def test_history_needs_one_kind_of_end(data):
    with pytest.raises(ExpressionError):
        Evaluator(data, History(HISTORY)).run("history_range('val', first_absolute_index=1, last_absolute_time=2)")

"""Every registered query of the engine against its SQL, on the smallest data."""

import math
from pathlib import Path

import duckdb
import pytest

from gridwell.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v if math.isinf(v) else float(f"{v:.9g}") + 0.0
    return v if v is None or isinstance(v, int | str | bool) else str(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, tables, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    made = [tuple(norm(r[c]) for c in columns) for r in df.collect()]
    found = tables.execute(SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    wanted = [tuple(norm(r[names.index(c)]) for c in columns) for r in found.fetchall()]
    assert sorted(made, key=repr) == sorted(wanted, key=repr)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0

"""Every registered query against its SQL in DuckDB, on the smallest data."""

import math
from pathlib import Path

import duckdb
import pytest

from granary.plans import registry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="there is no test data")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.12g}")
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted([tuple(plain(r[i]) for i in order) for r in rows], key=str)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, con, name):
    df = registry.queries()[name](spark, DATA)
    got = rows_of(df.columns, df.collect())
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(names)
    assert got == rows_of(names, found.fetchall())

"""Every query with SQL returns what the SQL returns, at the smallest size."""

import math

import duckdb
import pytest

from tsumugi.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = ["documents", "benchmark", "labels", "pages", "conversations", "events"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def rows(names, data):
    order = sorted(range(len(names)), key=names.__getitem__)
    fix = lambda x: round(x, 9) if isinstance(x, float) and not math.isnan(x) else x
    return sorted(names), sorted(map(str, ([fix(r[i]) for i in order] for r in data)))


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, con, name):
    df = registry.queries()[name](spark, SF)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert got[1]
        return
    rel = con.sql(sql)
    want = rows(rel.columns, rel.fetchall())
    assert got[0] == want[0]
    assert got[1][:3] == want[1][:3] and got == want

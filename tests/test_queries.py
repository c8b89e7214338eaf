"""Every named query against its SQL statement on the smallest tables."""

import decimal
import glob
import os

import duckdb
import pytest

from firnline.plans import registry

SF = os.environ.get("QUERY_SF_DIR", "/root/testdata/sf0.001")
QUERIES = registry()
TYPES = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean", "DATE": "date"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def _plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return float(v) + 0.0
    return v


def _sorted(rows):
    return sorted(rows, key=lambda r: tuple((v is None, str(type(v)), 0 if v is None else v) for v in r))


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    q = QUERIES[name]
    df = q.run(spark, SF)
    columns = sorted(df.columns)
    types = dict(df.dtypes)
    rows = _sorted(tuple(_plain(v) for v in r) for r in df.select(*[f"`{c}`" for c in columns]).collect())
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert q.sql is not None
    result = duck.execute(q.sql)
    described = {d[0]: str(d[1]) for d in result.description}
    assert sorted(described) == columns
    assert {c: TYPES.get(t, t) for c, t in described.items()} == types
    at = [list(described).index(c) for c in columns]
    expected = _sorted(tuple(_plain(r[i]) for i in at) for r in result.fetchall())
    assert rows == expected

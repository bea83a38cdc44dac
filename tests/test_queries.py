"""Every query with SQL equals that SQL over the smallest tables; the others run."""

import glob
import os

import duckdb
import pytest

from weftline.plans import registry

DIR = os.environ.get("WEFTLINE_TEST_TABLES", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in glob.glob(f"{DIR}/*.parquet"):
        c.sql(f"create view {os.path.basename(t)[:-8]} as select * from '{t}'")
    return c


def _cell(x):
    if x is None or x != x:
        return "null"
    return str(round(float(x), 6)) if isinstance(x, (int, float)) and not isinstance(x, bool) or type(x).__name__ in ("Decimal", "int64", "int32", "float64") else str(x)


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equals_sql(spark, duck, name):
    df = registry.queries()[name](spark, DIR)
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    want = duck.sql(registry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert got == _rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs(spark, name):
    assert registry.queries()[name](spark, DIR).count() > 0


def test_stream_equals_batch(spark):
    q = registry.queries()
    assert sorted(map(tuple, q["adapted_delays"](spark, DIR).collect())) == sorted(map(tuple, q["stream_delays"](spark, DIR).collect()))

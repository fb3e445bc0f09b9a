"""Every query with SQL against DuckDB on the small tables."""

import glob
import math
import os

import duckdb
import pytest

SF = "/root/testdata/sf0.001"

import __spark_entry__ as entry  # noqa: E402
from lexweave.plans import registry  # noqa: E402


def canon(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    fix = lambda v: round(float(v), 8) + 0.0 if isinstance(v, float) or type(v).__name__ == "Decimal" else v
    return sorted((tuple(fix(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, db, name):
    df = registry.queries()[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    res = db.execute(registry.oracle_sql()[name])
    names = [d[0] for d in res.description]
    want = res.fetchall()
    assert sorted(names) == sorted(df.columns)
    assert len(got) == len(want)
    assert canon(got, df.columns) == canon(want, names)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert math.isfinite(len(entry.queries()))

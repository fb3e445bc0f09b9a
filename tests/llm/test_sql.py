"""Corpus queries with SQL against DuckDB."""

import duckdb
import pytest

from lexweave.llm import queries
from tests.llm.conftest import SF


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "labels"):
        db.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = queries.queries()[name](spark, SF)
    res = db.execute(queries.oracle_sql()[name])
    names = [x[0] for x in res.description]
    want = sorted(tuple(r[names.index(c)] for c in df.columns) for r in res.fetchall())
    assert sorted(map(tuple, df.collect())) == want

"""Every query with DuckDB SQL gives the SQL's rows, on a whole fixture table."""

import duckdb
import pytest

from wayfold.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_equals_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    df = queries.QUERIES[name](spark, SF)
    r = c.execute(queries.ORACLE[name])
    have, cols = [d[0] for d in r.description], sorted(df.columns)
    assert sorted(have) == cols
    want = sorted((tuple(row[have.index(k)] for k in cols) for row in r.fetchall()), key=str)
    assert sorted((tuple(row[k] for k in cols) for row in df.collect()), key=str) == want

"""Every query with DuckDB SQL gives the SQL's rows; the others give rows, or none where they look for broken bounds."""

import math

import duckdb
import pytest

from wayfold.plans import registry

from .conftest import SF

TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0 if v else 0.0)
    return str([plain(x) for x in v]) if isinstance(v, (list, tuple)) else str(v)


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_equals_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    r = duck.execute(registry.ORACLE[name])
    have = [d[0] for d in r.description]
    assert sorted(have) == cols
    want = sorted([plain(row[have.index(c)]) for c in cols] for row in r.fetchall())
    assert sorted([plain(row[c]) for c in cols] for row in df.collect()) == want


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE)))
def test_rows_without_sql(spark, name):
    df = registry.QUERIES[name](spark, SF)
    keys = [c for c in ("scenario_id", "trajectory_id", "method_a", "configuration") if c in df.columns]
    rows = df.collect()
    assert (not rows) == name.endswith("_bound_problems")
    assert all(r[k] is not None for r in rows for k in keys)


def test_flagship(spark):
    r = registry.flagship(spark, SF).first()
    # worked out independently in SQL for this table
    assert (r["count"], round(r["mean"], 4), round(r["p95"], 4), round(r["maximum"], 4)) == (799, 27.5699, 109.4765, 236.2917)

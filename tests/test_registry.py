import math

import duckdb
import pytest
from timeweft.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents".split()


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


def cell(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return "null"
    return f"{float(x):.6f}" if isinstance(x, (int, float)) and not isinstance(x, bool) or type(x).__name__ == "Decimal" else str(x)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_agrees_with_sql(spark, data, duck, name):
    got = registry.QUERIES[name](spark, data)
    want = duck.sql(registry.SQL[name])
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    pick = [want.columns.index(c) for c in columns]
    assert sorted(tuple(map(cell, (r[c] for c in columns))) for r in got.collect()) == sorted(tuple(cell(r[i]) for i in pick) for r in want.fetchall())


def test_flagship(spark, data):
    assert registry.flagship(spark, data).count() > 0


def test_entry_point_imports():
    import __spark_entry__ as e

    assert set(registry.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())

"""Every registered query of the match and map operators against its DuckDB oracle."""

import math

import duckdb
import pytest

from matchspark.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def plain(x):
    """A value as both engines spell it."""
    if x is None or isinstance(x, float) and math.isnan(x):
        return None
    return round(float(x), 6) if isinstance(x, (int, float)) and not isinstance(x, bool) or hasattr(x, "as_tuple") else str(x)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES.split():
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_equals_oracle(spark, duck, name):
    want = duck.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    rows = sorted((tuple(map(plain, r)) for r in want.fetchall()), key=str)
    got = registry.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    assert sorted((tuple(map(plain, r)) for r in got.select(*columns).collect()), key=str) == rows

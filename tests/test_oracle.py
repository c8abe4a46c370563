"""Every registered query of the session-log operators against its SQL, on the smallest tables."""

import math
import os

import duckdb
import pytest

from sparklog import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="the test tables are not here")


@pytest.fixture(scope="module")
def sql():
    connection = duckdb.connect()
    connection.execute("SET TimeZone='UTC'")
    for name in ("events", "conversations"):
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return connection


def same(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 8) + 0.0
    return tuple(map(same, value)) if isinstance(value, (list, tuple)) else value


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_its_sql(spark, sql, name):
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(same(r[c]) for c in columns) for r in df.collect()), key=repr)
    result = sql.execute(queries.SQL[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == sorted((tuple(same(row[k]) for k in at) for row in result.fetchall()), key=repr)


def test_every_query_has_sql():
    assert queries.QUERIES.keys() == queries.SQL.keys()

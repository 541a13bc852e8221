"""Every registered query against its SQL on the smallest test tables."""

import math
import os

import pytest

from catalogue import registry

FOLDER = "/root/testdata/sf0.001"
TABLES = [f[: -len(".parquet")] for f in os.listdir(FOLDER)] if os.path.isdir(FOLDER) else []

pytestmark = pytest.mark.skipif(not TABLES, reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


def canonical(rows, columns):
    def value(v):
        if isinstance(v, float):
            return "null" if math.isnan(v) else repr(round(v, 6) + 0.0)
        return str(v)

    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([value(row[i]) for i in order] for row in rows)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, FOLDER)
    rows = [tuple(r) for r in df.collect()]
    if name not in registry.ORACLES:
        assert rows
        return
    result = duck.execute(registry.ORACLES[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert canonical(rows, df.columns) == canonical(result.fetchall(), columns)


def test_every_oracle_has_a_query():
    assert set(registry.ORACLES) <= set(registry.QUERIES)


def test_entry(spark):
    import __spark_entry__ as entry

    got = entry.entry(spark).collect()
    assert len(got) == 45 and all(r["strato_id"].count("|") == 7 for r in got)
    assert set(registry.QUERIES) <= set(entry.queries())

"""Every registered query against its SQL on the smallest given tables."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as driver

FOLDER = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="the given tables are not here")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


def same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return a == b or (math.isnan(a) and math.isnan(b)) or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)
    return a == b


@pytest.mark.parametrize("name", list(driver.queries()))
def test_query(spark, duck, name):
    df = driver.queries()[name](spark, FOLDER)
    rows = df.collect()
    assert rows
    sql = driver.oracle_sql().get(name)
    if sql is None:
        return
    cursor = duck.execute(sql)
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    order = sorted(columns)
    got = sorted(([r[c] for c in order] for r in rows), key=repr)
    want = sorted(([r[columns.index(c)] for c in order] for r in cursor.fetchall()), key=repr)
    assert len(got) == len(want)
    assert all(same(x, y) for a, b in zip(got, want) for x, y in zip(a, b))


def test_entry(spark):
    assert {r.id for r in driver.entry(spark).collect()} == {"plus", "minus", "plus_minus_delta"}


def test_schedules_agree(spark):
    row = driver.queries()["schedule_invariance"](spark, FOLDER).first()
    assert (row.plans, row.digests) == (3, 1)


def test_seeds_differ(spark):
    rows = driver.queries()["draws_over_seeds"](spark, FOLDER).collect()
    assert len({r.avg for r in rows}) == len(rows)

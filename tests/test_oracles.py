"""Every registered query with reference SQL gives the same rows as DuckDB."""

import math

import duckdb
import pytest

import __spark_entry__ as entry_point

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()
ORACLES = entry_point.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float) and math.isnan(value):
        return None
    return value


def rows_of(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(r[i]) for i in order) for r in records]
    return sorted(out, key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(name, spark, sf_dir, duck):
    df = entry_point.queries()[name](spark, sf_dir)
    result = duck.execute(ORACLES[name])
    columns = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(columns)
    ours = rows_of(df.columns, [tuple(r) for r in df.collect()])
    theirs = rows_of(columns, result.fetchall())
    assert len(ours) == len(theirs)
    for a, b in zip(ours, theirs):
        assert a == b


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(entry_point.queries())


def test_entry(spark):
    assert entry_point.entry(spark).columns[:2] == ["account", "txns"]

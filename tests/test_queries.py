"""Every registered query runs; those with a SQL twin give its rows."""

import math

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    if hasattr(v, "isoformat"):
        return str(pd.Timestamp(v).tz_localize(None))
    return float(v) if type(v).__name__ == "Decimal" else v


def _rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, duck, sf_dir, name):
    df = entry.queries()[name](spark, sf_dir)
    data = df.collect()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert data and df.columns
        return
    result = duck.execute(sql)
    columns = [c[0] for c in result.description]
    assert sorted(df.columns) == sorted(columns)
    assert _rows(df.columns, data) == _rows(columns, result.fetchall())


def test_every_twin_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())

"""Every query runs on the smallest tables and, where there is SQL, gives its rows."""

import math

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from reconlake.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents".split()
SQL = catalog.oracle_sql()


def plain(x):
    if x is None or x is pd.NA or x is pd.NaT or (isinstance(x, float) and math.isnan(x)):
        return "-"
    return str(int(x)) if isinstance(x, (int, float)) and float(x).is_integer() else str(x)


def rows_of(frame):
    columns = sorted(frame.columns)
    return columns, sorted(tuple(plain(x) for x in r) for r in frame[columns].astype(object).values.tolist())


@pytest.fixture(scope="module")
def sql():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return connection


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, sql, name):
    got = catalog.queries()[name](spark, SF).toPandas()
    if name in SQL:
        assert rows_of(got) == rows_of(sql.execute(SQL[name]).df())


def test_entry_and_names(spark):
    assert entry.entry(spark).count() == 365
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_journals_balance(spark):
    assert catalog.queries()["L11_balanced_entries"](spark, SF).first()["unbalanced"] == 0

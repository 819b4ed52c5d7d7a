"""Each registered query gives the rows of its SQL counterpart on the smallest data set."""

from __future__ import annotations

import datetime
import math
import os

import duckdb
import pytest

import __spark_entry__ as contract

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test data")


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for name in os.listdir(SF_DIR):
        connection.execute(f"create view {name.removesuffix('.parquet')} as select * from '{SF_DIR}/{name}'")
    return connection


def plain(value):
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    if isinstance(value, bool) or value is None:
        return str(value)
    if isinstance(value, (int, float)):
        return "nan" if math.isnan(value) else f"{float(value) + 0.0:.9g}"
    return str(value)


def table(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted([plain(row[i]) for i in order] for row in rows)


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_query_matches_sql(spark, database, name):
    df = contract.queries()[name](spark, SF_DIR)
    mine = table(df.columns, df.collect())
    cursor = database.execute(contract.oracle_sql()[name])
    assert mine == table([c[0] for c in cursor.description], cursor.fetchall())


@pytest.mark.parametrize("name", sorted(set(contract.queries()) - set(contract.oracle_sql())))
def test_query_without_sql_gives_rows(spark, name):
    assert not contract.queries()[name](spark, SF_DIR).isEmpty()


def test_entry(spark):
    assert contract.entry(spark).count() == 25


@pytest.mark.parametrize("sf_dir", [SF_DIR, "/root/testdata/sf0.01"])
def test_cases_reach_every_rule(sf_dir):
    """The SQL's own rows at two scales hold each alert, health and each turnover class."""
    connection = duckdb.connect()
    for name in os.listdir(sf_dir):
        connection.execute(f"create view {name.removesuffix('.parquet')} as select * from '{sf_dir}/{name}'")
    sql = contract.oracle_sql()["alert_cases"]
    kinds = {row[0] for row in connection.execute(f"select distinct alert_type from ({sql})").fetchall()}
    assert kinds == {None, "CRITICAL", "SEASONAL_RISK", "RESTOCK_SOON", "LOW_STOCK", "OVERSTOCK"}
    assert len(connection.execute(f"select distinct turnover from ({sql})").fetchall()) == 3

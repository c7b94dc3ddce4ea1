"""Registered queries against their SQL on the smallest tables."""

import datetime
import decimal

import duckdb
import pytest

from tidelog.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, (datetime.date, decimal.Decimal)):
        return str(value)
    return round(value, 9) if isinstance(value, float) else value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(repr([plain(r[k]) for k in order]) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_equals_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    told = duck.sql(catalog.ORACLES[name])
    assert sorted(df.columns) == sorted(told.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(told.columns, told.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(catalog.QUERIES) <= set(__spark_entry__.queries())
    assert set(catalog.ORACLES) <= set(__spark_entry__.oracle_sql())


def test_filters_reach_the_scan(spark):
    plan = catalog.QUERIES["facet_or"](spark, SF)._jdf.queryExecution().toString()
    assert "PushedFilters" in plan and "o_orderstatus" in plan.split("PushedFilters")[1]
    assert "o_totalprice" not in plan.split("ReadSchema")[1]

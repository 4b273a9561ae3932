"""Every registered query against its SQL on the smallest data set."""

import datetime
import math
import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry

# the operators of the subpackage have their own tests
OWN = {n for part in (entry.preparation, entry.reference, entry.dirty) for n in part.QUERIES}


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None) if v.tzinfo is None else v.astimezone(datetime.timezone.utc).replace(tzinfo=None)
    if isinstance(v, (int, float)) and not isinstance(v, bool):
        return float(v) + 0.0
    return v


def rows(names, table):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in table)


@pytest.fixture(scope="module")
def views(data):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for f in os.listdir(data):
        con.execute(f"create view {f.split('.')[0]} as select * from '{data}/{f}'")
    return con


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(set(entry.oracle_sql()) & OWN))
def test_same_rows_as_sql(spark, data, views, name):
    df = entry.queries()[name](spark, data)
    found = views.execute(entry.oracle_sql()[name])
    names = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(names, found.fetchall())


@pytest.mark.parametrize("name", sorted(OWN - set(entry.oracle_sql())))
def test_queries_without_sql_give_rows(spark, data, name):
    assert entry.queries()[name](spark, data).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0

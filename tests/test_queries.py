"""Every query of the core beside its SQL, on the smallest tables."""

import math
import os
from decimal import Decimal

import duckdb
import pytest

from dwell.plans import catalogue


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    return con


def plain(v):
    if isinstance(v, float | Decimal):
        return "nan" if math.isnan(v) else f"{float(v):.6f}".replace("-0.000000", "0.000000")
    return str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(tuple(plain(r[k]) for k in order) for r in data)


def test_all_have_sql():
    assert set(catalogue.QUERIES) == set(catalogue.SQL)


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_rows_are_those_of_the_sql(spark, sf, db, name):
    got = catalogue.QUERIES[name](spark, sf)
    found = db.execute(catalogue.SQL[name])
    columns = [c[0] for c in found.description]
    assert sorted(got.columns) == sorted(columns)
    assert rows(got.columns, got.collect()) == rows(columns, found.fetchall())

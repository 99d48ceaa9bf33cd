from __future__ import annotations

import importlib
import os

import duckdb
import pytest

DATA = "/root/testdata/sf0.001"


def norm(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    frame = frame.where(frame.notna(), None)
    return sorted(tuple(repr(round(v, 9) + 0.0) if isinstance(v, float) else str(v) for v in r) for r in frame.itertuples(index=False))


@pytest.fixture(scope="module")
def tables():
    db = duckdb.connect()
    for name in os.listdir(DATA):
        db.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{DATA}/{name}'")
    return db


def plans():
    return importlib.import_module("loomspark.plans.queries")


def test_entry(spark):
    assert importlib.import_module("__spark_entry__").entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(plans().ORACLE_SQL))
def test_query_equals_its_sql(spark, tables, name):
    got, want = plans().QUERIES[name](spark, DATA).toPandas(), tables.execute(plans().ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and norm(got) == norm(want)


@pytest.mark.parametrize("name", sorted(set(plans().QUERIES) - set(plans().ORACLE_SQL)))
def test_query_without_sql_has_rows(spark, name):
    assert plans().QUERIES[name](spark, DATA).count() > 0

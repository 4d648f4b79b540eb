"""Every query against its SQL, and the entry point."""

import math

import duckdb
import pytest
from conftest import SF

import __spark_entry__ as entry
from sieveline.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def value(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, (list, tuple)):
        return [value(x) for x in v]
    return float(v) if isinstance(v, float) else v


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF}/{name}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, db, name):
    df = catalog.QUERIES[name](spark, SF)
    sql = db.sql(catalog.ORACLES[name])
    assert sorted(df.columns) == sorted(sql.columns)
    columns = sorted(df.columns)
    got = sorted((repr([value(r[c]) for c in columns]) for r in df.collect()))
    places = [sql.columns.index(c) for c in columns]
    want = sorted((repr([value(r[k]) for k in places]) for r in sql.fetchall()))
    assert got == want


def test_names_and_entry(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() >= 0


def test_result_does_not_depend_on_partitions(spark):
    name = "q_clone_groups"
    one = sorted(map(str, catalog.QUERIES[name](spark, SF).collect()))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        assert sorted(map(str, catalog.QUERIES[name](spark, SF).collect())) == one
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)

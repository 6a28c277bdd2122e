"""Every registered query against its SQL on DuckDB, and the plans' independence of the partition count."""

import math
import os

import duckdb
import pytest

from corpusloom.plans import all_queries

SF = "/root/testdata/sf0.01"
QUERIES, ORACLES = all_queries()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return round(v, 5) if isinstance(v, float) else v


def rows_of(df):
    cols = sorted(df.columns)
    return sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=str)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = rows_of(df)
    found = duck.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    at = [names.index(c) for c in sorted(names)]
    want = sorted((tuple(plain(r[i]) for i in at) for r in found.fetchall()), key=str)
    assert got == want
    assert got, "a query without rows proves nothing"


@pytest.mark.parametrize("name", ["filter_funnel", "decontam_first_hit", "near_copies_by_language", "bm25_topk", "part_assignment", "deficit_interleave", "quota_collect"])
def test_partition_count_does_not_matter(spark, name):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    one = rows_of(QUERIES[name](spark, "/root/testdata/sf0.001"))
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        assert rows_of(QUERIES[name](spark, "/root/testdata/sf0.001")) == one
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
    assert len(e.queries()) >= 90

"""The queries that SQL can express against that SQL, on the smallest tables."""

import os

import duckdb
import pytest

from corpusloom.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    df = queries.QUERIES[name](spark, SF)
    found = con.execute(queries.ORACLES[name])
    at = [d[0] for d in found.description]
    assert sorted(at) == sorted(df.columns)
    assert sorted(tuple(r[c] for c in at) for r in df.collect()) == sorted(found.fetchall())


@pytest.mark.parametrize("name", ["op8_near_duplicates", "op9_repeated_substrings"])
def test_repeated_ids_equal_sql(spark, tmp_path, name):
    """Rows of one id with equal and with unlike texts, nulls and long texts."""
    table = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = [(i // 3, t) for i, t in enumerate(table[:90])] + [(5, table[0]), (5, table[0]), (40, table[7]), (41, None), (41, ""), (42, table[3] + " " + table[9])]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"file://{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    df = queries.QUERIES[name](spark, f"file://{tmp_path}")
    found = con.execute(queries.ORACLES[name])
    at = [d[0] for d in found.description]
    assert sorted(tuple(r[c] for c in at) for r in df.collect()) == sorted(found.fetchall())

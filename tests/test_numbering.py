"""Numbers over one order, whatever ranges adaptive execution cuts it into."""

from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import allocation as A
from corpusloom.operators import chatdata as C
from corpusloom.plans import all_queries


@pytest.fixture
def small_ranges(spark):
    """Ranges that adaptive execution joins where rows are narrow and leaves where they are wide."""
    names = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_places_in_groups(spark, small_ranges):
    rows = spark.range(20000).select(F.col("id").alias("doc_id"), F.concat(F.lit("g"), (F.col("id") % 3).cast("string")).alias("g"), F.sha2(F.col("id").cast("string"), 256).alias("key"))
    got = A.places_in(rows, "g", "key").select("g", "key", "place").collect()
    by = {}
    for r in sorted(got, key=lambda r: r.key):
        by.setdefault(r.g, []).append(r.place)
    assert Counter(map(len, by.values())) == Counter({6667: 2, 6666: 1})
    assert all(places == list(range(1, len(places) + 1)) for places in by.values())


def test_blocks_of_masks_are_whole(spark, small_ranges):
    rows = spark.range(20000).select(F.col("id").alias("conv_id"), F.lit(0).alias("turn"), F.sha2(F.col("id").cast("string"), 256).alias("role"))
    n = A.numbered_parts(rows, ["conv_id", "turn"], 64)
    assert "rangepartitioning" not in n._jdf.queryExecution().toString(), "numbers and sums must come from one sort"
    assert n.where("n <> conv_id").count() == 0
    assert C.mask_problems(n.select(F.col("n").alias("pos"), F.lit(1).alias("mask")), 8).count() == 0


def test_null_keys_come_last(spark):
    rows = spark.createDataFrame([(None, 1), (2, None), (2, 5), (1, 9), (None, None)], "a long, b long")
    assert [(r.a, r.b) for r in A.numbered_parts(rows, ["a", "b"], 64).sort("n").collect()] == [(1, 9), (2, 5), (2, None), (None, 1), (None, None)]


def masks(spark, at, parts):
    """What mask_problems and its SQL find in a table of (SELECT of a part), with turns of equal keys in the order of the table."""
    (at / "conversations.parquet").mkdir()
    for i, part in enumerate(parts):
        duckdb.sql(f"COPY ({part}) TO '{at}/conversations.parquet/part-{i}.parquet' (FORMAT parquet)")
    queries, sql = all_queries()
    got = [tuple(r) for r in queries["mask_problems"](spark, str(at)).select("block", "problem").collect()]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{at}/conversations.parquet/*.parquet', filename = true, file_row_number = true)")
    assert "ORDER BY conv_id, turn)" in sql["mask_problems"]
    want = con.execute(sql["mask_problems"].replace("ORDER BY conv_id, turn)", "ORDER BY conv_id, turn, filename, file_row_number)")).fetchall()
    return sorted(got), sorted(want)


ROLE = "CASE WHEN hash(i) % 31 = 0 THEN 'system' WHEN hash(i) % 7 = 1 THEN 'assistant' ELSE 'user' END"


def test_masks_of_many_ranges(spark, small_ranges, tmp_path):
    got, want = masks(spark, tmp_path, [f"SELECT i // 5 AS conv_id, i % 5 AS turn, {ROLE} AS role, '' AS text FROM range({k}, 60000, 4) r(i)" for k in range(4)])
    assert got == want and len(want) > 1000


def test_masks_with_null_keys(spark, tmp_path):
    got, want = masks(spark, tmp_path, [f"SELECT CASE WHEN i % 97 > 0 THEN i // 5 END AS conv_id, CASE WHEN i % 101 > 0 THEN i % 5 END AS turn, {ROLE} AS role, '' AS text FROM range(3000) r(i)"])
    assert got == want and len(want) > 100


def test_masks_with_equal_keys(spark, tmp_path):
    # the last file is the largest, which Spark reads first
    got, want = masks(spark, tmp_path, [f"SELECT i // 5 AS conv_id, i % 5 AS turn, {ROLE.replace('(i)', f'(i + {k * 7919})')} AS role, repeat(sha256(i::VARCHAR), {1 + 20 * k}) AS text FROM range(3000) r(i)" for k in range(3)])
    assert got == want and len(want) > 100

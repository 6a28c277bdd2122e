from pyspark.sql import functions as F

from corpusloom.plans import all_queries
from corpusloom.streaming import incremental as S


def test_dedup_survives_a_restart(spark, tmp_path):
    rows = [(i, f"text {i % 7}", "s") for i in range(30)]
    df = spark.createDataFrame(rows, "id long, text string, source string")
    at = f"file://{tmp_path}"
    df.where("id < 10").coalesce(1).write.parquet(f"{at}/in/a")
    run = lambda: S.dedup_stream(spark.readStream.schema(df.schema).parquet(f"{at}/in/*"), ["source"], f"{at}/out", f"{at}/cp")
    run()
    df.where("id >= 10").coalesce(1).write.parquet(f"{at}/in/b")
    run()
    run()
    got = spark.read.parquet(f"{at}/out/rows").groupBy("text").agg(F.count("*").alias("n")).collect()
    assert len(got) == 7 and all(r.n == 1 for r in got)


def test_limiter_equals_plain_rule(spark):
    got = {r.event_id: r.accepted for r in all_queries()[0]["stream_rate_limit"](spark, "/root/testdata/sf0.001").collect()}
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("user_id", "event_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("s")).collect()
    taken = {}
    for e in sorted(events, key=lambda r: (r.user_id, r.s, r.event_id)):
        own = taken.setdefault(e.user_id, [])
        ok = sum(t > e.s - 3600 for t in own) < 2 and sum(t // 86400 == e.s // 86400 for t in own) < 8
        if ok:
            own.append(e.s)
        assert got[e.event_id] == ok
    assert not all(got.values())


def test_hot_user_in_falling_order_and_small_batches(spark, tmp_path):
    rows = [(1, i, float(40_000 - 10 * i)) for i in range(4000)] + [(2, 10_000, 5.0)]
    df = spark.createDataFrame(rows, "user_id long, event_id long, s double")
    df.coalesce(1).write.parquet(f"file://{tmp_path}/in")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)
    try:
        S.run_to_end(S.limit_stream(spark.readStream.schema(df.schema).parquet(f"file://{tmp_path}/in"), 2, 8), f"file://{tmp_path}/out", f"file://{tmp_path}/cp")
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = {r.event_id: r.accepted for r in spark.read.parquet(f"file://{tmp_path}/out").collect()}
    own = []
    for _, i, s in sorted(rows[:-1], key=lambda r: (r[2], r[1])):
        ok = sum(t > s - 3600 for t in own) < 2 and sum(t // 86400 == s // 86400 for t in own) < 8
        if ok:
            own.append(s)
        assert got[i] == ok
    assert got[10_000] and len(got) == len(rows)

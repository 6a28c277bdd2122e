"""Queries that run a stream over a table to its end and read what it wrote."""

from __future__ import annotations

import tempfile

from pyspark.sql import functions as F

from ..streaming import incremental as S
from .registry import query, table


def _folder(spark) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = f"file://{tempfile.mkdtemp(prefix='corpusloom-')}"
    return f"{base.rstrip('/')}/stream-{spark.range(1).select(F.expr('uuid()')).first()[0]}"


def _stream(spark, sf, name):
    schema = table(spark, sf, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf}/{name}.parquet*")


def _finished(spark, stream, schema):
    at = _folder(spark)
    S.run_to_end(stream, f"{at}/out", f"{at}/checkpoint")
    return spark.read.schema(schema).parquet(f"{at}/out")


@query("SELECT source, sha256(text) AS content, 1::BIGINT AS n FROM documents GROUP BY ALL")
def stream_dedup(spark, sf):
    at = _folder(spark)
    S.dedup_stream(_stream(spark, sf, "documents").select("source", "text"), ["source"], f"{at}/out", f"{at}/checkpoint")
    return spark.read.parquet(f"{at}/out/rows").groupBy("source", F.sha2("text", 256).alias("content")).agg(F.count("*").alias("n"))


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, floor(epoch(ts)) AS s, row_number() OVER (PARTITION BY user_id ORDER BY floor(epoch(ts)), event_id) AS i FROM events),
r(user_id, event_id, i, recent, day, used, accepted) AS (
  SELECT user_id, NULL::BIGINT, 0::BIGINT, []::DOUBLE[], -1::BIGINT, 0::BIGINT, NULL::BOOLEAN FROM (SELECT DISTINCT user_id FROM events)
  UNION ALL
  SELECT user_id, event_id, i, CASE WHEN ok THEN list_append(recent, s) ELSE recent END, day, used + ok::INT, ok FROM (
    SELECT *, len(recent) < 2 AND used < 8 AS ok FROM (
      SELECT r.user_id, e.event_id, e.i, e.s, list_filter(r.recent, lambda x: x > e.s - 3600) AS recent, floor(e.s / 86400)::BIGINT AS day, CASE WHEN floor(e.s / 86400)::BIGINT = r.day THEN r.used ELSE 0 END AS used
      FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1)))
SELECT user_id, event_id, accepted FROM r WHERE i > 0""")
def stream_rate_limit(spark, sf):
    events = _stream(spark, sf, "events").select("user_id", "event_id", F.unix_seconds(F.col("ts").cast("timestamp")).cast("double").alias("s"))
    stream = S.limit_stream(events, 2, 8)
    return _finished(spark, stream, stream.schema)


@query("SELECT event_type, epoch(time_bucket(INTERVAL 1 HOUR, ts))::BIGINT AS hour, count(*) AS n FROM events GROUP BY 1, 2")
def hourly_counts(spark, sf):
    e = table(spark, sf, "events")
    return e.groupBy("event_type", F.unix_seconds(F.window("ts", "1 hour")["start"].cast("timestamp")).alias("hour")).agg(F.count("*").alias("n"))

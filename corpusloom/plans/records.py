"""Queries on build and card records."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .registry import query, table


@query("SELECT lang, substr(sha256(text || chr(0) || lang), 1, 24) AS key, doc_id FROM documents WHERE trim(text) <> ''")
def content_keys(spark, sf):
    d = table(spark, sf, "documents").where(F.trim("text") != "")
    return d.select("lang", F.substring(F.sha2(F.concat("text", F.char(F.lit(0)), "lang"), 256), 1, 24).alias("key"), "doc_id")


@query("SELECT conv_id, sum(CASE WHEN cum - length(text) < 2000 THEN least(length(text), 2000 - (cum - length(text))) ELSE 0 END)::BIGINT AS chars FROM (SELECT conv_id, text, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS cum FROM conversations) GROUP BY conv_id")
def character_cut(spark, sf):
    c = table(spark, sf, "conversations").withColumn("n", F.length("text"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("turn")) - F.col("n")
    c = c.withColumn("take", F.greatest(F.lit(0), F.least(F.col("n"), 2000 - before)))
    return c.groupBy("conv_id").agg(F.sum("take").cast("long").alias("chars"))


@query("SELECT lang, coalesce(max(CASE WHEN quality = 1 THEN n END)::VARCHAR, 'not measured') AS good, coalesce(max(CASE WHEN quality = 0 THEN n END)::VARCHAR, 'not measured') AS bad, coalesce(max(CASE WHEN quality = 7 THEN n END)::VARCHAR, 'not measured') AS other FROM (SELECT lang, quality, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1, 2) GROUP BY lang")
def card_table(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left").groupBy("lang").pivot("quality", [1, 0, 7]).agg(F.count("doc_id"))
    return d.select("lang", *[F.coalesce(F.col(q).cast("string"), F.lit("not measured")).alias(n) for q, n in (("1", "good"), ("0", "bad"), ("7", "other"))])


@query("SELECT user_id, count(*) AS ticks, max(event_id) AS last, bool_or(event_id >= 9900) AS active FROM events GROUP BY user_id")
def active_users(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("ticks"), F.max("event_id").alias("last"), F.bool_or(F.col("event_id") >= 9900).alias("active"))


@query("SELECT user_id, round((max(event_id) - min(event_id)) * 512.0 / (epoch(max(ts)) - epoch(min(ts))), 6)::DOUBLE AS rate FROM events WHERE event_id > 1000 GROUP BY user_id HAVING count(*) >= 2 AND max(ts) > min(ts)")
def steady_rate(spark, sf):
    e = table(spark, sf, "events").where("event_id > 1000").withColumn("s", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    rows = e.groupBy("user_id").agg(F.count("*").alias("n"), F.min("event_id").alias("a"), F.max("event_id").alias("b"), F.min("s").alias("s0"), F.max("s").alias("s1"))
    return rows.where("n >= 2 AND s1 > s0").select("user_id", F.round((F.col("b") - F.col("a")) * 512.0 / (F.col("s1") - F.col("s0")), 6).alias("rate"))


@query("SELECT doc_id, text_order, nxt FROM (SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS text_order, lead(doc_id) OVER (PARTITION BY source ORDER BY doc_id) AS nxt FROM documents) WHERE text_order % 10 <> 0")
def shifted_targets(spark, sf):
    w = Window.partitionBy("source").orderBy("doc_id")
    d = table(spark, sf, "documents").select("doc_id", F.row_number().over(w).cast("long").alias("text_order"), F.lead("doc_id").over(w).alias("nxt"))
    return d.where("text_order % 10 <> 0")


@query("SELECT lang, pos, documents FROM (SELECT lang, CASE lang WHEN 'en' THEN 0 WHEN 'de' THEN 1 WHEN 'fr' THEN 2 ELSE 98 END AS pos, count(*) AS documents FROM documents GROUP BY lang)")
def split_order(spark, sf):
    order = spark.createDataFrame([("en", 0), ("de", 1), ("fr", 2)], "lang string, pos int")
    d = table(spark, sf, "documents").groupBy("lang").agg(F.count("*").alias("documents"))
    return d.join(F.broadcast(order), "lang", "left").select("lang", F.coalesce("pos", F.lit(98)).alias("pos"), "documents")


@query("SELECT c AS condition, o AS ordering FROM (VALUES ('off'), ('bm25'), ('dense')) a(c), (VALUES ('document'), ('reverse')) b(o) WHERE c <> 'off' OR o = 'document'")
def condition_labels(spark, sf):
    rows = [(c, o) for c in ("off", "bm25", "dense") for o in ("document", "reverse") if c != "off" or o == "document"]
    return spark.createDataFrame(rows, "condition string, ordering string")

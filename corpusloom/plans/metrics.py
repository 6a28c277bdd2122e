"""Queries that report on documents, labels, events and runs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import allocation as A
from ..operators import metrics as M
from .registry import query, table


@query("SELECT event_type, sum(n)::BIGINT AS events, string_agg(user_key || '=' || n, ',' ORDER BY user_key) AS nested FROM (SELECT event_type, 'u' || user_id % 5 AS user_key, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1")
def outcome_counters(spark, sf):
    e = table(spark, sf, "events").groupBy("event_type", F.concat(F.lit("u"), (F.col("user_id") % 5).cast("string")).alias("k")).agg(F.count("*").alias("n"))
    rows = e.groupBy("event_type").agg(F.sum("n").cast("long").alias("events"), F.array_sort(F.collect_list(F.struct("k", "n"))).alias("r"))
    return rows.select("event_type", "events", F.array_join(F.transform("r", lambda x: F.concat(x["k"], F.lit("="), x["n"].cast("string"))), ",").alias("nested"))


@query("SELECT user_id, n, distinct_users FROM (SELECT user_id, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, user_id) AS rn, (SELECT count(DISTINCT user_id) FROM events) AS distinct_users FROM events GROUP BY user_id) WHERE rn <= 50")
def attribution_top(spark, sf):
    counts = table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    every = counts.agg(F.count("*").alias("distinct_users"))
    return counts.orderBy(F.desc("n"), "user_id").limit(50).join(F.broadcast(every))


@query("SELECT lang, source, chars, round(chars / sum(chars) OVER (PARTITION BY lang), 6) AS share FROM (SELECT lang, source, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY 1, 2)")
def source_shares(spark, sf):
    d = table(spark, sf, "documents").groupBy("lang", "source").agg(F.sum("n_chars").cast("long").alias("chars"))
    return d.withColumn("share", M.share_of(F.col("chars"), ["lang"]))


@query("WITH w(lang, weight) AS (VALUES ('en', 0.55::DOUBLE), ('fr', 0.2::DOUBLE), ('de', 0.2::DOUBLE), ('es', 0.04::DOUBLE), ('it', 0.01::DOUBLE)), g AS (SELECT lang, round(sum(n_chars) / (SELECT sum(n_chars) FROM documents), 6) AS got FROM documents GROUP BY 1) SELECT w.lang, weight, coalesce(got, 0) AS got FROM w LEFT JOIN g USING (lang) WHERE weight >= 0.05 AND abs(coalesce(got, 0) - weight) > 0.02")
def share_violations(spark, sf):
    weights = spark.createDataFrame([("en", 0.55), ("fr", 0.2), ("de", 0.2), ("es", 0.04), ("it", 0.01)], "lang string, weight double")
    d = table(spark, sf, "documents").groupBy("lang").agg(F.sum("n_chars").alias("c"))
    got = d.select("lang", F.round(F.col("c") / F.sum("c").over(Window.partitionBy()), 6).alias("got"))
    rows = weights.join(got, "lang", "left").withColumn("got", F.coalesce("got", F.lit(0.0)))
    return rows.where((F.col("weight") >= 0.05) & (F.abs(F.col("got") - F.col("weight")) > 0.02))


@query("SELECT source, documents, wrong, round(wrong / documents::DOUBLE, 6) AS rate, wrong > 0.4 * documents AS warn FROM (SELECT source, count(*) AS documents, count_if(lang <> 'en') AS wrong FROM documents GROUP BY source)")
def language_drop_rate(spark, sf):
    d = table(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("documents"), F.count_if(F.col("lang") != "en").alias("wrong"))
    return d.select("source", "documents", "wrong", F.round(F.col("wrong") / F.col("documents"), 6).alias("rate"), (F.col("wrong") > 0.4 * F.col("documents")).alias("warn"))


@query("SELECT CASE WHEN text IS NULL OR length(trim(text)) = 0 THEN 'blank' WHEN n > 4000 THEN 'too_long' WHEN dup > 1 THEN 'duplicate' WHEN lang <> 'en' AND prob THEN 'language' WHEN lang <> 'en' THEN 'unsure' ELSE 'kept' END AS status, source, count(*) AS documents, sum(n)::BIGINT AS tokens FROM (SELECT *, len(regexp_extract_all(text, '{TOKEN}')) + 1 AS n, row_number() OVER (PARTITION BY source, sha256(text) ORDER BY doc_id) AS dup, doc_id % 3 > 0 AS prob FROM documents) GROUP BY 1, 2")
def filter_funnel(spark, sf):
    return funnel(table(spark, sf, "documents")).groupBy("status", "source").agg(F.count("*").alias("documents"), F.sum("n").cast("long").alias("tokens"))


def funnel(docs):
    """docs with n (tokens with the end) and status: the first rule that drops a document, or kept."""
    d = docs.withColumn("n", F.size(T.tokens(F.col("text"))) + 1)
    nth = F.row_number().over(Window.partitionBy("source", F.sha2("text", 256)).orderBy("doc_id"))
    wrong = F.col("lang") != "en"
    status = F.when(T.is_blank(F.col("text")), "blank").when(F.col("n") > 4000, "too_long").when(F.col("nth") > 1, "duplicate").when(wrong & (F.col("doc_id") % 3 > 0), "language").when(wrong, "unsure").otherwise("kept")
    return d.withColumn("nth", nth).withColumn("status", status)


@query("SELECT coalesce(lang, 'all') AS lang, coalesce(source, 'all') AS source, count(*) AS labelled, sum(quality)::BIGINT AS good, round(100.0 * sum(quality) / count(*), 1)::DOUBLE AS pct FROM documents JOIN labels USING (doc_id) GROUP BY GROUPING SETS ((lang), (source), ())")
def quality_tallies(spark, sf):
    table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").createOrReplaceTempView("_labelled")
    return spark.sql("SELECT coalesce(lang, 'all') AS lang, coalesce(source, 'all') AS source, count(*) AS labelled, sum(quality) AS good, round(100.0D * sum(quality) / count(*), 1) AS pct FROM _labelled GROUP BY GROUPING SETS ((lang), (source), ())")


@query("SELECT conv_id, count(*) AS turns, coalesce(min(CASE WHEN length(text) > 1500 THEN nth END) - 1, count(*)) AS leading FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS nth FROM conversations) GROUP BY conv_id")
def chain_prefix(spark, sf):
    return M.leading_ok(table(spark, sf, "conversations"), "conv_id", "turn", F.length("text") <= 1500)


@query("SELECT event_type, coalesce(depth, -1) AS depth, count(*) AS trials, round(avg(hit::INT), 6) AS hit_rate, round(sum((hit AND pass)::INT) / nullif(sum(hit::INT), 0)::DOUBLE, 6) AS copy_given_hit, count_if(pass AND NOT hit) AS without_hit, round(median(value), 6) AS median_value FROM (SELECT event_type, user_id % 4 AS depth, event_id % 3 = 0 AS hit, value > 50 AS pass, value FROM events) GROUP BY GROUPING SETS ((event_type), (event_type, depth))")
def needle_metrics(spark, sf):
    e = table(spark, sf, "events").select("event_type", (F.col("user_id") % 4).alias("depth"), (F.col("event_id") % 3 == 0).alias("hit"), (F.col("value") > 50).alias("pass"), "value")
    e.createOrReplaceTempView("_trials")
    return spark.sql("""SELECT event_type, coalesce(depth, -1) AS depth, count(*) AS trials, round(avg(cast(hit AS int)), 6) AS hit_rate,
        round(count_if(hit AND pass) / nullif(count_if(hit), 0), 6) AS copy_given_hit, count_if(pass AND NOT hit) AS without_hit, round(percentile(value, 0.5), 6) AS median_value
        FROM _trials GROUP BY GROUPING SETS ((event_type), (event_type, depth))""")


@query("SELECT k, count(*) AS problems, round(100 * avg(CASE WHEN c = 0 THEN 0 WHEN n - c < k THEN 1 ELSE 1 - list_product([1 - k / i::DOUBLE for i in range(n - c + 1, n + 1)]) END), 6) AS score FROM (SELECT user_id, count(*) AS n, count_if(value > 60)::BIGINT AS c FROM events GROUP BY 1), (SELECT unnest([1, 5, 10]) AS k) GROUP BY k")
def pass_at_k(spark, sf):
    e = table(spark, sf, "events").groupBy("user_id").agg(F.count("*").cast("int").alias("n"), F.count_if(F.col("value") > 60).cast("int").alias("c"))
    out = None
    for k in (1, 5, 10):
        one = e.agg(F.lit(k).alias("k"), F.count("*").alias("problems"), F.round(100 * F.avg(M.pass_at_k(F.col("n"), F.col("c"), k)), 6).alias("score"))
        out = one if out is None else out.unionAll(one)
    return out


@query("SELECT lang, round(sum(n_chars * 0.7) / (sum(octet_length(encode(text))) * ln(2)), 6) AS bpb, round(sum(n_chars) / sum(len(regexp_extract_all(text, '{TOKEN}')))::DOUBLE, 6) AS chars_per_token, round(avg(octet_length(encode(text))), 6) AS mean_bytes FROM documents GROUP BY lang")
def bits_per_byte(spark, sf):
    d = table(spark, sf, "documents").select("lang", "n_chars", F.octet_length("text").alias("b"), F.size(T.tokens(F.col("text"))).alias("t"))
    return d.groupBy("lang").agg(F.round(M.bits_per_byte(F.col("n_chars") * 0.7, F.col("b")), 6).alias("bpb"), F.round(F.sum("n_chars") / F.sum("t"), 6).alias("chars_per_token"), F.round(F.avg("b"), 6).alias("mean_bytes"))


@query("PIVOT (SELECT (event_id // 1000)::BIGINT AS checkpoint, event_type, value FROM events) ON event_type IN ('click', 'view', 'purchase') USING round(avg(value), 6) GROUP BY checkpoint")
def pivot_metrics(spark, sf):
    e = table(spark, sf, "events").withColumn("checkpoint", F.floor(F.col("event_id") / 1000))
    return e.groupBy("checkpoint").pivot("event_type", ["click", "view", "purchase"]).agg(F.round(F.avg("value"), 6))


@query("WITH w(event_type, weight) AS (VALUES ('click', 0.5::DOUBLE), ('view', 0.3::DOUBLE), ('purchase', 0.1::DOUBLE), ('absent', 0.1::DOUBLE)), l AS (SELECT (event_id // 2000)::BIGINT AS step, event_type, avg(value) AS loss FROM events GROUP BY 1, 2) SELECT step, round(sum(weight * loss) / sum(weight), 6) AS loss, count(*) AS splits FROM l JOIN w USING (event_type) GROUP BY step")
def weighted_loss(spark, sf):
    w = spark.createDataFrame([("click", 0.5), ("view", 0.3), ("purchase", 0.1), ("absent", 0.1)], "event_type string, weight double")
    e = table(spark, sf, "events").groupBy(F.floor(F.col("event_id") / 2000).alias("step"), "event_type").agg(F.avg("value").alias("loss"))
    return e.join(F.broadcast(w), "event_type").groupBy("step").agg(F.round(F.sum(F.col("weight") * F.col("loss")) / F.sum("weight"), 6).alias("loss"), F.count("*").alias("splits"))


@query("SELECT user_id, count(*) AS steps, max(event_id) AS last_step, round(arg_max(value, event_id), 6) AS last_loss, round(arg_min(event_id, {'v': value, 'i': event_id})::DOUBLE, 6) AS best_step FROM events GROUP BY user_id")
def run_results(spark, sf):
    e = table(spark, sf, "events")
    return e.groupBy("user_id").agg(F.count("*").alias("steps"), F.max("event_id").alias("last_step"), F.round(F.max_by("value", "event_id"), 6).alias("last_loss"), F.round(F.min_by("event_id", F.struct("value", "event_id")).cast("double"), 6).alias("best_step"))


@query("SELECT user_id, n, round(n / avg(n) OVER (), 6) AS ratio, CASE WHEN round(n / avg(n) OVER (), 6) < 0.1 THEN 'dead' WHEN round(n / avg(n) OVER (), 6) > 3 THEN 'overloaded' ELSE 'ok' END AS flag FROM (SELECT user_id, count(*) AS n FROM events GROUP BY 1)")
def usage_flags(spark, sf):
    return M.usage_flags(table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("n")), "n")


@query("SELECT bucket, round(avg(value), 4) AS loss, count(*) AS n FROM (SELECT value, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) // 16 AS bucket FROM events) GROUP BY bucket")
def loss_by_position(spark, sf):
    pos = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return table(spark, sf, "events").select(F.floor(pos / 16).alias("bucket"), "value").groupBy("bucket").agg(F.round(F.avg("value"), 4).alias("loss"), F.count("*").alias("n"))


_SESSIONS = "SELECT user_id, ts::DATE AS day, epoch(min(ts))::DOUBLE AS start_s, epoch(max(ts))::DOUBLE AS last_s, 0.5 + user_id % 4 AS rate, (count(*) % 2 = 0) AS ended FROM events GROUP BY 1, 2"


def _sessions(spark, sf):
    e = table(spark, sf, "events").withColumn("s", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    return e.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.min("s").alias("start_s"), F.max("s").alias("last_s"), (F.count("*") % 2 == 0).alias("ended")).withColumn("rate", 0.5 + F.col("user_id") % 4)


@query(f"SELECT user_id, round(sum((CASE WHEN is_last AND NOT ended THEN 1706745600.0 ELSE last_s END - start_s) / 3600 * rate), 4) AS spent FROM (SELECT *, day = max(day) OVER (PARTITION BY user_id) AS is_last FROM ({_SESSIONS})) GROUP BY user_id")
def spend_intervals(spark, sf):
    s = _sessions(spark, sf).withColumn("is_last", F.col("day") == F.max("day").over(Window.partitionBy("user_id")))
    return s.groupBy("user_id").agg(F.round(M.spent(s, F.lit(1706745600.0)), 4).alias("spent"))


@query(f"SELECT user_id, count_if(start_s < prev) AS overlaps, round(sum(greatest(0, start_s - prev)) / 3600, 4) AS gap_hours FROM (SELECT *, lag(last_s + 60000) OVER (PARTITION BY user_id ORDER BY day) AS prev FROM ({_SESSIONS})) GROUP BY user_id")
def session_gaps(spark, sf):
    s = _sessions(spark, sf).withColumn("prev", F.lag(F.col("last_s") + 60000).over(Window.partitionBy("user_id").orderBy("day")))
    gap = F.when(F.col("prev").isNotNull(), F.greatest(F.lit(0.0), F.col("start_s") - F.col("prev"))).otherwise(0.0)
    return s.groupBy("user_id").agg(F.count_if(F.col("start_s") < F.col("prev")).alias("overlaps"), F.round(F.sum(gap) / 3600, 4).alias("gap_hours"))


@query("WITH r(reason) AS (VALUES ('merge'), ('blank'), ('too_long'), ('en'), ('fr'), ('xx')) SELECT reason, count(lang) AS dropped FROM r LEFT JOIN documents ON lang = reason GROUP BY reason")
def zero_filled_reasons(spark, sf):
    reasons = spark.createDataFrame([(r,) for r in ("merge", "blank", "too_long", "en", "fr", "xx")], "reason string")
    d = table(spark, sf, "documents").groupBy(F.col("lang").alias("reason")).agg(F.count("*").alias("dropped"))
    return reasons.join(d, "reason", "left").select("reason", F.coalesce("dropped", F.lit(0)).cast("long").alias("dropped"))


_EMA = "WITH RECURSIVE s AS (SELECT user_id, value AS x, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events), r(user_id, i, ema, n) AS (SELECT user_id, i, x, 0 FROM s WHERE i = 1 UNION ALL SELECT r.user_id, s.i, 0.98 * r.ema + (1 - 0.98::DOUBLE) * s.x, r.n + CASE WHEN s.x > 1.5 * r.ema THEN 1 ELSE 0 END FROM r JOIN s ON s.user_id = r.user_id AND s.i = r.i + 1) SELECT user_id, max(i)::INT AS steps, max(n)::INT AS spikes FROM r GROUP BY user_id"


@query(_EMA)
def spike_count(spark, sf):
    return M.spikes(table(spark, sf, "events"), "user_id", "event_id", "value")


@query("SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS baseline FROM events")
def trailing_baseline(spark, sf):
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(-4, 0)
    return table(spark, sf, "events").select("event_id", F.round(F.avg("value").over(w), 6).alias("baseline"))


@query("SELECT event_id, offered, offered > 3 AS over FROM (SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY floor(epoch(ts))::BIGINT RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS offered FROM events)")
def trailing_hour(spark, sf):
    return M.accepted_in_hour(table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")), "user_id", "ts", 3).select("event_id", "offered", "over")


@query("SELECT user_id, w AS window_no, count(*) AS offers, round(sum(value), 4) AS gain FROM (SELECT user_id, value, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 10 AS w FROM events) GROUP BY 1, 2")
def count_windows(spark, sf):
    no = F.floor((F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1) / 10)
    return table(spark, sf, "events").withColumn("window_no", no).groupBy("user_id", "window_no").agg(F.count("*").alias("offers"), F.round(F.sum("value"), 4).alias("gain"))


@query("SELECT doc_id, sum(n_chars) OVER (PARTITION BY lang ORDER BY doc_id)::BIGINT AS end_pos FROM documents")
def bucket_ends(spark, sf):
    return A.running_total(table(spark, sf, "documents").select("doc_id", "lang", "n_chars"), "lang", "doc_id", "n_chars", "end_pos").select("doc_id", "end_pos")


@query("SELECT event_id, (props::JSON->>'$.k')::BIGINT AS k, event_type || ':' || coalesce(props::JSON->>'$.k', '-') AS tag FROM events")
def json_fields(spark, sf):
    k = F.get_json_object("props", "$.k")
    return table(spark, sf, "events").select("event_id", k.cast("long").alias("k"), F.concat("event_type", F.lit(":"), F.coalesce(k, F.lit("-"))).alias("tag"))


@query("SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2")
def pricing_summary(spark, sf):
    rows = table(spark, sf, "lineitem").where("l_shipdate <= timestamp'1998-09-02'")
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))


@query("SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def revenue_by_nation(spark, sf):
    line = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    line = line.join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return line.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))

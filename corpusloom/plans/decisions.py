"""Queries on language decisions, runs, budgets and prompts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import allocation as A
from ..operators import records as R
from .registry import query, table

_LID = "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'zho' ELSE lang END AS source, CASE doc_id % 4 WHEN 0 THEN 'zho_Hant' WHEN 1 THEN 'xx' ELSE lang END AS label, (doc_id % 100) / 100.0::DOUBLE AS prob FROM documents"


@query(f"SELECT status, label, count(*) AS documents FROM (SELECT CASE WHEN ok THEN 'kept' WHEN prob >= 0.7 THEN 'dropped' ELSE 'unsure' END AS status, CASE WHEN ok THEN label WHEN prob >= 0.7 THEN NULL WHEN source = 'zho' THEN CASE WHEN prob > 0.3 THEN 'zho_Hant' ELSE 'zho_Hans' END ELSE source END AS label FROM (SELECT *, label = source OR (source = 'zho' AND label IN ('zho_Hans', 'zho_Hant')) AS ok FROM ({_LID}))) GROUP BY 1, 2")
def lid_decisions(spark, sf):
    i = F.col("doc_id")
    d = table(spark, sf, "documents").select("doc_id", F.when(i % 5 == 0, "zho").otherwise(F.col("lang")).alias("source"), F.when(i % 4 == 0, "zho_Hant").when(i % 4 == 1, "xx").otherwise(F.col("lang")).alias("label"), ((i % 100) / 100.0).alias("prob"))
    probs = F.create_map(F.lit("zho_Hans"), F.lit(0.3), F.lit("zho_Hant"), F.col("prob"))
    got = d.select(R.lid_decision(F.col("source"), F.col("label"), F.col("prob"), probs).alias("r"))
    return got.groupBy("r.status", "r.label").agg(F.count("*").alias("documents"))


@query("SELECT label, why, count(*) AS documents FROM (SELECT CASE WHEN lang = 'en' THEN 'eng_Latn' WHEN lang = 'de' THEN 'deu_Latn' END AS label, CASE WHEN lang IN ('en', 'de') THEN NULL WHEN lang = 'fr' THEN 'script' ELSE 'language' END AS why FROM documents) GROUP BY 1, 2")
def language_mapping(spark, sf):
    rules = {"en": "eng_Latn", "de": {"Latn": "deu_Latn"}, "fr": {"Arab": "fra_Arab"}}
    got = table(spark, sf, "documents").select(R.map_language(F.col("lang"), T.dominant_script(F.col("text")), rules).alias("r"))
    return got.groupBy("r.label", "r.why").agg(F.count("*").alias("documents"))


@query("SELECT o_orderkey, (CASE WHEN o_orderkey % 2 = 0 THEN date_trunc('month', o_orderdate)::DATE ELSE o_orderdate::DATE END) > DATE '1996-06-01' AS late FROM orders")
def date_cutoff(spark, sf):
    day = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyy-MM")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return table(spark, sf, "orders").select("o_orderkey", (R.date_key(day) > F.to_date(F.lit("1996-06-01"))).alias("late"))


@query("SELECT source, count(*) AS documents, round(sum(n) / 12.5, 4) AS tokens_per_second, round(sum(n) / 12.5 / 15, 4) AS per_core, round(count(*) / 12.5, 4) AS documents_per_second FROM (SELECT source, len(regexp_extract_all(text, '{TOKEN}')) + 1 AS n FROM documents) GROUP BY source")
def throughput(spark, sf):
    d = table(spark, sf, "documents").select("source", (F.size(T.tokens(F.col("text"))) + 1).alias("n"))
    s = F.sum("n") / 12.5
    return d.groupBy("source").agg(F.count("*").alias("documents"), F.round(s, 4).alias("tokens_per_second"), F.round(s / 15, 4).alias("per_core"), F.round(F.count("*") / 12.5, 4).alias("documents_per_second"))


@query("WITH e AS (SELECT event_type, user_id, value, row_number() OVER (PARTITION BY event_type, user_id ORDER BY event_id) % 2 = 1 AS f FROM events), r AS (SELECT event_type, user_id, avg(value) FILTER (f) AS l, avg(value) FILTER (NOT f) AS again FROM e GROUP BY 1, 2), b AS (SELECT event_type, arg_min({'u': user_id, 'l': l, 'a': again}, {'l': l, 'u': user_id}) AS b FROM r WHERE l IS NOT NULL GROUP BY 1) SELECT event_type, b.u AS best, round(b.l, 6) AS loss, round(abs(b.l - b.a), 6) AS noise, CASE WHEN abs(b.l - b.a) <= 5 THEN 'adopt' ELSE 'unclear' END AS decision FROM b")
def sweep_decision(spark, sf):
    """Each user is a run of every type: its 1st, 3rd, 5th ... events are the run, the others its repetition with another seed."""
    nth = F.row_number().over(Window.partitionBy("event_type", "user_id").orderBy("event_id"))
    e = table(spark, sf, "events").select("event_type", "user_id", "value", (nth % 2 == 1).alias("first"))
    r = e.groupBy("event_type", "user_id").agg(F.avg(F.when(F.col("first"), F.col("value"))).alias("l"), F.avg(F.when(~F.col("first"), F.col("value"))).alias("again"))
    best = r.where("l IS NOT NULL").groupBy("event_type").agg(F.min(F.struct("l", "user_id", "again")).alias("b"))
    noise = F.abs(F.col("b.l") - F.col("b.again"))
    return best.select("event_type", F.col("b.user_id").alias("best"), F.round("b.l", 6).alias("loss"), F.round(noise, 6).alias("noise"), F.when(noise <= 5, "adopt").otherwise("unclear").alias("decision"))


@query("SELECT lang, offered, round(offered * 250000.0 / sum(offered) OVER (), 4)::DOUBLE AS projected, offered * 250000.0 / sum(offered) OVER () < 20000 AS short FROM (SELECT lang, sum(n_chars)::BIGINT AS offered FROM documents GROUP BY lang)")
def projected_available(spark, sf):
    return _projected(table(spark, sf, "documents"))


def _projected(docs):
    d = docs.groupBy("lang").agg(F.sum("n_chars").cast("long").alias("offered"))
    p = F.col("offered") * 250000.0 / F.sum("offered").over(Window.partitionBy())
    return d.select("lang", "offered", F.round(p, 4).alias("projected"), (p < 20000).alias("short"))


@query("WITH RECURSIVE l AS (SELECT lang, row_number() OVER (ORDER BY lang) AS i, count(*) OVER () AS k, sum(n_chars)::DOUBLE AS has FROM documents GROUP BY lang), r(i, lang, take, spare) AS (SELECT 0::BIGINT, ''::VARCHAR, 0::DOUBLE, 1000000::DOUBLE UNION ALL SELECT l.i, l.lang, least(l.has, r.spare / (l.k - l.i + 1)), r.spare - least(l.has, r.spare / (l.k - l.i + 1)) FROM r JOIN l ON l.i = r.i + 1) SELECT lang, round(take, 4) AS take FROM r WHERE i > 0")
def carry_over_split(spark, sf):
    d = table(spark, sf, "documents").groupBy("lang").agg(F.sum("n_chars").cast("double").alias("has"))
    numbered = d.withColumn("i", F.row_number().over(Window.orderBy("lang")).cast("bigint")).withColumn("k", F.count("*").over(Window.partitionBy()))
    return spark.sql("""WITH RECURSIVE r(i, lang, take, spare) AS (
        SELECT 0L, '', 0D, 1000000D UNION ALL
        SELECT l.i, l.lang, least(l.has, r.spare / (l.k - l.i + 1)), r.spare - least(l.has, r.spare / (l.k - l.i + 1)) FROM r JOIN {langs} l ON l.i = r.i + 1)
        SELECT lang, round(take, 4) AS take FROM r WHERE i > 0""", langs=numbered)


@query("SELECT doc_id, depth, p AS at, p // 256 AS chunk, n + 3 AS total FROM (SELECT doc_id, depth, floor(n * depth / 100.0)::INT AS p, n FROM (SELECT doc_id, len(regexp_extract_all(text, '{TOKEN}')) AS n FROM documents), (SELECT unnest([0, 25, 50, 100]) AS depth))")
def needle_planting(spark, sf):
    return _planted(table(spark, sf, "documents"))


def _planted(docs):
    d = docs.select("doc_id", T.tokens(F.col("text")).alias("toks"), F.explode(F.array(*map(F.lit, (0, 25, 50, 100)))).alias("depth"))
    d = d.withColumn("all", R.planted(F.col("toks"), F.array(F.lit("\x00a"), F.lit("\x00b"), F.lit("\x00c")), F.col("depth")))
    at = (F.array_position("all", "\x00a") - 1).cast("int")
    return d.select("doc_id", "depth", at.alias("at"), F.floor(at / 256).cast("int").alias("chunk"), F.size("all").cast("long").alias("total"))


@query("SELECT coalesce(a.source, b.source) AS source, a.n AS measured, b.n AS listed FROM (SELECT source, count(*) AS n FROM documents GROUP BY 1) a FULL JOIN (SELECT 'src' || r AS source, CASE WHEN r % 3 = 0 THEN 50 ELSE 49 END::BIGINT AS n FROM range(0, 22) t(r)) b USING (source) WHERE a.n IS DISTINCT FROM b.n")
def revision_mismatches(spark, sf):
    listed = spark.range(22).select(F.concat(F.lit("src"), F.col("id").cast("string")).alias("source"), F.when(F.col("id") % 3 == 0, 50).otherwise(49).cast("long").alias("listed"))
    d = table(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("measured"))
    return d.join(listed, "source", "full").where(~F.col("measured").eqNullSafe(F.col("listed")))


@query("SELECT conv_id, turn, right(text, CASE WHEN total <= 900 THEN length(text) ELSE floor(length(text) * 900 / total::DOUBLE)::INT END) AS kept FROM (SELECT conv_id, turn, text, sum(length(text)) OVER (PARTITION BY conv_id) AS total FROM conversations)")
def trimmed_feedback(spark, sf):
    return R.trimmed_shares(table(spark, sf, "conversations"), "conv_id", "text", 900).select("conv_id", "turn", "kept")


@query("SELECT doc_id, n_files, first_path, content_chars FROM (SELECT doc_id, 2 AS n_files, 'a' || doc_id || '.py' AS first_path, (length(text) + 1 + 4)::BIGINT AS content_chars FROM documents)")
def file_blocks(spark, sf):
    quoted = F.replace("text", F.lit("=== "), F.lit("==_ "))  # markers in a text are no markers of the reply
    reply = F.concat(F.lit("Here:\n=== FILE: a"), F.col("doc_id").cast("string"), F.lit(".py ===\n"), quoted, F.lit("\n=== END FILE ===\n=== FILE: b.py ===\nx=1\n=== END FILE ===\n"))
    d = table(spark, sf, "documents").select("doc_id", R.blocks_of(reply).alias("b"))
    return d.select("doc_id", F.size("b").alias("n_files"), F.get("b", F.lit(0))["path"].alias("first_path"), F.aggregate("b", F.lit(0).cast("long"), lambda a, x: a + F.length(x["content"])).alias("content_chars"))


@query("WITH p AS (SELECT doc_id, text || chr(10) || chr(10) || 'CONTEXT FILES:' || chr(10) || 'x' || chr(10) || chr(10) || 'PROJECT TREE:' || chr(10) || lang AS p FROM documents) SELECT doc_id, trim(split_part(p, chr(10) || chr(10) || 'CONTEXT FILES:', 1)) AS step, trim(substr('STEP: ' || p, instr('STEP: ' || p, 'PROJECT TREE:' || chr(10)) + 14)) AS tree FROM p")
def prompt_sections(spark, sf):
    return _sections(table(spark, sf, "documents"), F.col("text"))


def _sections(docs, step):
    prompt = F.concat(F.lit("STEP: "), step, F.lit("\n\nCONTEXT FILES:\nx\n\nPROJECT TREE:\n"), F.col("lang"))
    return docs.select("doc_id", R.section(prompt, "STEP: ", "\n\nCONTEXT FILES:").alias("step"), R.section(prompt, "PROJECT TREE:\n", None).alias("tree"))


@query("SELECT doc_id, len(t[greatest(1, len(t) - 63):]) AS tail, ends_with(text, chr(10)) AS breaks FROM (SELECT doc_id, text, regexp_extract_all(text, '{TOKEN}') AS t FROM documents)")
def tail_windows(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", T.tokens(F.col("text")).alias("t"), "text")
    return d.select("doc_id", F.size(F.slice("t", F.greatest(F.lit(1), F.size("t") - 63), F.lit(64))).cast("long").alias("tail"), F.endswith("text", F.lit("\n")).alias("breaks"))


@query("SELECT CASE WHEN bytes IS NULL OR bytes = 0 THEN 'blank' WHEN source IN ('src3', 'src4') THEN 'licence' WHEN bytes > 20000 THEN 'bytes' WHEN doc_id % 50 = 7 THEN 'held_out' WHEN before >= 100000 THEN 'quota' ELSE 'kept' END AS status, count(*) AS documents FROM (SELECT *, coalesce(sum(CASE WHEN source NOT IN ('src3', 'src4') AND bytes <= 20000 AND doc_id % 50 <> 7 THEN bytes END) OVER (PARTITION BY lang ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (SELECT doc_id, lang, source, octet_length(encode(text)) AS bytes FROM documents)) GROUP BY 1")
def sampling_funnel(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang", "source", F.octet_length("text").alias("bytes"))
    fine = ~F.col("source").isin("src3", "src4") & (F.col("bytes") <= 20000) & (F.col("doc_id") % 50 != 7)
    d = A.admit_until(d.withColumn("counted", F.when(fine, F.col("bytes")).otherwise(0)), "lang", "doc_id", "counted", F.lit(100_000))
    status = F.when(F.coalesce("bytes", F.lit(0)) == 0, "blank").when(F.col("source").isin("src3", "src4"), "licence").when(F.col("bytes") > 20000, "bytes").when(F.col("doc_id") % 50 == 7, "held_out").when(~F.col("admitted"), "quota").otherwise("kept")
    return d.groupBy(status.alias("status")).agg(F.count("*").alias("documents"))


@query("SELECT total, round(hours, 6) AS hours, round(cost, 6) AS cost, cost <= 5 AS fits FROM (SELECT t * 100000 AS total, t * 100000 / 2500.0::DOUBLE / 3600 * 1.15 + 0.25 AS hours, (t * 100000 / 2500.0::DOUBLE / 3600 * 1.15 + 0.25) * 0.9 AS cost FROM range(1, 601, 50) r(t))")
def cost_projection(spark, sf):
    hours = F.col("id") * 100000 / F.lit(2500.0) / 3600 * 1.15 + 0.25
    rows = spark.range(1, 601, 50).select((F.col("id") * 100000).alias("total"), hours.alias("h"))
    return rows.select("total", F.round("h", 6).alias("hours"), F.round(F.col("h") * 0.9, 6).alias("cost"), (F.col("h") * 0.9 <= 5).alias("fits"))


@query("SELECT source, start, doc_id FROM (SELECT source, doc_id, cum - n AS start, cum, n FROM (SELECT source, doc_id, n, sum(n) OVER (PARTITION BY source ORDER BY doc_id)::BIGINT AS cum FROM (SELECT source, doc_id, len(regexp_extract_all(text, '{TOKEN}')) + 1 AS n FROM documents))) WHERE start < 12000 AND cum > 8000")
def range_read(spark, sf):
    d = table(spark, sf, "documents").select("source", "doc_id", (F.size(T.tokens(F.col("text"))) + 1).alias("n"))
    d = A.running_total(d, "source", "doc_id", "n", "cum")
    return d.withColumn("start", (F.col("cum") - F.col("n")).cast("long")).where("start < 12000 AND cum > 8000").select("source", "start", "doc_id")


@query("SELECT doc_id, 2 AS n, 'assert f(' || doc_id || ') == 1|assert f(3)[0] != ''x''' AS asserts FROM documents")
def assert_extraction(spark, sf):
    reply = F.concat(F.lit("Tests:\n```python\nassert f("), F.col("doc_id").cast("string"), F.lit(") == 1\nassert f(2) == None\nassert f(3)[0] != 'x'\nassert g(1) == 2\nassert f(4) != 0\nassert f(3)[0] != 'x'\n```"))
    d = table(spark, sf, "documents").select("doc_id", R.asserts_of(reply, F.lit("f")).alias("a"))
    return d.select("doc_id", F.size("a").alias("n"), F.array_join("a", "|").alias("asserts"))


@query("SELECT item_id AS id, item_id % 3 <> 1 AS passed, CASE WHEN item_id % 3 = 1 THEN 'AssertionError' ELSE '' END AS error FROM benchmark")
def sandboxed_tests(spark, sf):
    return _tested(table(spark, sf, "benchmark"))


def _tested(items):
    code = F.concat(F.lit("def f(x):\n    return x + "), F.when(F.col("item_id") % 3 == 1, "2").otherwise("1"))
    rows = items.select(F.col("item_id").alias("id"), code.alias("code"), F.array(F.lit("assert f(1) == 2")).alias("tests"))
    return R.run_tests(rows)


@query("SELECT doc_id, sha256(trim(regexp_replace(nfc_normalize(substr(text, 1, 2000)), '\\s+', ' ', 'g'))) AS digest FROM documents")
def normalised_texts(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2(R.normalised_for_lid(F.col("text")), 256).alias("digest"))

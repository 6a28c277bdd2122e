"""Queries on duplicates, contamination, joins and set differences."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import dedup as D
from .registry import query, table

_GRAMS = "SELECT {key}, unnest(CASE WHEN len(toks) >= 13 THEN list_distinct([array_to_string(toks[i:i+12], ' ') for i in range(1, len(toks)-11)]) ELSE [] END) AS gram FROM (SELECT {key}, regexp_extract_all(text, '{{TOKEN}}') AS toks FROM {table})"
_SUB = "SELECT d.doc_id, b.item_id FROM (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS flat FROM documents) d JOIN (SELECT item_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS needle FROM benchmark) b ON contains(d.flat, b.needle) WHERE length(needle) >= 60"
_BY_GRAM = f"WITH bg AS ({_GRAMS.format(key='item_id', table='benchmark')}), dg AS ({_GRAMS.format(key='doc_id', table='documents')}), n AS (SELECT item_id, count(*) AS k FROM bg GROUP BY 1 HAVING count(*) >= 2) SELECT doc_id, dg_item AS item_id, shared, need FROM (SELECT dg.doc_id, bg.item_id AS dg_item, count(*) AS shared, greatest(2, ceil(any_value(n.k) * 0.5))::BIGINT AS need FROM dg JOIN bg USING (gram) JOIN n ON n.item_id = bg.item_id GROUP BY 1, 2) WHERE shared >= need"


@query("SELECT sha256(text) AS content, count(*) AS copies, min(doc_id) AS first_doc FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_dup_groups(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("content"))
    return d.groupBy("content").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc")).where("copies > 1")


@query("SELECT doc_id, CASE WHEN NOT ok THEN 'dropped' WHEN row_number() OVER (PARTITION BY source, h, ok ORDER BY doc_id) = 1 THEN 'kept' ELSE 'dropped_duplicate' END AS status FROM (SELECT doc_id, source, sha256(text) AS h, length(trim(text)) >= 100 AS ok FROM documents)")
def dedup_first_per_source(spark, sf):
    d = table(spark, sf, "documents").withColumn("h", F.sha2("text", 256))
    return D.dedup_first_kept(d, F.length(F.trim("text")) >= 100, ["source", "h"], "doc_id").select("doc_id", "status")


@query("SELECT v.doc_id FROM documents v WHERE v.doc_id % 10 = 3 AND sha256(v.text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 10 <> 3)")
def cross_split_clean(spark, sf):
    d = table(spark, sf, "documents").withColumn("h", F.sha2("text", 256))
    return d.where("doc_id % 10 = 3").join(d.where("doc_id % 10 <> 3").select("h"), "h", "left_anti").select("doc_id")


@query("SELECT doc_id, CASE WHEN row_number() OVER (PARTITION BY sha ORDER BY doc_id) > 1 THEN 'sha' WHEN row_number() OVER (PARTITION BY reply ORDER BY doc_id) > 1 THEN 'reply' ELSE 'kept' END AS status FROM (SELECT doc_id, sha256(text) AS sha, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS reply FROM documents)")
def two_key_dedup(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("sha"), F.sha2(F.lower(T.collapse(F.col("text"))), 256).alias("reply"))
    return D.two_key_dedup(d, "sha", "reply", ["doc_id"]).select("doc_id", "status")


@query("SELECT doc_id, CASE WHEN doc_id = f THEN 'kept' WHEN doc_id > f THEN 'duplicate' ELSE 'contaminated' END AS status FROM (SELECT doc_id, min(CASE WHEN doc_id % 3 <> 0 THEN doc_id END) OVER (PARTITION BY lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))) AS f FROM documents)")
def first_clean_wins(spark, sf):
    d = table(spark, sf, "documents").withColumn("k", F.sha2(F.lower(T.collapse(F.col("text"))), 256))
    return D.unique_clean(d, F.col("k"), F.col("doc_id") % 3 == 0, "doc_id").select("doc_id", "status")


@query("SELECT doc_id, min(item_id) AS item_id FROM (" + _SUB + ") GROUP BY doc_id")
def decontam_substring(spark, sf):
    hits = D.substring_hits(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return hits.groupBy("doc_id").agg(F.min("item_id").alias("item_id"))


@query(_BY_GRAM)
def decontam_ngram(spark, sf):
    return D.gram_hits(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query("SELECT doc_id, m.item_id AS item_id, CASE WHEN m.rule = 0 THEN 'substring' ELSE 'ngrams' END AS rule FROM (SELECT doc_id, min({'item_id': item_id, 'rule': rule}) AS m FROM (SELECT doc_id, item_id, 0 AS rule FROM (" + _SUB + ") UNION ALL SELECT doc_id, item_id, 1 AS rule FROM (" + _BY_GRAM + ")) GROUP BY doc_id)")
def decontam_first_hit(spark, sf):
    return D.first_hit(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query("SELECT count(*) AS items, count_if(length(needle) >= 60) AS with_needle, count_if(grams >= 2) AS with_grams, count_if(length(needle) < 60 AND grams < 2) AS unchecked FROM (SELECT trim(regexp_replace(text, '\\s+', ' ', 'g')) AS needle, CASE WHEN len(toks) >= 13 THEN len(list_distinct([array_to_string(toks[i:i+12], ' ') for i in range(1, len(toks)-11)])) ELSE 0 END AS grams FROM (SELECT text, regexp_extract_all(text, '{TOKEN}') AS toks FROM benchmark))")
def decontam_index_summary(spark, sf):
    b = table(spark, sf, "benchmark").select(T.collapse(F.col("text")).alias("needle"), T.tokens(F.col("text")).alias("toks"))
    b = b.select(F.length("needle").alias("n"), F.size(T.ngrams(F.col("toks"), 13)).alias("grams"))
    return b.agg(F.count("*").alias("items"), F.count_if(F.col("n") >= 60).alias("with_needle"), F.count_if(F.col("grams") >= 2).alias("with_grams"), F.count_if((F.col("n") < 60) & (F.col("grams") < 2)).alias("unchecked"))


@query("SELECT sha256('v1|60|13|2|0.5|' || string_agg(item_id || ':' || sha256(text), '|' ORDER BY item_id)) AS fingerprint FROM benchmark")
def rule_fingerprint(spark, sf):
    rows = table(spark, sf, "benchmark").select("item_id", F.concat(F.col("item_id").cast("string"), F.lit(":"), F.sha2("text", 256)).alias("s"))
    one = rows.agg(F.array_sort(F.collect_list(F.struct("item_id", "s"))).alias("r"))
    return one.select(F.sha2(F.concat(F.lit("v1|60|13|2|0.5|"), F.array_join(F.transform("r", lambda x: x["s"]), "|")), 256).alias("fingerprint"))


_SHINGLES = "SELECT doc_id, lang, CASE WHEN len(toks) >= 5 THEN list_distinct([array_to_string(toks[i:i+4], ' ') for i in range(1, len(toks)-3)]) WHEN len(toks) > 0 THEN [array_to_string(toks, ' ')] ELSE [] END AS s FROM (SELECT doc_id, lang, regexp_extract_all(text, '{TOKEN}') AS toks FROM documents)"


@query("WITH d AS (" + _SHINGLES + "), k AS (SELECT *, array_to_string(list_sort(s), chr(10)) AS key FROM d), r AS (SELECT lang, key, min(doc_id) AS doc_id, any_value(s) AS s FROM k WHERE len(s) > 0 GROUP BY 1, 2) SELECT a.doc_id AS a, b.doc_id AS b, round(len(list_intersect(a.s, b.s)) / len(list_distinct(a.s || b.s))::DOUBLE, 6) AS likeness FROM r a JOIN r b ON a.lang = b.lang AND a.doc_id < b.doc_id AND least(len(a.s), len(b.s)) >= 0.9 * greatest(len(a.s), len(b.s)) WHERE len(list_intersect(a.s, b.s)) >= 0.9 * len(list_distinct(a.s || b.s))")
def near_copies_by_language(spark, sf):
    return D.near_copies(table(spark, sf, "documents"), "lang").withColumn("likeness", F.round("likeness", 6))


@query("WITH d AS (" + _SHINGLES + ") SELECT doc_id, min(doc_id) OVER (PARTITION BY lang, array_to_string(list_sort(s), chr(10))) AS a FROM d")
def same_shingles(spark, sf):
    return D.class_members(table(spark, sf, "documents"), "lang")


@query("SELECT DISTINCT a.doc_id FROM (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS c FROM documents WHERE doc_id % 2 = 0) a JOIN (SELECT trim(regexp_replace(text, '\\s+', ' ', 'g')) AS c FROM documents WHERE doc_id % 2 = 1) b ON a.c = b.c WHERE length(a.c) >= 200")
def whole_text_leaks(spark, sf):
    d = table(spark, sf, "documents").withColumn("c", T.collapse(F.col("text")))
    return d.where("doc_id % 2 = 0 AND length(c) >= 200").join(d.where("doc_id % 2 = 1").select("c"), "c", "left_semi").select("doc_id")


@query("SELECT content, doc_id, tag FROM (SELECT sha256(text) AS content, doc_id, CASE WHEN doc_id % 3 = 0 THEN 'a' WHEN doc_id % 3 = 1 THEN 'b' ELSE 'c' END AS tag, row_number() OVER (PARTITION BY text ORDER BY CASE doc_id % 3 WHEN 2 THEN 0 WHEN 0 THEN 1 ELSE 2 END, doc_id) AS rn FROM documents) WHERE rn = 1")
def first_answer_by_priority(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("content"))
    rank = F.when(F.col("doc_id") % 3 == 2, 0).when(F.col("doc_id") % 3 == 0, 1).otherwise(2)
    d = D.first_per_key(d.withColumn("rank", rank), ["content"], ["rank", "doc_id"])
    return d.where("is_first").select("content", "doc_id", F.element_at(F.array(F.lit("c"), F.lit("a"), F.lit("b")), F.col("rank") + 1).alias("tag"))


@query("SELECT CASE WHEN d.doc_id IS NULL THEN 'unknown_id' WHEN g.conv_id IS NULL THEN 'no_generation' WHEN l.quality = 0 THEN 'not_kept' ELSE 'kept' END AS reason, count(*) AS labels FROM labels l LEFT JOIN documents d USING (doc_id) LEFT JOIN (SELECT DISTINCT conv_id FROM conversations) g ON g.conv_id = l.doc_id GROUP BY 1")
def join_reasons(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.lit(True).alias("known"))
    made = table(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), F.lit(True).alias("made")).distinct()
    rows = table(spark, sf, "labels").join(docs, "doc_id", "left").join(made, "doc_id", "left")
    reason = F.when(F.col("known").isNull(), "unknown_id").when(F.col("made").isNull(), "no_generation").when(F.col("quality") == 0, "not_kept").otherwise("kept")
    return rows.groupBy(reason.alias("reason")).agg(F.count("*").alias("labels"))


@query("SELECT c.c_custkey AS id, lower(c.c_name) AS name FROM customer c WHERE c.c_custkey IN (SELECT o_custkey FROM orders) AND c.c_custkey NOT IN (SELECT s_suppkey FROM supplier) AND c.c_acctbal > 0")
def semi_anti_joins(spark, sf):
    c = table(spark, sf, "customer").where("c_acctbal > 0")
    c = c.join(table(spark, sf, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_semi")
    c = c.join(table(spark, sf, "supplier"), F.col("c_custkey") == F.col("s_suppkey"), "left_anti")
    return c.select(F.col("c_custkey").alias("id"), F.lower("c_name").alias("name"))


@query("SELECT coalesce(a.k, b.k) AS k, a.v AS old, b.v AS new FROM (SELECT source AS k, count(*) AS v FROM documents WHERE doc_id % 2 = 0 AND source <> 'src1' GROUP BY 1) a FULL JOIN (SELECT source AS k, count(*) AS v FROM documents WHERE doc_id % 3 <> 0 AND source <> 'src2' GROUP BY 1) b ON a.k = b.k WHERE a.v IS DISTINCT FROM b.v")
def settings_diff(spark, sf):
    d = table(spark, sf, "documents")
    a = d.where("doc_id % 2 = 0 AND source <> 'src1'").groupBy(F.col("source").alias("k")).agg(F.count("*").alias("old"))
    b = d.where("doc_id % 3 <> 0 AND source <> 'src2'").groupBy(F.col("source").alias("k")).agg(F.count("*").alias("new"))
    return a.join(b, "k", "full").where(~F.col("old").eqNullSafe(F.col("new")))


@query("SELECT 'both' AS side, count(*) AS n FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels) UNION ALL SELECT 'missing', count(*) FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels) UNION ALL SELECT 'all', count(*) FROM (SELECT doc_id FROM documents UNION ALL SELECT doc_id FROM labels)")
def set_operations(spark, sf):
    a, b = table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels").select("doc_id")
    sides = {"both": a.intersect(b), "missing": a.subtract(b), "all": a.unionAll(b)}
    out = None
    for name, df in sides.items():
        one = df.agg(F.lit(name).alias("side"), F.count("*").alias("n"))
        out = one if out is None else out.unionAll(one)
    return out

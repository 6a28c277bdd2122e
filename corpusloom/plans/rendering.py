"""Queries on the way from source rows to texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import dedup as D
from ..operators import mixing as M
from ..operators import rendering as R
from .registry import query, table

_SPLIT = "CASE WHEN ('0x' || substr(sha256(source || '/' || doc_id), 1, 2))::INT < 240 THEN 'train' ELSE 'val' END"


def _split():
    return F.when(F.conv(F.substring(F.sha2(F.concat("source", F.lit("/"), F.col("doc_id").cast("string")), 256), 1, 2), 16, 10).cast("int") < 240, "train").otherwise("val")


@query(f"SELECT source, coalesce(reason, 'kept') AS reason, count(*) AS documents FROM (SELECT source, CASE WHEN lang NOT IN ('en', 'fr', 'de') THEN 'dropped_lang' WHEN {_SPLIT} <> 'train' THEN 'dropped_split' WHEN doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) THEN 'dropped_heldout' WHEN text IS NULL THEN 'dropped_no_text' END AS reason FROM documents) GROUP BY 1, 2")
def render_reasons(spark, sf):
    """Keep-lists, then the split, then held-out ids (the toxic documents), then the text."""
    d = table(spark, sf, "documents").withColumn("split", _split())
    d = R.mark_held_out(d, table(spark, sf, "labels").where("toxic = 1"), "doc_id")
    reason = R.drop_reason({"lang": ["en", "fr", "de"]}, "train", F.col("held_out"))
    return d.groupBy("source", F.coalesce(reason, F.lit("kept")).alias("reason")).agg(F.count("*").alias("documents"))


@query("SELECT doc_id, sha256(CASE WHEN trim(lang) = '' THEN text ELSE trim(lang) || chr(10) || chr(10) || text END) AS titled, sha256(trim(source, ' ') || chr(10) || chr(10) || trim(text, ' ')) AS answered FROM documents")
def rendered_texts(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.sha2(R.titled(F.col("lang"), F.col("text")), 256).alias("titled"), F.sha2(R.answered(F.col("source"), F.col("text")), 256).alias("answered"))


@query("SELECT page_id, nullif(regexp_extract(q, '^https?://([^/]+)/questions/(\\d+)', 1), '') AS site, nullif(regexp_extract(q, '^https?://([^/]+)/questions/(\\d+)', 2), '') AS question_id FROM (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN regexp_replace(url, '^(https?://[^/]+)/.*$', '\\1/questions/') || page_id ELSE url END AS q FROM pages)")
def question_links(spark, sf):
    url = F.when(F.col("page_id") % 2 == 0, F.concat(F.regexp_replace("url", "^(https?://[^/]+)/.*$", "$1/questions/"), F.col("page_id").cast("string"))).otherwise(F.col("url"))
    return table(spark, sf, "pages").select("page_id", R.question_link(url).alias("q")).select("page_id", "q.site", "q.question_id")


@query("SELECT event_id, CASE WHEN user_id % 3 = 0 THEN floor(value)::BIGINT::VARCHAR ELSE json_extract_string(props, '$.k') END AS k, event_type AS kind, (1 + (user_id % 3 = 0 OR json_extract_string(props, '$.k') IS NOT NULL)::INT) AS fields FROM events")
def merged_metadata(spark, sf):
    """Properties under a row's own fields, which win."""
    own = {"kind": F.col("event_type"), "k": F.when(F.col("user_id") % 3 == 0, F.floor("value"))}
    meta = R.literal_as_json(F.translate("props", '"', "'"))  # as a Python literal
    m = table(spark, sf, "events").select("event_id", R.merged(meta, own).alias("m"))
    return m.select("event_id", F.element_at("m", "k").alias("k"), F.element_at("m", "kind").alias("kind"), F.size("m").alias("fields"))


_LICENSED = "SELECT d.doc_id, d.source, d.lang, d.text, CASE l.quality WHEN 1 THEN 'open' WHEN 0 THEN 'closed' END AS licence FROM documents d LEFT JOIN labels l USING (doc_id)"


def _licensed(spark, sf):
    """Documents with a licence: their quality stands in, and unlabelled ones have none."""
    licence = F.when(F.col("quality") == 1, "open").when(F.col("quality") == 0, "closed")
    return table(spark, sf, "documents").join(table(spark, sf, "labels").select("doc_id", licence.alias("licence")), "doc_id", "left")


@query(f"SELECT source, count(*) AS rows_scanned, count_if(lang NOT IN ('en', 'de')) AS dropped_language, count_if(lang IN ('en', 'de') AND licence IS DISTINCT FROM 'open') AS dropped_license, count_if(lang IN ('en', 'de') AND licence = 'open') AS kept FROM ({_LICENSED}) GROUP BY source")
def code_source_counts(spark, sf):
    return R.source_counts(_licensed(spark, sf), "source", "lang", ["en", "de"], "licence", ["open"])


@query(f"WITH r AS (SELECT doc_id, source, CASE WHEN lang NOT IN ('en', 'de') THEN 'language' WHEN licence IS DISTINCT FROM 'open' THEN 'license' WHEN length(text) > 4000 THEN 'too_long' END AS reason FROM ({_LICENSED})), p AS (SELECT *, sum((reason IS NULL)::INT) OVER (PARTITION BY source ORDER BY doc_id) - (reason IS NULL)::INT AS part FROM r) SELECT source, max(CASE WHEN reason IS NULL THEN doc_id END) AS doc_id, count(*) FILTER (reason = 'language') AS language, count(*) FILTER (reason = 'license') AS license, count(*) FILTER (reason = 'too_long') AS too_long FROM p GROUP BY source, part")
def offers_with_counts(spark, sf):
    """What is offered of each file, each offer with the counts of what was left out before it, and the rest at the file's end."""
    lang, lic = F.col("lang").isin("en", "de"), F.coalesce(F.col("licence") == "open", F.lit(False))
    reason = F.when(~lang, "language").when(~lic, "license").when(F.length("text") > 4000, "too_long")
    return R.carried(_licensed(spark, sf).withColumn("reason", reason), "source", "doc_id", "reason", ["language", "license", "too_long"])


@query("SELECT bucket, count(*) AS documents, round(sum(n_chars * part)::DOUBLE, 3) AS chars FROM (SELECT lang AS bucket, 1.0 AS part, n_chars FROM documents WHERE lang <> 'fr' UNION ALL SELECT unnest(['fra_a', 'fra_b']), 0.5, n_chars FROM documents WHERE lang = 'fr') GROUP BY 1")
def language_buckets(spark, sf):
    """One language is split in two buckets of half its weight."""
    d = R.script_buckets(table(spark, sf, "documents").select("lang", "n_chars"), "lang", "fr", ["fra_a", "fra_b"])
    return d.groupBy("bucket").agg(F.count("*").alias("documents"), F.round(F.sum(F.col("n_chars") * F.col("part")), 3).alias("chars"))


_PATH = "CASE doc_id % 5 WHEN 0 THEN 'lib/x.min.js' WHEN 1 THEN 'vendor/a.py' ELSE 'src/a.py' END"


def _code_documents(spark, sf):
    d = _licensed(spark, sf).withColumn("path", F.when(F.col("doc_id") % 5 == 0, "lib/x.min.js").when(F.col("doc_id") % 5 == 1, "vendor/a.py").otherwise("src/a.py"))
    leaks = table(spark, sf, "documents").where("lang = 'es'").select(F.sha2("text", 256).alias("h")).distinct().withColumn("leaked", F.lit(True))
    hits = D.substring_hits(table(spark, sf, "documents"), table(spark, sf, "benchmark")).select("doc_id").distinct().withColumn("contaminated", F.lit(True))
    d = d.withColumn("h", F.sha2("text", 256)).join(leaks, "h", "left").join(hits, "doc_id", "left").drop("h")
    d = d.withColumns({"leaked": F.coalesce("leaked", F.lit(False)), "contaminated": F.coalesce("contaminated", F.lit(False))})
    return R.code_reason(d, ["en", "de", "fr"], ["open", "closed"], 6000).withColumn("n_tokens", (F.size(T.tokens(F.col("text"))) + 1).cast("long"))


@query(f"""WITH RECURSIVE d AS (SELECT doc_id, source, lang, licence, text, {_PATH} AS path, (len(regexp_extract_all(text, '{{TOKEN}}')) + 1)::BIGINT AS n FROM ({_LICENSED})),
h AS (SELECT DISTINCT d.doc_id FROM documents d, (SELECT trim(regexp_replace(text, '\\s+', ' ', 'g')) AS needle FROM benchmark) b WHERE length(needle) >= 60 AND contains(trim(regexp_replace(d.text, '\\s+', ' ', 'g')), needle)),
f AS (SELECT text, min(doc_id) AS first_id FROM d WHERE lang IN ('en', 'de', 'fr') AND licence IS NOT NULL GROUP BY text),
r AS (SELECT d.*, CASE WHEN lang NOT IN ('en', 'de', 'fr') THEN 'language' WHEN licence IS NULL THEN 'license' WHEN doc_id > first_id THEN 'duplicate' WHEN text IN (SELECT text FROM documents WHERE lang = 'es') THEN 'leak'
  WHEN doc_id IN (SELECT doc_id FROM h) THEN 'contaminated' WHEN trim(text) = '' THEN 'blank' WHEN path = 'lib/x.min.js' THEN 'minified' WHEN path = 'vendor/a.py' THEN 'vendored' WHEN length(text) > 6000 THEN 'too_long' END AS reason FROM d LEFT JOIN f USING (text)),
k AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM r WHERE reason IS NULL),
c(source, doc_id, i, total, kind, skip) AS (SELECT source, NULL::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, NULL::BOOLEAN FROM (SELECT DISTINCT source FROM k) UNION ALL
  SELECT source, doc_id, i, total + CASE WHEN s THEN 0 ELSE n END, kind + CASE WHEN lang = 'de' AND NOT s THEN n ELSE 0 END, s FROM (SELECT k.*, c.total, c.kind, k.lang = 'de' AND c.total >= 500 AND c.kind + k.n > 0.2::DOUBLE * (c.total + k.n) AS s FROM c JOIN k ON k.source = c.source AND k.i = c.i + 1))
SELECT coalesce(reason, CASE WHEN skip THEN 'html_cap' ELSE 'kept' END) AS reason, count(*) AS documents, sum(n)::BIGINT AS tokens FROM r LEFT JOIN (SELECT doc_id, skip FROM c) USING (doc_id) GROUP BY 1""")
def code_chain(spark, sf):
    """The whole chain of code filters with a share cap at its end; what is left out counts its tokens too."""
    d = _code_documents(spark, sf)
    passed = d.where("reason IS NULL").select("source", "doc_id", "n_tokens", (F.col("lang") == "de").alias("special"))
    d = d.join(M.capped(passed, 0.2, 500), "doc_id", "left")
    reason = F.coalesce("reason", F.when(F.col("capped"), "html_cap").otherwise("kept"))
    return d.groupBy(reason.alias("reason")).agg(F.count("*").alias("documents"), F.sum("n_tokens").cast("long").alias("tokens"))

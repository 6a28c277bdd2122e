"""Queries on texts: tokens, scripts, secrets, paths, splits, pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from .registry import query, table

_NGRAMS = "list_distinct([array_to_string(toks[i:i+{n}-1], ' ') for i in range(1, len(toks)-{n}+2)])"


@query("SELECT doc_id, len(t) AS n_tokens, len(list_distinct(t)) AS n_distinct, length(text) - length(regexp_replace(text, '\\s', '', 'g')) AS n_spaces FROM (SELECT doc_id, text, regexp_extract_all(text, '{TOKEN}') AS t FROM documents)")
def doc_token_stats(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text", T.tokens(F.col("text")).alias("t"))
    return d.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"), (F.length("text") - F.length(T.spaceless(F.col("text")))).cast("long").alias("n_spaces"))


@query("SELECT CASE WHEN n <= 1000 THEN '<=1000' WHEN n <= 4000 THEN '<=4000' WHEN n <= 8000 THEN '<=8000' WHEN n <= 16000 THEN '<=16000' ELSE '>16000' END AS bucket, count(*) AS documents, sum(n)::BIGINT AS tokens FROM (SELECT len(regexp_extract_all(text, '{TOKEN}')) + 1 AS n FROM documents) GROUP BY 1")
def length_buckets(spark, sf):
    d = table(spark, sf, "documents").select((F.size(T.tokens(F.col("text"))) + 1).alias("n"))
    return d.groupBy(T.length_bucket(F.col("n")).alias("bucket")).agg(F.count("*").alias("documents"), F.sum("n").cast("long").alias("tokens"))


@query("SELECT doc_id, CASE WHEN len(toks) >= 13 THEN len(" + _NGRAMS.format(n=13) + ") ELSE 0 END AS n_grams FROM (SELECT doc_id, regexp_extract_all(text, '{TOKEN}') AS toks FROM documents)")
def ngram_counts(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", T.tokens(F.col("text")).alias("toks"))
    return d.select("doc_id", F.size(T.ngrams(F.col("toks"), 13)).cast("long").alias("n_grams"))


@query("SELECT doc_id, CASE WHEN len(toks) >= 5 THEN len(" + _NGRAMS.format(n=5) + ") WHEN len(toks) > 0 THEN 1 ELSE 0 END AS n_shingles FROM (SELECT doc_id, regexp_extract_all(text, '{TOKEN}') AS toks FROM documents)")
def shingle_counts(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", T.tokens(F.col("text")).alias("toks"))
    return d.select("doc_id", F.size(T.shingles(F.col("toks"))).cast("long").alias("n_shingles"))


_HOLDER = "(lower(trim(v)) LIKE 'changeme%' OR lower(trim(v)) LIKE 'your-%' OR starts_with(lower(trim(v)), 'your_') OR lower(trim(v)) LIKE '<%' OR lower(trim(v)) LIKE '$%' OR starts_with(lower(trim(v)), '%(') OR starts_with(lower(trim(v)), '{{') OR starts_with(lower(trim(v)), '***') OR starts_with(lower(trim(v)), 'process.env') OR starts_with(lower(trim(v)), 'os.environ') OR contains(lower(v), 'xxx') OR contains(lower(v), 'example') OR contains(lower(v), 'placeholder') OR contains(lower(v), 'dummy') OR contains(lower(v), 'replace') OR contains(lower(v), 'redacted'))"
_NAME = r"\w*(?:password|passwd|secret|api_key|apikey|token)\w*"
_VALUES = " || ".join(
    f"regexp_extract_all(text, '(?i){head}{q}([^''\"]{{6,}}){q}', 1)"
    for q in ("''", '"')
    for head in (_NAME + r"(?:[''\"]\])?\s*[:=]\s*".replace('\\"', '"'), r"(?:environ\.get|getenv)\(\s*[''\"]".replace('\\"', '"') + _NAME + r"[''\"]\s*,\s*".replace('\\"', '"'))
)


@query(f"SELECT doc_id, source FROM (SELECT doc_id, source, text, {_VALUES} AS vs FROM documents) WHERE regexp_matches(text, 'AKIA[0-9A-Z]{{16}}|-----BEGIN [A-Z ]*PRIVATE KEY-----|gh[pousr]_[A-Za-z0-9]{{36}}|sk-[A-Za-z0-9]{{20,}}|xox[baprs]-') OR len(list_filter(vs, lambda v: NOT {_HOLDER})) > 0")
def secret_hits(spark, sf):
    return table(spark, sf, "documents").where(T.contains_secret(F.col("text"))).select("doc_id", "source")


@query("SELECT lang, script, count(*) AS documents FROM (SELECT lang, CASE WHEN latn = 0 OR letters - latn > latn THEN NULL ELSE 'Latn' END AS script FROM (SELECT lang, length(regexp_replace(text, '[^A-Za-z\\x{AA}\\x{B5}\\x{BA}\\x{C0}-\\x{D6}\\x{D8}-\\x{F6}\\x{F8}-\\x{24F}]', '', 'g')) AS latn, length(regexp_replace(text, '\\P{L}', '', 'g')) AS letters FROM documents)) GROUP BY 1, 2")
def script_mix(spark, sf):
    d = table(spark, sf, "documents").select("lang", T.dominant_script(F.col("text")).alias("script"))
    return d.groupBy("lang", "script").agg(F.count("*").alias("documents"))


@query("SELECT lang, sum(length(text) - length(translate(text, 'éèêàç', '')))::BIGINT AS accented, sum(length(text) - length(translate(text, 'äöüß', '')))::BIGINT AS umlauts FROM documents GROUP BY lang")
def characteristic_characters(spark, sf):
    d = table(spark, sf, "documents")
    return d.groupBy("lang").agg(F.sum(T.char_count(F.col("text"), "éèêàç")).cast("long").alias("accented"), F.sum(T.char_count(F.col("text"), "äöüß")).cast("long").alias("umlauts"))


_PATHS = "CASE doc_id % 7 WHEN 0 THEN 'src\\App.min.JS' WHEN 1 THEN 'node_modules/x/index.js' WHEN 2 THEN 'lib/my.bundle.py' WHEN 3 THEN 'a/vendor' WHEN 4 THEN 'style.css.map' WHEN 5 THEN '//' ELSE 'pkg/main_' || doc_id || '.py' END"


@query(f"SELECT reason, count(*) AS documents, min(doc_id) AS first_doc FROM (SELECT doc_id, CASE WHEN len(parts) = 0 THEN NULL WHEN regexp_matches(parts[-1], '(?i)\\.min\\.(js|css)$|\\.map$') THEN 'minified' WHEN list_has_any(parts[:-2], ['vendor','node_modules','dist','build','bower_components','third_party','external']) OR contains(parts[-1], 'bundle') OR contains(parts[-1], '.pack.') THEN 'vendored' END AS reason FROM (SELECT doc_id, list_filter(string_split(lower(replace({_PATHS}, '\\', '/')), '/'), lambda p: p <> '') AS parts FROM documents)) GROUP BY 1")
def path_reasons(spark, sf):
    path = F.expr(_PATHS.replace("\\", "\\\\"))
    d = table(spark, sf, "documents").select("doc_id", T.code_path_reason(path).alias("reason"))
    return d.groupBy("reason").agg(F.count("*").alias("documents"), F.min("doc_id").alias("first_doc"))


@query("SELECT page_id, regexp_extract(url, 'https?://([^/]+)/', 1) AS host, regexp_extract(url, 'https?://[^/]+/([a-z]{2})/(\\d+)', 2) AS number, regexp_extract(url, '\\?(.*)$', 1) AS query_string FROM pages")
def url_parts(spark, sf):
    p = table(spark, sf, "pages")
    return p.select("page_id", F.regexp_extract("url", r"https?://([^/]+)/", 1).alias("host"), F.regexp_extract("url", r"https?://[^/]+/([a-z]{2})/(\d+)", 2).alias("number"), F.regexp_extract("url", r"\?(.*)$", 1).alias("query_string"))


@query("SELECT regexp_extract(url, 'https?://([^/]+)/', 1) AS host, count(*) AS pages, sum(length(html))::BIGINT AS chars FROM pages GROUP BY 1")
def host_counts(spark, sf):
    p = table(spark, sf, "pages")
    return p.groupBy(F.regexp_extract("url", r"https?://([^/]+)/", 1).alias("host")).agg(F.count("*").alias("pages"), F.sum(F.length("html")).cast("long").alias("chars"))


@query("SELECT page_id, sha256(trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?i)<(br|/p|/div|/li|/h[1-6]|/tr|/pre|/blockquote)[^>]*>', chr(10), 'g'), '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '\\n{3,}', chr(10) || chr(10), 'g'))) AS text_sha FROM pages")
def page_text(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.sha2(T.strip_html(F.col("html")), 256).alias("text_sha"))


@query("SELECT split, count(*) AS documents, sum(n_chars)::BIGINT AS chars FROM (SELECT n_chars, CASE WHEN f < 0.90 THEN 'train' WHEN f < 0.90 + 0.05 THEN 'validation' ELSE 'test' END AS split FROM (SELECT n_chars, ('0x' || substr(sha256(lower(source || '/' || doc_id)), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0 AS f FROM documents)) GROUP BY 1")
def hash_split(spark, sf):
    d = table(spark, sf, "documents").withColumn("split", T.assign_split(F.concat("source", F.lit("/"), F.col("doc_id").cast("string"))))
    return d.groupBy("split").agg(F.count("*").alias("documents"), F.sum("n_chars").cast("long").alias("chars"))


@query("SELECT conv_id, ('0x' || substr(sha256('chat' || chr(0) || conv_id), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0 < 0.02 AS is_val, ('0x' || substr(sha256(conv_id::VARCHAR), 1, 2))::INT % 3 AS kind FROM conversations GROUP BY conv_id")
def validation_keys(spark, sf):
    c = table(spark, sf, "conversations").select(F.col("conv_id"), F.col("conv_id").cast("string").alias("k")).distinct()
    kind = F.conv(F.substring(F.sha2("k", 256), 1, 2), 16, 10).cast("int") % 3
    return c.select("conv_id", (T.hash_fraction(F.concat(F.lit("chat"), F.char(F.lit(0)), "k")) < 0.02).alias("is_val"), kind.alias("kind"))


@query("SELECT item_id, size_text, CASE WHEN ends_with(size_text, 'M') THEN size_text[:-2]::BIGINT * 1048576 WHEN ends_with(size_text, 'k') THEN size_text[:-2]::BIGINT * 1024 ELSE size_text::BIGINT END AS size FROM (SELECT item_id, CASE WHEN n > 0 AND n % 1048576 = 0 THEN (n // 1048576) || 'M' WHEN n > 0 AND n % 1024 = 0 THEN (n // 1024) || 'k' ELSE n::VARCHAR END AS size_text FROM (SELECT item_id, CASE item_id % 3 WHEN 0 THEN item_id * 1048576 WHEN 1 THEN item_id * 1024 ELSE item_id END AS n FROM benchmark))")
def size_texts(spark, sf):
    n = F.when(F.col("item_id") % 3 == 0, F.col("item_id") * 1048576).when(F.col("item_id") % 3 == 1, F.col("item_id") * 1024).otherwise(F.col("item_id"))
    b = table(spark, sf, "benchmark").select("item_id", T.format_size(n).alias("size_text"))
    return b.select("item_id", "size_text", T.parse_size(F.col("size_text")).alias("size"))


@query("SELECT conv_id, turn, CASE WHEN strpos(t, chr(10)) > 0 THEN trim(substr(t, 1, strpos(t, chr(10)) - 1)) ELSE t END AS subject, ceil(length(t) / 3.0)::BIGINT AS estimate FROM (SELECT conv_id, turn, trim(text) AS t FROM conversations)")
def message_subjects(spark, sf):
    c = table(spark, sf, "conversations")
    return c.select("conv_id", "turn", T.message_parts(F.col("text"))[0].alias("subject"), F.ceil(F.length(F.trim("text")) / 3).cast("long").alias("estimate"))


@query("SELECT doc_id, n_lines, longest, round(total / n_lines::DOUBLE, 6) AS mean_line, longest > 1000 OR total > 200 * n_lines AS long_line FROM (SELECT doc_id, len(l) AS n_lines, list_max([length(x) for x in l]) AS longest, list_sum([length(x) for x in l]) AS total FROM (SELECT doc_id, string_split(regexp_replace(text, '\\n$', ''), chr(10)) AS l FROM documents))")
def line_lengths(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.transform(F.split(F.regexp_replace("text", r"\n\z", ""), "\n"), lambda x: F.length(x)).alias("l"))
    total = F.aggregate("l", F.lit(0), lambda a, x: a + x)
    return d.select("doc_id", F.size("l").cast("long").alias("n_lines"), F.array_max("l").cast("long").alias("longest"), F.round(total / F.size("l"), 6).alias("mean_line"), ((F.array_max("l") > 1000) | (total > 200 * F.size("l"))).alias("long_line"))

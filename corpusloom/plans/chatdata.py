"""Queries on chat training data."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chatdata as C
from ..operators import mixing as M
from ..operators import records as R
from .registry import query, table

_MAP = "CASE lang WHEN 'en' THEN 'english' WHEN 'de' THEN 'german' WHEN 'fr' THEN 'french' END"


@query(f"SELECT doc_id, coalesce(CASE WHEN label IS NULL THEN 'language' WHEN q = '' OR a = '' THEN 'empty' END, 'kept') AS status, label, substr(sha256(q || chr(0) || a), 1, 24) AS key FROM (SELECT doc_id, {_MAP} AS label, trim(source, ' ') AS q, trim(text, ' ') AS a FROM documents)")
def single_turn_examples(spark, sf):
    """One user turn (the source's name) and one assistant turn (the text) a row, in the languages of a map."""
    rules = {"en": "english", "de": "german", "fr": "french"}
    d = table(spark, sf, "documents").select("doc_id", R.map_language(F.col("lang"), F.lit(None).cast("string"), rules).alias("m"), F.trim("source").alias("q"), F.trim("text").alias("a"))
    status = F.when(F.col("m.label").isNull(), F.col("m.why")).when((F.col("q") == "") | (F.col("a") == ""), "empty").otherwise("kept")
    return d.select("doc_id", status.alias("status"), F.col("m.label").alias("label"), F.substring(F.sha2(F.concat("q", F.lit("\x00"), "a"), 256), 1, 24).alias("key"))


_TURNS = "SELECT conv_id, turn, role, coalesce(text, '') AS text, (len(regexp_extract_all(coalesce(text, ''), '{TOKEN}')) + 2)::BIGINT AS n FROM conversations"
_SPECIAL = " OR ".join(f"contains(text, '{s}')" for s in C.SPECIALS)
_VAL = "('0x' || substr(sha256('chat' || chr(0) || conv_id), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0 < 0.1"
_SCREENED = f"""WITH t AS ({_TURNS}), s AS (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY turn) AS upto, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, min(CASE WHEN role = 'system' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS x, first(role) OVER (PARTITION BY conv_id ORDER BY turn) = 'system' AS sys FROM t),
g AS (SELECT conv_id, count(*) AS turns, bool_or(trim(regexp_replace(text, '\\s+', ' ', 'g')) = '') AS blank, bool_or({_SPECIAL}) AS special,
  bool_and(CASE WHEN sys AND k = 1 THEN true ELSE role = CASE WHEN (k - sys::INT) % 2 = 1 THEN 'user' ELSE 'assistant' END END) AND count(*) - max(sys::INT) > 0 AND (count(*) - max(sys::INT)) % 2 = 0 AS fmt,
  string_agg(text, chr(10) ORDER BY turn) AS joined, string_agg('<|' || role || '|>' || text || '<|end|>', '' ORDER BY turn) AS r,
  max(CASE WHEN role = 'assistant' AND upto <= 300 THEN k END) AS fitted, max(CASE WHEN role = 'assistant' AND upto <= 300 THEN upto END) AS tokens FROM s GROUP BY conv_id),
h AS (SELECT DISTINCT conv_id FROM g, (SELECT trim(regexp_replace(text, '\\s+', ' ', 'g')) AS needle FROM benchmark) b WHERE length(needle) >= 60 AND contains(trim(regexp_replace(joined, '\\s+', ' ', 'g')), needle)),
e AS (SELECT g.*, CASE WHEN blank THEN 'empty' WHEN special THEN 'special_tokens' WHEN NOT fmt THEN 'format' WHEN conv_id IN (SELECT conv_id FROM h) THEN 'decontam' END AS early FROM g),
f AS (SELECT *, min(CASE WHEN early IS NULL THEN conv_id END) OVER (PARTITION BY r) AS first_id FROM e),
z AS (SELECT *, coalesce(early, CASE WHEN conv_id <> first_id THEN 'duplicate' END, CASE WHEN fitted IS NULL THEN 'too_long' END) AS reason, {_VAL} AS val FROM f),
screened AS (SELECT conv_id, reason, CASE WHEN reason IS NULL THEN fitted END AS fitted, CASE WHEN reason IS NULL THEN tokens::BIGINT END AS tokens, CASE WHEN reason IS NULL THEN fitted < turns END AS truncated, CASE WHEN reason IS NULL THEN CASE WHEN val THEN 'val' ELSE 'train' END END AS split FROM z)
"""


def _screened(spark, sf):
    is_val = T.hash_fraction(F.concat(F.lit("chat\x00"), F.col("conv_id").cast("string"))) < 0.1
    rows = C.screen(table(spark, sf, "conversations").select("conv_id", "turn", "role", "text"), table(spark, sf, "benchmark"), 300, is_val)
    return rows.withColumns({"fitted": F.col("fitted").cast("long"), "tokens": F.col("tokens").cast("long")})


@query(_SCREENED + "SELECT * FROM screened")
def screened_conversations(spark, sf):
    """Empty turns, special strings, format, decontamination, duplicates, context fit and split, in that order."""
    return _screened(spark, sf)


#: Next-fit of the screened conversations into blocks, each followed by an end token where there is room.
_BLOCKS = _SCREENED.replace("WITH t AS", "WITH RECURSIVE t AS") + """, c AS (SELECT conv_id, split, tokens, row_number() OVER (PARTITION BY split ORDER BY conv_id) AS i FROM screened WHERE reason IS NULL),
w(split, conv_id, i, block, used, tokens) AS (SELECT split, NULL::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT FROM (SELECT DISTINCT split FROM c) UNION ALL
  SELECT c.split, c.conv_id, c.i, CASE WHEN w.used > 0 AND w.used + least(c.tokens + 1, 512) > 512 THEN w.block + 1 ELSE w.block END, CASE WHEN w.used > 0 AND w.used + least(c.tokens + 1, 512) > 512 THEN least(c.tokens + 1, 512) ELSE w.used + least(c.tokens + 1, 512) END, c.tokens::BIGINT
  FROM w JOIN c ON c.split = w.split AND c.i = w.i + 1)
"""


def _blocks(spark, sf):
    kept = _screened(spark, sf).where("reason IS NULL").select("conv_id", "split", "tokens", F.least(F.col("tokens") + 1, F.lit(512)).alias("size"))
    return M.next_fit(kept, "conv_id", "split", "size", 512).join(kept.select("conv_id", "tokens"), "conv_id")


@query(_BLOCKS + "SELECT split, conv_id, block::INT AS block, (block // 4)::BIGINT AS shard FROM w WHERE i > 0")
def block_shards(spark, sf):
    """Blocks of 512 tokens in shards of four whole blocks."""
    return _blocks(spark, sf).select("split", "conv_id", "block", F.floor(F.col("block") / 4).alias("shard"))


@query(_BLOCKS + f"SELECT split, count(*) AS conversations, max(block) + 1 AS blocks, (max(block) + 1) * 512 AS tokens, sum(w.tokens)::BIGINT AS conversation_tokens, sum(a.n)::BIGINT AS assistant_tokens FROM w JOIN (SELECT t.conv_id, sum(n) FILTER (role = 'assistant') AS n FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM ({_TURNS})) t JOIN (SELECT conv_id, fitted FROM screened) s ON s.conv_id = t.conv_id AND t.k <= s.fitted GROUP BY 1) a USING (conv_id) WHERE i > 0 GROUP BY split")
def split_summary(spark, sf):
    """Conversations, blocks, tokens and those of assistants by split."""
    k = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    turns = table(spark, sf, "conversations").select("conv_id", "role", k.alias("k"), (F.size(T.tokens(F.coalesce("text", F.lit("")))) + 2).alias("n"))
    said = turns.join(_screened(spark, sf).select("conv_id", "fitted"), "conv_id").where("role = 'assistant' AND k <= fitted").groupBy("conv_id").agg(F.sum("n").alias("said"))
    rows = _blocks(spark, sf).join(said, "conv_id")
    blocks = (F.max("block") + 1).cast("long")
    return rows.groupBy("split").agg(F.count("*").alias("conversations"), blocks.alias("blocks"), (blocks * 512).alias("tokens"), F.sum("tokens").cast("long").alias("conversation_tokens"), F.sum("said").cast("long").alias("assistant_tokens"))


@query(f"SELECT coalesce(split, 'all') AS split, coalesce(first_role, 'all') AS first_role, count(*) AS conversations, sum(n)::BIGINT AS tokens, sum(said)::BIGINT AS assistant_tokens FROM (SELECT conv_id, CASE WHEN {_VAL} THEN 'val' ELSE 'train' END AS split, arg_min(role, turn) AS first_role, sum(n) AS n, coalesce(sum(n) FILTER (role = 'assistant'), 0) AS said FROM ({_TURNS}) GROUP BY conv_id) GROUP BY ROLLUP (first_role, split)")
def chat_source_stats(spark, sf):
    """Conversations and tokens by kind (the first role) and split, with subtotals."""
    val = F.when(T.hash_fraction(F.concat(F.lit("chat\x00"), F.col("conv_id").cast("string"))) < 0.1, "val").otherwise("train")
    n = F.size(T.tokens(F.coalesce("text", F.lit("")))) + 2
    c = table(spark, sf, "conversations").withColumn("n", n).groupBy("conv_id").agg(F.min_by("role", "turn").alias("first_role"), F.sum("n").alias("n"), F.sum(F.when(F.col("role") == "assistant", F.col("n")).otherwise(0)).alias("said"))
    rows = c.withColumn("split", val).rollup("first_role", "split").agg(F.count("*").alias("conversations"), F.sum("n").cast("long").alias("tokens"), F.sum("said").cast("long").alias("assistant_tokens"))
    return rows.withColumns({"split": F.coalesce("split", F.lit("all")), "first_role": F.coalesce("first_role", F.lit("all"))})


_MASKED = "SELECT row_number() OVER (ORDER BY conv_id, turn) - 1 AS pos, CASE role WHEN 'assistant' THEN 1 WHEN 'user' THEN 0 END AS mask FROM conversations"


@query(f"SELECT * FROM (SELECT pos // 8 AS block, CASE WHEN count(*) FILTER (mask IS NULL) > 0 THEN 'mask_values' WHEN count(*) <> 8 THEN 'short_block' WHEN coalesce(max(mask) FILTER (pos % 8 > 0), 0) = 0 THEN 'no_target' END AS problem FROM ({_MASKED}) GROUP BY 1) WHERE problem IS NOT NULL")
def mask_problems(spark, sf):
    """Blocks of eight turns whose masks (assistant or not; system turns have none) cannot be trained on."""
    from ..operators.allocation import numbered_parts
    from ..sources.readers import parquet_rows

    # turns of equal keys stay in the order of the table
    turns = parquet_rows(spark, f"{sf}/conversations.parquet", ["conv_id", "turn", "role"])
    rows = numbered_parts(turns, ["conv_id", "turn", "file", "row"], 64)
    mask = F.when(F.col("role") == "assistant", 1).when(F.col("role") == "user", 0)
    return C.mask_problems(rows.select(F.col("n").alias("pos"), mask.alias("mask")), 8)


_SET = "SELECT doc_id, lang, source, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS c, CASE WHEN len(toks) >= 5 THEN list_distinct([array_to_string(toks[i:i+4], ' ') for i in range(1, len(toks)-3)]) WHEN len(toks) > 0 THEN [array_to_string(toks, ' ')] ELSE [] END AS s FROM (SELECT doc_id, lang, source, text, regexp_extract_all(text, '{TOKEN}') AS toks FROM documents)"
_GUARDED = f"WITH d AS ({_SET}), a AS (SELECT * FROM d WHERE source NOT IN ('src1', 'src2')), b AS (SELECT * FROM d WHERE source IN ('src1', 'src2')), guarded AS (SELECT doc_id, max(rule) AS rule FROM (SELECT a.doc_id, 'whole' AS rule FROM a WHERE c IN (SELECT c FROM b) UNION ALL SELECT a.doc_id, 'near' FROM a JOIN b ON a.lang = b.lang AND least(len(a.s), len(b.s)) >= 0.9 * greatest(len(a.s), len(b.s)) WHERE len(list_intersect(a.s, b.s)) >= 0.9 * len(list_distinct(a.s || b.s))) GROUP BY doc_id)"


def _guarded(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.col("lang").alias("path"), "text", F.col("source").isin("src1", "src2").alias("test"))
    return C.split_guard(d.where("NOT test"), d.where("test"))


@query(_GUARDED + " SELECT * FROM guarded")
def held_out_guard(spark, sf):
    """Documents that copy one of two held-out sources, whole or, within a language, nearly."""
    return _guarded(spark, sf)


@query(_GUARDED + ", h AS (SELECT DISTINCT x.doc_id FROM documents x, (SELECT trim(regexp_replace(text, '\\s+', ' ', 'g')) AS needle FROM benchmark) b WHERE length(needle) >= 60 AND contains(trim(regexp_replace(x.text, '\\s+', ' ', 'g')), needle)), r AS (SELECT doc_id, CASE WHEN source IN ('src1', 'src2') THEN 'not_train_split' WHEN trim(text) = '' THEN 'no_reply' WHEN doc_id IN (SELECT doc_id FROM h) THEN 'leakage_bench' WHEN doc_id IN (SELECT doc_id FROM guarded) THEN 'leakage_test_split' WHEN length(text) > 8000 THEN 'reply_too_long' ELSE 'kept' END AS reason FROM documents) SELECT reason, count(*) AS documents FROM r GROUP BY 1")
def step_examples(spark, sf):
    """The reasons that keep a step's reply from becoming an example, in order."""
    from ..operators import dedup as D

    d = table(spark, sf, "documents")
    bench = D.substring_hits(d, table(spark, sf, "benchmark")).select("doc_id").distinct().withColumn("leaks", F.lit(True))
    # what the texts decide is decided before the joins, which then hold no texts
    short = d.select("doc_id", F.col("source").isin("src1", "src2").alias("held"), T.is_blank(F.col("text")).alias("blank"), (F.length("text") > 8000).alias("long"))
    rows = short.join(bench, "doc_id", "left").join(_guarded(spark, sf), "doc_id", "left")
    reason = (
        F.when(F.col("held"), "not_train_split")
        .when(F.col("blank"), "no_reply")
        .when(F.col("leaks"), "leakage_bench")
        .when(F.col("rule").isNotNull(), "leakage_test_split")
        .when(F.col("long"), "reply_too_long")
        .otherwise("kept")
    )
    return rows.groupBy(reason.alias("reason")).agg(F.count("*").alias("documents"))


@query(_GUARDED + " SELECT (SELECT count(*) FROM a) AS examples, count(*) AS leaks, min(doc_id) AS first_leak, count(*) = 0 AS clean FROM guarded")
def library_leaks(spark, sf):
    """Whether a library of examples is free of held-out replies."""
    found = _guarded(spark, sf).agg(F.count("*").alias("leaks"), F.min("doc_id").alias("first_leak"))
    every = table(spark, sf, "documents").where("source NOT IN ('src1', 'src2')").agg(F.count("*").alias("examples"))
    return every.join(F.broadcast(found)).withColumn("clean", F.col("leaks") == 0)


_TREES = "SELECT source, list(DISTINCT p ORDER BY NOT starts_with(p, 'en/'), p) AS ps FROM (SELECT source, lang || '/' || (doc_id % 40) AS p FROM documents) GROUP BY source"


@query(f"SELECT source, array_to_string([p || chr(10) for p in ps[1:12]], '') || CASE WHEN len(ps) > 12 THEN '... (' || (len(ps) - 12) || ' more files not shown)' || chr(10) ELSE '' END AS tree FROM ({_TREES})")
def project_trees(spark, sf):
    """Path lists with one folder first, cut after twelve."""
    path = F.concat("lang", F.lit("/"), (F.col("doc_id") % 40).cast("string"))
    d = table(spark, sf, "documents").groupBy("source").agg(F.collect_set(path).alias("ps"))
    return d.select("source", C.rendered_tree(C.tree_order(F.col("ps"), "^en/"), 12).alias("tree"))


@query("""WITH f AS (SELECT conv_id, turn, (length(text) // 10 + 1)::BIGINT AS n, role = 'assistant' AS written FROM conversations),
o AS (SELECT *, sum(n) OVER (PARTITION BY conv_id) AS total, row_number() OVER (PARTITION BY conv_id ORDER BY written, turn DESC) AS k, sum(n) OVER (PARTITION BY conv_id ORDER BY written, turn DESC) AS gone FROM f),
r AS (SELECT conv_id, 0 AS k, 60 - 10 - any_value(total) AS room FROM o GROUP BY 1 UNION ALL SELECT conv_id, k, 60 - 10 - total + gone FROM o),
b AS (SELECT conv_id, arg_min(room, k) AS room, min(k) AS files FROM r WHERE room >= 0 GROUP BY 1)
SELECT conv_id, files::INT AS files_dropped, CASE WHEN files IS NOT NULL THEN (SELECT count(*) FROM range(1, conv_id % 9 + 1) t(i) WHERE i * (i + 1) // 2 <= room)::INT END AS paths_shown, files IS NULL AS dropped FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN b USING (conv_id)""")
def fitted_prompts(spark, sf):
    """Prompts of at most 60 units: the path list is cut first, then whole files go."""
    one = F.struct("turn", F.floor(F.length("text") / 10 + 1).alias("n"), (F.col("role") == "assistant").alias("written"))
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(one)).alias("files"))
    paths = F.when(F.col("conv_id") % 9 > 0, F.transform(F.sequence(F.lit(1).cast("long"), F.col("conv_id") % 9), lambda i: i)).otherwise(F.array().cast("array<bigint>"))
    return C.fit_prompt(c.withColumn("fixed", F.lit(10)).withColumn("paths", paths), 60).select("conv_id", "files_dropped", "paths_shown", "dropped")

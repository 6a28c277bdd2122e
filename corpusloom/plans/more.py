"""Queries on shards and readers, counters, indexes that are patched, call-based problems and pre-tokenization."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import text as T
from ..operators import allocation as A
from ..operators import records as R
from ..operators import retrieval as V
from . import retrieval as Q
from .allocation import _DOCS, _sized
from .registry import query, table


@query("SELECT doc_id, (row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1) // 50 AS shard FROM documents")
def row_shards(spark, sf):
    """Shards of fifty rows by language."""
    rows = A.places_in(table(spark, sf, "documents").select("doc_id", "lang"), "lang", "doc_id")
    return rows.select("doc_id", F.floor((F.col("place") - 1) / 50).alias("shard"))


@query(f"WITH t AS (SELECT source, sum(n)::BIGINT AS total FROM ({_DOCS}) GROUP BY 1) SELECT source, total // 64 AS rows_held, total // 256 AS eval_batches, s AS step, (s * 256) % (total // 64 * 64) AS start, (s * 256) // (total // 64 * 64) AS wraps FROM t, range(0, 200, 40) r(s)")
def reader_positions(spark, sf):
    """Where a reader of batches of four rows of 64 tokens stands at some steps when it wraps, and how many whole batches there are when it does not."""
    t = _sized(spark, sf).groupBy("source").agg(F.sum("n_tokens").cast("long").alias("total"))
    rows = F.floor(F.col("total") / 64)
    t = t.select("source", rows.alias("rows_held"), F.floor(F.col("total") / 256).alias("eval_batches"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(160), F.lit(40))).alias("step"))
    held = F.col("rows_held") * 64
    return t.select("*", ((F.col("step") * 256) % held).alias("start"), F.floor(F.col("step") * 256 / held).alias("wraps"))


@query("SELECT source AS file, CASE WHEN n IS NULL THEN 'missing' WHEN m IS NULL THEN 'extra' WHEN m <> n THEN 'size' ELSE 'tokenizer' END AS problem FROM (SELECT 'src' || i AS source, 50 AS m, CASE WHEN i % 4 = 0 THEN 'b' ELSE 'a' END AS tok FROM range(2, 23) r(i)) FULL JOIN (SELECT source, count(*) AS n FROM documents GROUP BY 1) USING (source) WHERE n IS NULL OR m IS NULL OR m <> n OR tok <> 'a'")
def shard_view_problems(spark, sf):
    """A manifest of files, their sizes and tokenizer against what is held; a view is made only where nothing comes out."""
    listed = spark.range(2, 23).select(F.concat(F.lit("src"), F.col("id").cast("string")).alias("file"), F.lit(50).alias("m"), F.when(F.col("id") % 4 == 0, "b").otherwise("a").alias("tok"))
    held = table(spark, sf, "documents").groupBy(F.col("source").alias("file")).agg(F.count("*").alias("n"))
    problem = F.when(F.col("n").isNull(), "missing").when(F.col("m").isNull(), "extra").when(F.col("m") != F.col("n"), "size").when(F.col("tok") != "a", "tokenizer")
    return listed.join(held, "file", "full").select("file", problem.alias("problem")).where("problem IS NOT NULL")


@query("SELECT event_type AS name, 'u' || user_id % 5 AS sub, count(*) AS n FROM events GROUP BY 1, 2")
def counters_back(spark, sf):
    """Counters nested into one map a name, and flattened again from their keys name:sub."""
    counts = table(spark, sf, "events").groupBy("event_type", F.concat(F.lit("u"), (F.col("user_id") % 5).cast("string")).alias("k")).agg(F.count("*").alias("n"))
    nested = counts.groupBy("event_type").agg(F.map_from_entries(F.collect_list(F.struct(F.concat("event_type", F.lit(":"), "k"), "n"))).alias("m"))
    flat = nested.select(F.explode("m").alias("key", "n"))
    return flat.select(F.substring_index("key", ":", 1).alias("name"), F.substring_index("key", ":", -1).alias("sub"), "n")



@query("SELECT doc_id, CASE doc_id % 9 WHEN 0 THEN 'difficulty' WHEN 1 THEN 'class_solution' WHEN 2 THEN 'io_unreadable' WHEN 3 THEN 'not_call_based' WHEN 4 THEN 'case_count' WHEN 5 THEN 'io_shape' WHEN 6 THEN 'float_output' ELSE 'kept' END AS reason FROM documents")
def call_problems(spark, sf):
    """Call-based problems, one broken rule each; the sizes of the texts are the results that the cases ask for."""
    import json

    def reason(doc_id: int, size: int) -> str:
        k = doc_id % 9
        cases = [[[doc_id, j] for j in range(2 if k == 4 else 3)], [[size + 0.5] if k == 6 else [size, size] if k == 5 else [size]] * (2 if k == 4 else 3)]
        io = json.dumps({"fn_name": "len" if k == 3 else "solve", "inputs": cases[0], "outputs": cases[1]})
        row = {"difficulty": "interview" if k == 0 else "introductory", "starter_code": "class Solution:" if k == 1 else "", "input_output": io[:-4] if k == 2 else io}
        return R.call_problem(row)[1] or "kept"

    return table(spark, sf, "documents").select("doc_id", F.udf(reason, StringType())("doc_id", F.length("text")).alias("reason"))


@query("SELECT lang, sum(n_chars)::BIGINT AS chars, sum(n_chars) >= 300000 AS filled, bool_and(sum(n_chars) >= 300000) OVER () AS all_filled, CASE WHEN bool_and(sum(n_chars) >= 300000) OVER () THEN 0 ELSE 1 END AS exit_status FROM documents GROUP BY lang")
def preflight_status(spark, sf):
    """Whether every language can fill its quota, and the status to end with."""
    rows = table(spark, sf, "documents").groupBy("lang").agg(F.sum("n_chars").cast("long").alias("chars")).withColumn("filled", F.col("chars") >= 300_000)
    every = rows.agg(F.every("filled").alias("all_filled"))
    return rows.join(F.broadcast(every)).withColumn("exit_status", F.when(F.col("all_filled"), 0).otherwise(1))


@query("WITH t AS (SELECT doc_id, CASE WHEN doc_id % 50 = 7 THEN 'patched words of ' || source ELSE text END AS text FROM documents) SELECT term, count(*) AS df, sum(n)::BIGINT AS tf FROM (SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{TOKEN}')) AS term FROM t) GROUP BY 1, 2) GROUP BY 1")
def patched_index(spark, sf):
    """Document and term counts of an index in which some documents were replaced: the old counts, less those of the old texts, with those of the new."""

    def counts(docs, sign):
        each = docs.select("doc_id", F.explode(T.tokens(F.col("text"))).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("n"))
        return each.groupBy("term").agg((F.count("*") * sign).alias("df"), (F.sum("n") * sign).alias("tf"))

    d = table(spark, sf, "documents").select("doc_id", "text", "source")
    old = d.where("doc_id % 50 = 7")
    new = old.withColumn("text", F.concat(F.lit("patched words of "), "source"))
    rows = counts(d, 1).unionByName(counts(old, -1)).unionByName(counts(new, 1))
    return rows.groupBy("term").agg(F.sum("df").cast("long").alias("df"), F.sum("tf").cast("long").alias("tf")).where("df > 0")


@query("SELECT doc_id, (floor(n * 50 / 100.0)::INT // 256)::INT AS chunk, 1 AS rank, true AS hit FROM (SELECT doc_id, len(regexp_extract_all(text, '{TOKEN}')) AS n FROM documents)")
def needle_retrieval(spark, sf):
    """A word of its own planted half-way into every document, and looked for in the chunks of all of them."""
    d = table(spark, sf, "documents").select("doc_id", T.tokens(F.col("text")).alias("t"))
    needle = F.concat(F.lit("needle"), F.col("doc_id").cast("string"))
    d = d.select("doc_id", R.planted(F.col("t"), F.array(needle), F.lit(50)).alias("toks"))
    spans = d.select("doc_id", "toks", F.posexplode(F.sequence(F.lit(0), F.size("toks") - 1, F.lit(256))).alias("chunk", "start"))
    held = spans.select("doc_id", "chunk", F.slice("toks", F.col("start") + 1, 256).alias("toks"))
    found = V.bm25(held, d.select(F.col("doc_id").alias("query_id"), F.array(needle).alias("terms")), ["doc_id", "chunk"], 1)
    return found.select(F.col("query_id").alias("doc_id"), "chunk", "rank", (F.col("query_id") == F.col("doc_id")).alias("hit"))


_FILES = "(SELECT doc_id, text FROM (SELECT doc_id, text, row_number() OVER (PARTITION BY lang ORDER BY length(source), source, doc_id) AS nth FROM documents) WHERE nth <= 2000)"
_WHOLE = Q._BM25.replace("// 256", "// 1000000000").replace("+ 256", "+ 1000000000").replace("s+256", "s+1000000000").replace("len(t), 256", "len(t), 1000000000").replace("AS t FROM documents)", f"AS t FROM {_FILES})")


@query(_WHOLE + " SELECT query_id, doc_id, rank AS place FROM bm WHERE rank <= 2")
def commit_context(spark, sf):
    """For each benchmark text as a message, the two best files of at most 2000 candidates a language, the shallowest first."""
    from pyspark.sql import Window

    d = table(spark, sf, "documents")
    nth = F.row_number().over(Window.partitionBy("lang").orderBy(F.length("source"), "source", "doc_id"))
    files = d.select("doc_id", "text", nth.alias("nth")).where("nth <= 2000").drop("nth")
    ranked = V.bm25(V.chunks(files, 1_000_000_000), Q._queries(spark, sf), ["doc_id", "chunk"], 2)
    return ranked.select("query_id", "doc_id", F.col("rank").alias("place"))


#: Fixed value: the pre-tokenizer's pieces: a line end with its indent, runs of spaces, tabs, single digits, up to three Han or kana signs, words, marks.
PIECES = r"\n[ ]*|[ ]+|\t|\p{N}|[\x{3041}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}]{1,3}|[\p{L}\p{M}]+|[^\s\p{L}\p{M}\p{N}]+|\s"


@query(f"SELECT doc_id, len(p) AS pieces, len(list_filter(p, lambda x: trim(x, ' ' || chr(10)) = '')) AS blank, array_to_string(p, '') = text AS exact FROM (SELECT doc_id, text, regexp_extract_all(text, '{PIECES}') AS p FROM documents)")
def pre_tokens(spark, sf):
    """Texts in the pieces of a byte-level pre-tokenizer, which give them back."""
    d = table(spark, sf, "documents").select("doc_id", "text", F.regexp_extract_all("text", F.lit(PIECES), F.lit(0)).alias("p"))
    return d.select("doc_id", F.size("p").alias("pieces"), F.size(F.filter("p", lambda x: x.rlike(r"^[ \n]+$"))).alias("blank"), (F.array_join("p", "") == F.col("text")).alias("exact"))


_LANGUAGES = {"eng": "English", "deu": "German", "fra": "French", "spa": "Spanish", "zho": "Chinese (two scripts)"}


@query("SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v}', {str('scripts' in v).lower()})" for k, v in _LANGUAGES.items()) + ") t(code, label, by_script)")
def language_map_table(spark, sf):
    """The language map as a table for its documentation."""
    return spark.createDataFrame([(k, v, "scripts" in v) for k, v in _LANGUAGES.items()], "code string, label string, by_script boolean")

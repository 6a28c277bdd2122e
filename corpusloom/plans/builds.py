"""Queries on builds, their inputs and logs, and what surrounds them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import allocation as A
from ..operators import catalogue as K
from ..operators import records as R
from ..streaming import builds as B
from ..streaming import genlog as G
from . import allocation as P
from .registry import query, table
from .streams import _folder

_ALLOC = "WITH a AS (" + P._FILL.replace("{src}", f"SELECT source, share, unique_tokens::DOUBLE AS bound FROM ({P._SHARED})").replace("{total}", f"(SELECT sum(unique_tokens) * 9 // 10 FROM ({P._SHARED}))") + f"), b AS (SELECT m.*, a.alloc, floor(a.alloc + 1e-9) AS low FROM a JOIN ({P._SHARED}) m USING (source)), c AS (SELECT *, round_even(sum(alloc) OVER (), 0) - sum(low) OVER () AS lft FROM b) SELECT source, least(low + CASE WHEN row_number() OVER (ORDER BY round(alloc - low, 6) DESC, position) <= lft THEN 1 ELSE 0 END, unique_tokens)::BIGINT AS tokens, unique_tokens AS total FROM c"


def _ordered(spark, sf):
    return P._sized(spark, sf).select("source", F.col("doc_id").alias("ord"), "n_tokens")


@query(f"WITH t AS ({_ALLOC}), d AS (SELECT source, n, sum(n) OVER (PARTITION BY source ORDER BY doc_id) - n AS before FROM ({P._DOCS})) SELECT source, any_value(tokens) AS tokens, sum(n)::BIGINT AS unique_tokens, sum(n) = any_value(total) AS exhausted FROM d JOIN t USING (source) WHERE before < tokens GROUP BY source")
def build_rounds(spark, sf):
    """Nine tenths of all tokens by shares that some sources cannot give: built, allocated again and built on until nothing is missing."""
    shares = P._sources(spark, sf).select("source", "position", "share", F.lit("v1").alias("identity"))
    total = P._sources(spark, sf).agg(F.sum("unique_tokens")).first()[0] * 9 // 10
    folder = f"{_folder(spark)}/build"
    got = B.run_rounds(_ordered(spark, sf), shares, total, folder)
    return got.select("source", F.col("tokens").cast("long").alias("tokens"), "unique_tokens", "exhausted")


@query(f"WITH d AS (SELECT source, doc_id, n, sum(n) OVER (PARTITION BY source ORDER BY doc_id) - n AS before, sum(n) OVER (PARTITION BY source) AS total FROM ({P._DOCS})) SELECT source, max(doc_id) AS last_doc, count(*) AS documents, sum(n)::BIGINT AS tokens FROM d WHERE before < total * 2 // 3 GROUP BY source")
def resumed_build(spark, sf):
    """Builds to a third and then on to two thirds of each source, as one that stops and is taken up again."""
    rows, folder = _ordered(spark, sf), f"{_folder(spark)}/build"
    totals = rows.groupBy("source").agg(F.sum("n_tokens").alias("total"))
    for k in (1, 2):
        B.build(rows, totals.select("source", F.lit("v1").alias("identity"), F.floor(F.col("total") * k / 3).alias("target")), folder)
    return B.built(spark, folder).groupBy("source").agg(F.max("ord").alias("last_doc"), F.count("*").alias("documents"), F.sum("n_tokens").cast("long").alias("tokens"))


_LIVE = f"SELECT *, CASE WHEN exhausted THEN greatest(0, unique_tokens * 2 - consumed) ELSE unique_tokens - consumed END::DOUBLE AS most FROM ({P._STATES})"


@query(f"WITH s AS ({_LIVE}), l AS (SELECT min(most / share) AS level FROM s WHERE NOT exhausted) SELECT floor(sum(CASE WHEN exhausted THEN least(most, share * level) ELSE share * level END) + 1e-6)::BIGINT AS total FROM s, l")
def largest_chunk(spark, sf):
    """The largest mix that needs no further building."""
    return A.largest_feasible(P._states(spark, sf), 2)


def _log(spark, sf):
    """A log of answers: every seventh document is tried twice, every fifth still has none, and a last line is cut off."""
    at = f"{_folder(spark)}/log"
    d = table(spark, sf, "documents")
    one = F.struct(F.col("doc_id").cast("string").alias("id"), F.when(F.col("doc_id") % 5 != 0, F.concat(F.lit("r"), F.col("try").cast("string"), F.lit(" "), "source")).alias("response"), F.lit("t").alias("teacher"), F.lit("1").alias("revision"), F.lit("a").alias("tag"))
    for name, rows in (("0", d.withColumn("try", F.lit(0))), ("1", d.where("doc_id % 7 = 0").withColumn("try", F.lit(1)))):
        rows.select(F.to_json(one).alias("value")).coalesce(1).write.text(f"{at}/part={name}")
    spark.range(1).select(F.lit('{"id": "3", "resp').alias("value")).write.text(f"{at}/part=2")
    return G.read_log(spark, at), d


@query("SELECT doc_id::VARCHAR AS id, 1 + (doc_id % 7 = 0)::BIGINT AS tries FROM documents WHERE doc_id % 5 = 0")
def generation_todo(spark, sf):
    log, d = _log(spark, sf)
    return G.to_do(d.select(F.col("doc_id").cast("string").alias("id")), log)


@query("SELECT doc_id::VARCHAR AS id, CASE WHEN doc_id % 5 <> 0 THEN CASE WHEN doc_id % 7 = 0 THEN 'r1 ' ELSE 'r0 ' END || source END AS response FROM documents")
def last_answers(spark, sf):
    """The last answer of every id, in spite of a torn tail; one teacher wrote all that is kept."""
    log, d = _log(spark, sf)
    G.check_inputs("x", "x", 1.0, 2.0, d.select(F.col("doc_id").cast("string").alias("id"), F.lit(True).alias("kept")), log)
    return G.last_answers(log).select("id", "response")


@query("SELECT doc_id::VARCHAR AS id, 'a' AS tag, source AS prompt, 'r0 ' || source AS response FROM documents JOIN labels USING (doc_id) WHERE quality = 1 AND doc_id % 5 <> 0")
def kept_answers(spark, sf):
    """Kept verdicts (good labels) with the answer that each names and its prompt."""
    log, d = _log(spark, sf)
    verdicts = table(spark, sf, "labels").where("doc_id % 5 <> 0").select(F.col("doc_id").cast("string").alias("id"), (F.col("quality") == 1).alias("kept"), F.lit("a").alias("tag"))
    prompts = d.select(F.col("doc_id").cast("string").alias("id"), F.col("source").alias("prompt"))
    verdicts = verdicts.join(prompts.select("id"), "id", "left_semi")
    return G.kept_rows(verdicts, log, prompts).select("id", "tag", "prompt", "response")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'size' WHEN o_orderkey % 7 = 1 THEN 'etag' WHEN o_orderkey % 7 = 2 OR o_orderdate::DATE > DATE '1996-06-01' THEN 'late' WHEN o_orderkey % 7 = 3 THEN 'day' END AS problem FROM orders")
def pinned_sources(spark, sf):
    """Orders as served files: their dates as HTTP dates, against what was pinned."""
    i, day = F.col("o_orderkey") % 7, F.to_date("o_orderdate")
    stamp = F.when(i != 2, F.concat(F.date_format("o_orderdate", "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT")))
    served = F.struct(F.col("o_custkey").alias("size"), F.concat(F.lit("e"), F.col("o_custkey").cast("string")).alias("etag"), stamp.alias("last_modified"))
    pinned = F.struct((F.col("o_custkey") + F.when(i == 0, 1).otherwise(0)).alias("size"), F.when(i == 1, "other").alias("etag"), F.when(i == 3, F.date_add(day, 1)).otherwise(day).alias("day"))
    return table(spark, sf, "orders").select("o_orderkey", K.pinned_problem(served, pinned, F.to_date(F.lit("1996-06-01"))).alias("problem"))


@query("SELECT p_partkey, least(300, 5 * pow(2, p_size % 12)) AS wait, (400 + p_partkey % 200) < 500 AND (400 + p_partkey % 200) NOT IN (408, 429) AS permanent FROM part")
def retry_rules(spark, sf):
    return table(spark, sf, "part").select("p_partkey", K.retry_wait(1 + F.col("p_size") % 12).alias("wait"), K.is_permanent(400 + F.col("p_partkey") % 200).alias("permanent"))


_REPOS = "SELECT doc_id AS line, CASE doc_id % 6 WHEN 0 THEN '../' || source WHEN 1 THEN source || '/a b' WHEN 2 THEN 'Own/' || source ELSE lang || '/' || source END AS repo, CASE WHEN doc_id % 11 = 0 THEN 'java' ELSE 'flask' END AS tag, n_chars - 200 AS stars FROM documents"


@query(f"WITH r AS ({_REPOS}), f AS (SELECT *, min(line) OVER (PARTITION BY lower(repo)) AS f FROM r) SELECT line, CASE WHEN NOT regexp_matches(repo, '^[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+$') OR starts_with(repo, '../') THEN 'repo' WHEN tag <> 'flask' THEN 'tag' WHEN stars < 0 THEN 'stars' WHEN line > f THEN 'repeated' END AS problem FROM f")
def candidate_problems(spark, sf):
    i = F.col("doc_id") % 6
    repo = F.when(i == 0, F.concat(F.lit("../"), "source")).when(i == 1, F.concat("source", F.lit("/a b"))).when(i == 2, F.concat(F.lit("Own/"), "source")).otherwise(F.concat("lang", F.lit("/"), "source"))
    rows = table(spark, sf, "documents").select(F.col("doc_id").alias("line"), repo.alias("repo"), F.when(F.col("doc_id") % 11 == 0, "java").otherwise("flask").alias("tag"), (F.col("n_chars") - 200).alias("stars"))
    return K.candidate_problem(rows, ["flask", "react"]).select("line", "problem")


@query("WITH f AS (SELECT 'u' || user_id AS repo, CASE event_type WHEN 'click' THEN 'flask' ELSE 'react' END AS side, min(event_id) AS place, bool_or(value > 95) AS confirmed FROM events WHERE event_type IN ('click', 'purchase') AND value > 90 GROUP BY 1, 2), b AS (SELECT repo, count(*) AS sides, min(side) AS side, min(place) AS at_, bool_or(confirmed) AS confirmed FROM f GROUP BY 1), k AS (SELECT *, CASE WHEN sides > 1 THEN 0 WHEN confirmed THEN 1 ELSE 2 END AS kind FROM b), n AS (SELECT *, row_number() OVER (PARTITION BY kind, CASE kind WHEN 2 THEN side ELSE '' END ORDER BY at_, repo) AS nth FROM k) SELECT repo, CASE kind WHEN 2 THEN side ELSE 'full' END AS tag, place FROM (SELECT *, row_number() OVER (ORDER BY kind, nth, CASE kind WHEN 2 THEN side ELSE '' END)::INT AS place FROM n) WHERE place <= 100")
def candidate_selection(spark, sf):
    """Users as repositories that two searches found: on both sides first, then confirmed, then in turn; the first hundred."""
    e = table(spark, sf, "events").where("event_type IN ('click', 'purchase') AND value > 90")
    side = F.when(F.col("event_type") == "click", "flask").otherwise("react")
    found = e.groupBy(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("repo"), side.alias("side")).agg(F.min("event_id").alias("place"), F.some(F.col("value") > 95).alias("confirmed"))
    return K.select_candidates(found, 100)


@query("SELECT source, 'c' || doc_id AS sha, (doc_id % 3)::INT AS parents, lang || ': ' || n_chars AS message, 1 + (doc_id % 2 = 0)::INT AS files, n_chars AS added FROM documents")
def parsed_logs(spark, sf):
    """Logs of repositories, one a source, taken apart again."""
    sha = F.concat(F.lit("c"), F.col("doc_id").cast("string"))
    parents = F.array_join(F.array_repeat(F.lit("p"), (F.col("doc_id") % 3).cast("int")), " ")
    stat = F.concat(F.lit("\n\n"), F.col("n_chars").cast("string"), F.lit("\t2\tsrc/{old => new}/a.py\n"), F.when(F.col("doc_id") % 2 == 0, "-\t-\tlogo.png\n").otherwise(""))
    one = F.concat(F.lit(K.LOG_START), sha, F.lit(K.LOG_FIELD), parents, F.lit(K.LOG_FIELD), "lang", F.lit(": "), F.col("n_chars").cast("string"), F.lit("\n" + K.LOG_END), stat)
    raw = table(spark, sf, "documents").groupBy("source").agg(F.array_join(F.collect_list(one), "").alias("raw"))
    rows = raw.select("source", F.explode(K.parsed_log(F.col("raw"))).alias("c"))
    added = F.aggregate("c.changes", F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x["added"], F.lit(0)))
    right = F.get("c.changes", F.lit(0))["path"] == "src/new/a.py"
    return rows.select("source", "c.sha", "c.parents", "c.message", F.when(right, F.size("c.changes")).alias("files"), added.alias("added"))


@query("SELECT item_id, kind, count(*) AS texts, sum(length(t))::BIGINT AS chars FROM (SELECT item_id, 'needle' AS kind, unnest([p, text]) AS t FROM (SELECT item_id, text, 'def f():\n    \"\"\"' || text || '\"\"\"\n    x = ''''''' || 'doc' || '''''''\n    y = \"\"\"  \"\"\"' AS p FROM benchmark) UNION ALL SELECT item_id, 'grams', unnest(list_distinct([text, 'def f():\n    \"\"\"' || text || '\"\"\"\n    x = ''''''' || 'doc' || '''''''\n    y = \"\"\"  \"\"\"', text, 'doc'])) FROM benchmark) GROUP BY 1, 2")
def problem_needles(spark, sf):
    """Benchmark texts as solutions, and prompts that quote them: a docstring that repeats the solution counts once."""
    prompt = F.concat(F.lit('def f():\n    """'), "text", F.lit('"""\n    x = \'\'\'doc\'\'\'\n    y = """  """'))
    rows = table(spark, sf, "benchmark").select("item_id", prompt.alias("prompt"), "text")
    return K.problem_needles(rows, "item_id", "prompt", "text").groupBy("item_id", "kind").agg(F.count("*").alias("texts"), F.sum(F.length("text")).cast("long").alias("chars"))


@query("SELECT conv_id, CASE conv_id % 3 WHEN 0 THEN 'backend/models.py,backend/app.py' WHEN 1 THEN 'backend/app.py,backend/tests/t.py,backend/b.py,frontend/src/api.js,frontend/src/App.jsx,README.md' ELSE '' END AS paths FROM (SELECT DISTINCT conv_id FROM conversations)")
def context_files(spark, sf):
    files = F.array(*map(F.lit, ("README.md", "frontend/src/App.jsx", "backend/b.py", "backend/tests/t.py", "backend/app.py", "backend/models.py", "frontend/src/api.js")))
    i = F.col("conv_id") % 3
    wanted = F.when(i == 0, F.array(F.lit("backend/app.py"), F.lit("backend/models.py"), F.lit("gone.py"))).when(i == 1, F.array_except(files, F.array(F.lit("backend/models.py")))).otherwise(F.array().cast("array<string>"))
    c = table(spark, sf, "conversations").select("conv_id").distinct()
    return c.select("conv_id", F.array_join(K.context_paths(files, wanted), ",").alias("paths"))


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true ELSE false END AS full_stack FROM documents")
def manifest_dependencies(spark, sf):
    """Which manifests depend on one of the two libraries."""
    i = F.col("doc_id") % 4
    name = F.when(i < 2, "requirements.txt").otherwise("web/package.json")
    content = F.when(i == 0, F.concat("source", F.lit("\nFlask>=2\n"))).when(i == 1, "flask-cors==1\nsourceflask\n").when(i == 2, '{"devDependencies": {"react": "18"}}').otherwise('{"scripts": {"react": "18"}}')
    return table(spark, sf, "documents").select("doc_id", (K.has_flask(name, content) | F.coalesce(K.has_react(name, content), F.lit(False))).alias("full_stack"))


@query("SELECT user_id, CASE WHEN user_id % 4 = 0 THEN 's' || user_id END AS session FROM (SELECT DISTINCT user_id FROM events)")
def signed_passes(spark, sf):
    """Passes of users: genuine ones, forged ones, ones that ran out and ones that are cut off."""
    sign = K.signer(b"key")
    i, sid = F.col("user_id") % 4, F.concat(F.lit("s"), F.col("user_id").cast("string"))
    body = F.concat(sid, F.lit("."), F.when(i == 2, 10).otherwise(1000).cast("string"))
    value = F.when(i == 3, body).otherwise(F.concat(body, F.lit("."), F.when(i == 1, F.lit("0" * 64)).otherwise(sign(body))))
    users = table(spark, sf, "events").select("user_id").distinct()
    return users.select("user_id", K.checked_pass(value, F.lit(500), sign).alias("session"))


@query("SELECT doc_id, doc_id % 3 <> 1 AS same FROM documents")
def same_code(spark, sf):
    """Texts against themselves with other line ends and blank lines, or with one more line."""
    i = F.col("doc_id") % 3
    other = F.when(i == 0, F.concat(F.replace("text", F.lit("\n"), F.lit("  \r\n\n")), F.lit(" \n"))).when(i == 1, F.concat("text", F.lit("\nx"))).otherwise(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", K.same_code(F.col("text"), other).alias("same"))


@query("SELECT source, count(*) AS paths, count_if(doc_id % 4 < 2) AS environment FROM documents GROUP BY 1")
def environment_files(spark, sf):
    path = F.element_at(F.array(F.lit("a/.env"), F.lit(".env.local/x"), F.lit("src/env.py"), F.lit("a/x.env")), (F.col("doc_id") % 4 + 1).cast("int"))
    return table(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("paths"), F.count_if(R.is_env_path(path)).alias("environment"))


@query("SELECT source, count(*) AS sampled, count(DISTINCT lang) AS languages FROM documents d WHERE doc_id NOT IN (SELECT doc_id FROM labels) AND text NOT IN (SELECT text FROM documents JOIN labels USING (doc_id)) GROUP BY source")
def held_out_sample(spark, sf):
    """Documents that may be held out: neither themselves nor a copy of theirs is among the labelled ones."""
    d = table(spark, sf, "documents").withColumn("h", F.sha2("text", 256))
    used = d.join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi").select("h").distinct()
    free = d.join(table(spark, sf, "labels"), "doc_id", "left_anti").join(used, "h", "left_anti")
    return free.groupBy("source").agg(F.count("*").alias("sampled"), F.count_distinct("lang").alias("languages"))

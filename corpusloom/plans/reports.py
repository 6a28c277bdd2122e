"""Queries that report on verdicts, benchmark runs, tokenizers, sources and checkpoints."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import reports as R
from .registry import query, table


@query("WITH k AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, length(text) % 7 <> 0 AS ok FROM conversations), l AS (SELECT conv_id, coalesce(min(CASE WHEN NOT ok THEN k END), max(k) + 1) - 1 AS lead_ok, max(k) AS turns FROM k GROUP BY 1) SELECT CASE WHEN lead_ok = turns THEN 'max_turns' WHEN lead_ok = 0 THEN 'no_turn' ELSE 'failed_turn' END AS stop, count(*) AS chains, count_if(lead_ok >= 2) AS kept, count_if(lead_ok >= 3) AS kept_3, count_if(lead_ok < turns) AS cut FROM l GROUP BY 1")
def chain_verdicts(spark, sf):
    """Conversations as chains of turns that hold up to the first that fails."""
    c = R.leading_ok(table(spark, sf, "conversations"), "conv_id", "turn", F.length("text") % 7 != 0)
    stop = F.when(F.col("leading") == F.col("turns"), "max_turns").when(F.col("leading") == 0, "no_turn").otherwise("failed_turn")
    return c.groupBy(stop.alias("stop")).agg(F.count("*").alias("chains"), F.count_if(F.col("leading") >= 2).alias("kept"), F.count_if(F.col("leading") >= 3).alias("kept_3"), F.count_if(F.col("leading") < F.col("turns")).alias("cut"))


_GUESS = "CASE WHEN regexp_matches(text, '[äöüß]') THEN 'de' WHEN regexp_matches(text, '[ñ¿¡]') THEN 'es' WHEN regexp_matches(text, '[éèêàç]') THEN 'fr' ELSE 'en' END"


@query(f"WITH g AS (SELECT lang, {_GUESS} AS label FROM documents), n AS (SELECT lang, label, count(*) AS n, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, label) AS nth FROM g WHERE label <> lang GROUP BY 1, 2) SELECT t.lang, offers, dropped, as_labels, dropped > 0.4 * offers AS warning FROM (SELECT lang, count(*) AS offers, count_if(label <> lang) AS dropped FROM g GROUP BY 1) t LEFT JOIN (SELECT lang, string_agg(label || ' ' || n, ', ' ORDER BY nth) AS as_labels FROM n WHERE nth <= 3 GROUP BY 1) USING (lang)")
def language_warnings(spark, sf):
    """Languages of which a rule by letters would drop more than two fifths, and the labels it gives instead."""
    guess = F.when(F.col("text").rlike("[äöüß]"), "de").when(F.col("text").rlike("[ñ¿¡]"), "es").when(F.col("text").rlike("[éèêàç]"), "fr").otherwise("en")
    return R.mislabels(table(spark, sf, "documents").select("lang", guess.alias("label")), "lang", F.col("label"), 0.4)


_STEPS = "SELECT o_orderkey AS app, l_linenumber AS step, l_returnflag <> 'R' AS passed, (1 + l_partkey % 4)::INT AS attempts, CASE WHEN l_partkey % 5 = 0 THEN ['model_error', 'tests_failed'] WHEN l_partkey % 3 = 0 THEN ['tests_failed'] ELSE []::VARCHAR[] END AS kinds, o_orderstatus <> 'F' AS accepted, round(l_quantity, 2) AS seconds FROM lineitem JOIN orders ON l_orderkey = o_orderkey"


def _steps(spark, sf):
    """Orders as apps and their lines as steps."""
    i = F.col("l_partkey")
    kinds = F.when(i % 5 == 0, F.array(F.lit("model_error"), F.lit("tests_failed"))).when(i % 3 == 0, F.array(F.lit("tests_failed"))).otherwise(F.array().cast("array<string>"))
    rows = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.select(F.col("o_orderkey").alias("app"), F.col("l_linenumber").alias("step"), (F.col("l_returnflag") != "R").alias("passed"), (1 + i % 4).cast("int").alias("attempts"), kinds.alias("kinds"), (F.col("o_orderstatus") != "F").alias("accepted"), F.round("l_quantity", 2).alias("seconds"))


@query(f"WITH s AS ({_STEPS}), a AS (SELECT app, bool_and(passed) AS completed, bool_and(passed AND accepted) AS ful, min(step) FILTER (NOT passed) AS failed, sum(seconds) AS seconds FROM s GROUP BY 1), p AS (SELECT CASE WHEN failed IS NOT NULL THEN 'step ' || failed WHEN NOT ful THEN 'acceptance' END AS stop, count(*) AS n FROM a GROUP BY 1) SELECT (SELECT count(*) FROM a) AS apps, (SELECT count_if(ful) FROM a) AS apps_passed, (SELECT count_if(completed) FROM a) AS apps_completed, (SELECT round(sum(seconds), 3) FROM a) AS seconds, count_if(passed) AS steps_passed, count_if(passed AND attempts = 1) AS first_try, count_if(attempts >= 1) AS reached, round(count_if(passed AND attempts = 1) / count_if(attempts >= 1)::DOUBLE, 6) AS first_of_reached, round(sum(CASE WHEN passed THEN attempts - 1 END) / count_if(passed)::DOUBLE, 6) AS mean_retries, count_if(NOT passed AND attempts >= 4) AS exhausted, sum(len(list_filter(kinds, lambda k: k IN ('model_error', 'prompt_too_long'))))::BIGINT AS infra_attempts, (SELECT string_agg(stop || ': ' || n, ', ' ORDER BY stop) FROM p WHERE stop IS NOT NULL) AS stops FROM s")
def benchmark_totals(spark, sf):
    return R.benchmark_totals(_steps(spark, sf), 3, ["model_error", "prompt_too_long"])


@query(f"WITH s AS ({_STEPS}) SELECT step, kind, coalesce(n, 0) AS n FROM (SELECT * FROM (SELECT DISTINCT step FROM s WHERE len(kinds) > 0), (SELECT unnest(['model_error', 'tests_failed', 'timeout']) AS kind)) LEFT JOIN (SELECT step, unnest(kinds) AS kind, count(*) AS n FROM s GROUP BY 1, 2) USING (step, kind)")
def failure_kinds(spark, sf):
    """Every kind of failure by step, those without a case too."""
    each = _steps(spark, sf).select("step", F.explode("kinds").alias("kind"))
    counts = each.groupBy("step", "kind").agg(F.count("*").alias("c"))  # counts instead of cases are gathered
    every = each.select("step").distinct().withColumn("kind", F.explode(F.array(*map(F.lit, ("model_error", "tests_failed", "timeout")))))
    return every.join(counts, ["step", "kind"], "left").select("step", "kind", F.coalesce("c", F.lit(0).cast("long")).alias("n"))


@query("SELECT lang, count(*) AS documents, round(sum(length(text)) / sum(len(t))::DOUBLE, 6) AS chars_per_token, round(sum(len(list_filter(t, lambda x: regexp_full_match(x, '\\s+')))) / sum(len(t))::DOUBLE, 6) AS blank_share, count_if(array_to_string(t, '') <> text) AS failures FROM (SELECT lang, text, regexp_extract_all(text, '[\\p{L}\\p{M}\\p{N}_]+|[^\\p{L}\\p{M}\\p{N}_\\s]|\\s+') AS t FROM documents) GROUP BY lang")
def tokenizer_quality(spark, sf):
    """A tokenizer of words, signs and white space measured on every text: size of tokens, blank ones, and whether they give the text back."""
    t = F.regexp_extract_all("text", F.lit(T.TOKEN + r"|\s+"), F.lit(0))
    d = table(spark, sf, "documents").select("lang", "text", t.alias("t"))
    d = d.select("lang", F.length("text").alias("chars"), F.size("t").alias("tokens"), F.size(F.filter("t", lambda x: x.rlike(r"^\s+$"))).alias("blank_tokens"), (F.array_join("t", "") == F.col("text")).alias("exact"))
    return R.tokenizer_quality(d, "lang")


@query("WITH q AS (SELECT lang, sum(length(text)) / sum(len(t))::DOUBLE AS cpt, sum(len(list_filter(t, lambda x: x = ' '))) / sum(len(t))::DOUBLE AS blank FROM (SELECT lang, text, regexp_extract_all(text, '[\\p{L}\\p{M}\\p{N}_]+|[^\\p{L}\\p{M}\\p{N}_\\s]|\\s+') AS t FROM documents) GROUP BY lang), b AS (SELECT lang, sum(length(text)) / sum(len(w))::DOUBLE AS cpt FROM (SELECT lang, text, regexp_extract_all(text, '.{1,3}') AS w FROM documents) GROUP BY lang) SELECT lang, round(q.cpt / b.cpt, 6) AS ratio, q.cpt > b.cpt AS passed FROM q JOIN b USING (lang)")
def tokenizer_verdicts(spark, sf):
    """The same tokenizer against a baseline that cuts lines into threes: whether it needs fewer tokens in each language."""
    d = table(spark, sf, "documents").select("lang", F.length("text").alias("chars"), F.size(F.regexp_extract_all("text", F.lit(T.TOKEN + r"|\s+"), F.lit(0))).alias("own"), F.size(F.regexp_extract_all("text", F.lit(".{1,3}"), F.lit(0))).alias("base"))
    rows = d.groupBy("lang").agg((F.sum("chars") / F.sum("own")).alias("a"), (F.sum("chars") / F.sum("base")).alias("b"))
    return rows.select("lang", F.round(F.col("a") / F.col("b"), 6).alias("ratio"), (F.col("a") > F.col("b")).alias("passed"))


_RUNS = "SELECT item_id, CASE item_id % 4 WHEN 0 THEN '{\"run_id\": \"r' || item_id || '\", \"status\": \"done\", \"planned\": 100, \"steps\": [{\"step\": 1, \"loss\": 2.5, \"tokens\": 10}, {\"step\": ' || item_id || ', \"loss\": 1.5, \"tokens\": ' || (item_id * 10) || '}], \"evals\": [], \"resumes\": [3]}' WHEN 1 THEN '{\"run_id\": 5, \"steps\": \"none\"}' WHEN 2 THEN '{\"run_id\": \"cut' ELSE '{\"steps\": []}' END AS content FROM benchmark"


@query("SELECT CASE item_id % 4 WHEN 0 THEN 'r' || item_id ELSE 'f' || item_id END AS run, CASE item_id % 4 WHEN 0 THEN 'done' WHEN 1 THEN 'malformed' WHEN 2 THEN 'unreadable' ELSE '?' END AS status, CASE item_id % 4 WHEN 0 THEN item_id WHEN 3 THEN 0 END AS step, CASE WHEN item_id % 4 = 0 THEN 100 END AS planned, CASE WHEN item_id % 4 = 0 THEN 1.5::DOUBLE END AS train_loss, NULL::DOUBLE AS val_loss, CASE WHEN item_id % 4 = 0 THEN item_id * 10 END AS tokens, CASE item_id % 4 WHEN 0 THEN 1 WHEN 3 THEN 0 END AS resumes FROM benchmark")
def run_table(spark, sf):
    """One row a run file: whole, malformed, cut off, or without steps yet."""
    i = F.col("item_id")
    s = i.cast("string")
    whole = F.concat(F.lit('{"run_id": "r'), s, F.lit('", "status": "done", "planned": 100, "steps": [{"step": 1, "loss": 2.5, "tokens": 10}, {"step": '), s, F.lit(', "loss": 1.5, "tokens": '), (i * 10).cast("string"), F.lit('}], "evals": [], "resumes": [3]}'))
    content = F.when(i % 4 == 0, whole).when(i % 4 == 1, '{"run_id": 5, "steps": "none"}').when(i % 4 == 2, '{"run_id": "cut').otherwise('{"steps": []}')
    return R.run_table(table(spark, sf, "benchmark").select(F.concat(F.lit("f"), s).alias("name"), content.alias("content")))


@query("SELECT user_id, event_id FROM events e LEFT JOIN (SELECT user_id, min(event_id) AS upto FROM events WHERE event_type = 'purchase' GROUP BY 1) p USING (user_id) WHERE upto IS NULL OR event_id <= upto")
def truncated_history(spark, sf):
    """Each user's events up to the first purchase."""
    e = table(spark, sf, "events").select("user_id", "event_id", "event_type")
    upto = e.where("event_type = 'purchase'").groupBy("user_id").agg(F.min("event_id").alias("upto"))
    return R.truncated(e.drop("event_type"), "user_id", "event_id", upto)


@query("SELECT steps, (SELECT arg_max(d, {'r': least(d / 250.0::DOUBLE, 250.0::DOUBLE / d), 'd': d}) FROM range(1, steps + 1) t(d) WHERE steps % d = 0 AND steps // d <= 40) AS every_steps FROM (SELECT DISTINCT 10 + (n_chars % 3000) AS steps FROM documents)")
def eval_cadence(spark, sf):
    """For every run length the spacing of evaluations that ends on its last step."""
    every = F.udf(lambda s: R.aligned_every(s, 250, 40), "long")
    return table(spark, sf, "documents").select((10 + F.col("n_chars") % 3000).alias("steps")).distinct().select("steps", every("steps").alias("every_steps"))


@query("SELECT o_orderkey, list_sort(list_distinct(list_filter([greatest(5, greatest(1, round_even(m * (20 + o_custkey % 50) / 100.0, 0)::BIGINT)) for m in [1, 10, 25, 50, 75, 90, 100]], lambda v: v < 20 + o_custkey % 50))) AS milestones FROM orders")
def rescaled_milestones(spark, sf):
    new = (20 + F.col("o_custkey") % 50).cast("long")
    milestones = F.array(*[F.lit(m).cast("long") for m in (1, 10, 25, 50, 75, 90, 100)])
    return table(spark, sf, "orders").select("o_orderkey", R.rescaled(milestones, F.lit(100), new, 5).alias("milestones"))


@query("WITH r AS (SELECT o_custkey, list(o_totalprice) FILTER (o_orderstatus = 'O') AS rates, sum(o_totalprice) AS spent, bool_or(o_orderstatus = 'F') AS resumed FROM orders GROUP BY 1) SELECT o_custkey, round(s, 6) AS seconds, spent + s / 3600 * 2.5 + 1 <= 500000 AS allowed FROM (SELECT *, CASE WHEN len(rates) > 0 THEN 1e6 / list_min(rates) + CASE WHEN resumed THEN 300.0 ELSE 0.0 END ELSE 1e6 / 50000.0 + 300.0 END AS s FROM r)")
def spend_guard(spark, sf):
    """Seconds by the slowest measured rate, and whether the cost still fits a budget with its reserve."""
    r = table(spark, sf, "orders").groupBy("o_custkey").agg(F.collect_list(F.when(F.col("o_orderstatus") == "O", F.col("o_totalprice"))).alias("rates"), F.sum("o_totalprice").alias("spent"), F.some(F.col("o_orderstatus") == "F").alias("resumed"))
    r = r.withColumn("s", R.estimated_seconds(F.lit(1e6), F.col("rates"), 50_000.0, 300.0, F.col("resumed")))
    return r.select("o_custkey", F.round("s", 6).alias("seconds"), (F.col("spent") + F.col("s") / 3600 * 2.5 + 1 <= 500_000).alias("allowed"))


@query("WITH r AS (SELECT o_orderpriority AS config, round(sum(o_totalprice), 6) AS total, round(median(o_totalprice), 6) AS median, min(o_totalprice) AS loss FROM orders GROUP BY 1) SELECT config, total, median, round(loss, 6) AS loss, config = (SELECT arg_min(config, {'l': loss, 'c': config}) FROM r) AS is_best FROM r")
def run_medians(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("config"), "o_totalprice")
    return R.run_medians(o, "config", "o_totalprice", "o_totalprice")


@query("SELECT CASE WHEN final THEN 'final' ELSE 'step_' || lpad(step::VARCHAR, 6, '0') END AS label, step, path FROM (SELECT item_id * 10 AS step, 'm/' || item_id AS path, false AS final FROM benchmark UNION ALL SELECT max(item_id) * 10, 'latest', true FROM benchmark HAVING max(item_id) % 2 = 0)")
def checkpoint_list(spark, sf):
    """Milestones by step, and the final checkpoint if its content is another than that of the last one (which odd ends copy)."""
    b = table(spark, sf, "benchmark")
    m = b.select(F.concat(F.lit("m/"), F.col("item_id").cast("string")).alias("path"), (F.col("item_id") * 10).alias("step"), F.sha2(F.col("item_id").cast("string"), 256).alias("digest"), F.lit(False).alias("final"))
    last = b.agg(F.max("item_id").alias("i")).select(F.lit("latest").alias("path"), (F.col("i") * 10).alias("step"), F.sha2(F.when(F.col("i") % 2 == 1, F.col("i").cast("string")).otherwise("other"), 256).alias("digest"), F.lit(True).alias("final"))
    return R.checkpoints(m.unionByName(last))


@query("SELECT count(*) AS documents, sha256(string_agg(octet_length(encode(text)) || ':' || sha256(text), '|' ORDER BY item_id)) AS digest FROM benchmark")
def sample_digest(spark, sf):
    return R.ordered_digest(table(spark, sf, "benchmark"), "item_id", "text")


@query("SELECT d.source, count(*) AS documents, sum(n_chars)::BIGINT AS unique_chars, (sum(n_chars) * 3 // 2)::BIGINT AS consumed, 1.5::DOUBLE AS epochs, count(quality) AS labelled, count_if(quality = 1) AS good, count(DISTINCT lang) AS languages, arg_max(lang, {'n': k, 'l': lang}) AS main_language FROM (SELECT *, count(*) OVER (PARTITION BY source, lang) AS k FROM documents) d LEFT JOIN labels l USING (doc_id) GROUP BY d.source")
def source_manifest(spark, sf):
    """Per source what there is, what was used of it, how often, and who it comes from."""
    d = table(spark, sf, "documents").select("doc_id", "source", "lang", "n_chars").join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    by = d.groupBy("source", "lang").agg(F.count("*").alias("k"), F.sum("n_chars").alias("chars"), F.count("quality").alias("labelled"), F.count_if(F.col("quality") == 1).alias("good"))
    chars = F.sum("chars").cast("long")
    rows = by.groupBy("source").agg(F.sum("k").alias("documents"), chars.alias("unique_chars"), F.floor(F.sum("chars") * 3 / 2).cast("long").alias("consumed"), F.sum("labelled").alias("labelled"), F.sum("good").alias("good"), F.count("*").alias("languages"), F.max_by("lang", F.struct("k", "lang")).alias("main_language"))
    return rows.withColumn("epochs", F.lit(1.5))


@query("WITH r AS (SELECT source, CASE WHEN n_chars < 300 THEN 'short' WHEN lang = 'es' THEN 'language' WHEN n_chars > 9000 THEN 'long' END AS reason FROM documents), t AS (SELECT source, count(*) AS before, count_if(reason IS NULL) AS after FROM r GROUP BY 1) SELECT 'reason' AS part, k AS name, coalesce(n, 0) AS before, NULL::BIGINT AS after FROM (SELECT unnest(['short', 'language', 'long', 'secret']) AS k) LEFT JOIN (SELECT reason AS k, count(*) AS n FROM r GROUP BY 1) USING (k) UNION ALL SELECT 'source', source, before, after::BIGINT FROM (SELECT *, row_number() OVER (ORDER BY before DESC, source) AS nth FROM t) WHERE nth <= 10")
def build_report(spark, sf):
    """Drops by reason with those that had none, and the ten largest sources before and after."""
    reason = F.when(F.col("n_chars") < 300, "short").when(F.col("lang") == "es", "language").when(F.col("n_chars") > 9000, "long")
    r = table(spark, sf, "documents").select("source", reason.alias("reason"))
    names = spark.createDataFrame([(k,) for k in ("short", "language", "long", "secret")], "name string")
    drops = names.join(r.groupBy(F.col("reason").alias("name")).agg(F.count("*").alias("before")), "name", "left")
    top = r.groupBy(F.col("source").alias("name")).agg(F.count("*").alias("before"), F.count_if(F.col("reason").isNull()).alias("after")).orderBy(F.desc("before"), "name").limit(10)
    first = drops.select(F.lit("reason").alias("part"), "name", F.coalesce("before", F.lit(0).cast("long")).alias("before"), F.lit(None).cast("long").alias("after"))
    return first.unionByName(top.select(F.lit("source").alias("part"), "name", "before", "after"))


@query("SELECT name, score, cited FROM (SELECT 'user' || user_id AS name, round(avg(value), 4)::VARCHAR AS score, false AS cited FROM events GROUP BY user_id UNION ALL SELECT n_name, 'not measured', true FROM nation)")
def results_with_cited(spark, sf):
    """Measured rows and cited ones in one table; what was not measured says so."""
    # as the SQL rounds doubles and writes them: the scaled double is rounded, and small numbers have no exponent
    own = table(spark, sf, "events").groupBy("user_id").agg((F.round(F.avg("value") * 10000) / 10000).alias("s"))
    rows = own.select(F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("name"), F.col("s"), F.lit(False).alias("cited"))
    cited = table(spark, sf, "nation").select(F.col("n_name").alias("name"), F.lit(None).cast("double").alias("s"), F.lit(True).alias("cited"))
    plain = F.regexp_replace(F.col("s").cast("decimal(30,4)").cast("string"), "0{1,3}$", "")
    score = F.when(F.abs("s") < 1e15, plain).otherwise(F.col("s").cast("string"))
    return rows.unionByName(cited).select("name", F.coalesce(score, F.lit("not measured")).alias("score"), "cited")


@query("SELECT lang, coalesce(max(CASE WHEN q = 1 THEN n END)::VARCHAR, 'not measured') AS good, coalesce(max(CASE WHEN q = 0 THEN n END)::VARCHAR, 'not measured') AS poor, coalesce(max(CASE WHEN q IS NULL THEN n END)::VARCHAR, 'not measured') AS unknown FROM (SELECT lang, quality AS q, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1, 2) GROUP BY lang")
def card_pivot(spark, sf):
    """Kept, dropped and unsure by language as columns."""
    d = table(spark, sf, "documents").select("doc_id", "lang").join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    kind = F.when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "poor").otherwise("unknown")
    p = d.withColumn("kind", kind).groupBy("lang").pivot("kind", ["good", "poor", "unknown"]).count()
    return p.select("lang", *[F.coalesce(F.col(c).cast("string"), F.lit("not measured")).alias(c) for c in ("good", "poor", "unknown")])


@query("SELECT lang, round(avg(b), 6) AS mean_bytes, round(3.2 / (ln(2) * avg(b)), 6) AS bits_per_byte FROM (SELECT lang, octet_length(encode(w)) AS b FROM (SELECT lang, unnest(regexp_extract_all(text, '{TOKEN}')) AS w FROM documents)) GROUP BY lang")
def mean_token_bytes(spark, sf):
    """Mean bytes of a token over all texts, and a loss of 3.2 a token in bits a byte."""
    d = table(spark, sf, "documents").select("lang", T.tokens(F.col("text")).alias("t"))
    bytes_ = F.aggregate("t", F.lit(0).cast("long"), lambda a, w: a + F.octet_length(w))
    mean = F.sum("b") / F.sum("n")
    return d.select("lang", bytes_.alias("b"), F.size("t").alias("n")).groupBy("lang").agg(F.round(mean, 6).alias("mean_bytes"), F.round(F.lit(3.2) / (F.log(F.lit(2.0)) * mean), 6).alias("bits_per_byte"))


@query("SELECT k AS rank_no, sha256(string_agg(event_id::VARCHAR, ',' ORDER BY event_id)) AS digest FROM (SELECT event_id % 8 AS k, event_id FROM events WHERE event_id < 4096) GROUP BY 1")
def rank_digests(spark, sf):
    """The digest of each of eight ranks' share of one batch of 4096, so that equal data show."""
    e = table(spark, sf, "events").where("event_id < 4096").groupBy((F.col("event_id") % 8).alias("rank_no")).agg(F.array_sort(F.collect_list("event_id")).alias("ids"))
    return e.select("rank_no", F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("digest"))

"""Queries on budgets, quotas, shards and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import allocation as A
from ..operators import mixing as M
from .registry import query, table

_TOKENS = "len(regexp_extract_all(text, '{TOKEN}')) + 1"
_SOURCES = f"SELECT source, substr(source, 4)::INT AS position, CASE WHEN substr(source, 4)::INT % 2 = 0 THEN 'even' ELSE 'odd' END AS slice, 1.0 + substr(source, 4)::INT % 5 AS weight, sum({_TOKENS})::BIGINT AS unique_tokens FROM documents GROUP BY source"
_SHARED = f"SELECT *, weight / sum(weight) OVER (PARTITION BY slice) * CASE slice WHEN 'even' THEN 60 ELSE 40 END / 100 AS share FROM ({_SOURCES})"


def _sources(spark, sf):
    """One row a source with a made-up configuration and its measured tokens."""
    d = table(spark, sf, "documents").select("source", (F.size(T.tokens(F.col("text"))) + 1).alias("n"))
    rows = d.groupBy("source").agg(F.sum("n").cast("long").alias("unique_tokens"))
    rows = rows.withColumn("position", F.substring("source", 4, 9).cast("int"))
    rows = rows.withColumn("slice", F.when(F.col("position") % 2 == 0, "even").otherwise("odd")).withColumn("weight", 1.0 + F.col("position") % 5)
    return A.resolve_shares(rows.withColumn("slice_percent", F.when(F.col("slice") == "even", 60).otherwise(40)))


@query(f"SELECT source, slice, round(share, 9) AS share FROM ({_SHARED})")
def share_resolution(spark, sf):
    return _sources(spark, sf).select("source", "slice", F.round("share", 9).alias("share"))


@query(f"SELECT source, round(share / sum(share) OVER (), 9) AS share FROM ({_SHARED}) WHERE position < 7")
def share_subset(spark, sf):
    return A.renormalise(_sources(spark, sf), F.col("position") < 7).select("source", F.round("share", 9).alias("share"))


#: Water-filling round by round, as plain SQL: fix what is over its bound, share the rest again.
_FILL = """WITH RECURSIVE s AS ({src}), r(k, source, share, bound, alloc, fixed, lft) AS (
 SELECT 0, source, share, bound, 0.0::DOUBLE, false, {total}::DOUBLE FROM s
 UNION ALL
 SELECT k + 1, source, share, bound, CASE WHEN fixed THEN alloc WHEN lft * share / w > bound THEN bound ELSE lft * share / w END, fixed OR lft * share / w > bound,
  {total}::DOUBLE - sum(CASE WHEN fixed THEN alloc WHEN lft * share / w > bound THEN bound ELSE 0 END) OVER ()
 FROM (SELECT *, sum(CASE WHEN fixed THEN 0 ELSE share END) OVER () AS w FROM r) WHERE k < 25)
SELECT source, alloc FROM r WHERE k = 25"""


@query("SELECT source, round(alloc, 4) AS alloc FROM (" + _FILL.replace("{src}", f"SELECT source, share, unique_tokens::DOUBLE * (0.4 + position % 3) AS bound FROM ({_SHARED})").replace("{total}", "(SELECT sum(unique_tokens) FROM (" + _SOURCES + "))") + ")")
def water_fill(spark, sf):
    rows = _sources(spark, sf).withColumn("bound", F.col("unique_tokens") * (0.4 + F.col("position") % 3))
    total = rows.agg(F.sum("unique_tokens")).first()[0]
    return A.water_fill(rows, F.lit(total), "share", "bound").select("source", F.round("alloc", 4).alias("alloc"))


@query(f"SELECT source, (low + CASE WHEN row_number() OVER (ORDER BY v - low DESC, position) <= lft THEN 1 ELSE 0 END)::BIGINT AS tokens FROM (SELECT *, floor(v + 1e-9) AS low, round_even(sum(v) OVER (), 0) - sum(floor(v + 1e-9)) OVER () AS lft FROM (SELECT source, position, round(share * 12345, 6) AS v FROM ({_SHARED})))")
def largest_remainder(spark, sf):
    return A.integers(_sources(spark, sf).withColumn("alloc", F.round(F.col("share") * 12345, 6))).select("source", "tokens")


_STATES = f"SELECT *, (unique_tokens * (position % 3) // 4)::BIGINT AS consumed, position % 4 = 1 AS exhausted FROM ({_SHARED})"


def _states(spark, sf):
    rows = _sources(spark, sf)
    return rows.withColumn("consumed", F.floor(F.col("unique_tokens") * (F.col("position") % 3) / 4)).withColumn("exhausted", F.col("position") % 4 == 1)


_CHUNK = "WITH a AS (" + _FILL.replace("{src}", f"SELECT source, share, CASE WHEN exhausted THEN greatest(0, unique_tokens * 2 - consumed)::DOUBLE ELSE 'inf'::DOUBLE END AS bound FROM ({_STATES})").replace("{total}", "2000000") + f"), b AS (SELECT st.*, a.alloc, floor(a.alloc + 1e-9) AS low FROM a JOIN ({_STATES}) st USING (source)), c AS (SELECT *, round_even(sum(alloc) OVER (), 0) - sum(low) OVER () AS lft FROM b), e AS (SELECT *, low + CASE WHEN row_number() OVER (ORDER BY round(alloc - low, 6) DESC, position) <= lft THEN 1 ELSE 0 END AS t FROM c) SELECT source, exhausted, unique_tokens, consumed, (CASE WHEN exhausted THEN least(t, greatest(0, unique_tokens * 2 - consumed)) ELSE t END)::BIGINT AS tokens FROM e"


@query(f"SELECT source, tokens FROM ({_CHUNK})")
def epoch_allocation(spark, sf):
    return A.chunk_allocation(_states(spark, sf), 2_000_000, 2).select("source", "tokens")


@query(f"SELECT source, (tokens - (unique_tokens - consumed))::BIGINT AS need FROM ({_CHUNK}) WHERE NOT exhausted AND tokens > unique_tokens - consumed")
def build_targets(spark, sf):
    return A.build_targets(A.chunk_allocation(_states(spark, sf), 2_000_000, 2)).select("source", F.col("need").cast("long").alias("need"))


@query(f"SELECT t * 100000 AS total, greatest(0, t * 100000 - m)::DOUBLE AS shortfall FROM range(1, 21) r(t), (SELECT sum(greatest(0, unique_tokens * 2 - consumed)) AS m FROM ({_STATES}) WHERE exhausted)")
def feasible_totals(spark, sf):
    totals = spark.range(1, 21).select((F.col("id") * 100_000).alias("total"))
    return A.feasible(_states(spark, sf).where("exhausted"), totals, 2)


@query(f"SELECT doc_id, coalesce(sum(n) OVER (PARTITION BY lang ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 20000 AS admitted FROM (SELECT doc_id, lang, {_TOKENS} AS n FROM documents)")
def quota_prefix(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang", (F.size(T.tokens(F.col("text"))) + 1).alias("n"))
    return A.admit_until(d, "lang", "doc_id", "n", F.lit(20_000)).select("doc_id", "admitted")


@query("WITH f AS (SELECT lang, source AS file, sum(octet_length(encode(text)))::BIGINT AS bytes FROM documents GROUP BY 1, 2), c AS (SELECT *, sum(bytes) OVER (PARTITION BY lang ORDER BY file) AS cum, row_number() OVER (PARTITION BY lang ORDER BY file) AS nth FROM f) SELECT lang, sum(bytes)::BIGINT AS total, min(CASE WHEN cum >= 300000 THEN file END) AS first_file, coalesce(min(CASE WHEN cum >= 300000 THEN nth END), count(*)) AS files_read FROM c GROUP BY lang")
def preflight_files(spark, sf):
    f = table(spark, sf, "documents").groupBy("lang", F.col("source").alias("file")).agg(F.sum(F.octet_length("text")).alias("bytes"))
    return A.fill_point(f, "lang", "file", "bytes", F.lit(300_000)).withColumn("files_read", F.col("files_read").cast("long"))


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS k FROM documents) WHERE k <= 7 OR i IN (SELECT round_even(j * k / 7.0, 0)::BIGINT FROM range(7) r(j))")
def cap_even_spread(spark, sf):
    return A.even_spread(table(spark, sf, "documents").select("doc_id", "source"), "source", "doc_id", 7).select("doc_id")


@query("SELECT doc_id, lang, place FROM (SELECT doc_id, lang, row_number() OVER (ORDER BY rn, lang) AS place FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS rn FROM documents) WHERE rn <= 30) WHERE place <= 30")
def interleave_top(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    return A.interleave_top(d, "lang", [F.desc("n_chars"), "doc_id"], 30).select("doc_id", "lang", F.col("place").cast("long").alias("place"))


@query(f"SELECT doc_id, lang, written, shard FROM (SELECT doc_id, lang, greatest(0, least(cum, 30000) - least(cum - n, 30000))::BIGINT AS written, ((cum - n) // 4096)::BIGINT AS shard FROM (SELECT doc_id, lang, n, sum(n) OVER (PARTITION BY lang ORDER BY doc_id)::BIGINT AS cum FROM (SELECT doc_id, lang, {_TOKENS} AS n FROM documents))) WHERE written > 0")
def shard_assignment(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang", (F.size(T.tokens(F.col("text"))) + 1).alias("n"))
    return A.exact_shards(d, "lang", "doc_id", "n", 4096, F.lit(30_000)).select("doc_id", "lang", "written", "shard")


@query("SELECT doc_id, n, n // 64 AS part, CASE WHEN n % 20 = 0 THEN 'val' ELSE 'train' END AS split, 'dv2-' || lpad(n::VARCHAR, 7, '0') AS row_id FROM (SELECT doc_id, row_number() OVER (ORDER BY source, doc_id) - 1 AS n FROM documents)")
def part_assignment(spark, sf):
    return A.numbered_parts(table(spark, sf, "documents").select("doc_id", "source"), ["source", "doc_id"], 64).select("doc_id", "n", "part", "split", "row_id")


@query("SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY sha256('1337|' || doc_id)) AS place FROM documents")
def seeded_shuffle(spark, sf):
    key = F.sha2(F.concat(F.lit("1337|"), F.col("doc_id").cast("string")), 256)
    return A.places_in(table(spark, sf, "documents").select("doc_id", "lang", key.alias("key")), "lang", "key").select("doc_id", "place")


@query(f"SELECT doc_id, epoch, start FROM (SELECT doc_id, e AS epoch, n, (e * total + cum - n)::BIGINT AS start FROM (SELECT doc_id, source, n, sum(n) OVER (PARTITION BY source ORDER BY doc_id) AS cum, sum(n) OVER (PARTITION BY source) AS total FROM (SELECT doc_id, source, {_TOKENS} AS n FROM documents)), range(3) r(e))")
def epoch_repeat(spark, sf):
    """Every source gives three times its unique tokens."""
    return _repeated(_sized(spark, sf), 3).select("doc_id", "epoch", "start")


def _repeated(docs, epochs):
    """The documents of each source in order, again in every epoch, with the tokens before each."""
    totals = docs.groupBy("source").agg(F.sum("n_tokens").alias("total"))
    d = A.running_total(docs, "source", "doc_id", "n_tokens", "cum").join(F.broadcast(totals), "source")
    d = d.withColumn("epoch", F.explode(F.array(*[F.lit(e).cast("long") for e in range(epochs)])))
    return d.withColumn("start", (F.col("epoch") * F.col("total") + F.col("cum") - F.col("n_tokens")).cast("long"))


def _sized(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "source", "lang", (F.size(T.tokens(F.col("text"))) + 1).cast("long").alias("n_tokens"))


_DOCS = f"SELECT doc_id, source, lang, ({_TOKENS})::BIGINT AS n FROM documents"


def _deficit_sql(docs: str, want: str, out: str) -> str:
    """The deficit rule document by document. docs: source, doc_id, n; want: source, position, tokens."""
    return f"""WITH RECURSIVE want AS (SELECT source, tokens, row_number() OVER (ORDER BY position) AS pos FROM ({want}) WHERE tokens > 0),
d AS (SELECT pos, source, doc_id, n, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS seq, count(*) OVER (PARTITION BY source) AS k FROM ({docs}) JOIN want USING (source)),
c AS (SELECT list(tokens ORDER BY pos) AS w, sum(tokens)::DOUBLE AS total, count(*) AS m, (SELECT list(k ORDER BY pos) FROM (SELECT DISTINCT pos, k FROM d)) AS ks FROM want),
r(place, source, doc_id, epoch, start, written, taken, seen) AS (
  SELECT -1::BIGINT, ''::VARCHAR, NULL::BIGINT, NULL::INT, NULL::BIGINT, 0::BIGINT, [0::BIGINT for x in range(m)], [0::BIGINT for x in range(m)] FROM c
  UNION ALL
  SELECT place + 1, d.source, d.doc_id, (seen[best] // d.k)::INT, written, written + d.n, [taken[i] + CASE WHEN i = best THEN d.n ELSE 0 END for i in range(1, m + 1)], [seen[i] + (i = best)::INT for i in range(1, m + 1)]
  FROM (SELECT *, list_position(scores, list_max(scores)) AS best FROM (
    SELECT r.*, c.m, c.ks, [CASE WHEN r.taken[i] < c.w[i] THEN c.w[i] / c.total * r.written - r.taken[i] ELSE -1e300 END for i in range(1, c.m + 1)] AS scores
    FROM r, c WHERE r.written < c.total AND list_max([r.taken[i] < c.w[i] for i in range(1, c.m + 1)]))) x
  JOIN d ON d.pos = x.best AND d.seq = x.seen[x.best] % x.ks[x.best])
SELECT {out} FROM r WHERE place >= 0"""


_MIX = "SELECT source, position, (2 * unique_tokens) AS limit_tokens, share, unique_tokens FROM (" + _SHARED + ")"
_MIX_WANT = "WITH a AS (" + _FILL.replace("{src}", f"SELECT source, share, limit_tokens::DOUBLE AS bound FROM ({_MIX})").replace("{total}", f"(SELECT sum(unique_tokens) FROM ({_MIX}))") + f"), b AS (SELECT m.*, a.alloc, floor(a.alloc + 1e-9) AS low FROM a JOIN ({_MIX}) m USING (source)), c AS (SELECT *, round_even(sum(alloc) OVER (), 0) - sum(low) OVER () AS lft FROM b) SELECT source, position, least(low + CASE WHEN row_number() OVER (ORDER BY round(alloc - low, 6) DESC, position) <= lft THEN 1 ELSE 0 END, limit_tokens)::BIGINT AS tokens FROM c"


@query(_deficit_sql(_DOCS, _MIX_WANT, "place, source, doc_id, epoch, start"))
def deficit_interleave(spark, sf):
    """A mix of as many tokens as there are, in which a source is repeated at most once."""
    rows = _sources(spark, sf).withColumn("consumed", F.lit(0).cast("long")).withColumn("exhausted", F.lit(True))
    total = rows.agg(F.sum("unique_tokens")).first()[0] or 0
    want = A.chunk_allocation(rows, total, 2).orderBy("position").select("source", "tokens").collect()
    return M.deficit_interleave(_sized(spark, sf), [(r["source"], int(r["tokens"])) for r in want])


_SIDES = "SELECT doc_id, CASE WHEN lang = 'en' THEN 'code' ELSE 'text' END AS source, n FROM (" + _DOCS + ")"


@query(_deficit_sql(_SIDES, f"SELECT source, CASE source WHEN 'text' THEN 0 ELSE 1 END AS position, sum(n)::BIGINT AS tokens FROM ({_SIDES}) GROUP BY source", "place, source, doc_id, start"))
def text_code_interleave(spark, sf):
    """Two kinds by their shares of the tokens, ties to the first; neither may run dry."""
    docs = _sized(spark, sf).withColumn("source", F.when(F.col("lang") == "en", "code").otherwise("text"))
    have = {r["source"]: r["n"] for r in docs.groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}
    return M.deficit_interleave(docs, [(s, int(have[s])) for s in ("text", "code") if s in have], repeat=False).select("place", "source", "doc_id", "start")


@query(f"""WITH RECURSIVE d AS (SELECT source, doc_id, n, lang = 'de' AS special, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM ({_DOCS})),
r(source, doc_id, i, total, kind, capped) AS (
  SELECT source, NULL::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, NULL::BOOLEAN FROM (SELECT DISTINCT source FROM d)
  UNION ALL
  SELECT source, doc_id, i, total + CASE WHEN skip THEN 0 ELSE n END, kind + CASE WHEN special AND NOT skip THEN n ELSE 0 END, skip FROM (
    SELECT d.*, r.total, r.kind, d.special AND r.total >= 2000 AND r.kind + d.n > 0.1::DOUBLE * (r.total + d.n) AS skip FROM r JOIN d ON d.source = r.source AND d.i = r.i + 1))
SELECT doc_id, capped FROM r WHERE i > 0""")
def special_share_cap(spark, sf):
    return M.capped(_sized(spark, sf).withColumn("special", F.col("lang") == "de"), 0.1, 2000)


_WEIGHTS = {"en": 0.4, "fr": 0.2, "de": 0.2, "es": 0.2}


_FOUR = "[1, 2, 3, 4]"


def _windows_sql(total: float, window: int, slack: float, closed: str, state: str, first: str) -> str:
    """Offers window by window: a bucket takes offers while it is below its limit, so what a window takes follows from the state it
    starts in (taken, base, gone and `state`, with `first` as its value). closed: a query that makes base2, gone2 and the new
    state of what a window took (now, after was), where the window is a whole one (full_window)."""
    w = "[" + ", ".join(map(str, _WEIGHTS.values())) + "]::DOUBLE[]"
    names = "'" + "', '".join(_WEIGHTS) + "'"
    took = f"[r.taken[i] + coalesce(list_sum([x.n FOR x IN g.rs IF x.l = i AND NOT r.gone[i] AND r.taken[i] + x.cb < r.base[i] * {1 + slack}]), 0) FOR i IN {_FOUR}]::BIGINT[]"
    step = f"SELECT r.*, {w} AS w0, r.taken AS was, g.full_window, {took} AS now FROM r JOIN g ON g.win = r.win"
    return f"""WITH RECURSIVE o AS (SELECT doc_id, lang AS bucket, list_position([{names}], lang) AS l, n, (row_number() OVER (ORDER BY doc_id) - 1) // {window} AS win FROM ({_DOCS})),
c AS (SELECT *, sum(n) OVER (PARTITION BY win, l ORDER BY doc_id) - n AS cb FROM o),
g AS (SELECT win, list({{'l': l, 'n': n, 'cb': cb}} ORDER BY doc_id) AS rs, count(*) = {window} AS full_window FROM c GROUP BY win),
r(win, taken, base, gone, {state}) AS (SELECT 0::BIGINT, [0, 0, 0, 0]::BIGINT[], [x * {total} FOR x IN {w}]::DOUBLE[], [false, false, false, false], {first}
  UNION ALL SELECT win + 1, now, base2, gone2, {state}2 FROM ({closed.replace('{STEP}', step)}))
SELECT doc_id, bucket, coalesce(NOT r.gone[l] AND r.taken[l] + cb < r.base[l] * {1 + slack}, false) AS admitted FROM c JOIN r USING (win)"""


def _refilled(total: float, step: str) -> str:
    """Water-filling over the buckets, of which those that are gone get no more than they have: four rounds settle all."""
    left = f"SELECT *, {total}::DOUBLE - coalesce(list_sum([now[j] FOR j IN {_FOUR} IF f[j]]), 0) AS rest, coalesce(list_sum([w0[j] FOR j IN {_FOUR} IF NOT f[j]]), 1) AS weight FROM"
    rows = f"SELECT *, [false, false, false, false] AS f FROM ({step})"
    for _ in range(4):
        rows = f"SELECT * EXCLUDE (f, rest, weight), [f[k] OR (gone2[k] AND rest * w0[k] / weight > now[k]) FOR k IN {_FOUR}] AS f FROM ({left} ({rows}))"
    return f"SELECT *, CASE WHEN ended THEN [CASE WHEN f[k] THEN now[k]::DOUBLE ELSE rest * w0[k] / weight END FOR k IN {_FOUR}] ELSE base END AS base2 FROM ({left} ({rows}))"


_STALLED = f"SELECT *, CASE WHEN full_window THEN [CASE WHEN NOT gone[i] AND now[i] < base[i] AND now[i] - was[i] < 0.01 * w0[i] * 150000.0 THEN stalled[i] + 1 ELSE 0 END FOR i IN {_FOUR}] ELSE stalled END AS stalled2 FROM ({{STEP}})"
_ENDED = f"SELECT *, [gone[i] OR stalled2[i] >= 2 FOR i IN {_FOUR}] AS gone2, len([i FOR i IN {_FOUR} IF stalled2[i] >= 2]) > 0 AND full_window AS ended FROM ({_STALLED})"


@query(_windows_sql(150000.0, 100, 0.1, _refilled(150000.0, _ENDED), "stalled", "[0, 0, 0, 0]"))
def quota_collect(spark, sf):
    """Decides by windows of offers; also tested offer by offer against the rule (tests/test_mixing.py)."""
    return M.collect_quota(_sized(spark, sf).withColumnRenamed("lang", "bucket"), _WEIGHTS, 150_000.0)


_SLOW = f"SELECT *, [coalesce(full_window AND NOT gone[i] AND base[i] > now[i] AND (now[i] - was[i] < 0.01 * w0[i] * 150000.0 OR (now[i] - was[i]) * (8 - (win + 1)) < base[i] - now[i]), false) FOR i IN {_FOUR}] AS slow, gone AS gone0, base AS base0 FROM ({{STEP}})"


def _given_up(step: str) -> str:
    """Slow buckets give up one after the other; what each leaves goes to those that have not, but not to the last one."""
    rows = step
    for b in (1, 2, 3, 4):
        rows = f"SELECT * EXCLUDE (gone0, base0), base0 AS b_was, [gone0[i] OR (slow[i] AND i = {b}) FOR i IN {_FOUR}] AS gone0, base0[{b}] - now[{b}] AS rest FROM ({rows})"
        rows = f"SELECT *, coalesce(list_sum([w0[j] FOR j IN [1, 2, 3] IF NOT gone0[j]]), 0) AS weight FROM ({rows})"
        rows = f"SELECT * EXCLUDE (b_was, rest, weight), CASE WHEN slow[{b}] THEN [CASE WHEN i = {b} THEN now[i]::DOUBLE WHEN NOT gone0[i] AND i < 4 AND rest > 0 THEN b_was[i] + rest * w0[i] / weight ELSE b_was[i] END FOR i IN {_FOUR}] ELSE b_was END AS base0 FROM ({rows})"
    return f"SELECT *, base0 AS base2, gone0 AS gone2, 0 AS unused2 FROM ({rows})"


@query(_windows_sql(150000.0, 100, 0.0, _given_up(_SLOW), "unused", "0"))
def quota_sample(spark, sf):
    """The sampler that gives up buckets by their rate; one bucket takes nothing of what others leave."""
    return M.sample_quota(_sized(spark, sf).withColumnRenamed("lang", "bucket"), _WEIGHTS, 150_000.0, last_window=8, capped=("es",))


def _walk_sql(step: str, out: str) -> str:
    """A walk over each source's documents with two numbers of state, a and b, from 0. step: the new a, b and what stands before them, of n."""
    return f"""WITH RECURSIVE d AS (SELECT source, doc_id, n, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM ({_DOCS})),
r(source, doc_id, i, a, b, own, "at") AS (
  SELECT source, NULL::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, NULL::BIGINT, NULL::BIGINT FROM (SELECT DISTINCT source FROM d)
  UNION ALL SELECT source, doc_id, i, {step} FROM (SELECT d.*, r.a, r.b FROM r JOIN d ON d.source = r.source AND d.i = r.i + 1))
SELECT source, doc_id, {out} FROM r WHERE i > 0"""


@query(_walk_sql("CASE WHEN b > 0 AND b + n > 1024 THEN a + 1 ELSE a END, CASE WHEN b > 0 AND b + n > 1024 THEN n ELSE b + n END, CASE WHEN b > 0 AND b + n > 1024 THEN a + 1 ELSE a END, CASE WHEN b > 0 AND b + n > 1024 THEN 0 ELSE b END", 'own::INT AS block, "at"'))
def pack_blocks(spark, sf):
    return M.next_fit(_sized(spark, sf), "doc_id", "source", "n_tokens", 1024)


@query(_walk_sql("CASE WHEN b + n >= 2000 THEN a + 1 ELSE a END, CASE WHEN b + n >= 2000 THEN 0 ELSE b + n END, a, b", "own::INT AS part"))
def cut_parts(spark, sf):
    return M.cut_parts(_sized(spark, sf), "source", "doc_id", "n_tokens", 2000)

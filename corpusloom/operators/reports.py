"""Reports over runs, verdicts, benchmark records and sources, and the decisions taken from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def leading_ok(turns: DataFrame, key: str, turn: str, ok: Column) -> DataFrame:
    """key, leading, turns: how many turns from the first on are all right."""
    w = Window.partitionBy(key).orderBy(turn)
    ranked = turns.select(key, F.row_number().over(w).alias("k"), ok.alias("ok"))
    first_bad = F.min(F.when(~F.coalesce("ok", F.lit(False)), F.col("k")))
    return ranked.groupBy(key).agg((F.coalesce(first_bad, F.max("k") + 1) - 1).alias("leading"), F.max("k").alias("turns"))


def mislabels(rows: DataFrame, group: str, label: Column, most: float, top: int = 3) -> DataFrame:
    """group, offers, dropped, warning, as_labels of rows whose label is unlike their group's: a warning above a share, and the most
    frequent wrong labels, ties in their order."""
    wrong = F.coalesce(label != F.col(group), F.lit(False))
    totals = rows.groupBy(group).agg(F.count("*").alias("offers"), F.count_if(wrong).alias("dropped"))
    counts = rows.where(wrong).groupBy(group, label.alias("label")).agg(F.count("*").alias("n"))
    nth = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("n"), "label"))
    best = counts.withColumn("nth", nth).where(F.col("nth") <= top).groupBy(group).agg(F.array_sort(F.collect_list(F.struct("nth", F.concat("label", F.lit(" "), F.col("n").cast("string")).alias("s")))).alias("r"))
    named = best.select(group, F.array_join(F.transform("r", lambda x: x["s"]), ", ").alias("as_labels"))
    return totals.join(named, group, "left").withColumn("warning", F.col("dropped") > most * F.col("offers"))


def benchmark_totals(steps: DataFrame, max_retries: int, infra: Sequence[str]) -> DataFrame:
    """One row of totals of steps(app, step, passed, attempts, kinds: array of failure kinds, accepted, seconds).

    An app passes when all its steps do and it is accepted; it stops at its first failed step, or at acceptance.
    """
    w = Window.partitionBy("app")
    per_app = steps.groupBy("app").agg(F.every("passed").alias("completed"), F.every(F.col("passed") & F.col("accepted")).alias("full"), F.min(F.when(~F.col("passed"), F.col("step"))).alias("failed"), F.sum("seconds").alias("seconds"))
    stop = F.when(F.col("failed").isNotNull(), F.concat(F.lit("step "), F.col("failed").cast("string"))).when(~F.col("full"), "acceptance")
    stops = per_app.groupBy(stop.alias("stop")).agg(F.count("*").alias("n")).where("stop IS NOT NULL")
    stops = stops.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("stop", "n"))), lambda x: F.concat(x["stop"], F.lit(": "), x["n"].cast("string"))), ", ").alias("stops"))
    apps = per_app.agg(F.count("*").alias("apps"), F.count_if("full").alias("apps_passed"), F.count_if("completed").alias("apps_completed"), F.round(F.sum("seconds"), 3).alias("seconds"))
    lost = F.size(F.filter("kinds", lambda k: k.isin(*infra)))
    passed, reached = F.count_if("passed"), F.count_if(F.col("attempts") >= 1)
    first = F.count_if(F.col("passed") & (F.col("attempts") == 1))
    totals = steps.agg(
        passed.alias("steps_passed"),
        first.alias("first_try"),
        reached.alias("reached"),
        F.round(F.try_divide(first, reached), 6).alias("first_of_reached"),
        F.round(F.try_divide(F.sum(F.when(F.col("passed"), F.col("attempts") - 1)), passed), 6).alias("mean_retries"),
        F.count_if(~F.col("passed") & (F.col("attempts") >= 1 + max_retries)).alias("exhausted"),
        F.sum(lost).cast("long").alias("infra_attempts"),
    )
    return apps.join(F.broadcast(totals)).join(F.broadcast(stops))


def failure_kinds(attempts: DataFrame, keys: Sequence[str], kinds: Sequence[str]) -> DataFrame:
    """keys, kind, n with a row for every kind, those that did not come up too."""
    held = attempts.groupBy(*keys).agg(F.collect_list("kind").alias("held"))
    every = held.withColumn("kind", F.explode(F.array(*map(F.lit, kinds))))
    return every.select(*keys, "kind", F.size(F.filter("held", lambda k: k == F.col("kind"))).cast("long").alias("n"))


def tokenizer_quality(rows: DataFrame, group: str) -> DataFrame:
    """Per group of rows(chars, tokens, blank_tokens, exact): characters a token, the share of blank tokens, and failed round trips."""
    tokens = F.sum("tokens")
    return rows.groupBy(group).agg(F.count("*").alias("documents"), F.round(F.try_divide(F.sum("chars"), tokens), 6).alias("chars_per_token"), F.round(F.coalesce(F.try_divide(F.sum("blank_tokens"), tokens), F.lit(0.0)), 6).alias("blank_share"), F.count_if(~F.col("exact")).alias("failures"))


def last_of(records: Column, field: str) -> Column:
    """A field of the last record of an array, or null."""
    return F.when(F.size(records) > 0, F.element_at(records, -1)[field])


#: A run's record: its id, state, planned steps, and what was logged.
RUN_SCHEMA = "run_id string, status string, planned long, steps array<struct<step:long,loss:double,tokens:long>>, evals array<struct<step:long,loss:double>>, resumes array<long>"


def run_table(files: DataFrame) -> DataFrame:
    """run, status and the last step, losses, tokens and resumes of files(name, content), one row a file.

    What is no JSON is `unreadable` and what is no run record `malformed`; both keep the file's name and no figures.
    """
    doc = F.expr("try_parse_json(content)")
    readable = doc.isNotNull()
    rec = F.from_json("content", RUN_SCHEMA)
    shaped = readable & F.expr("schema_of_variant(try_parse_json(content)) LIKE 'OBJECT%'") & rec["steps"].isNotNull() & F.coalesce(F.forall(rec["steps"], lambda s: s["step"].isNotNull() & s["loss"].isNotNull()), F.lit(False))
    rows = files.select("name", F.when(~readable, "unreadable").when(~F.coalesce(shaped, F.lit(False)), "malformed").alias("bad"), rec.alias("r"))
    good = F.col("bad").isNull()

    def figure(c: Column) -> Column:
        return F.when(good, c)

    return rows.select(
        F.when(good, F.coalesce(F.col("r.run_id"), F.col("name"))).otherwise(F.col("name")).alias("run"),
        F.coalesce("bad", "r.status", F.lit("?")).alias("status"),
        figure(F.coalesce(last_of(F.col("r.steps"), "step"), F.lit(0))).alias("step"),
        figure(F.col("r.planned")).alias("planned"),
        figure(last_of(F.col("r.steps"), "loss")).alias("train_loss"),
        figure(last_of(F.col("r.evals"), "loss")).alias("val_loss"),
        figure(last_of(F.col("r.steps"), "tokens")).alias("tokens"),
        figure(F.coalesce(F.size("r.resumes"), F.lit(0))).alias("resumes"),
    )


def truncated(history: DataFrame, key: str, step: str, after: DataFrame) -> DataFrame:
    """The history without what came after each key's step in after(key, upto); keys that are not in it stay whole."""
    return history.join(after, key, "left").where(F.col("upto").isNull() | (F.col(step) <= F.col("upto"))).drop("upto")


def aligned_every(steps: int, want: int, most: int) -> int:
    """The divisor of steps nearest to `want` by ratio that makes at most `most` evaluations, the larger of two."""
    divisors = {d for k in range(1, int(steps**0.5) + 1) if steps % k == 0 for d in (k, steps // k)}
    return max((d for d in divisors if steps // d <= most), key=lambda d: (min(d / want, want / d), d))


def rescaled(milestones: Column, old: Column, new: Column, gate: int = 0) -> Column:
    """Milestones at their shares of a longer or shorter run, rounded half to even, each once, none at its end or past it."""
    moved = F.transform(milestones, lambda m: F.greatest(F.lit(1), F.bround(m * new / old).cast("long")))
    if gate:
        moved = F.transform(moved, lambda v: F.greatest(v, F.lit(gate)))
    return F.array_sort(F.array_distinct(F.filter(moved, lambda v: v < new)))


def estimated_seconds(tokens: Column, rates: Column, prior: float, overhead: float, resumed: Column) -> Column:
    """Seconds of a run by the slowest measured rate, with the overhead again if it is resumed; by the prior rate and overhead before any measurement."""
    return F.when(F.size(rates) > 0, tokens / F.array_min(rates) + F.when(resumed, F.lit(overhead)).otherwise(0.0)).otherwise(tokens / F.lit(prior) + F.lit(overhead))


def run_medians(runs: DataFrame, config: str, rate: str, loss: str) -> DataFrame:
    """config, total, median of the rates of its runs, and whether it has the least loss."""
    rows = runs.groupBy(config).agg(F.round(F.sum(rate), 6).alias("total"), F.round(F.median(rate), 6).alias("median"), F.min(loss).alias("loss"))
    best = rows.agg(F.min(F.struct("loss", config)).alias("b")).select(F.col(f"b.{config}").alias("best"))
    return rows.join(F.broadcast(best)).select(config, "total", "median", F.round("loss", 6).alias("loss"), (F.col(config) == F.col("best")).alias("is_best"))


def checkpoints(files: DataFrame) -> DataFrame:
    """label, step, path of files(path, step, digest, final): milestones by step, and the final one unless it is the last milestone's copy."""
    last = files.where("NOT final").agg(F.max(F.struct("step", "digest")).alias("m"))
    rows = files.join(F.broadcast(last))
    same = F.col("final") & F.coalesce((F.col("step") == F.col("m.step")) & (F.col("digest") == F.col("m.digest")), F.lit(False))
    label = F.when(F.col("final"), "final").otherwise(F.concat(F.lit("step_"), F.lpad(F.col("step").cast("string"), 6, "0")))
    return rows.where(~same).select(label.alias("label"), "step", "path")


def ordered_digest(rows: DataFrame, order: str, text: str) -> DataFrame:
    """documents and one digest of a sample: of the digests of its texts, each with its length, in order. A sample is small; its texts do not meet."""
    one = F.concat(F.octet_length(text).cast("string"), F.lit(":"), F.sha2(F.col(text), 256))
    held = rows.agg(F.count("*").alias("documents"), F.array_sort(F.collect_list(F.struct(F.col(order), one.alias("d")))).alias("r"))
    return held.select("documents", F.sha2(F.array_join(F.transform("r", lambda x: x["d"]), "|"), 256).alias("digest"))

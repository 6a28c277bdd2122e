"""Chat training data: screening of conversations, guards against held-out replies, prompt fitting, masked blocks."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import dedup as D
from .staging import SENT_ROWS, staged

#: Strings that mark turns and may not stand in a text.
SPECIALS = ["<|system|>", "<|user|>", "<|assistant|>", "<|end|>", "<|endoftext|>"]


def conversations(turns: DataFrame) -> DataFrame:
    """conv_id, turns: array of (turn, role, text) in order."""
    one = F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    return turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(one)).alias("turns"))


def has_special(turns: Column) -> Column:
    return F.exists(turns, lambda t: F.lit(False) if not SPECIALS else _any([F.contains(t["text"], F.lit(s)) for s in SPECIALS]))


def _any(found: Sequence[Column]) -> Column:
    out = found[0]
    for f in found[1:]:
        out = out | f
    return out


def has_format(turns: Column) -> Column:
    """An optional system turn, then user and assistant in turn, up to an assistant."""
    rest = F.when(F.get(turns, F.lit(0))["role"] == "system", F.slice(turns, 2, F.size(turns))).otherwise(turns)
    expected = F.transform(rest, lambda t, i: t["role"] == F.when(i % 2 == 0, "user").otherwise("assistant"))
    return (F.size(rest) > 0) & (F.size(rest) % 2 == 0) & F.forall(expected, lambda x: x)


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit("<|"), t["role"], F.lit("|>"), t["text"], F.lit("<|end|>"))), "")


def screen(turns: DataFrame, bench: DataFrame, context: int, is_val: Column) -> DataFrame:
    """conv_id, reason (or null), fitted (turns that fit), tokens, truncated, split, of turns(conv_id, turn, role, text).

    The reasons in order: empty, special_tokens, format, decontam, duplicate (of an earlier conversation that came so far),
    too_long (no assistant turn ends within the context). Turns count their tokens and two marks.
    """
    held = conversations(turns)
    joined = held.select(F.col("conv_id").alias("doc_id"), F.array_join(F.transform("turns", lambda t: t["text"]), "\n").alias("text"))
    hits = D.substring_hits(joined, bench).select(F.col("doc_id").alias("conv_id")).distinct().withColumn("hit", F.lit(True))
    early = (
        F.when(F.exists("turns", lambda t: T.is_blank(t["text"])), "empty")
        .when(has_special(F.col("turns")), "special_tokens")
        .when(~has_format(F.col("turns")), "format")
        .when(F.col("hit"), "decontam")
    )
    rows = held.join(hits, "conv_id", "left").withColumn("early", early).withColumn("key", F.sha2(rendered(F.col("turns")), 256))
    firsts = rows.where("early IS NULL").groupBy("key").agg(F.min("conv_id").alias("first_id"))
    rows = rows.join(firsts, "key", "left")
    rows = rows.withColumn("ends", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), (F.size(T.tokens(t["text"])) + 2).alias("n"))))
    ends = F.transform("ends", lambda t, i: F.struct((i + 1).alias("k"), t["role"].alias("role"), F.aggregate(F.slice("ends", F.lit(1), i + 1), F.lit(0), lambda a, x: a + x["n"]).alias("upto")))
    fit = F.array_max(F.filter(ends, lambda e: (e["role"] == "assistant") & (e["upto"] <= context)))
    rows = rows.withColumn("fit", fit)
    reason = F.coalesce("early", F.when(F.col("conv_id") != F.col("first_id"), "duplicate"), F.when(F.col("fit").isNull(), "too_long"))
    good = reason.isNull()
    return rows.select(
        "conv_id",
        reason.alias("reason"),
        F.when(good, F.col("fit.k")).alias("fitted"),
        F.when(good, F.col("fit.upto")).alias("tokens"),
        F.when(good, F.col("fit.k") < F.size("turns")).alias("truncated"),
        F.when(good, F.when(is_val, "val").otherwise("train")).alias("split"),
    )


#: Buckets of shingles whose counts among the test replies order the shingles of all replies.
BUCKETS = 1 << 16


def _bucket_counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """b, n: how many shingles of a task fall into each bucket."""
    counts = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        hashes = np.asarray(batch.column(0).flatten()).view(np.uint64)
        counts += np.bincount((hashes & np.uint64(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS)
    yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(counts)), pa.array(counts[counts > 0])], ["b", "n"])


def _rarest_first(counts: np.ndarray, threshold: float) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """In place of the shingles s as many of the rarest as a pair at the threshold must share one of.

    The order is any one order for all replies: the level of the bucket's count, then the hash (its upper 52 bits).
    """
    levels = np.minimum(np.log2(1.0 + counts) * 32, 2047).astype(np.uint64) << np.uint64(52)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = batch.column(batch.schema.get_field_index("s"))
            at = np.asarray(s.offsets)
            hashes = np.asarray(s.values).view(np.uint64)
            keys = levels[(hashes & np.uint64(BUCKETS - 1)).astype(np.int64)] | hashes >> np.uint64(12)
            runs = [np.sort(keys[i:j])[: j - i - math.ceil((j - i) * threshold - 1e-9) + 1] if j > i else keys[:0] for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            ends = np.cumsum([0, *map(len, runs)]).astype(np.int32)
            flat = np.concatenate([*runs, keys[:0]]).view(np.int64)
            rare = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
            names = batch.schema.names
            yield pa.RecordBatch.from_arrays([rare if n == "s" else batch.column(n) for n in names], names)

    return run


def _sets(replies: DataFrame, width: int) -> DataFrame:
    """side, doc_id, path, n, k, k2 (two hashes of path and shingles), s of replies with a path."""
    toks = replies.where("path IS NOT NULL").select("side", "doc_id", "path", T.tokens(F.coalesce("text", F.lit(""))).alias("toks"))
    s = toks.select("side", "doc_id", "path", T.shingle_hashes(F.col("toks"), width).alias("s"))
    return s.select("side", "doc_id", "path", F.size("s").alias("n"), F.xxhash64("path", "s").alias("k"), F.xxhash64(F.lit("again"), "s", "path").alias("k2"), "s")


def split_guard(train: DataFrame, test: DataFrame, threshold: float = 0.9, width: int = 5) -> DataFrame:
    """doc_id, rule of the train replies(doc_id, path, text) that copy a test reply: whole (white space collapsed), or near for the same path.

    Near-copies are found by an equi-join on rare shingles (prefix filtering); copies of one reply are one row of it. Texts are
    cut into shingles once, and of those only the rare ones are staged and shuffled; whole sets are made again for the
    replies of candidate pairs, which are confirmed on them.
    """
    whole = train.select("doc_id", F.sha2(T.collapse(F.col("text")), 256).alias("key")).join(test.select(F.sha2(T.collapse(F.col("text")), 256).alias("key")).distinct(), "key", "left_semi")
    both = train.select(F.lit(0).alias("side"), "doc_id", "path", "text").unionByName(test.select(F.lit(1).alias("side"), "doc_id", "path", "text"))
    sets = _sets(both, width)
    counts = np.zeros(BUCKETS)
    for r in _sets(both.where("side = 1"), width).select("s").mapInArrow(_bucket_counts, "b long, n long").groupBy("b").agg(F.sum("n").alias("n")).collect():
        counts[r["b"]] = r["n"]
    rows = staged(sets.mapInArrow(_rarest_first(counts, threshold), sets.schema), "guard-rare")
    trained, tested = rows.where("side = 0"), rows.where("side = 1")
    held = tested.select("k", "k2").distinct()

    def entries(classes: DataFrame, key: str, n: str, rest: str) -> DataFrame:
        one = classes.groupBy("k", "k2").agg(F.first("path").alias("path"), F.first("n").alias(n), F.first("s").alias("s"))
        return one.select(F.col("k").alias(key), "path", n, (F.col(n) - F.size("s")).alias(rest), F.explode("s").alias("g")).select(key, n, rest, F.xxhash64("path", "g").alias("g"))

    # what a pair shares is among the rare shingles of both, which are counted, or among the rest of the one whose rare ones end first
    mine, theirs = entries(trained.join(held, ["k", "k2"], "left_anti"), "a", "n", "x"), entries(tested, "b", "m", "y")
    met = mine.join(theirs, "g").where(F.least("n", "m") >= threshold * F.greatest("n", "m") - 1e-9).groupBy("a", "b", "n", "m", "x", "y").agg(F.count("*").alias("c"))
    able = F.col("c") + F.greatest("x", "y") >= threshold / (1 + threshold) * (F.col("n") + F.col("m")) - 1e-9
    pairs = staged(met.where(able).select("a", "b").distinct(), "guard-pairs")
    keys = pairs.select(F.col("a").alias("k")).union(pairs.select("b")).distinct()
    one = staged(rows.join(keys, "k", "left_semi").groupBy("k", "k2").agg(F.min("doc_id").alias("rep")), "guard-reps")
    reps = one.select("rep").distinct()
    reps = F.broadcast(reps) if one.count() <= SENT_ROWS else reps
    full = _sets(both.join(reps, F.col("doc_id").eqNullSafe(F.col("rep")), "left_semi"), width).select("k", "k2", "path", "s")
    found = pairs.join(full.withColumnRenamed("k", "a"), "a").join(full.select(F.col("k").alias("b"), "path", F.col("s").alias("t")), ["b", "path"])
    near = found.where(T.jaccard(F.col("s"), F.col("t")) >= threshold).select(F.col("a").alias("k"), "k2").union(held).distinct()
    hits = trained.join(near, ["k", "k2"], "left_semi").select("doc_id")
    same = whole.select("doc_id", F.lit("whole").alias("rule")).unionByName(hits.select("doc_id", F.lit("near").alias("rule")))
    return same.groupBy("doc_id").agg(F.max("rule").alias("rule"))


def tree_order(paths: Column, first: str) -> Column:
    """Distinct paths, those that match a pattern first, each part in order."""
    own = F.array_sort(F.array_distinct(paths))
    return F.concat(F.filter(own, lambda p: p.rlike(first)), F.filter(own, lambda p: ~p.rlike(first)))


def rendered_tree(paths: Column, most: int) -> Column:
    """The first paths, a line each, and how many more there are."""
    shown = F.concat(F.array_join(F.transform(F.slice(paths, 1, most), lambda p: F.concat(p, F.lit("\n"))), ""))
    more = F.size(paths) - most
    return F.when(more > 0, F.concat(shown, F.lit("... ("), more.cast("string"), F.lit(" more files not shown)\n"))).otherwise(shown)


def fit_prompt(rows: DataFrame, budget: int) -> DataFrame:
    """rows(fixed, files: array of (n, written), paths: array of sizes) with files_dropped, paths_shown and dropped.

    A prompt is its fixed part, its files and the longest head of its path list that fits. Where no path fits, whole files go: the last shown
    first, those that the reply does not write before those that it does. Sizes add up.
    """
    order = F.concat(F.reverse(F.filter("files", lambda f: ~f["written"])), F.reverse(F.filter("files", lambda f: f["written"])))
    total = F.aggregate("files", F.lit(0).cast("long"), lambda a, f: a + f["n"])
    rows = rows.withColumn("_order", order).withColumn("_total", total)
    left = F.transform(F.sequence(F.lit(0), F.size("_order")), lambda k: F.struct(k.alias("k"), (F.lit(budget) - F.col("fixed") - F.col("_total") + F.aggregate(F.slice("_order", F.lit(1), k), F.lit(0).cast("long"), lambda a, f: a + f["n"])).alias("room")))
    rows = rows.withColumn("_fit", F.array_min(F.filter(left, lambda x: x["room"] >= 0)))
    ends = F.transform("paths", lambda p, i: F.aggregate(F.slice("paths", F.lit(1), i + 1), F.lit(0).cast("long"), lambda a, x: a + x))
    shown = F.size(F.filter(ends, lambda e: e <= F.col("_fit.room")))
    none = F.col("_fit").isNull()
    return rows.select(*[c for c in rows.columns if not c.startswith("_")], F.when(~none, F.col("_fit.k")).alias("files_dropped"), F.when(~none, shown).alias("paths_shown"), none.alias("dropped"))


def mask_problems(tokens: DataFrame, context: int) -> DataFrame:
    """block, problem of a stream of tokens(pos, token, mask): a mask that is missing or not 0 or 1, a short last block, or a block whose
    places after the first hold no target. Good blocks do not come out."""
    place = F.pmod(F.col("pos"), F.lit(context))
    by = tokens.groupBy(F.floor(F.col("pos") / context).alias("block")).agg(F.count("*").alias("n"), F.count_if(~F.coalesce(F.col("mask").isin(0, 1), F.lit(False))).alias("bad"), F.max(F.when(place > 0, F.col("mask"))).alias("target"))
    problem = F.when(F.col("bad") > 0, "mask_values").when(F.col("n") != context, "short_block").when(F.coalesce("target", F.lit(0)) == 0, "no_target")
    return by.select("block", problem.alias("problem")).where("problem IS NOT NULL")

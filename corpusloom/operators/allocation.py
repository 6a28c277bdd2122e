"""Token budgets over weighted sources: shares, water-filling, integer rounding, epochs, quotas, shards.

Budgets are tables of one row a source; their windows have no partition because a budget is one whole, and its
size is that of a configuration. Corpus tables are reduced by aggregates or ranked per key before they get here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import staged


def resolve_shares(sources: DataFrame) -> DataFrame:
    """share of each source(slice, slice_percent, weight): its weight within the slice times the slice's percentage."""
    return sources.withColumn("share", F.col("weight") / F.sum("weight").over(Window.partitionBy("slice")) * F.col("slice_percent") / 100)


def renormalise(sources: DataFrame, keep: Column) -> DataFrame:
    """The kept sources with shares that sum to one."""
    return sources.where(keep).withColumn("share", F.col("share") / F.sum("share").over(Window.partitionBy()))


def water_fill(sources: DataFrame, total: Column, weight: str = "weight", bound: str = "bound") -> DataFrame:
    """alloc of each source: in proportion to its weight, but never above its bound (null: none), the rest shared again.

    In ascending order of bound / weight the sources up to some point are at their bounds and all others get the
    same level per weight, which is what is left over the weights that are left; the level is the first that no later bound undercuts.
    """
    per = F.coalesce(F.col(bound) / F.col(weight), F.lit(float("inf")))
    rows = sources.withColumn("_per", per).withColumn("_total", total.cast("double"))
    asc = Window.orderBy("_per", "source")
    upto = asc.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_before", F.coalesce(F.sum(F.col(bound)).over(upto), F.lit(0.0)))
    rows = rows.withColumn("_after", F.sum(weight).over(asc.rowsBetween(0, Window.unboundedFollowing)))
    rows = rows.withColumn("_level", F.greatest(F.col("_total") - F.col("_before"), F.lit(0.0)) / F.col("_after"))
    level = F.min(F.when(F.col("_level") <= F.col("_per"), F.struct("_per", "source", "_level"))).over(Window.partitionBy())["_level"]
    alloc = F.when(level.isNull(), F.col(bound)).otherwise(F.least(F.coalesce(F.col(bound), F.lit(float("inf"))), level * F.col(weight)))
    return rows.withColumn("alloc", alloc.cast("double")).drop("_per", "_total", "_before", "_after", "_level")


def integers(sources: DataFrame, alloc: str = "alloc", position: str = "position") -> DataFrame:
    """tokens of each source: its allocation rounded down, and what is left of the rounded sum to the largest remainders, ties by position."""
    everyone = Window.partitionBy()
    low = F.floor(F.col(alloc) + 1e-9)
    rows = sources.withColumn("_low", low).withColumn("_left", F.bround(F.sum(alloc).over(everyone)) - F.sum(low).over(everyone))
    nth = F.row_number().over(Window.orderBy(F.desc(F.col(alloc) - F.col("_low")), position))
    return rows.withColumn("tokens", (F.col("_low") + F.when(nth <= F.col("_left"), 1).otherwise(0)).cast("long")).drop("_low", "_left")


def epoch_budget(unique: Column, consumed: Column, max_epochs: int) -> Column:
    """What an exhausted source can still give."""
    return F.greatest(F.lit(0), unique * max_epochs - consumed)


def chunk_allocation(states: DataFrame, total: int, max_epochs: int) -> DataFrame:
    """tokens of each source(source, position, share, unique_tokens, consumed, exhausted) for a chunk, exhausted ones within their epochs."""
    bound = F.when(F.col("exhausted"), epoch_budget(F.col("unique_tokens"), F.col("consumed"), max_epochs)).cast("double")
    filled = water_fill(states.where("share > 0").withColumn("bound", bound), F.lit(total), "share", "bound")
    got = integers(filled)
    return got.withColumn("tokens", F.least("tokens", F.coalesce(F.col("bound").cast("long"), F.col("tokens"))))


def build_targets(allocated: DataFrame) -> DataFrame:
    """need: unique tokens that each live source must still build for its allocation."""
    need = F.col("tokens") - (F.col("unique_tokens") - F.col("consumed"))
    return allocated.where(~F.col("exhausted")).withColumn("need", need).where("need > 0")


def feasible(states: DataFrame, totals: DataFrame, max_epochs: int) -> DataFrame:
    """total, shortfall of every candidate total; the largest without a shortfall fits.

    A live source has no bound, so a total falls short only where all sources are exhausted.
    """
    bound = F.when(F.col("exhausted"), epoch_budget(F.col("unique_tokens"), F.col("consumed"), max_epochs).cast("double")).otherwise(F.lit(float("inf")))
    most = states.where("share > 0").agg(F.sum(bound).alias("most"))
    return totals.join(F.broadcast(most)).withColumn("shortfall", F.greatest(F.lit(0.0), F.col("total") - F.col("most"))).drop("most")


#: Values of the order column that one block of a running total spans.
BLOCK = 1 << 16


def running_total(rows: DataFrame, group: str, order: str, size: str, name: str, block: int = BLOCK) -> DataFrame:
    """rows with the sum of the group's sizes up to and with each row, by a unique long column.

    Sums of blocks of the order's values are added up first, and then the rows of a block, so that a hot group is many tasks.
    """
    part = F.floor(F.col(order) / block)
    blocks = rows.groupBy(F.col(group).alias("_g"), part.alias("_b")).agg(F.sum(size).alias("_s"))
    before = F.sum("_s").over(Window.partitionBy("_g").orderBy("_b")) - F.col("_s")
    starts = blocks.select("_g", "_b", before.alias("_before"))
    joined = rows.withColumn("_own", part).join(starts, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_own") == F.col("_b")))
    within = F.sum(size).over(Window.partitionBy(group, "_own").orderBy(order))
    return joined.withColumn(name, (F.col("_before") + within).cast("long")).drop("_g", "_b", "_own", "_before")


def admit_until(rows: DataFrame, bucket: str, order: str, size: str, limit: Column) -> DataFrame:
    """admitted: whether the sum of the bucket's earlier rows is below its limit, which the last admitted row may pass."""
    summed = running_total(rows, bucket, order, size, "_cum")
    return summed.withColumn("admitted", F.col("_cum") - F.coalesce(F.col(size), F.lit(0)) < limit).drop("_cum")


def fill_point(files: DataFrame, bucket: str, file: str, size: str, quota: Column) -> DataFrame:
    """bucket, total, first_file at which the bucket's cumulative size reaches its quota, files_read up to there."""
    w = Window.partitionBy(bucket).orderBy(file)
    rows = files.withColumn("_quota", quota).withColumn("_cum", F.sum(size).over(w)).withColumn("_nth", F.row_number().over(w))
    full = F.col("_cum") >= F.col("_quota")
    return rows.groupBy(bucket).agg(F.sum(size).alias("total"), F.min(F.when(full, F.col(file))).alias("first_file"), F.coalesce(F.min(F.when(full, F.col("_nth"))), F.count("*")).alias("files_read"))


def even_spread(rows: DataFrame, group: str, order: str, cap: int) -> DataFrame:
    """At most `cap` rows of each group, evenly spread over it: ranks round_half_even(i * size / cap)."""
    w = Window.partitionBy(group)
    ranked = rows.withColumn("_i", F.row_number().over(w.orderBy(order)) - 1).withColumn("_k", F.count("*").over(w))
    near = F.floor(F.col("_i") * cap / F.col("_k"))
    hit = F.lit(False)
    for d in (-1, 0, 1):  # the only numbers that can round to this rank
        i = near + d
        hit = hit | ((i >= 0) & (i < cap) & (F.bround(i * F.col("_k") / cap) == F.col("_i")))
    return ranked.where((F.col("_k") <= cap) | hit).drop("_i", "_k")


def interleave_top(rows: DataFrame, side: str, order: list[str | Column], limit: int) -> DataFrame:
    """place: rows of the sides in turn by their ranks, up to a limit."""
    ranked = rows.withColumn("_rn", F.row_number().over(Window.partitionBy(side).orderBy(*order))).where(F.col("_rn") <= limit)
    return ranked.withColumn("place", F.row_number().over(Window.orderBy("_rn", side))).where(F.col("place") <= limit).drop("_rn")


def exact_shards(rows: DataFrame, split: str, order: str, size: str, shard_tokens: int, target: Column) -> DataFrame:
    """written tokens of each row so that its split ends exactly at the target, and the first shard it is in."""
    rows = running_total(rows, split, order, size, "_cum").withColumn("_from", F.col("_cum") - F.col(size)).withColumn("_target", target)
    written = F.greatest(F.lit(0), F.least("_cum", "_target") - F.least("_from", "_target"))
    return rows.withColumn("written", written.cast("long")).withColumn("shard", F.floor(F.col("_from") / shard_tokens).cast("long")).where("written > 0").drop("_cum", "_from", "_target")


def places_in(rows: DataFrame, group: str, key: str) -> DataFrame:
    """rows with their place (from 1) within their group by a key: numbers over the whole order less those of the groups before."""
    numbered = numbered_parts(rows, [group, key], 1).drop("part", "split", "row_id")
    first = numbered.groupBy(F.col(group).alias("_g")).agg(F.min("n").alias("_first"))
    return numbered.join(F.broadcast(first), F.col(group).eqNullSafe(F.col("_g"))).withColumn("place", F.col("n") - F.col("_first") + 1).drop("n", "_g", "_first")


def largest_feasible(states: DataFrame, max_epochs: int) -> DataFrame:
    """total: the largest total that the unique tokens built so far can fill by the sources' shares without building more, as a whole
    number of tokens: a source gives at most its epochs, and shares are spread over those that are not used up."""
    budget = epoch_budget(F.col("unique_tokens"), F.col("consumed"), max_epochs).cast("double")
    live = states.where("share > 0").withColumn("most", F.when(F.col("exhausted"), budget).otherwise((F.col("unique_tokens") - F.col("consumed")).cast("double")))
    # an exhausted source gives what it can and drops out; a live one bounds the total as soon as its share of the rest asks for more
    dry = live.where("exhausted")
    w = Window.orderBy("ratio").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    dry = dry.withColumn("ratio", F.col("most") / F.col("share")).select("ratio", F.sum("most").over(w).alias("given"), F.sum("share").over(w).alias("gone"))
    rest = live.where("NOT exhausted").agg(F.min(F.col("most") / F.col("share")).alias("level"))
    shares, every = live.agg(F.sum("share").alias("shares")), live.agg(F.sum("most").alias("sum"), F.count_if(~F.col("exhausted")).alias("n_live"))
    below = dry.join(F.broadcast(rest)).where(F.col("ratio") <= F.col("level")).agg(F.coalesce(F.max("given"), F.lit(0.0)).alias("given"), F.coalesce(F.max("gone"), F.lit(0.0)).alias("gone"))
    one = below.join(shares).join(every).join(rest)
    total = F.when(F.col("n_live") == 0, F.col("sum")).otherwise(F.col("given") + F.col("level") * (F.col("shares") - F.col("gone")))
    return one.select(F.floor(total + F.lit(1e-6)).alias("total"))


def numbered_parts(rows: DataFrame, order: list[str], size: int, val_every: int = 20) -> DataFrame:
    """n, part, split and row_id of rows in one order, dealt to parts of a fixed size.

    The order is one whole, nulls last as in SQL; rows get their numbers from sorted ranges and prefix sums over the ranges, not
    in one task. The sorted rows are staged: were they sorted again for the sums, adaptive execution could cut them into other ranges.
    """
    sorted_ = staged(rows.sort(*[F.col(c).asc_nulls_last() for c in order]).withColumn("_m", F.monotonically_increasing_id()), "numbered")
    held = sorted_.withColumn("_task", F.shiftright("_m", 33)).withColumn("_at", F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)))
    counts = held.groupBy("_task").agg(F.count("*").alias("_k"))
    starts = counts.select("_task", (F.sum("_k").over(Window.orderBy("_task")) - F.col("_k")).alias("_start"))
    out = held.join(F.broadcast(starts), "_task").withColumn("n", F.col("_start") + F.col("_at"))
    out = out.withColumn("part", F.floor(F.col("n") / size)).withColumn("split", F.when(F.col("n") % val_every == 0, "val").otherwise("train"))
    return out.withColumn("row_id", F.format_string("dv2-%07d", "n")).drop("_m", "_task", "_at", "_start")

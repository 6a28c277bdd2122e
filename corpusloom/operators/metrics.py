"""Reports over evaluation and build records."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pass_at_k(n: Column, c: Column, k: int) -> Column:
    """The unbiased chance that one of k of n tries with c passes is a pass."""
    product = F.aggregate(F.sequence(n - c + 1, n), F.lit(1.0), lambda a, i: a * (1 - k / i))
    return F.when(c <= 0, 0.0).when(n - c < k, 1.0).otherwise(1 - product)


def bits_per_byte(nll: Column, size: Column) -> Column:
    return F.when(F.sum(size) > 0, F.sum(nll) / (F.sum(size) * math.log(2)))


def share_of(part: Column, by: list[str]) -> Column:
    """A share of the whole by group, to six digits, 0 where the whole is."""
    whole = F.sum(part).over(Window.partitionBy(*by))
    return F.when(whole == 0, 0.0).otherwise(F.round(part / whole, 6))


def spikes(rows: DataFrame, run: str, step: str, loss: str, factor: float = 1.5, beta: float = 0.98) -> DataFrame:
    """run, steps, spikes: losses above factor times the moving average of the finite ones before, which the first one seeds."""
    series = rows.where(~F.isnan(loss) & F.col(loss).isNotNull()).groupBy(run).agg(F.array_sort(F.collect_list(F.struct(F.col(step), F.col(loss).alias("x")))).alias("s"))
    start = F.struct(F.lit(None).cast("double").alias("ema"), F.lit(0).alias("n"))

    def add(acc: Column, p: Column) -> Column:
        ema = F.coalesce(acc["ema"], p["x"])
        hit = acc["ema"].isNotNull() & (p["x"] > factor * acc["ema"])
        return F.struct((beta * ema + (1 - beta) * p["x"]).alias("ema"), (acc["n"] + F.when(hit, 1).otherwise(0)).alias("n"))

    return series.select(run, F.size("s").alias("steps"), F.aggregate("s", start, add, lambda a: a["n"]).alias("spikes"))


def spent(sessions: DataFrame, now: Column) -> Column:
    """Sum of hours times rate of sessions(start_s, last_s, rate, ended, is_last): only a last one that has not ended runs to now."""
    end = F.when(F.col("is_last") & ~F.col("ended"), now).otherwise(F.col("last_s"))
    return F.sum((end - F.col("start_s")) / 3600 * F.col("rate"))


def leading_ok(turns: DataFrame, conv: str, turn: str, ok: Column) -> DataFrame:
    """conv, turns, leading: how many turns come before the first that is not ok."""
    first_bad = F.min(F.when(~ok, F.col("nth")))
    nth = F.row_number().over(Window.partitionBy(conv).orderBy(turn))
    return turns.withColumn("nth", nth).groupBy(conv).agg(F.count("*").alias("turns"), F.coalesce(first_bad - 1, F.count("*")).alias("leading"))


def usage_flags(counts: DataFrame, count: str) -> DataFrame:
    """ratio of each count to the mean, and whether it is dead (< 0.1) or overloaded (> 3)."""
    ratio = F.col(count) / F.avg(count).over(Window.partitionBy())
    return counts.withColumn("ratio", F.round(ratio, 6)).withColumn("flag", F.when(F.col("ratio") < 0.1, "dead").when(F.col("ratio") > 3, "overloaded").otherwise("ok"))


def accepted_in_hour(rows: DataFrame, user: str, ts: str, limit: int) -> DataFrame:
    """rows with how many rows of the user came in the trailing hour, and whether that passes the limit."""
    w = Window.partitionBy(user).orderBy(F.col(ts).cast("long")).rangeBetween(-3600, 0)
    return rows.withColumn("offered", F.count("*").over(w)).withColumn("over", F.col("offered") > limit)

"""Incremental builds of sources to targets of unique tokens, with states that are refused when a source has changed.

A build folder holds `rows` and `state`, both in folders by round. A round's rows count once its state is written, so a build
that was killed leaves only rows that the next build of that round overwrites. All sources of a round are one job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import allocation as A

STATE = "source string, identity string, cursor long, unique_tokens long, exhausted boolean, round int"


class Refused(ValueError):
    """A source is not what it was when its build began."""


class NeedMore(ValueError):
    """The rounds are used up and some source still has to build more."""


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def states(spark: SparkSession, folder: str) -> DataFrame:
    """The last state of every source."""
    if not _exists(spark, f"{folder}/state"):
        return spark.createDataFrame([], STATE)
    rows = spark.read.schema(STATE).parquet(f"{folder}/state")
    last = rows.groupBy("source").agg(F.max_by(F.struct(*rows.columns), "round").alias("s"))
    return last.select("s.*")


def built(spark: SparkSession, folder: str) -> DataFrame | None:
    """The rows of all rounds whose state is written."""
    if not _exists(spark, f"{folder}/state"):
        return None
    done = spark.read.schema(STATE).parquet(f"{folder}/state").select("round").distinct()
    return spark.read.parquet(f"{folder}/rows").join(F.broadcast(done), "round", "left_semi").drop("round")


def build(rows: DataFrame, targets: DataFrame, folder: str, limit_docs: int | None = None) -> DataFrame:
    """Go on with every source of targets(source, identity, target) from where it stopped until its unique tokens reach the target or it ends.

    rows: source, ord (a unique long within a source, its order), n_tokens, and what else is to be kept. limit_docs bounds
    the documents of each source in this round. Returns the last states.
    """
    spark = rows.sparkSession
    before = states(spark, folder)
    both = targets.join(before, "source", "left").select("source", targets["identity"], "target", before["identity"].alias("was"), F.coalesce("cursor", F.lit(-1)).alias("cursor"), F.coalesce("unique_tokens", F.lit(0)).alias("had"), F.coalesce("exhausted", F.lit(False)).alias("ended"), F.coalesce("round", F.lit(-1)).alias("last"))
    changed = [r["source"] for r in both.where("was IS NOT NULL AND was <> identity").select("source").collect()]  # a row a source
    if changed:
        raise Refused(f"these sources have changed since their build began: {sorted(changed)}")
    number = (before.agg(F.max("round")).first()[0] if _exists(spark, f"{folder}/state") else None)
    number = 0 if number is None else number + 1
    asked = both.where("NOT ended AND had < target")
    left = rows.join(F.broadcast(asked.select("source", "cursor", "had", "target")), "source").where(F.col("ord") > F.col("cursor"))
    summed = A.running_total(left, "source", "ord", "n_tokens", "upto")
    taken = summed.where(F.col("had") + F.col("upto") - F.col("n_tokens") < F.col("target"))
    if limit_docs is not None:
        taken = A.running_total(taken.withColumn("one", F.lit(1)), "source", "ord", "one", "nth").where(F.col("nth") <= limit_docs).drop("one", "nth")
    out = f"{folder}/rows/round={number}"
    taken.select(*rows.columns).write.mode("overwrite").parquet(out)
    new = spark.read.schema(taken.select(*rows.columns).schema).parquet(out).groupBy("source").agg(F.max("ord").alias("at"), F.sum("n_tokens").alias("got"))
    end = rows.groupBy("source").agg(F.max("ord").alias("end"))
    now = asked.join(new, "source", "left").join(end, "source", "left").select("source", "identity", F.coalesce("at", "cursor").alias("cursor"), (F.col("had") + F.coalesce("got", F.lit(0))).alias("unique_tokens"), (F.coalesce("at", "cursor") >= F.coalesce("end", F.lit(-1))).alias("exhausted"))
    now.coalesce(1).write.mode("overwrite").parquet(f"{folder}/state/round={number}")
    return states(spark, folder)


def run_rounds(rows: DataFrame, shares: DataFrame, total: int, folder: str, max_epochs: int = 1, rounds: int = 5) -> DataFrame:
    """Build what an allocation of a total by shares(source, position, share, identity) asks for, allocate again with what turned out to be
    exhausted, and so on until nothing is missing; NeedMore after the last round. Returns source, tokens, unique_tokens, exhausted, round."""
    for _ in range(rounds):
        now = states(rows.sparkSession, folder)
        state = shares.join(now.select("source", "unique_tokens", "exhausted", "round"), "source", "left").withColumns({"unique_tokens": F.coalesce("unique_tokens", F.lit(0).cast("long")), "exhausted": F.coalesce("exhausted", F.lit(False)), "consumed": F.lit(0).cast("long")})
        wanted = A.chunk_allocation(state, total, max_epochs)
        missing = A.build_targets(wanted).join(shares.select("source", F.col("identity").alias("own")), "source").select("source", F.col("own").alias("identity"), F.col("tokens").cast("long").alias("target"))
        if missing.isEmpty():
            return wanted.select("source", "tokens", "unique_tokens", "exhausted", "round")
        # targets are few; as local rows they do not read the states that the build is about to add to
        build(rows, rows.sparkSession.createDataFrame(missing.collect(), "source string, identity string, target long"), folder)
    raise NeedMore(f"sources still have to build more after {rounds} rounds")

"""Append-only logs of generated answers: torn tails, what is still to do, and the checks before they become training data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ANSWER = "id string, response string, teacher string, revision string, tag string"


class Integrity(ValueError):
    """Inputs do not belong together."""


def read_log(spark: SparkSession, path: str | Sequence[str], schema: str = ANSWER) -> DataFrame:
    """line, and the fields of every line that is whole: a last line that was cut off while it was written is no JSON and is left out."""
    lines = spark.read.text(path if isinstance(path, str) else list(path)).select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line"))
    whole = lines.where(F.expr("try_parse_json(value)").isNotNull() & (F.trim("value") != ""))
    return whole.select("file", "line", F.from_json("value", schema).alias("r")).select("file", "line", "r.*").where("id IS NOT NULL")


def last_answers(log: DataFrame) -> DataFrame:
    """The last answer of each id."""
    fields = [c for c in log.columns if c not in ("line", "file")]
    return log.groupBy("id").agg(F.max_by(F.struct(*fields), F.struct("file", "line")).alias("a")).select("a.*")


def to_do(ids: DataFrame, log: DataFrame, attempts: int | None = None) -> DataFrame:
    """The ids without an answer, with how often they were tried; those tried too often are left out."""
    tried = log.groupBy("id").agg(F.count("*").alias("tries"), F.max(F.col("response").isNotNull()).alias("done"))
    left = ids.join(tried, "id", "left").where(~F.coalesce("done", F.lit(False))).select("id", F.coalesce("tries", F.lit(0).cast("long")).alias("tries"))
    return left if attempts is None else left.where(F.col("tries") < attempts)


def kept_rows(verdicts: DataFrame, log: DataFrame, prompts: DataFrame) -> DataFrame:
    """id, tag, prompt, response of the kept verdicts(id, kept, tag), from the answer of the tag that each names (the first of its id).

    A kept id without such an answer or without a prompt is an error.
    """
    kept = verdicts.where("kept").select("id", "tag")
    made = log.join(kept, ["id", "tag"]).groupBy("id", "tag").agg(F.min_by("response", F.struct("file", "line")).alias("response"))
    lost = kept.join(made, ["id", "tag"], "left_anti").count()
    if lost:
        raise Integrity(f"{lost} kept ids have no generation")
    rows = made.join(prompts.select("id", "prompt"), "id", "left")
    return rows.withColumn("prompt", F.coalesce("prompt", F.raise_error(F.concat(F.lit("no prompt for "), "id")).cast("string")))


def check_inputs(prompts_digest: str, manifest_digest: str | None, answered_at: float, verified_at: float, kept: DataFrame, answers: DataFrame) -> tuple[str | None, str | None]:
    """(teacher, revision) of the kept answers; an error where the prompts are not the manifest's, the verdicts are older than the answers,
    or several teachers or revisions wrote what is kept."""
    if manifest_digest is not None and manifest_digest != prompts_digest:
        raise Integrity("the prompts are not those of their manifest")
    if answered_at > verified_at:
        raise Integrity("the answers are newer than their verdicts")
    who = answers.join(kept.where("kept").select("id"), "id", "left_semi").select("teacher", "revision").distinct().limit(2).collect()
    if len(who) > 1:
        raise Integrity("the kept answers come from more than one teacher or revision")
    return (who[0]["teacher"], who[0]["revision"]) if who else (None, None)

"""What surrounds a build: pinned files, repositories and their logs, candidates, benchmark needles, context files, signed passes."""

from __future__ import annotations

import hashlib
import hmac
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

#: The wait after the n-th failed attempt in seconds, attempts, and client errors that may pass by themselves.
WAIT_FIRST, WAIT_MOST, ATTEMPTS = 5, 300, 12
PASSING_STATUS = [408, 429]
#: Names of repositories, and what a Python or JavaScript manifest must hold.
REPO_NAME = r"^[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+$"
FLASK_LINE = r"(?im)^\s*[\"']?flask\s*([=<>~!\[;,\"']|$)"
#: Ranks of files by what others depend on, as (pattern, rank) in order; others come last.
DEPENDENCY_RANKS = [("^backend/models\\.py$", 0), ("^backend/app\\.py$", 1), ("^backend/tests/", 2), ("^backend/", 3), ("^frontend/src/api\\.js$", 4), ("^frontend/src/components/", 5), ("^frontend/src/App\\.jsx$", 6)]


def http_day(stamp: Column) -> Column:
    """The day of an HTTP date (Sun, 06 Nov 1994 08:49:37 GMT), or null."""
    return F.to_date(F.try_to_timestamp(F.regexp_replace(stamp, r"^[A-Za-z]{3}, | GMT$", ""), F.lit("dd MMM yyyy HH:mm:ss")))


def pinned_problem(served: Column, pinned: Column, cutoff: Column) -> Column:
    """Why a served file (struct size, etag, last_modified) is not the pinned one (struct size, etag, day): size, etag, late (or without a
    date), day; or null. Pinned nulls are not compared."""
    day = http_day(served["last_modified"])
    return (
        F.when(pinned["size"].isNotNull() & ~served["size"].eqNullSafe(pinned["size"]), "size")
        .when(pinned["etag"].isNotNull() & ~served["etag"].eqNullSafe(pinned["etag"]), "etag")
        .when(day.isNull() | (day > cutoff), "late")
        .when(pinned["day"].isNotNull() & (day != pinned["day"]), "day")
    )


def retry_wait(attempt: Column) -> Column:
    """Seconds to wait after a failed attempt, counted from 1."""
    return F.least(F.lit(WAIT_MOST).cast("double"), F.lit(WAIT_FIRST) * F.pow(F.lit(2.0), attempt - 1))


def is_permanent(status: Column) -> Column:
    """Whether asking again is of no use: client errors but those that pass."""
    return F.coalesce((status >= 400) & (status < 500) & ~status.isin(*PASSING_STATUS), F.lit(False))


def valid_repo(name: Column) -> Column:
    parts = F.split(name, "/")
    return F.coalesce(name.rlike(REPO_NAME) & ~F.exists(parts, lambda p: p.isin(".", "..")), F.lit(False))


def candidate_problem(rows: DataFrame, tags: Sequence[str]) -> DataFrame:
    """rows(repo, tag, stars) with why a candidate cannot be used: repo, tag, stars, repeated (without regard to case); or null."""
    first = rows.groupBy(F.lower("repo").alias("_r")).agg(F.min("line").alias("_first"))
    joined = rows.join(first, F.lower("repo").eqNullSafe(F.col("_r")), "left")
    problem = F.when(~valid_repo(F.col("repo")), "repo").when(~F.coalesce(F.col("tag").isin(*tags), F.lit(False)), "tag").when(F.coalesce(F.col("stars") < 0, F.lit(True)), "stars").when(F.col("line") > F.col("_first"), "repeated")
    return joined.withColumn("problem", problem).drop("_r", "_first")


def select_candidates(found: DataFrame, limit: int) -> DataFrame:
    """repo, tag, place: repositories found on both sides first, then confirmed ones, then the two sides in turn, up to a limit.

    found: repo, side, place (of its search), confirmed. Only the first `limit` of each kind are put in order.
    """
    by = found.groupBy("repo").agg(F.count_distinct("side").alias("sides"), F.min("side").alias("side"), F.min("place").alias("at"), F.max("confirmed").alias("confirmed"))
    kind = F.when(F.col("sides") > 1, 0).when(F.col("confirmed"), 1).otherwise(2)
    lane = F.when(kind == 2, F.col("side")).otherwise("")
    ranked = by.select("repo", kind.alias("kind"), lane.alias("lane"), F.when(kind == 2, F.col("side")).otherwise("full").alias("tag"), "at")
    ranked = ranked.withColumn("nth", F.row_number().over(Window.partitionBy("kind", "lane").orderBy("at", "repo"))).where(F.col("nth") <= limit)
    place = F.row_number().over(Window.orderBy("kind", "nth", "lane"))
    return ranked.withColumn("place", place).where(F.col("place") <= limit).select("repo", "tag", "place")


#: A log is written with --first-parent --numstat --format=%x01%H%x02%P%x02%B%x03: these characters stand between its parts.
LOG_START, LOG_FIELD, LOG_END = "\x01", "\x02", "\x03"


def parsed_log(raw: Column) -> Column:
    """Array of (sha, parents, message, changes: array of (path, added, removed)) of a log; binary files count no lines and renames take their new path."""
    entries = F.filter(F.split(raw, LOG_START), lambda e: F.contains(e, F.lit(LOG_END)))

    def change(line: Column) -> Column:
        f = F.split(line, "\t", 3)
        new = F.regexp_replace(F.regexp_replace(F.get(f, F.lit(2)), r"\{[^{}]* => ([^{}]*)\}", "$1"), r"^.* => ", "")
        return F.struct(F.replace(new, F.lit("//"), F.lit("/")).alias("path"), F.get(f, F.lit(0)).try_cast("long").alias("added"), F.get(f, F.lit(1)).try_cast("long").alias("removed"))

    def entry(e: Column) -> Column:
        head, stat = F.substring_index(e, LOG_END, 1), F.substring_index(e, LOG_END, -1)
        f = F.split(head, LOG_FIELD)
        lines = F.filter(F.split(stat, "\n"), lambda x: x.rlike(r"^(\d+|-)\t(\d+|-)\t"))
        parents = F.size(F.filter(F.split(F.get(f, F.lit(1)), " "), lambda p: p != ""))
        return F.struct(F.get(f, F.lit(0)).alias("sha"), parents.alias("parents"), F.regexp_replace(F.get(f, F.lit(2)), r"^\s+|\s+$", "").alias("message"), F.transform(lines, change).alias("changes"))

    return F.transform(entries, entry)


def docstrings(source: Column) -> Column:
    """The contents of the triple-quoted strings of a source, in order, without blank ones."""
    pattern = r"(?s)\"\"\"(.*?)\"\"\"|'''(.*?)'''"
    one, two = (F.regexp_extract_all(source, F.lit(pattern), F.lit(i)) for i in (1, 2))
    return F.filter(F.zip_with(one, two, lambda a, b: F.when(a != "", a).otherwise(b)), lambda d: F.trim(F.regexp_replace(d, r"\s", "")) != "")


def problem_needles(rows: DataFrame, item: str, prompt: str, solution: str) -> DataFrame:
    """item, kind, text: the prompt and solution of each problem as needles, and the solution, prompt and docstrings, each once, for n-grams."""
    needles = F.array(*[F.struct(F.lit("needle").alias("kind"), F.col(c).alias("text")) for c in (prompt, solution)])
    grams = F.transform(F.array_distinct(F.concat(F.array(F.col(solution), F.col(prompt)), docstrings(F.col(prompt)))), lambda t: F.struct(F.lit("grams").alias("kind"), t.alias("text")))
    return rows.select(item, F.explode(F.concat(needles, grams)).alias("n")).select(item, "n.kind", "n.text").where("text IS NOT NULL")


def dependency_rank(path: Column) -> Column:
    out = F.when(F.lit(False), 0)
    for pattern, rank in DEPENDENCY_RANKS:
        out = out.when(path.rlike(pattern), rank)
    return out.otherwise(len(DEPENDENCY_RANKS))


def context_paths(files: Column, wanted: Column) -> Column:
    """The wanted files that exist, once, by rank and name."""
    held = F.array_intersect(wanted, files)
    return F.transform(F.array_sort(F.transform(held, lambda p: F.struct(dependency_rank(p).alias("r"), p.alias("p")))), lambda x: x["p"])


def has_flask(name: Column, content: Column) -> Column:
    return name.rlike(r"(?i)(^|/)(requirements[^/]*\.txt|pyproject\.toml|setup\.py|pipfile)$") & content.rlike(FLASK_LINE)


def has_react(name: Column, content: Column) -> Column:
    """A package.json that lists react among its dependencies, of any kind."""
    found = F.lit(False)
    for part in ("dependencies", "devDependencies", "peerDependencies"):
        found = found | F.get_json_object(content, f"$.{part}.react").isNotNull()
    return name.rlike(r"(^|/)package\.json$") & found


def signer(key: bytes):
    """A column function: the keyed SHA-256 of a text."""

    @pandas_udf(StringType())
    def sign(text: pd.Series) -> pd.Series:
        return text.map(lambda t: None if t is None else hmac.new(key, t.encode(), hashlib.sha256).hexdigest())

    return sign


def checked_pass(value: Column, now: Column, sign) -> Column:
    """The session of a pass `sid.expiry.mac` that is genuine and has not run out, else null."""
    f = F.split(value, "\\.")
    sid, end, mac = (F.get(f, F.lit(i)) for i in range(3))
    good = (F.size(f) == 3) & end.rlike(r"^\d{1,18}$") & (mac == sign(F.concat(sid, F.lit("."), end))) & (end.try_cast("long") >= now)
    return F.when(F.coalesce(good, F.lit(False)), sid)


def same_code(a: Column, b: Column) -> Column:
    """Whether two sources are equal but for blank lines and white space at line ends."""

    def bare(text: Column) -> Column:
        lf = F.regexp_replace(text, r"\r\n?", "\n")
        kept = F.filter(F.transform(F.split(lf, "\n"), lambda x: F.regexp_replace(x, r"\s+$", "")), lambda x: x != "")
        return F.array_join(kept, "\n")

    return bare(a) == bare(b)

"""Queries on commits, paths and prompt problems derived from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import commits as C
from .registry import query, table

_MESSAGE = "CASE doc_id % 9 WHEN 0 THEN 'wip' WHEN 1 THEN 'Merge branch ''main'' into dev' WHEN 2 THEN 'Update files' WHEN 3 THEN 'Bump flask from 1 to 2' WHEN 4 THEN 'fix some small bugs' WHEN 5 THEN 'Update src/app.py' WHEN 6 THEN 'Revert \"Add search\"' ELSE 'Add search to the list of ' || source END"


@query(f"SELECT doc_id, length(m) < 12 OR regexp_matches(m, '(?i)^merge (branch|pull request|remote-tracking branch|tag|commit|[''\"])') OR starts_with(m, 'Revert \"') OR regexp_matches(m, '(?i)^((update|create|delete|rename|add) \\S*[./]\\S*|add files via upload)$') OR len(list_filter(string_split(lower(m), ' '), lambda w: w NOT IN ('update','updated','updates','fix','fixed','fixes','change','changes','changed','made','some','small','minor','code','bug','bugs','files','stuff','initial','first','commit','init','refactor','more','misc','wip'))) = 0 AS low_info FROM (SELECT doc_id, {_MESSAGE} AS m FROM documents)")
def low_info_messages(spark, sf):
    return table(spark, sf, "documents").select("doc_id", C.is_low_info(F.expr(_MESSAGE.replace("''", "\\'"))).alias("low_info"))


#: Of each rule a commit that breaks it and no earlier one; the texts of all others are the document's, short of secrets and long lines.
_RULES = ["merge", "root", "no_change", "whitespace_only", "too_many_files", "unsafe_path", "excluded_path", "file_type", "deleted_file", "too_many_lines", "too_long_file", "long_line", "marker_in_content", "secret", "unsafe_message", "dependency_only", "low_info_message"]
_CASES = "CASE doc_id % 18 " + " ".join(f"WHEN {i} THEN '{r}'" for i, r in enumerate(_RULES)) + " END"


@query(f"""WITH d AS (SELECT doc_id, text, string_split(regexp_replace(text, '\\n$', ''), chr(10)) AS l FROM documents),
t AS (SELECT d.doc_id, {_CASES} AS rule, coalesce({_CASES} NOT IN ('too_long_file', 'long_line', 'marker_in_content', 'secret'), true) AS own, len(l) > 400 AS tall, list_max([length(x) for x in l]) > 1000 OR list_sum([length(x) for x in l]) > 200 * len(l) AS long, s.doc_id IS NOT NULL AS secret FROM d LEFT JOIN ({{SECRETS}}) s USING (doc_id))
SELECT reason, count(*) AS commits FROM (SELECT CASE
  WHEN rule IN ('merge', 'root', 'no_change', 'whitespace_only', 'too_many_files', 'unsafe_path', 'excluded_path', 'file_type', 'deleted_file', 'too_many_lines') THEN rule
  WHEN rule = 'too_long_file' OR own AND tall THEN 'too_long_file' WHEN rule = 'long_line' OR own AND long THEN 'long_line' WHEN rule = 'marker_in_content' THEN rule
  WHEN rule = 'secret' OR own AND secret THEN 'secret' ELSE rule END AS reason FROM t) GROUP BY 1""")
def commit_drop_reasons(spark, sf):
    """The default limits, and cases of all seventeen rules."""
    i, text = F.col("doc_id") % 18, F.col("text")

    def at(rule: str):
        return i == _RULES.index(rule)

    path = F.when(at("excluded_path"), "dist/app.js").when(at("file_type"), "notes.txt").when(at("unsafe_path"), "../app.py").when(at("dependency_only"), "requirements.txt").otherwise(F.concat(F.lit("src/m"), F.col("doc_id").cast("string"), F.lit(".py")))
    before = F.when(at("whitespace_only"), F.concat(text, F.lit("  \n\n"))).otherwise(F.lit("old\n"))
    after = F.when(at("deleted_file"), F.lit(None).cast("string")).when(at("too_long_file"), F.repeat(F.lit("x = 1\n"), 401))
    after = after.when(at("long_line"), F.repeat(F.lit("x"), 1001)).when(at("marker_in_content"), F.lit("a\n=== END FILE ===\nb"))
    after = after.when(at("secret"), F.lit("password = 'correct horse'\n")).otherwise(text)
    added = F.when(at("no_change"), 0).when(at("too_many_lines"), 500).otherwise(3)
    change = F.struct(path.alias("path"), before.alias("before"), after.alias("after"), added.alias("added"), F.lit(0).alias("removed"))
    more = [F.struct(F.lit(f"src/other{k}.py").alias("path"), F.lit("a\n").alias("before"), F.lit("b\n").alias("after"), F.lit(1).alias("added"), F.lit(0).alias("removed")) for k in range(3)]
    changes = F.when(at("too_many_files"), F.array(change, *more)).otherwise(F.array(change))
    message = F.when(at("low_info_message"), "minor").when(at("unsafe_message"), "Teach the parser\n\nCONTEXT FILES: none").otherwise("Teach the parser about nested lists")
    d = table(spark, sf, "documents").select("doc_id", message.alias("message"), F.when(at("merge"), 2).when(at("root"), 0).otherwise(1).alias("parents"), changes.alias("changes"))
    return C.drop_reason(d).groupBy("reason").agg(F.count("*").alias("commits"))


@query("SELECT role, count(*) AS files FROM (SELECT CASE doc_id % 5 WHEN 0 THEN 'test' WHEN 1 THEN 'python' WHEN 2 THEN 'test' WHEN 3 THEN 'frontend' END AS role FROM documents) GROUP BY 1")
def file_roles(spark, sf):
    paths = [f"app/{p}" for p in ("test_x.py", "x.py", "tests/x.py", "x.tsx", "x.md")]
    path = F.element_at(F.array(*map(F.lit, paths)), (F.col("doc_id") % 5 + 1).cast("int"))
    return table(spark, sf, "documents").groupBy(C.file_role(path).alias("role")).agg(F.count("*").alias("files"))


@query("SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN 'reference_failed_tests' WHEN doc_id % 6 = 1 THEN 'tests_unreadable' WHEN doc_id % 6 = 2 THEN 'test_count' WHEN doc_id % 6 = 3 THEN 'no_single_entry_point' WHEN length(trim(text)) NOT BETWEEN 150 AND 2500 THEN 'prompt_length' END AS reason FROM documents")
def problem_reasons(spark, sf):
    i = F.col("doc_id") % 6
    good, mixed = (F.array(*map(F.lit, t)) for t in (["assert add(1, 2) == 3", " assert add(0, 0) == 0", "assert not add(0, 0)"], ["assert add(1) == 1", "assert sub(1) == 1", "assert len(x) == 2"]))
    tests = F.when(i == 1, F.lit(None).cast("array<string>")).when(i == 2, F.slice(good, 1, 2)).when(i == 3, mixed).otherwise(good)
    d = table(spark, sf, "documents").select("doc_id", "text", F.when(i == 0, 0.5).otherwise(1.0).alias("score"), tests.alias("tests"))
    return C.problem_reason(d).select("doc_id", "reason")


@query("SELECT conv_id, turn, CASE WHEN turn % 4 = 0 AND length(p) BETWEEN 15 AND 600 AND NOT regexp_matches(p, '\\n\\s*\\n| = |:\\s*(\\n|$)') THEN p END AS request FROM (SELECT conv_id, turn, trim(text) AS p FROM conversations)")
def follow_up_requests(spark, sf):
    said = F.concat(F.when(F.col("turn") % 4 == 0, "REQUEST: ").when(F.col("turn") % 4 == 1, "").when(F.col("turn") % 4 == 2, "REQUEST: REQUEST: ").otherwise("REQUEST: <a> <b "), "text")
    return table(spark, sf, "conversations").select("conv_id", "turn", C.parse_request(said).alias("request"))


@query("SELECT repo, path FROM (SELECT repo, path, row_number() OVER (PARTITION BY repo ORDER BY length(path) - length(replace(path, '/', '')), path) AS rn FROM (SELECT source AS repo, CASE doc_id % 4 WHEN 0 THEN 'package.json' WHEN 1 THEN 'web/package.json' WHEN 2 THEN 'a/b/' || doc_id || '/package.json' ELSE 'node_modules/package.json' END AS path FROM documents) WHERE length(path) - length(replace(path, '/', '')) <= 2 AND NOT contains(path, 'node_modules') GROUP BY repo, path) WHERE rn <= 3")
def manifest_paths(spark, sf):
    from pyspark.sql import Window

    i = F.col("doc_id") % 4
    path = F.when(i == 0, "package.json").when(i == 1, "web/package.json").when(i == 2, F.concat(F.lit("a/b/"), F.col("doc_id").cast("string"), F.lit("/package.json"))).otherwise("node_modules/package.json")
    d = table(spark, sf, "documents").select(F.col("source").alias("repo"), path.alias("path"), (F.size(F.split(path, "/")) - 1).alias("depth")).distinct()
    d = d.where((F.col("depth") <= 2) & ~F.array_contains(F.split("path", "/"), "node_modules"))
    return d.withColumn("rn", F.row_number().over(Window.partitionBy("repo").orderBy("depth", "path"))).where("rn <= 3").select("repo", "path")


def _link_secrets() -> None:
    from . import registry, text  # noqa: F401

    registry.ORACLES["commit_drop_reasons"] = registry.ORACLES["commit_drop_reasons"].replace("{SECRETS}", registry.ORACLES["secret_hits"])


_link_secrets()

"""From source rows to texts: keep rules, ways to render, carried counts of what was left out, and a chain of code filters."""

from __future__ import annotations

import ast
import json
import re
from collections.abc import Mapping, Sequence
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from ..functions import text as T


def drop_reason(keep: Mapping[str, Sequence], split: str | None = None, held_out: Column | None = None, text: str = "text") -> Column:
    """Why a row is left out: the first of dropped_<field> for a value that is not on the field's list, dropped_split,
    dropped_heldout, dropped_no_text; or null. A null value is on no list."""
    rules = [(f"dropped_{name}", ~F.coalesce(F.col(name).isin(*values), F.lit(False))) for name, values in keep.items()]
    if split is not None:
        rules.append(("dropped_split", ~F.col("split").eqNullSafe(F.lit(split))))
    if held_out is not None:
        rules.append(("dropped_heldout", F.coalesce(held_out, F.lit(False))))
    rules.append(("dropped_no_text", F.col(text).isNull()))
    out = F.when(F.lit(False), "")
    for name, broken in rules:
        out = out.when(broken, name)
    return out


def mark_held_out(rows: DataFrame, ids: DataFrame, key: str, name: str = "held_out") -> DataFrame:
    """rows with whether their key is among the held-out ids (a table of any size)."""
    known = ids.select(F.col(key)).distinct().withColumn(name, F.lit(True))
    return rows.join(known, key, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def held_out_ids(spark, paths: Sequence[str], key: str) -> DataFrame:
    """The distinct ids of some Parquet files."""
    return spark.read.parquet(*paths).select(key).where(F.col(key).isNotNull()).distinct()


def titled(title: Column, body: Column) -> Column:
    """title, a blank line, body; the body alone where the title is blank."""
    t, b = F.trim(F.coalesce(title, F.lit(""))), F.coalesce(body, F.lit(""))
    return F.when(t == "", b).otherwise(F.concat(t, F.lit("\n\n"), b))


def answered(prompt: Column, response: Column) -> Column:
    return F.concat(F.trim(F.coalesce(prompt, F.lit(""))), F.lit("\n\n"), F.trim(F.coalesce(response, F.lit(""))))


def question_link(url: Column) -> Column:
    """struct(site, question_id) of the address of a question, nulls for others."""
    pattern = r"^https?://([^/]+)/questions/(\d+)"
    found = [F.regexp_extract(url, pattern, i) for i in (1, 2)]
    return F.struct(*[F.when(x != "", x).alias(n) for x, n in zip(found, ("site", "question_id"), strict=True)])


@pandas_udf(StringType())
def literal_as_json(text: pd.Series) -> pd.Series:
    """Metadata written as a Python literal, or as JSON, as JSON; what is neither, or no dictionary, is empty."""

    def one(t: str | None) -> str:
        for read in (ast.literal_eval, json.loads):
            try:
                value = read(t or "{}")
            except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
                continue
            if isinstance(value, dict):
                return json.dumps(value, default=str)
        return "{}"

    return text.map(one)


def merged(metadata: Column, own: Mapping[str, Column]) -> Column:
    """A map of metadata (a JSON object) and a row's own fields, which win; null fields are left out."""
    given = F.coalesce(F.from_json(metadata, "map<string,string>"), F.create_map().cast("map<string,string>"))
    mine = F.map_filter(F.create_map(*[x for k, v in own.items() for x in (F.lit(k), v.cast("string"))]), lambda k, v: v.isNotNull())
    rest = F.map_filter(given, lambda k, v: ~F.array_contains(F.map_keys(mine), k))
    return F.map_concat(rest, mine)


#: Elements that start and end a line of text.
BREAKS = frozenset("address article aside blockquote br dd div dl dt figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table tr ul".split())


class _Plain(HTMLParser):
    """Text of HTML: breaks at block elements, preformatted text as it is, other white space as one space."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.pre = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in BREAKS:
            self.parts.append("\n")
        self.pre += tag == "pre"

    def handle_endtag(self, tag: str) -> None:
        if tag in BREAKS:
            self.parts.append("\n")
        self.pre -= tag == "pre" and self.pre > 0

    def handle_data(self, data: str) -> None:
        self.parts.append(data if self.pre else re.sub(r"\s+", " ", data))


def plain_html(html: str) -> str:
    """All text of a piece of HTML (that of scripts too), with at most one blank line between two others."""
    reader = _Plain()
    reader.feed(html)
    reader.close()
    lines = [x.rstrip() for x in "".join(reader.parts).split("\n")]
    kept = [x for i, x in enumerate(lines) if x or (i and lines[i - 1])]
    return "\n".join(kept).strip()


@pandas_udf(StringType())
def html_text(html: pd.Series) -> pd.Series:
    return html.map(lambda h: None if h is None else plain_html(h))


def carried(rows: DataFrame, file: str, order: str, reason: str, reasons: Sequence[str]) -> DataFrame:
    """The kept rows (reason is null) of each file in order, and one row an end of file (order null), each with how many rows
    were left out since the kept row before, by reason.

    One task reads one file's keys and reasons.
    """
    w = Window.partitionBy(file).orderBy(order)
    kept = F.col(reason).isNull()
    # the number of kept rows before a row says which kept row it is counted with
    part = F.sum(F.when(kept, 1).otherwise(0)).over(w) - F.when(kept, 1).otherwise(0)
    counted = rows.select(file, order, reason, part.alias("part")).groupBy(file, "part")
    return counted.agg(F.max(F.when(kept, F.col(order))).alias(order), *[F.count_if(F.col(reason) == r).alias(r) for r in reasons]).drop("part")


def source_counts(rows: DataFrame, file: str, language: str, languages: Sequence[str], licence: str, licences: Sequence[str]) -> DataFrame:
    """Per file: rows, rows of other languages, rows of other licences among the rest, and rows kept. Nulls are on no list."""
    lang, lic = (F.coalesce(F.col(c).isin(*v), F.lit(False)) for c, v in ((language, languages), (licence, licences)))
    return rows.groupBy(file).agg(F.count("*").alias("rows_scanned"), F.count_if(~lang).alias("dropped_language"), F.count_if(lang & ~lic).alias("dropped_license"), F.count_if(lang & lic).alias("kept"))


def source_rows(rows: DataFrame, language: str, languages: Sequence[str], licence: str, licences: Sequence[str]) -> DataFrame:
    """The rows of these languages and licences; both conditions reach a columnar scan."""
    return rows.where(F.col(language).isin(*languages) & F.col(licence).isin(*licences))


def script_buckets(rows: DataFrame, language: str, merged_language: str, scripts: Sequence[str]) -> DataFrame:
    """rows with a bucket: the language, or for the merged one each of its scripts, of which each has an equal share of its weight."""
    both = F.array(*[F.struct(F.lit(s).alias("bucket"), F.lit(1.0 / len(scripts)).alias("part")) for s in scripts])
    own = F.array(F.struct(F.col(language).alias("bucket"), F.lit(1.0).alias("part")))
    return rows.withColumn("b", F.explode(F.when(F.col(language) == merged_language, both).otherwise(own))).select(*rows.columns, "b.bucket", "b.part")


def code_reason(rows: DataFrame, languages: Sequence[str], licences: Sequence[str], longest: int) -> DataFrame:
    """rows(doc_id, lang, licence, text, path, leaked, contaminated) with the first reason: language, license, duplicate, leak,
    contaminated, blank, path reason, too_long; or null.

    A duplicate is a later row with the text of an earlier row of fitting language and licence; the first one of a text is found
    by an aggregate, so copies of one text gather in no task.
    """
    fits = [F.coalesce(F.col(c).isin(*v), F.lit(False)) for c, v in (("lang", languages), ("licence", licences))]
    keyed = rows.withColumn("key", F.sha2("text", 256))
    firsts = keyed.where(fits[0] & fits[1]).groupBy("key").agg(F.min("doc_id").alias("first_id"))
    path = T.code_path_reason(F.col("path"))
    reason = (
        F.when(~fits[0], "language")
        .when(~fits[1], "license")
        .when(F.col("doc_id") > F.col("first_id"), "duplicate")
        .when(F.col("leaked"), "leak")
        .when(F.col("contaminated"), "contaminated")
        .when(T.is_blank(F.col("text")), "blank")
        .when(path.isNotNull(), path)
        .when(F.length("text") > longest, "too_long")
    )
    return keyed.join(firsts, "key", "left").withColumn("reason", reason).drop("key", "first_id")

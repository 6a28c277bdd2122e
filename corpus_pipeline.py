"""A corpus pipeline over `documents` in four stages, each an operator whose decisions take effect on all that the one before kept.

1. language: documents without a language that could be learnt (no text, no letter) go;
2. near_duplicates: of documents linked by 85 % of their five-word shingles the one with the smallest doc_id stays;
   rows of equal doc_id stay or go together, and rows with a null doc_id stay;
3. repeated_substrings: bytes in 100-byte strings that also start earlier are taken out of the texts, n_chars
   follows, and documents of which no letter is left go;
4. packing: what is left is tokenised and packed into sequences of at most 1024 tokens; the result is one row per piece.

Extra columns of any name are kept by all stages but the last. What a stage stages for itself is dropped when the stage is
written, and its own rows when the next one is.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import langid, neardup, packing, substrings
from corpusloom.llm.common import Staged, free, staging

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = free("prediction", docs.columns)
    return langid.predict(docs, langid.train(docs)).where(F.col(f"{found}.lang_pred") != "und").drop(found)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    gone = neardup.near_duplicates(docs).where("NOT kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*[f"`{c}`" for c in docs.columns])


def repeated_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    left = substrings.remove(docs).withColumn("n_chars", F.char_length("text").cast("long"))
    return left.where(F.col("text").rlike(r"\p{L}")).select(*[f"`{c}`" for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeated_substrings", repeated_substrings),
    ("packing", pack),
]

#: The stages train a model, iterate, and tokenise, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents of a data folder; each stage is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before: Staged | None = None
    for name, stage in STAGES[:-1]:
        with staging() as made:
            made.keep(after := Staged(stage(spark, docs, sf_dir), f"pipeline-{name}"))
        if before is not None:
            before.drop()
        before, docs = after, after.df
    return STAGES[-1][1](spark, docs, sf_dir)

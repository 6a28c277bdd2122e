"""Sinks: token shards, provenance lines, numbered parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def provenance(meta: Column) -> Column:
    """A map column as one JSON line without its private (underscored) keys."""
    return F.to_json(F.map_filter(meta, lambda k, v: ~F.startswith(k, F.lit("_"))))


def json_parts(rows: DataFrame, path: str, by: list[str]) -> None:
    """JSON lines in folders by the given columns; the committer makes the write atomic."""
    rows.repartition(*by).write.mode("overwrite").partitionBy(*by).json(path)


def shard_table(rows: DataFrame, path: str) -> None:
    """A token table partitioned by split and shard."""
    rows.repartition("split", "shard").sortWithinPartitions("split", "shard", "start").write.mode("overwrite").partitionBy("split", "shard").parquet(path)


def missing_files(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """What a manifest lists and the store does not hold, and the reverse."""
    a = expected.select(key).exceptAll(actual.select(key)).withColumn("side", F.lit("missing"))
    return a.unionByName(actual.select(key).exceptAll(expected.select(key)).withColumn("side", F.lit("extra")))

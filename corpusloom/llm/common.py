"""What the operators of this subpackage share: tables, the shared folder, staged tables and range buckets."""

from __future__ import annotations

import atexit
import ctypes
import gc
import sys
import tempfile
import uuid
from collections.abc import Iterable, Iterator, Sequence
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, read by Spark so that any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, what: str) -> str:
    """A new path below the folder in spark.checkpoint.dir, which driver and executors share.

    Where the setting is absent a temporary folder of this machine is used and set in local mode (tests); on a cluster
    executors could not read it, so that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="corpusloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def drop_dir(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store; a missing one is no error."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


#: Staged tables that were not dropped, by path.
_HELD: dict[str, SparkSession] = {}


class Staged:
    """A DataFrame written as Parquet to the shared folder, which cuts its lineage."""

    def __init__(self, df: DataFrame, what: str) -> None:
        self.spark = df.sparkSession
        self.path = shared_dir(self.spark, what)
        schema = df.schema
        _HELD[self.path] = self.spark
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(schema).parquet(self.path)

    def drop(self) -> None:
        drop_dir(self.spark, self.path)
        _HELD.pop(self.path, None)


def drop_staged(paths: Iterable[str] | None = None) -> None:
    """Drop these staged tables, or all; what was read from them must have been written or used."""
    for path in list(_HELD if paths is None else paths):
        if (spark := _HELD.pop(path, None)) is not None:
            drop_dir(spark, path)


class _Kept(set):
    def keep(self, table: Staged) -> None:
        self.add(table.path)


@contextmanager
def staging() -> Iterator[_Kept]:
    """Drops the staged tables made within but those to keep."""
    kept = _Kept(_HELD)
    try:
        yield kept
    finally:
        drop_staged(set(_HELD) - kept)


@atexit.register
def _at_exit() -> None:
    """Results may read their staged tables as long as the session lives; what is left goes with it."""
    for path, spark in list(_HELD.items()):
        if spark.sparkContext._jsc is not None:
            drop_staged([path])


def free(name: str, columns: Iterable[str]) -> str:
    """name, with as many underscores after it as make it unlike all columns (case does not count)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def packed(df: DataFrame, columns: Iterable[str]) -> Column:
    """These columns of df as one struct, so that names that are added beside it cannot clash with them."""
    own = [F.col(f"`{c}`") for c in columns]
    return F.struct(*own) if own else F.struct(F.lit(True).alias("none"))


def forget_others(encoders: bool = True) -> None:
    """On an executor: drop what a worker that ran another operator before still holds for it; token caches only if asked to."""
    names = [("neardup", "_POWERS")] + [("encode", "_ENCODERS"), ("bpe", "_CODECS")] * encoders
    held = [getattr(m, a) for n, a in names if (m := sys.modules.get(f"{__package__}.{n}")) is not None]
    if any(held):
        for h in held:
            h.clear()
        gc.collect()
    # what was freed goes back to the system, as workers of several operators share an executor's memory
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner free the shuffle files of finished stages now: it acts on what the driver's garbage collection finds."""
    gc.collect()
    spark._jvm.System.gc()


def bounds(df: DataFrame, key: str, n: int) -> list[int]:
    """At most n - 1 ascending values that cut the long column into about equal parts."""
    if n <= 1:
        return []
    probs = [i / n for i in range(1, n)]
    found = df.agg(F.percentile_approx(key, probs, 100 * n).alias("q")).first()["q"]
    return sorted(set(found or []))


def bucket(key: Column, cuts: Sequence[int]) -> Column:
    """The number of cuts that are <= key, as a balanced tree of comparisons; null counts as the smallest key."""

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(key >= F.lit(cuts[mid]), tree(mid + 1, hi)).otherwise(tree(lo, mid))

    return tree(0, len(cuts))


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))

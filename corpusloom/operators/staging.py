"""Tables staged as Parquet in the folder that driver and executors share, which cuts their lineage."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows of keys that are sent to every task; beyond that both sides are shuffled.
SENT_ROWS = 1_000_000

_HELD: dict[str, SparkSession] = {}


def staged(df: DataFrame, what: str) -> DataFrame:
    """df written below spark.checkpoint.dir and read again; it is dropped when the session ends, as lazily read results need it until then.

    Where the setting is absent a temporary folder of this machine is used in local mode (tests); on a cluster executors could
    not read it, so that is an error.
    """
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="corpusloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    path, schema = f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}", df.schema
    _HELD[path] = spark
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


@atexit.register
def _at_exit() -> None:
    for path, spark in list(_HELD.items()):
        if spark.sparkContext._jsc is not None:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        _HELD.pop(path)

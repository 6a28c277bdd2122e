"""Streams: incremental builds with exact deduplication across runs, and a limiter of accepted rows per user."""

from __future__ import annotations

import collections
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def run_to_end(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process what has come since the checkpoint and stop; a run that was killed is taken up where it was."""
    q = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()


def dedup_stream(stream: DataFrame, keys: list[str], path: str, checkpoint: str, text: str = "text") -> None:
    """Write the first row of every text by the keys below path, over all runs of one checkpoint, and stop at the end.

    What was seen lies in a table of hashes beside the rows, which each batch is anti-joined with, so the stream holds no
    state. Batches are written under their number, so that one that is done again overwrites itself.
    """
    spark = stream.sparkSession
    hashed = F.sha2(F.concat_ws("\x00", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys], F.coalesce(text, F.lit(""))), 256)
    row = F.struct(*[F.col(f"`{c}`") for c in stream.columns])

    def one(batch: DataFrame, number: int) -> None:
        new = batch.select(row.alias("row"), hashed.alias("key")).dropDuplicates(["key"])
        if number:
            seen = spark.read.schema("key string, batch long").parquet(f"{path}/keys").where(F.col("batch") < number)
            new = new.join(seen, "key", "left_anti")
        new.select("key").write.mode("overwrite").parquet(f"{path}/keys/batch={number}")
        # the rows are found again by their keys, so that both tables hold the same ones
        own = spark.read.parquet(f"{path}/keys/batch={number}")
        rows = batch.select(row.alias("row"), hashed.alias("key")).dropDuplicates(["key"]).join(own, "key", "left_semi")
        rows.select("row.*").write.mode("overwrite").parquet(f"{path}/rows/batch={number}")

    stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


LIMIT_SCHEMA = "user_id long, event_id long, accepted boolean"


def limiter(per_hour: int, per_day: int):
    """A state function: a row is accepted while fewer than per_hour accepted rows lie in the hour before it and fewer than per_day in its UTC day."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, day, used = state.get if state.exists else ([], -1, 0)
        recent = collections.deque(held)
        # a key's rows may come as several batches in any order: 16 bytes of each are held until all are there
        events = pd.concat([rows[["event_id", "s"]] for rows in batches]).sort_values(["s", "event_id"])
        accepted = []
        for s in events["s"].tolist():
            if s // 86400 != day:
                day, used = int(s // 86400), 0
            while recent and recent[0] <= s - 3600:
                recent.popleft()
            accepted.append(len(recent) < per_hour and used < per_day)
            if accepted[-1]:
                recent.append(float(s))
                used += 1
        state.update((list(recent), day, used))
        for i in range(0, len(accepted), 10_000):
            own = events["event_id"].iloc[i : i + 10_000]
            yield pd.DataFrame({"user_id": key[0], "event_id": own, "accepted": accepted[i : i + 10_000]})

    return run


def limit_stream(events: DataFrame, per_hour: int, per_day: int) -> DataFrame:
    """user_id, event_id, accepted of events(user_id, event_id, s) in time order within a micro-batch."""
    return events.groupBy("user_id").applyInPandasWithState(limiter(per_hour, per_day), LIMIT_SCHEMA, "recent array<double>, day long, used long", "append", GroupStateTimeout.NoTimeout)

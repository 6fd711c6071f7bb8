"""Structured Streaming forms of the event feed and of session receipts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def event_stream(spark: SparkSession, path: str, schema, per_trigger: int = 8) -> DataFrame:
    """A folder of event files as a stream; back-pressure by files a trigger."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def feed(events: DataFrame, categories: list[str]) -> DataFrame:
    return events.where(F.col("event_type").isin(categories)) if categories else events


def sessions(events: DataFrame, key: str, time_us: str, final: str, ttl_us: int = 300_000_000, cap: int = 1000) -> DataFrame:
    """Receipts of sessions (key, first_us, n, closed): a session ends by its final event, or ttl_us of event
    time after its first. Needs columns key, time_us, event_type; keeps at most cap events a session."""
    timed = events.withColumn("_ts", F.timestamp_micros(time_us)).withWatermark("_ts", "1 minute")

    def fold(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        first, n = state.get if state.exists else (None, 0)
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({key: [k[0]], "first_us": [first], "n": [n], "closed": [False]})
            return
        # the rows of a key come in several frames, in no order
        for us, kind in pd.concat(frames).sort_values(time_us)[[time_us, "event_type"]].itertuples(index=False):
            first = us if first is None else first
            n = min(n + 1, cap)
            if kind == final:
                yield pd.DataFrame({key: [k[0]], "first_us": [first], "n": [n], "closed": [True]})
                first, n = None, 0
        if first is None:
            if state.exists:
                state.remove()
        else:
            state.update((first, n))
            state.setTimeoutTimestamp(max((first + ttl_us) // 1000, state.getCurrentWatermarkMs() + 1))

    kind = events.schema[key].dataType.simpleString()
    return timed.groupBy(key).applyInPandasWithState(fold, f"{key} {kind}, first_us long, n long, closed boolean", "first_us long, n long", "append", GroupStateTimeout.EventTimeTimeout)


def drain(stream: DataFrame, name: str, checkpoint: str) -> DataFrame:
    """Runs a stream over what is there and returns its rows, for tests and small inputs."""
    q = stream.writeStream.format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)

"""Event sources and sinks: reads by range and type, retention, batches, fan-out and copies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def without_replicas(blobs: DataFrame, failed: list[int]) -> DataFrame:
    """Tolerance of failed replicas is their removal from the input."""
    return blobs.where(~F.col("replica").isin(failed))


def of_types(events: DataFrame, types: list[str]) -> DataFrame:
    return events.where(F.col("type").isin(types)) if types else events


def query_events(events: DataFrame, since: int, until: int, limit: int = 200, types: list[str] | None = None) -> DataFrame:
    """The oldest rows of the closed range."""
    return of_types(events.where(F.col("ts_ns").between(since, until)), types or []).orderBy("ts_ns", "event_id").limit(limit)


DEFAULT_LIMIT, MAX_LIMIT = 100, 1000


def receipts(rows: DataFrame, since: int, until: int, retention: int, limit: int | None = None) -> DataFrame:
    """The oldest rows of [since, until), MAX_LIMIT at most; a range beyond the retention and limits under 1 are errors."""
    if until - since > retention:
        raise ValueError("time range exceeds retention window")
    if limit is not None and limit <= 0:
        raise ValueError("invalid limit")
    return rows.where((F.col("us") >= since) & (F.col("us") < until)).orderBy("us", "event_id").limit(min(limit or DEFAULT_LIMIT, MAX_LIMIT))


def positive_or(raw: Column, default: int) -> Column:
    n = raw.try_cast("long")
    return F.when(n > 0, n).otherwise(F.lit(default).cast("long"))


def within_ttl(rows: DataFrame, time: str, ttl: int) -> DataFrame:
    """Rows not older than ttl at the time of the newest."""
    return rows.crossJoin(F.broadcast(rows.agg(F.max(time).alias("_now")))).where(F.col(time) > F.col("_now") - ttl).drop("_now")


def append_by_day(rows: DataFrame, path: str, us: str = "us") -> None:
    """Appends in day partitions, so that retention drops whole folders."""
    rows.withColumn("day", F.floor(F.col(us) / 86_400_000_000)).write.mode("append").partitionBy("day").parquet(path)


def receipt_batches(rows: DataFrame, time: str, size: int) -> DataFrame:
    """Flushes of `size` ids; rows without a positive time are refused."""
    return rows.where(F.col(time) > 0).groupBy(F.floor(F.col("event_id") / size).alias("batch")).agg(F.count("*").alias("n"), F.min(time).alias("first_us"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """One row a key: the later of old and new."""
    rest = [c for c in old.columns if c not in keys]
    both = old.unionByName(new).withColumn("_o", order)
    return both.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_o").alias("w")).select(*keys, "w.*")


def fan_out(events: DataFrame, categories: list[str], slots: int) -> DataFrame:
    n = F.count("*")
    return of_types(events, categories).groupBy(F.col("type").alias("category")).agg(n.alias("sent"), F.greatest(n - slots, F.lit(0)).alias("dropped"))


def bounded_queue(events: DataFrame, period: str, size: int) -> DataFrame:
    n = F.count("*")
    return events.groupBy(period).agg(n.alias("offered"), F.least(n, F.lit(size)).alias("queued"), F.greatest(n - size, F.lit(0)).alias("dropped"))


def copy_outcomes(source: DataFrame, target: DataFrame, failed: Column) -> DataFrame:
    """Each source row with what a copy that skips existing keys does to it."""
    there = target.select("key").distinct().withColumn("_there", F.lit(True))
    return source.join(there, "key", "left").withColumn("outcome", F.when(F.col("_there"), "skipped").when(failed, "error").otherwise("copied"))


def read_through(local: DataFrame, upstream: DataFrame, key: str) -> DataFrame:
    return local.unionByName(upstream.join(local, key, "left_anti").select(local.columns))

"""Last-writer-wins resolution of replicated records.

The winner is the largest (mod_time, version_id, meta_seq, is_hard_deleted): a tombstone wins a full
tie. Every aggregate is a max_by, which combines before it shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def order_key() -> Column:
    return F.struct("mod_time", "version_id", "meta_seq", "is_hard_deleted")


def winner(blobs: DataFrame, *keys: str) -> DataFrame:
    """The winning record of each key."""
    rest = [c for c in blobs.columns if c not in keys]
    return blobs.groupBy(*keys).agg(F.max_by(F.struct(*rest), order_key()).alias("w")).select(*keys, "w.*")


def versions(blobs: DataFrame) -> DataFrame:
    return winner(blobs, "bucket", "key", "version_id")


def live_versions(blobs: DataFrame) -> DataFrame:
    """Versions without hard-deleted ones; delete markers stay."""
    return versions(blobs).where(~F.col("is_hard_deleted"))


def latest(blobs: DataFrame, markers: bool = False) -> DataFrame:
    """The latest live version of each key; keys hidden by a delete marker go unless markers."""
    out = winner(live_versions(blobs), "bucket", "key")
    return out if markers else out.where(~F.col("is_delete_marker"))


def with_is_latest(live: DataFrame) -> DataFrame:
    w = Window.partitionBy("bucket", "key").orderBy(F.desc("mod_time"), F.desc("version_id"))
    return live.withColumn("rk", F.row_number().over(w)).withColumn("is_latest", F.col("rk") == 1)


def decide_write(existing: DataFrame, candidates: DataFrame) -> DataFrame:
    """verdict of each candidate (bucket, key, cand_*): apply, skip, or reject_cas for a compare-and-swap
    that isn't exactly one step ahead in the same placement group."""
    both = candidates.join(existing, ["bucket", "key"], "left")
    in_place = F.coalesce(F.col("group_id"), F.lit("")).isin("") | (F.col("cand_group") == F.col("group_id"))
    next_seq = F.coalesce("meta_seq", F.lit(0)) + 1 == F.col("cand_seq")
    newer = F.col("mod_time").isNull() | (F.struct("cand_time", "cand_version", "cand_seq", F.lit(False).alias("x")) > F.struct(F.col("mod_time").alias("cand_time"), F.col("version_id").alias("cand_version"), F.col("meta_seq").alias("cand_seq"), F.col("is_hard_deleted").alias("x")))
    return both.withColumn("verdict", F.when(F.col("cas"), F.when(next_seq & in_place, "apply").otherwise("reject_cas")).when(newer, "apply").otherwise("skip"))

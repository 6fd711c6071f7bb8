"""Scans, pages and listings. Order is always the byte order of keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def scan(blobs: DataFrame, bucket: str, prefix: str = "") -> DataFrame:
    """Prefixes are literal; both conditions reach the file scan."""
    return blobs.where((F.col("bucket") == bucket) & F.col("key").startswith(prefix))


def scan_strict(blobs: DataFrame, bucket: str) -> DataFrame:
    """Fails on a record without key or version."""
    ok = F.when(F.col("key").isNull() | F.col("version_id").isNull(), F.raise_error(F.lit("bad record"))).otherwise(F.lit(True))
    return blobs.where(F.col("bucket") == bucket).where(ok)


def user_buckets(names: DataFrame) -> DataFrame:
    """Distinct names in order, without internal ones."""
    return names.distinct().where(~F.col("name").startswith("__")).orderBy("name")


def visible(entries: DataFrame) -> DataFrame:
    return entries.where(~F.col("is_delete_marker") & ~F.col("is_hard_deleted"))


def page(entries: DataFrame, marker: str, max_keys: int, *keys: str) -> DataFrame:
    """At most max_keys rows after marker in key order, with is_truncated; one more row is probed."""
    keys = keys or ("key",)
    probed = entries.where(F.col(keys[0]) > marker).orderBy(*keys).limit(max_keys + 1)
    # the page is bounded by max_keys, so its row numbers need no distribution
    n = F.row_number().over(Window.orderBy(*keys))
    total = F.count("*").over(Window.partitionBy())
    return probed.withColumn("rn", n).withColumn("is_truncated", total > max_keys).where(F.col("rn") <= max_keys).drop("rn")


def pages(entries: DataFrame, size: int, *partition: str) -> DataFrame:
    """Numbers the pages of a full listing per partition."""
    w = Window.partitionBy(*partition).orderBy("key")
    return entries.withColumn("page", F.floor((F.row_number().over(w) - 1) / size).cast("long"))


def token(key: Column) -> Column:
    return F.base64(F.encode(key, "UTF-8"))


def resume(v2: Column, token_: Column, start_after: Column, marker: Column) -> Column:
    """The key after which a page begins: version 2 has the token, else start-after; version 1 the marker."""
    decoded = from_token(token_)
    return F.when(~v2, marker).when(decoded != "", decoded).otherwise(start_after)


def from_token(t: Column) -> Column:
    return F.decode(F.unbase64(t), "UTF-8")

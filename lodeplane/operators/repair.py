"""Garbage collection, scrub and repair decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as fn


def needs_redundancy(now: int, min_age: int, redundant: Column) -> Column:
    return redundant & (F.col("ec_data") >= 1) & (F.col("ec_parity") == 0) & ~F.col("is_delete_marker") & (now - F.col("mod_time") >= min_age)


# The profiles (data + parity shards) from the narrowest to the widest.
PROFILES = ["1+0", "1+1", "2+1", "2+2", "3+2", "4+2", "5+2", "6+2"]


def redundant_capacity(groups: DataFrame) -> DataFrame:
    """One row: whether two nodes or more are there and the widest group would have parity."""
    widest = groups.groupBy("group_id").agg(F.count("*").alias("n"), F.collect_set("peer").alias("p"))
    out = widest.agg(F.max("n").alias("n"), F.size(F.array_distinct(F.flatten(F.collect_list("p")))).alias("nodes"))
    return out.select(((F.col("nodes") >= 2) & (fn.ec_profile(F.col("n"))[1] > 0)).alias("redundant"))


def _width(data: Column, parity: Column) -> Column:
    """Place of a profile from 1, 0 for one that is none."""
    return F.array_position(F.array(*map(F.lit, PROFILES)), F.concat_ws("+", data.cast("string"), parity.cast("string")))


def layouts(objects: DataFrame, groups: DataFrame, missing: list[str]) -> DataFrame:
    """layout of each object (with node_ids) against its group: unknown without one; repair-needed where nodes lack or
    are too many; downgrade-skipped where its profile is wider than the group's; repair-needed where a node is missing or
    not of the group; pending-upgrade where its profile is narrower; else current."""
    peers = groups.groupBy("group_id").agg(F.collect_set("peer").alias("peers"))
    actual, desired = _width(F.col("ec_data"), F.col("ec_parity")), _width(*fn.ec_profile(F.size("peers")))
    nodes, known = F.size("node_ids"), (actual > 0) & (desired > 0)
    astray = F.size(F.array_except("node_ids", "peers")) > 0
    gone = F.arrays_overlap("node_ids", F.array(*map(F.lit, missing)).cast("array<string>"))
    state = (
        F.when(F.col("peers").isNull(), "unknown")
        .when((nodes == 0) | (nodes != F.col("ec_data") + F.col("ec_parity")), "repair-needed")
        .when(known & (actual > desired), "downgrade-skipped")
        .when(astray | gone, "repair-needed")
        .when(~known, "unknown")
        .when(actual < desired, "pending-upgrade")
        .otherwise("current")
    )
    return objects.join(peers, "group_id", "left").withColumn("layout", state)


def attempt_order(nodes: Column, data: Column, parity: Column, demoted: list[str]) -> tuple[Column, Column]:
    """Shards to read first, and after those. Demoted data shards change places with the lowest parity shards that are
    not, one for one, unless there are too few of these; what is left for later has the demoted ones last."""
    upto = lambda a, n: F.when(n > 0, F.sequence(a, a + n - 1)).otherwise(F.array().cast("array<int>"))
    bad = lambda i: F.get(nodes, i).isin(demoted)
    first, rest = upto(F.lit(0), data), upto(data, parity)
    out, spare = F.filter(first, bad), F.filter(rest, lambda i: ~bad(i))
    swapped = F.slice(spare, 1, F.size(out))
    later = F.array_sort(F.concat(F.array_except(rest, swapped), out))
    short = F.size(out) > F.size(spare)
    return (
        F.when(short, first).otherwise(F.array_sort(F.concat(F.array_except(first, out), swapped))),
        F.when(short, rest).otherwise(F.concat(F.filter(later, lambda i: ~bad(i)), F.filter(later, bad))),
    )


def refcounts(refs: DataFrame) -> DataFrame:
    return refs.groupBy("chunk").agg(F.count_distinct("manifest").alias("refs"))


def gc_candidates(tombstones: DataFrame, refs: DataFrame, now: int, window: int) -> DataFrame:
    """Unreferenced chunks whose tombstone is strictly older than the window."""
    return tombstones.where(now - F.col("t_zero") > window).join(refs, "chunk", "left_anti")


def orphans(found: DataFrame, known: DataFrame, *keys: str) -> DataFrame:
    return found.join(known, list(keys), "left_anti")


def promoted(seen: DataFrame, key: str, cap: int) -> DataFrame:
    """Orphans (cycle, key) seen in two consecutive cycles, at most cap a cycle in key order."""
    before = F.lag("cycle").over(Window.partitionBy(key).orderBy("cycle"))
    twice = seen.withColumn("_b", before).where(F.col("_b") == F.col("cycle") - 1)
    return twice.withColumn("rn", F.row_number().over(Window.partitionBy("cycle").orderBy(key))).where(F.col("rn") <= cap).drop("_b")


def shard_states(expected: DataFrame, present: DataFrame) -> DataFrame:
    """missing, corrupt, unverified or healthy for each expected (key, idx)."""
    both = expected.join(present, ["key", "idx"], "left")
    state = F.when(F.col("ok").isNull() & F.col("read").isNull(), "missing").when(F.col("read") == "error", "unverified").when(~F.col("ok"), "corrupt").otherwise("healthy")
    return both.withColumn("state", state)


def replay_refs(log: DataFrame) -> DataFrame:
    """State of each chunk after an ordered add/remove log: refs and t_zero. The last operation of each
    (chunk, manifest) decides whether it refers; t_zero is the time of the removal that emptied the set."""
    last = log.groupBy("chunk", "manifest").agg(F.max_by("op", "seq").alias("op"))
    refs = last.groupBy("chunk").agg(F.count_if(F.col("op") == "add").alias("refs"))
    per_pair = Window.partitionBy("chunk", "manifest").orderBy("seq")
    step = F.when(F.col("op") == "add", 1).otherwise(0)
    delta = log.withColumn("d", step - F.coalesce(F.lag(step).over(per_pair), F.lit(0)))
    # only changes of the set count, so repeated adds and removes leave it alone
    running = F.sum("d").over(Window.partitionBy("chunk").orderBy("seq"))
    emptied = delta.withColumn("n", running).where("d = -1 and n = 0").groupBy("chunk").agg(F.max_by("t", "seq").alias("t_zero"))
    return refs.join(emptied, "chunk", "left").select("chunk", "refs", F.when(F.col("refs") == 0, F.col("t_zero")).alias("t_zero"))

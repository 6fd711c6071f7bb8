"""Node statistics, load balance and placement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def current(stats: DataFrame) -> DataFrame:
    """The last sample of each node; of samples at one time the largest."""
    return stats.groupBy("node_id").agg(F.max(F.struct("us", "disk_pct", "avail", "rps")).alias("s")).select("node_id", "s.disk_pct", "s.avail", "s.rps", "s.us")


def imbalance(value: str) -> Column:
    return F.when(F.count("*") < 2, F.lit(0.0)).otherwise(F.max(value) - F.min(value))


def upper_median(value: str) -> Column:
    """sorted[n / 2]; over nodes, of which there are few."""
    sorted_ = F.array_sort(F.collect_list(value))
    return F.get(sorted_, F.floor(F.size(sorted_) / 2).cast("int"))


def hysteresis(order: Window, value: Column, high: Column, low: Column) -> Column:
    """On above high, off below low, else as before; off at first."""
    return F.coalesce(F.last(F.when(value > high, True).when(value < low, False), ignorenulls=True).over(order), F.lit(False))


def rate(order: Window, counter: Column, time: Column, unit: float = 1e6) -> Column:
    """Per unit of time; resets count as 0, steps without time are null."""
    dt = time - F.lag(time).over(order)
    return F.when(dt > 0, F.greatest(F.lit(0), counter - F.lag(counter).over(order)) * unit / dt)


def _sha(key: str, node: Column) -> Column:
    return F.sha2(F.concat_ws("/", F.col(key), node), 256)


def _cost(key: str, node: Column, weight: Column) -> Column:
    """Negative weight / -ln(u), u in (0, 1) from the first 8 hexadecimal digits of the SHA-256: the smallest comes first."""
    u = (F.conv(F.substring(_sha(key, node), 1, 8), 16, 10).cast("double") + 1) / 4294967297.0
    return weight / F.log(u)


def _first(nodes: Column, score, width: int) -> Column:
    """The first `width` nodes by score, then by name."""
    ranked = F.array_sort(F.transform(nodes, lambda x: F.struct(score(x).alias("score"), x["node"].alias("node"))))
    return F.transform(F.slice(ranked, 1, width), lambda x: x["node"])


def rendezvous(keys: DataFrame, nodes: DataFrame, key: str, node: str, width: int) -> DataFrame:
    """Each key with its first `width` nodes by the SHA-256 of key/node, and their rank. The nodes are one row of
    configuration, and a key is ranked by itself, so nothing is exchanged but that row."""
    listed = nodes.agg(F.collect_list(F.struct(F.col(node).alias("node"))).alias("_nodes"))
    best = _first(F.col("_nodes"), lambda x: _sha(key, x["node"]), width)
    return keys.crossJoin(F.broadcast(listed)).select(*keys.columns, F.posexplode(best).alias("_at", node)).withColumn("rank", F.col("_at") + 1).drop("_at")


def placement(keys: DataFrame, members: DataFrame, key: str, node: str, weight: str, width: int) -> DataFrame:
    """Each key (with group_id) on the first `width` nodes of its group by weight; where fewer have a weight over 0, on
    the first of all of them without weights."""
    listed = members.groupBy("group_id").agg(F.collect_list(F.struct(F.col(node).alias("node"), F.col(weight).alias("w"))).alias("_nodes"))
    weighted = F.filter("_nodes", lambda x: x["w"] > 0)
    best = F.when(F.size(weighted) >= width, _first(weighted, lambda x: _cost(key, x["node"], x["w"]), width)).otherwise(_first(F.col("_nodes"), lambda x: _sha(key, x["node"]), width))
    return keys.join(listed, "group_id").select(*keys.columns, F.explode(best).alias(node))


def voters(members: DataFrame, node: str, width: int) -> DataFrame:
    """The first `width` nodes of each group by SHA-256, sorted by name; a node that is alone is named `width` times."""
    listed = members.groupBy("group_id").agg(F.collect_list(F.struct(F.col(node).alias("node"))).alias("_nodes"))
    alone = F.array_repeat(F.get("_nodes", F.lit(0))["node"], width)
    best = F.when(F.size("_nodes") == 1, alone).otherwise(F.array_sort(_first(F.col("_nodes"), lambda x: _sha("group_id", x["node"]), width)))
    return listed.select("group_id", best.alias("voters"))


def grace_trigger(start: Column, joined: Column, trigger: float, grace: int) -> Column:
    """The trigger, half as high again while a node joined less than `grace` ago."""
    return F.when(start - joined < grace, trigger * 1.5).otherwise(trigger)


def remove_peer(targets: DataFrame, peers: DataFrame) -> DataFrame:
    """Preflight of the removal of each target from peers (peer, voter, blocks, alive): not in the cluster, then peers that
    block, then a quorum of the other voters that would break, else allowed. Peers are configuration."""
    both = targets.crossJoin(F.broadcast(peers)).withColumn("other", F.col("peer") != F.col("removed"))
    quorum = F.floor(F.count_if(F.col("other") & F.col("voter")) / 2) + 1
    blocking = F.array_sort(F.collect_list(F.when(F.col("other") & F.col("blocks"), F.col("peer"))))
    here = F.bool_or((~F.col("other")))
    alive = F.count_if(F.col("other") & F.col("voter") & F.col("alive"))
    out = both.groupBy("removed").agg(here.alias("here"), quorum.alias("quorum"), blocking.alias("list"), alive.alias("n"))
    seen = F.col("here") & (F.size("list") == 0)
    verdict = F.when(~F.col("here"), "not-in-cluster").when(F.size("list") > 0, "identity-unresolved").when(F.col("n") < F.col("quorum"), "quorum-would-break").otherwise("allowed")
    return out.select("removed", "quorum", F.when(F.col("here"), F.array_join("list", ",")).otherwise("").alias("blocking"), F.when(seen, F.col("n")).otherwise(0).alias("alive"), verdict.alias("verdict"))

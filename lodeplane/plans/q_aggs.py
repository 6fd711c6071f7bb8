"""Aggregations (AGG), windows (WIN), order (SRT) and monitoring (PM) queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as fn
from ..operators import balance, listing, lww, metrics, repair
from ..sources import sinks
from ..sources.adapters import Tables
from .q_sources import ID, LAST_STATS, rows
from .registry import query

DAY_US = 86_400_000_000


def day() -> Column:
    return F.floor(F.col("us") / DAY_US)


@query("agg01", "SELECT bucket, key, version_id, mod_time, meta_seq, is_hard_deleted FROM (SELECT *, row_number() OVER (PARTITION BY bucket, key ORDER BY mod_time DESC, version_id DESC, meta_seq DESC, is_hard_deleted DESC) AS r FROM meta) WHERE r = 1")
def _(t):
    return lww.winner(t.meta, "bucket", "key").select(*ID, "mod_time", "meta_seq", "is_hard_deleted")


@query("agg02", "SELECT bucket, key, version_id, replica, meta_seq FROM versions")
def _(t):
    return lww.versions(t.meta).select(*ID, "replica", "meta_seq")


@query("agg03", "SELECT bucket, key, version_id FROM latest WHERE NOT is_delete_marker AND bucket = 'N'")
def _(t):
    return lww.latest(t.meta.where("bucket = 'N'")).select(*ID)


@query("agg04", "SELECT bucket, count(*) AS n_keys, count(*) FILTER (WHERE is_delete_marker) AS hidden, sum(size) FILTER (WHERE NOT is_delete_marker)::BIGINT AS bytes FROM latest GROUP BY bucket")
def _(t):
    return lww.latest(t.meta, markers=True).groupBy("bucket").agg(F.count("*").alias("n_keys"), F.count_if("is_delete_marker").alias("hidden"), F.sum(F.when(~F.col("is_delete_marker"), F.col("size"))).alias("bytes"))


@query("agg05", "SELECT DISTINCT bucket, key, version_id FROM meta")
def _(t):
    return t.meta.select(*ID).dropDuplicates(ID)


@query("agg06", "SELECT bucket, count(*) AS n FROM latest WHERE NOT is_delete_marker GROUP BY bucket")
def _(t):
    return lww.latest(t.meta).groupBy("bucket").agg(F.count("*").alias("n"))


@query("agg07", "SELECT chunk, count(DISTINCT manifest) AS refs FROM chunk_refs GROUP BY chunk")
def _(t):
    return repair.refcounts(t.chunk_refs)


@query("agg08", "SELECT us // 86400000000 AS day, CASE WHEN count(*) < 2 THEN 0 ELSE max(disk_pct) - min(disk_pct) END AS imbalance FROM node_stats GROUP BY 1")
def _(t):
    return t.node_stats.groupBy(day().alias("day")).agg(balance.imbalance("disk_pct").alias("imbalance"))


PEERS = f"SELECT a.node_id AS self, list_sort(list(b.rps))[count(*) // 2 + 1] AS median, min_by(b.node_id, (b.rps, b.node_id)) AS lightest FROM {LAST_STATS} a JOIN {LAST_STATS} b ON a.node_id <> b.node_id GROUP BY a.node_id"


@query("agg09", f"SELECT p.self, p.median, s.rps > p.median * 1.3 AS overloaded, CASE WHEN s.rps > p.median * 1.3 THEN p.lightest END AS target FROM ({PEERS}) p JOIN {LAST_STATS} s ON s.node_id = p.self")
def _(t):
    s = balance.current(t.node_stats).select("node_id", "rps")
    pairs = s.select(F.col("node_id").alias("self"), F.col("rps").alias("own")).join(F.broadcast(s), F.col("self") != F.col("node_id"))
    g = pairs.groupBy("self", "own").agg(balance.upper_median("rps").alias("median"), F.min_by("node_id", F.struct("rps", "node_id")).alias("lightest"))
    over = F.col("own") > F.col("median") * 1.3
    return g.select("self", "median", over.alias("overloaded"), F.when(over, F.col("lightest")).alias("target"))


@query("agg10", f"SELECT a.node_id AS self, min_by(b.node_id, (b.disk_pct, b.node_id)) AS dst FROM {LAST_STATS} a JOIN {LAST_STATS} b ON a.node_id <> b.node_id AND b.disk_pct < 90 GROUP BY a.node_id")
def _(t):
    s = balance.current(t.node_stats).select("node_id", "disk_pct")
    return s.select(F.col("node_id").alias("self")).join(F.broadcast(s.where("disk_pct < 90")), F.col("self") != F.col("node_id")).groupBy("self").agg(F.min_by("node_id", F.struct("disk_pct", "node_id")).alias("dst"))


@query("agg11", "SELECT us // 86400000000 AS day, round(avg(rps), 6) AS mean, round(avg(rps) * 1.25, 6) AS high, round(avg(rps) * 1.1, 6) AS low, max(us) AS updated FROM node_stats GROUP BY 1")
def _(t):
    return t.node_stats.groupBy(day().alias("day")).agg(F.round(F.avg("rps"), 6).alias("mean"), F.round(F.avg("rps") * 1.25, 6).alias("high"), F.round(F.avg("rps") * 1.1, 6).alias("low"), F.max("us").alias("updated"))


@query("agg13", "WITH p AS (SELECT cid, string_agg(peer, ',' ORDER BY us, event_id) AS peers FROM (SELECT *, row_number() OVER (PARTITION BY cid, peer ORDER BY us, event_id) AS f FROM heal_events) WHERE f = 1 GROUP BY cid) SELECT cid, min(us) AS first_us, (max(us) - min(us)) // 1000 AS duration_ms, count(*) FILTER (WHERE phase = 'detect' AND shard_id >= 0) AS lost, count(*) FILTER (WHERE phase = 'write' AND outcome = 'success' AND shard_id >= 0) AS rebuilt, peers, md5(string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY us, event_id)) AS ids FROM heal_events JOIN p USING (cid) GROUP BY cid, peers")
def _(t):
    shard = F.col("shard_id") >= 0
    g = t.heal_events.groupBy("cid").agg(F.array_sort(F.collect_list(F.struct("us", "event_id", "peer"))).alias("e"), F.min("us").alias("first_us"), F.floor((F.max("us") - F.min("us")) / 1000).alias("duration_ms"), F.count_if((F.col("phase") == "detect") & shard).alias("lost"),
        F.count_if((F.col("phase") == "write") & (F.col("outcome") == "success") & shard).alias("rebuilt"))
    peers, ids = F.array_distinct(F.transform("e", lambda x: x["peer"])), F.transform("e", lambda x: x["event_id"].cast("string"))
    return g.select("cid", "first_us", "duration_ms", "lost", "rebuilt", F.array_join(peers, ",").alias("peers"), F.md5(F.array_join(ids, ",")).alias("ids"))


@query("agg14", "SELECT bucket, count(*) FILTER (WHERE outcome = 'success') AS repaired, count(*) FILTER (WHERE outcome = 'failed') AS failed, bool_or(outcome = 'failed') AS partial FROM heal_events GROUP BY bucket")
def _(t):
    bad = F.col("outcome") == "failed"
    return t.heal_events.groupBy("bucket").agg(F.count_if(~bad).alias("repaired"), F.count_if(bad).alias("failed"), F.bool_or(bad).alias("partial"))


@query("agg15", f"WITH q AS (SELECT group_id, count(*) AS voters, count(*) FILTER (WHERE disk_pct < 60) AS alive, count(*) // 2 + 1 AS required, count(*) FILTER (WHERE disk_pct < 60) >= count(*) // 2 + 1 AS has_quorum FROM groups g LEFT JOIN {LAST_STATS} s ON s.node_id = g.peer GROUP BY group_id) SELECT q.*, q.has_quorum AND n.has_quorum AS joint FROM q JOIN q n ON n.group_id = concat('g', (CAST(substr(q.group_id, 2) AS INT) + 1) % 5)")
def _(t):
    s = balance.current(t.node_stats).select(F.col("node_id").alias("peer"), "disk_pct")
    alive, need = F.count_if(F.col("disk_pct") < 60), F.floor(F.count("*") / 2) + 1
    q = t.groups.join(s, "peer", "left").groupBy("group_id").agg(F.count("*").alias("voters"), alive.alias("alive"), need.alias("required"), (alive >= need).alias("has_quorum"))
    # while voters change from a group's to the next one's, both need their majority
    new = q.select(F.concat(F.lit("g"), ((F.substring("group_id", 2, 9).cast("int") + 4) % 5).cast("string")).alias("group_id"), F.col("has_quorum").alias("then"))
    return q.join(new, "group_id").select("group_id", "voters", "alive", "required", "has_quorum", (F.col("has_quorum") & F.col("then")).alias("joint"))


@query("agg16", f"WITH s AS (SELECT node_id, CASE WHEN disk_pct >= 90 THEN 'critical' WHEN disk_pct >= 50 THEN 'warn' ELSE 'ok' END AS state, CASE avail % 3 WHEN 0 THEN 'leader' WHEN 1 THEN 'follower' ELSE 'candidate' END AS role, greatest(0, avail - 50000) AS lag FROM {LAST_STATS}) SELECT 'members' AS metric, state AS label, count(node_id) AS n FROM (VALUES ('ok'), ('warn'), ('critical')) AS f(state) LEFT JOIN s USING (state) GROUP BY state UNION ALL SELECT 'role', concat(s.node_id, '=', r.role), CAST(s.role = r.role AS BIGINT) FROM s CROSS JOIN (VALUES ('leader'), ('follower'), ('candidate')) AS r(role) UNION ALL SELECT 'lag', node_id, lag FROM s")
def _(t):
    state = F.when(F.col("disk_pct") >= 90, "critical").when(F.col("disk_pct") >= 50, "warn").otherwise("ok")
    role = F.when(F.col("avail") % 3 == 0, "leader").when(F.col("avail") % 3 == 1, "follower").otherwise("candidate")
    s = balance.current(t.node_stats).select("node_id", state.alias("state"), role.alias("role"), F.greatest(F.lit(0), F.col("avail") - 50000).alias("lag"))
    members = rows(t, "('ok'), ('warn'), ('critical') AS f(state)").join(s, "state", "left").groupBy(F.lit("members").alias("metric"), F.col("state").alias("label")).agg(F.count("node_id").alias("n"))
    hot = F.explode(F.array(*[F.struct(F.lit(r).alias("r")) for r in ("leader", "follower", "candidate")])).alias("x")
    roles = s.select("node_id", "role", hot).select(F.lit("role").alias("metric"), F.concat("node_id", F.lit("="), "x.r").alias("label"), (F.col("role") == F.col("x.r")).cast("long").alias("n"))
    return members.unionByName(roles).unionByName(s.select(F.lit("lag").alias("metric"), F.col("node_id").alias("label"), F.col("lag").alias("n")))


@query("agg17", "SELECT node, type, CASE WHEN value <= 10 THEN '10' WHEN value <= 100 THEN '100' ELSE 'inf' END AS le, count(*) AS n, round(sum(value), 4) AS total FROM event_log GROUP BY 1, 2, 3")
def _(t):
    le = F.when(F.col("value") <= 10, "10").when(F.col("value") <= 100, "100").otherwise("inf")
    return t.event_log.groupBy("node", "type", le.alias("le")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("agg18", "SELECT concat(CAST(CAST(status AS INT) // 100 AS VARCHAR), 'xx') AS class, count(*) AS n FROM counters GROUP BY 1")
def _(t):
    return t.counters.groupBy(F.concat(F.floor(F.col("status").cast("int") / 100).cast("string"), F.lit("xx")).alias("class")).agg(F.count("*").alias("n"))


@query("agg19", f"SELECT max(w) AS min_required, (SELECT count(*) FROM {LAST_STATS} WHERE disk_pct < 60) AS live FROM (SELECT group_id, count(*) AS w FROM groups GROUP BY group_id)")
def _(t):
    live = balance.current(t.node_stats).agg(F.count_if(F.col("disk_pct") < 60).alias("live"))
    return t.groups.groupBy("group_id").agg(F.count("*").alias("w")).agg(F.max("w").alias("min_required")).crossJoin(F.broadcast(live))


@query("agg20", "SELECT DISTINCT peer FROM groups")
def _(t):
    return t.groups.select("peer").distinct().orderBy("peer")


@query("agg21", "SELECT group_id, n FROM (SELECT group_id, count(*) AS n, rank() OVER (ORDER BY count(*) DESC) AS r FROM groups GROUP BY group_id) WHERE r = 1")
def _(t):
    w = t.groups.groupBy("group_id").agg(F.count("*").alias("n"))
    return w.join(F.broadcast(w.agg(F.max("n").alias("n"))), "n").select("group_id", "n")


@query("agg22", "SELECT upload_id, count(*) AS n, sum(size)::BIGINT AS bytes, coalesce(min_by(error, r) FILTER (WHERE error IS NOT NULL), 'ok') AS verdict FROM (SELECT upload_id, size, r, CASE WHEN part_number NOT BETWEEN 1 AND 10000 THEN 'InvalidPart' WHEN part_number = before THEN 'DuplicatePart' WHEN trim(asked, '\"') <> etag THEN 'ETagMismatch' WHEN size < 5242880 AND r < n THEN 'EntityTooSmall' END AS error FROM (SELECT *, CASE WHEN size = 49 * 1048576 THEN 'x' WHEN part_number % 2 = 0 THEN '\"' || etag || '\"' ELSE etag END AS asked, lag(part_number) OVER w AS before, row_number() OVER w AS r, count(*) OVER (PARTITION BY upload_id) AS n FROM parts WINDOW w AS (PARTITION BY upload_id ORDER BY part_number, etag, size))) GROUP BY upload_id")
def _(t):
    asked = F.when(F.col("size") == 49 * 1048576, "x").when(F.col("part_number") % 2 == 0, F.concat(F.lit('"'), "etag", F.lit('"'))).otherwise(F.col("etag"))
    w = Window.partitionBy("upload_id").orderBy("part_number", "etag", "size")
    error = (
        F.when(~F.col("part_number").between(1, 10000), "InvalidPart").when(F.col("part_number") == F.lag("part_number").over(w), "DuplicatePart")
        .when(F.btrim(asked, F.lit('"')) != F.col("etag"), "ETagMismatch").when((F.col("size") < 5242880) & F.lead("part_number").over(w).isNotNull(), "EntityTooSmall")
    )
    p = t.parts.withColumn("error", error).withColumn("at", F.when(F.col("error").isNotNull(), F.struct("part_number", "etag", "size")))
    return p.groupBy("upload_id").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), F.coalesce(F.min_by("error", "at"), F.lit("ok")).alias("verdict"))


@query("agg23", "SELECT upload_id, concat(md5(unhex(string_agg(etag, '' ORDER BY part_number, etag))), '-', count(*)) AS etag FROM parts GROUP BY upload_id")
def _(t):
    etags = F.transform(F.array_sort(F.collect_list(F.struct("part_number", "etag"))), lambda x: x["etag"])
    return t.parts.groupBy("upload_id").agg(fn.composite_etag(etags).alias("etag"))


@query("agg24", "SELECT node, string_agg(concat(type, '=', n), ', ' ORDER BY n DESC, type) AS top FROM (SELECT node, type, count(*) AS n FROM event_log GROUP BY 1, 2) GROUP BY node")
def _(t):
    n = t.event_log.groupBy("node", "type").agg(F.count("*").alias("n"))
    named = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "type"))), lambda x: F.concat(x["type"], F.lit("="), (-x["m"]).cast("string")))
    return n.groupBy("node").agg(F.array_join(named, ", ").alias("top"))


@query("agg25", "SELECT count(*) FILTER (WHERE outcome = 'success') AS copied, count(*) FILTER (WHERE shard_id < 0) AS skipped, count(*) FILTER (WHERE outcome = 'failed') AS errors FROM heal_events")
def _(t):
    return t.heal_events.agg(F.count_if(F.col("outcome") == "success").alias("copied"), F.count_if(F.col("shard_id") < 0).alias("skipped"), F.count_if(F.col("outcome") == "failed").alias("errors"))


@query("agg26", "SELECT DISTINCT bucket, version_id FROM (SELECT bucket, version_id FROM latest UNION ALL SELECT bucket, version_id FROM live WHERE size > 40)")
def _(t):
    return lww.latest(t.meta, markers=True).select("bucket", "version_id").unionByName(lww.live_versions(t.meta).where("size > 40").select("bucket", "version_id")).distinct()


EVIDENCE = "(SELECT node AS peer, max(us) AS at, bool_and(type <> 'error') AS ready FROM event_log GROUP BY node)"


@query("agg27", f"SELECT group_id, count(*) FILTER (WHERE e.peer IS NULL) AS unknown, count(*) FILTER (WHERE NOT e.ready) AS missing, count(*) FILTER (WHERE e.at < 1706400000000000) AS stale, coalesce(bool_and(e.ready AND e.at >= 1706400000000000), false) AND count(*) FILTER (WHERE e.peer IS NULL) = 0 AS allowed FROM groups g LEFT JOIN {EVIDENCE} e USING (peer) GROUP BY group_id")
def _(t):
    e = t.event_log.groupBy(F.col("node").alias("peer")).agg(F.max("us").alias("at"), F.bool_and(F.col("type") != "error").alias("ready"))
    fresh = F.col("at") >= 1706400000000000
    unknown = F.count_if(F.col("at").isNull())
    return t.groups.join(e, "peer", "left").groupBy("group_id").agg(unknown.alias("unknown"), F.count_if(~F.col("ready")).alias("missing"), F.count_if(~fresh).alias("stale"), (F.coalesce(F.bool_and(F.col("ready") & fresh), F.lit(False)) & (unknown == 0)).alias("allowed"))


@query("agg28", "SELECT bucket, sum(size)::BIGINT AS bytes, sum(size)::BIGINT + 100000 AS byte_limit FROM latest WHERE NOT is_delete_marker GROUP BY bucket")
def _(t):
    return lww.latest(t.meta).groupBy("bucket").agg(F.sum("size").alias("bytes"), (F.sum("size") + 100000).alias("byte_limit"))


ISSUES = f"(SELECT list_filter([CASE WHEN count(*) FILTER (WHERE disk_pct < 60) = 0 THEN 'leaderless' END, CASE WHEN count(*) = 1 THEN 'unwired' END, CASE WHEN max(avail) - min(avail) > 50000 THEN 'peer_lag' END], lambda x: x IS NOT NULL) AS issues FROM groups LEFT JOIN {LAST_STATS} s ON s.node_id = peer GROUP BY group_id)"


@query("agg29", f"SELECT count(*) AS total, count(*) FILTER (WHERE len(issues) = 0) AS healthy, sum(len(list_filter(issues, lambda x: x IN ('leaderless', 'unwired'))))::BIGINT AS leaderless, sum(len(list_filter(issues, lambda x: x = 'peer_lag')))::BIGINT AS lagging FROM {ISSUES}")
def _(t):
    s = balance.current(t.node_stats).select(F.col("node_id").alias("peer"), "disk_pct", "avail")
    found = [F.when(F.count_if(F.col("disk_pct") < 60) == 0, "leaderless"), F.when(F.count("*") == 1, "unwired"), F.when(F.max("avail") - F.min("avail") > 50000, "peer_lag")]
    i = t.groups.join(s, "peer", "left").groupBy("group_id").agg(F.array_compact(F.array(*found)).alias("issues"))
    of = lambda *names: F.sum(F.size(F.filter("issues", lambda x: x.isin(*names)))).cast("long")
    return i.agg(F.count("*").alias("total"), F.count_if(F.size("issues") == 0).alias("healthy"), of("leaderless", "unwired").alias("leaderless"), of("peer_lag").alias("lagging"))


@query("agg30", "SELECT us // 86400000000 AS day, count(DISTINCT node) >= 2 AND (count(DISTINCT node) FILTER (WHERE value > 150) > 1 OR max(user_id % 4) - min(user_id % 4) > 1) AS split FROM event_log GROUP BY 1")
def _(t):
    term = F.col("user_id") % 4
    nodes, leaders = F.count_distinct("node"), F.count_distinct(F.when(F.col("value") > 150, F.col("node")))
    return t.event_log.groupBy(day().alias("day")).agg(((nodes >= 2) & ((leaders > 1) | (F.max(term) - F.min(term) > 1))).alias("split"))


@query("agg31", "SELECT group_id, count(*) AS n FROM latest WHERE NOT is_delete_marker GROUP BY group_id")
def _(t):
    return lww.latest(t.meta).groupBy("group_id").agg(F.count("*").alias("n"))


@query("win01", "SELECT bucket, key, version_id, row_number() OVER (PARTITION BY bucket, key ORDER BY mod_time DESC, version_id DESC) = 1 AS is_latest FROM live")
def _(t):
    return lww.with_is_latest(lww.live_versions(t.meta)).select(*ID, "is_latest")


@query("win02", "SELECT bucket, key, version_id, CAST(rk - 2 AS INT) AS nc_rank FROM (SELECT *, row_number() OVER (PARTITION BY bucket, key ORDER BY mod_time DESC, version_id DESC) AS rk FROM live) WHERE rk > 1")
def _(t):
    from ..operators import lifecycle

    return lifecycle.noncurrent(lww.with_is_latest(lww.live_versions(t.meta))).select(*ID, "nc_rank")


@query("win03", "SELECT upload_id, part_number, etag, coalesce(sum(size) OVER (PARTITION BY upload_id ORDER BY part_number, etag, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM parts")
def _(t):
    w = Window.partitionBy("upload_id").orderBy("part_number", "etag", "size").rowsBetween(Window.unboundedPreceding, -1)
    return t.parts.select("upload_id", "part_number", "etag", F.coalesce(F.sum("size").over(w), F.lit(0)).alias("start"))


@query("win04", "SELECT key, peer, CAST(r AS INT) AS r FROM (SELECT key, peer, row_number() OVER (PARTITION BY key ORDER BY sha256(key || '/' || peer), peer) AS r FROM (SELECT DISTINCT key FROM latest) CROSS JOIN (SELECT DISTINCT peer FROM groups)) WHERE r <= 3")
def _(t):
    keys = lww.latest(t.meta, markers=True).select("key").distinct()
    return balance.rendezvous(keys, t.groups.select("peer").distinct(), "key", "peer", 3).select("key", "peer", F.col("rank").alias("r"))


ISLAND = "(SELECT *, us // 3600000000 - row_number() OVER (PARTITION BY node_id ORDER BY us // 3600000000) AS island FROM (SELECT node_id, us // 3600000000 * 3600000000 AS us, avg(rps) AS rps FROM node_stats GROUP BY 1, 2))"


def hourly(t: Tables) -> DataFrame:
    h = t.node_stats.groupBy("node_id", (F.floor(F.col("us") / 3600000000)).alias("hour")).agg(F.avg("rps").alias("rps"))
    return h.withColumn("island", F.col("hour") - F.row_number().over(Window.partitionBy("node_id").orderBy("hour")))


HOT = "coalesce(last_value(CASE WHEN rps > 60 THEN true WHEN rps < 40 THEN false END IGNORE NULLS) OVER (PARTITION BY node_id, island ORDER BY us), false)"


@query("win05", f"SELECT node_id, us // 3600000000 AS hour, {HOT} AS hot FROM {ISLAND}")
def _(t):
    w = Window.partitionBy("node_id", "island").orderBy("hour")
    return hourly(t).select("node_id", "hour", balance.hysteresis(w, F.col("rps"), F.lit(60), F.lit(40)).alias("hot"))


@query("win06", "SELECT day, imbalance, coalesce(last_value(CASE WHEN imbalance >= trigger_at THEN true WHEN imbalance < 118 THEN false END IGNORE NULLS) OVER (ORDER BY day), false) AS active FROM (SELECT day, imbalance, CASE WHEN day * 86400000000 - (SELECT max(j) FROM (SELECT min(us) AS j FROM node_stats GROUP BY node_id)) < 2 * 86400000000 THEN 119 * 1.5 ELSE 119 END AS trigger_at FROM (SELECT us // 86400000000 AS day, max(disk_pct) - min(disk_pct) AS imbalance FROM node_stats GROUP BY 1))")
def _(t):
    d = t.node_stats.groupBy(day().alias("day")).agg((F.max("disk_pct") - F.min("disk_pct")).alias("imbalance"))
    joined = t.node_stats.groupBy("node_id").agg(F.min("us").alias("us")).agg(F.max("us").alias("joined"))
    at = balance.grace_trigger(F.col("day") * 86400000000, F.col("joined"), 119.0, 2 * 86400000000)
    # one row a day: the series is small whatever the input
    state = F.last(F.when(F.col("imbalance") >= F.col("at"), True).when(F.col("imbalance") < 118, False), ignorenulls=True).over(Window.orderBy("day"))
    return d.crossJoin(F.broadcast(joined)).withColumn("at", at).select("day", "imbalance", F.coalesce(state, F.lit(False)).alias("active"))


@query("win07", "SELECT node, us, round(CASE WHEN us > lag(us) OVER w THEN greatest(0, value - lag(value) OVER w) * 1e6 / (us - lag(us) OVER w) END, 6) AS rate FROM counters WINDOW w AS (PARTITION BY node ORDER BY us)")
def _(t):
    w = Window.partitionBy("node").orderBy("us")
    return t.counters.select("node", "us", F.round(balance.rate(w, F.col("value"), F.col("us")), 6).alias("rate"))


@query("win08", f"SELECT node_id, hour, hot FROM (SELECT *, lag(hot) OVER (PARTITION BY node_id, island ORDER BY hour) AS was FROM (SELECT node_id, island, us // 3600000000 AS hour, {HOT} AS hot FROM {ISLAND})) WHERE coalesce(was, false) <> hot")
def _(t):
    w = Window.partitionBy("node_id", "island").orderBy("hour")
    h = hourly(t).withColumn("hot", balance.hysteresis(w, F.col("rps"), F.lit(60), F.lit(40)))
    return h.withColumn("was", F.coalesce(F.lag("hot").over(w), F.lit(False))).where("was <> hot").select("node_id", "hour", "hot")


SEEN = "(SELECT DISTINCT us // 86400000000 AS cycle, concat('s', event_id % 331) AS key FROM event_log)"


@query("win09", f"SELECT cycle, key FROM (SELECT cycle, key, row_number() OVER (PARTITION BY cycle ORDER BY key) AS r FROM (SELECT cycle, key, lag(cycle) OVER (PARTITION BY key ORDER BY cycle) AS b FROM {SEEN}) WHERE b = cycle - 1) WHERE r <= 50")
def _(t):
    seen = t.event_log.select(day().alias("cycle"), F.concat(F.lit("s"), (F.col("event_id") % 331).cast("string")).alias("key")).distinct()
    return repair.promoted(seen, "key", 50).select("cycle", "key")


@query("win10", "SELECT node, us, round((value - fv) / ((us - fu) / 1e6), 9) AS slope FROM (SELECT node, us, value, first_value(value) OVER w AS fv, first_value(us) OVER w AS fu FROM event_log WINDOW w AS (PARTITION BY node ORDER BY us, event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)) WHERE us - fu >= 300000000")
def _(t):
    w = Window.partitionBy("node").orderBy("us", "event_id").rowsBetween(-19, 0)
    d = t.event_log.select("node", "us", "value", F.first("value").over(w).alias("fv"), F.first("us").over(w).alias("fu")).where("us - fu >= 300000000")
    return d.select("node", "us", F.round((F.col("value") - F.col("fv")) / ((F.col("us") - F.col("fu")) / 1e6), 9).alias("slope"))


@query("win11", "SELECT node, event_id, count(*) OVER (PARTITION BY node ORDER BY us RANGE BETWEEN 21599999999 PRECEDING AND CURRENT ROW) AS flaps FROM event_log WHERE type = 'error'")
def _(t):
    w = Window.partitionBy("node").orderBy("us").rangeBetween(-21599999999, 0)
    return t.event_log.where("type = 'error'").select("node", "event_id", F.count("*").over(w).alias("flaps"))


@query("win13", "SELECT node, us FROM (SELECT *, row_number() OVER (PARTITION BY node, run ORDER BY us) AS n FROM (SELECT *, sum(CASE WHEN type IN ('error', 'signup') THEN 0 ELSE 1 END) OVER (PARTITION BY node ORDER BY us) AS run FROM event_log) WHERE type IN ('error', 'signup')) WHERE n = 3")
def _(t):
    return metrics.runs(t.event_log, F.col("type").isin("error", "signup"), "us", "node").where("n = 3").select("node", "us")


@query("win14", f"WITH p AS (SELECT group_id, peer, CASE WHEN disk_pct < 60 THEN avail ELSE 0 END AS w FROM groups LEFT JOIN {LAST_STATS} s ON s.node_id = peer), q AS (SELECT *, count(*) FILTER (WHERE w > 0) OVER (PARTITION BY group_id) >= 2 AS ok FROM p), k AS (SELECT DISTINCT key, group_id FROM latest WHERE bucket = 'A') SELECT key, peer FROM (SELECT key, peer, row_number() OVER (PARTITION BY key ORDER BY CASE WHEN ok THEN w / -ln(((CAST('0x' || substr(sha256(key || '/' || peer), 1, 8) AS BIGINT) + 1) / 4294967297.0::DOUBLE)) END DESC, CASE WHEN NOT ok THEN sha256(key || '/' || peer) END, peer) AS r FROM k JOIN q USING (group_id) WHERE NOT ok OR w > 0) WHERE r <= 2")
def _(t):
    keys = lww.latest(t.meta.where("bucket = 'A'"), markers=True).select("key", "group_id")
    s = balance.current(t.node_stats).select(F.col("node_id").alias("peer"), "avail", "disk_pct")
    members = t.groups.join(s, "peer", "left").withColumn("w", F.when(F.col("disk_pct") < 60, F.col("avail")).otherwise(0).cast("double"))
    return balance.placement(keys, members, "key", "peer", "w", 2).select("key", "peer")


@query("win15", "SELECT group_id, CASE WHEN max(n) = 1 THEN concat_ws(',', max(peer), max(peer), max(peer)) ELSE string_agg(peer, ',' ORDER BY peer) END AS voters FROM (SELECT group_id, peer, count(*) OVER (PARTITION BY group_id) AS n, row_number() OVER (PARTITION BY group_id ORDER BY sha256(group_id || '/' || peer)) AS r FROM groups) WHERE r <= 3 GROUP BY group_id")
def _(t):
    return balance.voters(t.groups, "peer", 3).select("group_id", F.array_join("voters", ",").alias("voters"))


@query("srt01", "SELECT key FROM latest WHERE bucket = 'A' AND NOT is_delete_marker")
def _(t):
    return lww.latest(t.meta.where("bucket = 'A'")).select("key").orderBy("key")


@query("srt02", "SELECT key, version_id, mod_time FROM live WHERE bucket = 'R'")
def _(t):
    return lww.live_versions(t.meta.where("bucket = 'R'")).orderBy("key", F.desc("mod_time"), F.desc("version_id")).select("key", "version_id", "mod_time")


@query("srt03", "SELECT key, (SELECT count(*) FROM latest WHERE bucket = 'A' AND NOT is_delete_marker AND key > '00000050') > 20 AS is_truncated FROM latest WHERE bucket = 'A' AND NOT is_delete_marker AND key > '00000050' ORDER BY key LIMIT 20")
def _(t):
    return listing.page(lww.latest(t.meta.where("bucket = 'A'")), "00000050", 20).select("key", "is_truncated")


ASKS = "(1, true, 'MDAwMDAwMTE=', '00000040', '00000070'), (2, true, '', '00000040', '00000070'), (3, false, 'MDAwMDAwMTE=', '00000040', '00000070'), (4, true, '', '', '00000070')"


@query("srt04", f"SELECT req, key, base64(encode(key)) AS token FROM (SELECT r.req, l.key, row_number() OVER (PARTITION BY r.req ORDER BY l.key) AS n FROM latest l JOIN (SELECT req, CASE WHEN NOT v2 THEN marker WHEN token <> '' THEN decode(from_base64(token)) ELSE start_after END AS marker FROM (VALUES {ASKS}) AS r(req, v2, token, start_after, marker)) r ON l.key > r.marker WHERE l.bucket = 'A') WHERE n <= 30")
def _(t):
    asks = rows(t, f"{ASKS} AS r(req, v2, token, start_after, marker)")
    after = asks.select("req", listing.resume(F.col("v2"), F.col("token"), F.col("start_after"), F.col("marker")).alias("after"))
    found = lww.latest(t.meta.where("bucket = 'A'"), markers=True).select("key").join(F.broadcast(after), F.col("key") > F.col("after"))
    n = F.row_number().over(Window.partitionBy("req").orderBy("key"))
    return found.withColumn("n", n).where("n <= 30").select("req", "key", listing.token(F.col("key")).alias("token"))


@query("srt05", "SELECT bucket, key, version_id FROM (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY key) AS r FROM latest WHERE NOT is_delete_marker) WHERE r <= 15")
def _(t):
    w = Window.partitionBy("bucket").orderBy("key")
    return lww.latest(t.meta).withColumn("r", F.row_number().over(w)).where("r <= 15").select(*ID)


@query("srt06", "SELECT c_name FROM customer WHERE c_name > 'Customer#000000100' ORDER BY c_name LIMIT 40")
def _(t):
    return t.customer.where("c_name > 'Customer#000000100'").orderBy("c_name").limit(40).select("c_name")


@query("srt07", "SELECT cid, max(us) AS updated FROM facts GROUP BY cid ORDER BY updated DESC, cid DESC LIMIT 50")
def _(t):
    return t.facts.groupBy("cid").agg(F.max("us").alias("updated")).orderBy(F.desc("updated"), F.desc("cid")).limit(50)


@query("srt08", "SELECT event_id, us FROM heal_events ORDER BY us DESC, event_id DESC LIMIT 75")
def _(t):
    return t.heal_events.orderBy(F.desc("us"), F.desc("event_id")).limit(75).select("event_id", "us")


@query("srt09", "SELECT event_id, us FROM heal_events WHERE us >= 1704153600000000 AND us < 1705881600000000 ORDER BY us, event_id LIMIT 1000")
def _(t):
    return sinks.receipts(t.heal_events, 1704153600000000, 1705881600000000, 30 * 86400000000, 5000).select("event_id", "us")


@query("srt10", "SELECT u.upload_id, u.key, u.initiated, p.part_number FROM (SELECT * FROM uploads WHERE bucket = 'O' AND starts_with(key, '000000') ORDER BY initiated, key, upload_id LIMIT 200) u LEFT JOIN (SELECT upload_id, part_number, row_number() OVER (PARTITION BY upload_id ORDER BY part_number, etag, size) AS r FROM parts WHERE part_number > 0) p ON p.upload_id = u.upload_id AND p.r <= 2")
def _(t):
    page = t.uploads.where("bucket = 'O' AND startswith(key, '000000')").orderBy("initiated", "key", "upload_id").limit(200)
    # the page is bounded by its limit
    listed = t.parts.where("part_number > 0").join(F.broadcast(page.select("upload_id")), "upload_id", "left_semi")
    r = F.row_number().over(Window.partitionBy("upload_id").orderBy("part_number", "etag", "size"))
    return page.join(listed.withColumn("r", r).where("r <= 2"), "upload_id", "left").select("upload_id", "key", "initiated", "part_number")


@query("srt11", "SELECT cid, string_agg(type, '>' ORDER BY us, seq) AS story FROM facts GROUP BY cid")
def _(t):
    return t.facts.groupBy("cid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("us", "seq", "type"))), lambda x: x["type"]), ">").alias("story"))


DEMOTED = "['n1', 'n5', 'n6']"
ATTEMPTS = f"""WITH o AS (SELECT key, ec_data AS k, ec_parity AS m, list_transform(range(0, ec_data + ec_parity), lambda i: concat('n', (CAST(key AS BIGINT) * 3 + i) % 8)) AS nodes FROM latest WHERE bucket = 'A' AND NOT is_delete_marker),
    p AS (SELECT *, list_filter(range(0, k), lambda i: list_contains({DEMOTED}, nodes[i + 1])) AS gone, list_filter(range(k, k + m), lambda i: NOT list_contains({DEMOTED}, nodes[i + 1])) AS spare FROM o),
    q AS (SELECT *, list_filter(spare, lambda x, j: j <= len(gone)) AS swapped FROM p),
    r AS (SELECT *, list_sort(list_concat(list_filter(range(k, k + m), lambda i: NOT list_contains(swapped, i)), gone)) AS later FROM q)
    SELECT key, array_to_string(CASE WHEN len(gone) > len(spare) THEN range(0, k) ELSE list_sort(list_concat(list_filter(range(0, k), lambda i: NOT list_contains(gone, i)), swapped)) END, ',') AS first,
        array_to_string(CASE WHEN len(gone) > len(spare) THEN range(k, k + m) ELSE list_concat(list_filter(later, lambda i: NOT list_contains({DEMOTED}, nodes[i + 1])), list_filter(later, lambda i: list_contains({DEMOTED}, nodes[i + 1]))) END, ',') AS later FROM r"""


@query("srt12", ATTEMPTS)
def _(t):
    node = lambda i: F.concat(F.lit("n"), ((F.col("key").cast("long") * 3 + i) % 8).cast("string"))
    o = lww.latest(t.meta.where("bucket = 'A'")).withColumn("nodes", F.transform(F.sequence(F.lit(0), F.col("ec_data") + F.col("ec_parity") - 1), node))
    first, later = repair.attempt_order(F.col("nodes"), F.col("ec_data"), F.col("ec_parity"), ["n1", "n5", "n6"])
    return o.select("key", F.array_join(first.cast("array<string>"), ",").alias("first"), F.array_join(later.cast("array<string>"), ",").alias("later"))


INC = "(SELECT *, CASE WHEN value >= lag(value) OVER w THEN value - lag(value) OVER w WHEN lag(value) OVER w IS NOT NULL THEN value END AS inc, us // 300000000 AS win FROM counters WINDOW w AS (PARTITION BY node, status ORDER BY us))"


def increased(t: Tables) -> DataFrame:
    return metrics.windowed(metrics.increases(t.counters, "node", "status"), 300_000_000)


@query("pm01", f"SELECT us // 86400000000 AS day, round(sum(CASE WHEN starts_with(status, '5') THEN inc ELSE 0 END) / CASE WHEN sum(inc) > 0 THEN sum(inc) END, 9) AS ratio FROM {INC} GROUP BY 1")
def _(t):
    return increased(t).groupBy(day().alias("day")).agg(F.round(metrics.ratio(F.col("status").startswith("5"), "inc"), 9).alias("ratio"))


RATES = "(SELECT day, le, sum(n / 86400.0::DOUBLE) AS n FROM buckets_day GROUP BY day, le)"
QUANT = f"(SELECT day, round(low + (le - low) * (0.99::DOUBLE * total - below) / (n - below), 6) AS quantile FROM (SELECT *, max(n) OVER (PARTITION BY day) AS total, coalesce(lag(le) OVER (PARTITION BY day ORDER BY le), 0) AS low, coalesce(lag(n) OVER (PARTITION BY day ORDER BY le), 0) AS below FROM {RATES}) WHERE n >= 0.99::DOUBLE * total AND below < 0.99::DOUBLE * total)"


def daily_p99(t: Tables) -> DataFrame:
    rates = t.buckets_day.groupBy("day", "le").agg(F.sum(F.col("n") / 86400.0).alias("n"))
    return metrics.histogram_quantile(rates, 0.99, "day").select("day", F.round("quantile", 6).alias("quantile"))


@query("pm02", f"SELECT * FROM {QUANT}")
def _(t):
    return daily_p99(t)


@query("pm03", f"SELECT node, status, win, sum(inc)::BIGINT AS increase FROM {INC} GROUP BY 1, 2, 3 HAVING sum(inc) > 0")
def _(t):
    return increased(t).groupBy("node", "status", "win").agg(F.sum("inc").alias("increase")).where("increase > 0")


@query("pm04", "SELECT DISTINCT node, us // 21600000000 AS win FROM counters a WHERE NOT EXISTS (SELECT 1 FROM counters b WHERE b.node = a.node AND b.us // 21600000000 = a.us // 21600000000 - 1)")
def _(t):
    return metrics.unless_before(metrics.windowed(t.counters, 21_600_000_000), 1, "node")


@query("pm05", "SELECT node, min(value) AS low, max(value) AS high, sum(value)::BIGINT AS total FROM counters WHERE regexp_full_match(status, '(4|5)..') GROUP BY node")
def _(t):
    return t.counters.where(F.col("status").rlike("^(4|5)..$")).groupBy("node").agg(F.min("value").alias("low"), F.max("value").alias("high"), F.sum("value").alias("total"))


@query("pm06", "SELECT node, us FROM (SELECT *, us - min(us) OVER (PARTITION BY node, run ORDER BY us) AS held FROM (SELECT *, sum(CASE WHEN value > 20 THEN 0 ELSE 1 END) OVER (PARTITION BY node ORDER BY us) AS run FROM event_log) WHERE value > 20) WHERE held >= 3600000000")
def _(t):
    r = metrics.runs(t.event_log, F.col("value") > 20, "us", "node").where("on")
    return r.withColumn("held", F.col("us") - F.min("us").over(Window.partitionBy("node", "run_id").orderBy("us"))).where("held >= 3600000000").select("node", "us")


@query("pm07", f"SELECT a.day, a.quantile > 2 * b.quantile AS diverged FROM {QUANT} a JOIN {QUANT} b ON b.day = a.day - 1")
def _(t):
    before = daily_p99(t).select((F.col("day") + 1).alias("day"), F.col("quantile").alias("was"))
    return daily_p99(t).join(before, "day").select("day", (F.col("quantile") > 2 * F.col("was")).alias("diverged"))
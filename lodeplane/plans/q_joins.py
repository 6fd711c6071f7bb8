"""Joins (JON), set operations (SET), lifecycle (LC) and repair (GC) queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import balance, lifecycle, lww, policy, repair
from ..sources.adapters import Tables
from .q_sources import ID, LAST_STATS, rows
from .registry import query

NOW = 1_000_000_000
ENABLED = "(SELECT * FROM rules WHERE status = 'Enabled')"
RANKED = "(SELECT *, row_number() OVER (PARTITION BY bucket, key ORDER BY mod_time DESC, version_id DESC) AS rk, count(*) OVER (PARTITION BY bucket, key) AS n FROM live)"
MATCH = "starts_with(v.key, r.prefix) AND (r.tag IS NULL OR list_has_all(string_split(v.tag, ';'), string_split(r.tag, ';'))) AND (r.size_gt IS NULL OR v.size > r.size_gt) AND (r.size_lt IS NULL OR v.size < r.size_lt)"
CURRENT = f"SELECT v.bucket, v.key, v.version_id, r.id FROM {RANKED} v JOIN {ENABLED} r USING (bucket) WHERE v.rk = 1 AND NOT v.is_delete_marker AND {MATCH} AND coalesce(r.exp_date, (v.mod_time // 86400 + r.exp_days + 1) * 86400) <= {NOW}"
MARKERS = f"SELECT v.bucket, v.key, v.version_id, r.id FROM {RANKED} v JOIN {ENABLED} r USING (bucket) WHERE v.rk = 1 AND v.is_delete_marker AND v.n = 1 AND r.exp_marker AND {MATCH}"
NONCURRENT = f"SELECT v.bucket, v.key, v.version_id, r.id FROM {RANKED} v JOIN {ENABLED} r USING (bucket) WHERE v.rk > 1 AND (r.nc_days IS NOT NULL OR r.nc_newer IS NOT NULL) AND (r.nc_newer IS NULL OR v.rk - 2 >= r.nc_newer) AND (r.nc_days IS NULL OR v.mod_time + r.nc_days * 86400 <= {NOW})"
UPLOADS = f"SELECT upload_id, id FROM (SELECT u.upload_id, u.initiated, r.id, r.abort_days, row_number() OVER (PARTITION BY u.upload_id ORDER BY r.pos) AS rn FROM uploads u JOIN {ENABLED} r USING (bucket) WHERE r.abort_days IS NOT NULL AND starts_with(u.key, r.prefix)) WHERE rn = 1 AND initiated + abort_days * 86400 <= 880000000"


def ranked(t: Tables) -> DataFrame:
    return lww.with_is_latest(lww.live_versions(t.meta))


@query("jon01", f"SELECT v.bucket, v.key, v.version_id, r.id FROM live v JOIN rules r USING (bucket) WHERE r.status = 'Enabled' AND {MATCH}")
def _(t):
    return lww.live_versions(t.meta).join(lifecycle.enabled(t.rules), "bucket").where(lifecycle.matches()).select(*ID, "id")


@query("jon02", UPLOADS)
def _(t):
    return lifecycle.expired_uploads(t.uploads, t.rules, 880_000_000).select("upload_id", "id")


@query("jon03", "SELECT n_nationkey, n_name, s.s_nationkey IS NOT NULL AS has_upstream FROM nation LEFT JOIN (SELECT DISTINCT s_nationkey FROM supplier) s ON n_nationkey = s_nationkey")
def _(t):
    up = t.supplier.select(F.col("s_nationkey").alias("n_nationkey")).distinct().withColumn("u", F.lit(True))
    return t.nation.join(up, "n_nationkey", "left").select("n_nationkey", "n_name", F.col("u").isNotNull().alias("has_upstream"))


EDGES = "(SELECT sa AS principal, policy FROM sa_policies UNION ALL SELECT g.sa, p.policy FROM sa_groups g JOIN group_policies p USING (grp))"


@query("jon04", f"SELECT principal, policy, pos, effect FROM {EDGES} e JOIN statements USING (policy)")
def _(t):
    return policy.granted(policy.principal_policies(t.sa_policies, t.sa_groups, t.group_policies), t.statements).select("principal", "policy", "pos", "effect")


GLOB = "regexp_matches({s}, '(?s)^' || replace(regexp_replace({p}, '([\\\\.\\[\\]{{}}()+?^$|])', '\\\\\\1', 'g'), '*', '.*') || '$')"
IP = "(CAST(split_part({c}, '.', 1) AS BIGINT) * 16777216 + CAST(split_part({c}, '.', 2) AS BIGINT) * 65536 + CAST(split_part({c}, '.', 3) AS BIGINT) * 256 + CAST(split_part({c}, '.', 4) AS BIGINT))"
INCIDR = f"(s.cidr IS NULL OR {IP.format(c='r.ip')} // CAST(power(2, 32 - CAST(split_part(s.cidr, '/', 2) AS INT)) AS BIGINT) = {IP.format(c=chr(40) + 'split_part(s.cidr, chr(47), 1)' + chr(41))} // CAST(power(2, 32 - CAST(split_part(s.cidr, '/', 2) AS INT)) AS BIGINT))"
MATCHED = f"SELECT r.req, s.policy, s.pos, s.effect FROM requests r JOIN {EDGES} e USING (principal) JOIN statements s USING (policy) WHERE {GLOB.format(s='r.action', p='s.action')} AND {GLOB.format(s='r.resource', p='s.resource')} AND {INCIDR}"


def matched(t: Tables) -> DataFrame:
    edges = policy.principal_policies(t.sa_policies, t.sa_groups, t.group_policies)
    return policy.hits(t.requests, policy.granted(edges, t.statements), ["principal"])


@query("jon05", MATCHED)
def _(t):
    return matched(t).select("req", "policy", "pos", "effect")


REST = "regexp_replace({c}, '^arn:aws:s3:::', '')"
KEY = f"CASE WHEN strpos({REST}, '/') = 0 THEN '' ELSE substr({REST}, strpos({REST}, '/') + 1) END"
NAMED = f"CASE WHEN ends_with(s.resource, '/*') THEN left({REST.format(c='s.resource')}, length({REST.format(c='s.resource')}) - 2) = r.bucket ELSE split_part({REST.format(c='s.resource')}, '/', 1) = r.bucket AND {KEY.format(c='s.resource')} = {KEY.format(c='r.resource')} END"
BELOW = "(s.resource = r.resource OR (ends_with(s.resource, '/*') AND (r.resource = left(s.resource, length(s.resource) - 2) OR starts_with(r.resource, left(s.resource, length(s.resource) - 1)))))"
BUCKET_HITS = "SELECT r.req, s.pos, s.effect FROM requests r JOIN bucket_statements s USING (bucket) WHERE s.principal IN ('*', r.principal) AND (s.action = r.action OR (ends_with(s.action, ':*') AND starts_with(r.action, left(s.action, length(s.action) - 1)))) AND "


@query("jon06", BUCKET_HITS + NAMED)
def _(t):
    return policy.bucket_hits(t.requests, t.bucket_statements, True).select("req", "pos", "effect")


FOLD = "SELECT req, bool_or(effect = 'Deny') AS deny, min_by(concat(policy, '/', pos), (policy, pos)) FILTER (WHERE effect = 'Deny') AS dl, max_by(concat(policy, '/', pos), (policy, pos)) FILTER (WHERE effect = 'Allow') AS al FROM ({m}) GROUP BY req"
DECIDE = "SELECT r.req, CASE WHEN deny THEN 'Deny' WHEN deny IS NOT NULL THEN 'Allow' ELSE 'ImplicitDeny' END AS decision, CASE WHEN deny THEN dl ELSE al END AS label FROM requests r LEFT JOIN ({f}) f USING (req)"


@query("agg12", DECIDE.format(f=FOLD.format(m=MATCHED)))
def _(t):
    return policy.decide(t.requests, matched(t))


@query("flt24", f"WITH i AS ({DECIDE.format(f=FOLD.format(m=MATCHED))}), b AS (SELECT req, bool_or(effect = 'Allow') AND NOT bool_or(effect = 'Deny') AS ok FROM ({BUCKET_HITS + NAMED}) GROUP BY req), d AS (SELECT r.req, i.decision = 'Allow' AS granted, ends_with(r.action, 'BucketPolicy') OR r.bucket NOT IN (SELECT bucket FROM bucket_statements) OR coalesce(b.ok, false) AS passes, r.req % 4 AS acl, r.req % 5 <> 0 AS keyed, r.action IN ('s3:GetObject', 's3:HeadObject', 's3:ListBucket') AS is_read FROM requests r JOIN i USING (req) LEFT JOIN b USING (req)), e AS (SELECT *, (acl & 2) > 0 OR ((acl & 1) > 0 AND is_read) OR keyed AS by_acl FROM d) SELECT req, granted AND passes AND by_acl AS allow, CASE WHEN NOT granted THEN 'iam_grant' WHEN NOT passes THEN 'bucket_policy' WHEN NOT by_acl THEN 'object_acl' WHEN (acl & 2) > 0 THEN 'object_acl_public_read_write' WHEN (acl & 1) > 0 AND is_read THEN 'object_acl_public_read' ELSE 'object_acl_authenticated' END AS layer, CASE WHEN NOT granted THEN 'no_grant' WHEN NOT passes THEN 'policy_deny' WHEN NOT by_acl THEN CASE WHEN keyed THEN 'acl_private_denied' ELSE 'acl_anonymous_denied' END END AS reason FROM e")
def _(t):
    requests = t.requests.withColumn("acl", F.col("req") % 4).withColumn("keyed", F.col("req") % 5 != 0)
    return policy.layered(requests, policy.decide(t.requests, matched(t)), t.bucket_statements)


@query("flt26", f"SELECT r.req, coalesce(b.ok, false) AS allowed FROM requests r LEFT JOIN (SELECT req, bool_or(effect = 'Allow') AND NOT bool_or(effect = 'Deny') AS ok FROM ({BUCKET_HITS + BELOW}) GROUP BY req) b USING (req)")
def _(t):
    return policy.allowed(t.requests, policy.bucket_hits(t.requests, t.bucket_statements, False)).select("req", "allowed")


@query("jon07", "SELECT DISTINCT bucket, key FROM meta WHERE replica = 0 AND (bucket, key) NOT IN (SELECT (bucket, key) FROM latest WHERE NOT is_delete_marker)")
def _(t):
    return repair.orphans(t.meta.where("replica = 0").select("bucket", "key").distinct(), lww.latest(t.meta), "bucket", "key")


@query("jon08", "SELECT DISTINCT chunk FROM tombstones WHERE chunk NOT IN (SELECT chunk FROM chunk_refs)")
def _(t):
    return repair.orphans(t.tombstones.select("chunk").distinct(), t.chunk_refs, "chunk")


@query("jon09", "SELECT b.bucket, b.key, b.version_id, CASE WHEN bool_and(g.peer <> 'n7') AND coalesce(bool_and(v.is_hard_deleted), true) THEN 'stale' ELSE 'keep' END AS verdict FROM (SELECT * FROM meta WHERE replica = 1 AND meta_seq = 0) b JOIN versions v USING (bucket, key, version_id) JOIN groups g ON g.group_id = b.group_id GROUP BY 1, 2, 3")
def _(t):
    blobs = t.meta.where("replica = 1 AND meta_seq = 0").select(*ID, "group_id")
    truth = lww.versions(t.meta).select(*ID, F.col("is_hard_deleted").alias("gone"))
    reach = t.groups.groupBy("group_id").agg(F.bool_and(F.col("peer") != "n7").alias("reachable"))
    both = blobs.join(truth, ID).join(F.broadcast(reach), "group_id")
    return both.groupBy(*ID).agg(F.when(F.bool_and("reachable") & F.bool_and("gone"), "stale").otherwise("keep").alias("verdict"))


@query("jon10", "SELECT upload_id, bucket, key FROM uploads u WHERE NOT EXISTS (SELECT 1 FROM parts p WHERE p.upload_id = u.upload_id)")
def _(t):
    return t.uploads.join(t.parts, "upload_id", "left_anti").select("upload_id", "bucket", "key")


@query("jon11", "SELECT key, coalesce(a.version_id, n.version_id) AS version_id, a.version_id IS NOT NULL AS packed FROM (SELECT * FROM latest WHERE bucket = 'A' AND NOT is_delete_marker) a FULL JOIN (SELECT * FROM latest WHERE bucket = 'N' AND NOT is_delete_marker) n USING (key)")
def _(t):
    live = lww.latest(t.meta)
    a = live.where("bucket = 'A'").select("key", F.col("version_id").alias("a"))
    n = live.where("bucket = 'N'").select("key", F.col("version_id").alias("n"))
    return a.join(n, "key", "full").select("key", F.coalesce("a", "n").alias("version_id"), F.col("a").isNotNull().alias("packed"))


@query("jon12", "SELECT v.peer, CASE WHEN p.live IS NOT NULL THEN CASE WHEN p.live THEN 'live' ELSE 'down' END WHEN s.node_id IS NOT NULL THEN CASE WHEN s.disk_pct < 60 THEN 'live' ELSE 'down' END ELSE 'unknown' END AS state FROM (SELECT DISTINCT peer FROM groups UNION SELECT 'n9') v LEFT JOIN (SELECT node AS peer, max_by(type <> 'error', (CAST(type <> 'error' AS INT), us)) AS live FROM event_log GROUP BY node) p USING (peer) LEFT JOIN " + LAST_STATS + " s ON s.node_id = v.peer")
def _(t):
    voters = t.groups.select("peer").unionByName(rows(t, "('n9') AS v(peer)")).distinct()
    live = F.col("type") != "error"
    probes = t.event_log.groupBy(F.col("node").alias("peer")).agg(F.max_by(live, F.struct(live.cast("int").alias("l"), "us")).alias("live"))
    s = balance.current(t.node_stats).select(F.col("node_id").alias("peer"), "disk_pct")
    state = F.when(F.col("live"), "live").when(F.col("live").isNotNull(), "down").when(F.col("disk_pct") < 60, "live").when(F.col("disk_pct").isNotNull(), "down").otherwise("unknown")
    return voters.join(probes, "peer", "left").join(s, "peer", "left").select("peer", state.alias("state"))


@query("jon13", "SELECT u.upload_id, u.initiated, count(*) AS parts FROM (SELECT upload_id, initiated FROM uploads WHERE initiated >= 900000000) u JOIN parts p USING (upload_id) GROUP BY 1, 2")
def _(t):
    return t.uploads.where("initiated >= 900000000").join(t.parts, "upload_id").groupBy("upload_id", "initiated").agg(F.count("*").alias("parts"))


@query("jon14", "SELECT w.cid, coalesce(l.event_id, r.event_id, b.event_id) AS event_id, CASE WHEN l.event_id IS NOT NULL THEN 'local' WHEN r.event_id IS NOT NULL THEN 'routed' WHEN b.event_id IS NOT NULL THEN 'broadcast' END AS source FROM (SELECT DISTINCT cid FROM event_log) w LEFT JOIN (SELECT cid, min(event_id) AS event_id FROM event_log WHERE node = 'n0' GROUP BY cid) l USING (cid) LEFT JOIN (SELECT cid, min(event_id) AS event_id FROM event_log WHERE node IN ('n1', 'n2') GROUP BY cid) r USING (cid) LEFT JOIN (SELECT cid, min(event_id) AS event_id FROM event_log GROUP BY cid) b USING (cid)")
def _(t):
    first = lambda cond: F.min(F.when(F.expr(cond), F.col("event_id")))
    out = t.event_log.groupBy("cid").agg(first("node = 'n0'").alias("l"), first("node IN ('n1', 'n2')").alias("r"), F.min("event_id").alias("b"))
    return out.select("cid", F.coalesce("l", "r", "b").alias("event_id"), F.when(F.col("l").isNotNull(), "local").when(F.col("r").isNotNull(), "routed").when(F.col("b").isNotNull(), "broadcast").alias("source"))


EXPECTED = "(SELECT key, i AS idx FROM latest, unnest(range(0, ec_data + ec_parity)) AS u(i) WHERE bucket = 'A' AND NOT is_delete_marker)"
PRESENT = "(SELECT DISTINCT lpad(CAST(l_partkey AS VARCHAR), 8, '0') AS key, CAST(l_linenumber - 1 AS BIGINT) AS idx, (l_partkey + l_linenumber) % 5 <> 0 AS ok, CASE WHEN (l_partkey + l_linenumber) % 7 = 0 THEN 'error' ELSE 'ok' END AS read FROM lineitem)"
STATES = f"SELECT e.key, e.idx, CASE WHEN p.read IS NULL THEN 'missing' WHEN p.read = 'error' THEN 'unverified' WHEN NOT p.ok THEN 'corrupt' ELSE 'healthy' END AS state FROM {EXPECTED} e LEFT JOIN {PRESENT} p USING (key, idx)"


def states(t: Tables, owned: Column | None = None) -> DataFrame:
    base = lww.latest(t.meta.where("bucket = 'A'"))
    expected = base.select("key", F.explode(F.sequence(F.lit(0).cast("long"), (F.col("ec_data") + F.col("ec_parity") - 1).cast("long"))).alias("idx"))
    expected = expected if owned is None else expected.where(owned)
    sum_ = F.col("l_partkey") + F.col("l_linenumber")
    present = t.lineitem.select(F.lpad(F.col("l_partkey").cast("string"), 8, "0").alias("key"), (F.col("l_linenumber") - 1).cast("long").alias("idx"), (sum_ % 5 != 0).alias("ok"), F.when(sum_ % 7 == 0, "error").otherwise("ok").alias("read")).distinct()
    return repair.shard_states(expected, present)


@query("jon15", f"SELECT key, idx, state FROM ({STATES}) WHERE (CAST(key AS BIGINT) + idx) % 8 = 1")
def _(t):
    # the placement vector of a key names the node of each shard; the node looks after its own
    return states(t, (F.col("key").cast("long") + F.col("idx")) % 8 == 1).select("key", "idx", "state")


@query("jon16", "SELECT key, peer FROM (SELECT key, peer, row_number() OVER (PARTITION BY key ORDER BY sha256(key || '/' || peer), peer) AS r FROM (SELECT DISTINCT key FROM latest) CROSS JOIN (SELECT DISTINCT peer FROM groups)) WHERE r = 1")
def _(t):
    keys = lww.latest(t.meta, markers=True).select("key").distinct()
    return balance.rendezvous(keys, t.groups.select("peer").distinct(), "key", "peer", 1).select("key", "peer")


@query("jon17", "SELECT key FROM latest WHERE bucket = 'N' AND NOT is_delete_marker AND key NOT IN (SELECT key FROM latest WHERE bucket = 'R' AND NOT is_delete_marker)")
def _(t):
    live = lww.latest(t.meta)
    return live.where("bucket = 'N'").join(live.where("bucket = 'R'"), "key", "left_anti").select("key")


OFFSETS = "(SELECT upload_id, part_number, size, etag, coalesce(sum(size) OVER (PARTITION BY upload_id ORDER BY part_number, etag, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM parts)"


@query("jon18", f"SELECT o.upload_id, o.part_number, o.etag, q.at - o.start AS inside FROM {OFFSETS} o JOIN (SELECT upload_id, CAST(upload_id AS BIGINT) * 1000003 % 100000000 AS at FROM uploads) q USING (upload_id) WHERE q.at >= o.start AND q.at < o.start + o.size")
def _(t):
    w = Window.partitionBy("upload_id").orderBy("part_number", "etag", "size").rowsBetween(Window.unboundedPreceding, -1)
    o = t.parts.withColumn("start", F.coalesce(F.sum("size").over(w), F.lit(0)))
    q = t.uploads.select("upload_id", (F.col("upload_id").cast("long") * 1000003 % 100000000).alias("at"))
    return o.join(q, "upload_id").where("at >= start AND at < start + size").select("upload_id", "part_number", "etag", (F.col("at") - F.col("start")).alias("inside"))


@query("jon19", f"WITH p AS (SELECT peer, peer <> 'n7' AS voter, coalesce(disk_pct >= 108, false) AS blocks, coalesce(disk_pct < 80, false) AS alive FROM (SELECT DISTINCT peer FROM groups) LEFT JOIN {LAST_STATS} s ON s.node_id = peer), t AS (SELECT peer AS removed FROM p UNION ALL SELECT 'n9'), g AS (SELECT removed, bool_or(peer = removed) AS here, count(*) FILTER (WHERE peer <> removed AND voter) // 2 + 1 AS quorum, coalesce(string_agg(peer, ',' ORDER BY peer) FILTER (WHERE peer <> removed AND blocks), '') AS list, count(*) FILTER (WHERE peer <> removed AND voter AND alive) AS n FROM t CROSS JOIN p GROUP BY removed) SELECT removed, quorum, CASE WHEN here THEN list ELSE '' END AS blocking, CASE WHEN here AND list = '' THEN n ELSE 0 END AS alive, CASE WHEN NOT here THEN 'not-in-cluster' WHEN list <> '' THEN 'identity-unresolved' WHEN n < quorum THEN 'quorum-would-break' ELSE 'allowed' END AS verdict FROM g")
def _(t):
    s = balance.current(t.node_stats).select(F.col("node_id").alias("peer"), "disk_pct")
    no = F.lit(False)
    peers = t.groups.select("peer").distinct().join(s, "peer", "left").select("peer", (F.col("peer") != "n7").alias("voter"), F.coalesce(F.col("disk_pct") >= 108, no).alias("blocks"), F.coalesce(F.col("disk_pct") < 80, no).alias("alive"))
    targets = t.groups.select(F.col("peer").alias("removed")).distinct().union(rows(t, "('n9') AS v(removed)"))
    return balance.remove_peer(targets, peers)


@query("jon20", f"SELECT g.group_id, min_by(s.node_id, (s.disk_pct, s.node_id)) AS replacement FROM (SELECT group_id FROM groups WHERE peer = 'n2') g CROSS JOIN {LAST_STATS} s WHERE s.node_id <> 'n2' AND NOT EXISTS (SELECT 1 FROM groups m WHERE m.group_id = g.group_id AND m.peer = s.node_id) GROUP BY g.group_id")
def _(t):
    hit = t.groups.where("peer = 'n2'").select("group_id")
    s = balance.current(t.node_stats).where("node_id <> 'n2'")
    free = hit.crossJoin(F.broadcast(s)).join(t.groups.withColumnRenamed("peer", "node_id"), ["group_id", "node_id"], "left_anti")
    return free.groupBy("group_id").agg(F.min_by("node_id", F.struct("disk_pct", "node_id")).alias("replacement"))


@query("jon21", "SELECT d.chunk, d.newest, CASE WHEN 120000 - d.newest > 60000 THEN 'stale' ELSE 'live' END AS kind FROM (SELECT chunk, max(t_zero) AS newest FROM tombstones GROUP BY chunk) d WHERE d.chunk NOT IN (SELECT chunk FROM chunk_refs)")
def _(t):
    newest = t.tombstones.groupBy("chunk").agg(F.max("t_zero").alias("newest"))
    return repair.orphans(newest, t.chunk_refs, "chunk").withColumn("kind", F.when(120000 - F.col("newest") > 60000, "stale").otherwise("live"))


@query("jon22", "SELECT 'groups' AS kind, sa AS name, string_agg(grp, ',' ORDER BY grp) AS list FROM sa_groups GROUP BY sa UNION ALL SELECT 'members', grp, string_agg(sa, ',' ORDER BY sa) FROM sa_groups GROUP BY grp UNION ALL SELECT 'keys', sa, string_agg(access_key, ',' ORDER BY created, access_key) FROM sa_keys GROUP BY sa")
def _(t):
    of = lambda kind, d, name, *order: d.groupBy(F.lit(kind).alias("kind"), F.col(name).alias("name")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order))), lambda x: x[order[-1]]), ",").alias("list"))
    return of("groups", t.sa_groups, "sa", "grp").unionByName(of("members", t.sa_groups, "grp", "sa")).unionByName(of("keys", t.sa_keys, "sa", "created", "access_key"))


CONFIG = "('a.interval', '60'), ('b.limit', '50'), ('c.mode', 'auto')"
SET = "('b.limit', '75'), ('z.unknown', '1')"


@query("jon23", f"SELECT name, coalesce(s.value, d.dflt) AS value, s.value IS NOT NULL AS is_set FROM (VALUES {CONFIG}) AS d(name, dflt) LEFT JOIN (VALUES {SET}) AS s(name, value) USING (name)")
def _(t):
    out = rows(t, f"{CONFIG} AS d(name, dflt)").join(rows(t, f"{SET} AS s(name, value)"), "name", "left")
    return out.select("name", F.coalesce("value", "dflt").alias("value"), F.col("value").isNotNull().alias("is_set")).orderBy("name")


@query("jon24", f"SELECT DISTINCT peer FROM groups WHERE peer NOT IN (SELECT node_id FROM {LAST_STATS} WHERE disk_pct < 50)")
def _(t):
    live = balance.current(t.node_stats).where("disk_pct < 50").select(F.col("node_id").alias("peer"))
    return t.groups.select("peer").distinct().join(live, "peer", "left_anti")


@query("set01", "SELECT bucket, key, version_id, replica FROM meta WHERE replica = 0 UNION ALL SELECT bucket, key, version_id, replica FROM meta WHERE replica = 1")
def _(t):
    m = t.meta.select(*ID, "replica")
    return m.where("replica = 0").unionByName(m.where("replica = 1"))


@query("set02", "SELECT peer FROM groups UNION SELECT node FROM event_log")
def _(t):
    return t.groups.select("peer").union(t.event_log.select("node")).distinct()


@query("set03", "SELECT key FROM meta WHERE bucket = 'A' EXCEPT SELECT key FROM meta WHERE bucket = 'R' AND size < 10")
def _(t):
    return t.meta.where("bucket = 'A'").select("key").subtract(t.meta.where("bucket = 'R' AND size < 10").select("key"))


@query("set04", "SELECT chunk FROM chunk_refs INTERSECT SELECT chunk FROM tombstones")
def _(t):
    return t.chunk_refs.select("chunk").intersect(t.tombstones.select("chunk"))


@query("set05", "SELECT b.day, string_agg(b.node, ',' ORDER BY b.node) AS entered FROM (SELECT us // 86400000000 AS day, node FROM event_log GROUP BY 1, 2 HAVING avg(value) > 20) b WHERE NOT EXISTS (SELECT 1 FROM (SELECT us // 86400000000 AS day, node FROM event_log GROUP BY 1, 2 HAVING avg(value) > 20) a WHERE a.day = b.day - 1 AND a.node = b.node) GROUP BY b.day")
def _(t):
    hot = t.event_log.groupBy(F.floor(F.col("us") / 86400000000).alias("day"), "node").agg(F.avg("value").alias("v")).where("v > 20").groupBy("day").agg(F.array_sort(F.collect_set("node")).alias("hot"))
    before = hot.select((F.col("day") + 1).alias("day"), F.col("hot").alias("was"))
    new = F.array_except("hot", F.coalesce("was", F.array().cast("array<string>")))
    return hot.join(before, "day", "left").withColumn("new", new).where(F.size("new") > 0).select("day", F.array_join("new", ",").alias("entered"))


@query("lc01", CURRENT)
def _(t):
    return lifecycle.expired_current(ranked(t), t.rules, NOW).select(*ID, "id")


@query("lc02", MARKERS)
def _(t):
    return lifecycle.dangling_markers(ranked(t), t.rules).select(*ID, "id")


@query("lc03", NONCURRENT)
def _(t):
    return lifecycle.expired_noncurrent(ranked(t), t.rules, NOW).select(*ID, "id")


@query("lc04", UPLOADS.replace("880000000", "940000000"))
def _(t):
    return lifecycle.expired_uploads(t.uploads, t.rules, 940_000_000).select("upload_id", "id")


@query("lc05", f"SELECT action, count(*) AS matches, count(DISTINCT concat(bucket, '/', key, '/', version_id)) AS n FROM (SELECT 'expire' AS action, * FROM ({CURRENT}) UNION ALL SELECT 'marker', * FROM ({MARKERS}) UNION ALL SELECT 'noncurrent', * FROM ({NONCURRENT})) GROUP BY action")
def _(t):
    return lifecycle.actions(ranked(t), t.rules, NOW).groupBy("action").agg(F.count("*").alias("matches"), F.count_distinct("bucket", "key", "version_id").alias("n"))


@query("gc01", "SELECT DISTINCT chunk, t_zero FROM tombstones t WHERE 120000 - t_zero > 3600 AND NOT EXISTS (SELECT 1 FROM chunk_refs r WHERE r.chunk = t.chunk)")
def _(t):
    return repair.gc_candidates(t.tombstones.distinct(), t.chunk_refs, 120_000, 3600)


@query("gc02", "SELECT c.chunk, c.t_zero FROM (SELECT chunk, t_zero + CASE WHEN t_zero % 180 = 0 THEN 1 ELSE 0 END AS t_zero FROM tombstones) c WHERE NOT EXISTS (SELECT 1 FROM tombstones t WHERE t.chunk = c.chunk AND t.t_zero = c.t_zero)")
def _(t):
    cand = t.tombstones.select("chunk", (F.col("t_zero") + F.when(F.col("t_zero") % 180 == 0, 1).otherwise(0)).alias("t_zero"))
    return cand.join(t.tombstones, ["chunk", "t_zero"], "left_anti")


@query("gc03", "WITH log AS (SELECT concat('k', user_id % 40) AS chunk, concat('m', event_id % 5) AS manifest, CASE WHEN event_id % 3 = 0 THEN 'remove' ELSE 'add' END AS op, event_id AS seq, us AS t FROM event_log), d AS (SELECT *, (CASE WHEN op = 'add' THEN 1 ELSE 0 END) - coalesce(lag(CASE WHEN op = 'add' THEN 1 ELSE 0 END) OVER (PARTITION BY chunk, manifest ORDER BY seq), 0) AS dl FROM log), n AS (SELECT *, sum(dl) OVER (PARTITION BY chunk ORDER BY seq) AS n FROM d) SELECT chunk, sum(dl)::BIGINT AS refs, CASE WHEN sum(dl) = 0 THEN max(t) FILTER (WHERE dl = -1 AND n = 0) END AS t_zero FROM n GROUP BY chunk")
def _(t):
    log = t.event_log.select(F.concat(F.lit("k"), (F.col("user_id") % 40).cast("string")).alias("chunk"), F.concat(F.lit("m"), (F.col("event_id") % 5).cast("string")).alias("manifest"), F.when(F.col("event_id") % 3 == 0, "remove").otherwise("add").alias("op"), F.col("event_id").alias("seq"), F.col("us").alias("t"))
    return repair.replay_refs(log)


SEEN = "(SELECT DISTINCT us // 86400000000 AS cycle, concat('s', event_id % 331) AS key FROM event_log)"


@query("gc04", f"SELECT cycle, key FROM (SELECT cycle, key, lag(cycle) OVER (PARTITION BY key ORDER BY cycle) AS b FROM {SEEN}) WHERE b = cycle - 1 AND key NOT IN (SELECT concat('s', event_id % 331) FROM event_log WHERE type = 'purchase')")
def _(t):
    seen = t.event_log.select(F.floor(F.col("us") / 86400000000).alias("cycle"), F.concat(F.lit("s"), (F.col("event_id") % 331).cast("string")).alias("key")).distinct()
    known = t.event_log.where("type = 'purchase'").select(F.concat(F.lit("s"), (F.col("event_id") % 331).cast("string")).alias("key"))
    return repair.orphans(repair.promoted(seen, "key", 1 << 30), known, "key").select("cycle", "key")


@query("gc05", "SELECT bucket, key FROM (SELECT bucket, key, row_number() OVER (PARTITION BY bucket ORDER BY key) AS r FROM latest WHERE NOT is_delete_marker AND ec_parity = 0 AND ec_data >= 1 AND 1000000000 - mod_time >= 3600) WHERE r <= 25")
def _(t):
    d = lww.latest(t.meta).where(repair.needs_redundancy(NOW, 3600, F.lit(True)))
    return d.withColumn("r", F.row_number().over(Window.partitionBy("bucket").orderBy("key"))).where("r <= 25").select("bucket", "key")


@query("gc06", f"SELECT key, count(*) FILTER (WHERE state = 'missing') AS missing, count(*) FILTER (WHERE state = 'corrupt') AS corrupt, bool_and(state = 'healthy') AS healthy FROM ({STATES}) GROUP BY key")
def _(t):
    of = lambda s: F.count_if(F.col("state") == s).alias(s)
    return states(t).groupBy("key").agg(of("missing"), of("corrupt"), F.bool_and(F.col("state") == "healthy").alias("healthy"))


@query("gc07", "SELECT upload_id FROM uploads WHERE initiated < 850000000")
def _(t):
    return t.uploads.where("initiated < 850000000").select("upload_id")

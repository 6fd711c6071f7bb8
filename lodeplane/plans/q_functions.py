"""Scalar function (FN) and stateful (ST) queries, and ordered folds (WIN12)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as fn
from ..operators import lifecycle, lww
from ..sources import sinks
from ..streaming import folds
from .q_joins import GLOB
from .q_sources import rows
from .registry import query

GLOBS = "('s3:GetObject', 's3:Get*'), ('s3:PutObject', '*Object'), ('a.b', 'a*b'), ('axb', 'a.b'), ('x+y', 'x+*'), ('', '*'), ('abc', 'a*d'), ('a/b/c', 'a/*/c'), ('*ba', '*a')"


@query("fn01", f"SELECT s, p, {GLOB.format(s='s', p='p')} AS ok FROM (VALUES {GLOBS}) AS v(s, p)")
def _(t):
    return rows(t, f"{GLOBS} AS v(s, p)").select("s", "p", fn.glob(F.col("s"), F.col("p")).alias("ok"))


SEGS = "('cluster/status', 'cluster/*'), ('cluster/a/b', 'cluster/*'), ('x/y', 'x/y'), ('x/y', '*/*'), ('x', 'y')"


@query("fn02", f"SELECT s, p, len(string_split(s, '/')) = len(string_split(p, '/')) AND list_bool_and(list_transform(list_zip(string_split(s, '/'), string_split(p, '/')), lambda x: coalesce(x[2] = '*' OR x[1] = x[2], false))) AS ok FROM (VALUES {SEGS}) AS v(s, p)")
def _(t):
    return rows(t, f"{SEGS} AS v(s, p)").select("s", "p", fn.segmented(F.col("s"), F.col("p")).alias("ok"))


@query("fn03", f"SELECT DISTINCT r.action, s.effect, s.action AS pattern, CASE WHEN starts_with(r.action, 'admin:') AND s.effect = 'Allow' THEN starts_with(s.action, 'admin:') ELSE {GLOB.format(s='r.action', p='s.action')} END AS ok FROM (SELECT action FROM requests UNION SELECT 'admin:Reload') r CROSS JOIN statements s")
def _(t):
    actions = t.requests.select("action").union(rows(t, "('admin:Reload') AS v(action)")).distinct()
    s = t.statements.select("effect", F.col("action").alias("pattern")).distinct()
    admin = F.col("action").startswith("admin:") & (F.col("effect") == "Allow")
    ok = F.when(admin, F.col("pattern").startswith("admin:")).otherwise(fn.glob(F.col("action"), F.col("pattern")))
    return actions.crossJoin(F.broadcast(s)).select("action", "effect", "pattern", ok.alias("ok"))


CIDRS = "('10.0.0.0/8'), ('10.1.0.0/16'), ('10.2.3.0/24'), ('0.0.0.0/0'), ('10.3.255.7/32'), ('2001:db8::/32'), ('::/0'), ('fe80::/10'), ('::1/128'), ('2001:db8:0:0:8:800:200c:4170/124')"
MORE_IPS = "('2001:db8::1'), ('2001:DB8:0:0:8:800:200c:417a'), ('::1'), ('febf::1:2'), ('fec0::'), ('bad'), ('10.0.0.300'), (':1'), ('1::2::3'), ('1:2:3:4:5:6:7::8')"
SIDE = "list_filter(string_split(split_part(lower({c}), '::', {k}), ':'), lambda g: g <> '')"
GROUP = "[0-9a-f]{1,4}"
# binary digits of an address of either family, null where it is none
V4 = "CASE WHEN regexp_full_match({c}, '(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])([.](25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])){3}') THEN array_to_string(list_transform(string_split({c}, '.'), lambda g: lpad(bin(TRY_CAST(g AS INTEGER)), 8, '0')), '') END"
V6 = "CASE WHEN regexp_full_match(lower({c}), '(<g>:){7}<g>') OR (regexp_full_match(lower({c}), '((<g>:)*<g>)?::((<g>:)*<g>)?') AND len(<l>) + len(<r>) <= 7) THEN array_to_string(list_transform(list_concat(list_concat(<l>, list_transform(range(0, 8 - len(<l>) - len(<r>)), lambda i: '0')), <r>), lambda g: lpad(bin(TRY_CAST(concat('0x', g) AS INTEGER)), 16, '0')), '') END"


def digits(c: str) -> str:
    v6 = V6.replace("<g>", GROUP).replace("<l>", SIDE.replace("{k}", "1")).replace("<r>", SIDE.replace("{k}", "2"))
    return f"coalesce({V4}, {v6})".replace("{c}", c)


@query("fn04", f"WITH i AS (SELECT DISTINCT ip FROM requests UNION SELECT ip FROM (VALUES {MORE_IPS}) AS m(ip)), a AS (SELECT ip, {digits('ip')} AS d FROM i), c AS (SELECT cidr, CAST(split_part(cidr, '/', 2) AS INT) AS n, {digits('base')} AS b FROM (SELECT cidr, split_part(cidr, '/', 1) AS base FROM (VALUES {CIDRS}) AS v(cidr))) SELECT ip, cidr, coalesce(length(d) = length(b) AND d[1:n] = b[1:n], false) AS inside, d IS NOT NULL AND NOT (length(d) = length(b) AND d[1:n] = b[1:n]) AS outside FROM a CROSS JOIN c")
def _(t):
    ips = t.requests.select("ip").union(rows(t, f"{MORE_IPS} AS m(ip)")).distinct()
    inside = fn.in_cidr(F.col("ip"), F.col("cidr"))
    return ips.crossJoin(F.broadcast(rows(t, f"{CIDRS} AS c(cidr)"))).select("ip", "cidr", inside.alias("inside"), (fn.is_address(F.col("ip")) & ~inside).alias("outside"))


@query("fn05", f"SELECT req, action <> 's3:ListBucket' OR {GLOB.format(s='resource', p=chr(39) + '*/logs/*' + chr(39))} AS ok FROM requests")
def _(t):
    return t.requests.select("req", ((F.col("action") != "s3:ListBucket") | fn.glob(F.col("resource"), F.lit("*/logs/*"))).alias("ok"))


REST = "regexp_replace(resource, '^arn:aws:s3:::', '')"


@query("fn06", f"SELECT resource, CASE WHEN ends_with({REST}, '/*') THEN left({REST}, length({REST}) - 2) ELSE split_part({REST}, '/', 1) END AS bucket, CASE WHEN ends_with({REST}, '/*') OR strpos({REST}, '/') = 0 THEN '' ELSE substr({REST}, strpos({REST}, '/') + 1) END AS key, ends_with({REST}, '/*') AS mode FROM (SELECT resource FROM requests UNION SELECT resource FROM statements)")
def _(t):
    bucket, key, mode = fn.arn(F.col("resource"))
    return t.requests.select("resource").union(t.statements.select("resource")).distinct().select("resource", bucket.alias("bucket"), key.alias("key"), mode.alias("mode"))


RANGES = "('bytes=0-9', 100), ('bytes=90-200', 100), ('bytes=50-', 100), ('bytes=-10', 100), ('bytes=-500', 100), ('bytes=100-', 100), ('bytes=9-3', 100), ('items=0-1', 100), ('bytes=-0', 100), ('bytes=0-0', 0)"
RX = "SELECT h, n, TRY_CAST(nullif(regexp_extract(h, '^bytes=(\\d*)-(\\d*)', 1), '') AS BIGINT) AS a, TRY_CAST(nullif(regexp_extract(h, '^bytes=(\\d*)-(\\d*)', 2), '') AS BIGINT) AS b FROM (VALUES {r}) AS v(h, n)"


@query("fn07", f"SELECT h, n, CASE WHEN ok THEN f END AS first, CASE WHEN ok THEN l END AS last FROM (SELECT *, coalesce((a IS NOT NULL OR b > 0) AND f <= l AND f < n, false) AS ok FROM (SELECT *, CASE WHEN a IS NULL THEN greatest(0, n - b) ELSE a END AS f, CASE WHEN a IS NULL THEN n - 1 ELSE least(coalesce(b, n - 1), n - 1) END AS l FROM ({RX.format(r=RANGES)})))")
def _(t):
    d = rows(t, f"{RANGES} AS v(h, n)")
    a, b = fn.byte_range(F.col("h"), F.col("n").cast("long"))
    return d.select("h", "n", a.alias("first"), b.alias("last"))


@query("fn08", f"SELECT h, n, CASE WHEN a <= b AND b < n THEN a END AS first, CASE WHEN a <= b AND b < n THEN b END AS last FROM ({RX.format(r=RANGES)})")
def _(t):
    d = rows(t, f"{RANGES} AS v(h, n)")
    a, b = fn.strict_range(F.col("h"), F.col("n").cast("long"))
    return d.select("h", "n", a.alias("first"), b.alias("last"))


@query("fn09", "SELECT upload_id, part_number, etag, start, start + size - 1 AS last FROM (SELECT *, coalesce(sum(size) OVER (PARTITION BY upload_id ORDER BY part_number, etag, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM parts) WHERE part_number = 2")
def _(t):
    w = Window.partitionBy("upload_id").orderBy("part_number", "etag", "size").rowsBetween(Window.unboundedPreceding, -1)
    d = t.parts.withColumn("start", F.coalesce(F.sum("size").over(w), F.lit(0))).where("part_number = 2")
    return d.select("upload_id", "part_number", "etag", "start", (F.col("start") + F.col("size") - 1).alias("last"))


@query("fn10", "SELECT bucket, key, version_id, (mod_time // 86400 + 31) * 86400 AS expires FROM live WHERE bucket = 'A'")
def _(t):
    return lww.live_versions(t.meta.where("bucket = 'A'")).select("bucket", "key", "version_id", lifecycle.expiry(F.col("mod_time"), F.lit(30)).alias("expires"))


@query("fn11", "SELECT upload_id, initiated + 7 * 86400 AS abort_at FROM uploads")
def _(t):
    return t.uploads.select("upload_id", (F.col("initiated") + 7 * lifecycle.DAY).alias("abort_at"))


@query("fn12", "SELECT doc_id, md5(text) AS etag, CASE length(CASE WHEN doc_id % 3 = 0 THEN md5(text) WHEN doc_id % 3 = 1 THEN substr(md5(text), 1, 16) ELSE 'x' END) WHEN 32 THEN 'md5' WHEN 16 THEN 'xxh3' END AS algorithm FROM documents")
def _(t):
    m = F.md5("text")
    shown = F.when(F.col("doc_id") % 3 == 0, m).when(F.col("doc_id") % 3 == 1, F.substring(m, 1, 16)).otherwise("x")
    return t.documents.select("doc_id", m.alias("etag"), F.when(F.length(shown) == 32, "md5").when(F.length(shown) == 16, "xxh3").alias("algorithm"))


@query("fn13", "SELECT doc_id, sha256(text) AS checksum FROM documents")
def _(t):
    # the checksum's algorithm is a parameter; SHA-256 stands in for one that no engine here has
    return t.documents.select("doc_id", F.sha2("text", 256).alias("checksum"))


@query("fn14", "SELECT name, list_reduce(list_prepend(2166136261::BIGINT, list_transform(range(1, length(name) + 1), lambda i: ascii(substr(name, i, 1))::BIGINT)), lambda h, b: (xor(h, b) * 16777619) % 4294967296) AS h, list_reduce(list_prepend(2166136261::BIGINT, list_transform(range(1, length(name) + 1), lambda i: ascii(substr(name, i, 1))::BIGINT)), lambda h, b: (xor(h, b) * 16777619) % 4294967296) % 5 AS grp FROM (SELECT DISTINCT c_name AS name FROM customer)")
def _(t):
    return t.customer.select(F.col("c_name").alias("name")).distinct().withColumn("h", fn.fnv32a(F.col("name"))).withColumn("grp", F.col("h") % 5)


@query("fn15", "SELECT key, round(-ln((CAST('0x' || substr(sha256(key), 1, 8) AS BIGINT) + 1) / 4294967297.0::DOUBLE), 9) AS cost FROM (SELECT DISTINCT key FROM meta)")
def _(t):
    u = (F.conv(F.substring(F.sha2("key", 256), 1, 8), 16, 10).cast("double") + 1) / 4294967297.0
    return t.meta.select("key").distinct().select("key", F.round(-F.log(u), 9).alias("cost"))


@query("fn16", "SELECT n, CASE WHEN n <= 0 THEN 0 WHEN n <= 2 THEN 1 WHEN n = 3 THEN 2 ELSE least(n - 2, 6) END::INT AS k, CASE WHEN n <= 1 THEN 0 WHEN n <= 3 THEN 1 ELSE 2 END::INT AS m FROM (SELECT DISTINCT p_size % 12 AS n FROM part)")
def _(t):
    k, m = fn.ec_profile(F.col("n"))
    return t.part.select((F.col("p_size") % 12).alias("n")).distinct().select("n", k.alias("k"), m.alias("m"))


@query("fn17", "SELECT upload_id, part_number, size, (size + 262143) // 262144 AS stripes, ((size + 262143) // 262144) * 65536 AS fragment FROM parts WHERE part_number = 1")
def _(t):
    stripes = F.floor((F.col("size") + 262143) / 262144)
    return t.parts.where("part_number = 1").select("upload_id", "part_number", "size", stripes.alias("stripes"), (stripes * 65536).alias("fragment"))


@query("fn18", "SELECT version_id, concat('seg/', bucket, '/', key, '/', version_id) AS path, split_part(concat('seg/', bucket, '/', key, '/', version_id), '/', 4) AS blob FROM latest")
def _(t):
    path = F.concat_ws("/", F.lit("seg"), "bucket", "key", "version_id")
    return lww.latest(t.meta, markers=True).select("version_id", path.alias("path"), F.substring_index(path, "/", -1).alias("blob"))


@query("fn19", "SELECT event_id, concat('{\"bucket\":\"', bucket, '\",\"cid\":\"', cid, '\",\"peers\":[],\"us\":', us, '}') AS canonical FROM heal_events WHERE phase = 'verify'")
def _(t):
    body = F.to_json(F.struct("bucket", "cid", F.array().cast("array<string>").alias("peers"), "us"))
    return t.heal_events.where("phase = 'verify'").select("event_id", body.alias("canonical"))


@query("fn20", "SELECT doc_id, lower(hex(from_base64(base64(unhex(md5(text)))))) AS digest, octet_length(from_base64(base64(unhex(md5(text))))) = 16 AS ok FROM documents")
def _(t):
    raw = F.unbase64(F.base64(F.unhex(F.md5("text"))))
    return t.documents.select("doc_id", F.lower(F.hex(raw)).alias("digest"), (F.octet_length(raw) == 16).alias("ok"))


@query("fn21", "SELECT etag, trim(trim(CASE WHEN part_number = 1 THEN '\"' || etag || '\"' ELSE ' ' || etag END), '\"') = etag AS same FROM parts")
def _(t):
    shown = F.when(F.col("part_number") == 1, F.concat(F.lit('"'), "etag", F.lit('"'))).otherwise(F.concat(F.lit(" "), "etag"))
    return t.parts.select("etag", (F.btrim(F.btrim(shown), F.lit('"')) == F.col("etag")).alias("same"))


@query("fn22", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS rfc, epoch(strptime(strftime(ts, '%Y-%m-%dT%H:%M:%SZ'), '%Y-%m-%dT%H:%M:%SZ'))::BIGINT AS seconds FROM events")
def _(t):
    shown = t.events.select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("rfc"))
    return shown.withColumn("seconds", F.unix_timestamp(F.to_timestamp("rfc", "yyyy-MM-dd'T'HH:mm:ssX")))


@query("fn23", "SELECT node_id, us, CASE WHEN disk_pct / 100 >= 0.9 THEN 'critical' WHEN disk_pct / 100 >= 0.8 THEN 'warn' ELSE 'ok' END AS level FROM node_stats")
def _(t):
    return t.node_stats.select("node_id", "us", fn.level(F.col("disk_pct") / 100).alias("level"))


@query("fn24", "SELECT bucket, string_agg(DISTINCT tag, ',' ORDER BY tag) AS tags FROM meta GROUP BY bucket")
def _(t):
    return t.meta.groupBy("bucket").agg(F.array_join(F.array_sort(F.collect_set("tag")), ",").alias("tags"))


ACTIONS = "('missing_shard', 'insufficient_survivors', 'restore a peer'), ('missing_shard', '', 'inspect and retry'), ('corrupt_shard', '', 'inspect and retry'), ('corrupt_shard', 'insufficient_survivors', 'restore a peer')"


@query("fn25", f"SELECT cid, seq, coalesce(next, 'watch') AS next FROM facts LEFT JOIN (VALUES {ACTIONS}) AS a(cause, code, next) USING (cause, code)")
def _(t):
    return t.facts.join(F.broadcast(rows(t, f"{ACTIONS} AS a(cause, code, next)")), ["cause", "code"], "left").select("cid", "seq", F.coalesce("next", F.lit("watch")).alias("next"))


@query("fn26", "SELECT CAST(n AS BIGINT) AS n, least(0.25::DOUBLE * power(2, n - 1), 30.0::DOUBLE) AS wait FROM range(1, 13) AS r(n)")
def _(t):
    return t.spark.range(1, 13).select(F.col("id").alias("n"), fn.backoff(0.25, F.col("id"), 30.0).alias("wait"))


@query("fn27", "SELECT event_id, ts > TIMESTAMP '2024-01-15 12:00:00' AS expired FROM events")
def _(t):
    return t.events.select("event_id", (F.col("ts") > F.to_timestamp_ntz(F.lit("2024-01-15T12:00:00"), F.lit("yyyy-MM-dd'T'HH:mm:ss"))).alias("expired"))


QS = "('uploads'), ('x=1&uploads'), ('uploadId=3'), ('a&uploads=1'), ('xuploads'), ('')"


@query("fn28", f"SELECT q, list_contains(list_transform(string_split(q, '&'), lambda p: split_part(p, '=', 1)), 'uploads') AS has FROM (VALUES {QS}) AS v(q)")
def _(t):
    return rows(t, f"{QS} AS v(q)").select("q", fn.query_has(F.col("q"), "uploads").alias("has"))


FDS = "('socket:[12]'), ('/data/x.SST'), ('/var/receipts/1'), ('/tmp/a.log'), ('pipe'), ('anon.db'), ('Events.bin')"


@query("fn29", f"SELECT f, CASE WHEN lower(f) LIKE '%sock%' THEN 'socket' WHEN lower(f) LIKE '%.sst%' OR lower(f) LIKE '%manifest%' OR lower(f) LIKE '%badger%' THEN 'badger' WHEN lower(f) LIKE '%receipt%' OR lower(f) LIKE '%event%' THEN 'receipt_or_event_store' WHEN lower(f) LIKE '%/%' OR lower(f) LIKE '%.log%' OR lower(f) LIKE '%.db%' THEN 'regular_file' ELSE 'unknown' END AS category FROM (VALUES {FDS}) AS v(f)")
def _(t):
    return rows(t, f"{FDS} AS v(f)").select("f", fn.fd_category(F.col("f")).alias("category"))


@query("st01", "SELECT event_id, event_type FROM events WHERE event_type IN ('click', 'purchase')")
def _(t):
    from ..streaming import streams

    return streams.feed(t.events, ["click", "purchase"]).select("event_id", "event_type")


@query("st02")
def _(t):
    def fold(rows_):
        first, n = None, 0
        for r in rows_:
            if first is not None and r["us"] - first >= 300_000_000:
                yield {"cid": r["cid"], "first_us": first, "n": n, "closed": False}
                first, n = None, 0
            first, n = (r["us"] if first is None else first), n + 1
            if r["type"] == "purchase":
                yield {"cid": r["cid"], "first_us": first, "n": n, "closed": True}
                first, n = None, 0

    return folds.by_key(t.event_log.select("cid", "us", "type"), "cid", ["us"], fold, "cid string, first_us long, n long, closed boolean")


@query("st03")
def _(t):
    return folds.by_key(t.facts, "cid", ["us", "seq"], folds.incident, "cid string, state string, severity string, proof string, cause string, action string, updated long")


@query("st04")
def _(t):
    reports = t.event_log.select("node", "event_id", "us", (F.col("type") == "error").alias("faulty"))
    return folds.by_key(reports, "node", ["us", "event_id"], folds.degraded, "node string, event_id long, degraded boolean, held boolean")


@query("st05")
def _(t):
    return folds.by_key(t.event_log.select("node", "event_id", "us", "value"), "node", ["us", "event_id"], lambda r: folds.resource_watch(r, limit=120.0), "node string, event_id long, level string, why string, eta_s long")


def lru(size: int) -> str:
    return f"count(*) FILTER (WHERE d < {size}) AS hits_{size}, count(*) FILTER (WHERE d IS NULL OR d >= {size}) AS misses_{size}"


@query("st06")  # SQL counts the keys between two accesses, which is quadratic: tests/test_whole_inputs.py has the plain model
def _(t):
    a = t.event_log.select((F.col("event_id") % 4).alias("stream"), F.col("user_id").alias("k"), "us")
    return folds.lru_distance(a, "k", "us", [16, 64, 256], "stream")


@query("st07", "SELECT event_id, CASE WHEN age IS NULL THEN 'miss' WHEN age <= 3600000000 THEN 'fresh' WHEN age <= 7200000000 THEN 'stale' ELSE 'miss' END AS state FROM (SELECT event_id, us - lag(us) OVER (PARTITION BY user_id ORDER BY us) AS age FROM event_log)")
def _(t):
    age = F.col("us") - F.lag("us").over(Window.partitionBy("user_id").orderBy("us"))
    return t.event_log.withColumn("age", age).select("event_id", folds.cache_state(F.col("age"), 3_600_000_000, 3_600_000_000).alias("state"))


@query("st08", "SELECT node_id, us, disk_pct FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY us DESC, disk_pct DESC, avail DESC, rps DESC) AS r FROM node_stats WHERE us > (SELECT max(us) FROM node_stats) - 7200000000) WHERE r = 1")
def _(t):
    from ..operators import balance

    return balance.current(sinks.within_ttl(t.node_stats, "us", 7_200_000_000)).select("node_id", "us", "disk_pct")


@query("st09", "SELECT bucket, user_id, type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY bucket, user_id ORDER BY event_id DESC) AS r FROM event_log) WHERE r = 1 AND type <> 'error'")
def _(t):
    last = t.event_log.groupBy("bucket", "user_id").agg(F.max_by(F.struct("type", "event_id"), "event_id").alias("w")).select("bucket", "user_id", "w.*")
    return last.where("type <> 'error'")


@query("st10", "SELECT node, event_id FROM event_log e WHERE us // 3600000000 = (SELECT max(us) // 3600000000 FROM event_log x WHERE x.node = e.node)")
def _(t):
    e = t.event_log.withColumn("hour", F.floor(F.col("us") / 3600000000))
    latest = e.groupBy("node", "hour").agg(F.collect_list("event_id").alias("ids")).groupBy("node").agg(F.max_by("ids", "hour").alias("ids"))
    return latest.select("node", F.explode("ids").alias("event_id"))


@query("win12")
def _(t):
    return folds.by_key(t.event_log.select("node", "event_id", "type", "us"), "node", ["us", "event_id"], lambda r: folds.alert_dedup(r, 7_200_000_000), "node string, event_id long, type string, us long")

"""Scans, sources, sinks, filters and projections (SRC, SNK, FLT, PRJ)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as fn
from ..operators import listing, lww, policy
from ..sources import sinks
from ..sources.adapters import Tables
from .registry import query

ID = ["bucket", "key", "version_id"]


def rows(t: Tables, values: str) -> DataFrame:
    return t.spark.sql(f"SELECT * FROM VALUES {values}")


@query("src01", "SELECT bucket, key, version_id, replica FROM meta WHERE bucket = 'A' AND starts_with(key, '0000001')")
def _(t):
    return listing.scan(t.meta, "A", "0000001").select(*ID, "replica")


@query("src02", "SELECT bucket, count(*) AS n, sum(size)::BIGINT AS bytes FROM meta WHERE bucket = 'N' GROUP BY bucket")
def _(t):
    return listing.scan_strict(t.meta, "N").groupBy("bucket").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


@query("src03", "SELECT key, version_id, (count(*) OVER ()) > 50 AS is_truncated FROM (SELECT * FROM latest WHERE bucket = 'R' AND NOT is_delete_marker AND key > '00000020' ORDER BY key LIMIT 51) QUALIFY row_number() OVER (ORDER BY key) <= 50")
def _(t):
    return listing.page(lww.latest(listing.scan(t.meta, "R")), "00000020", 50).select("key", "version_id", "is_truncated")


@query("src04", "SELECT bucket, key, count(*) AS n_versions, max(mod_time) AS newest FROM versions GROUP BY bucket, key")
def _(t):
    return lww.versions(t.meta).groupBy("bucket", "key").agg(F.count("*").alias("n_versions"), F.max("mod_time").alias("newest"))


@query("src05", "SELECT bucket, key, version_id, mod_time, size FROM (SELECT *, row_number() OVER (PARTITION BY bucket, key ORDER BY mod_time DESC, version_id DESC, meta_seq DESC, is_hard_deleted DESC) AS r FROM meta WHERE key = '00000017') WHERE r = 1")
def _(t):
    return lww.winner(t.meta.where("key = '00000017'"), "bucket", "key").select(*ID, "mod_time", "size")


@query("src06", "SELECT bucket, key, version_id FROM (SELECT *, row_number() OVER (PARTITION BY bucket, key ORDER BY mod_time DESC, version_id DESC, meta_seq DESC, is_hard_deleted DESC) AS r FROM meta WHERE key IN (SELECT lpad(CAST(p_partkey AS VARCHAR), 8, '0') FROM part WHERE p_size = 7)) WHERE r = 1")
def _(t):
    wanted = t.part.where("p_size = 7").select(F.lpad(F.col("p_partkey").cast("string"), 8, "0").alias("key"))
    return lww.winner(t.meta.join(wanted, "key", "left_semi"), "bucket", "key").select(*ID)


@query("src07", "SELECT bucket, key, version_id, replica FROM (SELECT *, row_number() OVER (PARTITION BY bucket, key ORDER BY mod_time DESC, version_id DESC, meta_seq DESC, is_hard_deleted DESC) AS r FROM meta WHERE replica <> 2) WHERE r = 1")
def _(t):
    return lww.winner(sinks.without_replicas(t.meta, [2]), "bucket", "key").select(*ID, "replica")


@query("src08", "SELECT bucket, count(*) AS n, sum(CAST(is_hard_deleted AS INT))::BIGINT AS hard FROM versions GROUP BY bucket")
def _(t):
    return lww.versions(t.meta).groupBy("bucket").agg(F.count("*").alias("n"), F.count_if("is_hard_deleted").alias("hard"))


@query("src09", "SELECT event_id, ts_ns, type FROM event_log WHERE ts_ns >= 1704153600000000000 AND ts_ns <= 1704672000000000000 AND type IN ('click', 'error') ORDER BY ts_ns, event_id LIMIT 200")
def _(t):
    return sinks.query_events(t.event_log, 1704153600000000000, 1704672000000000000, 200, ["click", "error"]).select("event_id", "ts_ns", "type")


@query("src10", "SELECT c_name, c_custkey FROM customer WHERE c_name >= 'Customer#00000001' AND c_name < 'Customer#00000002'")
def _(t):
    return t.customer.where("c_name >= 'Customer#00000001' AND c_name < 'Customer#00000002'").select("c_name", "c_custkey")


@query("src11", "SELECT bucket, key, 'segment' AS kind, CAST(i AS BIGINT) AS idx FROM latest, unnest(range(0, size // 16 + 1)) AS u(i) WHERE NOT is_delete_marker UNION ALL SELECT bucket, key, 'coalesced', CAST(i AS BIGINT) FROM latest, unnest(range(0, size // 32)) AS u(i) WHERE NOT is_delete_marker UNION ALL SELECT bucket, key, 'object', CAST(0 AS BIGINT) FROM latest WHERE NOT is_delete_marker AND ec_parity > 0")
def _(t):
    named = lambda kind, idx: F.transform(idx, lambda i: F.struct(F.lit(kind).alias("kind"), i.alias("idx")))
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.array().cast("array<bigint>"))
    segments, coalesced = F.floor(F.col("size") / 16) + 1, F.floor(F.col("size") / 32)
    targets = F.concat(named("segment", upto(segments)), named("coalesced", upto(coalesced)), named("object", upto((F.col("ec_parity") > 0).cast("long"))))
    return lww.latest(t.meta).select("bucket", "key", F.inline(targets))


@query("src12", "SELECT bucket, (row_number() OVER (PARTITION BY bucket ORDER BY key) - 1) // 100 AS page, key FROM latest WHERE NOT is_delete_marker")
def _(t):
    return listing.pages(lww.latest(t.meta), 100, "bucket").select("bucket", "page", "key")


@query("src13", "SELECT upload_id, key, initiated FROM uploads WHERE bucket = 'P'")
def _(t):
    return t.uploads.where("bucket = 'P'").select("upload_id", "key", "initiated")


@query("src14", "SELECT epoch, group_id, row_number() OVER (ORDER BY epoch DESC, group_id) AS probe FROM (VALUES (1, 'g0', true), (2, 'g1', false), (3, 'g2', false), (3, 'g3', false)) AS g(epoch, group_id, retired) WHERE NOT retired")
def _(t):
    g = rows(t, "(1, 'g0', true), (2, 'g1', false), (3, 'g2', false), (3, 'g3', false) AS g(epoch, group_id, retired)")
    return g.where("not retired").select("epoch", "group_id", F.row_number().over(Window.orderBy(F.desc("epoch"), "group_id")).alias("probe"))


@query("src15", "SELECT name FROM (SELECT DISTINCT concat(CASE WHEN p_size % 5 = 0 THEN '__' ELSE '' END, lower(replace(p_brand, '#', '-'))) AS name FROM part) WHERE NOT starts_with(name, '__') ORDER BY name")
def _(t):
    name = F.concat(F.when(F.col("p_size") % 5 == 0, "__").otherwise(""), F.lower(F.replace("p_brand", F.lit("#"), F.lit("-"))))
    return listing.user_buckets(t.part.select(name.alias("name")))


@query("snk01", "SELECT event_id, ts_ns FROM event_log WHERE ts_ns > (SELECT max(ts_ns) FROM event_log) - 604800000000000")
def _(t):
    return sinks.within_ttl(t.event_log, "ts_ns", 7 * 86400 * 10**9).select("event_id", "ts_ns")


@query("snk02", "SELECT event_id // 100 AS batch, count(*) AS n, min(us) AS first_us FROM event_log WHERE us > 0 AND type <> 'error' GROUP BY 1")
def _(t):
    return sinks.receipt_batches(t.event_log.where("type <> 'error'"), "us", 100)


@query("snk03", "SELECT cid, type, us FROM (SELECT cid, type, us, row_number() OVER (PARTITION BY cid ORDER BY us DESC, event_id DESC) AS r FROM event_log) WHERE r = 1")
def _(t):
    old, new = t.event_log.where("event_id % 2 = 0"), t.event_log.where("event_id % 2 = 1")
    last = lambda d: d.groupBy("cid").agg(F.max_by(F.struct("type", "us", "event_id"), F.struct("us", "event_id")).alias("w")).select("cid", "w.*")
    return sinks.upsert(last(old), last(new), ["cid"], F.struct("us", "event_id")).select("cid", "type", "us")


SNK04 = """SELECT bucket, key, cand_version, CASE WHEN cas THEN CASE WHEN coalesce(meta_seq, 0) + 1 = cand_seq AND (coalesce(group_id, '') = '' OR group_id = cand_group) THEN 'apply' ELSE 'reject_cas' END
    WHEN mod_time IS NULL OR (cand_time, cand_version, cand_seq, false) > (mod_time, version_id, meta_seq, is_hard_deleted) THEN 'apply' ELSE 'skip' END AS verdict
    FROM (SELECT o_orderstatus AS b0, CASE o_orderstatus WHEN 'F' THEN 'A' WHEN 'O' THEN 'N' ELSE 'R' END AS bucket, lpad(CAST(o_custkey % 300 AS VARCHAR), 8, '0') AS key, CAST(o_orderkey AS VARCHAR) AS cand_version, epoch_us(o_orderdate) // 1000000 AS cand_time,
        CAST(o_orderkey % 3 AS BIGINT) AS cand_seq, concat('g', CAST(o_custkey % 4 AS VARCHAR)) AS cand_group, o_orderkey % 2 = 0 AS cas FROM orders) c LEFT JOIN latest USING (bucket, key)"""


@query("snk04", SNK04)
def _(t):
    c = t.uploads.select(F.when(F.col("bucket") == "F", "A").when(F.col("bucket") == "O", "N").otherwise("R").alias("bucket"), F.lpad((F.col("key").cast("long") % 300).cast("string"), 8, "0").alias("key"), F.col("upload_id").alias("cand_version"), F.col("initiated").alias("cand_time"),
        (F.col("upload_id").cast("long") % 3).alias("cand_seq"), F.concat(F.lit("g"), (F.col("key").cast("long") % 4).cast("string")).alias("cand_group"), (F.col("upload_id").cast("long") % 2 == 0).alias("cas"))
    return lww.decide_write(lww.latest(t.meta, markers=True), c).select("bucket", "key", "cand_version", "verdict")


@query("snk05", "SELECT type AS category, count(*) AS sent, greatest(count(*) - 8, 0) AS dropped FROM event_log WHERE type IN ('click', 'error') GROUP BY type")
def _(t):
    return sinks.fan_out(t.event_log, ["click", "error"], 8)


@query("snk06", "SELECT us // 86400000000 AS day, count(*) AS offered, least(count(*), 300) AS queued, greatest(count(*) - 300, 0) AS dropped FROM event_log GROUP BY 1")
def _(t):
    return sinks.bounded_queue(t.event_log.withColumn("day", F.floor(F.col("us") / 86400000000)), "day", 300)


@query("snk07", "SELECT event_id, event_id % 6 + 1 AS attempt, least(0.5::DOUBLE * power(2, event_id % 6), 8.0::DOUBLE) AS wait_s FROM event_log WHERE type = 'error'")
def _(t):
    attempt = F.col("event_id") % 6 + 1
    return t.event_log.where("type = 'error'").select("event_id", attempt.alias("attempt"), fn.backoff(0.5, attempt, 8.0).alias("wait_s"))


@query("snk08", "SELECT CASE WHEN d.key IS NOT NULL THEN 'skipped' WHEN s.size % 17 = 0 THEN 'error' ELSE 'copied' END AS outcome, count(*) AS n FROM (SELECT * FROM latest WHERE NOT is_delete_marker AND bucket = 'A') s LEFT JOIN (SELECT DISTINCT key FROM latest WHERE NOT is_delete_marker AND bucket = 'R') d USING (key) GROUP BY 1")
def _(t):
    live = lww.latest(t.meta)
    return sinks.copy_outcomes(live.where("bucket = 'A'"), live.where("bucket = 'R'"), F.col("size") % 17 == 0).groupBy("outcome").agg(F.count("*").alias("n"))


@query("snk09", "SELECT key, bucket FROM latest WHERE bucket = 'A' AND NOT is_delete_marker UNION ALL SELECT key, bucket FROM latest WHERE bucket = 'N' AND NOT is_delete_marker AND key NOT IN (SELECT key FROM latest WHERE bucket = 'A' AND NOT is_delete_marker)")
def _(t):
    live = lww.latest(t.meta).select("key", "bucket")
    return sinks.read_through(live.where("bucket = 'A'"), live.where("bucket = 'N'"), "key")


@query("flt01", "SELECT bucket, key, version_id, meta_seq FROM meta WHERE starts_with(key, '000000')")
def _(t):
    return t.meta.where(F.col("key").startswith("000000")).select(*ID, "meta_seq")


@query("flt02", "SELECT DISTINCT key FROM meta WHERE key > '00000150'")
def _(t):
    return t.meta.where("key > '00000150'").select("key").distinct()


@query("flt03", "SELECT bucket, key, version_id FROM latest WHERE NOT is_delete_marker")
def _(t):
    return listing.visible(lww.latest(t.meta, markers=True)).orderBy("bucket", "key").select(*ID)


@query("flt04", "SELECT bucket, key, version_id, is_delete_marker FROM live")
def _(t):
    return lww.live_versions(t.meta).select(*ID, "is_delete_marker")


@query("flt05", "SELECT l.bucket, l.key, l.version_id, r.id FROM live l JOIN rules r USING (bucket) WHERE starts_with(l.key, r.prefix) AND (r.tag IS NULL OR list_has_all(string_split(l.tag, ';'), string_split(r.tag, ';'))) AND (r.size_gt IS NULL OR l.size > r.size_gt) AND (r.size_lt IS NULL OR l.size < r.size_lt)")
def _(t):
    from ..operators import lifecycle

    return lww.live_versions(t.meta).join(t.rules.withColumnRenamed("tag", "rule_tag"), "bucket").where(lifecycle.matches()).select(*ID, "id")


COND = """SELECT bucket, key, version_id, CASE WHEN {im} IS NOT NULL AND NOT ({im} = etag OR {im} = '*') THEN 412 WHEN {inm} IS NOT NULL AND ({inm} = etag OR {inm} = '*') THEN 304 WHEN {inm} IS NULL AND {ims} IS NOT NULL AND mod_time <= {ims} THEN 304
    WHEN {im} IS NULL AND {ius} IS NOT NULL AND mod_time > {ius} THEN 412 ELSE 200 END AS status FROM latest""".format(
    im="(CASE size % 5 WHEN 0 THEN etag WHEN 1 THEN '*' WHEN 2 THEN 'x' END)", inm="(CASE size % 7 WHEN 0 THEN etag WHEN 1 THEN 'y' END)", ims="(CASE WHEN size % 3 = 0 THEN 946684800 END)", ius="(CASE WHEN size % 3 = 1 THEN 946684800 END)"
)


@query("flt06", COND)
def _(t):
    d = lww.latest(t.meta, markers=True).withColumns({"if_match": F.expr("CASE size % 5 WHEN 0 THEN etag WHEN 1 THEN '*' WHEN 2 THEN 'x' END"), "if_none_match": F.expr("CASE size % 7 WHEN 0 THEN etag WHEN 1 THEN 'y' END"),
        "if_modified": F.expr("CASE WHEN size % 3 = 0 THEN 946684800 END"), "if_unmodified": F.expr("CASE WHEN size % 3 = 1 THEN 946684800 END")})
    return d.select(*ID, policy.http_conditions().alias("status"))


BARE = "regexp_replace(trim({c}), '^\"|\"$', '', 'g')"
REFUSED = "({c} LIKE '%,%' OR starts_with(trim({c}), 'W/'))"
COPY = """SELECT bucket, key, version_id, CASE WHEN """ + REFUSED.format(c="m") + " THEN 400 WHEN " + BARE.format(c="m") + " <> etag THEN 412 WHEN mod_time > 978307200 THEN 412 WHEN " + REFUSED.format(c="nm") + " THEN 400 WHEN " + BARE.format(c="nm") + """ = etag THEN 412 WHEN mod_time <= 852076800 THEN 412 ELSE 200 END AS status
    FROM (SELECT *, nullif(CASE size % 8 WHEN 0 THEN '"' || etag || '"' WHEN 1 THEN '*' WHEN 2 THEN 'W/"' || etag || '"' WHEN 3 THEN '"' || etag || '", "x"' WHEN 4 THEN ' ' || etag || ' ' WHEN 5 THEN '' END, '') AS m, nullif(CASE size % 9 WHEN 2 THEN etag WHEN 4 THEN 'W/"x"' WHEN 6 THEN '"y"' WHEN 8 THEN '' END, '') AS nm FROM latest)"""


@query("flt07", COPY)
def _(t):
    d = lww.latest(t.meta, markers=True).withColumns({"if_match": F.expr("""CASE size % 8 WHEN 0 THEN concat('"', etag, '"') WHEN 1 THEN '*' WHEN 2 THEN concat('W/"', etag, '"') WHEN 3 THEN concat('"', etag, '", "x"') WHEN 4 THEN concat(' ', etag, ' ') WHEN 5 THEN '' END"""), "if_none_match": F.expr("""CASE size % 9 WHEN 2 THEN etag WHEN 4 THEN 'W/"x"' WHEN 6 THEN '"y"' WHEN 8 THEN '' END""")})
    return d.select(*ID, policy.copy_conditions(978307200, 852076800).alias("status"))


@query("flt08", "SELECT event_id, type FROM event_log WHERE type IN ('view', 'signup')")
def _(t):
    return sinks.of_types(t.event_log, ["view", "signup"]).select("event_id", "type")


@query("flt09", "SELECT raw, CASE WHEN regexp_full_match(raw, '[0-9]{1,9}') AND CAST(raw AS BIGINT) > 0 THEN CAST(raw AS BIGINT) ELSE 3600 END AS since FROM (VALUES ('60'), ('x'), ('-5'), ('0'), (''), ('86400')) AS v(raw)")
def _(t):
    return rows(t, "('60'), ('x'), ('-5'), ('0'), (''), ('86400') AS v(raw)").select("raw", sinks.positive_or(F.col("raw"), 3600).alias("since"))


@query("flt10", "SELECT node, type, count(*) AS n FROM event_log WHERE (node = 'n1' AND type = 'click') OR (node = 'n2' AND type IN ('view', 'error')) GROUP BY node, type")
def _(t):
    subs = rows(t, "('n1', 'click'), ('n2', 'view'), ('n2', 'error') AS s(node, type)")
    return t.event_log.join(F.broadcast(subs), ["node", "type"], "left_semi").groupBy("node", "type").agg(F.count("*").alias("n"))


@query("flt11", "SELECT node_id, us, least(greatest(disk_pct, 0), 100) AS disk_pct, greatest(rps, 0) AS rps FROM node_stats WHERE (SELECT max(us) FROM node_stats) - us <= 3 * 86400000000")
def _(t):
    s = t.node_stats
    top = s.agg(F.max("us").alias("now"))
    return s.crossJoin(F.broadcast(top)).where("now - us <= 3 * 86400000000L").select("node_id", "us", F.least(F.greatest("disk_pct", F.lit(0.0)), F.lit(100.0)).alias("disk_pct"), F.greatest("rps", F.lit(0.0)).alias("rps"))


@query("flt12", "SELECT bucket, key, version_id FROM versions WHERE mod_time > 978307200")
def _(t):
    return lww.versions(t.meta).where("mod_time > 978307200").select(*ID)


@query("flt13", "SELECT bucket, key FROM latest WHERE NOT is_delete_marker AND ec_data >= 1 AND ec_parity = 0 AND 1000000000 - mod_time >= 86400 AND (SELECT count(DISTINCT peer) FROM groups) >= 2 AND (SELECT max(n) FROM (SELECT count(*) AS n FROM groups GROUP BY group_id)) >= 2")
def _(t):
    from ..operators import repair

    there = lww.latest(t.meta).crossJoin(F.broadcast(repair.redundant_capacity(t.groups)))
    return there.where(repair.needs_redundancy(1000000000, 86400, F.col("redundant"))).select("bucket", "key")


@query("flt14", "SELECT name, regexp_full_match(name, '[a-z0-9][a-z0-9.-]{1,61}[a-z0-9]') AND NOT starts_with(name, '__') AS ok FROM (SELECT DISTINCT lower(replace(p_brand, '#', CASE WHEN p_size % 2 = 0 THEN '-' ELSE '_' END)) AS name FROM part)")
def _(t):
    name = F.lower(F.when(F.col("p_size") % 2 == 0, F.replace("p_brand", F.lit("#"), F.lit("-"))).otherwise(F.replace("p_brand", F.lit("#"), F.lit("_"))))
    return t.part.select(name.alias("name")).distinct().select("name", (fn.valid_bucket(F.col("name")) & ~F.col("name").startswith("__")).alias("ok"))


TAGS = "(1, 'env', 'prod'), (1, 'env', 'dev'), (2, 'aws:x', 'v'), (3, '', 'v'), (4, 'ok', 'fine'), (5, 'bad~', 'v'), (6, 'größe', 'ü')"


@query("flt15", f"SELECT id, CASE WHEN count(*) > 10 THEN 'too many' WHEN bool_or(octet_length(encode(k)) NOT BETWEEN 1 AND 128) THEN 'key length' WHEN bool_or(octet_length(encode(v)) > 256) THEN 'value length' WHEN bool_or(starts_with(k, 'aws:')) THEN 'reserved' WHEN bool_or(NOT regexp_full_match(k, '[\\p{{L}}\\p{{N}}\\s+\\-=._:/@]*')) THEN 'charset' WHEN count(DISTINCT k) < count(*) THEN 'duplicate' ELSE 'ok' END AS verdict FROM (VALUES {TAGS}) AS t(id, k, v) GROUP BY id")
def _(t):
    return policy.tag_verdict(rows(t, f"{TAGS} AS t(id, k, v)"))


@query("flt16", "SELECT bucket, id, CASE WHEN id = '' THEN 'no id' WHEN count(*) OVER (PARTITION BY bucket, id) > 1 THEN 'duplicate id' WHEN status NOT IN ('Enabled', 'Disabled') THEN 'bad status' WHEN coalesce(exp_days, exp_date, nc_days, nc_newer, abort_days) IS NULL AND NOT exp_marker THEN 'no action' WHEN exp_days < 0 THEN 'bad days' WHEN exp_days IS NOT NULL AND exp_date IS NOT NULL THEN 'days and date' WHEN coalesce(exp_days, exp_date) IS NOT NULL AND exp_marker THEN 'marker with days or date' WHEN exp_date % 86400 <> 0 THEN 'date is no midnight' WHEN regexp_matches(lower(tag), '(^|;)aws:') THEN 'reserved tag' WHEN size_gt >= size_lt THEN 'empty size range' WHEN abort_days IS NOT NULL AND (tag IS NOT NULL OR size_gt IS NOT NULL) THEN 'abort with tag or size' WHEN abort_days <= 0 THEN 'bad abort days' END AS error FROM rules")
def _(t):
    from ..operators import lifecycle

    return lifecycle.rule_errors(t.rules)


POST = "(1, 'eq', 'bucket', 'b1'), (1, 'starts-with', 'key', 'user/'), (2, 'eq', 'bucket', 'b2'), (2, 'starts-with', 'key', ''), (3, 'starts-with', 'key', 'x/')"
FORM = "('bucket', 'b1'), ('key', 'user/a.txt')"


@query("flt17", f"SELECT id, bool_and(CASE WHEN op = 'eq' THEN coalesce(f.v, '') = p.v ELSE starts_with(coalesce(f.v, ''), p.v) END) AS ok FROM (VALUES {POST}) AS p(id, op, k, v) LEFT JOIN (VALUES {FORM}) AS f(k, v) USING (k) GROUP BY id")
def _(t):
    return policy.post_policy(rows(t, f"{POST} AS p(id, op, k, v)"), rows(t, f"{FORM} AS f(k, form)"))


METHODS = "('GET'), ('PUT'), ('POST'), ('DELETE'), ('HEAD'), ('PATCH')"
PLACES = "('/'), ('/b'), ('/b/k'), ('/b/k/j'), ('/metrics'), ('/api'), ('/api/x'), ('/api/cluster/status'), ('/api/cluster/x'), ('/admin'), ('/admin/x'), ('/ui'), ('/ui/x'), ('/metrics/x'), ('other')"
ASKED = "(''), ('uploads'), ('uploads='), ('uploadId=1'), ('partNumber=1&uploadId=u'), ('delete'), ('policy'), ('x=1&policy'), ('versioning'), ('lifecycle'), ('versions'), ('list-type=2')"
CALLS = f"(SELECT method, path, q, copies FROM (VALUES {METHODS}) AS a(method) CROSS JOIN (VALUES {PLACES}) AS b(path) CROSS JOIN (VALUES {ASKED}) AS c(q) CROSS JOIN (VALUES (true), (false)) AS d(copies))"
NAMED = "list_contains(list_transform(string_split(q, '&'), lambda p: split_part(p, '=', 1)), '{k}')"
ANYWHERE = "(q = '{k}' OR starts_with(q, '{k}&') OR contains(q, '&{k}') OR contains(q, '{k}='))"
TITLE = "CASE method WHEN 'GET' THEN 'Get' WHEN 'PUT' THEN 'Put' WHEN 'DELETE' THEN 'Delete' ELSE 'Unknown' END"
HAS_KEY = "contains(trim(path, '/'), '/')"
METRIC = f"""CASE WHEN service = 'metrics' THEN 'Scrape' WHEN service IN ('cluster', 'admin') THEN CASE WHEN path = '/api/cluster/status' THEN 'Status' ELSE 'API' END WHEN service = 'dashboard' THEN 'UI' WHEN service = 'other' THEN method
    WHEN method = 'GET' AND path = '/' THEN 'ListBuckets' WHEN method = 'POST' AND NOT {HAS_KEY} AND {NAMED.format(k='delete')} THEN 'DeleteObjects' WHEN method = 'POST' AND {HAS_KEY} AND {NAMED.format(k='uploads')} THEN 'CreateMultipartUpload'
    WHEN method = 'PUT' AND {HAS_KEY} AND {NAMED.format(k='uploadId')} AND {NAMED.format(k='partNumber')} THEN 'UploadPart'
    WHEN {HAS_KEY} AND {NAMED.format(k='uploadId')} AND method IN ('POST', 'DELETE', 'GET') THEN CASE method WHEN 'POST' THEN 'CompleteMultipartUpload' WHEN 'DELETE' THEN 'AbortMultipartUpload' ELSE 'ListParts' END
    WHEN method IN ('GET', 'HEAD', 'PUT', 'DELETE') THEN CASE WHEN {HAS_KEY} THEN CASE method WHEN 'GET' THEN 'GetObject' WHEN 'HEAD' THEN 'HeadObject' WHEN 'PUT' THEN 'PutObject' ELSE 'DeleteObject' END ELSE CASE method WHEN 'GET' THEN 'ListBucket' WHEN 'HEAD' THEN 'HeadBucket' WHEN 'PUT' THEN 'CreateBucket' ELSE 'DeleteBucket' END END ELSE method END"""
SERVICE = "CASE WHEN path = '/metrics' THEN 'metrics' WHEN starts_with(path, '/api/cluster/') THEN 'cluster' WHEN path IN ('/api', '/admin') OR starts_with(path, '/api/') OR starts_with(path, '/admin/') THEN 'admin' WHEN path = '/ui' OR starts_with(path, '/ui/') THEN 'dashboard' WHEN starts_with(path, '/') AND NOT starts_with(path, '/metrics/') THEN 's3' ELSE 'other' END"
AUDIT = f"""CASE WHEN method = 'PUT' AND {HAS_KEY} AND copies THEN 'CopyObject' WHEN {ANYWHERE.format(k='policy')} AND method IN ('GET', 'PUT', 'DELETE') THEN concat({TITLE}, 'BucketPolicy') WHEN {ANYWHERE.format(k='versioning')} THEN concat({TITLE}, 'BucketVersioning')
    WHEN {ANYWHERE.format(k='lifecycle')} THEN concat({TITLE}, 'BucketLifecycle') WHEN {ANYWHERE.format(k='versions')} THEN 'ListObjectVersions' WHEN method = 'GET' AND NOT {HAS_KEY} AND {ANYWHERE.format(k='uploads')} THEN 'ListMultipartUploads'
    WHEN method = 'POST' AND {HAS_KEY} AND {ANYWHERE.format(k='uploads')} THEN 'CreateMultipartUpload' WHEN {ANYWHERE.format(k='uploadId')} AND method IN ('PUT', 'POST', 'DELETE', 'GET') THEN CASE method WHEN 'PUT' THEN 'UploadPart' WHEN 'POST' THEN 'CompleteMultipartUpload' WHEN 'DELETE' THEN 'AbortMultipartUpload' ELSE 'ListParts' END
    WHEN NOT {HAS_KEY} AND method IN ('GET', 'HEAD', 'PUT', 'DELETE') THEN CASE method WHEN 'GET' THEN 'ListObjects' WHEN 'HEAD' THEN 'HeadBucket' WHEN 'PUT' THEN 'CreateBucket' ELSE 'DeleteBucket' END WHEN method = 'PATCH' THEN 'Unknown' ELSE concat(CASE method WHEN 'HEAD' THEN 'Head' WHEN 'POST' THEN 'Post' ELSE {TITLE} END, 'Object') END"""


@query("flt18", f"SELECT method, path, q, copies, service, {METRIC} AS operation, {AUDIT} AS audited FROM (SELECT *, {SERVICE} AS service FROM {CALLS})")
def _(t):
    calls = rows(t, f"{METHODS} AS a(method)").crossJoin(rows(t, f"{PLACES} AS b(path)")).crossJoin(rows(t, f"{ASKED} AS c(q)")).crossJoin(rows(t, "(true), (false) AS d(copies)"))
    return policy.routes(calls).select("method", "path", "q", "copies", "service", "operation", "audited")


@query("flt19", "SELECT node AS grp, count(*) FILTER (WHERE type = 'error') AS errors, CASE WHEN count(*) FILTER (WHERE type = 'error') * 5 > count(*) THEN 'error_rate' END AS issue1, CASE WHEN max(us) < (SELECT max(us) FROM event_log) - 3600000000 THEN 'stale' END AS issue2 FROM event_log GROUP BY node")
def _(t):
    e = t.event_log
    now = F.broadcast(e.agg(F.max("us").alias("now")))
    g = e.groupBy(F.col("node").alias("grp")).agg(F.count_if(F.col("type") == "error").alias("errors"), F.count("*").alias("n"), F.max("us").alias("last")).crossJoin(now)
    return g.select("grp", "errors", F.when(F.col("errors") * 5 > F.col("n"), "error_rate").alias("issue1"), F.when(F.col("last") < F.col("now") - 3600000000, "stale").alias("issue2"))


NODES = "list_transform(range(0, CASE WHEN size % 11 = 0 THEN 0 WHEN size % 7 = 0 THEN ec_data + ec_parity + 1 ELSE ec_data + ec_parity END), lambda i: concat('n', (size + i) % 5))"
PROFILES = "['1+0', '1+1', '2+1', '2+2', '3+2', '4+2', '5+2', '6+2']"
LAYOUT = f"""WITH o AS (SELECT *, {NODES} AS nodes, coalesce(list_position({PROFILES}, concat(ec_data, '+', ec_parity)), 0) AS actual FROM latest WHERE NOT is_delete_marker),
    g AS (SELECT group_id, list(peer) AS peers, coalesce(list_position({PROFILES}, CASE count(*) WHEN 1 THEN '1+0' WHEN 2 THEN '1+1' WHEN 3 THEN '2+1' ELSE concat(least(count(*) - 2, 6), '+2') END), 0) AS desired FROM groups GROUP BY group_id)
    SELECT o.bucket, o.key, CASE WHEN g.peers IS NULL THEN 'unknown' WHEN len(nodes) = 0 OR len(nodes) <> ec_data + ec_parity THEN 'repair-needed' WHEN actual > 0 AND desired > 0 AND actual > desired THEN 'downgrade-skipped' WHEN NOT list_has_all(peers, nodes) OR list_contains(nodes, 'n2') THEN 'repair-needed' WHEN actual = 0 OR desired = 0 THEN 'unknown' WHEN actual < desired THEN 'pending-upgrade' ELSE 'current' END AS layout FROM o LEFT JOIN g USING (group_id)"""


@query("flt20", LAYOUT)
def _(t):
    from ..operators import repair

    shards = F.col("ec_data") + F.col("ec_parity")
    n = F.when(F.col("size") % 11 == 0, 0).when(F.col("size") % 7 == 0, shards + 1).otherwise(shards)
    nodes = F.when(n == 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.concat(F.lit("n"), ((F.col("size") + i) % 5).cast("string"))))
    return repair.layouts(lww.latest(t.meta).withColumn("node_ids", nodes), t.groups, ["n2"]).select("bucket", "key", "layout")


@query("flt21", "SELECT upload_id, CASE WHEN count(*) >= 6 THEN 'count' WHEN sum(size) >= 100 * 1048576 THEN 'size' WHEN 915148800 - min(created) >= 94608000 THEN 'idle' END AS trigger FROM parts GROUP BY upload_id")
def _(t):
    p = t.parts.groupBy("upload_id").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), F.min("created").alias("first"))
    idle = 915148800 - F.col("first") >= 94608000
    return p.select("upload_id", F.when(F.col("n") >= 6, "count").when(F.col("bytes") >= 100 * 1048576, "size").when(idle, "idle").alias("trigger"))


LAST_STATS = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY us DESC, disk_pct DESC, avail DESC, rps DESC) AS r FROM node_stats) WHERE r = 1)"


@query("flt22", f"SELECT node_id, disk_pct >= 60 AS is_open FROM {LAST_STATS}")
def _(t):
    from ..operators import balance

    return balance.current(t.node_stats).select("node_id", (F.col("disk_pct") >= 60).alias("is_open"))


@query("flt23", "SELECT bucket, key, acl, (acl & 2) > 0 OR ((acl & 1) > 0 AND size % 2 = 0) OR size % 3 = 0 AS allowed FROM latest")
def _(t):
    return lww.latest(t.meta, markers=True).select("bucket", "key", "acl", policy.acl_allows(F.col("acl"), F.col("size") % 2 == 0, F.col("size") % 3 == 0).alias("allowed"))


@query("flt25", f"SELECT g.group_id, NOT bool_or(coalesce(s.disk_pct >= 60, false) AND g.peer <> 'n0') AS accepted FROM groups g LEFT JOIN {LAST_STATS} s ON g.peer = s.node_id GROUP BY g.group_id")
def _(t):
    from ..operators import balance

    s = balance.current(t.node_stats).select(F.col("node_id").alias("peer"), "disk_pct")
    return t.groups.join(s, "peer", "left").groupBy("group_id").agg((~F.bool_or(F.coalesce(F.col("disk_pct") >= 60, F.lit(False)) & (F.col("peer") != "n0"))).alias("accepted"))


@query("flt27", "SELECT node_id, us, avail FROM node_stats WHERE avail > 0 AND us >= (SELECT max(us) FROM node_stats) - 86400000000")
def _(t):
    s = t.node_stats
    return s.crossJoin(F.broadcast(s.agg(F.max("us").alias("now")))).where("avail > 0 AND us >= now - 86400000000L").select("node_id", "us", "avail")


@query("prj01", "SELECT bucket, key, version_id, size, etag, concat(CAST(ec_data AS VARCHAR), '+', CAST(ec_parity AS VARCHAR)) AS profile FROM latest WHERE NOT is_delete_marker")
def _(t):
    return lww.latest(t.meta).select(*ID, "size", "etag", F.concat(F.col("ec_data").cast("string"), F.lit("+"), F.col("ec_parity").cast("string")).alias("profile"))


@query("prj02", "SELECT CASE WHEN is_delete_marker THEN 'marker' ELSE 'version' END AS output, count(*) AS n FROM live WHERE bucket = 'A' GROUP BY 1")
def _(t):
    output = F.when(F.col("is_delete_marker"), "marker").otherwise("version").alias("output")
    return listing.scan(lww.live_versions(t.meta), "A").groupBy(output).agg(F.count("*").alias("n"))


@query("prj03", "SELECT bucket, key, version_id, lag(version_id) OVER w AS prev_version, lag(size) OVER w AS prev_size FROM live WINDOW w AS (PARTITION BY bucket, key ORDER BY mod_time, version_id)")
def _(t):
    w = Window.partitionBy("bucket", "key").orderBy("mod_time", "version_id")
    return lww.live_versions(t.meta).select(*ID, F.lag("version_id").over(w).alias("prev_version"), F.lag("size").over(w).alias("prev_size"))


@query("prj04", "SELECT ec_data, ec_parity, count(*) AS n FROM latest WHERE NOT is_delete_marker GROUP BY 1, 2")
def _(t):
    return lww.latest(t.meta).groupBy("ec_data", "ec_parity").agg(F.count("*").alias("n"))

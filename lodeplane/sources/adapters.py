"""The entities of an object store's metadata plane, as views over the driver's tables.

Each view is plain SQL that Spark and other engines read alike; `//` is integer division and
EPOCH_US() the microseconds since 1970 of a timestamp without zone.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents"]

VIEWS = {
    # one replica's record of an object version; a seventh of the orders have a second, newer copy
    "meta": """
        SELECT l_returnflag AS bucket, lpad(CAST(l_partkey AS STRING), 8, '0') AS key,
               concat(lpad(CAST(l_orderkey AS STRING), 10, '0'), '-', CAST(l_linenumber AS STRING), '-', CAST(l_suppkey AS STRING)) AS version_id,
               CAST((l_suppkey + n) % 3 AS INT) AS replica, EPOCH_US(l_shipdate) // 1000000 AS mod_time, CAST(n AS BIGINT) AS meta_seq,
               CAST(l_quantity AS BIGINT) AS size, md5(concat(CAST(l_orderkey AS STRING), '/', CAST(l_partkey AS STRING), '/', CAST(l_linenumber AS STRING))) AS etag,
               (l_linestatus = 'F' AND l_linenumber = 1) AS is_delete_marker, (n = 1 AND l_orderkey % 49 = 0) AS is_hard_deleted,
               CAST(l_linenumber % 4 AS INT) AS acl, CASE WHEN l_partkey % 3 = 0 THEN 1 ELSE 4 END AS ec_data,
               CASE WHEN l_partkey % 3 = 0 THEN 0 ELSE 2 END AS ec_parity, concat('g', CAST(l_partkey % 5 AS STRING)) AS group_id,
               concat('class=', CASE WHEN l_suppkey % 2 = 0 THEN 'hot' ELSE 'cold' END, ';half=', CAST(l_linenumber % 2 AS STRING)) AS tag
        FROM lineitem CROSS JOIN (SELECT 0 AS n UNION ALL SELECT 1 AS n) copies WHERE n = 0 OR l_orderkey % 7 = 0""",
    "event_log": """
        SELECT event_id, EPOCH_US(ts) AS us, EPOCH_US(ts) * 1000 AS ts_ns, user_id, event_type AS type, value,
               concat('n', CAST(user_id % 8 AS STRING)) AS node, concat('b', CAST(user_id % 5 AS STRING)) AS bucket,
               concat('c', CAST(user_id AS STRING)) AS cid FROM events""",
    "heal_events": """
        SELECT event_id, us, cid, concat('n', CAST(event_id // 3 % 8 AS STRING)) AS peer, bucket, CASE event_id % 4 WHEN 0 THEN 'detect' WHEN 1 THEN 'reconstruct' WHEN 2 THEN 'write' ELSE 'verify' END AS phase,
               CASE WHEN event_id % 6 = 5 THEN 'failed' ELSE 'success' END AS outcome, CAST(event_id % 7 AS INT) - 1 AS shard_id FROM event_log""",
    "node_stats": """
        SELECT node AS node_id, us, (event_id * 37 % 1200) / 1e1 - 5 AS disk_pct, event_id * 7919 % 100000 AS avail, event_id * 13 % 101 / 1e0 - 1 AS rps FROM event_log""",
    "uploads": """
        SELECT CAST(o_orderkey AS STRING) AS upload_id, o_orderstatus AS bucket, lpad(CAST(o_custkey AS STRING), 8, '0') AS key,
               EPOCH_US(o_orderdate) // 1000000 AS initiated FROM orders""",
    "parts": """
        SELECT CAST(l_orderkey AS STRING) AS upload_id, l_linenumber AS part_number, CAST(l_quantity AS BIGINT) * 1048576 AS size,
               md5(concat(CAST(l_partkey AS STRING), ':', CAST(l_suppkey AS STRING))) AS etag, EPOCH_US(l_shipdate) // 1000000 AS created FROM lineitem""",
    "chunk_refs": """
        SELECT concat('m', CAST(l_orderkey AS STRING)) AS manifest, concat('k', CAST(l_partkey - l_partkey % 3 AS STRING)) AS chunk FROM lineitem""",
    "tombstones": """
        SELECT concat('k', CAST(p_partkey AS STRING)) AS chunk, p_partkey * 60 AS t_zero FROM part""",
    "rules": """
        SELECT * FROM (VALUES ('A', 0, 'r-days', 'Enabled', '000', CAST(NULL AS STRING), CAST(10 AS BIGINT), CAST(NULL AS BIGINT), 30, false, CAST(NULL AS INT), CAST(NULL AS INT), 7, CAST(NULL AS BIGINT)),
            ('A', 1, 'r-tag', 'Enabled', '', 'class=hot', NULL, 40, 365, false, 90, 2, NULL, NULL), ('R', 0, 'r-off', 'Disabled', '', NULL, NULL, NULL, 1, false, 1, 0, 1, NULL),
            ('R', 1, 'r-nc', 'Enabled', '', NULL, NULL, NULL, NULL, true, NULL, 3, NULL, NULL), ('N', 0, 'r-both', 'Enabled', '0000', 'class=cold;half=1', 5, 45, 3650, false, 400, 1, 30, NULL),
            ('F', 0, 'r-mpu', 'Enabled', '000', NULL, NULL, NULL, NULL, false, NULL, NULL, 10, NULL), ('F', 1, 'r-mpu2', 'Enabled', '', NULL, NULL, NULL, NULL, false, NULL, NULL, 3, NULL), ('O', 0, 'r-mpu3', 'Enabled', '00001', NULL, NULL, NULL, NULL, false, NULL, NULL, 5, NULL),
            ('N', 1, 'r-date', 'Enabled', '000', 'half=0', NULL, NULL, NULL, false, NULL, NULL, NULL, 946684800), ('N', 2, 'r-later', 'Enabled', '', NULL, NULL, NULL, NULL, false, NULL, NULL, NULL, 1893456000),
            ('N', 3, 'r-gone', 'Enabled', '0000', 'class=hot', NULL, NULL, NULL, true, NULL, NULL, NULL, NULL), ('O', 1, 'r-twice', 'Disabled', '', NULL, NULL, NULL, 1, false, NULL, NULL, NULL, NULL),
            ('O', 2, 'r-twice', 'Disabled', '', NULL, NULL, NULL, 1, false, NULL, NULL, NULL, NULL), ('O', 3, 'r-both', 'Disabled', '', NULL, NULL, NULL, 1, false, NULL, NULL, NULL, 946684800),
            ('O', 4, 'r-noon', 'Disabled', '', NULL, NULL, NULL, NULL, false, NULL, NULL, NULL, 946728000), ('O', 5, 'r-aws', 'Disabled', '', 'a=1;AWS:b=2', NULL, NULL, 1, false, NULL, NULL, NULL, NULL),
            ('O', 6, 'r-marker', 'Disabled', '', NULL, NULL, NULL, 5, true, NULL, NULL, NULL, NULL), ('O', 7, 'r-none', 'Disabled', '', NULL, NULL, NULL, NULL, false, NULL, NULL, NULL, NULL), ('O', 8, 'r-abort', 'Disabled', '', NULL, NULL, NULL, NULL, false, NULL, NULL, 0, NULL))
            AS r(bucket, pos, id, status, prefix, tag, size_gt, size_lt, exp_days, exp_marker, nc_days, nc_newer, abort_days, exp_date)""",
    "groups": """
        SELECT * FROM (VALUES ('g0', 'n0'), ('g0', 'n1'), ('g0', 'n2'), ('g1', 'n1'), ('g1', 'n2'), ('g1', 'n3'), ('g1', 'n4'), ('g2', 'n0'), ('g2', 'n5'), ('g3', 'n2'), ('g3', 'n3'), ('g3', 'n6'), ('g3', 'n7'), ('g4', 'n4'))
            AS g(group_id, peer)""",
    "requests": """
        SELECT event_id AS req, concat('sa', CAST(user_id % 6 AS STRING)) AS principal, bucket, CASE event_id % 4 WHEN 0 THEN 's3:GetObject' WHEN 1 THEN 's3:PutObject' WHEN 2 THEN 's3:ListBucket' ELSE CASE WHEN event_id % 8 = 3 THEN 's3:DeleteObject' ELSE 's3:PutBucketPolicy' END END AS action,
               concat('arn:aws:s3:::', bucket, '/', CASE WHEN event_id % 3 = 0 THEN 'logs/' ELSE 'data/' END, CAST(event_id % 50 AS STRING)) AS resource,
               concat('10.', CAST(event_id % 4 AS STRING), '.', CAST(event_id % 256 AS STRING), '.7') AS ip FROM event_log""",
    "statements": """
        SELECT * FROM (VALUES ('p-read', 0, 'Allow', 's3:Get*', 'arn:aws:s3:::*', CAST(NULL AS STRING)), ('p-read', 1, 'Allow', 's3:List*', 'arn:aws:s3:::b1*', NULL), ('p-write', 0, 'Allow', 's3:*', 'arn:aws:s3:::b2/*', '10.0.0.0/15'),
            ('p-write', 1, 'Deny', 's3:Delete*', '*', NULL), ('p-logs', 0, 'Allow', 's3:PutObject', 'arn:aws:s3:::*/logs/*', '10.2.0.0/16'), ('p-admin', 0, 'Allow', '*', '*', NULL), ('p-nolog', 0, 'Deny', '*', '*/logs/4*', NULL))
            AS s(policy, pos, effect, action, resource, cidr)""",
    "sa_policies": "SELECT * FROM (VALUES ('sa0', 'p-read'), ('sa1', 'p-write'), ('sa2', 'p-admin'), ('sa2', 'p-nolog'), ('sa3', 'p-gone')) AS e(sa, policy)",
    "sa_groups": "SELECT * FROM (VALUES ('sa3', 'ops'), ('sa4', 'ops'), ('sa4', 'dev'), ('sa1', 'dev')) AS e(sa, grp)",
    "group_policies": "SELECT * FROM (VALUES ('ops', 'p-logs'), ('ops', 'p-read'), ('dev', 'p-write')) AS e(grp, policy)",
    "bucket_statements": """
        SELECT * FROM (VALUES ('b0', 0, 'Allow', '*', 's3:GetObject', 'arn:aws:s3:::b0/*'), ('b0', 1, 'Deny', 'sa1', 's3:*', 'arn:aws:s3:::b0/logs/*'), ('b0', 2, 'Deny', '*', 's3:GetObject', 'arn:aws:s3:::b0/data/4'),
            ('b1', 0, 'Allow', 'sa2', 's3:*', 'arn:aws:s3:::b1'), ('b1', 1, 'Allow', 'sa3', 's3:PutObject', 'arn:aws:s3:::b1/data/7'), ('b2', 0, 'Allow', '*', 's3:*', 'arn:aws:s3:::b2/data/*'), ('b2', 1, 'Deny', '*', 's3:Delete*', 'arn:aws:s3:::b2/*'),
            ('b2', 2, 'Allow', 'sa1', 's3:*', 'arn:aws:s3:::b2/*'), ('b3', 0, 'Allow', 'sa0', '*', 'arn:aws:s3:::b3/*'), ('b3', 1, 'Allow', 'sa2', 's3:*', 'arn:aws:s3:::b0/*'))
            AS s(bucket, pos, effect, principal, action, resource)""",
    "sa_keys": "SELECT * FROM (VALUES ('sa0', 'AK3', 30), ('sa0', 'AK1', 10), ('sa1', 'AK2', 20), ('sa4', 'AK9', 5), ('sa4', 'AK8', 5)) AS k(sa, access_key, created)",
    "bucket_policies": "SELECT * FROM (VALUES ('b0', 'p-nolog'), ('b3', 'p-read')) AS e(bucket, policy)",
    # counters: running sums by user; a drop every fiftieth event is a reset
    "counters": """
        SELECT us, node, CASE WHEN type = 'error' THEN '500' WHEN type = 'signup' THEN '404' ELSE '200' END AS status, event_id % 50 * 3 + 1 AS value FROM event_log""",
    "buckets_le": """
        SELECT node, le, count(*) FILTER (WHERE value <= le) AS n FROM event_log CROSS JOIN (SELECT * FROM (VALUES (1e0), (5e0), (2e1), (5e1), (1e2), (2e2)) AS b(le)) bounds GROUP BY node, le""",
    "buckets_day": """
        SELECT node, us // 86400000000 AS day, le, count(*) FILTER (WHERE value <= le) AS n FROM event_log CROSS JOIN (SELECT * FROM (VALUES (1e0), (5e0), (2e1), (5e1), (1e2), (2e2)) AS b(le)) bounds GROUP BY node, us // 86400000000, le""",
    "facts": """
        SELECT cid, event_id AS seq, us, CASE event_id % 6 WHEN 0 THEN 'observed' WHEN 1 THEN 'diagnosed' WHEN 2 THEN 'action_started' WHEN 3 THEN 'verified' WHEN 4 THEN 'action_failed' ELSE 'isolated' END AS type,
               CASE user_id % 3 WHEN 0 THEN 'missing_shard' WHEN 1 THEN 'corrupt_shard' ELSE '' END AS cause, CASE WHEN event_id % 4 = 0 THEN 'isolate_object' ELSE 'repair' END AS action,
               CASE WHEN event_id % 5 = 0 THEN 'insufficient_survivors' ELSE '' END AS code, concat('r', CAST(event_id AS STRING)) AS receipt_id FROM event_log""",
    "versions": """
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY bucket, key, version_id ORDER BY mod_time DESC, meta_seq DESC, is_hard_deleted DESC) AS rn FROM meta) v WHERE rn = 1""",
    "live": "SELECT * FROM versions WHERE NOT is_hard_deleted",
    "latest": """
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY bucket, key ORDER BY mod_time DESC, version_id DESC) AS rk FROM live) x WHERE rk = 1""",
}


def spark_dialect(sql: str) -> str:
    sql = re.sub(r"EPOCH_US\((\w+)\)", r"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', \1)", sql)
    return sql.replace("//", " div ")


class Tables:
    """Driver tables and views of one folder as DataFrames, by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        if name not in VIEWS:
            raise AttributeError(name)
        sql = spark_dialect(VIEWS[name])
        used = {n for n in [*TABLES, *VIEWS] if n != name and re.search(rf"(FROM|JOIN) {n}\b", sql)}
        sql = re.sub(r"\b(FROM|JOIN) (\w+)\b", lambda m: f"{m[1]} {{{m[2]}}}" if m[2] in used else m[0], sql)
        return self.spark.sql(sql, **{n: getattr(self, n) for n in used})

"""Access policy: conditions, statement matching and decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as fn


def http_conditions() -> Column:
    """Status of a conditional read: If-Match, If-None-Match, If-Modified-Since, If-Unmodified-Since."""
    c = F.col
    hit = lambda h: (c(h) == c("etag")) | (c(h) == "*")
    return (
        F.when(c("if_match").isNotNull() & ~hit("if_match"), 412)
        .when(hit("if_none_match"), 304)
        .when(c("if_none_match").isNull() & (c("mod_time") <= c("if_modified")), 304)
        .when(c("if_match").isNull() & (c("mod_time") > c("if_unmodified")), 412)
        .otherwise(200)
    )


def copy_conditions(unmodified: int, modified: int) -> Column:
    """Match, unmodified, none-match, modified; an empty condition is none, a * is a literal here, and weak or several
    ETags are refused."""
    given = lambda h: F.trim(F.nullif(F.col(h), F.lit("")))
    refused = lambda h: given(h).contains(",") | given(h).startswith("W/")
    bare = lambda h: F.regexp_replace(given(h), '^"|"$', "")
    return (
        F.when(refused("if_match"), 400)
        .when(bare("if_match") != F.col("etag"), 412)
        .when(F.col("mod_time") > unmodified, 412)
        .when(refused("if_none_match"), 400)
        .when(bare("if_none_match") == F.col("etag"), 412)
        .when(F.col("mod_time") <= modified, 412)
        .otherwise(200)
    )


def tag_verdict(tags: DataFrame) -> DataFrame:
    """First failed rule of each tag set (id, k, v)."""
    bad = lambda c: F.bool_or(c)
    return tags.groupBy("id").agg(
        F.when(F.count("*") > 10, "too many")
        .when(bad(~F.octet_length("k").between(1, 128)), "key length")
        .when(bad(F.octet_length("v") > 256), "value length")
        .when(bad(F.col("k").startswith("aws:")), "reserved")
        .when(bad(~F.col("k").rlike(r"^[\p{L}\p{N}\s+\-=._:/@]*$")), "charset")
        .when(F.count_distinct("k") < F.count("*"), "duplicate")
        .otherwise("ok")
        .alias("verdict")
    )


def post_policy(conditions: DataFrame, form: DataFrame) -> DataFrame:
    both = conditions.join(form, "k", "left").withColumn("form", F.coalesce("form", F.lit("")))
    return both.groupBy("id").agg(F.bool_and(F.when(F.col("op") == "eq", F.col("form") == F.col("v")).otherwise(F.col("form").startswith(F.col("v")))).alias("ok"))


# Operations of the paths of the other services; a name that ends in / stands for all below it.
API_OPERATIONS = {
    "/api/cluster/status": "Status", "/api/cluster/placement": "Placement", "/api/cluster/balancer/status": "BalancerStatus",
    "/api/incidents": "Incidents", "/api/incidents/": "Incidents", "/api/events": "Events", "/api/eventlog": "Events",
}


def routes(requests: DataFrame) -> DataFrame:
    """service, operation for metrics and audited, the operation of the audit trail, of (method, path, q, copies)."""
    p, method = F.col("path"), F.col("method")
    under = lambda *xs: F.array_contains(F.array(*[(p == x) | p.startswith(x + "/") for x in xs]), True)
    service = (
        F.when(p == "/metrics", "metrics").when(p.startswith("/api/cluster/"), "cluster").when(under("/api", "/admin"), "admin")
        .when(under("/ui"), "dashboard").when(p.startswith("/") & ~under("/metrics"), "s3").otherwise("other")
    )
    api = F.coalesce(*[F.when(p.startswith(x) if x.endswith("/") else p == x, name) for x, name in API_OPERATIONS.items()], F.lit("API"))
    operation = F.when(F.col("service") == "s3", fn.s3_operation(method, p, F.col("q"))).when(F.col("service") == "metrics", "Scrape").when(F.col("service") == "dashboard", "UI").when(F.col("service") == "other", method).otherwise(api)
    has_key = F.instr(F.btrim(p, F.lit("/")), "/") > 0
    return requests.withColumn("service", service).withColumn("operation", operation).withColumn("audited", fn.audit_operation(method, has_key, F.col("q"), F.col("copies")))


def acl_allows(acl: Column, is_read: Column, has_key: Column) -> Column:
    return (acl.bitwiseAND(2) > 0) | ((acl.bitwiseAND(1) > 0) & is_read) | has_key


def principal_policies(sa_policies: DataFrame, sa_groups: DataFrame, group_policies: DataFrame) -> DataFrame:
    """principal, policy: direct ones and those by group, as a bag."""
    via = sa_groups.join(group_policies, "grp").select("sa", "policy")
    return sa_policies.select("sa", "policy").unionByName(via).withColumnRenamed("sa", "principal")


def granted(edges: DataFrame, statements: DataFrame) -> DataFrame:
    """Statements of each principal; policies without a document drop out."""
    return edges.join(statements, "policy")


def hits(requests: DataFrame, statements: DataFrame, on: list[str]) -> DataFrame:
    """Requests with the statements that match action, resource and address. Statements are joined on
    equal keys first, so globs are tried on a principal's or bucket's own statements alone."""
    s = statements.withColumnRenamed("action", "s_action").withColumnRenamed("resource", "s_resource")
    address = F.col("cidr").isNull() | fn.in_cidr(F.col("ip"), F.col("cidr"))
    return requests.join(s, on).where(fn.glob(F.col("action"), F.col("s_action")) & fn.glob(F.col("resource"), F.col("s_resource")) & address)


def bucket_hits(requests: DataFrame, statements: DataFrame, compiled: bool) -> DataFrame:
    """Requests with the statements of their bucket that match principal, action and resource; actions may end in :*.
    Compiled statements name a bucket, with all its keys or one; in the others any prefix may stand before /*."""
    s = statements.select("bucket", "pos", "effect", *[F.col(c).alias(f"s_{c}") for c in ("principal", "action", "resource")])
    named, asked = F.col("s_resource"), F.col("resource")
    who = F.col("s_principal").isin("*") | (F.col("s_principal") == F.col("principal"))
    what = (F.col("s_action") == F.col("action")) | (F.col("s_action").endswith(":*") & F.col("action").startswith(F.left("s_action", F.length("s_action") - 1)))
    if compiled:
        bucket, key, every = fn.arn(named)
        where = (bucket == F.col("bucket")) & (every | (key == fn.arn(asked)[1]))
    else:
        prefix = F.left(named, F.length(named) - 2)
        where = (named == asked) | (named.endswith("/*") & ((asked == prefix) | asked.startswith(F.concat(prefix, F.lit("/")))))
    return requests.join(s, "bucket").where(who & what & where)


def allowed(requests: DataFrame, hits_: DataFrame) -> DataFrame:
    """Any deny refuses, else any allow lets pass, else refused."""
    deny = F.col("effect") == "Deny"
    folded = hits_.groupBy("req").agg((F.bool_or(~deny) & ~F.bool_or(deny)).alias("ok"))
    return requests.join(folded, "req", "left").withColumn("allowed", F.coalesce("ok", F.lit(False))).drop("ok")


def layered(requests: DataFrame, iam: DataFrame, statements: DataFrame) -> DataFrame:
    """allow, layer and reason of requests with acl and keyed (whether an access key came): the grant first; then the
    bucket's policy, if it has one and the action is not on policies themselves; then the object's ACL."""
    action, acl = F.col("action"), F.col("acl")
    own = statements.select("bucket").distinct().withColumn("has_policy", F.lit(True))
    all_ = allowed(requests, bucket_hits(requests, statements, True)).join(own, "bucket", "left").join(iam.select("req", "decision"), "req")
    granted_ = F.col("decision") == "Allow"
    passes = action.isin("s3:GetBucketPolicy", "s3:PutBucketPolicy", "s3:DeleteBucketPolicy") | F.col("has_policy").isNull() | F.col("allowed")
    is_read = action.isin("s3:GetObject", "s3:HeadObject", "s3:ListBucket")
    by_acl = acl_allows(acl, is_read, F.col("keyed"))
    layer = (
        F.when(~granted_, "iam_grant").when(~passes, "bucket_policy").when(~by_acl, "object_acl")
        .when(acl.bitwiseAND(2) > 0, "object_acl_public_read_write").when((acl.bitwiseAND(1) > 0) & is_read, "object_acl_public_read").otherwise("object_acl_authenticated")
    )
    reason = F.when(~granted_, "no_grant").when(~passes, "policy_deny").when(~by_acl, F.when(F.col("keyed"), "acl_private_denied").otherwise("acl_anonymous_denied"))
    return all_.select("req", (granted_ & passes & by_acl).alias("allow"), layer.alias("layer"), reason.alias("reason"))


def decide(requests: DataFrame, matched: DataFrame) -> DataFrame:
    """Any deny, else any allow, else implicit deny; the label is the first deny or the last allow."""
    place = F.struct("policy", "pos")
    label = F.concat_ws("/", "policy", F.col("pos").cast("string"))
    deny = F.col("effect") == "Deny"
    folded = matched.groupBy("req").agg(F.bool_or(deny).alias("deny"), F.min_by(F.when(deny, label), F.when(deny, place)).alias("deny_label"), F.max_by(F.when(~deny, label), F.when(~deny, place)).alias("allow_label"))
    out = requests.join(folded, "req", "left")
    return out.select("req", F.when(F.col("deny"), "Deny").when(F.col("deny").isNotNull(), "Allow").otherwise("ImplicitDeny").alias("decision"), F.when(F.col("deny"), F.col("deny_label")).otherwise(F.col("allow_label")).alias("label"))

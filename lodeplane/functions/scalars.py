"""Scalar functions of the metadata plane as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def glob(subject: Column, pattern: Column) -> Column:
    """A true glob in which only * is special."""
    escaped = F.regexp_replace(pattern, r"([\\.\[\]{}()+?^$|])", r"\\$1")
    return F.regexp_like(subject, F.concat(F.lit("(?s)^"), F.replace(escaped, F.lit("*"), F.lit(".*")), F.lit("$")))


def segmented(subject: Column, pattern: Column) -> Column:
    """Equal numbers of / parts, each equal or under a * in the pattern."""
    a, b = F.split(subject, "/"), F.split(pattern, "/")
    return (F.size(a) == F.size(b)) & F.forall(F.zip_with(a, b, lambda x, y: F.coalesce((y == "*") | (x == y), F.lit(False))), lambda x: x)


def ipv4(ip: Column) -> Column:
    """The address as a number; null if it is none."""
    p = F.split(ip, r"\.")
    n = lambda i: F.get(p, F.lit(i)).cast("long")
    octet = r"(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
    return F.when(ip.rlike(rf"^{octet}(\.{octet}){{3}}$"), n(0) * 16777216 + n(1) * 65536 + n(2) * 256 + n(3))


def ipv6(ip: Column) -> Column:
    """The address as 128 binary digits; null if it is none. Forms with a dotted end are not read."""
    low = F.lower(ip)
    group, groups = "[0-9a-f]{1,4}", "(([0-9a-f]{1,4}:)*[0-9a-f]{1,4})?"
    side = lambda k: F.filter(F.coalesce(F.split(F.get(F.split(low, "::"), F.lit(k)), ":"), F.array().cast("array<string>")), lambda g: g != "")
    n = F.size(side(0)) + F.size(side(1))
    all_ = F.concat(side(0), F.array_repeat(F.lit("0"), 8 - n), side(1))
    ok = low.rlike(f"^({group}:){{7}}{group}$") | (low.rlike(f"^{groups}::{groups}$") & (n <= 7))
    return F.when(ok, F.array_join(F.transform(all_, lambda g: F.lpad(F.conv(g, 16, 2), 16, "0")), ""))


def in_cidr(ip: Column, cidr: Column) -> Column:
    """False for bad addresses and for those of the other family."""
    base, bits = F.substring_index(cidr, "/", 1), F.substring_index(cidr, "/", -1).cast("int")
    block = F.pow(F.lit(2.0), 32 - bits).cast("long")
    v4 = F.floor(ipv4(ip) / block) == F.floor(ipv4(base) / block)
    v6 = F.left(ipv6(ip), bits) == F.left(ipv6(base), bits)
    return F.coalesce(F.when(F.contains(cidr, F.lit(":")), v6).otherwise(v4), F.lit(False))


def is_address(ip: Column) -> Column:
    return F.coalesce(ipv4(ip).isNotNull() | ipv6(ip).isNotNull(), F.lit(False))


def arn(resource: Column) -> tuple[Column, Column, Column]:
    """Bucket, key and prefix mode: a resource that ends in /* stands for all keys of what is before it."""
    rest = F.regexp_replace(resource, "^arn:aws:s3:::", "")
    mode = rest.endswith("/*")
    bucket = F.when(mode, F.left(rest, F.length(rest) - 2)).otherwise(F.substring_index(rest, "/", 1))
    return bucket, F.when(mode, "").otherwise(F.regexp_extract(rest, r"(?s)^[^/]*/(.*)$", 1)), mode


def byte_range(header: Column, size: Column) -> tuple[Column, Column]:
    """First and last byte of `bytes=a-b`, `a-` or `-n`, clamped; null if not satisfiable."""
    part = lambda k: F.regexp_extract(header, r"^bytes=(\d*)-(\d*)", k)
    a, b = F.when(part(1) != "", part(1)).cast("long"), F.when(part(2) != "", part(2)).cast("long")
    first = F.when(a.isNull(), F.greatest(F.lit(0).cast("long"), size - b)).otherwise(a)
    last = F.when(a.isNull(), size - 1).otherwise(F.least(F.coalesce(b, size - 1), size - 1))
    ok = (a.isNotNull() | (b > 0)) & (first <= last) & (first < size)
    return F.when(ok, first), F.when(ok, last)


def strict_range(header: Column, size: Column) -> tuple[Column, Column]:
    """First and last byte of `bytes=a-b`; null unless both are inside."""
    part = lambda k: F.regexp_extract(header, r"^bytes=(\d+)-(\d+)$", k)
    a, b = F.when(part(1) != "", part(1)).cast("long"), F.when(part(2) != "", part(2)).cast("long")
    ok = (a <= b) & (b < size)
    return F.when(ok, a), F.when(ok, b)


def fnv32a(s: Column) -> Column:
    """FNV-1a of 32 bits over UTF-8 bytes."""
    bytes_ = F.filter(F.split(F.regexp_replace(F.hex(F.encode(s, "UTF-8")), "(..)", "$1 "), " "), lambda x: x != "")
    numbers = F.transform(bytes_, lambda x: F.conv(x, 16, 10).cast("long"))
    return F.aggregate(numbers, F.lit(2166136261).cast("long"), lambda h, b: (h.bitwiseXOR(b) * 16777619) % 4294967296)


def composite_etag(etags: Column) -> Column:
    """md5 over the concatenated binary md5s, with the number of parts."""
    return F.concat(F.md5(F.unhex(F.array_join(etags, ""))), F.lit("-"), F.size(etags).cast("string"))


def ec_profile(n: Column) -> tuple[Column, Column]:
    k = F.when(n <= 0, 0).when(n <= 2, 1).when(n == 3, 2).otherwise(F.least(n - 2, F.lit(6)))
    m = F.when(n <= 1, 0).when(n <= 3, 1).otherwise(2)
    return k.cast("int"), m.cast("int")


def fd_category(target: Column) -> Column:
    t = F.lower(target)
    has = lambda *xs: F.array_contains(F.array(*[t.contains(x) for x in xs]), True)
    return F.when(has("socket:", "sock"), "socket").when(has(".sst", "manifest", "badger"), "badger").when(has("receipt", "event"), "receipt_or_event_store").when(has("/", ".log", ".db"), "regular_file").otherwise("unknown")


def level(ratio: Column) -> Column:
    return F.when(ratio >= 0.90, "critical").when(ratio >= 0.80, "warn").otherwise("ok")


def backoff(base: float, attempt: Column, cap: float) -> Column:
    return F.least(F.lit(base) * F.pow(F.lit(2.0), attempt - 1), F.lit(cap))


def query_has(raw: Column, key: str) -> Column:
    return F.exists(F.split(raw, "&"), lambda p: F.substring_index(p, "=", 1) == key)


def valid_bucket(name: Column) -> Column:
    return name.rlike("^[a-z0-9][a-z0-9.-]{1,61}[a-z0-9]$")


def s3_operation(method: Column, path: Column, raw: Column) -> Column:
    """Operation of an object request: the first rule that holds."""
    key = F.instr(F.btrim(path, F.lit("/")), "/") > 0
    has = lambda k: query_has(raw, k)
    rules = [
        ("GET", path == "/", "ListBuckets"), ("POST", ~key & has("delete"), "DeleteObjects"), ("POST", key & has("uploads"), "CreateMultipartUpload"),
        ("PUT", key & has("uploadId") & has("partNumber"), "UploadPart"), ("POST", key & has("uploadId"), "CompleteMultipartUpload"),
        ("DELETE", key & has("uploadId"), "AbortMultipartUpload"), ("GET", key & has("uploadId"), "ListParts"), ("GET", key, "GetObject"), ("HEAD", key, "HeadObject"),
        ("PUT", key, "PutObject"), ("DELETE", key, "DeleteObject"), ("GET", F.lit(True), "ListBucket"), ("HEAD", F.lit(True), "HeadBucket"),
        ("PUT", F.lit(True), "CreateBucket"), ("DELETE", F.lit(True), "DeleteBucket"),
    ]
    out = F
    for m, cond, name in rules:
        out = out.when((method == m) & cond, name)
    return out.otherwise(method)


def audit_operation(method: Column, has_key: Column, raw: Column, copies: Column) -> Column:
    """Operation of the audit trail. Unlike s3_operation() it looks for names anywhere in the query, and subresources come first."""
    has = lambda k: (raw == k) | raw.startswith(f"{k}&") | raw.contains(f"&{k}") | raw.contains(f"{k}=")
    title = F.when(method.isin("GET", "PUT", "DELETE"), F.initcap(method)).otherwise("Unknown")
    of = lambda names: F.coalesce(*[F.when(method == m, n) for m, n in names.items()])
    bucket_policy = of({"GET": "GetBucketPolicy", "PUT": "PutBucketPolicy", "DELETE": "DeleteBucketPolicy"})
    upload = of({"PUT": "UploadPart", "POST": "CompleteMultipartUpload", "DELETE": "AbortMultipartUpload", "GET": "ListParts"})
    bucket = of({"GET": "ListObjects", "HEAD": "HeadBucket", "PUT": "CreateBucket", "DELETE": "DeleteBucket"})
    key = of({"GET": "GetObject", "HEAD": "HeadObject", "PUT": "PutObject", "DELETE": "DeleteObject", "POST": "PostObject"})
    return F.coalesce(
        F.when((method == "PUT") & has_key & copies, "CopyObject"),
        F.when(has("policy"), bucket_policy),
        F.when(has("versioning"), F.concat(title, F.lit("BucketVersioning"))),
        F.when(has("lifecycle"), F.concat(title, F.lit("BucketLifecycle"))),
        F.when(has("versions"), "ListObjectVersions"),
        F.when((method == "GET") & ~has_key & has("uploads"), "ListMultipartUploads"),
        F.when((method == "POST") & has_key & has("uploads"), "CreateMultipartUpload"),
        F.when(has("uploadId"), upload),
        F.when(~has_key, bucket),
        key,
        F.lit("Unknown"),
    )

"""Queries against plain models over the whole of their inputs, where the SQL of the registry reads a part."""

from collections import Counter, OrderedDict

import pandas as pd
import pytest

import lodeplane.plans as plans
from lodeplane.sources.adapters import Tables

DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def events():
    return pd.read_parquet(f"{DIR}/events.parquet")


def test_caches_see_every_access(spark, events):
    want = {}
    for stream, part in events.sort_values(["ts", "event_id"]).groupby(events.event_id % 4):
        for size in (16, 64, 256):
            cache, hits = OrderedDict(), 0
            for k in part.user_id:
                hits += k in cache
                cache[k] = True
                cache.move_to_end(k)
                if len(cache) > size:
                    cache.popitem(last=False)
            want[stream, size] = (hits, len(part) - hits)
    got = {r["stream"]: r for r in plans.QUERIES["st06"](spark, DIR).collect()}
    assert {(s, n): (got[s][f"hits_{n}"], got[s][f"misses_{n}"]) for s, n in want} == want


def test_every_event_is_sent(spark, events):
    sent = Counter(t for t in events.event_type if t in ("click", "error"))
    assert {r["category"]: (r["sent"], r["dropped"]) for r in plans.QUERIES["snk05"](spark, DIR).collect()} == {t: (n, max(n - 8, 0)) for t, n in sent.items()}


def test_addresses_of_late_requests_are_matched(spark, tmp_path):
    spark.read.parquet(f"{DIR}/events.parquet").where("event_id >= 400 AND event_id < 420").write.parquet(f"{tmp_path}/events.parquet")
    assert plans.QUERIES["fn04"](spark, str(tmp_path)).count() == (20 + 10) * 10


def stale_before(us):
    return us < 1706400000000000


def test_gates_weigh_all_evidence(spark, events):
    e = events.assign(peer=["n" + str(u % 8) for u in events.user_id], us=events.ts.astype("datetime64[us]").astype("int64"))
    at, ready = e.groupby("peer").us.max().to_dict(), (e.event_type != "error").groupby(e.peer).all().to_dict()
    groups = {}
    for r in Tables(spark, DIR).groups.collect():
        groups.setdefault(r["group_id"], []).append(r["peer"])
    want = {}
    for g, peers in groups.items():
        known = [p for p in peers if p in at]
        bad = [p for p in known if not ready[p]], [p for p in known if stale_before(at[p])]
        want[g] = (len(peers) - len(known), len(bad[0]), len(bad[1]), len(known) == len(peers) and not bad[0] and not bad[1])
    assert {r["group_id"]: (r["unknown"], r["missing"], r["stale"], r["allowed"]) for r in plans.QUERIES["agg27"](spark, DIR).collect()} == want


def test_split_brain_counts_all_rows(spark, tmp_path):
    # two nodes with far terms on one day, none of them in a twentieth of the ids
    rows = spark.read.parquet(f"{DIR}/events.parquet").where("event_id % 20 <> 0")
    rows.write.parquet(f"{tmp_path}/events.parquet")
    days = rows.selectExpr("date(ts) AS d").distinct().count()
    assert plans.QUERIES["agg30"](spark, str(tmp_path)).count() == days > 0


def test_probes_of_every_event_count(spark, tmp_path):
    spark.read.parquet(f"{DIR}/events.parquet").where("event_id % 97 <> 0 AND user_id % 8 = 1 AND event_type = 'error'").write.parquet(f"{tmp_path}/events.parquet")
    got = {r["peer"]: r["state"] for r in plans.QUERIES["jon12"](spark, str(tmp_path)).collect()}
    assert got.pop("n1") == "down" and set(got.values()) == {"unknown"}


def test_no_referenced_chunk_is_garbage(spark, tmp_path):
    lines = spark.read.parquet(f"{DIR}/lineitem.parquet").where("l_partkey % 3 = 0 AND concat('m', l_orderkey) >= 'm3'")
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.read.parquet(f"{DIR}/part.parquet").write.parquet(f"{tmp_path}/part.parquet")
    used = {f"k{r['l_partkey'] % 1999}" for r in lines.select("l_partkey").distinct().collect()}
    parts = [r["p_partkey"] for r in spark.read.parquet(f"{DIR}/part.parquet").select("p_partkey").distinct().collect()]
    free = {f"k{p}": p * 60 for p in parts if f"k{p}" not in used}
    assert used and free
    assert {r["chunk"]: r["t_zero"] for r in plans.QUERIES["gc01"](spark, str(tmp_path)).collect()} == {c: t for c, t in free.items() if 120000 - t > 3600}
    assert {r["chunk"]: r["newest"] for r in plans.QUERIES["jon21"](spark, str(tmp_path)).collect()} == free


def test_no_purchased_segment_is_an_orphan(spark, tmp_path):
    rows = spark.read.parquet(f"{DIR}/events.parquet").where("event_id % 5 <> 0 AND (event_type <> 'purchase' OR event_id % 331 < 100)")
    rows.write.parquet(f"{tmp_path}/events.parquet")
    rows = rows.toPandas()
    key, cycle = "s" + (rows.event_id % 331).astype(str), rows.ts.astype("datetime64[us]").astype("int64") // 86400000000
    seen, known = set(zip(cycle, key, strict=True)), set(key[rows.event_type == "purchase"])
    want = {(c, k) for c, k in seen if (c - 1, k) in seen and k not in known}
    assert want and {(r["cycle"], r["key"]) for r in plans.QUERIES["gc04"](spark, str(tmp_path)).collect()} == want

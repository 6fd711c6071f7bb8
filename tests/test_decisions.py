"""Decisions against plain models, and plans that must stay without an exchange."""

import random

import pytest
from pyspark.sql import functions as F

from lodeplane.functions import scalars as fn
from lodeplane.operators import balance, repair
from lodeplane.sources import sinks


def plain_order(nodes, k, m, demoted):
    bad = [n in demoted for n in nodes]
    out, spare = [i for i in range(k) if bad[i]], [i for i in range(k, k + m) if not bad[i]]
    if len(out) > len(spare):
        return list(range(k)), list(range(k, k + m))
    first = sorted({*range(k)} - {*out} | {*spare[: len(out)]})
    return first, sorted({*range(k + m)} - {*first}, key=lambda i: (bad[i], i))


def test_attempt_order(spark):
    rng = random.Random(2)
    cases = [([f"n{rng.randrange(6)}" for _ in range(k + m)], k, m) for k, m in [(1, 0), (2, 1), (4, 2), (6, 2)] for _ in range(40)]
    df = spark.createDataFrame(cases, "nodes array<string>, k int, m int")
    first, later = repair.attempt_order(F.col("nodes"), F.col("k"), F.col("m"), ["n1", "n2"])
    got = [(list(r[0]), list(r[1])) for r in df.select(first, later).collect()]
    assert got == [plain_order(n, k, m, {"n1", "n2"}) for n, k, m in cases]


def test_placement_falls_back_to_all_nodes(spark):
    keys = spark.createDataFrame([(f"k{i}", f"g{i % 3}") for i in range(30)], "key string, group_id string")
    members = spark.createDataFrame([("g0", "a", 5.0), ("g0", "b", 1.0), ("g0", "c", 0.0), ("g1", "a", 5.0), ("g1", "b", 0.0), ("g2", "a", 0.0), ("g2", "b", None)], "group_id string, peer string, w double")
    got = {}
    for r in balance.placement(keys, members, "key", "peer", "w", 2).collect():
        got.setdefault((r["group_id"], r["key"]), set()).add(r["peer"])
    assert len(got) == 30 and all(v == {"a", "b"} for v in got.values())


def test_ranking_of_keys_exchanges_nothing_but_the_nodes(spark):
    keys = spark.range(1000).select(F.col("id").cast("string").alias("key"))
    nodes = spark.createDataFrame([(f"n{i}",) for i in range(8)], "peer string")
    out = balance.rendezvous(keys, nodes, "key", "peer", 2)
    assert out.groupBy("key").count().where("count = 2").count() == 1000
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == plan.count("BroadcastExchange") + plan.count("Exchange SinglePartition") and "Sort " not in plan


def test_receipt_ranges(spark):
    rows = spark.range(1500).select(F.col("id").alias("event_id"), (F.col("id") * 10).alias("us"))
    assert sinks.receipts(rows, 0, 15000, 20000).count() == 100
    assert sinks.receipts(rows, 0, 15000, 20000, 9999).count() == 1000
    assert sinks.receipts(rows, 500, 500, 20000).count() == 0
    for bad in ({"retention": 10}, {"limit": 0}):
        with pytest.raises(ValueError):
            sinks.receipts(rows, 0, 15000, **{"retention": 20000, **bad})


@pytest.mark.parametrize("ip", ["::", "::1", "1::", "2001:db8::ff00:42:8329", "FE80::1", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7::", "::1::", ":::", "1:2:3:4:5:6:7", "g::1", "12345::", "1:2:3:4:5:6:7:8:9", "", "10.0.0.1"])
def test_addresses(spark, ip):
    import ipaddress

    try:
        want = format(int(ipaddress.IPv6Address(ip)), "0128b")
    except ValueError:
        want = None
    assert spark.createDataFrame([(ip,)], "ip string").select(fn.ipv6(F.col("ip"))).first()[0] == want

"""Ordered folds: table cases, and random streams against plain models."""

import random
from collections import OrderedDict

import pytest

from lodeplane.operators import repair
from lodeplane.plans import QUERIES
from lodeplane.streaming import folds, streams

DIR = "/root/testdata/sf0.001"
S = 1_000_000


def story(*types, cause="missing_shard", action="repair"):
    return [{"cid": "c", "type": k, "cause": cause, "action": action, "us": i} for i, k in enumerate(types)]


@pytest.mark.parametrize(
    ("facts", "expected"),
    [
        (story("observed", "diagnosed", "action_started", "verified", "receipt_signed"), ("fixed", "info", "signed")),
        (story("observed", "action_started", "verified"), ("proof_unavailable", "warning", "missing")),
        (story("observed", "verified", cause="corrupt_blob"), ("verifying", "warning", "not_required")),
        (story("observed", "action_failed", cause="corrupt_shard", action="isolate_object"), ("needs_human", "critical", "not_required")),
        (story("verified", "action_failed"), ("blocked", "critical", "not_required")),
        (story("isolated", cause=""), ("isolated", "degraded", "not_required")),
    ],
)
def test_incident(facts, expected):
    (out,) = folds.incident(facts)
    assert (out["state"], out["severity"], out["proof"]) == expected


def reports(*pairs):
    return [{"node": "n", "event_id": i, "us": t * S, "faulty": f} for i, (t, f) in enumerate(pairs)]


def test_degraded_recovers_only_after_a_stable_time():
    out = [r["degraded"] for r in folds.degraded(reports((0, True), (1, False), (20, False), (31, False)))]
    assert out == [True, True, True, False]


def test_degraded_holds_on_the_third_flap():
    out = [*folds.degraded(reports((0, True), (1, False), (2, True), (3, False), (4, True), (5, False), (200, False), (305, False), (340, False)))]
    assert [r["held"] for r in out] == [False, False, False, False, True, True, True, False, False]
    assert out[-1]["degraded"] is False


def test_alerts_are_not_rearmed_by_suppressed_ones():
    rows = [{"node": "n", "event_id": i, "type": "x", "us": t * S} for i, t in enumerate((0, 400, 700, 1200, 1300))]
    assert [r["event_id"] for r in folds.alert_dedup(rows)] == [0, 2, 4]


def test_resource_watch_cuts_the_projection_to_seconds():
    rows = [{"node": "n", "event_id": i, "us": i * 200 * S, "value": 100.0 + 30 * i} for i in range(4)]
    assert [(r["level"], r["why"], r["eta_s"]) for r in folds.resource_watch(rows)] == [("warn", "projected", 1066)]


def test_lru_equals_a_cache(spark):
    rng = random.Random(5)
    data = [(s, i, rng.randrange(12)) for s in range(3) for i in range(150)]
    got = {r["s"]: r for r in folds.lru_distance(spark.createDataFrame(data, "s int, i int, k int"), "k", "i", [3, 7], "s").collect()}
    for s in range(3):
        for size in (3, 7):
            cache, hits = OrderedDict(), 0
            for _, _, k in (x for x in data if x[0] == s):
                hits += k in cache
                cache[k] = True
                cache.move_to_end(k)
                if len(cache) > size:
                    cache.popitem(last=False)
            assert (got[s][f"hits_{size}"], got[s][f"misses_{size}"]) == (hits, 150 - hits)


def test_reference_log_replay_equals_sets(spark):
    rng = random.Random(9)
    log = [(f"k{rng.randrange(4)}", f"m{rng.randrange(3)}", rng.choice(["add", "remove"]), i, i * 10) for i in range(200)]
    refs, zero = {}, {}
    for chunk, m, op, _, t in log:
        own = refs.setdefault(chunk, set())
        if op == "add":
            own.add(m)
            zero.pop(chunk, None)
        elif m in own:
            own.remove(m)
            if not own:
                zero[chunk] = t
    got = {r["chunk"]: (r["refs"], r["t_zero"]) for r in repair.replay_refs(spark.createDataFrame(log, "chunk string, manifest string, op string, seq long, t long")).collect()}
    assert got == {c: (len(s), zero.get(c)) for c, s in refs.items()}


@pytest.mark.parametrize("name", ["st02", "st03", "st04", "st05", "win12"])
def test_stateful_queries_run(spark, name):
    assert QUERIES[name](spark, DIR).count() > 0


def test_session_stream(spark, tmp_path):
    t = 1_700_000_000 * S
    data = [("a", t, "view"), ("a", t + 10 * S, "purchase"), ("a", t + 20 * S, "view"), ("b", t + 5 * S, "view")]
    spark.createDataFrame(data, "cid string, us long, event_type string").coalesce(1).write.parquet(str(tmp_path / "in"))
    events = streams.event_stream(spark, str(tmp_path / "in"), "cid string, us long, event_type string")
    out = streams.drain(streams.sessions(events, "cid", "us", "purchase"), "sessions", str(tmp_path / "cp")).collect()
    assert [(r["cid"], r["first_us"], r["n"], r["closed"]) for r in out if r["closed"]] == [("a", t, 2, True)]

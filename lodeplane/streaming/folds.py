"""Ordered folds over a key's rows, in batch form.

Each fold is a plain function over one key's rows in order; `by_key` runs it inside Spark, where rows of
a key meet in one task because the state depends on all that went before.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

US = 1_000_000


def by_key(rows: DataFrame, key: str, order: list[str], fold: Callable[[list[dict]], Iterable[dict]], schema: str) -> DataFrame:
    names = [x.strip().split(" ")[0] for x in schema.split(",")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([*fold(pdf.sort_values(order).to_dict("records"))], columns=names)

    return rows.groupBy(key).applyInPandas(run, schema)


def alert_dedup(rows: list[dict], quiet_us: int = 600 * US) -> Iterable[dict]:
    """Alerts of one resource that are sent; suppressed ones don't prolong the silence."""
    sent: dict[str, int] = {}
    for r in rows:
        if r["type"] not in sent or r["us"] - sent[r["type"]] >= quiet_us:
            sent[r["type"]] = r["us"]
            yield {"node": r["node"], "event_id": r["event_id"], "type": r["type"], "us": r["us"]}


def degraded(rows: list[dict], stable_us: int = 30 * US, flap_us: int = 300 * US, flaps: int = 3) -> Iterable[dict]:
    """State after each report: faults degrade at once, recovery needs a stable time, flapping holds."""
    on = held = False
    healthy_since, release, moves = None, 0, []
    for r in rows:
        now = r["us"]
        if r["faulty"]:
            if not on or healthy_since is not None:
                moves.append(now)
            moves = [m for m in moves if m > now - flap_us]
            if not held and len(moves) >= flaps:
                held, release = True, now + flap_us
            on, healthy_since = True, None
        elif on:
            healthy_since = now if healthy_since is None else healthy_since
            if held and now > release:
                held = False
            if not held and now - healthy_since >= stable_us:
                on, healthy_since = False, None
        yield {"node": r["node"], "event_id": r["event_id"], "degraded": on, "held": held}


def resource_watch(rows: list[dict], limit: float = 400.0, recovery_us: int = 3600 * US, eta_us: int = 7200 * US, keep: int = 20, min_us: int = 300 * US, min_samples: int = 3) -> Iterable[dict]:
    """Decisions on a resource's use: levels at once, recovery after a quiet time, a warning ahead of a
    projected crossing. The projected time is cut to whole seconds."""
    last, recovering, samples = "ok", None, []
    for r in rows:
        now, used = r["us"], r["value"]
        samples = [*samples, (now, used)][-keep:]
        ratio = used / limit
        level = "critical" if ratio >= 0.9 else "warn" if ratio >= 0.8 else "ok"
        said = None
        if level == "ok" and last != "ok":
            if recovering is None:
                recovering = now
            elif now - recovering >= recovery_us:
                last, said = "ok", ("ok", "recovered", 0)
        elif level != "ok":
            recovering = None
            if level != last:
                last, said = level, (level, level, 0)
        elif len(samples) >= min_samples:
            t0, v0 = samples[0]
            if now - t0 >= min_us and used > v0:
                eta = int((0.8 * limit - used) / ((used - v0) / ((now - t0) / US)))
                if 0 < eta * US <= eta_us:
                    last, said = "warn", ("warn", "projected", eta)
        if said:
            yield {"node": r["node"], "event_id": r["event_id"], "level": said[0], "why": said[1], "eta_s": said[2]}


BADGER = {"badger_open_failed", "badger_preflight_failed", "badger_read_only_admitted", "badger_startup_blocked"}


def incident(rows: list[dict]) -> Iterable[dict]:
    """The state of one incident from its facts in order."""
    first = rows[0]
    state, severity, proof, cause, action = "observed", "warning", "not_required", first["cause"], ""
    verified = signed = False
    for f in rows:
        cause = cause or f["cause"]
        kind = f["type"]
        if kind == "observed":
            state, action = "observed", f["action"] or action
        elif kind == "diagnosed":
            state = "diagnosed"
            if cause in BADGER:
                action = f["action"] or action
        elif kind == "action_started":
            state, action = "acting", f["action"]
        elif kind == "action_failed":
            state, action, severity, proof = "blocked", f["action"], "critical", "not_required"
            if cause in ("corrupt_shard", "corrupt_blob") and action == "isolate_object":
                state = "needs_human"
        elif kind == "verified":
            state, verified = "verifying", True
        elif kind == "receipt_signed":
            state, severity, proof, signed = "fixed", "info", "signed", True
        elif kind == "isolated":
            state, action, severity, proof = "isolated", f["action"], "degraded", "not_required"
        elif kind == "resolved":
            state, severity, proof, action = "fixed", "info", "not_required", f["action"] or action
    if verified and not signed and state != "blocked" and cause == "missing_shard":
        state, severity, proof = "proof_unavailable", "warning", "missing"
    yield {"cid": first["cid"], "state": state, "severity": severity, "proof": proof, "cause": cause, "action": action, "updated": max(f["us"] for f in rows)}


def lru_distance(accesses: DataFrame, key: str, order: str, sizes: list[int], *stream: str) -> DataFrame:
    """hits_<size> and misses_<size> of LRU caches of several sizes over each stream, in one pass: an access
    hits if fewer distinct keys than the size were used since the last use of its own."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        # Fenwick tree over positions; a key counts at its last use only
        keys = pdf.sort_values(order)[key].tolist()
        tree, last, out = [0] * (len(keys) + 1), {}, dict.fromkeys(sizes, 0)

        def add(i: int, v: int) -> None:
            while i <= len(keys):
                tree[i] += v
                i += i & -i

        def upto(i: int) -> int:
            n = 0
            while i:
                n += tree[i]
                i &= i - 1
            return n

        for i, k in enumerate(keys, 1):
            if k in last:
                between = upto(i - 1) - upto(last[k])
                for s in sizes:
                    out[s] += between < s
                add(last[k], -1)
            add(i, 1)
            last[k] = i
        return pd.DataFrame([[*pdf[list(stream)].iloc[0].tolist(), *(x for s in sizes for x in (out[s], len(keys) - out[s]))]], columns=names)

    names = [*stream, *(f"{w}_{s}" for s in sizes for w in ("hits", "misses"))]
    return accesses.groupBy(*stream).applyInPandas(run, ", ".join([f"{s} {accesses.schema[s].dataType.simpleString()}" for s in stream] + [f"{n} long" for n in names[len(stream) :]]))


def cache_state(age_us: Column, ttl_us: int, grace_us: int) -> Column:
    return F.when(age_us.isNull(), "miss").when(age_us <= ttl_us, "fresh").when(age_us <= ttl_us + grace_us, "stale").otherwise("miss")

"""Lifecycles in blocks of every size against a plain walk; tables compose."""

import random
from datetime import datetime, timedelta

import pytest

from tidewater.operators import lifecycle as lc

START = datetime(2024, 1, 1)


def logs():
    rng = random.Random(3)
    rows = []
    for life in range(20):
        at = 0
        for k in range(rng.choice([1, 5, 40, 300])):
            ask = lc.OPEN[at] if rng.random() < 0.5 else rng.choice([*lc.OPEN, *(lc.CLOSED if rng.random() < 0.25 else []), "odd", None])
            at = min(at + (ask == lc.OPEN[at]), 4)
            rows.append((f"l{life}", k * rng.choice([1, 1, 3]) if life == 5 else k, START + timedelta(minutes=k), ask, rng.choice([None, "late"]), rng.choice([None, "hit"])))
    return rows


def walk(rows):
    out, stage = [], "none"
    for _, seq, at, ask, reason, outcome in sorted(rows, key=lambda r: (r[1], r[2], r[3] or "")):
        before = stage
        if ask == stage:
            v = "repeated"
        elif stage == "none":
            v = "applied" if ask == "detected" else "starts_late"
        elif stage in lc.CLOSED:
            v = "already_closed"
        elif ask == "expired" and reason is None:
            v = "no_reason"
        elif ask in lc.CLOSED:
            v = "applied"
        elif ask not in lc.OPEN:
            v = "unknown_stage"
        else:
            v = "applied" if lc.OPEN.index(ask) == lc.OPEN.index(stage) + 1 else "out_of_order"
        stage = ask if v == "applied" else stage
        out.append((seq, at, ask, before, v))
    return out, stage


@pytest.mark.parametrize("block", [1, 7, 10**6])
def test_rows_and_states_equal_the_walk(spark, block):
    rows = logs()
    got = lc.judged(spark.createDataFrame(rows, "lifecycle_id string, seq long, at timestamp, stage string, reason string, outcome string").repartition(4), block)
    found = got.collect()
    states = {r["lifecycle_id"]: r for r in lc.states(got).collect()}
    seen = set()
    for life in {r[0] for r in rows}:
        want, stage = walk([r for r in rows if r[0] == life])
        own = [(r["seq"], r["at"], r["stage"], r["before"], r["verdict"]) for r in found if r["lifecycle_id"] == life]
        assert sorted(own, key=str) == sorted(want, key=str)
        s = states[life]
        done = [w for w in want if w[4] == "applied"]
        assert (s["stage"], s["applied"], s["rejected"]) == (stage, len(done), sum(w[4] not in ("applied", "repeated") for w in want))
        at = {w[2]: w[1] for w in done}
        assert s["lifetime"] == ((at[stage] - at["detected"]).total_seconds() if stage in lc.CLOSED else None)
        assert s["detection_delay"] == ((at["confirmed"] - at["detected"]).total_seconds() if "confirmed" in at else None)
        seen |= {w[4] for w in want}
    assert seen == {"applied", "repeated", "starts_late", "already_closed", "no_reason", "unknown_stage", "out_of_order"}


def test_rejected_rows_name_the_rule(spark):
    rows = [("a", 1, START, "sent", None, None), ("a", 2, START, "detected", None, None), ("a", 3, START, "expired", None, None), ("a", 4, START, "succeeded", None, None), ("a", 5, START, "failed", None, None)]
    got = lc.judged(spark.createDataFrame(rows, "lifecycle_id string, seq long, at timestamp, stage string, reason string, outcome string"), 2)
    assert sorted((r["seq"], r["before"], r["rule"]) for r in lc.rejected(got).collect()) == [(1, "none", "starts_late"), (3, "detected", "no_reason"), (5, "succeeded", "already_closed")]
    assert lc.states(got).first()["outcome"] == "succeeded"
    empty = spark.createDataFrame([], "lifecycle_id string, seq long, at timestamp, stage string, reason string, outcome string")
    assert lc.states(lc.judged(empty)).count() == 0

"""Barrier labels against a plain walk of each entry's bars, over paths that reach every exit."""

import math
import random
import statistics
from datetime import datetime, timedelta

import pytest

from tidewater.operators import labels as m

START = datetime(2024, 1, 1)


def walk(bars, i, sign, events, thin):
    """(reason, price, ts, held, gap, ambiguous, profit, stop) of the entry at bar i; bars: (ts, open, high, low, close)."""
    win = bars[max(0, i - 19) : i + 1]
    lr = [math.log(b[4] / a[4]) for a, b in zip(win, win[1:]) if a[4] > 0 and b[4] > 0]
    vol = max(statistics.pstdev(lr), 0.002) if len(lr) >= 2 else 0.002
    profit, stop, entry = round(2 * vol, 6), round(vol, 6), bars[i][4]
    target, fixed = entry * (1 + sign * profit), entry * (1 - sign * stop)
    beyond = lambda a, b: a >= b if sign > 0 else a <= b
    active, trail, ext = False, fixed, entry
    ahead = bars[i + 1 : i + 11]
    if not ahead:
        return "insufficient_data", entry, bars[i][0], 0, False, False, profit, stop
    for n, (ts, o, h, lo, c) in enumerate(ahead, 1):
        at = trail if active else fixed
        name = "trailing_stop" if active else "stop"
        far, near = (h, lo) if sign > 0 else (lo, h)
        if beyond(o, target) and beyond(at, o):
            return "stop", o, ts, n, True, True, profit, stop
        if beyond(o, target):
            return "profit_target", target, ts, n, True, False, profit, stop
        if beyond(at, o):
            return name, at, ts, n, True, False, profit, stop
        if beyond(far, target) and beyond(at, near):
            return "stop", at, ts, n, False, True, profit, stop
        if beyond(far, target):
            return "profit_target", target, ts, n, False, False, profit, stop
        if beyond(at, near):
            return name, at, ts, n, False, False, profit, stop
        day = (ts + timedelta(minutes=330)).date()
        if day in events or day in thin:
            return "event_barrier" if day in events else "liquidity_barrier", c, ts, n, False, False, profit, stop
        ext = max(ext, far) if sign > 0 else min(ext, far)
        active = active or sign * (ext - entry) / entry >= 0.5 * profit
        if active:
            new = ext * (1 - sign * 0.4 * profit)
            trail = max(trail, new) if sign > 0 else min(trail, new)
    return "max_holding_time" if len(ahead) == 10 else "insufficient_data", ahead[-1][4], ahead[-1][0], len(ahead), False, False, profit, stop


@pytest.fixture(scope="module")
def data():
    rng = random.Random(17)
    out = {}
    for s, noise, gaps in (("calm", 0.02, 0.0), ("gappy", 0.02, 0.03), ("wide", 0.015, 0.01)):
        bars, c = [], 100.0
        for k in range(260):
            o = c * math.exp(rng.gauss(0, gaps))
            c = o * math.exp(rng.gauss(0, noise * (0.1 if k % 60 > 45 else 1)))
            spread = rng.random() * (0.05 if s == "wide" else 0.004)
            bars.append((START + timedelta(hours=7 * k), o, max(o, c) * (1 + spread), min(o, c) * (1 - spread), c))
        out[s] = bars
    return out


def test_labels_equal_the_walk(spark, data):
    events = {(START + timedelta(days=d)).date() for d in range(0, 76, 9)}
    thin = {"calm": {(START + timedelta(days=d)).date() for d in range(4, 76, 7)}, "wide": set(), "gappy": set()}
    candles = spark.createDataFrame([(s, *b, 1) for s, bars in data.items() for b in bars], "symbol string, ts timestamp, open double, high double, low double, close double, volume long").repartition(3)
    days = spark.createDataFrame([(d,) for d in events for _ in range(2)], "day date")
    got = m.labelled(candles, days, spark.createDataFrame([(s, d) for s, own in thin.items() for d in own], "symbol string, day date")).collect()
    assert len(got) == 2 * 3 * 260
    rows = {(r["symbol"], r["ts"], r["direction"]): r for r in got}
    reasons, kinds = set(), set()
    for s, bars in data.items():
        for i in range(len(bars)):
            for name, sign in (("long", 1), ("short", -1)):
                reason, price, ts, held, gap, both, profit, stop = walk(bars, i, sign, events, thin[s])
                r = rows[s, bars[i][0], name]
                ret = sign * (price - bars[i][4]) / bars[i][4] * 100
                assert (r["exit_reason"], r["exit_ts"], r["bars_held"], r["gap"], r["ambiguous"]) == (reason, ts, held, gap, both)
                assert (r["exit_price"], r["exit_return_pct"], r["profit_target_pct"], r["stop_pct"]) == pytest.approx((price, ret, profit, stop), abs=1e-4)
                label = {"profit_target": "win", "stop": "loss", "max_holding_time": "timeout", "insufficient_data": "timeout"}.get(reason) or ("partial_success" if r["exit_return_pct"] > 0 else "loss")
                quality = 0.1 if reason == "insufficient_data" else 1 - 0.3 * gap - 0.4 * both - 0.2 * (reason == "max_holding_time")
                assert r["label"] == label and r["label_quality"] == pytest.approx(quality)
                reasons.add(reason)
                kinds.add((gap, both, label))
    assert reasons == {"stop", "trailing_stop", "profit_target", "event_barrier", "liquidity_barrier", "max_holding_time", "insufficient_data"}
    assert {(True, False, "win"), (True, False, "loss"), (False, True, "loss"), (False, False, "partial_success")} <= kinds


def test_one_exchange_and_no_python(spark, data):
    candles = spark.createDataFrame([("s", *b) for b in data["calm"][:3]], "symbol string, ts timestamp, open double, high double, low double, close double")
    out = m.labelled(candles, spark.createDataFrame([], "day date"), spark.createDataFrame([], "symbol string, day date"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(symbol") == 1 and "Python" not in plan and "Arrow" not in plan
    assert out.count() == 6 and m.labelled(candles.limit(0), spark.createDataFrame([], "day date"), spark.createDataFrame([], "symbol string, day date")).count() == 0

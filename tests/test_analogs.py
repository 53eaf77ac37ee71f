"""Analogs against a plain walk over every past state: rankings, alignments, outcomes and the assessment."""

import math
import random
import statistics
from datetime import datetime, timedelta

import numpy as np
import pytest

from tidewater.operators import analogs as a


def dtw(p, q):
    d = [[math.inf] * (len(q) + 1) for _ in range(len(p) + 1)]
    d[0][0] = 0.0
    for i in range(1, len(p) + 1):
        for j in range(1, len(q) + 1):
            d[i][j] = math.dist(p[i - 1], q[j - 1]) + min(d[i - 1][j], d[i][j - 1], d[i - 1][j - 1])
    return d[-1][-1]


def outcome(returns):
    path = [1.0]
    for r in returns:
        path.append(path[-1] * (1 + r))
    high = low = 1.0
    drop = rise = 0.0
    for v in path[1:]:
        high, low = max(high, v), min(low, v)
        drop, rise = min(drop, v / high - 1), max(rise, v / low - 1)
    return path[-1] - 1, statistics.pstdev(returns), drop, rise


def walk(rows):
    """rows of one symbol in time order: (ts, sr, state or None)."""
    ret = [(ts, sr, v) for ts, sr, v in rows if sr is not None]
    states = [(ts, v, k) for k, (ts, _, v) in enumerate(ret) if v is not None]
    if not states:
        return None
    now = states[-1][1]
    past = []
    for i, (ts, v, k) in enumerate(states[:-1]):
        ahead = [r for _, r, _ in ret[k + 1 : k + 21]]
        if len(ahead) == 20:
            nv, nn = math.hypot(*v), math.hypot(*now)
            cos = max(-1, min(1, sum(x * y for x, y in zip(v, now)) / (nv * nn))) if nv and nn else None
            past.append((i, ts, cos, math.dist(v, now), outcome(ahead)))
    cos = sorted((p for p in past if p[2] is not None), key=lambda p: -p[2])
    euc = sorted(past, key=lambda p: p[3])
    pre = {p[0] for p in cos[:100]} | {p[0] for p in euc[:100]}
    path = lambda i: [v for _, v, _ in states[i - 9 : i + 1]]
    warped = sorted(((dtw(path(len(states) - 1), path(i)), i) for i in pre if i >= 9)) if len(states) >= 10 else []
    return cos, euc, warped, len(past)


@pytest.fixture(scope="module")
def data():
    rng = random.Random(21)
    out = {}
    for s, n in (("long", 330), ("short", 45), ("young", 12)):
        v = [0.0] * 7
        rows = []
        for k in range(n):
            v = [0.8 * x + rng.gauss(0, 1) for x in v]
            state = None if rng.random() < 0.05 else [0.0] * 7 if k == 20 else [round(x, 6) for x in v]
            rows.append((datetime(2024, 1, 1) + timedelta(hours=k), None if rng.random() < 0.04 else rng.gauss(0, 0.02), state))
        out[s] = rows
    return out


@pytest.fixture(scope="module")
def got(spark, data):
    rows = [(s, ts, sr, *(v or [None] * 7)) for s, r in data.items() for ts, sr, v in r]
    frame = spark.createDataFrame(rows, "symbol string, ts timestamp, sr double, " + ", ".join(f"{k} double" for k in a.STATE)).repartition(3)
    return a.analogs(frame)


def test_rankings_and_outcomes(data, got):
    ranked = got[0].collect()
    for s, rows in data.items():
        cos, euc, warped, n = walk(rows)
        own = [r for r in ranked if r["symbol"] == s]
        by = lambda k, m: [r["ts"] for r in sorted((r for r in own if r[k] and r[k] <= m), key=lambda r: r[k])]
        assert by("cosine_rank", 100) == [p[1] for p in cos[:100]] and by("distance_rank", 100) == [p[1] for p in euc[:100]]
        dtws = sorted((r["dtw_rank"], r["dtw"], r["i"] - 1) for r in own if r["dtw"] is not None)
        assert [(i, pytest.approx(d)) for _, d, i in dtws] == [(i, d) for d, i in warped[:20]]
        at = {p[1]: p[4] for p in cos}
        assert all(r["n"] == n and tuple(r["outcome"]) == pytest.approx(at[r["ts"]]) for r in own if r["cosine_rank"])
    assert len(ranked) <= 3 * 200


def test_assessment(data, got):
    rows = {r["symbol"]: r for r in a.assessed(*got).collect()}
    assert (rows["young"]["score"], rows["young"]["confidence"], rows["young"]["mixed"], rows["young"]["analogs"], rows["young"]["win_rate"]) == (50.0, 0.1, 1.0, 0, None)
    for s in ("long", "short"):
        cos, euc, warped, n = walk(data[s])
        top = [(p[1], round(p[2], 4), *[round(x, 4) for x in p[4]]) for p in cos[:20]]
        win = sum(t[2] > 0 for t in top) / len(top)
        gain, like = statistics.fmean(t[2] for t in top), statistics.fmean(t[1] for t in top)
        dates = {t[0] for t in top}
        agree = len(dates & {p[1] for p in euc[:20]}) / len(top)
        if warped:
            ids = {p[0]: p[1] for p in cos}
            agree = (agree + len(dates & {ids.get(i) for _, i in warped[:20]}) / len(top)) / 2
        r = rows[s]
        assert r["dtw_used"] == bool(warped) and r["analogs"] == len(top)
        assert (r["win_rate"], r["mean_return"], r["method_agreement"]) == pytest.approx((round(win, 4), round(gain, 4), round(agree, 4)), abs=1e-4)
        assert r["score"] == pytest.approx(50 + 50 * math.tanh(gain / 0.05))
        assert r["confidence"] == pytest.approx(min(1, 0.15 + 0.35 * min(1, (like + 1) / 2) + 0.25 * agree + 0.25 * min(1, n / 100)))
        tilt = min(1, abs(win - 0.5) * 2.5)
        assert (r["bullish"], r["bearish"], r["mixed"]) == pytest.approx((tilt if win > 0.5 else 0, tilt if win < 0.5 else 0, 1 - tilt))


def test_bound_prunes_and_keeps_the_best():
    rng = np.random.default_rng(0)
    now = rng.normal(size=(10, 7))
    paths = now + rng.normal(size=(200, 10, 7)) * np.linspace(0.01, 5, 200)[:, None, None]
    k, d = a.align(now, paths, 5, batch=16)
    want = sorted((dtw(now.tolist(), p.tolist()), i) for i, p in enumerate(paths))[:5]
    assert [(i, pytest.approx(x)) for i, x in zip(k, d)] == [(i, x) for x, i in want]


def test_similarity_mirrors_a_short(spark):
    rows = spark.createDataFrame([("s", 1, 0.1, -0.05, 0.2), ("s", 2, -0.3, -0.4, 0.1)], "symbol string, rank int, subsequent_return double, max_drawdown double, max_runup double")
    sides = spark.createDataFrame([("s", "long"), ("s", "short"), ("t", "long")], "symbol string, direction string")
    out = {(r["symbol"], r["direction"]): r for r in a.similarity(rows, sides).collect()}
    assert (out["s", "long"]["average_return"], out["s", "long"]["worst_drawdown"], out["s", "long"]["best_runup"]) == (-0.1, -0.4, 0.2)
    assert (out["s", "short"]["average_return"], out["s", "short"]["worst_drawdown"], out["s", "short"]["best_runup"], out["s", "short"]["win_rate"]) == (0.1, -0.2, 0.4, 0.5)
    assert out["t", "long"]["analogs"] == 0 and out["t", "long"]["win_rate"] is None

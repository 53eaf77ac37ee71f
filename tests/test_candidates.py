"""The way from components to priority against a plain walk, on rows with and without readings."""

import math
import random
import statistics

import pytest

from tidewater.operators import candidates as c
from tidewater.plans.dialect import CATALOG


def clamp(x, low=0.0, high=1.0):
    return max(low, min(high, x))


def walk_row(r):
    sure = lambda k: r[k] or 0.0
    over = lambda k, least: r[k] is not None and r[k] > least
    fired = []
    if over("breakout_prob", 0.65):
        fired.append(("significant_breakout_probability", sure("structure_conf"), 240))
    if over("sweep", 0.5):
        fired.append(("liquidity_sweep_detected", sure("structure_conf"), 120))
    if r["trend_alert"] == 1:
        fired.append(("structural_trend_change", sure("trend_change_conf"), 1440))
    if r["structure_alert"] == 1:
        fired.append(("regime_transition", sure("structure_change_conf"), 1440))
    fired += [(f"institutional_{k}", sure("flow_conf"), 4320) for k in ("accumulation", "distribution") if over(k, 0.5)]
    if over("leadership", 85):
        fired.append(("exceptional_relative_strength", sure("relative_conf"), 2880))
    if over("expansion", 0.5):
        fired.append(("high_volatility_expansion", sure("volatility_conf"), 180))
    if over("event_score", 40):
        fired.append(("event_driven_opportunity", sure("event_conf"), min(r["hours_to_event"] * 60, 2880) if over("hours_to_event", 0) else 240))
    pairs = [(r[a], r[b]) for a, b in (("trend_direction", "trend_conf"), ("bias", "structure_conf"), ("net_flow", "flow_conf"), ("relative_trend", "relative_conf"))]
    pairs = [p for p in pairs if None not in p]
    weight = sum(w for _, w in pairs)
    lean = sum(v * w for v, w in pairs) / weight if weight else None
    direction = "neutral" if lean is None or abs(lean) <= 0.05 else "long" if lean > 0 else "short"
    reads = [
        ("market_confidence", "market_confidence_conf", lambda x: x / 100), ("liquidity_score", "liquidity_conf", lambda x: x / 100), ("event_score", "event_conf", lambda x: 1 - x / 100),
        ("transition_score", "transition_conf", lambda x: 1 - x / 100), ("flow_score", "flow_conf", lambda x: abs(x - 50) / 50), ("volatility_score", "volatility_conf", lambda x: 1 - x / 100),
    ]
    dims = [(clamp(f(r[a])), r[b]) for a, b, f in reads if r[a] is not None and r[b] is not None]
    total = sum(w for _, w in dims)
    quality = sum(q * w for q, w in dims) / total if total else None
    by = 1 if quality is None else quality
    context = None if r["probability"] is None else 0.5 + (r["probability"] - 0.5) * by
    side = lambda k: None if r[k] is None else 100 - r[k] if direction == "short" else r[k]
    pct = lambda x: None if x is None else 100 * x
    evidence = [
        (0.35, pct(r["probability"]), r["calibration_conf"]), (0.2, pct(context), None if r["calibration_conf"] is None else r["calibration_conf"] * by), (0.1, pct(r["win_rate"]), r["mean_similarity"]),
        (0.1, side("flow_score"), r["flow_conf"]), (0.1, side("structure_score"), r["structure_conf"]), (0.05, r["liquidity_score"], r["liquidity_conf"]), (0.05, side("relative_score"), r["relative_conf"]),
        (0.05, pct(r["agreement_pct"]), r["model_conf"]), (0.1, side("options_score"), r["options_conf"]),
    ]
    evidence = [(w, s, k or 0.0) for w, s, k in evidence if s is not None]
    total = sum(w for w, _, _ in evidence)
    conviction = sum(w * s for w, s, _ in evidence) / total if total else 50.0
    trust = sum(w * k for w, _, k in evidence) / total if total else 0.0
    low = lambda k, least: r[k] is None or r[k] < least
    fails = {
        "liquidity": low("liquidity_score", 30), "spread": r["spread_pct"] is None or r["spread_pct"] > 0.5, "event_risk": r["event_score"] is None or r["event_score"] > 70 or r["frozen"] == 1,
        "model_agreement": low("agreement_pct", 0.8), "feature_quality": low("feature_quality", 0.5), "market_confidence": low("market_confidence", 35), "analog_reliability": low("mean_similarity", 0.5),
    }
    priority, lifetime = sum(w for _, w, _ in fired), min((t for *_, t in fired), default=240)
    factors = [conviction, 100 * math.tanh(priority / 2), r["liquidity_score"], min(100, 100 * lifetime / 1440), None if r["var95"] is None else clamp(100 - 20 * r["var95"], 0, 100), r["leadership"]]
    factors += [pct(r["mean_similarity"]), None if r["average_return"] is None else 50 + 50 * math.tanh(r["average_return"] / 0.05)]
    known = [f for f in factors if f is not None]
    return dict(fired=[k for k, *_ in fired], priority=priority, lifetime=lifetime, lean=lean, direction=direction, quality=quality, conviction=conviction, trust=trust, complete=len(evidence) / 9,
                reasons="".join(f"{k};" for k, bad in fails.items() if bad), rank=sum(known) / len(known))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    scale = {"sweep": 1, "leadership": 100, "event_score": 90, "liquidity_score": 100, "market_confidence": 100, "flow_score": 100, "structure_score": 100, "relative_score": 100, "options_score": 100, "transition_score": 100, "volatility_score": 100, "hours_to_event": 80, "var95": 6}
    out = []
    for k in range(240):
        r = {"symbol": f"s{k % 6}", "ts": k // 6}
        for name in c.READINGS:
            gone = rng.random() < (0.0 if k % 3 else 0.3)
            v = float(rng.random() < 0.3) if name.endswith("alert") or name == "frozen" else rng.uniform(-1, 1) if name in ("trend_direction", "bias", "net_flow", "relative_trend") else rng.random() ** (0.3 if k % 4 == 0 and name in ("agreement_pct", "mean_similarity") else 1) * scale.get(name, 1)
            r[name] = None if gone or k == 239 else v
        if k % 8 == 1:
            r |= {"liquidity_score": 80.0, "spread_pct": 0.2, "event_score": 50.0, "frozen": 0.0, "agreement_pct": 1.0, "feature_quality": 0.9, "market_confidence": 60.0, "mean_similarity": 0.7}
        out.append(r)
    return out


@pytest.fixture(scope="module")
def got(spark, rows):
    df = spark.createDataFrame(rows, "symbol string, ts int, " + ", ".join(f"{k} double" for k in c.READINGS)).cache()
    return lambda name: CATALOG[name].apply(spark, components=df).collect()


def near(a, b):
    return a is b if a is None or b is None else a == pytest.approx(b, abs=2e-6)


def test_triggers_direction_lifetime_and_context(rows, got):
    want = {(r["symbol"], r["ts"]): walk_row(r) for r in rows}
    fired = {}
    for r in got("z01_triggers"):
        fired.setdefault((r["symbol"], r["ts"]), []).append(r["trigger"])
    assert {k: sorted(v) for k, v in fired.items()} == {k: sorted(w["fired"]) for k, w in want.items() if w["fired"]}
    assert len({t for v in fired.values() for t in v}) == 9
    assert all(near(r["priority"], want[r["symbol"], r["ts"]]["priority"]) for r in got("z02_priority_score"))
    assert all(near(r["minutes"], want[r["symbol"], r["ts"]]["lifetime"]) for r in got("z05_lifetime"))
    for r in got("z04_direction"):
        assert near(r["signal"], want[r["symbol"], r["ts"]]["lean"]) and r["direction"] == want[r["symbol"], r["ts"]]["direction"]
    assert all(near(r["quality"], want[r["symbol"], r["ts"]]["quality"]) for r in got("z09_context_quality"))


def test_conviction_with_its_history(rows, got):
    past = {}
    want = {}
    for r in rows:
        w = walk_row(r)
        series = [*past.get((r["symbol"], w["direction"]), [])[-20:], w["conviction"]]
        past.setdefault((r["symbol"], w["direction"]), []).append(w["conviction"])
        slope = statistics.linear_regression(range(len(series)), series).slope if len(series) > 1 else 0.0
        want[r["symbol"], r["ts"]] = (w, slope, clamp(1 - statistics.pstdev(series) / 25), clamp(0.4 * w["complete"] + 0.3 * w["trust"] + 0.3 * clamp((len(series) - 1) / 5)))
    grades = set()
    for r in got("z10_conviction"):
        w, slope, steady, sure = want[r["symbol"], r["ts"]]
        assert near(r["conviction"], w["conviction"]) and near(r["stability"], steady) and near(r["completeness"], w["complete"]) and near(r["confidence"], sure)
        assert r["trend"] == ("improving" if slope > 1 else "declining" if slope < -1 else "stable")
        assert r["grade"] == next((g for t, g in ((80, "A"), (65, "B"), (50, "C"), (35, "D")) if w["conviction"] >= t), "F")
        grades.add(r["grade"])
    assert len(grades) >= 3


def test_gates_and_priority(rows, got):
    want = {(r["symbol"], r["ts"]): walk_row(r) for r in rows}
    assert {(r["symbol"], r["ts"]): r["reasons"] for r in got("z11_qualification")} == {k: w["reasons"] for k, w in want.items()}
    assert sum(not w["reasons"] for w in want.values()) > 10
    assert all(near(r["priority"], want[r["symbol"], r["ts"]]["rank"]) for r in got("h69_priority_mean"))


def test_market_confidence_with_its_terms(spark):
    rng = random.Random(27)
    rows = [(s, k, *[None if rng.random() < 0.25 or k == 9 else rng.random() for _ in c.SIX]) for s in "ab" for k in range(45)]
    df = spark.createDataFrame(rows, "symbol string, ts int, " + ", ".join(f"{k} double" for k in c.SIX))
    got = {(r["symbol"], r["ts"]): r for r in CATALOG["n27_confidence_terms"].apply(spark, inputs=df).collect()}
    seen = set()
    for s in "ab":
        past = []
        for _, k, *x in (r for r in rows if r[0] == s):
            here = [v for v in x if v is not None]
            score = 100 * sum(here) / len(here) if here else 50.0
            series = [*past[-20:], score]
            slope = statistics.linear_regression(range(len(series)), series).slope if len(series) > 1 else 0.0
            w = [max(0.0, 1 - abs(score / 100 - a) / 0.4) for a in (0, 0.5, 1)]
            r = got[s, k]
            assert near(r["score"], score) and near(r["trend_slope"], slope) and near(r["completeness"], len(here) / 6)
            assert near(r["confidence"], clamp(0.6 * len(here) / 6 + 0.4 * clamp((len(series) - 1) / 5)))
            assert r["grade"] == next((g for t, g in ((80, "A"), (65, "B"), (50, "C"), (35, "D")) if score >= t), "F") and r["trend"] == ("improving" if slope > 1 else "declining" if slope < -1 else "stable")
            assert all(near(r[n], v / sum(w) if sum(w) else 1 / 3) for n, v in zip(("s_low", "s_moderate", "s_high"), w))
            past.append(score)
            seen.add((r["grade"], r["trend"]))
    assert len(seen) > 5

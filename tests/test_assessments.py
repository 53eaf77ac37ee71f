"""Assessments against plain Python walks of their definitions, on rows with and without missing readings."""

import math
import random
from statistics import pstdev

import pytest
from pyspark.sql import Row

from tidewater.operators import assessments as A


def clamp(x, low=0.0, high=1.0):
    return float(max(low, min(high, x)))


def mean(xs):
    xs = [x for x in xs if x is not None]
    return sum(xs) / len(xs) if xs else None


def shares(evidence):
    total = sum(max(0.0, e) for e in evidence)
    return [max(0.0, e) / total if total > 0 else 1 / len(evidence) for e in evidence]


def near(level, anchors, band):
    return [max(0.0, 1 - abs(level - a) / band) for a in anchors.values()]


def sign(x):
    return (x > 0) - (x < 0)


def rows_of(names, n, scale=1.0, seed=5, **keys):
    """Rows with ever more missing values; the last has none at all."""
    rng = random.Random(seed)
    return [dict(**{k: f(i) for k, f in keys.items()}, **{c: None if i == n - 1 or rng.random() < i / n else rng.gauss(0, scale) for c in names}) for i in range(n)]


def frame(spark, rows, keys):
    return spark.createDataFrame([Row(**r) for r in rows], ", ".join(f"{c} {keys.get(c, 'double')}" for c in rows[0]))


def check(got, rows, key, walk):
    got = {r[key]: r for r in got.collect()}
    assert len(got) == len(rows)
    for r in rows:
        have = [v for k, v in got[r[key]].asDict().items() if isinstance(v, float)]
        want = [w for w in walk(r) if w is not None]
        assert have == pytest.approx(want, abs=2e-6), r


def blended(f, daily):
    if f["move"] is None:
        return daily, 0.0
    today = math.tanh(f["move"] / 2)
    return 0.7 * daily + 0.3 * today, max(0.0, -today * sign(daily))


def test_structure(spark):
    names = ["bias", "trend", "breakout_prob", "sweep_prob", "choch", "move", "drawdown"]
    rows = rows_of(names, 40, symbol=lambda i: f"s{i}", ts=lambda i: i)
    for r in rows:
        r["trend"] = r["trend"] and float(round(r["trend"]))
        r["choch"] = r["choch"] and float(round(r["choch"]))
        r["sweep_prob"] = r["sweep_prob"] and abs(math.tanh(r["sweep_prob"]))

    def walk(f):
        level, conflict = blended(f, clamp(f["bias"], -1, 1) if f["bias"] is not None else 0.0)
        on = 1.0 if f["trend"] not in (None, 0.0) else 0.0
        there = sum(f[k] is not None for k in ("bias", "trend", "breakout_prob", "sweep_prob")) / 4
        sure = clamp(0.2 + 0.6 * there - (0.15 if f["choch"] not in (None, 0.0) else 0) - 0.3 * conflict)
        up, down = max(level, 0), max(-level, 0)
        ev = [up * on, down * on, up * (1 - on), down * (1 - on), (1 - abs(level)) * (1 - on), 0.5 * (f["sweep_prob"] or 0)]
        return [level, clamp(50 + 50 * level, 0, 100), sure, clamp(f["drawdown"] / 1.5) if f["drawdown"] is not None else None, *shares(ev)]

    check(A.structure(frame(spark, rows, {"symbol": "string", "ts": "int"})), rows, "symbol", walk)


def test_relative_strength(spark):
    names = [f"{r}_{k}_{w}" for r in A.REFERENCES for k in ("strength", "momentum") for w in A.WINDOWS]
    names += [f"{k}_{w}" for k in ("outperformance", "rank") for w in A.WINDOWS] + ["own_move", "nifty_move", "sensex_move"]
    rows = rows_of(names, 30, scale=3.0, symbol=lambda i: f"s{i}", ts=lambda i: i)

    def walk(f):
        each = lambda name: mean(f[f"{name}_{w}"] for w in A.WINDOWS)
        sig = [math.tanh(x / 5) for r in A.REFERENCES if (x := each(f"{r}_strength")) is not None]
        daily = clamp(mean(sig) or 0.0, -1, 1)
        moves = [math.tanh((f["own_move"] - f[f"{r}_move"]) / 2) for r in A.TODAY_REFERENCES if f["own_move"] is not None and f[f"{r}_move"] is not None]
        today = mean(moves)
        level = daily if today is None else clamp(0.75 * daily + 0.25 * today, -1, 1)
        gain = mean([math.tanh(x) for r in A.REFERENCES if (x := each(f"{r}_momentum")) is not None]) or 0.0
        same = sum(sign(s) == sign(level) for s in sig) / len(sig) if sig and level else 0.0
        beat = each("outperformance")
        score = clamp((clamp(50 + 50 * level, 0, 100) if beat is None else beat) or 50.0, 0, 100)
        conflict = max(0.0, -today * sign(daily)) if today is not None else 0.0
        sure = clamp(0.2 + 0.3 * len(sig) / 5 + 0.3 * same + (0.2 if beat is not None else 0) - 0.25 * conflict)
        return [level, score, sure, gain, each("rank"), same, *shares([max(level, 0) * same, max(-level, 0) * same, 1 - abs(level), abs(level) * (1 - same)])]

    check(A.relative_strength(frame(spark, rows, {"symbol": "string", "ts": "int"})), rows, "symbol", walk)


def test_sectors(spark):
    names = ["heat", "leadership", "leadership_was", "relative", "momentum", "capital"]
    rng = random.Random(2)
    rows, moments = [], {}
    for day, n in enumerate([7, 5, 4, 1, 2, 14, 3]):
        rotation, part = (None, None) if day == 2 else (rng.random() * 30, rng.random() * 100)
        own = rows_of(names, n, scale=2.0, seed=day, ts=lambda i, d=day: d, sector=lambda i: f"s{i:02d}")
        if day == 1:
            own[0]["heat"] = own[1]["heat"] = 1.0  # a tie goes by name
        moments[day] = own
        rows += [dict(**r, rotation=rotation, participation=part) for r in own]
    got = {r["ts"]: r for r in A.sectors(frame(spark, rows, {"ts": "int", "sector": "string"})).collect()}
    for day, own in moments.items():
        own = [r for r in rows if r["ts"] == day]
        ranked = [r["sector"] for r in sorted((r for r in own if r["heat"] is not None), key=lambda r: (-r["heat"], r["sector"]))]
        k = min(3, len(ranked) // 2)
        assert got[day]["leaders"] == ",".join(ranked[:k]) and got[day]["laggards"] == (",".join(ranked[-k:]) if k else "")
        both = [(r["leadership"], r["leadership_was"]) for r in own if r["leadership"] is not None and r["leadership_was"] is not None]
        changes = sum((a > 0) != (b > 0) or abs(a - b) >= 1 for a, b in both)
        change = changes / len(both) if both else 0.0
        rotation, part = own[0]["rotation"], own[0]["participation"]
        capital = mean(abs(r["capital"]) for r in own if r["capital"] is not None)
        turn = mean([clamp(capital, 0, 100) if capital is not None else None, clamp(rotation * 5, 0, 100) if rotation is not None else None]) or 0.0
        rel, mom = mean(r["relative"] for r in own), mean(r["momentum"] for r in own)
        terms = [(0.4, clamp((part - 50) / 50, -1, 1))] if part is not None else []
        terms += [(0.35, math.tanh(rel / 5))] if rel is not None else []
        terms += [(0.25, math.tanh(mom / 5))] if mom is not None else []
        level = clamp(sum(w * v for w, v in terms) / sum(w for w, _ in terms), -1, 1) if terms else 0.0
        zs = [r["leadership"] for r in own if r["leadership"] is not None]
        sure = clamp(0.2 + 0.3 * len(ranked) / max(len(own), 12) + 0.25 * (clamp(pstdev(zs) / 2) if len(zs) > 1 else 0) + 0.25 * (1 - change if both else 0.5))
        t, b = clamp(turn / 100), clamp(part / 100) if part is not None else 0.5
        want = [level, 50 + 50 * level, sure, turn, mean(r["heat"] for r in own), float(changes), *shares([t * b, t * (1 - b), change, 1 - t])]
        assert [v for v in got[day].asDict().values() if isinstance(v, float)] == pytest.approx([w for w in want if w is not None], abs=2e-6)


def test_options_events_liquidity_flow(spark):
    def weighed(terms):
        terms = [(w, v) for w, v in terms if v is not None]
        return sum(w * v for w, v in terms) / sum(w for w, _ in terms) if terms else 0.0

    opt = rows_of(["dealer", "pcr", "max_pain_distance", "iv_rank"], 30, scale=2.0, chain=lambda i: f"c{i}")
    for r in opt:
        r["iv_rank"] = r["iv_rank"] and clamp(50 + 20 * r["iv_rank"], 0, 100)

    def walk_options(f):
        terms = [(0.4, f["dealer"] is not None and clamp(f["dealer"], -1, 1)), (0.3, f["pcr"] is not None and clamp(1 - f["pcr"], -1, 1)), (0.3, f["max_pain_distance"] is not None and clamp(f["max_pain_distance"] / 10, -1, 1))]
        terms = [(w, None if v is False else v) for w, v in terms]
        level = weighed(terms)
        iv = (f["iv_rank"] / 100 - 0.5) * 2 if f["iv_rank"] is not None else 0.0
        sure = clamp(0.3 + 0.5 * sum(v is not None for _, v in terms) / 3 + (0.2 if f["iv_rank"] is not None else 0))
        return [level, 50 + 50 * level, sure, *shares([level, -level, iv, -iv, 1 - abs(level)])]

    check(A.options(frame(spark, opt, {"chain": "string"})), opt, "chain", walk_options)

    ev = rows_of(["sensitivity", "hours", "expected_vol", "category_impact", "reduction", "frozen", "similarity"], 40, ts=lambda i: i)
    for r in ev:
        r["hours"] = r["hours"] and abs(r["hours"]) * 30
        r["expected_vol"] = r["expected_vol"] and 1 + abs(r["expected_vol"])
        r["frozen"] = None if r["frozen"] is None else float(r["frozen"] > 0)

    def walk_events(f):
        terms = [(0.5, None if f["sensitivity"] is None else clamp(f["sensitivity"])), (0.3, None if f["hours"] is None else clamp(1 - f["hours"] / 48)), (0.2, None if f["expected_vol"] is None else clamp((f["expected_vol"] - 1) / 4))]
        level = weighed(terms)
        e = near(level, A.EVENT_ANCHORS, 0.3)
        if f["frozen"] == 1.0:
            e[3] = max(e[3], 0.8)
        base = 0.7 if f["reduction"] is None else clamp(1 - f["reduction"])
        sure = clamp(base - (0.1 if f["similarity"] is None else 0.15 * (1 - f["similarity"])))
        impact = 100 * f["category_impact"] if f["category_impact"] is not None else 100 * level if any(v is not None for _, v in terms) else None
        return [level, 100 * level, sure, impact, *shares(e)]

    check(A.event_risk(frame(spark, ev, {"ts": "int"})), ev, "ts", walk_events)

    liq = rows_of(["liquidity_score", "spread_pct", "impact_pct", "imbalance", *(f"trend_{w}" for w in A.WINDOWS), "turnover", "delivery_pct", "turnover_z", "delivery_z"], 40, symbol=lambda i: f"s{i}", ts=lambda i: i)
    for r in liq:
        r["liquidity_score"] = r["liquidity_score"] and 50 + 40 * r["liquidity_score"]
        r["imbalance"] = r["imbalance"] and math.tanh(r["imbalance"])

    def walk_liquidity(f):
        score = 50.0 if f["liquidity_score"] is None else clamp(f["liquidity_score"], 0, 100)
        level = score / 100
        risk = mean([None if f["spread_pct"] is None else clamp(f["spread_pct"]), None if f["impact_pct"] is None else clamp(f["impact_pct"] / 0.5)])
        slopes = [f[f"trend_{w}"] for w in A.WINDOWS if f[f"trend_{w}"] is not None]
        churn = clamp((f["turnover_z"] - f["delivery_z"]) / 4) if None not in (f["turnover_z"], f["delivery_z"]) else 0.0
        lean = abs(f["imbalance"] or 0.0)
        stress = clamp(0.45 * clamp((mean(slopes) or 0.0) / -3) + 0.35 * lean + 0.2 * churn)
        steady = 0.0 if not slopes else 1.0 if len({s > 0 for s in slopes}) == 1 else 0.5
        there = sum(f[k] is not None for k in ("liquidity_score", "spread_pct", "imbalance", "impact_pct", "turnover", "delivery_pct")) / 6
        return [level, score, clamp(0.2 + 0.4 * there + 0.2 * steady - 0.15 * stress), 100 * stress, 100 * risk if risk is not None else 100 - score, *shares([*near(level, A.LIQUIDITY_ANCHORS, 0.3), 0.5 * stress, 0.5 * clamp((1 - level) * lean)])]

    check(A.liquidity(frame(spark, liq, {"symbol": "string", "ts": "int"})), liq, "symbol", walk_liquidity)

    flow = rows_of([*A.FLOW_WEIGHTS, "sast", "participation", *(f"{k}_momentum_{w}" for k in ("fii", "dii", "participation") for w in A.WINDOWS)], 40, scale=0.4, segment=lambda i: f"g{i}", ts=lambda i: i)
    for r in flow:
        r["sast"] = r["sast"] and abs(r["sast"])
        r["participation"] = r["participation"] and 50 + 100 * r["participation"]

    def walk_flow(f):
        vs = [f[k] for k in A.FLOW_WEIGHTS if f[k] is not None]
        level = clamp(weighed([(w, f[k]) for k, w in A.FLOW_WEIGHTS.items()]), -1, 1)
        same = (sum((v > 0) == (level > 0) for v in vs) / len(vs) if level else 0.5) if vs else 0.0
        keen = clamp((mean(abs(v) for v in vs) or 0.0) / 0.3)
        there = sum(f[k] is not None for k in A.FLOW_REQUIRED) / 6
        pace = clamp(mean(mean(f[f"{k}_momentum_{w}"] for w in A.WINDOWS) for k in ("fii", "dii", "participation")) or 0.0, -1, 1)
        score = 50 + 50 * level if f["participation"] is None else clamp(f["participation"], 0, 100)
        return [
            level, score, clamp(0.2 + 0.35 * there + 0.3 * same - 0.1 * (f["sast"] or 0)), 100 * (mean(max(v, 0) for v in vs) or 0.0), 100 * (mean(max(-v, 0) for v in vs) or 0.0), pace, same,
            *shares([keen * same * (level > 0), keen * same * (level < 0), 1 - keen, keen * (1 - same)]),
        ]

    check(A.institutional_flow(frame(spark, flow, {"segment": "string", "ts": "int"})), flow, "segment", walk_flow)


def test_macro(spark):
    rng = random.Random(8)
    days = {0: [0.2, -0.1, 0.4], 1: [0.0, 0.0], 2: [None, None], 3: [rng.uniform(-1, 1) for _ in range(9)], 4: [-0.01, -0.02, None]}
    rows = [dict(ts=d, factor=f"f{k}", score=x) for d, xs in days.items() for k, x in enumerate(xs)]
    got = {r["ts"]: r for r in A.macro(frame(spark, rows, {"ts": "int", "factor": "string"})).collect()}
    for d, xs in days.items():
        xs = [x for x in xs if x is not None]
        level = mean(xs) or 0.0
        same = sum(sign(x) == sign(level) for x in xs) / len(xs) if xs and level else 0.0
        keen = clamp((mean(map(abs, xs)) or 0.0) / 0.3)
        sure = clamp(0.2 + 0.3 * len(xs) / 14 + 0.5 * same) if xs else 0.0
        want = [level, 50 + 50 * level, sure, keen, same, len(xs), *shares([keen * same * (level > 0), keen * same * (level < 0), 1 - keen])]
        assert list(got[d])[1:] == pytest.approx(want, abs=2e-6)


def test_composite(spark):
    rng = random.Random(4)
    names = [*A.DIRECTIONAL, *A.MAGNITUDE]
    held = {f"s{k}": {n: (rng.random() * 100, rng.random()) for n in names if rng.random() > k / 8} for k in range(8)}
    held["one"] = {"volatility": (30.0, 0.5)}
    rows = [dict(symbol=s, component=n, score=v, confidence=c) for s, r in held.items() for n, (v, c) in r.items()] + [dict(symbol="one", component="other", score=1.0, confidence=1.0), dict(symbol="one", component="trend", score=None, confidence=1.0)]
    got = {r["symbol"]: r for r in A.composite(frame(spark, rows, {"symbol": "string", "component": "string"})).collect()}
    assert set(got) == {s for s, r in held.items() if r}
    for s, r in held.items():
        if not r:
            continue
        leans = [(r[n][0] - 50) / 50 for n in A.DIRECTIONAL if n in r]
        level = mean(leans) or 0.0
        part = {n: r[n][0] / 100 if n in r else None for n in A.MAGNITUDE}
        calm = mean([None if part["volatility"] is None else 1 - part["volatility"], part["liquidity"], None if part["correlation"] is None else 1 - part["correlation"]])
        risk = mean([part["volatility"], part["event_risk"], part["correlation"]])
        stability = 50.0 if calm is None else 100 * calm
        want = [50 + 50 * level, clamp(0.4 * len(r) / 12 + 0.6 * mean(c for _, c in r.values())), 100 * (mean(max(x, 0) for x in leans) or 0.0), 100 * (mean(max(-x, 0) for x in leans) or 0.0)]
        want += [stability, 50.0 if risk is None else 100 * risk, clamp(abs(level) * stability, 0, 100), len(r), *shares(near((level + 1) / 2, A.COMPOSITE_ANCHORS, 0.3))]
        assert list(got[s])[1:] == pytest.approx(want, abs=2e-6), s


def test_transition(spark):
    rng = random.Random(6)
    states = ["calm", "rough", "wild"]
    held = {f"s{k}": [shares([rng.random() for _ in states]) for _ in range(n)] for k, n in enumerate([1, 2, 3, 10, 19, 20, 25])}
    held["tie"] = [[0.4, 0.4, 0.2]] * 4
    rows = [dict(symbol=s, ts=t, **dict(zip(states, p))) for s, ps in held.items() for t, p in enumerate(ps)]
    got = {r["symbol"]: r for r in A.transition(frame(spark, rows, {"symbol": "string", "ts": "int"}), states).collect()}

    def slope(ys):
        n, mx, my = len(ys), (len(ys) - 1) / 2, sum(ys) / len(ys)
        low = sum((x - mx) ** 2 for x in range(n))
        return sum((x - mx) * (y - my) for x, y in enumerate(ys)) / low if low else 0.0

    for s, ps in held.items():
        r, ps = got[s], ps[-20:]
        if len(ps) < 2:
            assert (r["score"], r["confidence"], r["state"], r["alert"], r["s_stable"]) == (0.0, 0.1, None, 0.0, 1.0)
            continue
        ranked = sorted(range(3), key=lambda k: (-ps[-1][k], k))
        a, b = ranked[:2]
        speed, rising = slope([p[a] for p in ps]), slope([p[b] for p in ps])
        chance = clamp(0.6 * (1 - clamp(ps[-1][a] - ps[-1][b])) + 0.4 * clamp(max(rising, 0) / 0.05))
        loss = clamp(max(ps[0]) - max(ps[-1]))
        level = clamp(0.4 * chance + 0.3 * clamp(abs(speed) / 0.1) + 0.3 * loss)
        assert (r["state"], r["runner_up"]) == (states[a], states[b])
        assert list(r)[4:] == pytest.approx([100 * level, clamp(len(ps) / 10), chance, speed, loss, float(chance >= 0.6), *shares(near(level, A.TRANSITION_ANCHORS, 0.4))], abs=2e-6), s


def test_empty(spark):
    assert A.macro(spark.createDataFrame([], "ts int, factor string, score double")).count() == 0
    assert A.composite(spark.createDataFrame([], "symbol string, component string, score double, confidence double")).count() == 0
    assert A.transition(spark.createDataFrame([], "symbol string, ts int, a double, b double"), ["a", "b"]).count() == 0

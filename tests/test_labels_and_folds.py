import random

import numpy as np
import pandas as pd
import pytest

from tidewater.operators import folds, swings
from tidewater.plans import catalog
from tidewater.plans.dialect import CATALOG
from tests.test_kernels import series

catalog.queries()


def walk(bars, i, vol, horizon=10):
    """The triple barrier, bar by bar."""
    entry = bars[i][3]
    target, stop0, peak = entry * (1 + 2 * vol), entry * (1 - vol), None
    for k in range(1, horizon + 1):
        if i + k >= len(bars):
            return None
        o, h, low, c = bars[i + k]
        stop = max(stop0, peak * (1 - vol)) if peak is not None and peak >= entry * (1 + vol) else stop0
        if o <= stop:
            return "gap_stop", k
        if o >= target:
            return "gap_profit", k
        if low <= stop:
            return "stop", k
        if h >= target:
            return "profit", k
        peak = h if peak is None else max(peak, h)
    return "timeout", horizon


def test_triple_barrier_against_a_walk(spark):
    rng = random.Random(4)
    closes = [100.0]
    for _ in range(150):
        closes.append(closes[-1] * (1 + rng.gauss(0, 0.01)))
    df = series(spark, closes)
    vols = {r["ts"]: round(r["vol"], 6) for r in CATALOG["y01_trailing_volatility"].apply(spark, candles=df).collect()}
    rows = df.orderBy("ts").collect()
    bars = [(r["open"], r["high"], r["low"], r["close"]) for r in rows]
    got = {r["ts"]: (r["outcome"], r["bars"]) for r in CATALOG["y03_triple_barrier"].apply(spark, candles=df).collect()}
    want = {r["ts"]: w for i, r in enumerate(rows) if i >= 19 and (w := walk(bars, i, vols[r["ts"]]))}
    assert got == want


def structure_walk(high, low, close, k=2):
    """The definition, bar by bar: what is known of swings, breaks and gaps once each bar has closed."""
    rows, seen, broken, gaps, last_break = [], {1: [], -1: []}, {1: None, -1: None}, [], None
    runs = {1: 0, -1: 0}
    for i in range(len(close)):
        j = i - k
        for side, x in ((1, high), (-1, low)):
            if j >= k and all(side * x[j] >= side * x[m] for m in range(j - k, j + k + 1)):
                if not seen[side] or abs(x[j] - seen[side][-1]) > 1e-9 * max(abs(x[j]), abs(seen[side][-1])):
                    runs[side] = runs[side] + 1 if seen[side] and side * (x[j] - seen[side][-1]) > 0 else 0
                    seen[side].append(x[j])
                    broken[side] = None
        trend = None
        if min(map(len, seen.values())) >= 2:
            steps = [np.sign(s[-1] - s[-2]) for s in seen.values()]
            trend = float(steps[0]) if steps[0] == steps[1] else 0.0
        bos = 0.0
        for side in (1, -1):
            if not bos and seen[side] and side * (close[i] - seen[side][-1]) > 0 and broken[side] != seen[side][-1]:
                bos, broken[side], last_break = float(side), seen[side][-1], (i, side)
        if i >= 2 and low[i] > high[i - 2]:
            gaps.append(((low[i] + high[i - 2]) / 2, 1))
        elif i >= 2 and high[i] < low[i - 2]:
            gaps.append(((low[i - 2] + high[i]) / 2, -1))
        gaps = [g for g in gaps[-100:] if not low[i] <= g[0] <= high[i]]
        levels = seen[1][-5:] + seen[-1][-5:]
        zone = min(abs(x - close[i]) for x in levels) / close[i] * 100 if levels else None
        bias = breakout = None
        if trend is not None:
            faded = last_break[1] * (1 - (i - last_break[0]) / 10) if last_break and i - last_break[0] <= 10 else 0.0
            bias = max(-1.0, min(1.0, 0.5 * trend + 0.3 * faded + 0.2 * np.tanh((runs[1] - runs[-1]) / 3)))
            near = 1 - min(abs(seen[1][-1] - close[i]) / close[i] * 100, 2.0) / 2
            breakout = max(0.05, min(0.95, 0.5 + 0.3 * bias + 0.2 * near))
        sweep = None if zone is None else max(0.05, min(0.95, 0.15 + 0.7 * (1 - min(zone, 2.0) / 2)))
        choch = bos if trend is not None and trend * bos < 0 else 0.0
        rows.append((seen[1][-1] if seen[1] else None, float(runs[1]) if seen[1] else None, float(runs[-1]) if seen[-1] else None, trend, bos, choch, zone, float(sum(g[1] for g in gaps)), bias, breakout, sweep))
    return rows


@pytest.mark.parametrize("seed, step", [(1, 1.0), (2, 3.0), (3, 0.4), (4, 8.0)])
def test_structure_against_its_definition(seed, step):
    rng = np.random.default_rng(seed)
    close = np.round(np.abs(100 + np.cumsum(rng.normal(0, step, 600))) + 1, 0 if seed == 4 else 2)
    high, low = close + np.round(rng.exponential(step / 3, 600), 1), close - np.round(rng.exponential(step / 3, 600), 1)
    bars = pd.DataFrame({"symbol": "s", "ts": pd.date_range("2024-01-01", periods=600, freq="h"), "high": high, "low": low, "close": close})
    got = swings.structure_of(bars.sample(frac=1, random_state=1))
    names = ["last_high", "hh_run", "ll_run", "trend", "bos", "choch", "zone_pct", "open_gaps", "bias", "breakout_prob", "sweep_prob"]
    want = pd.DataFrame(structure_walk(high, low, close), columns=names).astype(float)
    for c in names:
        assert np.allclose(got[c], want[c], equal_nan=True), c


def test_more_gaps_than_are_kept():
    n = 400
    low = np.arange(n) * 10.0  # each bar leaves an open gap above the one before
    assert swings.open_gaps(low + 1, low).max() == 100.0


def test_value_area_ties_go_up():
    assert swings.value_area(np.array([1, 5, 1, 1])) == (1, 1, 2)
    assert swings.value_area(np.array([10.0])) == (0, 0, 0)
    assert swings.value_area(np.array([0.0, 4, 3, 9, 5, 2])) == (3, 2, 4)


def test_dtw_against_recursion():
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(5, 2)), rng.normal(size=(6, 2))

    def d(i, j):
        if i < 0 and j < 0:
            return 0.0
        if i < 0 or j < 0:
            return float("inf")
        return float(np.linalg.norm(a[i] - b[j])) + min(d(i - 1, j), d(i, j - 1), d(i - 1, j - 1))

    assert folds.dtw(a, b) == pytest.approx(d(4, 5))


def test_novelty_keeps_the_first_of_a_kind(spark):
    rows = [("a", 1, ["x", "y", "z"]), ("a", 2, ["x", "y", "z"]), ("a", 3, ["p", "q"]), ("b", 4, ["x", "y", "z"]), ("a", 5, [])]
    got = {r["id"]: r["kept"] for r in folds.novelty(spark.createDataFrame(rows, "source string, id long, tokens array<string>")).collect()}
    assert got == {1: True, 2: False, 3: True, 4: True, 5: True}


def test_signal_filter():
    s = lambda sym, reason="flow", minute=0, sector=None: {"symbol": sym, "direction": "long", "minute": minute, "reason": reason, "sector": sector}
    kept = folds.filter_signals([s("a", "breakout"), s("a", minute=30), s("b", "Breakout up"), s("c"), s("d"), s("e", sector="x"), s("f", sector="x")], {("a", "c"): 0.9})
    assert [k["symbol"] for k in kept] == ["a", "d", "e"]


def test_feature_choice():
    assert folds.select_features({("a", "b"): 0.99}, {"a": 0.5, "b": 0.9, "c": 0.1}) == ["b", "c"]


def test_novelty_remembers_all_kept_articles_of_all_sources(spark):
    first = [f"w{k}" for k in range(10)]
    rows = [("a", 0, first)] + [("a", i, [f"x{i}", f"y{i}"]) for i in range(1, 601)] + [("a", 601, first), ("b", 602, first[:9] + ["other"]), ("b", 603, first[:5])]
    got = {r["id"]: (round(r["novelty"], 6), r["kept"]) for r in folds.novelty(spark.createDataFrame(rows, "source string, id long, tokens array<string>"), across=True).collect()}
    assert got[601] == (0.0, False) and got[602] == (round(1 - 9 / 11, 6), False) and got[603] == (0.5, True)
    assert all(got[i] == (1.0, True) for i in range(601))


def test_analog_paths_start_at_every_bar(spark):
    rng = np.random.default_rng(3)
    r = rng.normal(0, 0.01, 60)
    r[13:23] = r[-10:]
    close = 100 * np.exp(np.r_[0, np.cumsum(r)])
    bars = pd.DataFrame({"symbol": "a", "ts": pd.date_range("2024-01-01", periods=61, freq="h"), "close": close})
    got = sorted((x["rank"], x["ts"], x["distance"]) for x in folds.analog_paths(spark.createDataFrame(bars)).collect())
    assert got[0][1] == bars["ts"][13] and got[0][2] == pytest.approx(0, abs=1e-9)
    r = np.diff(np.log(close))
    want = sorted((folds.dtw(r[-10:, None], r[s : s + 10, None]), s) for s in range(41))[:20]
    assert [g[2] for g in got] == pytest.approx([w[0] for w in want], abs=1e-9) and [g[1] for g in got] == [bars["ts"][w[1]] for w in want]

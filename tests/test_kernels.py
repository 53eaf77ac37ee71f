"""Rolling kernels against plain Python loops."""

import math
import statistics

import pytest

from tidewater.plans.dialect import CATALOG
from tidewater.plans import catalog

catalog.queries()


def series(spark, closes, volumes=None):
    rows = [("s", f"2024-01-01 {k // 60:02d}:{k % 60:02d}:00", c - 0.5, c + 1.0, c - 1.0, c, (volumes or [10 + k % 3 for k in range(len(closes))])[k]) for k, c in enumerate(closes)]
    return spark.createDataFrame(rows, "symbol string, t string, open double, high double, low double, close double, volume long").selectExpr("symbol", "CAST(t AS TIMESTAMP) AS ts", "open", "high", "low", "close", "volume")


CLOSES = [100 + 5 * math.sin(k / 3) + (k * 7 % 11) / 5 for k in range(140)]


@pytest.fixture(scope="module")
def candles(spark):
    return series(spark, CLOSES).cache()


def column(spark, name, col, candles, **more):
    return [r[col] for r in CATALOG[name].apply(spark, candles=candles, **more).orderBy("ts").collect()]


def returns():
    return [None] + [b / a - 1 for a, b in zip(CLOSES, CLOSES[1:])]


def close_to(got, want):
    for g, w in zip(got, want, strict=True):
        assert (g is None) == (w is None), (g, w)
        assert g is None or abs(g - w) < 2e-6, (g, w)


def window(xs, i, w):
    return [x for x in xs[max(0, i - w + 1) : i + 1] if x is not None]


def test_zscore(spark, candles):
    r = returns()
    want = []
    for i in range(len(r)):
        x = window(r, i, 50)
        want.append((r[i] - statistics.fmean(x)) / statistics.pstdev(x) if r[i] is not None and len(x) >= 10 else None)
    close_to(column(spark, "k01_rolling_zscore", "z_50", candles), want)


def test_percentile_rank(spark, candles):
    r = returns()[1:]
    want = [sum(x <= v for x in window(r, i, 20)) / len(window(r, i, 20)) if len(window(r, i, 20)) >= 10 else None for i, v in enumerate(r)]
    close_to(column(spark, "k04_percentile_rank", "pr_20", candles), want)


def test_winsorize_uses_prior_bars_only(spark, candles):
    r = returns()[1:]
    want = []
    for i, v in enumerate(r):
        prior = sorted(r[max(0, i - 50) : i])
        n = len(prior)
        want.append(v if n < 10 else min(max(v, prior[math.floor(0.05 * (n - 1))]), prior[math.ceil(0.95 * (n - 1))]))
    close_to(column(spark, "k06_winsorize", "wins_50", candles), want)


def test_slope_and_ema(spark, candles):
    want = []
    for i in range(len(CLOSES)):
        y = CLOSES[i - 19 : i + 1] if i >= 19 else None
        want.append(sum((k - 9.5) * v for k, v in enumerate(y)) / sum((k - 9.5) ** 2 for k in range(20)) if y else None)
    close_to(column(spark, "k08_rolling_slope", "slope_20", candles), want)
    e = statistics.fmean(CLOSES[:20])
    for c in CLOSES[20:]:
        e += (c - e) * 2 / 21
    assert abs(CATALOG["k13_ema"].apply(spark, candles=candles).first()["ema_20"] - e) < 2e-6


def test_atr_momentum_drawdown(spark, candles):
    tr = [None] + [max(2.0, abs(c + 1 - p), abs(c - 1 - p)) for p, c in zip(CLOSES, CLOSES[1:])]
    close_to(column(spark, "p02_atr", "atr_10", candles), [statistics.fmean(tr[i - 9 : i + 1]) if i >= 10 else None for i in range(len(tr))])
    close_to(column(spark, "p05_momentum", "mom_20", candles), [(CLOSES[i] / CLOSES[i - 20] - 1) * 100 if i >= 20 else None for i in range(len(CLOSES))])
    want = []
    for i in range(len(CLOSES)):
        if i < 20:
            want.append(None)
            continue
        peak = worst = 0.0
        for c in CLOSES[i - 20 : i + 1]:
            peak = max(peak, c)
            worst = max(worst, 1 - c / peak)
        want.append(worst * 100)
    close_to(column(spark, "r04_drawdown", "max_dd_20", candles), want)


def test_var_and_skew(spark, candles):
    r = returns()[1:]
    want = []
    for i in range(len(r)):
        x = sorted(r[i - 49 : i + 1]) if i >= 49 else None
        if x:
            at = 0.05 * 49
            q = x[int(at)] + (at - int(at)) * (x[int(at) + 1] - x[int(at)])
            tail = [v for v in x if v <= q]
            want.append(-statistics.fmean(tail) * 100)
        else:
            want.append(None)
    close_to(column(spark, "r01_var_cvar", "cvar95_50", candles), want)


def test_flat_and_short_series_are_null_not_errors(spark):
    flat = series(spark, [50.0] * 30, [0] * 30)
    for name in ("k01_rolling_zscore", "k02_rolling_minmax", "k03_rolling_robust", "p04_vwap_distance", "v04_volume_stats", "v07_mfi", "r02_sharpe_sortino", "r03_skew_kurtosis"):
        CATALOG[name].apply(spark, candles=flat).collect()
    assert set(column(spark, "k01_rolling_zscore", "z_20", flat)) == {None}
    assert CATALOG["p05_momentum"].apply(spark, candles=flat.limit(0)).count() == 0


def test_one_exchange_serves_all_frames(spark, candles):
    df = CATALOG["w01_volatility"].apply(spark, candles=candles)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1

"""Selection against plain Python over small matrices: alignment, moments, ridge, elimination, ranks."""

import math
import random
import statistics
from collections import Counter
from datetime import datetime, timedelta

import numpy as np
import pytest

from tidewater.operators import selection as s

START = datetime(2024, 1, 1)
NAMES = ["a", "b", "c", "d", "flat", "late", "rare"]


@pytest.fixture(scope="module")
def data():
    rng = random.Random(12)
    bars, series = [], []
    for sym, n in (("x", 120), ("y", 90), ("tiny", 20)):
        for k in range(n):
            ts = START + timedelta(hours=k)
            v = {"a": rng.gauss(0, 1), "b": rng.gauss(3, 2), "flat": 7.0}
            v["c"] = v["a"] + 0.01 * rng.gauss(0, 1)  # nearly a
            v["d"] = rng.gauss(0, 5)
            bars.append((sym, ts, 0.01 * v["a"] - 0.004 * (v["b"] - 3) + 0.01 * rng.gauss(0, 1)))
            for f, x in v.items():
                if f != "b" or rng.random() > 0.1 or k == 0:
                    series.append((sym, ts, f, x))
            if k > 0:
                series.append((sym, ts, "late", rng.random()))
            if k % 2 == 0:
                series.append((sym, ts, "rare", rng.random()))
            series.append((sym, ts + timedelta(minutes=7), "a", 99.0))  # not at a bar
    return bars, series


def plain(bars, series, sym):
    own = sorted((ts, t) for s_, ts, t in bars if s_ == sym)
    if len(own) < s.LEAST_BARS:
        return None
    at = {(f, ts): v for s_, ts, f, v in series if s_ == sym}
    cols = {}
    for f in NAMES:
        col = [at.get((f, ts)) for ts, _ in own]
        if sum(v is not None for v in col) / len(own) >= 0.8 and col[0] is not None:
            for k in range(1, len(col)):
                col[k] = col[k - 1] if col[k] is None else col[k]
            if statistics.pstdev(col) > 1e-9:
                cols[f] = col
    target = [t for _, t in own]
    n = len(own)

    def bins(v, b):
        out = [0] * n
        for place, k in enumerate(sorted(range(n), key=lambda k: v[k])):
            out[k] = min(b - 1, place * b // n)
        return out

    mi = {}
    for f, col in cols.items():
        i, j = bins(col, 5), bins(target, 3)
        both, ni, nj = Counter(zip(i, j)), Counter(i), Counter(j)
        mi[f] = max(0.0, sum(c / n * math.log(c * n / (ni[p] * nj[q])) for (p, q), c in both.items()))
    z = {f: (np.array(c) - np.mean(c)) / np.std(c) for f, c in cols.items()}
    kept = []
    for f in sorted(z, key=lambda f: -mi[f]):
        if all(abs(np.mean(z[f] * z[g])) < 0.95 for g in kept):
            kept.append(f)
    x, t = np.stack([z[f] for f in kept], 1), np.array(target)
    ridge = lambda m: np.linalg.solve(m.T @ m / n + np.eye(m.shape[1]) / n, m.T @ t / n)
    c = ridge(x)
    left, rfe = list(range(len(kept))), [0] * len(kept)
    while left:
        w = min(range(len(left)), key=lambda p: abs(ridge(x[:, left])[p]))
        rfe[left.pop(w)] = len(left)
    rank = lambda v: [sorted(range(len(v)), key=lambda k: -v[k]).index(k) + 1 for k in range(len(v))]
    shap = [abs(c[k]) * np.abs(x[:, k]).mean() for k in range(len(kept))]
    rng = np.random.default_rng(0)
    base = ((t - x @ c) ** 2).mean()
    perm = []
    for k in range(len(kept)):
        costs = []
        for _ in range(400):
            y = x.copy()
            rng.shuffle(y[:, k])
            costs.append(((t - y @ c) ** 2).mean() - base)
        perm.append(np.mean(costs))
    mean = [sum(q) / 4 for q in zip(rank([mi[f] for f in kept]), rank([2 * v * v for v in c]), rank(shap), rfe)]
    return {f: (c[k], mi[f], perm[k], shap[k], rfe[k], mean[k]) for k, f in enumerate(kept)}


def test_selection_equals_the_walk(spark, data):
    bars, series = data
    b = spark.createDataFrame(bars, "symbol string, ts timestamp, target double").repartition(3)
    got = s.selection(b, spark.createDataFrame(series, "symbol string, ts timestamp, feature string, value double").repartition(4), NAMES).collect()
    assert {r["symbol"] for r in got} == {"x", "y"}
    for sym in ("x", "y"):
        want = plain(bars, series, sym)
        own = {r["feature"]: r for r in got if r["symbol"] == sym}
        assert set(own) == set(want) and not {"flat", "late", "rare"} & set(own) and len({"a", "c"} & set(own)) == 1
        for f, (c, mi, perm, shap, rfe, mean) in want.items():
            r = own[f]
            assert (r["coefficient"], r["mutual_information"], r["shap"]) == pytest.approx((c, mi, shap), rel=1e-6, abs=1e-12)
            assert r["rfe_rank"] == rfe and r["composite"] == pytest.approx(mean) and r["recommended"]
            assert r["permutation"] == pytest.approx(perm, rel=0.15, abs=2e-6)  # the mean over all shuffles
        ranks = sorted((r["rank"], r["composite"]) for r in own.values())
        assert [k for k, _ in ranks] == list(range(1, len(own) + 1)) and [m for _, m in ranks] == sorted(m for _, m in ranks)


def test_solve_with_and_without_pivots():
    rng = np.random.default_rng(1)
    a = rng.normal(size=(6, 6))
    a[0, 0] = 0.0
    b = rng.normal(size=6)
    assert np.allclose(s.solve(a, b), np.linalg.solve(a, b))
    assert s.solve(np.array([[2.0, 0.0], [0.0, 0.0]]), np.array([4.0, 3.0])).tolist() == [2.0, 0.0]


def test_sweeping_equals_refitting():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(200, 12)) @ rng.normal(size=(12, 12))
    g, rhs = x.T @ x / 200 + np.eye(12) / 200, rng.normal(size=12)
    left, want = list(range(12)), [0] * 12
    while left:
        w = int(np.abs(np.linalg.solve(g[np.ix_(left, left)], rhs[left])).argmin())
        want[left.pop(w)] = len(left)
    assert s.elimination_ranks(g, rhs).tolist() == want


def test_empty(spark):
    b = spark.createDataFrame([], "symbol string, ts timestamp, target double")
    assert s.selection(b, spark.createDataFrame([], "symbol string, ts timestamp, feature string, value double"), ["a"]).count() == 0

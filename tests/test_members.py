"""Members on a small learnable table; blends, agreement, calibration and attributions against plain Python."""

import math
import random
import statistics
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.operators import members as m
from tidewater.operators.trees import Learner, binned

START = datetime(2024, 1, 1)
FEATURES = ["a", "b", "c"]
SMALL = [Learner("forest", False, trees=5, depth=4, some=True, drawn=True), Learner("random", False, trees=5, depth=4, any_cut=True), Learner("newton", True, trees=3, depth=3, l2=1.0)]


def table(n=260):
    rng = random.Random(5)
    rows = []
    for k in range(n):
        a, b = rng.gauss(0, 1), rng.gauss(5, 2)
        rows.append((rng.choice("xy"), START + timedelta(hours=k // 2), int(a + 0.3 * rng.gauss(0, 1) > 0), None if rng.random() < 0.1 else a, b, None))
    return rows


@pytest.fixture(scope="module")
def fitted(spark):
    rows = table()
    df = spark.createDataFrame(rows, "symbol string, ts timestamp, target int, a double, b double, c double").repartition(3)
    trained, held = m.train(df, FEATURES, SMALL)
    return rows, df, trained, held.collect()


def test_split_means_weights_and_skill(fitted):
    rows, _, trained, held = fitted
    cutoff = sorted(r[1] for r in rows)[round(len(rows) * 0.8) - 1]
    assert {r["ts"] for r in held} == {r[1] for r in rows if r[1] > cutoff} and trained.held_out == len(held) == sum(r[1] > cutoff for r in rows)
    known = [r[3] for r in rows if r[3] is not None]
    assert trained.means == pytest.approx([statistics.fmean(known), statistics.fmean(r[4] for r in rows), 0.0]) and trained.deviations[0] == pytest.approx(statistics.pstdev(known))
    assert [x.name for x in trained.members] == ["forest", "random", "newton", "logistic_regression"]
    for k, x in enumerate(trained.members):
        acc = sum((r["p"][k] > 0.5) == (r["y"] == 1) for r in held) / len(held)
        assert x.accuracy == pytest.approx(acc) and acc > 0.7 and x.weight == pytest.approx(max(acc - 0.5, 0) + 1e-6)


def test_moment_at(spark):
    ts = [START + timedelta(hours=7 * k) for k in range(40)] + [START + timedelta(hours=7)] * 3
    df = spark.createDataFrame([(t,) for t in ts], "ts timestamp")
    assert [m.moment_at(df, k) for k in (1, 2, 5, 6, 20, 43)] == [sorted(ts)[k - 1] for k in (1, 2, 5, 6, 20, 43)]


def test_one_class_trains_nothing(spark):
    df = spark.createDataFrame([(s, t, 1, a, b, c) for s, t, _, a, b, c in table(60)], "symbol string, ts timestamp, target int, a double, b double, c double")
    trained, _ = m.train(df, FEATURES, SMALL)
    p = m.predicted(df.limit(3), trained, ["symbol", "ts"], m.SCHEMA)
    assert trained.members == [] and m.mean_accuracy(trained) is None
    assert {tuple(r)[2:] for r in m.blended(p, trained).collect()} == {(0.5, 0.0, 1.0, 0.0)}
    assert {(r["agreement_pct"], r["level"], r["proceed"]) for r in m.agreement(p, trained).collect()} == {(0.0, "low", False)}
    assert m.attributed(df, trained, ["symbol", "ts"], m.SCHEMA).count() == 0


def test_blend_and_agreement(spark):
    rows = [(k, [random.Random(k * 9 + j).random() for j in range(4)]) for k in range(60)] + [(60, [0.9, 0.8, 0.7, 0.95]), (61, [0.5, 0.52, 0.48, 0.5])]
    trained = m.Trained(FEATURES, np.zeros(3), np.ones(3), [], 0, 0, [m.Member(str(k), None, acc, max(acc - 0.5, 0) + 1e-6) for k, acc in enumerate((0.6, 0.71, 0.45, 0.8))])
    df = spark.createDataFrame(rows, "k int, p array<double>")
    blend, agree = ({r["k"]: r for r in f(df, trained).collect()} for f in (m.blended, m.agreement))
    w = [x.weight for x in trained.members]
    side = lambda p: "bullish" if p > 0.55 else "bearish" if p < 0.45 else "neutral"
    levels = set()
    for k, raw in rows:
        p = [round(x, 4) for x in raw]
        mean = sum(a * b for a, b in zip(p, w)) / sum(w)
        assert blend[k]["probability"] == pytest.approx(round(mean, 4), abs=1.1e-4) and blend[k]["uncertainty"] == pytest.approx(1 - 2 * abs(mean - 0.5), abs=1.1e-4)
        assert blend[k]["disagreement"] == pytest.approx(min(1, 2 * statistics.pstdev(p)), abs=1.1e-4)
        share = sum(side(x) == side(round(mean, 4)) for x in p) / 4
        level = "high" if share >= 0.8 else "medium" if share >= 0.5 else "low"
        assert (agree[k]["agreement_pct"], agree[k]["level"], agree[k]["proceed"]) == (share, level, level == "high") and agree[k]["variance"] == pytest.approx(statistics.pvariance(p), abs=1e-6)
        assert agree[k]["spread"] == pytest.approx(0.35)
        levels.add(level)
    assert levels == {"high", "medium", "low"}


def pairs_frame(spark, n=400, hot=0.5, seed=3):
    rng = random.Random(seed)
    pairs = []
    for k in range(n):
        z = rng.gauss(0, 2)
        pairs.append((START + timedelta(hours=k), 1 / (1 + math.exp(-z)), float(rng.random() < 1 / (1 + math.exp(-hot * z)))))
    return pairs, spark.createDataFrame(pairs, "ts timestamp, p double, y double").repartition(3)


def test_calibration_fits_and_choice(spark):
    pairs, df = pairs_frame(spark)
    out = {c.method: c for c in m.calibrations(df)}
    fit, judge = pairs[:200], pairs[200:]
    lg = lambda p: math.log(p / (1 - p))
    sg = lambda z: 1 / (1 + math.exp(-z))
    (a,), (b,) = out["platt_scaling"].knots
    errors = [(sg(a * lg(p) + b) - y, lg(p)) for _, p, y in fit]
    assert abs(a + sum(e * z for e, z in errors)) < 0.05 and abs(sum(e for e, _ in errors)) < 0.05  # no slope left in the penalised loss
    t = out["temperature_scaling"].knots[0][0]
    nll = lambda t: -sum(y * math.log(sg(lg(p) / t)) + (1 - y) * math.log(1 - sg(lg(p) / t)) for _, p, y in fit)
    assert all(nll(t) <= nll(t * f) + 1e-6 for f in (0.5, 0.98, 1.02, 2)) and 1.3 < t < 4
    x, y = out["isotonic_regression"].knots
    assert x == sorted(x) and y == sorted(y)
    own = sorted((p, o) for _, p, o in fit)
    for cut in range(1, 200):  # pooled means: the best line that doesn't fall, by its max-min formula
        best = max(min(statistics.fmean(o for _, o in own[i : j + 1]) for j in range(cut, 200)) for i in range(max(0, cut - 60), cut + 1))
        if cut % 40 == 0:
            assert np.interp(own[cut][0], x, y) == pytest.approx(best, abs=0.02)
    for c in out.values():
        q = c.values(np.array([p for _, p, _ in judge]), np.array([lg(p) for _, p, _ in judge]))
        assert c.brier == pytest.approx(np.mean((q - np.array([o for *_, o in judge])) ** 2), abs=1e-4) and (c.fitted, c.judged) == (200, 200)
    assert [c.brier for c in m.calibrations(df)] == sorted(c.brier for c in out.values())


def test_calibration_edges(spark):
    _, df = pairs_frame(spark, 19)
    assert m.calibrations(df) == []
    _, df = pairs_frame(spark, 40)
    ones = m.calibrations(df.withColumn("y", F.lit(1.0)))
    assert {c.method: c.knots for c in ones}["platt_scaling"] == ([1.0], [0.0])
    rows = spark.createDataFrame([(0.2,), (0.9,)], "probability double")
    assert [tuple(r) for r in m.calibrated(rows, None).collect()] == [(0.2, 0.2, 0.0, "none"), (0.9, 0.9, 0.0, "none")]
    for c in ones:
        got = [r["calibrated"] for r in m.calibrated(rows, c).collect()]
        assert got == pytest.approx(c.values(np.array([0.2, 0.9]), np.log(np.array([0.2 / 0.8, 9.0]))).tolist(), abs=1e-4)
    assert m.brier(ones[0], np.zeros((0, 4))) == 1.0


def test_explanations_and_attributions(spark, fitted):
    rows, df, trained, _ = fitted
    first = {(r[0], r[1]): r for r in rows}
    some = spark.createDataFrame(list(first.values())[:6], df.schema)
    top = m.explained(some, trained, ["symbol", "ts"], m.SCHEMA, 2).collect()
    assert len(top) == 6 * 4 * 2
    for r in some.collect():
        std = [0.0 if r[f] is None or trained.deviations[k] == 0 else (r[f] - trained.means[k]) / trained.deviations[k] for k, f in enumerate(FEATURES)]
        for e in trained.members:
            w = e.model.weights if isinstance(e.model, m.Linear) else e.model.importance(3)
            want = sorted(((round(w[k] * std[k], 6), f) for k, f in enumerate(FEATURES)), key=lambda c: -abs(c[0]))[:2]
            own = sorted((t["rank"], t["feature"], t["contribution"]) for t in top if (t["symbol"], t["ts"], t["model"]) == (r["symbol"], r["ts"], e.name))
            assert [(f, c) for _, f, c in own] == [(f, pytest.approx(c, abs=2e-6)) for c, f in want]
    value = {(r["symbol"], r["ts"], r["feature"]): r["contribution"] for r in m.attributed(some, trained, ["symbol", "ts"], m.SCHEMA, 3).collect()}
    total = sum(x.weight for x in trained.members)
    for r in some.collect():
        x = np.array([[trained.means[k] if r[f] is None else r[f] for k, f in enumerate(FEATURES)]])
        bins = binned(x, trained.edges)
        want = 0.0
        for e in trained.members:
            if isinstance(e.model, m.Linear):
                want += e.weight * ((x - trained.means) @ e.model.weights)[0]
            else:
                mean = sum(sum(t.value[k] * t.rows[k] for k, _ in t.paths()) / t.rows[0] for t in e.model.trees)
                out = sum(t.value[t.leaf(bins)][0] for t in e.model.trees) - mean
                want += e.weight * (out if e.model.learner.boosted else out / len(e.model.trees))
        assert sum(value[r["symbol"], r["ts"], f] for f in FEATURES) == pytest.approx(want / total, abs=1e-5)  # values add up to the output less its mean


def test_champion():
    assert m.champion(0.6, 0.62) == (0.02, "challenger") and m.champion(0.6, 0.595) == (-0.005, "tie") and m.champion(0.7, 0.6)[1] == "champion"
    assert m.champion(None, None) == (None, "insufficient_data") and m.champion(None, 0.5)[1] == "challenger" and m.champion(0.5, None)[1] == "champion"

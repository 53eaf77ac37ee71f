"""The as-of pass against a bisecting walk, coverage and targets by hand, structure by windows against the swing table."""

import bisect
import random
from datetime import datetime, timedelta

import pandas as pd
import pytest

from tidewater.operators import training as t
from tidewater.operators.swings import structure_of
from tidewater.plans.dialect import CATALOG, Operator

START = datetime(2024, 1, 1)
at = lambda k: START + timedelta(seconds=k)


@pytest.mark.parametrize("block", [7, 60, 10**9])
def test_as_of_equals_bisecting(spark, block):
    rng = random.Random(block)
    names = ["a", "b", "c"]
    seen = [(s, at(rng.randrange(400)), f, rng.choice([None, round(rng.random(), 3)])) for s in "xyz" for f in names for _ in range(25) if not (s == "y" and f == "c")]
    asks = [(s, at(rng.randrange(500)), k) for k, s in enumerate(rng.choices("xyzw", k=120))] + [("x", at(5), 900), ("x", at(5), 901)]
    got = t.as_of(spark.createDataFrame(asks, "symbol string, ts timestamp, k int"), spark.createDataFrame(seen, "symbol string, ts timestamp, feature string, value double"), names, block)
    assert got.columns == ["symbol", "ts", "k", *names]
    best = {}
    for s, ts, f, v in seen:
        if v is not None:
            best[s, f, ts] = max(v, best.get((s, f, ts), v))

    def walk(s, f, ts):
        own = sorted((k[2], v) for k, v in best.items() if k[:2] == (s, f))
        n = bisect.bisect_right([x for x, _ in own], ts)
        return own[n - 1][1] if n else None

    want = {k: (s, ts, *[walk(s, f, ts) for f in names]) for s, ts, k in asks}
    rows = got.collect()
    assert len(rows) == len(asks) and {r["k"]: (r["symbol"], r["ts"], r["a"], r["b"], r["c"]) for r in rows} == want


def test_rows_need_core_features_and_quality(spark):
    labels = spark.createDataFrame([("x", at(10), 1, 1.0), ("x", at(11), 0, 0.1), ("z", at(10), 1, 0.5), ("x", at(1), 0, 0.5)], "symbol string, ts timestamp, target int, quality double")
    ten, nine = t.CORE[:10], t.CORE[:9]
    seen = [("x", at(5), f, 1.5) for f in ten] + [("z", at(5), f, 2.5) for f in nine] + [("MARKET", at(6), "event_trading_freeze", 1.0), ("x", at(6), "options_pcr", 0.7), ("x", at(6), "unknown", 9.0)]
    rows = t.training_rows(labels, spark.createDataFrame(seen, "symbol string, ts timestamp, feature string, value double"), block=4).collect()
    assert len(t.FEATURES) == 39 and len(t.CORE) == 16
    (r,) = rows  # ten of sixteen are enough, nine aren't; quality 0.1 and an entry before all observations drop
    assert (r["symbol"], r["ts"], r["target"]) == ("x", at(10), 1)
    assert r["event_trading_freeze"] == 1.0 and r["options_pcr"] == 0.7 and r["liquidity_score"] is None and r[ten[3]] == 1.5


def test_one_exchange_of_the_observations(spark):
    series = spark.createDataFrame([("x", at(1), "a", 1.0)], "symbol string, ts timestamp, feature string, value double")
    rows = t.as_of(spark.createDataFrame([("x", at(2), 1)], "symbol string, ts timestamp, k int"), series, ["a", "b"])
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Window [last(") + plan.count("Window [_") <= 3 and "Python" not in plan


def test_structure_by_windows_equals_the_swing_table(spark, sf):
    got = Operator("", "", "SELECT * FROM {structure}", {"structure": t.STRUCTURE}).run(spark, sf).toPandas().set_index(["symbol", "ts"]).sort_index()
    candles = Operator("", "", "SELECT * FROM {candles}").run(spark, sf).toPandas()
    want = pd.concat([structure_of(g) for _, g in candles.groupby("symbol")]).set_index(["symbol", "ts"]).sort_index()
    for k in ("trend", "bos", "choch", "bias", "breakout_prob", "sweep_prob"):
        pd.testing.assert_series_equal(got[k].astype(float), want[k].astype(float), check_names=False, atol=1e-9)


def test_hash_follows_rows_not_their_order(spark):
    rows = [("x", at(k * 90000), k % 2, float(k), None) for k in range(40)]
    make = lambda r: t.training_hash(spark.createDataFrame(r, "symbol string, ts timestamp, target int, a double, b double").repartition(3), ["a", "b"]).first()["dataset_hash"]
    assert make(rows) == make(rows[::-1]) != make(rows[:-1]) and make([*rows[:-1], (*rows[-1][:3], 7.0, None)]) != make(rows)
    assert "m09_structure_windows" in CATALOG

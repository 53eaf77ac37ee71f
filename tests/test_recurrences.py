"""Recurrences over blocks against plain walks, whatever the blocks' size."""

import random
from datetime import datetime, timedelta, timezone

import pytest

from tidewater.operators import recurrences as R

START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def moments(rng, n):
    """Distinct minutes with gaps of many sizes."""
    out, at = [], START
    for _ in range(n):
        at += timedelta(minutes=rng.choice([1, 1, 1, 7, 60, 4000]))
        out.append(at)
    return out


@pytest.mark.parametrize("block", [60, 3600, 400 * 86400])
def test_averages(spark, block):
    rng = random.Random(1)
    series = {"long": 130, "edge": 20, "short": 3, "one": 1}
    rows = [(s, t, rng.uniform(10, 90)) for s, n in series.items() for t in moments(rng, n)]
    shuffled = rows + [("long", None, 5.0), ("long", START, None)]
    rng.shuffle(shuffled)
    got = {(r["symbol"], r["n"]): r for r in R.averages(spark.createDataFrame(shuffled, "symbol string, ts timestamp, close double"), (1, 5, 20), block).collect()}
    assert len(got) == len(rows)
    for s, n in series.items():
        closes = [c for k, _, c in rows if k == s]
        for w in (1, 5, 20):
            k, e = 2 / (w + 1), None
            for j, c in enumerate(closes, 1):
                if j == w:
                    e = sum(closes[:w]) / w
                elif j > w:
                    e = c * k + e * (1 - k)
                assert got[s, j][f"ema_{w}"] == (None if e is None else pytest.approx(e, abs=2e-6)), (s, j, w)


@pytest.mark.parametrize("block", [60, 7200, 400 * 86400])
def test_beliefs(spark, block):
    rng = random.Random(2)
    rows = []
    for s, n in {"a": 90, "b": 2, "c": 1}.items():
        for t in moments(rng, n):
            rows.append((s, t, rng.choice([None, -1.0, 0.3, 0.77, 4.0]), *(rng.choice([None, -2.0, 0.0, rng.random()]) for _ in range(3))))
    frame = spark.createDataFrame(rng.sample(rows, len(rows)), "symbol string, ts timestamp, confidence double, x double, y double, z double")
    got = {(r["symbol"], r["u"]): (r["x"], r["y"], r["z"]) for r in R.beliefs(frame, ["x", "y", "z"], block).selectExpr("symbol", "unix_timestamp(ts) AS u", "x", "y", "z").collect()}
    belief = {}
    for s, t, sure, *ev in rows:
        ev = [max(0.0, v or 0.0) for v in ev]
        likely = [v / sum(ev) if sum(ev) else 1 / 3 for v in ev]
        w = min(0.9, max(0.1, 0.1 if sure is None else sure))
        if s in belief:
            mixed = [(1 - w) * a + w * b for a, b in zip(belief[s], likely)]
            likely = [v / sum(mixed) for v in mixed]
        belief[s] = likely
        assert got[s, int(t.timestamp())] == pytest.approx(likely, abs=1e-9)
    assert len(got) == len(rows)


def test_empty(spark):
    assert R.averages(spark.createDataFrame([], "symbol string, ts timestamp, close double")).count() == 0
    assert R.beliefs(spark.createDataFrame([], "symbol string, ts timestamp, confidence double, a double, b double"), ["a", "b"]).count() == 0

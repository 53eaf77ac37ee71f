"""Engines against plain Python walks of their definitions, on rows with and without missing features."""

import math
import random

import pytest
from pyspark.sql import Row

from tidewater.operators import engines, newswords

NAMES = ["symbol", "ts", "far_high", "far_low", "rvol", "obv_z", "move", "drawdown", "today_vol"]
NAMES += [f"{k}_{w}" for k in ("mom", "acc", "z") for w in engines.MOMENTUM_SCALES] + ["trend", "bias", "bos", "breakout_prob"]


def sign(x):
    return (x > 0) - (x < 0)


def walk_trend(f, age, steady):
    known = [math.tanh(f[f"mom_{w}"] / s) for w, s in engines.MOMENTUM_SCALES.items() if f[f"mom_{w}"] is not None]
    daily = 0.5 * (sum(known) / len(known) if known else 0) + 0.3 * (f["trend"] or 0) + 0.2 * (f["bias"] or 0)
    level, conflict = daily, 0.0
    if f["move"] is not None:
        today = math.tanh(f["move"] / 2)
        level, conflict = 0.7 * daily + 0.3 * today, max(0.0, -today * sign(daily))
    level = max(-1.0, min(1.0, level))
    strength = min(1.0, 0.7 * (sum(map(abs, known)) / len(known) if known else 0) + 0.3 * abs(f["bias"] or 0))
    opposing = max(0.0, -sign(level) * math.tanh((f["acc_20"] or 0) / 2))
    far = f["far_high"] if level >= 0 else f["far_low"]
    near = 1 - min(abs(far), 5) / 5 if far is not None else 0
    tired = min(1.0, 0.4 * min(age / 60, 1) + 0.4 * opposing + 0.2 * near * opposing)
    if f["drawdown"] is not None:
        tired = min(1.0, tired + 0.25 * min(1.0, f["drawdown"] / 1.5))
    volume = [min(f["rvol"] / 1.5, 1.0)] if f["rvol"] is not None else []
    volume += [max(0.0, min(1.0, 0.5 + 0.5 * sign(level) * math.tanh(f["obv_z"])))] if f["obv_z"] is not None else []
    agree = sum(sign(s) == sign(level) for s in known) / len(known) if known and level else 0.0
    sure = 0.25 + 0.45 * agree + 0.2 * steady + 0.1 * (sum(volume) / len(volume) if volume else 0) - 0.3 * conflict
    chance = f["breakout_prob"] or 0
    up, down = max(level, 0), max(-level, 0)
    ev = [up * strength, up * (1 - strength), down * strength, down * (1 - strength), (1 - abs(level)) * (1 - strength)]
    ev += [max(f["bos"] or 0, 0) * chance, max(-(f["bos"] or 0), 0) * chance, 0.5 * (1 - steady) * abs(level)]
    total = sum(ev)
    return [level, 50 + 50 * level, max(0, min(1, sure)), strength, tired, age, steady, *(e / total if total else 1 / 8 for e in ev)]


def test_trend_against_a_walk(spark):
    rng = random.Random(3)
    rows, history = [], []
    for k in range(60):
        f = {n: None if rng.random() < k / 70 else rng.gauss(0, 4) for n in NAMES[2:]}
        for n in ("rvol", "drawdown", "today_vol"):
            f[n] = abs(f[n]) if f[n] is not None else None
        f["trend"] = None if f["trend"] is None else float(sign(round(f["trend"] / 4)))
        f["bias"] = None if f["bias"] is None else math.tanh(f["bias"])
        f["bos"] = None if f["bos"] is None else float(sign(round(f["bos"] / 6)))
        f["breakout_prob"] = None if f["breakout_prob"] is None else 0.5 + 0.4 * math.tanh(f["breakout_prob"])
        rows.append(Row(symbol=f"s{k}", ts=k, **f))
        history.append((f"s{k}", float(rng.randrange(90)), rng.random()))
    schema = "symbol string, ts int, " + ", ".join(f"{n} double" for n in NAMES[2:])
    got = {r["symbol"]: r for r in engines.trend(spark.createDataFrame(rows, schema), spark.createDataFrame(history, "symbol string, age double, stability double")).collect()}
    for r, (name, age, steady) in zip(rows, history):
        want = walk_trend(r.asDict(), age, steady)
        assert list(got[name])[2:] == pytest.approx(want, abs=2e-6), name


def test_nothing_known_says_nothing(spark):
    schema = "symbol string, ts int, " + ", ".join(f"{n} double" for n in NAMES[2:])
    empty = spark.createDataFrame([("s", 0, *[None] * (len(NAMES) - 2))], schema)
    r = engines.trend(empty, spark.createDataFrame([], "symbol string, age double, stability double")).first()
    assert r["score"] == 50 and r["confidence"] == 0.25 and r["s_range"] == 1.0
    r = engines.momentum(empty).first()
    assert r["score"] == 50 and r["confidence"] == 0 and r["s_mixed"] == 1.0


def test_trend_age_and_stability(spark):
    series = {"a": [1, 1, 0, -1, -1, -1], "b": [-1, 0], "c": [1] * 30, "d": [None, 1, -1, 1]}
    rows = [(s, k, None if v is None else float(v)) for s, vs in series.items() for k, v in enumerate(vs)]
    got = {r["symbol"]: (r["age"], round(r["stability"], 4)) for r in engines.trend_history(spark.createDataFrame(rows, "symbol string, ts int, trend double")).collect()}
    assert got == {"a": (3, 0.5), "b": (0, 0), "c": (30, 1), "d": (1, 0.6667)}


def test_news_words(spark):
    texts = ["Ambani beats estimates", "War! rally; war", "Banking in China", "the autopilot of a warship", "Modi's budget", "GDP up", None, "losses losses losses", "S&P, Fitch"]
    got = [(r["sentiment"], r["entities"], r["class"]) for r in newswords.read(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).orderBy("doc_id").collect()]
    assert got[0] == (1.0, ["RELIANCE"], "stock") and got[2][1:] == (["BANKING", "CHINA"], "sector") and got[3] == (0.0, [], "macro")
    assert got[1][0] == pytest.approx((1.0 - 2.6) / 3.6) and got[1][2] == "global"
    assert got[4][1:] == (["MODI"], "policy") and got[5][2] == "macro" and got[6] == (0.0, [], "macro")
    assert got[7][0] == -1.0  # each phrase takes the space behind it
    assert got[8][1:] == (["FITCH", "S&P"], "global")

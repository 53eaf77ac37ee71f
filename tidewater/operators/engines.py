"""Intelligence engines: what one latest row of features says about trend, momentum, volatility and breadth.

An engine is a projection of columns: every feature may be missing, means skip what is missing, and a score says nothing
(50, or the middle) where nothing is known. Inputs are one row a symbol from :data:`FEATURES`, which looks back over a
bounded number of bars, so that an engine's work doesn't grow with the history.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewater.operators.rolling import BARS, P, over, zscore
from tidewater.operators.swings import structure
from tidewater.plans.dialect import CATALOG, Operator, operator

# Fixed values
MOMENTUM_SCALES = {5: 3.0, 20: 6.0, 50: 10.0, 200: 20.0}
ACCELERATION_SCALES = {5: 1.5, 20: 3.0, 50: 5.0, 200: 10.0}
VOLATILITY_WINDOWS = BREADTH_WINDOWS = (5, 20, 50, 100)
VOLATILITY_ANCHORS = {"extremely_low": 0.0, "low": 0.2, "normal": 0.5, "elevated": 0.7, "high": 0.85, "extreme": 1.0}
BACK = 421  # bars that the longest feature needs: momentum over 200, its change, a z-score over 100, and some

SESSION = "PARTITION BY symbol, @date(@ist(ts)) ORDER BY ts ROWS UNBOUNDED PRECEDING"


def _features() -> str:
    v, m = VOLATILITY_WINDOWS, tuple(MOMENTUM_SCALES)
    mom = ", ".join(f"@div(close - lag(close, {w}) OVER ({P}), lag(close, {w}) OVER ({P})) * 100 AS mom_{w}" for w in m)
    hist = ", ".join(f"CASE WHEN count(lr) {over(w)} = {w} THEN round(stddev_pop(lr) {over(w)} * sqrt(252) * 100, 9) END AS hist_{w}, CASE WHEN count(sr) {over(w)} = {w} THEN stddev_pop(sr) {over(w)} * 100 END AS roll_{w}" for w in v)
    held = ", ".join(f"@list_agg(hist_{w}) {over(100)} AS held_{w}, count(hist_{w}) {over(100)} AS n_{w}, CASE WHEN count(roll_{w}) {over(w)} = {w} THEN stddev_pop(roll_{w}) {over(w)} END AS vov_{w}" for w in v)
    rank = ", ".join(f"CASE WHEN hist_{w} IS NOT NULL AND n_{w} >= 10 THEN @div(@size(@filter(held_{w}, @L(x) x <= hist_{w})), n_{w}) END AS pct_{w}" for w in v)
    shown = [f"mom_{w}" for w in m] + [f"acc_{w}" for w in m] + [f"z_{w}" for w in m] + [f"hist_{w}" for w in v] + [f"vov_{w}" for w in v]
    shown += [f"CAST(CASE WHEN pct_{w} < 1.0 / 3 THEN 0 WHEN pct_{w} < 2.0 / 3 THEN 1 WHEN pct_{w} IS NOT NULL THEN 2 END AS DOUBLE) AS regime_{w}" for w in v]
    shown += [f"1 - pct_{w} AS compression_{w}, 0.1 + 0.8 * (1 - pct_{w}) AS expansion_{w}, hist_{w} - vix AS vix_{w}" for w in v]
    return f"""WITH recent AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS back FROM {{candles}}),
c AS (SELECT symbol, ts, open, high, low, close, volume, back FROM recent WHERE back <= {BACK}),
{BARS.strip().replace("{candles}", "c")},
m AS (SELECT *, {mom}, {hist},
  sum(CASE WHEN close > pc THEN volume WHEN close < pc THEN -volume ELSE 0 END) OVER ({P} ROWS UNBOUNDED PRECEDING) AS obv,
  @div(close - max(high) {over(50)}, max(high) {over(50)}) * 100 AS far_high, @div(close - min(low) {over(50)}, min(low) {over(50)}) * 100 AS far_low,
  @div(volume, avg(volume) {over(20, 1)}) AS rvol, first_value(open) OVER ({SESSION}) AS opened, max(close) OVER ({SESSION}) AS peak,
  CASE WHEN count(lr) OVER ({SESSION}) >= 3 THEN stddev_pop(lr) OVER ({SESSION}) * sqrt(252) * 100 END AS today_vol FROM rets),
h AS (SELECT *, {", ".join(f"mom_{w} - lag(mom_{w}) OVER ({P}) AS acc_{w}, {zscore(f'mom_{w}')} AS z_{w}" for w in m)}, {held}, {zscore("obv")} AS obv_z FROM m),
r AS (SELECT *, {rank} FROM h WHERE back = 1)
SELECT r.symbol, r.ts, far_high, far_low, rvol, obv_z, @div(r.close - opened, opened) * 100 AS move, @div(peak - r.close, peak) * 100 AS drawdown, today_vol,
  {", ".join(shown)} FROM r LEFT JOIN (SELECT ts, close AS vix FROM {{reference}}) x ON r.ts = x.ts"""


FEATURES = _features()
operator("f22_wide_features", "The newest bar of each symbol with the features that the engines read, over a bounded history.", FEATURES)

BREADTH = f"""WITH recent AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS back FROM {{candles}}),
b AS (SELECT symbol, ts, open, close, volume, avg(close) {over(50)} AS mean50, max(close) {over(100)} AS top, min(close) {over(100)} AS bottom, @div(close - lag(close) OVER ({P}), lag(close) OVER ({P})) * 100 AS ret FROM recent WHERE back <= 300),
s AS (SELECT 'all' AS symbol, ts, @div(sum(sign(close - open)), sum(abs(sign(close - open)))) AS strength, avg(CASE WHEN close > open THEN CAST(100 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) AS participation,
  avg(CASE WHEN close > mean50 THEN CAST(100 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) AS above, CAST(sum(CASE WHEN close = top THEN 1 ELSE 0 END) AS DOUBLE) AS highs, CAST(sum(CASE WHEN close = bottom THEN 1 ELSE 0 END) AS DOUBLE) AS lows,
  avg(ret) - @div(sum(ret * volume), sum(CASE WHEN ret IS NOT NULL THEN volume END)) AS divergence FROM b GROUP BY ts),
n AS (SELECT *, row_number() OVER ({P}) AS rn, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS back FROM s),
t AS (SELECT *, {", ".join(f"CASE WHEN count({k}) {over(w)} = {w} THEN regr_slope({k}, CAST(rn AS DOUBLE)) {over(w)} END AS {k}_{w}" for w in BREADTH_WINDOWS for k in ("strength", "highs", "lows"))} FROM n)
SELECT ts, strength, participation, above, divergence, {", ".join(f"{k}_{w}" for w in BREADTH_WINDOWS for k in ("strength", "highs", "lows"))} FROM t WHERE back = 1"""
operator("f23_breadth_features", "The newest snapshot of the market with the features that the breadth engine reads.", BREADTH)


def _some(*terms: Column) -> tuple[Column, Column]:
    """(mean of the terms that are present, null if none is; how many are)."""
    present = F.filter(F.array(*terms), lambda x: x.isNotNull())
    n = F.size(present).cast("double")
    return F.when(n > 0, F.aggregate(present, F.lit(0.0), lambda a, x: a + x) / n), n


def _or0(x: Column) -> Column:
    return F.coalesce(x, F.lit(0.0))


def _clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.when(x.isNotNull(), F.least(F.lit(high), F.greatest(F.lit(low), x)))


def _at_most(x: Column, high: float) -> Column:
    """least() passes over nulls; here a null stays one."""
    return F.when(x.isNotNull(), F.least(x, F.lit(high)))


def _shares(evidence: dict[str, Column]) -> list[Column]:
    """Evidence as a distribution, uniform where nothing speaks."""
    parts = {k: F.greatest(F.lit(0.0), _or0(e)) for k, e in evidence.items()}
    total = sum(parts.values(), F.lit(0.0))
    return [F.when(total > 0, p / total).otherwise(1.0 / len(parts)).alias(f"s_{k}") for k, p in parts.items()]


def _spread(*terms: Column) -> Column:
    """Population deviation of the terms that are present."""
    mean, n = _some(*terms)
    square, _ = _some(*(t * t for t in terms))
    return F.when(n > 0, F.sqrt(F.greatest(F.lit(0.0), square - mean * mean)))


def _daily_and_today(daily: Column) -> tuple[Column, Column]:
    """(level with today's move from the open blended in, how far that move opposes the daily level)."""
    today = F.tanh(F.col("move") / 2.0)
    return F.when(today.isNull(), daily).otherwise(0.7 * daily + 0.3 * today), _or0(F.greatest(F.lit(0.0), -today * F.signum(daily)))


def _rounded(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.select(*keys, *((F.round(F.col(c).cast("double") + 1e-9, 6) + 0.0).alias(c) for c in df.columns if c not in keys))


def trend(features: DataFrame, history: DataFrame) -> DataFrame:
    """``features``: :data:`FEATURES` with structure's trend, bias, bos and breakout_prob; ``history``: symbol, age, stability."""
    f = features.join(history, "symbol", "left")
    signals = [F.tanh(F.col(f"mom_{w}") / s) for w, s in MOMENTUM_SCALES.items()]
    ladder, _ = _some(*signals)
    size, _ = _some(*(F.abs(s) for s in signals))
    level, conflict = _daily_and_today(0.5 * _or0(ladder) + 0.3 * _or0(F.col("trend")) + 0.2 * _or0(F.col("bias")))
    f = f.withColumns({"level": _clamp(level, -1.0, 1.0), "conflict": conflict, "strength": F.least(F.lit(1.0), 0.7 * _or0(size) + 0.3 * F.abs(_or0(F.col("bias"))))})
    way = F.signum("level")
    agreeing, _ = _some(*(F.when(s.isNotNull(), (F.signum(s) == way).cast("double")) for s in signals))
    volume, _ = _some(_at_most(F.col("rvol") / 1.5, 1.0), _clamp(0.5 + 0.5 * way * F.tanh("obv_z")))
    opposing = F.greatest(F.lit(0.0), -way * F.tanh(_or0(F.col("acc_20")) / 2.0))
    far = F.when(F.col("level") >= 0, F.col("far_high")).otherwise(F.col("far_low"))
    near = _or0(1 - _at_most(F.abs(far), 5.0) / 5.0)
    tired = F.least(F.lit(1.0), 0.4 * _or0(_at_most(F.col("age") / 60.0, 1.0)) + 0.4 * opposing + 0.2 * near * opposing)
    tired = F.least(F.lit(1.0), tired + 0.25 * _or0(_at_most(F.col("drawdown") / 1.5, 1.0)))
    up, down, strong, steady = F.greatest(F.col("level"), F.lit(0.0)), F.greatest(-F.col("level"), F.lit(0.0)), F.col("strength"), _or0(F.col("stability"))
    bos, chance = _or0(F.col("bos")), _or0(F.col("breakout_prob"))
    states = {
        "strong_bull": up * strong, "weak_bull": up * (1 - strong), "strong_bear": down * strong, "weak_bear": down * (1 - strong),
        "range": (1 - F.abs("level")) * (1 - strong), "breakout": F.greatest(bos, F.lit(0.0)) * chance, "breakdown": F.greatest(-bos, F.lit(0.0)) * chance,
        "transition": 0.5 * (1 - steady) * F.abs("level"),
    }
    f = f.withColumns({"age": _or0(F.col("age")), "stability": steady})
    out = f.select(
        "symbol", "ts", "level", (50 + 50 * F.col("level")).alias("score"),
        _clamp(0.25 + 0.45 * F.when(way != 0, _or0(agreeing)).otherwise(0.0) + 0.2 * steady + 0.1 * _or0(volume) - 0.3 * F.col("conflict")).alias("confidence"),
        "strength", tired.alias("exhaustion"), "age", "stability", *_shares(states),
    )
    return _rounded(out, ["symbol", "ts"])


def trend_history(structured: DataFrame, lookback: int = 20) -> DataFrame:
    """symbol, age (newest bars in a row whose trend has the newest one's sign), stability (share of the last ones that have)."""
    newest_first = Window.partitionBy("symbol").orderBy(F.desc("ts"))
    known = structured.where("trend IS NOT NULL").select("symbol", F.signum("trend").alias("way"), F.row_number().over(newest_first).alias("back"), F.first(F.signum("trend")).over(newest_first).alias("now"))
    same = F.col("way") == F.col("now")
    first_other = F.min(F.when(~same, F.col("back")))
    age = F.coalesce(first_other - 1, F.max("back"))
    steady = F.avg(F.when(F.col("back") <= lookback, same.cast("double")))
    flat = F.max("now") == 0
    return known.groupBy("symbol").agg(F.when(flat, 0.0).otherwise(age.cast("double")).alias("age"), F.when(flat, 0.0).otherwise(steady).alias("stability"))


def momentum(features: DataFrame) -> DataFrame:
    signals = [F.tanh(F.col(f"mom_{w}") / s) for w, s in MOMENTUM_SCALES.items()]
    ladder, n = _some(*signals)
    gain, _ = _some(*(F.tanh(F.col(f"acc_{w}") / s) for w, s in ACCELERATION_SCALES.items()))
    level, conflict = _daily_and_today(_or0(ladder))
    f = features.withColumns({"level": _clamp(level, -1.0, 1.0), "gain": _or0(gain), "conflict": conflict})
    agreeing, _ = _some(*(F.when(s.isNotNull(), ((s >= 0) == (F.col("level") >= 0)).cast("double")) for s in signals))
    far = F.greatest(*(F.abs(f"z_{w}") for w in MOMENTUM_SCALES))
    lv, g = F.col("level"), F.col("gain")
    plus = lambda x: F.greatest(x, F.lit(0.0))
    states = {
        "accelerating_bullish": plus(lv) * plus(g), "accelerating_bearish": plus(-lv) * plus(-g), "decelerating": plus(lv) * plus(-g) + plus(-lv) * plus(g),
        "extreme": F.when(far >= 2, F.abs(lv)), "mixed": (1 - F.abs(lv)) * (1 - F.abs(g)),
    }
    confidence = _clamp(0.4 * n / len(signals) + 0.4 * _or0(agreeing) + F.when(far.isNotNull(), 0.2).otherwise(0.0) - 0.3 * F.col("conflict"))
    return _rounded(f.select("symbol", "ts", "level", (50 + 50 * lv).alias("score"), confidence.alias("confidence"), g.alias("acceleration"), far.alias("max_abs_z"), *_shares(states)), ["symbol", "ts"])


def volatility(features: DataFrame) -> DataFrame:
    each = lambda name: [F.col(f"{name}_{w}") for w in VOLATILITY_WINDOWS]
    levels = [x / 2.0 for x in each("regime")]
    regime, n = _some(*levels)
    vix, _ = _some(*each("vix"))
    hist, _ = _some(*each("hist"))
    vov, _ = _some(*each("vov"))
    squeeze, _ = _some(*each("compression"))
    burst, _ = _some(*each("expansion"))
    regime = F.coalesce(regime, F.lit(0.5))
    daily = _clamp(F.when(vix.isNull(), regime).otherwise(0.85 * regime + 0.15 * (0.5 - 0.5 * F.tanh(vix / 10.0))))
    f = features.withColumns({"daily": daily, "tilt": F.when(hist > 1e-6, F.tanh((F.col("today_vol") / hist - 1) / 1.5))})
    tilt = F.col("tilt")
    f = f.withColumn("level", F.when(tilt.isNull(), F.col("daily")).otherwise(_clamp(0.8 * F.col("daily") + 0.2 * (0.5 + 0.5 * tilt))))
    conflict = _or0(F.greatest(F.lit(0.0), tilt * (0.5 - F.col("daily")) * 2))
    agreement = F.when(n > 1, 1 - F.least(F.lit(1.0), 2 * _spread(*levels))).when(n == 1, 1.0).otherwise(0.0)
    unstable = _or0(_at_most(vov / F.when(hist.isNotNull(), F.greatest(hist, F.lit(1e-6))), 1.0))
    confidence = _clamp(0.25 + 0.35 * agreement + 0.2 * n / len(levels) + F.when(vix.isNotNull(), 0.1).otherwise(0.0) - 0.15 * unstable - 0.2 * conflict)
    states = {k: 1 - F.abs(F.col("level") - a) / 0.25 for k, a in VOLATILITY_ANCHORS.items()} | {"compression": 0.5 * squeeze, "expansion": 0.5 * burst}
    return _rounded(f.select("symbol", "ts", "level", (100 * F.col("level")).alias("score"), confidence.alias("confidence"), unstable.alias("instability"), *_shares(states)), ["symbol", "ts"])


def breadth(features: DataFrame) -> DataFrame:
    each = lambda name: _some(*(F.col(f"{name}_{w}") for w in BREADTH_WINDOWS))[0]
    way, new = F.tanh(each("strength") / 0.1), F.tanh((each("highs") - each("lows")) / 5.0)
    terms = [
        (0.40, _clamp(F.col("strength"), -1.0, 1.0), F.col("strength")), (0.25, _clamp((F.col("participation") - 50) / 50.0, -1.0, 1.0), F.col("participation")),
        (0.15, _clamp((F.col("above") - 50) / 50.0, -1.0, 1.0), F.col("above")), (0.10, way, way), (0.10, new, new),
    ]
    weight = sum((F.when(there.isNotNull(), w).otherwise(0.0) for w, _, there in terms), F.lit(0.0))
    level = _clamp(_or0(sum((F.when(there.isNotNull(), w * x).otherwise(0.0) for w, x, there in terms), F.lit(0.0)) / F.nullif(weight, F.lit(0.0))), -1.0, 1.0)
    n = sum((there.isNotNull().cast("double") for *_, there in terms), F.lit(0.0))
    base, known = _some(F.col("participation") / 100.0, F.col("above") / 100.0)
    narrow = F.coalesce(_clamp(1 + F.least(F.col("divergence"), F.lit(0.0)) / 10.0), F.lit(1.0))
    f = features.withColumns({"level": level, "quality": _clamp(F.coalesce(base, F.lit(0.5)) * narrow), "way": way, "new": new})
    both = F.filter(F.array(F.signum("way"), F.signum("new")), lambda x: x.isNotNull())
    agreement = F.when(F.size(both) == 0, 0.0).when(F.size(F.array_distinct(F.filter(both, lambda x: x != 0))) <= 1, 1.0).otherwise(0.5)
    confidence = _clamp(0.25 + 0.35 * n / 5 + 0.25 * agreement + 0.15 * F.when(known > 0, F.col("quality")).otherwise(0.0))
    conviction = F.abs(F.coalesce(_clamp(F.col("strength"), -1.0, 1.0), F.col("level")))
    q = F.col("quality")
    states = {"broad": conviction * q, "narrow": conviction * (1 - q), "improving": F.col("way"), "deteriorating": -F.col("way"), "mixed": (1 - conviction) * q}
    return _rounded(f.select("ts", "level", (50 + 50 * F.col("level")).alias("score"), confidence.alias("confidence"), q.alias("quality"), *_shares(states)), ["ts"])


def _wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return CATALOG["f22_wide_features"].run(spark, sf_dir)


def structured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structure of each symbol's newest ``BACK`` bars."""
    bars = Operator("", "", f"SELECT symbol, ts, high, low, close FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS back FROM {{candles}}) q WHERE back <= {BACK}").run(spark, sf_dir)
    return structure(bars)


def _trend_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = structured(spark, sf_dir)
    return trend(_wide(spark, sf_dir).join(known.select("symbol", "ts", "trend", "bias", "bos", "breakout_prob"), ["symbol", "ts"], "left"), trend_history(known))


QUERIES = {
    "n05_trend": _trend_query,
    "n06_momentum": lambda spark, d: momentum(_wide(spark, d)),
    "n07_volatility": lambda spark, d: volatility(_wide(spark, d)),
    "n08_breadth": lambda spark, d: breadth(CATALOG["f23_breadth_features"].run(spark, d)),
}

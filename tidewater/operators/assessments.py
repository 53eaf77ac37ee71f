"""Assessments beside the price engines: structure, relative strength, sectors, options, macro, events, flows and liquidity,
regime transitions, and the composite of all components.

As in :mod:`engines`, an assessment is a projection of columns over one row of readings (or one aggregate, where a row is a
whole cross-section), every reading may be missing, and nothing known gives the middle. Levels lie in -1..1 or 0..1, scores in
0..100, states are a distribution (``s_`` columns). The relations that the registered queries read are templates of their own.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.operators import engines, snapshots, training  # noqa: F401  their templates are inputs
from tidewater.operators.engines import _clamp, _daily_and_today, _or0, _rounded, _shares, _some, _spread
from tidewater.operators.rolling import QUOTE, P, full, over
from tidewater.plans.dialect import CATALOG, Operator
from tidewater.session import cut

# Weights, scales and anchors of the scores.
WINDOWS = (5, 20, 50, 100)
REFERENCES = ("nifty", "sensex", "sector", "industry", "peers")
TODAY_REFERENCES = ("nifty", "sensex")
SECTOR_COUNT, FACTOR_COUNT = 12, 14
FLOW_WEIGHTS = {"fii": 0.30, "dii": 0.20, "etf": 0.10, "deals": 0.15, "promoter": 0.15, "insider": 0.10}
FLOW_REQUIRED = ("fii", "dii", "etf", "deals", "insider", "sast")
EVENT_ANCHORS = {"clear": 0.0, "elevated_risk": 0.4, "high_risk": 0.7, "freeze_recommended": 0.9}
LIQUIDITY_ANCHORS = {"illiquid": 0.0, "thin": 0.25, "healthy": 0.6, "highly_liquid": 0.9}
TRANSITION_ANCHORS = {"stable": 0.0, "transitioning": 0.5, "unstable": 1.0}
COMPOSITE_ANCHORS = {"strong_bearish": 0.0, "bearish": 0.25, "neutral": 0.5, "bullish": 0.75, "strong_bullish": 1.0}
DIRECTIONAL = ("trend", "breadth", "macro", "sector", "institutional_flow", "market_structure", "options", "momentum")
MAGNITUDE = ("volatility", "liquidity", "correlation", "event_risk")


def _plus(x: Column) -> Column:
    return F.greatest(_or0(x), F.lit(0.0))


def _weighted(terms: list[tuple[float, Column]]) -> tuple[Column, Column]:
    """(weighted mean of the terms that are present, 0 if none is; how many are)."""
    there = [(w, x, x.isNotNull()) for w, x in terms]
    top = sum((F.when(ok, w * x).otherwise(0.0) for w, x, ok in there), F.lit(0.0))
    low = sum((F.when(ok, w).otherwise(0.0) for w, _, ok in there), F.lit(0.0))
    return _or0(top / F.nullif(low, F.lit(0.0))), sum((ok.cast("double") for *_, ok in there), F.lit(0.0))


def _near(level: Column, anchors: dict[str, float], band: float) -> dict[str, Column]:
    return {k: 1 - F.abs(level - a) / band for k, a in anchors.items()}


def _present(*names: str) -> Column:
    return sum((F.col(n).isNotNull().cast("double") for n in names), F.lit(0.0))


def structure(readings: DataFrame) -> DataFrame:
    """``readings``: symbol, ts, bias, trend, breakout_prob, sweep_prob, choch, move, drawdown."""
    daily = _or0(_clamp(F.col("bias"), -1.0, 1.0))
    level, conflict = _daily_and_today(daily)
    f = readings.withColumns({"level": level, "conflict": conflict, "trending": _or0((F.col("trend") != 0).cast("double"))})
    lv, on = F.col("level"), F.col("trending")
    turned = F.when(_or0(F.col("choch")) != 0, 0.15).otherwise(0.0)
    states = {
        "markup": _plus(lv) * on, "markdown": _plus(-lv) * on, "accumulation": _plus(lv) * (1 - on), "distribution": _plus(-lv) * (1 - on),
        "consolidation": (1 - F.abs(lv)) * (1 - on), "liquidity_sweep": 0.5 * _or0(F.col("sweep_prob")),
    }
    sure = _clamp(0.2 + 0.6 * _present("bias", "trend", "breakout_prob", "sweep_prob") / 4 - turned - 0.3 * F.col("conflict"))
    out = f.select("symbol", "ts", lv, _clamp(50 + 50 * lv, 0.0, 100.0).alias("score"), sure.alias("confidence"), _clamp(F.col("drawdown") / 1.5).alias("reversal"), *_shares(states))
    return _rounded(out, ["symbol", "ts"])


def relative_strength(readings: DataFrame) -> DataFrame:
    """``readings``: symbol, ts, ``<reference>_strength_<w>`` and ``_momentum_<w>``, outperformance_<w>, rank_<w>, own_move, ``<reference>_move``."""
    each = lambda name: _some(*(F.col(f"{name}_{w}") for w in WINDOWS))[0]
    signals = [F.tanh(each(f"{r}_strength") / 5.0) for r in REFERENCES]
    daily, n = _some(*signals)
    today, _ = _some(*(F.tanh((F.col("own_move") - F.col(f"{r}_move")) / 2.0) for r in TODAY_REFERENCES))
    gain, _ = _some(*(F.tanh(each(f"{r}_momentum") / 1.0) for r in REFERENCES))
    f = readings.withColumns({"daily": _or0(daily), "today": today, "n": n, "gain": _or0(gain), "out": each("outperformance"), "ranking": each("rank")})
    f = f.withColumn("level", _clamp(F.when(F.col("today").isNull(), F.col("daily")).otherwise(0.75 * F.col("daily") + 0.25 * F.col("today")), -1.0, 1.0))
    lv = F.col("level")
    agreeing, _ = _some(*(F.when(s.isNotNull(), (F.signum(s) == F.signum(lv)).cast("double")) for s in signals))
    f = f.withColumn("agreement", F.when(lv == 0, 0.0).otherwise(_or0(agreeing)))
    same = F.col("agreement")
    conflict = _or0(F.greatest(F.lit(0.0), -F.col("today") * F.signum("daily")))
    sure = _clamp(0.2 + 0.3 * F.col("n") / len(REFERENCES) + 0.3 * same + F.when(F.col("out").isNotNull(), 0.2).otherwise(0.0) - 0.25 * conflict)
    states = {"leading": _plus(lv) * same, "lagging": _plus(-lv) * same, "in_line": 1 - F.abs(lv), "rotating": F.abs(lv) * (1 - same)}
    shown = F.when(F.col("out").isNull(), _clamp(50 + 50 * lv, 0.0, 100.0)).when(F.col("out") == 0, 50.0).otherwise(_clamp(F.col("out"), 0.0, 100.0))
    return _rounded(f.select("symbol", "ts", lv, shown.alias("score"), sure.alias("confidence"), F.col("gain").alias("momentum"), "ranking", "agreement", *_shares(states)), ["symbol", "ts"])


def sectors(readings: DataFrame, universe: int = SECTOR_COUNT) -> DataFrame:
    """One row a moment. ``readings``: ts, sector, heat, leadership, leadership_was, relative, momentum, capital, and rotation and participation
    of the moment (the same in all its rows). Leaders and laggards are at most three each; a name decides between equals."""
    changed = ((F.col("leadership") > 0) != (F.col("leadership_was") > 0)) | (F.abs(F.col("leadership") - F.col("leadership_was")) >= 1.0)
    ranked = F.transform(F.array_sort(F.collect_list(F.when(F.col("heat").isNotNull(), F.struct((-F.col("heat")).alias("cold"), "sector")))), lambda x: x["sector"])
    g = readings.groupBy("ts").agg(
        ranked.alias("ranked"), F.count("*").alias("all"), F.avg("heat").alias("heat"), _clamp(F.avg(F.abs("capital")), 0.0, 100.0).alias("capital"), F.avg("relative").alias("relative"), F.avg("momentum").alias("momentum"),
        F.stddev_pop("leadership").alias("apart"), _or0(F.sum(changed.cast("double"))).alias("changes"), F.count(changed).cast("double").alias("compared"),
        F.max("rotation").alias("rotation"), F.max("participation").alias("participation"),
    )
    rotation, _ = _some(F.col("capital"), _clamp(F.col("rotation") * 5.0, 0.0, 100.0))
    level, _ = _weighted([(0.40, _clamp((F.col("participation") - 50) / 50.0, -1.0, 1.0)), (0.35, F.tanh(F.col("relative") / 5.0)), (0.25, F.tanh(F.col("momentum") / 5.0))])
    led = F.least(F.lit(3), F.floor(F.size("ranked") / 2)).cast("int")
    share = F.when(F.col("compared") > 0, F.col("changes") / F.col("compared")).otherwise(0.0)
    f = g.withColumns({"level": _clamp(level, -1.0, 1.0), "rotation_score": _or0(rotation), "change": share, "led": led})
    turn, broad = _clamp(F.col("rotation_score") / 100.0), F.coalesce(_clamp(F.col("participation") / 100.0), F.lit(0.5))
    steady = F.when(F.col("compared") > 0, 1 - F.col("change")).otherwise(0.5)
    sure = _clamp(0.2 + 0.3 * F.size("ranked") / F.greatest(F.col("all"), F.lit(universe)) + 0.25 * _or0(_clamp(F.col("apart") / 2.0)) + 0.25 * steady)
    states = {"broad_rotation": turn * broad, "narrow_leadership": turn * (1 - broad), "leadership_shift": F.col("change"), "sector_neutral": 1 - turn}
    first, last = F.slice("ranked", 1, F.col("led")), F.slice("ranked", F.size("ranked") - F.col("led") + 1, F.col("led"))
    names = {"leaders": F.array_join(first, ","), "laggards": F.array_join(last, ",")}
    out = f.select("ts", *(F.when(F.col("led") > 0, x).otherwise("").alias(k) for k, x in names.items()), "level", _clamp(50 + 50 * F.col("level"), 0.0, 100.0).alias("score"), sure.alias("confidence"), "rotation_score", "heat", "changes", *_shares(states))
    return _rounded(out, ["ts", "leaders", "laggards"])


def options(readings: DataFrame) -> DataFrame:
    """``readings``: chain, dealer, pcr, max_pain_distance, iv_rank."""
    level, n = _weighted([(0.40, _clamp(F.col("dealer"), -1.0, 1.0)), (0.30, _clamp(1 - F.col("pcr"), -1.0, 1.0)), (0.30, _clamp(F.col("max_pain_distance") / 10.0, -1.0, 1.0))])
    f = readings.withColumns({"level": level, "n": n})
    lv, iv = F.col("level"), (F.col("iv_rank") / 100.0 - 0.5) * 2
    states = {"bullish_positioning": lv, "bearish_positioning": -lv, "elevated_iv": iv, "compressed_iv": -iv, "mixed": 1 - F.abs(lv)}
    sure = _clamp(0.3 + 0.5 * F.col("n") / 3 + F.when(iv.isNotNull(), 0.2).otherwise(0.0))
    return _rounded(f.select("chain", lv, (50 + 50 * lv).alias("score"), sure.alias("confidence"), *_shares(states)), ["chain"])


def macro(factors: DataFrame, universe: int = FACTOR_COUNT) -> DataFrame:
    """One row a moment. ``factors``: ts, factor, score (signed, -1..1). Signs are counted first, so that one aggregate is enough."""
    x = F.col("score")
    g = factors.groupBy("ts").agg(F.avg("score").alias("mean"), F.count("score").cast("double").alias("n"), F.avg(F.abs("score")).alias("size"), *(F.sum((ok).cast("double")).alias(k) for k, ok in {"up": x > 0, "down": x < 0}.items()))
    f = g.withColumn("level", _or0(_clamp(F.col("mean"), -1.0, 1.0)))
    lv, n = F.col("level"), F.col("n")
    same = _or0(F.when(lv > 0, F.col("up") / n).when(lv < 0, F.col("down") / n))
    keen = _or0(_clamp(F.col("size") / 0.3))
    states = {"risk_on": F.when(lv > 0, keen * same), "risk_off": F.when(lv < 0, keen * same), "mixed": 1 - keen}
    sure = F.when(n > 0, _clamp(0.2 + 0.3 * n / universe + 0.5 * same)).otherwise(0.0)
    return _rounded(f.select("ts", lv, (50 + 50 * lv).alias("score"), sure.alias("confidence"), keen.alias("conviction"), same.alias("consistency"), "n", *_shares(states)), ["ts"])


def event_risk(readings: DataFrame) -> DataFrame:
    """``readings``: ts, sensitivity, hours, expected_vol, category_impact, reduction, frozen, similarity."""
    level, n = _weighted([(0.5, _clamp(F.col("sensitivity"))), (0.3, _clamp(1 - F.col("hours") / 48.0)), (0.2, _clamp((F.col("expected_vol") - 1) / 4.0))])
    f = readings.withColumns({"level": level, "n": n})
    lv = F.col("level")
    states = _near(lv, EVENT_ANCHORS, 0.3)
    states["freeze_recommended"] = F.when(F.col("frozen") == 1, F.greatest(states["freeze_recommended"], F.lit(0.8))).otherwise(states["freeze_recommended"])
    trust = F.coalesce(_clamp(1 - F.col("reduction")), F.lit(0.7)) - F.coalesce(0.15 * (1 - F.col("similarity")), F.lit(0.1))
    impact = F.coalesce(100 * F.col("category_impact"), F.when(F.col("n") > 0, 100 * lv))
    return _rounded(f.select("ts", lv, _clamp(100 * lv, 0.0, 100.0).alias("score"), _clamp(trust).alias("confidence"), impact.alias("expected_impact"), *_shares(states)), ["ts"])


def institutional_flow(readings: DataFrame) -> DataFrame:
    """``readings``: segment, ts, the six scores of ``FLOW_WEIGHTS``, sast, participation, and ``<score>_momentum_<w>`` of fii, dii, participation."""
    values = [F.col(k) for k in FLOW_WEIGHTS]
    level, n = _weighted([(w, F.col(k)) for k, w in FLOW_WEIGHTS.items()])
    buys, _ = _some(*(F.when(v.isNotNull(), F.greatest(v, F.lit(0.0))) for v in values))
    sells, _ = _some(*(F.when(v.isNotNull(), F.greatest(-v, F.lit(0.0))) for v in values))
    size, _ = _some(*(F.abs(v) for v in values))
    pace, _ = _some(*(_some(*(F.col(f"{k}_momentum_{w}") for w in WINDOWS))[0] for k in ("fii", "dii", "participation")))
    f = readings.withColumns({"level": _clamp(level, -1.0, 1.0), "n": n})
    lv = F.col("level")
    same, _ = _some(*(F.when(v.isNotNull(), ((v > 0) == (lv > 0)).cast("double")) for v in values))
    f = f.withColumns({"agreement": F.when(F.col("n") == 0, 0.0).when(lv == 0, 0.5).otherwise(same), "conviction": _or0(_clamp(size / 0.3))})
    same, keen = F.col("agreement"), F.col("conviction")
    states = {"institutional_accumulation": F.when(lv > 0, keen * same), "institutional_distribution": F.when(lv < 0, keen * same), "retail_driven": 1 - keen, "mixed_flow": keen * (1 - same)}
    sure = _clamp(0.2 + 0.35 * _present(*FLOW_REQUIRED) / len(FLOW_REQUIRED) + 0.3 * same - 0.1 * _or0(F.col("sast")))
    shown = F.coalesce(_clamp(F.col("participation"), 0.0, 100.0), 50 + 50 * lv)
    out = f.select(
        "segment", "ts", lv, shown.alias("score"), sure.alias("confidence"), (100 * _or0(buys)).alias("accumulation"), (100 * _or0(sells)).alias("distribution"),
        _or0(_clamp(pace, -1.0, 1.0)).alias("momentum"), "agreement", *_shares(states),
    )
    return _rounded(out, ["segment", "ts"])


def liquidity(readings: DataFrame) -> DataFrame:
    """``readings``: symbol, ts, liquidity_score, spread_pct, impact_pct, imbalance, trend_<w>, turnover, delivery_pct, turnover_z, delivery_z."""
    slopes = [F.col(f"trend_{w}") for w in WINDOWS]
    slope, n = _some(*slopes)
    score = F.coalesce(_clamp(F.col("liquidity_score"), 0.0, 100.0), F.lit(50.0))
    risk, _ = _some(_clamp(F.col("spread_pct") / 1.0), _clamp(F.col("impact_pct") / 0.5))
    lean = F.abs(_or0(F.col("imbalance")))
    stress = _clamp(0.45 * _or0(_clamp(slope / -3.0)) + 0.35 * lean + 0.2 * _or0(_clamp((F.col("turnover_z") - F.col("delivery_z")) / 4.0)))
    f = readings.withColumns({"score": score, "level": score / 100.0, "stress": stress, "lean": lean, "n": n})
    one_way = F.size(F.array_distinct(F.transform(F.filter(F.array(*slopes), lambda x: x.isNotNull()), lambda x: x > 0))) == 1
    steady = F.when(F.col("n") == 0, 0.0).when(one_way, 1.0).otherwise(0.5)
    states = _near(F.col("level"), LIQUIDITY_ANCHORS, 0.3) | {"stress": 0.5 * F.col("stress"), "auction_driven": 0.5 * _clamp((1 - F.col("level")) * F.col("lean"))}
    there = _present("liquidity_score", "spread_pct", "imbalance", "impact_pct", "turnover", "delivery_pct")
    sure = _clamp(0.2 + 0.4 * there / 6 + 0.2 * steady - 0.15 * F.col("stress"))
    out = f.select("symbol", "ts", "level", "score", sure.alias("confidence"), (100 * F.col("stress")).alias("stress"), F.coalesce(100 * risk, 100 - F.col("score")).alias("execution_risk"), *_shares(states))
    return _rounded(out, ["symbol", "ts"])


def transition(beliefs: DataFrame, states: list[str], history: int = 20, threshold: float = 0.6) -> DataFrame:
    """One row a symbol from its newest ``history`` beliefs. ``beliefs``: symbol, ts and a share for each of ``states``. Of equal shares
    the state named first leads. Fewer than two beliefs tell nothing: score 0, confidence 0.1, stable."""
    newest = F.row_number().over(engines.Window.partitionBy("symbol").orderBy(F.desc("ts")))
    held = beliefs.select("symbol", "ts", *states, newest.alias("back")).where(F.col("back") <= history)
    g = held.groupBy("symbol").agg(F.max("ts").alias("ts"), F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct((-F.col("back")).alias("at"), F.array(*states).alias("p")))).alias("h"))
    ranked = F.array_sort(F.transform(F.array(*[F.lit(k) for k in range(len(states))]), lambda k: F.struct((-F.get(F.col("now"), k)).alias("less"), k.alias("k"))))
    g = g.withColumn("now", F.element_at("h", -1)["p"]).withColumn("ranked", ranked)
    for name, place in (("lead", 0), ("second", 1)):
        g = g.withColumn(name, F.get("ranked", F.lit(place))["k"])
    series = lambda k: F.transform("h", lambda x, i: F.struct(i.cast("double").alias("i"), F.coalesce(F.get(x["p"], F.col(k)), F.lit(0.0)).alias("v")))
    add = lambda a, f: F.aggregate(a, F.lit(0.0), lambda s, x: s + f(x))

    def slope(a: Column) -> Column:
        n = F.col("n").cast("double")
        sx, sy, sxy, sxx = add(a, lambda x: x["i"]), add(a, lambda x: x["v"]), add(a, lambda x: x["i"] * x["v"]), add(a, lambda x: x["i"] * x["i"])
        return _or0((n * sxy - sx * sy) / F.nullif(n * sxx - sx * sx, F.lit(0.0)))

    g = g.withColumns({"speed": slope(series("lead")), "rising": slope(series("second")), "loss": _clamp(F.array_max(F.element_at("h", 1)["p"]) - F.array_max("now"))})
    closeness = 1 - _clamp(F.get("now", F.col("lead")) - F.coalesce(F.get("now", F.col("second")), F.lit(0.0)))
    g = g.withColumn("probability", F.when(F.col("n") > 1, _clamp(0.6 * closeness + 0.4 * _clamp(_plus(F.col("rising")) / 0.05))))
    level = _or0(F.when(F.col("n") > 1, _clamp(0.4 * F.col("probability") + 0.3 * _clamp(F.abs("speed") / 0.1) + 0.3 * F.col("loss"))))
    g = g.withColumn("level", level)
    name = lambda k: F.when(F.col("n") > 1, F.get(F.array(*[F.lit(s) for s in states]), F.col(k)))
    known = lambda x: F.when(F.col("n") > 1, x)
    out = g.select(
        "symbol", "ts", name("lead").alias("state"), name("second").alias("runner_up"), (100 * F.col("level")).alias("score"), F.when(F.col("n") > 1, _clamp(F.col("n") / 10.0)).otherwise(0.1).alias("confidence"),
        "probability", known(F.col("speed")).alias("speed"), known(F.col("loss")).alias("confidence_loss"), _or0((F.col("probability") >= threshold).cast("double")).alias("alert"), *_shares(_near(F.col("level"), TRANSITION_ANCHORS, 0.4)),
    )
    return _rounded(out, ["symbol", "ts", "state", "runner_up"])


def composite(components: DataFrame) -> DataFrame:
    """One row a symbol. ``components``: symbol, component, score, confidence; a component that isn't there is left out. One aggregate."""
    of = lambda name: F.max(F.when(F.col("component") == name, F.col("score")))
    g = components.where(F.col("component").isin(*DIRECTIONAL, *MAGNITUDE) & F.col("score").isNotNull())
    g = g.groupBy("symbol").agg(*(of(k).alias(k) for k in (*DIRECTIONAL, *MAGNITUDE)), F.count_distinct("component").cast("double").alias("n"), F.avg("confidence").alias("sure"))
    leans = [(F.col(k) - 50) / 50.0 for k in DIRECTIONAL]
    level, _ = _some(*leans)
    bull, _ = _some(*(F.when(x.isNotNull(), F.greatest(x, F.lit(0.0))) for x in leans))
    bear, _ = _some(*(F.when(x.isNotNull(), F.greatest(-x, F.lit(0.0))) for x in leans))
    part = {k: F.col(k) / 100.0 for k in MAGNITUDE}
    calm, _ = _some(1 - part["volatility"], part["liquidity"], 1 - part["correlation"])
    risk, _ = _some(part["volatility"], part["event_risk"], part["correlation"])
    f = g.withColumns({"level": _or0(level), "stability": F.coalesce(100 * calm, F.lit(50.0))})
    lv = F.col("level")
    out = f.select(
        "symbol", _clamp(50 + 50 * lv, 0.0, 100.0).alias("score"), _clamp(0.4 * F.col("n") / 12 + 0.6 * _or0(F.col("sure"))).alias("confidence"), (100 * _or0(bull)).alias("bullishness"), (100 * _or0(bear)).alias("bearishness"),
        "stability", F.coalesce(100 * risk, F.lit(50.0)).alias("expected_risk"), _clamp(F.abs(lv) * F.col("stability"), 0.0, 100.0).alias("opportunity"), "n", *_shares(_near(_clamp((lv + 1) / 2.0), COMPOSITE_ANCHORS, 0.3)),
    )
    return _rounded(out, ["symbol"])


# What the registered queries read ---------------------------------------------------------------------------------


def _relative() -> str:
    """Instruments without the two that stand for indices; sector: all symbols, industry: two of them, peers: all others."""
    ratio = {"nifty": "ln(close) - nifty", "sensex": "ln(close) - sensex", "sector": "ln(close) - total / n", "industry": "ln(close) - pair", "peers": "CASE WHEN n > 1 THEN ln(close) - (total - ln(close)) / (n - 1) END"}
    gap = ", ".join(f"(r_{r} - lag(r_{r}, {w}) OVER ({P})) * 100 AS {r}_strength_{w}, {full(f'regr_slope(r_{r}, CAST(rn AS DOUBLE)) ', f'r_{r}', w)} * 100 AS {r}_momentum_{w}" for r in REFERENCES for w in WINDOWS)
    gain = ", ".join(f"ln(close) - ln(lag(close, {w}) OVER ({P})) AS ret_{w}" for w in WINDOWS)
    there = lambda w: " + ".join(f"CASE WHEN {r}_strength_{w} IS NULL THEN 0 ELSE 1 END" for r in REFERENCES)
    beats = ", ".join(f"50 * (1 + ({' + '.join(f'coalesce(tanh({r}_strength_{w} / 5), 0)' for r in REFERENCES)}) / nullif(CAST({there(w)} AS DOUBLE), 0.0)) AS outperformance_{w}" for w in WINDOWS)
    rank = ", ".join(f"CASE WHEN ret_{w} IS NOT NULL AND count(ret_{w}) OVER (PARTITION BY ts) >= 2 THEN 100 * cume_dist() OVER (PARTITION BY ts, CASE WHEN ret_{w} IS NULL THEN 0 ELSE 1 END ORDER BY ret_{w}) END AS rank_{w}" for w in WINDOWS)
    strengths = ", ".join(f"{r}_{k}_{w}" for r in REFERENCES for k in ("strength", "momentum") for w in WINDOWS)
    return f"""WITH m AS (SELECT ts, sum(ln(close)) AS total, count(*) AS n, max(CASE WHEN symbol = 'view' THEN ln(close) END) AS nifty, max(CASE WHEN symbol = 'click' THEN ln(close) END) AS sensex,
  avg(CASE WHEN symbol IN ('purchase', 'signup') THEN ln(close) END) AS pair FROM {{candles}} WHERE close > 0 GROUP BY ts),
o AS (SELECT symbol, ts, close, @div(close - first_value(open) OVER ({engines.SESSION}), first_value(open) OVER ({engines.SESSION})) * 100 AS move, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS back, row_number() OVER ({P}) AS rn FROM {{candles}} WHERE close > 0),
x AS (SELECT symbol, o.ts AS ts, close, move, back, rn, {", ".join(f"{e} AS r_{k}" for k, e in ratio.items())} FROM o JOIN m ON o.ts = m.ts WHERE back <= 120 AND symbol NOT IN ('view', 'click')),
s AS (SELECT *, {gap}, {gain} FROM x), t AS (SELECT * FROM s WHERE back = 1),
v AS (SELECT ts, max(CASE WHEN symbol = 'view' THEN move END) AS nifty_move, max(CASE WHEN symbol = 'click' THEN move END) AS sensex_move FROM o WHERE symbol IN ('view', 'click') GROUP BY ts),
u AS (SELECT symbol, ts, {strengths}, {beats}, {rank}, move AS own_move FROM t)
SELECT u.*, nifty_move, sensex_move FROM u LEFT JOIN v ON u.ts = v.ts"""


RELATIONS = {
    "structure_readings": "SELECT s.symbol, s.ts, bias, trend, breakout_prob, sweep_prob, choch, move, drawdown FROM {m09_structure_windows} s JOIN {f22_wide_features} f ON s.symbol = f.symbol AND s.ts = f.ts",
    "relative_readings": _relative(),
    # labels of observations stand for sectors, their mean value for heat, their count for what trades in them
    "sector_readings": f"""WITH s AS (SELECT label AS sector, @date(ts) AS day, avg(value) AS heat, CAST(count(value) AS DOUBLE) AS volume FROM {{observations}} WHERE value IS NOT NULL GROUP BY label, @date(ts)),
m AS (SELECT *, avg(heat) OVER (PARTITION BY day) AS mean, stddev_pop(heat) OVER (PARTITION BY day) AS sd, @div(volume, sum(volume) OVER (PARTITION BY day)) AS part FROM s),
r AS (SELECT *, @div(heat - mean, mean) * 100 AS relative, CASE WHEN sd > 1e-12 THEN (heat - mean) / nullif(sd, 0.0) END AS leadership FROM m),
l AS (SELECT *, lag(leadership) OVER (PARTITION BY sector ORDER BY day) AS leadership_was, relative - avg(relative) OVER (PARTITION BY sector ORDER BY day ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS momentum,
  (part - lag(part) OVER (PARTITION BY sector ORDER BY day)) * 100 AS capital FROM r)
SELECT day AS ts, sector, heat, leadership, leadership_was, relative, momentum, capital, stddev_pop(relative) OVER (PARTITION BY day) AS rotation, avg(CASE WHEN relative > 0 THEN CAST(100 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) OVER (PARTITION BY day) AS participation FROM l""",
    # max pain: the strike at which writers pay least, among the chain's own strikes
    "option_readings": f"""WITH {snapshots.CHAIN}, t AS (SELECT chain, CAST(sum(call_oi) AS DOUBLE) AS calls, CAST(sum(put_oi) AS DOUBLE) AS puts, @div(sum(strike * (call_oi + put_oi)), sum(call_oi + put_oi)) AS spot, min(iv) AS lo, max(iv) AS hi, max_by(iv, strike) AS iv FROM c GROUP BY chain),
w AS (SELECT a.chain, a.strike, sum(greatest(a.strike - b.strike, 0) * b.call_oi + greatest(b.strike - a.strike, 0) * b.put_oi) AS pain FROM c a JOIN c b ON a.chain = b.chain GROUP BY a.chain, a.strike),
p AS (SELECT chain, strike FROM (SELECT *, row_number() OVER (PARTITION BY chain ORDER BY pain, strike) AS k FROM w) q WHERE k = 1)
SELECT t.chain AS chain, @div(puts - calls, puts + calls) AS dealer, @div(puts, calls) AS pcr, @div(strike - spot, spot) * 100 AS max_pain_distance, @div(iv - lo, hi - lo) * 100 AS iv_rank FROM t JOIN p ON t.chain = p.chain""",
    "macro_scores": "SELECT ts, factor, CASE WHEN factor IN ('1-URGENT', '2-HIGH') THEN -1 ELSE 1 END * least(3.0, greatest(-3.0, CAST(coalesce(z, ret) AS DOUBLE))) / 3 AS score FROM {b07_macro_factors} WHERE coalesce(z, ret) IS NOT NULL",
    "event_readings": """SELECT s.ts AS ts, @div(active, 10) AS sensitivity, @div(seconds_to_next, 3600) AS hours, CAST(multiplier AS DOUBLE) AS expected_vol, CASE WHEN active >= 5 THEN reduction END AS category_impact, reduction,
  CAST(CASE WHEN multiplier >= 3 AND reduction >= 0.8 THEN 1 ELSE 0 END AS DOUBLE) AS frozen, similarity
FROM {b16_event_similarity} s LEFT JOIN (SELECT ts, seconds_to_next, multiplier FROM {b15_event_windows} WHERE symbol = 'view') w ON s.ts = w.ts LEFT JOIN {d13_event_activity} a ON s.ts = a.ts""",
    "flow_readings": f"""WITH o AS (SELECT c_mktsegment AS segment, date_trunc('month', o_orderdate) AS ts, o_orderpriority AS pri, o_totalprice AS v, CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END AS open, c_acctbal AS bal, CASE WHEN o_custkey % 2 = 0 THEN 1 ELSE -1 END AS side FROM {{orders}} JOIN {{customer}} ON o_custkey = c_custkey),
g AS (SELECT segment AS symbol, ts, {", ".join(f"@div(sum(CASE WHEN {ok} THEN side * v END), sum(CASE WHEN {ok} THEN v END)) AS {k}" for k, ok in {"fii": "pri = '1-URGENT'", "dii": "pri = '2-HIGH'", "etf": "pri = '3-MEDIUM'", "deals": "v > 300000", "promoter": "bal > 8000", "insider": "bal < 0"}.items())},
  avg(CAST(open AS DOUBLE)) AS sast, CASE WHEN count(*) % 3 <> 0 THEN 50 + 50 * @div(sum(side * v), sum(v)) END AS participation FROM o GROUP BY segment, ts),
n AS (SELECT *, row_number() OVER ({P}) AS rn FROM g)
SELECT symbol AS segment, ts, fii, dii, etf, deals, promoter, insider, sast, participation, {", ".join(f"{full(f'regr_slope({k}, CAST(rn AS DOUBLE))', k, w)} AS {k}_momentum_{w}" for k in ("fii", "dii", "participation") for w in WINDOWS)} FROM n""",
    "newest_quotes": "SELECT symbol, ts, bid, ask, bid_depth, ask_depth FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS back FROM {quotes}) q WHERE back <= 220",
    "liquidity_readings": f"""WITH {QUOTE.replace("{quotes}", "{newest_quotes}")}, n AS (SELECT *, row_number() OVER ({P}) AS rn, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS back FROM s),
t AS (SELECT *, {", ".join(f"{full('regr_slope(raw * 100, CAST(rn AS DOUBLE))', 'raw', w)} AS trend_{w}" for w in WINDOWS)} FROM n),
d AS (SELECT l_returnflag AS symbol, @date(l_shipdate) AS ts, CAST(sum(l_extendedprice) AS DOUBLE) AS turnover, max_by(l_discount * 100, l_orderkey * 10 + l_linenumber) AS delivery_pct FROM {{lineitem}} GROUP BY l_returnflag, @date(l_shipdate)),
z AS (SELECT *, {", ".join(f"CASE WHEN count({k}) {over(20)} = 20 THEN ({k} - avg({k}) {over(20)}) / nullif(stddev_pop({k}) {over(20)}, 0.0) END AS {v}" for k, v in (("turnover", "turnover_z"), ("delivery_pct", "delivery_z")))}, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS back FROM d)
SELECT t.symbol AS symbol, t.ts AS ts, raw * 100 AS liquidity_score, spread_pct, impact AS impact_pct, imbalance, {", ".join(f"trend_{w}" for w in WINDOWS)}, turnover, CAST(delivery_pct AS DOUBLE) AS delivery_pct, turnover_z, delivery_z
FROM t LEFT JOIN (SELECT * FROM z WHERE back = 1) y ON t.symbol = y.symbol WHERE t.back = 1""",
}


def inputs() -> dict[str, str]:
    return {k: op.text for k, op in CATALOG.items()} | {"structure": training.STRUCTURE, "d13_event_activity": snapshots.ACTIVITY_BY_SECONDS} | RELATIONS


def readings(name: str) -> Operator:
    return Operator(name, "", f"SELECT * FROM {{{name}}}", inputs())


def _over(name: str, assess):
    return lambda spark, d: assess(readings(name).run(spark, d))


def _components(spark: SparkSession, d: str) -> DataFrame:
    """Components of each symbol over one table of its newest features, and of the market (its newest moment) told to every symbol."""
    known = cut(engines.structured(spark, d))
    f = cut(engines._wide(spark, d).join(known.select("symbol", "ts", "trend", "bias", "bos", "choch", "breakout_prob", "sweep_prob"), ["symbol", "ts"], "left"))
    own = {"trend": engines.trend(f, engines.trend_history(known)), "momentum": engines.momentum(f), "volatility": engines.volatility(f), "market_structure": structure(f)}
    market = {"breadth": engines.QUERIES["n08_breadth"], "macro": QUERIES["n13_macro_assessment"], "sector": QUERIES["n09_sector_assessment"], "event_risk": QUERIES["n14_event_assessment"], "institutional_flow": QUERIES["n15_flow_assessment"]}
    rows = reduce(DataFrame.unionByName, [x.select("symbol", F.lit(k).alias("component"), "score", "confidence") for k, x in own.items()])
    newest = F.max(F.struct("ts", "score", "confidence")).alias("now")
    told = []
    for k, query in market.items():
        moments = query(spark, d).groupBy(F.col("ts").cast("timestamp").alias("ts")).agg(F.avg("score").alias("score"), F.avg("confidence").alias("confidence"))
        told.append(moments.agg(newest).select(F.lit(k).alias("component"), "now.score", "now.confidence"))  # one row
    names = f.select("symbol", F.explode(F.array(*[F.lit(k) for k in market])).alias("component"))
    market_rows = names.join(F.broadcast(reduce(DataFrame.unionByName, told)), "component")  # a row a component
    return rows.unionByName(market_rows.select("symbol", "component", "score", "confidence"))


QUERIES = {
    "n09_sector_assessment": _over("sector_readings", sectors),
    "n10_structure_assessment": _over("structure_readings", structure),
    "n11_relative_assessment": _over("relative_readings", relative_strength),
    "n12_option_assessment": _over("option_readings", options),
    "n13_macro_assessment": _over("macro_scores", macro),
    "n14_event_assessment": _over("event_readings", event_risk),
    "n15_flow_assessment": _over("flow_readings", institutional_flow),
    "n16_liquidity_assessment": _over("liquidity_readings", liquidity),
    "n26_composite_components": lambda spark, d: composite(_components(spark, d)),
}

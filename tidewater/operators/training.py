"""Training rows: the series of all features that the models read, their values as of each label's entry, and a digest.

The as-of join of all features is one pass in long form. Entries and observations are dealt into blocks of time, a block
carries each feature's newest value from row to row, and what a block starts with is the newest value of the blocks
before it: one row a block, taken from a small table. So a symbol's history spreads over tasks, and there is one exchange of
the observations, however many features there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewater.operators import rolling  # noqa: F401  its definitions come first
from tidewater.operators.rolling import BARS, P, over, zscore
from tidewater.operators import snapshots, support  # noqa: F401
from tidewater.plans.dialect import CATALOG, Operator, operator
from tidewater.session import cut

# Feature, whose it is, timeframe
SPECS = [
    ("price_momentum_20", "instrument", "D"), ("price_acceleration_20", "instrument", "D"), ("price_dist_from_high_50", "instrument", "D"), ("price_dist_from_low_50", "instrument", "D"),
    ("volume_rvol_20", "instrument", "D"), ("volume_obv_z", "instrument", "D"),
    ("ms_trend_direction", "instrument", "D"), ("ms_structural_bias", "instrument", "D"), ("ms_breakout_probability", "instrument", "D"), ("ms_sweep_probability", "instrument", "D"),
    ("ms_change_of_character", "instrument", "D"), ("ms_break_of_structure", "instrument", "D"),
    ("volatility_regime_20", "instrument", "D"), ("volatility_expected_move_20", "instrument", "D"),
    ("liquidity_score", "instrument", "quote"), ("liquidity_spread_pct", "instrument", "quote"), ("liquidity_market_impact_pct", "instrument", "quote"), ("liquidity_order_book_imbalance", "instrument", "quote"),
    ("rs_nifty_strength_20", "instrument", "D"), ("rs_outperformance_20", "instrument", "D"),
    ("breadth_health_score", "market", "breadth"), ("breadth_participation_pct", "market", "breadth"), ("flow_participation_index", "market", "flow"),
    ("event_trading_freeze", "market", "events"), ("event_expected_volatility", "market", "events"),
    ("options_pcr", "instrument", "chain"), ("options_max_pain_distance_pct", "instrument", "chain"), ("options_iv_rank", "instrument", "chain"), ("options_gamma_exposure", "instrument", "chain"), ("options_dealer_positioning", "instrument", "chain"),
    ("intraday_move_from_open_pct", "instrument", "5m"), ("intraday_current_drawdown_pct", "instrument", "5m"), ("intraday_max_drawdown_pct", "instrument", "5m"), ("intraday_realized_vol_pct", "instrument", "5m"),
    ("intraday_expected_move_next_30m_pct", "instrument", "5m"), ("intraday_var95_next_30m_pct", "instrument", "5m"), ("intraday_expected_move_rest_of_session_pct", "instrument", "5m"), ("intraday_var95_rest_of_session_pct", "instrument", "5m"), ("intraday_time_elapsed_pct", "instrument", "5m"),
]
LEAST_QUALITY, LEAST_COVERAGE = 0.2, 0.6
FEATURES = [name for name, _, _ in SPECS]
CORE = [name for name, _, timeframe in SPECS if timeframe == "D"]
MARKET = [name for name, whose, _ in SPECS if whose == "market"]
BLOCK = 30 * 86400  # seconds of a block


# Structure of every bar from windows: swings, distinct levels, runs, trend, breaks, bias and probabilities ----------

_AROUND = f"OVER ({P} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)"
_BEFORE = f"OVER ({P} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
_SO_FAR = f"OVER ({P} ROWS UNBOUNDED PRECEDING)"


def _side(name: str, further: str) -> str:
    n = f"n_{name}"
    return f"""{name}_levels AS (SELECT symbol, {n}, {name} AS level, {", ".join(f"lag({name}, {k}) OVER (PARTITION BY symbol ORDER BY {n}) AS level_{k}" for k in range(1, 5))} FROM counted WHERE {name} IS NOT NULL),
{name}_runs AS (SELECT *, CAST({n} - max(CASE WHEN level_1 IS NOT NULL AND level {further} level_1 THEN NULL ELSE {n} END) OVER (PARTITION BY symbol ORDER BY {n} ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS run FROM {name}_levels)"""


_away = ", ".join(f"abs({s}.level{'' if k == 0 else f'_{k}'} - b.close)" for s in ("t", "u") for k in range(5))
STRUCTURE = f"""WITH pivots AS (SELECT symbol, ts, high, low, close, row_number() OVER ({P}) AS rn,
  CASE WHEN count(*) {_AROUND} = 5 AND high = max(high) {_AROUND} THEN high END AS up, CASE WHEN count(*) {_AROUND} = 5 AND low = min(low) {_AROUND} THEN low END AS down FROM {{candles}}),
known AS (SELECT symbol, ts, close, rn, lag(up, 2) OVER ({P}) AS up, lag(down, 2) OVER ({P}) AS down FROM pivots),
fresh AS (SELECT symbol, ts, close, rn, up, down, @last_nn(up) {_BEFORE} AS up_was, @last_nn(down) {_BEFORE} AS down_was FROM known),
levels AS (SELECT symbol, ts, close, rn, CASE WHEN up_was IS NULL OR abs(up - up_was) > 1e-9 * abs(up_was) THEN up END AS top, CASE WHEN down_was IS NULL OR abs(down - down_was) > 1e-9 * abs(down_was) THEN down END AS bottom FROM fresh),
counted AS (SELECT *, count(top) {_SO_FAR} AS n_top, count(bottom) {_SO_FAR} AS n_bottom FROM levels),
{_side("top", ">")},
{_side("bottom", "<")},
placed AS (SELECT b.symbol, b.ts, b.rn, b.close, b.n_top, b.n_bottom, t.level AS top, u.level AS bottom, t.level - t.level_1 AS rise, u.level - u.level_1 AS fall, coalesce(t.run, 0.0) AS hh, coalesce(u.run, 0.0) AS ll, least({_away}) AS away
  FROM counted b LEFT JOIN top_runs t ON b.symbol = t.symbol AND b.n_top = t.n_top LEFT JOIN bottom_runs u ON b.symbol = u.symbol AND b.n_bottom = u.n_bottom),
upward AS (SELECT *, CASE WHEN rise IS NOT NULL AND fall IS NOT NULL THEN CASE WHEN rise > 0 AND fall > 0 THEN 1.0 WHEN rise < 0 AND fall < 0 THEN -1.0 ELSE 0.0 END END AS trend,
  CASE WHEN close > top AND sum(CASE WHEN close > top THEN 1 ELSE 0 END) OVER (PARTITION BY symbol, n_top ORDER BY ts ROWS UNBOUNDED PRECEDING) = 1 THEN 1 ELSE 0 END AS above FROM placed),
downward AS (SELECT *, CASE WHEN close < bottom AND above = 0 THEN 1 ELSE 0 END AS under FROM upward),
broken AS (SELECT *, above - CASE WHEN under = 1 AND sum(under) OVER (PARTITION BY symbol, n_bottom ORDER BY ts ROWS UNBOUNDED PRECEDING) = 1 THEN 1 ELSE 0 END AS bos FROM downward),
aged AS (SELECT *, rn - @last_nn(CASE WHEN bos <> 0 THEN rn END) {_SO_FAR} AS age, @last_nn(CASE WHEN bos <> 0 THEN bos END) {_SO_FAR} AS latest FROM broken),
biased AS (SELECT *, CASE WHEN trend IS NOT NULL THEN CAST(greatest(-1.0, least(1.0, 0.5 * trend + 0.3 * CASE WHEN age <= 10 THEN latest * (1 - CAST(age AS DOUBLE) / 10) ELSE 0 END + 0.2 * tanh((hh - ll) / 3))) AS DOUBLE) END AS bias, CASE WHEN close > 0 THEN away / close * 100 END AS zone FROM aged)
SELECT symbol, ts, CAST(trend AS DOUBLE) AS trend, CAST(bos AS DOUBLE) AS bos, CAST(CASE WHEN coalesce(trend, 0) * bos < 0 THEN bos ELSE 0 END AS DOUBLE) AS choch, bias,
  CASE WHEN close > 0 AND bias IS NOT NULL AND top IS NOT NULL THEN greatest(0.05, least(0.95, 0.5 + 0.3 * bias + 0.2 * (1 - least(abs(top - close) / close * 100, 2.0) / 2))) END AS breakout_prob,
  CASE WHEN zone IS NOT NULL THEN greatest(0.05, least(0.95, 0.15 + 0.7 * (1 - least(zone, 2.0) / 2))) END AS sweep_prob FROM biased"""
operator("m09_structure_windows", "Market structure of every bar by windows alone.", f"SELECT symbol, ts, trend, bos, choch, " + ", ".join(f"@r6({k}) AS {k}" for k in ("bias", "breakout_prob", "sweep_prob")) + " FROM {structure}", structure=STRUCTURE)

# The series of all features ---------------------------------------------------------------------------------------

#: Quotes of the instruments themselves: range and balance of the ticks in a quarter of an hour.
QUOTES = "SELECT symbol, @from_unix(@idiv(@unix(ts), 900) * 900 + 900) AS ts, min(ltp) AS bid, max(ltp) AS ask, CAST(sum(CASE WHEN ltp < 20 THEN 1 ELSE 0 END) AS DOUBLE) AS bid_depth, CAST(sum(CASE WHEN ltp >= 20 THEN 1 ELSE 0 END) AS DOUBLE) AS ask_depth FROM {ticks} GROUP BY symbol, @idiv(@unix(ts), 900)"
#: What a chain would say, from a day's ticks: those below 20 count as puts, above as calls, the price with most ticks as pain.
CHAIN = f"""WITH b AS (SELECT symbol, @date(ts) AS d, round(ltp, 0) AS strike, count(*) AS n, sum(CASE WHEN ltp < 20 THEN 1 ELSE 0 END) AS puts, avg(ltp) AS mean FROM {{ticks}} GROUP BY symbol, @date(ts), round(ltp, 0)),
c AS (SELECT symbol, d, CAST(sum(puts) AS DOUBLE) AS puts, CAST(sum(n) AS DOUBLE) AS n, max_by(strike, n * 100000 - strike) AS pain, sum(mean * n) / sum(n) AS spot, sum(CAST(n AS DOUBLE) * n) AS squares FROM b GROUP BY symbol, d)
SELECT symbol, CAST(d AS TIMESTAMP) + INTERVAL 24 HOURS AS ts, @div(puts, n - puts) AS pcr, @div(spot - pain, pain) * 100 AS pain_distance, @div(squares, n * n) AS gamma, 1 - 2 * @div(puts, n) AS dealer FROM c"""
DAILY = f"""WITH {BARS.strip()},
m AS (SELECT symbol, ts, close, volume, lr, @div(close - lag(close, 20) OVER ({P}), lag(close, 20) OVER ({P})) * 100 AS mom, @div(close - max(high) {over(50)}, max(high) {over(50)}) * 100 AS far_high, @div(close - min(low) {over(50)}, min(low) {over(50)}) * 100 AS far_low,
  @div(volume, avg(volume) {over(20, 1)}) AS rvol, sum(CASE WHEN close > pc THEN volume WHEN close < pc THEN -volume ELSE 0 END) OVER ({P} ROWS UNBOUNDED PRECEDING) AS obv,
  CASE WHEN count(lr) {over(20)} = 20 THEN round(stddev_pop(lr) {over(20)} * sqrt(252) * 100, 9) END AS hist, avg(lr) OVER (PARTITION BY ts) AS market FROM rets),
h AS (SELECT *, mom - lag(mom) OVER ({P}) AS acc, {zscore("obv")} AS obv_z, @list_agg(hist) {over(100)} AS held, count(hist) {over(100)} AS n, CASE WHEN count(lr) {over(20)} = 20 THEN sum(lr - market) {over(20)} * 100 END AS strength, avg(CASE WHEN lr > market THEN CAST(1 AS DOUBLE) WHEN lr IS NOT NULL THEN CAST(0 AS DOUBLE) END) {over(20)} AS beats FROM m)
SELECT symbol, ts, mom, acc, far_high, far_low, rvol, obv_z, CASE WHEN hist IS NOT NULL AND n >= 10 THEN CAST(least(2.0, floor(3 * @div(@size(@filter(held, @L(x) x < hist)), n))) AS DOUBLE) END AS regime, close * hist / 100 * sqrt(CAST(20 AS DOUBLE) / 252) AS move, strength, beats FROM h"""


def _long(relation: str, symbol: str, pairs: dict[str, str]) -> str:
    frames = {name: timeframe for name, _, timeframe in SPECS}
    return f"SELECT symbol, ts, r.feature AS feature, r.timeframe AS timeframe, r.value AS value FROM (SELECT {symbol} AS symbol, ts, @explode(@array(" + ", ".join(f"@struct('{k}' AS feature, '{frames[k]}' AS timeframe, CAST({v} AS DOUBLE) AS value)" for k, v in pairs.items()) + f")) AS r FROM {{{relation}}}) q"


SERIES = " UNION ALL ".join(
    [
        _long("daily_features", "symbol", {"price_momentum_20": "mom", "price_acceleration_20": "acc", "price_dist_from_high_50": "far_high", "price_dist_from_low_50": "far_low", "volume_rvol_20": "rvol", "volume_obv_z": "obv_z", "volatility_regime_20": "regime", "volatility_expected_move_20": "move", "rs_nifty_strength_20": "strength", "rs_outperformance_20": "beats"}),
        _long("structure", "symbol", {"ms_trend_direction": "trend", "ms_structural_bias": "bias", "ms_breakout_probability": "breakout_prob", "ms_sweep_probability": "sweep_prob", "ms_change_of_character": "choch", "ms_break_of_structure": "bos"}),
        _long("liquidity", "symbol", {"liquidity_score": "liquidity_score"}),
        _long("quoted", "symbol", {"liquidity_spread_pct": "spread_pct", "liquidity_market_impact_pct": "impact", "liquidity_order_book_imbalance": "imbalance"}),
        _long("chain", "symbol", {"options_pcr": "pcr", "options_max_pain_distance_pct": "pain_distance", "options_gamma_exposure": "gamma", "options_dealer_positioning": "dealer"}),
        _long("ranks", "symbol", {"options_iv_rank": "iv_rank"}),
        _long("breadth", "'MARKET'", {"breadth_health_score": "50 + 50 * strength", "breadth_participation_pct": "participation"}),
        _long("flows", "'MARKET'", {"flow_participation_index": "score"}),
        _long("calendar", "'MARKET'", {"event_trading_freeze": "CASE WHEN multiplier >= 3 THEN 1 ELSE 0 END", "event_expected_volatility": "multiplier"}),
        _long("session_move", "symbol", {"intraday_move_from_open_pct": "move_from_open", "intraday_time_elapsed_pct": "least(100.0, bars * 100 / CAST(24 AS DOUBLE))"}),
        _long("session_drop", "symbol", {"intraday_current_drawdown_pct": "dd", "intraday_max_drawdown_pct": "max_dd"}),
        _long("session_risk", "symbol", {"intraday_realized_vol_pct": "rv", "intraday_expected_move_next_30m_pct": "exp_move_next", "intraday_var95_next_30m_pct": "var95_next", "intraday_expected_move_rest_of_session_pct": "exp_move_rest", "intraday_var95_rest_of_session_pct": "var95_rest"}),
    ]
)
FEEDS = {
    "daily_features": DAILY, "structure": STRUCTURE, "quotes": QUOTES, "chain": CHAIN,
    "liquidity": CATALOG["l02_liquidity_score"].text, "quoted": CATALOG["l01_quote_features"].text, "ranks": CATALOG["b09_iv_rank"].text, "breadth": CATALOG["b01_breadth"].text,
    "flows": "SELECT @from_unix(@idiv(@unix(ts), 86400) * 86400 + 86400) AS ts, @div(sum(ltp) - 20 * count(*), sum(abs(ltp - 20))) AS score FROM {ticks} GROUP BY @idiv(@unix(ts), 86400)",
    "calendar": "SELECT ts, max(multiplier) AS multiplier FROM {windows} GROUP BY ts", "windows": CATALOG["b15_event_windows"].text,
    "session_move": CATALOG["i01_session_move"].text, "session_drop": CATALOG["i02_session_drawdown"].text, "session_risk": CATALOG["i03_session_risk"].text,
}
operator("h59_training_series", "Observations of all features that the models read, in long form.", "SELECT symbol, ts, feature, timeframe, @r6(value) AS value FROM {series} WHERE value IS NOT NULL", series=SERIES, **FEEDS)


# The as-of pass ----------------------------------------------------------------------------------------------------

def _newest(name: str, w) -> Column:
    return F.last(name, ignorenulls=True).over(w)


def as_of(entries: DataFrame, series: DataFrame, features: list[str], block: int = BLOCK) -> DataFrame:
    """``entries`` (symbol, ts, others) with a column a feature: its newest value at or before ts, null before its first.

    ``series``: symbol, ts, feature, value; of several values of one moment the largest counts. Null values are no observations.
    """
    own = [c for c in entries.columns if c not in ("symbol", "ts")]
    cell = lambda f: F.max(F.when(F.col("feature") == f, F.col("value"))).alias(f)
    seen = series.where(F.col("value").isNotNull() & F.col("feature").isin(features))
    at = F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / block)
    wide = seen.groupBy("symbol", at.alias("_block"), "ts").agg(*[cell(f) for f in features]).select("symbol", "_block", "ts", F.lit(0).alias("_asks"), F.lit(None).cast(entries.select(F.struct(*own).alias("r")).schema["r"].dataType).alias("_own"), *features)
    wide = cut(wide)
    ask = entries.select("symbol", at.alias("_block"), "ts", F.lit(1).alias("_asks"), F.struct(*own).alias("_own"), *[F.lit(None).cast("double").alias(f) for f in features])
    inside = Window.partitionBy("symbol", "_block").orderBy("ts", "_asks").rowsBetween(Window.unboundedPreceding, 0)
    held = wide.unionByName(ask).select("symbol", "_block", "ts", "_asks", "_own", *[_newest(f, inside).alias(f) for f in features]).where("_asks = 1")
    # what each block starts with: one row a symbol and block
    ends = wide.groupBy("symbol", "_block").agg(*[F.max_by(f, F.when(F.col(f).isNotNull(), F.col("ts"))).alias(f) for f in features])
    asked = ask.select("symbol", "_block").distinct()
    blocks = asked.join(ends, ["symbol", "_block"], "full")
    before = Window.partitionBy("symbol").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select("symbol", "_block", *[_newest(f, before).alias(f"_{f}") for f in features])
    met = held.join(starts, ["symbol", "_block"], "left")
    return met.select("symbol", "ts", *[F.col(f"_own.{c}").alias(c) for c in own], *[F.coalesce(f, f"_{f}").alias(f) for f in features])


def training_rows(labels: DataFrame, series: DataFrame, block: int = BLOCK) -> DataFrame:
    """symbol, ts, target and all features as of ts, of the labels that are good enough and have enough of the core features.

    ``labels``: symbol, ts, target, quality. Features of the market count for every symbol; they are looked up once a moment.
    """
    labels = labels.where(F.col("quality") >= LEAST_QUALITY).select("symbol", "ts", "target")
    one = [f for f in FEATURES if f not in MARKET]
    of_market = as_of(labels.select(F.lit("MARKET").alias("symbol"), "ts").distinct().withColumn("_k", F.lit(1)), series.where("symbol = 'MARKET'"), MARKET, block).drop("symbol", "_k")
    # cut first: the planner infers constraints from every part of a filter over so many derived columns
    rows = cut(as_of(labels, series.where("symbol <> 'MARKET'"), one, block)).join(cut(of_market), "ts", "left")
    present = sum(F.col(f).isNotNull().cast("int") for f in CORE)
    return rows.where(present / F.lit(len(CORE)) >= LEAST_COVERAGE).select("symbol", "ts", "target", *FEATURES)


def series_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return CATALOG["h59_training_series"].run(spark, sf_dir)


def labels_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, ts, target, quality of every long entry: wins and partial successes count as 1."""
    from tidewater.operators.labels import QUERIES as of

    long = cut(of["y03_barrier_labels"](spark, sf_dir).where("direction = 'long'"))
    return long.select("symbol", "ts", F.col("label").isin("win", "partial_success").cast("int").alias("target"), F.col("label_quality").alias("quality"))


def rows_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The training rows of a folder of tables, kept once a session in the checkpoint folder."""
    kept = spark.sparkContext.__dict__.setdefault("_tidewater_training", {})
    if sf_dir not in kept:
        kept[sf_dir] = cut(training_rows(labels_of(spark, sf_dir), cut(series_of(spark, sf_dir))))
    return kept[sf_dir]


def training_hash(rows: DataFrame, features: list[str], parts: int = 256) -> DataFrame:
    """Digest of a training table: every row's canonical line (moment, label, name=value of each feature in order) is hashed
    where it lies; ranges of rows in order of (ts, symbol) are digested, then their digests in order."""
    value = lambda f: F.concat(F.lit(f"{f}="), F.coalesce(F.col(f).cast("string"), F.lit("")))
    line = F.concat_ws("|", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), "symbol", F.col("target").cast("string"), *[value(f) for f in features])
    day = F.date_format("ts", "yyyy-MM-dd")
    digest = F.transform(F.sort_array(F.collect_list("r")), lambda r: r["h"])
    days = rows.select(day.alias("day"), F.struct("ts", "symbol", F.sha2(line, 256).alias("h")).alias("r")).groupBy("day").agg(F.sha2(F.concat_ws("\n", digest), 256).alias("h"), F.count("*").alias("n"))
    years = days.groupBy(F.substring("day", 1, 4).alias("year")).agg(F.sha2(F.concat_ws("\n", F.transform(F.sort_array(F.collect_list(F.struct("day", "h"))), lambda r: r["h"])), 256).alias("h"), F.sum("n").alias("n"))
    return years.agg(F.sha2(F.concat_ws("\n", F.transform(F.sort_array(F.collect_list(F.struct("year", "h"))), lambda r: r["h"])), 256).alias("dataset_hash"), F.sum("n").alias("rows"))


QUERIES = {
    "y08_training_set": lambda spark, d: training_rows(labels_of(spark, d), cut(series_of(spark, d))),
    "y09_training_hash": lambda spark, d: training_hash(rows_of(spark, d), FEATURES),
}


def _oracle() -> str:
    """Another shape: one as-of join of DuckDB's own for each pair of an entry and a feature, then a pivot."""
    from tidewater.operators.labels import oracle_sql as of_labels

    head = Operator("", "", "SELECT 1 AS z FROM {h}", {"h": CATALOG["h59_training_series"].text, "series": SERIES, **FEEDS}).oracle()
    ctes = head[: head.rindex("SELECT 1 AS z")]
    pairs = ", ".join(f"('{n}', {str(w == 'market').lower()})" for n, w, _ in SPECS)
    core = ", ".join(f"'{f}'" for f in CORE)
    return f"""{ctes.rstrip()},
labelled AS (SELECT symbol, ts, CASE WHEN label IN ('win', 'partial_success') THEN 1 ELSE 0 END AS target, label_quality AS quality FROM ({of_labels()["y03_barrier_labels"]}) q WHERE direction = 'long'),
names AS (SELECT * FROM (VALUES {pairs}) v(feature, of_market)),
asked AS (SELECT symbol, ts, target, feature, CASE WHEN of_market THEN 'MARKET' ELSE symbol END AS whose FROM labelled, names WHERE quality >= {LEAST_QUALITY}),
obs AS (SELECT symbol, ts, feature, max(value) AS value FROM h GROUP BY symbol, ts, feature),
met AS (SELECT a.symbol, a.ts, a.target, a.feature, o.value FROM asked a ASOF LEFT JOIN obs o ON a.whose = o.symbol AND a.feature = o.feature AND a.ts >= o.ts)
SELECT symbol, ts, target, {", ".join(f"max(CASE WHEN feature = '{f}' THEN value END) AS {f}" for f in FEATURES)} FROM met GROUP BY symbol, ts, target
HAVING count(CASE WHEN feature IN ({core}) THEN value END) >= {LEAST_COVERAGE} * {len(CORE)}"""


def oracle_sql() -> dict[str, str]:
    return {"y08_training_set": _oracle()}

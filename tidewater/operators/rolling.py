"""Rolling kernels and bar features (price, volume, volatility, tail risk, liquidity, relative strength, intraday).

Every frame is partitioned by symbol and ordered by time, so one exchange and one sort serve all windows of a query.
Frames count rows, null rows included; the current bar is included unless a comment says otherwise.
"""

from __future__ import annotations

from tidewater.plans.dialect import operator

WINDOWS = (5, 10, 20, 50, 100, 200)
Z_WINDOW = 100
Z_MIN = 10

P = "PARTITION BY symbol ORDER BY ts"


def over(w: int, upto: int = 0) -> str:
    """Frame of the w rows that end ``upto`` rows back (0: at the current row)."""
    end = "CURRENT ROW" if upto == 0 else f"{upto} PRECEDING"
    return f"OVER ({P} ROWS BETWEEN {w - 1 + upto} PRECEDING AND {end})"


def zscore(v: str, w: int = Z_WINDOW, least: int = Z_MIN) -> str:
    o = over(w)
    return f"CASE WHEN {v} IS NOT NULL AND count({v}) {o} >= {least} AND stddev_pop({v}) {o} > 1e-12 THEN ({v} - avg({v}) {o}) / nullif(stddev_pop({v}) {o}, 0.0) END"


def full(agg: str, v: str, w: int) -> str:
    """agg over w rows, null unless all of them have a value."""
    o = over(w)
    return f"CASE WHEN count({v}) {o} = {w} THEN {agg} {o} END"


BARS = f"""
bars AS (
  SELECT *, row_number() OVER ({P}) AS rn, lag(close) OVER ({P}) AS pc, (high + low + close) / 3 AS tp FROM {{candles}}),
rets AS (
  SELECT *, CASE WHEN pc > 0 AND close > 0 THEN ln(close / pc) END AS lr, CASE WHEN pc > 0 THEN close / pc - 1 END AS sr,
         CASE WHEN pc IS NOT NULL THEN greatest(high - low, abs(high - pc), abs(low - pc)) END AS tr,
         CASE WHEN high > low AND volume > 0 THEN (close - low - (high - close)) / nullif(high - low, 0.0) * volume END AS delta
  FROM bars)"""


def bars(name: str, doc: str, select: str, more: str = "", source: str = "rets") -> None:
    operator(name, doc, f"WITH {BARS.strip()}{more}\nSELECT symbol, ts, {select} FROM {source}")


def cols(items: dict[str, str]) -> str:
    return ",\n  ".join(f"@r6({e}) AS {n}" for n, e in items.items())


# 2.4 kernels -----------------------------------------------------------------------------------------------------
bars("k01_rolling_zscore", "Rolling z-score, population deviation, null on flat or short windows.", cols({f"z_{w}": zscore("sr", w, max(10, w // 10)) for w in (20, 50, 100)}))
bars("k02_rolling_minmax", "Rolling position between minimum and maximum.", cols({f"mm_{w}": f"CASE WHEN sr IS NOT NULL AND count(sr) {over(w)} >= 10 THEN @div(sr - min(sr) {over(w)}, max(sr) {over(w)} - min(sr) {over(w)}) END" for w in (20, 100)}))
bars("k03_rolling_robust", "Rolling (value - median) / interquartile range.", cols({f"rb_{w}": f"CASE WHEN sr IS NOT NULL AND count(sr) {over(w)} >= 10 THEN @div(sr - @pct(sr, 0.5) {over(w)}, @pct(sr, 0.75) {over(w)} - @pct(sr, 0.25) {over(w)}) END" for w in (20, 50)}))
bars("k04_percentile_rank", "Share of the window's values at or below the current one.", cols({f"pr_{w}": f"CASE WHEN sr IS NOT NULL AND n_{w} >= 10 THEN CAST(@size(@filter(a_{w}, @L(x) x <= sr)) AS DOUBLE) / n_{w} END" for w in (20, 100)}), ", held AS (SELECT *, " + ", ".join(f"@list_agg(sr) {over(w)} AS a_{w}, count(sr) {over(w)} AS n_{w}" for w in (20, 100)) + " FROM rets WHERE sr IS NOT NULL)", "held")
bars("k05_signed_log", "Signed log1p.", cols({"slog": "sign(sr) * ln(1 + abs(sr))", "slog_delta": "sign(delta) * ln(1 + abs(delta))"}))
bars("k06_winsorize", "Clamp to the 5% and 95% order statistics of the prior bars; passes through while they are few.", cols({"wins_50": "CASE WHEN n < 10 THEN sr ELSE least(greatest(sr, @element(a, CAST(floor(0.05 * (n - 1)) AS INT) + 1)), @element(a, CAST(ceil(0.95 * (n - 1)) AS INT) + 1)) END"}), f", held AS (SELECT *, @sort(@list_agg(sr) {over(50, 1)}) AS a, count(sr) {over(50, 1)} AS n FROM rets WHERE sr IS NOT NULL)", "held")
bars("k08_rolling_slope", "Least-squares slope per bar over a full window.", cols({f"slope_{w}": full("regr_slope(close, rn)", "close", w) for w in (5, 20, 50)}))
bars("k09_rolling_correlation", "Pearson correlation over completely clean windows, clamped.", cols({f"corr_{w}": f"CASE WHEN count(sr * br) {over(w)} = {w} THEN least(1.0, greatest(-1.0, covar_pop(sr, br) {over(w)} / nullif(sqrt(var_pop(sr) {over(w)} * var_pop(br) {over(w)}), 0.0))) END" for w in (20, 60)}), ", ref AS (SELECT ts, close / nullif(lag(close) OVER (PARTITION BY symbol ORDER BY ts), 0.0) - 1 AS br FROM {reference}), joined AS (SELECT rets.*, ref.br FROM rets LEFT JOIN ref USING (ts))", "joined")
bars("k10_trailing_percentile", "Percentile of the current range among the trailing ones.", cols({"tpct_100": "CASE WHEN n >= 20 THEN CAST(@size(@filter(a, @L(x) x <= v)) AS DOUBLE) / n END"}), f", held AS (SELECT *, @list_agg(v) {over(100)} AS a, count(v) {over(100)} AS n FROM (SELECT *, (high - low) / close AS v FROM rets WHERE close > 0) q)", "held")
bars("k11_normalised_companions", "The z companion of raw series, on one shared window.", cols({f"{n}_z": zscore(n) for n in ("sr", "lr", "tr", "delta", "volume")}))
operator("k12_quantile", "Interpolated quantiles of a series.", f"WITH {BARS.strip()}\nSELECT symbol, " + cols({f"q{int(q * 100)}": f"@pct(sr, {q})" for q in (0.05, 0.25, 0.5, 0.75, 0.95)}) + " FROM rets WHERE sr IS NOT NULL GROUP BY symbol")
operator("k13_ema", "Exponential average seeded with the plain average of the first window: one fold over each symbol's ordered closes.", "WITH a AS (SELECT symbol, @transform(@sort(@list_agg(@struct(ts AS ts, close AS c))), @L(x) x.c) AS cs FROM {candles} GROUP BY symbol) SELECT symbol, " + cols({f"ema_{w}": f"@fold(@tail(cs, {w}), @mean_first(cs, {w}), @L(e, x) e + (x - e) * CAST({2 / (w + 1)!r} AS DOUBLE))" for w in (5, 20)}) + " FROM a WHERE @size(cs) >= 20")
bars("k14_window_returns", "Returns over 1, 5 and 20 bars, once 21 closes exist.", cols({f"ret_{k}": f"CASE WHEN rn >= 21 THEN @div(close - lag(close, {k}) OVER ({P}), lag(close, {k}) OVER ({P})) * 100 END" for k in (1, 5, 20)}))
bars("k15_factor_metrics", "Twenty-observation z-score of a level and its one-bar change.", cols({"z20": f"CASE WHEN count(close) {over(20)} < 10 THEN NULL WHEN stddev_pop(close) {over(20)} > 1e-12 THEN (close - avg(close) {over(20)}) / nullif(stddev_pop(close) {over(20)}, 0.0) ELSE 0.0 END", "chg1_pct": "sr * 100"}))
operator("k16_list_slope", "Slope of the last values of each series; 0 for fewer than two.", f"SELECT symbol, @r6(coalesce(regr_slope(close, rn), 0.0)) AS slope FROM (SELECT symbol, close, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS back, row_number() OVER ({P}) AS rn FROM {{candles}}) q WHERE back <= 20 GROUP BY symbol")

# 2.5 price -------------------------------------------------------------------------------------------------------
bars("p01_price_basics", "Log and simple return, gap, true range, daily and intraday range, each with its z companion.", cols({"log_return": "lr", "simple_return": "sr", "gap_pct": "CASE WHEN pc > 0 THEN (open - pc) / nullif(pc, 0.0) * 100 END", "true_range": "tr", "daily_range_pct": "CASE WHEN pc > 0 THEN (high - low) / nullif(pc, 0.0) * 100 END", "intraday_range_pct": "CASE WHEN open > 0 THEN (high - low) / nullif(open, 0.0) * 100 END", "log_return_z": zscore("lr"), "true_range_z": zscore("tr")}))
bars("p02_atr", "Average true range from bar index w.", cols({f"atr_{w}": full("avg(tr)", "tr", w) for w in WINDOWS}))
bars("p03_rolling_high_low", "Rolling extremes and the distance from them.", cols({f"{k}_{w}": f"CASE WHEN rn >= {w} THEN {e} END" for w in WINDOWS for k, e in (("high", f"max(high) {over(w)}"), ("low", f"min(low) {over(w)}"), ("from_high_pct", f"@div(close - max(high) {over(w)}, max(high) {over(w)}) * 100"), ("from_low_pct", f"@div(close - min(low) {over(w)}, min(low) {over(w)}) * 100"))}))
bars("p04_vwap_distance", "Distance from the rolling volume-weighted typical price.", cols({f"vwap_dist_{w}": f"CASE WHEN rn >= {w} THEN (@div(close, @div(sum(tp * volume) {over(w)}, sum(volume) {over(w)})) - 1) * 100 END" for w in WINDOWS}))
bars("p05_momentum", "Momentum and its change from bar to bar.", cols({**{f"mom_{w}": f"mom_{w}" for w in WINDOWS}, **{f"acc_{w}": f"mom_{w} - lag(mom_{w}) OVER ({P})" for w in WINDOWS}}), ", moms AS (SELECT *, " + ", ".join(f"@div(close - lag(close, {w}) OVER ({P}), lag(close, {w}) OVER ({P})) * 100 AS mom_{w}" for w in WINDOWS) + " FROM rets)", "moms")
REF = ", ref AS (SELECT ts, CASE WHEN lag(close) OVER (PARTITION BY symbol ORDER BY ts) > 0 THEN close / nullif(lag(close) OVER (PARTITION BY symbol ORDER BY ts), 0.0) - 1 END AS br FROM {reference}), joined AS (SELECT rets.*, ref.br, CASE WHEN sr IS NOT NULL AND ref.br IS NOT NULL THEN sr END AS ps, CASE WHEN sr IS NOT NULL THEN ref.br END AS pb FROM rets LEFT JOIN ref USING (ts))"
bars("p06_benchmark_return", "Benchmark return at the same time.", "@r6(br) AS bench_return, @r6(sr - br) AS excess_return", REF, "joined")
bars("p07_beta_alpha", "Rolling beta, alpha and correlation over paired returns.", cols({f"{k}_{w}": f"CASE WHEN rn > {w} AND count(ps) {over(w)} >= {max(3, w // 2)} AND var_pop(pb) {over(w)} > 1e-18 THEN {e} END" for w in WINDOWS for k, e in (("beta", f"covar_pop(ps, pb) {over(w)} / nullif(var_pop(pb) {over(w)}, 0.0)"), ("alpha", f"(avg(ps) {over(w)} - covar_pop(ps, pb) {over(w)} / nullif(var_pop(pb) {over(w)}, 0.0) * avg(pb) {over(w)}) * 100"), ("corr", f"covar_pop(ps, pb) {over(w)} / nullif(sqrt(var_pop(ps) {over(w)} * var_pop(pb) {over(w)}), 0.0)"))}), REF, "joined")

# 2.6 volume ------------------------------------------------------------------------------------------------------
MF = ", flow AS (SELECT *, lag(tp) OVER (PARTITION BY symbol ORDER BY ts) AS ptp FROM rets)"
bars("v01_pressure", "Buying and selling pressure and their difference.", cols({"buying": "CASE WHEN high > low AND volume > 0 THEN (close - low) / nullif(high - low, 0.0) * volume END", "selling": "CASE WHEN high > low AND volume > 0 THEN (high - close) / nullif(high - low, 0.0) * volume END", "delta": "delta"}))
bars("v02_obv", "On-balance volume from the second bar.", f"@r6(CASE WHEN rn >= 2 THEN sum(CASE WHEN pc IS NULL THEN 0 ELSE sign(close - pc) * volume END) OVER ({P} ROWS UNBOUNDED PRECEDING) END) AS obv")
bars("v03_ad_line", "Accumulation and distribution, cumulative.", f"@r6(sum(coalesce(delta, 0)) OVER ({P} ROWS UNBOUNDED PRECEDING)) AS ad_line")
bars("v04_volume_stats", "Rolling average volume, spike and trend.", cols({f"{k}_{w}": f"CASE WHEN rn >= {w} THEN {e} END" for w in WINDOWS for k, e in (("vol_avg", f"avg(volume) {over(w)}"), ("vol_spike", f"@div(volume - avg(volume) {over(w)}, stddev_pop(volume) {over(w)})"), ("vol_trend", f"@div(regr_slope(CAST(volume AS DOUBLE), rn) {over(w)}, avg(volume) {over(w)}) * 100"))}))
bars("v05_imbalance_cmf", "Imbalance and money-flow ratio.", cols({f"cmf_{w}": f"CASE WHEN rn >= {w} THEN @div(sum(delta) {over(w)}, sum(volume) {over(w)}) END" for w in WINDOWS}))
bars("v06_rvol", "Volume over the mean of the prior bars.", cols({f"rvol_{w}": f"CASE WHEN rn > {w} THEN @div(volume, avg(volume) {over(w, 1)}) END" for w in WINDOWS}))
bars("v07_mfi", "Money flow index.", cols({f"mfi_{w}": f"CASE WHEN rn > {w} THEN @div(sum(CASE WHEN tp > ptp THEN tp * volume ELSE 0 END) {over(w)}, sum(CASE WHEN tp <> ptp THEN tp * volume ELSE 0 END) {over(w)}) * 100 END" for w in WINDOWS}), MF, "flow")
bars("v08_volume_oscillator", "Short against long average volume.", cols({f"vosc_{w}": f"CASE WHEN rn >= {2 * w} THEN @div(avg(volume) {over(w)} - avg(volume) {over(2 * w)}, avg(volume) {over(2 * w)}) * 100 END" for w in (5, 10, 20, 50, 100)}))
operator("v09_active_symbols", "Symbols with any volume at all.", "SELECT symbol, ts, volume FROM (SELECT *, sum(volume) OVER (PARTITION BY symbol) AS total FROM {candles}) q WHERE total > 0")

# 2.7 volatility --------------------------------------------------------------------------------------------------
bars("w01_volatility", "Historical, realised and rolling volatility.", cols({f"{k}_{w}": f"CASE WHEN count(lr) {over(w)} = {w} THEN {e} END" for w in WINDOWS for k, e in (("hist", f"stddev_pop(lr) {over(w)} * sqrt(252) * 100"), ("realised", f"sqrt(avg(lr * lr) {over(w)} * 252) * 100"), ("roll", f"stddev_pop(sr) {over(w)} * 100"))}))
bars("w02_atr_pct", "Average true range as a share of the close.", cols({f"atr_pct_{w}": f"CASE WHEN count(tr) {over(w)} = {w} THEN @div(avg(tr) {over(w)}, close) * 100 END" for w in WINDOWS}))
bars("w03_expected_move", "Expected move over w bars.", cols({f"exp_move_{w}": f"CASE WHEN count(lr) {over(w)} = {w} THEN close * stddev_pop(lr) {over(w)} * sqrt(252) * sqrt(CAST({w} AS DOUBLE) / 252) END" for w in WINDOWS}))
bars("w04_vix_distance", "Historical volatility against the volatility index at the same time.", cols({f"vix_dist_{w}": f"CASE WHEN count(lr) {over(w)} = {w} THEN stddev_pop(lr) {over(w)} * sqrt(252) * 100 - vix END" for w in (20, 50)}), ", v AS (SELECT ts, close AS vix FROM {reference}), joined AS (SELECT rets.*, vix FROM rets LEFT JOIN v USING (ts))", "joined")
bars("w05_vol_of_vol", "Deviation of rolling volatility.", cols({f"vov_{w}": f"CASE WHEN count(rv_{w}) {over(w)} = {w} THEN stddev_pop(rv_{w}) {over(w)} END" for w in (5, 20, 50)}), ", vols AS (SELECT *, " + ", ".join(f"CASE WHEN count(sr) {over(w)} = {w} THEN stddev_pop(sr) {over(w)} * 100 END AS rv_{w}" for w in (5, 20, 50)) + " FROM rets)", "vols")
bars("w06_vol_regime", "Regime tercile, compression and expansion probability.", "CAST(CASE WHEN 3 * below < n THEN 0 WHEN 3 * below < 2 * n THEN 1 WHEN p IS NOT NULL THEN 2 END AS INT) AS regime, @r6(1 - p) AS compression, @r6(0.1 + 0.8 * (1 - p)) AS expansion_prob", f", vols AS (SELECT *, CASE WHEN count(lr) {over(20)} = 20 THEN round(stddev_pop(lr) {over(20)}, 12) END AS hv FROM rets), held AS (SELECT *, @list_agg(hv) {over(100)} AS a FROM vols), counted AS (SELECT *, @size(@filter(a, @L(x) x IS NOT NULL)) AS n, @size(@filter(a, @L(x) x <= hv)) AS below FROM held), ranked AS (SELECT *, CASE WHEN hv IS NOT NULL AND n >= 10 THEN @div(below, n) END AS p FROM counted)", "ranked")

# 2.8 tail risk ---------------------------------------------------------------------------------------------------
RW = (20, 50, 100)
bars("r01_var_cvar", "Value at risk, its conditional mean and the tail ratio.", cols({f"{k}_{w}": f"CASE WHEN n_{w} = {w} THEN {e} END" for w in RW for k, e in (("var95", f"greatest(0.0, -q05_{w}) * 100"), ("var99", f"greatest(0.0, -q01_{w}) * 100"), ("cvar95", f"@div(@fold(@filter(a_{w}, @L(x) x <= q05_{w}), CAST(0.0 AS DOUBLE), @L(s, x) s + x), @size(@filter(a_{w}, @L(x) x <= q05_{w}))) * -100"), ("tail_ratio", f"@div(abs(q95_{w}), abs(q05_{w}))"))}), ", held AS (SELECT *, " + ", ".join(f"@list_agg(sr) {over(w)} AS a_{w}, count(sr) {over(w)} AS n_{w}, @pct(sr, 0.05) {over(w)} AS q05_{w}, @pct(sr, 0.01) {over(w)} AS q01_{w}, @pct(sr, 0.95) {over(w)} AS q95_{w}" for w in RW) + " FROM rets WHERE sr IS NOT NULL)", "held")
bars("r02_sharpe_sortino", "Downside deviation, Sharpe and Sortino ratios.", cols({f"{k}_{w}": f"CASE WHEN count(sr) {over(w)} = {w} THEN {e} END" for w in WINDOWS for k, e in (("downside", f"sqrt(avg(least(sr, 0.0) * least(sr, 0.0)) {over(w)}) * 100"), ("sharpe", f"@div(avg(sr) {over(w)}, stddev_pop(sr) {over(w)}) * sqrt(252)"), ("sortino", f"@div(avg(sr) {over(w)}, sqrt(avg(least(sr, 0.0) * least(sr, 0.0)) {over(w)})) * sqrt(252)"))}))
M2 = "greatest(avg(sr * sr) {o} - avg(sr) {o} * avg(sr) {o}, 0.0)"
bars("r03_skew_kurtosis", "Population skewness and excess kurtosis.", cols({f"{k}_{w}": f"CASE WHEN count(sr) {over(w)} = {w} THEN {e.format(o=over(w))} END" for w in RW for k, e in (("skew", "@div(avg(sr * sr * sr) {o} - 3 * avg(sr) {o} * avg(sr * sr) {o} + 2 * power(avg(sr) {o}, 3), power(" + M2 + ", 1.5))"), ("kurt", "@div(avg(sr * sr * sr * sr) {o} - 4 * avg(sr) {o} * avg(sr * sr * sr) {o} + 6 * power(avg(sr) {o}, 2) * avg(sr * sr) {o} - 3 * power(avg(sr) {o}, 4), power(" + M2 + ", 2)) - 3"))}))
DD = "@fold(a_{w}, @struct(CAST(0.0 AS DOUBLE) AS p, CAST(0.0 AS DOUBLE) AS m, CAST(0.0 AS DOUBLE) AS c, CAST(0.0 AS DOUBLE) AS q), @L(s, x) @struct(greatest(s.p, x) AS p, greatest(s.m, 1 - x / greatest(s.p, x)) AS m, 1 - x / greatest(s.p, x) AS c, s.q + (1 - x / greatest(s.p, x)) * (1 - x / greatest(s.p, x)) AS q))"
DDW = (20, 50)
bars("r04_drawdown", "Largest and current drawdown and Ulcer index; the peak restarts with each window.", cols({f"{k}_{w}": f"CASE WHEN rn > {w} THEN {e} END" for w in DDW for k, e in (("max_dd", f"d_{w}.m * 100"), ("cur_dd", f"d_{w}.c * 100"), ("ulcer", f"sqrt(d_{w}.q / {w + 1}) * 100"))}), ", held AS (SELECT *, " + ", ".join(f"@list_agg(close) {over(w + 1)} AS a_{w}" for w in DDW) + " FROM rets WHERE close > 0), folded AS (SELECT *, " + ", ".join(f"{DD.replace('{w}', str(w))} AS d_{w}" for w in DDW) + " FROM held)", "folded")
bars("r05_calmar", "Mean return over largest drawdown.", cols({f"calmar_{w}": f"CASE WHEN rn > {w} THEN @div(avg_{w} * 252, d_{w}.m) END" for w in DDW}), ", held AS (SELECT *, " + ", ".join(f"@list_agg(close) {over(w + 1)} AS a_{w}, avg(sr) {over(w)} AS avg_{w}" for w in DDW) + " FROM rets WHERE close > 0), folded AS (SELECT *, " + ", ".join(f"{DD.replace('{w}', str(w))} AS d_{w}" for w in DDW) + " FROM held)", "folded")

# 2.9 liquidity ---------------------------------------------------------------------------------------------------
QUOTE = """q AS (
  SELECT symbol, ts, CASE WHEN bid > 0 AND bid <= ask THEN ask - bid END AS spread, CASE WHEN bid > 0 AND bid <= ask THEN @div(ask - bid, (bid + ask) / 2) * 100 END AS spread_pct,
         CASE WHEN bid_depth > 0 AND ask_depth > 0 THEN @div(bid_depth - ask_depth, bid_depth + ask_depth) END AS imbalance, CASE WHEN bid_depth > 0 AND ask_depth > 0 THEN bid_depth + ask_depth END AS depth,
         CASE WHEN bid > 0 AND bid <= ask AND bid_depth + ask_depth > 0 THEN @div(ask - bid, bid + ask) * 100 * (1 + @div(1000, bid_depth + ask_depth)) END AS impact FROM {quotes}),
h AS (SELECT *, @list_agg(depth) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS depths, count(depth) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS n FROM q),
p AS (SELECT *, CASE WHEN n >= 10 AND depth IS NOT NULL THEN @div(@size(@filter(depths, @L(x) x <= depth)), n) END AS depth_pct FROM h),
s AS (SELECT *, 0.4 * greatest(0.0, 1 - spread_pct / 1.0) + 0.3 * depth_pct + 0.3 * greatest(0.0, 1 - impact / 0.5) AS raw FROM p)"""
operator("l01_quote_features", "Spread, imbalance, depth and impact of quotes.", f"WITH {QUOTE} SELECT symbol, ts, " + cols({k: k for k in ("spread", "spread_pct", "imbalance", "depth", "impact")}) + " FROM q")
operator("l02_liquidity_score", "Tightness, depth and impact in one score.", f"WITH {QUOTE} SELECT symbol, ts, @r6(raw * 100) AS liquidity_score FROM s")
operator("l03_spread_trend", "Average spread and slope of the score over full windows.", f"WITH {QUOTE}, n AS (SELECT *, row_number() OVER ({P}) AS rn FROM s) SELECT symbol, ts, " + cols({**{f"avg_spread_{w}": full("avg(spread_pct)", "spread_pct", w) for w in (5, 20)}, **{f"score_slope_{w}": full("regr_slope(raw * 100, CAST(rn AS DOUBLE))", "raw", w) for w in (5, 20)}}) + " FROM n")
bars("l04_turnover", "Close times volume where both are positive.", "@r6(CASE WHEN close > 0 AND volume > 0 THEN close * volume END) AS turnover")
operator("l05_delivery_pct", "Last delivery observation of each session date.", "SELECT l_returnflag AS symbol, CAST(l_shipdate AS DATE) AS session, @r6(max_by(l_discount * 100, l_orderkey * 10 + l_linenumber)) AS delivery_pct FROM {lineitem} GROUP BY l_returnflag, CAST(l_shipdate AS DATE)")

# 2.10 relative strength ------------------------------------------------------------------------------------------
REL = ", r AS (SELECT ts, close AS rclose FROM {reference}), peers AS (SELECT ts, sum(ln(close)) AS s, count(*) AS n FROM {candles} WHERE close > 0 GROUP BY ts), rel AS (SELECT rets.*, CASE WHEN close > 0 AND rclose > 0 THEN ln(close) - ln(rclose) END AS x, CASE WHEN close > 0 AND peers.n > 1 THEN ln(close) - (peers.s - ln(close)) / (peers.n - 1) END AS px FROM rets LEFT JOIN r USING (ts) LEFT JOIN peers USING (ts))"
bars("x01_reference_alignment", "Log ratio to a reference at the same time.", "@r6(x) AS log_ratio", REL, "rel")
bars("x02_peer_basket", "Log ratio to the equal-weight basket of the other symbols.", "@r6(px) AS peer_log_ratio", REL, "rel")
bars("x03_relative_strength", "Strength, momentum and volatility ratio to a reference.", cols({f"{k}_{w}": e for w in (5, 20, 50) for k, e in (("strength", f"(px - lag(px, {w}) OVER ({P})) * 100"), ("rmom", f"CASE WHEN count(px) {over(w)} = {w} THEN regr_slope(px, CAST(rn AS DOUBLE)) {over(w)} * 100 END"), ("rvol", f"CASE WHEN count(lr) {over(w)} = {w} THEN stddev_pop(lr) {over(w)} * 100 END"))}), REL, "rel")
operator("x04_relative_volume", "Average volume against the mean of the peers' averages.", f"WITH a AS (SELECT symbol, ts, CASE WHEN count(CASE WHEN volume > 0 THEN 1 END) {over(20)} = 20 THEN avg(volume) {over(20)} END AS va FROM {{candles}}), g AS (SELECT ts, sum(va) AS s, count(va) AS n FROM a GROUP BY ts) SELECT symbol, ts, @r6(CASE WHEN va IS NOT NULL AND n > 1 THEN @div(va, (s - va) / (n - 1)) END) AS rel_volume_20 FROM a JOIN g USING (ts)")
operator("x05_return_rank", "Percentile rank of the 20-bar return among all symbols.", f"WITH a AS (SELECT symbol, ts, CASE WHEN close > 0 AND lag(close, 20) OVER ({P}) > 0 THEN ln(close) - ln(lag(close, 20) OVER ({P})) END AS r FROM {{candles}}) SELECT symbol, ts, @r6(CASE WHEN count(*) OVER (PARTITION BY ts) >= 2 THEN cume_dist() OVER (PARTITION BY ts ORDER BY r) * 100 END) AS rank_pct FROM a WHERE r IS NOT NULL")
bars("x06_outperformance", "Mean squashed strength over the references that exist.", "@r6(CASE WHEN a IS NOT NULL OR b IS NOT NULL THEN 50 * (1 + (coalesce(tanh(a / 5), 0) + coalesce(tanh(b / 5), 0)) / ((CASE WHEN a IS NULL THEN 0 ELSE 1 END) + (CASE WHEN b IS NULL THEN 0 ELSE 1 END))) END) AS outperformance", REL + f", st AS (SELECT *, (x - lag(x, 20) OVER ({P})) * 100 AS a, (px - lag(px, 20) OVER ({P})) * 100 AS b FROM rel)", "st")
operator("x07_equity_watchlist", "Symbols that are not references.", "SELECT DISTINCT c.symbol FROM {candles} c WHERE NOT EXISTS (SELECT 1 FROM (SELECT 'view' AS symbol) i WHERE i.symbol = c.symbol)")

# 2.11 structure: the parts that are frames -----------------------------------------------------------------------
bars("m01_fractal_swings", "Fractal pivots, visible from their confirmation two bars later.", f"lag(hi, 2) OVER ({P}) AS swing_high, lag(lo, 2) OVER ({P}) AS swing_low", f", piv AS (SELECT *, CASE WHEN count(*) OVER ({P} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) = 5 AND high = max(high) OVER ({P} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) THEN 1 ELSE 0 END AS hi, CASE WHEN count(*) OVER ({P} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) = 5 AND low = min(low) OVER ({P} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) THEN 1 ELSE 0 END AS lo FROM rets)", "piv")
bars("m07_order_block", "Distance to the middle of the last opposite bar before a close-to-close impulse of more than one average true range.", "@r6(@div(close - block, block) * 100) AS order_block_pct", f", imp AS (SELECT *, close - pc AS impulse, {full('avg(tr)', 'tr', 14)} AS atr, sign(pc - lag(open) OVER ({P})) AS before, (lag(high) OVER ({P}) + lag(low) OVER ({P})) / 2 AS middle FROM rets), blk AS (SELECT *, @last_nn(CASE WHEN (impulse > atr AND before < 0) OR (impulse < -atr AND before > 0) THEN middle END) OVER ({P} ROWS UNBOUNDED PRECEDING) AS block FROM imp)", "blk")
SESSION = "d AS (SELECT *, CAST(@ist(ts) AS DATE) AS session, row_number() OVER (PARTITION BY symbol, CAST(@ist(ts) AS DATE) ORDER BY ts) AS k, (high + low + close) / 3 AS tp FROM {candles})"
operator("m09_session_features", "Session price bands, opening range and initial balance.", f"WITH {SESSION}, g AS (SELECT symbol, session, count(*) AS n, @div(sum(tp * volume), sum(volume)) AS vwap, @div(sum(tp * tp * volume), sum(volume)) AS v2, max(CASE WHEN k <= 3 THEN high END) AS or_high, min(CASE WHEN k <= 3 THEN low END) AS or_low, max(CASE WHEN k <= 12 THEN high END) AS ib_high, min(CASE WHEN k <= 12 THEN low END) AS ib_low, sum(CASE WHEN close > open THEN volume WHEN close < open THEN -volume ELSE 0 END) AS net, sum(volume) AS vol FROM d GROUP BY symbol, session) SELECT symbol, session, " + cols({"vwap": "vwap", "band_up": "vwap + sqrt(greatest(0.0, v2 - vwap * vwap))", "band_down": "vwap - sqrt(greatest(0.0, v2 - vwap * vwap))", "or_high": "or_high", "or_low": "or_low", "ib_high": "ib_high", "ib_low": "ib_low", "auction_imbalance": "@div(net, vol)"}) + " FROM g WHERE n >= 15")
operator("m10_volume_profile", "Thirty-bin volume profile of each session: bins and point of control.", f"WITH {SESSION}, r AS (SELECT symbol, session, min(low) AS lo, max(high) AS hi FROM d GROUP BY symbol, session HAVING count(*) >= 15), b AS (SELECT d.symbol, d.session, least(29, CAST(floor(@div(close - lo, (hi - lo) / 30)) AS INT)) AS bin, sum(volume) AS v FROM d JOIN r ON d.symbol = r.symbol AND d.session = r.session WHERE hi > lo GROUP BY 1, 2, 3) SELECT symbol, session, CAST(max_by(bin, v * 100 - bin) AS INT) AS poc_bin, CAST(sum(v) AS BIGINT) AS volume, count(*) AS used_bins FROM b GROUP BY symbol, session")
operator("m11_session_rows", "Complete sessions: fifteen bars or more.", f"WITH {SESSION} SELECT symbol, session, count(*) AS bars, @r6(min_by(open, ts)) AS open, @r6(max_by(close, ts)) AS close FROM d GROUP BY symbol, session HAVING count(*) >= 15")

# 2.12 intraday risk ----------------------------------------------------------------------------------------------
S = "PARTITION BY symbol, session ORDER BY ts"
RUN = f"OVER ({S} ROWS UNBOUNDED PRECEDING)"
INTRA = f"{SESSION}, e AS (SELECT *, first_value(open) {RUN} AS so, max(close) {RUN} AS peak, ln(close / nullif(lag(close) OVER ({S}), 0.0)) AS r FROM d WHERE close > 0), f AS (SELECT *, 1 - close / peak AS dd, stddev_pop(r) {RUN} AS sd, count(r) {RUN} AS n FROM e)"
operator("i01_session_move", "Bars elapsed and move from the open.", f"WITH {INTRA} SELECT symbol, ts, CAST(k AS BIGINT) AS bars, @r6(@div(close - so, so) * 100) AS move_from_open FROM f")
operator("i02_session_drawdown", "Current and running largest drawdown from the session's highest close.", f"WITH {INTRA} SELECT symbol, ts, @r6(dd * 100) AS dd, @r6(max(dd) {RUN} * 100) AS max_dd FROM f")
operator("i03_session_risk", "Realised volatility, expected move and Gaussian value at risk to a horizon and to the session's end.", f"WITH {INTRA} SELECT symbol, ts, " + cols({"rv": "CASE WHEN n >= 3 THEN sd * 100 END", "exp_move_next": "CASE WHEN n >= 3 THEN close * sd END", "exp_move_rest": "CASE WHEN n >= 3 THEN close * sd * sqrt(greatest(0, 24 - k)) END", "var95_next": "CASE WHEN n >= 3 THEN 1.6449 * sd * 100 END", "var95_rest": "CASE WHEN n >= 3 THEN 1.6449 * sd * sqrt(greatest(0, 24 - k)) * 100 END"}) + " FROM f")

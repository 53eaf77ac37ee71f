"""Intelligence scoring: the latest wide feature row to levels, confidences and state distributions.

Every component is one projection over a symbol's latest row: missing terms are skipped and weights renormalised over the
terms present, so missing data is neutral. Scores are 50 + 50 * level unless stated, clamped to 0..100.
"""

from __future__ import annotations

from tidewater.operators.rolling import BARS, P, cols, over
from tidewater.plans.dialect import operator


def c01(x: str) -> str:
    return f"least(1.0, greatest(0.0, {x}))"


def c11(x: str) -> str:
    return f"least(1.0, greatest(-1.0, {x}))"


def wavg(terms: list[tuple[float, str]]) -> str:
    """Weighted mean over the terms that aren't null; null if none is."""
    top = " + ".join(f"coalesce(CAST({w} AS DOUBLE) * ({e}), 0)" for w, e in terms)
    low = " + ".join(f"CASE WHEN ({e}) IS NULL THEN 0 ELSE CAST({w} AS DOUBLE) END" for w, e in terms)
    return f"(({top}) / nullif({low}, 0.0))"


def mean(*terms: str) -> str:
    return wavg([(1.0, t) for t in terms])


def score(level: str) -> str:
    return f"least(100.0, greatest(0.0, 50 + 50 * coalesce({level}, 0)))"


def states(items: dict[str, str]) -> dict[str, str]:
    """Evidence to a distribution: non-negative shares, uniform if nothing speaks."""
    total = " + ".join(f"greatest(0.0, coalesce({e}, 0))" for e in items.values())
    return {f"s_{k}": f"CASE WHEN ({total}) > 0 THEN greatest(0.0, coalesce({e}, 0)) / ({total}) ELSE 1.0 / {len(items)} END" for k, e in items.items()}


def anchors(level: str, at: dict[str, float], band: float) -> dict[str, str]:
    """Triangular membership around anchors."""
    return {k: f"greatest(0.0, 1 - abs({level} - {a}) / {band})" for k, a in at.items()}


#: The latest row of each symbol with what the components read.
WIDE = f"""{BARS.strip()},
w AS (SELECT *, {", ".join(f"@div(close - lag(close, {w}) OVER ({P}), lag(close, {w}) OVER ({P})) * 100 AS mom_{w}" for w in (5, 20, 50))},
  {", ".join(f"stddev_pop(lr) {over(w)} * 100 AS hv_{w}" for w in (5, 20, 50))}, @div(volume, avg(volume) {over(20, 1)}) AS rvol,
  @div(sum(delta) {over(20)}, sum(volume) {over(20)}) AS cmf, @div(close - min(low) {over(20)}, max(high) {over(20)} - min(low) {over(20)}) AS pos,
  (CASE WHEN stddev_pop(sr) {over(100)} > 0 THEN (sr - avg(sr) {over(100)}) / nullif(stddev_pop(sr) {over(100)}, 0.0) END) AS z,
  row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS back FROM rets),
latest AS (SELECT *, {mean("tanh(mom_5 / 3)", "tanh(mom_20 / 6)", "tanh(mom_50 / 10)")} AS lean, {c01("@div(hv_5, hv_50) / 2")} AS vol_level FROM w WHERE back = 1)"""


def component(name: str, doc: str, level: str, confidence: str, evidence: dict[str, str], scored: str | None = None) -> None:
    operator(name, doc, f"WITH {WIDE}, v AS (SELECT *, {level} AS level FROM latest) SELECT symbol, ts, " + cols({"level": "level", "score": scored or score("level"), "confidence": c01(confidence), **states(evidence)}) + " FROM v")


operator("n01_normalise_states", "Evidence to a distribution; uniform when nothing speaks.", "WITH e AS (SELECT symbol, ts, close - open AS up, open - close AS down, high - low - abs(close - open) AS flat FROM {candles}) SELECT symbol, ts, " + cols(states({"up": "up", "down": "down", "flat": "flat"})) + " FROM e")
operator("n02_clamp_sign", "Clamp and sign helpers.", "SELECT symbol, ts, @r6(least(60.0, greatest(20.0, close))) AS clamped, CAST(sign(close - open) AS INT) AS direction FROM {candles}")
operator("n03_intraday_signals", "Direction and reversal signals of the session.", "WITH s AS (SELECT *, first_value(open) OVER (PARTITION BY symbol, @date(@ist(ts)) ORDER BY ts ROWS UNBOUNDED PRECEDING) AS so, max(close) OVER (PARTITION BY symbol, @date(@ist(ts)) ORDER BY ts ROWS UNBOUNDED PRECEDING) AS peak FROM {candles}) SELECT symbol, ts, @r6(tanh(@div(close - so, so) * 100 / 2)) AS direction, @r6(least(1.0, @div(peak - close, peak) * 100 / 1.5)) AS reversal FROM s")
operator("n04_level_weights", "Triangular membership around level anchors.", "WITH v AS (SELECT symbol, ts, @div(close - min(close) OVER (PARTITION BY symbol), max(close) OVER (PARTITION BY symbol) - min(close) OVER (PARTITION BY symbol)) AS level FROM {candles}) SELECT symbol, ts, " + cols(anchors("level", {"low": 0.0, "fair": 0.25, "mid": 0.5, "high": 0.75, "top": 1.0}, 0.3)) + " FROM v")
operator("n09_sectors", "Sector leaders, laggards and leadership flips against the snapshot before.", "WITH s AS (SELECT label AS sector, @date(ts) AS day, avg(value) AS heat FROM {observations} WHERE value IS NOT NULL GROUP BY label, @date(ts)), r AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY heat DESC, sector) AS rank, count(*) OVER (PARTITION BY day) AS n FROM s), f AS (SELECT *, lag(rank) OVER (PARTITION BY sector ORDER BY day) AS prank FROM r) SELECT sector, day, CASE WHEN rank <= least(3, @idiv(n, 2)) THEN 'leader' WHEN rank > n - least(3, @idiv(n, 2)) THEN 'laggard' ELSE 'middle' END AS place, CASE WHEN (rank <= 2) <> (prank <= 2) THEN 1 ELSE 0 END AS flipped FROM f")
component("n10_structure", "Market structure: bias and Wyckoff-like states.", c11("(pos - 0.5) * 2"), "0.2 + 0.6 * CASE WHEN pos IS NULL THEN 0 ELSE 1 END", {"markup": "level * (1 - vol_level)", "markdown": "-level * (1 - vol_level)", "accumulation": "(1 - abs(level)) * coalesce(cmf, 0)", "distribution": "(1 - abs(level)) * -coalesce(cmf, 0)", "sweep": "0.5 * vol_level * (1 - abs(level))"})
operator("n11_relative_strength", "Relative strength: mean squashed strength over references, and leadership rank.", f"WITH {WIDE}, m AS (SELECT avg(mom_20) AS base FROM latest), v AS (SELECT latest.*, tanh((mom_20 - base) / 5) AS level FROM latest JOIN m ON 1 = 1) SELECT symbol, ts, " + cols({"level": "level", "score": score("level"), **states({"outperforming": "level", "underperforming": "-level", "inline": "1 - abs(level)"})}) + ", CAST(row_number() OVER (ORDER BY level DESC, symbol) AS INT) AS rank FROM v")
CHAINS = "c AS (SELECT p_brand AS chain, @div(sum(CASE WHEN p_partkey % 2 = 1 THEN 1 + p_partkey % 11 ELSE 0 END), sum(CASE WHEN p_partkey % 2 = 0 THEN 1 + p_partkey % 13 ELSE 0 END)) AS pcr, avg(p_size) - 25 AS max_pain, @div(avg(p_retailprice) - 900, 2000) AS iv_rank FROM {part} GROUP BY p_brand)"
operator("n12_options", "Options: weighted level of positioning, ratio and max pain.", f"WITH {CHAINS}, v AS (SELECT *, {wavg([(0.4, c11('iv_rank - 0.5')), (0.3, c11('1 - pcr')), (0.3, c11('max_pain / 10'))])} AS level FROM c) SELECT chain, " + cols({"level": "level", "score": score("level"), "confidence": c01("0.3 + 0.5 + 0.2"), **states({"bullish": "level", "bearish": "-level", "iv_high": "(iv_rank - 0.5) * 2", "iv_low": "(0.5 - iv_rank) * 2", "neutral": "1 - abs(level)"})}) + " FROM v")
operator("n13_macro", "Macro: mean factor score, agreement of signs and conviction.", f"WITH {WIDE}, m AS (SELECT avg(lean) AS level, avg(abs(lean)) AS conv, count(lean) AS n FROM latest), a AS (SELECT avg(CASE WHEN sign(lean) = sign(level) THEN 1 ELSE 0 END) AS cons FROM latest JOIN m ON 1 = 1 WHERE lean IS NOT NULL) SELECT " + cols({"level": "level", "score": score("level"), "confidence": c01("0.2 + 0.3 * n / 14 + 0.5 * cons"), **states({"risk_on": "CASE WHEN level > 0 THEN least(1.0, conv / 0.3) * cons END", "risk_off": "CASE WHEN level < 0 THEN least(1.0, conv / 0.3) * cons END", "neutral": "1 - least(1.0, conv / 0.3)"})}) + " FROM m JOIN a ON 1 = 1")
operator("n14_event_risk", "Event risk: weighted level of sensitivity, nearness and volatility, with anchors.", f"WITH e AS (SELECT event_id, 1 + event_id % 3 AS vol, event_id % 48 AS hours, @div(event_id % 10, 10) AS sens FROM {{events}}), v AS (SELECT *, {wavg([(0.5, 'sens'), (0.3, c01('1 - CAST(hours AS DOUBLE) / 48')), (0.2, c01('(CAST(vol AS DOUBLE) - 1) / 4'))])} AS level FROM e) SELECT event_id, " + cols({"level": "level", "score": "100 * level", **states(anchors("level", {"calm": 0.0, "watch": 0.4, "high": 0.7, "freeze": 0.9}, 0.3))}) + " FROM v")
operator("n15_institutional_flow", "Institutional flow: weighted level, accumulation and distribution.", f"WITH f AS (SELECT c.c_mktsegment AS segment, @div(sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE -o_totalprice END), sum(o_totalprice)) AS a, @div(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE -1 END), count(*)) AS b FROM {{orders}} o JOIN {{customer}} c ON o.o_custkey = c.c_custkey GROUP BY c.c_mktsegment), v AS (SELECT *, {wavg([(0.3, 'a'), (0.2, 'b')])} AS level FROM f) SELECT segment, " + cols({"level": "level", "score": score("level"), "confidence": c01("0.2 + 0.35 * 2 / 6 + 0.3 * CASE WHEN sign(a) = sign(b) THEN 1 ELSE 0 END"), **states({"accumulation": "level", "distribution": "-level", "neutral": "1 - abs(level)"})}) + " FROM v")
operator("n16_liquidity", "Liquidity: execution risk, stress and churn states.", f"WITH q AS (SELECT symbol, avg(@div(ask - bid, (ask + bid) / 2)) AS spread, avg(abs(@div(bid_depth - ask_depth, bid_depth + ask_depth))) AS imb FROM {{quotes}} GROUP BY symbol), v AS (SELECT *, {c01('1 - spread * 5')} AS level, 0.45 * {c01('spread * 5')} + 0.35 * imb AS stress FROM q) SELECT symbol, " + cols({"score": "100 * level", "stress": "stress", "confidence": c01("0.2 + 0.4 - 0.15 * stress"), **states({**anchors("level", {"illiquid": 0.0, "thin": 0.25, "normal": 0.6, "deep": 0.9}, 0.3), "stressed": "0.5 * stress", "one_sided": "0.5 * (1 - level) * imb"})}) + " FROM v")
DAILY = "d AS (SELECT symbol, @date(@ist(ts)) AS day, max_by(close, ts) AS c FROM {candles} GROUP BY symbol, @date(@ist(ts))), r AS (SELECT symbol, day, ln(c / lag(c) OVER (PARTITION BY symbol ORDER BY day)) AS r, row_number() OVER (PARTITION BY symbol ORDER BY day DESC) AS back FROM d WHERE c > 0)"
operator("n17_cross_correlation", "Pairwise correlation of daily returns over two spans, with stability.", f"WITH {DAILY}, p AS (SELECT a.symbol AS x, b.symbol AS y, a.day, a.r AS ra, b.r AS rb, a.back FROM r a JOIN r b ON a.day = b.day AND a.symbol < b.symbol WHERE a.r IS NOT NULL AND b.r IS NOT NULL), c AS (SELECT x, y, covar_pop(CASE WHEN back <= 20 THEN ra END, CASE WHEN back <= 20 THEN rb END) / nullif(sqrt(var_pop(CASE WHEN back <= 20 THEN ra END) * var_pop(CASE WHEN back <= 20 THEN rb END)), 0.0) AS r20, covar_pop(CASE WHEN back <= 60 THEN ra END, CASE WHEN back <= 60 THEN rb END) / nullif(sqrt(var_pop(CASE WHEN back <= 60 THEN ra END) * var_pop(CASE WHEN back <= 60 THEN rb END)), 0.0) AS r60 FROM p GROUP BY x, y) SELECT x, y, " + cols({"r_short": "r20", "r_long": "r60", "stability": f"1 - {c01('abs(r20 - r60) / 0.5')}"}) + ", CASE WHEN abs(r20 - r60) >= 0.4 THEN 1 ELSE 0 END AS breakdown FROM c")
DOT = "@fold(@transform(@seq(1, @size({a})), @L(i) CAST(@element({a}, CAST(i AS INT)) AS DOUBLE) * CAST(@element({b}, CAST(i AS INT)) AS DOUBLE)), CAST(0.0 AS DOUBLE), @L(s, x) s + x)"
SQD = "@fold(@transform(@seq(1, @size({a})), @L(i) power(CAST(@element({a}, CAST(i AS INT)) AS DOUBLE) - CAST(@element({b}, CAST(i AS INT)) AS DOUBLE), 2)), CAST(0.0 AS DOUBLE), @L(s, x) s + x)"


def dot(a: str, b: str) -> str:
    return DOT.replace("{a}", a).replace("{b}", b)


PAIRS = "q AS (SELECT vec_id AS qid, embedding AS qe FROM {embeddings} WHERE vec_id % 100 = 0), p AS (SELECT qid, vec_id, qe, embedding AS e, label FROM q JOIN {embeddings} ON vec_id <> qid)"
operator("n18_historical_analogs", "Nearest historical states by cosine, with the outcome of their labels.", f"WITH {PAIRS}, s AS (SELECT qid, vec_id, label, {dot('qe', 'e')} / nullif(sqrt({dot('qe', 'qe')} * {dot('e', 'e')}), 0.0) AS cs FROM p), k AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY cs DESC, vec_id) AS rank FROM s) SELECT qid, " + cols({"best": "max(cs)", "mean": "avg(cs)", "win_rate": "avg(CASE WHEN label >= 5 THEN 1 ELSE 0 END)"}) + ", count(*) AS n FROM k WHERE rank <= 20 GROUP BY qid")
operator("n19_cosine", "Cosine similarity, clamped; null on a zero norm.", f"WITH {PAIRS} SELECT qid, vec_id, @r6({c11(dot('qe', 'e') + ' / nullif(sqrt(' + dot('qe', 'qe') + ' * ' + dot('e', 'e') + '), 0.0)')}) AS cosine FROM p")
operator("n20_euclidean", "Euclidean distance.", f"WITH {PAIRS} SELECT qid, vec_id, @r6(sqrt({SQD.replace('{a}', 'qe').replace('{b}', 'e')})) AS distance FROM p")
operator("n22_path_outcomes", "Return, deviation, largest fall and rise over the next twenty bars.", f"WITH {BARS.strip()}, f AS (SELECT symbol, ts, close, count(lr) OVER ({P} ROWS BETWEEN 1 FOLLOWING AND 20 FOLLOWING) AS n, stddev_pop(lr) OVER ({P} ROWS BETWEEN 1 FOLLOWING AND 20 FOLLOWING) AS sd, lead(close, 20) OVER ({P}) AS c20, min(close) OVER ({P} ROWS BETWEEN 1 FOLLOWING AND 20 FOLLOWING) AS lo, max(close) OVER ({P} ROWS BETWEEN 1 FOLLOWING AND 20 FOLLOWING) AS hi FROM rets WHERE close > 0) SELECT symbol, ts, " + cols({"ret": "@div(c20 - close, close)", "vol": "sd", "fall": "least(0.0, @div(lo - close, close))", "rise": "greatest(0.0, @div(hi - close, close))"}) + " FROM f WHERE n = 20")
operator("n23_bayesian_update", "Belief of an up state: an ordered fold over evidence, the weight clamped.", "WITH e AS (SELECT symbol, @transform(@sort(@list_agg(@struct(ts AS ts, CASE WHEN close > open THEN CAST(0.8 AS DOUBLE) ELSE CAST(0.2 AS DOUBLE) END AS l))), @L(x) x.l) AS ls FROM {candles} GROUP BY symbol) SELECT symbol, @r6(@fold(ls, CAST(0.5 AS DOUBLE), @L(p, l) p * CAST(0.7 AS DOUBLE) + l * CAST(0.3 AS DOUBLE))) AS belief FROM e".replace("@fold(ls, CAST(0.5 AS DOUBLE)", "@fold(ls, CAST(0.5 AS DOUBLE)"))
operator("n24_state_changes", "Rows whose states differ from the row before.", "SELECT symbol, ts, close FROM (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY ts) AS pc FROM {candles}) q WHERE pc IS NULL OR abs(close - pc) > 0.000000001")
operator("n25_regime_transition", "Closeness of the two leading states, its slope and an alert.", f"WITH e AS (SELECT symbol, ts, greatest(close - open, 0.0) AS up, greatest(open - close, 0.0) AS down, row_number() OVER ({P}) AS rn FROM {{candles}}), c AS (SELECT *, 1 - abs(@div(up - down, up + down + 1)) AS closeness FROM e), s AS (SELECT *, regr_slope(closeness, CAST(rn AS DOUBLE)) {over(20)} AS slope, count(*) {over(20)} AS n FROM c), v AS (SELECT *, 0.6 * closeness + 0.4 * {c01('greatest(slope, 0.0) / 0.05')} AS prob FROM s WHERE n = 20) SELECT symbol, ts, @r6(prob) AS prob, CASE WHEN prob >= 0.6 THEN 1 ELSE 0 END AS alert, " + cols(states(anchors("0.4 * prob", {"stable": 0.0, "shifting": 0.5, "turning": 1.0}, 0.4))) + " FROM v")
component("n26_composite", "Composite: mean lean, stability and opportunity.", mean("lean", "(pos - 0.5) * 2", "cmf"), "0.4 * 3 / 12 + 0.6 * abs(lean)", anchors("(level + 1) / 2", {"bear": 0.0, "weak": 0.25, "neutral": 0.5, "firm": 0.75, "bull": 1.0}, 0.3), "100 * abs(level) * (1 - vol_level)")
component("n27_market_confidence", "Market confidence: mean of the present inputs, graded.", mean("abs(lean)", "1 - vol_level", "pos"), "0.6 + 0.4", anchors("level", {"low": 0.0, "fair": 0.5, "high": 1.0}, 0.4), "100 * level")
operator("n28_confidence_interval", "Interval of a score by its confidence.", f"WITH {WIDE} SELECT symbol, " + cols({"low": f"greatest(0.0, {score('lean')} - 30 * (1 - abs(lean)))", "high": f"least(100.0, {score('lean')} + 30 * (1 - abs(lean)))"}) + " FROM latest")
operator("n29_explanations", "Newest explanation rows of each component.", "SELECT source AS component, id, label FROM (SELECT *, row_number() OVER (PARTITION BY source, label ORDER BY id DESC) AS k FROM {observations}) q WHERE k = 1")
operator("n30_state_report", "Leading state per component; the first key wins ties.", "WITH e AS (SELECT symbol, ts, CASE WHEN close > open AND close - open >= high - low - abs(close - open) THEN 'bull' WHEN open > close AND open - close >= high - low - abs(close - open) THEN 'bear' ELSE 'range' END AS regime FROM {candles}) SELECT symbol, regime, count(*) AS n FROM e GROUP BY symbol, regime")
operator("n31_report_as_of", "Report as of a moment.", "SELECT symbol, max_by(close, ts) AS close, max(ts) AS ts FROM {candles} WHERE ts <= (SELECT min(ts) + INTERVAL 10 DAYS FROM {candles}) GROUP BY symbol")
operator("n32_intraday_relative", "Move from the open against the benchmark's.", "WITH s AS (SELECT symbol, ts, close, first_value(open) OVER (PARTITION BY symbol, @date(@ist(ts)) ORDER BY ts ROWS UNBOUNDED PRECEDING) AS so FROM {candles}), m AS (SELECT symbol, ts, @div(close - so, so) * 100 AS move FROM s) SELECT a.symbol, a.ts, @r6(a.move - b.move) AS relative_move FROM m a JOIN m b ON a.ts = b.ts AND b.symbol = 'view'")

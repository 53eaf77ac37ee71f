"""From components to ranked candidates: triggers, direction, lifetime, context, conviction, gates, priority.

Every operator is a projection of one row of ``components`` a symbol and moment, whose columns are the components' readings
(any may be null); only conviction's history and the ranks look at other rows. A null reading fires no trigger, is no
evidence, counts in no mean, and fails its gate.
"""

from __future__ import annotations

from tidewater.operators import snapshots  # noqa: F401  its definitions come first
from tidewater.operators.rolling import BARS, P, cols, over
from tidewater.operators.scoring import c01, c11, mean, wavg
from tidewater.plans.dialect import CATALOG, Operator, operator

# Fixed values
#: name, reading, what it must exceed, confidence, minutes that such a setup lasts
TRIGGERS = [
    ("significant_breakout_probability", "breakout_prob", "0.65", "structure_conf", "240"),
    ("liquidity_sweep_detected", "sweep", "0.5", "structure_conf", "120"),
    ("structural_trend_change", "CASE WHEN trend_alert = 1 THEN coalesce(trend_change, 0) END", "-1", "trend_change_conf", "1440"),
    ("regime_transition", "CASE WHEN structure_alert = 1 THEN coalesce(structure_change, 0) END", "-1", "structure_change_conf", "1440"),
    ("institutional_accumulation", "accumulation", "0.5", "flow_conf", "4320"),
    ("institutional_distribution", "distribution", "0.5", "flow_conf", "4320"),
    ("exceptional_relative_strength", "leadership", "85", "relative_conf", "2880"),
    ("high_volatility_expansion", "expansion", "0.5", "volatility_conf", "180"),
    ("event_driven_opportunity", "event_score", "40", "event_conf", "CASE WHEN hours_to_event > 0 THEN least(hours_to_event * 60, 2880) ELSE 240 END"),
]
LEANS = [("trend_direction", "trend_conf"), ("bias", "structure_conf"), ("net_flow", "flow_conf"), ("relative_trend", "relative_conf")]
#: kind, weight, score, confidence; scores of a direction are mirrored for a short candidate
EVIDENCE = [
    ("calibrated_probability", 0.35, "probability * 100", "calibration_conf"),
    ("market_context", 0.20, "adjusted * 100", "adjusted_conf"),
    ("historical_analog", 0.10, "win_rate * 100", "CASE WHEN win_rate IS NOT NULL THEN coalesce(mean_similarity, 0) END"),
    ("institutional_flow", 0.10, "mirror(flow_score)", "flow_conf"),
    ("market_structure", 0.10, "mirror(structure_score)", "structure_conf"),
    ("liquidity", 0.05, "liquidity_score", "liquidity_conf"),
    ("sector_strength", 0.05, "mirror(relative_score)", "relative_conf"),
    ("model_agreement", 0.05, "agreement_pct * 100", "model_conf"),
    ("options_positioning", 0.10, "mirror(options_score)", "options_conf"),
]
CONTEXT = [
    ("market_confidence / 100", "market_confidence_conf"), ("liquidity_score / 100", "liquidity_conf"), ("1 - event_score / 100", "event_conf"),
    ("1 - transition_score / 100", "transition_conf"), ("abs(flow_score - 50) / 50", "flow_conf"), ("1 - volatility_score / 100", "volatility_conf"),
]
GATES = [
    ("liquidity", "liquidity_score >= 30"), ("spread", "spread_pct <= 0.5"), ("event_risk", "event_score <= 70 AND coalesce(frozen, 0) = 0"),
    ("model_agreement", "agreement_pct >= 0.8"), ("feature_quality", "feature_quality >= 0.5"), ("market_confidence", "market_confidence >= 35"), ("analog_reliability", "mean_similarity >= 0.5"),
]
FACTORS = [
    "conviction", "100 * tanh(greatest(priority, 0.0) / 2)", "liquidity_score", "100 * least(1.0, lifetime / 1440)",
    "CASE WHEN var95 IS NOT NULL THEN least(100.0, greatest(0.0, 100 - 20 * var95)) END", "leadership", "mean_similarity * 100", "50 + 50 * tanh(average_return / 0.05)",
]
GRADES = "CASE WHEN conviction >= 80 THEN 'A' WHEN conviction >= 65 THEN 'B' WHEN conviction >= 50 THEN 'C' WHEN conviction >= 35 THEN 'D' ELSE 'F' END"


def dbl(x: str) -> str:
    return f"CAST({x} AS DOUBLE)"


def weighed(terms: list[tuple[str, str]]) -> tuple[str, str, str]:
    """(sum of value x confidence, sum of confidences, how many) over the terms whose value and confidence are present."""
    both = [f"({v}) IS NOT NULL AND ({c}) IS NOT NULL" for v, c in terms]
    return (
        " + ".join(f"coalesce({dbl(f'({v}) * ({c})')}, 0)" for v, c in terms),
        " + ".join(f"CASE WHEN {b} THEN {dbl(c)} ELSE 0 END" for b, (_, c) in zip(both, terms, strict=True)),
        " + ".join(f"CASE WHEN {b} THEN 1 ELSE 0 END" for b in both),
    )


def mirrored(x: str) -> str:
    return f"CASE WHEN direction = 'short' THEN 100 - {x[7:-1]} ELSE {x[7:-1]} END" if x.startswith("mirror(") else x


#: What market confidence is the mean of: quality of data and features, certainty of the regime, breadth, agreement of flows,
#: stability of correlations.
INPUTS = ["CASE WHEN l.volume > 0 AND l.high >= l.low THEN 1 ELSE 0 END", "CAST(n AS DOUBLE) / 50", "abs(level)", "avg(CASE WHEN l.close > l.open THEN 1 ELSE 0 END) OVER (PARTITION BY l.ts)", "abs(flow)", "1 - heat"]
#: Readings of every bar, from the candles and the calendar. What the provided tables lack (quotes, chains and members
#: of these symbols) has stand-ins made of the bars: the body's share of the range for the spread, momenta for members.
#: Events are dense there, so one is near within ten minutes, not two days.
READINGS = {
    "trend_direction": "level", "trend_conf": "0.25 + 0.45 * CASE WHEN s5 * s20 > 0 AND s20 * s50 > 0 THEN 1 ELSE 0.5 END",
    "bias": "place", "breakout_prob": "0.5 + 0.4 * tanh(@div(close - top, atr))", "sweep": "CASE WHEN high > top AND close < top THEN 0.8 WHEN low < bottom AND close > bottom THEN 0.7 ELSE 0 END",
    "structure_score": "50 + 50 * place", "structure_conf": "0.2 + 0.6 * CASE WHEN place IS NULL THEN 0 ELSE 1 END",
    "trend_alert": "CASE WHEN level * was < 0 THEN 1 ELSE 0 END", "trend_change": "abs(level - was) / 2", "trend_change_conf": c01("CAST(n AS DOUBLE) / 50"),
    "structure_alert": "CASE WHEN place * placed < 0 THEN 1 ELSE 0 END", "structure_change": "abs(place - placed) / 2", "structure_change_conf": c01("CAST(n AS DOUBLE) / 60"),
    "net_flow": "flow", "accumulation": "greatest(0.0, tanh(3 * flow))", "distribution": "greatest(0.0, tanh(-3 * flow))", "flow_score": "50 + 50 * flow", "flow_conf": "0.2 + 0.35 * abs(flow)",
    "relative_trend": "tanh((mom_20 - market) / 5)", "leadership": "100 * rank", "relative_score": "50 + 50 * tanh((mom_20 - market) / 5)", "relative_conf": "0.5 + 0.3 * rank",
    "expansion": "CASE WHEN hv_5 > hv_20 THEN heat ELSE 0.5 * heat END", "volatility_score": "100 * heat", "volatility_conf": "0.25 + 0.35 * heat",
    "event_score": "100 * " + wavg([(0.3, c01("1 - CAST(seconds_to_next AS DOUBLE) / 600")), (0.2, c01("(CAST(multiplier AS DOUBLE) - 1) / 4"))]), "event_conf": "0.6", "hours_to_event": "CAST(seconds_to_next AS DOUBLE) / 3600",
    "frozen": "CASE WHEN multiplier >= 3 AND seconds_to_next < 600 THEN 1 ELSE 0 END",
    "liquidity_score": "100 * least(1.0, rvol / 2)", "liquidity_conf": "0.6", "spread_pct": "@div(abs(close - open), high - low)",
    "options_score": "50 - 50 * s5", "options_conf": "CASE WHEN s5 IS NOT NULL THEN 0.5 END",
    "transition_score": "50 * abs(level - was)", "transition_conf": c01("CAST(n AS DOUBLE) / 50"), "market_confidence": "100 * " + mean(*INPUTS),
    "market_confidence_conf": "0.6 * (" + " + ".join(f"CASE WHEN ({x}) IS NULL THEN 0 ELSE 1 END" for x in INPUTS) + ") / CAST(6 AS DOUBLE) + 0.4 * " + c01("(l.rn - 1) / CAST(5 AS DOUBLE)"), "feature_quality": "CAST(n AS DOUBLE) / 50",
    "probability": "0.5 + 0.4 * level", "calibration_conf": "0.75", "agreement_pct": "(CASE WHEN s5 * level > 0 THEN 1 ELSE 0 END + CASE WHEN s20 * level > 0 THEN 1 ELSE 0 END + CASE WHEN s50 * level > 0 THEN 1 ELSE 0 END) / CAST(3 AS DOUBLE)", "model_conf": "abs(level)",
    "mean_similarity": "CASE WHEN n = 50 THEN 1 - heat END", "win_rate": "CASE WHEN n = 50 THEN wins END", "average_return": "CASE WHEN n = 50 THEN gain END", "var95": "CASE WHEN n = 50 THEN greatest(0.0, 1.645 * noise - gain) END",
}
REASONS = " || ".join(f"CASE WHEN coalesce({ok}, false) THEN '' ELSE '{name};' END" for name, ok in GATES)
_fires = ", ".join(
    f"@struct('{name}' AS name, {dbl(v)} AS v, {dbl(f'coalesce({w}, 0)')} AS w, {dbl(life)} AS life, coalesce(({v}) > {over_}, false) AS holds)" for name, v, over_, w, life in TRIGGERS
)
_lean, _lean_weight, _ = weighed(LEANS)
_quality, _quality_weight, _quality_n = weighed([(f"CASE WHEN ({v}) IS NOT NULL THEN {c01(v)} END", c) for v, c in CONTEXT])
KEPT = [*READINGS, "fired", "lean", "quality", "quality_conf", "direction", "priority", "lifetime", "adjusted", "adjusted_conf"]
#: One row a component row, with triggers that hold, priority, lifetime, direction and the probability in its context.
#: Each goes through one struct, so that the planner does not infer constraints from every part of what a filter reads.
ROW = f"""c AS (SELECT *, @filter(@array({_fires}), @L(x) x.holds) AS fired, ({_lean}) / nullif({_lean_weight}, 0.0) AS lean,
  ({_quality}) / nullif({_quality_weight}, 0.0) AS quality, ({_quality_weight}) / nullif({dbl(_quality_n)}, 0.0) AS quality_conf FROM {{components}}),
o AS (SELECT *, CASE WHEN round(lean, 6) > 0.05 THEN 'long' WHEN round(lean, 6) < -0.05 THEN 'short' ELSE 'neutral' END AS direction,
  @fold(@transform(fired, @L(x) x.w), CAST(0.0 AS DOUBLE), @L(s, x) s + x) AS priority, coalesce(@amin(@transform(fired, @L(x) x.life)), CAST(240.0 AS DOUBLE)) AS lifetime,
  0.5 + (probability - 0.5) * coalesce(quality, 1) AS adjusted, calibration_conf * coalesce(quality, 1) AS adjusted_conf FROM c),
i AS (SELECT symbol, ts, @explode(@array(@struct({", ".join(f"{k} AS {k}" for k in KEPT)}))) AS r FROM o), d AS (SELECT symbol, ts, {", ".join(f"r.{k} AS {k}" for k in KEPT)} FROM i)"""
_score = wavg([(w, mirrored(s)) for _, w, s, _ in EVIDENCE])
_sure = wavg([(w, f"CASE WHEN ({mirrored(s)}) IS NOT NULL THEN coalesce({c}, 0) END") for _, w, s, c in EVIDENCE])
_there = " + ".join(f"CASE WHEN ({mirrored(s)}) IS NULL THEN 0 ELSE 1 END" for _, _, s, _ in EVIDENCE)
_past = "OVER (PARTITION BY symbol, direction ORDER BY ts ROWS BETWEEN 20 PRECEDING AND CURRENT ROW)"
CONVICTION = f"""{ROW}, e AS (SELECT *, coalesce({_score}, 50) AS conviction, coalesce({_sure}, 0) AS sure, ({_there}) / CAST(9 AS DOUBLE) AS complete FROM d),
g AS (SELECT *, row_number() OVER (PARTITION BY symbol, direction ORDER BY ts) AS rn FROM e),
h AS (SELECT *, CASE WHEN count(*) {_past} > 1 THEN regr_slope(conviction, {dbl("rn")}) {_past} ELSE 0 END AS slope, stddev_pop(conviction) {_past} AS sd, count(*) {_past} - 1 AS held FROM g)"""
RANKED = f"""{CONVICTION}, q AS (SELECT *, {REASONS} AS reasons FROM h), f AS (SELECT *, {mean(*FACTORS)} AS rank_score,
  ({" + ".join(f"CASE WHEN ({x}) IS NULL THEN 0 ELSE 1 END" for x in FACTORS)}) / CAST(8 AS DOUBLE) AS factors FROM q WHERE reasons = '')"""

COMPONENTS = f"""WITH {BARS.strip()},
w AS (SELECT *, {", ".join(f"@div(close - lag(close, {n}) OVER ({P}), lag(close, {n}) OVER ({P})) * 100 AS mom_{n}, stddev_pop(lr) {over(n)} AS hv_{n}" for n in (5, 20, 50))},
  @div(sum(delta) {over(20)}, sum(volume) {over(20)}) AS flow, @div(volume, avg(volume) {over(20, 1)}) AS rvol, max(high) {over(20, 1)} AS top, min(low) {over(20, 1)} AS bottom,
  avg(tr) {over(14)} AS atr, avg(CASE WHEN lr > 0 THEN 1 WHEN lr IS NOT NULL THEN 0 END) {over(50)} AS wins, avg(sr) {over(50)} AS gain, stddev_pop(sr) {over(50)} AS noise, count(sr) {over(50)} AS n FROM rets),
v AS (SELECT *, tanh(mom_5 / 3) AS s5, tanh(mom_20 / 6) AS s20, tanh(mom_50 / 10) AS s50, {c11("@div(close - (top + bottom) / 2, top - bottom) * 2")} AS place,
  {c01("@div(hv_5, hv_50) / 2")} AS heat, avg(mom_20) OVER (PARTITION BY ts) AS market, CASE WHEN mom_20 IS NOT NULL THEN percent_rank() OVER (PARTITION BY ts, CASE WHEN mom_20 IS NULL THEN 0 ELSE 1 END ORDER BY round(mom_20, 6)) END AS rank FROM w),
l AS (SELECT *, {mean("s5", "s20", "s50")} AS level, lag({mean("s5", "s20", "s50")}, 5) OVER ({P}) AS was, lag(place, 5) OVER ({P}) AS placed FROM v)
SELECT l.symbol, l.ts, """ + ", ".join(f"{dbl(e)} AS {k}" for k, e in READINGS.items()) + " FROM l LEFT JOIN {event_windows} x ON l.symbol = x.symbol AND l.ts = x.ts"
FEEDS = {"components": COMPONENTS, "event_windows": CATALOG["b15_event_windows"].text}


def decided(name: str, doc: str, text: str) -> Operator:
    return operator(name, doc, f"WITH {text}", **FEEDS)


_each = "t AS (SELECT symbol, ts, @explode(fired) AS x FROM d)"
_pay = "t AS (SELECT symbol, ts, @explode(@array(" + ", ".join(f"@struct('{k}' AS kind, {dbl(w)} AS w, {dbl(mirrored(s))} AS s, {dbl(c)} AS c)" for k, w, s, c in EVIDENCE) + ")) AS x FROM d)"
_why = "@element(@transform(fired, @L(x) x.name), 1)"
decided("z01_triggers", "Conditions that hold at each moment, with what was read and how sure it is.", f"{ROW}, {_each} SELECT symbol, ts, x.name AS trigger, @r6(x.v) AS value, @r6(x.w) AS confidence FROM t")
decided("z02_priority_score", "Sum of trigger confidences.", f"{ROW} SELECT symbol, ts, @r6(priority) AS priority, CAST(@size(fired) AS BIGINT) AS n FROM d")
decided("z03_watchlist_scan", "Watchlist of each moment by score, list position breaking ties.", f"{ROW} SELECT symbol, ts, @r6(priority) AS priority, CAST(row_number() OVER (PARTITION BY ts ORDER BY round(priority, 6) DESC, symbol) AS INT) AS place FROM d WHERE @size(fired) > 0")
decided("z04_direction", "Direction by a mean weighted with confidences, with a neutral band.", f"{ROW} SELECT symbol, ts, @r6(lean) AS signal, direction FROM d")
decided("z05_lifetime", "Shortest lifetime of the triggers that hold; an event's is the time to it, two days at most.", f"{ROW} SELECT symbol, ts, @r6(lifetime) AS minutes FROM d")
decided("z06_candidates", "Ranked candidates of each moment, twenty at most.", f"{ROW}, r AS (SELECT *, CAST(row_number() OVER (PARTITION BY ts ORDER BY round(priority, 6) DESC, symbol) AS INT) AS rank FROM d WHERE @size(fired) > 0) SELECT symbol, ts, rank, @r6(priority) AS priority, direction, @r6(lifetime) AS minutes, {_why} AS reason FROM r WHERE rank <= 20")
decided("z09_context_quality", "Context quality over six readings, weighted with confidences; shrinks probabilities to a half.", f"{ROW} SELECT symbol, ts, @r6(quality) AS quality, @r6(coalesce(quality_conf, 0)) AS quality_confidence, @r6(adjusted) AS probability, @r6(adjusted_conf) AS confidence FROM d")
decided("z10_conviction", "Weighted evidence over what is present, with grade, trend, stability and confidence from the last twenty scores.", f"{CONVICTION} SELECT symbol, ts, direction, @r6(conviction) AS conviction, {GRADES.replace('conviction', 'round(conviction, 6)')} AS grade, CASE WHEN round(slope, 6) > 1 THEN 'improving' WHEN round(slope, 6) < -1 THEN 'declining' ELSE 'stable' END AS trend, " + cols({"stability": c01("1 - sd / 25"), "completeness": "complete", "confidence": c01(f"0.4 * complete + 0.3 * sure + 0.3 * {c01('CAST(held AS DOUBLE) / 5')}")}) + " FROM h")
decided("z11_qualification", "Fail-closed gates with reasons.", f"{ROW} SELECT symbol, ts, {REASONS} AS reasons, CASE WHEN ({REASONS}) = '' THEN 1 ELSE 0 END AS qualified FROM d")
decided("z12_priority_rank", "Equal-weight factors over what is present, best ten of the qualified at each moment.", f"{RANKED}, k AS (SELECT *, CAST(row_number() OVER (PARTITION BY ts ORDER BY round(rank_score, 6) DESC, symbol) AS INT) AS rank FROM f) SELECT symbol, ts, rank, @r6(rank_score) AS priority, @r6(factors) AS completeness FROM k WHERE rank <= 10")
decided("h65_evidence", "Evidence rows; one kind only where it exists.", f"{ROW}, {_pay} SELECT symbol, ts, x.kind AS kind, @r6(x.w) AS weight, @r6(x.s) AS score, @r6(coalesce(x.c, 0)) AS confidence, CASE WHEN round(x.s, 6) >= 50 THEN 'supportive' ELSE 'weak' END AS effect FROM t WHERE x.s IS NOT NULL")
decided("h66_conviction", "Weighted mean of the evidence at hand; fifty with none.", f"{CONVICTION} SELECT symbol, ts, @r6(conviction) AS conviction, @r6(sure) AS confidence, @r6(complete) AS completeness FROM h")
decided("h67_gates", "Single gates, null-safe.", f"{ROW} SELECT symbol, ts, " + ", ".join(f"CASE WHEN coalesce({ok}, false) THEN 1 ELSE 0 END AS {name}_ok" for name, ok in GATES) + " FROM d")
decided("h68_qualified", "Qualified symbols only.", f"{ROW} SELECT symbol, ts, direction FROM d WHERE ({REASONS}) = ''")
decided("h69_priority_mean", "Mean of the priority factors that exist; zero with none.", f"{CONVICTION} SELECT symbol, ts, @r6(coalesce({mean(*FACTORS)}, 0.0)) AS priority FROM h")
decided("h73_reason_text", "Reason text of each candidate.", f"{ROW} SELECT symbol, ts, direction || ': ' || {_why} || ' and ' || CAST(@size(fired) - 1 AS STRING) || ' more' AS reason FROM d WHERE @size(fired) > 0")
decided("h75_report_lookup", "Newest report row of each symbol and moment.", "r AS (SELECT label, max_by(value, id) AS confidence FROM {observations} GROUP BY label) SELECT d.symbol, d.ts, r.confidence FROM {components} d LEFT JOIN r ON d.symbol = r.label")


# Market confidence with all its terms: six inputs, grade, trend over the scores before, level states ---------------
# Fixed values
HELD_SCORES, ENOUGH_SCORES, STEADY = 20, 5, 1.0
SIX = ("data_quality", "feature_quality", "regime_certainty", "breadth", "institutional_agreement", "correlation_stability")
CONFIDENCE_INPUTS = COMPONENTS.split("\nSELECT l.symbol, l.ts, ")[0] + "\nSELECT l.symbol, l.ts, " + ", ".join(f"{dbl(x)} AS {k}" for k, x in zip(SIX, INPUTS)) + " FROM l"
_given = " + ".join(f"CASE WHEN {k} IS NULL THEN 0 ELSE 1 END" for k in SIX)
_before = f"OVER ({P} ROWS BETWEEN {HELD_SCORES} PRECEDING AND CURRENT ROW)"
_weight = lambda a: f"greatest(0.0, 1 - abs(score / 100 - {a}) / {dbl('0.4')})"
_whole = f"nullif({_weight('0.0')} + {_weight('0.5')} + {_weight('1.0')}, 0.0)"
MARKET_CONFIDENCE = f"""WITH v AS (SELECT symbol, ts, coalesce(100 * {mean(*SIX)}, 50) AS score, ({_given}) / CAST(6 AS DOUBLE) AS completeness, row_number() OVER ({P}) AS rn FROM {{inputs}}),
h AS (SELECT *, count(*) {_before} - 1 AS held, CASE WHEN count(*) {_before} > 1 THEN regr_slope(score, {dbl("rn")}) {_before} ELSE 0 END AS slope FROM v)
SELECT symbol, ts, @r6(score) AS score, @r6({c01(f"0.6 * completeness + 0.4 * least(1.0, held / {dbl(str(ENOUGH_SCORES))})")}) AS confidence,
  CASE WHEN score >= 80 THEN 'A' WHEN score >= 65 THEN 'B' WHEN score >= 50 THEN 'C' WHEN score >= 35 THEN 'D' ELSE 'F' END AS grade,
  CASE WHEN slope > {STEADY} THEN 'improving' WHEN slope < -{STEADY} THEN 'declining' ELSE 'stable' END AS trend, @r6(slope) AS trend_slope, @r6(completeness) AS completeness,
  """ + ", ".join(f"@r6(coalesce({_weight(a)} / {_whole}, 1 / CAST(3 AS DOUBLE))) AS {k}" for k, a in (("s_low", "0.0"), ("s_moderate", "0.5"), ("s_high", "1.0"))) + " FROM h"
operator("n27_confidence_terms", "Market confidence of every bar: six inputs, grade, trend over twenty scores before, states.", MARKET_CONFIDENCE, inputs=CONFIDENCE_INPUTS)

"""DuckDB SQL of the assessments, written from their definitions over lists, in another shape than the operators' columns."""

from __future__ import annotations

from tidewater.plans.dialect import Operator


def _twin(keys: str, text: str, shown: dict[str, str], states: dict[str, str]) -> str:
    """``text`` ends in a relation z; ``states``: evidence by name, shares of its positive parts."""
    parts = ", ".join(f"greatest(0, coalesce({e}, 0))" for e in states.values())
    columns = [f"@r6({e}) AS {k}" for k, e in shown.items()] + [f"@r6(coalesce(ev[{i}] / nullif(list_sum(ev), 0), 1.0 / {len(states)})) AS s_{k}" for i, k in enumerate(states, 1)]
    return f"WITH {text},\ne AS (SELECT *, [{parts}] AS ev FROM z)\nSELECT {keys}, {', '.join(columns)} FROM e"


def _list(*terms: str) -> str:
    return f"[{', '.join(terms)}]"


def _weighed(terms: list[tuple[float, str]]) -> str:
    return f"coalesce(list_sum({_list(*(f'{w} * ({x})' for w, x in terms))}) / nullif(list_sum({_list(*(f'CASE WHEN ({x}) IS NOT NULL THEN {w} END' for w, x in terms))}), 0), 0)"


def _in(x: str, low: float = 0, high: float = 1) -> str:
    return f"CASE WHEN ({x}) < {low} THEN {low} WHEN ({x}) > {high} THEN {high} ELSE ({x}) END"


def _near(level: str, at: dict[str, float], band: float) -> dict[str, str]:
    return {k: f"({band} - abs({level} - {a})) / {band}" for k, a in at.items()}


W = (5, 20, 50, 100)
_each = lambda k: _list(*(f"{k}_{w}" for w in W))


def _texts() -> dict[str, str]:
    refs = ("nifty", "sensex", "sector", "industry", "peers")
    flows = {"fii": 0.3, "dii": 0.2, "etf": 0.1, "deals": 0.15, "promoter": 0.15, "insider": 0.1}
    v = _list(*flows)
    return {
        "n09_sector_assessment": _twin(
            "ts, leaders, laggards",
            f"""r AS (SELECT *, row_number() OVER (PARTITION BY ts ORDER BY heat DESC, sector) AS up, row_number() OVER (PARTITION BY ts ORDER BY heat, sector DESC) AS down,
  least(3, count(heat) OVER (PARTITION BY ts) // 2) AS k, CASE WHEN leadership IS NOT NULL AND leadership_was IS NOT NULL THEN CASE WHEN (leadership > 0 AND leadership_was <= 0) OR (leadership <= 0 AND leadership_was > 0) OR abs(leadership - leadership_was) >= 1 THEN 1 ELSE 0 END END AS turned FROM {{sector_readings}}),
g AS (SELECT ts, coalesce(string_agg(CASE WHEN up <= k THEN sector END, ',' ORDER BY up), '') AS leaders, coalesce(string_agg(CASE WHEN down <= k THEN sector END, ',' ORDER BY down DESC), '') AS laggards, count(heat) AS n, count(*) AS whole, avg(heat) AS heat,
  {_in('avg(abs(capital))', 0, 100)} AS capital, tanh(avg(relative) / 5) AS relative, tanh(avg(momentum) / 5) AS momentum, stddev_pop(leadership) AS apart, coalesce(sum(turned), 0) AS changes, coalesce(avg(turned), 0) AS change, count(turned) AS compared,
  {_in('5 * any_value(rotation)', 0, 100)} AS rotation, any_value(participation) AS participation FROM r GROUP BY ts),
z AS (SELECT *, {_weighed([(0.4, _in('participation / 50 - 1', -1)), (0.35, 'relative'), (0.25, 'momentum')])} AS level, coalesce(list_avg([capital, rotation]), 0) AS turn FROM g)""",
            {"level": "level", "score": "50 * (1 + level)", "confidence": _in("0.2 + 0.3 * n / greatest(whole, 12) + 0.25 * least(1, coalesce(apart, 0) / 2) + CASE WHEN compared = 0 THEN 0.125 ELSE 0.25 * (1 - change) END"), "rotation_score": "turn", "heat": "heat", "changes": "changes"},
            {"broad_rotation": "turn / 100 * coalesce(participation / 100, 0.5)", "narrow_leadership": "turn / 100 * (1 - coalesce(participation / 100, 0.5))", "leadership_shift": "change", "sector_neutral": "1 - turn / 100"},
        ),
        "n10_structure_assessment": _twin(
            "symbol, ts",
            f"""d AS (SELECT *, coalesce({_in('bias', -1)}, 0) AS daily, tanh(move / 2) AS today, CASE WHEN trend <> 0 THEN 1 ELSE 0 END AS on_way FROM {{structure_readings}}),
z AS (SELECT *, coalesce(0.7 * daily + 0.3 * today, daily) AS level, CASE WHEN today * daily < 0 THEN abs(today) ELSE 0 END AS conflict FROM d)""",
            {"level": "level", "score": "50 * (1 + level)", "reversal": _in("drawdown / 1.5"), "confidence": _in("0.2 + 0.15 * len(list_filter([bias, trend, breakout_prob, sweep_prob], lambda x: x IS NOT NULL)) - CASE WHEN choch <> 0 THEN 0.15 ELSE 0 END - 0.3 * conflict")},
            {"markup": "level * on_way", "markdown": "-level * on_way", "accumulation": "level * (1 - on_way)", "distribution": "-level * (1 - on_way)", "consolidation": "(1 - abs(level)) * (1 - on_way)", "liquidity_sweep": "sweep_prob / 2"},
        ),
        "n11_relative_assessment": _twin(
            "symbol, ts",
            f"""s AS (SELECT *, list_filter({_list(*(f'tanh(list_avg({_each(f"{r}_strength")}) / 5)' for r in refs))}, lambda x: x IS NOT NULL) AS sig, coalesce(list_avg({_list(*(f'tanh(list_avg({_each(f"{r}_momentum")}))' for r in refs))}), 0) AS gain,
  list_avg([tanh((own_move - nifty_move) / 2), tanh((own_move - sensex_move) / 2)]) AS today, list_avg({_each('outperformance')}) AS beat, list_avg({_each('rank')}) AS ranking FROM {{relative_readings}}),
l AS (SELECT *, coalesce(list_avg(sig), 0) AS daily, coalesce(0.75 * coalesce(list_avg(sig), 0) + 0.25 * today, list_avg(sig), 0) AS level FROM s),
z AS (SELECT *, CASE WHEN level = 0 OR len(sig) = 0 THEN 0 ELSE len(list_filter(sig, lambda x: x * level > 0)) / len(sig) END AS same, CASE WHEN today * daily < 0 THEN abs(today) ELSE 0 END AS conflict FROM l)""",
            {"level": "level", "score": "CASE WHEN beat = 0 THEN 50 ELSE coalesce(beat, 50 * (1 + level)) END", "momentum": "gain", "ranking": "ranking", "agreement": "same", "confidence": _in("0.2 + 0.06 * len(sig) + 0.3 * same + CASE WHEN beat IS NULL THEN 0 ELSE 0.2 END - 0.25 * conflict")},
            {"leading": "level * same", "lagging": "-level * same", "in_line": "1 - abs(level)", "rotating": "abs(level) * (1 - same)"},
        ),
        "n12_option_assessment": _twin(
            "chain",
            f"""t AS (SELECT *, {_in('dealer', -1)} AS a, {_in('1 - pcr', -1)} AS b, {_in('max_pain_distance / 10', -1)} AS c, iv_rank / 50 - 1 AS iv FROM {{option_readings}}),
z AS (SELECT *, {_weighed([(0.4, 'a'), (0.3, 'b'), (0.3, 'c')])} AS level FROM t)""",
            {"level": "level", "score": "50 * (1 + level)", "confidence": _in("0.3 + len(list_filter([a, b, c], lambda x: x IS NOT NULL)) / 6 + CASE WHEN iv IS NULL THEN 0 ELSE 0.2 END")},
            {"bullish_positioning": "level", "bearish_positioning": "-level", "elevated_iv": "iv", "compressed_iv": "-iv", "mixed": "1 - abs(level)"},
        ),
        "n13_macro_assessment": _twin(
            "ts",
            """m AS (SELECT ts, avg(score) AS level, list(score) AS xs FROM {macro_scores} GROUP BY ts),
z AS (SELECT *, len(xs) AS n, least(1, list_avg(list_transform(xs, lambda x: abs(x))) / 0.3) AS keen, CASE WHEN level = 0 THEN 0 ELSE len(list_filter(xs, lambda x: x * level > 0)) / len(xs) END AS same FROM m)""",
            {"level": "level", "score": "50 * (1 + level)", "confidence": _in("0.2 + 0.3 * n / 14 + same / 2"), "conviction": "keen", "consistency": "same", "n": "n"},
            {"risk_on": "CASE WHEN level > 0 THEN keen * same END", "risk_off": "CASE WHEN level < 0 THEN keen * same END", "mixed": "1 - keen"},
        ),
        "n14_event_assessment": _twin(
            "ts",
            f"z AS (SELECT *, {_weighed([(0.5, _in('sensitivity')), (0.3, _in('1 - hours / 48')), (0.2, _in('(expected_vol - 1) / 4'))])} AS level, sensitivity IS NULL AND hours IS NULL AND expected_vol IS NULL AS blind FROM {{event_readings}})",
            {"level": "level", "score": "100 * level", "confidence": _in(f"coalesce({_in('1 - reduction')}, 0.7) - coalesce(0.15 - 0.15 * similarity, 0.1)"), "expected_impact": "100 * coalesce(category_impact, CASE WHEN NOT blind THEN level END)"},
            _near("level", {"clear": 0, "elevated_risk": 0.4, "high_risk": 0.7}, 0.3) | {"freeze_recommended": "greatest((0.3 - abs(level - 0.9)) / 0.3, CASE WHEN frozen = 1 THEN 0.8 END)"},
        ),
        "n15_flow_assessment": _twin(
            "segment, ts",
            f"""l AS (SELECT *, {_in(_weighed([(w, k) for k, w in flows.items()]), -1)} AS level, list_filter({v}, lambda x: x IS NOT NULL) AS vs, list_avg([{", ".join(f"list_avg({_each(f'{k}_momentum')})" for k in ("fii", "dii", "participation"))}]) AS pace FROM {{flow_readings}}),
z AS (SELECT *, CASE WHEN len(vs) = 0 THEN 0 WHEN level = 0 THEN 0.5 ELSE len(list_filter(vs, lambda x: (x > 0) = (level > 0))) / len(vs) END AS same, coalesce({_in('list_avg(list_transform(vs, lambda x: abs(x))) / 0.3')}, 0) AS keen FROM l)""",
            {
                "level": "level", "score": f"coalesce({_in('participation', 0, 100)}, 50 * (1 + level))", "accumulation": "100 * coalesce(list_avg(list_transform(vs, lambda x: CASE WHEN x > 0 THEN x ELSE 0 END)), 0)",
                "distribution": "100 * coalesce(list_avg(list_transform(vs, lambda x: CASE WHEN x < 0 THEN -x ELSE 0 END)), 0)", "momentum": f"coalesce({_in('pace', -1)}, 0)", "agreement": "same",
                "confidence": _in("0.2 + 0.35 * len(list_filter([fii, dii, etf, deals, insider, sast], lambda x: x IS NOT NULL)) / 6 + 0.3 * same - 0.1 * coalesce(sast, 0)"),
            },
            {"institutional_accumulation": "CASE WHEN level > 0 THEN keen * same END", "institutional_distribution": "CASE WHEN level < 0 THEN keen * same END", "retail_driven": "1 - keen", "mixed_flow": "keen * (1 - same)"},
        ),
        "n16_liquidity_assessment": _twin(
            "symbol, ts",
            f"""l AS (SELECT *, coalesce({_in('liquidity_score', 0, 100)}, 50) / 100 AS level, list_filter({_each('trend')}, lambda x: x IS NOT NULL) AS ts_, coalesce(abs(imbalance), 0) AS lean, coalesce({_in('(turnover_z - delivery_z) / 4')}, 0) AS churn FROM {{liquidity_readings}}),
z AS (SELECT *, least(1, 0.45 * coalesce({_in('-list_avg(ts_) / 3')}, 0) + 0.35 * lean + 0.2 * churn) AS pressed,
  CASE WHEN len(ts_) = 0 THEN 0 WHEN len(list_filter(ts_, lambda x: x > 0)) IN (0, len(ts_)) THEN 1 ELSE 0.5 END AS steady FROM l)""",
            {
                "level": "level", "score": "100 * level", "stress": "100 * pressed", "execution_risk": f"100 * coalesce(list_avg([{_in('spread_pct')}, {_in('impact_pct / 0.5')}]), 1 - level)",
                "confidence": _in("0.2 + 0.4 * len(list_filter([liquidity_score, spread_pct, imbalance, impact_pct, turnover, delivery_pct], lambda x: x IS NOT NULL)) / 6 + 0.2 * steady - 0.15 * pressed"),
            },
            _near("level", {"illiquid": 0, "thin": 0.25, "healthy": 0.6, "highly_liquid": 0.9}, 0.3) | {"stress": "pressed / 2", "auction_driven": "least(1, (1 - level) * lean) / 2"},
        ),
    }


def oracle_sql() -> dict[str, str]:
    from tidewater.operators.assessments import inputs

    return {name: Operator(name, "", text, inputs()).oracle() for name, text in _texts().items()}

"""DuckDB SQL written by hand from an operator's definition, in another shape than the operator's own text.

Named relations in braces are inputs (market views or tables, or the text of an operator whose output is the input).
"""

from __future__ import annotations

from tidewater.plans.dialect import CATALOG, Operator

TEXTS: dict[str, str] = {
    # every later event within twelve hours, by a range join
    "b15_event_windows": """
SELECT c.symbol, c.ts, min(CAST(floor(epoch(e.ts)) AS BIGINT) - CAST(floor(epoch(c.ts)) AS BIGINT)) AS seconds_to_next,
       CAST(max(CASE WHEN e.ts <= c.ts + INTERVAL 2 HOURS THEN 1 + e.event_id % 3 ELSE 1 END) AS BIGINT) AS multiplier
FROM {candles} c JOIN {events} e ON e.ts >= c.ts AND e.ts < c.ts + INTERVAL 12 HOURS GROUP BY c.symbol, c.ts""",
    # windows of events compared with moments directly
    "d13_event_activity": """
SELECT c.ts, count(*) AS active, @r6(least(1.0, sum(CASE e.event_type WHEN 'error' THEN 0.4 ELSE 0.2 END))) AS reduction, max(e.event_type) AS kind
FROM {reference} c JOIN {events} e ON (e.event_type = 'error' AND c.ts BETWEEN e.ts - INTERVAL 2 HOURS AND e.ts + INTERVAL 4 HOURS)
                                   OR (e.event_type = 'purchase' AND c.ts BETWEEN e.ts - INTERVAL 1 HOURS AND e.ts + INTERVAL 1 HOURS)
GROUP BY c.ts""",
    # pairs numbered by a window over all pairs of the first articles
    "b13_headline_similarity": """
WITH f AS (SELECT doc_id, source, list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda t: length(t) > 2)) AS ws
           FROM {documents} QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 201),
p AS (SELECT a.source, len(list_intersect(a.ws, b.ws)) AS i, len(a.ws) + len(b.ws) AS n FROM f a JOIN f b ON a.source = b.source AND a.doc_id < b.doc_id
      QUALIFY row_number() OVER (PARTITION BY a.source ORDER BY a.doc_id, b.doc_id) <= 200)
SELECT source, @r6(avg(CAST(i AS DOUBLE) / nullif(n - i, 0))) AS similarity, count(*) AS pairs FROM p GROUP BY source""",
    # bars numbered, and the impulse bar's neighbours found by number
    "m07_order_block": """
WITH b AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn FROM {candles}),
t AS (SELECT x.symbol, x.rn, x.ts, x.close, x.close - y.close AS impulse, y.close - y.open AS body, (y.high + y.low) / 2 AS middle,
             greatest(x.high, y.close) - least(x.low, y.close) AS tr
      FROM b x LEFT JOIN b y ON x.symbol = y.symbol AND x.rn = y.rn + 1),
a AS (SELECT *, CASE WHEN rn > 14 THEN list_avg(list(tr) OVER (PARTITION BY symbol ORDER BY rn ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)) END AS atr FROM t),
o AS (SELECT symbol, rn, middle FROM a WHERE (impulse > atr AND body < 0) OR (impulse < -atr AND body > 0))
SELECT a.symbol, a.ts, @r6((a.close - o.middle) / nullif(o.middle, 0.0) * 100) AS order_block_pct
FROM a ASOF LEFT JOIN o ON a.symbol = o.symbol AND a.rn >= o.rn""",
    # the percentile counted by a range self-join
    "l02_liquidity_score": """
WITH q AS (SELECT symbol, ts, bid, ask, CASE WHEN bid_depth > 0 AND ask_depth > 0 THEN bid_depth + ask_depth END AS depth, bid_depth + ask_depth AS total,
                  row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn FROM {quotes}),
p AS (SELECT x.symbol, x.rn, avg(CASE WHEN y.depth <= x.depth THEN 1.0 ELSE 0.0 END) AS pct, count(y.depth) AS n
      FROM q x JOIN q y ON x.symbol = y.symbol AND y.rn BETWEEN x.rn - 99 AND x.rn AND y.depth IS NOT NULL WHERE x.depth IS NOT NULL GROUP BY x.symbol, x.rn),
s AS (SELECT q.symbol, q.ts, pct, 200 * (ask - bid) / (ask + bid) AS spread, 100 * (ask - bid) / (ask + bid) * (1 + 1000.0 / total) AS impact
      FROM q LEFT JOIN p ON q.symbol = p.symbol AND q.rn = p.rn AND n >= 10 WHERE bid > 0 AND bid <= ask AND total > 0)
SELECT q.symbol, q.ts, @r6(40 * greatest(0.0, 1 - spread) + 30 * pct + 30 * greatest(0.0, 1 - impact / 0.5)) AS liquidity_score
FROM q LEFT JOIN s ON q.symbol = s.symbol AND q.ts = s.ts""",
    # lists skip what is null: means and weights over what is present
    "n06_momentum": """
WITH f AS (SELECT *, [tanh(mom_5 / 3), tanh(mom_20 / 6), tanh(mom_50 / 10), tanh(mom_200 / 20)] AS sig, tanh(move / 2) AS today,
                  coalesce(list_avg([tanh(acc_5 / 1.5), tanh(acc_20 / 3), tanh(acc_50 / 5), tanh(acc_200 / 10)]), 0) AS g,
                  list_max([abs(z_5), abs(z_20), abs(z_50), abs(z_200)]) AS far FROM {f22_wide_features}),
d AS (SELECT *, coalesce(list_avg(sig), 0) AS daily FROM f),
l AS (SELECT *, least(1, greatest(-1, CASE WHEN today IS NULL THEN daily ELSE 0.7 * daily + 0.3 * today END)) AS level,
             coalesce(greatest(0, -today * sign(daily)), 0) AS conflict, list_filter(sig, lambda x: x IS NOT NULL) AS known FROM d),
e AS (SELECT *, [CASE WHEN level > 0 AND g > 0 THEN level * g ELSE 0 END, CASE WHEN level < 0 AND g < 0 THEN level * g ELSE 0 END,
                 CASE WHEN level * g < 0 THEN -level * g ELSE 0 END, CASE WHEN far >= 2 THEN abs(level) ELSE 0 END, (1 - abs(level)) * (1 - abs(g))] AS ev FROM l),
s AS (SELECT *, CASE WHEN list_sum(ev) > 0 THEN list_transform(ev, lambda x: x / list_sum(ev)) ELSE [0.2, 0.2, 0.2, 0.2, 0.2] END AS p FROM e)
SELECT symbol, ts, @r6(level) AS level, @r6(50 + 50 * level) AS score, @r6(g) AS acceleration, @r6(far) AS max_abs_z,
  @r6(least(1, greatest(0, 0.4 * len(known) / 4.0
      + 0.4 * coalesce(len(list_filter(known, lambda x: (x >= 0) = (level >= 0))) / nullif(len(known), 0), 0) + CASE WHEN far IS NULL THEN 0 ELSE 0.2 END - 0.3 * conflict))) AS confidence,
  @r6(p[1]) AS s_accelerating_bullish, @r6(p[2]) AS s_accelerating_bearish, @r6(p[3]) AS s_decelerating, @r6(p[4]) AS s_extreme, @r6(p[5]) AS s_mixed FROM s""",
    "n07_volatility": """
WITH u AS (SELECT symbol, ts, today_vol, unnest([regime_5, regime_20, regime_50, regime_100]) / 2 AS r, unnest([vix_5, vix_20, vix_50, vix_100]) AS x, unnest([hist_5, hist_20, hist_50, hist_100]) AS h,
                  unnest([vov_5, vov_20, vov_50, vov_100]) AS v, unnest([compression_5, compression_20, compression_50, compression_100]) AS c, unnest([expansion_5, expansion_20, expansion_50, expansion_100]) AS b
           FROM {f22_wide_features}),
a AS (SELECT symbol, ts, any_value(today_vol) AS today, coalesce(avg(r), 0.5) AS r, count(r) AS n, stddev_pop(r) AS sd, avg(x) AS x, avg(h) AS h, avg(v) AS v, coalesce(avg(c), 0) AS c, coalesce(avg(b), 0) AS b FROM u GROUP BY symbol, ts),
d AS (SELECT *, least(1, greatest(0, coalesce(0.85 * r + 0.075 * (1 - tanh(x / 10)), r))) AS daily, CASE WHEN h > 1e-6 THEN tanh((today / h - 1) / 1.5) END AS tilt FROM a),
l AS (SELECT *, CASE WHEN tilt IS NULL THEN daily ELSE least(1, greatest(0, 0.8 * daily + 0.1 + 0.1 * tilt)) END AS level, CASE WHEN v IS NULL OR h IS NULL THEN 0 ELSE least(1, v / greatest(h, 1e-6)) END AS unstable FROM d),
w AS (SELECT symbol, ts, k, greatest(0, e) AS e FROM (
  SELECT symbol, ts, unnest(['extremely_low', 'low', 'normal', 'elevated', 'high', 'extreme', 'compression', 'expansion']) AS k,
         unnest([1 - abs(level) / 0.25, 1 - abs(level - 0.2) / 0.25, 1 - abs(level - 0.5) / 0.25, 1 - abs(level - 0.7) / 0.25, 1 - abs(level - 0.85) / 0.25, 1 - abs(level - 1) / 0.25, c / 2, b / 2]) AS e FROM l) q),
s AS (PIVOT (SELECT symbol, ts, k, coalesce(e / nullif(sum(e) OVER (PARTITION BY symbol, ts), 0), 0.125) AS p FROM w)
      ON k IN ('extremely_low', 'low', 'normal', 'elevated', 'high', 'extreme', 'compression', 'expansion') USING max(p) GROUP BY symbol, ts)
SELECT l.symbol, l.ts, @r6(level) AS level, @r6(100 * level) AS score, @r6(unstable) AS instability,
  @r6(least(1, greatest(0, 0.25 + 0.35 * CASE WHEN n = 0 THEN 0 WHEN n = 1 THEN 1 ELSE 1 - least(1, 2 * sd) END + 0.05 * n + CASE WHEN x IS NULL THEN 0 ELSE 0.1 END - 0.15 * unstable
      - 0.2 * greatest(0, coalesce(tilt * (1 - 2 * daily), 0))))) AS confidence,
  @r6(extremely_low) AS s_extremely_low, @r6(low) AS s_low, @r6(normal) AS s_normal, @r6(elevated) AS s_elevated, @r6(high) AS s_high, @r6(extreme) AS s_extreme,
  @r6(compression) AS s_compression, @r6(expansion) AS s_expansion FROM l JOIN s ON l.symbol = s.symbol AND l.ts = s.ts""",
    "n08_breadth": """
WITH m AS (SELECT *, tanh(list_avg([strength_5, strength_20, strength_50, strength_100]) * 10) AS way,
                  tanh((list_avg([highs_5, highs_20, highs_50, highs_100]) - list_avg([lows_5, lows_20, lows_50, lows_100])) / 5) AS new FROM {f23_breadth_features}),
t AS (SELECT m.*, unnest([0.4, 0.25, 0.15, 0.1, 0.1]) AS w, unnest([strength, (participation - 50) / 50, (above - 50) / 50, way, new]) AS v FROM m),
l AS (SELECT ts, any_value(strength) AS strength, any_value(way) AS way, any_value(new) AS new, count(v) AS n,
             coalesce(sum(CASE WHEN v IS NOT NULL THEN w * least(1, greatest(-1, v)) END) / nullif(sum(CASE WHEN v IS NOT NULL THEN w END), 0), 0) AS level,
             any_value(list_avg([participation, above]) / 100) AS base, any_value(divergence) AS gap FROM t GROUP BY ts),
q AS (SELECT *, least(1, greatest(0, coalesce(base, 0.5) * CASE WHEN gap < 0 THEN greatest(0, 1 + gap / 10) ELSE 1 END)) AS quality,
             abs(CASE WHEN strength IS NULL THEN level ELSE least(1, greatest(-1, strength)) END) AS sure FROM l),
s AS (SELECT *, sure + (1 - sure) * quality + abs(coalesce(way, 0)) AS total FROM q)
SELECT ts, @r6(level) AS level, @r6(50 + 50 * level) AS score, @r6(quality) AS quality,
  @r6(least(1, 0.25 + 0.07 * n + 0.25 * CASE WHEN way IS NULL AND new IS NULL THEN 0 WHEN way * new < 0 THEN 0.5 ELSE 1 END + 0.15 * CASE WHEN base IS NULL THEN 0 ELSE quality END)) AS confidence,
  @r6(coalesce(sure * quality / nullif(total, 0), 0.2)) AS s_broad, @r6(coalesce(sure * (1 - quality) / nullif(total, 0), 0.2)) AS s_narrow,
  @r6(coalesce(greatest(0, coalesce(way, 0)) / nullif(total, 0), 0.2)) AS s_improving, @r6(coalesce(greatest(0, -coalesce(way, 0)) / nullif(total, 0), 0.2)) AS s_deteriorating,
  @r6(coalesce((1 - sure) * quality / nullif(total, 0), 0.2)) AS s_mixed FROM s""",
}


def _market_confidence() -> str:
    """Scores from lists, slopes from sums over a join of each bar with those before it."""
    from tidewater.operators.candidates import CONFIDENCE_INPUTS, SIX

    return f"""WITH given AS ({CONFIDENCE_INPUTS}),
x AS (SELECT symbol, ts, list_filter([{", ".join(SIX)}], lambda v: v IS NOT NULL) AS x FROM given),
w AS (SELECT symbol, ts, len(x) AS n, coalesce(100 * list_avg(x), 50) AS score, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn FROM x),
g AS (SELECT a.symbol, a.ts, any_value(a.score) AS score, any_value(a.n) / 6 AS completeness, count(*) - 1 AS held,
  coalesce((count(*) * sum((b.rn - a.rn) * b.score) - sum(b.rn - a.rn) * sum(b.score)) / nullif(count(*) * sum((b.rn - a.rn) * (b.rn - a.rn)) - sum(b.rn - a.rn) * sum(b.rn - a.rn), 0), 0) AS slope
  FROM w a JOIN w b ON a.symbol = b.symbol AND b.rn BETWEEN a.rn - 20 AND a.rn GROUP BY a.symbol, a.ts),
t AS (SELECT *, list_transform([0, 0.5, 1], lambda k: greatest(0, 1 - abs(score / 100 - k) / 0.4)) AS near FROM g)
SELECT symbol, ts, @r6(score) AS score, @r6(0.6 * completeness + 0.4 * least(1, held / 5)) AS confidence, ['F', 'D', 'C', 'B', 'A'][1 + len(list_filter([35, 50, 65, 80], lambda k: score >= k))] AS grade,
  CASE WHEN slope > 1 THEN 'improving' WHEN slope < -1 THEN 'declining' ELSE 'stable' END AS trend, @r6(slope) AS trend_slope, @r6(completeness) AS completeness,
  @r6(coalesce(near[1] / nullif(list_sum(near), 0), 1 / 3)) AS s_low, @r6(coalesce(near[2] / nullif(list_sum(near), 0), 1 / 3)) AS s_moderate, @r6(coalesce(near[3] / nullif(list_sum(near), 0), 1 / 3)) AS s_high FROM t"""


def oracle_sql() -> dict[str, str]:
    views = {name: op.text for name, op in CATALOG.items()}
    return {name: Operator(name, "", text, views).oracle() for name, text in (TEXTS | {"n27_confidence_terms": _market_confidence()}).items()}

"""Labels, dataset assembly, calibration, agreement; triggers, ranking, lifecycle."""

from __future__ import annotations

from tidewater.operators.rolling import BARS, P, cols, over
from tidewater.operators.scoring import WIDE
from tidewater.operators.snapshots import normal_cdf
from tidewater.plans.dialect import operator

VOL = f"greatest(CAST(0.002 AS DOUBLE), coalesce(CASE WHEN count(lr) {over(19)} >= 2 THEN stddev_pop(lr) {over(19)} END, 0.0))"
HORIZON = 10
ENTRY = f"{BARS.strip()}, e AS (SELECT symbol, ts, rn, close, high, low, open, round({VOL}, 6) AS vol FROM rets WHERE close > 0)"
#: Closed form of the walk: the trailing stop follows the running extreme of the bars before.
WALK = f"""{ENTRY}, f AS (
  SELECT a.symbol, a.ts, a.rn, a.close AS entry, a.close * (1 + 2 * a.vol) AS target, a.close * (1 - a.vol) AS stop0, b.rn - a.rn AS k, b.open, b.high, b.low, b.close,
         max(b.high) OVER (PARTITION BY a.symbol, a.rn ORDER BY b.rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS peak, a.vol
  FROM e a JOIN e b ON a.symbol = b.symbol AND b.rn > a.rn AND b.rn <= a.rn + {HORIZON} WHERE a.rn >= 20),
g AS (SELECT *, CASE WHEN peak >= entry * (1 + vol) THEN greatest(stop0, peak * (1 - vol)) ELSE stop0 END AS stop FROM f),
h AS (SELECT *, CASE WHEN open <= stop THEN 'gap_stop' WHEN open >= target THEN 'gap_profit' WHEN low <= stop THEN 'stop' WHEN high >= target THEN 'profit' END AS hit FROM g),
o AS (SELECT symbol, ts, rn, max(entry) AS entry, min_by(hit, CASE WHEN hit IS NOT NULL THEN k END) AS hit, min(CASE WHEN hit IS NOT NULL THEN k END) AS k, min_by(CASE WHEN hit = 'gap_stop' OR hit = 'gap_profit' THEN open WHEN hit = 'stop' THEN stop WHEN hit = 'profit' THEN target END, CASE WHEN hit IS NOT NULL THEN k END) AS exit_at, max_by(close, k) AS last, count(*) AS n FROM h GROUP BY symbol, ts, rn)"""
LABELS = f"{WALK}, l AS (SELECT symbol, ts, rn, coalesce(hit, 'timeout') AS outcome, coalesce(k, n) AS bars, coalesce(exit_at, last) / entry - 1 AS ret FROM o WHERE hit IS NOT NULL OR n = {HORIZON})"

operator("y01_trailing_volatility", "Trailing volatility with a floor.", f"WITH {BARS.strip()} SELECT symbol, ts, @r6({VOL}) AS vol FROM rets")
operator("y02_barriers", "Dynamic barriers from volatility.", f"WITH {ENTRY} SELECT symbol, ts, " + cols({"profit": "2 * vol", "stop": "vol"}) + " FROM e")
operator("y03_triple_barrier", "First barrier that each entry's path reaches: a bounded range join and running extremes.", f"WITH {LABELS} SELECT symbol, ts, outcome, CAST(bars AS BIGINT) AS bars, @r6(ret) AS ret FROM l")
operator("y04_label_quality", "Label and quality by outcome.", f"WITH {LABELS} SELECT symbol, ts, CASE WHEN outcome IN ('profit', 'gap_profit') THEN 'win' WHEN outcome = 'timeout' AND ret > 0 THEN 'partial' ELSE 'loss' END AS label, CASE WHEN outcome = 'timeout' THEN 0.5 WHEN outcome LIKE 'gap%' THEN 0.8 ELSE 1.0 END AS quality FROM l".replace("0.5 WHEN", "CAST(0.5 AS DOUBLE) WHEN").replace("THEN 0.8 ELSE 1.0 END", "THEN CAST(0.8 AS DOUBLE) ELSE CAST(1.0 AS DOUBLE) END"))
operator("y05_label_history", "Outcomes over eligible entries, by symbol.", f"WITH {LABELS} SELECT symbol, outcome, count(*) AS n, @r6(avg(ret)) AS mean_ret FROM l GROUP BY symbol, outcome")
operator("y06_breach_dates", "Dates on which liquidity breached.", "SELECT DISTINCT symbol, @date(ts) AS day FROM {candles} WHERE volume < 10 OR high - low > 80")
operator("y07_as_of_value", "Last stored value at or before each entry.", f"WITH u AS (SELECT symbol, ts, 1 AS kind, CAST(NULL AS DOUBLE) AS value FROM {{candles}} UNION ALL SELECT symbol, ts - INTERVAL 90 MINUTES, 0, value FROM {{store}} WHERE feature_name = 'range'), h AS (SELECT *, @last_nn(value) OVER (PARTITION BY symbol ORDER BY ts, kind ROWS UNBOUNDED PRECEDING) AS held FROM u) SELECT symbol, ts, held FROM h WHERE kind = 1")
operator("y08_training_rows", "Labels joined with the features known at entry; thin rows drop.", f"WITH {LABELS}, x AS (SELECT symbol, ts, lr, tr, delta FROM rets) SELECT l.symbol, l.ts, @r6(x.lr) AS lr, @r6(x.tr) AS tr, @r6(x.delta) AS delta, CASE WHEN outcome IN ('profit', 'gap_profit') OR (outcome = 'timeout' AND ret > 0) THEN 1 ELSE 0 END AS target FROM l JOIN x ON l.symbol = x.symbol AND l.ts = x.ts WHERE (CASE WHEN lr IS NULL THEN 0 ELSE 1 END) + (CASE WHEN tr IS NULL THEN 0 ELSE 1 END) + (CASE WHEN delta IS NULL THEN 0 ELSE 1 END) >= 2")
operator("y10_standardise", "Mean and deviation of features; missing values take the mean.", f"WITH {BARS.strip()} SELECT symbol, ts, " + cols({f"{v}_std": f"@div(coalesce({v}, avg({v}) OVER (PARTITION BY symbol)) - avg({v}) OVER (PARTITION BY symbol), stddev_pop({v}) OVER (PARTITION BY symbol))" for v in ("lr", "tr", "delta")}) + " FROM rets")
PREDS = "p AS (SELECT doc_id AS id, @div(doc_id % 97, 96) AS p1, @div((doc_id * 7) % 89, 88) AS p2, @div((doc_id * 13) % 83, 82) AS p3, quality AS y FROM {labels})"
operator("y12_blend", "Weighted blend, uncertainty and disagreement of member models.", f"WITH {PREDS}, b AS (SELECT *, (p1 * 0.5 + p2 * 0.3 + p3 * 0.2) AS p, (p1 + p2 + p3) / 3 AS m FROM p) SELECT id, " + cols({"probability": "p", "uncertainty": "1 - 2 * abs(p - 0.5)", "disagreement": "least(1.0, 2 * sqrt(((p1 - m) * (p1 - m) + (p2 - m) * (p2 - m) + (p3 - m) * (p3 - m)) / 3))"}) + " FROM b")
operator("y13_explain", "Largest contributions of a linear model.", f"WITH {WIDE}, l AS (SELECT symbol, 'mom_5' AS feature, 0.5 * mom_5 AS c FROM latest UNION ALL SELECT symbol, 'mom_20', 0.3 * mom_20 FROM latest UNION ALL SELECT symbol, 'cmf', 0.2 * cmf FROM latest) SELECT symbol, feature, @r6(c) AS contribution, CAST(row_number() OVER (PARTITION BY symbol ORDER BY abs(c) DESC, feature) AS INT) AS rank FROM l WHERE c IS NOT NULL")
operator("y16_brier", "Brier scores of member models.", f"WITH {PREDS} SELECT " + cols({f"brier_{k}": f"coalesce(avg(power(p{k} - y, 2)), 1.0)" for k in (1, 2, 3)}) + " FROM p")
operator("y17_apply_calibration", "Calibrated probabilities by a logistic map.", f"WITH {PREDS}, c AS (SELECT id, least(0.999999, greatest(0.000001, p1)) AS q FROM p) SELECT id, @r6(1 / (1 + exp(-(0.8 * ln(q / (1 - q)) + 0.1)))) AS calibrated FROM c")
operator("y18_agreement", "Share of agreeing models, variance, spread and level.", f"WITH {PREDS}, l AS (SELECT id, p1 AS q FROM p UNION ALL SELECT id, p2 FROM p UNION ALL SELECT id, p3 FROM p) SELECT id, " + cols({"agreement": "greatest(avg(CASE WHEN q > 0.55 THEN 1 ELSE 0 END), avg(CASE WHEN q < 0.45 THEN 1 ELSE 0 END), avg(CASE WHEN q BETWEEN 0.45 AND 0.55 THEN 1 ELSE 0 END))", "variance": "var_pop(q)", "spread": "max(q) - min(q)"}) + ", CASE WHEN greatest(avg(CASE WHEN q > 0.55 THEN 1 ELSE 0 END), avg(CASE WHEN q < 0.45 THEN 1 ELSE 0 END)) >= 0.8 THEN 1 ELSE 0 END AS proceed FROM l GROUP BY id")
operator("y19_horizons", "Probability of a rise over several horizons of a lognormal path.", f"WITH {WIDE}, h AS (SELECT symbol, m, (coalesce(lean, 0) * CAST(0.001 AS DOUBLE) * m) / nullif(hv_20 / 100 * sqrt(CAST(m AS DOUBLE)), 0.0) AS x FROM latest JOIN (SELECT 15 AS m UNION ALL SELECT 30 UNION ALL SELECT 60 UNION ALL SELECT 240) t ON 1 = 1), k AS (SELECT *, 1 / (1 + CAST(0.2316419 AS DOUBLE) * abs(x)) AS kk FROM h) SELECT symbol, m AS minutes, @r6({normal_cdf('x', 'kk')}) AS probability_up FROM k")
operator("y20_drift_volatility", "Drift and volatility inputs.", f"WITH {WIDE} SELECT symbol, " + cols({"mu": "lean / 252", "sigma": "hv_20 / 100"}) + " FROM latest")
operator("y21_similarity_outcomes", "Distribution of forward outcomes by percentiles.", f"WITH {LABELS} SELECT symbol, " + cols({f"p{q}": f"@pct(ret, {q / 100})" for q in (10, 25, 50, 75, 90)}) + " FROM l GROUP BY symbol")
operator("y22_alpha_research", "Correlation of a feature with outcomes and its decay between halves.", f"WITH {LABELS}, j AS (SELECT l.symbol, l.ts, l.ret, rets.tr AS v, row_number() OVER (PARTITION BY l.symbol ORDER BY l.ts) AS i, count(*) OVER (PARTITION BY l.symbol) AS n FROM l JOIN rets ON l.symbol = rets.symbol AND l.ts = rets.ts WHERE rets.tr IS NOT NULL), c AS (SELECT symbol, CASE WHEN i <= @idiv(n, 2) THEN 1 ELSE 2 END AS half, covar_pop(v, ret) / nullif(sqrt(var_pop(v) * var_pop(ret)), 0.0) AS r FROM j GROUP BY 1, 2) SELECT symbol, " + cols({"first_half": "abs(max(CASE WHEN half = 1 THEN r END))", "second_half": "abs(max(CASE WHEN half = 2 THEN r END))"}) + " FROM c GROUP BY symbol")
operator("y23_champion", "Challenger against champion by accuracy.", f"WITH {PREDS}, a AS (SELECT avg(CASE WHEN (p1 >= 0.5 AND y = 1) OR (p1 < 0.5 AND y = 0) THEN 1 ELSE 0 END) AS champion, avg(CASE WHEN (p2 >= 0.5 AND y = 1) OR (p2 < 0.5 AND y = 0) THEN 1 ELSE 0 END) AS challenger FROM p) SELECT @r6(champion) AS champion, @r6(challenger) AS challenger, CASE WHEN challenger > champion + 0.01 THEN 'promote' WHEN challenger < champion - 0.01 THEN 'keep' ELSE 'tie' END AS verdict FROM a")
operator("y24_leaderboard", "Best of the newest rows; the limit comes before the sort.", "SELECT id, value FROM (SELECT id, value FROM {observations} WHERE value IS NOT NULL ORDER BY id DESC LIMIT 500) q ORDER BY value DESC, id LIMIT 20")
operator("y26_reason_codes", "Reasons that hold, in order.", f"WITH {WIDE} SELECT symbol, CASE WHEN lean > 0.2 THEN 'momentum;' ELSE '' END || CASE WHEN vol_level > 0.6 THEN 'volatile;' ELSE '' END || CASE WHEN rvol > 1.5 THEN 'volume;' ELSE '' END || CASE WHEN pos > 0.8 THEN 'near_high;' ELSE '' END AS reasons FROM latest")

# 2.19 ------------------------------------------------------------------------------------------------------------
operator("z07_signal_streak", "Runs of one direction without a gap over twenty minutes.", "WITH d AS (SELECT symbol, ts, CASE WHEN ltp > 20 THEN 'long' ELSE 'short' END AS dir, lag(ts) OVER (PARTITION BY symbol ORDER BY ts, event_id) AS pts, lag(CASE WHEN ltp > 20 THEN 'long' ELSE 'short' END) OVER (PARTITION BY symbol ORDER BY ts, event_id) AS pdir, event_id FROM {ticks}), g AS (SELECT *, sum(CASE WHEN pts IS NULL OR dir <> pdir OR @unix(ts) - @unix(pts) > 1200 THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM d) SELECT symbol, CAST(run AS BIGINT) AS run, min(dir) AS direction, min(ts) AS since, count(*) AS n FROM g GROUP BY symbol, run")
operator("z08_snapshot_freeze", "Values and versions frozen at a moment.", "SELECT symbol, feature_name, feature_version, value, ts FROM (SELECT *, row_number() OVER (PARTITION BY symbol, feature_name ORDER BY ts DESC, feature_version DESC) AS k FROM {store}) q WHERE k = 1")
operator("z14_pair_correlation", "Correlation of returns on common times, by pair.", f"WITH {BARS.strip()} SELECT a.symbol AS x, b.symbol AS y, @r6(covar_pop(a.lr, b.lr) / nullif(sqrt(var_pop(a.lr) * var_pop(b.lr)), 0.0)) AS r, count(*) AS n FROM rets a JOIN rets b ON a.ts = b.ts AND a.symbol < b.symbol WHERE a.lr IS NOT NULL AND b.lr IS NOT NULL GROUP BY a.symbol, b.symbol")
LOG = "lg AS (SELECT conv_id AS lifecycle_id, turn AS seq, role AS stage FROM {conversations})"
operator("z15_lifecycle", "State machine over an append-only log; repeats of a stage are ignored.", f"WITH {LOG}, d AS (SELECT *, lag(stage) OVER (PARTITION BY lifecycle_id ORDER BY seq) AS before FROM lg) SELECT lifecycle_id, count(*) AS transitions, max_by(stage, seq) AS stage, CAST(sum(CASE WHEN before = 'assistant' AND stage = 'system' THEN 1 ELSE 0 END) AS BIGINT) AS invalid FROM d WHERE before IS NULL OR before <> stage GROUP BY lifecycle_id")
operator("z16_lifecycle_metrics", "Delay and lifetime of each lifecycle.", f"WITH {LOG}, s AS (SELECT lifecycle_id, min(CASE WHEN stage = 'user' THEN seq END) AS detected, min(CASE WHEN stage = 'assistant' THEN seq END) AS acted, max(seq) AS ended FROM lg GROUP BY lifecycle_id) SELECT lifecycle_id, acted - detected AS delay, ended - detected AS lifetime FROM s")

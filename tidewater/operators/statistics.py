"""Quality, drift and feature selection."""

from __future__ import annotations

from tidewater.operators.rolling import BARS, cols
from tidewater.plans.dialect import operator

#: The newest 100 values of each feature against the 400 before them.
SPLIT = "n AS (SELECT symbol, feature_name, ts, value, row_number() OVER (PARTITION BY symbol, feature_name ORDER BY ts DESC) AS k FROM {store}), v AS (SELECT *, CASE WHEN k <= 100 THEN 1 ELSE 0 END AS recent FROM n WHERE k <= 500)"
G = "PARTITION BY symbol, feature_name"
KS = f"c AS (SELECT symbol, feature_name, value, sum(recent) OVER ({G} ORDER BY value RANGE UNBOUNDED PRECEDING) AS a, sum(1 - recent) OVER ({G} ORDER BY value RANGE UNBOUNDED PRECEDING) AS b, sum(recent) OVER ({G}) AS na, sum(1 - recent) OVER ({G}) AS nb FROM v), ks AS (SELECT symbol, feature_name, max(abs(@div(a, na) - @div(b, nb))) AS ks FROM c GROUP BY symbol, feature_name)"
EDGES = "e AS (SELECT symbol, feature_name, " + ", ".join(f"@pct(CASE WHEN {{w}} THEN value END, {q / 10}) AS e{q}" for q in range(1, 10)) + " FROM v GROUP BY symbol, feature_name)"
BIN = " + ".join(f"(CASE WHEN value > e{q} THEN 1 ELSE 0 END)" for q in range(1, 10))


def binned(which: str) -> str:
    """Equal-mass bins of the chosen rows; a value equal to an edge goes to the lower bin."""
    return f"{EDGES.replace('{w}', which)}, b AS (SELECT v.symbol, v.feature_name, recent, {BIN} AS bin FROM v JOIN e ON v.symbol = e.symbol AND v.feature_name = e.feature_name), h AS (SELECT symbol, feature_name, bin, CAST(sum(recent) AS DOUBLE) AS a, CAST(sum(1 - recent) AS DOUBLE) AS b FROM b GROUP BY symbol, feature_name, bin), p AS (SELECT *, a / nullif(sum(a) OVER ({G}), 0.0) AS pa, b / nullif(sum(b) OVER ({G}), 0.0) AS pb FROM h)"


EPS = "CAST(0.000001 AS DOUBLE)"
PSI = f"SELECT symbol, feature_name, sum((greatest(pa, {EPS}) - greatest(pb, {EPS})) * ln(greatest(pa, {EPS}) / greatest(pb, {EPS}))) AS psi FROM p GROUP BY symbol, feature_name"
operator("q01_ks", "Two-sample Kolmogorov-Smirnov statistic; ties by range frames.", f"WITH {SPLIT}, {KS} SELECT symbol, feature_name, @r6(ks) AS ks FROM ks")
operator("q02_psi", "Population stability over the reference's equal-mass bins.", f"WITH {SPLIT}, {binned('recent = 0')} SELECT symbol, feature_name, @r6(psi) AS psi FROM ({PSI}) x")
operator("q03_jensen_shannon", "Jensen-Shannon distance over pooled equal-mass bins.", f"WITH {SPLIT}, {binned('recent >= 0')} SELECT symbol, feature_name, @r6(sqrt(greatest(0.0, 0.5 * sum(CASE WHEN pa > 0 THEN pa * ln(2 * pa / (pa + pb)) / ln(CAST(2 AS DOUBLE)) ELSE 0.0 END) + 0.5 * sum(CASE WHEN pb > 0 THEN pb * ln(2 * pb / (pa + pb)) / ln(CAST(2 AS DOUBLE)) ELSE 0.0 END)))) AS js FROM p GROUP BY symbol, feature_name")
operator("q04_population_shift", "Shift of the mean in pooled deviations.", f"WITH {SPLIT} SELECT symbol, feature_name, @r6(@div(abs(avg(CASE WHEN recent = 1 THEN value END) - avg(CASE WHEN recent = 0 THEN value END)), stddev_pop(value))) AS shift FROM v GROUP BY symbol, feature_name")
operator("q05_autocorrelation", "Lag-one autocorrelation around the series' mean.", "WITH m AS (SELECT symbol, feature_name, ts, value - avg(value) OVER (PARTITION BY symbol, feature_name) AS d FROM {store}), l AS (SELECT *, lag(d) OVER (PARTITION BY symbol, feature_name ORDER BY ts) AS pd FROM m) SELECT symbol, feature_name, @r6(@div(sum(d * pd), sum(d * d))) AS autocorrelation FROM l GROUP BY symbol, feature_name")
operator("q06_series_quality", "Completeness, stability and variance of a series, blended.", f"WITH {SPLIT}, s AS (SELECT symbol, feature_name, count(value) AS n, avg(value) AS m, stddev_pop(value) AS sd, @unix(max(ts)) - @unix(min(ts)) AS span FROM v GROUP BY symbol, feature_name) SELECT symbol, feature_name, @r6(least(100.0, @div(n, span / 3600 + 1) * 100)) AS completeness, @r6(100 * greatest(0.0, 1 - @div(sd, abs(m) * 3))) AS stability, CASE WHEN sd > 0 THEN 100 ELSE 0 END AS variance FROM s")
operator("q07_forward_returns", "Next bar's log return.", "SELECT symbol, ts, @r6(CASE WHEN close > 0 AND nxt > 0 THEN ln(nxt / close) END) AS forward_return FROM (SELECT *, lead(close) OVER (PARTITION BY symbol ORDER BY ts) AS nxt FROM {candles}) q")
operator("q08_groups", "Distinct series.", "SELECT DISTINCT symbol, timeframe, feature_name FROM {store}")
operator("q09_drift", "Drift metrics in long form with their thresholds.", f"WITH {SPLIT}, {KS}, {binned('recent = 0')}, psi AS ({PSI}), l AS (SELECT symbol, feature_name, 'ks' AS metric, ks AS value, CAST(0.2 AS DOUBLE) AS threshold FROM ks UNION ALL SELECT symbol, feature_name, 'psi', psi, CAST(0.25 AS DOUBLE) FROM psi) SELECT symbol, feature_name, metric, @r6(value) AS value, threshold, CASE WHEN value > threshold THEN 1 ELSE 0 END AS breached FROM l")
operator("q10_cadence", "Observations a day, recent against reference.", f"WITH {SPLIT}, c AS (SELECT symbol, feature_name, recent, @div(count(*), @unix(max(ts)) - @unix(min(ts))) AS rate FROM v GROUP BY symbol, feature_name, recent) SELECT symbol, feature_name, @r6(@div(max(CASE WHEN recent = 1 THEN rate END), max(CASE WHEN recent = 0 THEN rate END))) AS ratio FROM c GROUP BY symbol, feature_name")
operator("q11_concept_shift", "Change of a feature's correlation with the forward return.", f"WITH {SPLIT}, r AS (SELECT symbol, ts, ln(lead(close) OVER (PARTITION BY symbol ORDER BY ts) / close) AS fr FROM {{candles}} WHERE close > 0), j AS (SELECT v.symbol, feature_name, recent, value, fr FROM v JOIN r ON v.symbol = r.symbol AND v.ts = r.ts WHERE fr IS NOT NULL), c AS (SELECT symbol, feature_name, recent, covar_pop(value, fr) / nullif(sqrt(var_pop(value) * var_pop(fr)), 0.0) AS c FROM j GROUP BY symbol, feature_name, recent) SELECT symbol, feature_name, @r6(abs(max(CASE WHEN recent = 1 THEN c END) - max(CASE WHEN recent = 0 THEN c END))) AS shift FROM c GROUP BY symbol, feature_name")

MATRIX = f"{BARS.strip()}, x AS (SELECT symbol, ts, lr, tr, delta, volume, ln(lead(close) OVER (PARTITION BY symbol ORDER BY ts) / close) AS fr, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS k FROM rets WHERE close > 0), m AS (SELECT * FROM x WHERE k BETWEEN 2 AND 251 AND lr IS NOT NULL)"
LONG = "l AS (SELECT symbol, ts, fr, 'lr' AS feature, CAST(lr AS DOUBLE) AS v FROM m UNION ALL SELECT symbol, ts, fr, 'tr', tr FROM m UNION ALL SELECT symbol, ts, fr, 'delta', delta FROM m WHERE delta IS NOT NULL UNION ALL SELECT symbol, ts, fr, 'volume', volume FROM m)"
operator("g01_matrix", "Aligned matrix of the last 250 bars, forward filled; thin features drop.", f"WITH {MATRIX} SELECT symbol, ts, @r6(lr) AS lr, @r6(tr) AS tr, @r6(@last_nn(delta) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING)) AS delta, volume, @r6(fr) AS target FROM m")
operator("g02_mutual_information", "Mutual information over equal-frequency bins by position.", f"WITH {MATRIX}, {LONG}, b AS (SELECT symbol, feature, @idiv((row_number() OVER (PARTITION BY symbol, feature ORDER BY v, ts) - 1) * 5, count(*) OVER (PARTITION BY symbol, feature)) AS i, @idiv((row_number() OVER (PARTITION BY symbol, feature ORDER BY fr, ts) - 1) * 3, count(*) OVER (PARTITION BY symbol, feature)) AS j FROM l), c AS (SELECT symbol, feature, i, j, CAST(count(*) AS DOUBLE) AS n FROM b GROUP BY symbol, feature, i, j), t AS (SELECT *, sum(n) OVER (PARTITION BY symbol, feature) AS t, sum(n) OVER (PARTITION BY symbol, feature, i) AS ni, sum(n) OVER (PARTITION BY symbol, feature, j) AS nj FROM c) SELECT symbol, feature, @r6(sum(n / t * ln(n * t / (ni * nj)))) AS mi FROM t GROUP BY symbol, feature")
operator("g03_redundancy", "Correlations of features with each other, for the greedy filter.", f"WITH {MATRIX}, {LONG} SELECT a.symbol, a.feature AS x, b.feature AS y, @r6(covar_pop(a.v, b.v) / nullif(sqrt(var_pop(a.v) * var_pop(b.v)), 0.0)) AS r FROM l a JOIN l b ON a.symbol = b.symbol AND a.ts = b.ts AND a.feature < b.feature GROUP BY a.symbol, a.feature, b.feature")
operator("g04_ridge_moments", "Gram matrix entries of the ridge fit, by partial aggregation.", f"WITH {MATRIX}, {LONG} SELECT a.symbol, a.feature AS x, b.feature AS y, @r6(covar_pop(a.v, b.v)) AS gram, @r6(covar_pop(a.v, a.fr)) AS rhs FROM l a JOIN l b ON a.symbol = b.symbol AND a.ts = b.ts GROUP BY a.symbol, a.feature, b.feature")
operator("g06_linear_shap", "Mean absolute linear attribution and rank of each feature.", f"WITH {MATRIX}, {LONG}, s AS (SELECT symbol, feature, abs(covar_pop(v, fr) / nullif(var_pop(v), 0.0)) * avg(abs(v - mean)) AS shap FROM (SELECT *, avg(v) OVER (PARTITION BY symbol, feature) AS mean FROM l) q GROUP BY symbol, feature) SELECT symbol, feature, @r6(shap) AS shap, CAST(row_number() OVER (PARTITION BY symbol ORDER BY shap DESC, feature) AS INT) AS rank FROM s")
operator("g07_usage_rows", "Recommended set to upsert, by absolute correlation with the target.", f"WITH {MATRIX}, {LONG}, c AS (SELECT symbol, feature, abs(covar_pop(v, fr) / nullif(sqrt(var_pop(v) * var_pop(fr)), 0.0)) AS r FROM l GROUP BY symbol, feature) SELECT symbol, feature, CAST(rank AS INT) AS rank FROM (SELECT symbol, feature, row_number() OVER (PARTITION BY symbol ORDER BY r DESC, feature) AS rank FROM c) q WHERE rank <= 3")

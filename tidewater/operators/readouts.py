"""Readers, registries and readouts that complete the inventory; parsers run on payloads made from the tables themselves."""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions import kernels
from tidewater.operators import rolling, snapshots, statistics, store  # noqa: F401  their definitions come first
from tidewater.operators.decision import LABELS, PREDS
from tidewater.operators.rolling import cols
from tidewater.operators.scoring import mean
from tidewater.operators import newswords
from tidewater.operators.newswords import NEGATIVE, POSITIVE
from tidewater.operators.statistics import LONG, MATRIX
from tidewater.plans.dialect import CATALOG, Operator, operator
from tidewater.sources import readers

operator("t16_cascade_disable", "Collectors that a disabled one takes along, with their depth.", "WITH RECURSIVE e AS (SELECT * FROM (VALUES ('candles', 'ticks'), ('breadth', 'candles'), ('sector', 'breadth'), ('options', 'ticks'), ('news', 'rss')) AS t(name, needs)), d AS (SELECT 'ticks' AS name, 0 AS depth UNION ALL SELECT e.name, d.depth + 1 FROM e JOIN d ON e.needs = d.name) SELECT name, CAST(depth AS INT) AS depth FROM d")
operator("f05_archive_partitions", "Rows that each partition of the archive gets.", "SELECT symbol, timeframe, feature_name, count(*) AS n, min(ts) AS since, max(ts) AS until FROM {store} GROUP BY symbol, timeframe, feature_name")
operator("i04_timeframe_minutes", "Minutes of each timeframe name; days have none.", "SELECT tf, CASE WHEN tf LIKE '%m' THEN CAST(substr(tf, 1, length(tf) - 1) AS INT) WHEN tf LIKE '%H' THEN CAST(substr(tf, 1, length(tf) - 1) AS INT) * 60 END AS minutes FROM (SELECT '1m' AS tf UNION ALL SELECT '5m' UNION ALL SELECT '30m' UNION ALL SELECT '1H' UNION ALL SELECT 'D') t")
operator("y14_registry", "Datasets to register: hashes that aren't known yet.", "SELECT DISTINCT n.name, n.fingerprint FROM (SELECT feature_name AS name, count(*) % 7 AS fingerprint FROM {store} GROUP BY feature_name) n WHERE NOT EXISTS (SELECT 1 FROM (SELECT 'close' AS name) o WHERE o.name = n.name)")
operator("y25_top_features", "Features by attribution weighted over models.", f"WITH {MATRIX}, {LONG}, s AS (SELECT feature, avg(abs(v)) * abs(covar_pop(v, fr) / nullif(var_pop(v), 0.0)) AS w FROM l GROUP BY feature, symbol) SELECT feature, @r6(sum(w)) AS attribution FROM s GROUP BY feature")
operator("h19_expiry_events", "Expiries within thirty days.", "WITH b AS (SELECT min(@date(o_orderdate)) AS lo FROM {orders}) SELECT DISTINCT o_orderpriority AS code, @date(o_orderdate) AS expiry FROM {orders} JOIN b ON @date(o_orderdate) >= lo AND @days(o_orderdate, lo) <= 30")
operator("h27_raw_ticks", "Raw ticks to append.", "SELECT event_id, symbol, ts, ltp FROM {ticks}")
operator("h29_signed_score", "Positive minus negative probability.", f"WITH {PREDS} SELECT id, @r6(p1 - p2) AS signed_score FROM p")
operator("h38_replay_matrix", "State of each symbol's features at each day's start.", CATALOG["f11_walk_forward"].text)
operator("h39_daily_pass", "Passes that run only for the daily timeframe.", "SELECT symbol, max_by(bid, ts) AS bid, max_by(ask, ts) AS ask, count(*) AS quotes FROM {quotes} GROUP BY symbol")
operator("h40_session_gate", "Symbols with a complete session to process.", "SELECT symbol, count(*) AS sessions FROM (SELECT symbol, @date(@ist(ts)) AS d FROM {candles} GROUP BY symbol, @date(@ist(ts)) HAVING count(*) >= 15) q GROUP BY symbol")
operator("h42_market_wide_rows", "Market-wide rows, keyed without a symbol loop.", "SELECT 'MARKET' AS symbol, ts, @r6(avg(close)) AS value FROM {candles} GROUP BY ts")
operator("h45_belief_history", "Newest beliefs of each series, oldest first.", "SELECT label, id, value FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY id DESC) AS k FROM {observations} WHERE value IS NOT NULL) q WHERE k <= 30")
operator("h51_feature_label_pairs", "As-of pairs of a feature and an outcome of enough quality.", f"WITH {LABELS} SELECT l.symbol, l.ts, @r6(rets.tr) AS feature, @r6(l.ret) AS outcome FROM l JOIN rets ON l.symbol = rets.symbol AND l.ts = rets.ts WHERE rets.tr IS NOT NULL AND l.outcome <> 'timeout'")
operator("h52_mean_accuracy", "Mean holdout accuracy of the member models.", f"WITH {PREDS} SELECT " + cols({"accuracy": "(" + " + ".join(f"avg(CASE WHEN (p{k} >= 0.5 AND y = 1) OR (p{k} < 0.5 AND y = 0) THEN 1 ELSE 0 END)" for k in (1, 2, 3)) + ") / 3"}) + " FROM p WHERE id % 5 = 0")
operator("h53_comparison_leaderboard", "Largest improvements among the newest comparisons.", "SELECT id, improvement FROM (SELECT id, value - lag(value) OVER (ORDER BY id) AS improvement FROM (SELECT id, value FROM {observations} WHERE value IS NOT NULL ORDER BY id DESC LIMIT 300) a) q WHERE improvement IS NOT NULL ORDER BY improvement DESC, id LIMIT 10".replace("SELECT id, improvement", "SELECT id, @r6(improvement) AS improvement"))
operator("h54_temperature", "Negative log likelihood of a grid of temperatures.", f"WITH {PREDS}, c AS (SELECT y, least(CAST(0.999999 AS DOUBLE), greatest(CAST(0.000001 AS DOUBLE), p1)) AS q FROM p), t AS (SELECT CAST(k AS DOUBLE) / 4 AS temp FROM (SELECT 1 AS k UNION ALL SELECT 2 UNION ALL SELECT 4 UNION ALL SELECT 8 UNION ALL SELECT 16 UNION ALL SELECT 40) g) SELECT temp, @r6(-avg(CASE WHEN y = 1 THEN @ln(1 / (1 + exp(-ln(q / (1 - q)) / temp))) ELSE @ln(1 - 1 / (1 + exp(-ln(q / (1 - q)) / temp))) END)) AS nll FROM c JOIN t ON 1 = 1 GROUP BY temp")
operator("h57_blended_probabilities", "Weighted holdout probabilities.", f"WITH {PREDS} SELECT id, @r6((p1 * 0.2 + p2 * 0.1 + p3 * 0.1) / 0.4) AS p FROM p WHERE id % 5 = 0")
operator("h58_prediction_defaults", "Prediction with its defaults where a model is missing.", f"WITH {PREDS}, m AS (SELECT id, CASE WHEN id % 3 = 0 THEN p1 END AS p FROM p) SELECT id, @r6(coalesce(p, 0.5)) AS probability, @r6(CASE WHEN p IS NULL THEN 1.0 ELSE 1 - 2 * abs(p - 0.5) END) AS uncertainty FROM m")
operator("h59_feature_series", "One scan of a chosen set of features.", "SELECT symbol, feature_name, feature_version, ts, value FROM {store} WHERE feature_name IN ('close', 'range') AND timeframe = '1H'")
operator("h77_normalised_attribution", "Attributions as shares of their sum.", f"WITH {MATRIX}, {LONG}, s AS (SELECT symbol, feature, abs(covar_pop(v, fr)) / nullif(stddev_pop(v), 0.0) AS a FROM l GROUP BY symbol, feature) SELECT symbol, feature, @r6(a / nullif(sum(a) OVER (PARTITION BY symbol), 0.0)) AS share FROM s")

CANDLES_SQL = "SELECT symbol, ts, open, high, low, close, volume FROM {candles}"


def _candles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Operator("candles", "", "SELECT * FROM {candles}").run(spark, sf_dir)


def chart_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candles as one chart payload a symbol and day, parsed again."""
    c = _candles(spark, sf_dir).withColumn("d", F.to_date("ts"))
    rows = c.groupBy("symbol", "d").agg(F.sort_array(F.collect_list(F.struct(F.unix_timestamp(F.col("ts").cast("timestamp")).alias("t"), "open", "high", "low", "close", "volume"))).alias("r"))
    col = lambda k: F.transform("r", lambda x: x[k]).alias(k)
    quote = F.struct(*[col(k) for k in ("open", "high", "low", "close", "volume")])
    body = F.to_json(F.struct(F.struct(F.array(F.struct(F.transform("r", lambda x: x["t"]).alias("timestamp"), F.struct(F.array(quote).alias("quote")).alias("indicators"))).alias("result")).alias("chart")))
    return readers.chart_candles(rows.select("symbol", body.alias("body"))).select("symbol", "ts", "open", "high", "low", "close", "volume")


def positional_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candles as positional arrays, parsed again."""
    c = _candles(spark, sf_dir).withColumn("d", F.to_date("ts"))
    row = F.array(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), *[F.col(k).cast("string") for k in ("open", "high", "low", "close", "volume")])
    raw = c.groupBy("symbol", "d").agg(F.to_json(F.collect_list(row)).alias("body"))
    return readers.positional_candles(raw)


def packets(ticks: DataFrame) -> DataFrame:
    """event_id and price in hundredths from little-endian packets (8 bytes each)."""
    value = lambda at: F.conv(F.hex(F.concat(*[F.expr(f"substring(packet, {at + 8 - k}, 1)") for k in range(1, 9)])), 16, 10).cast("long")
    return ticks.select(value(1).alias("event_id"), value(9).alias("price"))


def packet_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Operator("ticks", "", "SELECT event_id, ltp FROM {ticks}").run(spark, sf_dir)
    raw = lambda c: F.expr(f"unhex(lpad(hex({c}), 16, '0'))")
    big = t.select(raw("event_id").alias("a"), raw("CAST(round(ltp * 100) AS BIGINT)").alias("b"))
    flip = lambda c: F.concat(*[F.expr(f"substring({c}, {9 - k}, 1)") for k in range(1, 9)])
    return packets(big.select(F.concat(flip("a"), flip("b")).alias("packet")))


def provider_sentiment(texts: DataFrame, score) -> DataFrame:
    """doc_id, sentiment by a pluggable batch scorer (list of texts to list of numbers), in Arrow batches."""

    def run(it):
        for pdf in it:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "sentiment": score(pdf["text"].tolist())})

    return texts.select("doc_id", "text").mapInPandas(run, "doc_id long, sentiment double")


def lexicon_scorer(texts: list[str]) -> list[float]:
    import re

    out = []
    for t in texts:
        spaced = f" {' '.join(re.findall('[a-z0-9]+', (t or '').lower()))} "
        pos, neg = (sum(w * spaced.count(f" {k} ") for k, w in d.items()) for d in (POSITIVE, NEGATIVE))
        out.append(round((pos - neg) / (pos + neg) + 1e-9, 6) + 0.0 if pos + neg else 0.0)
    return out


RIDGE, SHUFFLE_SEED = 1.0, 42  # fixed values


def permutation_importance(x: np.ndarray, y: np.ndarray, seed: int = SHUFFLE_SEED) -> list[float]:
    """Rise of a ridge fit's squared error when a column is shuffled, never below 0; each column has a seed of its own."""
    z = (x - x.mean(0)) / np.where(x.std(0) > 0, x.std(0), 1)
    w = np.linalg.solve(z.T @ z / len(z) + RIDGE / len(z) * np.eye(z.shape[1]), z.T @ y / len(z))
    left = y - z @ w
    rises = []
    for k, column in enumerate(z.T):
        mixed = column.tolist()
        random.Random(seed + k).shuffle(mixed)
        rises.append(max(0.0, float(((left + w[k] * (column - mixed)) ** 2).mean() - (left**2).mean())))
    return rises


def permutation_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = CATALOG["g01_matrix"].run(spark, sf_dir)

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("ts").fillna(0.0)
        names = ["lr", "tr", "delta", "volume"]
        got = permutation_importance(rows[names].to_numpy(float), rows["target"].to_numpy(float))
        return pd.DataFrame({"symbol": rows["symbol"].iloc[0], "feature": names, "importance": got})

    return m.groupBy("symbol").applyInPandas(lambda rows: one(rows), "symbol string, feature string, importance double")


def dispatch_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _candles(spark, sf_dir)
    w = kernels.frame(["symbol"], "ts")
    sr = c.select("symbol", "ts", F.when(F.lag("close").over(w) > 0, F.col("close") / F.lag("close").over(w) - 1).alias("sr"))
    out = kernels.normalise(kernels.normalise(sr, ["sr"], "minmax", ["symbol"], "ts", 20, "_20"), ["sr"], "minmax", ["symbol"], "ts", 100, "_100")
    r6 = lambda c: F.round(F.col(c) + 1e-9, 6) + 0.0
    return out.select("symbol", "ts", r6("sr_20").alias("mm_20"), r6("sr_100").alias("mm_100"))


QUERIES = {
    "s05_packets": packet_round_trip,
    "s12_chart_candles": chart_round_trip,
    "h05_positional_candles": positional_round_trip,
    "k07_dispatch": dispatch_query,
    "d17_sentiment_provider": lambda spark, d: provider_sentiment(newswords._texts(spark, d), lexicon_scorer),
    "g05_permutation_importance": permutation_query,
}


def oracle_sql() -> dict[str, str]:
    made = lambda text: Operator("", "", text).oracle()
    return {
        "s05_packets": made("SELECT event_id, CAST(round(ltp * 100) AS BIGINT) AS price FROM {ticks}"),
        "s12_chart_candles": made(CANDLES_SQL),
        "h05_positional_candles": made(CANDLES_SQL),
        "k07_dispatch": CATALOG["k02_rolling_minmax"].oracle(),
        "d17_sentiment_provider": newswords.ORACLES["d16_lexicon_sentiment"],
    }



"""Operators whose state depends on the order of rows: structure, greedy filters, path distances, models.

Each runs once per series on the series' ordered rows (``applyInPandas``); a series is one symbol's history, which
is bounded by its calendar, never by the number of symbols.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.operators.novelty import novelty
from tidewater.operators.swings import structure, value_area
from tidewater.plans.dialect import CATALOG, Operator

def session_profiles(candles: DataFrame, bins: int = 30, least: int = 15) -> DataFrame:
    """Volume profile of each complete local session: point of control and value area prices."""

    def one(bars: pd.DataFrame) -> pd.DataFrame:
        lo, hi = bars["low"].min(), bars["high"].max()
        if len(bars) < least or hi <= lo:
            return pd.DataFrame([], columns=["symbol", "session", "poc", "val", "vah"])
        at = np.minimum((bars["close"] - lo) / ((hi - lo) / bins), bins - 1).astype(int)
        p, a, b = value_area(np.bincount(at, weights=bars["volume"], minlength=bins))
        step = (hi - lo) / bins
        return pd.DataFrame([(bars["symbol"].iloc[0], bars["session"].iloc[0], lo + (p + 0.5) * step, lo + a * step, lo + (b + 1) * step)], columns=["symbol", "session", "poc", "val", "vah"])

    d = candles.withColumn("session", F.to_date(F.col("ts") + F.expr("INTERVAL 330 MINUTES")))
    return d.groupBy("symbol", "session").applyInPandas(one, "symbol string, session date, poc double, val double, vah double")


def dtw(a: np.ndarray, b: np.ndarray) -> float:
    """Dynamic time warping distance of two vector paths."""
    cost = np.sqrt(((a[:, None, :] - b[None, :, :]) ** 2).sum(-1))
    d = np.full((len(a) + 1, len(b) + 1), np.inf)
    d[0, 0] = 0.0
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = cost[i - 1, j - 1] + min(d[i - 1, j], d[i, j - 1], d[i - 1, j - 1])
    return float(d[-1, -1])


def _dtw_each(now: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Dynamic time warping distance of one path of numbers to each of the windows."""
    n = len(now)
    cost = np.abs(now[None, :, None] - windows[:, None, :])
    d = np.full((n + 1, n + 1, len(windows)), np.inf)
    d[0, 0] = 0.0
    for i in range(1, n + 1):
        for j in range(1, n + 1):
            d[i, j] = cost[:, i - 1, j - 1] + np.minimum(np.minimum(d[i - 1, j], d[i, j - 1]), d[i - 1, j - 1])
    return d[n, n]


def analog_paths(candles: DataFrame, length: int = 10, top: int = 20) -> DataFrame:
    """Each symbol's newest path of ``length`` returns against all earlier ones that end before it, nearest first."""

    def one(bars: pd.DataFrame) -> pd.DataFrame:
        bars = bars.sort_values("ts").reset_index(drop=True)
        r = np.diff(np.log(bars["close"].to_numpy()))
        starts = range(max(0, len(r) - 2 * length + 1))
        found = []
        for at in range(0, len(starts), 4096):
            own = starts[at : at + 4096]
            windows = np.lib.stride_tricks.sliding_window_view(r, length)[own.start : own.stop]
            found = sorted([*found, *zip(_dtw_each(r[-length:], windows).tolist(), own)])[:top]
        return pd.DataFrame([(bars["symbol"].iloc[0], k + 1, bars["ts"][s], d) for k, (d, s) in enumerate(found)], columns=["symbol", "rank", "ts", "distance"])

    return candles.where("close > 0").select("symbol", "ts", "close").groupBy("symbol").applyInPandas(one, "symbol string, rank int, ts timestamp, distance double")


def filter_signals(signals: list[dict], correlation: dict[tuple[str, str], float], gap_minutes: int = 60, limit: float = 0.8) -> list[dict]:
    """Greedy pass over a ranked list (a few dozen rows): repeats, correlated symbols, second breakouts and sectors drop."""
    kept: list[dict] = []
    for s in signals:
        why = None
        for k in kept:
            r = correlation.get(tuple(sorted((s["symbol"], k["symbol"]))), 0.0)
            if s["symbol"] == k["symbol"] and s["direction"] == k["direction"] and abs(s["minute"] - k["minute"]) <= gap_minutes:
                why = "repeat"
            elif s["symbol"] != k["symbol"] and abs(r) >= limit:
                why = "correlated"
            elif "breakout" in s["reason"].lower() and "breakout" in k["reason"].lower():
                why = "breakout"
            elif s.get("sector") and s.get("sector") == k.get("sector"):
                why = "sector"
            if why:
                break
        if not why:
            kept.append(s)
    return kept


def dataset_hash(rows: DataFrame, names: list[str]) -> DataFrame:
    """One SHA-256 over the ordered canonical lines of a training table, from per-line digests in (symbol, ts) order."""
    line = F.concat_ws("|", F.col("symbol"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), *[F.coalesce(F.format_number(n, 6), F.lit("")) for n in names])
    lines = rows.groupBy("symbol").agg(F.sha2(F.concat_ws("\n", F.sort_array(F.collect_list(line))), 256).alias("h"))
    return lines.agg(F.sha2(F.concat_ws("\n", F.sort_array(F.collect_list(F.concat_ws(":", "symbol", "h")))), 256).alias("dataset_hash"), F.count("*").alias("groups"))


def select_features(corr: dict[tuple[str, str], float], mi: dict[str, float], limit: float = 0.95, most: int = 20) -> list[str]:
    """Information-descending greedy choice without near-copies; the inputs are as many as features, squared."""
    kept: list[str] = []
    for f in sorted(mi, key=lambda x: (-mi[x], x)):
        if all(abs(corr.get(tuple(sorted((f, k))), 0.0)) < limit for k in kept):
            kept.append(f)
        if len(kept) == most:
            break
    return kept


def train_models(rows: DataFrame, features: list[str], label: str = "target") -> DataFrame:
    """Chronological 80/20 split, three classifiers, weights from holdout accuracy: model, accuracy, weight."""
    from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
    from pyspark.ml.feature import Imputer, VectorAssembler

    cutoff = rows.select(F.percentile(F.unix_timestamp("ts"), F.lit(0.8)).alias("t")).first()["t"]
    filled = Imputer(inputCols=features, outputCols=[f"{f}_f" for f in features]).fit(rows).transform(rows)
    data = VectorAssembler(inputCols=[f"{f}_f" for f in features], outputCol="x").transform(filled).select("ts", F.col(label).cast("double").alias("y"), "x")
    train, test = data.where(F.unix_timestamp("ts") <= cutoff).cache(), data.where(F.unix_timestamp("ts") > cutoff).cache()
    out = []
    for name, est in (("logistic", LogisticRegression(maxIter=20)), ("forest", RandomForestClassifier(numTrees=10, seed=7)), ("boosted", GBTClassifier(maxIter=5, seed=7))):
        model = est.setFeaturesCol("x").setLabelCol("y").fit(train)
        acc = model.transform(test).agg(F.avg((F.col("prediction") == F.col("y")).cast("double")).alias("a")).first()["a"]
        out.append((name, float(acc or 0.0), max(float(acc or 0.0) - 0.5, 0.0) + 1e-6))
    return rows.sparkSession.createDataFrame(out, "model string, accuracy double, weight double")


def calibrate(pairs: DataFrame, least: int = 20) -> DataFrame:
    """Isotonic and logistic calibration on the first half, Brier scores on the second; the lowest wins. pairs: id, p, y."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import IsotonicRegression

    half = pairs.select(F.percentile("id", F.lit(0.5)).alias("m")).first()["m"]
    if pairs.limit(least).count() < least:
        return pairs.sparkSession.createDataFrame([("identity", 1.0)], "method string, brier double")
    q = F.least(F.lit(0.999999), F.greatest(F.lit(1e-6), F.col("p")))
    data = VectorAssembler(inputCols=["z"], outputCol="x").transform(pairs.withColumn("z", F.log(q / (1 - q))).withColumn("y", F.col("y").cast("double")))
    fit, test = data.where(F.col("id") <= half).cache(), data.where(F.col("id") > half).cache()
    iso = IsotonicRegression(featuresCol="p", labelCol="y").fit(fit).transform(test).agg(F.avg(F.pow(F.col("prediction") - F.col("y"), 2)).alias("b")).first()["b"]
    lr = LogisticRegression(featuresCol="x", labelCol="y").fit(fit)
    from pyspark.ml.functions import vector_to_array

    platt = lr.transform(test).agg(F.avg(F.pow(vector_to_array("probability")[1] - F.col("y"), 2)).alias("b")).first()["b"]
    raw = test.agg(F.avg(F.pow(F.col("p") - F.col("y"), 2)).alias("b")).first()["b"]
    return pairs.sparkSession.createDataFrame([("identity", raw), ("isotonic", iso), ("platt", platt)], "method string, brier double")


def _view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return Operator(name, "", f"SELECT * FROM {{{name}}}").run(spark, sf_dir)


def _training(spark: SparkSession, sf_dir: str) -> DataFrame:
    return CATALOG["y08_training_rows"].run(spark, sf_dir)


def _articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("source", F.col("doc_id").alias("id"), F.array_distinct(F.expr("regexp_extract_all(lower(text), '([a-z0-9]+)', 1)")).alias("tokens"))


def _z13(spark: SparkSession, sf_dir: str) -> DataFrame:
    candidates = CATALOG["z06_candidates"].run(spark, sf_dir)
    ranked = candidates.join(candidates.agg(F.max("ts").alias("ts")), "ts").orderBy("rank").limit(20).collect()
    pairs = {(r["x"], r["y"]): r["r"] or 0.0 for r in CATALOG["z14_pair_correlation"].run(spark, sf_dir).collect()}
    signals = [{"symbol": r["symbol"], "direction": r["direction"], "minute": 0, "reason": r["reason"]} for r in ranked]
    return spark.createDataFrame([(s["symbol"], s["reason"]) for s in filter_signals(signals, pairs)], "symbol string, reason string")


def _g03(spark: SparkSession, sf_dir: str) -> DataFrame:
    corr: dict[str, dict] = {}
    for r in CATALOG["g03_redundancy"].run(spark, sf_dir).collect():
        corr.setdefault(r["symbol"], {})[r["x"], r["y"]] = r["r"] or 0.0
    mi: dict[str, dict] = {}
    for r in CATALOG["g02_mutual_information"].run(spark, sf_dir).collect():
        mi.setdefault(r["symbol"], {})[r["feature"]] = r["mi"]
    rows = [(s, f, k + 1) for s, m in sorted(mi.items()) for k, f in enumerate(select_features(corr.get(s, {}), m))]
    return spark.createDataFrame(rows, "symbol string, feature string, rank int")


#: Queries without SQL twins; tests hold them against plain Python.
QUERIES = {
    "m02_structure_fold": lambda spark, d: structure(_view(spark, d, "candles")).select("symbol", "ts", "last_high", "last_low", "hh_run", "ll_run"),
    "m03_structure_trend": lambda spark, d: structure(_view(spark, d, "candles")).select("symbol", "ts", "trend"),
    "m04_break_of_structure": lambda spark, d: structure(_view(spark, d, "candles")).select("symbol", "ts", "bos", "choch"),
    "m05_liquidity_zones": lambda spark, d: structure(_view(spark, d, "candles")).select("symbol", "ts", "zone_pct"),
    "m06_fair_value_gaps": lambda spark, d: structure(_view(spark, d, "candles")).select("symbol", "ts", "open_gaps"),
    "m08_structural_bias": lambda spark, d: structure(_view(spark, d, "candles")).select("symbol", "ts", "bias", "breakout_prob", "sweep_prob"),
    "m10_value_area": lambda spark, d: session_profiles(_view(spark, d, "candles")),
    "d15_novelty": lambda spark, d: novelty(_articles(spark, d), across=True),
    "n21_dtw_analogs": lambda spark, d: analog_paths(_view(spark, d, "candles")),
    "y09_dataset_hash": lambda spark, d: dataset_hash(_training(spark, d), ["lr", "tr", "delta"]),
    "y11_train_models": lambda spark, d: train_models(_training(spark, d), ["lr", "tr", "delta"]),
    "y15_calibration": lambda spark, d: calibrate(spark.read.parquet(f"{d}/labels.parquet").select(F.col("doc_id").alias("id"), ((F.col("doc_id") % 97) / 96).alias("p"), F.col("quality").alias("y"))),
    "g03_selected_features": _g03,
    "z13_signal_filter": _z13,
}


"""Feature selection: an aligned matrix, ridge coefficients from summed moments, four rankings and their mean.

The matrix holds a symbol's newest `BARS` bars with a known target; a feature is used if it was observed at 80 % of them and at
the first, and is filled forward. Partitions sum moments of standardised columns; a group's moments meet in one row of
features squared, whatever the bars. From them come the ridge coefficients, what a shuffled column costs, mean absolute
attributions and the order of backward elimination: one inverse, from which a column is swept at a time.

The cost of a shuffled column is its mean over all shuffles, 2c(c + lambda c / n), not that of one seeded shuffle. Ties go to
the feature with more information, then to the earlier name. Fewer than `LEAST_BARS` bars give no ranking.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewater.operators import training
from tidewater.plans.dialect import Operator
from tidewater.session import cut, sized_join

# Fixed values
BARS, LEAST_BARS, COVERAGE = 250, 60, 0.8
FLAT, ALIKE, CANDIDATES, RIDGE, RECOMMENDED = 1e-9, 0.95, 20, 1.0, 10
FEATURE_BINS, TARGET_BINS = 5, 3


def solve(matrix: np.ndarray, rhs: np.ndarray, least: float = 1e-12) -> np.ndarray:
    """Solution by elimination with row pivots; an unknown without a pivot is zero."""
    a = np.column_stack([np.asarray(matrix, float), np.asarray(rhs, float)])
    n = len(a)
    out = np.zeros(n)
    for k in range(n):
        p = k + int(np.abs(a[k:, k]).argmax())
        if abs(a[p, k]) < least:
            continue
        a[[k, p]] = a[[p, k]]
        rest = np.arange(n) != k
        a[rest] -= np.outer(a[rest, k] / a[k, k], a[k])
    pivot = np.abs(np.diag(a[:, :n])) > least
    out[pivot] = a[pivot, n] / np.diag(a[:, :n])[pivot]
    return out


def elimination_ranks(gram: np.ndarray, rhs: np.ndarray) -> np.ndarray:
    """Rank of each column: 1 stays longest. The column of least |coefficient| goes, and is swept out of the inverse."""
    inverse = np.linalg.inv(gram)
    left = np.arange(len(rhs))
    ranks = np.zeros(len(rhs), int)
    while len(left):
        weakest = int(np.abs(inverse @ rhs[left]).round(12).argmin())
        ranks[left[weakest]] = len(left)
        col = inverse[:, weakest]
        inverse = inverse - np.outer(col, col) / col[weakest]
        keep = np.arange(len(left)) != weakest
        inverse, left = inverse[np.ix_(keep, keep)], left[keep]
    return ranks


def rank_features(names: list[str], n: int, corr: np.ndarray, with_target: np.ndarray, spread: np.ndarray, mi: np.ndarray) -> dict:
    """Candidates in order of their mean rank. ``corr``: moments of standardised columns; ``spread``: their mean absolute values."""
    order = sorted(range(len(names)), key=lambda k: (-mi[k], names[k]))
    kept: list[int] = []
    redundant: set[int] = set()
    for k in order:
        if len(kept) == CANDIDATES:
            break
        if k not in redundant:
            kept.append(k)
            redundant |= {j for j in order if j not in kept and abs(corr[k, j]) >= ALIKE}
    gram = corr[np.ix_(kept, kept)] + np.eye(len(kept)) * RIDGE / n
    rhs = with_target[kept]
    c = solve(gram, rhs)
    shuffled = 2 * c * c * (1 + RIDGE / n)
    shap = np.abs(c) * spread[kept]
    place = lambda v: np.argsort(np.argsort(-np.round(v, 12), kind="stable"), kind="stable") + 1
    rfe = elimination_ranks(gram, rhs)
    mean = (place(mi[kept]) + place(shuffled) + place(shap) + rfe) / 4
    final = np.argsort(mean, kind="stable")
    return {"kept": [kept[k] for k in final], "coefficient": c[final], "permutation": shuffled[final], "shap": shap[final], "rfe": rfe[final], "composite": mean[final], "redundant": redundant - set(kept)}


def bars_of(candles: DataFrame, most: int = BARS) -> DataFrame:
    """symbol, ts, target: the newest bars whose next return is known."""
    by = Window.partitionBy("symbol").orderBy("ts")
    ahead = F.log(F.lead("close").over(by) / F.col("close"))
    known = candles.where("close > 0").select("symbol", "ts", ahead.alias("target")).where("target IS NOT NULL")
    return known.withColumn("_k", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("ts")))).where(F.col("_k") <= most).drop("_k")


def matrix(bars: DataFrame, series: DataFrame, features: list[str]) -> tuple[DataFrame, DataFrame]:
    """(symbol, ts, target, x: a value a feature; symbol, n, used: which features are).  ``series``: symbol, ts, feature, value."""
    seen = series.join(bars.select("symbol", "ts"), ["symbol", "ts"], "left_semi")
    filled = cut(training.as_of(bars, seen, features).select("symbol", "ts", "target", F.array(*features).alias("x")))
    there = seen.where("value IS NOT NULL").groupBy("symbol").agg(F.array(*[F.count_distinct(F.when(F.col("feature") == f, F.col("ts"))) for f in features]).alias("seen"))
    gaps = filled.groupBy("symbol").agg(F.count("*").alias("n"), F.array(*[F.sum(F.col("x")[k].isNull().cast("int")) for k in range(len(features))]).alias("gaps"))
    used = F.zip_with("seen", "gaps", lambda s, g: (s / F.col("n") >= COVERAGE) & (g == 0))
    return filled, cut(gaps.where(F.col("n") >= LEAST_BARS).join(there, "symbol").select("symbol", "n", used.alias("used")))


def information(rows: DataFrame, used: DataFrame) -> DataFrame:
    """symbol, mi: of each feature's fifths with the target's thirds, by place in order; null where a feature isn't used."""
    long = rows.join(used, "symbol").select("symbol", "ts", "target", "used", F.posexplode("x").alias("f", "v")).where(F.col("used")[F.col("f")])
    part = lambda by, bins: F.floor((F.row_number().over(Window.partitionBy("symbol", "f").orderBy(by, "ts")) - 1) * bins / F.count("*").over(Window.partitionBy("symbol", "f")))
    cells = long.select("symbol", "f", part("v", FEATURE_BINS).alias("i"), part("target", TARGET_BINS).alias("j")).groupBy("symbol", "f", "i", "j").agg(F.count("*").cast("double").alias("c"))
    of = lambda *k: F.sum("c").over(Window.partitionBy("symbol", "f", *k))
    terms = cells.select("symbol", "f", (F.col("c") / of() * F.log(F.col("c") * of() / (of("i") * of("j")))).alias("t"))
    return terms.groupBy("symbol", "f").agg(F.greatest(F.lit(0.0), F.sum("t")).alias("mi")).groupBy("symbol").agg(F.map_from_entries(F.collect_list(F.struct("f", "mi"))).alias("mi"))


def moments(rows: DataFrame, stats: DataFrame, features: int) -> DataFrame:
    """symbol, n, gram, rhs, spread: sums of each partition over standardised columns. ``stats``: symbol, mean, deviation (null: unused)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, list] = {}
        for b in batches:
            if not b.num_rows:
                continue
            flat = lambda c: np.array([[np.nan if v is None else v for v in r] for r in c.to_pylist()], float).reshape(b.num_rows, features)
            x, mean, dev = flat(b.column(1)), flat(b.column(3)), flat(b.column(4))
            z = np.nan_to_num((x - mean) / dev)
            t = b.column(2).to_numpy()
            symbols = np.array(b.column(0).to_pylist(), object)
            for s in set(symbols.tolist()):
                own = z[symbols == s]
                new = [len(own), own.T @ own, own.T @ t[symbols == s], np.abs(own).sum(0)]
                total[s] = [a + c for a, c in zip(total[s], new)] if s in total else new
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array([v[0] for v in total.values()], pa.int64()), *[pa.array([v[k].astype("<f8").tobytes() for v in total.values()], pa.binary()) for k in (1, 2, 3)]], names=["symbol", "n", "gram", "rhs", "spread"])

    joined = sized_join(rows, stats, ["symbol"], "inner").select("symbol", "x", "target", "mean", "deviation")
    return joined.mapInArrow(run, "symbol string, n long, gram binary, rhs binary, spread binary")


def selection(bars: DataFrame, series: DataFrame, features: list[str]) -> DataFrame:
    """symbol, feature, rank, coefficient, mutual_information, permutation, shap, rfe_rank, composite, recommended, by symbol."""
    rows, used = matrix(bars, series, features)
    width = len(features)
    flat = lambda k: F.when(F.col("used")[k] & (F.stddev_pop(F.col("x")[k]) > FLAT), F.stddev_pop(F.col("x")[k]))
    stats = rows.join(used, "symbol").groupBy("symbol", "used").agg(F.array(*[F.avg(F.col("x")[k]) for k in range(width)]).alias("mean"), F.array(*[flat(k) for k in range(width)]).alias("deviation"))
    stats = cut(stats.drop("used"))
    parts = moments(rows, stats, width)
    known = information(rows, used).join(stats.select("symbol", "deviation"), "symbol")

    def run(key: tuple, sums: pa.Table, own: pa.Table) -> pa.Table:
        out: dict[str, list] = {k: [] for k in ("symbol", "feature", "rank", "coefficient", "mutual_information", "permutation", "shap", "rfe_rank", "composite", "recommended")}
        if sums.num_rows and own.num_rows:
            add = lambda c: sum(np.frombuffer(v, "<f8") for v in sums.column(c).to_pylist())
            n = sum(sums.column("n").to_pylist())
            mi = dict(own.column("mi").to_pylist()[0])
            live = [k for k, d in enumerate(own.column("deviation").to_pylist()[0]) if d is not None]
            if live:
                r = rank_features([features[k] for k in live], n, add("gram").reshape(width, width)[np.ix_(live, live)] / n, add("rhs")[live] / n, add("spread")[live] / n, np.array([mi.get(k, 0.0) for k in live]))
                for place, k in enumerate(r["kept"]):
                    row = (key[0].as_py(), features[live[k]], place + 1, r["coefficient"][place], mi.get(live[k], 0.0), r["permutation"][place], r["shap"][place], int(r["rfe"][place]), r["composite"][place], place < RECOMMENDED)
                    for c, v in zip(out, row):
                        out[c].append(v)
        kinds = [pa.string(), pa.string(), pa.int32(), *[pa.float64()] * 4, pa.int32(), pa.float64(), pa.bool_()]
        return pa.table({k: pa.array(v, t) for (k, v), t in zip(out.items(), kinds)})

    schema = "symbol string, feature string, rank int, coefficient double, mutual_information double, permutation double, shap double, rfe_rank int, composite double, recommended boolean"
    return parts.groupBy("symbol").cogroup(known.groupBy("symbol")).applyInArrow(run, schema)


#: Features observed at every bar.
AT_BARS = [f for f, whose, timeframe in training.SPECS if whose == "instrument" and timeframe in ("D", "5m")] + ["options_iv_rank"]


def _selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    candles = Operator("", "", "SELECT * FROM {candles}").run(spark, sf_dir)
    return selection(cut(bars_of(candles)), cut(training.series_of(spark, sf_dir).where(F.col("feature").isin(AT_BARS))), AT_BARS)


QUERIES = {
    "g06_feature_ranking": _selection,
    "g04_ridge_coefficients": lambda spark, d: _selection(spark, d).select("symbol", "feature", F.round("coefficient", 8).alias("coefficient")),
}

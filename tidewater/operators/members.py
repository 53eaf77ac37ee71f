"""Member models: six of them trained on the training rows, weighed by held-out skill; blend, agreement, calibration, attribution.

The split is chronological: rows up to the moment that holds the row at four fifths train, later ones are held out (rows of
one moment stay together). Missing values take the mean of the rows that have one. A model's weight is its held-out accuracy
above a half, and a millionth. Nothing is trained where the training rows hold one class; predictions are then 0.5 with
confidence 0, uncertainty 1 and disagreement 0.

Calibration sees held-out blends only. Logits are summed once into a sketch of cells (a cell keeps its count, positives and
means), on which Platt's two parameters, isotonic steps and a temperature within bounds are fitted; the later half of the
pairs decides by the Brier score. Fewer than `LEAST_PAIRS` pairs, no calibration.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewater.operators import training
from tidewater.operators.trees import LEARNERS, Ensemble, Learner, binned, edges_of, ensemble_shapley, grow
from tidewater.session import cut

# Fixed values
HELD_OUT, TOP_FEATURES, BAND = 0.2, 5, 0.05
HIGH, MEDIUM = 0.8, 0.5
LEAST_PAIRS, EDGE, TEMPERATURES = 20, 1e-6, (0.05, 20.0)
TIE = 0.01
CELLS = 1024  # cells of the sketch for one unit of log odds


def moment_at(rows: DataFrame, k: int, ts: str = "ts"):
    """The moment of the k-th row (from 1) in order of time: first its day, then its second, from counts."""
    at = rows.select(F.col(ts).alias("t"))
    for unit in ("day", "microsecond"):
        counts = at.groupBy(F.date_trunc(unit, "t").alias("u")).count().orderBy("u").collect()  # as many as days; then as moments of one day
        for r in counts:
            if k <= r["count"]:
                break
            k -= r["count"]
        at = at.where(F.date_trunc(unit, F.col("t")) == F.lit(r["u"]))
    return r["u"]


@dataclass
class Linear:
    weights: np.ndarray
    intercept: float

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.weights + self.intercept, -700, 700)))


@dataclass
class Member:
    name: str
    model: Ensemble | Linear
    accuracy: float = 0.5
    weight: float = 1e-6


@dataclass
class Trained:
    """What a training keeps: numbers of features, bins and trees, whatever the rows."""

    features: list[str]
    means: np.ndarray
    deviations: np.ndarray
    edges: list[np.ndarray]
    rows: int
    held_out: int
    members: list[Member] = field(default_factory=list)

    def matrix(self, columns: list[pa.Array]) -> np.ndarray:
        x = np.stack([c.cast(pa.float64()).to_numpy(zero_copy_only=False) for c in columns], 1) if columns else np.zeros((0, 0))
        return np.where(np.isnan(x), self.means, x)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """Rows by members."""
        bins = binned(x, self.edges)
        return np.stack([m.model.probability(x if isinstance(m.model, Linear) else bins) for m in self.members], 1)


def _mapped(rows: DataFrame, trained: Trained, keep: list[str], then, schema: str) -> DataFrame:
    names = [p.split()[0] for p in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                own = then(b.columns[: len(keep)], trained.matrix(b.columns[len(keep) :]))
                yield pa.RecordBatch.from_arrays(own, names=names)

    return rows.select(*keep, *[F.col(f).cast("double") for f in trained.features]).mapInArrow(run, schema)


def _logistic(data: DataFrame, features: int, rows: int) -> Linear:
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    fitted = LogisticRegression(maxIter=100, regParam=1.0 / max(rows, 1), standardization=False).fit(data.select(F.col("y").alias("label"), array_to_vector("x").alias("features")))
    return Linear(np.array(fitted.coefficients.toArray()), float(fitted.intercept))


def train(rows: DataFrame, features: list[str], learners: list[Learner] | None = None, seed: int = 42) -> tuple[Trained, DataFrame]:
    """(the members, held-out rows with ``p``: an array of the members' probabilities). ``rows``: symbol, ts, target, features."""
    learners = LEARNERS if learners is None else learners
    n = rows.count()
    stats = rows.agg(*[F.avg(f).alias(f"m{k}") for k, f in enumerate(features)], *[F.stddev_pop(f).alias(f"s{k}") for k, f in enumerate(features)]).first()
    means = np.array([stats[f"m{k}"] if stats[f"m{k}"] is not None else 0.0 for k in range(len(features))])
    deviations = np.array([stats[f"s{k}"] if stats[f"s{k}"] is not None else 0.0 for k in range(len(features))])
    held = rows.select("symbol", "ts", F.col("target").cast("double").alias("y"), F.lit(None).cast("array<double>").alias("p"))
    if n < 2:
        return Trained(features, means, deviations, [np.zeros(0)] * len(features), n, 0), held.where("false")
    last = moment_at(rows, max(1, min(n - 1, round(n * (1 - HELD_OUT)))))
    early, late = rows.where(F.col("ts") <= F.lit(last)), rows.where(F.col("ts") > F.lit(last))
    known = early.count()
    out = Trained(features, means, deviations, edges_of(early.na.fill(dict(zip(features, means.tolist()))), features), n, n - known)
    if early.select("target").distinct().limit(2).count() < 2:
        return out, held.where("false")

    def shaped(keys, x):
        b = binned(x, out.edges)
        return [keys[0], keys[1], pa.array([r.tobytes() for r in b], pa.binary()), pa.array(x.tolist(), pa.list_(pa.float64()))]

    keyed = early.withColumn("h", F.xxhash64("symbol", "ts")).withColumn("y", F.col("target").cast("double"))
    data = cut(_mapped(keyed, out, ["h", "y"], shaped, "h long, y double, b binary, x array<double>"))
    ensembles = grow(data, len(features), learners, seed)
    out.members = [Member(e.learner.name, e) for e in ensembles] + [Member("logistic_regression", _logistic(data, len(features), known))]
    judged = cut(predicted(late.withColumn("y", F.col("target").cast("double")), out, ["symbol", "ts", "y"], "symbol string, ts timestamp, y double"))
    if out.held_out:
        right = judged.agg(*[F.avg(((F.col("p")[k] > 0.5).cast("double") == F.col("y")).cast("double")).alias(f"a{k}") for k in range(len(out.members))]).first()
        for k, m in enumerate(out.members):
            m.accuracy = float(right[f"a{k}"])
    for m in out.members:
        m.weight = max(m.accuracy - 0.5, 0.0) + 1e-6
    return out, judged


def predicted(rows: DataFrame, trained: Trained, keep: list[str], schema: str) -> DataFrame:
    """``keep`` of every row and ``p``, a probability for each member (empty without members)."""

    def then(keys, x):
        p = trained.probabilities(x).tolist() if trained.members else [[]] * len(x)
        return [*keys, pa.array(p, pa.list_(pa.float64()))]

    return _mapped(rows, trained, keep, then, f"{schema}, p array<double>")


# Readouts of one row of probabilities ------------------------------------------------------------------------------

def _array(values: list[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values]).cast("array<double>")


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def blended(rows: DataFrame, trained: Trained) -> DataFrame:
    """``rows`` with probability, confidence, uncertainty and disagreement in place of ``p``."""
    w = [m.weight for m in trained.members]
    total = sum(w)
    four = F.transform("p", lambda x: F.round(x, 4)) if w else F.col("p")
    mean = F.aggregate(four, F.lit(0.0), lambda s, x: s + x) / F.size(four)
    spread = F.sqrt(F.aggregate(four, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean)) / F.size(four))
    p = F.round(_dot(four, _array(w)) / total, 4) if w else F.lit(0.5)
    sure = round(sum(round(m.accuracy, 4) * m.weight for m in trained.members) / total, 4) if w else 0.0
    spread = F.round(F.least(2 * spread, F.lit(1.0)), 4) if len(w) > 1 else F.lit(0.0)
    raw = _dot(four, _array(w)) / total if w else F.lit(0.5)
    return rows.select(*[c for c in rows.columns if c != "p"], p.alias("probability"), F.lit(sure).alias("confidence"), F.round(1 - 2 * F.abs(raw - 0.5), 4).alias("uncertainty"), spread.alias("disagreement"))


def pairs_of(held: DataFrame, trained: Trained) -> DataFrame:
    """symbol, ts, p (the blend, not rounded), y of held-out rows: what calibration sees."""
    w = [m.weight for m in trained.members]
    return held.select("symbol", "ts", (_dot(F.col("p"), _array(w)) / sum(w) if w else F.lit(0.5)).alias("p"), "y")


def direction(p: Column) -> Column:
    return F.when(p > 0.5 + BAND, "bullish").when(p < 0.5 - BAND, "bearish").otherwise("neutral")


def agreement(rows: DataFrame, trained: Trained) -> DataFrame:
    """How many members point where their blend points; variance of what they say, spread of what they have shown."""
    keys = [c for c in rows.columns if c != "p"]
    if not trained.members:
        return rows.select(*keys, F.lit(0.0).alias("agreement_pct"), F.lit(0.0).alias("variance"), F.lit(0.0).alias("spread"), F.lit("low").alias("level"), F.lit(False).alias("proceed"))
    four, w = F.transform("p", lambda x: F.round(x, 4)), [m.weight for m in trained.members]
    both = rows.withColumn("_b", F.round(_dot(four, _array(w)) / sum(w), 4))
    mean = F.aggregate(four, F.lit(0.0), lambda s, x: s + x) / F.size(four)
    same = F.round(F.size(F.filter(four, lambda x: direction(x) == direction(F.col("_b")))) / F.size(four), 4)
    shown = [round(m.accuracy, 4) for m in trained.members]
    level = F.when(F.col("agreement_pct") >= HIGH, "high").when(F.col("agreement_pct") >= MEDIUM, "medium").otherwise("low")
    out = both.select(*keys, same.alias("agreement_pct"), F.round(F.aggregate(four, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean)) / F.size(four), 6).alias("variance"), F.lit(round(max(shown) - min(shown), 4)).alias("spread"))
    return out.withColumn("level", level).withColumn("proceed", F.col("level") == "high")


# Calibration -------------------------------------------------------------------------------------------------------

def logit(p: Column) -> Column:
    q = F.greatest(F.lit(EDGE), F.least(F.lit(1 - EDGE), p))
    return F.log(q / (1 - q))


def sketch(pairs: DataFrame) -> np.ndarray:
    """Cells of log odds: n, positives, mean logit, mean p, in order. ``pairs``: p, y. At most about 28,000 cells."""
    rows = pairs.select("p", "y", logit(F.col("p")).alias("z"))
    cells = rows.groupBy(F.round(F.col("z") * CELLS).cast("long").alias("c")).agg(F.count("*").alias("n"), F.sum(F.col("y").cast("double")).alias("s"), F.avg("z").alias("z"), F.avg("p").alias("p"))
    found = sorted((r["c"], float(r["n"]), r["s"], r["z"], r["p"]) for r in cells.collect())
    return np.array([r[1:] for r in found], float).reshape(-1, 4)


def fit_platt(cells: np.ndarray) -> tuple[float, float]:
    """(slope, intercept) of least loss with the slope's half square added; one class: the identity."""
    n, s, z = cells[:, 0], cells[:, 1], cells[:, 2]
    if s.sum() <= 0 or s.sum() >= n.sum():
        return 1.0, 0.0
    loss = lambda v: 0.5 * v[0] ** 2 + float((n * np.logaddexp(0, v[0] * z + v[1])).sum() - (s * (v[0] * z + v[1])).sum())
    v = np.array([0.0, math.log(s.sum() / (n.sum() - s.sum()))])
    for _ in range(100):
        p = 1 / (1 + np.exp(-(v[0] * z + v[1])))
        grad = np.array([v[0] + ((n * p - s) * z).sum(), (n * p - s).sum()])
        w = n * p * (1 - p)
        hess = np.array([[1 + (w * z * z).sum(), (w * z).sum()], [(w * z).sum(), w.sum() + 1e-12]])
        step = np.linalg.solve(hess, grad)
        size = 1.0
        while size > 1e-8 and loss(v - size * step) > loss(v):
            size /= 2
        v = v - size * step
        if np.abs(step).max() * size < 1e-10:
            break
    return float(v[0]), float(v[1])


def fit_isotonic(cells: np.ndarray) -> tuple[list[float], list[float]]:
    """Knots of a line that doesn't fall: least squares by pooling neighbours that are out of order."""
    blocks: list[list[float]] = []  # weight, positives, first cell, last cell
    for k, (n, s) in enumerate(cells[:, :2]):
        blocks.append([n, s, k, k])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            n2, s2, _, end = blocks.pop()
            blocks[-1] = [blocks[-1][0] + n2, blocks[-1][1] + s2, blocks[-1][2], end]
    x, y = [], []
    for n, s, a, b in blocks:
        for k in sorted({int(a), int(b)}):
            x.append(float(cells[k, 3]))
            y.append(min(1.0, max(0.0, s / n)))
    return x, y


def fit_temperature(cells: np.ndarray) -> float:
    """The temperature within bounds of least negative log likelihood, by golden sections over its logarithm, from the best of a
    coarse grid."""
    n, s, z = cells[:, 0], cells[:, 1], cells[:, 2]

    def loss(t: float) -> float:
        p = np.clip(1 / (1 + np.exp(-np.clip(z / t, -700, 700))), EDGE, 1 - EDGE)
        return -float((s * np.log(p) + (n - s) * np.log(1 - p)).sum() / n.sum())

    grid = np.exp(np.linspace(math.log(TEMPERATURES[0]), math.log(TEMPERATURES[1]), 41))
    k = int(np.argmin([loss(t) for t in grid]))
    a, b = math.log(grid[max(0, k - 1)]), math.log(grid[min(40, k + 1)])
    ratio = (math.sqrt(5) - 1) / 2
    while b - a > 1e-9:
        c, d = b - ratio * (b - a), a + ratio * (b - a)
        a, b = (a, d) if loss(math.exp(c)) <= loss(math.exp(d)) else (c, b)
    return math.exp((a + b) / 2)


@dataclass
class Calibration:
    method: str
    knots: tuple[list[float], list[float]]  # Platt: slope, intercept; temperature: one value; isotonic: x, y
    brier: float = 1.0
    fitted: int = 0
    judged: int = 0

    @property
    def confidence(self) -> float:
        return round(max(0.0, 1.0 - self.brier), 4)

    def values(self, p: np.ndarray, z: np.ndarray) -> np.ndarray:
        x, y = self.knots
        if self.method == "isotonic_regression":
            return np.interp(p, x, y)
        at = x[0] * z + y[0] if self.method == "platt_scaling" else z / x[0]
        return 1 / (1 + np.exp(-np.clip(at, -700, 700)))


def brier(c: Calibration, cells: np.ndarray) -> float:
    """Mean squared error over a sketch; nothing to judge is the worst."""
    if not len(cells):
        return 1.0
    q = c.values(cells[:, 3], cells[:, 2])
    return float((cells[:, 0] * q * q - 2 * q * cells[:, 1] + cells[:, 1]).sum() / cells[:, 0].sum())


def calibrations(pairs: DataFrame) -> list[Calibration]:
    """All methods with their scores, the best first (ties: the order of fitting); none of too few pairs. ``pairs``: ts, p, y."""
    n = pairs.count()
    if n < LEAST_PAIRS:
        return []
    last = moment_at(pairs, max(1, min(n - 1, round(n * 0.5))))
    fit, judge = sketch(pairs.where(F.col("ts") <= F.lit(last))), sketch(pairs.where(F.col("ts") > F.lit(last)))
    a, b = fit_platt(fit)
    out = [Calibration("platt_scaling", ([a], [b])), Calibration("isotonic_regression", fit_isotonic(fit)), Calibration("temperature_scaling", ([fit_temperature(fit)], []))]
    for c in out:
        c.brier, c.fitted, c.judged = round(brier(c, judge), 6), int(fit[:, 0].sum()), int(judge[:, 0].sum()) if len(judge) else 0
    return sorted(out, key=lambda c: c.brier)


def calibrated(rows: DataFrame, best: Calibration | None) -> DataFrame:
    """``rows`` (with probability) and calibrated, calibration_confidence, method; without a calibration the raw value, 0, none."""
    if best is None:
        return rows.withColumns({"calibrated": F.col("probability"), "calibration_confidence": F.lit(0.0), "method": F.lit("none")})
    p, z = F.col("probability"), logit(F.col("probability"))
    x, y = best.knots
    if best.method == "isotonic_regression":
        # the segment by a search in the sorted knots, which are as many as cells at most
        @F.pandas_udf("double")
        def value(v):
            import pandas as pd

            return pd.Series(np.interp(v, x, y))

        q = value(p)
    else:
        q = 1 / (1 + F.exp(-(F.lit(x[0]) * z + F.lit(y[0])))) if best.method == "platt_scaling" else 1 / (1 + F.exp(-z / F.lit(x[0])))
    return rows.withColumns({"calibrated": F.round(q, 4), "calibration_confidence": F.lit(best.confidence), "method": F.lit(best.method)})


# Explanations ------------------------------------------------------------------------------------------------------

def _top(parts: DataFrame, keys: list[str], top: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(F.abs("contribution")), "place"))
    return parts.withColumn("rank", rank).where(F.col("rank") <= top).select(*keys, "rank", "feature", "contribution")


def explained(rows: DataFrame, trained: Trained, keep: list[str], schema: str, top: int = TOP_FEATURES) -> DataFrame:
    """Per member the features of largest |weight x standardised value|: coefficients of the line, shares of gain of trees."""
    weights = [(m.name, m.model.weights if isinstance(m.model, Linear) else m.model.importance(len(trained.features))) for m in trained.members]
    d = trained.deviations

    def then(keys, x):
        std = np.where(d > 0, (x - trained.means) / np.where(d > 0, d, 1), 0.0)
        return [*keys, pa.array([[(std[r] * w).round(6).tolist() for _, w in weights] for r in range(len(x))], pa.list_(pa.list_(pa.float64())))]

    parts = _mapped(rows, trained, keep, then, f"{schema}, c array<array<double>>")
    names = F.array(*[F.lit(n) for n, _ in weights]) if weights else F.array().cast("array<string>")
    long = parts.select(*keep, F.posexplode("c").alias("_m", "c")).select(*keep, F.get(names, F.col("_m")).alias("model"), F.posexplode("c").alias("place", "contribution"))
    return _top(long.withColumn("feature", F.get(F.array(*[F.lit(f) for f in trained.features]), F.col("place"))), [*keep, "model"], top)


def attributed(rows: DataFrame, trained: Trained, keep: list[str], schema: str, top: int = TOP_FEATURES) -> DataFrame:
    """Shapley values averaged over the members by weight: the ``top`` of each row. Boosted members and the line speak of log odds,
    forests of probabilities."""
    total = sum(m.weight for m in trained.members)

    def then(keys, x):
        bins = binned(x, trained.edges)
        value = np.zeros(x.shape)
        for m in trained.members:
            value += m.weight * ((x - trained.means) * m.model.weights if isinstance(m.model, Linear) else ensemble_shapley(m.model, bins, x.shape[1]))
        return [*keys, pa.array((value / total if total else value).round(6).tolist(), pa.list_(pa.float64()))]

    parts = _mapped(rows if trained.members else rows.where("false"), trained, keep, then, f"{schema}, c array<double>")
    long = parts.select(*keep, F.posexplode("c").alias("place", "contribution"))
    return _top(long.withColumn("feature", F.get(F.array(*[F.lit(f) for f in trained.features]), F.col("place"))), keep, top)


def champion(first: float | None, second: float | None) -> tuple[float | None, str]:
    """(improvement, winner) of a challenger's mean held-out accuracy over the champion's."""
    if first is None or second is None:
        return None, "challenger" if second is not None else "champion" if first is not None else "insufficient_data"
    gain = round(second - first, 4)
    return gain, "challenger" if gain > TIE else "champion" if gain < -TIE else "tie"


def mean_accuracy(trained: Trained) -> float | None:
    return round(sum(m.accuracy for m in trained.members) / len(trained.members), 4) if trained.members else None


# Queries -----------------------------------------------------------------------------------------------------------

def _made(spark: SparkSession, sf_dir: str) -> tuple[Trained, DataFrame]:
    """The members of a folder of tables, trained once a session."""
    kept = spark.sparkContext.__dict__.setdefault("_tidewater_members", {})
    if sf_dir not in kept:
        kept[sf_dir] = train(training.rows_of(spark, sf_dir), training.FEATURES)
    return kept[sf_dir]


def _newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = training.rows_of(spark, sf_dir)
    last = rows.groupBy("symbol").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "symbol"]), "ts").alias("r"))
    return last.select("symbol", "r.*")


KEYS, SCHEMA = ["symbol", "ts"], "symbol string, ts timestamp"


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    trained, held = _made(spark, sf_dir)
    return pairs_of(held, trained)


def _member_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    trained, _ = _made(spark, sf_dir)
    return spark.createDataFrame([(m.name, round(m.accuracy, 4), round(m.weight, 6), trained.rows, trained.held_out) for m in trained.members], "model string, accuracy double, weight double, n_samples long, n_holdout long")


def _briers(spark: SparkSession, sf_dir: str) -> DataFrame:
    trained, held = _made(spark, sf_dir)
    names = F.array(*[F.lit(m.name) for m in trained.members])
    long = held.select("y", F.posexplode("p").alias("k", "q")).select(F.get(names, F.col("k")).alias("model"), "q", "y")
    return long.groupBy("model").agg(F.round(F.coalesce(F.avg((F.col("q") - F.col("y")) ** 2), F.lit(1.0)), 6).alias("brier"))


def _calibration_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = calibrations(_pairs(spark, sf_dir))
    shown = lambda c: (c.knots[0][0], c.knots[1][0] if c.method == "platt_scaling" else None) if c.method != "isotonic_regression" else (None, None)
    rows = [(c.method, *shown(c), len(c.knots[0]) if c.method == "isotonic_regression" else None, c.brier, c.confidence, c.fitted, c.judged, k == 0) for k, c in enumerate(own)]
    return spark.createDataFrame(rows, "method string, parameter double, intercept double, knots int, brier double, calibration_confidence double, n_fit int, n_eval int, chosen boolean")


def _best(spark: SparkSession, sf_dir: str) -> Calibration | None:
    return next(iter(calibrations(_pairs(spark, sf_dir))), None)


def _champion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Champion: the core features; challenger: all of them, over the same rows."""
    few = [lr for lr in LEARNERS if not lr.boosted]
    rows = training.rows_of(spark, sf_dir)
    a, b = (mean_accuracy(train(rows, names, few)[0]) for names in (training.CORE, training.FEATURES))
    return spark.createDataFrame([(a, b, *champion(a, b), len(training.CORE), len(training.FEATURES))], "champion_accuracy double, challenger_accuracy double, improvement double, winner string, champion_features int, challenger_features int")


def _mean_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(mean_accuracy(_made(spark, sf_dir)[0]),)], "accuracy double")


def _newest_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    trained, _ = _made(spark, sf_dir)
    return blended(predicted(_newest(spark, sf_dir), trained, KEYS, SCHEMA), trained)


QUERIES = {
    "y11_member_models": _member_table,
    "y12_member_blend": lambda spark, d: blended(_made(spark, d)[1], _made(spark, d)[0]),
    "y13_member_explanations": lambda spark, d: explained(_newest(spark, d), _made(spark, d)[0], KEYS, SCHEMA),
    "y15_calibration_choice": _calibration_table,
    "y16_member_brier": _briers,
    "y17_calibrated_blend": lambda spark, d: calibrated(blended(_made(spark, d)[1], _made(spark, d)[0]), _best(spark, d)),
    "y18_member_agreement": lambda spark, d: agreement(_made(spark, d)[1], _made(spark, d)[0]),
    "y23_member_champion": _champion,
    "y25_member_attributions": lambda spark, d: attributed(_newest(spark, d), _made(spark, d)[0], KEYS, SCHEMA),
    "h52_member_accuracy": _mean_accuracy,
    "h57_holdout_pairs": _pairs,
    "h58_member_prediction": _newest_blend,
}

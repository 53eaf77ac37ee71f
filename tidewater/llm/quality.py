"""Operator 7: quality classifier from document statistics, random Fourier features and ridge, calibrated.

Each whole text becomes a fixed list of statistics. Random Fourier features of the standardised statistics
approximate a Gaussian kernel; the normal equations of a ridge fit are summed partition by partition and then over
partitions in rounds, so what one task or the driver holds has a fixed size whatever the data; isotonic regression over a fixed
number of score bins turns scores into probabilities.

Defined results
- null and empty texts have statistics of zeros and get a score like any other; repeated rows get equal scores.
- with no labelled rows, or labels of one kind only, every score is the mean label (0.5 with none).
- labels other than 0 and 1 and null labels are not learned from; an id labelled twice counts twice.
- label, language, source and id are never inputs; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.session import cut

RFF = 256
RIDGE = 1e-3
BINS = 512
FAN = 16  # partial sums that one task, or the driver, adds up

_SYMBOLS = re.compile(r"[^\w\s.,;:!?'\"()\-]")
_ENDS = re.compile(r"[.!?]")
_SHORT = 3
STATISTICS = 20


def statistics(text: str | None) -> np.ndarray:
    """The fixed list of statistics of one text, each of bounded or logarithmic size."""
    out = np.zeros(STATISTICS)
    if not text:
        return out
    words = text.split()
    n, w = len(text), max(1, len(words))
    kinds = set(words)
    lower_kinds = {x.lower() for x in kinds}
    lines = [x for x in text.split("\n") if x.strip()]
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    counts = np.bincount(raw, minlength=256)
    p = counts[counts > 0] / len(raw)
    letters = counts[65:91].sum() + counts[97:123].sum() + counts[128:].sum()
    symbols = len(_SYMBOLS.findall(text))
    pairs = len(set(zip(words, words[1:]))) if len(words) > 1 else 1
    out[:] = [
        np.log1p(n), np.log1p(len(words)), n / w / 10, counts[65:91].sum() / len(raw), counts[48:58].sum() / len(raw),
        letters / len(raw), symbols / n, counts[33] / n, len(_ENDS.findall(text)) / w, (counts[44] + counts[59] + counts[58]) / w,
        len(lower_kinds) / w, pairs / max(1, len(words) - 1), len(set(lines)) / max(1, len(lines)), np.log1p(n / max(1, len(lines))),
        float(-(p * np.log2(p)).sum()) / 8, sum(x.isupper() for x in kinds) / max(1, len(kinds)), sum(len(x) <= _SHORT for x in words) / w,
        max(map(len, words), default=0) ** 0.5 / 10, counts[124] / n + counts[60] / n + counts[123] / n, np.log1p(symbols) / 10,
    ]
    return out


def with_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, stats array<double>."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [statistics(t) for t in batch.column(1).to_pylist()]
            flat = np.concatenate(rows) if rows else np.zeros(0)
            offsets = np.arange(0, len(flat) + 1, STATISTICS, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["doc_id", "stats"])

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return chosen.mapInArrow(run, "doc_id long, stats array<double>")


def _matrix(batch: pa.RecordBatch, name: str = "stats") -> np.ndarray:
    col = batch.column(batch.schema.get_field_index(name))
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1)


def _summed(rows: DataFrame, local, size: int) -> np.ndarray:
    """Sum over all partitions of the vectors that ``local(batch)`` gives: by partition, then ``FAN`` vectors a task in as
    many rounds as that takes, the last ``FAN`` on the driver."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = np.zeros(size)
        for b in batches:
            if b.num_rows:
                total += local(b)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["g", "v"])

    def group(key: tuple, table: pa.Table) -> pa.Table:
        total = np.zeros(size)
        order = pa.compute.sort_indices(table, [("g", "ascending")])
        for v in table.column("v").take(order):
            total += np.frombuffer(v.as_buffer(), np.float64)
        return pa.table({"g": pa.array([key[0].as_py()], pa.int32()), "v": pa.array([total.tobytes()], pa.binary())})

    left = rows.rdd.getNumPartitions()
    sums = rows.mapInArrow(part, "g int, v binary")
    while left > FAN:
        left = -(-left // FAN)
        sums = sums.groupBy((F.col("g") % left).alias("to")).applyInArrow(lambda key, t: group(key, t), "g int, v binary")
    got = sorted(sums.collect(), key=lambda r: r["g"])
    return np.sum([np.frombuffer(r["v"], np.float64) for r in got], axis=0) if got else np.zeros(size)


class Model:
    def __init__(self, mean: np.ndarray, scale: np.ndarray, seed: int = 7, gamma: float = 0.05):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = mean, scale
        self.freq = rng.normal(0, (2 * gamma) ** 0.5, (len(mean), RFF))
        self.phase = rng.uniform(0, 2 * np.pi, RFF)
        self.beta = np.zeros(RFF + 1)
        self.edges, self.levels = np.array([0.0, 1.0]), np.array([0.5, 0.5])

    def lift(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.scale, -8, 8)
        return np.hstack([np.cos(z @ self.freq + self.phase) * (2 / RFF) ** 0.5, np.ones((len(z), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.lift(stats) @ self.beta

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(stats), self.edges, self.levels), 0, 1)


def isotonic(weight: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Non-decreasing means by pooling neighbours: one level per bin with weight."""
    blocks: list[list[float]] = []
    for w, t in zip(weight, total):
        blocks.append([t, w, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            t2, w2, n2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + t2, blocks[-1][1] + w2, blocks[-1][2] + n2]
    return np.array([t / w for t, w, n in blocks for _ in range(int(n))])


def fit(train: DataFrame) -> Model:
    """``train``: stats array<double>, y double (0 or 1)."""
    k = STATISTICS

    def moments(b: pa.RecordBatch) -> np.ndarray:
        x, y = _matrix(b), b.column("y").to_numpy(zero_copy_only=False)
        return np.concatenate([[len(x), y.sum()], x.sum(0), (x * x).sum(0)])

    m = _summed(train, moments, 2 + 2 * k)
    n, positive = m[0], m[1]
    if n == 0 or positive in (0, n):
        model = Model(np.zeros(k), np.ones(k))
        model.levels = np.full(2, 0.5 if n == 0 else positive / n)
        return model
    mean = m[2 : 2 + k] / n
    model = Model(mean, np.sqrt(np.maximum(m[2 + k :] / n - mean * mean, 1e-8)))
    d = RFF + 1

    def equations(b: pa.RecordBatch) -> np.ndarray:
        z, y = model.lift(_matrix(b)), b.column("y").to_numpy(zero_copy_only=False)
        w = np.where(y > 0, n / (2 * positive), n / (2 * (n - positive)))
        zw = z * w[:, None]
        return np.concatenate([(zw.T @ z).ravel(), zw.T @ y])

    s = _summed(train, equations, d * d + d)
    ridge = RIDGE * n * np.eye(d) / d
    ridge[-1, -1] = 0
    model.beta = np.linalg.solve(s[: d * d].reshape(d, d) + ridge, s[d * d :])

    def histogram(b: pa.RecordBatch) -> np.ndarray:
        y = b.column("y").to_numpy(zero_copy_only=False)
        at = np.clip(((model.raw(_matrix(b)) + 0.5) * (BINS / 2)).astype(int), 0, BINS - 1)
        return np.concatenate([np.bincount(at, minlength=BINS), np.bincount(at, weights=y, minlength=BINS)])

    h = _summed(train, histogram, 2 * BINS)
    used = np.flatnonzero(h[:BINS])
    model.edges = (used + 0.5) / (BINS / 2) - 0.5
    model.levels = isotonic(h[used], h[BINS + used])
    return model


def score(stats: DataFrame, model: Model) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = model.score(_matrix(b)) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s, pa.float64())], names=["doc_id", "score"])

    return stats.select("doc_id", "stats").mapInArrow(run, "doc_id long, score double")


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality IN (0, 1)").where(~held_out())
    stats = cut(with_statistics(docs))
    train = stats.join(labels.select("doc_id", F.col("quality").cast("double").alias("y")), "doc_id").select("stats", "y")
    out = score(stats, fit(cut(train)))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))

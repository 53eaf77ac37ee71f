"""Every hundredth vector against all others: cosines, distances and the nearest with their outcomes.

Queries are dealt into groups, vectors into blocks, both of bounded size; a group meets a block in one task, on matrices. Sums
run component by component in the vectors' order, as the SQL's do. The pairs themselves are the result of `n19_cosine` and
`n20_euclidean`: a hundredth of the square of the vectors.

A query's components decide which are read: a shorter vector, a null and a null component give null, more components don't
count (but in the vector's own norm).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewater.operators.rolling import cols
from tidewater.plans.dialect import render

# Fixed values
GROUP, BLOCK, EVERY, TOP = 512, 8192, 100, 20


def _matrix(vectors: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(components, zeros where there are none; how many can be read before the first null; all, -1 if one is null)."""
    a = vectors.combine_chunks()
    a = a.chunk(0) if isinstance(a, pa.ChunkedArray) else a
    lengths = a.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(int)
    flat = a.flatten()
    row, start = np.repeat(np.arange(len(a)), lengths), np.cumsum(lengths) - lengths
    at = np.arange(len(flat)) - start[row]
    x = np.zeros((len(a), int(lengths.max(initial=0))))
    x[row, at] = flat.cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False)
    known = lengths.copy()
    gone = flat.is_null().to_numpy(zero_copy_only=False)
    np.minimum.at(known, row[gone], at[gone])
    absent = a.is_null().to_numpy(zero_copy_only=False)
    return x, np.where(absent, -1, known), np.where(absent | (known < lengths), -1, lengths)


def _summed(one: Callable[[int], np.ndarray], n: int, shape) -> np.ndarray:
    total = np.zeros(shape)
    with np.errstate(all="ignore"):
        for k in range(n):
            total += one(k)
    return total


def cosine(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Cosines of one query (its own components) and all rows; NaN marks what isn't a number, null comes from the caller."""
    with np.errstate(all="ignore"):
        norm = np.sqrt(_summed(lambda k: q[k] * q[k], len(q), ()) * _summed(lambda k: x[:, k] * x[:, k], x.shape[1], len(x)))
        value = _summed(lambda k: q[k] * x[:, k], len(q), len(x)) / np.where(norm == 0, 1.0, norm)
    return np.ma.masked_array(value, norm == 0)


def euclidean(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    with np.errstate(all="ignore"):
        return np.ma.masked_array(np.sqrt(_summed(lambda k: (q[k] - x[:, k]) ** 2, len(q), len(x))), np.zeros(len(x), bool))


def rounded(v: np.ndarray) -> np.ndarray:
    with np.errstate(all="ignore"):
        s = (v + 1e-9) * 1e6
        return np.trunc(s + np.copysign(0.5, s)) / 1e6 + 0.0


def met(vectors: DataFrame, own: Callable, each: Callable, schema: str) -> DataFrame:
    """``each`` (query id, vector ids, labels, values) of every query and block; ``own``: values of a query and all rows of a block."""
    n = vectors.count()
    groups, blocks = -(-max(1, n // EVERY) // GROUP), -(-max(1, n) // BLOCK)
    deal = lambda m: F.pmod(F.xxhash64("vec_id"), F.lit(m)).cast("int")
    rows = vectors.select("vec_id", "embedding", "label")
    queries = rows.where(F.col("vec_id") % EVERY == 0).withColumn("g", deal(groups)).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    # columns of their own: the planner tells the two sides of a cogroup apart by them
    all_rows = rows.select(*[F.col(c).alias(f"to_{c}") for c in rows.columns], deal(blocks).alias("to_b"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("to_g"))
    names = [p.split()[0] for p in schema.split(", ")]
    kinds = pa.schema([(p.split()[0], {"long": pa.int64(), "double": pa.float64(), "int": pa.int32()}[p.split()[1]]) for p in schema.split(", ")])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return kinds.empty_table()
        q, q_known, q_all = _matrix(left["embedding"])
        x, x_known, x_all = _matrix(right["to_embedding"])
        ids, labels = right["to_vec_id"].combine_chunks(), right["to_label"].combine_chunks()
        ids, labels = (c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in (ids, labels))
        number = ids.to_numpy(zero_copy_only=False)
        out = []
        for r, qid in enumerate(left["vec_id"].to_pylist()):
            n = q_all[r]
            if n >= 0:
                wide = x if x.shape[1] >= n else np.pad(x, ((0, 0), (0, n - x.shape[1])))
                value = own(q[r, :n], wide, x_all)
                value = np.ma.masked_array(value.data, value.mask | (x_known < n))
            else:
                value = np.ma.masked_all(len(number))
            out.append(each(qid, number, ids, labels, value, number != qid, names))
        return pa.Table.from_batches(out, schema=kinds)

    return queries.groupBy("g", "b").cogroup(all_rows.groupBy("to_g", "to_b")).applyInArrow(run, schema)


def _own_cosine(q, x, x_all):
    value = cosine(q, x)
    return np.ma.masked_array(value.data, value.mask | (x_all < 0))  # a norm with a null component is null


def _pairs(value_of: Callable) -> Callable:
    def each(qid, number, ids, labels, value, others, names):
        v, none = value_of(value)
        return pa.RecordBatch.from_arrays([pa.array(np.full(int(others.sum()), qid)), ids.filter(pa.array(others)), pa.array(v[others], mask=none[others])], names=names)

    return each


def _clamped(value):
    """As least(1, greatest(-1, x)): what isn't a number is the largest, null is passed over."""
    v = np.where(np.isnan(value.data), 1.0, np.clip(value.data, -1.0, 1.0))
    return rounded(np.where(value.mask, -1.0, v)), np.zeros(len(v), bool)


def _nearest(qid, number, ids, labels, value, others, names):
    """The query's best of a block, a null last, what isn't a number first, ties by id."""
    at = np.flatnonzero(others)
    order = np.where(value.mask, -np.inf, np.where(np.isnan(value.data), np.inf, value.data))[at]
    if len(at) > TOP:
        keep = order >= np.partition(order, len(order) - TOP)[len(order) - TOP]
        at, order = at[keep], order[keep]
    at = at[np.lexsort((number[at], -order))[:TOP]]
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(at), qid)), ids.take(pa.array(at)), labels.take(pa.array(at)).cast(pa.int32()), pa.array(value.data[at], mask=value.mask[at])], names=names)


def historical_analogs(vectors: DataFrame) -> DataFrame:
    best = met(vectors, _own_cosine, _nearest, "qid long, vec_id long, label int, cs double")
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("cs"), "vec_id"))
    shown = render(cols({"best": "max(cs)", "mean": "avg(cs)", "win_rate": "avg(CASE WHEN label >= 5 THEN 1 ELSE 0 END)"}), duck=False)
    kept = best.withColumn("rank", rank).where(F.col("rank") <= TOP)
    return kept.sparkSession.sql(f"SELECT qid, {shown}, count(*) AS n FROM {{kept}} GROUP BY qid", kept=kept)


def _embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


QUERIES = {
    "n18_historical_analogs": lambda spark, d: historical_analogs(_embeddings(spark, d)),
    "n19_cosine": lambda spark, d: met(_embeddings(spark, d), _own_cosine, _pairs(_clamped), "qid long, vec_id long, cosine double"),
    "n20_euclidean": lambda spark, d: met(_embeddings(spark, d), lambda q, x, _: euclidean(q, x), _pairs(lambda v: (rounded(v.data), np.ma.getmaskarray(v))), "qid long, vec_id long, distance double"),
}

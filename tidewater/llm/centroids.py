"""Operator 12: centroid clustering, Lloyd's rounds with dual cover trees.

Vectors lie in blocks of a partition's rows, each with a cover tree that is built once and kept beside its block in the
checkpoint folder. Every round builds a cover tree over the centroids and walks both trees together: a node of vectors with
centre a and radius R drops a node of centroids with centre b and radius r if ``|a - b| - R - r`` is above the least
``|a - b'| + R`` (b' is a centroid itself, so no vector of the node is further from its nearest). A node left with one centroid
is settled as a whole; pairs of leaves are compared exactly, in whole numbers. Blocks need no shuffle; a partition sends
one sum a centroid and component, and the driver holds the centroids alone.

Defined results
- vectors that are null, have another length, or hold a null or non-finite component take no part; nor do those with a
  component beyond `LIMIT` after scaling, for which a squared distance would not fit 64 bits.
- ties go to the smaller centroid number; an empty centroid stays; equal starts are centroids of their own.
- repeated rows and ids count as vectors of their own; where starts share an id the lesser vector comes first; a null id is no
  start. Fewer vectors than `K` give as many centroids; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.topk import CoverTree
from tidewater.session import cut

K = 16
ROUNDS = 3
WIDTH = 64
SCALE = 64
BLOCK = 8192
LIMIT = 2**27


def whole_numbers(vectors: pa.Array, width: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows that take part, their components as whole numbers)."""
    sized = pc.fill_null(pc.equal(pc.list_value_length(vectors), width), False)
    rows = np.flatnonzero(sized.to_numpy(zero_copy_only=False))
    flat = vectors.filter(sized).flatten()
    with np.errstate(invalid="ignore", over="ignore"):
        x = np.floor(scale * flat.cast(pa.float64()).to_numpy(zero_copy_only=False)).reshape(-1, width)  # a null becomes NaN
        fit = (np.abs(x) <= LIMIT).all(1)
    return rows[fit], x[fit].astype(np.int64)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances, vectors by centroids."""
    most = float(max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)))
    if most * most * 4 * x.shape[1] < 2.0**52:
        xf, cf = x.astype(np.float64), c.astype(np.float64)
        return ((xf**2).sum(1)[:, None] - 2 * (xf @ cf.T) + (cf**2).sum(1)).astype(np.int64)
    return np.stack([((x - one) ** 2).sum(1) for one in c], 1)


def nearest(tree: CoverTree, x: np.ndarray, centroids: np.ndarray, over: CoverTree | None = None) -> np.ndarray:
    """Number of the nearest centroid of every row, by walking the rows' tree and the centroids' together."""
    over = over or CoverTree(centroids.astype(np.float64), leaf=1)
    center, radius = np.array(over.center), np.array(over.radius)
    out = np.full(len(x), -1)
    todo: list[tuple[int, list[int]]] = [(0, [0])]
    while todo:
        a, near = todo.pop()
        reach, leaf = tree.radius[a], not tree.children[a]
        while True:
            away = np.sqrt(((center[near] - tree.center[a]) ** 2).sum(1))
            bound = (away.min() + reach) * (1 + 1e-9) + 1e-9
            near = [n for n, d in zip(near, away.tolist()) if d - reach - radius[n] <= bound]
            split = {n for n in near if over.children[n] and (leaf or radius[n] > reach)}
            if not split:
                break
            near = [m for n in near for m in (over.children[n] if n in split else [n])]
        if len(near) == 1 and not over.children[near[0]] and len(over.rows[near[0]]) == 1:
            out[tree.below(a)] = over.rows[near[0]][0]
        elif leaf:
            rows, own = tree.rows[a], np.sort(np.concatenate([over.rows[n] for n in near]))
            out[rows] = own[squared(x[rows], centroids[own]).argmin(1)]
        else:
            todo.extend((child, near) for child in tree.children[a])
    return out


def _blocks(vectors: DataFrame, id_col: str, vec_col: str, width: int, scale: int, block: int) -> DataFrame:
    """ids, v (rows of whole numbers), tree: one row a block."""

    def made(ids: list, xs: list) -> pa.RecordBatch:
        x = np.concatenate(xs)
        tree = pickle.dumps(CoverTree(x.astype(np.float64)), protocol=5)
        return pa.RecordBatch.from_arrays([pa.array([np.concatenate(ids).tolist()], pa.list_(pa.int64())), pa.array([x.astype("<i8").tobytes()], pa.binary()), pa.array([tree], pa.binary())], names=["ids", "v", "tree"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, xs, n = [], [], 0
        for b in batches:
            rows, x = whole_numbers(b.column(1), width, scale)
            own = np.array(b.column(0).to_pylist(), object)[rows]
            while len(x):
                take = block - n
                ids.append(own[:take])
                xs.append(x[:take])
                n += len(xs[-1])
                own, x = own[take:], x[take:]
                if n == block:
                    yield made(ids, xs)
                    ids, xs, n = [], [], 0
        if n:
            yield made(ids, xs)

    return vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v")).mapInArrow(run, "ids array<long>, v binary, tree binary")


def _starts(vectors: DataFrame, id_col: str, vec_col: str, k: int, width: int, scale: int) -> np.ndarray:
    """The k vectors with the least hash of their id; at most k rows come to the driver."""
    x = F.col("v")
    kept = vectors.select(F.col(id_col).cast("long").alias("id"), F.transform(F.col(vec_col).cast("array<double>"), lambda c: c * scale).alias("v"))
    kept = kept.where(x.isNotNull() & F.col("id").isNotNull()).where((F.size(x) == width) & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf")))))
    kept = kept.where(F.forall(x, lambda c: (c >= -LIMIT) & (c < LIMIT + 1)))
    first = kept.orderBy(F.sha2(F.concat(F.lit("1:"), F.col("id").cast("string")), 256), F.transform(x, lambda c: F.floor(c))).limit(k)
    return np.array([[int(np.floor(c)) for c in r["v"]] for r in first.collect()], np.int64).reshape(-1, width)


def _walked(blocks: DataFrame, centroids: np.ndarray, width: int, then, schema: str) -> DataFrame:
    """``then(ids, rows, cluster numbers)`` of every block, in a stream of batches for each partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        over = CoverTree(centroids.astype(np.float64), leaf=1)

        def each():
            for b in batches:
                for ids, v, tree in zip(b.column(0), b.column(1).to_pylist(), b.column(2).to_pylist()):
                    x = np.frombuffer(v, "<i8").reshape(-1, width)
                    yield ids.values, x, nearest(pickle.loads(tree), x, centroids, over)

        yield from then(each())

    return blocks.mapInArrow(run, schema)


def _sums(blocks: DataFrame, centroids: np.ndarray, width: int) -> np.ndarray:
    """The next centroids: floors of the exact means; an empty one stays."""

    def then(each) -> Iterator[pa.RecordBatch]:
        total: dict[int, list[int]] = {}
        for _, x, home in each:
            for c in np.unique(home).tolist():
                own = x[home == c]
                so_far = total.setdefault(c, [0] * (width + 1))
                total[c] = [a + int(s) for a, s in zip(so_far, [*own.sum(0).tolist(), len(own)])]
        rows = [(c, k, str(s)) for c, own in total.items() for k, s in enumerate(own)]
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.int32(), pa.int32(), pa.string()))], names=["c", "k", "s"])

    parts = _walked(blocks, centroids, width, then, "c int, k int, s string")
    new = centroids.copy()
    found: dict[int, dict[int, int]] = {}
    for r in parts.groupBy("c", "k").agg(F.sum(F.col("s").cast("decimal(28,0)")).alias("s")).collect():  # centroids x components
        found.setdefault(r["c"], {})[r["k"]] = int(r["s"])
    for c, own in found.items():
        new[c] = [own[k] // own[width] for k in range(width)]
    return new


def lloyd(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, id_col: str = "vec_id", vec_col: str = "embedding", width: int = WIDTH, scale: int = SCALE, block: int = BLOCK) -> tuple[DataFrame, np.ndarray]:
    """(id, cluster, distance of every vector that takes part; the final centroids)."""
    blocks = cut(_blocks(vectors, id_col, vec_col, width, scale, block))
    centroids = _starts(vectors, id_col, vec_col, k, width, scale)
    if len(centroids) == 0:
        return vectors.sparkSession.createDataFrame([], "vec_id long, cluster int, distance long"), centroids
    for _ in range(rounds):
        centroids = _sums(blocks, centroids, width)

    def then(each) -> Iterator[pa.RecordBatch]:
        for ids, x, home in each:
            step = x - centroids[home]
            yield pa.RecordBatch.from_arrays([ids, pa.array(home, pa.int32()), pa.array((step * step).sum(1), pa.int64())], names=["vec_id", "cluster", "distance"])

    return cut(_walked(blocks, centroids, width, then, "vec_id long, cluster int, distance long")), centroids


def clustered(vectors: DataFrame, **options) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    rows, centroids = lloyd(vectors, **options)
    spark = vectors.sparkSession
    digest = [(c, hashlib.sha256(",".join(map(str, v)).encode()).hexdigest()) for c, v in enumerate(centroids.tolist())]
    names = spark.createDataFrame(digest, "cluster int, centroid_sha256 string")
    by = rows.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")).collect()  # one row a centroid
    total = sum(r["cluster_inertia"] for r in by)
    sums = spark.createDataFrame([(r["cluster"], r["cluster_inertia"], total) for r in by], "cluster int, cluster_inertia long, inertia long")
    found = rows.join(F.broadcast(sums.join(names, "cluster")), "cluster")  # at most k rows
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustered(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


def _sql_round(n: int) -> str:
    return f"""
d{n} AS (
  SELECT e.row, c.c, CAST(list_inner_product(e.v, e.v) - 2 * list_inner_product(e.v, c.v) + list_inner_product(c.v, c.v) AS BIGINT) AS d
  FROM e CROSS JOIN c{n} c),
a{n} AS (SELECT row, c, d FROM d{n} QUALIFY row_number() OVER (PARTITION BY row ORDER BY d, c) = 1)"""


def _sql_means(n: int) -> str:
    return f"""
u{n} AS (SELECT a.c, unnest(e.v) AS x, unnest(range({WIDTH})) AS i FROM a{n} a JOIN e USING (row)),
t{n} AS (SELECT c, i, sum(x)::HUGEINT AS s, count(*) AS n FROM u{n} GROUP BY c, i),
m{n} AS (SELECT c, list(((s - ((s % n) + n) % n) / n)::DOUBLE ORDER BY i) AS v FROM t{n} GROUP BY c),
c{n + 1} AS (SELECT c.c, coalesce(m.v, c.v) AS v FROM c{n} c LEFT JOIN m{n} m USING (c))"""


SQL = f"""
WITH raw AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = {WIDTH}),
e AS (
  SELECT row_number() OVER () AS row, vec_id, v FROM raw
  WHERE len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x) OR abs(x) > {LIMIT})) = 0),
c0 AS (
  SELECT CAST(row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1 AS INTEGER) AS c, v FROM e
  WHERE vec_id IS NOT NULL QUALIFY c < {K}),
{",".join(_sql_round(n) + "," + _sql_means(n) for n in range(ROUNDS))},{_sql_round(ROUNDS)}
SELECT e.vec_id, a.c AS cluster, a.d AS distance,
       CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(list_transform(c.v, lambda x: CAST(x AS BIGINT)), ',')) AS centroid_sha256
FROM a{ROUNDS} a JOIN e USING (row) JOIN c{ROUNDS} c ON c.c = a.c
"""

"""Operator 3: exact top-k inner-product search by dual cover trees.

A cover tree has nested levels: the centres of level i are among those of level i + 1, lie more than r / 2**i apart and
cover all points within r / 2**i. Farthest-first order gives all levels at once: the points so far when the next one is
r / 2**i away or nearer are level i. Queries and candidates are both indexed; pairs of nodes are visited best bound first,
and a pair with centres q, c and covering radii R, r is pruned if q.c + R|c| + r|q| + Rr is below the worst kth score of the
query node.

On Spark. Up to ``PIVOTS`` points of a bounded sample, farthest first, are the top level: every vector belongs to its nearest
pivot, queries to groups and candidates to blocks of a pivot, each of bounded size. A first round searches each query group
in the blocks of its own pivot (and more of the best bound, until they hold more than k candidates). Its worst kth score
decides which other pivots can still hold something: only those meet in the second round, which starts from the scores of
the first. The driver holds pivots and counts, at most ``PIVOTS`` squared small numbers.

Defined results
- components become floor(1024 * x), x as double; null vectors and vectors with a null or non-finite component, or one
  beyond 62 bits, take no part; a query's own row is no candidate; ties go to the smaller id; fewer candidates give fewer rows.
- rows with equal vectors all count: of each distinct vector the k + 1 smallest ids are carried, which is all that a
  list of k can use. Vectors of other lengths are compared only with their like. Empty tables give no rows.
- scores wrap around where an inner product needs more than 64 bits.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewater.session import cut

K = 10
BLOCK = 8192  # candidates in a block
GROUP = 4096  # queries in a group
LEAF = 64
PIVOTS = 512
SAMPLE = 4096  # vectors, about, that pivots are chosen from, and one of each length
NONE = np.iinfo(np.int64).min


def farthest_first(x: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows in the order chosen, each one's distance from those before it: not increasing); equal points are chosen once."""
    chosen, away = [0], [np.inf]
    near = ((x - x[0]) ** 2).sum(1)
    while len(chosen) < most:
        p = int(near.argmax())
        if near[p] <= 0:
            break
        chosen.append(p)
        away.append(float(near[p] ** 0.5))
        np.minimum(near, ((x - x[p]) ** 2).sum(1), near)
    return np.array(chosen), np.array(away)


class CoverTree:
    """Cover tree over the rows of ``x`` (float64), down to the level that has ``len(x) / leaf`` centres.

    ``levels[i]`` centres, a prefix of ``order``, are within ``scale / 2**i`` of all points and further than that from each
    other. A node stands for a centre at one level; its children are itself and others at the next, and those of the
    last level hold ``rows``. ``radius`` is the largest distance from the centre to a row below.
    """

    def __init__(self, x: np.ndarray, leaf: int = LEAF):
        self.order, away = farthest_first(x, max(1, -(-len(x) // leaf)))
        centre = x[self.order]
        self.scale = float(np.sqrt(((x - x[0]) ** 2).sum(1).max()))
        self.levels = [1]
        while self.levels[-1] < len(self.order):
            gap = self.scale / 2 ** len(self.levels)
            self.levels.append(int(np.searchsorted(-away, -gap, "left")))  # chosen further away than the gap
            if self.levels[-1] == self.levels[-2] == 1 and gap <= 0:
                break
        # nearest centre of each prefix, by level
        self.center: list[np.ndarray] = [centre[0]]
        self.radius: list[float] = [self.scale]
        self.children: list[list[int]] = [[]]
        self.rows: list[np.ndarray] = [np.zeros(0, np.int64)]
        at = {0: 0}  # node of each centre at the level above
        for above, below in zip(self.levels, self.levels[1:]):
            if below == above:
                continue
            near = _nearest(centre[:below], centre[:above])
            near[:above] = np.arange(above)  # a centre stays its own parent
            new = {}
            for k in range(below):
                new[k] = len(self.center)
                self.children[at[int(near[k])]].append(new[k])
                self.center.append(centre[k])
                self.radius.append(0.0)
                self.children.append([])
                self.rows.append(np.zeros(0, np.int64))
            at = new
        home = _nearest(x, centre)
        by = np.argsort(home, kind="stable")
        ends = np.cumsum(np.bincount(home, minlength=len(centre)))
        for k, n in at.items():
            self.rows[n] = by[ends[k - 1] if k else 0 : ends[k]]
        for n in range(len(self.center) - 1, -1, -1):
            own = self.below(n)
            self.radius[n] = float(np.sqrt(((x[own] - self.center[n]) ** 2).sum(1).max())) if len(own) else 0.0

    def below(self, n: int) -> np.ndarray:
        todo, out = [n], []
        while todo:
            m = todo.pop()
            out.append(self.rows[m])
            todo.extend(self.children[m])
        return np.concatenate(out)


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Index of the nearest centre of each row; the first among equals."""
    norms = (centres**2).sum(1)
    return np.concatenate([(norms - 2 * (x[s : s + 4096] @ centres.T)).argmin(1) for s in range(0, len(x), 4096)]) if len(x) else np.zeros(0, np.int64)


def search(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int = K, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query ids, candidate ids, scores), at most k a query; q and c are int64 matrices of one width. ``floor``: kth scores
    that the queries have already, below which nothing is wanted."""
    if not len(q) or not len(c):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    exact_in_float = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(1, q.shape[1]) < 2.0**52
    qf, cf = q.astype(np.float64), c.astype(np.float64)
    qt, ct = CoverTree(qf), CoverTree(cf)
    best_s = np.full((len(q), k), NONE)
    best_i = np.full((len(q), k), np.iinfo(np.int64).max)
    least = np.full(len(q), NONE) if floor is None else floor
    q_norm = [float(np.linalg.norm(v)) for v in qt.center]
    c_norm = [float(np.linalg.norm(v)) for v in ct.center]
    worst = [float(least[qt.below(n)].min(initial=np.iinfo(np.int64).max)) for n in range(len(qt.center))]
    above = [-1] * len(qt.center)
    for n, own in enumerate(qt.children):
        for m in own:
            above[m] = n

    def bound(a: int, b: int) -> float:
        x = float(qt.center[a] @ ct.center[b]) + qt.radius[a] * c_norm[b] + ct.radius[b] * q_norm[a] + qt.radius[a] * ct.radius[b]
        return x + 1e-9 * (abs(x) + q_norm[a] * c_norm[b] + 1)

    heap = [(-bound(0, 0), 0, 0)]
    while heap:
        neg, a, b = heapq.heappop(heap)
        if -neg < worst[a]:
            continue
        if qt.children[a] or ct.children[b]:
            for x in qt.children[a] or [a]:
                for y in ct.children[b] or [b]:
                    if (z := bound(x, y)) >= worst[x]:
                        heapq.heappush(heap, (-z, x, y))
            continue
        qr, cr = qt.rows[a], ct.rows[b]
        if not len(qr) or not len(cr):
            continue
        s = (qf[qr] @ cf[cr].T).astype(np.int64) if exact_in_float else q[qr] @ c[cr].T
        ids = np.broadcast_to(c_ids[cr], s.shape)
        s = np.where((ids == q_ids[qr][:, None]) | (s < least[qr][:, None]), NONE, s)
        all_s = np.hstack([best_s[qr], s])
        all_i = np.hstack([best_i[qr], np.where(s == NONE, np.iinfo(np.int64).max, ids)])
        top = np.lexsort((all_i, -all_s.astype(np.float64) if exact_in_float else ~all_s), axis=1)[:, :k]
        best_s[qr] = np.take_along_axis(all_s, top, 1)
        best_i[qr] = np.take_along_axis(all_i, top, 1)
        worst[a] = float(np.maximum(best_s[qr, k - 1], least[qr]).min())
        while above[a] >= 0:
            a = above[a]
            low = min(worst[m] for m in qt.children[a])
            if low <= worst[a]:
                break
            worst[a] = low
    r, col = np.nonzero(best_s != NONE)
    return q_ids[r], best_i[r, col], best_s[r, col]


def scaled(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """id, v (little-endian int64 components), without the vectors that take no part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, vs = [], []
            for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if v is None or i is None or any(x is None for x in v):
                    continue
                x = np.floor(1024 * np.array(v, np.float64))
                if (np.abs(x) < 2.0**62).all():
                    ids.append(i)
                    vs.append(x.astype("<i8").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(vs, pa.binary())], names=["id", "v"])

    return vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v")).mapInArrow(run, "id long, v binary")


def _kept(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Per partition: the k + 1 smallest ids of each distinct vector."""
    own: dict[bytes, list[int]] = {}
    for b in batches:
        for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            ids = own.setdefault(v, [])
            if len(ids) <= k:
                ids.append(i)
                ids.sort()
            elif i < ids[-1]:
                ids[-1] = i
                ids.sort()
        if len(own) > 200_000:
            yield _kept_batch(own)
            own = {}
    yield _kept_batch(own)


def _kept_batch(own: dict[bytes, list[int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(own), pa.binary()), pa.array(list(own.values()), pa.list_(pa.int64()))], names=["v", "ids"])


def _rows(vs: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(vs), "<i8").reshape(len(vs), -1)


class Pivots:
    """The top level: pivots by vector length, what belongs to each, and which of them must meet."""

    def __init__(self, sample: list[bytes], blocks: int):
        self.of: dict[int, np.ndarray] = {}  # bytes of a vector -> float64 pivots
        self.start: dict[int, int] = {}
        n = 0
        for w in sorted({len(v) for v in sample}):
            own = [v for v in sample if len(v) == w]
            x = _rows(sorted(own)).astype(np.float64)
            order, _ = farthest_first(x, max(1, min(blocks, PIVOTS)))
            self.of[w], self.start[w] = x[order], n
            n += len(order)
        self.n = n

    def assign(self, vs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(pivot, distance) of each vector; -1 for lengths that the sample lacks."""
        home, away = np.full(len(vs), -1), np.zeros(len(vs))
        lengths = np.array([len(v) for v in vs])
        for w in np.unique(lengths):
            if int(w) in self.of and w:
                at = np.flatnonzero(lengths == w)
                x, c = _rows([vs[k] for k in at]).astype(np.float64), self.of[int(w)]
                near = _nearest(x, c)
                home[at] = near + self.start[int(w)]
                away[at] = np.sqrt(((x - c[near]) ** 2).sum(1))
        return home, away


def _placed(df: DataFrame, pivots: Pivots) -> DataFrame:
    """id, v, pivot, away."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            home, away = pivots.assign(b.column(1).to_pylist()) if b.num_rows else (np.zeros(0, np.int64), np.zeros(0))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(home, pa.int32()), pa.array(away, pa.float64())], names=["id", "v", "pivot", "away"])

    return df.mapInArrow(run, "id long, v binary, pivot int, away double")


def _sizes(df: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, covering radius) of each pivot."""
    count, radius = np.zeros(n, np.int64), np.zeros(n)
    for r in df.where("pivot >= 0").groupBy("pivot").agg(F.count("*").alias("n"), F.max("away").alias("r")).collect():
        count[r["pivot"]], radius[r["pivot"]] = r["n"], r["r"]
    return count, radius


def _met(queries: DataFrame, candidates: DataFrame, meets: np.ndarray, groups: np.ndarray, blocks: np.ndarray, k: int) -> DataFrame:
    """query_id, vec_id, score of the query groups of pivot a and the candidate blocks of pivot b where ``meets[a, b]``.

    ``queries``: id, v, pivot, floor (a kth score so far, or null)."""

    def cells(own: np.ndarray, other: np.ndarray, partners: list[np.ndarray], candidates_side: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                # each row to a block of its own pivot, by id, and to every block of the other side that it meets
                home, ids = b.column("pivot").to_numpy(), b.column("id").to_numpy()
                part = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).astype(np.int64) % np.maximum(own[home], 1) if len(ids) else ids
                rows, cell = [], []
                for k_, (h, p) in enumerate(zip(home.tolist(), part.tolist())):
                    for o in partners[h].tolist():
                        for x in range(int(other[o])):
                            rows.append(k_)
                            cell.append(f"{o}.{x}|{h}.{p}" if candidates_side else f"{h}.{p}|{o}.{x}")
                kept = b.take(pa.array(rows, pa.int64())) if rows else b.slice(0, 0)
                yield pa.RecordBatch.from_arrays([pa.array(cell, pa.string()), *kept.columns], names=["cell", *b.schema.names])

        return run

    to = [np.flatnonzero(row) for row in meets]
    back = [np.flatnonzero(col) for col in meets.T]
    left = candidates.where("pivot >= 0").select("id", "v", "pivot").mapInArrow(cells(blocks, groups, back, True), "cell string, id long, v binary, pivot int")
    right = queries.where("pivot >= 0").select("id", "v", "pivot", "floor").mapInArrow(cells(groups, blocks, to, False), "cell string, id long, v binary, pivot int, floor long")

    def run(key: tuple, c: pa.Table, q: pa.Table) -> pa.Table:
        out = [np.zeros(0, np.int64)] * 3
        if c.num_rows and q.num_rows:
            floor = q.column("floor").fill_null(int(NONE)).to_numpy()
            out = search(q.column("id").to_numpy(), _rows(q.column("v").to_pylist()), c.column("id").to_numpy(), _rows(c.column("v").to_pylist()), k, floor)
        return pa.table(dict(zip(["query_id", "vec_id", "score"], out)))

    return left.groupBy("cell").cogroup(right.groupBy("cell")).applyInArrow(lambda key, c, q: run(key, c, q), "query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score. ``queries``: a stated set of rows like those of ``vectors``."""
    data = scaled(vectors, id_col, vec_col)
    kept = data.mapInArrow(lambda it: _kept(it, k), "v binary, ids array<long>").groupBy("v").agg(F.slice(F.sort_array(F.flatten(F.collect_list("ids"))), 1, k + 1).alias("ids"))
    kept = cut(kept.select(F.explode("ids").alias("id"), "v"))
    n = kept.count()
    seen = kept.select("v", F.octet_length("v").alias("w"), F.xxhash64("v").alias("h"))
    one = seen.groupBy("w").agg(F.min_by("v", "h").alias("v")).select("v")  # of every length
    some = seen.where(F.pmod("h", F.lit(1 << 30)) < int(min(1.0, SAMPLE / max(1, n)) * (1 << 30))).orderBy("h", "v").limit(2 * SAMPLE).select("v")
    sample = sorted({bytes(r["v"]) for r in one.unionByName(some).collect()})
    pivots = Pivots(sample, -(-n // BLOCK))
    kept = cut(_placed(kept, pivots))
    asked = cut(_placed(scaled(queries, id_col, vec_col), pivots))
    (c_n, c_r), (q_n, q_r) = _sizes(kept, pivots.n), _sizes(asked, pivots.n)
    blocks, groups = -(-c_n // BLOCK), -(-q_n // GROUP)
    # the best score that a query of pivot a and a candidate of pivot b can have
    bounds = np.full((pivots.n, pivots.n), -np.inf)
    for w, c in pivots.of.items():
        s = slice(pivots.start[w], pivots.start[w] + len(c))
        norm = np.linalg.norm(c, axis=1)
        x = c @ c.T + q_r[s, None] * norm + norm[:, None] * c_r[s] + q_r[s, None] * c_r[s]
        bounds[s, s] = x + 1e-6 * (np.abs(x) + norm[:, None] * norm + 1)
    bounds[:, c_n == 0] = -np.inf
    bounds[q_n == 0] = -np.inf
    first = np.zeros_like(bounds, bool)
    for a in np.flatnonzero(q_n):
        order = np.argsort(-bounds[a], kind="stable")
        order = order[np.isfinite(bounds[a, order])]
        order = np.r_[order[order == a], order[order != a]]
        need = int(np.searchsorted(np.cumsum(c_n[order]), k + 1)) + 1
        first[a, order[:need]] = True
    schema = "query_id long, vec_id long, score long"
    spark = vectors.sparkSession
    found = cut(_met(asked.withColumn("floor", F.lit(None).cast("long")), kept, first, groups, blocks, k)) if first.any() else spark.createDataFrame([], schema)
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    found = cut(found.withColumn("rank", best).where(F.col("rank") <= k))
    if np.isfinite(bounds[~first]).any():
        kth = found.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("floor"))
        asked = cut(asked.join(kth, "id", "left"))
        worst = np.full(pivots.n, -np.inf)
        for r in asked.where("pivot >= 0").groupBy("pivot").agg(F.min("floor").alias("low"), F.bool_and(F.col("floor").isNotNull()).alias("all")).collect():
            worst[r["pivot"]] = r["low"] if r["all"] else -np.inf
        second = ~first & np.isfinite(bounds) & (bounds >= worst[:, None])
        if second.any():
            more = _met(asked, kept, second, groups, blocks, k)
            found = found.select("query_id", "vec_id", "score").unionByName(more).withColumn("rank", best).where(F.col("rank") <= k)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op3_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return top_k(vectors, vectors.where(F.col("vec_id") % 100 == 0))


SQL = """
WITH raw AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL),
e AS (
  SELECT vec_id, v FROM raw
  WHERE len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM e q JOIN e c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

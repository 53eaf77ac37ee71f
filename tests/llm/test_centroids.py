"""Operator 12: the dual-tree walk against all distances, the whole against plain rounds and the SQL."""

import hashlib
import math

import duckdb
import numpy as np
import pandas as pd
import pytest

from tidewater.llm import centroids as m
from tidewater.llm.topk import CoverTree


def plain(rows, k=m.K, rounds=m.ROUNDS, width=m.WIDTH):
    kept = []
    for i, v in rows:
        if v is None or len(v) != width or any(c is None or not math.isfinite(c) for c in v):
            continue
        x = [math.floor(64 * c) for c in v]
        if max(map(abs, x)) <= m.LIMIT:
            kept.append((i, x))
    order = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), x) for i, x in kept if i is not None)
    cs = [x for _, x in order[:k]]
    if not cs:
        return []
    dist = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c))
    home = lambda: [min((dist(x, c), n) for n, c in enumerate(cs)) for _, x in kept]
    for _ in range(rounds):
        near = home()
        for n in range(len(cs)):
            own = [x for (_, x), (_, c) in zip(kept, near) if c == n]
            if own:
                cs[n] = [sum(col) // len(own) for col in zip(*own)]
    near = home()
    by = [sum(d for d, c in near if c == n) for n in range(len(cs))]
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cs]
    return [(i, c, d, by[c], sum(by), sha[c]) for (i, _), (d, c) in zip(kept, near)]


def hard_rows(n, seed=1):
    rng = np.random.default_rng(seed)
    mids = rng.normal(size=(6, m.WIDTH))
    rows = [(k, (mids[k % 6] + 0.05 * rng.normal(size=m.WIDTH)).tolist()) for k in range(n)]
    rows += [(1, rows[2][1]), (1, rows[4][1]), (None, rows[3][1]), (n, None), (n + 1, [1.0] * 63), (n + 2, [1.0] * 65), (n + 3, [])]
    rows += [(n + 4, [float("nan")] + [0.0] * 63), (n + 5, [float("inf")] + [0.0] * 63), (n + 6, [None] + [0.0] * 63), (n + 7, [1e30] + [0.0] * 63)]
    return rows + [(n + 8 + k, [0.25] * 64) for k in range(40)]


def frame(spark, rows):
    return spark.createDataFrame([(i, v, k % 3, 1) for k, (i, v) in enumerate(rows)], "vec_id long, embedding array<double>, cluster int, tree int").repartition(3)


@pytest.mark.parametrize("block", [8, 100, 8192])
def test_rounds_against_a_plain_walk(spark, block):
    rows = hard_rows(300)
    got = sorted((tuple(r) for r in m.clustered(frame(spark, rows), block=block).collect()), key=str)
    assert got == sorted(plain(rows), key=str)


def test_fewer_vectors_than_centroids_and_empty(spark):
    rows = hard_rows(5)[:9]
    assert sorted((tuple(r) for r in m.clustered(frame(spark, rows)).collect()), key=str) == sorted(plain(rows), key=str)
    assert m.clustered(frame(spark, [])).count() == 0
    assert m.clustered(frame(spark, [(1, None)])).count() == 0


@pytest.mark.parametrize("spread", [0.0, 0.01, 1.0, 1e5])
def test_walk_equals_all_distances(spread):
    rng = np.random.default_rng(3)
    x = np.floor(64 * (rng.normal(size=(40, 8)) * 10)[rng.integers(0, 40, 900)] + spread * rng.normal(size=(900, 8))).astype(np.int64)
    for k in (1, 2, 16, 90):
        c = x[rng.integers(0, len(x), k)]  # with equal ones
        want = np.stack([((x - one) ** 2).sum(1) for one in c], 1).argmin(1)
        assert (m.nearest(CoverTree(x.astype(np.float64)), x, c) == want).all()


def test_walk_prunes():
    """Tight, distant groups are settled by bounds: hardly any pair of leaves is compared."""
    rng = np.random.default_rng(5)
    x = (1000 * rng.integers(-9, 9, (20, 8)))[rng.integers(0, 20, 4000)] + rng.integers(0, 3, (4000, 8))
    seen = []
    exact, m.squared = m.squared, lambda a, b: seen.append(len(a) * len(b)) or exact(a, b)
    try:
        m.nearest(CoverTree(x.astype(np.float64)), x, x[:20])
    finally:
        m.squared = exact
    assert sum(seen) < 0.35 * 4000 * 20


def test_large_components_are_exact():
    x = np.array([[2**27, -(2**27)], [2**27 - 1, -(2**27)], [0, 0]], np.int64)
    assert m.squared(x, x).tolist() == [[sum((int(a) - int(b)) ** 2 for a, b in zip(p, q)) for q in x] for p in x]


def test_equals_sql(spark, tmp_path):
    rows = [r for r in hard_rows(400) if r[0] != 1]
    pd.DataFrame(rows, columns=["vec_id", "embedding"]).astype({"vec_id": "Int64"}).to_parquet(tmp_path / "embeddings.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet'")
    got = [tuple(r) for r in m.op12_centroid_clusters(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(con.sql(m.SQL).fetchall(), key=str) == sorted(plain(rows), key=str)

import numpy as np
import pytest

import tidewater.llm.topk as T
from tidewater.llm.topk import CoverTree, search, top_k


def brute(q_ids, q, c_ids, c, k):
    out = set()
    for i, v in zip(q_ids, q):
        scores = sorted((-int(v @ w), int(j)) for j, w in zip(c_ids, c) if j != i)[:k]
        out |= {(int(i), j, -s) for s, j in scores}
    return out


@pytest.mark.parametrize("seed, n, d, spread", [(0, 700, 8, 1000), (1, 900, 64, 300), (2, 500, 3, 3), (3, 300, 16, 2**40)])
def test_search_against_brute_force(seed, n, d, spread):
    rng = np.random.default_rng(seed)
    c = rng.integers(-spread, spread, (n, d)) if spread < 2**20 else rng.integers(-(2**25), 2**25, (n, d))
    c[n // 2 : n // 2 + 100] = c[0]
    ids = rng.permutation(n)
    at = np.arange(0, n, 9)
    got = set(zip(*(x.tolist() for x in search(ids[at], c[at], ids, c))))
    assert got == brute(ids[at], c[at], ids, c, 10)


@pytest.mark.parametrize("kind", ["normal", "clustered", "equal", "line"])
def test_levels_are_nested_apart_and_cover(kind):
    rng = np.random.default_rng(1)
    x = {
        "normal": rng.normal(size=(500, 5)),
        "clustered": rng.normal(size=(10, 4)).repeat(50, 0) * 100 + rng.normal(size=(500, 4)),
        "equal": np.ones((200, 3)),
        "line": np.cumsum(1.3 ** np.arange(60))[:, None] * np.ones((1, 2)),
    }[kind]
    t = CoverTree(x, 5)
    away = lambda a, b: np.sqrt(((a[:, None] - b[None]) ** 2).sum(2))
    assert t.levels == sorted(t.levels)  # each level is a prefix of the next: nesting
    for i, n in enumerate(t.levels):
        c, gap = x[t.order[:n]], t.scale / 2**i
        if n == len(t.order) and i == len(t.levels) - 1:
            break  # the last level is cut short at its number of centres
        assert n == 1 or (away(c, c) + np.eye(n) * 1e30).min() > gap - 1e-9  # separation
        assert away(x, c).min(1).max() <= gap + 1e-9  # covering
    assert sorted(t.below(0).tolist()) == list(range(len(x)))
    for n in range(len(t.center)):
        own = x[t.below(n)]
        assert not len(own) or np.sqrt(((own - t.center[n]) ** 2).sum(1)).max() <= t.radius[n] + 1e-9
        assert not t.children[n] or any((t.center[m] == t.center[n]).all() for m in t.children[n])


def test_floors_change_no_result():
    rng = np.random.default_rng(6)
    c = rng.integers(-50, 50, (400, 6))
    ids = np.arange(400)
    plain = set(zip(*(x.tolist() for x in search(ids[:40], c[:40], ids, c))))
    kth = np.array([min(s for q, _, s in plain if q == i) for i in range(40)])
    assert set(zip(*(x.tolist() for x in search(ids[:40], c[:40], ids, c, floor=kth)))) == plain


@pytest.mark.parametrize("spread", [3, 400])
def test_many_pivots_against_brute_force(spark, monkeypatch, spread):
    monkeypatch.setattr(T, "BLOCK", 40)
    monkeypatch.setattr(T, "GROUP", 7)
    rng = np.random.default_rng(8)
    at = rng.normal(size=(9, 6)) * spread
    x = np.vstack([at[k % 9] + rng.normal(size=6) for k in range(600)])
    x[100:160] = x[0]
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    q = df.where("vec_id % 9 = 0")
    full = np.floor(1024 * x).astype(np.int64)
    ids = np.arange(600)
    got = {(r["query_id"], r["vec_id"], r["score"]) for r in top_k(df, q).collect()}
    assert got == brute(ids[::9], full[::9], ids, full, 10)


def test_frame_edges(spark):
    rows = [(0, [1.0, 0.5], 1), (1, [1.0, 0.5], 1), (2, None, 1), (3, [None, 1.0], 1), (4, [float("nan"), 1.0], 1), (5, [float("inf"), 0.0], 1), (6, [0.0001, -1.0], 1), (7, [1.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int")
    got = sorted(tuple(r) for r in top_k(df, df).select("query_id", "rank", "vec_id", "score").collect())
    full = {0: [1024, 512], 1: [1024, 512], 6: [0, -1024]}
    want = []
    for i, v in full.items():
        best = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in full.items() if j != i)
        want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    assert got == sorted(want)
    assert top_k(df.limit(0), df).count() == 0 and top_k(df, df.limit(0)).count() == 0


def test_mixed_lengths(spark):
    rng = np.random.default_rng(2)
    rows = [(k, rng.normal(size=k % 5).tolist()) for k in range(100)]
    got = top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), spark.createDataFrame(rows[:10], "vec_id long, embedding array<double>"))
    assert {r["query_id"]: r["n"] for r in got.groupBy("query_id").count().withColumnRenamed("count", "n").collect()} == {k: 10 for k in range(10) if k % 5}


def test_many_equal_vectors(spark):
    df = spark.createDataFrame([(i, [0.5, 0.25]) for i in range(200)], "vec_id long, embedding array<double>")
    got = top_k(df, df.where("vec_id % 100 = 0"))
    assert sorted(r["vec_id"] for r in got.where("query_id = 0").collect()) == list(range(1, 11))
    assert sorted(r["vec_id"] for r in got.where("query_id = 100").collect()) == list(range(10))

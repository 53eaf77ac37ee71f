"""Histogram trees against a plain learner of one process, and Shapley values against their definition."""

import math
from itertools import combinations

import numpy as np
import pandas as pd
import pytest

from tidewater.operators import trees as t


def plain_tree(bins, grad, hess, n, lr, depth, node=0, out=None):
    """Depth-wise splits by exhaustive search over one process's arrays: {node: (feature, cut)}."""
    out = {} if out is None else out
    if depth == 0:
        return out
    best = (1e-9, None)
    G, H = grad.sum(), hess.sum()
    for f in range(bins.shape[1]):
        for c in range(t.BINS):
            left = bins[:, f] <= c
            if n[left].sum() < t.LEAST_ROWS or n[~left].sum() < t.LEAST_ROWS:
                continue
            gl, hl = grad[left].sum(), hess[left].sum()
            gain = gl**2 / (hl + lr.l2) + (G - gl) ** 2 / (H - hl + lr.l2) - G**2 / (H + lr.l2)
            if gain > best[0] + 1e-9:
                best = (gain, (f, c))
    if best[1] is None:
        return out
    out[node] = best[1]
    left = bins[:, best[1][0]] <= best[1][1]
    for child, own in ((2 * node + 1, left), (2 * node + 2, ~left)):
        plain_tree(bins[own], grad[own], hess[own], n[own], lr, depth - 1, child, out)
    return out


@pytest.fixture(scope="module")
def made(spark):
    rng = np.random.default_rng(8)
    bins = rng.integers(0, t.BINS, (700, 5)).astype(np.uint8)
    odds = 0.3 * (bins[:, 0].astype(float) - 16) * np.where(bins[:, 1] > 12, 1, -1) + 0.1 * bins[:, 2]
    y = (rng.random(700) < 1 / (1 + np.exp(-odds))).astype(float)
    keys = rng.integers(-(2**62), 2**62, 700)
    df = spark.createDataFrame(pd.DataFrame({"h": keys, "y": y, "b": [r.tobytes() for r in bins]}), "h long, y double, b binary").repartition(5)
    return df, bins, y, keys


def test_boosted_trees_equal_a_plain_learner(made):
    df, bins, y, _ = made
    lr = t.Learner("x", True, trees=3, depth=3, rate=0.3, l2=1.0)
    (e,) = t.grow(df, 5, [lr])
    margin = np.full(len(y), math.log(y.mean() / (1 - y.mean())))
    for tree in e.trees:
        p = 1 / (1 + np.exp(-margin))
        want = plain_tree(bins, p - y, p * (1 - p), np.ones(len(y)), lr, 3)
        assert {k: (int(tree.feature[k]), int(tree.cut[k])) for k in np.flatnonzero(tree.feature >= 0)} == want
        leaf = tree.leaf(bins)
        for k in np.unique(leaf):
            own = leaf == k
            assert tree.value[k] == pytest.approx(-(p - y)[own].sum() / ((p * (1 - p))[own].sum() + 1) * 0.3) and tree.rows[k] == own.sum()
        margin = margin + tree.value[leaf]
    assert np.allclose(e.margin(bins), margin)


def test_all_learners_learn_together_and_repeat(made):
    df, bins, y, keys = made
    first, again = t.grow(df, 5, t.LEARNERS[:1] + t.LEARNERS[2:]), t.grow(df.repartition(2), 5, t.LEARNERS[:1] + t.LEARNERS[2:])
    for a, b in zip(first, again):
        assert np.allclose(a.probability(bins), b.probability(bins))
        assert ((a.probability(bins) > 0.5) == y).mean() > 0.8
        assert a.importance(5)[:2].sum() > 0.5 and a.importance(5).sum() == pytest.approx(1)
    leafwise, level = first[2], first[3]
    assert all(sum(1 for _ in tree.paths()) <= 12 for tree in leafwise.trees)
    for tree in level.trees:
        for d in range(tree.depth):
            own = [k for k in range(2**d - 1, 2 ** (d + 1) - 1) if tree.feature[k] >= 0]
            assert len({(int(tree.feature[k]), int(tree.cut[k])) for k in own}) <= 1
    assert t.draws(keys, 1).mean() == pytest.approx(1, abs=0.15) and (t.draws(keys, 1) != t.draws(keys, 2)).any()


def test_extra_trees_cut_at_random(made):
    df, bins, y, _ = made
    (e,) = t.grow(df, 5, [t.Learner("x", False, trees=12, depth=4, some=True, any_cut=True)])
    roots = {(int(tree.feature[0]), int(tree.cut[0])) for tree in e.trees}
    assert len(roots) > 6 and ((e.probability(bins) > 0.5) == y).mean() > 0.65


def test_shapley_by_definition(made):
    df, bins, _, _ = made
    (e,) = t.grow(df, 5, [t.Learner("x", True, trees=2, depth=4, l2=1.0)])
    for tree in e.trees:
        got = t.shapley(tree, bins[:6], 5)

        def value(row, known, k=0):
            f = tree.feature[k]
            if f < 0:
                return tree.value[k]
            a, b = 2 * k + 1, 2 * k + 2
            if f in known:
                return value(row, known, b if row[f] > tree.cut[k] else a)
            return (tree.rows[a] * value(row, known, a) + tree.rows[b] * value(row, known, b)) / tree.rows[k]

        for r in range(6):
            for f in range(5):
                others = [x for x in range(5) if x != f]
                want = sum(math.factorial(s) * math.factorial(4 - s) / math.factorial(5) * (value(bins[r], {*c, f}) - value(bins[r], set(c))) for s in range(5) for c in combinations(others, s))
                assert got[r, f] == pytest.approx(want, abs=1e-9)
            assert got[r].sum() == pytest.approx(value(bins[r], set(range(5))) - value(bins[r], set()))


def test_edges_and_bins(spark):
    df = spark.createDataFrame([(float(k), 1.0) for k in range(100)], "a double, b double")
    edges = t.edges_of(df, ["a", "b"])
    bins = t.binned(np.array([[0.0, 1.0], [50.0, 1.0], [1000.0, 2.0]]), edges)
    assert len(edges[0]) <= t.BINS - 1 and bins[:, 0].tolist() == sorted(bins[:, 0].tolist()) and bins[2, 0] == len(edges[0]) and bins[0, 1] == 0 and bins[2, 1] == 1


def test_sums_come_as_columns_and_nothing_grows_from_no_rows(spark, monkeypatch):
    learner = t.Learner(**{**t.LEARNERS[0].__dict__})
    data = spark.createDataFrame([(k, float(k % 2), bytes([k % 2, 3])) for k in range(40)], "h long, y double, b binary")
    growing = t._Growing(0, 0, t.Tree(learner.depth), [0], {0: np.arange(2)})
    monkeypatch.setattr(type(data), "collect", lambda self: 1 / 0)  # no row objects in the driver
    ensemble = [t.Ensemble(learner, 0.0)]
    found = t._summed(data, ensemble, [growing])
    assert set(found) == {(0, 0, 0), (0, 0, 1)} and found[0, 0, 0].shape == (t.BINS, 3) and found[0, 0, 1][3, 2] == found[0, 0, 0][:2, 2].sum() > 0
    assert t._summed(data.where("false"), ensemble, [growing]) == {}

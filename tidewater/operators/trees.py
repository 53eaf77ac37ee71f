"""Tree ensembles grown from histograms that Spark sums: forests, extremely randomised trees and three kinds of boosting.

Features are cut into at most `BINS` bins at quantiles. One job a level sums gradients over (tree, node, feature, bin) for
all trees that grow at that time, of every learner: the trees of the forests together, one tree of each boosted learner a
round. What comes to the driver is as many numbers as trees x nodes x features x bins, whatever the rows. A row's
gradient is worked out from the trees before, so no job depends on a stored margin, and a lost executor costs a repeat.

A tree is an array: node k has the children 2k + 1 and 2k + 2. Shapley values are the path-dependent ones: a leaf's value
counts for a subset of features as far as the row follows them, and by the share of training rows elsewhere.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BINS = 32
LEAST_ROWS = 5


@dataclass
class Tree:
    depth: int
    feature: np.ndarray = field(init=False)  # -1: a leaf
    cut: np.ndarray = field(init=False)  # bins up to it go left
    value: np.ndarray = field(init=False)
    rows: np.ndarray = field(init=False)
    gain: np.ndarray = field(init=False)

    def __post_init__(self):
        n = 2 ** (self.depth + 1) - 1
        self.feature, self.cut = np.full(n, -1), np.zeros(n, np.int64)
        self.value, self.rows, self.gain = np.zeros(n), np.zeros(n), np.zeros(n)

    def leaf(self, bins: np.ndarray) -> np.ndarray:
        node, at = np.zeros(len(bins), np.int64), np.arange(len(bins))
        for _ in range(self.depth):
            f = self.feature[node]
            node = np.where(f >= 0, 2 * node + 1 + (bins[at, np.maximum(f, 0)] > self.cut[node]), node)
        return node

    def paths(self) -> Iterator[tuple[int, list[tuple[int, bool]]]]:
        """Every leaf with the (node, went right) above it."""
        todo: list[tuple[int, list[tuple[int, bool]]]] = [(0, [])]
        while todo:
            k, above = todo.pop()
            if self.feature[k] < 0:
                yield k, above
            else:
                todo += [(2 * k + 1, [*above, (k, False)]), (2 * k + 2, [*above, (k, True)])]


@dataclass(frozen=True)
class Learner:
    name: str
    boosted: bool
    trees: int = 20
    depth: int = 5
    rate: float = 0.3
    l2: float = 0.0
    some: bool = False  # a random choice of features at each node, as many as the root of all
    any_cut: bool = False  # one random cut a feature
    drawn: bool = False  # rows drawn with replacement
    leaves: int = 1 << 30
    level: bool = False  # one split for a whole level


LEARNERS = [
    Learner("random_forest", False, some=True, drawn=True),
    Learner("extra_trees", False, some=True, any_cut=True),
    Learner("boosted_depthwise", True, trees=10, depth=4, l2=1.0),
    Learner("boosted_leafwise", True, trees=10, depth=5, l2=0.1, leaves=12),
    Learner("boosted_levelwise", True, trees=10, depth=4, l2=3.0, level=True),
]


@dataclass
class Ensemble:
    learner: Learner
    start: float  # log odds that boosting starts from
    trees: list[Tree] = field(default_factory=list)

    def margin(self, bins: np.ndarray) -> np.ndarray:
        total = sum((t.value[t.leaf(bins)] for t in self.trees), np.zeros(len(bins)))
        return self.start + total if self.learner.boosted else total / max(1, len(self.trees))

    def probability(self, bins: np.ndarray) -> np.ndarray:
        m = self.margin(bins)
        return 1 / (1 + np.exp(-m)) if self.learner.boosted else np.clip(m, 0, 1)

    def importance(self, features: int) -> np.ndarray:
        own = np.zeros(features)
        for t in self.trees:
            inner = t.feature >= 0
            np.add.at(own, t.feature[inner], t.gain[inner])
        return own / own.sum() if own.sum() > 0 else own


def draws(keys: np.ndarray, tree: int) -> np.ndarray:
    """How often each row is in a tree's sample: Poisson counts from a hash of the row's key."""
    with np.errstate(over="ignore"):
        z = keys.astype(np.uint64) + np.uint64(tree + 1) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
    below = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(8)])
    return np.searchsorted(below, (z >> np.uint64(11)).astype(np.float64) / 2.0**53, "right").astype(float)


def edges_of(rows: DataFrame, features: list[str]) -> list[np.ndarray]:
    """Inner bounds of each feature's bins."""
    at = F.array(*[F.lit(k / BINS) for k in range(1, BINS)])
    r = rows.agg(*[F.percentile_approx(f, at, 10_000).alias(f"q{k}") for k, f in enumerate(features)]).first()
    return [np.unique(np.array(r[f"q{k}"] or [], float)) for k in range(len(features))]


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, x[:, k], "left") for k, e in enumerate(edges)], 1).astype(np.uint8)


@dataclass
class _Growing:
    """A tree on its way: which ensemble, which nodes at the level, and the features that each looks at."""

    of: int
    number: int
    tree: Tree
    nodes: list[int]
    looks: dict[int, np.ndarray]
    sums: dict[int, tuple[float, float, float]] = field(default_factory=dict)


def _summed(data: DataFrame, ensembles: list[Ensemble], growing: list[_Growing]) -> dict[tuple[int, int, int], np.ndarray]:
    """(tree, node, feature) -> bins x (gradient, hessian, rows). ``data``: h long, y double, b binary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int, int], np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, y = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            bins = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(len(y), -1)
            margins: dict[int, np.ndarray] = {}
            for t, g in enumerate(growing):
                e = ensembles[g.of]
                if e.learner.boosted:
                    if g.of not in margins:
                        margins[g.of] = e.probability(bins)
                    p = margins[g.of]
                    grad, hess, n = p - y, p * (1 - p), np.ones(len(y))
                else:
                    n = draws(keys, g.number) if e.learner.drawn else np.ones(len(y))
                    grad, hess = -y * n, n
                leaf = g.tree.leaf(bins)
                for node in g.nodes:
                    own = np.flatnonzero(leaf == node)
                    if not len(own):
                        continue
                    for f in g.looks[node].tolist():
                        cells = np.stack([np.bincount(bins[own, f], v[own], BINS) for v in (grad, hess, n)], 1)
                        total[t, node, f] = total.get((t, node, f), 0) + cells
        seen = {key: np.flatnonzero(cells[:, 2]) for key, cells in total.items()}
        keys = np.repeat(np.array(list(seen), dtype=np.int32).reshape(-1, 3), [len(b) for b in seen.values()], axis=0)
        bins_ = np.concatenate([*seen.values(), np.zeros(0, int)]).astype(np.int32)
        values = np.concatenate([*[total[key][b] for key, b in seen.items()], np.zeros((0, 3))]).astype(float)
        yield pa.RecordBatch.from_arrays([*[pa.array(keys[:, k]) for k in range(3)], pa.array(bins_), *[pa.array(values[:, k]) for k in range(3)]], names=["t", "node", "f", "b", "g", "h", "n"])

    sums = data.select("h", "y", "b").mapInArrow(run, "t int, node int, f int, b int, g double, h double, n double")
    found = sums.groupBy("t", "node", "f", "b").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n")).toArrow()
    column = lambda k: found[k].to_numpy()
    keys, of = np.unique(np.stack([column(k) for k in ("t", "node", "f")], 1), axis=0, return_inverse=True)
    cells = np.zeros((len(keys), BINS, 3))
    cells[of.reshape(-1), column("b")] = np.stack([column(k) for k in ("g", "h", "n")], 1)
    return {tuple(key): cells[k] for k, key in enumerate(keys.tolist())}


def gains(cells: np.ndarray, l2: float) -> np.ndarray:
    """Gain of a cut after each bin; minus infinity where a side would be too small."""
    left = np.cumsum(cells, 0)
    right = left[-1] - left
    with np.errstate(divide="ignore", invalid="ignore"):
        score = lambda s: s[..., 0] ** 2 / (s[..., 1] + l2)
        g = score(left) + score(right) - score(left[-1])
    fit = (left[:, 2] >= LEAST_ROWS) & (right[:, 2] >= LEAST_ROWS) & (left[:, 1] + l2 > 1e-12) & (right[:, 1] + l2 > 1e-12)
    return np.where(fit, g, -np.inf)


def _split(e: Ensemble, g: _Growing, t: int, found: dict, seed: int) -> None:
    """Choose the splits of the level from the sums, and make the children."""
    lr = e.learner
    options: dict[int, dict[int, np.ndarray]] = {}
    for node in g.nodes:
        own = {f: found[t, node, f] for f in g.looks[node].tolist() if (t, node, f) in found}
        if own:
            total = next(iter(own.values())).sum(0)
            g.sums[node] = tuple(total)
            g.tree.rows[node] = total[2]
            g.tree.value[node] = -total[0] / (total[1] + lr.l2) * (lr.rate if lr.boosted else 1.0) if total[1] + lr.l2 > 0 else 0.0
        options[node] = {}
        for f, cells in own.items():
            gain = gains(cells, lr.l2)
            if lr.any_cut:
                seen = np.flatnonzero(cells[:, 2])
                if len(seen) < 2:
                    continue
                one = int(np.random.default_rng([seed, g.number, node, f]).integers(seen[0], seen[-1]))
                gain = np.where(np.arange(BINS) == one, gain, -np.inf)
            options[node][f] = gain
    chosen: list[tuple[float, int, int, int]] = []  # gain, node, feature, cut
    if lr.level:
        total = {}
        for node in g.nodes:
            for f, gain in options[node].items():
                total[f] = total.get(f, 0) + np.where(np.isfinite(gain), gain, 0)
        best = max(((float(v.max()), -f, -int(v.argmax())) for f, v in total.items()), default=(0.0, 0, 0))
        if best[0] > 1e-9:
            f, at = -best[1], -best[2]
            chosen = [(float(options[n][f][at]), n, f, at) for n in g.nodes if f in options[n] and np.isfinite(options[n][f][at])]
    else:
        for node in g.nodes:
            best = max(((float(v.max()), -f, -int(v.argmax())) for f, v in options[node].items()), default=(0.0, 0, 0))
            if best[0] > 1e-9:
                chosen.append((best[0], node, -best[1], -best[2]))
        leaves = int((np.array([g.tree.feature[(k - 1) // 2] if k else 0 for k in range(len(g.tree.feature))]) >= 0).sum() + 1) // 2
        chosen = sorted(chosen, key=lambda c: (-c[0], c[1]))[: max(0, lr.leaves - max(1, leaves))]
    g.nodes = []
    for gain, node, f, at in sorted(chosen, key=lambda c: c[1]):
        g.tree.feature[node], g.tree.cut[node], g.tree.gain[node] = f, at, max(gain, 0.0)
        left = found[t, node, f][: at + 1].sum(0)
        for child, s in ((2 * node + 1, left), (2 * node + 2, np.array(g.sums[node]) - left)):
            g.sums[child] = tuple(s)
            g.tree.rows[child] = s[2]
            g.tree.value[child] = -s[0] / (s[1] + lr.l2) * (lr.rate if lr.boosted else 1.0)
            g.nodes.append(child)


def grow(data: DataFrame, features: int, learners: list[Learner], seed: int = 42) -> list[Ensemble]:
    """Ensembles fitted on ``data`` (h long: a key of the row, y double 0 or 1, b binary: a byte a feature)."""
    mean = min(max(float(data.agg(F.avg("y")).first()[0]), 1e-6), 1 - 1e-6)
    ensembles = [Ensemble(lr, math.log(mean / (1 - mean)) if lr.boosted else 0.0) for lr in learners]
    few = max(1, round(math.sqrt(features)))

    def looked(lr: Learner, number: int, node: int) -> np.ndarray:
        return np.sort(np.random.default_rng([seed, number, node]).choice(features, few, replace=False)) if lr.some else np.arange(features)

    for turn in range(max(lr.trees if lr.boosted else 1 for lr in learners)):
        growing = []
        for k, lr in enumerate(learners):
            for number in range(turn, turn + 1) if lr.boosted and turn < lr.trees else range(lr.trees) if not lr.boosted and turn == 0 else ():
                growing.append(_Growing(k, number, Tree(lr.depth), [0], {}))
        for level in range(max((learners[g.of].depth for g in growing), default=0)):
            now = [g for g in growing if g.nodes and level < learners[g.of].depth]
            if not now:
                break
            for g in now:
                g.looks = {n: looked(learners[g.of], g.number, n) for n in g.nodes}
            found = _summed(data, ensembles, now)
            for t, g in enumerate(now):
                _split(ensembles[g.of], g, t, found, seed)
        for g in growing:
            ensembles[g.of].trees.append(g.tree)
    return ensembles


def _weights(k: int) -> np.ndarray:
    """Shapley weight of a subset of size s among k - 1 others."""
    return np.array([math.factorial(s) * math.factorial(k - 1 - s) / math.factorial(k) for s in range(k)])


def shapley(tree: Tree, bins: np.ndarray, features: int) -> np.ndarray:
    """Path-dependent Shapley values of one tree: rows x features. They add up to value minus the tree's mean over its rows."""
    out = np.zeros((len(bins), features))
    for leaf, above in tree.paths():
        goes: dict[int, np.ndarray] = {}
        share: dict[int, float] = {}
        for node, right in above:
            f = int(tree.feature[node])
            meets = (bins[:, f] > tree.cut[node]) == right
            goes[f] = goes[f] & meets if f in goes else meets
            child = 2 * node + 1 + right
            share[f] = share.get(f, 1.0) * (tree.rows[child] / tree.rows[node] if tree.rows[node] > 0 else 0.0)
        names = list(goes)
        k = len(names)
        if not k or tree.value[leaf] == 0:
            continue
        o = np.stack([goes[f] for f in names], 1).astype(float)
        z = np.array([share[f] for f in names])
        w = _weights(k)
        for i, f in enumerate(names):
            poly = np.zeros((len(bins), k))  # by size of the subset of the others that the row follows
            poly[:, 0] = 1.0
            for j in range(k):
                if j != i:
                    poly[:, 1:] = poly[:, 1:] * z[j] + poly[:, :-1] * o[:, j : j + 1]
                    poly[:, 0] *= z[j]
            out[:, f] += tree.value[leaf] * (o[:, i] - z[i]) * (poly @ w)
    return out


def ensemble_shapley(e: Ensemble, bins: np.ndarray, features: int) -> np.ndarray:
    total = sum((shapley(t, bins, features) for t in e.trees), np.zeros((len(bins), features)))
    return total if e.learner.boosted else total / max(1, len(e.trees))

"""Gradient-boosted trees: logistic loss, quantile bins, depth-limited trees.

``fit`` learns from arrays, ``fit_groups`` from a table of any size, many models at once: each level of a tree is one Spark
job that adds gradients per node, feature and bin, and only these sums, whose number is fixed, reach the driver.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Mapping
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowwatch.llm.common import written


class Tree(NamedTuple):
    """A complete tree as arrays by level order; a row goes right where ``x[feature] > cut``."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        for _ in range(int(np.log2(len(self.value)))):
            f = self.feature[at]
            at = 2 * at + 1 + (x[np.arange(len(x)), f] > self.cut[at])
        return self.value[at - len(self.feature)]


class Boosted(NamedTuple):
    prior: float
    trees: tuple[Tree, ...]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities."""
        z = np.full(len(x), self.prior)
        for t in self.trees:
            z += t.score(x)
        return 1 / (1 + np.exp(-z))


def _gain(g: float, h: float, n: int, gs: np.ndarray, hs: np.ndarray, ns: np.ndarray, ridge: float, least: int) -> np.ndarray:
    """What a split after each bin but the last gains, from a node's sums and its sums per bin."""
    gs, hs, ns = (s.cumsum()[:-1] for s in (gs, hs, ns))
    gain = gs ** 2 / (hs + ridge) + (g - gs) ** 2 / (h - hs + ridge) - g * g / (h + ridge)
    gain[(ns < least) | (n - ns < least)] = 0
    return gain


def _grow(x: np.ndarray, bins: np.ndarray, edges: list[np.ndarray], grad: np.ndarray, hess: np.ndarray, depth: int,
          shrink: float, ridge: float, least: int, columns: np.ndarray) -> tuple[Tree, np.ndarray]:
    inner = 2 ** depth - 1
    feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
    at = np.zeros(len(x), np.int64)
    for node in range(inner):
        rows = np.flatnonzero(at == node)
        if len(rows):
            g, h = grad[rows].sum(), hess[rows].sum()
            best = 1e-9
            for f, e in enumerate(edges):
                if not len(e) or not columns[f]:
                    continue
                gain = _gain(g, h, len(rows), *(np.bincount(bins[rows, f], w, len(e) + 1) for w in (grad[rows], hess[rows], None)),
                             ridge, least)
                if gain.max() > best:
                    best, feature[node], cut[node] = gain.max(), f, e[gain.argmax()]
        at[rows] = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
    leaf = at - inner
    value = shrink * np.bincount(leaf, grad, inner + 1) / (np.bincount(leaf, hess, inner + 1) + ridge)
    return Tree(feature, cut, value), value[leaf]


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 40, depth: int = 3, shrink: float = 0.2, ridge: float = 1.0,
        least: int = 3, n_bins: int = 32, columns: float = 1.0) -> Boosted:
    """``y`` holds 0 and 1, both of them. Each tree sees a share ``columns`` of the features, drawn anew, so that one feature
    that separates the rows alone doesn't keep the others out."""
    rng = np.random.default_rng(x.shape[1])
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, n_bins + 1)[1:-1], method="lower")) for f in range(x.shape[1])]
    edges = [e[e < x[:, f].max()] for f, e in enumerate(edges)]
    bins = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], 1)
    prior = float(np.log(y.mean() / (1 - y.mean())))
    z, trees = np.full(len(y), prior), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-z))
        tree, change = _grow(x, bins, edges, y - p, p * (1 - p), depth, shrink, ridge, least,
                             rng.random(x.shape[1]) < columns)
        trees.append(tree)
        z += change
    return Boosted(prior, tuple(trees))


#: Gradients are added as whole numbers of this part, so that their sums are the same in any order and partitioning.
_UNIT = float(1 << 24)
#: What ``fit_groups`` reads: ``x`` holds little-endian 16-bit numbers, ``n`` says how many rows are like this one.
FEATURES = np.dtype("<i2")


def features_of(part: pa.RecordBatch, kind: np.dtype, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(part.column("x").to_pylist()), kind).reshape(-1, width)


def _of_groups(part: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray]]:
    names = np.array(part.column("kind").to_pylist(), object)
    return ((name, np.flatnonzero(names == name)) for name in dict.fromkeys(names.tolist()))


def _value_counts(rows: DataFrame, width: int) -> dict[str, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """By group and feature: its values in order, how many rows have each, and how many of them are examples."""
    def run(batches):
        for part in batches:
            x, n = features_of(part, FEATURES, width), part.column("n").to_numpy()
            good = n * part.column("y").to_numpy(zero_copy_only=False)
            for name, mine in _of_groups(part):
                for f in range(width):
                    value, at = np.unique(x[mine, f], return_inverse=True)
                    yield pa.RecordBatch.from_pydict({
                        "kind": [name] * len(value), "feature": np.full(len(value), f, np.int32), "value": value.astype(np.int32),
                        "n": np.bincount(at, n[mine]).astype(np.int64), "good": np.bincount(at, good[mine]).astype(np.int64)})
    counted = rows.mapInArrow(run, "kind string, feature int, value int, n long, good long").groupBy(
        "kind", "feature", "value").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    found = defaultdict(lambda: [[] for _ in range(width)])
    for r in counted.orderBy("value").collect():
        found[r["kind"]][r["feature"]].append((r["value"], r["n"], r["good"]))
    return {name: [tuple(np.array(c) for c in zip(*of, strict=True)) for of in features] for name, features in found.items()}


def _edges(value: np.ndarray, n: np.ndarray, n_bins: int) -> np.ndarray:
    """The distinct lower quantiles of counted values, without the greatest value."""
    ranks = np.floor(np.linspace(0, 1, n_bins + 1)[1:-1] * (n.sum() - 1))
    e = np.unique(value[np.searchsorted(n.cumsum(), ranks, "right")])
    return e[e < value[-1]]


def _binned(rows: DataFrame, edges: Mapping[str, list[np.ndarray]], width: int) -> DataFrame:
    """The rows with a byte, its bin, for each feature; those that became equal are one."""
    def run(batches):
        for part in batches:
            x = features_of(part, FEATURES, width)
            bins = np.zeros(x.shape, np.uint8)
            for name, mine in _of_groups(part):
                for f, e in enumerate(edges[name]):
                    bins[mine, f] = np.searchsorted(e, x[mine, f], "left")
            yield pa.RecordBatch.from_pydict({
                "kind": part.column("kind"), "x": pa.array([b.tobytes() for b in bins], pa.binary()), "y": part.column("y"),
                "n": part.column("n")})
    out = rows.mapInArrow(run, "kind string, x binary, y boolean, n long").groupBy("kind", "x", "y").agg(F.sum("n").alias("n"))
    return written(out, "boosting-bins")


def _sums(rows: DataFrame, models: Mapping[str, Boosted], growing: Mapping[str, Tree], level: int, columns: np.ndarray,
          n_bins: int) -> dict[str, np.ndarray]:
    """By group: sums of gradient, curvature and rows per node of the level, feature and bin. The last feature, in its
    first bin, has the sums of the node. ``rows`` and trees speak of bins."""
    width, first = len(columns), 2 ** level - 1
    shape = (first + 1, width + 1, n_bins)

    def run(batches):
        total = {name: np.zeros((3, np.prod(shape)), np.int64) for name in models}
        for part in batches:
            x, n = features_of(part, np.dtype(np.uint8), width), part.column("n").to_numpy()
            y = part.column("y").to_numpy(zero_copy_only=False)
            for name, mine in _of_groups(part):
                bins, weight = x[mine], n[mine]
                p = models[name].score(bins)
                sums = [np.rint((y[mine] - p) * _UNIT) * weight, np.rint(p * (1 - p) * _UNIT) * weight, weight]
                at, tree = np.zeros(len(mine), np.int64), growing[name]
                for _ in range(level):
                    f = tree.feature[at]
                    at = 2 * at + 1 + (bins[np.arange(len(mine)), f] > tree.cut[at])
                for f in [*np.flatnonzero(columns), width]:
                    cell = ((at - first) * (width + 1) + f) * n_bins + (bins[:, f] if f < width else 0)
                    for i, s in enumerate(sums):
                        total[name][i] += np.bincount(cell, s, total[name].shape[1]).astype(np.int64)
        for name, (g, h, n) in total.items():
            cell = np.flatnonzero(n)
            yield pa.RecordBatch.from_pydict({"kind": pa.array([name] * len(cell), pa.string()), "cell": cell, "g": g[cell],
                                              "h": h[cell], "n": n[cell]})
    out = {name: np.zeros((3, np.prod(shape))) for name in models}
    for r in rows.mapInArrow(run, "kind string, cell long, g long, h long, n long").groupBy("kind", "cell").agg(
            *(F.sum(c).alias(c) for c in "ghn")).collect():
        out[r["kind"]][:, r["cell"]] = r["g"] / _UNIT, r["h"] / _UNIT, r["n"]
    return {name: s.reshape(3, *shape) for name, s in out.items()}


def fit_groups(rows: DataFrame, width: int, rounds: int = 40, depth: int = 3, shrink: float = 0.2, ridge: float = 1.0,
               least: int = 3, n_bins: int = 32, columns: float = 1.0) -> dict[str, Boosted]:
    """``fit`` for every group of a table ``kind string, x binary, y boolean, n long`` (see ``FEATURES``), from all its rows.
    Each group has examples and others. A feature's distinct values, at most 65,536, are counted on the driver."""
    rng = np.random.default_rng(width)
    counts = _value_counts(rows, width)
    if not counts:
        return {}
    edges = {name: [_edges(value, n, n_bins) for value, n, _ in of] for name, of in counts.items()}
    share = {name: of[0][2].sum() / of[0][1].sum() for name, of in counts.items()}
    models = {name: Boosted(float(np.log(s / (1 - s))), ()) for name, s in share.items()}  # cuts are numbers of bins
    bins, inner = _binned(rows, edges, width), 2 ** depth - 1
    for _ in range(rounds):
        seen = rng.random(width) < columns
        growing = {name: Tree(np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(inner + 1)) for name in models}
        for level in range(depth):
            for name, sums in _sums(bins, models, growing, level, seen, n_bins).items():
                tree = growing[name]
                for at in range(2 ** level):
                    node = 2 ** level - 1 + at
                    g, h, n = sums[:, at, width, 0]
                    best, left = 1e-9, sums[:, at, width, 0]
                    for f, e in enumerate(edges[name]):
                        if len(e) and seen[f]:
                            gs, hs, ns = sums[:, at, f, :len(e) + 1]
                            gain = _gain(g, h, n, gs, hs, ns, ridge, least)
                            if gain.max() > best:
                                best, tree.feature[node], tree.cut[node] = gain.max(), f, gain.argmax()
                                left = sums[:, at, f, :gain.argmax() + 1].sum(1)
                    if level == depth - 1:
                        for leaf, (lg, lh) in ((2 * at, left[:2]), (2 * at + 1, (g - left[0], h - left[1]))):
                            tree.value[leaf] = shrink * lg / (lh + ridge)
        models = {name: Boosted(m.prior, (*m.trees, growing[name])) for name, m in models.items()}
    return {name: Boosted(m.prior, tuple(
        Tree(t.feature, np.array([edges[name][f][int(c)] if np.isfinite(c) else np.inf for f, c in zip(t.feature, t.cut, strict=True)]),
             t.value) for t in m.trees)) for name, m in models.items()}

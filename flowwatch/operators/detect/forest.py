"""Isolation forest: one Spark task group per tree, scores in Arrow batches."""

from __future__ import annotations

import copy
import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowwatch.functions.exprs import q
from flowwatch.operators.detect.base import Detector, arrow_score, pack, unpack
from flowwatch.operators.order import hash_key, hash_take
from flowwatch.operators.quantile import exact_percentiles

_TREE = "tree int, node int, feature int, cut double, left int, right int, length double"


def expected_path(n: float) -> float:
    """Mean depth of an unsuccessful search in a random tree over ``n`` rows."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + 0.5772156649) - 2.0 * (n - 1.0) / n


def grow(tree: int, x: np.ndarray, features: np.ndarray, limit: int, rng: np.random.Generator) -> pd.DataFrame:
    """Random splits until rows are alone, equal, or the depth limit is reached."""
    nodes: list[list] = []
    open_ = [(0, np.arange(len(x)), 0)]
    nodes.append([tree, 0, -1, 0.0, -1, -1, 0.0])
    while open_:
        at, rows, depth = open_.pop()
        lo, hi = x[rows].min(axis=0), x[rows].max(axis=0)
        usable = [f for f in features if hi[f] > lo[f]]
        if depth >= limit or len(rows) <= 1 or not usable:
            nodes[at][6] = depth + expected_path(len(rows))
            continue
        f = int(rng.choice(usable))
        cut = float(rng.uniform(lo[f], hi[f]))
        goes = x[rows, f] <= cut
        left, right = len(nodes), len(nodes) + 1
        nodes[at][2:6] = [f, cut, left, right]
        for child, part in ((left, rows[goes]), (right, rows[~goes])):
            nodes.append([tree, child, -1, 0.0, -1, -1, 0.0])
            open_.append((child, part, depth + 1))
    return pd.DataFrame(nodes, columns=[c.split()[0] for c in _TREE.split(", ")])


def _depth(inner: np.ndarray, child: np.ndarray) -> int:
    """Steps from the root to the deepest leaf."""
    depth, at = 0, np.zeros(1, dtype=int)
    while len(at := at[inner[at]]):
        at, depth = np.concatenate([child[2 * at], child[2 * at + 1]]), depth + 1
    return depth


class IsolationForest(Detector):
    """Score = ``2^(-E[h]/c)`` minus the contamination offset; flagged above 0."""

    kind = "isolation_forest"
    cut_param = "contamination"

    def __init__(self, trees: int = 50, contamination: float = 0.15, max_features: float = 0.5,
                 sample: int = 256, seed: int = 42, id_col: str = "row_id") -> None:
        super().__init__()
        self.trees, self.contamination, self.max_features = trees, contamination, max_features
        self.sample, self.seed, self.id_col = sample, seed, id_col

    def fit(self, benign: DataFrame, cols: Sequence[str]) -> IsolationForest:
        self.offset = self.fit_cuts(benign, cols, [self.contamination])[0].offset
        return self

    def fit_cuts(self, benign: DataFrame, cols: Sequence[str], shares: Sequence[float]) -> list[IsolationForest]:
        """The same trees with the offset of each contamination; the benign rows are scored once."""
        self._grow(benign, cols)
        offsets = exact_percentiles(self.raw_score(benign), ["score"], [1.0 - s for s in shares])["score"]
        models = []
        for share, offset in zip(shares, offsets, strict=True):
            models.append(copy.copy(self))
            models[-1].contamination, models[-1].offset = share, offset
        return models

    def raw_score(self, df: DataFrame, out: str = "score") -> DataFrame:
        bare = copy.copy(self)
        bare.offset = 0.0
        return bare.score(df, out)

    def from_raw(self, raw: Column) -> Column:
        return raw - F.lit(float(self.offset))

    def _grow(self, benign: DataFrame, cols: Sequence[str]) -> None:
        self.cols = list(cols)
        rows = benign.select(self.id_col, *[q(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)]).dropna()
        pool = hash_take(rows, self.trees * self.sample, self.id_col, self.seed).persist()
        n = pool.count()
        if n >= self.trees * self.sample:
            # Enough rows: disjoint samples, dealt out by the hash rank of this bounded pool.
            rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(hash_key(self.id_col, self.seed)))
            dealt = pool.withColumn("tree", ((rank - 1) % self.trees).cast("int"))
        else:
            each = pool.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(self.trees - 1))))
            key = F.md5(F.concat(F.lit(f"{self.seed}:"), F.col("tree").cast("string"), F.lit(":"),
                                 F.col(self.id_col).cast("string")))
            rank = F.row_number().over(Window.partitionBy("tree").orderBy(key))
            dealt = each.withColumn("_rn", rank).filter(F.col("_rn") <= self.sample)
        self.used = min(self.sample, n)
        limit = max(1, math.ceil(math.log2(max(self.used, 2))))
        d, seed, share = len(cols), self.seed, self.max_features

        def build(pdf: pd.DataFrame) -> pd.DataFrame:
            tree = int(pdf["tree"].iloc[0])
            rng = np.random.default_rng([seed, tree])
            chosen = rng.choice(d, size=max(1, int(share * d)), replace=False)
            ordered = pdf.sort_values([f"c{i}" for i in range(d)])
            return grow(tree, ordered[[f"c{i}" for i in range(d)]].to_numpy(dtype=float), chosen, limit, rng)

        needed = dealt.select("tree", *[f"c{i}" for i in range(d)])
        nodes = needed.groupBy("tree").applyInPandas(build, _TREE).toPandas().sort_values(["tree", "node"])
        pool.unpersist()
        self.nodes = nodes.to_numpy(dtype=float)
        self.threshold = self.offset = 0.0

    def scorer(self):
        self.check()
        scale, offset = expected_path(self.used) or 1.0, self.offset
        forest = []
        for t in np.unique(self.nodes[:, 0]):
            part = self.nodes[self.nodes[:, 0] == t]
            feature, own = part[:, 2].astype(int), np.arange(len(part))
            inner = feature >= 0  # a leaf leads to itself
            child = np.where(inner[:, None], part[:, 4:6].astype(int), own[:, None]).ravel()
            forest.append((np.maximum(feature, 0), part[:, 3], child, part[:, 6], _depth(inner, child)))

        def run(x: np.ndarray) -> np.ndarray:
            total = np.zeros(len(x))
            flat, row = np.ascontiguousarray(x).ravel(), np.arange(len(x)) * x.shape[1]
            for feature, cut, child, length, depth in forest:
                at = np.zeros(len(x), dtype=int)
                for _ in range(depth):
                    at = child[2 * at + ~(flat[row + feature[at]] <= cut[at])]  # NaN goes right
                total += length[at]
            return np.power(2.0, -total / len(forest) / scale) - offset

        return run

    def score(self, df: DataFrame, out: str = "score") -> DataFrame:
        return arrow_score(df, self.cols, self.scorer(), out)

    def rows(self):
        return [("", "offset", 0, self.offset), ("", "used", 0, self.used)] + pack("nodes", self.nodes)

    def restore(self, rows) -> None:
        self.offset = next(v for _, s, _, v in rows if s == "offset")
        self.used = int(next(v for _, s, _, v in rows if s == "used"))
        self.nodes = unpack("nodes", rows)

"""Detectors whose score is one expression: z-score, Mahalanobis, distance to the centre."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowwatch.functions.exprs import q
from flowwatch.operators.detect.base import Detector, pack, unpack
from flowwatch.operators.dist import mahalanobis_distance, robust_covariance
from flowwatch.operators.moments import moments
from flowwatch.operators.quantile import exact_percentiles


class ZScoreMax(Detector):
    """Largest absolute z-score over the features; a fixed cut ``T``."""

    kind = "zscore_max"
    strict = False

    def __init__(self, cut: float = 3.0) -> None:
        super().__init__()
        self.cut = cut

    def fit(self, benign: DataFrame, cols: Sequence[str]) -> ZScoreMax:
        self.cols = list(cols)
        row = benign.agg(*[F.avg(q(c)).alias(f"m{i}") for i, c in enumerate(cols)],
                         *[F.stddev_pop(q(c)).alias(f"s{i}") for i, c in enumerate(cols)]).first()
        self.mean = np.array([row[f"m{i}"] for i in range(len(cols))], dtype=float)
        self.dev = np.array([row[f"s{i}"] for i in range(len(cols))], dtype=float)
        self.threshold = self.cut
        return self

    def score(self, df: DataFrame, out: str = "score") -> DataFrame:
        self.check()
        z = [F.abs((q(c) - float(m)) / F.lit(float(s) + 1e-12)) for c, m, s in zip(self.cols, self.mean, self.dev)]
        return df.withColumn(out, F.greatest(*z) if len(z) > 1 else z[0])

    def rows(self):
        return pack("mean", self.mean) + pack("dev", self.dev)

    def restore(self, rows) -> None:
        self.mean, self.dev = unpack("mean", rows), unpack("dev", rows)


class MahalanobisDetector(Detector):
    """Distance from the benign centre; the cut is a benign percentile."""

    kind = "mahalanobis"

    def __init__(self, robust: bool = False, percentile: float = 95.0, support: float = 0.9) -> None:
        super().__init__()
        self.robust, self.percentile, self.support = robust, percentile, support

    def fit(self, benign: DataFrame, cols: Sequence[str]) -> MahalanobisDetector:
        self.cols = list(cols)
        if self.robust:
            self.centre, self.sigma = robust_covariance(benign, cols, self.support)
        else:
            _, self.centre, self.sigma = moments(benign, cols)
        self.threshold = 0.0
        scored = self.score(benign)
        self.threshold = exact_percentiles(scored, ["score"], [self.percentile / 100.0])["score"][0]
        return self

    def score(self, df: DataFrame, out: str = "score") -> DataFrame:
        self.check()
        return mahalanobis_distance(df, df, self.cols, out, (self.centre, self.sigma))

    def rows(self):
        return pack("centre", self.centre) + pack("sigma", self.sigma)

    def restore(self, rows) -> None:
        self.centre, self.sigma = unpack("centre", rows), unpack("sigma", rows)


class CenterDistance(Detector):
    """Squared distance of an embedding to the benign centre; 95th percentile cut."""

    kind = "center_distance"

    def __init__(self, percentile: float = 95.0) -> None:
        super().__init__()
        self.percentile = percentile

    def fit(self, benign: DataFrame, cols: Sequence[str]) -> CenterDistance:
        self.cols = list(cols)
        row = benign.agg(*[F.avg(q(c)).alias(f"m{i}") for i, c in enumerate(cols)]).first()
        self.centre = np.array([row[f"m{i}"] for i in range(len(cols))], dtype=float)
        self.threshold = 0.0
        scored = self.score(benign)
        self.threshold = exact_percentiles(scored, ["score"], [self.percentile / 100.0])["score"][0]
        return self

    def score(self, df: DataFrame, out: str = "score") -> DataFrame:
        self.check()
        total = F.lit(0.0)
        for c, m in zip(self.cols, self.centre):
            total = total + (q(c) - float(m)) * (q(c) - float(m))
        return df.withColumn(out, total)

    def rows(self):
        return pack("centre", self.centre)

    def restore(self, rows) -> None:
        self.centre = unpack("centre", rows)

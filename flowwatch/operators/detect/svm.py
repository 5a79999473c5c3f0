"""One-class SVM with an RBF kernel, by random Fourier features and Frank-Wolfe steps."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowwatch.functions.exprs import q
from flowwatch.operators.detect.base import Detector, arrow_score, pack, unpack
from flowwatch.operators.order import hash_take
from flowwatch.operators.quantile import exact_percentiles


class OneClassSvm(Detector):
    """Score = ``rho - w . z(x)``; flagged above 0.

    The dual puts weight at most ``1/(nu n)`` on each row. The best direction of
    a step is therefore the mean of the ``nu`` share of rows with the lowest
    ``w . z``: one exact percentile and one partial-sum pass per step.
    """

    kind = "one_class_svm"

    def __init__(self, nu: float = 0.2, gamma: float = 0.1, cap: int | None = None, features: int = 128,
                 steps: int = 12, seed: int = 42, id_col: str = "row_id") -> None:
        super().__init__()
        self.nu, self.gamma, self.cap, self.features = nu, gamma, cap, features
        self.steps, self.seed, self.id_col = steps, seed, id_col

    def _lift(self):
        freq, phase = self.freq, self.phase
        scale = math.sqrt(2.0 / len(phase))
        return lambda x: scale * np.cos(x @ freq + phase)

    def fit(self, benign: DataFrame, cols: Sequence[str]) -> OneClassSvm:
        self.cols = list(cols)
        rows = benign.select(self.id_col, *[q(c).cast("double").alias(c) for c in cols]).dropna()
        if self.cap is not None:
            rows = hash_take(rows, self.cap, self.id_col, self.seed)
        rows = rows.persist()
        rng = np.random.default_rng(self.seed)
        self.freq = rng.normal(0.0, math.sqrt(2.0 * self.gamma), (len(cols), self.features))
        self.phase = rng.uniform(0.0, 2.0 * math.pi, self.features)
        lift = self._lift()
        w: np.ndarray | None = None
        cut = math.inf
        try:
            for t in range(self.steps):
                if w is not None:
                    cut = self._percentile(rows, w, lift)
                now, edge = w, cut

                def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                    total = np.zeros(len(self_phase) + 1)
                    for pdf in batches:
                        z = lift(pdf.to_numpy(dtype=float))
                        if now is not None:
                            z = z[z @ now <= edge]
                        total[:-1] += z.sum(axis=0)
                        total[-1] += len(z)
                    yield pd.DataFrame({"i": np.arange(len(total)), "v": total})

                self_phase = self.phase
                got = rows.select(*[q(c) for c in cols]).mapInPandas(partial, "i int, v double")
                total = np.zeros(self.features + 1)
                for r in got.groupBy("i").agg(F.sum("v").alias("v")).collect():
                    total[r["i"]] = r["v"]
                mean = total[:-1] / max(total[-1], 1.0)
                w = mean if w is None else w + (2.0 / (t + 2.0)) * (mean - w)
            self.w = w
            self.rho = self._percentile(rows, w, lift)
        finally:
            rows.unpersist()
        self.threshold = 0.0
        return self

    def _percentile(self, rows: DataFrame, w: np.ndarray, lift) -> float:
        projected = arrow_score(rows, self.cols, lambda x: lift(x) @ w, "_p")
        return exact_percentiles(projected, ["_p"], [self.nu])["_p"][0]

    def scorer(self):
        self.check()
        lift, w, rho = self._lift(), self.w, self.rho
        return lambda x: rho - lift(x) @ w

    def score(self, df: DataFrame, out: str = "score") -> DataFrame:
        return arrow_score(df, self.cols, self.scorer(), out)

    def rows(self):
        return [("", "rho", 0, self.rho)] + pack("w", self.w) + pack("freq", self.freq) + pack("phase", self.phase)

    def restore(self, rows) -> None:
        self.rho = next(v for _, s, _, v in rows if s == "rho")
        self.w, self.freq, self.phase = (unpack(s, rows) for s in ("w", "freq", "phase"))

"""Reconstruction scores of row windows: a linear autoencoder (PCA of window vectors)."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowwatch.functions.exprs import q
from flowwatch.operators import sequence
from flowwatch.operators.detect.base import Detector, arrow_score, pack, unpack
from flowwatch.operators.moments import array_pca
from flowwatch.operators.order import dense_index
from flowwatch.operators.quantile import exact_percentiles


def flattened(windows: DataFrame) -> DataFrame:
    return windows.select("window_id", F.flatten(F.transform("steps", lambda s: s["x"])).alias("flat"))


class WindowReconstruction(Detector):
    """Window score = mean squared error; step error = mean over features."""

    kind = "window_reconstruction"

    def __init__(self, size: int = 50, latent: int = 32, percentile: float = 95.0) -> None:
        super().__init__()
        self.size, self.latent, self.percentile = size, latent, percentile
        self.row_threshold: float | None = None

    def fit(self, windows: DataFrame, cols: Sequence[str]) -> WindowReconstruction:
        self.cols = list(cols)
        flat = flattened(windows).persist()
        try:
            model = array_pca(flat, "flat", min(self.latent, self.size * len(cols)))
        finally:
            flat.unpersist()
        self.mean, self.parts = model.mean, model.parts
        self.threshold = 0.0
        scored = self.score(windows)
        self.threshold = exact_percentiles(scored, ["score"], [self.percentile / 100.0])["score"][0]
        return self

    def given(self, cols: Sequence[str], mean: np.ndarray, parts: np.ndarray, threshold: float) -> WindowReconstruction:
        """A model with known mean and components (one column each)."""
        self.cols, self.mean, self.parts, self.threshold = list(cols), np.asarray(mean), np.asarray(parts), threshold
        return self

    def errors_of(self) -> Callable[[np.ndarray], np.ndarray]:
        """Flat windows to one error per step: the part that the components leave, averaged over features."""
        self.check()
        mean, parts, size, d = self.mean, self.parts, self.size, len(self.cols)

        def errors(flat: np.ndarray) -> np.ndarray:
            x = flat - mean
            rest = x - (x @ parts) @ parts.T
            return (rest ** 2).reshape(len(x), size, d).mean(axis=2)
        return errors

    def step_errors(self, windows: DataFrame) -> DataFrame:
        """``(window_id, errors)``: one error per step of each window."""
        errors, width = self.errors_of(), self.size * len(self.cols)

        @F.pandas_udf("array<double>")
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for flat in batches:
                yield pd.Series(list(errors(np.stack(flat.to_numpy()) if len(flat) else np.zeros((0, width)))))

        return flattened(windows).select("window_id", run("flat").alias("errors"))

    def score(self, windows: DataFrame, out: str = "score") -> DataFrame:
        errors = self.step_errors(windows)
        total = F.aggregate("errors", F.lit(0.0), lambda a, e: a + e)
        return errors.select("window_id", (total / float(self.size)).alias(out))

    def score_flows(self, df: DataFrame, stride: int, order_col: str, tie_col: str, out: str = "score",
                    row_scores: Mapping[str, Callable[[np.ndarray], np.ndarray]] | None = None) -> DataFrame:
        """Mean step error per row over the windows that cover it, beside scores of the row alone (``row_scores``).

        All come from one index and one pass. Fewer rows than one window make one window padded with zero rows.
        """
        indexed, n = dense_index(df, order_col, tie_col)
        if n >= self.size:
            return sequence.score_ranges(indexed, n, self.cols, self.size, stride, self.errors_of(), out, row_scores)
        windows = sequence.padded_window(indexed, n, self.cols, self.size)
        scored = sequence.scatter_to_rows(self.step_errors(windows), indexed, n, self.size, stride, "errors", out)
        for name, scorer in (row_scores or {}).items():
            scored = arrow_score(scored, self.cols, scorer, name)
        return scored

    def calibrate_flows(self, benign: DataFrame, stride: int, order_col: str, tie_col: str) -> float:
        """Row threshold: the same percentile of benign row scores."""
        needed = benign.select(*[q(c) for c in dict.fromkeys([order_col, tie_col, *self.cols])])
        scored = self.score_flows(needed, stride, order_col, tie_col)
        self.row_threshold = exact_percentiles(scored, ["score"], [self.percentile / 100.0])["score"][0]
        return self.row_threshold

    def rows(self):
        own = [("", "size", 0, self.size), ("", "percentile", 0, self.percentile), ("", "latent", 0, self.latent),
               ("", "row_threshold", 0, self.row_threshold)]
        return own + pack("mean", self.mean) + pack("parts", self.parts)

    def restore(self, rows) -> None:
        for _, stat, _, value in rows:
            if stat in ("size", "latent"):
                setattr(self, stat, int(value))
            elif stat in ("percentile", "row_threshold"):
                setattr(self, stat, value)
        self.mean, self.parts = unpack("mean", rows), unpack("parts", rows)

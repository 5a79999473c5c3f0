"""A mixture over rows, reconstruction over row windows, and their fusion, as one detector."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from flowwatch.operators import fuse
from flowwatch.operators.detect.base import Detector
from flowwatch.operators.detect.mixture import GaussianMixtureDetector
from flowwatch.operators.detect.windows import WindowReconstruction
from flowwatch.sources import params

BASES = ["gmm", "window"]


class HybridDetector(Detector):
    """Adds ``gmm`` and ``window`` scores from one row index, and their fused ``score``.

    Rows are ordered by ``order_col`` and the unique ``tie_col``; windows start every ``stride`` rows. Both models read the
    same columns, so both scores come from the same pass over index blocks. Flagged from the fusion threshold on.
    """

    kind = "hybrid"
    strict = False

    def __init__(self, mixture: GaussianMixtureDetector | None = None, windows: WindowReconstruction | None = None,
                 fusion: fuse.FusionModel | None = None, order_col: str = "", tie_col: str = "", stride: int = 1) -> None:
        super().__init__()
        self.mixture, self.windows, self.fusion = mixture, windows, fusion
        self.order_col, self.tie_col, self.stride = order_col, tie_col, stride
        if windows is not None:
            if list(windows.cols) != list(mixture.cols):
                raise ValueError("mixture and windows must read the same columns")
            self.cols = list(windows.cols)
        self.threshold = None if fusion is None else fusion.threshold

    def bases(self, df: DataFrame) -> DataFrame:
        """The rows with their index and both base scores."""
        return self.windows.score_flows(df, self.stride, self.order_col, self.tie_col, "window",
                                        {"gmm": self.mixture.scorer()})

    def fit_fusion(self, labelled: DataFrame, y: str = "y", candidates: Sequence[str] = ("rf", "lr", "weighted"),
                   **options) -> DataFrame:
        """Fit the fusion on rows that have both base scores; returns the candidates' table."""
        self.fusion, table = fuse.FusionModel.fit(labelled, BASES, self.tie_col, y, candidates, **options)
        self.threshold = self.fusion.threshold
        return table

    def score(self, df: DataFrame, out: str = "score") -> DataFrame:
        self.check()
        scored = df if set(BASES) <= set(df.columns) else self.bases(df).drop("idx")
        return self.fusion.score(scored, out).drop(*[f"calibrated_{b}" for b in BASES])

    def check(self) -> None:
        if self.mixture is None or self.windows is None or self.fusion is None:
            raise RuntimeError("the hybrid detector is not fitted")

    def save(self, spark: SparkSession, path: str) -> None:
        self.check()
        params.save_params(spark, f"{path}/hybrid", self.kind, [
            (self.order_col, "order_col", 0, None), (self.tie_col, "tie_col", 0, None), ("", "stride", 0, self.stride)])
        self.mixture.save(spark, f"{path}/gmm")
        self.windows.save(spark, f"{path}/window")
        self.fusion.save(spark, f"{path}/fusion")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> HybridDetector:
        own = {stat: (feature, value) for feature, stat, _, value in params.load_params(spark, f"{path}/hybrid", cls.kind)}
        return cls(GaussianMixtureDetector.load(spark, f"{path}/gmm"), WindowReconstruction.load(spark, f"{path}/window"),
                   fuse.FusionModel.load(spark, f"{path}/fusion"), own["order_col"][0], own["tie_col"][0],
                   int(own["stride"][1]))

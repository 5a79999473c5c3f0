"""The detector contract and Arrow-batched scoring."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowwatch.functions.exprs import q
from flowwatch.operators.metrics import classification_metrics
from flowwatch.sources import params

Scorer = Callable[[np.ndarray], np.ndarray]


def arrow_score(df: DataFrame, cols: Sequence[str], scorer: Scorer, out: str = "score") -> DataFrame:
    """Adds ``scorer(matrix)`` of the given columns, one Arrow batch at a time."""

    @F.pandas_udf("double")
    def run(first: pd.Series, *rest: pd.Series) -> pd.Series:
        matrix = np.column_stack([s.to_numpy(dtype=float) for s in (first, *rest)])
        return pd.Series(np.asarray(scorer(matrix), dtype=float))

    return df.withColumn(out, run(*[q(c).cast("double") for c in cols]))


class Detector:
    """``fit`` sees benign rows only; ``score`` adds a column; ``predict`` adds 0/1."""

    kind = "detector"
    strict = True
    #: A parameter that only moves the cut. With one, ``fit_cuts`` fits once for many of its values, ``raw_score`` adds what
    #: these models share as a column, and ``from_raw`` makes a model's own score of it.
    cut_param: str | None = None

    def __init__(self) -> None:
        self.cols: list[str] = []
        self.threshold: float | None = None

    def fit(self, benign: DataFrame, cols: Sequence[str]) -> Detector:
        raise NotImplementedError

    def score(self, df: DataFrame, out: str = "score") -> DataFrame:
        raise NotImplementedError

    def predict(self, df: DataFrame, out: str = "pred") -> DataFrame:
        self.check()
        scored = df if "score" in df.columns else self.score(df)
        s = q("score")
        hit = s > self.threshold if self.strict else s >= self.threshold
        return scored.withColumn(out, F.when(hit, 1).otherwise(0))

    def evaluate(self, df: DataFrame, y: str = "y") -> DataFrame:
        return classification_metrics(self.predict(self.score(df)), y, "pred", "score")

    def check(self) -> None:
        if self.threshold is None:
            raise RuntimeError(f"{self.kind} is not fitted")

    # Parameters as (feature, stat, pos, value) rows.
    def rows(self) -> list[tuple[str, str, int, float | None]]:
        raise NotImplementedError

    def restore(self, rows: list[tuple[str, str, int, float | None]]) -> None:
        raise NotImplementedError

    def save(self, spark: SparkSession, path: str) -> None:
        self.check()
        base = [("", "threshold", 0, self.threshold)] + [(c, "column", i, None) for i, c in enumerate(self.cols)]
        params.save_params(spark, path, self.kind, base + self.rows())

    @classmethod
    def load(cls, spark: SparkSession, path: str):
        rows = params.load_params(spark, path, cls.kind)
        out = cls()
        for feature, stat, _, value in rows:
            if stat == "threshold":
                out.threshold = value
            elif stat == "column":
                out.cols.append(feature)
        out.restore(rows)
        return out


def pack(stat: str, values: np.ndarray) -> list[tuple[str, str, int, float]]:
    """A flattened array as parameter rows, its shape first."""
    values = np.asarray(values, dtype=float)
    shape = [("", f"{stat}.shape", i, float(s)) for i, s in enumerate(values.shape)]
    return shape + [("", stat, i, float(v)) for i, v in enumerate(values.ravel())]


def unpack(stat: str, rows) -> np.ndarray:
    shape = [int(v) for _, s, _, v in sorted((r for r in rows if r[1] == f"{stat}.shape"), key=lambda r: r[2])]
    flat = [v for _, s, _, v in sorted((r for r in rows if r[1] == stat), key=lambda r: r[2])]
    return np.array(flat, dtype=float).reshape(shape)

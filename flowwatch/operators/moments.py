"""Mean vector and covariance matrix from one aggregate."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowwatch.functions.exprs import q


def moments(df: DataFrame, cols: Sequence[str], ddof: int = 0) -> tuple[int, np.ndarray, np.ndarray]:
    """Row count, mean vector and covariance of complete rows, from one aggregate."""
    complete = df.select(*[q(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)]).dropna()
    cov = F.covar_samp if ddof else F.covar_pop
    d = len(cols)
    row = complete.agg(F.count(F.lit(1)).alias("n"), *[F.avg(f"c{i}").alias(f"m{i}") for i in range(d)],
                       *[cov(f"c{i}", f"c{j}").alias(f"v{i}_{j}") for i in range(d) for j in range(i, d)]).first()
    sigma = np.zeros((d, d))
    for i in range(d):
        for j in range(i, d):
            sigma[i, j] = sigma[j, i] = row[f"v{i}_{j}"] or 0.0
    return row["n"], np.array([row[f"m{i}"] or 0.0 for i in range(d)]), sigma


@dataclass
class Pca:
    """Mean, components (one per column, strongest first) and explained shares."""

    mean: np.ndarray
    parts: np.ndarray
    shares: np.ndarray


def array_pca(df: DataFrame, col: str, k: int) -> Pca:
    """PCA of an array column: the centred Gram matrix is summed on Spark, d x d is solved here.

    Each task adds its rows into one matrix and emits its d rows; vector sums
    per matrix row merge the tasks, so neither rows nor row pairs are collected.
    """
    vectors = df.select(F.col(col).alias("x"))
    mean = vectors.select(Summarizer.mean(array_to_vector("x")).alias("m")).first()["m"].toArray()
    d = len(mean)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gram = np.zeros((d, d))
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf["x"].to_numpy()) - mean
                gram += x.T @ x
        yield pd.DataFrame({"i": np.arange(d), "row": list(gram)})

    rows = vectors.mapInPandas(partial, "i int, row array<double>").groupBy("i").agg(
        Summarizer.sum(array_to_vector("row")).alias("row")).collect()
    gram = np.zeros((d, d))
    for r in rows:
        gram[r["i"]] = r["row"].toArray()
    values, parts = np.linalg.eigh((gram + gram.T) / 2.0)
    values, parts = np.maximum(values[::-1], 0.0), parts[:, ::-1]
    # A component's sign is free: its largest loading is made positive.
    parts = parts * np.where(parts[np.abs(parts).argmax(axis=0), np.arange(d)] < 0, -1.0, 1.0)
    return Pca(mean, parts[:, :k], (values / (values.sum() or 1.0))[:k])

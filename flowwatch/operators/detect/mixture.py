"""Gaussian mixtures: EM on Spark aggregates, log-density scores, model selection."""

from __future__ import annotations

import math
import time
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.clustering import GaussianMixture
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowwatch.functions.exprs import q
from flowwatch.operators.detect.base import Detector, arrow_score, pack, unpack
from flowwatch.operators.dist import assemble
from flowwatch.operators.metrics import classification_metrics
from flowwatch.operators.order import hash_key, hash_take
from flowwatch.operators.quantile import exact_percentiles

COVARIANCE_TYPES = ("full", "tied", "diag", "spherical")
_RIDGE = 1e-6


def component_log_density(x: np.ndarray, weights: np.ndarray, means: np.ndarray,
                          covs: np.ndarray) -> np.ndarray:
    """``log(w_k N(x; m_k, S_k))`` per row and component."""
    n, d = x.shape
    out = np.empty((n, len(weights)))
    for k, (w, m, s) in enumerate(zip(weights, means, covs)):
        root = np.linalg.cholesky(s)
        z = np.linalg.solve(root, (x - m).T)
        logdet = 2.0 * np.log(np.diag(root)).sum()
        out[:, k] = math.log(max(w, 1e-300)) - 0.5 * (d * math.log(2.0 * math.pi) + logdet + (z * z).sum(axis=0))
    return out


def log_density(x: np.ndarray, weights: np.ndarray, means: np.ndarray, covs: np.ndarray) -> np.ndarray:
    parts = component_log_density(x, weights, means, covs)
    top = parts.max(axis=1)
    return top + np.log(np.exp(parts - top[:, None]).sum(axis=1))


def free_parameters(k: int, d: int, cov: str) -> int:
    shape = {"full": k * d * (d + 1) // 2, "tied": d * (d + 1) // 2, "diag": k * d, "spherical": k}[cov]
    return shape + k * d + k - 1


def _safe(cov: np.ndarray) -> np.ndarray:
    """Symmetric and positive definite, by the smallest ridge that is enough."""
    cov = (cov + np.swapaxes(cov, -1, -2)) / 2.0
    eye = np.eye(cov.shape[-1])
    fixed = []
    for s in cov:
        ridge = 0.0
        while True:
            try:
                np.linalg.cholesky(s + ridge * eye)
                break
            except np.linalg.LinAlgError:
                ridge = max(ridge * 10.0, _RIDGE)
        fixed.append(s + ridge * eye)
    return np.array(fixed)


def em_fit(rows: DataFrame, cols: Sequence[str], k: int, cov: str, seed: int, id_col: str,
           max_iter: int = 100, tol: float = 1e-3):
    """EM for tied, diagonal and spherical mixtures.

    Each step sends the current parameters out and adds responsibilities and
    moments per partition: one row per statistic and partition comes back.
    """
    d = len(cols)
    start = rows.orderBy(hash_key(id_col, seed)).limit(k).select(*[q(c) for c in cols]).collect()
    means = np.array([[float(v) for v in r] for r in start])
    spread = rows.agg(*[F.var_pop(q(c)).alias(f"v{i}") for i, c in enumerate(cols)]).first()
    base = np.diag([max(float(spread[f"v{i}"] or 0.0), _RIDGE) for i in range(d)])
    weights, covs = np.full(k, 1.0 / k), np.repeat(base[None], k, axis=0)
    size, last = k * (1 + 2 * d), -math.inf
    n = ll = 0.0
    for _ in range(max_iter):
        state = (weights, means, covs)

        def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            sums = np.zeros(size + 2)
            gram = np.zeros((d, d))
            for pdf in batches:
                x = pdf.to_numpy(dtype=float)
                parts = component_log_density(x, *state)
                top = parts.max(axis=1, keepdims=True)
                like = top[:, 0] + np.log(np.exp(parts - top).sum(axis=1))
                r = np.exp(parts - like[:, None])
                sums[:k] += r.sum(axis=0)
                sums[k:k + k * d] += (r.T @ x).ravel()
                sums[k + k * d:size] += (r.T @ (x * x)).ravel()
                sums[size] += like.sum()
                sums[size + 1] += len(x)
                gram += x.T @ x
            values = np.concatenate([sums, gram.ravel()])
            yield pd.DataFrame({"i": np.arange(len(values)), "v": values})

        got = rows.select(*[q(c).cast("double") for c in cols]).mapInPandas(partial, "i int, v double")
        total = np.zeros(size + 2 + d * d)
        for r in got.groupBy("i").agg(F.sum("v").alias("v")).collect():
            total[r["i"]] = r["v"]
        nk = np.maximum(total[:k], 1e-10)
        sx, sxx = total[k:k + k * d].reshape(k, d), total[k + k * d:size].reshape(k, d)
        ll, n = total[size], total[size + 1]
        gram = total[size + 2:].reshape(d, d)
        if ll / n - last < tol and math.isfinite(last):
            break
        last = ll / n
        weights, means = nk / nk.sum(), sx / nk[:, None]
        var = np.maximum(sxx / nk[:, None] - means ** 2, 0.0) + _RIDGE
        if cov == "diag":
            covs = np.array([np.diag(v) for v in var])
        elif cov == "spherical":
            covs = np.array([np.eye(d) * v.mean() for v in var])
        else:
            pooled = (gram - (means * nk[:, None]).T @ means) / n
            covs = np.repeat(_safe((pooled + _RIDGE * np.eye(d))[None]), k, axis=0)
    return weights, means, covs, float(ll), int(n)


class GaussianMixtureDetector(Detector):
    """Score = ``-log p(x)``; flagged when strictly above the benign percentile cut."""

    kind = "gmm"

    def __init__(self, k: int = 12, cov: str = "full", percentile: float = 11.0, n_init: int = 3,
                 max_iter: int = 200, cap: int | None = None, seed: int = 42, id_col: str = "row_id") -> None:
        super().__init__()
        if cov not in COVARIANCE_TYPES:
            raise ValueError(f"cov must be one of {COVARIANCE_TYPES}")
        self.k, self.cov, self.percentile, self.n_init = k, cov, percentile, n_init
        self.max_iter, self.cap, self.seed, self.id_col = max_iter, cap, seed, id_col
        self.log_likelihood, self.n_fit = float("nan"), 0

    def fit(self, benign: DataFrame, cols: Sequence[str]) -> GaussianMixtureDetector:
        self.cols = list(cols)
        named = [] if self.cap is None and self.cov == "full" else [self.id_col]  # the id only orders the rows for a cap or a start
        every = benign.filter(q(self.id_col).isNotNull()).select(*named, *[q(c).cast("double").alias(c) for c in cols]).dropna()
        # a cap is the caller's own choice; the threshold comes from all benign rows in any case
        rows = (every if self.cap is None else hash_take(every, self.cap, self.id_col, self.seed)).persist()
        try:
            best = None
            for j in range(self.n_init):
                found = self._once(rows, self.seed + j)
                if best is None or found[3] > best[3]:
                    best = found
            self.weights, self.means, self.covs, self.log_likelihood, self.n_fit = best
            self.threshold = 0.0
            scored = self.score(every)
            self.threshold = exact_percentiles(scored, ["score"], [1.0 - self.percentile / 100.0])["score"][0]
        finally:
            rows.unpersist()
        return self

    def _once(self, rows: DataFrame, seed: int):
        if self.cov != "full":
            return em_fit(rows, self.cols, self.k, self.cov, seed, self.id_col, self.max_iter)
        if self.k == 1:
            from flowwatch.operators.moments import moments
            n, mean, sigma = moments(rows, self.cols)
            covs = _safe(sigma[None])
            # E[(x-m)' S^-1 (x-m)] = trace(S^-1 S): the likelihood of one Gaussian in closed form.
            d = len(self.cols)
            ll = -0.5 * n * (d * math.log(2 * math.pi) + np.linalg.slogdet(covs[0])[1]
                             + np.trace(np.linalg.solve(covs[0], sigma)))
            return np.ones(1), mean[None], covs, float(ll), n
        model = GaussianMixture(k=self.k, featuresCol="v", maxIter=self.max_iter, tol=1e-3, seed=seed,
                                probabilityCol="_p", predictionCol="_c").fit(assemble(rows, self.cols))
        parts = model.gaussiansDF.collect()
        means = np.array([r["mean"].toArray() for r in parts])
        covs = _safe(np.array([r["cov"].toArray() for r in parts]))
        return np.array(model.weights), means, covs, float(model.summary.logLikelihood), rows.count()

    def given(self, cols: Sequence[str], weights, means, covs, threshold: float) -> GaussianMixtureDetector:
        """A mixture with known parameters."""
        self.cols, self.threshold = list(cols), threshold
        self.weights, self.means, self.covs = (np.asarray(a, dtype=float) for a in (weights, means, covs))
        return self

    def scorer(self):
        self.check()
        parts = (self.weights, self.means, self.covs)
        return lambda x: -log_density(x, *parts)

    def score(self, df: DataFrame, out: str = "score") -> DataFrame:
        return arrow_score(df, self.cols, self.scorer(), out)

    def bic(self) -> float:
        return -2.0 * self.log_likelihood + free_parameters(len(self.weights), len(self.cols), self.cov) * math.log(self.n_fit)

    def aic(self) -> float:
        return -2.0 * self.log_likelihood + 2.0 * free_parameters(len(self.weights), len(self.cols), self.cov)

    def rows(self):
        own = [("", "k", 0, self.k), ("", "percentile", 0, self.percentile), ("", "n_init", 0, self.n_init),
               ("", "max_iter", 0, self.max_iter), ("", "seed", 0, self.seed),
               ("", "cap", 0, self.cap), (self.cov, "cov_type", 0, None), (self.id_col, "id_col", 0, None)]
        return own + pack("weights", self.weights) + pack("means", self.means) + pack("covs", self.covs)

    def restore(self, rows) -> None:
        for feature, stat, _, value in rows:
            if stat in ("k", "n_init", "max_iter", "seed"):
                setattr(self, stat, int(value))
            elif stat == "cap":
                self.cap = None if value is None else int(value)
            elif stat == "percentile":
                self.percentile = value
            elif stat == "cov_type":
                self.cov = feature
            elif stat == "id_col":
                self.id_col = feature
        self.weights, self.means, self.covs = (unpack(s, rows) for s in ("weights", "means", "covs"))


def gmm_covariance_compare(train: DataFrame, test: DataFrame, cols: Sequence[str], k: int = 12, y: str = "y",
                           **options) -> DataFrame:
    """Free parameters, BIC, metrics and time of each covariance shape."""
    out = None
    for cov in COVARIANCE_TYPES:
        started = time.perf_counter()
        model = GaussianMixtureDetector(k=k, cov=cov, **options).fit(train, cols)
        seconds = time.perf_counter() - started
        row = classification_metrics(model.predict(model.score(test)), y, "pred", "score").select(
            F.lit(cov).alias("cov"), F.lit(free_parameters(k, len(cols), cov)).alias("n_params"),
            F.lit(model.bic()).alias("bic"), "f1", "precision", "recall", "roc_auc",
            F.lit(seconds).alias("fit_seconds"))
        out = row if out is None else out.unionByName(row)
    return out


def gmm_select_k(train: DataFrame, cols: Sequence[str], ks: Sequence[int] = tuple(range(1, 16)), **options) -> DataFrame:
    """BIC and AIC per number of components; the two best are marked."""
    rows = []
    for k in ks:
        model = GaussianMixtureDetector(k=k, **options).fit(train, cols)
        rows.append([k, model.log_likelihood, model.bic(), model.aic()])
    best_bic = min(r[2] for r in rows)
    best_aic = min(r[3] for r in rows)
    return train.sparkSession.createDataFrame(
        [(r[0], r[1], r[2], r[3], r[2] == best_bic, r[3] == best_aic) for r in rows],
        "k int, log_likelihood double, bic double, aic double, best_bic boolean, best_aic boolean")

"""Thresholds, calibration and score fusion on columns keyed by row id."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import (
    LogisticRegression, LogisticRegressionModel, RandomForestClassificationModel, RandomForestClassifier,
)
from pyspark.ml.feature import Bucketizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowwatch.functions.exprs import clip, q
from flowwatch.operators.metrics import (
    classification_metrics, comparison_table, count_if, mixed_percentiles, mixed_ranking, ranking_metrics,
    with_rates,
)
from flowwatch.operators.order import sorted_ranges
from flowwatch.operators.quantile import exact_percentiles
from flowwatch.operators.split import stratified_kfold
from flowwatch.sources import params


def percentile_threshold(benign: DataFrame, score: str, p: float) -> float:
    """``p``-th percentile (0-100) of benign scores."""
    return exact_percentiles(benign, [score], [p / 100.0])[score][0]


def flag_above(df: DataFrame, score: str, threshold: float, out: str = "pred", strict: bool = True) -> DataFrame:
    hit = q(score) > threshold if strict else q(score) >= threshold
    return df.withColumn(out, F.when(hit, 1).otherwise(0))


def _with_beaten(df: DataFrame, cuts: Mapping[str, Sequence[float]], strict: bool) -> DataFrame:
    """Adds ``_n_<score>``: how many of its ascending thresholds each score passes.

    A binary search per score, so many thresholds cost no more than a few.
    """
    edges, names = [], list(cuts)
    for c in names:
        distinct = sorted(set(cuts[c]))
        edges.append([-math.inf, *[math.nextafter(t, math.inf) if strict else t for t in distinct], math.inf])
    out = Bucketizer(splitsArray=edges, inputCols=names, outputCols=[f"_b_{c}" for c in names],
                     handleInvalid="keep").transform(df)
    for c in names:
        distinct = sorted(set(cuts[c]))
        passed = [0] + [sum(1 for t in cuts[c] if t <= u) for u in distinct]
        table = F.array(*[F.lit(v) for v in passed])
        out = out.withColumn(f"_n_{c}", F.element_at(table, F.col(f"_b_{c}").cast("int") + 1)).drop(f"_b_{c}")
    return out


def _sweep(cells: DataFrame, by: Sequence[str], steps: int) -> DataFrame:
    """Counts per number of beaten thresholds to counts per threshold.

    ``cells`` has at most ``steps + 1`` rows per group, so this is a fixed-size step.
    """
    grid = F.transform(F.sequence(F.lit(1), F.lit(steps)), lambda t: F.struct(
        t.alias("step"), F.when(F.col("passed") >= t, F.col("pos")).otherwise(0).alias("tp"),
        F.when(F.col("passed") >= t, F.col("neg")).otherwise(0).alias("fp"),
        F.when(F.col("passed") < t, F.col("pos")).otherwise(0).alias("fn"),
        F.when(F.col("passed") < t, F.col("neg")).otherwise(0).alias("tn")))
    return cells.select(*by, F.inline(grid)).groupBy(*by, "step").agg(
        *[F.sum(c).alias(c) for c in ("tn", "fp", "fn", "tp")])


def threshold_sweep(df: DataFrame, score: str, thresholds: Sequence[float], y: str = "y",
                    strict: bool = True) -> DataFrame:
    """Metrics at every threshold, from one pass over the rows."""
    cuts = sorted({float(t) for t in thresholds})
    rows = df.filter(q(score).isNotNull()).select(q(score).cast("double").alias("s"), q(y).alias("_y"))
    cells = _with_beaten(rows, {"s": cuts}, strict).groupBy(F.col("_n_s").alias("passed")).agg(
        count_if(F.col("_y") == 1).alias("pos"), count_if(F.col("_y") == 0).alias("neg"))
    swept = _sweep(cells, [], len(cuts))
    value = F.element_at(F.array(*[F.lit(t) for t in cuts]), F.col("step"))
    return with_rates(swept.select(value.alias("threshold"), "tn", "fp", "fn", "tp"))


def best_threshold(swept: DataFrame, metric: str = "f1") -> DataFrame:
    return swept.orderBy(F.desc(metric), "threshold").limit(1)


def fit_minmax(validation_benign: DataFrame, scores: Sequence[str]) -> dict[str, tuple[float, float]]:
    row = validation_benign.agg(*[F.min(q(s)).alias(f"lo{i}") for i, s in enumerate(scores)],
                                *[F.max(q(s)).alias(f"hi{i}") for i, s in enumerate(scores)]).first()
    return {s: (row[f"lo{i}"], row[f"hi{i}"]) for i, s in enumerate(scores)}


def minmax_expr(score: Column, bounds: tuple[float, float]) -> Column:
    lo, hi = bounds
    return clip((score - lo) / F.lit(hi - lo + 1e-8), 0.0, 1.0)


def minmax_clip(df: DataFrame, bounds: Mapping[str, tuple[float, float]]) -> DataFrame:
    return df.select(*[minmax_expr(q(c), bounds[c]).alias(c) if c in bounds else q(c) for c in df.columns])


# --- calibration ---------------------------------------------------------------


@dataclass
class Isotonic:
    """A monotone map: linear between the levels at its boundaries, constant outside."""

    boundaries: list[float]
    levels: list[float]

    def apply(self, values: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(values, self.boundaries, self.levels), 0.0, 1.0)


#: Neighbouring groups of pooled blocks that one task of a reduction round merges.
_FAN = 8
_BLOCKS = "grp long, lo double, hi double, w double, wy double"


def _pooled(blocks: pa.Table) -> pa.Table:
    """Adjacent violators pooled: blocks whose mean is not above that of the block before become one with it."""
    blocks = blocks.sort_by("lo")
    done: list[list[float]] = []
    for block in zip(*(blocks.column(c).to_pylist() for c in ("lo", "hi", "w", "wy")), strict=True):
        now = list(block)
        while done and done[-1][3] * now[2] >= now[3] * done[-1][2]:
            before = done.pop()
            now = [before[0], now[1], before[2] + now[2], before[3] + now[3]]
        done.append(now)
    lo, hi, w, wy = (pa.array([d[i] for d in done], pa.float64()) for i in range(4))
    return pa.table({"grp": pa.array([blocks.column("grp")[0].as_py()] * len(done), pa.int64()),
                     "lo": lo, "hi": hi, "w": w, "wy": wy})


def isotonic_fit(meta_fit: DataFrame, score: str, y: str = "y") -> Isotonic:
    """Monotone map of score to attack rate, fitted on distinct scores with weights.

    Ranges of scores are pooled in their tasks. What is pooled stays together when neighbours are pooled with it, so the
    blocks of neighbouring ranges merge in a tree of rounds, and the driver gets the blocks of the solution only.
    """
    rows = meta_fit.filter(q(score).isNotNull() & q(y).isNotNull())
    merged = rows.groupBy(q(score).cast("double").alias("lo")).agg(
        F.sum(q(y).cast("double")).alias("wy"), F.count(F.lit(1)).cast("double").alias("w"))
    ranges = sorted_ranges(merged, [F.col("lo")])
    groups = (ranges.agg(F.max("_b")).first()[0] or 0) + 1
    blocks = ranges.select(F.col("_b").cast("long").alias("grp"), "lo", F.col("lo").alias("hi"), "w", "wy")
    blocks = blocks.groupBy("grp").applyInArrow(_pooled, _BLOCKS)
    while groups > 1:
        blocks = blocks.withColumn("grp", F.floor(F.col("grp") / _FAN)).groupBy("grp").applyInArrow(_pooled, _BLOCKS)
        groups = -(-groups // _FAN)
    solution = sorted((r["lo"], r["hi"], r["wy"] / r["w"]) for r in blocks.collect())
    if not solution:
        raise ValueError("no scored rows to calibrate on")
    points = [(x, level) for lo, hi, level in solution for x in ((lo,) if lo == hi else (lo, hi))]
    return Isotonic([x for x, _ in points], [level for _, level in points])


def isotonic_apply(df: DataFrame, model: Isotonic, score: str, out: str) -> DataFrame:
    @F.pandas_udf("double")
    def run(values: pd.Series) -> pd.Series:
        return pd.Series(model.apply(values.to_numpy(dtype=float)))
    return df.withColumn(out, F.when(q(score).isNotNull(), run(q(score).cast("double"))))


def meta_features(scores: Mapping[str, DataFrame], row_id: str,
                  calibrators: Mapping[str, Isotonic] | None = None,
                  keep: DataFrame | None = None) -> DataFrame:
    """Raw and calibrated scores side by side, joined on the row id."""
    out = keep
    for name, frame in scores.items():
        named = frame.select(row_id, q("score").alias(name))
        out = named if out is None else out.join(named, row_id)
    for name, model in (calibrators or {}).items():
        out = isotonic_apply(out, model, name, f"calibrated_{name}")
    return out


# --- weighting -------------------------------------------------------------------


def alpha_percentile_grid(validation_benign: DataFrame, test: DataFrame, first: str, second: str,
                          y: str = "y", alphas: Sequence[float] = tuple(round(0.1 * i, 1) for i in range(1, 10)),
                          percentiles: Sequence[int] = tuple(range(1, 25))) -> DataFrame:
    """F1 and AUC of every mix ``a * first + (1 - a) * second`` at every benign percentile."""
    mixes = {f"a{i}": a * q(first) + (1.0 - a) * q(second) for i, a in enumerate(alphas)}
    cuts = mixed_percentiles(validation_benign, mixes, [p / 100.0 for p in percentiles])
    wide = test.select(q(y).alias("_y"), *[m.alias(name) for name, m in mixes.items()])
    per_mix = lambda col: F.array(*[F.struct(F.lit(i).alias("m"), F.col(col(name)).alias("v"))
                                    for i, name in enumerate(mixes)])
    counted = _with_beaten(wide, cuts, True).select("_y", F.inline(per_mix(lambda name: f"_n_{name}")))
    cells = counted.groupBy("m", F.col("v").alias("passed")).agg(
        count_if(F.col("_y") == 1).alias("pos"), count_if(F.col("_y") == 0).alias("neg"))
    swept = with_rates(_sweep(cells, ["m"], len(percentiles)))
    auc = mixed_ranking(wide, {name: q(name) for name in mixes}, "_y").select("m", F.col("roc_auc").alias("auc"))
    alpha = F.element_at(F.array(*[F.lit(float(a)) for a in alphas]), F.col("m") + 1)
    pct = F.element_at(F.array(*[F.lit(int(p)) for p in percentiles]), F.col("step"))
    return swept.join(auc, "m").select(alpha.alias("alpha"), pct.alias("pct"), "f1", "auc")


def grid_heat_table(grid: DataFrame, alphas: Sequence[float]) -> DataFrame:
    """F1 by percentile (rows) and alpha (columns)."""
    return grid.groupBy("pct").pivot("alpha", [float(a) for a in alphas]).agg(F.first("f1"))


def weighted_mix(cols: Sequence[str], alpha: float | Column) -> Column:
    a = alpha if isinstance(alpha, Column) else F.lit(float(alpha))
    out = a * q(cols[0])
    for c in cols[1:]:
        out = out + (1.0 - a) / float(len(cols) - 1) * q(c)
    return out


def weighted_average(df: DataFrame, cols: Sequence[str], y: str = "y",
                     alphas: Sequence[float] = tuple(round(0.05 * i, 2) for i in range(21))) -> DataFrame:
    """Average precision per alpha, best first; the lowest alpha wins a tie."""
    found = mixed_ranking(df, {str(i): weighted_mix(cols, a) for i, a in enumerate(alphas)}, y)
    alpha = F.element_at(F.array(*[F.lit(float(a)) for a in alphas]), F.col("m") + 1)
    ranks = found.select(alpha.alias("alpha"), "pr_auc")
    return ranks.orderBy(F.desc("pr_auc"), "alpha")


# --- meta-learners ---------------------------------------------------------------------


@dataclass
class Learner:
    """A fitted meta-learner: adds an attack probability to meta-features."""

    name: str
    cols: list[str]
    model: object

    def score(self, df: DataFrame, out: str = "score") -> DataFrame:
        if self.name == "weighted":
            return df.withColumn(out, weighted_mix(self.cols, self.model))
        staged = VectorAssembler(inputCols=self.cols, outputCol="_meta").transform(df)
        return self.model.transform(staged).withColumn(out, vector_to_array("_prob")[1]).drop(
            "_meta", "_raw", "_prob", "_hit")


def meta_learner(name: str, df: DataFrame, cols: Sequence[str], y: str = "y", seed: int = 42,
                 trees: int = 200, depth: int = 30, c: float = 1.0, balanced: bool = False) -> Learner:
    """Fit ``rf``, ``lr`` or ``weighted`` on meta-features."""
    cols = list(cols)
    if name == "weighted":
        best = weighted_average(df, cols, y).first()
        return Learner(name, cols, float(best["alpha"]))
    if name not in ("rf", "lr"):
        raise KeyError(f"unknown meta-learner {name!r}")
    staged = VectorAssembler(inputCols=cols, outputCol="_meta").transform(df).withColumn("_y", q(y).cast("double"))
    names = dict(featuresCol="_meta", labelCol="_y", probabilityCol="_prob", rawPredictionCol="_raw",
                 predictionCol="_hit")
    counts = staged.agg(F.count(F.lit(1)).alias("n"), F.sum("_y").alias("p")).first()
    n, p = counts["n"], counts["p"] or 0.0
    if balanced and 0 < p < n:
        staged = staged.withColumn("_w", F.when(F.col("_y") == 1, n / (2.0 * p)).otherwise(n / (2.0 * (n - p))))
        names["weightCol"] = "_w"
    if name == "rf":
        learner = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, **names)
    else:
        learner = LogisticRegression(regParam=1.0 / (c * max(n, 1)), elasticNetParam=0.0, standardization=False,
                                     maxIter=1000, **names)
    return Learner(name, cols, learner.fit(staged))


def select_meta_learner(meta_fit: DataFrame, cols: Sequence[str], row_id: str, y: str = "y",
                        candidates: Sequence[str] = ("rf", "lr", "weighted"), k: int = 3, seed: int = 42,
                        **options) -> tuple[Learner, DataFrame]:
    """Cross-validated average precision per candidate; the best is refitted on all rows."""
    folds = stratified_kfold(meta_fit, row_id, y, k, seed).persist()
    rows = []
    try:
        for name in candidates:
            found = []
            for j in range(k):
                fitted = meta_learner(name, folds.filter(F.col("fold") != j), cols, y, seed, **options)
                held = fitted.score(folds.filter(F.col("fold") == j))
                found.append(ranking_metrics(held, "score", y).first()["pr_auc"])
            rows.append((name, float(np.mean(found)), float(np.std(found))))
        best = max(rows, key=lambda r: r[1])[0]
        fitted = meta_learner(best, folds, cols, y, seed, **options)
    finally:
        folds.unpersist()
    table = meta_fit.sparkSession.createDataFrame(rows, "candidate string, cv_pr_auc_mean double, cv_pr_auc_std double")
    return fitted, table


def learner_weights(learner: Learner) -> list[tuple[str, float, float]]:
    """``(feature, weight, relative share)`` of a linear or forest learner."""
    if learner.name == "lr":
        raw = [float(v) for v in learner.model.coefficients]
    elif learner.name == "rf":
        raw = [float(v) for v in learner.model.featureImportances.toArray()]
    else:
        rest = (1.0 - learner.model) / max(1, len(learner.cols) - 1)
        raw = [learner.model] + [rest] * (len(learner.cols) - 1)
    total = sum(abs(v) for v in raw) or 1.0
    return [(c, v, abs(v) / total) for c, v in zip(learner.cols, raw)]


@dataclass
class FusionModel:
    """Calibrated scores into one probability, or a weighted min-max mix without a learner."""

    bases: list[str]
    calibrators: dict = field(default_factory=dict)
    learner: Learner | None = None
    bounds: dict = field(default_factory=dict)
    alpha: float = 0.7
    threshold: float = 0.5

    @classmethod
    def fit(cls, meta_fit: DataFrame, bases: Sequence[str], row_id: str, y: str = "y",
            candidates: Sequence[str] = ("rf", "lr", "weighted"), **options) -> tuple[FusionModel, DataFrame]:
        calibrators = {b: isotonic_fit(meta_fit, b, y) for b in bases}
        staged = cls(list(bases), calibrators)
        featured = staged._features(meta_fit)
        learner, table = select_meta_learner(featured, staged.columns, row_id, y, candidates, **options)
        staged.learner = learner
        staged.bounds = fit_minmax(meta_fit, bases)
        return staged, table

    @property
    def columns(self) -> list[str]:
        return self.bases + [f"calibrated_{b}" for b in self.bases if b in self.calibrators]

    def _features(self, df: DataFrame) -> DataFrame:
        for b, model in self.calibrators.items():
            df = isotonic_apply(df, model, b, f"calibrated_{b}")
        return df

    def score(self, df: DataFrame, out: str = "score") -> DataFrame:
        if self.learner is not None:
            return self.learner.score(self._features(df), out)
        if not self.bounds:
            raise RuntimeError("the fusion model is not fitted")
        unclipped = [(q(b) - self.bounds[b][0]) / F.lit(self.bounds[b][1] - self.bounds[b][0] + 1e-8)
                     for b in self.bases]
        return df.withColumn(out, self.alpha * unclipped[0] + (1.0 - self.alpha) * unclipped[1])

    def predict(self, df: DataFrame, out: str = "pred") -> DataFrame:
        return flag_above(self.score(df), "score", self.threshold, out, strict=False)

    def save(self, spark: SparkSession, path: str) -> None:
        """Bases, calibrators, bounds and numbers as a parameter table, a fitted learner's model beside it."""
        if self.learner is None and not self.bounds:
            raise RuntimeError("the fusion model is not fitted")
        rows = [("", "alpha", 0, self.alpha), ("", "threshold", 0, self.threshold)]
        rows += [(b, "base", i, None) for i, b in enumerate(self.bases)]
        for b, m in self.calibrators.items():
            rows += [(b, "boundary", i, v) for i, v in enumerate(m.boundaries)]
            rows += [(b, "level", i, v) for i, v in enumerate(m.levels)]
        rows += [(b, "bound", i, v) for b, pair in self.bounds.items() for i, v in enumerate(pair)]
        if self.learner is not None:
            weight = self.learner.model if self.learner.name == "weighted" else None
            rows += [(self.learner.name, "learner", 0, weight)]
            rows += [(c, "learner_column", i, None) for i, c in enumerate(self.learner.cols)]
        params.save_params(spark, f"{path}/params", "fusion", rows)
        if self.learner is not None and self.learner.name != "weighted":
            self.learner.model.write().overwrite().save(f"{path}/learner")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> FusionModel:
        rows = params.load_params(spark, f"{path}/params", "fusion")
        series: dict[tuple[str, str], list[float]] = {}
        for feature, stat, _, value in rows:  # in the order of their places
            series.setdefault((stat, feature), []).append(value)
        bases = [f for f, stat, _, _ in rows if stat == "base"]
        calibrators = {b: Isotonic(series["boundary", b], series["level", b]) for b in bases if ("boundary", b) in series}
        bounds = {b: tuple(series["bound", b]) for b in bases if ("bound", b) in series}
        learner = None
        for name, value in [(f, v) for f, stat, _, v in rows if stat == "learner"]:
            kinds = {"lr": LogisticRegressionModel, "rf": RandomForestClassificationModel}
            model = value if name == "weighted" else kinds[name].load(f"{path}/learner")
            learner = Learner(name, [f for f, stat, _, _ in rows if stat == "learner_column"], model)
        return cls(bases, calibrators, learner, bounds, series["alpha", ""][0], series["threshold", ""][0])


def variant_metrics(df: DataFrame, variants: Mapping[str, tuple[Column, float, bool]], y: str = "y") -> DataFrame:
    """The same metrics for several score columns, each with its own threshold."""
    entries = F.array(*[
        F.struct(F.lit(name).alias("variant"), s.cast("double").alias("s"),
                 F.when(s > t if strict else s >= t, 1).otherwise(0).alias("pred"))
        for name, (s, t, strict) in variants.items()])
    long = df.select(q(y).alias("_y"), F.inline(entries))
    return classification_metrics(long, "_y", "pred", "s", ["variant"])


ablation_variants = variant_metrics


def fusion_method_compare(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Methods side by side; ``winner`` marks the best AUC."""
    merged = comparison_table(tables)
    best = F.max(F.struct(F.coalesce("roc_auc", F.lit(-1.0)), "model")).over(Window.partitionBy(F.lit(0)))
    return merged.withColumn("winner", F.col("model") == best["model"])

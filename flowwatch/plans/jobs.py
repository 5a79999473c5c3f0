"""End-to-end jobs: preprocess, train, evaluate, detect, monitor, robustness.

Each job is a chain of the operators. Fits run a few aggregates and keep only
small parameters on the driver; everything that touches rows stays lazy.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowwatch.functions.exprs import numeric_columns, q
from flowwatch.operators import clean, explain, fuse, metrics, sequence, split
from flowwatch.operators.detect import (
    Detector, GaussianMixtureDetector, HybridDetector, IsolationForest, OneClassSvm, WindowReconstruction,
)
from flowwatch.operators.features import FeaturePlan
from flowwatch.operators.order import dense_index
from flowwatch.session import durable
from flowwatch.sources import flow_files
from flowwatch.streaming.adapt import AdaptationLoop, drift_event_report, run_batches
from flowwatch.streaming.batch import inject_shift, shift_benign


def clean_flows(raw: DataFrame, label: str = "Label", benign: str = "BENIGN",
                keep: Sequence[str] = ()) -> DataFrame:
    """Names, identifiers, constants, non-finite values, imputation, duplicates."""
    named = clean.strip_column_names(raw, label)
    named = clean.repair_label_text(named, label)
    kept = clean.drop_identifier_columns(named, [c for c in clean.ID_COLUMNS if c not in keep])
    kept = clean.drop_near_constant(kept, exclude=[label, *keep])
    finite = clean.nonfinite_to_null(kept)
    features = numeric_columns(finite, exclude=[label, *keep])
    filled = clean.impute_or_drop(finite, features, label, benign)
    return filled.dropDuplicates([c for c in filled.columns if c not in keep]) if keep else clean.drop_exact_duplicates(filled)


def preprocess(flows: DataFrame, row_id: str, features: Sequence[str], label: str = "label",
               benign: str = "BENIGN", test_size: float = 0.2, seed: int = 42,
               keep: Sequence[str] = ()) -> tuple[DataFrame, FeaturePlan]:
    """Split, fit the feature plan on benign train rows, transform every row."""
    parts = split.one_class_split(flows, row_id, label, benign, test_size, seed)
    plan = FeaturePlan().fit(parts.filter("split = 'train'"), features)
    return plan.transform(parts, [row_id, label, "y", "split", *keep]), plan


@dataclass
class Trained:
    """Fitted detectors, the fusion model and the tables of a training run."""

    detectors: dict[str, Detector] = field(default_factory=dict)
    sequence: WindowReconstruction | None = None
    fusion: fuse.FusionModel | None = None
    comparison: DataFrame | None = None
    candidates: DataFrame | None = None
    parts: DataFrame | None = None


def train(ready: DataFrame, cols: Sequence[str], row_id: str, order_col: str, label: str = "label",
          window: int = 50, stride: int = 25, latent: int = 32, meta_frac: float = 0.4, seed: int = 42,
          mixture: dict | None = None, forest: dict | None = None, svm: dict | None = None,
          learner: dict | None = None) -> Trained:
    """Flow detectors, the window detector, and the leak-free fusion of two scores."""
    benign, test = ready.filter("split = 'train'").persist(), ready.filter("split = 'test'").persist()
    out = Trained()
    out.detectors["gmm"] = GaussianMixtureDetector(id_col=row_id, seed=seed, **(mixture or {})).fit(benign, cols)
    out.detectors["isolation_forest"] = IsolationForest(id_col=row_id, seed=seed, **(forest or {})).fit(benign, cols)
    out.detectors["one_class_svm"] = OneClassSvm(id_col=row_id, seed=seed, **(svm or {})).fit(benign, cols)
    tables = {name: model.evaluate(test) for name, model in out.detectors.items()}

    windows = sequence.train_windows(split.tail_split(benign, 0.1, order_col, row_id).filter("split = 'train'"),
                                     cols, window, stride, order_col, row_id)
    out.sequence = WindowReconstruction(window, latent).fit(windows, cols)
    out.sequence.calibrate_flows(benign, stride, order_col, row_id)
    hybrid = HybridDetector(out.detectors["gmm"], out.sequence, None, order_col, row_id, stride)
    needed = dict.fromkeys([row_id, order_col, label, "y", *cols])
    pool = hybrid.bases(test.select(*[q(c) for c in needed])).select(row_id, label, "y", "gmm", "window")
    out.parts = split.stratified_holdout(pool, row_id, "y", meta_frac, seed).persist()
    flagged = fuse.flag_above(out.parts, "window", out.sequence.row_threshold)
    tables["window_reconstruction"] = metrics.classification_metrics(flagged, "y", "pred", "window")
    out.candidates = hybrid.fit_fusion(out.parts.filter("part = 'meta'"), **(learner or {}))
    out.fusion, out.detectors["hybrid"] = hybrid.fusion, hybrid
    held = out.fusion.predict(out.parts.filter("part = 'eval'"))
    tables["fusion"] = metrics.classification_metrics(held, "y", "pred", "score")
    out.comparison = durable(metrics.comparison_table(tables))
    benign.unpersist()
    test.unpersist()
    return out


def evaluate(scored: DataFrame, score: str, pred: str, row_id: str, label: str = "label",
             n_boot: int = 500) -> dict[str, DataFrame]:
    """Report tables of one scored, flagged eval part."""
    rates = metrics.detection_rate_by_label(scored, label, pred)
    return {
        "metrics": metrics.classification_metrics(scored, "y", pred, score),
        "by_label": rates,
        "per_attack": metrics.per_attack_table(scored, score, label, "y", pred),
        "prevalence": metrics.prevalence_sweep(scored, score, row_id),
        "weak_spots": metrics.weak_spots(rates),
        "interval": metrics.bootstrap_ci(scored, score, n_boot=n_boot),
    }


def detect(new_flows: DataFrame, plan: FeaturePlan, model: Detector, row_id: str, path: str | None = None,
           reference: dict[str, float] | None = None, order_cols: Sequence[str] = (), fmt: str = "parquet") -> DataFrame:
    """Scores new flows with fitted statistics only; optional explanations and sink.

    With a row detector a chain of narrow steps, so it also runs under ``foreachBatch``. A hybrid detector indexes the rows
    by its order columns, which are kept, and its flagged rows are explained by their mixture score.
    """
    named = new_flows.toDF(*[c.strip() for c in new_flows.columns])
    flow_files.read_scoring_input(named, plan.raw)  # the required-column check
    hybrid = isinstance(model, HybridDetector)
    kept = dict.fromkeys([row_id, *([model.order_col, model.tie_col] if hybrid else []), *order_cols])
    ready = plan.transform(named, list(kept))
    out = model.predict(model.score(ready))
    if reference is not None:
        out = explain.explain_flagged(out, model.cols, (model.mixture if hybrid else model).score, reference)
    if path is not None:
        flow_files.write_predictions(out, path, "pred", "score", fmt)
    return out


def monitor(stream: DataFrame, model: GaussianMixtureDetector, order_col: str, row_id: str, batch_rows: int,
            labelled: DataFrame | None = None,
            ks_baseline: Sequence[float] | None = None, shift_after: int | None = None, shift: float = 3.0,
            **options) -> tuple[AdaptationLoop, DataFrame]:
    """Replays stored rows through the adaptation loop; optionally injects a shift."""
    rows, n = dense_index(stream, order_col, row_id)
    if shift_after is not None:
        stds = rows.agg(*[F.stddev_pop(q(c)).alias(c) for c in model.cols]).first().asDict()
        rows = inject_shift(rows, model.cols, "idx", shift_after, shift)
        if labelled is not None:
            labelled = shift_benign(labelled, model.cols, shift, stds)
    loop = AdaptationLoop(model, labelled, ks_baseline=ks_baseline, **options)
    run_batches(loop, rows.persist(), batch_rows, n)
    rows.unpersist()
    return loop, drift_event_report(stream.sparkSession, loop.reports)


def robustness(ready: DataFrame, models: dict[str, Detector], cols: Sequence[str], row_id: str) -> dict[str, DataFrame]:
    scorers = {name: (m.score, m.threshold) for name, m in models.items()}
    benign = ready.filter("split = 'test' AND y = 0")
    return explain.robustness_report(benign, ready.filter("y = 1"), cols, scorers, row_id)


def save_reports(spark: SparkSession, tables: dict[str, DataFrame], folder: str) -> list[str]:
    return flow_files.write_report_tables(tables, folder)

"""Metrics by hand and edge cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowwatch.operators import metrics, split
from flowwatch.operators.detect.base import arrow_score


def rows(spark, data, schema):
    return spark.createDataFrame(data, schema)


@pytest.fixture
def tiny(spark):
    return rows(spark, [(1, 1, .9), (1, 1, .8), (0, 1, .7), (0, 0, .2), (1, 0, .4)], "y int, pred int, s double")


def test_counts_and_rates_by_hand(tiny):
    r = metrics.classification_metrics(tiny, score="s").first()
    assert (r["tp"], r["fp"], r["tn"], r["fn"]) == (2, 1, 1, 1)
    assert r["accuracy"] == pytest.approx(0.6)
    assert r["precision"] == r["recall"] == pytest.approx(2 / 3)
    assert r["roc_auc"] == pytest.approx(5 / 6)


def test_average_precision_with_tie_is_the_step_sum(spark):
    df = rows(spark, [(1, .9), (0, .8), (1, .8), (0, .3), (0, .1)], "y int, s double")
    assert metrics.average_precision(df, "s").first()[0] == pytest.approx(0.5 * 1 + 0.5 * 2 / 3)


def test_zero_division_and_single_class(spark):
    df = rows(spark, [(0, 0, .1), (0, 0, .2)], "y int, pred int, s double")
    r = metrics.classification_metrics(df, score="s").first()
    assert r["precision"] == r["recall"] == r["f1"] == 0.0
    assert r["roc_auc"] is None and r["pr_auc"] is None
    assert metrics.fpr_at_tpr(df, "s").first()[0] is None


def test_detection_rate_by_label(spark):
    df = rows(spark, [("DoS", 1), ("DoS", 0), ("Bot", 1), ("BENIGN", 1), ("normal", 0), ("NORMAL", 1)],
              "label string, pred int")
    got = {r["label"]: (r["total"], r["detected"], r["missed"], r["rate_pct"])
           for r in metrics.detection_rate_by_label(df).collect()}
    assert got == {"DoS": (2, 1, 1, 50.0), "Bot": (1, 1, 0, 100.0), "normal": (1, 0, 1, 0.0)}
    assert metrics.detection_rate_by_label(df.limit(0)).count() == 0


def separable(spark, n_pos=100, n_neg=400):
    rng = np.random.default_rng(0)
    s = np.concatenate([rng.normal(3, 1, n_pos), rng.normal(0, 1, n_neg)])
    data = [(i, int(i < n_pos), "DoS" if i < n_pos // 2 else "Bot" if i < n_pos else "BENIGN", float(v))
            for i, v in enumerate(s)]
    return rows(spark, data, "id long, y int, label string, s double")


def rank_auc(pos, neg):
    return np.mean([(a > neg).mean() + 0.5 * (a == neg).mean() for a in pos])


@pytest.mark.parametrize("split_tasks", [False, True])
def test_ranking_metrics_against_brute_force(spark, monkeypatch, split_tasks):
    from flowwatch.operators import order
    if split_tasks:
        monkeypatch.setattr(order, "TASK_ROWS", 41)
    df = separable(spark).withColumn("s", F.round("s", 1))
    pdf = df.toPandas()
    pos, neg = pdf.s[pdf.y == 1].to_numpy(), pdf.s[pdf.y == 0].to_numpy()
    got = metrics.ranking_metrics(df, "s").first()
    assert got["roc_auc"] == pytest.approx(rank_auc(pos, neg))
    cuts = sorted(set(pdf.s), reverse=True)
    last, ap = 0.0, 0.0
    for c in cuts:
        tp, fp = (pos >= c).sum(), (neg >= c).sum()
        ap += (tp / len(pos) - last) * tp / (tp + fp)
        last = tp / len(pos)
    assert got["pr_auc"] == pytest.approx(ap)
    per = {r["attack_type"]: r["auc_vs_benign"] for r in metrics.per_attack_table(df, "s").collect()}
    for t in ("DoS", "Bot"):
        assert per[t] == pytest.approx(rank_auc(pdf.s[pdf.label == t].to_numpy(), neg))


@pytest.mark.parametrize("metric", ["roc_auc", "pr_auc"])
def test_bootstrap_contains_estimate_and_splits_agree(spark, monkeypatch, metric):
    from flowwatch.operators import order
    df = separable(spark)
    whole = metrics.bootstrap_ci(df, "s", metric=metric, n_boot=100).first()
    want = metrics.ranking_metrics(df, "s").first()[metric]
    assert whole["estimate"] == pytest.approx(want)
    assert whole["ci_lower"] <= want <= whole["ci_upper"]
    monkeypatch.setattr(order, "TASK_ROWS", 60)
    cut = metrics.bootstrap_ci(df, "s", metric=metric, n_boot=100).first()
    assert cut["estimate"] == pytest.approx(want)
    assert cut["ci_lower"] == pytest.approx(whole["ci_lower"], abs=0.03)


def test_bootstrap_one_class_is_null(spark):
    df = rows(spark, [(0, .1), (0, .2)], "y int, s double")
    assert metrics.bootstrap_ci(df, "s", n_boot=10).first()["estimate"] is None


def test_prevalence_ratio_and_rows(spark):
    df = separable(spark, 100, 4000)
    got = {round(r["prevalence"], 2): r for r in metrics.prevalence_sweep(df, "s", "id").collect()}
    assert got[0.05]["n"] == 2000 and got[0.05]["n_attacks"] == 100
    assert got[0.20]["pr_auc"] > got[0.05]["pr_auc"]
    kept = split.subsample_to_prevalence(df, 0.05, "id")
    assert kept.count() == 2000 and kept.filter("y = 1").count() == 100


def test_no_attacks_gives_empty_table(spark):
    df = rows(spark, [("BENIGN", 0, .1)], "label string, y int, s double")
    assert metrics.per_attack_table(df, "s").count() == 0


def test_holdout_is_disjoint_complete_and_stratified(spark):
    df = spark.range(500).withColumn("y", (F.col("id") % 5 == 0).cast("int"))
    parts = split.stratified_holdout(df, "id")
    counts = {(r["y"], r["part"]): r["count"] for r in parts.groupBy("y", "part").count().collect()}
    assert counts == {(0, "meta"): 160, (0, "eval"): 240, (1, "meta"): 40, (1, "eval"): 60}
    with pytest.raises(ValueError):
        split.stratified_holdout(df.filter("id = 0"), "id")


def test_folds_are_balanced(spark):
    df = spark.range(301).withColumn("y", (F.col("id") % 3 == 0).cast("int"))
    sizes = [r["count"] for r in split.stratified_kfold(df, "id").groupBy("y", "fold").count().collect()]
    assert len(sizes) == 6 and max(s for s in sizes if s < 50) - min(s for s in sizes if s < 50) <= 1


def test_leaked_rows_is_empty_for_a_split(spark):
    df = spark.range(100).withColumn("y", (F.col("id") % 2).cast("int"))
    parts = split.stratified_holdout(df, "id")
    meta, held = parts.filter("part = 'meta'"), parts.filter("part = 'eval'")
    assert metrics.leaked_rows(df, meta, held, "id").count() == 0
    assert metrics.eval_only_filter(df, held, "id").count() == held.count()


def test_arrow_score_runs_on_batches(spark):
    got = arrow_score(spark.range(10).select(F.col("id").cast("double").alias("a")), ["a"], lambda x: x[:, 0] * 2)
    assert [r["score"] for r in got.orderBy("a").collect()] == [2.0 * i for i in range(10)]
    assert not math.isnan(got.first()["score"])


def test_many_mixes_rank_as_each_alone(spark, tiny_tasks):
    rng = np.random.default_rng(8)
    a, b, y = np.round(rng.normal(0, 1, 3000), 1), rng.normal(0, 1, 3000), (rng.random(3000) < 0.2).astype(int)
    rows = [(None if i % 50 == 0 else float(u), float("nan") if i % 70 == 0 else float(v), None if i % 90 == 0 else int(c))
            for i, (u, v, c) in enumerate(zip(a, b, y, strict=True))]
    rows += [(0.5, 0.25, 0)] * 1500  # one value holds a third of the rows
    df = spark.createDataFrame(rows, "a double, b double, y int").repartition(5)
    mixes = {"x": F.col("a"), "y": F.col("b"), "z": 0.3 * F.col("a") + 0.7 * F.col("b"), "one": F.lit(1.0)}
    got = {r["m"]: r for r in metrics.mixed_ranking(df, mixes).collect()}
    for m, mix in enumerate(mixes.values()):
        want = metrics.ranking_metrics(df.withColumn("s", mix), "s").first()
        assert [got[m][c] for c in want.asDict()] == pytest.approx(list(want), rel=1e-12)
    clean = df.filter("NOT isnan(b)")
    probs = [0.0, 0.013, 0.5, 0.77, 1.0]
    cuts = metrics.mixed_percentiles(clean, mixes, probs)
    for name, mix in mixes.items():
        want = clean.agg(F.percentile(mix, F.array(*[F.lit(p) for p in probs]))).first()[0]
        assert cuts[name] == pytest.approx(want, rel=1e-12)


def test_mixes_of_no_rows_or_one_class(spark):
    none = spark.createDataFrame([], "a double, y int")
    assert metrics.mixed_ranking(none, {"a": F.col("a")}).count() == 0
    assert metrics.mixed_percentiles(none, {"a": F.col("a")}, [0.5]) == {"a": [None]}
    one = spark.createDataFrame([(1.0, 0), (2.0, 0)], "a double, y int")
    assert metrics.mixed_ranking(one, {"a": F.col("a")}).first()["pr_auc"] is None


def test_ranking_writes_no_values(spark, monkeypatch):
    """Average precision and AUC need the counts of the distinct scores, not the scores."""
    written = []
    ranges = metrics.mixed_ranges
    monkeypatch.setattr(metrics, "mixed_ranges", lambda *a: written.append(ranges(*a)) or written[-1])
    df = spark.createDataFrame([(float(i % 7), i % 3 // 2) for i in range(60)], "a double, y int")
    metrics.mixed_ranking(df, {"a": F.col("a")}).collect()
    metrics.mixed_percentiles(df, {"a": F.col("a")}, [0.5])
    assert [w.columns for w in written] == [["m", "r", "pos", "neg", "p", "n"], ["m", "r", "v", "pos", "p", "n"]]

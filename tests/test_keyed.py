"""Adaptation by source: two sources, of which one drifts, against what each source would do alone."""

import numpy as np
import pandas as pd
import pytest

from flowwatch.operators.detect import GaussianMixtureDetector
from flowwatch.streaming import keyed
from flowwatch.streaming.adapt import Tolerance, run_batches
from flowwatch.streaming.folds import Adwin, PageHinkley, ScoreMonitor
from flowwatch.streaming.keyed import SourceAdaptation, em_arrays, refit_by_source, score_by_source

COLS = ["a", "b"]


def start():
    return GaussianMixtureDetector(k=1, percentile=11.0).given(COLS, [1.0], [[0.0, 0.0]], [np.eye(2)], 4.5)


def stream(n=1200, shift=4.0, seed=2):
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame(rng.normal(size=(n, 2)), columns=COLS)
    pdf["idx"], pdf["row_id"] = np.arange(n), [f"r{i:04d}" for i in range(n)]
    pdf["src"] = np.where(rng.random(n) < 0.5, "calm", "moved")
    pdf.loc[(pdf["src"] == "moved") & (pdf["idx"] >= n // 2), COLS] += shift
    return pdf


def labelled(shift=4.0):
    rng = np.random.default_rng(7)
    rows = pd.DataFrame(rng.normal(size=(400, 2)), columns=COLS)
    rows["src"], rows["y"] = ["calm", "moved"] * 200, [0, 0, 1, 1] * 100
    rows.loc[(rows["src"] == "moved") & (rows["y"] == 0), COLS] += shift
    rows.loc[rows["y"] == 1, COLS] += 30.0
    return rows


def monitor():
    return ScoreMonitor(4.5, PageHinkley(40, 0.1, 100), PageHinkley(15, 0.05, 100), Adwin(delta=0.002))


@pytest.fixture(scope="module")
def ran(spark):
    loop = SourceAdaptation(start(), "src", spark.createDataFrame(labelled()), monitor(), limit=Tolerance(rows=50), history=100)
    return run_batches(loop, spark.createDataFrame(stream()), 200, 1200)


def test_only_the_moved_source_adapts(spark, ran):
    status = {r["source"]: r for r in ran.status().collect()}
    assert status["calm"]["version"] == 0 and not status["calm"]["pending"]
    assert status["moved"]["version"] >= 1
    events = [r for r in ran.events(spark).collect()]
    assert events and {r["source"] for r in events} == {"moved"} and min(r["at"] for r in events) >= 600
    reports = ran.reports(spark).collect()
    assert {r["source"] for r in reports} == {"moved"} and any(r["accepted"] for r in reports)
    models = {r["source"]: r for r in ran.models.collect()}
    assert models["calm"]["means"] == [0.0, 0.0] and np.abs(np.array(models["moved"]["means"]) - 4).max() < 1.5
    held = ran.buffer.groupBy("source").agg({"idx": "min"}).collect()
    low = {r["source"]: r[1] for r in held}
    assert low["calm"] < 20 and low["moved"] >= 600


def test_a_source_alone_does_the_same(spark, ran):
    pdf = stream()
    alone = SourceAdaptation(start(), "src", spark.createDataFrame(labelled()), monitor(), limit=Tolerance(rows=50), history=100)
    run_batches(alone, spark.createDataFrame(pdf[pdf["src"] == "moved"]), 200, 1200)
    def key(loop):
        return sorted((r["step"], r["accepted"], r["recent_rows"], r["false_new"]) for r in loop.reports(spark).collect())
    assert key(alone) == key(ran)
    one = {r["source"]: r.asDict() for r in alone.status().collect()}
    assert one["moved"] == {r["source"]: r.asDict() for r in ran.status().collect()}["moved"] and set(one) == {"moved"}


def test_capacity_reservoir_and_no_labels(spark):
    pdf = stream(400, 0.0)
    pdf.loc[::50, "src"] = None
    loop = SourceAdaptation(start(), "src", monitor=monitor(), capacity=30, mode="reservoir", limit=Tolerance(rows=1000))
    run_batches(loop, spark.createDataFrame(pdf), 150, 400)
    status = {r["source"]: r for r in loop.status().collect()}
    assert set(status) == {"", "calm", "moved"} and status["calm"]["buffer_rows"] == 30 and status[""]["buffer_rows"] <= 8
    assert loop.reports(spark).count() == 0


@pytest.mark.parametrize("held", [1000, 1])
def test_scores_and_refits_by_source(spark, monkeypatch, held):
    monkeypatch.setattr(keyed, "TASK_ROWS", 37)
    monkeypatch.setattr(keyed, "HELD_MODELS", held)
    pdf = stream(300)[["src", "idx", *COLS]].rename(columns={"src": "source"})
    rows = spark.createDataFrame(pdf)
    models = spark.createDataFrame([("calm", 0, 3.0, [1.0], [0.0, 0.0], [1.0, 0.0, 0.0, 1.0], 0, 0),
                                    ("moved", 0, 2.0, [0.5, 0.5], [0.0, 0.0, 4.0, 4.0], [1.0, 0.0, 0.0, 1.0] * 2, 0, 0)], keyed.MODELS)
    scored = score_by_source(rows, models, COLS)
    moves = "hashpartitioning" in scored._jdf.queryExecution().executedPlan().toString()
    assert moves == (held == 1)  # few mixtures go to the rows
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # rows and mixtures must meet in many partitions
    try:
        got = {r["idx"]: r for r in scored.collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(got) == 300
    for r in pdf.itertuples():
        one = np.exp(-(r.a ** 2 + r.b ** 2) / 2) / (2 * np.pi)
        two = np.exp(-((r.a - 4) ** 2 + (r.b - 4) ** 2) / 2) / (2 * np.pi)
        want = -np.log(one if r.source == "calm" else (one + two) / 2)
        assert got[r.idx]["score"] == pytest.approx(want) and got[r.idx]["pred"] == int(want > (3 if r.source == "calm" else 2))
    refits = {r["source"]: r for r in refit_by_source(rows, models, COLS, 1, 10.0).collect()}
    for source, mine in pdf.groupby("source"):
        x = mine[COLS].to_numpy()
        assert refits[source]["means"] == pytest.approx(x.mean(axis=0))
        assert refits[source]["covs"] == pytest.approx(np.cov(x.T, bias=True).ravel())
        assert refits[source]["median_old"] == pytest.approx(np.median([got[i]["score"] for i in mine["idx"]]))
        assert len(refits[source]["baseline"]) == 999


def test_em_finds_two_clusters():
    rng = np.random.default_rng(1)
    x = np.vstack([rng.normal(0, 1, (400, 2)), rng.normal(6, 0.5, (200, 2))])
    weights, means, covs = em_arrays(x, 2, 0, 3)
    order = np.argsort(means[:, 0])
    assert weights[order] == pytest.approx([2 / 3, 1 / 3], abs=0.02)
    assert means[order] == pytest.approx(np.array([[0, 0], [6, 6]]), abs=0.2)
    assert covs[order][1] == pytest.approx(np.eye(2) * 0.25, abs=0.08)

"""The end-to-end jobs on a small flow world."""

import numpy as np
import pandas as pd
import pytest

from flowwatch.streaming.adapt import Tolerance
from flowwatch.operators import explain
from flowwatch.plans import jobs

COLS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def world(spark):
    rng = np.random.default_rng(17)
    pdf = pd.DataFrame(np.vstack([rng.normal(0, 1, (600, 3)), rng.normal(3, 1, (200, 3))]), columns=COLS)
    pdf["row_id"] = [f"r{i:04d}" for i in range(800)]
    pdf["pos"] = np.random.default_rng(1).permutation(800)
    pdf["label"] = ["BENIGN"] * 600 + ["DoS"] * 120 + ["Bot"] * 80
    return spark.createDataFrame(pdf).persist()


def test_preprocess_train_detect_evaluate(spark, world, tmp_path):
    ready, plan = jobs.preprocess(world, "row_id", COLS, keep=["pos"])
    assert ready.filter("split = 'train'").count() == 480
    # The absent ratio columns are constant zeros and carry no signal.
    cols = [c for c in plan.names if not c.startswith("feat_")]
    got = jobs.train(ready, cols, "row_id", "pos", window=5, stride=1, latent=3,
                     mixture=dict(k=2, n_init=1, max_iter=10), forest=dict(trees=10), svm=dict(steps=5),
                     learner=dict(candidates=("lr", "weighted")))
    table = {r["model"]: r for r in got.comparison.collect()}
    assert set(table) == {"gmm", "isolation_forest", "one_class_svm", "window_reconstruction", "fusion"}
    assert table["fusion"]["roc_auc"] > 0.9

    held = got.fusion.predict(got.parts.filter("part = 'eval'"))
    reports = jobs.evaluate(held, "score", "pred", "row_id", n_boot=20)
    assert {r["label"] for r in reports["by_label"].collect()} == {"DoS", "Bot"}
    assert len(jobs.save_reports(spark, reports, str(tmp_path / "reports"))) == 6

    model = got.detectors["gmm"]
    benign = ready.filter("split = 'train'")
    out = jobs.detect(world, plan, model, "row_id", str(tmp_path / "out"),
                      reference=explain.benign_reference(benign, model.cols))
    assert out.count() == 800
    written = spark.read.parquet(str(tmp_path / "out"))
    assert {"anomaly_score", "is_attack", "explain_top1_feature"} <= set(written.columns)
    with pytest.raises(ValueError):
        jobs.detect(world.drop("a"), plan, model, "row_id")

    loop, report = jobs.monitor(benign, model, "pos", "row_id", 200, ready.filter("split = 'test' OR y = 1"),
                                shift_after=240, limit=Tolerance(rows=100))
    assert report.columns[0] == "step" and loop.buffer is not None and loop.recent
    tables = jobs.robustness(ready, {"gmm": model}, model.cols, "row_id")
    assert tables["mimicry"].count() == 5 and tables["noise"].count() == 5

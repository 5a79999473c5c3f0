"""Window scores by index ranges, the hybrid detector, its persistence, and the isotonic reduction tree."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from flowwatch.operators import fuse, sequence
from flowwatch.operators.detect import GaussianMixtureDetector, HybridDetector, WindowReconstruction
from flowwatch.operators.order import dense_index
from flowwatch.plans import jobs
from flowwatch.sources import flow_files

COLS = ["a", "b"]


@pytest.fixture(scope="module")
def world(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame(rng.normal(size=(240, 2)), columns=COLS)
    pdf["row_id"] = [f"r{i:03d}" for i in range(240)]
    pdf["at"] = rng.permutation(240) // 2
    pdf["y"] = (rng.random(240) < 0.3).astype(int)
    pdf.loc[pdf["y"] == 1, "a"] += 2.5
    return spark.createDataFrame(pdf).persist()


def model(size):
    parts = np.linalg.qr(np.random.default_rng(1).normal(size=(2 * size, 3)))[0]
    return WindowReconstruction(size=size).given(COLS, np.linspace(0, 1, 2 * size), parts, 0.1)


def mixture():
    return GaussianMixtureDetector(k=1).given(COLS, [1.0], [[0.0, 0.0]], [np.eye(2)], 3.0)


@pytest.mark.parametrize(("size", "stride"), [(1, 1), (7, 1), (7, 3), (7, 7), (5, 9), (240, 1), (239, 2), (300, 4)])
def test_ranges_equal_scattered_windows(spark, world, monkeypatch, size, stride):
    monkeypatch.setattr(sequence, "BLOCK", 31)
    m = model(size)
    windows, _, rows, n = sequence.eval_windows(world, COLS, size, stride, "at", "row_id")
    want = {r["row_id"]: r["score"] for r in sequence.scatter_to_rows(
        m.step_errors(windows), rows, n, size, stride).collect()}
    got = m.score_flows(world, stride, "at", "row_id", row_scores={"gmm": mixture().scorer()}).collect()
    assert {r["row_id"]: pytest.approx(r["score"]) for r in got} == want and len(got) == 240
    assert all(r["gmm"] == pytest.approx(np.log(2 * np.pi) + (r["a"] ** 2 + r["b"] ** 2) / 2) for r in got)


def test_hybrid_fits_scores_and_comes_back(spark, world, tmp_path):
    hybrid = HybridDetector(mixture(), model(4), None, "at", "row_id", 2)
    with pytest.raises(RuntimeError):
        hybrid.score(world)
    with pytest.raises(RuntimeError):
        fuse.FusionModel(["gmm", "window"]).save(spark, str(tmp_path / "none"))
    based = hybrid.bases(world)
    for kind, options in (("lr", {}), ("rf", dict(trees=5, depth=3)), ("weighted", {})):
        hybrid.fit_fusion(based, candidates=(kind,), **options)
        want = {r["row_id"]: (r["score"], r["pred"]) for r in hybrid.predict(hybrid.score(world)).collect()}
        path = str(tmp_path / kind)
        hybrid.save(spark, path)
        back = HybridDetector.load(spark, path)
        found = back.predict(back.score(world))
        assert {"gmm", "window", "score", "pred"} <= set(found.columns) and "calibrated_gmm" not in found.columns
        assert {r["row_id"]: (pytest.approx(r["score"]), r["pred"]) for r in found.collect()} == want
    plain = HybridDetector(mixture(), model(4), fuse.FusionModel(
        ["gmm", "window"], bounds={"gmm": (0.0, 2.0), "window": (0.0, 1.0)}, alpha=0.25, threshold=0.4), "at", "row_id")
    plain.save(spark, str(tmp_path / "plain"))
    back = HybridDetector.load(spark, str(tmp_path / "plain"))
    assert (back.fusion.bounds, back.fusion.alpha, back.threshold, back.fusion.learner) == (
        {"gmm": (0.0, 2.0), "window": (0.0, 1.0)}, 0.25, 0.4, None)
    with pytest.raises(TypeError):
        GaussianMixtureDetector.load(spark, str(tmp_path / "plain/fusion/params"))


def test_hybrid_needs_one_set_of_columns():
    with pytest.raises(ValueError):
        HybridDetector(GaussianMixtureDetector(k=1).given(["a"], [1.0], [[0.0]], [np.eye(1)], 1.0), model(3))


def loop_isotonic(points):
    """points: (score, mean, weight), ascending."""
    out = []
    for s, m, w in points:
        out.append([[s], m, w])
        while len(out) > 1 and out[-2][1] >= out[-1][1]:
            b, a = out.pop(), out.pop()
            out.append([a[0] + b[0], (a[1] * a[2] + b[1] * b[2]) / (a[2] + b[2]), a[2] + b[2]])
    return {s: m for group, m, _ in out for s in group}


def test_isotonic_tree_equals_the_loop(spark, monkeypatch):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"s": rng.integers(0, 150, 3000) / 7.0})
    pdf["y"] = (rng.random(3000) < pdf["s"] / 30 + 0.1 * np.sin(pdf["s"])).astype(int)
    spark.conf.set("spark.sql.shuffle.partitions", "20")
    try:
        fitted = fuse.isotonic_fit(spark.createDataFrame(pdf).repartition(5), "s")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    grouped = pdf.groupby("s")["y"].agg(["mean", "size"])
    want = loop_isotonic(list(grouped.itertuples()))
    assert dict(zip(want, fitted.apply(np.array(list(want))), strict=True)) == pytest.approx(want)
    assert fitted.apply(np.array([-5.0, 500.0])).tolist() == [fitted.levels[0], fitted.levels[-1]]
    odd = fuse.isotonic_apply(spark.createDataFrame([(None,), (1.0,)], "s double"), fitted, "s", "p").collect()
    assert odd[0]["p"] is None and 0 <= odd[1]["p"] <= 1
    with pytest.raises(ValueError):
        fuse.isotonic_fit(spark.createDataFrame([], "s double, y int"), "s")


def test_detect_with_the_hybrid(spark, tmp_path):
    rng = np.random.default_rng(9)
    pdf = pd.DataFrame(np.vstack([rng.normal(0, 1, (300, 3)), rng.normal(3, 1, (100, 3))]), columns=["a", "b", "c"])
    pdf["row_id"], pdf["pos"] = [f"r{i:03d}" for i in range(400)], rng.permutation(400)
    pdf["label"] = ["BENIGN"] * 300 + ["DoS"] * 100
    flows = spark.createDataFrame(pdf)
    ready, plan = jobs.preprocess(flows, "row_id", ["a", "b", "c"], keep=["pos"])
    got = jobs.train(ready, [c for c in plan.names if not c.startswith("feat_")], "row_id", "pos", window=4, stride=2,
                     latent=3, mixture=dict(k=1, n_init=1), forest=dict(trees=5), svm=dict(steps=3),
                     learner=dict(candidates=("lr",)))
    out = jobs.detect(flows, plan, got.detectors["hybrid"], "row_id", str(tmp_path / "out"),
                      reference={c: 0.0 for c in got.detectors["hybrid"].cols})
    assert out.count() == 400 and {"gmm", "window", "explain_top1_feature"} <= set(out.columns)
    hits = out.join(flows.select("row_id", "label"), "row_id").groupBy("label").agg(F.avg("pred").alias("r")).collect()
    rates = {r["label"]: r["r"] for r in hits}
    assert rates["DoS"] > 0.7 > 0.3 > rates["BENIGN"]


def test_captures_are_joined_by_name(spark, tmp_path):
    for name, text in (("x.csv", "A,B,Label\n1,2,one\n"), ("y.csv", "B,A,Label\n3,4,two\n"), ("z.csv", "Label,A,C\nthree,5,6\n")):
        (tmp_path / name).write_text(text, encoding="latin-1")
    rows = flow_files.read_flow_csvs(spark, str(tmp_path), ["x.csv", "y.csv", "z.csv"])
    got = {r["Label"]: r for r in rows.collect()}
    assert {k: (v["A"], v["B"], v["C"]) for k, v in got.items()} == {
        "one": (1.0, 2.0, None), "two": (4.0, 3.0, None), "three": (5.0, None, 6.0)}
    assert rows.columns == ["A", "B", "Label", "C", "source_file"]


def test_index_is_made_once(spark, world, monkeypatch):
    from flowwatch.operators.detect import windows
    calls = []
    monkeypatch.setattr(windows, "dense_index", lambda *a, **k: calls.append(a) or dense_index(*a, **k))
    HybridDetector(mixture(), model(4), fuse.FusionModel(
        ["gmm", "window"], bounds={"gmm": (0.0, 2.0), "window": (0.0, 1.0)}), "at", "row_id").score(world).count()
    assert len(calls) == 1

"""Cleaning, features and sources on small frames."""

import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from flowwatch.operators import clean, dist, features, profile, sequence
from flowwatch.operators.detect import GaussianMixtureDetector
from flowwatch.operators.features import FeaturePlan
from flowwatch.plans import jobs
from flowwatch.sources import flow_files


@pytest.fixture
def raw(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({
        " Flow Duration": rng.uniform(1, 100, 90), " Total Fwd Packets": np.arange(90),
        "Flow Bytes/s": rng.uniform(1, 9, 90), "Const": 1.0,
        "Label": ["BENIGN"] * 60 + ["DoS Hulk"] * 30})
    pdf.loc[7, "Flow Bytes/s"] = np.inf
    return spark.createDataFrame(pdf)


def test_raw_flows_are_cleaned(raw):
    # One infinite value in 90 rows is more than 1 %: the column goes.
    out = jobs.clean_flows(raw)
    assert set(out.columns) == {"Flow Duration", "Total Fwd Packets", "Label"}
    assert out.count() == 90


def test_light_gap_is_filled_with_benign_median(spark):
    data = [(float(i), "BENIGN" if i < 150 else "DoS") for i in range(300)] + [(float("nan"), "DoS")]
    df = clean.nonfinite_to_null(spark.createDataFrame(data, "a double, label string"))
    out = clean.impute_or_drop(df, ["a"])
    assert out.filter("a IS NULL").count() == 0
    assert out.filter("a = 74.5").count() == 1


def test_missing_label_and_files(spark, raw, tmp_path):
    with pytest.raises(KeyError):
        clean.strip_column_names(raw.drop("Label"))
    with pytest.raises(FileNotFoundError):
        flow_files.read_flow_csvs(spark, str(tmp_path), ["none.csv"])


def test_read_flow_csvs(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b" Flow Duration,Flow Bytes/s,Label\n1,Infinity,BENIGN\n,,\n2,NaN,Web Attack \x96 XSS\n")
    (tmp_path / "b.csv").write_bytes(b" Flow Duration,Flow Bytes/s,Label\n3,4,BENIGN\n")
    df = flow_files.read_flow_csvs(spark, str(tmp_path), ["a.csv", "b.csv"])
    rows = clean.repair_label_text(clean.strip_column_names(df)).orderBy("Flow Duration").collect()
    assert [r["Label"] for r in rows] == ["BENIGN", "Web Attack - XSS", "BENIGN"]
    assert [r["source_file"] for r in rows] == ["a.csv", "a.csv", "b.csv"]
    assert rows[0]["Flow Bytes/s"] == float("inf")


def test_headerless_default_schema(spark, tmp_path):
    line = ",".join(["1", "tcp", "http", "SF"] + ["0"] * 37 + ["{}", "21"])
    (tmp_path / "KDDTrain+.txt").write_text(line.format("normal") + "\n" + line.format("neptune ") + "\n")
    (tmp_path / "KDDTest+.txt").write_text(line.format(" Normal") + "\n")
    df = flow_files.read_headerless_flows(spark, str(tmp_path))
    assert sorted((r["Label"], r["source_file"]) for r in df.collect()) == [
        ("BENIGN", "KDDTest+"), ("BENIGN", "KDDTrain+"), ("neptune", "KDDTrain+")]
    assert len(df.columns) == 44


def test_scoring_input_lists_missing_columns(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "` b` double, a double")
    assert flow_files.read_scoring_input(df, ["a", "b"]).columns == ["a", "b"]
    with pytest.raises(ValueError, match="zz"):
        flow_files.read_scoring_input(df, ["a", "zz"])


def test_predictions_are_written_and_counted(spark, tmp_path):
    df = spark.createDataFrame([(1, .2, 0), (2, .9, 1)], "id int, score double, pred int")
    for fmt in ("parquet", "csv"):
        got = flow_files.write_predictions(df, str(tmp_path / fmt), fmt=fmt)
        assert (got["rows"], got["flagged"], got["rate"]) == (2, 1, 0.5)
    assert set(spark.read.parquet(str(tmp_path / "parquet")).columns) == {"id", "anomaly_score", "is_attack"}


def nine(spark):
    cols = ["Total Fwd Packets", "Total Backward Packets", "Subflow Fwd Bytes", "Total Length of Bwd Packets",
            "Average Packet Size", "Max Packet Length", "Flow IAT Std", "Flow IAT Mean", "Packet Length Variance"]
    data = [(i, i + 1, 10 * i, 5, 20 + i, 40, 1.5 * i, 2.0, 9.0 * i) for i in range(1, 6)]
    return spark.createDataFrame([tuple(map(float, r)) for r in data], ", ".join(f"`{c}` double" for c in cols))


def test_ratio_formulas(spark):
    r = features.add_ratio_features(nine(spark)).orderBy("Total Fwd Packets").first()
    assert r["feat_fwd_bwd_pkt_ratio"] == pytest.approx(1 / 3)
    assert r["feat_fwd_bwd_byte_ratio"] == pytest.approx(10 / 6)
    assert r["feat_payload_ratio"] == pytest.approx(21 / 41)
    assert r["feat_burst_intensity"] == pytest.approx(1.5 / 3)
    assert r["feat_byte_entropy_approx"] == pytest.approx(9 / (21 ** 2 + 1))


def test_absent_columns_count_as_zero(spark):
    r = features.add_ratio_features(spark.createDataFrame([(4.0,)], "`Total Fwd Packets` double")).first()
    assert r["feat_fwd_bwd_pkt_ratio"] == 4.0 and r["feat_payload_ratio"] == 0.0


def two_columns(spark, n=200):
    return spark.range(n).select("id", (F.col("id") % 101 + 1.0).alias("A"), (F.col("id") % 6).cast("double").alias("B"))


def test_plan_fill_equals_training_median_for_any_batch(spark):
    plan = FeaturePlan().fit(two_columns(spark), ["A", "B"])
    gap = spark.createDataFrame([(1, None, 2.0), (2, 90.0, 2.0)], "id long, A double, B double")
    filled = spark.createDataFrame([(1, plan.medians["A"], 2.0)], "id long, A double, B double")
    want = plan.transform(filled, ["id"]).first()["A"]
    assert plan.transform(gap, ["id"]).filter("id = 1").first()["A"] == want
    assert plan.transform(gap.filter("id = 1"), ["id"]).first()["A"] == want


def test_plan_round_trip(spark, tmp_path):
    df = two_columns(spark)
    plan = FeaturePlan().fit(df, ["A", "B"])
    plan.save(spark, str(tmp_path / "plan"))
    again = FeaturePlan.load(spark, str(tmp_path / "plan"))
    assert again.names == plan.names
    assert again.transform(df, ["id"]).orderBy("id").collect() == plan.transform(df, ["id"]).orderBy("id").collect()
    with pytest.raises(TypeError):
        GaussianMixtureDetector.load(spark, str(tmp_path / "plan"))
    with pytest.raises(RuntimeError):
        FeaturePlan().transform(df)


def test_duplicate_column_is_pruned(spark):
    df = two_columns(spark).withColumn("C", F.col("A") * 2)
    assert features.correlation_prune_later(df, ["A", "B", "C"])[1] == ["C"]
    kept, log = features.correlation_prune_low_variance(df, ["A", "B", "C"])
    assert kept == ["B", "C"] and log[0]["dropped"] == "A"


def test_profile_edges(spark):
    df = spark.createDataFrame([(1.0, None, "a"), (1.0, None, "a")], "x double, z double, label string")
    assert {r["feature"] for r in profile.constant_columns(df, ["x", "z"]).collect()} == {"x", "z"}
    assert profile.duplicate_profile(df).first()["n_duplicates"] == 1
    assert profile.negative_profile(df).count() == 0


def test_bad_timestamps_are_dropped(spark):
    df = spark.createDataFrame([("2017-07-03 08:55:58", 0), ("junk", 1), ("2017-07-03 08:55:01", 1)], "t string, y int")
    assert [tuple(r)[1:] for r in profile.traffic_per_minute(df, "t", F.col("y") == 1).collect()] == [(1, 1)]


def test_robust_covariance_ignores_outliers(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (1000, 2))
    x[:50] += 30
    df = spark.createDataFrame(pd.DataFrame(x, columns=["a", "b"]))
    centre, sigma = dist.robust_covariance(df, ["a", "b"])
    assert np.abs(centre).max() < 0.3 and np.abs(np.diag(sigma) - 1).max() < 0.4


# --- windows -----------------------------------------------------------------------


def ordered(spark, n, d=2):
    return spark.range(n).select(
        "id", F.format_string("%05d", "id").alias("row_id"),
        *[(F.col("id") * d + j).cast("double").alias(f"c{j}") for j in range(d)])


@pytest.mark.parametrize("block", [4, 16_384])
def test_windows_in_order_across_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(sequence, "BLOCK", block)
    monkeypatch.setattr(sequence.halo_frame, "__defaults__", ("idx", block))
    got = sequence.train_windows(ordered(spark, 20), ["c0", "c1"], 5, 3, "id", "row_id").orderBy("window_id").collect()
    assert [r["window_id"] for r in got] == list(range(6))
    for r in got:
        assert [s["x"][0] for s in r["steps"]] == [2.0 * (3 * r["window_id"] + p) for p in range(5)]


def test_too_few_rows(spark):
    with pytest.raises(ValueError):
        sequence.train_windows(ordered(spark, 3), ["c0"], 5, 1, "id", "row_id")
    windows, cover, _, n = sequence.eval_windows(ordered(spark, 3), ["c0"], 5, 1, "id", "row_id")
    (w,) = windows.collect()
    assert n == 3 and [s["x"][0] for s in w["steps"]] == [0.0, 2.0, 4.0, 0.0, 0.0]
    assert sorted(r["pos"] for r in cover.collect()) == [0, 1, 2]


def test_scatter_by_hand(spark):
    rows = ordered(spark, 3).withColumn("idx", F.col("id"))
    errors = spark.createDataFrame([(0, [1.0, 2.0]), (1, [10.0, 20.0])], "window_id long, errors array<double>")
    got = sequence.scatter_to_rows(errors, rows, 3, 2, 1).orderBy("idx").collect()
    assert [r["score"] for r in got] == [1.0, 6.0, 20.0]


def test_uncovered_rows(spark):
    rows = ordered(spark, 5).withColumn("idx", F.col("id"))
    errors = spark.createDataFrame([(0, [1.0, 3.0]), (1, [5.0, 7.0])], "window_id long, errors array<double>")
    got = [r["score"] for r in sequence.scatter_to_rows(errors, rows, 5, 2, 2).orderBy("idx").collect()]
    assert got == [1.0, 3.0, 5.0, 7.0, 4.0]
    whole = spark.createDataFrame([(0, 2.0), (1, 6.0)], "window_id long, error double")
    got = [r["score"] for r in sequence.window_error_to_rows(whole, rows, 2, 2).orderBy("idx").collect()]
    assert got == [2.0, 2.0, 6.0, 6.0, 0.0]


def test_window_labels(spark):
    rows = ordered(spark, 4).withColumn("idx", F.col("id")).withColumn("y", (F.col("id") == 3).cast("int"))
    got = [r["label"] for r in sequence.window_label(rows, 4, 2, 1).orderBy("window_id").collect()]
    assert got == [0, 0, 1]


def test_no_file_of_the_repo_is_large():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for folder, _, files in os.walk(os.path.join(root, "flowwatch")):
        assert all(os.path.getsize(os.path.join(folder, f)) < 1_000_000 for f in files)


def test_pca_equals_numpy(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(0, 1, (400, 4)) @ np.diag([5.0, 2.0, 1.0, 0.1]) + 100.0
    df = spark.createDataFrame(pd.DataFrame(x, columns=list("abcd")))
    model = dist.fit_pca(df, list("abcd"), 2)
    values, vectors = np.linalg.eigh(np.cov(x.T))
    assert np.allclose(model.shares, (values[::-1] / values.sum())[:2])
    assert np.allclose(np.abs(model.parts), np.abs(vectors[:, ::-1][:, :2]))
    shown = dist.pca_project(df, model, list("abcd")).toPandas()
    assert abs(shown["pc1"].mean()) < 1e-9 and shown["pc1"].var() == pytest.approx(values[-1])


def test_ks_of_groups_over_many_ranges(spark):
    """Running gaps joined over the tasks' ranges; ties, a null group, rows without a side and small groups."""
    import numpy as np
    from pyspark.sql import functions as F

    from flowwatch.operators import dist
    rng = np.random.default_rng(8)
    rows, plain = [], {}
    for name, n, step in (("a", 800, 1), (None, 500, 7), ("c", 30, 1)):
        side = rng.random(n) < 0.4
        value = (rng.normal(0, 40, n) + 15 * side) // step * step
        rows += [(name, float(v), bool(s)) for v, s in zip(value, side)] + [(name, float("nan"), True), (name, 1.0, None)]
        at = np.unique(value)
        share = [np.searchsorted(np.sort(value[side == s]), at, "right") / (side == s).sum() for s in (True, False)]
        plain[name] = np.abs(share[0] - share[1]).max(), side.sum(), (~side).sum()
    df = spark.createDataFrame(rows, "name string, v double, s boolean").repartition(5)
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # four ranges
    try:
        out = dist.ks_two_sample(df, "v", F.col("s"), ["name"], least=20)
        got = {r["name"]: r for r in out.collect()}
        assert set(got) == {"a", None} and "MapInArrow" in out._jdf.queryExecution().toString()
        for name, r in got.items():
            assert abs(r["ks"] - plain[name][0]) < 1e-12 and (r["n_a"], r["n_b"]) == tuple(plain[name][1:])
        one = dist.ks_two_sample(df.filter("name = 'a'"), "v", F.col("s")).collect()
        assert len(one) == 1 and abs(one[0]["ks"] - plain["a"][0]) < 1e-12
        assert dist.ks_two_sample(df.filter("false"), "v", F.col("s")).collect() == []
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)

"""Detectors find planted attacks, keep the contract, and survive a round trip."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from flowwatch.operators import explain, fuse, metrics, sequence, split
from flowwatch.operators.detect import (
    CenterDistance, GaussianMixtureDetector, IsolationForest, MahalanobisDetector, OneClassSvm,
    WindowReconstruction, ZScoreMax,
)
from flowwatch.operators.detect.mixture import component_log_density, gmm_select_k, log_density

COLS = [f"f{i}" for i in range(5)]
N_BENIGN, N_ATTACK = 500, 90


@pytest.fixture(scope="module")
def world(spark):
    """Correlated benign rows; each attack leaves them along a random direction of the five columns."""
    rng = np.random.default_rng(31)
    mix = np.linalg.cholesky(0.35 * np.ones((5, 5)) + 0.65 * np.eye(5))
    way = rng.choice([-1.0, 1.0], (N_ATTACK, 5)) * rng.uniform(3.5, 6.0, (N_ATTACK, 5))
    rows = np.concatenate([rng.standard_normal((N_BENIGN, 5)) @ mix.T, rng.standard_normal((N_ATTACK, 5)) @ mix.T + way])
    pdf = pd.DataFrame(rows, columns=COLS).assign(row_id=[f"w{i:05d}" for i in range(len(rows))], pos=range(len(rows)),
                                                  y=[0] * N_BENIGN + [1] * N_ATTACK)
    return spark.createDataFrame(pdf).persist()


MODELS = {
    "zscore": lambda: ZScoreMax(), "mahalanobis": lambda: MahalanobisDetector(),
    "robust": lambda: MahalanobisDetector(robust=True), "centre": lambda: CenterDistance(),
    "gmm_full": lambda: GaussianMixtureDetector(k=2, n_init=1, max_iter=20),
    "gmm_diag": lambda: GaussianMixtureDetector(k=2, cov="diag", n_init=1, max_iter=10),
    "gmm_tied": lambda: GaussianMixtureDetector(k=2, cov="tied", n_init=1, max_iter=10),
    "gmm_spherical": lambda: GaussianMixtureDetector(k=2, cov="spherical", n_init=1, max_iter=10),
    "forest": lambda: IsolationForest(trees=25), "svm": lambda: OneClassSvm(),
}


@pytest.mark.parametrize("name", list(MODELS))
def test_planted_attacks_are_found(spark, world, tmp_path, name):
    model = MODELS[name]().fit(world.filter("y = 0"), COLS)
    row = model.evaluate(world).first()
    assert row["roc_auc"] > 0.9
    assert row["recall"] > 0.6
    model.save(spark, str(tmp_path / name))
    again = type(model).load(spark, str(tmp_path / name))
    a = model.predict(model.score(world)).orderBy("pos").toPandas()
    b = again.predict(again.score(world)).orderBy("pos").toPandas()
    assert np.allclose(a["score"], b["score"]) and (a["pred"] == b["pred"]).all()


def test_unfitted_models_refuse(world):
    for make in MODELS.values():
        with pytest.raises(RuntimeError):
            make().score(world).count()


def test_log_density_by_hand():
    x = np.array([[0.0, 0.0], [1.0, -1.0]])
    w, m, c = np.array([1.0]), np.zeros((1, 2)), np.eye(2)[None]
    assert np.allclose(log_density(x, w, m, c), -np.log(2 * np.pi) - 0.5 * (x ** 2).sum(axis=1))
    assert component_log_density(x, w, m, c).shape == (2, 1)


def test_gmm_threshold_is_a_strict_percentile(world):
    benign = world.filter("y = 0")
    model = GaussianMixtureDetector(k=1, n_init=1, percentile=10).fit(benign, COLS)
    share = model.predict(model.score(benign)).agg(F.avg("pred")).first()[0]
    assert share == pytest.approx(0.10, abs=0.002)


def test_bic_prefers_two_clusters(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(-5, 1, 300), rng.normal(5, 1, 300)])
    df = spark.createDataFrame(pd.DataFrame({"row_id": [str(i) for i in range(600)], "a": x, "b": rng.normal(0, 1, 600)}))
    table = {r["k"]: r for r in gmm_select_k(df, ["a", "b"], ks=(1, 2, 3), n_init=3, max_iter=60).collect()}
    assert table[2]["best_bic"]


def test_window_reconstruction_scores_attack_rows_higher(spark, world, tmp_path):
    model = WindowReconstruction(size=5, latent=6)
    model.fit(sequence.train_windows(world.filter("y = 0"), COLS, 5, 2, "pos", "row_id"), COLS)
    model.calibrate_flows(world.filter("y = 0"), 1, "pos", "row_id")
    scored = model.score_flows(world, 1, "pos", "row_id")
    assert scored.count() == N_BENIGN + N_ATTACK
    assert metrics.roc_auc(scored, "score").first()[0] > 0.9
    model.save(spark, str(tmp_path / "w"))
    again = WindowReconstruction.load(spark, str(tmp_path / "w"))
    assert again.row_threshold == model.row_threshold and again.size == 5


# --- fusion --------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def bases(spark):
    rng = np.random.default_rng(17)
    y = (rng.random(450) < 0.3).astype(int)
    good = np.where(y == 1, rng.gumbel(2.2, 0.8, 450), rng.normal(0, 0.9, 450))
    return spark.createDataFrame(pd.DataFrame({"row_id": [f"b{i}" for i in range(450)], "y": y, "strong": good,
                                               "weak": 0.6 * y + rng.uniform(-1.5, 1.5, 450)})).persist()


def test_calibration_is_monotone_and_bounded(bases):
    model = fuse.isotonic_fit(bases, "strong")
    got = fuse.isotonic_apply(bases, model, "strong", "p").orderBy("strong").toPandas()
    assert (got["p"].diff().dropna() >= -1e-12).all()
    assert got["p"].between(0, 1).all()


def test_meta_learners_and_unknown_name(bases):
    with pytest.raises(KeyError):
        fuse.meta_learner("nope", bases, ["strong", "weak"])
    best, table = fuse.select_meta_learner(bases, ["strong", "weak"], "row_id", trees=10, depth=4)
    rows = {r["candidate"]: r["cv_pr_auc_mean"] for r in table.collect()}
    assert set(rows) == {"rf", "lr", "weighted"}
    assert best.name == max(rows, key=rows.get)
    weights = fuse.learner_weights(fuse.meta_learner("lr", bases, ["strong", "weak"]))
    assert weights[0][1] > weights[1][1] and sum(w[2] for w in weights) == pytest.approx(1.0)


def test_fusion_fits_on_meta_rows_only(bases):
    parts = split.stratified_holdout(bases, "row_id")
    model, _ = fuse.FusionModel.fit(parts.filter("part = 'meta'"), ["strong", "weak"], "row_id", candidates=("lr", "weighted"))
    held = model.predict(parts.filter("part = 'eval'"))
    assert metrics.roc_auc(held, "score").first()[0] > 0.8
    assert held.filter("score < 0 OR score > 1").count() == 0
    with pytest.raises(RuntimeError):
        fuse.FusionModel(["strong", "weak"]).score(bases)


def test_fallback_uses_fitted_range_not_the_batch(bases):
    model = fuse.FusionModel(["strong", "weak"], bounds={"strong": (0.0, 2.0), "weak": (0.0, 1.0)}, alpha=0.5)
    one = bases.limit(1)
    r = model.score(one).first()
    assert r["score"] == pytest.approx(0.5 * r["strong"] / (2 + 1e-8) + 0.5 * r["weak"] / (1 + 1e-8))


# --- explanation and robustness ------------------------------------------------------------------


def test_every_flagged_row_is_explained(spark):
    """Also where a row id comes twice."""
    df = spark.range(1200).select((F.col("id") % 700).cast("string").alias("row_id"), (F.col("id") % 7).cast("double").alias("a"),
                                  F.lit(1.0).alias("b"), F.when(F.col("id") % 2 == 0, -8.0).otherwise(0.5).alias("c"),
                                  F.when(F.col("id") < 900, (F.col("id") % 2 == 0).cast("int")).alias("pred"))
    scorer = lambda d, out: d.withColumn(out, 2 * F.abs("c") - F.col("b"))
    ref = {"a": 3.0, "b": 1.0, "c": 0.5}
    top = explain.counterfactual_attribution(df.filter("pred = 1"), ["a", "b", "c"], scorer, ref).filter("rank = 1")
    assert {(r["feature"], r["contribution"]) for r in top.collect()} == {("c", 15.0)} and top.count() == 450
    out = explain.explain_flagged(df, ["a", "b", "c"], scorer, ref)
    assert out.count() == 1200 and out.filter("explain_top1_feature = 'c'").count() == 450
    assert out.filter("explain_top1_feature IS NOT NULL AND NOT pred <=> 1").count() == 0


def test_changed_score_restores_columns(spark):
    df = spark.createDataFrame([("x", 1.0, 2.0)], "row_id string, a double, b double")
    out = explain.score_changed(df, lambda d, o: d.withColumn(o, F.col("a") + F.col("b")), {"a": F.lit(10.0)}, "s")
    assert out.first().asDict() == {"row_id": "x", "a": 1.0, "b": 2.0, "s": 12.0}


def test_evasion_and_noise(spark, world):
    model = CenterDistance().fit(world.filter("y = 0"), COLS)
    ref = explain.benign_reference(world.filter("y = 0"), COLS)
    ev = explain.mimicry_evasion(world.filter("y = 1"), COLS, model.score, ref, model.threshold).orderBy("alpha").collect()
    assert ev[0]["detection_rate"] > 0.9 and ev[-1]["detection_rate"] == 0.0
    nz = explain.noise_fpr(world.filter("y = 0"), COLS, model.score, model.threshold, sigmas=(0.05, 1.0)).orderBy("sigma").collect()
    assert nz[0]["fpr_clean"] == pytest.approx(0.05, abs=0.01)
    assert nz[1]["fpr_mean"] > nz[0]["fpr_mean"]
    again = explain.noise_fpr(world.filter("y = 0").repartition(7), COLS, model.score, model.threshold, sigmas=(0.05, 1.0))
    assert [tuple(r) for r in again.orderBy("sigma").collect()] == [tuple(r) for r in nz]


def test_noise_is_standard_normal(spark):
    z = spark.range(20_000).select(explain.normal_noise(F.col("id").cast("string")).alias("z")).agg(
        F.avg("z").alias("m"), F.stddev_pop("z").alias("s")).first()
    assert abs(z["m"]) < 0.03 and abs(z["s"] - 1) < 0.03


def test_permutation_importance_ranks_the_used_column(bases):
    got = explain.permutation_importance(bases, ["strong", "weak"], lambda d, o: d.withColumn(o, F.col("strong") * 1.0), n_repeats=2)
    rows = {r["feature"]: r["importance"] for r in got.collect()}
    assert rows["strong"] > 0.1 and rows["weak"] == pytest.approx(0.0)


def test_variants_in_one_matrix_call_equal_chained_scorers(spark, world):
    model = GaussianMixtureDetector(k=2, n_init=1, max_iter=5).fit(world.filter("y = 0"), COLS)
    chained = lambda d, o: model.score(d, o)  # hides the matrix
    assert explain.matrix_scorer(model.score) and explain.matrix_scorer(chained) is None
    ref = explain.benign_reference(world.filter("y = 0"), COLS)
    df = model.predict(model.score(world)).drop("score").withColumn("pred", F.when(F.col("row_id") != "7", F.col("pred")))
    shown = [sorted(tuple(map(str, r)) for r in explain.explain_flagged(df, COLS, f, ref).select(
        "row_id", "pred", "explain_top1_feature", F.round("explain_top1_contrib", 6), F.round("explain_top2_contrib", 6)).collect())
        for f in (model.score, chained)]
    assert shown[0] == shown[1] and any(r[2] != "None" for r in shown[0]) and any(r[2] == "None" for r in shown[0])
    benign, attacks = world.filter("y = 0"), world.filter("y = 1")
    for one, other in zip(
            (explain.noise_fpr(benign, COLS, model.score, model.threshold, (0.1, 1.0), 2), explain.mimicry_evasion(attacks, COLS, model.score, ref, 5.0)),
            (explain.noise_fpr(benign, COLS, chained, model.threshold, (0.1, 1.0), 2), explain.mimicry_evasion(attacks, COLS, chained, ref, 5.0)),
            strict=True):
        assert [list(r) for r in one.orderBy(one.columns[0]).collect()] == [pytest.approx(list(r)) for r in other.orderBy(one.columns[0]).collect()]
    plan = explain.noise_fpr(benign, COLS, model.score, 1.0, (0.1, 1.0), 2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_noise_of_a_batch_equals_the_expression(spark):
    rows = spark.createDataFrame([(f"r{i}" if i % 7 else None, float(i)) for i in range(200)], "row_id string, x double")
    made = explain.with_normal_noise(rows, "row_id", ["42:0:1:x:", "é:"], "_n").select(
        "row_id", "x", "_n", *[explain.normal_noise(F.concat(F.lit(p), F.col("row_id"))).alias(f"w{k}") for k, p in enumerate(["42:0:1:x:", "é:"])])
    got = made.collect()
    assert len(got) == 200 and sum(r["row_id"] is None for r in got) == 29
    for r in got:
        if r["row_id"] is None:
            assert r["_n"] is None
        else:
            assert r["_n"] == pytest.approx([r["w0"], r["w1"]], abs=1e-9)


def test_permutations_are_joined_at_once(spark, bases, monkeypatch):
    """The ranked scores of all repeats come from one written table, which the ranking reads without a join."""
    seen = []
    ranking = explain.mixed_ranking
    monkeypatch.setattr(explain, "mixed_ranking", lambda df, *a, **k: seen.append(df) or ranking(df, *a, **k))
    explain.permutation_importance(bases, ["strong", "weak"], lambda d, o: d.withColumn(o, F.col("strong") * 1.0), n_repeats=3).collect()
    assert len(seen) == 1 and "Join" not in seen[0]._jdf.queryExecution().optimizedPlan().toString()


def test_forest_scores_are_walks_of_its_trees():
    """Steps as deep as the deepest leaf, a missing value goes right, a tree may be a single leaf."""
    import numpy as np

    from flowwatch.operators.detect import forest
    rng = np.random.default_rng(9)
    x = rng.random((300, 3))
    trees = [forest.grow(t, x[:n], np.arange(3), 6, rng) for t, n in enumerate((200, 1, 40))]
    model = forest.IsolationForest(trees=3)
    model.nodes, model.used, model.offset, model.threshold = np.vstack([t.to_numpy(float) for t in trees]), 200, 0.1, 0.0
    x[::7, 1] = np.nan
    want = []
    for row in x:
        total = 0.0
        for t in trees:
            node = t.iloc[0]
            while node.feature >= 0:
                node = t.iloc[int(node.left if row[int(node.feature)] <= node.cut else node.right)]
            total += node.length
        want.append(2.0 ** (-total / 3 / forest.expected_path(200)) - 0.1)
    assert np.allclose(model.scorer()(x), want, rtol=0, atol=1e-12)
    depths = [forest._depth(t["feature"].to_numpy() >= 0, t[["left", "right"]].to_numpy(int).ravel()) for t in trees]
    assert depths[1] == 0 and max(depths) <= 6


def test_grid_search_shares_fits_and_equals_single_models(world):
    """Combinations that differ in the contamination only share a forest; every row equals the model fitted on its own."""
    from flowwatch.operators.detect.search import grid_search
    made = []

    def make(**kw):
        made.append(kw)
        return IsolationForest(**kw)
    fits, grow = [], IsolationForest._grow
    IsolationForest._grow = lambda self, *a: fits.append(self.trees) or grow(self, *a)
    try:
        train = world.filter("y = 0")
        found = grid_search(make, {"trees": [5, 8], "contamination": [0.05, 0.2]}, train, world, COLS).collect()
        assert len(found) == 4 and sorted(fits) == [5, 8]
    finally:
        IsolationForest._grow = grow
    for r in found:
        alone = IsolationForest(trees=int(r["trees"]), contamination=float(r["contamination"])).fit(train, COLS).evaluate(world).first()
        assert [r[c] for c in ("precision", "recall", "f1", "roc_auc")] == pytest.approx(
            [alone[c] for c in ("precision", "recall", "f1", "roc_auc")], abs=1e-12)


def test_grid_search_query_tries_the_whole_published_grid(spark, monkeypatch):
    from flowwatch.plans import detector_queries, registry
    seen = []

    class Stop(Exception):
        pass

    def catch(make, grid, *rest, **kw):
        seen.append(grid)
        raise Stop
    monkeypatch.setattr(detector_queries, "grid_search", catch)
    monkeypatch.setattr(detector_queries, "split_flows", lambda *a: [type("F", (), {"select": lambda self, *c: self})()] * 2)
    with pytest.raises(Stop):
        registry.QUERIES["grid_search"](spark, "")
    assert {k: len(v) for k, v in seen[0].items()} == {"trees": 4, "contamination": 5, "max_features": 3}
    assert min(seen[0]["trees"]) == 50

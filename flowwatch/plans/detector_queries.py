"""Queries of the detectors, and the flagship query."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from flowwatch.operators import clean, features, fuse, metrics, sequence, split
from flowwatch.operators.detect import (
    CenterDistance, GaussianMixtureDetector, HybridDetector, IsolationForest, OneClassSvm, WindowReconstruction, ZScoreMax,
)
from flowwatch.operators.detect.mixture import gmm_covariance_compare, gmm_select_k
from flowwatch.operators.detect.search import external_model_score, grid_search, score_in_chunks
from flowwatch.operators.detect.windows import flattened
from flowwatch.plans.catalog import query, rounded
from flowwatch.plans.split_queries import H42
from flowwatch.sources.tables import BASE, FLOWS, VECTOR_DIMS, VECTORS, flows, vectors, with_views

UNIT = {"quantity": 50.0, "price": 105000.0, "discount": 0.1, "tax": 0.08}


def unit_flows(spark, d):
    """Base features on comparable scales."""
    f = flows(spark, d)
    return f.select("row_id", "ship_date", "label", "y", *[(F.col(c) / s).alias(c) for c, s in UNIT.items()])


def split_flows(spark, d):
    s = split.one_class_split(unit_flows(spark, d).drop("y"), "row_id")
    return s.filter("split = 'train'"), s.filter("split = 'test'")


FLAG_COLS = ["quantity", "price", "discount", "tax", "net_price"]


def _flagship_sql() -> str:
    cleaned = "cleaned AS (SELECT row_id, label, y, " + ", ".join(FLAG_COLS) + " FROM flows)"
    parts = f"""parts AS (SELECT *, CASE WHEN label = 'BENIGN' AND row_number() OVER (PARTITION BY label ORDER BY {H42})
      > greatest(1, round((SELECT count(*) FROM flows WHERE label = 'BENIGN') * 0.2)) THEN 'train' ELSE 'test' END AS split FROM cleaned)"""
    fit = "fit AS (SELECT " + ", ".join(
        f"quantile_cont({c}, 0.5) AS {c}_m, quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) AS {c}_w" for c in FLAG_COLS
    ) + " FROM parts WHERE split = 'train')"
    scaled = "scaled AS (SELECT row_id, label, split, " + ", ".join(
        f"({c} - {c}_m) / {c}_w AS {c}" for c in FLAG_COLS) + " FROM parts, fit)"
    mom = "mom AS (SELECT " + ", ".join(
        f"avg({c}) AS {c}_a, stddev_pop({c}) AS {c}_s" for c in FLAG_COLS) + " FROM scaled WHERE split = 'train')"
    z = "greatest(" + ", ".join(f"abs(({c} - {c}_a) / ({c}_s + 1e-12))" for c in FLAG_COLS) + ")"
    score = f"zed AS (SELECT label, split, {z} AS score FROM scaled, mom)"
    cut = "cut AS (SELECT quantile_cont(score, 0.95) AS t FROM zed WHERE split = 'train')"
    return with_views(FLOWS, cleaned, parts, fit, scaled, mom, score, cut) + """
SELECT label, count(*) AS total, CAST(sum(CASE WHEN score > t THEN 1 ELSE 0 END) AS BIGINT) AS detected,
  CAST(sum(CASE WHEN score <= t THEN 1 ELSE 0 END) AS BIGINT) AS missed,
  round(100.0 * sum(CASE WHEN score > t THEN 1 ELSE 0 END) / count(*), 6) AS rate_pct
FROM zed, cut WHERE split = 'test' AND label <> 'BENIGN' GROUP BY label"""


@query("flagship", _flagship_sql())
def flagship(spark, d):
    """Clean, split, scale on benign rows, score, cut at 5 % benign alarms, detection rate by label."""
    f = clean.nonfinite_to_null(flows(spark, d).select("row_id", "label", *FLAG_COLS))
    parts = split.one_class_split(f, "row_id")
    train = parts.filter("split = 'train'")
    scaling = features.fit_robust_scaler(train, FLAG_COLS)
    scaled = features.robust_scale(parts, scaling)
    train = scaled.filter("split = 'train'")
    scored = ZScoreMax().fit(train, FLAG_COLS).score(scaled)
    cut = fuse.percentile_threshold(scored.filter("split = 'train'"), "score", 95)
    flagged = fuse.flag_above(scored.filter("split = 'test'"), "score", cut)
    return rounded(metrics.detection_rate_by_label(flagged))


ZSQL = "greatest(" + ", ".join(
    f"abs(({c} - (SELECT avg({c}) FROM flows WHERE label = 'BENIGN')) / ((SELECT stddev_pop({c}) FROM flows WHERE label = 'BENIGN') + 1e-12))"
    for c in BASE) + ")"


@query("zscore_max", with_views(FLOWS) + f"SELECT row_id, round({ZSQL}, 6) AS score FROM flows")
def _(spark, d):
    f = flows(spark, d).select("row_id", "label", *BASE)
    model = ZScoreMax().fit(f.filter("label = 'BENIGN'"), BASE)
    return rounded(model.score(f).select("row_id", "score"))


@query("isolation_forest")
def _(spark, d):
    train, test = split_flows(spark, d)
    model = IsolationForest().fit(train, BASE)
    return rounded(model.predict(model.score(test)).select("row_id", "label", "score", "pred"))


@query("one_class_svm")
def _(spark, d):
    train, test = split_flows(spark, d)
    model = OneClassSvm(gamma=1.0).fit(train, BASE)
    return rounded(model.predict(model.score(test)).select("row_id", "label", "score", "pred"))


@query("gmm_fit")
def _(spark, d):
    train, _ = split_flows(spark, d)
    model = GaussianMixtureDetector(k=3, n_init=2, max_iter=20).fit(train, BASE)
    rows = [(k, float(w), [float(v) for v in m], float(model.threshold))
            for k, (w, m) in enumerate(zip(model.weights, model.means))]
    return rounded(spark.createDataFrame(rows, "component int, weight double, mean array<double>, threshold double"))


MIX = dict(weights=[0.6, 0.4], means=[[0.3, 0.3], [0.7, 0.6]], covs=[[[0.04, 0], [0, 0.05]], [[0.02, 0], [0, 0.03]]])
DENSITY = " + ".join(
    f"CAST({w} AS DOUBLE) / (2 * pi() * sqrt(CAST({c[0][0]} AS DOUBLE) * {c[1][1]})) * exp(-0.5 * (pow(quantity / 50.0 - {m[0]}, 2) / {c[0][0]} + pow(price / 105000.0 - {m[1]}, 2) / {c[1][1]}))"
    for w, m, c in zip(*MIX.values()))


def known_mixture():
    return GaussianMixtureDetector(k=2).given(["quantity", "price"], threshold=0.5, **MIX)


@query("gmm_score", with_views(FLOWS) + f"SELECT row_id, round(-ln({DENSITY}), 6) AS score FROM flows")
def _(spark, d):
    return rounded(known_mixture().score(unit_flows(spark, d)).select("row_id", "score"))


@query("gmm_predict", with_views(FLOWS) + f"""
SELECT label, count(*) AS n, CAST(sum(CASE WHEN -ln({DENSITY}) > 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS flagged FROM flows GROUP BY label""")
def _(spark, d):
    return known_mixture().predict(unit_flows(spark, d)).groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), F.sum("pred").alias("flagged"))


@query("gmm_covariance_compare")
def _(spark, d):
    train, test = split_flows(spark, d)
    return rounded(gmm_covariance_compare(train, test, BASE, k=3, n_init=1, max_iter=10), 4)


@query("gmm_select_k")
def _(spark, d):
    train, _ = split_flows(spark, d)
    return rounded(gmm_select_k(train, BASE, ks=(1, 2, 3), n_init=1, max_iter=10), 4)


@query("window_reconstruction")
def _(spark, d):
    """Fitted on windows of benign training rows; every test row is scored and flagged."""
    train, test = split_flows(spark, d)
    cols = ["quantity", "price"]
    windows = sequence.train_windows(train, cols, 10, 5, "ship_date", "row_id")
    model = WindowReconstruction(size=10, latent=8).fit(windows, cols)
    cut = model.calibrate_flows(train, 5, "ship_date", "row_id")
    scored = model.score_flows(test, 5, "ship_date", "row_id")
    return rounded(fuse.flag_above(scored, "score", cut).select("row_id", "label", "score", "pred"))


TEST_ROWS = f"""parts AS (SELECT *, CASE WHEN label = 'BENIGN' AND row_number() OVER (PARTITION BY label ORDER BY {H42})
  > greatest(1, round((SELECT count(*) FROM flows WHERE label = 'BENIGN') * 0.2)) THEN 'train' ELSE 'test' END AS split FROM flows),
placed AS (SELECT row_id, label, split, quantity / 50.0 AS x,
  row_number() OVER (PARTITION BY split ORDER BY ship_date, row_id) - 1 AS idx, count(*) OVER (PARTITION BY split) AS n FROM parts)"""
PAIR_SQL = """
, pairs AS (SELECT split, idx // 2 AS w, n, max(CASE WHEN idx % 2 = 0 THEN x END) AS a, max(CASE WHEN idx % 2 = 1 THEN x END) AS b
  FROM placed GROUP BY split, idx // 2, n HAVING count(*) = 2),
fit AS (SELECT avg(a) AS ma, avg(b) AS mb, avg(a * a) - avg(a) * avg(a) AS saa, avg(b * b) - avg(b) * avg(b) AS sbb,
  avg(a * b) - avg(a) * avg(b) AS sab FROM pairs WHERE split = 'train'),
turn AS (SELECT ma, mb, 0.5 * atan2(2 * sab, saa - sbb) AS t FROM fit),
rest AS (SELECT split, w, power(-sin(t) * (a - ma) + cos(t) * (b - mb), 2) AS r, t FROM pairs, turn),
covered AS (SELECT p.row_id, p.split, p.label, r.r * CASE WHEN idx % 2 = 0 THEN power(sin(t), 2) ELSE power(cos(t), 2) END AS e
  FROM placed p LEFT JOIN rest r ON r.split = p.split AND r.w = p.idx // 2),
filled AS (SELECT row_id, split, label, coalesce(e, (SELECT avg(e) FROM covered c WHERE c.split = covered.split)) AS score FROM covered)
SELECT row_id, label, round(score, 6) AS score,
  CASE WHEN score > (SELECT quantile_cont(score, 0.95) FROM filled WHERE split = 'train') THEN 1 ELSE 0 END AS pred
FROM filled WHERE split = 'test'"""


@query("window_reconstruction_pairs", with_views(FLOWS, TEST_ROWS) + PAIR_SQL.replace("\n, pairs", ", pairs", 1))
def _(spark, d):
    """Windows of two rows and one component, whose direction has a closed form; test rows are scored."""
    train, test = split_flows(spark, d)
    model = WindowReconstruction(size=2, latent=1).fit(
        sequence.train_windows(train, ["quantity"], 2, 2, "ship_date", "row_id"), ["quantity"])
    cut = model.calibrate_flows(train, 2, "ship_date", "row_id")
    scored = model.score_flows(test.select("row_id", "label", "ship_date", "quantity"), 2, "ship_date", "row_id")
    return rounded(fuse.flag_above(scored, "score", cut).select("row_id", "label", "score", "pred"))


def known_windows(size: int = 10) -> WindowReconstruction:
    """Keeps every first feature, so only the second one is reconstructed from its mean."""
    parts = np.zeros((size * 2, size))
    parts[::2] = np.eye(size)
    return WindowReconstruction(size=size).given(["quantity", "price"], np.tile([0.0, 0.5], size), parts, 0.0)


WINDOW_SCORES = """r AS (SELECT row_id, label, quantity, price, power(price / 105000.0 - 0.5, 2) / 2 AS e,
  row_number() OVER (ORDER BY ship_date, row_id) - 1 AS idx, count(*) OVER () AS n FROM flows),
c AS (SELECT *, CASE WHEN idx < (n - 10) // 7 * 7 + 10 THEN e END AS covered FROM r)"""


@query("score_flows", with_views(FLOWS, WINDOW_SCORES) + """
SELECT row_id, round(coalesce(covered, (SELECT avg(covered) FROM c)), 6) AS score FROM c""")
def _(spark, d):
    return rounded(known_windows().score_flows(unit_flows(spark, d), 7, "ship_date", "row_id").select("row_id", "score"))


def known_hybrid() -> HybridDetector:
    fusion = fuse.FusionModel(["gmm", "window"], bounds={"gmm": (-1.0, 3.0), "window": (0.0, 0.1)})
    return HybridDetector(known_mixture(), known_windows(), fusion, "ship_date", "row_id", 7)


@query("detect_hybrid", with_views(FLOWS, WINDOW_SCORES) + f"""
SELECT row_id, label, round(gmm, 6) AS gmm, round("window", 6) AS "window", round(score, 6) AS score,
  CASE WHEN score >= 0.5 THEN 1 ELSE 0 END AS pred FROM (
  SELECT *, 0.7 * (gmm + 1.0) / (4.0 + 1e-8) + (1.0 - 0.7) * "window" / (0.1 + 1e-8) AS score FROM (
    SELECT row_id, label, -ln({DENSITY}) AS gmm, coalesce(covered, (SELECT avg(covered) FROM c)) AS "window" FROM c))""")
def _(spark, d):
    """Mixture, windows and fusion with given parameters, from one index of the new rows."""
    model = known_hybrid()
    found = model.predict(model.score(unit_flows(spark, d)))
    return rounded(found.select("row_id", "label", "gmm", "window", "score", "pred"))


@query("score_in_chunks", with_views(FLOWS) + """
SELECT (idx - 1) // 10 AS window_id, round(sum(quantity / 50.0), 6) AS score FROM (
  SELECT quantity, row_number() OVER (ORDER BY ship_date, row_id) AS idx, count(*) OVER () AS n FROM flows) 
WHERE idx <= n // 10 * 10 GROUP BY 1""")
def _(spark, d):
    windows, _, _, _ = sequence.eval_windows(unit_flows(spark, d), ["quantity"], 10, 10, "ship_date", "row_id")
    return rounded(score_in_chunks(flattened(windows), lambda p: pd.Series([float(np.sum(v)) for v in p["flat"]])))


DIMS = [f"x{i}" for i in range(VECTOR_DIMS)]
LINEAR = [(-1) ** i / (i + 2) for i in range(VECTOR_DIMS)]
CENTRE = " + ".join(f"pow({c} - (SELECT avg({c}) FROM vectors WHERE y = 0), 2)" for c in DIMS)


@query("center_distance", with_views(VECTORS) + f"""
, s AS (SELECT vec_id, y, {CENTRE} AS score FROM vectors)
SELECT vec_id, round(score, 6) AS score, CASE WHEN score > (SELECT quantile_cont(score, 0.95) FROM s WHERE y = 0) THEN 1 ELSE 0 END AS pred
FROM s""".replace("\n, s", ", s", 1))
def _(spark, d):
    v = vectors(spark, d)
    model = CenterDistance().fit(v.filter("y = 0"), DIMS)
    return rounded(model.predict(model.score(v)).select("vec_id", "score", "pred"))


def _linear_model():
    def predict(x: np.ndarray) -> np.ndarray:
        return x @ np.array(LINEAR)
    return predict


@query("external_model_score", with_views(VECTORS) + f"""
SELECT vec_id, round({" + ".join(f"x{i} * CAST({w!r} AS DOUBLE)" for i, w in enumerate(LINEAR))}, 6) AS score FROM vectors""")
def _(spark, d):
    v = vectors(spark, d)
    return rounded(external_model_score(v, DIMS, _linear_model).select("vec_id", "score"))


@query("grid_search")
def _(spark, d):
    """All 60 forests of the published search."""
    train, test = split_flows(spark, d)
    found = grid_search(IsolationForest, {
        "trees": [50, 100, 200, 300], "contamination": [0.01, 0.03, 0.05, 0.1, 0.15], "max_features": [0.5, 0.7, 1.0]},
        train.select("row_id", *BASE), test.select("y", *BASE), BASE)
    return rounded(found.drop("fit_seconds", "score_seconds"), 4)

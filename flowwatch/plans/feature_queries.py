"""Queries of feature engineering and distribution statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowwatch.operators import clean, dist, features
from flowwatch.operators.quantile import exact_percentiles
from flowwatch.plans.catalog import query, rounded
from flowwatch.plans.profile_queries import GAPS, per_column
from flowwatch.sources.tables import (
    BASE, FLOWS, PACKETS, SCORED, VECTOR_DIMS, flows, packet_flows, scored, vectors, with_views,
)

BENIGN = "label = 'BENIGN'"
CAPPED = ["price", "step_rate"]


def gaps(spark, d):
    return clean.nonfinite_to_null(flows(spark, d))


COMPLETE = f"complete AS (SELECT * FROM gaps WHERE {BENIGN} AND " + " AND ".join(f"{c} IS NOT NULL" for c in CAPPED) + ")"
CAP_SQL = "caps AS (" + "SELECT " + ", ".join(
    f"quantile_cont({c}, 0.01) AS {c}_lo, quantile_cont({c}, 0.99) AS {c}_hi" for c in CAPPED) + " FROM complete)"


@query("fit_caps", with_views(FLOWS, GAPS, COMPLETE, CAP_SQL) + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS feature, round({c}_lo, 6) AS cap_lo, round({c}_hi, 6) AS cap_hi FROM caps" for c in CAPPED))
def _(spark, d):
    caps = features.fit_caps(gaps(spark, d).filter(BENIGN), CAPPED)
    return rounded(spark.createDataFrame(
        [(c, *v) for c, v in caps.items()], "feature string, cap_lo double, cap_hi double"))


def clip_sql(c: str) -> str:
    return f"CASE WHEN {c} IS NOT NULL THEN least(greatest({c}, (SELECT {c}_lo FROM caps)), (SELECT {c}_hi FROM caps)) END"


@query("apply_caps", with_views(FLOWS, GAPS, COMPLETE, CAP_SQL)
       + "SELECT row_id, " + ", ".join(f"round({clip_sql(c)}, 6) AS {c}" for c in CAPPED) + " FROM gaps")
def _(spark, d):
    g = gaps(spark, d).select("row_id", "label", *CAPPED)
    caps = features.fit_caps(g.filter(BENIGN), CAPPED)
    return rounded(features.apply_caps(g, caps).drop("label"))


MASKED = ["quantity", "price", "discount", "step_rate"]
MASK_COMPLETE = f"complete AS (SELECT * FROM gaps WHERE {BENIGN} AND " + " AND ".join(f"{c} IS NOT NULL" for c in MASKED) + ")"
MASK_CAPS = "caps AS (SELECT " + ", ".join(
    f"quantile_cont({c}, 0.01) AS {c}_lo, quantile_cont({c}, 0.99) AS {c}_hi" for c in MASKED) + " FROM complete)"


@query("fit_skew_mask", with_views(FLOWS, GAPS, MASK_COMPLETE, MASK_CAPS) + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS feature, round(skewness({clip_sql(c)}), 5) AS skew, abs(skewness({clip_sql(c)})) > 1.0 AS logged FROM complete"
    for c in MASKED))
def _(spark, d):
    complete = gaps(spark, d).filter(BENIGN).select(*MASKED).dropna()
    capped = features.apply_caps(complete, features.fit_caps(complete, MASKED))
    skews = features.column_skews(capped, MASKED)
    logged = features.fit_skew_mask(capped, MASKED)
    return rounded(spark.createDataFrame(
        [(c, skews[c], c in logged) for c in MASKED], "feature string, skew double, logged boolean"), 5)


RATIO_SQL = """ratios AS (SELECT *, fwd / (bwd + 1) AS r1, sub_bytes / (bwd_bytes + 1) AS r2, avg_size / (max_len + 1) AS r3,
  iat_std / (iat_mean + 1) AS r4, len_var / (avg_size * avg_size + 1) AS r5 FROM packets)"""
RATIO_NAMES = [n for n, *_ in features.RATIO_FEATURES]


@query("add_ratio_features", with_views(PACKETS, RATIO_SQL) + "SELECT row_id, " + ", ".join(
    f"r{i + 1} AS {n}" for i, n in enumerate(RATIO_NAMES)) + " FROM ratios")
def _(spark, d):
    return features.add_ratio_features(packet_flows(spark, d)).select("row_id", *RATIO_NAMES)


WIDE_SQL = {
    "feat_fwd_bwd_pkt_ratio": "fwd / (bwd + 1)",
    "feat_fwd_bwd_byte_ratio": "fwd_bytes / (bwd_bytes + 1)",
    "feat_payload_ratio": "(fwd_bytes + bwd_bytes) / (fwd + bwd + fwd_bytes + 1)",
    "feat_iat_cv": "iat_std / (iat_mean + CAST(1e-9 AS DOUBLE))",
    "feat_burst_intensity": "max_len / (len_mean + 1)",
    "feat_byte_entropy_approx": "(bwd_bytes + fwd_bytes) / (len_std + 1)",
    "feat_inter_Flow_IAT_Max_x_Flow_Duration": "iat_max * duration",
    "feat_inter_Flow_IAT_Max_div_Flow_Duration": "iat_max / (duration + 1)",
    "feat_inter_Fwd_IAT_Max_x_Flow_IAT_Max": "fwd_iat_max * iat_max",
    "feat_inter_Fwd_IAT_Max_div_Flow_IAT_Max": "fwd_iat_max / (iat_max + 1)",
    "feat_inter_Flow_IAT_Max_x_Fwd_Header_Length": "iat_max * header",
    "feat_inter_Flow_IAT_Max_div_Fwd_Header_Length": "iat_max / (header + 1)",
}


@query("add_flow_ratio_features", with_views(PACKETS) + "SELECT row_id, " + ", ".join(
    f'{e} AS "{n}"' for n, e in WIDE_SQL.items()) + " FROM packets")
def _(spark, d):
    return features.add_flow_ratio_features(packet_flows(spark, d)).select("row_id", *WIDE_SQL)


@query("apply_log", with_views(FLOWS, GAPS) + """
SELECT row_id, CASE WHEN step_rate IS NOT NULL THEN round(ln(1 + greatest(step_rate, 0)), 6) END AS step_rate,
  price, round(ln(1 + greatest(quantity * 2.0, 0)), 6) AS feat_double FROM gaps""")
def _(spark, d):
    g = gaps(spark, d).select("row_id", "step_rate", "price", (F.col("quantity") * 2.0).alias("feat_double"))
    return rounded(features.apply_log(g, ["step_rate"]))


@query("log_with_shift", """
WITH t AS (SELECT c_acctbal AS bal FROM customer WHERE c_nationkey <> 3),
s AS (SELECT greatest(0, -min(bal) + 1e-9) AS shift FROM t)
SELECT 'c_acctbal' AS feature, round(skewness(bal), 5) AS skew_before, round(skewness(ln(1 + greatest(bal + shift, 0))), 5) AS skew_after,
  round(any_value(shift), 6) AS shift FROM t, s""")
def _(spark, d):
    c = spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", "c_nationkey", "c_acctbal")
    _, report = features.log_with_shift(c, c.filter("c_nationkey <> 3"), ["c_acctbal"])
    return rounded(report, 5, shift=6)


SCALED = ["quantity", "price", "discount"]
SCALE_SQL = "fit AS (SELECT " + ", ".join(
    f"quantile_cont({c}, 0.5) AS {c}_m, quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) AS {c}_w" for c in SCALED
) + f" FROM flows WHERE {BENIGN})"
ROBUST = {c: f"({c} - (SELECT {c}_m FROM fit)) / (SELECT CASE WHEN {c}_w = 0 THEN 1 ELSE {c}_w END FROM fit)" for c in SCALED}


@query("robust_scale", with_views(FLOWS, SCALE_SQL) + "SELECT row_id, " + ", ".join(
    f"round({e}, 6) AS {c}" for c, e in ROBUST.items()) + " FROM flows")
def _(spark, d):
    f = flows(spark, d).select("row_id", "label", *SCALED)
    return rounded(features.robust_scale(f, features.fit_robust_scaler(f.filter(BENIGN), SCALED)).drop("label"))


@query("fit_robust_scaler", with_views(FLOWS, SCALE_SQL) + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS feature, round({c}_m, 6) AS centre, round({c}_w, 6) AS width FROM fit" for c in SCALED))
def _(spark, d):
    f = flows(spark, d).filter(BENIGN)
    return rounded(spark.createDataFrame(
        [(c, *v) for c, v in features.fit_robust_scaler(f, SCALED).items()],
        "feature string, centre double, width double"))


@query("scaling_effect_table", with_views(FLOWS, SCALE_SQL) + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS feature, round(avg({c}), 4) AS mean_before, round(stddev_pop({c}), 4) AS std_before, "
    f"round(avg({e}), 4) AS mean_after, round(stddev_pop({e}), 4) AS std_after FROM flows" for c, e in ROBUST.items()))
def _(spark, d):
    f = flows(spark, d).select("label", *SCALED)
    after = features.robust_scale(f, features.fit_robust_scaler(f.filter(BENIGN), SCALED))
    return rounded(features.scaling_effect_table(f, after, SCALED), 4)


@query("standardise_benign", with_views(FLOWS) + "SELECT row_id, " + ", ".join(
    f"round(({c} - (SELECT avg({c}) FROM flows WHERE {BENIGN})) / (SELECT stddev_pop({c}) FROM flows WHERE {BENIGN}), 6) AS {c}"
    for c in SCALED) + " FROM flows")
def _(spark, d):
    f = flows(spark, d).select("row_id", "label", *SCALED)
    return rounded(features.standardise_benign(f, f.filter(BENIGN), SCALED).drop("label"))


FILLED = ["step_rate", "tax_rate"]


@query("serving_impute", with_views(FLOWS, GAPS) + "SELECT row_id, " + ", ".join(
    f"round(coalesce({c}, (SELECT quantile_cont({c}, 0.5) FROM gaps WHERE {BENIGN} AND origin = 'F')), 6) AS {c}"
    for c in FILLED) + " FROM gaps WHERE origin = 'O'")
def _(spark, d):
    f = flows(spark, d).select("row_id", "label", "origin", *FILLED)
    train = clean.nonfinite_to_null(f.filter(BENIGN).filter("origin = 'F'"))
    fill = {c: v[0] for c, v in exact_percentiles(train, FILLED, [0.5]).items()}
    return rounded(features.serving_impute(f.filter("origin = 'O'").select("row_id", *FILLED), fill))


@query("residual_nonfinite_impute", with_views(FLOWS, GAPS) + f"""
SELECT row_id, round(coalesce(tax_rate * 2.0, (SELECT quantile_cont(tax_rate * 2.0, 0.5) FROM gaps WHERE {BENIGN})), 5) AS feat_tax FROM gaps""")
def _(spark, d):
    f = flows(spark, d).select("row_id", "label", (F.col("tax_rate") * 2.0).alias("feat_tax"))
    return rounded(features.residual_nonfinite_impute(f, f.filter(BENIGN), ["feat_tax"]).drop("label"), 5)


PRUNE = ["quantity", "price", "net_price", "discount", "tax"]
PRUNE_SQL = "\nUNION ALL\n".join(
    f"SELECT '{c}' AS feature, " + (" AND ".join(
        f"(SELECT abs(corr({e}, {c})) FROM flows WHERE {BENIGN}) <= 0.95" for e in PRUNE[:i]) or "true")
    + " AS kept" for i, c in enumerate(PRUNE))


@query("correlation_prune_later", with_views(FLOWS) + PRUNE_SQL)
def _(spark, d):
    kept, _ = features.correlation_prune_later(flows(spark, d).filter(BENIGN), PRUNE)
    return spark.createDataFrame([(c, c in kept) for c in PRUNE], "feature string, kept boolean")


@query("correlation_prune_low_variance")
def _(spark, d):
    _, log = features.correlation_prune_low_variance(flows(spark, d).filter(BENIGN), PRUNE)
    return rounded(spark.createDataFrame(
        [(r["feature_a"], r["feature_b"], r["abs_r"], r["kept"], r["dropped"]) for r in log],
        "feature_a string, feature_b string, abs_r double, kept string, dropped string"))


TOP = ["quantity", "price", "net_price", "discount"]


@query("high_correlation_pairs", with_views(FLOWS) + "SELECT feature_a, feature_b, round(r, 6) AS r FROM (" + "\nUNION ALL\n".join(
    f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, corr({a}, {b}) AS r FROM flows WHERE {BENIGN}"
    for i, a in enumerate(TOP) for b in TOP[i + 1:]) + ") WHERE abs(r) > 0.95")
def _(spark, d):
    from flowwatch.operators.profile import high_correlation_pairs
    f = flows(spark, d).filter(BENIGN)
    return rounded(high_correlation_pairs(f, [*TOP, "tax", "const_one"], top_k=4))


PLAN_COLS = ["quantity", "price", "net_price", "discount", "tax", "step_rate"]


def _plan_sql() -> str:
    """The whole chain in SQL: fill, cap, log, ratios (all zero here), scale, prune."""
    med = "med AS (SELECT " + ", ".join(f"quantile_cont({c}, 0.5) AS {c}_med" for c in PLAN_COLS) + f" FROM gaps WHERE {BENIGN})"
    comp = f"complete AS (SELECT * FROM gaps WHERE {BENIGN} AND step_rate IS NOT NULL)"
    caps = "caps AS (SELECT " + ", ".join(
        f"quantile_cont({c}, 0.01) AS {c}_lo, quantile_cont({c}, 0.99) AS {c}_hi" for c in PLAN_COLS) + " FROM complete)"
    mask = "mask AS (SELECT " + ", ".join(
        f"abs(skewness(least(greatest({c}, {c}_lo), {c}_hi))) > 1 AS {c}_log" for c in PLAN_COLS) + " FROM complete, caps)"
    step = lambda c, v: f"CASE WHEN {c}_log THEN ln(1 + greatest(least(greatest({v}, {c}_lo), {c}_hi), 0)) ELSE least(greatest({v}, {c}_lo), {c}_hi) END"
    logged = "logged AS (SELECT " + ", ".join(f"{step(c, c)} AS {c}" for c in PLAN_COLS) + " FROM complete, caps, mask)"
    fit = "fit AS (SELECT " + ", ".join(
        f"quantile_cont({c}, 0.5) AS {c}_m, quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) AS {c}_w" for c in PLAN_COLS) + " FROM logged)"
    body = "SELECT row_id, " + ", ".join(
        f"round(({step(c, f'coalesce({c}, {c}_med)')} - {c}_m) / {c}_w, 6) AS {c}" for c in PLAN_COLS if c != "net_price")
    # The five ratios read absent columns: constant 0, median 0, width 1, never pruned.
    zeros = "".join(f", CAST(0.0 AS DOUBLE) AS {n}" for n in RATIO_NAMES)
    return with_views(FLOWS, GAPS, med, comp, caps, mask, logged, fit) + body + zeros + " FROM gaps, med, caps, mask, fit"


@query("feature_plan", _plan_sql())
def _(spark, d):
    f = flows(spark, d).select("row_id", "label", *PLAN_COLS)
    plan = features.FeaturePlan().fit(f.filter(BENIGN), PLAN_COLS)
    return rounded(plan.transform(f, ["row_id"]))


# --- distributions ------------------------------------------------------------------

SERIES = "(SELECT sum((CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END) * exp(-2.0 * k * k * lam * lam)) FROM range(1, 101) r(k))"


def ks_sql(source: str, cols, cond: str) -> str:
    long = " UNION ALL ".join(f"SELECT '{c}' AS feature, {c} AS v, {cond} AS g FROM {source} WHERE abs({c}) < CAST('inf' AS DOUBLE)" for c in cols)
    return f"""ks AS (SELECT feature, ks, n_a, n_b, lam, CASE WHEN lam < 0.3 THEN 1.0 ELSE least(1.0, greatest(0.0, 2.0 * {SERIES})) END AS p_value
FROM (SELECT *, (sqrt(n_a * n_b / (n_a + n_b)) + 0.12 + 0.11 / sqrt(n_a * n_b / (n_a + n_b))) * ks AS lam
FROM (SELECT feature, max(abs(ca / ta - cb / tb)) AS ks, max(ta) AS n_a, max(tb) AS n_b
FROM (SELECT feature, CAST(sum(a) OVER w AS DOUBLE) AS ca, CAST(sum(b) OVER w AS DOUBLE) AS cb,
  CAST(sum(a) OVER (PARTITION BY feature) AS DOUBLE) AS ta, CAST(sum(b) OVER (PARTITION BY feature) AS DOUBLE) AS tb
  FROM (SELECT feature, v, count(*) FILTER (g) AS a, count(*) FILTER (NOT g) AS b FROM ({long}) GROUP BY feature, v)
  WINDOW w AS (PARTITION BY feature ORDER BY v)) GROUP BY feature)))"""


KS_COLS = ["quantity", "price", "discount", "tax", "step_rate"]


@query("ks_two_sample", with_views(FLOWS, ks_sql("flows", KS_COLS, "label = 'BENIGN'")) + """
SELECT feature, round(ks, 6) AS ks, CAST(n_a AS BIGINT) AS n_a, CAST(n_b AS BIGINT) AS n_b, round(p_value, 6) AS p_value FROM ks""")
def _(spark, d):
    return rounded(dist.ks_by_feature(flows(spark, d), KS_COLS, F.col("label") == "BENIGN"))


KEEP_MAP = {"feat_fwd_bwd_pkt_ratio": ("fwd", "bwd"), "feat_fwd_bwd_byte_ratio": ("fwd_bytes", "bwd_bytes"),
            "feat_iat_cv": ("iat_std", "iat_mean"), "feat_burst_intensity": ("max_len", "len_mean")}
KEEP_VIEW = "wide AS (SELECT *, " + ", ".join(f'{WIDE_SQL[n]} AS "{n}"' for n in KEEP_MAP) + " FROM packets)"


@query("ks_keep_features", with_views(PACKETS, KEEP_VIEW, ks_sql("wide", [*KEEP_MAP, *[p for v in KEEP_MAP.values() for p in v]], "label = 'BENIGN'"))
       + "\nUNION ALL\n".join(
    f"""SELECT '{f}' AS feature, round(ks, 6) AS ks, round((SELECT max(ks) FROM ks WHERE feature IN ('{a}', '{b}')), 6) AS parent_ks,
  ks > (SELECT max(ks) FROM ks WHERE feature IN ('{a}', '{b}')) AS better, ks > 0.1 AS keep FROM ks WHERE feature = '{f}'"""
    for f, (a, b) in KEEP_MAP.items()))
def _(spark, d):
    wide = features.add_flow_ratio_features(packet_flows(spark, d))
    return rounded(dist.ks_keep_features(wide, list(KEEP_MAP), features.PARENTS, F.col("label") == "BENIGN"))


IMP = ["quantity", "price", "discount", "tax"]


@query("score_importance", with_views(FLOWS, SCORED) + "\nUNION ALL\n".join(
    f"""SELECT '{c}' AS feature, round(abs(corr({c}, CASE WHEN s0 > cut THEN 1.0 ELSE 0.0 END)), 6) AS importance, 'decile' AS mode FROM {{src}}
UNION ALL SELECT '{c}', round(abs(corr({c}, s0)), 6), 'score' FROM {{src}}""" for c in IMP).replace(
    "{src}", "(SELECT *, quantity / 50.0 + discount * 5.0 AS s0 FROM flows), (SELECT quantile_cont(s0, 0.9) AS cut FROM scored)"))
def _(spark, d):
    f = flows(spark, d).select(*IMP, (F.col("quantity") / 50.0 + F.col("discount") * 5.0).alias("s0"))
    a = features.score_importance(f, IMP, "s0").withColumn("mode", F.lit("decile"))
    return rounded(a.unionByName(features.score_importance(f, IMP, "s0", "score").withColumn("mode", F.lit("score"))))


@query("cumulative_importance_select", with_views(FLOWS) + """
SELECT feature, round(importance, 6) AS importance, CAST(rank AS INTEGER) AS rank, round(cumulative, 6) AS cumulative FROM (
  SELECT *, sum(CASE WHEN cumulative <= 0.95 THEN 1 ELSE 0 END) OVER () + 1 AS need FROM (
    SELECT feature, importance, row_number() OVER (ORDER BY importance DESC, feature) AS rank,
      sum(importance) OVER (ORDER BY importance DESC, feature) / sum(importance) OVER () AS cumulative FROM (""" + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS feature, abs(corr({c}, quantity / 50.0 + discount * 5.0)) AS importance FROM flows" for c in IMP) + """)))
WHERE rank <= greatest(need, 2)""")
def _(spark, d):
    f = flows(spark, d).select(*IMP, (F.col("quantity") / 50.0 + F.col("discount") * 5.0).alias("s0"))
    return rounded(features.cumulative_importance_select(features.score_importance(f, IMP, "s0", "score"), at_least=2))


MI = ["quantity", "price", "tax"]


def _mi_sql(c: str) -> str:
    cuts = " + ".join(f"(CASE WHEN {c} > (SELECT quantile_cont({c}, {i / 10}) FROM flows) THEN 1 ELSE 0 END)" for i in range(1, 10))
    return f"SELECT '{c}' AS feature, {cuts} AS bin, y, CAST(count(*) AS DOUBLE) AS n FROM flows GROUP BY 2, 3"


@query("mutual_information", with_views(FLOWS) + """
SELECT feature, round(sum(n / t * ln(n * t / (nb * ny))), 6) AS mi FROM (
  SELECT feature, n, sum(n) OVER (PARTITION BY feature) AS t, sum(n) OVER (PARTITION BY feature, bin) AS nb,
    sum(n) OVER (PARTITION BY feature, y) AS ny FROM (
""" + "\nUNION ALL\n".join(_mi_sql(c) for c in MI) + ")) GROUP BY feature")
def _(spark, d):
    return rounded(dist.mutual_information(flows(spark, d), MI, "y"))


DIMS = [f"x{i}" for i in range(VECTOR_DIMS)]


@query("pca_explained_variance")
def _(spark, d):
    return rounded(dist.pca_explained_variance(vectors(spark, d).filter("y = 0"), DIMS))


@query("pca_two_columns", with_views(FLOWS) + f"""
, m AS (SELECT var_pop(quantity / 50.0) AS a, var_pop(price / 105000.0) AS c, covar_pop(quantity / 50.0, price / 105000.0) AS b FROM flows WHERE {BENIGN}),
e AS (SELECT (a + c) / 2 + sqrt(pow((a - c) / 2, 2) + b * b) AS big, a + c AS whole FROM m)
SELECT 1 AS component, round(big / whole, 6) AS share, round(big / whole, 6) AS cumulative FROM e
UNION ALL SELECT 2, round(1 - big / whole, 6), round(CAST(1 AS DOUBLE), 6) FROM e""".replace("\n, m AS", ", m AS", 1))
def _(spark, d):
    f = flows(spark, d).filter(BENIGN).select((F.col("quantity") / 50.0).alias("a"), (F.col("price") / 105000.0).alias("b"))
    return rounded(dist.pca_explained_variance(f, ["a", "b"]).drop("reaches"))


@query("pca_project")
def _(spark, d):
    v = vectors(spark, d)
    model = dist.fit_pca(v.filter("y = 0"), DIMS, 2)
    return rounded(dist.pca_project(v, model, DIMS, ["vec_id", "label"]))


@query("pca_loadings")
def _(spark, d):
    v = vectors(spark, d)
    return rounded(dist.pca_loadings(v, dist.fit_pca(v.filter("y = 0"), DIMS, 2), DIMS))


@query("mahalanobis_distance", with_views(FLOWS) + f"""
, m AS (SELECT avg(quantity) AS mq, avg(price) AS mp, var_pop(quantity) AS a, var_pop(price) AS c, covar_pop(quantity, price) AS b FROM flows WHERE {BENIGN}),
d AS (SELECT y, sqrt(((quantity - mq) ** 2 * c - 2 * b * (quantity - mq) * (price - mp) + (price - mp) ** 2 * a) / (a * c - b * b)) AS score FROM flows, m),
t AS (SELECT quantile_cont(score, 0.95) AS cut FROM d WHERE y = 0)
SELECT round(any_value(cut), 6) AS threshold, round(avg(CASE WHEN score > cut THEN 1.0 ELSE 0.0 END) FILTER (y = 1), 6) AS detection_rate,
  round(avg(CASE WHEN score > cut THEN 1.0 ELSE 0.0 END) FILTER (y = 0), 6) AS fp_rate FROM d, t""".replace("\n, m AS", ", m AS", 1))
def _(spark, d):
    f = flows(spark, d)
    s = dist.mahalanobis_distance(f, f.filter(BENIGN), ["quantity", "price"])
    return rounded(dist.cut_rates(s.select("y", "score"), "score", "y"))


@query("robust_covariance")
def _(spark, d):
    cols = BASE
    centre, sigma = dist.robust_covariance(flows(spark, d).filter(BENIGN), cols)
    rows = [(a, float(centre[i]), [float(x) for x in sigma[i]]) for i, a in enumerate(cols)]
    return spark.createDataFrame(rows, "feature string, centre double, covariance array<double>")


@query("score_histogram", with_views(FLOWS, SCORED) + """
SELECT y AS cls, bin, round(lo + bin * w, 6) AS left, count(*) AS n, round(count(*) / (sum(count(*)) OVER (PARTITION BY y) * w), 6) AS density
FROM (SELECT y, lo, w, CAST(least(floor((s1 - lo) / w), 79) AS INTEGER) AS bin FROM scored,
  (SELECT min(s1) AS lo, (max(s1) - min(s1)) / 80 AS w FROM scored)) GROUP BY y, bin, lo, w""")
def _(spark, d):
    return rounded(dist.score_histogram(scored(spark, d), "s1", "y"))


@query("kde_on_grid", with_views(FLOWS) + f"""
, p AS (SELECT label = 'BENIGN' AS b, count(*) AS n, stddev_samp(price) AS sd, quantile_cont(price, 0.01) AS lo, quantile_cont(price, 0.99) AS hi FROM flows GROUP BY 1),
h AS (SELECT b, n, pow(3.0 * n / 4.0, -0.2) * sd AS w FROM p),
g AS (SELECT point, lo + point * (hi - lo) / 399 AS x FROM range(400) r(point), (SELECT min(lo) AS lo, max(hi) AS hi FROM p)),
k AS (SELECT point, any_value(x) AS x, f.label = 'BENIGN' AS b, sum(exp(-0.5 * ((x - price) / w) ** 2)) / (any_value(n) * any_value(w) * sqrt(2 * pi())) AS dens
  FROM g, flows f JOIN h ON h.b = (f.label = 'BENIGN') GROUP BY point, f.label = 'BENIGN')
SELECT CAST(point AS INTEGER) AS point, round(any_value(x), 3) AS x, round(max(dens) FILTER (b), 10) AS benign, round(max(dens) FILTER (NOT b), 10) AS attack,
  round(min(dens), 10) AS overlap FROM k GROUP BY point""".replace("\n, p AS", ", p AS", 1))
def _(spark, d):
    f = flows(spark, d)
    return rounded(dist.kde_on_grid(f, "price", F.col("label") == "BENIGN"), 10, x=3)


FIVE = ["quantity", "price", "step_rate"]


@query("five_number_by_label", with_views(FLOWS, GAPS) + "\nUNION ALL\n".join(
    f"SELECT label, '{c}' AS feature, " + ", ".join(
        f"round(quantile_cont({e}, {p}), 6) AS {n}" for n, p in (("low", 0), ("q1", .25), ("median", .5), ("q3", .75), ("high", 1)))
    + " FROM gaps GROUP BY label" for c, e in (("quantity", "quantity"), ("price", "price"), ("step_rate", "ln(1 + greatest(step_rate, 0))"))))
def _(spark, d):
    return rounded(dist.five_number_by_label(gaps(spark, d), FIVE, "label", logged=["step_rate"]))


@query("missed_vs_benign_means", with_views(FLOWS) + """
, s AS (SELECT *, CASE WHEN quantity / 50.0 + discount * 5.0 > 0.9 THEN 1 ELSE 0 END AS pred FROM flows)
""".replace("\n, s", ", s", 1) + per_column(
    IMP, "round(avg({c}) FILTER (y = 1 AND pred = 0), 4) AS missed, round(avg({c}) FILTER (y = 0 AND pred = 0), 4) AS benign, "
         "round(avg({c}) FILTER (y = 1 AND pred = 0) - avg({c}) FILTER (y = 0 AND pred = 0), 4) AS difference", "s"))
def _(spark, d):
    f = flows(spark, d)
    pred = F.when(F.col("quantity") / 50.0 + F.col("discount") * 5.0 > 0.9, 1).otherwise(0)
    return rounded(dist.missed_vs_benign_means(f.withColumn("pred", pred), IMP), 4)

"""Queries of explanation, robustness, sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowwatch.operators import explain, features
from flowwatch.operators.detect import ZScoreMax
from flowwatch.plans.catalog import query, rounded
from flowwatch.plans.detector_queries import unit_flows
from flowwatch.plans.profile_queries import per_column
from flowwatch.plans.split_queries import rare
from flowwatch.session import scratch_path
from flowwatch.sources import flow_files
from flowwatch.sources.tables import BASE, FLOWS, SCORED, flows, scored, with_views

COLS = ["quantity", "price", "discount"]
CENTRE = {"quantity": 0.5, "price": 0.36, "discount": 0.5}
UNIT_SQL = "unit AS (SELECT row_id, ship_date, label, y, quantity / 50.0 AS quantity, price / 105000.0 AS price, discount / 0.1 AS discount FROM flows)"


def distance(df, out="score"):
    """A fixed, known scorer: squared distance from a given centre."""
    total = F.lit(0.0)
    for c, m in CENTRE.items():
        total = total + (F.col(c) - m) * (F.col(c) - m)
    return df.withColumn(out, total)


def dist_sql(fmt: str = "{c}") -> str:
    return " + ".join(f"pow({fmt.format(c=c)} - {m}, 2)" for c, m in CENTRE.items())


REF_SQL = "ref AS (SELECT " + ", ".join(f"quantile_cont({c}, 0.5) AS {c}_r" for c in COLS) + " FROM unit WHERE y = 0)"


@query("benign_reference", with_views(FLOWS) + per_column(
    BASE, "round(quantile_cont({c}, 0.5), 6) AS median", "flows", "WHERE label = 'BENIGN'"))
def _(spark, d):
    ref = explain.benign_reference(flows(spark, d).filter("label = 'BENIGN'"), BASE)
    return rounded(spark.createDataFrame(list(ref.items()), "feature string, median double"))


ATTR = "\nUNION ALL\n".join(
    f"SELECT row_id, ship_date, y, '{c}' AS feature, {i} AS pos, pow({c} - {CENTRE[c]}, 2) - pow({c}_r - {CENTRE[c]}, 2) AS contribution FROM unit, ref"
    for i, c in enumerate(COLS))


@query("counterfactual_attribution", with_views(FLOWS, UNIT_SQL, REF_SQL) + f"""
SELECT row_id, feature, round(contribution, 6) AS contribution FROM ({ATTR})""")
def _(spark, d):
    u = unit_flows(spark, d)
    ref = explain.benign_reference(u.filter("y = 0"), COLS)
    # The rank is left out here: features with equal contributions may be ordered by the last bit.
    return rounded(explain.counterfactual_attribution(u, COLS, distance, ref).drop("rank"))


@query("explain_flagged", with_views(FLOWS, UNIT_SQL, REF_SQL, f"hit AS (SELECT row_id, CASE WHEN {dist_sql()} > 0.9 THEN 1 ELSE 0 END AS pred FROM unit)",
       f"attr AS ({ATTR})") + """
SELECT hit.row_id, pred, CASE WHEN pred = 1 THEN round(top, 5) END AS top1, CASE WHEN pred = 1 THEN round(total, 5) END AS top_sum
FROM hit JOIN (SELECT row_id, max(abs(contribution)) AS top, sum(contribution) AS total FROM attr GROUP BY row_id) a USING (row_id)""")
def _(spark, d):
    u = distance(unit_flows(spark, d))
    ref = explain.benign_reference(u.filter("y = 0"), COLS)
    flagged = u.withColumn("pred", F.when(F.col("score") > 0.9, 1).otherwise(0)).drop("score")
    e = explain.explain_flagged(flagged, COLS, distance, ref)
    return rounded(e.select(
        "row_id", "pred", F.abs("explain_top1_contrib").alias("top1"),
        (F.col("explain_top1_contrib") + F.col("explain_top2_contrib") + F.col("explain_top3_contrib")).alias("top_sum")), 5)


def mixed_score(df, out="score"):
    return df.withColumn(out, 0.8 * F.col("s") + 0.2 * F.col("s1"))


@query("permutation_importance")
def _(spark, d):
    r = rare(spark, d)
    return rounded(explain.permutation_importance(r, ["s", "s1"], mixed_score, n_repeats=3))


ALPHAS = (0.0, 0.25, 0.5, 0.75, 1.0)


MIMICRY_SQL = with_views(FLOWS, UNIT_SQL, REF_SQL) + "\nUNION ALL\n".join(
    f"""SELECT CAST({a} AS DOUBLE) AS alpha, round(avg(s), 6) AS mean_score, round(avg(CASE WHEN s >= 0.4 THEN 1.0 ELSE 0.0 END), 6) AS detection_rate
FROM (SELECT {" + ".join(f"pow({c} + CAST({a} AS DOUBLE) * ({c}_r - {c}) - {m}, 2)" for c, m in CENTRE.items())} AS s FROM unit, ref WHERE y = 1)""" for a in ALPHAS)


@query("mimicry_evasion", MIMICRY_SQL)
def _(spark, d):
    u = unit_flows(spark, d)
    ref = explain.benign_reference(u.filter("y = 0"), COLS)
    return rounded(explain.mimicry_evasion(u.filter("y = 1"), COLS, distance, ref, 0.4, ALPHAS))


def _noise_sql() -> str:
    uni = lambda start: f"(CAST(CAST('0x' || substr(h, {start}, 13) AS BIGINT) AS DOUBLE) + 0.5) / CAST({16 ** 13} AS DOUBLE)"
    parts = []
    for i, sigma in enumerate((0.05, 0.1, 0.25, 0.5, 1.0)):
        for r in range(3):
            terms = []
            for c, m in CENTRE.items():
                z = f"(SELECT sqrt(-2 * ln({uni(1)})) * cos(2 * pi() * {uni(14)}) FROM (SELECT md5('42:{i}:{r}:{c}:' || row_id) AS h))"
                terms.append(f"pow({c} + {sigma} * {c}_d * {z} - {m}, 2)")
            parts.append(f"SELECT CAST({sigma} AS DOUBLE) AS sigma, avg(CASE WHEN {' + '.join(terms)} >= 0.4 THEN 1.0 ELSE 0.0 END) AS f FROM b, dev")
    return with_views(FLOWS, UNIT_SQL, "b AS (SELECT * FROM unit WHERE y = 0)", "dev AS (SELECT " + ", ".join(
        f"stddev_pop({c}) AS {c}_d" for c in COLS) + " FROM b)") + f"""
SELECT sigma, round(avg(f), 5) AS fpr_mean, round(stddev_pop(f), 5) AS fpr_std,
  (SELECT round(avg(CASE WHEN {dist_sql()} >= 0.4 THEN 1.0 ELSE 0.0 END), 5) FROM b) AS fpr_clean
FROM ({" UNION ALL ".join(parts)}) GROUP BY sigma"""


@query("noise_fpr", _noise_sql())
def _(spark, d):
    return rounded(explain.noise_fpr(unit_flows(spark, d).filter("y = 0"), COLS, distance, 0.4), 5)


_DISTANCE_REPORT = f"""
SELECT 'distance' AS model, 'noise' AS experiment, sigma AS level, fpr_mean AS rate FROM ({_noise_sql()})
UNION ALL
SELECT 'distance', 'mimicry', alpha, round(detection_rate, 5) FROM ({MIMICRY_SQL})"""


@query("robustness_report", _DISTANCE_REPORT)
def _(spark, d):
    u = unit_flows(spark, d)
    report = explain.robustness_report(u.filter("y = 0"), u.filter("y = 1"), COLS, {"distance": (distance, 0.4)})
    noise = report["noise"].select("model", F.lit("noise").alias("experiment"), F.col("sigma").alias("level"),
                                   F.col("fpr_mean").alias("rate"))
    mimicry = report["mimicry"].select("model", F.lit("mimicry").alias("experiment"), F.col("alpha").alias("level"),
                                       F.col("detection_rate").alias("rate"))
    return rounded(noise.unionByName(mimicry), 5)


@query("robustness_report_models")
def _(spark, d):
    u = unit_flows(spark, d)
    z = ZScoreMax(1.6).fit(u.filter("y = 0"), COLS)
    report = explain.robustness_report(u.filter("y = 0"), u.filter("y = 1"), COLS,
                                       {"distance": (distance, 0.4), "zscore": (z.score, 1.6)})
    return rounded(report["noise"].select("model", F.col("sigma").alias("level"), F.col("fpr_mean").alias("rate")))


# --- sources and sinks ---------------------------------------------------------------------


@query("read_flow_csvs", with_views(FLOWS) + """
SELECT "Label", source_file, count(*) AS n, round(avg(quantity), 6) AS mean_quantity, round(sum(tax), 6) AS second_tax,
  CAST(count(*) FILTER (isinf(step_rate)) AS BIGINT) AS n_inf
FROM (SELECT label AS "Label", origin || '.csv' AS source_file, quantity, tax, step_rate FROM flows) GROUP BY 1, 2""")
def _(spark, d):
    base = scratch_path(spark, "flow_csv")
    f = flows(spark, d)
    for o in ("F", "O"):
        rate = F.when(F.col("step_rate") == float("inf"), "Infinity").otherwise(F.col("step_rate").cast("string"))
        part = f.filter(F.col("origin") == o).select("label", "quantity", rate.alias("step_rate"), F.lit(0.0).alias("zero"), "tax")
        lines = part.select(F.concat_ws(",", *part.columns).alias("line"))
        # two columns of the same name, as the captures have; every part file of a capture begins with the header
        header = "Label,quantity,step_rate,tax,tax"
        first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
        lines = lines.select(F.when(first, F.concat(F.lit(header + "\n"), "line")).otherwise(F.col("line")).alias("line"))
        head = spark.createDataFrame([(header,)], "line string").coalesce(1)
        head.unionByName(lines).write.text(f"{base}/{o}.csv")
    raw = flow_files.read_flow_csvs(spark, base, ["F.csv", "O.csv"])
    return rounded(raw.groupBy("Label", "source_file").agg(
        F.count(F.lit(1)).alias("n"), F.avg("quantity").alias("mean_quantity"), F.sum("`tax.1`").alias("second_tax"),
        F.count(F.when(F.col("step_rate") == float("inf"), 1)).alias("n_inf")))


@query("read_headerless_flows", with_views(FLOWS) + """
SELECT CASE WHEN label = 'BENIGN' THEN 'BENIGN' ELSE label END AS "Label", 'part_' || origin AS source_file, count(*) AS n, round(sum(price), 2) AS total
FROM flows GROUP BY 1, 2""")
def _(spark, d):
    base = scratch_path(spark, "headerless")
    f = flows(spark, d).withColumn("raw", F.when(F.col("label") == "BENIGN", " Normal ").otherwise(
        F.concat(F.col("label"), F.lit(" "))))
    for o in ("F", "O"):
        f.filter(F.col("origin") == o).select("price", "quantity", "raw").write.csv(
            f"{base}/part_{o}.txt", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    got = flow_files.read_headerless_flows(spark, base, ["part_F.txt", "part_O.txt"], ["price", "quantity", "label"], ["label"])
    return rounded(got.groupBy("Label", "source_file").agg(F.count(F.lit(1)).alias("n"), F.sum("price").alias("total")), 2)


@query("read_scoring_input", with_views(FLOWS) + "SELECT tax, quantity, price FROM flows")
def _(spark, d):
    path = scratch_path(spark, "scoring_input")
    flows(spark, d).withColumnsRenamed({"tax": " tax", "quantity": "quantity "}).write.parquet(path)
    return flow_files.read_scoring_file(spark, path, ["tax", "quantity", "price"])


@query("write_predictions", with_views(FLOWS, SCORED) + "SELECT row_id, s0 AS anomaly_score, flag AS is_attack FROM scored")
def _(spark, d):
    path = scratch_path(spark, "predictions")
    flow_files.write_predictions(scored(spark, d).select("row_id", "s0", "flag"), path, "flag", "s0")
    return spark.read.parquet(path)


@query("write_model_ready", with_views(FLOWS) + "SELECT origin AS split, count(*) AS n, round(sum(quantity), 2) AS total FROM flows GROUP BY origin")
def _(spark, d):
    path = scratch_path(spark, "model_ready")
    flow_files.write_model_ready(flows(spark, d).select("row_id", "y", "label", "quantity", F.col("origin").alias("split")), path)
    return rounded(flow_files.read_model_ready(spark, path).groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), F.sum("quantity").alias("total")), 2)


@query("read_model_ready", with_views(FLOWS) + "SELECT row_id, quantity FROM flows WHERE origin = 'F'")
def _(spark, d):
    path = scratch_path(spark, "model_ready")
    flow_files.write_model_ready(flows(spark, d).select("row_id", "quantity", "price", F.col("origin").alias("split")), path)
    return flow_files.read_model_ready(spark, path, "F", ["row_id", "quantity"])


@query("fitted_params", with_views(FLOWS) + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS feature, round(quantile_cont({c}, 0.5), 6) AS median, round(quantile_cont({c}, 0.01), 6) AS cap_lo FROM flows WHERE label = 'BENIGN'" for c in BASE))
def _(spark, d):
    path = scratch_path(spark, "params")
    features.FeaturePlan().fit(flows(spark, d).filter("label = 'BENIGN'"), BASE).save(spark, path)
    plan = features.FeaturePlan.load(spark, path)
    return rounded(spark.createDataFrame(
        [(c, plan.medians[c], plan.caps[c][0]) for c in plan.raw], "feature string, median double, cap_lo double"))


@query("write_report_tables", with_views(FLOWS) + "SELECT label, count(*) AS n FROM flows GROUP BY label")
def _(spark, d):
    base = scratch_path(spark, "reports")
    table = flows(spark, d).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    (path,) = flow_files.write_report_tables({"labels": table}, base)
    return spark.read.schema("label string, n long").option("header", True).csv(path)

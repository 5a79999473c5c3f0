"""Queries of splits, samples and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowwatch.operators import metrics, split
from flowwatch.plans.catalog import query, rounded
from flowwatch.sources.tables import FLOWS, SCORED, flows, scored, with_views

H42 = "md5('42:' || row_id)"
SPLIT = f"""splitted AS (
  SELECT *, CASE WHEN label = 'BENIGN' AND row_number() OVER (PARTITION BY label ORDER BY {H42})
      > greatest(1, round((SELECT count(*) FROM flows WHERE label = 'BENIGN') * 0.2)) THEN 'train' ELSE 'test' END AS split
  FROM flows)"""


@query("one_class_split", with_views(FLOWS, SPLIT) + "SELECT row_id, label, y, split FROM splitted")
def _(spark, d):
    f = flows(spark, d).select("row_id", "label")
    return split.one_class_split(f, "row_id").select("row_id", "label", "y", "split")


@query("stratified_holdout", with_views(FLOWS) + f"""
SELECT row_id, y, CASE WHEN row_number() OVER (PARTITION BY y ORDER BY {H42})
  <= round(count(*) OVER (PARTITION BY y) * 0.4) THEN 'meta' ELSE 'eval' END AS part FROM flows""")
def _(spark, d):
    return split.stratified_holdout(flows(spark, d).select("row_id", "y"), "row_id")


@query("stratified_kfold", with_views(FLOWS) + f"""
SELECT row_id, y, CAST((row_number() OVER (PARTITION BY y ORDER BY {H42}) - 1) * 3
  // count(*) OVER (PARTITION BY y) AS INTEGER) AS fold FROM flows""")
def _(spark, d):
    return split.stratified_kfold(flows(spark, d).select("row_id", "y"), "row_id")


@query("cap_sample", with_views(FLOWS) + f"SELECT row_id, label, quantity FROM flows ORDER BY {H42} LIMIT 8000")
def _(spark, d):
    return split.cap_sample(flows(spark, d).select("row_id", "label", "quantity"), 8000, "row_id")


@query("tail_split", with_views(FLOWS) + """
SELECT row_id, CASE WHEN row_number() OVER (ORDER BY ship_date, row_id)
  > count(*) OVER () - greatest(1, floor(count(*) OVER () * 0.15)) THEN 'val' ELSE 'train' END AS split
FROM flows WHERE label = 'BENIGN'""")
def _(spark, d):
    f = flows(spark, d).filter("label = 'BENIGN'").select("row_id", "ship_date")
    return split.tail_split(f, 0.15, "ship_date", "row_id").select("row_id", "split")


@query("head_slice", with_views(FLOWS) + """
SELECT row_id, quantity FROM flows WHERE label = 'BENIGN' ORDER BY ship_date, row_id LIMIT 5000""")
def _(spark, d):
    f = flows(spark, d).filter("label = 'BENIGN'").select("row_id", "ship_date", "quantity")
    return split.head_slice(f, 5000, "ship_date", "row_id").select("row_id", "quantity")


@query("split_summary", with_views(FLOWS, SPLIT) + """
SELECT split, CAST(sum(1 - y) AS BIGINT) AS benign, CAST(sum(y) AS BIGINT) AS attack, count(*) AS total,
  round(100.0 * sum(y) / count(*), 6) AS anomaly_pct
FROM splitted GROUP BY split""")
def _(spark, d):
    f = flows(spark, d).select("row_id", "label")
    return rounded(split.split_summary(split.one_class_split(f, "row_id")))


@query("label_chronology", with_views(FLOWS) + """
SELECT row_id, label, row_number() OVER (ORDER BY CASE label WHEN 'BENIGN' THEN 0 WHEN 'R' THEN 1 ELSE 2 END,
  ship_date, row_id) - 1 AS seq FROM flows""")
def _(spark, d):
    f = flows(spark, d).select("row_id", "label", "ship_date")
    return split.label_chronology(f, ["BENIGN", "R"], "ship_date", "row_id").select("row_id", "label", "seq")


@query("class_capped_sample", with_views(FLOWS) + f"""
SELECT row_id, label, quantity FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {H42}) AS rn FROM flows)
WHERE rn <= CASE WHEN label = 'BENIGN' THEN 5000 ELSE 2000 END""")
def _(spark, d):
    f = flows(spark, d).select("row_id", "label", "quantity")
    return split.class_capped_sample(f, {"BENIGN": 5000, "A": 2000, "R": 2000}, "row_id", "label")


RARE = """rare AS (
  SELECT row_id, label, quantity / 50.0 + discount * 5.0 AS s, price / 105000.0 AS s1,
    CASE WHEN quantity >= 48 AND label <> 'BENIGN' THEN 1 ELSE 0 END AS y FROM flows)"""


def rare(spark, d):
    f = flows(spark, d)
    return f.select(
        "row_id", "label", (F.col("quantity") / 50.0 + F.col("discount") * 5.0).alias("s"),
        (F.col("price") / 105000.0).alias("s1"),
        F.when((F.col("quantity") >= 48) & (F.col("label") != "BENIGN"), 1).otherwise(0).alias("y"))


@query("subsample_to_prevalence", with_views(FLOWS, RARE) + f"""
SELECT row_id, y FROM (SELECT *, row_number() OVER (PARTITION BY y ORDER BY {H42}) AS rn FROM rare)
WHERE y = 1 OR rn <= greatest(1, floor((SELECT sum(y) FROM rare) * (1 - CAST(0.1 AS DOUBLE)) / CAST(0.1 AS DOUBLE)))""")
def _(spark, d):
    return split.subsample_to_prevalence(rare(spark, d).select("row_id", "y"), 0.10, "row_id")


# --- evaluation ---------------------------------------------------------------

CONF = """sum(CASE WHEN y = 0 AND flag = 0 THEN 1 ELSE 0 END) AS tn, sum(CASE WHEN y = 0 AND flag = 1 THEN 1 ELSE 0 END) AS fp,
  sum(CASE WHEN y = 1 AND flag = 0 THEN 1 ELSE 0 END) AS fn, sum(CASE WHEN y = 1 AND flag = 1 THEN 1 ELSE 0 END) AS tp"""


def curve_sql(source: str, score: str = "s", y: str = "y", name: str = "curve", by: str = "") -> str:
    part = f"PARTITION BY {by} " if by else ""
    lead = f"{by}, " if by else ""
    whole = f"OVER (PARTITION BY {by})" if by else "OVER ()"
    return f"""{name} AS (
  SELECT *, sum(pos) OVER ({part}ORDER BY {score} DESC) AS tp, sum(neg) OVER ({part}ORDER BY {score} DESC) AS fp,
    sum(pos) {whole} AS p, sum(neg) {whole} AS n
  FROM (SELECT {lead}{score}, sum(CASE WHEN {y} = 1 THEN 1 ELSE 0 END) AS pos, sum(CASE WHEN {y} = 0 THEN 1 ELSE 0 END) AS neg
        FROM {source} GROUP BY {lead}{score}))"""


AUC = "1.0 - sum(pos * (fp - neg / 2.0)) / CAST(max(p) * max(n) AS DOUBLE)"
AP = "sum(pos * (tp / CAST(tp + fp AS DOUBLE))) / max(p)"
FPR95 = "min(CASE WHEN tp / CAST(p AS DOUBLE) >= 0.95 THEN fp / CAST(n AS DOUBLE) END)"


@query("confusion_counts", with_views(FLOWS, SCORED) + f"""
SELECT CAST(tn AS BIGINT) AS tn, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(tp AS BIGINT) AS tp
FROM (SELECT {CONF} FROM scored)""")
def _(spark, d):
    return metrics.confusion_counts(scored(spark, d), pred="flag")


RATES = """round(coalesce(tp / nullif(CAST(tp + fp AS DOUBLE), 0), 0), 6) AS precision,
  round(coalesce(tp / nullif(CAST(tp + fn AS DOUBLE), 0), 0), 6) AS recall,
  round(coalesce(2 * tp / nullif(CAST(2 * tp + fp + fn AS DOUBLE), 0), 0), 6) AS f1,
  round((tp + tn) / CAST(tp + tn + fp + fn AS DOUBLE), 6) AS accuracy,
  round(coalesce(fp / nullif(CAST(fp + tn AS DOUBLE), 0), 0), 6) AS fpr,
  round(coalesce(fn / nullif(CAST(fn + tp AS DOUBLE), 0), 0), 6) AS fnr"""
COUNTS = "CAST(tn AS BIGINT) AS tn, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(tp AS BIGINT) AS tp"


@query("classification_metrics", with_views(FLOWS, SCORED, curve_sql("scored", "s0")) + f"""
SELECT {COUNTS}, {RATES}, roc_auc, pr_auc FROM (SELECT {CONF} FROM scored),
  (SELECT round({AUC}, 6) AS roc_auc, round({AP}, 6) AS pr_auc FROM curve)""")
def _(spark, d):
    return rounded(metrics.classification_metrics(scored(spark, d), pred="flag", score="s0"))


@query("roc_auc", with_views(FLOWS, SCORED, curve_sql("scored", "s0")) + f"SELECT round({AUC}, 6) AS roc_auc FROM curve")
def _(spark, d):
    return rounded(metrics.roc_auc(scored(spark, d), "s0"))


@query("average_precision", with_views(FLOWS, SCORED, curve_sql("scored", "s0")) + f"SELECT round({AP}, 6) AS pr_auc FROM curve")
def _(spark, d):
    return rounded(metrics.average_precision(scored(spark, d), "s0"))


@query("roc_curve", with_views(FLOWS, SCORED, curve_sql("scored", "s1")) + """
SELECT round(s1, 9) AS threshold, round(fp / CAST(n AS DOUBLE), 9) AS fpr, round(tp / CAST(p AS DOUBLE), 9) AS tpr FROM curve""")
def _(spark, d):
    return rounded(metrics.roc_curve(scored(spark, d), "s1"), 9)


@query("pr_curve", with_views(FLOWS, SCORED, curve_sql("scored", "s1")) + """
SELECT round(s1, 9) AS threshold, round(tp / CAST(p AS DOUBLE), 9) AS recall,
  round(tp / CAST(tp + fp AS DOUBLE), 9) AS precision FROM curve""")
def _(spark, d):
    return rounded(metrics.pr_curve(scored(spark, d), "s1"), 9)


@query("confusion_percent", with_views(FLOWS, SCORED) + """
SELECT y AS y_true, flag AS y_pred, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY y), 6) AS pct
FROM scored GROUP BY y, flag""")
def _(spark, d):
    return rounded(metrics.confusion_percent(scored(spark, d), pred="flag"))


@query("fpr_at_tpr", with_views(FLOWS, SCORED, curve_sql("scored", "s0")) + f"SELECT round({FPR95}, 6) AS fpr_at_tpr FROM curve")
def _(spark, d):
    return rounded(metrics.fpr_at_tpr(scored(spark, d), "s0"))


@query("bootstrap_ci")
def _(spark, d):
    return rounded(metrics.bootstrap_ci(rare(spark, d), "s1", n_boot=200))


BY_LABEL = """SELECT label, count(*) AS total, CAST(sum(flag) AS BIGINT) AS detected,
  CAST(count(*) - sum(flag) AS BIGINT) AS missed, round(100.0 * sum(flag) / count(*), 6) AS rate_pct
FROM scored WHERE label <> 'BENIGN' GROUP BY label"""


@query("detection_rate_by_label", with_views(FLOWS, SCORED) + BY_LABEL)
def _(spark, d):
    return rounded(metrics.detection_rate_by_label(scored(spark, d), pred="flag"))


@query("per_attack_table", with_views(FLOWS, SCORED) + """
SELECT label AS attack_type, CAST(sum(a.n) AS BIGINT) AS count, round(sum(a.n * a.s0) / sum(a.n), 6) AS mean_score,
  round(sum(a.n * (b.below - b.neg / 2.0)) / (sum(a.n) * CAST(max(b.total) AS DOUBLE)), 6) AS auc_vs_benign,
  round(sum(a.hits) / CAST(sum(a.n) AS DOUBLE), 6) AS detection_rate
FROM (SELECT label, s0, count(*) AS n, sum(flag) AS hits FROM scored WHERE y = 1 GROUP BY label, s0) a
JOIN (SELECT s0, neg, sum(neg) OVER (ORDER BY s0) AS below, sum(neg) OVER () AS total
      FROM (SELECT s0, sum(1 - y) AS neg FROM scored GROUP BY s0)) b USING (s0)
GROUP BY label""")
def _(spark, d):
    return rounded(metrics.per_attack_table(scored(spark, d), "s0", pred="flag"))


def _sweep_sql() -> str:
    cuts, parts = [], []
    for i, p in enumerate((0.20, 0.10, 0.05, 0.01)):
        cuts.append(f"""cut{i} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY y ORDER BY {H42}) AS rn FROM rare)
  WHERE y = 1 OR rn <= greatest(1, floor((SELECT sum(y) FROM rare) * (1 - CAST({p} AS DOUBLE)) / CAST({p} AS DOUBLE))))""")
        cuts.append(curve_sql(f"cut{i}", "s1", name=f"curve{i}"))
        parts.append(f"""SELECT CAST({p} AS DOUBLE) AS prevalence, CAST(max(p) + max(n) AS BIGINT) AS n, CAST(max(p) AS BIGINT) AS n_attacks,
  round({AP}, 6) AS pr_auc, round({FPR95}, 6) AS fpr_at_95tpr, CAST({p} AS DOUBLE) AS random_baseline_pr_auc FROM curve{i}""")
    return with_views(FLOWS, RARE, *cuts) + "\nUNION ALL\n".join(parts)


@query("prevalence_sweep", _sweep_sql())
def _(spark, d):
    return rounded(metrics.prevalence_sweep(rare(spark, d), "s1", "row_id"))


@query("weak_spots", with_views(FLOWS, SCORED) + f"SELECT * FROM ({BY_LABEL}) WHERE rate_pct < 50 ORDER BY rate_pct, label LIMIT 5")
def _(spark, d):
    return rounded(metrics.weak_spots(metrics.detection_rate_by_label(scored(spark, d), pred="flag")))


@query("eval_only_filter", with_views(FLOWS, SCORED) + f"""
SELECT row_id, label, y, flag FROM (SELECT *, row_number() OVER (PARTITION BY y ORDER BY {H42}) AS rn,
  count(*) OVER (PARTITION BY y) AS total FROM scored) WHERE rn > round(total * 0.4)""")
def _(spark, d):
    s = scored(spark, d).select("row_id", "label", "y", "flag")
    parts = split.stratified_holdout(s.select("row_id", "y"), "row_id")
    return metrics.eval_only_filter(s, parts.filter("part = 'eval'"), "row_id")


@query("error_category", with_views(FLOWS, SCORED) + """
SELECT label, CASE WHEN y = 1 AND flag = 1 THEN 'TP' WHEN y = 0 AND flag = 0 THEN 'TN' WHEN y = 0 THEN 'FP' ELSE 'FN' END AS category,
  count(*) AS n FROM scored GROUP BY ALL""")
def _(spark, d):
    return metrics.error_category(scored(spark, d), pred="flag").groupBy("label", "category").agg(
        F.count(F.lit(1)).alias("n"))


@query("missed_attack_profile", with_views(FLOWS, SCORED) + """
SELECT label, count(*) AS total, CAST(sum(flag) AS BIGINT) AS detected, CAST(sum(1 - flag) AS BIGINT) AS missed,
  round(100.0 * sum(flag) / count(*), 6) AS rate_pct,
  round(avg(s0) FILTER (flag = 0), 6) AS mean_s0_missed, round(avg(s1) FILTER (flag = 0), 6) AS mean_s1_missed
FROM scored WHERE y = 1 GROUP BY label""")
def _(spark, d):
    return rounded(metrics.missed_attack_profile(scored(spark, d), ["s0", "s1"], pred="flag"))


@query("model_pair_by_attack", with_views(FLOWS, SCORED) + """
SELECT label, count(*) AS total, CAST(sum(flag) AS BIGINT) AS detected_a, CAST(sum(CASE WHEN s1 > 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS detected_b,
  round(100.0 * sum(flag) / count(*), 6) AS rate_a, round(100.0 * sum(CASE WHEN s1 > 0.5 THEN 1 ELSE 0 END) / count(*), 6) AS rate_b,
  round(100.0 * sum(CASE WHEN s1 > 0.5 THEN 1 ELSE 0 END) / count(*) - 100.0 * sum(flag) / count(*), 6) AS delta_points
FROM scored WHERE y = 1 GROUP BY label""")
def _(spark, d):
    s = scored(spark, d).withColumn("flag1", F.when(F.col("s1") > 0.5, 1).otherwise(0))
    return rounded(metrics.model_pair_by_attack(s, "flag", "flag1"))


@query("comparison_table", with_views(FLOWS, SCORED) + "\nUNION ALL\n".join(
    f"SELECT '{m}' AS model, {COUNTS}, {RATES} FROM (SELECT {CONF} FROM (SELECT y, CASE WHEN {c} THEN 1 ELSE 0 END AS flag FROM scored))"
    for m, c in (("quantity", "s0 > 0.9"), ("price", "s1 > 0.5"))))
def _(spark, d):
    s = scored(spark, d).withColumn("flag1", F.when(F.col("s1") > 0.5, 1).otherwise(0))
    return rounded(metrics.comparison_table({
        "quantity": metrics.classification_metrics(s, pred="flag"),
        "price": metrics.classification_metrics(s, pred="flag1")}))


@query("pick_best_model", with_views(FLOWS, SCORED) + "SELECT model, f1 FROM (" + "\nUNION ALL\n".join(
    f"SELECT '{m}' AS model, {RATES} FROM (SELECT {CONF} FROM (SELECT y, CASE WHEN {c} THEN 1 ELSE 0 END AS flag FROM scored))"
    for m, c in (("quantity", "s0 > 0.9"), ("price", "s1 > 0.5"))) + ") ORDER BY f1 DESC, model LIMIT 1")
def _(spark, d):
    s = scored(spark, d).withColumn("flag1", F.when(F.col("s1") > 0.5, 1).otherwise(0))
    table = metrics.comparison_table({
        "quantity": metrics.classification_metrics(s, pred="flag"),
        "price": metrics.classification_metrics(s, pred="flag1")})
    return rounded(metrics.pick_best_model(table))

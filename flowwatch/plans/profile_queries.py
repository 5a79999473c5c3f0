"""Queries of the data-quality profile and of cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowwatch.operators import clean, profile
from flowwatch.plans.catalog import query, rounded
from flowwatch.sources.tables import (
    FLOWS, PACKETS, STREAM, flows, packet_flows, score_stream, table, with_views,
)

RAW = ["quantity", "price", "discount", "tax", "step_rate", "tax_rate", "net_price", "const_one"]
FIN = "CASE WHEN abs({c}) < CAST('inf' AS DOUBLE) THEN {c} END"


def fin(c: str) -> str:
    return FIN.format(c=c)


def per_column(cols, body: str, source: str, where: str = "") -> str:
    """UNION ALL of one aggregate select per column; ``{c}`` and ``{f}`` are filled in."""
    return "\nUNION ALL\n".join(
        f"SELECT '{c}' AS feature, {body.format(c=c, f=fin(c))} FROM {source} {where}" for c in cols)


@query("label_distribution", with_views(FLOWS) + """
SELECT label, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 2) AS pct
FROM flows GROUP BY label""")
def _(spark, d):
    return profile.label_distribution(flows(spark, d))


@query("benign_attack_summary", with_views(FLOWS) + """
SELECT count(*) FILTER (label = 'BENIGN') AS n_benign, count(*) FILTER (label <> 'BENIGN') AS n_attack,
  count(DISTINCT CASE WHEN label <> 'BENIGN' THEN label END) AS attack_types,
  round(greatest(count(*) FILTER (label = 'BENIGN'), count(*) FILTER (label <> 'BENIGN'))
    / CAST(least(count(*) FILTER (label = 'BENIGN'), count(*) FILTER (label <> 'BENIGN')) AS DOUBLE), 6) AS imbalance
FROM flows""")
def _(spark, d):
    return rounded(profile.benign_attack_summary(flows(spark, d)))


def _with_gaps(spark, d):
    f = clean.nonfinite_to_null(flows(spark, d))
    return f


GAPS = "gaps AS (SELECT * REPLACE (" + ", ".join(f"{fin(c)} AS {c}" for c in ("step_rate", "tax_rate")) + ") FROM flows)"


def _share_sql(cond: str, name: str, cols, source: str) -> str:
    inner = per_column(cols, f"CAST(sum(CASE WHEN {cond} THEN 1 ELSE 0 END) AS BIGINT) AS {name}, count(*) AS total", source)
    return f"SELECT feature, {name}, round(100.0 * {name} / total, 3) AS pct FROM ({inner}) WHERE {name} > 0"


@query("null_profile", with_views(FLOWS, GAPS) + _share_sql("{c} IS NULL OR isnan({c})", "n_null", RAW, "gaps"))
def _(spark, d):
    return profile.null_profile(_with_gaps(spark, d), RAW)


@query("inf_profile", with_views(FLOWS) + _share_sql("abs({c}) = CAST('inf' AS DOUBLE)", "n_inf", RAW, "flows"))
def _(spark, d):
    return profile.inf_profile(flows(spark, d), RAW)


@query("negative_profile", """
SELECT 'balance_rate' AS feature, CAST(sum(CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_negative,
  round(100.0 * sum(CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END) / count(*), 3) AS pct
FROM customer HAVING sum(CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END) > 0""")
def _(spark, d):
    c = table(spark, d, "customer")
    return profile.negative_profile(c.select(F.col("c_acctbal").alias("balance_rate"), "c_nationkey"))


@query("duplicate_profile", """
SELECT CAST(sum(n) AS BIGINT) AS n_rows, CAST(sum(n - 1) AS BIGINT) AS n_duplicates,
  round(100.0 * sum(n - 1) / sum(n), 2) AS pct
FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_quantity, l_discount, l_tax, l_returnflag)""")
def _(spark, d):
    li = table(spark, d, "lineitem")
    return profile.duplicate_profile(li.select("l_quantity", "l_discount", "l_tax", "l_returnflag"))


@query("constant_columns", with_views(FLOWS) + """
SELECT feature, n_values <= 1 AS constant, round(std, 6) AS std FROM (
""" + per_column(RAW, "count(DISTINCT {c}) AS n_values, stddev_samp({f}) AS std", "flows") + """
) WHERE n_values <= 1 OR std < 1e-6""")
def _(spark, d):
    return rounded(profile.constant_columns(flows(spark, d), RAW))


DESCRIBED = RAW[:5] + ["net_price"]
DESCRIBE_SQL = "described AS (SELECT *, abs(skewness) AS abs_skew FROM (" + per_column(
    DESCRIBED,
    "count({f}) AS n, avg({f}) AS mean, stddev_samp({f}) AS std, min({f}) AS min, "
    + ", ".join(f"quantile_cont({{f}}, {p}) AS p{int(round(p * 100))}" for p in profile.DESCRIBE_PROBS)
    + ", max({f}) AS max, skewness({f}) AS skewness, kurtosis({f}) AS kurtosis, "
      "stddev_samp({f}) / nullif(abs(avg({f})), 0) AS cv", "flows", "WHERE label = 'BENIGN'") + "))"
DESCRIBE_OUT = """SELECT feature, n, """ + ", ".join(
    f"round({c}, 4) AS {c}" for c in (
        "mean", "std", "min", "p1", "p5", "p25", "p50", "p75", "p95", "p99", "max",
        "skewness", "kurtosis", "cv", "abs_skew")) + " FROM described"


def _described(spark, d):
    f = flows(spark, d)
    return profile.extended_describe(f.filter("label = 'BENIGN'"), DESCRIBED)


@query("extended_describe", with_views(FLOWS, DESCRIBE_SQL) + DESCRIBE_OUT)
def _(spark, d):
    return rounded(_described(spark, d), 4)


@query("log_candidates", with_views(FLOWS, DESCRIBE_SQL) + DESCRIBE_OUT
       + " WHERE abs_skew > 2 AND std > 0 AND min >= 0")
def _(spark, d):
    return rounded(profile.log_candidates(_described(spark, d)), 4)


@query("top_k_by_variance", with_views(FLOWS) + "SELECT feature, round(variance, 2) AS variance FROM ("
       + per_column(RAW, "var_samp({f}) AS variance", "flows", "WHERE label = 'BENIGN'")
       + ") ORDER BY variance DESC, feature LIMIT 4")
def _(spark, d):
    f = flows(spark, d)
    return rounded(profile.top_k_by_variance(f.filter("label = 'BENIGN'"), RAW, 4), 2)


@query("traffic_per_minute", with_views(STREAM) + """
SELECT date_trunc('minute', ts) AS minute, count(*) FILTER (flag = 0) AS benign,
  count(*) FILTER (flag = 1) AS attack
FROM stream GROUP BY 1""")
def _(spark, d):
    return profile.traffic_per_minute(score_stream(spark, d), "ts", F.col("flag") == 1)


ISSUE_COLS = RAW
PAIRS = [(a, b) for i, a in enumerate(ISSUE_COLS) for b in ISSUE_COLS[i + 1:]]
PAIR_SQL = "\nUNION ALL\n".join(
    f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, "
    f"CASE WHEN count({fin(a)} + {fin(b)}) > 0 THEN corr({fin(a)}, {fin(b)}) END AS r FROM flows WHERE label = 'BENIGN'"
    for a, b in PAIRS if "const_one" not in (a, b))
SKEW_SQL = per_column([c for c in ISSUE_COLS if c != "const_one"],
                      "abs(skewness({f})) AS s, stddev_samp({f}) AS std, min({f}) AS lo", "flows",
                      "WHERE label = 'BENIGN'")
ISSUES_SQL = with_views(FLOWS) + f"""
SELECT feature, 'infinite values' AS issue, n, 'High' AS severity, 'replace with NULL' AS action FROM (
  {per_column(ISSUE_COLS, "CAST(count(*) FILTER (isinf({c})) AS BIGINT) AS n", "flows")}) WHERE n > 0
UNION ALL
SELECT feature, 'near-constant column', (SELECT count(*) FROM flows), 'Medium', 'remove' FROM (
  {per_column(ISSUE_COLS, "count(DISTINCT {c}) AS n_values, stddev_samp({f}) AS std", "flows")})
WHERE n_values <= 1 OR std < 1e-6
UNION ALL
SELECT 'all columns', 'duplicate rows', n, 'Medium', 'drop before the split' FROM (
  SELECT CAST(sum(n - 1) AS BIGINT) AS n FROM (SELECT count(*) AS n FROM flows GROUP BY ALL)) WHERE n > 0
UNION ALL
SELECT 'skewed columns', 'high skewness', count(*), 'High', 'log1p' FROM ({SKEW_SQL}) WHERE s > 2 AND std > 0 AND lo >= 0
UNION ALL
SELECT 'column pairs', 'high correlation', count(*), 'Medium', 'drop one of the pair' FROM ({PAIR_SQL}) WHERE abs(r) > 0.95
UNION ALL
SELECT 'data set', 'class imbalance', CAST(floor(greatest(b, a) / CAST(least(b, a) AS DOUBLE)) AS BIGINT), 'Low',
  'train on benign rows only'
FROM (SELECT count(*) FILTER (label = 'BENIGN') AS b, count(*) FILTER (label <> 'BENIGN') AS a FROM flows)
UNION ALL
SELECT 'all columns', 'different scales', {len(ISSUE_COLS)}, 'High', 'scale on benign rows'
""".replace("GROUP BY ALL", "GROUP BY " + ", ".join(["row_id", "ship_date", "origin", "label", "y", *RAW]))


@query("quality_issue_table", ISSUES_SQL)
def _(spark, d):
    return profile.quality_issue_table(flows(spark, d), ISSUE_COLS)


# --- cleaning ---------------------------------------------------------------


@query("strip_column_names", with_views(PACKETS) + """
SELECT label AS "Label", count(*) AS n, round(avg(duration), 4) AS mean_duration FROM packets GROUP BY label""")
def _(spark, d):
    p = packet_flows(spark, d).withColumnsRenamed({"Flow Duration": " Flow Duration", "label": " Label "})
    named = clean.strip_column_names(p)
    return rounded(named.groupBy("Label").agg(
        F.count(F.lit(1)).alias("n"), F.avg("`Flow Duration`").alias("mean_duration")), 4)


@query("drop_identifier_columns", with_views(FLOWS) + """
SELECT label, quantity, price, discount, tax FROM flows""")
def _(spark, d):
    f = flows(spark, d).select(
        F.col("row_id").alias("Flow ID"), F.col("origin").alias("source_file"),
        F.col("ship_date").alias("Timestamp"), "label", "quantity", "price", "discount", "tax")
    return clean.drop_identifier_columns(f)


@query("drop_near_constant", with_views(FLOWS) + """
SELECT row_id, quantity, price, discount, tax, net_price FROM flows""")
def _(spark, d):
    f = flows(spark, d).select("row_id", "quantity", "price", "discount", "tax", "net_price", "const_one")
    return clean.drop_near_constant(f)


@query("nonfinite_to_null", with_views(FLOWS) + f"""
SELECT row_id, {fin('step_rate')} AS step_rate, {fin('tax_rate')} AS tax_rate FROM flows""")
def _(spark, d):
    return clean.nonfinite_to_null(flows(spark, d).select("row_id", "step_rate", "tax_rate"))


IMPUTED = "imputed AS (SELECT *, coalesce(" + fin("step_rate") + """,
    (SELECT quantile_cont(""" + fin("step_rate") + """, 0.5) FROM flows WHERE label = 'BENIGN')) AS step_filled FROM flows)"""


@query("impute_or_drop", with_views(FLOWS, IMPUTED) + """
SELECT row_id, label, quantity, round(step_filled, 6) AS step_rate FROM imputed""")
def _(spark, d):
    f = clean.nonfinite_to_null(flows(spark, d).select("row_id", "label", "quantity", "step_rate", "tax_rate"))
    return rounded(clean.impute_or_drop(f, ["quantity", "step_rate", "tax_rate"]))


@query("drop_exact_duplicates", """
SELECT DISTINCT l_quantity, l_discount, l_tax, l_returnflag FROM lineitem""")
def _(spark, d):
    li = table(spark, d, "lineitem")
    return clean.drop_exact_duplicates(li.select("l_quantity", "l_discount", "l_tax", "l_returnflag"))


@query("repair_label_text", with_views(FLOWS) + """
SELECT row_id, 'Web Attack - ' || label AS label FROM flows""")
def _(spark, d):
    f = flows(spark, d)
    raw = f.select("row_id", F.concat(F.lit("  Web Attack \x96 "), F.col("label"), F.lit(" ")).alias("label"))
    return clean.repair_label_text(raw, "label")


@query("binary_label", with_views(FLOWS) + "SELECT row_id, label, y AS is_attack FROM flows")
def _(spark, d):
    return clean.binary_label(flows(spark, d).select("row_id", "label"), "label", out="is_attack")


WINSOR = ["price", "net_price", "step_rate"]
WINSOR_SQL = with_views(FLOWS, GAPS) + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS feature, count(*) FILTER (g.{c} < b.lo OR g.{c} > b.hi) AS n_capped, "
    f"round(any_value(b.lo), 4) AS lower, round(any_value(b.hi), 4) AS upper, "
    f"round(sum(least(greatest(g.{c}, b.lo), b.hi)), 1) AS capped_sum "
    f"FROM gaps g, (SELECT q1 - 3 * (q3 - q1) AS lo, q3 + 3 * (q3 - q1) AS hi FROM (SELECT "
    f"quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM gaps WHERE label = 'BENIGN')) b "
    f"WHERE g.{c} IS NOT NULL" for c in WINSOR)


@query("winsorise_iqr", WINSOR_SQL)
def _(spark, d):
    f = _with_gaps(spark, d)
    capped, report = clean.winsorise_iqr(f, WINSOR)
    sums = profile.feature_rows(
        capped.agg(*[F.sum(c).alias(f"{i}_capped_sum") for i, c in enumerate(WINSOR)]), WINSOR, ["capped_sum"])
    return rounded(report.join(sums, "feature"), 4, capped_sum=1)


LEAK = ["quantity", "price", "discount", "tax", "net_price", "const_one"]


@query("label_leakage_check", with_views(FLOWS) + "SELECT feature, round(abs(r), 6) AS abs_r, abs(r) > 0.9 AS leak FROM ("
       + per_column(LEAK[:-1], "corr({c}, y) AS r", "flows") + ") ORDER BY abs_r DESC LIMIT 20")
def _(spark, d):
    return rounded(clean.label_leakage_check(flows(spark, d), LEAK))

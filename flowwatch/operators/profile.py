"""Data-quality profile of a flow table: each report is one aggregate pass."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowwatch.functions.exprs import INF, correlation, finite, numeric_columns, q, sample_kurtosis, sample_skew
from flowwatch.operators.quantile import exact_percentiles

# Name parts of columns that should never be negative.
NON_NEGATIVE_WORDS = (
    "packet", "byte", "length", "duration", "count", "rate", "size", "window", "seg", "header",
)
NEAR_CONSTANT = 1e-6


def feature_rows(row: DataFrame, features: Sequence[str], stats: Sequence[str],
                 extra: dict[str, dict[str, float | None]] | None = None) -> DataFrame:
    """One wide aggregate row ``<i>_<stat>`` to a row per feature, plus driver-known values."""
    extra = extra or {}
    entries = [
        F.struct(
            F.lit(f).alias("feature"),
            *[F.col(f"{i}_{s}").alias(s) for s in stats],
            *[F.lit(v.get(f)).cast("double").alias(k) for k, v in extra.items()],
        )
        for i, f in enumerate(features)
    ]
    return row.select(F.inline(F.array(*entries)))


def _count_if(cond: Column) -> Column:
    return F.coalesce(F.sum(F.when(cond, 1).otherwise(0)), F.lit(0)).cast("long")


def _counted(df: DataFrame, cols: Sequence[str], cond, name: str, digits: int) -> DataFrame:
    aggs = [_count_if(cond(c)).alias(f"{i}_n") for i, c in enumerate(cols)]
    row = df.agg(F.count(F.lit(1)).alias("rows"), *aggs)
    entries = [F.struct(F.lit(c).alias("feature"), F.col(f"{i}_n").alias(name)) for i, c in enumerate(cols)]
    return (
        row.select("rows", F.inline(F.array(*entries)))
        .filter(F.col(name) > 0)
        .select("feature", name, F.round(100.0 * F.col(name) / F.col("rows"), digits).alias("pct"))
        .orderBy(F.desc(name), "feature")
    )


def label_distribution(df: DataFrame, label: str = "label") -> DataFrame:
    per_label = df.groupBy(q(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))  # one row per label
    return per_label.select("label", "n", F.round(100.0 * F.col("n") / total, 2).alias("pct")).orderBy(
        F.desc("n"), "label")


def benign_attack_summary(df: DataFrame, label: str = "label", benign: str = "BENIGN") -> DataFrame:
    """Counts, number of attack types and the ratio of the larger to the smaller side."""
    per_label = df.groupBy(q(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    is_benign = F.col("label") == benign
    row = per_label.agg(
        F.coalesce(F.sum(F.when(is_benign, F.col("n"))), F.lit(0)).alias("n_benign"),
        F.coalesce(F.sum(F.when(~is_benign, F.col("n"))), F.lit(0)).alias("n_attack"),
        _count_if(~is_benign).alias("attack_types"),
    )
    low = F.least("n_benign", "n_attack")
    return row.withColumn(
        "imbalance", F.when(low > 0, F.greatest("n_benign", "n_attack") / F.when(low > 0, low)))


def null_profile(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    cols = list(cols or numeric_columns(df))
    return _counted(df, cols, lambda c: q(c).isNull() | F.isnan(q(c)), "n_null", 3)


def inf_profile(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    cols = list(cols or numeric_columns(df))
    return _counted(df, cols, lambda c: F.abs(q(c)) == F.lit(INF), "n_inf", 3)


def negative_profile(df: DataFrame, words: Sequence[str] = NON_NEGATIVE_WORDS) -> DataFrame:
    cols = [c for c in numeric_columns(df) if any(w in c.lower() for w in words)]
    if not cols:
        return df.sparkSession.createDataFrame([], "feature string, n_negative long, pct double")
    return _counted(df, cols, lambda c: q(c) < 0, "n_negative", 3)


def duplicate_profile(df: DataFrame) -> DataFrame:
    """Exact duplicate rows beyond the first of each."""
    merged = df.groupBy(*[q(c) for c in df.columns]).agg(F.count(F.lit(1)).alias("_n"))
    return merged.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("n_rows"),
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("n_duplicates"),
    ).withColumn(
        "pct", F.when(F.col("n_rows") > 0, F.round(
            100.0 * F.col("n_duplicates") / F.when(F.col("n_rows") > 0, F.col("n_rows")), 2)))


def spread(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Per column: is there at most one value, and the finite sample deviation.

    ``min = max`` decides constancy without a distinct count, hence no shuffle.
    """
    aggs = []
    for i, c in enumerate(cols):
        seen = F.when(~F.isnan(q(c)), q(c))
        aggs += [F.min(seen).alias(f"{i}_lo"), F.max(seen).alias(f"{i}_hi"),
                 F.stddev_samp(finite(q(c))).alias(f"{i}_std")]
    return feature_rows(df.agg(*aggs), cols, ["lo", "hi", "std"]).select(
        "feature", (F.col("lo").isNull() | (F.col("lo") == F.col("hi"))).alias("constant"), "std")


def constant_columns(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    cols = list(cols or numeric_columns(df))
    return spread(df, cols).filter(
        F.col("constant") | (F.coalesce(F.col("std"), F.lit(INF)) < NEAR_CONSTANT)
    ).select("feature", "constant", "std")


DESCRIBE_PROBS = [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]


def extended_describe(benign: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Moments, percentiles and shape of the finite values of benign rows."""
    clean = benign.select(*[finite(q(c).cast("double")).alias(c) for c in cols])
    pct = exact_percentiles(clean, cols, DESCRIBE_PROBS)
    aggs = []
    for i, c in enumerate(cols):
        v = q(c)
        aggs += [F.count(v).alias(f"{i}_n"), F.avg(v).alias(f"{i}_mean"),
                 F.stddev_samp(v).alias(f"{i}_std"), F.min(v).alias(f"{i}_min"),
                 F.max(v).alias(f"{i}_max"), F.skewness(v).alias(f"{i}_g1"),
                 F.kurtosis(v).alias(f"{i}_g2")]
    extra = {f"p{int(round(p * 100))}": {c: pct[c][j] for c in cols} for j, p in enumerate(DESCRIBE_PROBS)}
    rows = feature_rows(clean.agg(*aggs), cols, ["n", "mean", "std", "min", "max", "g1", "g2"], extra)
    n = F.col("n").cast("double")
    skew = sample_skew(F.col("g1"), n)
    size = F.abs(F.col("mean"))
    return rows.select(
        "feature", "n", "mean", "std", "min", *extra, "max",
        skew.alias("skewness"), sample_kurtosis(F.col("g2"), n).alias("kurtosis"),
        F.when(size > 0, F.col("std") / F.when(size > 0, size)).alias("cv"),
        F.abs(skew).alias("abs_skew"),
    )


def skew_profile(benign: DataFrame, cols: Sequence[str]) -> DataFrame:
    """The part of :func:`extended_describe` that needs no percentiles: one aggregate."""
    aggs = []
    for i, c in enumerate(cols):
        v = finite(q(c).cast("double"))
        aggs += [F.stddev_samp(v).alias(f"{i}_std"), F.min(v).alias(f"{i}_min"),
                 F.abs(sample_skew(F.skewness(v), F.count(v).cast("double"))).alias(f"{i}_abs_skew")]
    return feature_rows(benign.agg(*aggs), cols, ["std", "min", "abs_skew"])


def log_candidates(described: DataFrame, threshold: float = 2.0) -> DataFrame:
    return described.filter(
        (F.col("abs_skew") > threshold) & (F.col("std") > 0) & (F.col("min") >= 0)
    ).orderBy(F.desc("abs_skew"), "feature")


def top_k_by_variance(benign: DataFrame, cols: Sequence[str], k: int) -> DataFrame:
    row = benign.agg(*[F.var_samp(finite(q(c))).alias(f"{i}_variance") for i, c in enumerate(cols)])
    return feature_rows(row, cols, ["variance"]).filter(F.col("variance").isNotNull()).orderBy(
        F.desc("variance"), "feature").limit(k)


def traffic_per_minute(df: DataFrame, ts: str, is_attack: Column, fmt: str | None = None) -> DataFrame:
    """Benign and attack rows per minute; text that is no timestamp is dropped."""
    when = q(ts)
    if isinstance(df.schema[ts].dataType, T.StringType):
        when = F.try_to_timestamp(when, F.lit(fmt)) if fmt else F.try_to_timestamp(when)
    timed = df.select(F.date_trunc("minute", when).alias("minute"), is_attack.alias("a"))
    return timed.filter(F.col("minute").isNotNull()).groupBy("minute").agg(
        _count_if(~F.col("a")).alias("benign"), _count_if(F.col("a")).alias("attack"))


def quality_issue_table(df: DataFrame, cols: Sequence[str], label: str = "label",
                        benign: str = "BENIGN", corr_threshold: float = 0.95,
                        skew_threshold: float = 2.0, n_components: int | None = None) -> DataFrame:
    """Every finding as ``(feature, issue, n, severity, action)``."""
    spark = df.sparkSession
    total = df.count()
    benign_rows = df.filter(q(label) == benign)

    def finding(frame: DataFrame, count: str, issue: str, severity, action: str) -> DataFrame:
        level = severity if isinstance(severity, Column) else F.lit(severity)
        return frame.select("feature", F.lit(issue).alias("issue"), F.col(count).cast("long").alias("n"),
                            level.alias("severity"), F.lit(action).alias("action"))

    share = F.col("n_null") / F.lit(float(max(total, 1)))
    level = F.when(share > 0.05, "High").when(share > 0.001, "Medium").otherwise("Low")
    words = [c for c in cols if any(w in c.lower() for w in NON_NEGATIVE_WORDS)]
    parts = [
        finding(inf_profile(df, cols), "n_inf", "infinite values", "High", "replace with NULL"),
        finding(null_profile(df, cols), "n_null", "missing values", level, "impute or drop"),
        finding(duplicate_profile(df).filter(F.col("n_duplicates") > 0)
                .withColumn("feature", F.lit("all columns")),
                "n_duplicates", "duplicate rows", "Medium", "drop before the split"),
        finding(constant_columns(df, cols).withColumn("n", F.lit(total)), "n",
                "near-constant column", "Medium", "remove"),
    ]
    if words:
        parts.append(finding(negative_profile(df.select(*[q(c) for c in words])), "n_negative",
                             "negative values", "Medium", "report"))
    skewed = log_candidates(skew_profile(benign_rows, cols), skew_threshold)
    summary = skewed.agg(F.count(F.lit(1)).alias("n")).withColumn("feature", F.lit("skewed columns"))
    parts.append(finding(summary, "n", "high skewness", "High", "log1p"))
    pairs = high_correlation_pairs(benign_rows, cols, corr_threshold)
    summary = pairs.agg(F.count(F.lit(1)).alias("n")).withColumn("feature", F.lit("column pairs"))
    parts.append(finding(summary, "n", "high correlation", "Medium", "drop one of the pair"))
    imbalance = benign_attack_summary(df, label, benign).select(
        F.lit("data set").alias("feature"), F.floor("imbalance").alias("n"))
    parts.append(finding(imbalance, "n", "class imbalance", "Low", "train on benign rows only"))
    known = [("all columns", "different scales", len(cols), "High", "scale on benign rows")]
    if n_components is not None:
        known.append(("all columns", "high dimensionality", n_components, "Medium", "project or select"))
    parts.append(spark.createDataFrame(known, "feature string, issue string, n long, severity string, action string"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def high_correlation_pairs(benign: DataFrame, cols: Sequence[str], threshold: float = 0.95,
                           top_k: int | None = None) -> DataFrame:
    """Pairs with ``|r|`` above the threshold, from one aggregate over complete pairs."""
    cols = list(cols)
    if top_k is not None and top_k < len(cols):
        top = {r["feature"] for r in top_k_by_variance(benign, cols, top_k).collect()}
        cols = [c for c in cols if c in top]
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    aggs = [correlation(finite(q(a)), finite(q(b))).alias(f"r{k}") for k, (a, b) in enumerate(pairs)]
    if not pairs:
        return benign.sparkSession.createDataFrame([], "feature_a string, feature_b string, r double")
    entries = [F.struct(F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"), F.col(f"r{k}").alias("r"))
               for k, (a, b) in enumerate(pairs)]
    return benign.agg(*aggs).select(F.inline(F.array(*entries))).filter(
        F.abs("r") > threshold).orderBy(F.desc(F.abs("r")), "feature_a", "feature_b")

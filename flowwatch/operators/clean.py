"""Cleaning: name repair, column decisions, imputation, duplicates, capping."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowwatch.functions.exprs import clip, correlation, finite, numeric_columns, q
from flowwatch.operators.profile import NEAR_CONSTANT, feature_rows, spread
from flowwatch.operators.quantile import exact_percentiles

# Identifier columns of the raw flow files.
ID_COLUMNS = (
    "Flow ID", "Source IP", "Destination IP", "Source Port", "Destination Port", "Timestamp",
    "source_file",
)


def strip_column_names(df: DataFrame, label: str = "Label") -> DataFrame:
    out = df.toDF(*[c.strip() for c in df.columns])
    if label not in out.columns:
        raise KeyError(f"no label column {label!r}")
    return out


def drop_identifier_columns(df: DataFrame, ids: Sequence[str] = ID_COLUMNS) -> DataFrame:
    return df.drop(*[c for c in ids if c in df.columns])


def near_constant_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    cols = numeric_columns(df, exclude)
    if not cols:
        return []
    return [r["feature"] for r in spread(df, cols).collect()
            if r["std"] is not None and r["std"] < NEAR_CONSTANT]


def drop_near_constant(df: DataFrame, exclude: Sequence[str] = ()) -> DataFrame:
    return df.drop(*near_constant_columns(df, exclude))


def nonfinite_to_null(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    cols = set(cols or [f for f, t in df.dtypes if t in ("double", "float")])
    return df.select(*[finite(q(c)).alias(c) if c in cols else q(c) for c in df.columns])


def imputation_plan(df: DataFrame, cols: Sequence[str], label: str = "label", benign: str = "BENIGN",
                    threshold: float = 0.01) -> tuple[dict[str, float], list[str]]:
    """Benign medians of lightly incomplete columns, and the columns to drop."""
    row = df.agg(F.count(F.lit(1)).alias("n"), *[
        F.count(F.when(q(c).isNull(), 1)).alias(f"m{i}") for i, c in enumerate(cols)]).first()
    shares = {c: row[f"m{i}"] / row["n"] if row["n"] else 0.0 for i, c in enumerate(cols)}
    fill = [c for c in cols if 0 < shares[c] < threshold]
    drop = [c for c in cols if shares[c] >= threshold]
    found = exact_percentiles(df.filter(q(label) == benign), fill, [0.5])
    return {c: v[0] for c, v in found.items()}, drop


def impute_or_drop(df: DataFrame, cols: Sequence[str], label: str = "label", benign: str = "BENIGN",
                   threshold: float = 0.01) -> DataFrame:
    fill, drop = imputation_plan(df, cols, label, benign, threshold)
    kept = [c for c in df.columns if c not in drop]
    return df.select(*[
        F.coalesce(q(c), F.lit(fill[c])).alias(c) if fill.get(c) is not None else q(c) for c in kept])


def drop_exact_duplicates(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def repair_label_text(df: DataFrame, label: str = "Label") -> DataFrame:
    """Stray dash bytes 0x96 and 0x97 become ``-``; outer blanks go."""
    fixed = F.trim(F.translate(q(label), "\x96\x97", "--"))
    return df.withColumn(label, fixed)


def binary_label(df: DataFrame, label: str = "Label", benign: str = "BENIGN", out: str = "y") -> DataFrame:
    return df.withColumn(out, (q(label) != benign).cast("int"))


def iqr_bounds(benign: DataFrame, cols: Sequence[str], k: float = 3.0) -> dict[str, tuple[float, float]]:
    found = exact_percentiles(benign, cols, [0.25, 0.75])
    return {c: (a - k * (b - a), b + k * (b - a)) for c, (a, b) in found.items() if a is not None}


def winsorise(df: DataFrame, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    return df.select(*[
        clip(q(c), *bounds[c]).alias(c) if c in bounds else q(c) for c in df.columns])


def capped_counts(df: DataFrame, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    cols = list(bounds)
    row = df.agg(*[
        F.count(F.when((q(c) < bounds[c][0]) | (q(c) > bounds[c][1]), 1)).alias(f"{i}_n_capped")
        for i, c in enumerate(cols)])
    return feature_rows(row, cols, ["n_capped"],
                        {"lower": {c: b[0] for c, b in bounds.items()},
                         "upper": {c: b[1] for c, b in bounds.items()}})


def winsorise_iqr(df: DataFrame, cols: Sequence[str], label: str = "label", benign: str = "BENIGN",
                  k: float = 3.0) -> tuple[DataFrame, DataFrame]:
    """Capped rows and the per-column report; bounds come from benign rows only."""
    bounds = iqr_bounds(df.filter(q(label) == benign), cols, k)
    return winsorise(df, bounds), capped_counts(df, bounds)


def label_leakage_check(df: DataFrame, cols: Sequence[str], y: str = "y", top: int = 20,
                        limit: float = 0.9) -> DataFrame:
    """``|r|`` of each feature with the 0/1 label (Pearson equals point-biserial)."""
    target = q(y).cast("double")
    aggs = []
    for i, c in enumerate(cols):
        aggs += [F.stddev_samp(q(c)).alias(f"{i}_sd"), correlation(q(c).cast("double"), target).alias(f"{i}_r")]
    rows = feature_rows(df.agg(*aggs), cols, ["sd", "r"])
    return (
        rows.filter(F.coalesce(F.col("sd"), F.lit(0.0)) >= 1e-10)
        .select("feature", F.abs("r").alias("abs_r"), (F.abs("r") > limit).alias("leak"))
        .orderBy(F.desc("abs_r"), "feature").limit(top)
    )

"""Column expressions shared by the operators. All stay inside codegen."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INF = float("inf")


def q(name: str) -> Column:
    """Column by exact name, also when the name has blanks, dots or slashes."""
    return F.col("`" + name.replace("`", "``") + "`")


def finite(c: Column) -> Column:
    """NULL for NULL, NaN and both infinities."""
    return F.when(F.abs(c) < F.lit(INF), c)


def clip(c: Column, lo, hi) -> Column:
    """Clip that leaves NULL alone (``least``/``greatest`` skip NULLs)."""
    lo = lo if isinstance(lo, Column) else F.lit(float(lo))
    hi = hi if isinstance(hi, Column) else F.lit(float(hi))
    return F.when(c.isNotNull(), F.least(F.greatest(c, lo), hi))


def ratio(num: Column, den: Column, otherwise=None) -> Column:
    """``num / den`` where the denominator is not zero; never raises in ANSI mode."""
    safe = F.when(den != 0, num / F.when(den != 0, den))
    return safe if otherwise is None else F.coalesce(safe, F.lit(otherwise))


def correlation(a: Column, b: Column) -> Column:
    """Pearson r over complete pairs; NULL (not an ANSI error) for a constant side."""
    both = a.isNotNull() & b.isNotNull()
    spread = F.stddev_pop(F.when(both, a)) * F.stddev_pop(F.when(both, b))
    return ratio(F.covar_pop(a, b), spread)


def hash_key(id_col: str, seed) -> Column:
    """Order key of every seeded choice: the same on any partitioning."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, T.NumericType) and f.name not in exclude
    ]


def sample_skew(g1: Column, n: Column) -> Column:
    """Bias-corrected skewness from Spark's population skewness."""
    return F.when(n > 2, g1 * F.sqrt(n * (n - 1.0)) / F.when(n > 2, n - 2.0))


def sample_kurtosis(g2: Column, n: Column) -> Column:
    """Bias-corrected excess kurtosis from Spark's population kurtosis."""
    return F.when(
        n > 3,
        ((n + 1.0) * g2 + 6.0) * (n - 1.0) / F.when(n > 3, (n - 2.0) * (n - 3.0)),
    )


def as_number(df: DataFrame, col: str) -> Column:
    """Order-preserving double of a numeric, date or timestamp column."""
    kind = df.schema[col].dataType
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return q(col).cast("timestamp").cast("double")
    return q(col).cast("double")

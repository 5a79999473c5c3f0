"""Fitted statistics as a long parquet table ``(kind, feature, stat, pos, value)``."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "kind string, feature string, stat string, pos int, value double"


def params_frame(spark: SparkSession, kind: str,
                 rows: Iterable[tuple[str, str, int, float | None]]) -> DataFrame:
    data = [(kind, f, s, int(p), None if v is None else float(v)) for f, s, p, v in rows]
    return spark.createDataFrame(data, SCHEMA)


def save_params(spark: SparkSession, path: str, kind: str, rows) -> None:
    params_frame(spark, kind, rows).coalesce(1).write.mode("overwrite").parquet(path)


def load_params(spark: SparkSession, path: str, kind: str) -> list[tuple[str, str, int, float | None]]:
    """Rows of one fitted object; a table of another kind is refused."""
    rows = spark.read.schema(SCHEMA).parquet(path).orderBy("pos", "feature", "stat").collect()
    kinds = {r["kind"] for r in rows}
    if kinds != {kind}:
        raise TypeError(f"{path} holds {sorted(map(str, kinds))}, not {kind!r}")
    return [(r["feature"], r["stat"], r["pos"], r["value"]) for r in rows]

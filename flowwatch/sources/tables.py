"""Flow, score and vector views over the given tables, as DataFrames and as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowwatch.functions.exprs import INF, ratio

BENIGN = "BENIGN"
BASE = ["quantity", "price", "discount", "tax"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw flows over ``lineitem``: one unlabelled rate has infinities, one is redundant."""
    li = table(spark, sf_dir, "lineitem")
    c = F.col
    step = (c("l_quantity") - 1.0) + c("l_tax")
    return li.select(
        F.md5(F.concat_ws(
            "|", c("l_orderkey").cast("string"), c("l_linenumber").cast("string"),
            c("l_partkey").cast("string"), c("l_suppkey").cast("string"),
            c("l_shipdate").cast("date").cast("string"))).alias("row_id"),
        c("l_shipdate").cast("date").alias("ship_date"),
        c("l_linestatus").alias("origin"),
        F.when(c("l_returnflag") == "N", BENIGN).otherwise(c("l_returnflag")).alias("label"),
        F.when(c("l_returnflag") == "N", 0).otherwise(1).alias("y"),
        c("l_quantity").alias("quantity"),
        c("l_extendedprice").alias("price"),
        c("l_discount").alias("discount"),
        c("l_tax").alias("tax"),
        ratio(c("l_extendedprice"), step, INF).alias("step_rate"),
        ratio(c("l_extendedprice"), c("l_tax"), INF).alias("tax_rate"),
        (c("l_extendedprice") * (1.0 - c("l_discount"))).alias("net_price"),
        F.lit(1.0).alias("const_one"),
    )


FLOWS = """flows AS (
  SELECT md5(concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_shipdate AS DATE))) AS row_id,
    CAST(l_shipdate AS DATE) AS ship_date, l_linestatus AS origin,
    CASE WHEN l_returnflag = 'N' THEN 'BENIGN' ELSE l_returnflag END AS label,
    CASE WHEN l_returnflag = 'N' THEN 0 ELSE 1 END AS y,
    l_quantity AS quantity, l_extendedprice AS price, l_discount AS discount, l_tax AS tax,
    CASE WHEN (l_quantity - 1.0) + l_tax <> 0 THEN l_extendedprice / ((l_quantity - 1.0) + l_tax)
         ELSE CAST('inf' AS DOUBLE) END AS step_rate,
    CASE WHEN l_tax <> 0 THEN l_extendedprice / l_tax ELSE CAST('inf' AS DOUBLE) END AS tax_rate,
    l_extendedprice * (1.0 - l_discount) AS net_price, CAST(1.0 AS DOUBLE) AS const_one
  FROM lineitem)"""


def packet_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``flows`` under the raw column names that the ratio features read."""
    c = F.col
    return table(spark, sf_dir, "lineitem").select(
        F.md5(F.concat_ws(
            "|", c("l_orderkey").cast("string"), c("l_linenumber").cast("string"),
            c("l_partkey").cast("string"), c("l_suppkey").cast("string"),
            c("l_shipdate").cast("date").cast("string"))).alias("row_id"),
        F.when(c("l_returnflag") == "N", BENIGN).otherwise(c("l_returnflag")).alias("label"),
        c("l_quantity").alias("Total Fwd Packets"),
        c("l_linenumber").cast("double").alias("Total Backward Packets"),
        c("l_extendedprice").alias("Subflow Fwd Bytes"),
        (c("l_partkey") * 10.0).alias("Total Length of Bwd Packets"),
        ratio(c("l_extendedprice"), c("l_quantity")).alias("Average Packet Size"),
        (c("l_suppkey") * 25.0).alias("Max Packet Length"),
        (c("l_discount") * 100.0).alias("Flow IAT Std"),
        (c("l_tax") * 100.0).alias("Flow IAT Mean"),
        (c("l_extendedprice") * c("l_tax")).alias("Packet Length Variance"),
        (c("l_extendedprice") * 0.5).alias("Total Length of Fwd Packets"),
        (c("l_quantity") * 20.0).alias("Packet Length Mean"),
        (c("l_discount") * 40.0).alias("Packet Length Std"),
        (c("l_quantity") * 3.0).alias("Flow IAT Max"),
        (c("l_extendedprice") * 0.01).alias("Flow Duration"),
        (c("l_linenumber") * 7.0).alias("Fwd IAT Max"),
        (c("l_suppkey") * 2.0).alias("Fwd Header Length"),
    )


PACKETS = """packets AS (
  SELECT md5(concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_shipdate AS DATE))) AS row_id,
    CASE WHEN l_returnflag = 'N' THEN 'BENIGN' ELSE l_returnflag END AS label,
    l_quantity AS fwd, CAST(l_linenumber AS DOUBLE) AS bwd, l_extendedprice AS sub_bytes,
    l_partkey * CAST(10.0 AS DOUBLE) AS bwd_bytes,
    CASE WHEN l_quantity <> 0 THEN l_extendedprice / l_quantity END AS avg_size,
    l_suppkey * CAST(25.0 AS DOUBLE) AS max_len,
    l_discount * 100.0 AS iat_std, l_tax * 100.0 AS iat_mean, l_extendedprice * l_tax AS len_var,
    l_extendedprice * 0.5 AS fwd_bytes, l_quantity * 20.0 AS len_mean, l_discount * 40.0 AS len_std,
    l_quantity * 3.0 AS iat_max, l_extendedprice * 0.01 AS duration,
    l_linenumber * CAST(7.0 AS DOUBLE) AS fwd_iat_max, l_suppkey * CAST(2.0 AS DOUBLE) AS header
  FROM lineitem)"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows with two scores and the flag of the first; many tied values on purpose."""
    f = flows(spark, sf_dir)
    s0 = F.col("quantity") / 50.0 + F.col("discount") * 5.0
    return f.select(
        "row_id", "ship_date", "label", "y", "price",
        s0.alias("s0"), (F.col("price") / 105000.0).alias("s1"),
        F.when(s0 > 0.9, 1).otherwise(0).alias("flag"),
    )


SCORED = """scored AS (
  SELECT row_id, ship_date, label, y, price, s0, s1, CASE WHEN s0 > 0.9 THEN 1 ELSE 0 END AS flag
  FROM (SELECT *, quantity / 50.0 + discount * 5.0 AS s0, price / 105000.0 AS s1 FROM flows))"""


def score_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_type").alias("key"), "user_id", F.col("event_id").alias("step"),
        F.col("ts"), F.col("value").alias("score"),
        F.when(F.col("event_type") == "error", 1).otherwise(0).alias("flag"),
    )


STREAM = """stream AS (
  SELECT event_type AS key, user_id, event_id AS step, ts, value AS score,
    CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS flag FROM events)"""


VECTOR_DIMS = 64


def vectors(spark: SparkSession, sf_dir: str, dims: int = VECTOR_DIMS) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        "vec_id", F.col("label").cast("int").alias("label"),
        F.when(F.col("label") == 0, 0).otherwise(1).alias("y"),
        *[F.col("embedding")[i].cast("double").alias(f"x{i}") for i in range(dims)],
    )


VECTORS = """vectors AS (
  SELECT vec_id, label, CASE WHEN label = 0 THEN 0 ELSE 1 END AS y, """ + ", ".join(
    f"CAST(embedding[{i + 1}] AS DOUBLE) AS x{i}" for i in range(VECTOR_DIMS)) + """
  FROM embeddings)"""


def with_views(*views: str) -> str:
    return "WITH " + ",\n".join(views) + "\n"

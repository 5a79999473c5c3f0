"""The split paths of the order primitives must equal a plain sort."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from flowwatch.operators import order, quantile, split
from flowwatch.operators.order import dense_index, hash_cuts, hash_take, prefix_sums, running


def skewed(spark, n=2000):
    """A third of all rows share one key and one value."""
    df = spark.range(n).withColumn("k", F.when(F.col("id") % 3 == 0, "hot").otherwise(
        F.concat(F.lit("k"), (F.col("id") % 7).cast("string"))))
    value = F.when(F.col("id") % 3 == 0, 5.0).otherwise((F.col("id") * 37 % 1009) / 10.0)
    return df.withColumn("v", value).withColumn("h", F.md5(F.col("id").cast("string")))


@pytest.mark.parametrize("by", [[], ["k"]])
def test_dense_index_equals_sort(spark, tiny_tasks, by):
    df = skewed(spark)
    got, n = dense_index(df, "v", "h", by)
    pdf = got.toPandas()
    assert n == 2000 and len(pdf) == 2000
    for _, g in pdf.groupby("k") if by else [(None, pdf)]:
        g = g.sort_values(["v", "h"])
        assert g["idx"].tolist() == list(range(len(g)))


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("by", [[], ["k"]])
def test_prefix_sums_equal_cumsum(spark, tiny_tasks, by, descending):
    df = skewed(spark)
    got = prefix_sums(df, "v", {"n": F.count(F.lit(1)), "s": F.sum("id")}, by, descending).toPandas()
    base = df.toPandas()
    for key, g in base.groupby("k") if by else [(None, base)]:
        want = g.groupby("v").agg(n=("id", "size"), s=("id", "sum")).sort_index(ascending=not descending)
        part = got[got["k"] == key] if by else got
        part = part.sort_values("v", ascending=not descending)
        assert part["v"].tolist() == want.index.tolist()
        assert part["cum_n"].tolist() == want["n"].cumsum().tolist()
        assert part["cum_s"].tolist() == want["s"].cumsum().tolist()
        assert set(part["all_n"]) == {want["n"].sum()}


def test_hash_cut_takes_exact_quota(spark, tiny_tasks):
    df = skewed(spark)
    rows = df.toPandas()
    rows["key"] = df.select(order.hash_key("id", 7).alias("h")).toPandas()["h"]
    assert set(hash_take(df, 700, "id", 7).toPandas()["id"]) == set(rows.sort_values("key")["id"][:700])
    cuts = hash_cuts(df, {"hot": 100, "k1": 3, "k2": 10_000}, "id", 7, ["k"])
    taken = df.filter(order.below_cut(cuts, "id", 7, ["k"])).groupBy("k").count().toPandas().set_index("k")["count"]
    assert taken["hot"] == 100 and taken["k1"] == 3
    assert taken["k2"] == (rows["k"] == "k2").sum()


def test_running_sum_and_min(spark, tiny_tasks):
    df, n = dense_index(skewed(spark), "v", "h", ["k"])
    signed = df.withColumn("x", F.when(F.col("id") % 2 == 0, F.col("v")).otherwise(-F.col("v")))
    got = running(signed, "idx", {"s": ("sum", F.col("x")), "m": ("min", F.col("x"))}, ["k"]).toPandas()
    for _, g in got.groupby("k"):
        g = g.sort_values("idx")
        assert np.allclose(g["s"], g["x"].cumsum())
        assert np.allclose(g["m"], g["x"].cummin())


def test_percentiles_by_brackets(spark, tiny_tasks, monkeypatch):
    monkeypatch.setattr(quantile, "_ACCURACY", 50)
    monkeypatch.setattr(quantile, "HELD_VALUES", 300)
    df = skewed(spark, 6000).withColumn("w", F.col("id") * 1.5 - 100)
    probs = [0.0, 0.01, 0.25, 0.3, 0.5, 0.975, 1.0]
    got = quantile.exact_percentiles(df, ["v", "w"], probs)
    pdf = df.toPandas()
    for c in ("v", "w"):
        assert np.allclose(got[c], np.percentile(pdf[c], [100 * p for p in probs]))


def test_grouped_percentiles_split(spark, tiny_tasks):
    df = skewed(spark)
    got = quantile.grouped_percentiles(df, ["k"], "v", [0.1, 0.5, 0.9]).toPandas().set_index("k")
    for key, g in df.toPandas().groupby("k"):
        assert np.allclose(got.loc[key, ["q0", "q1", "q2"]].astype(float), np.percentile(g["v"], [10, 50, 90]))


def test_percentiles_skip_null_columns(spark):
    df = spark.createDataFrame([(1.0, None), (3.0, None)], "a double, b double")
    assert quantile.exact_percentiles(df, ["a", "b"], [0.5]) == {"a": [2.0], "b": [None]}


def test_rank_in_class_split(spark, tiny_tasks):
    got = split.rank_in_class(skewed(spark), "id", ["k"], 3).toPandas()
    for _, g in got.groupby("k"):
        assert sorted(g["rank"]) == list(range(1, len(g) + 1))


def test_results_do_not_depend_on_partitioning(spark):
    df = skewed(spark)
    a = {r["id"] for r in hash_take(df.repartition(3), 100, "id", 1).collect()}
    b = {r["id"] for r in hash_take(df.repartition(17, "v"), 100, "id", 1).collect()}
    assert a == b


def test_many_percentiles_cost_no_aggregates_each(spark, monkeypatch):
    """A thousand percentiles of a large column are read from one sorted copy."""
    monkeypatch.setattr(quantile, "HELD_VALUES", 100)
    widths, agg = [], type(spark.range(1)).agg
    monkeypatch.setattr(type(spark.range(1)), "agg", lambda self, *e: widths.append(len(e)) or agg(self, *e))
    df = skewed(spark).withColumn("v", F.when(F.col("id") % 50 != 0, F.col("v")))
    probs = [i / 200 for i in range(1, 200)]
    got = quantile.exact_percentiles(df, ["v"], probs)["v"]
    want = np.quantile([r["v"] for r in df.filter("v IS NOT NULL").collect()], probs)
    assert np.allclose(got, want) and max(widths) < 10


def test_index_of_few_long_groups_joins_ranges(spark, tiny_tasks, monkeypatch):
    """Without a small side the first places are joined by group and range, so no task takes a whole group."""
    monkeypatch.setattr(order, "SMALL_ROWS", 0)
    df = skewed(spark)
    got, _ = dense_index(df, "v", "h", ["k"])
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "_range" in plan
    for _, g in got.toPandas().groupby("k"):
        assert sorted(g["idx"]) == list(range(len(g)))


def test_first_rows_of_each_group_rank_parts(spark):
    df = skewed(spark).select("k", "h", "id")
    got = order.first_rows(df, ["k"], [F.desc("h")], 30).toPandas()
    for key, g in df.toPandas().groupby("k"):
        want = g.sort_values("h", ascending=False)["id"].head(30).tolist()
        assert got[got["k"] == key].sort_values("rank")["id"].tolist() == want


def test_balanced_sample_reads_stored_sides(spark):
    """The frames behind the shares are not cut again by what reads the sample."""
    shares = spark.range(400).withColumn("attack_share", F.avg(F.col("id") % 2).over(Window.orderBy("id").rowsBetween(0, 2)))
    got = split.balanced_window_sample(shares.withColumnRenamed("id", "window_id"), 20, low=0.5)
    assert "Window" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert {r["side"]: r["count"] for r in got.groupBy("side").count().collect()} == {0: 10, 1: 10}


def test_windows_order_only_their_columns(spark, monkeypatch):
    from flowwatch.operators import sequence
    seen, index = [], sequence.dense_index
    monkeypatch.setattr(sequence, "dense_index", lambda df, *a, **k: seen.append(df.columns) or index(df, *a, **k))
    got = sequence.train_windows(skewed(spark, 50), ["v"], 2, 2, "id", "h")
    assert seen == [["id", "h", "v"]] and got.count() == 25

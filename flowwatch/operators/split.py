"""Splits, samples and orderings; every random choice is an order by row hash.

Each exact quota is found as a hash cut (:func:`order.hash_cuts`), so assigning
rows is a row-local comparison: no shuffle and no sort of the data.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowwatch.functions.exprs import q
from flowwatch.operators import order
from flowwatch.operators.order import (
    below_cut, class_counts, dense_index, hash_cuts, hash_take, hash_take_per_class, lookup,
)
from flowwatch.session import scratch_path


def one_class_split(df: DataFrame, id_col: str, label: str = "label", benign: str = "BENIGN",
                    test_size: float = 0.2, seed: int = 42) -> DataFrame:
    """Adds ``split`` (train = 80 % of benign, test = the rest and all attacks) and ``y``."""
    is_benign = q(label) == benign
    benign_rows = df.filter(is_benign)
    n = benign_rows.count()
    n_test = max(1, round(n * test_size))
    held = below_cut(hash_cuts(benign_rows, {"": n_test}, id_col, seed, n_rows=n), id_col, seed)
    return df.select(
        "*",
        F.when(is_benign & ~held, "train").otherwise("test").alias("split"),
        F.when(is_benign, 0).otherwise(1).alias("y"),
    ) if "y" not in df.columns else df.withColumn(
        "split", F.when(is_benign & ~held, "train").otherwise("test"))


def stratified_holdout(df: DataFrame, id_col: str, y: str = "y", frac: float = 0.4, seed: int = 42,
                       out: str = "part") -> DataFrame:
    """Adds ``part`` = ``meta`` for each class's share of rows, ``eval`` for the rest."""
    sizes = class_counts(df, [y])
    quotas = {k: max(1, round(n * frac)) if n > 1 else n for k, n in sizes.items()}
    if sum(quotas.values()) >= sum(sizes.values()):
        raise ValueError("the eval part is empty: lower the fraction or add rows")
    cuts = hash_cuts(df, quotas, id_col, seed, [y], n_rows=sum(sizes.values()))
    return df.withColumn(out, F.when(below_cut(cuts, id_col, seed, [y]), "meta").otherwise("eval"))


def stratified_kfold(df: DataFrame, id_col: str, y: str = "y", k: int = 3, seed: int = 42) -> DataFrame:
    """Adds ``fold`` 0..k-1, balanced within every class to one row."""
    sizes = class_counts(df, [y])
    steps = {c: [math.ceil(n * j / k) for j in range(1, k)] for c, n in sizes.items()}
    found = order.hash_at_ranks(df, steps, id_col, seed, [y], n_rows=sum(sizes.values()))
    fold = F.lit(0)
    for j in range(k - 1):
        cuts = {c: found.get((c, steps[c][j]), "g") for c in sizes}
        fold = fold + F.when(below_cut(cuts, id_col, seed, [y]), 0).otherwise(1)
    return df.withColumn("fold", fold)


def cap_sample(df: DataFrame, n: int, id_col: str, seed: int = 42) -> DataFrame:
    """At most ``n`` rows, uniformly and without replacement."""
    return hash_take(df, n, id_col, seed)


def tail_split(df: DataFrame, frac: float, order_col: str, tie_col: str) -> DataFrame:
    """The last share of the rows in order is ``val``, the rest ``train``."""
    indexed, n = dense_index(df, order_col, tie_col)
    n_val = n // 5 if n <= 10 else max(1, int(n * frac))
    return indexed.withColumn("split", F.when(F.col("idx") >= n - n_val, "val").otherwise("train")).drop("idx")


def head_slice(df: DataFrame, n: int, order_col: str, tie_col: str) -> DataFrame:
    """The first ``n`` rows in order."""
    indexed, _ = dense_index(df, order_col, tie_col)
    return indexed.filter(F.col("idx") < n).drop("idx")


def split_summary(df: DataFrame, split: str = "split", y: str = "y") -> DataFrame:
    attacks = F.sum(q(y).cast("long"))
    return df.groupBy(split).agg(
        F.sum(1 - q(y).cast("long")).alias("benign"), attacks.alias("attack"),
        F.count(F.lit(1)).alias("total"), (100.0 * attacks / F.count(F.lit(1))).alias("anomaly_pct"))


def split_label_counts(df: DataFrame, split: str = "split", label: str = "label") -> DataFrame:
    return df.groupBy(split, label).agg(F.count(F.lit(1)).alias("n"))


def random_window_split(windows: DataFrame, frac: float = 0.2, window_col: str = "window_id",
                        seed: int = 42) -> DataFrame:
    """Random train/validation split of windows."""
    n = windows.count()
    n_val = max(1, round(n * frac))
    held = below_cut(hash_cuts(windows, {"": n_val}, window_col, seed, n_rows=n), window_col, seed)
    return windows.withColumn("split", F.when(held, "val").otherwise("train"))


def label_chronology(df: DataFrame, labels: Sequence[str], order_col: str, tie_col: str,
                     label: str = "label") -> DataFrame:
    """Stable position by a fixed label sequence; unknown labels come last."""
    place = F.coalesce(lookup({v: i for i, v in enumerate(labels)}, q(label)), F.lit(len(labels)))
    staged = df.withColumn("_place", place)
    sizes = {r["_place"]: r["count"] for r in staged.groupBy("_place").count().collect()}
    start, starts = 0, {}
    for p in sorted(sizes):
        starts[p] = start
        start += sizes[p]
    indexed, _ = dense_index(staged, order_col, tie_col, by=["_place"])
    return indexed.withColumn("seq", F.col("idx") + lookup(starts, F.col("_place"))).drop("_place", "idx")


def balanced_window_sample(windows: DataFrame, n: int, share: str = "attack_share", low: float = 0.3,
                           high: float | None = None, window_col: str = "window_id",
                           seed: int = 42) -> DataFrame:
    """``n`` windows, half of them above and half at or below the attack-share cut.

    With ``high`` given, the sides are ``share >= high`` and ``share <= low``.
    """
    upper = q(share) > low if high is None else q(share) >= high
    sided = windows.withColumn("side", F.when(upper, 1).when(q(share) <= low, 0))
    path = scratch_path(windows.sparkSession, "sided-windows")  # the frames are cut once for all passes over the sides
    sided.filter(F.col("side").isNotNull()).write.parquet(path)
    sided = windows.sparkSession.read.schema(sided.schema).parquet(path)
    sizes = class_counts(sided, ["side"])
    each = min([n // 2, *sizes.values()]) if len(sizes) == 2 else 0
    return hash_take_per_class(sided, {k: each for k in sizes}, window_col, seed, ["side"])


def class_capped_sample(df: DataFrame, quotas: Mapping[str, int], id_col: str, by: str,
                        seed: int = 42) -> DataFrame:
    """Up to ``quotas[c]`` rows of each class."""
    return hash_take_per_class(df, quotas, id_col, seed, [by])


def benign_quota(n_attack: int, n_benign: int, prevalence: float) -> int:
    """Benign rows to keep so that attacks make up ``prevalence`` of the pool."""
    return min(n_benign, max(1, int(n_attack * (1 - prevalence) / max(prevalence, 1e-9))))


def subsample_to_prevalence(df: DataFrame, prevalence: float, id_col: str, y: str = "y",
                            seed: int = 42) -> DataFrame:
    sizes = df.agg(F.sum(q(y)).alias("p"), F.count(F.lit(1)).alias("n")).first()
    n_attack = int(sizes["p"] or 0)
    keep = benign_quota(n_attack, sizes["n"] - n_attack, prevalence)
    benign = df.filter(q(y) == 0)
    cuts = hash_cuts(benign, {"": keep}, id_col, seed)
    return df.filter((q(y) == 1) | below_cut(cuts, id_col, seed))


def rank_in_class(df: DataFrame, id_col: str, by: Sequence[str], seed: int = 42) -> DataFrame:
    """1-based hash rank inside each class."""
    indexed, _ = dense_index(df.withColumn("_h", order.hash_key(id_col, seed)), "_h", "_h", by=by)
    return indexed.withColumn("rank", F.col("idx") + 1).drop("_h", "idx")

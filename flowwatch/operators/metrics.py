"""Evaluation: confusion counts, ranking metrics, per-attack and per-prevalence tables.

Ranking metrics read one table of distinct scores with running counts
(:func:`order.prefix_sums`); the rows themselves are never sorted.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowwatch.functions.exprs import as_number, q, ratio
from flowwatch.operators import order
from flowwatch.operators.order import below_cut, prefix_sums
from flowwatch.operators.split import benign_quota
from flowwatch.session import scratch_path

# Spellings that mean "no attack".
BENIGN_SPELLINGS = ("BENIGN", "benign", "Benign", "NORMAL")


def count_if(cond: Column) -> Column:
    return F.coalesce(F.sum(F.when(cond, 1).otherwise(0)), F.lit(0)).cast("long")


def confusion_counts(df: DataFrame, y: str = "y", pred: str = "pred", by: Sequence[str] = ()) -> DataFrame:
    t, p = q(y) == 1, q(pred) == 1
    return df.groupBy(*by).agg(
        count_if(~t & ~p).alias("tn"), count_if(~t & p).alias("fp"),
        count_if(t & ~p).alias("fn"), count_if(t & p).alias("tp"))


def with_rates(counts: DataFrame) -> DataFrame:
    """Rates from the four counts; a zero denominator gives 0."""
    tn, fp, fn, tp = (F.col(c).cast("double") for c in ("tn", "fp", "fn", "tp"))
    return counts.select(
        "*",
        ratio(tp, tp + fp, 0.0).alias("precision"), ratio(tp, tp + fn, 0.0).alias("recall"),
        ratio(2.0 * tp, 2.0 * tp + fp + fn, 0.0).alias("f1"),
        ratio(tp + tn, tp + tn + fp + fn, 0.0).alias("accuracy"),
        ratio(fp, fp + tn, 0.0).alias("fpr"), ratio(fn, fn + tp, 0.0).alias("fnr"))


def score_counts(df: DataFrame, score: str, y: str = "y", by: Sequence[str] = ()) -> DataFrame:
    """Distinct scores, highest first, with running true and false positives."""
    return prefix_sums(df, score, {"pos": count_if(q(y) == 1), "neg": count_if(q(y) == 0)}, by,
                       descending=True)


def summarise_curve(curve: DataFrame, by: Sequence[str] = (), target_tpr: float = 0.95,
                    pos: str = "pos", neg: str = "neg", suffix: str = "") -> list[Column]:
    p, n = F.max(f"all_{pos}").cast("double"), F.max(f"all_{neg}").cast("double")
    both = (p > 0) & (n > 0)
    tp, fp = F.col(f"cum_{pos}").cast("double"), F.col(f"cum_{neg}").cast("double")
    area = F.sum(F.col(pos) * (fp - F.col(neg) / 2.0))
    steps = F.sum(F.col(pos) * ratio(tp, tp + fp, 0.0))
    reached = ratio(tp, F.col(f"all_{pos}").cast("double")) >= target_tpr
    first = F.min(F.when(reached, ratio(fp, F.col(f"all_{neg}").cast("double"))))
    return [
        F.when(both, 1.0 - area / F.when(both, p * n)).alias(f"roc_auc{suffix}"),
        F.when(both, steps / F.when(both, p)).alias(f"pr_auc{suffix}"),
        F.when(both, F.coalesce(first, F.lit(1.0))).alias(f"fpr_at_tpr{suffix}"),
    ]


def ranking_metrics(df: DataFrame, score: str, y: str = "y", by: Sequence[str] = (),
                    target_tpr: float = 0.95) -> DataFrame:
    """``roc_auc``, ``pr_auc`` (average precision) and ``fpr_at_tpr``; NULL with one class."""
    curve = score_counts(df, score, y, by)
    return curve.groupBy(*by).agg(*summarise_curve(curve, by, target_tpr))


_LISTS = {"v": "array<double>", "pos": "array<bigint>", "neg": "array<bigint>"}
#: Rows that a task ranks together before they are dealt to ranges.
_HELD_ROWS = 250_000


def _distinct(v: np.ndarray, pos: np.ndarray, neg: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values in order, each once, with the sums of their counts; NaN is one value above all others."""
    order_ = np.argsort(v, kind="stable")
    v = v[order_]
    first = np.flatnonzero(np.r_[True, ~((v[1:] == v[:-1]) | (np.isnan(v[1:]) & np.isnan(v[:-1])))]) if len(v) else []
    return v[first], *(np.add.reduceat(c[order_], first) if len(v) else c for c in (pos, neg))


def mixed_ranges(df: DataFrame, mixes: Mapping[str, Column], y: Column, lists: Sequence[str] = ("v", "pos", "neg")) -> DataFrame:
    """Distinct values of many scores of the same rows, with both classes' counts, as one written row a range of a score.
    Of the values ``v`` and the counts, only the ``lists`` that the caller reads are written.

    The rows are never multiplied: a task sorts each score of the rows it holds, merges equal values and sends them as
    arrays to ranges of that score, where they are merged once. ``m`` numbers the scores, ``r`` their ranges.
    """
    spark, names = df.sparkSession, list(mixes)
    wide = df.select(y.cast("int").alias("y"), *[c.cast("double").alias(f"m{i}") for i, c in enumerate(mixes.values())])
    rows = wide.count()
    parts = -(-rows // (10 * order.TASK_ROWS))
    splits = [np.unique(b) for b in order.many_range_splits(wide, [F.col(f"m{i}") for i in range(len(names))], parts, rows)]

    def ranked(held: pa.Table):
        y_ = held.column("y").to_numpy()
        pos, neg = (y_ == 1).astype(np.int64), (y_ == 0).astype(np.int64)
        for i in range(len(names)):
            column = held.column(f"m{i}")
            known = column.is_valid().to_numpy()
            v, p, n = _distinct(column.to_numpy()[known], pos[known], neg[known])
            ends = np.r_[0, np.searchsorted(v, splits[i], side="left"), len(v)]
            lists = lambda c, t: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(c, t))
            yield pa.RecordBatch.from_pydict({
                "m": pa.array([i] * (len(ends) - 1), pa.int32()), "r": pa.array(range(len(ends) - 1), pa.int32()),
                "v": lists(v, pa.float64()), "pos": lists(p, pa.int64()), "neg": lists(n, pa.int64())})

    def send(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= _HELD_ROWS:
                yield from ranked(pa.Table.from_batches(held))
                held = []
        if held:
            yield from ranked(pa.Table.from_batches(held))

    def merge(group: pa.Table) -> pa.Table:
        flat = [np.concatenate([np.asarray(x.flatten().to_numpy()) for x in group.column(c).chunks]) for c in ("v", "pos", "neg")]
        v, p, n = _distinct(*flat)
        written = {"v": pa.array([v], pa.list_(pa.float64())), "pos": pa.array([p], pa.list_(pa.int64())),
                   "neg": pa.array([n], pa.list_(pa.int64()))}
        return pa.table({"m": group.column("m")[:1], "r": group.column("r")[:1]} | {c: written[c] for c in lists} | {
                         "p": pa.array([int(p.sum())], pa.int64()), "n": pa.array([int(n.sum())], pa.int64())})

    path = scratch_path(spark, "mixes")
    merged = ", ".join(["m int, r int", *[f"{c} {_LISTS[c]}" for c in lists], "p long, n long"])
    wide.mapInArrow(send, "m int, r int, v array<double>, pos array<bigint>, neg array<bigint>").groupBy("m", "r").applyInArrow(
        merge, merged).write.parquet(path)
    return spark.read.schema(merged).parquet(path)


def _with_others(merged: DataFrame, order_: Column) -> DataFrame:
    """Adds each class's count in the ranges before (``over_``) and in all ranges of the score (``all_``)."""
    before = Window.partitionBy("m").orderBy(order_).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("m")
    offsets = merged.select("m", "r", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"over_{c}") for c in ("p", "n")],
                            *[F.sum(c).over(whole).alias(f"all_{c}") for c in ("p", "n")])
    return order.join_small(merged, offsets, ["m", "r"])


def mixed_percentiles(df: DataFrame, mixes: Mapping[str, Column], probs: Sequence[float]) -> dict[str, list[float | None]]:
    """Exact, linearly interpolated percentiles of many scores of the same rows, as driver values."""
    placed = _with_others(mixed_ranges(df, mixes, F.lit(1), ("v", "pos")), F.col("r"))

    def picked(batches):
        for batch in batches:
            out = []
            for r in range(batch.num_rows):
                m, over, whole, here = (batch.column(c)[r].as_py() for c in ("m", "over_p", "all_p", "p"))
                v, upto = batch.column("v")[r].values.to_numpy(), np.cumsum(batch.column("pos")[r].values.to_numpy())
                for i, p in enumerate(probs):
                    spot = p * (whole - 1)
                    for side, rank in (("lo", math.floor(spot)), ("hi", math.ceil(spot))):
                        if over <= rank < over + here:
                            out.append((m, i, side, float(v[np.searchsorted(upto, rank - over, side="right")]), whole))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 5, (
                pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.int64()), strict=True)], ["m", "i", "side", "v", "n"])

    rows = placed.mapInArrow(picked, "m int, i int, side string, v double, n long").collect()
    at, sizes = {(r["m"], r["i"], r["side"]): r["v"] for r in rows}, {r["m"]: r["n"] for r in rows}
    found: dict[str, list[float | None]] = {}
    for m, name in enumerate(mixes):
        found[name] = [None] * len(probs)
        for i, p in enumerate(probs if m in sizes else ()):
            spot, a, b = p * (sizes[m] - 1), at[m, i, "lo"], at[m, i, "hi"]
            found[name][i] = a + (b - a) * (spot - math.floor(spot))
    return found


def mixed_ranking(df: DataFrame, mixes: Mapping[str, Column], y: str = "y", target_tpr: float = 0.95) -> DataFrame:
    """``(m, roc_auc, pr_auc, fpr_at_tpr)`` of many scores of the same rows; ``m`` numbers the scores.

    A range is summed up in its task; what lies above it is added as two numbers.
    """
    placed = _with_others(mixed_ranges(df, mixes, q(y), ("pos", "neg")), F.desc("r"))

    def summed(batches):
        for batch in batches:
            out = []
            for r in range(batch.num_rows):
                pos, neg = (batch.column(c)[r].values.to_numpy()[::-1] for c in ("pos", "neg"))
                at = {c: batch.column(c)[r].as_py() for c in ("m", "over_p", "over_n", "all_p", "all_n")}
                tp, fp = at["over_p"] + np.cumsum(pos), at["over_n"] + np.cumsum(neg)
                seen = np.maximum(tp + fp, 1)
                hit = tp / max(at["all_p"], 1) >= target_tpr
                out.append((at["m"], at["all_p"], at["all_n"], float(np.sum(pos * (fp - neg / 2.0))), float(np.sum(pos * (tp / seen))),
                            float(fp[hit.argmax()]) if hit.any() else None))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 6, (
                pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()), strict=True)],
                ["m", "p", "n", "area", "steps", "reached"])

    sums = placed.mapInArrow(summed, "m int, p long, n long, area double, steps double, reached double").groupBy("m").agg(
        F.max("p").alias("p"), F.max("n").alias("n"), F.sum("area").alias("area"), F.sum("steps").alias("steps"),
        F.min("reached").alias("reached"))
    both = (F.col("p") > 0) & (F.col("n") > 0)
    return sums.select(
        "m", F.when(both, 1.0 - F.col("area") / F.when(both, F.col("p").cast("double") * F.col("n"))).alias("roc_auc"),
        F.when(both, F.col("steps") / F.when(both, F.col("p"))).alias("pr_auc"),
        F.when(both, F.coalesce(F.col("reached") / F.when(both, F.col("n")), F.lit(1.0))).alias("fpr_at_tpr"))


def roc_auc(df: DataFrame, score: str, y: str = "y", by: Sequence[str] = ()) -> DataFrame:
    return ranking_metrics(df, score, y, by).select(*by, "roc_auc")


def average_precision(df: DataFrame, score: str, y: str = "y", by: Sequence[str] = ()) -> DataFrame:
    return ranking_metrics(df, score, y, by).select(*by, "pr_auc")


def fpr_at_tpr(df: DataFrame, score: str, y: str = "y", target: float = 0.95,
               by: Sequence[str] = ()) -> DataFrame:
    return ranking_metrics(df, score, y, by, target).select(*by, "fpr_at_tpr")


def classification_metrics(df: DataFrame, y: str = "y", pred: str = "pred", score: str | None = None,
                           by: Sequence[str] = ()) -> DataFrame:
    out = with_rates(confusion_counts(df, y, pred, by))
    if score is None:
        return out
    ranks = ranking_metrics(df, score, y, by).drop("fpr_at_tpr")
    if by:
        return out.join(ranks, list(by))
    # Two one-row results: keep the second as scalars, no join of data.
    row = ranks.first()
    return out.withColumn("roc_auc", F.lit(row["roc_auc"]).cast("double")).withColumn(
        "pr_auc", F.lit(row["pr_auc"]).cast("double"))


def roc_curve(df: DataFrame, score: str, y: str = "y", by: Sequence[str] = ()) -> DataFrame:
    return score_counts(df, score, y, by).select(
        *by, q(score).alias("threshold"),
        ratio(F.col("cum_neg").cast("double"), F.col("all_neg")).alias("fpr"),
        ratio(F.col("cum_pos").cast("double"), F.col("all_pos")).alias("tpr"))


def pr_curve(df: DataFrame, score: str, y: str = "y", by: Sequence[str] = ()) -> DataFrame:
    return score_counts(df, score, y, by).select(
        *by, q(score).alias("threshold"),
        ratio(F.col("cum_pos").cast("double"), F.col("all_pos")).alias("recall"),
        ratio(F.col("cum_pos").cast("double"), F.col("cum_pos") + F.col("cum_neg")).alias("precision"))


def confusion_percent(df: DataFrame, y: str = "y", pred: str = "pred") -> DataFrame:
    """Row-normalised confusion matrix in long form."""
    cells = df.groupBy(q(y).alias("y_true"), q(pred).alias("y_pred")).agg(F.count(F.lit(1)).alias("n"))
    whole = F.sum("n").over(Window.partitionBy("y_true"))  # at most two cells per row
    return cells.withColumn("pct", 100.0 * F.col("n") / whole)


def detection_rate_by_label(df: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    attacks = df.filter(~q(label).isin(*BENIGN_SPELLINGS))
    return attacks.groupBy(q(label).alias("label")).agg(
        F.count(F.lit(1)).alias("total"), count_if(q(pred) == 1).alias("detected"),
    ).select("label", "total", "detected", (F.col("total") - F.col("detected")).alias("missed"),
             (100.0 * F.col("detected") / F.col("total")).alias("rate_pct")).orderBy(F.desc("total"), "label")


def per_attack_table(df: DataFrame, score: str, label: str = "label", y: str = "y",
                     pred: str | None = None) -> DataFrame:
    """Count, mean score, AUC against all benign rows and detection rate per attack type."""
    benign = prefix_sums(df, score, {"neg": count_if(q(y) == 0)})
    flagged = [count_if(q(pred) == 1).alias("hits")] if pred else []
    types = df.filter(q(y) == 1).groupBy(q(label).alias("attack_type"), q(score)).agg(
        F.count(F.lit(1)).alias("n"), *flagged)
    joined = types.join(benign, score)
    n, total = F.sum("n").cast("double"), F.max("all_neg").cast("double")
    wins = F.sum(F.col("n") * (F.col("cum_neg") - F.col("neg") / 2.0))
    rate = [(F.sum("hits") / n).alias("detection_rate")] if pred else []
    return joined.groupBy("attack_type").agg(
        F.sum("n").alias("count"), (F.sum(F.col("n") * q(score)) / n).alias("mean_score"),
        F.when(total > 0, wins / F.when(total > 0, n * total)).alias("auc_vs_benign"), *rate,
    ).orderBy(F.desc("count"), "attack_type")


def prevalence_sweep(df: DataFrame, score: str, id_col: str, y: str = "y",
                     prevalences: Sequence[float] = (0.20, 0.10, 0.05, 0.01), seed: int = 42) -> DataFrame:
    """Average precision and FPR at 95 % TPR as attacks get rarer.

    All prevalences share one table of distinct scores: each has its own benign
    count column, so rows are not copied per prevalence.
    """
    sizes = df.agg(count_if(q(y) == 1).alias("p"), count_if(q(y) == 0).alias("n")).first()
    benign = df.filter(q(y) == 0)
    sums: dict[str, Column] = {"pos": count_if(q(y) == 1)}
    keeps = [benign_quota(sizes["p"], sizes["n"], p) for p in prevalences]
    # The cuts are nested ranks of one hash order, so one search finds them all.
    found = order.hash_at_ranks(benign, {"": [k for k in keeps if k < sizes["n"]]}, id_col, seed, n_rows=sizes["n"])
    for i, keep in enumerate(keeps):
        inside = below_cut({"": found.get(("", keep), "g")}, id_col, seed)
        sums[f"neg{i}"] = count_if((q(y) == 0) & inside)
    curve = prefix_sums(df, score, sums, descending=True)
    aggs: list[Column] = []
    for i in range(len(prevalences)):
        aggs += summarise_curve(curve, neg=f"neg{i}", suffix=f"_{i}")
    row = curve.agg(*aggs)
    entries = [F.struct(
        F.lit(float(p)).alias("prevalence"), F.lit(keeps[i] + sizes["p"]).cast("long").alias("n"),
        F.lit(sizes["p"]).cast("long").alias("n_attacks"), F.col(f"pr_auc_{i}").alias("pr_auc"),
        F.col(f"fpr_at_tpr_{i}").alias("fpr_at_95tpr"), F.lit(float(p)).alias("random_baseline_pr_auc"))
        for i, p in enumerate(prevalences)]
    return row.select(F.inline(F.array(*entries)))


def weak_spots(rates: DataFrame, below_pct: float = 50.0, top: int = 5) -> DataFrame:
    return rates.filter(F.col("rate_pct") < below_pct).orderBy("rate_pct", "label").limit(top)


def eval_only_filter(df: DataFrame, eval_ids: DataFrame, id_col: str) -> DataFrame:
    return df.join(eval_ids.select(id_col), id_col, "left_semi")


def leaked_rows(df: DataFrame, meta_ids: DataFrame, eval_ids: DataFrame, id_col: str) -> DataFrame:
    """Rows of both parts; empty when the parts are disjoint."""
    return df.join(meta_ids.select(id_col), id_col, "left_semi").join(
        eval_ids.select(id_col), id_col, "left_semi")


def error_category(df: DataFrame, y: str = "y", pred: str = "pred") -> DataFrame:
    t, p = q(y) == 1, q(pred) == 1
    return df.withColumn(
        "category", F.when(t & p, "TP").when(~t & ~p, "TN").when(~t & p, "FP").otherwise("FN"))


def false_negatives_by_type(df: DataFrame, label: str = "label", y: str = "y", pred: str = "pred") -> DataFrame:
    return df.filter(q(y) == 1).groupBy(q(label).alias("label")).agg(
        F.count(F.lit(1)).alias("total"), count_if(q(pred) == 0).alias("missed"),
    ).withColumn("miss_rate", F.col("missed") / F.col("total"))


def missed_attack_profile(df: DataFrame, scores: Sequence[str], label: str = "label", y: str = "y",
                          pred: str = "pred") -> DataFrame:
    missed = q(pred) == 0
    return df.filter(q(y) == 1).groupBy(q(label).alias("label")).agg(
        F.count(F.lit(1)).alias("total"), count_if(~missed).alias("detected"),
        count_if(missed).alias("missed"), (100.0 * count_if(~missed) / F.count(F.lit(1))).alias("rate_pct"),
        *[F.avg(F.when(missed, q(s))).alias(f"mean_{s}_missed") for s in scores])


def model_pair_by_attack(df: DataFrame, pred_a: str, pred_b: str, label: str = "label",
                         y: str = "y") -> DataFrame:
    rate = lambda p: 100.0 * count_if(q(p) == 1) / F.count(F.lit(1))
    return df.filter(q(y) == 1).groupBy(q(label).alias("label")).agg(
        F.count(F.lit(1)).alias("total"), count_if(q(pred_a) == 1).alias("detected_a"),
        count_if(q(pred_b) == 1).alias("detected_b"), rate(pred_a).alias("rate_a"),
        rate(pred_b).alias("rate_b"), (rate(pred_b) - rate(pred_a)).alias("delta_points"))


def model_pair_auc_by_attack(df: DataFrame, score_a: str, score_b: str, label: str = "label",
                             y: str = "y") -> DataFrame:
    a = per_attack_table(df, score_a, label, y).select("attack_type", F.col("auc_vs_benign").alias("auc_a"))
    b = per_attack_table(df, score_b, label, y).select("attack_type", F.col("auc_vs_benign").alias("auc_b"))
    return a.join(b, "attack_type").withColumn(
        "better", F.when(F.col("auc_a") > F.col("auc_b"), score_a).otherwise(score_b))


def comparison_table(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Metric rows of several models, one under the other."""
    out: DataFrame | None = None
    for name, frame in tables.items():
        named = frame.select(F.lit(name).alias("model"), "*")
        out = named if out is None else out.unionByName(named, allowMissingColumns=True)
    if out is None:
        raise ValueError("no tables to compare")
    return out


def pick_best_model(table: DataFrame, metric: str = "f1", name: str = "model") -> DataFrame:
    """The model with the highest metric; ties go to the first name."""
    return table.filter(q(metric).isNotNull()).orderBy(F.desc(metric), name).limit(1).select(name, metric)


def bootstrap_ci(df: DataFrame, score: str, y: str = "y", metric: str = "roc_auc", n_boot: int = 500,
                 alpha: float = 0.05, seed: int = 42) -> DataFrame:
    """Percentile bootstrap of ``roc_auc`` or ``pr_auc`` over distinct scores.

    Every replicate reweights each (score, class) count by a Poisson draw. Score
    ranges are processed apart: a first pass sums the weights per range and
    replicate, a second one adds what lies above the range. Rows are not copied
    per replicate and no task sees more than one range.
    """
    if metric not in ("roc_auc", "pr_auc"):
        raise ValueError("metric must be roc_auc or pr_auc")
    rows = df.filter(q(score).isNotNull()).select(as_number(df, score).alias("s"), q(y).cast("int").alias("y"))
    n = rows.count()
    splits = order.range_splits(rows, F.col("s"), 8 + n // 2_000_000, n) if n else []
    merged = rows.groupBy("s").agg(count_if(F.col("y") == 1).alias("pos"), count_if(F.col("y") == 0).alias("neg"))
    cut = order.with_range_bucket(merged, F.col("s"), splits, "b").select("b", "s", "pos", "neg")
    by_auc = metric == "roc_auc"

    def draws(pdf: pd.DataFrame):
        """Weight columns of one replicate after another; replicate 0 is the data itself."""
        pdf = pdf.sort_values("s", ascending=False)
        pos, neg = pdf["pos"].to_numpy(float), pdf["neg"].to_numpy(float)
        rng = np.random.default_rng([seed, int(pdf["b"].iloc[0]) + 1])
        for rep in range(n_boot + 1):
            yield rep, (pos if rep == 0 else rng.poisson(pos)), (neg if rep == 0 else rng.poisson(neg))

    def weigh(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(int(pdf["b"].iloc[0]), rep, float(p.sum()), float(m.sum()))
                             for rep, p, m in draws(pdf)], columns=["b", "rep", "wp", "wn"])

    def steps(rows_: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        if rows_.empty:
            return pd.DataFrame({"rep": [], "part": []})
        up = above.set_index("rep")
        out = []
        for rep, p, m in draws(rows_):
            tp = up.at[rep, "tp"] + np.cumsum(p)
            fp = up.at[rep, "fp"] + np.cumsum(m)
            if by_auc:
                part = np.sum(p * (fp - m / 2.0))
            else:
                part = np.sum(p * np.divide(tp, tp + fp, out=np.zeros_like(tp), where=tp + fp > 0))
            out.append((rep, float(part)))
        return pd.DataFrame(out, columns=["rep", "part"])

    weights = cut.groupBy("b").applyInPandas(weigh, "b int, rep int, wp double, wn double")
    before = Window.partitionBy("rep").orderBy(F.desc("b")).rowsBetween(Window.unboundedPreceding, -1)
    above = weights.select(
        "b", "rep", F.coalesce(F.sum("wp").over(before), F.lit(0.0)).alias("tp"),
        F.coalesce(F.sum("wn").over(before), F.lit(0.0)).alias("fp"))
    totals = weights.groupBy("rep").agg(F.sum("wp").alias("p"), F.sum("wn").alias("n"))
    parts = cut.groupBy("b").cogroup(above.groupBy("b")).applyInPandas(steps, "rep int, part double")
    joined = parts.groupBy("rep").agg(F.sum("part").alias("part")).join(totals, "rep")
    pn = F.col("p") * F.col("n")
    value = 1.0 - ratio(F.col("part"), pn) if by_auc else F.when(pn > 0, ratio(F.col("part"), F.col("p")))
    reps = joined.select("rep", value.alias("v"))
    drawn = F.when(F.col("rep") > 0, F.col("v"))
    return reps.agg(
        F.max(F.when(F.col("rep") == 0, F.col("v"))).alias("estimate"),
        F.percentile(drawn, F.lit(alpha / 2)).alias("ci_lower"),
        F.percentile(drawn, F.lit(1 - alpha / 2)).alias("ci_upper"))

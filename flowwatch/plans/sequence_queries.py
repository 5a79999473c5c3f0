"""Queries of sequence windows, calibration and fusion."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowwatch.operators import fuse, sequence, split
from flowwatch.operators.metrics import classification_metrics
from flowwatch.operators.order import dense_index
from flowwatch.plans.catalog import query, rounded
from flowwatch.plans.split_queries import AP, AUC, CONF, COUNTS, RARE, RATES, curve_sql, rare
from flowwatch.sources.tables import FLOWS, SCORED, flows, scored, with_views

W, S = 10, 5
IDX = "idx AS (SELECT *, row_number() OVER (ORDER BY ship_date, row_id) - 1 AS idx, count(*) OVER () AS total FROM flows)"
BIDX = "idx AS (SELECT *, row_number() OVER (ORDER BY ship_date, row_id) - 1 AS idx, count(*) OVER () AS total FROM flows WHERE label = 'BENIGN')"


def cover(w: int = W, s: int = S) -> str:
    return f"""cover AS (SELECT w AS window_id, idx - w * {s} AS pos, i.* FROM idx i, LATERAL (
  SELECT unnest(range(CAST(greatest(0, ceil((idx - {w - 1}) / CAST({s} AS DOUBLE))) AS BIGINT),
    CAST(least(idx // {s}, (total - {w}) // {s}) AS BIGINT) + 1)) AS w))"""


def indexed(spark, d, benign=False):
    f = flows(spark, d).select("row_id", "ship_date", "label", "y", "quantity", "price")
    return dense_index(f.filter("label = 'BENIGN'") if benign else f, "ship_date", "row_id")


def unrolled(windows):
    return windows.select("window_id", F.inline("steps")).select(
        "window_id", F.col("pos").cast("int").alias("pos"), F.col("x")[0].alias("quantity"), F.col("x")[1].alias("price"))


@query("train_windows", with_views(FLOWS, BIDX, cover()) + "SELECT window_id, CAST(pos AS INTEGER) AS pos, quantity, price FROM cover")
def _(spark, d):
    f = flows(spark, d).filter("label = 'BENIGN'")
    return unrolled(sequence.train_windows(f, ["quantity", "price"], W, S, "ship_date", "row_id"))


@query("eval_windows", with_views(FLOWS, IDX, cover()) + "SELECT window_id, row_id, pos FROM cover")
def _(spark, d):
    f = flows(spark, d)
    _, coverage, _, _ = sequence.eval_windows(f, ["quantity", "price"], W, S, "ship_date", "row_id")
    return coverage.select("window_id", "row_id", "pos")


@query("scatter_to_rows", with_views(FLOWS, IDX, cover()) + """
, r AS (SELECT row_id, avg(quantity * (1 + pos)) AS score FROM cover GROUP BY row_id)
SELECT i.row_id, round(coalesce(score, (SELECT avg(score) FROM r)), 6) AS score FROM idx i LEFT JOIN r USING (row_id)""".replace("\n, r", ", r", 1))
def _(spark, d):
    f = flows(spark, d)
    windows, _, rows, n = sequence.eval_windows(f, ["quantity"], W, S, "ship_date", "row_id")
    errors = windows.select("window_id", F.transform("steps", lambda s: s["x"][0] * (1 + s["pos"])).alias("errors"))
    return rounded(sequence.scatter_to_rows(errors, rows, n, W, S).select("row_id", "score"))


@query("window_error_to_rows", with_views(FLOWS, IDX, cover(W, 1)) + """
, e AS (SELECT window_id, avg(quantity) AS error FROM cover GROUP BY window_id)
SELECT row_id, round(avg(error), 6) AS score FROM cover JOIN e USING (window_id) GROUP BY row_id""".replace("\n, e", ", e", 1))
def _(spark, d):
    windows, _, rows, _ = sequence.eval_windows(flows(spark, d), ["quantity"], W, 1, "ship_date", "row_id")
    total = F.aggregate("steps", F.lit(0.0), lambda acc, s: acc + s["x"][0])
    errors = windows.select("window_id", (total / float(W)).alias("error"))
    return rounded(sequence.window_error_to_rows(errors, rows.select("row_id", "idx"), W, 1).select("row_id", "score"))


@query("window_label", with_views(FLOWS, IDX, cover()) + """
SELECT window_id, CASE WHEN avg(y) > 0.6 THEN 1 ELSE 0 END AS label FROM cover GROUP BY window_id""")
def _(spark, d):
    rows, n = indexed(spark, d)
    return sequence.window_label(rows, n, W, S, min_frac=0.6)


@query("window_attack_share", with_views(FLOWS, IDX, cover()) + """
SELECT window_id, round(avg(y), 6) AS attack_share FROM cover GROUP BY window_id""")
def _(spark, d):
    rows, n = indexed(spark, d)
    return rounded(sequence.window_attack_share(rows, n, W, S))


@query("truncate_windows", with_views(FLOWS, BIDX, cover()) + """
SELECT window_id, CAST(pos AS INTEGER) AS pos, quantity, price FROM cover WHERE pos < 4""")
def _(spark, d):
    f = flows(spark, d).filter("label = 'BENIGN'")
    return unrolled(sequence.truncate_windows(
        sequence.train_windows(f, ["quantity", "price"], W, S, "ship_date", "row_id"), 4))


SHARES = "shares AS (SELECT window_id, avg(y) AS attack_share FROM cover GROUP BY window_id)"


@query("balanced_window_sample", with_views(FLOWS, IDX, cover(), SHARES) + """
SELECT window_id, side FROM (SELECT *, row_number() OVER (PARTITION BY side ORDER BY md5('42:' || window_id)) AS rn FROM (
  SELECT window_id, CASE WHEN attack_share > 0.6 THEN 1 ELSE 0 END AS side FROM shares))
WHERE rn <= least(1000, (SELECT least(count(*) FILTER (attack_share > 0.6), count(*) FILTER (attack_share <= 0.6)) FROM shares))""")
def _(spark, d):
    rows, n = indexed(spark, d)
    shares = sequence.window_attack_share(rows, n, W, S)
    return split.balanced_window_sample(shares, 2000, low=0.6).select("window_id", "side")


@query("random_window_split", with_views(FLOWS, BIDX, cover()) + """
SELECT window_id, CASE WHEN row_number() OVER (ORDER BY md5('42:' || window_id)) <= greatest(1, round(count(*) OVER () * 0.2))
  THEN 'val' ELSE 'train' END AS split FROM (SELECT DISTINCT window_id FROM cover)""")
def _(spark, d):
    f = flows(spark, d).filter("label = 'BENIGN'")
    windows = sequence.train_windows(f, ["quantity", "price"], W, S, "ship_date", "row_id")
    return split.random_window_split(windows.select("window_id"))


# --- thresholds and fusion -------------------------------------------------------------


@query("percentile_threshold", with_views(FLOWS, SCORED) + """
SELECT p AS pct, round(t, 6) AS threshold, count(*) FILTER (s1 > t AND y = 0) AS benign_flagged, count(*) FILTER (s1 > t AND y = 1) AS attacks_flagged
FROM scored, (SELECT 95 AS p, quantile_cont(s1, 0.95) AS t FROM scored WHERE y = 0) GROUP BY p, t""")
def _(spark, d):
    s = scored(spark, d)
    t = fuse.percentile_threshold(s.filter("y = 0"), "s1", 95)
    flagged = fuse.flag_above(s, "s1", t)
    return rounded(flagged.agg(
        F.lit(95).alias("pct"), F.lit(t).alias("threshold"),
        F.count(F.when((F.col("pred") == 1) & (F.col("y") == 0), 1)).alias("benign_flagged"),
        F.count(F.when((F.col("pred") == 1) & (F.col("y") == 1), 1)).alias("attacks_flagged")))


@query("threshold_sweep", with_views(FLOWS, SCORED) + f"""
SELECT round(t, 9) AS threshold, {COUNTS}, {RATES} FROM (
  SELECT t, {CONF.replace('flag = 0', 's1 <= t').replace('flag = 1', 's1 > t')} FROM scored,
    (SELECT DISTINCT unnest(quantile_cont(s1, [{", ".join(str(i / 100) for i in range(1, 40))}])) AS t FROM scored WHERE y = 0) GROUP BY t)""")
def _(spark, d):
    from flowwatch.operators.quantile import exact_percentiles
    s = scored(spark, d)
    cuts = exact_percentiles(s.filter("y = 0"), ["s1"], [i / 100 for i in range(1, 40)])["s1"]
    return rounded(fuse.threshold_sweep(s, "s1", cuts), threshold=9)


@query("minmax_clip", with_views(FLOWS, SCORED) + """
SELECT row_id, round(least(greatest((s0 - lo) / (hi - lo + 1e-8), 0), 1), 6) AS s0 FROM scored,
  (SELECT min(s0) AS lo, max(s0) AS hi FROM scored WHERE y = 0 AND price < 50000)""")
def _(spark, d):
    s = scored(spark, d)
    bounds = fuse.fit_minmax(s.filter("y = 0 AND price < 50000"), ["s0"])
    return rounded(fuse.minmax_clip(s.select("row_id", "s0"), bounds))


@query("isotonic_apply")
def _(spark, d):
    s = split.stratified_holdout(rare(spark, d), "row_id")
    model = fuse.isotonic_fit(s.filter("part = 'meta'"), "s1")
    return rounded(fuse.isotonic_apply(s.filter("part = 'eval'"), model, "s1", "calibrated").select("row_id", "s1", "calibrated"))


@query("isotonic_fit", with_views(FLOWS, """merged AS (SELECT CAST(floor(price / 1050.0) AS DOUBLE) AS s, sum(y) AS wy, count(*) AS w FROM flows GROUP BY 1),
summed AS (SELECT s, wy, w, sum(wy) OVER (ORDER BY s) AS cy, sum(w) OVER (ORDER BY s) AS cw FROM merged),
means AS (SELECT a.s AS a, b.s AS b, (b.cy - a.cy + a.wy) / CAST(b.cw - a.cw + a.w AS DOUBLE) AS m
  FROM summed a JOIN summed b ON b.s >= a.s),
lows AS (SELECT x.s, p.a, min(p.m) AS low FROM summed x JOIN means p ON p.a <= x.s AND p.b >= x.s GROUP BY x.s, p.a)""") + """
SELECT s, round(max(low), 6) AS calibrated FROM lows GROUP BY s""")
def _(spark, d):
    """The level at every distinct score: the largest of the smallest means of the stretches around it."""
    s = flows(spark, d).select(F.floor(F.col("price") / 1050.0).cast("double").alias("s"), "y")
    return rounded(fuse.isotonic_apply(s.select("s").distinct(), fuse.isotonic_fit(s, "s"), "s", "calibrated"))


@query("meta_features", with_views(FLOWS, SCORED) + """
SELECT row_id, y, s0 AS quantity_score, s1 AS price_score FROM scored""")
def _(spark, d):
    s = scored(spark, d)
    return fuse.meta_features(
        {"quantity_score": s.select("row_id", F.col("s0").alias("score")),
         "price_score": s.select("row_id", F.col("s1").alias("score"))},
        "row_id", keep=s.select("row_id", "y"))


def _grid_sql() -> str:
    alphas = [round(0.1 * i, 1) for i in range(1, 10)]
    mix = "mix AS (" + "\nUNION ALL\n".join(
        f"SELECT CAST({a} AS DOUBLE) AS alpha, y, label, CAST({a} AS DOUBLE) * s0 + (CAST(1.0 AS DOUBLE) - CAST({a} AS DOUBLE)) * s1 AS s FROM scored" for a in alphas) + ")"
    cuts = "cuts AS (SELECT alpha, unnest(range(1, 25)) AS pct, unnest(q) AS t FROM (SELECT alpha, quantile_cont(s, [" + ", ".join(
        str(i / 100) for i in range(1, 25)) + "]) AS q FROM mix WHERE y = 0 GROUP BY alpha))"
    auc = curve_sql("mix", "s", by="alpha") + f", auc AS (SELECT alpha, {AUC} AS auc FROM curve GROUP BY alpha)"
    return with_views(FLOWS, SCORED, mix, cuts, auc) + """
SELECT alpha, CAST(pct AS INTEGER) AS pct, round(2 * tp / CAST(2 * tp + fp + fn AS DOUBLE), 6) AS f1, round(auc, 6) AS auc FROM (
  SELECT m.alpha, c.pct, sum(CASE WHEN s > t AND y = 1 THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN s > t AND y = 0 THEN 1 ELSE 0 END) AS fp,
    sum(CASE WHEN s <= t AND y = 1 THEN 1 ELSE 0 END) AS fn FROM mix m JOIN cuts c ON m.alpha = c.alpha GROUP BY ALL) JOIN auc USING (alpha)"""


@query("alpha_percentile_grid", _grid_sql())
def _(spark, d):
    s = scored(spark, d)
    return rounded(fuse.alpha_percentile_grid(s.filter("y = 0"), s, "s0", "s1"))


def _weighted_sql() -> str:
    alphas = [round(0.05 * i, 2) for i in range(21)]
    mix = "mix AS (" + "\nUNION ALL\n".join(
        f"SELECT CAST({a} AS DOUBLE) AS alpha, y, CAST({a} AS DOUBLE) * s + (CAST(1.0 AS DOUBLE) - CAST({a} AS DOUBLE)) / 1.0 * s1 AS m FROM rare" for a in alphas) + ")"
    return with_views(FLOWS, RARE, mix, curve_sql("mix", "m", by="alpha")) + f"""
SELECT alpha, round({AP}, 6) AS pr_auc FROM curve GROUP BY alpha"""


@query("weighted_average", _weighted_sql())
def _(spark, d):
    return rounded(fuse.weighted_average(rare(spark, d), ["s", "s1"]))


@query("fusion_score", with_views(FLOWS, SCORED) + """
SELECT row_id, round(0.7 * (s0 - a) / (b - a + 1e-8) + 0.3 * (s1 - c) / (e - c + 1e-8), 6) AS score,
  CASE WHEN 0.7 * ((s0 - a) / (b - a + 1e-8)) + 0.3 * ((s1 - c) / (e - c + 1e-8)) >= 0.5 THEN 1 ELSE 0 END AS pred
FROM scored, (SELECT min(s0) AS a, max(s0) AS b, min(s1) AS c, max(s1) AS e FROM scored WHERE y = 0)""")
def _(spark, d):
    s = scored(spark, d)
    model = fuse.FusionModel(["s0", "s1"], bounds=fuse.fit_minmax(s.filter("y = 0"), ["s0", "s1"]))
    return rounded(model.predict(s).select("row_id", "score", "pred"))


@query("meta_learner")
def _(spark, d):
    s = split.stratified_holdout(rare(spark, d), "row_id")
    fitted = fuse.meta_learner("lr", s.filter("part = 'meta'"), ["s", "s1"], balanced=True)
    held = fuse.flag_above(fitted.score(s.filter("part = 'eval'")), "score", 0.5, strict=False)
    return rounded(classification_metrics(held, score="score"), 4)


@query("select_meta_learner")
def _(spark, d):
    s = split.stratified_holdout(rare(spark, d), "row_id").filter("part = 'meta'")
    _, table = fuse.select_meta_learner(s, ["s", "s1"], "row_id", trees=20, depth=5)
    return rounded(table, 4)


@query("learner_weights")
def _(spark, d):
    s = rare(spark, d)
    rows = []
    for name in ("rf", "lr"):
        fitted = fuse.meta_learner(name, s, ["s", "s1"], trees=20, depth=5)
        rows += [(name, *w) for w in fuse.learner_weights(fitted)]
    return rounded(spark.createDataFrame(rows, "learner string, feature string, weight double, share double"), 4)


VARIANTS = {"first": ("s0", 0.9), "second": ("s1", 0.5), "equal": ("0.5 * s0 + 0.5 * s1", 0.7)}
VAR_VIEW = "var AS (" + "\nUNION ALL\n".join(
    f"SELECT '{n}' AS variant, y, {e} AS s, CASE WHEN {e} > CAST({t} AS DOUBLE) THEN 1 ELSE 0 END AS flag FROM scored" for n, (e, t) in VARIANTS.items()) + ")"
VAR_SQL = f"""SELECT variant, {COUNTS}, {RATES}, roc_auc, pr_auc FROM (SELECT variant, {CONF} FROM var GROUP BY variant)
JOIN (SELECT variant, round({AUC}, 6) AS roc_auc, round({AP}, 6) AS pr_auc FROM curve GROUP BY variant) USING (variant)"""


def _variants():
    exprs = {"first": F.col("s0"), "second": F.col("s1"), "equal": 0.5 * F.col("s0") + 0.5 * F.col("s1")}
    return {n: (exprs[n], t, True) for n, (_, t) in VARIANTS.items()}


@query("ablation_variants", with_views(FLOWS, SCORED, VAR_VIEW, curve_sql("var", "s", by="variant")) + VAR_SQL)
def _(spark, d):
    return rounded(fuse.ablation_variants(scored(spark, d), _variants()))


@query("fusion_method_compare", with_views(FLOWS, SCORED, VAR_VIEW, curve_sql("var", "s", by="variant"))
       + f"SELECT variant AS model, roc_auc, pr_auc, f1, roc_auc = max(roc_auc) OVER () AS winner FROM ({VAR_SQL})")
def _(spark, d):
    rows = fuse.variant_metrics(scored(spark, d), _variants()).persist()
    table = fuse.fusion_method_compare({
        n: rows.filter(F.col("variant") == n).drop("variant") for n in VARIANTS})
    return rounded(table.select("model", "roc_auc", "pr_auc", "f1", "winner"))

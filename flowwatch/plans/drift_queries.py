"""Queries of drift detection and adaptation over score streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from flowwatch.operators import split
from flowwatch.operators.detect import GaussianMixtureDetector
from flowwatch.operators.order import dense_index, first_rows
from flowwatch.operators.quantile import exact_percentiles
from flowwatch.plans.catalog import query, rounded
from flowwatch.plans.detector_queries import UNIT
from flowwatch.sources.tables import BASE, FLOWS, STREAM, flows, score_stream, with_views
from flowwatch.streaming import batch, ranges
from flowwatch.streaming.adapt import AdaptationLoop, Tolerance, drift_event_report, guarded_refit, run_batches
from flowwatch.streaming.folds import (
    Adwin, KsWindow, PageHinkley, PageHinkleyDecrease, ScoreMonitor, SingleFold,
)
from flowwatch.streaming.keyed import MODELS, SourceAdaptation, refit_by_source

TAU, LAM, WARM = 1500.0, 2.0, 150


@query("page_hinkley", with_views(STREAM) + f"""
SELECT key, max(i) AS n, min(CASE WHEN i > {WARM} AND s - least(0, low) > {TAU} THEN i END) AS first_alarm FROM (
  SELECT key, i, s, min(CASE WHEN i > {WARM} THEN s END) OVER (PARTITION BY key ORDER BY i) AS low FROM (
    SELECT key, i, sum(CASE WHEN i > {WARM} THEN x - m - {LAM} ELSE 0 END) OVER (PARTITION BY key ORDER BY i) AS s FROM (
      SELECT key, score AS x, row_number() OVER w AS i, sum(score) OVER w / row_number() OVER w AS m
      FROM stream WINDOW w AS (PARTITION BY key ORDER BY step)))) GROUP BY key""")
def _(spark, d):
    return batch.page_hinkley_first_alarm(score_stream(spark, d), "key", "step", "step", tau=TAU, lam=LAM, warmup=WARM)


def steps(df):
    return df.select("key", "step", F.concat_ws("+", "detectors").alias("detectors"))


def recursive(*views):
    """The views of a sequential fold in SQL: one row of each key a step."""
    return with_views(STREAM, *views).replace("WITH", "WITH RECURSIVE", 1)


@query("page_hinkley_alarms", recursive(
    "r AS (SELECT key, score AS x, row_number() OVER (PARTITION BY key ORDER BY step) AS i FROM stream)",
    f"""f AS (SELECT DISTINCT key, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS n, CAST(0 AS DOUBLE) AS total, CAST(0 AS DOUBLE) AS s,
    CAST(0 AS DOUBLE) AS low, false AS hit FROM r
  UNION ALL SELECT key, i, CASE WHEN hit THEN 0 ELSE n END, CASE WHEN hit THEN 0 ELSE total END, CASE WHEN hit THEN 0 ELSE s END,
    CASE WHEN hit THEN 0 ELSE low END, hit
  FROM (SELECT *, n > {WARM} AND s - low > {TAU} AS hit
    FROM (SELECT key, i, n, total, s, CASE WHEN n > {WARM} THEN least(low, s) ELSE low END AS low
      FROM (SELECT r.key, r.i, f.n + 1 AS n, f.total + r.x AS total, f.low,
          CASE WHEN f.n + 1 > {WARM} THEN f.s + r.x - (f.total + r.x) / (f.n + 1) - {LAM} ELSE f.s END AS s
        FROM f JOIN r ON r.key = f.key AND r.i = f.i + 1))))""") + """
SELECT key, i AS step, 'page_hinkley' AS detectors FROM f WHERE hit""")
def _(spark, d):
    return steps(batch.fold_stream(score_stream(spark, d), "key", "step", "step",
                                   SingleFold(PageHinkley(TAU, LAM, WARM), "page_hinkley")))


DECREASE = recursive(
    "r AS (SELECT user_id, score AS x, row_number() OVER (PARTITION BY user_id ORDER BY step) AS i FROM stream)",
    "base AS (SELECT avg(score) AS m FROM stream)", "limits AS (SELECT unnest([5.0, 10.0, 20.0, 30.0])::DOUBLE AS threshold)",
    """f AS (SELECT DISTINCT user_id, threshold, CAST(0 AS BIGINT) AS i, m AS mean, m AS high, false AS hit FROM r, base, limits
  UNION ALL SELECT user_id, threshold, i, CASE WHEN hit THEN x ELSE mean END, CASE WHEN hit THEN x ELSE high END, hit
  FROM (SELECT *, i > 20 AND high - mean > threshold AS hit
    FROM (SELECT user_id, threshold, i, x, mean, greatest(high, mean) AS high
      FROM (SELECT r.user_id, f.threshold, r.i, r.x, (f.mean * (r.i - 1) + r.x) / r.i AS mean, f.high
        FROM f JOIN r ON r.user_id = f.user_id AND r.i = f.i + 1))))""")


def decrease(baseline):
    return lambda t: PageHinkleyDecrease(baseline, t, 20)


def _baseline(spark, d):
    return score_stream(spark, d).agg(F.avg("score")).first()[0]


@query("page_hinkley_decrease", DECREASE + """
SELECT user_id AS key, i AS step, 'decrease' AS detectors FROM f WHERE hit AND threshold = 10""")
def _(spark, d):
    return steps(batch.fold_stream(score_stream(spark, d), "user_id", "step", "step",
                                   SingleFold(decrease(_baseline(spark, d))(10.0), "decrease")).withColumnRenamed("user_id", "key"))


@query("drift_sensitivity", DECREASE + """
SELECT user_id, threshold, count(*) FILTER (WHERE hit) AS events, min(i) FILTER (WHERE hit) AS first_step FROM f GROUP BY user_id, threshold""")
def _(spark, d):
    return batch.drift_sensitivity(score_stream(spark, d), "user_id", "step", "step",
                                   decrease(_baseline(spark, d)), [5.0, 10.0, 20.0, 30.0])


@query("label_at_drift", with_views(STREAM) + f"""
, alarms AS (SELECT user_id, step, row_number() OVER (PARTITION BY user_id ORDER BY step) AS i, count(*) OVER (PARTITION BY user_id) AS n, score, key FROM stream),
hits AS (SELECT user_id, i AS step, least(i, n - 1) AS at FROM alarms WHERE score > 250)
SELECT h.user_id, h.step, a.key AS label FROM hits h JOIN alarms a ON a.user_id = h.user_id AND a.i = h.at + 1""".replace("\n, alarms", ", alarms", 1))
def _(spark, d):
    s = score_stream(spark, d)
    indexed, _ = dense_index(s, "step", "step", by=["user_id"])
    hits = indexed.filter("score > 250").select("user_id", (F.col("idx") + 1).alias("step"))
    rows = s.select("user_id", F.col("key").alias("label"), F.col("step").alias("ord"))
    return batch.label_at_drift(hits, rows, "user_id", "label", "ord", "ord").select("user_id", "step", "label")


ADWIN = Adwin(delta=0.002)


def _adwin_sql(t: Adwin) -> str:
    """State of a key after each check: rows before the window, checks, a pending split. Means come from prefix sums."""
    bound = f"{t.scale} * sqrt((1.0 / k + 1.0 / (len - k)) / 2 * ln(4.0 * greatest(1, checks) / {t.delta}))"
    return recursive(
        """c AS (SELECT key, row_number() OVER w AS i, sum(score) OVER w AS upto, score FROM stream WINDOW w AS (PARTITION BY key ORDER BY step)
  UNION ALL SELECT DISTINCT key, 0, 0, NULL FROM stream)""",
        f"""f AS (SELECT DISTINCT key, CAST(0 AS BIGINT) AS t, CAST(0 AS BIGINT) AS start, CAST(0 AS BIGINT) AS checks, false AS pending, false AS hit FROM stream
  UNION ALL SELECT key, t, CASE WHEN k IS NOT NULL AND pending THEN start + k ELSE start END,
    CASE WHEN k IS NOT NULL THEN 0 ELSE checks END, k IS NOT NULL AND NOT pending, k IS NOT NULL AND pending
  FROM (SELECT key, t, start, checks, pending, min(CASE WHEN abs((mid - low) / k - (top - mid) / (len - k)) >= {bound} THEN k END) AS k
    FROM (SELECT g.*, m.i - g.start AS k, m.upto AS mid, a.upto AS low
      FROM (SELECT key, t, start, t - start AS len, pending, top, checks + greatest(0, t - start - {2 * t.min_window - 1}) AS checks
        FROM (SELECT f.key, e.i AS t, greatest(f.start, e.i - {t.max_window}) AS start, f.checks, f.pending, e.upto AS top
          FROM f JOIN c e ON e.key = f.key AND e.i = f.t + {t.cadence})) g
      JOIN c a ON a.key = g.key AND a.i = g.start
      LEFT JOIN c m ON m.key = g.key AND m.i BETWEEN g.start + {t.min_window} AND g.t - {t.min_window})
    GROUP BY key, t, start, checks, pending))""")


@query("adwin", _adwin_sql(ADWIN) + """
SELECT f.key, f.t AS step, round(c.score, 6) AS score, 'adwin' AS detectors FROM f JOIN c ON c.key = f.key AND c.i = f.t WHERE f.hit""")
def _(spark, d):
    found = ranges.adwin_alarms(score_stream(spark, d), "key", "step", "step", ADWIN)
    return rounded(found.withColumn("detectors", F.lit("adwin")))


def _frozen(spark, d):
    """Scores of the first days: the frozen baseline."""
    first = score_stream(spark, d).orderBy("step").limit(1000)
    return [r[0] for r in first.select("score").collect()]


KS_SIZE, KS_ALPHA, KS_CADENCE = 100, 0.05, 25


@query("ks_window", with_views(
    STREAM, "base AS (SELECT score AS v FROM stream ORDER BY step LIMIT 1000)", "size AS (SELECT count(*) AS m FROM base)",
    "r AS (SELECT key, score AS v, row_number() OVER (PARTITION BY key ORDER BY step) AS i FROM stream)",
    f"tests AS (SELECT key, i AS t FROM r WHERE i % {KS_CADENCE} = 0 AND i >= {KS_SIZE})",
    f"""points AS (SELECT tests.key, t, v, 0 AS old, 1 AS recent FROM tests JOIN r ON r.key = tests.key AND i BETWEEN t - {KS_SIZE - 1} AND t
  UNION ALL SELECT key, t, v, 1, 0 FROM tests, base)""",
    f"""found AS (SELECT key, t, m, max(gap) AS distance FROM (
    SELECT key, t, m, abs(sum(old) OVER w / m - sum(recent) OVER w / {KS_SIZE}.0) AS gap FROM points, size
    WINDOW w AS (PARTITION BY key, t ORDER BY v)) GROUP BY key, t, m)""",
    f"lam AS (SELECT *, m * {KS_SIZE}.0 / (m + {KS_SIZE}) AS e, (sqrt(e) + 0.12 + 0.11 / sqrt(e)) * distance AS l FROM found)",
    """tail AS (SELECT key, t, distance, CASE WHEN l < 0.3 THEN 1.0 ELSE least(1.0, greatest(0.0,
    2 * sum(CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END * exp(-2 * (k * l) * (k * l))))) END AS p
  FROM lam, range(1, 101) AS terms(k) GROUP BY key, t, distance, l)""") + f"""
SELECT key, t AS step, round(distance, 6) AS distance, round(p, 6) AS ks_p, 'ks_window' AS detectors FROM tail WHERE p < {KS_ALPHA}""")
def _(spark, d):
    test = KsWindow(_frozen(spark, d), alpha=KS_ALPHA, window=KS_SIZE, cadence=KS_CADENCE)
    found = ranges.ks_window_tests(score_stream(spark, d), "key", "step", "step", test)
    return rounded(found.filter("alarm").drop("alarm").withColumn("detectors", F.lit("ks_window")))


def _monitor(spark, d):
    return ScoreMonitor(threshold=150.0, score_test=PageHinkley(TAU, LAM, WARM), ks=KsWindow(_frozen(spark, d), window=100))


@query("score_monitor")
def _(spark, d):
    s = score_stream(spark, d).drop("flag")
    return steps(batch.fold_stream(s, "key", "step", "step", _monitor(spark, d)))


@query("rearm")
def _(spark, d):
    s = score_stream(spark, d).drop("flag").withColumn("rearm", F.when(F.col("step") % 1000 == 0, 1).otherwise(0))
    return steps(batch.fold_stream(s, "key", "step", "step", _monitor(spark, d), cols=["score", "rearm"]))


INDEXED = "idx AS (SELECT *, row_number() OVER (ORDER BY step) - 1 AS idx FROM stream)"


def indexed_stream(spark, d):
    rows, n = dense_index(score_stream(spark, d), "step", "step")
    return rows, n


@query("inject_shift", with_views(STREAM, INDEXED) + """
SELECT step, round(CASE WHEN idx >= 500 THEN score + 3.0 * (SELECT stddev_pop(score) FROM stream) ELSE score END, 6) AS score FROM idx""")
def _(spark, d):
    rows, _ = indexed_stream(spark, d)
    return rounded(batch.inject_shift(rows.select("step", "idx", "score"), ["score"], "idx", 500, 3.0).drop("idx"))


@query("replay_buffer_sliding", with_views(STREAM) + "SELECT step, score FROM stream ORDER BY step DESC LIMIT 500")
def _(spark, d):
    return batch.replay_buffer_sliding(score_stream(spark, d).select("step", "score"), 500, "step")


@query("replay_buffer_reservoir", with_views(STREAM) + "SELECT step, score FROM stream ORDER BY md5('42:' || step) LIMIT 500")
def _(spark, d):
    return batch.replay_buffer_reservoir(score_stream(spark, d).select("step", "score"), 500, "step")


@query("buffer_reset", with_views(STREAM, INDEXED) + """
SELECT idx, score FROM (SELECT * FROM idx WHERE idx >= (SELECT min(idx) FROM idx WHERE score > 300) ) ORDER BY idx DESC LIMIT 400""")
def _(spark, d):
    rows, _ = indexed_stream(spark, d)
    alarm = rows.filter("score > 300").agg(F.min("idx")).first()[0] or 0
    kept = batch.buffer_reset(rows.select("idx", "score"), "idx", alarm)
    return batch.replay_buffer_sliding(kept, 400, "idx")


@query("admission_rule", with_views(STREAM, INDEXED) + """
, f AS (SELECT idx, score, CASE WHEN score > 60 THEN 1 ELSE 0 END AS flag, CASE WHEN idx >= 300 THEN 1 ELSE 0 END AS pending,
  quantile_cont(score, 0.4) OVER w AS cut, count(*) OVER w AS seen FROM idx WINDOW w AS (ORDER BY idx ROWS BETWEEN 99 PRECEDING AND CURRENT ROW))
SELECT idx, CASE WHEN flag = 0 OR (pending = 1 AND seen >= 50 AND score <= cut) THEN 1 ELSE 0 END AS admitted FROM f""".replace("\n, f", ", f", 1))
def _(spark, d):
    rows, _ = indexed_stream(spark, d)
    f = rows.select("idx", "score", F.when(F.col("score") > 60, 1).otherwise(0).alias("flag"),
                    F.when(F.col("idx") >= 300, 1).otherwise(0).alias("pending"))
    return batch.admission_rule(f, "score", "flag", "pending", history=100).select("idx", "admitted")


def _fitted(spark, d):
    unit = flows(spark, d).select("row_id", "ship_date", "label", "origin", *[(F.col(c) / s).alias(c) for c, s in UNIT.items()])
    parts = split.one_class_split(unit, "row_id")
    train, test = parts.filter("split = 'train'"), parts.filter("split = 'test'")
    return GaussianMixtureDetector(k=2, n_init=1, max_iter=10).fit(train, BASE), train, test


@query("adapt_with_guards")
def _(spark, d):
    model, train, test = _fitted(spark, d)
    stds = {c: 0.3 for c in BASE}
    moved = batch.shift_benign(train.withColumn("y", F.lit(0)), BASE, 1.0, stds)
    val = batch.shift_benign(test, BASE, 1.0, stds)
    _, verdict = guarded_refit(model, moved, val, Tolerance())
    return rounded(drift_event_report(spark, [{"step": 0, "detectors": "manual", **verdict._asdict()}]), 3)


def _run_loop(spark, d):
    """A benign stream whose second half is shifted, in four batches."""
    model, train, test = _fitted(spark, d)
    rows, n = dense_index(train.select("row_id", "ship_date", "origin", *BASE), "ship_date", "row_id")
    stream = batch.inject_shift(rows, BASE, "idx", n // 2, 3.0).persist()
    stds = train.agg(*[F.stddev_pop(c).alias(c) for c in BASE]).first().asDict()
    val = batch.shift_benign(test, BASE, 3.0, stds)
    baseline = exact_percentiles(model.score(train), ["score"], [i / 1000 for i in range(1, 1000)])["score"]
    loop = AdaptationLoop(model, val, ks_baseline=baseline, source_col="origin", limit=Tolerance(hits=1.0, rows=500))
    run_batches(loop, stream, -(-n // 4), n)
    stream.unpersist()
    return loop


def two_sources(df):
    """Rows dealt to two sources by the first digit of their row id."""
    return df.withColumn("source", F.when(F.substring("row_id", 1, 1) < "8", "a").otherwise("b"))


@query("adaptation_loop")
def _(spark, d):
    """Two sources, of which one shifts half way: a mixture, buffer, pending flag and version for each."""
    model, train, test = _fitted(spark, d)
    rows, n = dense_index(two_sources(train.select("row_id", "ship_date", *BASE)), "ship_date", "row_id")
    stds = train.agg(*[F.stddev_pop(c).alias(c) for c in BASE]).first().asDict()
    moved = (F.col("source") == "b") & (F.col("idx") >= n // 2)
    stream = rows.select("row_id", "idx", "source", *[F.when(moved, F.col(c) + 3.0 * stds[c]).otherwise(F.col(c)).alias(c) for c in BASE])
    val = two_sources(test.withColumn("y", F.when(F.col("label") == "BENIGN", 0).otherwise(1)))
    val = val.select("source", "y", *[F.when((F.col("source") == "b") & (F.col("y") == 0), F.col(c) + 3.0 * stds[c])
                                      .otherwise(F.col(c)).alias(c) for c in BASE])
    baseline = exact_percentiles(model.score(train), ["score"], [i / 1000 for i in range(1, 1000)])["score"]
    loop = SourceAdaptation(model, "source", val, ks_baseline=baseline, limit=Tolerance(hits=1.0, rows=300))
    run_batches(loop, stream.persist(), -(-n // 4), n)
    return loop.status()


def _refit_sql() -> str:
    z = ("(vp * power(quantity - mq, 2) - 2 * cqp * (quantity - mq) * (price - mp) + vq * power(price - mp, 2)) / (vq * vp - cqp * cqp)")
    return with_views(FLOWS, """recent AS (SELECT * FROM (SELECT source, quantity, price, row_number() OVER (PARTITION BY source ORDER BY ship_date DESC, row_id DESC) AS rn
  FROM (SELECT *, CASE WHEN substr(row_id, 1, 1) < '8' THEN 'a' ELSE 'b' END AS source FROM flows) x) WHERE rn <= 2000),
unit AS (SELECT source, quantity / 50.0 AS quantity, price / 105000.0 AS price FROM recent),
fit AS (SELECT source, count(*) AS n, avg(quantity) AS mq, avg(price) AS mp, var_pop(quantity) AS vq, var_pop(price) AS vp,
  covar_pop(quantity, price) AS cqp FROM unit GROUP BY source)""") + f"""
SELECT f.source, f.n AS recent_rows, round(f.mq, 6) AS mean_quantity, round(f.mp, 6) AS mean_price, round(f.cqp, 6) AS covariance,
  round(quantile_cont(ln(2 * pi()) + 0.5 * ln(vq * vp - cqp * cqp) + 0.5 * {z}, 0.89), 6) AS threshold,
  round(quantile_cont(ln(2 * pi()) + 0.5 * ln(vq * vp - cqp * cqp) + 0.5 * {z}, 0.5), 6) AS median_new
FROM unit u JOIN fit f ON f.source = u.source GROUP BY f.source, f.n, f.mq, f.mp, f.cqp"""


@query("refit_by_source", _refit_sql())
def _(spark, d):
    """One Gaussian per source from its last 2,000 rows, all sources at once."""
    unit = two_sources(flows(spark, d)).select("source", "row_id", "ship_date", (F.col("quantity") / 50.0).alias("quantity"),
                                               (F.col("price") / 105000.0).alias("price"))
    last = first_rows(unit, ["source"], [F.desc("ship_date"), F.desc("row_id")], 2000)
    recent = last.withColumn("idx", -F.col("rank"))
    found = refit_by_source(recent, spark.createDataFrame([], MODELS), ["quantity", "price"], 1, 11.0)
    return rounded(found.select("source", "recent_rows", F.col("means")[0].alias("mean_quantity"), F.col("means")[1].alias("mean_price"),
                                F.col("covs")[1].alias("covariance"), "threshold", "median_new"))


@query("drift_event_report")
def _(spark, d):
    return rounded(drift_event_report(spark, _run_loop(spark, d).reports), 3)


@query("drift_events")
def _(spark, d):
    return rounded(_run_loop(spark, d).events(spark).select("source", "at", F.concat_ws("+", "detectors").alias("detectors"), "score"), 3)

"""Drift folds against plain loops; segments and streams against the whole fold."""

import time
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from flowwatch.operators.detect import GaussianMixtureDetector
from flowwatch.streaming import batch
from flowwatch.streaming.adapt import AdaptationLoop, Tolerance, drift_event_report, guarded_refit, run_batches
from flowwatch.streaming.folds import (
    Adwin, KsWindow, PageHinkley, PageHinkleyDecrease, ScoreMonitor, SingleFold,
)
from flowwatch.streaming.stream import ROCKSDB, stream_buffer, stream_fold, stream_traffic


def shifted(n=1500, m=1500, jump=3.0, seed=0):
    rng = np.random.default_rng(seed)
    return np.concatenate([rng.normal(0, 1, n), rng.normal(jump, 1, m)])


def loop_page_hinkley(x, tau, lam, warm):
    out, n, mean, s, low = [], 0, 0.0, 0.0, 0.0
    for i, v in enumerate(x):
        n += 1
        mean += (v - mean) / n
        if n <= warm:
            continue
        s += v - mean - lam
        low = min(low, s)
        if s - low > tau:
            out.append(i)
            n, mean, s, low = 0, 0.0, 0.0, 0.0
    return out


def loop_decrease(x, base, threshold, warm):
    out, n, mean, high = [], 0, base, base
    for i, v in enumerate(x):
        n += 1
        mean = (1 - 1 / n) * mean + v / n
        high = max(high, mean)
        if n > warm and high - mean > threshold:
            out.append(i)
            mean = high = v
    return out


def test_page_hinkley_equals_the_loop():
    x = np.tile(shifted(800, 800), 4)
    _, got = PageHinkley(20, 0.1, 100).run(PageHinkley().start(), x)
    assert got == loop_page_hinkley(x, 20, 0.1, 100) and len(got) > 2


def test_decrease_equals_the_loop():
    x = -np.tile(shifted(800, 800), 3)
    d = PageHinkleyDecrease(0.0, 0.5, 100)
    assert d.run(d.start(), x)[1] == loop_decrease(x, 0.0, 0.5, 100)


@pytest.mark.parametrize("fold", [
    PageHinkley(20, 0.1, 100), PageHinkleyDecrease(0.0, 0.5, 100), Adwin(delta=0.01),
    KsWindow(np.random.default_rng(9).normal(0, 1, 500), window=200)])
def test_any_cut_of_the_input_gives_the_same_alarms(fold):
    x = shifted()
    _, whole = fold.run(fold.start(), x)
    state, pieces, at = fold.start(), [], 0
    for size in (1, 7, 333, 1000, 24, 5000):
        state, found = fold.run(state, x[at:at + size])
        pieces += [(a[0] + at, a[1]) if isinstance(a, tuple) else a + at for a in found]
        at += size
    assert pieces == whole


def test_detectors_fire_after_the_change_and_not_before():
    x = shifted()
    for fold in (PageHinkley(), Adwin(), KsWindow(shifted(500, 0, seed=3), window=300)):
        alarms = [a[0] if isinstance(a, tuple) else a for a in fold.run(fold.start(), x)[1]]
        assert alarms and 1500 <= alarms[0] < 2100, fold
        quiet = fold.run(fold.start(), shifted(3000, 0))[1]
        assert not quiet, fold


def test_adwin_keeps_only_the_new_regime():
    state, alarms = Adwin().run(Adwin().start(), shifted())
    assert alarms and np.mean(state["window"]) > 2.5


def test_monitor_merges_detectors_and_rearms():
    x = shifted()
    fold = ScoreMonitor(2.0, ks=KsWindow(shifted(500, 0, seed=4), window=300))
    _, events = fold.run(fold.start(), pd.DataFrame({"score": x}))
    assert {"ph_score", "ph_alert_rate"} & {d for _, ds, _ in events for d in ds}
    assert all(o >= 1500 for o, _, _ in events)
    marks = np.zeros(len(x), dtype=int)
    marks[1600::100] = 1
    state, fewer = fold.run(fold.start(), pd.DataFrame({"score": x, "rearm": marks}))
    assert len(fewer) < len(events)
    assert state["ph_score"]["n"] == (len(x) - 1) % 100
    fresh = fold.rearm(state, 9.0, [1.0, 2.0])
    assert fresh["threshold"] == 9.0 and fresh["ks_window"]["base"] == [1.0, 2.0]


@pytest.fixture(scope="module")
def stream(spark):
    rows = []
    for k, seed in (("hot", 1), ("a", 2), ("b", 3)):
        x = shifted(600, 600, seed=seed) if k != "hot" else np.tile(shifted(600, 600, seed=seed), 3)
        rows += [(k, i, datetime(2024, 1, 1) + timedelta(seconds=i), float(v)) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "key string, i long, ts timestamp, score double").persist()


def events_of(df):
    return sorted((r["key"], r["step"], tuple(r["detectors"])) for r in df.collect())


def test_segments_equal_one_pass(spark, stream):
    fold = ScoreMonitor(2.0, PageHinkley(20, 0.1, 100), adwin=Adwin(0.01), ks=KsWindow(shifted(300, 0, seed=5), window=100))
    whole = events_of(batch.fold_stream(stream, "key", "i", "i", fold))
    parts = events_of(batch.fold_stream(stream, "key", "i", "i", fold, segment_rows=500))
    assert whole == parts and len(whole) > 5


def test_first_alarm_by_sums_equals_the_fold(spark, stream, monkeypatch):
    from flowwatch.operators import order
    found = events_of(batch.fold_stream(stream, "key", "i", "i", SingleFold(PageHinkley(20, 0.1, 100))))
    want = {k: min(s for kk, s, _ in found if kk == k) for k in ("hot", "a", "b")}
    for limit in (2_000_000, 111):
        monkeypatch.setattr(order, "TASK_ROWS", limit)
        got = batch.page_hinkley_first_alarm(stream, "key", "i", "i", tau=20, lam=0.1, warmup=100)
        assert {r["key"]: r["first_alarm"] for r in got.collect()} == want


def test_stream_equals_batch(spark, stream, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    for b in range(3):
        part = stream.filter((F.col("i") >= b * 1200) & (F.col("i") < (b + 1) * 1200))
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(stream.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    fold = SingleFold(PageHinkley(20, 0.1, 100))
    q = (stream_fold(source, "key", ["i"], fold).writeStream.format("memory").queryName("drift")
         .option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").start())
    q.processAllAvailable()
    q.stop()
    assert events_of(spark.table("drift")) == events_of(batch.fold_stream(stream, "key", "i", "i", fold))


def test_stream_buffers(spark, stream, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    stream.filter("key = 'a'").coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(stream.schema).parquet(str(tmp_path / "in"))
    for mode in ("sliding", "reservoir"):
        q = (stream_buffer(source, "key", "i", "i", ["score"], 50, mode).writeStream.format("memory").queryName(f"buf_{mode}")
             .option("checkpointLocation", str(tmp_path / mode)).outputMode("update").start())
        q.processAllAvailable()
        q.stop()
        got = {r["idx"] for r in spark.table(f"buf_{mode}").collect()}
        a = stream.filter("key = 'a'")
        want = batch.replay_buffer_sliding(a, 50, "i") if mode == "sliding" else batch.replay_buffer_reservoir(a, 50, "i")
        assert got == {r["i"] for r in want.collect()}


def test_stream_traffic_counts(spark, stream, tmp_path):
    stream.coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(stream.schema).parquet(str(tmp_path / "in"))
    q = (stream_traffic(source, "ts", F.col("score") > 2).writeStream.format("memory").queryName("traffic")
         .option("checkpointLocation", str(tmp_path / "cp")).outputMode("complete").start())
    q.processAllAvailable()
    q.stop()
    assert spark.table("traffic").agg(F.sum(F.col("benign") + F.col("attack"))).first()[0] == stream.count()


def test_sensitivity_and_labels(spark, stream):
    table = batch.drift_sensitivity(stream, "key", "i", "i", lambda t: PageHinkley(t, 0.1, 100), [10.0, 20.0, 1e9])
    rows = {(r["key"], r["threshold"]): r for r in table.collect()}
    assert rows[("a", 1e9)]["events"] == 0 and rows[("a", 10.0)]["events"] >= rows[("a", 20.0)]["events"] >= 1
    labelled = stream.withColumn("label", F.when(F.col("i") < 600, "old").otherwise("new"))
    found = batch.fold_stream(stream, "key", "i", "i", SingleFold(PageHinkley(20, 0.1, 100)))
    got = batch.label_at_drift(found.filter("key = 'a'"), labelled, "key", "label", "i", "i")
    assert {r["label"] for r in got.collect()} == {"new"}
    last = spark.createDataFrame([("a", 1200)], "key string, step long")
    assert batch.label_at_drift(last, labelled, "key", "label", "i", "i").first()["label"] == "new"


# --- adaptation -----------------------------------------------------------------------------


COLS = ["f0", "f1", "f2"]


def cloud(spark, n, centre, seed, start=0):
    x = np.random.default_rng(seed).normal(centre, 1, (n, 3))
    pdf = pd.DataFrame(x, columns=COLS)
    pdf["row_id"] = [f"{seed}-{i}" for i in range(n)]
    pdf["idx"] = range(start, start + n)
    return spark.createDataFrame(pdf)


@pytest.fixture(scope="module")
def old_model(spark):
    return GaussianMixtureDetector(k=1, n_init=1).fit(cloud(spark, 1500, 0, 1), COLS)


def checked(spark, benign, attacks, seeds=(3, 4)):
    """Labelled rows around two centres."""
    return cloud(spark, 300, benign, seeds[0]).withColumn("y", F.lit(0)).unionByName(
        cloud(spark, 100, attacks, seeds[1]).withColumn("y", F.lit(1)))


def test_refit_that_follows_the_benign_rows_is_taken(spark, old_model):
    model, verdict = guarded_refit(old_model, cloud(spark, 1600, 4, 2), checked(spark, 4, 9))
    assert verdict.accepted and model is not old_model and verdict.false_new < verdict.false_old
    assert verdict.hit_new == 1.0 and verdict.recent_rows == 1600


def test_few_rows_do_not_refit(spark, old_model):
    model, verdict = guarded_refit(old_model, cloud(spark, 100, 4, 2))
    assert (model, verdict) == (old_model, (False, "too few recent rows", 100, None, None, None, None))


@pytest.mark.parametrize("benign,attacks,limit,reason", [
    (0, 9, Tolerance(), "too many new false alarms"), (4, 4, Tolerance(), "too many lost hits"),
    (30, 9, Tolerance(), "both models flag every benign row"), (4, 4, Tolerance(hits=1.0), "labelled rows agree")])
def test_first_rule_that_holds_decides(spark, old_model, benign, attacks, limit, reason):
    model, verdict = guarded_refit(old_model, cloud(spark, 1600, 4, 2), checked(spark, benign, attacks, (5, 6)), limit)
    assert verdict.reason == reason and (model is old_model) == (not verdict.accepted)


def test_medians_decide_without_labels(spark, old_model):
    _, verdict = guarded_refit(old_model, cloud(spark, 1600, 4, 2))
    assert verdict.accepted and verdict.false_old is None and verdict.reason == "median score did not rise"


@pytest.mark.parametrize("source", [None, "site"])
def test_loop_adapts_to_a_shift(spark, old_model, source):
    rows = cloud(spark, 1000, 0, 11).unionByName(cloud(spark, 2000, 4, 12, 1000)).withColumn(
        "site", F.when(F.col("idx") % 3 == 0, "a").otherwise("b")).persist()
    loop = AdaptationLoop(old_model, checked(spark, 4, 9), source_col=source, limit=Tolerance(rows=300))
    run_batches(loop, rows, 750, 3000)
    assert loop.versions and loop.reports[-1]["accepted"]
    assert drift_event_report(spark, loop.reports).count() == len(loop.reports)
    events = loop.events(spark)
    assert loop.buffer.agg(F.min("idx")).first()[0] >= events.agg(F.min("at")).first()[0]
    assert {r["source"] for r in events.filter("at >= 1000").select("source").distinct().collect()} == ({"a", "b"} if source else {""})
    late = loop.model.predict(loop.model.score(cloud(spark, 300, 4, 20))).agg(F.avg("pred")).first()[0]
    stale = old_model.predict(old_model.score(cloud(spark, 300, 4, 20))).agg(F.avg("pred")).first()[0]
    assert late < 0.4 < stale


def test_quiet_stream_never_adapts(spark, old_model):
    # The adaptive window's bound assumes values of range 1; these scores span more.
    monitor = ScoreMonitor(old_model.threshold, adwin=Adwin(0.002, scale=8.0))
    loop = run_batches(AdaptationLoop(old_model, monitor=monitor, limit=Tolerance(rows=300)), cloud(spark, 1500, 0, 30), 500, 1500)
    assert not loop.reports and not loop.pending and loop.events(spark).count() == 0


def test_rearm_keeps_the_latest_scores():
    fold = ScoreMonitor(2.0, ks=KsWindow(shifted(500, 0, seed=4), window=300))
    state, _ = fold.run(fold.start(), pd.DataFrame({"score": shifted(400, 0)}))
    fresh = fold.rearm(state)
    assert fresh["ks_window"] == state["ks_window"] and fresh["ph_score"] == fold.start()["ph_score"]


def test_sliding_buffer_with_gaps(spark):
    df = spark.range(2000).select((F.col("id") * 3).alias("idx"))
    got = batch.replay_buffer_sliding(df, 900, "idx").agg(F.count("*"), F.min("idx")).first()
    assert tuple(got) == (900, 3300)


def test_admission(spark):
    df = spark.createDataFrame([(i, float(i % 10), int(i % 10 > 4), int(i >= 60)) for i in range(120)],
                               "idx long, score double, flag int, pending int")
    got = {r["idx"]: r["admitted"] for r in batch.admission_rule(df, "score", "flag", "pending", quantile=0.6).collect()}
    assert got[5] == 0 and got[4] == 1 and got[65] == 1 and got[69] == 0


def test_admission_ranks_equal_sorted_windows(spark):
    rng = np.random.default_rng(3)
    x = [None if i % 17 == 0 else float(v) for i, v in enumerate(rng.integers(0, 40, 700))]
    df = spark.createDataFrame([(i, v, int(i % 3 > 0), int(i >= 90)) for i, v in enumerate(x)],
                               "idx long, score double, flag int, pending int")
    got = [r["admitted"] for r in batch.admission_rule(df, "score", "flag", "pending", quantile=0.3, history=80).orderBy("idx").collect()]
    for i, v in enumerate(x):
        window = [w for w in x[max(0, i - 79):i + 1] if w is not None]
        low = i >= 90 and v is not None and len(window) >= 50 and v <= np.quantile(window, 0.3)
        assert got[i] == int(i % 3 == 0 or low)


def test_admission_ranks_many_rows_at_once():
    """A sort of each window would take a minute."""
    x = np.random.default_rng(4).normal(size=300_000)
    began = time.perf_counter()
    low = batch.in_low_tail(x, np.ones(len(x), bool), np.arange(len(x)), 0.4, 500, 50)
    assert 0.39 < low.mean() < 0.41 and time.perf_counter() - began < 10


def test_ks_tests_of_a_long_stream_are_made_together():
    fold, tested = KsWindow(shifted(999, 0, seed=4)), []
    began = time.perf_counter()
    fold.run(fold.start(), shifted(250_000, 0, seed=6), tested=tested)
    assert len(tested) == (250_000 - 1000) // 25 + 1 and time.perf_counter() - began < 3


def test_recent_rows_are_read_once_for_a_refit(spark):
    """Counted, fitted and scored by both models from one kept copy."""
    from flowwatch.operators.detect.mixture import GaussianMixtureDetector
    from flowwatch.streaming.adapt import Tolerance, guarded_refit
    seen = spark.sparkContext.accumulator(0)

    def through(batches):
        for pdf in batches:
            seen.add(len(pdf))
            yield pdf
    rows = spark.createDataFrame([(str(i), float(i % 17), float(i * 7 % 23)) for i in range(200)], "row_id string, a double, b double")
    model = GaussianMixtureDetector(k=1).fit(rows, ["a", "b"])
    _, verdict = guarded_refit(model, rows.mapInPandas(through, rows.schema), limit=Tolerance(rows=50))
    assert verdict.accepted and verdict.recent_rows == 200 and seen.value == 200


def test_adapt_with_guards_refuses_a_refit_that_loses_hits(spark, monkeypatch):
    """The query keeps every guard: attacks that lie where the benign rows have moved to are lost by the refit."""
    from flowwatch.plans import drift_queries, registry
    cols = drift_queries.BASE

    def near(n, centre, seed):
        pdf = pd.DataFrame(np.random.default_rng(seed).normal(centre, 0.3, (n, len(cols))), columns=cols)
        return spark.createDataFrame(pdf.assign(row_id=[f"{seed}-{i}" for i in range(n)]))
    train = near(1600, 0.0, 1)
    model = GaussianMixtureDetector(k=1, n_init=1).fit(train, cols)
    test = near(300, 0.0, 3).withColumn("y", F.lit(0)).unionByName(near(100, 0.3, 4).withColumn("y", F.lit(1)))
    monkeypatch.setattr(drift_queries, "_fitted", lambda *a: (model, train, test))
    row = registry.QUERIES["adapt_with_guards"](spark, "").first()
    assert row["hit_new"] < row["hit_old"] - 0.05 and row["false_new"] <= row["false_old"]
    assert (row["accepted"], row["reason"]) == (False, "too many lost hits")


def test_quick_check_of_the_adaptive_window_leaves_its_alarms(monkeypatch):
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(m, 0.3, n) for m, n in ((0, 4000), (0.2, 3000), (0.9, 500), (0.4, 9000))])
    x[12_000] = np.nan
    fold = Adwin(delta=0.002, max_window=1000, min_window=100)
    quick = fold.run(fold.start(), x)
    skipped = []
    calm = Adwin._calm
    monkeypatch.setattr(Adwin, "_calm", lambda self, *a: skipped.append(calm(self, *a)) or False)
    assert str(fold.run(fold.start(), x)) == str(quick) and len(quick[1]) > 2 and sum(skipped) > 50


def test_many_percentiles_of_a_middling_table_are_not_made_in_one_task(spark, monkeypatch):
    from flowwatch.operators import quantile
    rows = spark.range(30_000).select((F.hash("id") % 1000).cast("double").alias("x"))
    probs = [i / 1000 for i in range(1, 1000)]
    asked = []
    ranks = quantile._sorted_ranks
    monkeypatch.setattr(quantile, "_sorted_ranks", lambda *a: asked.append(1) or ranks(*a))
    got = quantile.exact_percentiles(rows, ["x"], probs)["x"]
    assert asked and got == pytest.approx(np.quantile([r[0] for r in rows.collect()], probs).tolist(), abs=1e-9)

"""Guarded adaptation of one mixture per source; everything a source owns is a row of a table keyed by source.

A micro-batch goes through few joins for all sources together: rows are scored by their source's mixture (rows of a large
source are salted over tasks), one keyed pass runs the monitors and chooses the rows that the replay buffer may learn
from, the buffers are cut to their capacity, and all sources whose refit is due are fitted and judged at once. One
source's alarm, buffer and model do not touch another's. The driver sees counts only.

One source's rows of a micro-batch, and its replay buffer of at most ``capacity`` rows, are held by one task; the trigger
and the capacity bound them. Rows without a source form the source of the empty string.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowwatch.functions.exprs import hash_key, q
from flowwatch.operators.detect.mixture import GaussianMixtureDetector, _safe, component_log_density, log_density
from flowwatch.operators.order import join_small
from flowwatch.session import scratch_path
from flowwatch.streaming.adapt import Tolerance, rule_table
from flowwatch.streaming.batch import in_low_tail
from flowwatch.streaming.folds import KsWindow, ScoreMonitor

PARAMETERS = "threshold double, weights array<double>, means array<double>, covs array<double>"
MODELS = f"source string, version int, {PARAMETERS}, last_attempt long, last_buffer long"
STATES = "source string, pending boolean, state string"
REFITS = f"source string, recent_rows long, {PARAMETERS}, median_old double, median_new double, baseline array<double>"
RATES = "source string, false_old double, false_new double, hit_old double, hit_new double"
#: Rows of a source that one scoring task takes.
TASK_ROWS = 100_000
#: Mixtures that every scoring task may hold.
HELD_MODELS = 1000


def table(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def em_arrays(x: np.ndarray, k: int, seed: int, n_init: int = 1, max_iter: int = 100,
              tol: float = 1e-3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A full-covariance mixture of one bounded set of rows, from sufficient statistics; the best of ``n_init`` starts."""
    n, d = x.shape
    spread = np.atleast_2d(np.cov(x.T, bias=True))
    if k == 1:
        return np.ones(1), x.mean(axis=0)[None], _safe(spread[None])
    best, found = -math.inf, None
    for j in range(n_init):
        means = x[np.random.default_rng(seed + j).permutation(n)[:k]].copy()
        weights, covs, last = np.full(len(means), 1.0 / len(means)), _safe(np.repeat(
            np.diag(np.maximum(np.diag(spread), 1e-6))[None], len(means), axis=0)), -math.inf
        for _ in range(max_iter):
            parts = component_log_density(x, weights, means, covs)
            like = np.logaddexp.reduce(parts, axis=1)
            if like.mean() - last < tol:
                break
            last = like.mean()
            share = np.exp(parts - like[:, None])
            mass = np.maximum(share.sum(axis=0), 1e-10)
            weights, means = mass / mass.sum(), (share.T @ x) / mass[:, None]
            second = np.einsum("nk,ni,nj->kij", share, x, x, optimize=True) / mass[:, None, None]
            covs = _safe(second - means[:, :, None] * means[:, None, :] + 1e-6 * np.eye(d))
        if last > best:
            best, found = last, (weights, means, covs)
    return found


def _parameters(row: dict, d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return (np.array(row["weights"], float), np.array(row["means"], float).reshape(-1, d),
            np.array(row["covs"], float).reshape(-1, d, d))


def _matrix(rows: pa.Table, cols: Sequence[str]) -> np.ndarray:
    return np.column_stack([rows.column(c).to_numpy() for c in cols]).astype(float)


def score_by_source(rows: DataFrame, models: DataFrame, cols: Sequence[str], out: str = "score", flag: str = "pred",
                    task_rows: int | None = None) -> DataFrame:
    """Adds ``-log p`` under the source's mixture, and whether it is above that mixture's threshold.

    Up to ``HELD_MODELS`` mixtures go to every task, and the rows stay where they are. Otherwise a source's rows are dealt
    over tasks by a hash of their values, and its model goes to each of them.
    """
    cols, names = list(cols), rows.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + f", `{out}` double, `{flag}` int"
    held = models.select("source", "threshold", "weights", "means", "covs").limit(HELD_MODELS + 1).collect()
    if len(held) <= HELD_MODELS:
        known = {r["source"]: (r["threshold"], _parameters(r, len(cols))) for r in held}

        def score_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                coded = batch.column("source").dictionary_encode()
                place = coded.indices.to_numpy(zero_copy_only=False)
                x = _matrix(pa.Table.from_batches([batch]), cols)
                values, hit = np.full(len(x), np.nan), np.zeros(len(x), np.int32)
                for i, source in enumerate(coded.dictionary.to_pylist()):
                    if source in known:
                        threshold, mixture = known[source]
                        here = np.flatnonzero(place == i)
                        values[here] = -log_density(x[here], *mixture)
                        hit[here] = values[here] > threshold
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.float64(), from_pandas=True), pa.array(hit)],
                                                 [*names, out, flag])
        return rows.mapInArrow(score_all, schema)
    salts = rows.groupBy("source").agg(F.ceil(F.count(F.lit(1)) / (task_rows or TASK_ROWS)).cast("int").alias("_salts"))
    dealt = join_small(rows, salts, ["source"]).withColumn(
        "_salt", F.pmod(F.xxhash64(*[q(c) for c in names]), F.col("_salts")).cast("int")).drop("_salts")
    spread = models.join(salts, "source").select(
        "source", "threshold", "weights", "means", "covs", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)).alias("_salt"))

    def score(group: pa.Table, model: pa.Table) -> pa.Table:
        kept = group.select(names)
        row = model.to_pylist()[0] if model.num_rows else None
        values = -log_density(_matrix(group, cols), *_parameters(row, len(cols))) if row and group.num_rows else np.full(
            group.num_rows, np.nan)
        kept = kept.append_column(out, pa.array(values, pa.float64(), from_pandas=True))
        return kept.append_column(flag, pa.array((values > (row["threshold"] if row else 0)).astype(np.int32)))
    return dealt.groupBy("source", "_salt").cogroup(spread.groupBy("source", "_salt")).applyInArrow(score, schema)


def refit_by_source(buffers: DataFrame, models: DataFrame, cols: Sequence[str], k: int, percentile: float, seed: int = 42,
                    n_init: int = 1, max_iter: int = 100, baseline_points: int = 1000, idx: str = "idx") -> DataFrame:
    """All sources at once: a mixture of each source's buffered rows, its threshold and baseline on them, and the median
    scores under the source's old mixture (null without one) and the new (``REFITS``)."""
    cols = list(cols)

    def fit(group: pa.Table, model: pa.Table) -> pa.Table:
        if not group.num_rows:
            return pa.table({f: [] for f in ("source", "recent_rows", "threshold", "weights", "means", "covs", "median_old",
                                             "median_new", "baseline")}, schema=_REFIT_ARROW)
        x = _matrix(group.sort_by(idx), cols)
        new = em_arrays(x, k, seed, n_init, max_iter)
        scores = -log_density(x, *new)
        old = model.to_pylist()[0] if model.num_rows else None
        before = float(np.median(-log_density(x, *_parameters(old, len(cols))))) if old else None
        points = np.arange(1, baseline_points) / baseline_points
        return pa.Table.from_pylist([{
            "source": group.column("source")[0].as_py(), "recent_rows": len(x),
            "threshold": float(np.quantile(scores, 1.0 - percentile / 100.0)), "weights": new[0].tolist(),
            "means": new[1].ravel().tolist(), "covs": new[2].ravel().tolist(), "median_old": before,
            "median_new": float(np.median(scores)), "baseline": np.quantile(scores, points).tolist()}], schema=_REFIT_ARROW)
    rows = buffers.select("source", q(idx).cast("long").alias(idx), *[q(c).cast("double").alias(c) for c in cols])
    held = models.select("source", "weights", "means", "covs")
    return rows.groupBy("source").cogroup(held.groupBy("source")).applyInArrow(fit, REFITS)


_LIST = pa.list_(pa.float64())
_WATCHED = [pa.string(), pa.string(), pa.int64(), pa.list_(pa.string()), pa.float64(), pa.float64(), pa.bool_(), pa.int64(), pa.string()]
_REFIT_ARROW = pa.schema([
    ("source", pa.string()), ("recent_rows", pa.int64()), ("threshold", pa.float64()), ("weights", _LIST), ("means", _LIST),
    ("covs", _LIST), ("median_old", pa.float64()), ("median_new", pa.float64()), ("baseline", _LIST)])


@dataclass
class SourceAdaptation:
    """Scores micro-batches and adapts each source on its own; ``process`` fits ``foreachBatch``.

    ``model`` gives every new source its first mixture and the settings of refits. ``labelled`` rows (the model's columns,
    ``y`` and the source column) judge the refits of their source; a source without them is judged by median scores.
    """

    model: GaussianMixtureDetector
    source_col: str
    labelled: DataFrame | None = None
    monitor: ScoreMonitor | None = None
    ks_baseline: Sequence[float] | None = None
    idx: str = "idx"
    capacity: int = 20_000
    mode: str = "sliding"
    limit: Tolerance = Tolerance()
    min_interval: int = 10
    admit_quantile: float = 0.40
    history: int = 500
    least: int = 50
    baseline_points: int = 1000
    seed: int = 42
    event_paths: list[str] = field(default_factory=list)
    report_paths: list[str] = field(default_factory=list)

    def __post_init__(self) -> None:
        if self.monitor is None:
            ks = None if self.ks_baseline is None else KsWindow(self.ks_baseline)
            self.monitor = ScoreMonitor(self.model.threshold, ks=ks)
        self.models: DataFrame | None = None
        self.states: DataFrame | None = None
        self.buffer: DataFrame | None = None

    def _sourced(self, df: DataFrame, *more: str) -> DataFrame:
        source = F.coalesce(q(self.source_col).cast("string"), F.lit("")).alias("source")
        return df.select(source, *[q(c).cast("double").alias(c) for c in self.model.cols], *[q(c) for c in more])

    def process(self, batch: DataFrame, batch_id: int = 0) -> None:
        rows = self._sourced(batch, self.model.id_col, self.idx).withColumn(self.idx, q(self.idx).cast("long"))
        self._meet(rows)
        scored = table(score_by_source(rows, self.models, self.model.cols), "scored")
        if scored.isEmpty():
            return
        seen = self._watch(scored)
        self._refill(seen)
        self._refit(scored)

    def _meet(self, rows: DataFrame) -> None:
        """A first mixture for every source that has none."""
        spark, m = rows.sparkSession, self.model
        first = spark.createDataFrame([(
            0, float(m.threshold), m.weights.tolist(), m.means.ravel().tolist(), m.covs.ravel().tolist(), -self.min_interval, 0)],
            MODELS.split(", ", 1)[1])
        known = self.models if self.models is not None else spark.createDataFrame([], MODELS)
        new = rows.select("source").distinct().join(known, "source", "left_anti").join(F.broadcast(first))
        self.models = table(known.unionByName(new), "source-models")

    def _watch(self, scored: DataFrame) -> DataFrame:
        """One keyed pass: drift events, admitted rows and the new state of every source in the batch, as one table."""
        spark, monitor, idx, features = scored.sparkSession, self.monitor, self.idx, list(self.model.cols)
        cols = [self.model.id_col, *features]
        history, least, quantile = self.history, self.least, self.admit_quantile
        # a sliding buffer holds the newest rows only, so no older ones leave the task
        newest = -self.capacity if self.mode == "sliding" else None
        states = self.states if self.states is not None else spark.createDataFrame([], STATES)
        own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in scored.select(*[q(c) for c in cols]).schema)
        schema = ("source string, kind string, at long, detectors array<string>, score double, ks_p double, "
                  f"pending boolean, began long, state string, {own}")
        names = ["source", "kind", "at", "detectors", "score", "ks_p", "pending", "began", "state"]

        def run(now: pa.Table, held: pa.Table) -> pa.Table:
            source = (now if now.num_rows else held).column("source")[0].as_py()
            before = held.to_pylist()
            state = json.loads(before[0]["state"]) if before else {"monitor": monitor.start(), "recent": []}
            pending = bool(before[0]["pending"]) if before else False
            places = np.argsort(now.column(idx).to_numpy(), kind="stable")
            at, scores, flags = now.column(idx).to_numpy()[places], now.column("score").to_numpy()[places], now.column("pred").to_numpy()[places]
            found = []
            if len(at):
                state["monitor"], found = monitor.run(state["monitor"], pd.DataFrame({"score": scores, "flag": flags}))
            first = int(at[found[0][0]]) if found else None
            began = first if found and not pending else None
            since = began if began is not None else (-1 if pending else None)
            line = np.r_[np.array(state["recent"], float), scores]
            old, admitted = len(line) - len(scores), flags == 0
            if since is not None:
                asked = np.flatnonzero((flags == 1) & (at >= since))
                missing = np.r_[0, np.cumsum(np.isnan(line))]
                ends = old + asked + 1
                whole = missing[ends] == missing[np.maximum(ends - history, 0)]  # a missing score leaves no quantile
                low = in_low_tail(line, np.ones(len(line), bool), ends[whole] - 1, quantile, history, least)
                admitted[asked[whole]] = low
            if began is not None:
                admitted &= at >= began
            state["recent"] = line[-history:].tolist()
            plain = lambda v: None if v is None or v != v else float(v)
            out = [(source, "event", int(at[o]), list(d), plain(m["score"]), plain(m.get("ks_p")), None, None, None) for o, d, m in found]
            out.append((source, "state", None, None, None, None, pending or bool(found), began, json.dumps(state)))
            told = pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _WATCHED, strict=True)], names)
            kept = now.take(pa.array(places[np.flatnonzero(admitted)[newest:]]))
            n, numbers = kept.num_rows, {c: kept.column(c).to_numpy() for c in ("score", *features)}
            own_columns = {"source": pa.array([source] * n, pa.string()), "kind": pa.array(["row"] * n, pa.string()),
                           "at": kept.column(idx), cols[0]: kept.column(cols[0])} | {
                               c: pa.array(v, pa.float64(), from_pandas=True) for c, v in numbers.items()}
            return pa.concat_tables([told, pa.table(own_columns)], promote_options="default").select([*names, *cols])

        wanted = scored.select("source", self.idx, "score", "pred", *[q(c) for c in cols])
        seen = table(wanted.groupBy("source").cogroup(states.groupBy("source")).applyInArrow(run, schema), "watched")
        path = scratch_path(spark, "source-events")
        seen.filter("kind = 'event'").select("source", "at", "detectors", "score", "ks_p").write.parquet(path)
        self.event_paths.append(path)
        new = seen.filter("kind = 'state'").select("source", "pending", "state")
        self.states = table(states.join(new, "source", "left_anti").unionByName(new), "source-states")
        return seen

    def _refill(self, seen: DataFrame) -> None:
        """Admitted rows join the buffers; a source whose alarm began forgets what it held; the capacity holds for each."""
        fresh = seen.filter("kind = 'row'").select(
            "source", F.col("at").alias(self.idx), q(self.model.id_col), *[q(c) for c in self.model.cols])
        if self.buffer is not None:
            began = seen.filter("kind = 'state' AND began IS NOT NULL").select("source")
            fresh = self.buffer.join(began, "source", "left_anti").unionByName(fresh)
        newest = [q(self.idx).desc()] if self.mode == "sliding" else [hash_key(self.model.id_col, self.seed), q(self.idx)]
        place = F.row_number().over(Window.partitionBy("source").orderBy(*newest))
        self.buffer = table(fresh.withColumn("_place", place).filter(F.col("_place") <= self.capacity).drop("_place"), "buffers")

    def _refit(self, scored: DataFrame) -> None:
        """Fits and judges all sources that are due; accepted mixtures, re-armed monitors and the report are new tables."""
        spark, limit, m = scored.sparkSession, self.limit, self.model
        held = self.buffer.groupBy("source").agg(F.count(F.lit(1)).alias("held"))
        last = scored.groupBy("source").agg(F.max(self.idx).alias("last"))
        grown = F.greatest(F.lit(max(limit.rows, 10)), F.col("last_buffer") + max(20, limit.rows // 4))
        due = table(self.models.join(self.states.filter("pending").select("source"), "source").join(held, "source").join(last, "source")
                    .filter((F.col("held") >= grown) & (F.col("last") - F.col("last_attempt") >= self.min_interval))
                    .select("source", "last", "held"), "due")
        if due.isEmpty():
            return
        buffers = self.buffer.join(due.select("source"), "source", "left_semi")
        fitted = table(refit_by_source(buffers, self.models.join(due.select("source"), "source", "left_semi"), m.cols, m.k, m.percentile,
                                       self.seed, m.n_init, m.max_iter, self.baseline_points, self.idx), "refits")
        judged = self._judged(fitted)
        path = scratch_path(spark, "source-reports")
        judged.join(due, "source").select(
            "source", (F.col("last") + 1).alias("step"), "accepted", "reason", "recent_rows", "false_old", "false_new",
            "hit_old", "hit_new", "median_old", "median_new").write.parquet(path)
        self.report_paths.append(path)
        verdict = spark.read.parquet(path).select("source", "accepted")
        parameters = [c.split()[0] for c in PARAMETERS.split(", ")]
        tried = (self.models.join(due, "source").join(verdict, "source")
                 .join(fitted.select("source", *[F.col(c).alias(f"new_{c}") for c in parameters]), "source"))
        swapped = tried.select(
            "source", (F.col("version") + F.col("accepted").cast("int")).alias("version"),
            *[F.when(F.col("accepted"), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) for c in parameters],
            F.col("last").alias("last_attempt"), F.when(F.col("accepted"), 0).otherwise(F.col("held")).alias("last_buffer"))
        self.models = table(self.models.join(due, "source", "left_anti").unionByName(swapped), "source-models")
        self._rearm(fitted.join(verdict.filter("accepted"), "source", "left_semi").select("source", "threshold", "baseline"))

    def _judged(self, fitted: DataFrame) -> DataFrame:
        """The refits with the rates of both mixtures on their source's labelled rows, and the verdict of the rule table."""
        spark = fitted.sparkSession
        if self.labelled is None:
            rates = spark.createDataFrame([], RATES)
        else:
            rows = self._sourced(self.labelled, "y").join(fitted.select("source"), "source", "left_semi")
            cols = self.model.cols
            both = score_by_source(score_by_source(rows, self.models, cols, "_s", "_old"), fitted, cols, "_t", "_new")
            share = lambda flag, label: F.avg(F.when(F.col("y") == label, F.col(flag)))
            rates = both.groupBy("source").agg(
                share("_old", 0).alias("false_old"), share("_new", 0).alias("false_new"),
                share("_old", 1).alias("hit_old"), share("_new", 1).alias("hit_new"))
        rules = rule_table(self.limit)
        rule = F.coalesce(*[F.when(cond, F.struct(F.lit(why).alias("reason"), F.lit(ok).alias("accepted")))
                            for why, ok, cond in rules])
        return fitted.join(rates, "source", "left").withColumn("_rule", rule).select(
            "*", "_rule.reason", "_rule.accepted").drop("_rule")

    def _rearm(self, accepted: DataFrame) -> None:
        """Fresh detectors, threshold and baseline for the sources that got a new mixture; the others keep theirs."""
        monitor = self.monitor

        def again(held: pa.Table, new: pa.Table) -> pa.Table:
            rows = held.to_pylist()
            if rows and new.num_rows:
                change, state = new.to_pylist()[0], json.loads(rows[0]["state"])
                state["monitor"] = monitor.rearm(state["monitor"], change["threshold"], change["baseline"])
                rows[0] |= {"pending": False, "state": json.dumps(state)}
            return pa.Table.from_pylist(rows, schema=pa.schema(
                [("source", pa.string()), ("pending", pa.bool_()), ("state", pa.string())]))
        self.states = table(self.states.groupBy("source").cogroup(accepted.groupBy("source")).applyInArrow(again, STATES), "source-states")

    def _tables(self, spark: SparkSession, paths: Sequence[str], schema: str) -> DataFrame:
        return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)

    def events(self, spark: SparkSession) -> DataFrame:
        return self._tables(spark, self.event_paths, "source string, at long, detectors array<string>, score double, ks_p double")

    def reports(self, spark: SparkSession) -> DataFrame:
        """One row a source and refit attempt."""
        return self._tables(spark, self.report_paths, "source string, step long, accepted boolean, reason string, recent_rows long, "
                            "false_old double, false_new double, hit_old double, hit_new double, median_old double, median_new double")

    def status(self) -> DataFrame:
        """source, version, pending, buffer_rows of every source."""
        held = self.buffer.groupBy("source").agg(F.count(F.lit(1)).alias("buffer_rows"))
        return (self.models.select("source", "version").join(self.states.select("source", "pending"), "source", "left")
                .join(held, "source", "left").select("source", "version", "pending", F.coalesce("buffer_rows", F.lit(0)).alias("buffer_rows")))

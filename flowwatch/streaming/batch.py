"""Folds over stored score streams, per key and in order, in bounded segments."""

from __future__ import annotations

import json
import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from flowwatch.functions.exprs import q
from flowwatch.operators import order
from flowwatch.operators.order import dense_index
from flowwatch.session import scratch_path

_OUT = "step long, detectors array<string>, details map<string,double>, state string"


def fold_stream(df: DataFrame, key: str, order_col: str, tie_col: str, fold, cols: Sequence[str] = ("score",),
                segment_rows: int = 1_000_000) -> DataFrame:
    """Events ``(key, step, detectors, details)``; ``step`` counts rows of the key from 1.

    A fold is sequential within a key. Keys up to ``segment_rows`` rows run in
    one grouped pass. Longer keys go through in segments: every round reads one
    segment per key from a table written once, and hands a small state table to
    the next round, so no task ever holds more than one segment of a key.
    """
    spark = df.sparkSession
    needed = df.select(q(key), *[q(c) for c in dict.fromkeys([order_col, tie_col, *cols]) if c != key])
    indexed, n = dense_index(needed, order_col, tie_col, by=[key], out="_pos")
    kind = df.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, {_OUT}"
    names = list(cols)

    def events(key_value, base: int, found, state: dict | None) -> pd.DataFrame:
        out = [(key_value, base + offset + 1, list(names_), details, None) for offset, names_, details in found]
        if state is not None:
            out.append((key_value, None, None, None, json.dumps(state)))
        frame = pd.DataFrame(out, columns=[key, "step", "detectors", "details", "state"])
        frame["step"] = frame["step"].astype("Int64")
        return frame

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_pos")
        _, found = fold.run(fold.start(), pdf[names])
        return events(pdf[key].iloc[0], 0, found, None)

    longest = n if n <= segment_rows else (indexed.agg(F.max("_pos")).first()[0] or 0) + 1
    rows = indexed.select(key, "_pos", *names) if key not in names else indexed.select("_pos", *names)
    if longest <= segment_rows:
        return rows.groupBy(key).applyInPandas(whole, schema).drop("state")

    base_path = scratch_path(spark, "fold")
    rows.withColumn("seg", F.floor(F.col("_pos") / segment_rows).cast("int")).write.partitionBy("seg").parquet(
        f"{base_path}/rows")
    stored = spark.read.parquet(f"{base_path}/rows")

    def step(pdf: pd.DataFrame, before: pd.DataFrame) -> pd.DataFrame:
        if pdf.empty:
            return events(None, 0, [], None)
        pdf = pdf.sort_values("_pos")
        state = json.loads(before["state"].iloc[0]) if len(before) else fold.start()
        state, found = fold.run(state, pdf[names])
        return events(pdf[key].iloc[0], int(pdf["_pos"].iloc[0]), found, state)

    state = spark.createDataFrame([], f"`{key}` {kind}, state string")
    paths = []
    for s in range(math.ceil(longest / segment_rows)):
        part = stored.filter(F.col("seg") == s)
        done = part.groupBy(key).cogroup(state.groupBy(key)).applyInPandas(step, schema)
        paths.append(f"{base_path}/out-{s}")
        done.write.parquet(paths[-1])
        state = spark.read.schema(schema).parquet(paths[-1]).filter("state IS NOT NULL").select(key, "state")
    return spark.read.schema(schema).parquet(*paths).filter("state IS NULL").drop("state")


def page_hinkley_first_alarm(df: DataFrame, key: str, order_col: str, tie_col: str, score: str = "score",
                             tau: float = 40.0, lam: float = 0.1, warmup: int = 150) -> DataFrame:
    """Rows and first alarm per key, from summaries of index blocks that compose; only blocks with an alarm are replayed.

    What came before a block acts on it by the sum of its scores (the running mean) and by the excess ``e`` of the deviation
    sum over its minimum: inside the block the excess is the larger of ``e + s`` and ``s`` less its own running minimum.
    So a block needs its total, minimum, maximum and largest rise; the blocks of a key are composed by running sums and
    minima over these few rows, and no block waits for another.
    """
    indexed, _ = dense_index(df.select(key, *dict.fromkeys([order_col, tie_col]), q(score).cast("double").alias("_x")),
                             order_col, tie_col, by=[key])
    blocks = indexed.select(q(key), "idx", "_x", F.floor(F.col("idx") / order.TASK_ROWS).cast("long").alias("_blk"))
    earlier = Window.partitionBy(key).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    sums = blocks.groupBy(key, "_blk").agg(F.sum("_x").alias("_t"), F.count(F.lit(1)).alias("_n"))
    before = sums.select(q(key), "_blk", F.coalesce(F.sum("_t").over(earlier), F.lit(0.0)).alias("_before"))
    staged = order.join_small(blocks, before, [key, "_blk"])

    def deviations(block: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray]:
        """Of one block in order: whether rows are past the warm-up, deviation sums and their running minimum."""
        block = block.sort_by("idx")
        x, count = block.column("_x").to_numpy(), block.column("idx").to_numpy() + 1
        known = ~np.isnan(x)  # a missing score counts as a row and moves nothing
        means = (block.column("_before")[0].as_py() + np.cumsum(np.where(known, x, 0.0))) / count
        armed = count > warmup
        s = np.cumsum(np.where(armed & known, x - means - lam, 0.0))
        return block, armed, s, np.minimum.accumulate(np.where(armed, s, np.inf))

    def summary(block: pa.Table) -> pa.Table:
        block, armed, s, low = deviations(block)
        known = [s[-1], low[-1], s[armed].max(), (s - low)[armed].max()] if armed.any() else [0.0, None, None, None]
        return block.select([key, "_blk"])[:1].append_column("_total", pa.array(known[:1], pa.float64())).append_column(
            "_low", pa.array(known[1:2], pa.float64())).append_column("_top", pa.array(known[2:3], pa.float64())).append_column(
            "_rise", pa.array(known[3:], pa.float64()))

    def replay(block: pa.Table) -> pa.Table:
        block, armed, s, low = deviations(block)
        hit = armed & (np.maximum(block.column("_e")[0].as_py() + s, s - low) > tau)
        return block.select([key])[:1].append_column(
            "first_alarm", pa.array([int(block.column("idx")[int(hit.argmax())].as_py()) + 1 if hit.any() else None], pa.int64()))

    kind = df.schema[key].dataType.simpleString()
    known = staged.groupBy(key, "_blk").applyInArrow(
        summary, f"`{key}` {kind}, _blk long, _total double, _low double, _top double, _rise double")
    placed = known.withColumn("_s", F.coalesce(F.sum("_total").over(earlier), F.lit(0.0)))
    placed = placed.withColumn("_e", F.col("_s") - F.least(F.lit(0.0), F.min(F.col("_s") + F.col("_low")).over(earlier)))
    hits = placed.filter((F.col("_e") + F.col("_top") > tau) | (F.col("_rise") > tau)).groupBy(key).agg(
        F.min(F.struct("_blk", "_e")).alias("_h")).select(q(key), "_h._blk", "_h._e")
    alarms = order.join_small(staged, hits, [key, "_blk"]).groupBy(key).applyInArrow(replay, f"`{key}` {kind}, first_alarm long")
    return sums.groupBy(key).agg(F.sum("_n").alias("n")).join(alarms, key, "left")


def drift_sensitivity(df: DataFrame, key: str, order_col: str, tie_col: str, make, thresholds: Sequence[float],
                      segment_rows: int = 1_000_000) -> DataFrame:
    """Number of alarms and the first one, per key and threshold."""
    from flowwatch.streaming.folds import SensitivityFold
    fold = SensitivityFold({repr(float(t)): make(float(t)) for t in thresholds})
    found = fold_stream(df, key, order_col, tie_col, fold, segment_rows=segment_rows)
    hits = found.groupBy(key, F.element_at("detectors", 1).cast("double").alias("threshold")).agg(
        F.count(F.lit(1)).alias("events"), F.min("step").alias("first_step"))
    keys = df.select(key).distinct().select(
        key, F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold"))
    return keys.join(hits, [key, "threshold"], "left").withColumn("events", F.coalesce("events", F.lit(0)))


def label_at_drift(events: DataFrame, rows: DataFrame, key: str, label: str, order_col: str, tie_col: str) -> DataFrame:
    """Label of the row at each drift index; an index past the end takes the last row."""
    indexed, _ = dense_index(rows.select(key, q(label), *dict.fromkeys([order_col, tie_col])), order_col, tie_col, by=[key])
    sizes = indexed.groupBy(key).agg(F.max("idx").alias("_last"))
    placed = events.join(sizes, key).withColumn("idx", F.least("step", "_last")).drop("_last")
    return placed.join(indexed.select(key, "idx", q(label)), [key, "idx"]).drop("idx")


def inject_shift(df: DataFrame, cols: Sequence[str], idx: str, after: int, shift: float) -> DataFrame:
    """Adds ``shift`` deviations to every column from index ``after`` on."""
    row = df.agg(*[F.stddev_pop(q(c)).alias(f"s{i}") for i, c in enumerate(cols)]).first()
    return df.select(*[
        F.when(q(idx) >= after, q(c) + shift * float(row[f"s{cols.index(c)}"] or 0.0)).otherwise(q(c)).alias(c)
        if c in cols else q(c) for c in df.columns])


def shift_benign(df: DataFrame, cols: Sequence[str], shift: float, stds: dict, y: str = "y") -> DataFrame:
    """Validation rows of the shifted world: benign rows move, attacks do not."""
    return df.select(*[
        F.when(q(y) == 0, q(c) + shift * float(stds[c])).otherwise(q(c)).alias(c) if c in cols else q(c)
        for c in df.columns])


# --- replay buffers ------------------------------------------------------------------------


def replay_buffer_sliding(df: DataFrame, capacity: int, idx: str) -> DataFrame:
    """The most recent ``capacity`` rows of a unique index, which may have gaps."""
    placed, n = dense_index(df, idx, idx, out="_place")
    return placed.filter(F.col("_place") >= n - capacity).drop("_place")


def replay_buffer_reservoir(df: DataFrame, capacity: int, row_id: str, seed: int = 42) -> DataFrame:
    """A uniform sample of the whole history: the rows with the lowest hashes."""
    return order.hash_take(df, capacity, row_id, seed)


def buffer_reset(df: DataFrame, idx: str, alarm_idx: int) -> DataFrame:
    """Rows before the alarm leave the buffer."""
    return df.filter(q(idx) >= alarm_idx)


def admission_rule(df: DataFrame, score: str, flag: str, pending: str, idx: str = "idx", quantile: float = 0.40,
                   history: int = 500, least: int = 50) -> DataFrame:
    """Adds ``admitted``: unflagged rows, and the low tail of recent scores while an alarm is pending.

    Only flagged rows under a pending alarm need the quantile; they are ranked in their windows, an index block at a time.
    """
    from flowwatch.operators.sequence import halo_ranges
    spread, home = halo_ranges(df, history - 1, 0, idx)
    mark = lambda name, value: F.coalesce(q(name) == value, F.lit(False))
    staged = spread.select("*", (F.col("_blk") == home).alias("_own"), q(score).cast("double").alias("_x"),
                           mark(flag, 0).alias("_calm"), (mark(pending, 1) & ~mark(flag, 0)).alias("_ask"))
    given = df.columns

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by(idx)
        own, asked = group.column("_own").to_numpy(), group.column("_ask").to_numpy()
        known = ~group.column("_x").is_null().to_numpy()
        x = group.column("_x").fill_null(0.0).to_numpy()
        admitted = group.column("_calm").to_numpy().copy()
        at = np.flatnonzero(own & asked & known)
        admitted[at] = in_low_tail(x, known, at, quantile, history, least)
        kept = group.filter(group.column("_own")).select(given)
        return kept.append_column("admitted", pa.array(admitted[own].astype(np.int32)))

    schema = StructType([*df.schema.fields, StructField("admitted", IntegerType())])
    return staged.groupBy("_blk").applyInArrow(run, schema)


def in_low_tail(x: np.ndarray, known: np.ndarray, at: np.ndarray, quantile: float, history: int, least: int,
                at_once: int = 2048) -> np.ndarray:
    """Whether the values at some places are at or below the quantile of the last ``history`` rows' known values, of which
    at least ``least`` are needed.

    A value of the window is at or below the interpolated quantile just when no more values than the rank below the
    quantile are smaller, so the values are counted and not sorted. NaN counts as larger than any other value.
    """
    pad = np.full(history - 1, False)
    values = np.concatenate([np.zeros(history - 1), x])
    present = np.concatenate([pad, known])
    views = np.lib.stride_tricks.sliding_window_view
    out = np.zeros(len(at), bool)
    for a in range(0, len(at), at_once):
        rows = at[a:a + at_once]
        window, there = views(values, history)[rows], views(present, history)[rows]
        n = there.sum(axis=1)
        mine = x[rows][:, None]
        smaller = (((window < mine) | (np.isnan(mine) & ~np.isnan(window))) & there).sum(axis=1)
        out[a:a + at_once] = (n >= least) & (smaller <= np.floor(quantile * (n - 1)))
    return out

"""Drift tests over stored score streams whose long keys are worked in parallel, in ranges of the key's index.

A range carries the rows before it that its first windows reach (a halo). A missing score counts as a row; it is
larger than any other for the KS test, and a window that holds one gives no split in the adaptive window.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowwatch.functions.exprs import q
from flowwatch.functions.ks import ks_p_values, window_distances
from flowwatch.operators import order
from flowwatch.operators.sequence import halo_ranges
from flowwatch.session import scratch_path
from flowwatch.streaming.folds import Adwin, KsWindow

def _indexed(df: DataFrame, key: str, order_col: str, tie_col: str, score: str) -> DataFrame:
    needed = df.select(q(key), *[q(c) for c in dict.fromkeys([order_col, tie_col]) if c != key],
                       q(score).cast("double").alias("_x"))
    return order.dense_index(needed, order_col, tie_col, by=[key])[0].select(q(key), "idx", "_x")


def ks_window_tests(df: DataFrame, key: str, order_col: str, tie_col: str, test: KsWindow, score: str = "score",
                    block: int | None = None) -> DataFrame:
    """``(key, step, distance, ks_p, alarm)`` of every scheduled test of a key; ``step`` counts the key's rows from 1.

    A row's rank in the frozen baseline is found once; a test sorts the ranks of its window. No test waits for another.
    """
    values, counts = np.unique(np.asarray(test.baseline, dtype=float), return_counts=True)
    upto = np.concatenate([[0], np.cumsum(counts)])
    size, cadence, alpha = test.window, test.cadence, test.alpha
    spread, home = halo_ranges(_indexed(df, key, order_col, tie_col, score), size - 1, 0, block=block or order.TASK_ROWS)
    staged = spread.withColumn("_own", F.col("_blk") == home)

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("idx")
        place, x = rows.column("idx").to_numpy(), rows.column("_x").to_numpy()
        own = place[rows.column("_own").to_numpy()]
        stop = own[-1] + 1 if len(own) else 0  # no own rows: only the halo behind a key's last range
        first = max(-(-(own[0] + 1 if len(own) else 1) // cadence), -(-size // cadence)) * cadence
        steps = np.arange(first, stop + 1, cadence)  # rows seen at each test
        found = np.zeros(0)
        if len(steps):
            codes = np.searchsorted(values, x, side="left") + np.searchsorted(values, x, side="right")
            found = window_distances(codes[first - size - place[0]:], upto, size, cadence)[:len(steps)]
        p = ks_p_values(found, int(upto[-1]), size)
        return pa.table({key: rows.column(key).take(pa.array(np.zeros(len(steps), np.int64))),
                         "step": pa.array(steps, pa.int64()), "distance": found, "ks_p": p, "alarm": pa.array(p < alpha)})

    kind = df.schema[key].dataType.simpleString()
    return staged.groupBy(key, "_blk").applyInArrow(
        run, f"`{key}` {kind}, step long, distance double, ks_p double, alarm boolean")


def split_reach(test: Adwin, before: np.ndarray, own: np.ndarray, first: int) -> float:
    """Most checks, counted when the range begins with a full window, at which some check of the range may find a split.

    ``before`` are the rows a full window holds when the range begins at index ``first``. A check finds a split up to a
    number of checks that follows from its largest gap, and each check before it in the range has added the same number.
    """
    width, k = test.max_window, np.arange(test.min_window, test.max_window - test.min_window + 1)
    if first < width or not len(k):
        return -np.inf
    rows, each = np.concatenate([before, own]), len(k)
    n1, best = width - k, -np.inf
    harmonic = 1.0 / k + 1.0 / n1
    for j in range(len(own) // test.cadence):
        end = len(before) + (j + 1) * test.cadence
        sums = np.cumsum(rows[end - width:end])
        gap = np.abs(sums[k - 1] / k - (sums[-1] - sums[k - 1]) / n1)
        power = np.where(np.isnan(gap), -np.inf, 2.0 * (gap / test.scale) ** 2 / harmonic).max()
        with np.errstate(over="ignore"):
            best = max(best, np.exp(power * (1 + 1e-9) + 1e-9) * test.delta / 4.0 - (j + 1) * each)
    return float(best)


def adwin_alarms(df: DataFrame, key: str, order_col: str, tie_col: str, test: Adwin, score: str = "score",
                 block: int | None = None) -> DataFrame:
    """``(key, step, score)`` of each alarm of the adaptive window; the same alarms as its fold in one sequence.

    A range that begins with a full window and no pending split is summed up, in parallel, by one number: up to how many
    checks it may hold a candidate for a cut (:func:`split_reach`). A range beyond that passes on a full window, and the
    number of checks grows by a known amount, so it is never folded. The others are folded from the state that really
    arrives: a round takes the next such range of every key, so the rounds are those of the key with most of them.
    """
    spark, width, cadence = df.sparkSession, test.max_window, test.cadence
    block = max(block or order.TASK_ROWS, width + 1)
    block = -(-block // cadence) * cadence  # checks fall on the ends of ranges
    spread, home = halo_ranges(_indexed(df, key, order_col, tie_col, score), width, 0, block=block)
    kind = df.schema[key].dataType.simpleString()

    def summed(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("idx")
        own, x = rows.column("_own").to_numpy(), rows.column("_x").to_numpy()
        place = rows.column("idx").to_numpy()
        if not own.any():  # the halo behind a key's last range
            return pa.table({key: rows.column(key)[:0], "_blk": rows.column("_blk")[:0], "_reach": pa.array([], pa.float64()),
                             "_halo": pa.array([], pa.list_(pa.float64())), "_rows": pa.array([], pa.list_(pa.float64()))})
        return pa.table({key: rows.column(key)[:1], "_blk": rows.column("_blk")[:1],
                         "_reach": [split_reach(test, x[~own], x[own], int(place[own][0]))],
                         "_halo": pa.array([x[~own]], pa.list_(pa.float64())),
                         "_rows": pa.array([x[own]], pa.list_(pa.float64()))})

    path = scratch_path(spark, "adwin")
    spread.withColumn("_own", F.col("_blk") == home).groupBy(key, "_blk").applyInArrow(
        summed, f"`{key}` {kind}, _blk long, _reach double, _halo array<double>, _rows array<double>",
    ).write.parquet(f"{path}/ranges")
    ranges = spark.read.parquet(f"{path}/ranges")
    per_range = block // cadence * max(0, width - 2 * test.min_window + 1)

    def fold(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                state = json.loads(r["_state"]) if r["_state"] else test.start()
                if r["_at"] != r["_blk"]:  # ranges in between were passed with a full window and nothing pending
                    checks = state["checks"] + (r["_blk"] - r["_at"]) * per_range
                    state = {"window": r["_halo"], "t": r["_blk"] * block, "checks": checks, "pending": False}
                rows = np.array(r["_rows"], dtype=float)
                state, alarms = test.run(state, rows)
                out += [(r[key], r["_blk"] * block + a + 1, float(rows[a]), None, None, None, None) for a in alarms]
                full = len(state["window"]) == width and not state["pending"]
                out.append((r[key], None, None, r["_blk"] + 1, full, float(state["checks"]), json.dumps(state)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 7, (
                    batch.schema.field(key).type, pa.int64(), pa.float64(), pa.int64(), pa.bool_(), pa.float64(), pa.string()),
                    strict=True)], [key, "step", "score", "_at", "_full", "_checks", "_state"])

    schema = f"`{key}` {kind}, step long, score double, _at long, _full boolean, _checks double, _state string"
    state = ranges.filter("_blk = 0").select(key, F.lit(0).cast("long").alias("_at"), F.lit(False).alias("_full"),
                                             F.lit(0.0).alias("_checks"), F.lit(None).cast("string").alias("_state"))
    paths = []
    while True:
        passed = F.col("_checks") + (F.col("_blk") - F.col("_at")) * float(per_range)
        due = (~F.col("_full") & (F.col("_blk") == F.col("_at"))) | (
            F.col("_full") & (F.col("_blk") >= F.col("_at")) & (F.col("_reach") >= passed))
        mine = state.withColumnRenamed(key, "_key")
        light = mine.drop("_state")
        wanted = ranges.select(q(key), "_blk", "_reach").join(light, q(key).eqNullSafe(F.col("_key"))).filter(due).groupBy(
            "_key").agg(F.min("_blk").alias("_next")).withColumnRenamed("_key", "_of")
        next_ = mine.join(wanted, F.col("_key").eqNullSafe(F.col("_of"))).drop("_of").withColumnRenamed("_next", "_blk")
        at = ranges.withColumnRenamed("_blk", "_b").join(
            next_, q(key).eqNullSafe(F.col("_key")) & (F.col("_b") == F.col("_blk")))
        paths.append(f"{path}/round-{len(paths)}")
        at.select(q(key), "_blk", "_at", "_state", "_halo", "_rows").mapInArrow(fold, schema).write.parquet(paths[-1])
        state = spark.read.schema(schema).parquet(paths[-1]).filter("_at IS NOT NULL").select(
            key, "_at", "_full", "_checks", "_state")
        if state.isEmpty():
            return spark.read.schema(schema).parquet(*paths).filter("_at IS NULL").select(key, "step", "score")

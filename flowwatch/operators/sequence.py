"""Sliding windows over row order, and scores brought back from windows to rows.

Rows carry a dense index. Frames are cut at fixed index blocks, and the few rows
a frame needs from the next or previous block are copied there (a halo), so the
shuffle carries ``1 + W / block`` of the rows and not ``W / stride`` of them.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from flowwatch.functions.exprs import q
from flowwatch.operators.order import dense_index, hash_take
from flowwatch.session import scratch_path

BLOCK = 16_384


def halo_ranges(indexed: DataFrame, before: int, after: int, idx: str = "idx",
                block: int | None = None) -> tuple[DataFrame, Column]:
    """Rows under the index block ``_blk`` that they belong to (the returned number), and under the neighbours that
    reach them with frames of ``before`` rows back and ``after`` rows ahead."""
    block = max(block or BLOCK, before + after + 1)
    home = F.floor(q(idx) / block)
    offset = q(idx) - home * block
    copies = [home]
    if after:  # the previous block looks ahead into these rows
        copies.append(F.when((offset < after) & (home > 0), home - 1))
    if before:  # the next block looks back at these rows
        copies.append(F.when(offset >= block - before, home + 1))
    return indexed.withColumn("_blk", F.explode(F.array_compact(F.array(*copies)))), home


def halo_frame(indexed: DataFrame, exprs: Mapping[str, Column], before: int, after: int,
               idx: str = "idx", block: int | None = None) -> DataFrame:
    """Adds window aggregates over the rows ``idx-before .. idx+after``."""
    spread, home = halo_ranges(indexed, before, after, idx, block)
    w = Window.partitionBy("_blk").orderBy(idx).rowsBetween(-before, after)
    return (
        spread.select("*", *[e.over(w).alias(name) for name, e in exprs.items()])
        .filter(F.col("_blk") == home).drop("_blk")
    )


def _last_start(n: int, size: int) -> int:
    return n - size


def window_frames(indexed: DataFrame, n: int, cols: Sequence[str], size: int, stride: int = 1) -> DataFrame:
    """``(window_id, steps)`` with ``steps`` an array of ``(pos, x)`` in order."""
    stride = max(1, stride)
    step = F.struct(F.col("idx"), F.array(*[q(c).cast("double") for c in cols]).alias("x"))
    rows = indexed.select("idx", step.alias("_s"))
    framed = halo_frame(rows, {"_w": F.collect_list("_s")}, 0, size - 1)
    starts = framed.filter((F.col("idx") % stride == 0) & (F.col("idx") <= _last_start(n, size)))
    return starts.select(
        F.floor(F.col("idx") / stride).cast("long").alias("window_id"),
        F.transform(F.array_sort("_w"), lambda s, i: F.struct(i.alias("pos"), s["x"].alias("x"))).alias("steps"))


def train_windows(benign: DataFrame, cols: Sequence[str], size: int, stride: int, order_col: str, tie_col: str,
                  max_windows: int | None = None, seed: int = 42) -> DataFrame:
    """Windows over benign rows; fewer rows than one window is an error."""
    indexed, n = dense_index(benign.select(*[q(c) for c in dict.fromkeys([order_col, tie_col, *cols])]), order_col, tie_col)
    if n < size:
        raise ValueError(f"need at least {size} benign rows, got {n}")
    windows = window_frames(indexed, n, cols, size, stride)
    total = _last_start(n, size) // max(1, stride) + 1
    if max_windows is not None and total > max_windows:
        return hash_take(windows, max_windows, "window_id", seed)
    return windows


def window_coverage(indexed: DataFrame, n: int, size: int, stride: int, row_id: str = "row_id") -> DataFrame:
    """``(window_id, row_id, idx, pos)``: a narrow expansion of each row."""
    stride = max(1, stride)
    if n < size:
        return indexed.select(F.lit(0).cast("long").alias("window_id"), q(row_id), "idx", F.col("idx").alias("pos"))
    idx = F.col("idx")
    first = F.greatest(F.lit(0), F.ceil((idx - (size - 1)) / stride))
    last = F.least(F.floor(idx / stride), F.lit(_last_start(n, size) // stride))
    hit = indexed.filter(first <= last).select(
        q(row_id), "idx", F.explode(F.sequence(first.cast("long"), last.cast("long"))).alias("window_id"))
    return hit.select("window_id", row_id, "idx", (F.col("idx") - F.col("window_id") * stride).alias("pos"))


def padded_window(indexed: DataFrame, n: int, cols: Sequence[str], size: int) -> DataFrame:
    """Fewer rows than one window as one window, filled with zero rows."""
    zero = F.array(*[F.lit(0.0) for _ in cols])
    one = indexed.select("idx", F.array(*[q(c).cast("double") for c in cols]).alias("x")).agg(
        F.array_sort(F.collect_list(F.struct("idx", "x"))).alias("w"))
    padded = F.concat(F.transform("w", lambda s: s["x"]), F.array_repeat(zero, size - n))
    return one.select(F.lit(0).cast("long").alias("window_id"),
                      F.transform(padded, lambda x, i: F.struct(i.alias("pos"), x.alias("x"))).alias("steps"))


def eval_windows(df: DataFrame, cols: Sequence[str], size: int, stride: int, order_col: str,
                 tie_col: str) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """Windows, coverage, the indexed rows and their number.

    Fewer rows than one window give one window padded with zero rows.
    """
    indexed, n = dense_index(df, order_col, tie_col)
    if n >= size:
        windows = window_frames(indexed, n, cols, size, stride)
    else:
        windows = padded_window(indexed, n, cols, size)
    return windows, window_coverage(indexed, n, size, stride, tie_col), indexed, n


def _covers_all(n: int, size: int, stride: int) -> bool:
    return n < size or (stride <= size and (n - size) % stride == 0)


def scatter_to_rows(errors: DataFrame, indexed: DataFrame, n: int, size: int, stride: int,
                    step_errors: str = "errors", out: str = "score") -> DataFrame:
    """Mean step error over the windows covering a row; the rest take the covered mean."""
    stride = max(1, stride)
    steps = errors.select("window_id", F.posexplode(q(step_errors)).alias("pos", "e"))
    per_row = (
        steps.select((F.col("window_id") * stride + F.col("pos")).alias("idx"), "e")
        .filter(F.col("idx") < n).groupBy("idx").agg(F.avg("e").alias(out))
    )
    joined = indexed.join(per_row, "idx", "left")
    if _covers_all(n, size, stride):
        return joined
    mean = per_row.agg(F.avg(out)).first()[0]
    return joined.withColumn(out, F.coalesce(q(out), F.lit(mean)))


def covering_sums(x: np.ndarray, first: int, n: int, size: int, stride: int,
                  step_errors: Callable[[np.ndarray], np.ndarray], at_once: int = 2048) -> tuple[np.ndarray, np.ndarray]:
    """Of consecutive rows ``x`` from index ``first`` on: the sum of the step errors over the windows of these rows that
    cover a row, and the number of those windows.

    Windows start at multiples of ``stride``. Each step's errors are added to a shifted slice; the number of windows
    is the running sum of their beginnings less their ends. ``step_errors`` takes flat windows.
    """
    sums, turns = np.zeros(len(x)), np.zeros(len(x) + 1)
    stop = min(first + len(x) - size, _last_start(n, size))
    starts = np.arange(-(-first // stride) * stride, stop + 1, stride) - first
    if not len(starts):
        return sums, turns[:-1]
    views = np.lib.stride_tricks.sliding_window_view(x, size, axis=0)
    for a in range(0, len(starts), at_once):
        begin = starts[a:a + at_once]
        errors = step_errors(views[begin].transpose(0, 2, 1).reshape(len(begin), -1))
        for step in range(size):
            sums[begin + step] += errors[:, step]
        turns[begin] += 1
        turns[begin + size] -= 1
    return sums, np.cumsum(turns)[:-1]


def score_ranges(indexed: DataFrame, n: int, cols: Sequence[str], size: int, stride: int,
                 step_errors: Callable[[np.ndarray], np.ndarray], out: str = "score",
                 row_scores: Mapping[str, Callable[[np.ndarray], np.ndarray]] | None = None) -> DataFrame:
    """Adds to each row the mean step error over the windows that cover it, and scores of the row alone.

    One Arrow call an index block with a halo of ``size - 1`` rows on both sides: windows are cut, scored and carried back
    to their rows there, so neither windows nor their errors are shuffled. Rows that no window covers take the mean of
    the covered ones. At least ``size`` rows are needed.
    """
    stride, cols, names = max(1, stride), list(cols), list(row_scores or {})
    spread, home = halo_ranges(indexed, size - 1, size - 1)
    given = [c for c in indexed.columns]
    added = ", ".join(f"`{c}` double" for c in [*names, out]) + ", _turns double"
    schema = StructType([*indexed.schema.fields, *StructType.fromDDL(added).fields])
    staged = spread.withColumn("_own", F.col("_blk") == home)
    wanted = staged.select("_blk", "_own", *[q(c) for c in given],
                           *[q(c).cast("double").alias(f"_x{i}") for i, c in enumerate(cols)])

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("idx")
        x = np.column_stack([group.column(f"_x{i}").to_numpy() for i in range(len(cols))]).astype(float)
        first = group.column("idx")[0].as_py()
        sums, turns = covering_sums(x, first, n, size, stride, step_errors)
        own = group.column("_own").to_numpy()
        kept, mine = group.filter(group.column("_own")).select(given), x[own]
        for name in names:
            kept = kept.append_column(name, pa.array(np.asarray(row_scores[name](mine), float)))
        with np.errstate(invalid="ignore", divide="ignore"):
            mean = sums[own] / turns[own]
        kept = kept.append_column(out, pa.array(mean, mask=turns[own] == 0))
        return kept.append_column("_turns", pa.array(turns[own]))

    scored = wanted.groupBy("_blk").applyInArrow(run, schema)
    if _covers_all(n, size, stride):
        return scored.drop("_turns")
    path = scratch_path(indexed.sparkSession, "range-scores")  # the scores are read for their mean and again
    scored.write.parquet(path)
    scored = indexed.sparkSession.read.schema(schema).parquet(path)
    mean = scored.agg(F.avg(F.when(F.col("_turns") > 0, q(out)))).first()[0]
    return scored.withColumn(out, F.when(F.col("_turns") > 0, q(out)).otherwise(F.lit(mean))).drop("_turns")


def window_error_to_rows(errors: DataFrame, indexed: DataFrame, size: int, stride: int,
                         error: str = "error", out: str = "score") -> DataFrame:
    """Mean whole-window error over the windows covering a row; uncovered rows get 0."""
    at_start = errors.select((F.col("window_id") * max(1, stride)).alias("idx"), q(error).alias("_e"))
    placed = indexed.join(at_start, "idx", "left")
    framed = halo_frame(placed, {"_a": F.avg("_e")}, size - 1, 0)
    return framed.withColumn(out, F.coalesce(F.col("_a"), F.lit(0.0))).drop("_e", "_a")


def window_attack_share(indexed: DataFrame, n: int, size: int, stride: int, y: str = "y") -> DataFrame:
    """Share of attack rows per window."""
    stride = max(1, stride)
    if n < size:
        return indexed.agg(F.lit(0).cast("long").alias("window_id"), F.avg(q(y)).alias("attack_share"))
    framed = halo_frame(indexed.select("idx", q(y).alias("_y")), {"attack_share": F.avg("_y")}, 0, size - 1)
    return framed.filter((F.col("idx") % stride == 0) & (F.col("idx") <= _last_start(n, size))).select(
        F.floor(F.col("idx") / stride).cast("long").alias("window_id"), "attack_share")


def window_label(indexed: DataFrame, n: int, size: int, stride: int, y: str = "y",
                 min_frac: float = 0.0) -> DataFrame:
    shares = window_attack_share(indexed, n, size, stride, y)
    return shares.select("window_id", (F.col("attack_share") > min_frac).cast("int").alias("label"))


def truncate_windows(windows: DataFrame, steps: int) -> DataFrame:
    """The first ``steps`` rows of every window."""
    return windows.withColumn("steps", F.slice("steps", 1, steps))

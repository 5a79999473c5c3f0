"""Exact, linearly interpolated percentiles that never gather a column in one task."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowwatch.functions.exprs import q
from flowwatch.operators import order

_ACCURACY = 10_000
# Values that the exact aggregate holds; a wider bracket is narrowed first.
HELD_VALUES = 4_000_000
# The exact aggregate copies the counts of its values for each percentile, in one task: the most values it may copy.
HELD_WORK = 20_000_000
# More percentiles than this are read from one sorted copy; each bracketed one costs every row a comparison.
MANY_PERCENTILES = 20


def exact_percentiles(df: DataFrame, cols: Sequence[str] | Mapping[str, Column],
                      probs: Sequence[float], n_rows: int | None = None) -> dict[str, list[float | None]]:
    """Percentiles of each column over its non-NULL rows, as driver values.

    Small inputs use Spark's exact aggregate. Larger ones bracket each wanted
    rank with a bounded sketch and count inside the bracket, again and again,
    until the bracket is small enough to rank: a few column-pruned scans and no
    shuffle of the data.
    """
    exprs = dict(cols) if isinstance(cols, Mapping) else {c: q(c) for c in cols}
    names = list(exprs)
    if not names:
        return {}
    data = df.select(*[exprs[c].cast("double").alias(f"v{i}") for i, c in enumerate(names)])
    limit = max(1, HELD_VALUES // len(names))
    rows = data.count() if n_rows is None else n_rows
    if rows <= limit and (len(probs) <= MANY_PERCENTILES or rows * len(probs) <= HELD_WORK):
        row = data.agg(*[
            F.percentile(F.col(f"v{i}"), F.array(*[F.lit(float(p)) for p in probs])).alias(f"v{i}")
            for i in range(len(names))
        ]).first()
        return {c: list(row[f"v{i}"] or [None] * len(probs)) for i, c in enumerate(names)}
    if len(names) > 1 or len(probs) > MANY_PERCENTILES:
        return _bracketed(data, names, probs, limit)
    data.persist()  # a score is computed once, however many scans follow
    try:
        return _bracketed(data, names, probs, limit)
    finally:
        data.unpersist()


def _sorted_ranks(data: DataFrame, names: Sequence[str], sizes: Sequence[int], probs: Sequence[float]) -> dict:
    """Values at the ranks beside each percentile, from rows numbered in global order: the work does not grow with the
    number of percentiles."""
    found = {}
    for i, n in enumerate(sizes):
        ranks = sorted({int(r) for p in probs if n for r in (math.floor(p * (n - 1)), math.ceil(p * (n - 1)))})
        if ranks:
            column = data.select(f"v{i}").filter(F.col(f"v{i}").isNotNull())
            placed, _ = order.dense_index(column, f"v{i}", f"v{i}")
            wanted = data.sparkSession.createDataFrame([(r,) for r in ranks], "idx long")
            for row in placed.join(F.broadcast(wanted), "idx").collect():
                found[(i, row["idx"])] = row[f"v{i}"]
    return found


def _bracketed(data: DataFrame, names: Sequence[str], probs: Sequence[float], limit: int):
    counts = data.agg(*[F.count(f"v{i}").alias(f"v{i}") for i in range(len(names))]).first()
    sizes = [counts[f"v{i}"] for i in range(len(names))]
    if len(probs) > MANY_PERCENTILES:
        return _interpolated(names, probs, sizes, _sorted_ranks(data, names, sizes, probs))
    # One search per (column, rank): lo/hi bracket values, rows below, rows inside.
    open_, found = {}, {}
    for i, n in enumerate(sizes):
        for p in probs:
            if n:
                spot = p * (n - 1)
                for r in {math.floor(spot), math.ceil(spot)}:
                    open_[(i, r)] = (-math.inf, math.inf, 0, n)
    inside = lambda i, lo, hi: (F.col(f"v{i}") >= lo) & (F.col(f"v{i}") <= hi)
    while True:
        wide = {k: b for k, b in open_.items() if b[3] > limit and b[0] < b[1]}
        if not wide:
            break
        # Ranks that share a bracket of a column share one sketch.
        shared: dict[tuple, list] = {}
        for (i, r), (lo, hi, below, m) in wide.items():
            at, slack = (r - below + 0.5) / m, 3.0 / _ACCURACY
            shared.setdefault((i, lo, hi), []).append((r, max(0.0, at - slack), min(1.0, at + slack)))
        sketch = [
            F.percentile_approx(
                F.when(inside(i, lo, hi), F.col(f"v{i}")), [p for _, a, b in want for p in (a, b)], _ACCURACY
            ).alias(f"s{g}") for g, ((i, lo, hi), want) in enumerate(shared.items())]
        row = data.agg(*sketch).first()
        guess = {f"s{i}_{r}": (row[f"s{g}"][2 * k], row[f"s{g}"][2 * k + 1])
                 for g, ((i, _, _), want) in enumerate(shared.items()) for k, (r, _, _) in enumerate(want)}
        checks = []
        for i, r in wide:
            lo, hi = guess[f"s{i}_{r}"]
            checks.append(F.count(F.when(F.col(f"v{i}") < lo, 1)).alias(f"b{i}_{r}"))
            checks.append(F.count(F.when(inside(i, lo, hi), 1)).alias(f"m{i}_{r}"))
        seen = data.agg(*checks).first()
        for (i, r), old in wide.items():
            lo, hi = guess[f"s{i}_{r}"]
            below, m = seen[f"b{i}_{r}"], seen[f"m{i}_{r}"]
            if not below <= r < below + m:
                # The sketch missed: keep the side of the old bracket that holds the rank.
                if r < below:
                    lo, hi, below, m = old[0], math.nextafter(lo, -math.inf), old[2], below - old[2]
                else:
                    lo, hi = math.nextafter(hi, math.inf), old[1]
                    below, m = below + m, old[2] + old[3] - below - m
            elif (lo, hi) == (old[0], old[1]):
                # No progress: split the bracket by value.
                hi = lo + (hi - lo) / 2
                cut = data.agg(F.count(F.when(inside(i, lo, hi), 1))).first()[0]
                if r >= below + cut:
                    lo, hi, below, m = math.nextafter(hi, math.inf), old[1], below + cut, m - cut
                else:
                    m = cut
            open_[(i, r)] = (lo, hi, below, m)
    for k, (lo, hi, _, _) in open_.items():
        if lo == hi:
            found[k] = lo
    rest = {k: b for k, b in open_.items() if k not in found}
    if rest:
        hits = F.array(*[
            F.when(inside(i, lo, hi), F.struct(
                F.lit(i).alias("i"), F.lit(r).cast("long").alias("r"),
                F.lit(below).cast("long").alias("below"), F.col(f"v{i}").alias("v")))
            for (i, r), (lo, hi, below, _) in rest.items()
        ])
        merged = (
            data.select(F.explode(F.filter(hits, lambda h: h.isNotNull())).alias("h")).select("h.*")
            .groupBy("i", "r", "below", "v").count()
        )
        run = Window.partitionBy("i", "r").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
        picked = merged.withColumn("upto", F.col("below") + F.sum("count").over(run)).filter(
            (F.col("upto") > F.col("r")) & (F.col("upto") - F.col("count") <= F.col("r")))
        for row in order.small_rows(picked):
            found[(row["i"], row["r"])] = row["v"]
    return _interpolated(names, probs, sizes, found)


def _interpolated(names: Sequence[str], probs: Sequence[float], sizes: Sequence[int], found: Mapping) -> dict[str, list[float | None]]:
    out: dict[str, list[float | None]] = {}
    for i, c in enumerate(names):
        values: list[float | None] = []
        for p in probs:
            if not sizes[i]:
                values.append(None)
                continue
            spot = p * (sizes[i] - 1)
            a, b = found[(i, math.floor(spot))], found[(i, math.ceil(spot))]
            values.append(a + (b - a) * (spot - math.floor(spot)))
        out[c] = values
    return out


def medians(df: DataFrame, cols: Sequence[str]) -> dict[str, float | None]:
    return {c: v[0] for c, v in exact_percentiles(df, cols, [0.5]).items()}


def grouped_percentiles(df: DataFrame, by: Sequence[str], value: str, probs: Sequence[float],
                        out: str = "q") -> DataFrame:
    """One row per group with ``q0..qk``; groups of any size, ranked by prefix sums."""
    by = list(by)
    rows = df.filter(q(value).isNotNull())
    ranked = order.prefix_sums(rows, value, {"n": F.count(F.lit(1))}, by)
    picks = []
    for i, p in enumerate(probs):
        spot = F.lit(float(p)) * (F.col("all_n") - 1)
        for side, rank in (("lo", F.floor(spot)), ("hi", F.ceil(spot))):
            hit = (F.col("cum_n") > rank) & (F.col("cum_n") - F.col("n") <= rank)
            picks.append(F.max(F.when(hit, q(value))).alias(f"_{side}{i}"))
    row = ranked.groupBy(*by).agg(F.max("all_n").alias("_all"), *picks)
    cols = []
    for i, p in enumerate(probs):
        spot = F.lit(float(p)) * (F.col("_all") - 1)
        a, b = F.col(f"_lo{i}"), F.col(f"_hi{i}")
        cols.append((a + (b - a) * (spot - F.floor(spot))).alias(f"{out}{i}"))
    return row.select(*by, *cols)

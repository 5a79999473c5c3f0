"""Distribution statistics: KS, mutual information, PCA, distances, densities."""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowwatch.functions.exprs import finite, q, ratio
from flowwatch.operators.metrics import count_if
from flowwatch.operators.moments import Pca, array_pca, moments
from flowwatch.operators.order import small_rows
from flowwatch.operators.profile import feature_rows
from flowwatch.operators.quantile import exact_percentiles, grouped_percentiles


def long_form(df: DataFrame, cols: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """``(keep..., feature, value)`` with finite values only; a narrow expansion."""
    entries = F.array(*[F.struct(F.lit(c).alias("feature"), finite(q(c).cast("double")).alias("value"))
                        for c in cols])
    return df.select(*[q(k) for k in keep], F.inline(entries)).filter(F.col("value").isNotNull())


def kolmogorov_p(d: Column, n: Column, m: Column) -> Column:
    """Asymptotic two-sided p-value of a two-sample KS distance."""
    e = n * m / (n + m)
    lam = (F.sqrt(e) + 0.12 + 0.11 / F.sqrt(e)) * d
    terms = F.transform(F.sequence(F.lit(1), F.lit(100)), lambda k: F.when(k % 2 == 1, 1.0).otherwise(-1.0)
                        * F.exp(-2.0 * k * k * lam * lam))
    total = F.aggregate(terms, F.lit(0.0), lambda acc, x: acc + x)
    # Below 0.3 the law is 1 to five digits while the series converges too slowly.
    return F.when(lam < 0.3, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 2.0 * total)))


def _gap_ranges(by: Sequence[str]):
    """For sorted rows of one task, per group: its first value, its whole change of the gap between both distributions, and
    the least and greatest change after any of its values."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list | None = None  # key, first value, n_a, n_b, a so far, b so far, low, high

        def closed() -> pa.RecordBatch:
            key, first, n_a, n_b, a, b, low, high = held
            row = [*key, first, n_a, n_b, a / n_a - b / n_b, low, high]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], names)
        for part in batches:
            if not len(part):
                continue
            keys = [part.column(i) for i in range(len(by))]
            kinds = [k.type for k in keys] + [pa.float64(), pa.int64(), pa.int64(), *[pa.float64()] * 3]
            names = [*by, "first", "n_a", "n_b", "gap", "low", "high"]
            new = np.zeros(len(part), bool)
            for k in keys:
                code = k.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
                new[1:] |= code[1:] != code[:-1]
            value, a, b, n_a, n_b = (part.column(len(by) + i).to_numpy(zero_copy_only=False) for i in range(5))
            starts = [0, *np.flatnonzero(new).tolist(), len(part)]
            for i, j in zip(starts, starts[1:]):
                key = [k[i].as_py() for k in keys]
                if held is None or held[0] != key:
                    if held is not None:
                        yield closed()
                    held = [key, float(value[i]), int(n_a[i]), int(n_b[i]), 0, 0, np.inf, -np.inf]
                more_a, more_b = held[4] + a[i:j].cumsum(), held[5] + b[i:j].cumsum()
                gap = more_a / held[2] - more_b / held[3]
                held[4:] = int(more_a[-1]), int(more_b[-1]), min(held[6], float(gap.min())), max(held[7], float(gap.max()))
        if held is not None:
            yield closed()
    return run


def ks_two_sample(df: DataFrame, value: str, group: Column, by: Sequence[str] = (), least: int = 10) -> DataFrame:
    """KS distance and p-value of ``value`` between rows with and without ``group``.

    Rows are merged per distinct value (map-side) and sorted once, in ranges over all tasks; a task passes on one row per group
    with the extremes of its running gap, and only these rows are scanned in sequence.
    """
    by = list(by)
    rows = df.select(*[q(b) for b in by], finite(q(value).cast("double")).alias("value"), group.alias("_g")).filter("value IS NOT NULL")
    sides = {"a": count_if(F.col("_g")), "b": count_if(~F.col("_g"))}
    sizes = rows.groupBy(*by).agg(sides["a"].alias("n_a"), sides["b"].alias("n_b")).filter(
        (F.col("n_a") > least) & (F.col("n_b") > least)).select(*[q(b).alias(f"_by{i}") for i, b in enumerate(by)], "n_a", "n_b")
    same = [q(b).eqNullSafe(F.col(f"_by{i}")) for i, b in enumerate(by)]
    merged = rows.groupBy(*by, "value").agg(*[c.alias(s) for s, c in sides.items()])
    merged = (merged.join(sizes, same) if by else merged.crossJoin(F.broadcast(sizes))).select(*[q(b) for b in by], "value", "a", "b", "n_a", "n_b")
    keys = [q(b) for b in by] + [F.col("value")]
    kept = "".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}, " for f in merged.schema.fields[:len(by)])
    ranges = merged.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(
        _gap_ranges(by), kept + "first double, n_a long, n_b long, gap double, low double, high double")
    before = Window.partitionBy(*(by or [F.lit(0)])).orderBy("first").rowsBetween(Window.unboundedPreceding, -1)  # a row per task
    start = F.coalesce(F.sum("gap").over(before), F.lit(0.0))
    ends = ranges.select(*[q(b) for b in by], "n_a", "n_b", F.greatest(F.abs(start + F.col("low")), F.abs(start + F.col("high"))).alias("gap"))
    out = ends.groupBy(*by).agg(F.max("gap").alias("ks"), F.max("n_a").alias("n_a"), F.max("n_b").alias("n_b")).filter("n_a IS NOT NULL")
    return out.withColumn("p_value", kolmogorov_p(F.col("ks"), F.col("n_a").cast("double"), F.col("n_b").cast("double")))


def ks_by_feature(df: DataFrame, cols: Sequence[str], group: Column) -> DataFrame:
    flagged = df.withColumn("_flag", group)
    return ks_two_sample(long_form(flagged, cols, ["_flag"]), "value", F.col("_flag"), ["feature"])


def ks_keep_features(df: DataFrame, engineered: Sequence[str], parents: Mapping[str, Sequence[str]],
                     is_benign: Column, threshold: float = 0.10) -> DataFrame:
    """KS of each engineered feature against its best parent; ``keep`` above the threshold."""
    names = list(engineered)
    sources = sorted({p for f in names for p in parents.get(f, ()) if p in df.columns})
    spark = df.sparkSession
    found = ks_by_feature(df, names + [s for s in sources if s not in names], is_benign).select("feature", "ks")
    ks = spark.createDataFrame(small_rows(found), found.schema)  # a row per feature, read twice
    pairs = [(f, p) for f in names for p in parents.get(f, ()) if p in df.columns]
    links = spark.createDataFrame(pairs, "feature string, parent string")
    best = links.join(ks.select(F.col("feature").alias("parent"), F.col("ks").alias("pk")), "parent").groupBy(
        "feature").agg(F.max("pk").alias("parent_ks"))
    return ks.filter(F.col("feature").isin(names)).select("feature", "ks").join(best, "feature", "left").select(
        "feature", "ks", "parent_ks",
        F.coalesce(F.col("ks") > F.col("parent_ks"), F.lit(True)).alias("better"),
        (F.col("ks") > threshold).alias("keep"))


def mutual_information(df: DataFrame, cols: Sequence[str], y: str, bins: int = 10) -> DataFrame:
    """Plug-in mutual information of quantile-binned features with the label, in nats."""
    edges = exact_percentiles(df, cols, [i / bins for i in range(1, bins)])
    entries = []
    for c in cols:
        cuts = sorted({e for e in edges[c] if e is not None})
        number = sum((F.when(q(c) > e, 1).otherwise(0) for e in cuts), F.lit(0))
        entries.append(F.struct(F.lit(c).alias("feature"), F.when(q(c).isNotNull(), number).alias("bin")))
    cells = df.select(q(y).alias("y"), F.inline(F.array(*entries))).filter(F.col("bin").isNotNull()).groupBy(
        "feature", "bin", "y").agg(F.count(F.lit(1)).cast("double").alias("n"))
    over = lambda *by: F.sum("n").over(Window.partitionBy(*by))  # cells: features x bins x classes
    joint = cells.select("feature", "n", over("feature").alias("t"), over("feature", "bin").alias("nb"),
                         over("feature", "y").alias("ny"))
    part = F.col("n") / F.col("t") * F.log(F.col("n") * F.col("t") / (F.col("nb") * F.col("ny")))
    return joint.groupBy("feature").agg(F.sum(part).alias("mi"))


# --- PCA and distances --------------------------------------------------------------


def assemble(df: DataFrame, cols: Sequence[str], out: str = "v", keep: Sequence[str] = ()) -> DataFrame:
    staged = df.select(*[q(k) for k in keep], *[q(c).cast("double").alias(f"_c{i}") for i, c in enumerate(cols)])
    names = [f"_c{i}" for i in range(len(cols))]
    return VectorAssembler(inputCols=names, outputCol=out).transform(staged.dropna(subset=names)).drop(*names)


def fit_pca(benign: DataFrame, cols: Sequence[str], k: int | None = None) -> Pca:
    complete = benign.select(*[q(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)]).dropna()
    packed = complete.select(F.array(*[F.col(f"c{i}") for i in range(len(cols))]).alias("x"))
    return array_pca(packed, "x", k or len(cols))


def pca_explained_variance(benign: DataFrame, cols: Sequence[str],
                           shares: Sequence[float] = (0.90, 0.95, 0.99)) -> DataFrame:
    """Explained and cumulative share per component, and the first k reaching each share."""
    ratios = fit_pca(benign, cols).shares
    cumulative = np.cumsum(ratios)
    rows = []
    for i, (a, b) in enumerate(zip(ratios, cumulative)):
        reached = [s for s in shares if b >= s - 1e-12 and (i == 0 or cumulative[i - 1] < s - 1e-12)]
        rows.append((i + 1, float(a), float(b), [float(s) for s in reached]))
    return benign.sparkSession.createDataFrame(
        rows, "component int, share double, cumulative double, reaches array<double>")


def pca_project(df: DataFrame, model: Pca, cols: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Centred projection as plain column arithmetic; incomplete rows are left out."""
    rows = df.select(*[q(k) for k in keep], *[q(c).cast("double").alias(f"_c{i}") for i, c in enumerate(cols)]).dropna(
        subset=[f"_c{i}" for i in range(len(cols))])
    out = []
    for k in range(model.parts.shape[1]):
        total = F.lit(0.0)
        for i in range(len(cols)):
            total = total + (F.col(f"_c{i}") - float(model.mean[i])) * float(model.parts[i, k])
        out.append(total.alias(f"pc{k + 1}"))
    return rows.select(*[q(c) for c in keep], *out)


def pca_loadings(df: DataFrame, model: Pca, cols: Sequence[str], component: int = 1, top: int = 5) -> DataFrame:
    loads = model.parts[:, component - 1]
    rows = [(c, float(v), abs(float(v))) for c, v in zip(cols, loads)]
    return df.sparkSession.createDataFrame(rows, "feature string, loading double, abs_loading double").orderBy(
        F.desc("abs_loading"), "feature").limit(top)


def quadratic_form(cols: Sequence[str], centre: np.ndarray, inverse: np.ndarray) -> Column:
    """``(x - c)' A (x - c)`` as one expression."""
    dev = [q(c) - float(m) for c, m in zip(cols, centre)]
    total: Column = F.lit(0.0)
    for i in range(len(cols)):
        total = total + dev[i] * dev[i] * float(inverse[i, i])
        for j in range(i + 1, len(cols)):
            total = total + dev[i] * dev[j] * float(2.0 * inverse[i, j])
    return total


def mahalanobis_distance(df: DataFrame, benign: DataFrame, cols: Sequence[str], out: str = "score",
                         fitted: tuple[np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """Adds the distance from the benign centre under the benign covariance."""
    if fitted is None:
        _, centre, sigma = moments(benign, cols)
        fitted = (centre, sigma)
    form = quadratic_form(cols, fitted[0], np.linalg.pinv(fitted[1]))
    return df.withColumn(out, F.sqrt(F.greatest(form, F.lit(0.0))))


def cut_rates(scored: DataFrame, score: str, y: str, p: float = 0.95) -> DataFrame:
    """Benign percentile as threshold, detection rate and false-positive rate."""
    cut = exact_percentiles(scored.filter(q(y) == 0), [score], [p])[score][0]
    hit = F.when(q(score) > cut, 1.0).otherwise(0.0)
    return scored.agg(
        F.lit(cut).alias("threshold"), F.avg(F.when(q(y) == 1, hit)).alias("detection_rate"),
        F.avg(F.when(q(y) == 0, hit)).alias("fp_rate"))


def robust_covariance(benign: DataFrame, cols: Sequence[str], support: float = 0.9, max_steps: int = 20,
                      tol: float = 1e-8) -> tuple[np.ndarray, np.ndarray]:
    """Centre and covariance of the least scattered share of rows, by concentration steps.

    Each step is a distance expression, one exact percentile and one filtered
    aggregate. Only moments stay between steps, so lineage does not grow. A
    singular step falls back to the plain covariance.
    """
    data = benign.select(*[q(c).cast("double").alias(c) for c in cols]).dropna()
    _, centre, sigma = moments(data, cols)
    plain = (centre, sigma)
    last = math.inf
    for _ in range(max_steps):
        sign, logdet = np.linalg.slogdet(sigma)
        if sign <= 0 or not math.isfinite(logdet):
            return plain
        if last - logdet < tol:
            break
        last = logdet
        dist = data.withColumn("_d", quadratic_form(cols, centre, np.linalg.inv(sigma)))
        cut = exact_percentiles(dist, ["_d"], [support])["_d"][0]
        _, centre, sigma = moments(dist.filter(F.col("_d") <= cut), cols)
    return centre, sigma


# --- densities ------------------------------------------------------------------------


def score_histogram(df: DataFrame, score: str, group: str, bins: int = 80) -> DataFrame:
    """Density histogram per class over the common range."""
    edge = df.agg(F.min(q(score)).alias("lo"), F.max(q(score)).alias("hi")).first()
    lo, hi = edge["lo"], edge["hi"]
    if lo is None:
        return df.sparkSession.createDataFrame([], "cls string, bin int, left double, n long, density double")
    width = (hi - lo) / bins or 1.0
    bin_ = F.least(F.floor((q(score) - lo) / width), F.lit(bins - 1)).cast("int")
    cells = df.filter(q(score).isNotNull()).groupBy(q(group).alias("cls"), bin_.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"))
    whole = F.sum("n").over(Window.partitionBy("cls"))  # at most ``bins`` rows per class
    return cells.select("cls", "bin", (F.lit(lo) + F.col("bin") * width).alias("left"), "n",
                        (F.col("n") / (whole * F.lit(width))).alias("density"))


#: A cell of the density is half a bandwidth wide; with so many powers about its centre a kernel is off by less than 1e-15.
_CELL, _POWERS = 0.5, 16
#: Bandwidths beyond which a kernel is below the last bit of its peak's double.
_REACH = 9.0


def kde_on_grid(df: DataFrame, value: str, is_benign: Column, points: int = 400) -> DataFrame:
    """Gaussian density of both classes on a common grid, and their overlap.

    Rows are merged, before the shuffle, to sums of powers of their distance to the centre of a cell of half a bandwidth;
    a kernel is its Taylor series about that centre. So a row costs a few products however many points the grid has, and
    the driver gets the sums of the cells that the grid reaches, whose number grows with the fifth root of the rows.
    """
    rows = df.select(finite(q(value).cast("double")).alias("v"), is_benign.alias("b")).filter(F.col("v").isNotNull())
    stats = {r["b"]: r for r in rows.groupBy("b").agg(
        F.count(F.lit(1)).alias("n"), F.stddev_samp("v").alias("sd")).collect()}
    if True not in stats or False not in stats:
        raise ValueError("both classes are needed")
    sides = {"yes": F.when(F.col("b"), F.col("v")), "no": F.when(~F.col("b"), F.col("v"))}
    ends = exact_percentiles(rows, sides, [0.01, 0.99], stats[True]["n"] + stats[False]["n"])
    lo, hi = min(e[0] for e in ends.values()), max(e[1] for e in ends.values())
    grid = np.linspace(lo, hi, points)
    width = {b: (3.0 * r["n"] / 4.0) ** -0.2 * (r["sd"] or 1.0) for b, r in stats.items()}
    own = F.when(F.col("b"), F.lit(width[True])).otherwise(F.lit(width[False]))
    place = (F.col("v") - F.lit(lo)) / own
    near = rows.select("b", place.alias("x")).filter(
        (place >= -_REACH) & (place <= F.lit(hi - lo) / own + _REACH)).withColumn("cell", F.floor(F.col("x") / _CELL))
    near = near.withColumn("u", F.col("x") - (F.col("cell") + 0.5) * _CELL)
    powers, power = [], F.lit(1.0)
    for k in range(_POWERS):
        powers.append(F.sum(power).alias(f"p{k}"))
        power = power * F.col("u")
    density = {b: np.zeros(points) for b in stats}
    for r in near.groupBy("b", "cell").agg(*powers).collect():
        t = (grid - lo) / width[r["b"]] - (r["cell"] + 0.5) * _CELL
        before, now, term = np.zeros(points), np.ones(points), np.zeros(points)
        for k in range(_POWERS):  # Hermite polynomials by their recurrence, over k!
            term += now * (r[f"p{k}"] / math.factorial(k))
            before, now = now, t * now - k * before
        density[r["b"]] += np.exp(-0.5 * t * t) * term
    norm = {b: stats[b]["n"] * width[b] * math.sqrt(2.0 * math.pi) for b in stats}
    step = (grid[-1] - grid[0]) / (points - 1)
    found = [(i, float(lo + i * step), float(density[True][i] / norm[True]), float(density[False][i] / norm[False])) for i in range(points)]
    return df.sparkSession.createDataFrame(found, "point int, x double, benign double, attack double").withColumn(
        "overlap", F.least("benign", "attack"))


def five_number_by_label(df: DataFrame, cols: Sequence[str], label: str, logged: Sequence[str] = ()) -> DataFrame:
    """Minimum, quartiles and maximum of each feature per label."""
    shown = df.select(q(label).alias("label"), *[
        F.log1p(F.greatest(q(c), F.lit(0.0))).alias(c) if c in logged else q(c) for c in cols])
    out = grouped_percentiles(long_form(shown, cols, ["label"]), ["label", "feature"], "value",
                              [0.0, 0.25, 0.5, 0.75, 1.0])
    return out.toDF("label", "feature", "low", "q1", "median", "q3", "high")


def missed_vs_benign_means(df: DataFrame, cols: Sequence[str], y: str = "y", pred: str = "pred") -> DataFrame:
    missed, right = (q(y) == 1) & (q(pred) == 0), (q(y) == 0) & (q(pred) == 0)
    aggs = []
    for i, c in enumerate(cols):
        aggs += [F.avg(F.when(missed, q(c))).alias(f"{i}_missed"), F.avg(F.when(right, q(c))).alias(f"{i}_benign")]
    return feature_rows(df.agg(*aggs), cols, ["missed", "benign"]).withColumn(
        "difference", F.col("missed") - F.col("benign"))

"""Explanation and robustness of any scorer.

A scorer is ``scorer(df, out) -> df`` that adds a score column, such as
``Detector.score``. What-if scores are computed beside the original row, so no row
is copied or joined back. A detector that scores a matrix gets all variants of an
Arrow batch in one call; for any other scorer a column is replaced, scored and restored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping, Sequence
from hashlib import md5

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from flowwatch.functions.exprs import q
from flowwatch.operators.metrics import mixed_ranking, ranking_metrics
from flowwatch.operators.order import hash_positions
from flowwatch.operators.quantile import medians
from flowwatch.session import scratch_path

Scorer = Callable[[DataFrame, str], DataFrame]


def score_changed(df: DataFrame, scorer: Scorer, changes: Mapping[str, Column], out: str) -> DataFrame:
    """Adds the score the row would have with some columns replaced."""
    kept = df.select("*", *[q(c).alias(f"_kept_{i}") for i, c in enumerate(changes)])
    moved = kept.select(*[changes[c].alias(c) if c in changes else q(c) for c in kept.columns])
    scored = scorer(moved, out)
    held = {c: f"_kept_{i}" for i, c in enumerate(changes)}
    return scored.select(*[q(held[c]).alias(c) if c in held else q(c)
                           for c in scored.columns if not c.startswith("_kept_")])


def matrix_scorer(scorer: Scorer) -> tuple[list[str], Callable[[np.ndarray], np.ndarray]] | None:
    """Columns and matrix function of a scorer that is the ``score`` of a detector with one."""
    owner = getattr(scorer, "__self__", None)
    if getattr(scorer, "__name__", "") != "score" or not hasattr(owner, "scorer"):
        return None
    return list(owner.cols), owner.scorer()


def score_variants(df: DataFrame, scorer: Scorer, variants: Sequence[Mapping[str, Column]], out: str,
                   where: Column | None = None) -> DataFrame:
    """Adds an array: the score of the row under each variant, which replaces some columns.

    Of a matrix scorer, rows outside ``where`` are not scored and get null. One batch holds the given columns, the
    replaced ones and one copy of the matrix, whatever the number of variants.
    """
    known = matrix_scorer(scorer)
    if known is None:
        staged, names = df, []
        for i, changes in enumerate(variants):
            names.append(f"{out}_{i}")
            staged = score_changed(staged, scorer, changes, names[-1]) if changes else scorer(staged, names[-1])
        return staged.select(*[q(c) for c in df.columns], F.array(*[q(c).cast("double") for c in names]).alias(out))
    cols, score = known
    places = [[(cols.index(c), at) for c, at in changed] for changed in _numbered(variants, cols)]
    given = [q(c) for c in cols] + [changes[c] for changes in variants for c in changes if c in cols]
    wanted = F.lit(True) if where is None else F.coalesce(where, F.lit(False))

    @F.pandas_udf("array<double>")
    def run(mask: pd.Series, *values: pd.Series) -> pd.Series:
        keep = mask.to_numpy(dtype=bool)
        held = [s.to_numpy(dtype=float)[keep] for s in values]
        matrix = np.column_stack(held[:len(cols)])
        scores = np.empty((keep.sum(), len(places)))
        for i, changed in enumerate(places if keep.any() else ()):
            for j, at in changed:
                matrix[:, j] = held[len(cols) + at]
            scores[:, i] = score(matrix.copy())
            for j, _ in changed:
                matrix[:, j] = held[j]
        found = np.full(len(mask), None, dtype=object)
        for at, row in zip(np.flatnonzero(keep), scores, strict=True):
            found[at] = row
        return pd.Series(found)

    return df.withColumn(out, run(wanted, *[c.cast("double") for c in given]))


def _numbered(variants: Sequence[Mapping[str, Column]], cols: Sequence[str]) -> list[list[tuple[str, int]]]:
    """The known columns that each variant replaces, numbered through all variants."""
    out, at = [], 0
    for changes in variants:
        names = [c for c in changes if c in cols]
        out.append([(c, at + k) for k, c in enumerate(names)])
        at += len(names)
    return out


def benign_reference(benign: DataFrame, cols: Sequence[str]) -> dict[str, float]:
    """Median of each processed feature over benign rows."""
    return medians(benign, cols)


def _with_contributions(df: DataFrame, cols: Sequence[str], scorer: Scorer, reference: Mapping[str, float],
                        where: Column | None = None) -> DataFrame:
    staged = score_variants(df, scorer, [{}, *[{c: F.lit(float(reference[c]))} for c in cols]], "_scores", where)
    change = lambda i: F.col("_scores")[0] - F.col("_scores")[i + 1]
    parts = F.array(*[
        F.struct((-F.abs(change(i))).alias("rank_key"), F.lit(i).alias("pos"), F.lit(c).alias("feature"), change(i).alias("contribution"))
        for i, c in enumerate(cols)])
    return staged.select(*[q(c) for c in df.columns], F.array_sort(parts).alias("_parts"))


def counterfactual_attribution(df: DataFrame, cols: Sequence[str], scorer: Scorer,
                               reference: Mapping[str, float], row_id: str = "row_id") -> DataFrame:
    """``(row_id, rank, feature, contribution)``, strongest first; ties keep column order."""
    parts = _with_contributions(df.select(row_id, *[q(c) for c in cols]), cols, scorer, reference)
    return parts.select(row_id, F.posexplode("_parts").alias("_i", "_p")).select(
        row_id, (F.col("_i") + 1).alias("rank"), F.col("_p.feature").alias("feature"),
        F.col("_p.contribution").alias("contribution"))


def explain_flagged(df: DataFrame, cols: Sequence[str], scorer: Scorer, reference: Mapping[str, float],
                    pred: str = "pred", top_k: int = 3) -> DataFrame:
    """All rows; each flagged one carries its ``top_k`` contributions.

    The what-if scores are computed for flagged rows only and stay in their row, so neither a join nor a row id
    is needed, and no flagged row is left out.
    """
    shown, blank = [], []
    for k in range(1, min(top_k, len(cols)) + 1):
        names = f"explain_top{k}_feature", f"explain_top{k}_contrib"
        shown += [F.col("_parts")[k - 1]["feature"].alias(names[0]), F.col("_parts")[k - 1]["contribution"].alias(names[1])]
        blank += [F.lit(None).cast("string").alias(names[0]), F.lit(None).cast("double").alias(names[1])]
    own, flagged = [q(c) for c in df.columns], F.coalesce(q(pred) == 1, F.lit(False))
    if matrix_scorer(scorer):  # other rows pass through the same call unscored, so the input is read once
        parts = _with_contributions(df, cols, scorer, reference, flagged)
        parts = parts.withColumn("_parts", F.when(flagged, F.col("_parts")))
        return parts.select(*own, *shown)
    parts = _with_contributions(df.filter(flagged), cols, scorer, reference)
    return parts.select(*own, *shown).unionByName(df.filter(~flagged).select(*own, *blank))


def permutation_importance(df: DataFrame, cols: Sequence[str], scorer: Scorer, y: str = "y",
                           row_id: str = "row_id", n_repeats: int = 5, seed: int = 42) -> DataFrame:
    """Mean drop of average precision when one column is permuted.

    A permutation pairs rows of equal rank under two hash orders, by an equi-join. All permutations are joined to the rows
    at once, and the scores of all changed columns are written once and ranked together.
    """
    base_df = df.select(row_id, q(y).alias("_y"), *[q(c) for c in cols])
    base = ranking_metrics(scorer(base_df, "_s"), "_s", "_y").first()["pr_auc"]
    staged = hash_positions(base_df, row_id, seed, {"_y": F.col("_y"), **{c: q(c) for c in cols}})
    changes = []
    for r in range(n_repeats):
        names = [f"_perm_{r}_{i}" for i in range(len(cols))]
        other = hash_positions(base_df, row_id, f"{seed}/{r + 1}", {name: q(c) for name, c in zip(names, cols)})
        staged = staged.join(other, "rank")
        changes += [{c: q(name)} for name, c in zip(names, cols)]
    scored = score_variants(staged, scorer, changes, "_scores")
    mixes = [f"_s{m}" for m in range(len(changes))]
    path = scratch_path(df.sparkSession, "permuted-scores")
    scored.select("_y", *[F.col("_scores")[m].alias(name) for m, name in enumerate(mixes)]).write.parquet(path)
    ranked = mixed_ranking(df.sparkSession.read.parquet(path), {name: F.col(name) for name in mixes}, "_y")
    feature = F.element_at(F.array(*[F.lit(c) for c in cols]), (F.col("m") % len(cols) + 1).cast("int"))
    return ranked.groupBy(feature.alias("feature")).agg((F.lit(base) - F.avg("pr_auc")).alias("importance")).orderBy(
        F.desc("importance"), "feature")


def mimicry_evasion(attacks: DataFrame, cols: Sequence[str], scorer: Scorer, reference: Mapping[str, float],
                    threshold: float, alphas: Sequence[float] = (0.0, 0.25, 0.5, 0.75, 1.0)) -> DataFrame:
    """Attack rows moved towards the benign reference: mean score and share still detected."""
    staged = attacks.select(*[q(c).cast("double").alias(c) for c in cols])
    moved = [{c: q(c) + F.lit(float(a)) * (F.lit(float(reference[c])) - q(c)) for c in cols} for a in alphas]
    staged = score_variants(staged, scorer, moved, "_scores")
    aggs = []
    for i in range(len(alphas)):
        s = F.col("_scores")[i]
        aggs += [F.avg(s).alias(f"m{i}"), F.avg(F.when(s >= threshold, 1.0).otherwise(0.0)).alias(f"r{i}")]
    entries = [F.struct(F.lit(float(a)).alias("alpha"), F.col(f"m{i}").alias("mean_score"),
                        F.col(f"r{i}").alias("detection_rate")) for i, a in enumerate(alphas)]
    return staged.agg(*aggs).select(F.inline(F.array(*entries)))


def _uniform(digest: Column, start: int) -> Column:
    """A number in (0, 1) from 13 hex digits, hence exact in a double."""
    digits = F.conv(F.substring(digest, start, 13), 16, 10).cast("double")
    return (digits + 0.5) / float(16 ** 13)


def normal_noise(key: Column) -> Column:
    """Standard normal value of a text key (Box-Muller on its digest)."""
    digest = F.md5(key)
    radius = F.sqrt(-2.0 * F.log(_uniform(digest, 1)))
    return radius * F.cos(2.0 * math.pi * _uniform(digest, 14))


def _digest_uniforms(digests: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Two numbers in (0, 1) of each 16-byte digest, from its first and next 13 hex digits, hence exact in a double."""
    words = np.frombuffer(digests, ">u8").reshape(-1, 2).astype(np.uint64)
    high, low = words[:, 0], words[:, 1]
    first = high >> np.uint64(12)
    second = ((high & np.uint64(0xFFF)) << np.uint64(40)) | (low >> np.uint64(24))
    return tuple((x.astype(float) + 0.5) / float(16 ** 13) for x in (first, second))


def with_normal_noise(df: DataFrame, row_id: str, prefixes: Sequence[str], out: str) -> DataFrame:
    """Adds an array: of each prefix, the standard normal value of the text key ``prefix + row id`` (Box-Muller on its MD5
    digest); null for a null id. Every digest is made once, an Arrow batch at a time."""
    heads, given = [p.encode() for p in prefixes], df.columns
    staged = df.withColumn("_id_text", q(row_id).cast("string"))
    schema = StructType([*df.schema.fields, StructField(out, ArrayType(DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("_id_text")
            ids = [b"" if t is None else t.encode() for t in texts.to_pylist()]
            values = np.empty((len(ids), len(heads)))
            for k, head in enumerate(heads):
                u, v = _digest_uniforms(b"".join([md5(head + i).digest() for i in ids]))
                values[:, k] = np.sqrt(-2.0 * np.log(u)) * np.cos(2.0 * math.pi * v)
            offsets = pa.array(np.arange(len(ids) + 1) * len(heads), pa.int32())
            noise = pa.ListArray.from_arrays(offsets, pa.array(values.ravel()), mask=texts.is_null() if texts.null_count else None)
            kept = [batch.column(c) for c in given]
            yield pa.RecordBatch.from_arrays([*kept, noise], [*given, out])
    return staged.mapInArrow(run, schema)


def noise_fpr(benign: DataFrame, cols: Sequence[str], scorer: Scorer, threshold: float,
              sigmas: Sequence[float] = (0.05, 0.1, 0.25, 0.5, 1.0), n_repeats: int = 3, seed: int = 42,
              row_id: str = "row_id") -> DataFrame:
    """False-positive rate of benign rows under Gaussian noise, over repeats."""
    stats = benign.agg(*[F.stddev_pop(q(c)).alias(f"s{i}") for i, c in enumerate(cols)]).first()
    dev = {c: float(stats[f"s{i}"] or 0.0) or 1.0 for i, c in enumerate(cols)}
    variants, names, prefixes = [{}], ["clean"], []
    for i, sigma in enumerate(sigmas):
        for r in range(n_repeats):
            at = len(prefixes)
            prefixes += [f"{seed}:{i}:{r}:{c}:" for c in cols]
            variants.append({c: q(c) + F.lit(float(sigma) * dev[c]) * F.col("_noise")[at + j] for j, c in enumerate(cols)})
            names.append(f"_n{i}_{r}")
    rows = with_normal_noise(benign.select(row_id, *[q(c).cast("double").alias(c) for c in cols]), row_id, prefixes, "_noise")
    staged = score_variants(rows, scorer, variants, "_scores")
    rate = lambda k: F.avg(F.when(F.col("_scores")[k] >= threshold, 1.0).otherwise(0.0))
    row = staged.agg(*[rate(k).alias(n) for k, n in enumerate(names)])
    entries = []
    for i, sigma in enumerate(sigmas):
        reps = [F.col(f"_n{i}_{r}") for r in range(n_repeats)]
        mean = sum(reps[1:], reps[0]) / float(n_repeats)
        var = sum(((x - mean) * (x - mean) for x in reps), F.lit(0.0)) / float(n_repeats)
        entries.append(F.struct(F.lit(float(sigma)).alias("sigma"), mean.alias("fpr_mean"),
                                F.sqrt(var).alias("fpr_std"), F.col("clean").alias("fpr_clean")))
    return row.select(F.inline(F.array(*entries)))


def robustness_report(benign: DataFrame, attacks: DataFrame, cols: Sequence[str],
                      scorers: Mapping[str, tuple[Scorer, float]], row_id: str = "row_id",
                      seed: int = 42) -> dict[str, DataFrame]:
    """Both experiments for every scorer, over all benign rows and all attacks."""
    reference = benign_reference(benign, cols)
    out: dict[str, DataFrame] = {}
    for name, (scorer, threshold) in scorers.items():
        found = {"mimicry": mimicry_evasion(attacks, cols, scorer, reference, threshold),
                 "noise": noise_fpr(benign, cols, scorer, threshold, seed=seed, row_id=row_id)}
        for kind, table in found.items():
            named = table.select(F.lit(name).alias("model"), "*")
            out[kind] = named if kind not in out else out[kind].unionByName(named)
    return out

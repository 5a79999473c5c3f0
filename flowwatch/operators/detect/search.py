"""Grid search and scoring with external models."""

from __future__ import annotations

import itertools
import time
from collections.abc import Callable, Iterator, Mapping, Sequence
from multiprocessing.pool import ThreadPool

import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowwatch.functions.exprs import q
from flowwatch.operators.detect.base import Detector
from flowwatch.operators.metrics import ranking_metrics, with_rates


def grid_search(make: Callable[..., Detector], grid: Mapping[str, Sequence], train: DataFrame, test: DataFrame,
                cols: Sequence[str], y: str = "y", parallel: int = 4) -> DataFrame:
    """Fit and evaluate every parameter combination on cached inputs; best F1 first.

    Combinations that differ in the detector's ``cut_param`` only share one fit and one scoring of the test rows, whose
    seconds each of them reports. ``parallel`` fits are submitted at a time.
    """
    names, spark = list(grid), train.sparkSession
    train, test = train.persist(), test.persist()
    try:
        families: dict[tuple, list[tuple]] = {}
        for values in itertools.product(*grid.values()):
            cut = make(**dict(zip(names, values))).cut_param
            families.setdefault(tuple(v for n, v in zip(names, values) if n != cut), []).append(values)

        def evaluated(family: list[tuple]) -> list[tuple]:
            started = time.perf_counter()
            models, scored, own = _fitted_family(make, names, family, train, test, cols)
            scored = scored.select(y, "score").persist()  # counted and ranked
            fitted = time.perf_counter()
            try:
                found = _family_metrics(models, scored, own, y)
            finally:
                scored.unpersist()
            seconds = fitted - started, time.perf_counter() - fitted
            return [(*[str(v) for v in values], *m, *seconds) for values, m in zip(family, found, strict=True)]

        with ThreadPool(min(parallel, len(families))) as pool:
            rows = list(itertools.chain(*pool.map(inheritable_thread_target(spark)(evaluated), families.values(), chunksize=1)))
    finally:
        train.unpersist()
        test.unpersist()
    schema = ", ".join(f"{n} string" for n in names) + (
        ", precision double, recall double, f1 double, roc_auc double, fit_seconds double, score_seconds double")
    return spark.createDataFrame(rows, schema).orderBy(F.desc("f1"), *names)


def _fitted_family(make, names: Sequence[str], family: Sequence[tuple], train: DataFrame, test: DataFrame, cols: Sequence[str]):
    """The models of combinations that differ in the cut only, the scored test rows, and each model's score of a row."""
    model = make(**dict(zip(names, family[0])))
    if model.cut_param not in names:
        model = model.fit(train, cols)
        return [model], model.score(test), [F.col("_raw")]
    at = names.index(model.cut_param)
    models = model.fit_cuts(train, cols, [values[at] for values in family])
    return models, models[0].raw_score(test), [m.from_raw(F.col("_raw")) for m in models]


def _family_metrics(models: Sequence[Detector], scored: DataFrame, own: Sequence[Column], y: str) -> list[tuple]:
    """(precision, recall, f1, roc_auc) of each model. A moved cut leaves the ranking as it is, so the rows are ranked once."""
    flagged, flags = scored.withColumnRenamed("score", "_raw"), [f"_p{i}" for i in range(len(models))]
    for model, score, flag in zip(models, own, flags, strict=True):
        flagged = model.predict(flagged.withColumn("score", score), flag)
    cells = flagged.groupBy(q(y).alias("_y"), *flags).count().collect()
    counts = [(i, *[sum(c["count"] for c in cells if (c["_y"], c[flag]) == cell) for cell in ((0, 0), (0, 1), (1, 0), (1, 1))])
              for i, flag in enumerate(flags)]
    rates = with_rates(scored.sparkSession.createDataFrame(counts, "i int, tn long, fp long, fn long, tp long")).orderBy("i").collect()
    auc = ranking_metrics(scored, "score", y).first()["roc_auc"]
    return [(m["precision"], m["recall"], m["f1"], auc) for m in rates]


def external_model_score(df: DataFrame, cols: Sequence[str], make_predict_fn: Callable, batch_size: int = 512,
                         out: str = "score") -> DataFrame:
    """Batched prediction of a model that ``make_predict_fn`` loads once per worker."""
    run = predict_batch_udf(make_predict_fn, return_type=T.DoubleType(), batch_size=batch_size,
                            input_tensor_shapes=[[len(cols)]])
    return df.withColumn(out, run(F.array(*[q(c).cast("double") for c in cols])))


def score_in_chunks(windows: DataFrame, scorer: Callable[[pd.DataFrame], pd.Series], chunk: int = 400,
                    key: str = "window_id") -> DataFrame:
    """Scores windows in fixed-size chunks of each Arrow stream; the whole set is never in memory."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for start in range(0, len(pdf), chunk):
                part = pdf.iloc[start:start + chunk]
                yield pd.DataFrame({key: part[key].to_numpy(), "score": scorer(part).to_numpy(dtype=float)})

    return windows.mapInPandas(run, f"{key} long, score double")

"""Helpers shared by the text operators: written tables, checked broadcasts, blocks of texts in tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowwatch.session import scratch_path, ship_package

#: Rows of a side that may be broadcast; each such side has rows of at most some 30 bytes.
BROADCAST_ROWS = 2_000_000

#: Bytes of text handled together by the array code; a longer text is a block of its own.
BLOCK_CHARS = 400_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: Bytes of an Arrow batch, so that 10,000 long texts do not meet in one batch in the memory of JVM and Python.
BATCH_BYTES = 4 << 20


def prepared(spark: SparkSession) -> SparkSession:
    """Ships the package to the Python workers and bounds Arrow batches; each operator that runs Python calls it."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: the rows as a table in the shared folder (``spark.checkpoint.dir``)."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written_in_buckets(df: DataFrame, key: str, name: str) -> DataFrame:
    """The rows as a table in the shared folder whose files are dealt by ``key``: what groups or joins them by the key
    reads them in place, without a shuffle of the rows."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    table = path.rsplit("/", 1)[-1].replace("-", "_")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.option("compression", "zstd").option("path", path).bucketBy(parts, key).saveAsTable(table)
    return spark.table(table)


def small_side(df: DataFrame, rows: int) -> DataFrame:
    """A broadcast hint for a narrow side of known row count, beyond the limit a shuffled join."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def id_and_text(df: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    """Just the columns that an operator reads; other columns cannot clash with its own."""
    return df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"),
                     F.col(f"`{text_col}`").cast("string").alias("text"),
                     *(F.col(f"`{c}`") for c in more))


def blocks(batches: Iterable[pa.RecordBatch], column: str = "text",
           chars: int = BLOCK_CHARS) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of the batches of about ``chars`` bytes of text, with their texts; null is empty."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        first = size = 0
        for i, n in enumerate([*sizes.tolist(), None]):
            if n is None or (size and size + n > chars):
                if i > first:
                    part = batch.slice(first, i - first)
                    yield part, [t or "" for t in part.column(column).to_pylist()]
                first, size = i, 0
            size += (n or 0) + 1


def map_blocks(df: DataFrame, fn: Callable[[pa.RecordBatch, list[str]], dict], schema: str,
               text_col: str = "text") -> DataFrame:
    """``fn(slice, texts)`` gives the columns of the result, in the order of the schema."""
    def run(batches):
        for part, texts in blocks(batches, text_col):
            yield pa.RecordBatch.from_pydict(fn(part, texts))
    return df.mapInArrow(run, schema)

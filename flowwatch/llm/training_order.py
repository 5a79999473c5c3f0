"""Training-order materialisation: fixed-length token sequences in a keyed permutation, in shards of fixed stride.

Tasks concatenate the ids of their documents, each with an end id, and cut them into sequences of ``length`` tokens (the
last of a task is filled up with the end id). They are written once, numbered by task and place, so the sequence numbers
0, 1, ... follow from the tasks' counts without a shuffle. A keyed Feistel permutation of the numbers, with cycle-walking
down to their exact count, gives every sequence its slot. Slots are range-partitioned, and each shard of
``shard_sequences`` slots is one row with one binary of fixed stride: sequence ``i`` of a shard is at byte ``i * stride``.
A reader goes through the shards in order and resumes at any slot by number alone.

Defined results: a null or empty text has only the end id; null doc_ids and repeated rows are kept; an empty table
gives no shards; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowwatch.llm.common import blocks, id_and_text, prepared, written
from flowwatch.llm.shingles import mixed
from flowwatch.llm.wordbpe import word_bpe
from flowwatch.session import scratch_path

DOCS = pa.list_(pa.struct([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int32())]))
DOCS_SQL = "array<struct<doc_id:long,start:long,length:int>>"


def token_type(vocabulary_size: int) -> np.dtype:
    """Little-endian, two bytes where they hold every id."""
    return np.dtype("<u2" if vocabulary_size <= 1 << 16 else "<u4")


def feistel(index: np.ndarray, n: int, key: int, rounds: int = 6) -> np.ndarray:
    """A permutation of 0 .. n-1: a balanced Feistel network over the next even power of two, walked until inside."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    bits, mask = np.uint64(half), np.uint64((1 << half) - 1)
    keys = mixed(np.arange(1, rounds + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key & (1 << 64) - 1))
    out = index.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        x = out[todo]
        left, right = x >> bits, x & mask
        for k in keys:
            left, right = right, left ^ (mixed(right ^ k) & mask)
        out[todo] = left << bits | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def cut_sequences(docs: DataFrame, vocabulary: str, length: int, end_id: int) -> DataFrame:
    """task, place, n_tokens, ids (fixed stride), docs (which stretch of which document lies where)."""
    def run(batches):
        encoder = word_bpe(vocabulary)
        kind = token_type(encoder.whole.get_vocab_size())
        task, place = TaskContext.get().partitionId(), 0
        held, parts, stretches = 0, [], []

        def batch(rows: list) -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), DOCS)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)],
                                              ["task", "place", "n_tokens", "ids", "docs"])
        for part, texts in blocks(batches):
            rows = []
            for doc_id, ids in zip(part.column("doc_id").to_pylist(), encoder.encode(texts), strict=True):
                whole, at = np.append(ids, end_id).astype(kind), 0
                while at < len(whole):
                    take = min(length - held, len(whole) - at)
                    parts.append(whole[at:at + take])
                    stretches.append({"doc_id": doc_id, "start": at, "length": take})
                    held, at = held + take, at + take
                    if held == length:
                        rows.append((task, place, length, np.concatenate(parts).tobytes(), stretches))
                        held, parts, stretches, place = 0, [], [], place + 1
            if rows:
                yield batch(rows)
        if held:
            fill = np.full(length - held, end_id, kind)
            yield batch([(task, place, held, np.concatenate([*parts, fill]).tobytes(), stretches)])
    return docs.mapInArrow(run, f"task long, place long, n_tokens int, ids binary, docs {DOCS_SQL}")


def materialise(df: DataFrame, vocabulary: str, path: str | None = None, id_col: str = "doc_id", text_col: str = "text",
                length: int = 2048, end_id: int = 1, key: int = 7, shard_sequences: int = 256) -> str:
    """Writes the shards (shard, first_slot, last_slot, sequences, stride, payload, n_tokens, docs); returns their path."""
    spark = prepared(df.sparkSession)
    cut = written(cut_sequences(id_and_text(df, id_col, text_col), vocabulary, length, end_id), "token-sequences")
    counts = sorted((r["task"], r["count"]) for r in cut.groupBy("task").count().collect())  # a row an input split
    n = sum(c for _, c in counts)
    tasks = np.array([t for t, _ in counts], np.int64)
    first = np.cumsum([0, *(c for _, c in counts)])[:-1]
    shared = spark.sparkContext.broadcast((tasks, first))

    def slots(batches):
        tasks, first = shared.value
        for batch in batches:
            task, place = (batch.column(c).to_numpy() for c in ("task", "place"))
            slot = feistel(first[np.searchsorted(tasks, task)] + place, n, key)
            yield pa.RecordBatch.from_arrays([pa.array(slot // shard_sequences), pa.array(slot),
                                              *(batch.column(c) for c in ("n_tokens", "ids", "docs"))],
                                             ["shard", "slot", "n_tokens", "ids", "docs"])

    def shards(batches):
        def row(shard: int, got: list) -> pa.RecordBatch:
            ids = b"".join(x["ids"] for x in got)
            return pa.RecordBatch.from_pydict({
                "shard": pa.array([shard], pa.int64()), "first_slot": pa.array([got[0]["slot"]], pa.int64()),
                "last_slot": pa.array([got[-1]["slot"]], pa.int64()),
                "sequences": pa.array([len(got)], pa.int32()), "stride": pa.array([len(ids) // len(got)], pa.int32()),
                "payload": pa.array([ids], pa.binary()), "n_tokens": pa.array([[x["n_tokens"] for x in got]], pa.list_(pa.int32())),
                "docs": pa.array([[x["docs"] for x in got]], pa.list_(DOCS))})
        shard, got = None, []
        for batch in batches:
            for x in batch.to_pylist():
                if x["shard"] != shard:
                    if got:
                        yield row(shard, got)
                    shard, got = x["shard"], []
                got.append(x)
        if got:
            yield row(shard, got)
    path = path or scratch_path(spark, "training-order")
    n_shards = -(-n // shard_sequences)
    width = min(max(n_shards, 1), int(spark.conf.get("spark.sql.shuffle.partitions")))
    (cut.mapInArrow(slots, f"shard long, slot long, n_tokens int, ids binary, docs {DOCS_SQL}")
     .repartitionByRange(width, "shard").sortWithinPartitions("shard", "slot")
     .mapInArrow(shards, "shard long, first_slot long, last_slot long, sequences int, stride int, payload binary, n_tokens array<int>, "
                         f"docs array<{DOCS_SQL}>")
     .write.option("compression", "zstd").parquet(path))
    return path


def read_sequences(spark: SparkSession, path: str, from_slot: int = 0) -> DataFrame:
    """slot, shard, place, n_tokens, ids, docs, from a slot on. The files' statistics of ``last_slot`` let the scan leave out
    files and row groups of earlier shards."""
    place = F.col("place")
    return (spark.read.parquet(path).filter(F.col("last_slot") >= from_slot)
            .withColumn("place", F.explode(F.sequence(F.lit(0), F.col("sequences") - 1)))
            .select((F.col("first_slot") + place).alias("slot"), "shard", "place",
                    F.get("n_tokens", place).alias("n_tokens"),
                    F.substring("payload", place * F.col("stride") + 1, F.col("stride")).alias("ids"),
                    F.get("docs", place).alias("docs"))
            .filter(F.col("slot") >= from_slot))

"""Best-fit-decreasing packing of token sequences, planned on the lengths alone.

Pieces of equal length are interchangeable, so the plan needs only how many pieces each length has: at most
``capacity`` numbers, whatever the corpus. A segment tree over the remaining capacities finds the tightest
open bin for a length in logarithmic time; all the pieces that best fit would put alike are placed in one step.
The plan is a list of runs (length, ranks from-to, first bin, pieces a bin, offset); each piece then finds
its place from its rank among the pieces of its length, which counts per bucket and a window inside each bucket
give without gathering a length in one task.

Defined results: a null or empty text has only the end token; repeated rows and repeated doc_ids are packed
each; a null doc_id passes through; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flowwatch.llm.common import blocks, id_and_text, prepared, written
from flowwatch.llm.wordbpe import word_bpe

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Pieces that a window inside one (length, bucket) sorts, about.
BUCKET_ROWS = 500_000


class CapacityTree:
    """Which remaining capacities have an open bin; the least one that is large enough in O(log capacity)."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.any = bytearray(2 * self.leaves)

    def put(self, remaining: int, there: bool) -> None:
        i = self.leaves + remaining
        self.any[i] = there
        while i > 1:
            i //= 2
            self.any[i] = self.any[2 * i] | self.any[2 * i + 1]

    def tightest(self, length: int) -> int | None:
        """The least remaining capacity >= length that has a bin."""
        i = self.leaves + length
        if self.any[i]:
            return length
        while i > 1:
            if i % 2 == 0 and self.any[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if self.any[2 * i] else 2 * i + 1
                return i - self.leaves
            i //= 2
        return None


def best_fit_plan(lengths: Iterable[tuple[int, int]], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, lo, hi, first bin, pieces a bin, offset of the first piece) for ``(length, count)`` pairs.

    The same bins fill as if best fit took the pieces one by one, longest first: the tightest bin stays the
    tightest until it is full for this length, so a bin takes ``remaining // length`` pieces in a row.
    """
    tree, open_bins, bins, runs = CapacityTree(capacity), {}, 0, []

    def add(remaining: int, first: int, count: int) -> None:
        held = open_bins.setdefault(remaining, deque())
        if held and held[-1][0] + held[-1][1] == first:
            held[-1] = (held[-1][0], held[-1][1] + count)
        else:
            held.append((first, count))
        tree.put(remaining, True)

    for length, count in sorted(lengths, reverse=True):
        done = 0
        while done < count:
            remaining = tree.tightest(length)
            if remaining is None:
                remaining = capacity
                each = capacity // length
                first, free = bins, -(-(count - done) // each)
                bins += free
            else:
                each = remaining // length
                held = open_bins[remaining]
                first, free = held.popleft()
                if not held:
                    tree.put(remaining, False)
            full = min(free, (count - done) // each)
            if full:
                runs.append((length, done, done + full * each, first, each, capacity - remaining))
                done += full * each
                add(remaining - each * length, first, full)
            rest = count - done if full < free else 0
            if rest:
                runs.append((length, done, count, first + full, each, capacity - remaining))
                done = count
                add(remaining - rest * length, first + full, 1)
                full += 1
            if full < free:
                open_bins.setdefault(remaining, deque()).appendleft((first + full, free - full))
                tree.put(remaining, True)
    return runs


def token_pieces(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text",
                 capacity: int = 4096, end_id: int = 1, keep_ids: bool = False) -> DataFrame:
    """Each document's ids and the end id, cut into pieces of at most ``capacity`` tokens."""
    def run(batches):
        encoder = word_bpe(vocabulary)
        for part, texts in blocks(batches):
            out: list[list] = [[], [], [], [], [], []]
            for doc_id, ids in zip(part.column("doc_id").to_pylist(), encoder.encode(texts), strict=True):
                whole = np.append(ids, end_id).astype("<u4")
                for piece, start in enumerate(range(0, len(whole), capacity)):
                    ids_of = whole[start:start + capacity].tobytes()
                    for column, value in zip(out, (doc_id, piece, start, len(ids_of) // 4, zlib.crc32(ids_of), ids_of),
                                             strict=True):
                        column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            names = ("doc_id", "piece", "start", "length", "ids_crc32", "ids")
            take = 6 if keep_ids else 5
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out[:take], kinds[:take], strict=True)],
                                             list(names[:take]))
    return id_and_text(df, id_col, text_col).mapInArrow(run, PIECES + (", ids binary" if keep_ids else ""))


def ranked(pieces: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Adds ``rank``: 0, 1, ... among the pieces of a length."""
    sizes = pieces.agg(F.count("*").alias("n")).first()["n"]
    n_buckets = -(-max(sizes, 1) // bucket_rows)
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(n_buckets)))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (dealt.groupBy("length", "bucket").count()
               .select("length", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first_rank")))
    within = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    return (dealt.withColumn("within", F.row_number().over(within)).join(offsets, ["length", "bucket"])
            .withColumn("rank", F.col("first_rank") + F.col("within") - 1).drop("bucket", "within", "first_rank"))


def place(pieces: DataFrame, capacity: int = 4096, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Adds sequence_id and offset to pieces that have a ``length`` of 1 to ``capacity``."""
    spark = prepared(pieces.sparkSession)
    counts = [(r["length"], r["count"]) for r in pieces.groupBy("length").count().collect()]  # capacity rows at most
    runs = np.array(best_fit_plan(counts, capacity), np.int64).reshape(-1, 6)
    runs = runs[np.lexsort((runs[:, 1], runs[:, 0]))]
    plan = spark.sparkContext.broadcast((runs[:, 0] * (1 << 48) + runs[:, 1], runs))

    def run(batches):
        keys, table = plan.value
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            row = table[np.searchsorted(keys, length * (1 << 48) + rank, "right") - 1]
            turn, nth = np.divmod(rank - row[:, 1], row[:, 4])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(batch.num_columns) if batch.schema.names[i] != "rank"),
                 pa.array(row[:, 3] + turn), pa.array(row[:, 5] + nth * length)],
                [*(n for n in batch.schema.names if n != "rank"), "sequence_id", "offset"])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return ranked(pieces, bucket_rows).select(*pieces.columns, "rank").mapInArrow(
        run, schema + ", sequence_id long, offset long")


def pack(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096,
         end_id: int = 1, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids), sequence_id, offset."""
    prepared(df.sparkSession)
    pieces = written(token_pieces(df, vocabulary, id_col, text_col, capacity, end_id, keep_ids), "token-pieces")
    return place(pieces, capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves (from ``pack(keep_ids=True)``): sequence_id, length, ids (little-endian uint32)."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return (packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), parts.alias("parts"))
            .select("sequence_id", "length",
                    F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["ids"])).alias("ids")))

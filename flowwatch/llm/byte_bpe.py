"""Byte-level BPE by a global shuffle of distinct words, and decoding by the token-byte table.

1. Each task splits its texts into pre-tokens and numbers the distinct ones of a block. It writes the
   documents as positions (the numbers in text order, compressed) and the words dealt by hash to word buckets, in a
   table of the shared folder.
2. The words are shuffled by bucket. A bucket's task sees all occurrences of its words in all blocks, encodes each
   distinct word once and sends the ids back under the numbers of each block.
3. Documents and ids meet by block, and the ids are put together by position.

A word takes one entry a block, not one a use, so frequent words stay small, and a block is bounded by its characters.
Defined results: a null or empty text has no ids; null doc_ids and repeated rows each give their row; an empty
table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from flowwatch.llm.common import blocks, id_and_text, prepared, written
from flowwatch.llm.pretokens import byte_level_spans

PARTS = "block long, bucket int, docs array<long>, body binary"
#: Characters and distinct words of a block; a longer document is a block of its own.
BLOCK_CHARS, BLOCK_WORDS = 32_000_000, 500_000
#: Words of a block with one-byte codes.
SHORT = 240


def read_ranks(path: str) -> bytes:
    """The rank file's bytes; the driver reads it once and ships it."""
    with open(path, "rb") as f:
        return f.read()


def _planes(*arrays: np.ndarray) -> bytes:
    """Arrays of small numbers, byte plane by byte plane, compressed."""
    raw = []
    for a in arrays:
        width = next(w for w in (1, 2, 3, 4) if w == 4 or not len(a) or int(a.max()) < 1 << 8 * w)
        raw += [np.int64(len(a)).tobytes(), np.int64(width).tobytes()]
        raw += [(a >> 8 * k if k else a).astype(np.uint8).tobytes() for k in range(width)]
    return zstandard.ZstdCompressor(level=6).compress(b"".join(raw))


def _unplaned(body: bytes) -> list[np.ndarray]:
    raw, out, at = zstandard.ZstdDecompressor().decompress(body), [], 0
    while at < len(raw):
        n, width = np.frombuffer(raw, "<i8", 2, at).tolist()
        at += 16
        if width == 1:
            out.append(np.frombuffer(raw, np.uint8, n, at))
        else:
            wide = np.zeros(n, "<u4")
            for k in range(width):
                wide |= np.frombuffer(raw, np.uint8, n, at + k * n).astype("<u4") << np.uint32(8 * k)
            out.append(wide)
        at += width * n
    return out


class _Block:
    """The words and documents of one block of a task."""

    def __init__(self, number: int):
        self.number, self.chars, self.words = number, 0, {}
        self.docs, self.sizes, self.codes = [], [], []

    def add(self, doc_ids: list, texts: list[str]) -> None:
        spans = byte_level_spans(texts)
        codes, place = spans.distinct()
        slots, words = self.words, spans.words(place)
        numbers = np.fromiter((slots.setdefault(w, len(slots)) for w in words), np.int32, len(words))
        self.chars += len(spans.text)
        self.docs += doc_ids
        self.sizes.append(np.diff(spans.first))
        self.codes.append(numbers[codes])

    def rows(self, buckets: int) -> Iterator[tuple]:
        """The documents, then the words by bucket: their numbers (as steps), lengths and bytes."""
        yield self.number, -1, self.docs, _planes(np.concatenate(self.sizes), *packed_positions(np.concatenate(self.codes)))
        words = [w.encode() for w in self.words]
        bucket = np.fromiter((xxhash.xxh3_64_intdigest(w) % buckets for w in words), np.int64, len(words))
        order = np.argsort(bucket, kind="stable")
        cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1))
        for group in np.split(order, cuts[1:]) if len(order) else ():
            mine = [words[i] for i in group.tolist()]
            yield self.number, int(bucket[group[0]]), None, _planes(
                np.diff(group, prepend=0), np.fromiter(map(len, mine), np.int64, len(mine)),
                np.frombuffer(b"".join(mine), np.uint8))


def packed_positions(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word numbers in text order, which count up at each first use: heads (0: the next new word, then the most
    frequent words, then the rest), rests, and the frequent words' numbers."""
    if not len(codes):
        return codes, codes, codes
    n = int(codes.max()) + 1
    frequent = np.argsort(-np.bincount(codes, minlength=n), kind="stable")[:SHORT].astype(np.int32)
    short = np.zeros(n, np.uint8)
    short[frequent] = np.arange(1, len(frequent) + 1)
    head = short[codes]
    rest = np.flatnonzero(head == 0)
    head[rest] = SHORT + 1 + np.minimum(codes[rest] >> 16, 254 - SHORT)
    top = np.maximum.accumulate(codes)
    head[0] = 0
    head[1:][top[1:] > top[:-1]] = 0
    return head, codes[head > SHORT], frequent


def unpacked_positions(head: np.ndarray, rest: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    codes = np.cumsum(head == 0, dtype=np.int32)
    codes -= 1
    short = (head > 0) & (head <= SHORT)
    codes[short] = frequent.astype(np.int32)[head[short] - 1]
    codes[head > SHORT] = rest
    return codes


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.binary())
    columns = zip(*rows, strict=True) if rows else [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(columns, kinds, strict=True)],
                                      ["block", "bucket", "docs", "body"])


def split_words(docs: DataFrame, buckets: int, block_chars: int, block_words: int) -> DataFrame:
    """Rows of documents (bucket -1, body: positions) and of words (body: numbers, lengths, bytes), by block."""
    def run(batches):
        task, turn = TaskContext.get().partitionId(), 0
        block = _Block(task << 32)
        for part, texts in blocks(batches):
            block.add(part.column("doc_id").to_pylist(), texts)
            if block.chars > block_chars or len(block.words) > block_words:
                yield _batch(list(block.rows(buckets)))
                turn += 1
                block = _Block(task << 32 | turn)
        if block.docs:
            yield _batch(list(block.rows(buckets)))
    return docs.mapInArrow(run, PARTS)


class WordEncoder:
    """Encodes one pre-token as a whole: a known token by its rank, another by merges."""

    def __init__(self, ranks: bytes):
        import tiktoken

        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines()) if a}
        self.merge = tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=self.ranks,
                                       special_tokens={}).encode_ordinary

    def encode(self, word: bytes) -> list[int]:
        known = self.ranks.get(word)
        return self.merge(word.decode()) if known is None else [known]


@functools.lru_cache(maxsize=2)
def word_encoder(ranks: bytes) -> WordEncoder:
    return WordEncoder(ranks)


def encode_words(words: DataFrame, ranks: bytes, buckets: int) -> DataFrame:
    """Each distinct word of a bucket once; body: numbers, ids a word, ids."""
    def run(batches):
        encoder, known, bucket = word_encoder(ranks), {}, None
        for batch in batches:
            out = []
            for block, b, body in zip(*(batch.column(c).to_pylist() for c in ("block", "bucket", "body")), strict=True):
                if b != bucket:
                    bucket, known = b, {}
                steps, sizes, raw = _unplaned(body)
                joined, ends = raw.tobytes(), np.cumsum(sizes, dtype=np.int64).tolist()
                ids = []
                for a, e in zip([0, *ends], ends, strict=False):
                    word = joined[a:e]
                    got = known.get(word)
                    if got is None:
                        got = known[word] = encoder.encode(word)
                    ids.append(got)
                flat = np.fromiter((i for x in ids for i in x), np.int64)
                out.append((block, b, None, _planes(steps, np.fromiter(map(len, ids), np.int64, len(ids)), flat)))
            yield _batch(out)
    return words.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(run, PARTS)


def _assembled(group: pa.Table) -> pa.Table:
    """The documents of one block with their ids in text order."""
    bucket = group.column("bucket").to_numpy()
    bodies = group.column("body")
    numbers, sizes, pool = [], [], []
    for i in np.flatnonzero(bucket >= 0).tolist():
        steps, size, ids = _unplaned(bodies[i].as_py())
        numbers.append(np.cumsum(steps.astype(np.int64)))
        sizes.append(size)
        pool.append(ids)
    n = sum(map(len, numbers))
    number = np.concatenate([*numbers, np.empty(0, np.int64)])
    size = np.concatenate([*sizes, np.empty(0, np.int64)]).astype(np.int64)
    flat = np.concatenate([*pool, np.empty(0, "<u4")]).astype("<u4")
    at, length = np.zeros(n, np.int64), np.zeros(n, np.int32)
    at[number], length[number] = np.cumsum(size) - size, size
    del numbers, sizes, pool, number, size
    row = int(np.flatnonzero(bucket < 0)[0])
    words, *packed = _unplaned(bodies[row].as_py())
    codes, ends = unpacked_positions(*packed), np.cumsum(words.astype(np.int64))
    counts, ids_of = [], []
    for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True):
        mine = codes[a:b]
        own = length[mine]
        last = np.cumsum(own, dtype=np.int64)
        counts.append(int(last[-1]) if b > a else 0)
        ids_of.append(flat[np.repeat(at[mine] - (last - own), own) + np.arange(counts[-1])].tobytes())
    return pa.table({"doc_id": group.column("docs")[row].values, "n_tokens": pa.array(counts, pa.int64()),
                     "ids": pa.array(ids_of, pa.binary())})


class TokenBytes(NamedTuple):
    """The token-byte table as arrays; a vocabulary's size."""

    size: np.ndarray
    first: np.ndarray
    pool: np.ndarray

    @classmethod
    def of(cls, table: DataFrame) -> TokenBytes:
        rows = sorted((r["id"], bytes(r["bytes"])) for r in table.select("id", "bytes").collect())
        size = np.full(rows[-1][0] + 1 if rows else 0, -1, np.int64)
        size[[i for i, _ in rows]] = [len(b) for _, b in rows]
        first = np.cumsum(np.maximum(size, 0)) - np.maximum(size, 0)
        return cls(size, first, np.frombuffer(b"".join(b for _, b in rows), np.uint8))

    def join(self, ids: np.ndarray) -> bytes:
        """The bytes of the ids, one after another; an id without a row raises."""
        own = self.size[ids]
        if (own < 0).any():
            raise ValueError("an id is not in the token-byte table")
        ends = np.cumsum(own)
        total = int(ends[-1]) if len(ends) else 0
        return self.pool[np.repeat(self.first[ids] - (ends - own), own) + np.arange(total)].tobytes()


def encode(df: DataFrame, ranks: bytes, id_col: str = "doc_id", text_col: str = "text", table: DataFrame | None = None,
           block_chars: int = BLOCK_CHARS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit integers); with a token-byte table also ``decoded``, the
    ids decoded again by the worker that put them together."""
    spark = prepared(df.sparkSession)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = written(split_words(id_and_text(df, id_col, text_col), buckets, block_chars, block_words), "word-parts")
    ids = encode_words(parts.filter("bucket >= 0"), ranks, buckets)
    shared = spark.sparkContext.broadcast(TokenBytes.of(table)) if table is not None else None

    def assemble(group: pa.Table) -> pa.Table:
        out = _assembled(group)
        if shared is None:
            return out
        decoded = [shared.value.join(np.frombuffer(x.as_buffer(), "<u4")) for x in out.column("ids")]
        return out.append_column("decoded", pa.array(decoded, pa.binary()))
    return (parts.filter("bucket < 0").unionByName(ids).groupBy("block")
            .applyInArrow(assemble, "doc_id long, n_tokens long, ids binary" + (", decoded binary" if shared else "")))


def token_bytes(spark: SparkSession, ranks: bytes) -> DataFrame:
    """The token-byte table: id, bytes. As many rows as the vocabulary has."""
    rows = [(int(b), base64.b64decode(a)) for a, b in map(bytes.split, ranks.splitlines()) if a]
    return spark.createDataFrame(pa.table({"id": pa.array([r[0] for r in rows], pa.int64()),
                                           "bytes": pa.array([r[1] for r in rows], pa.binary())}))


def decode(df: DataFrame, table: DataFrame) -> DataFrame:
    """Adds ``decoded`` (binary) to rows with ``ids``: a map-side join with the token-byte table.

    The table is bounded by the vocabulary, so each executor holds it as arrays and each id takes its bytes by
    index; null ids decode to no bytes.
    """
    spark = prepared(df.sparkSession)
    shared = spark.sparkContext.broadcast(TokenBytes.of(table))

    def run(batches):
        for batch in batches:
            out = [shared.value.join(np.frombuffer(raw or b"", "<u4")) for raw in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())],
                                             [*batch.schema.names, "decoded"])
    return df.mapInArrow(run, StructType([*df.schema.fields, StructField("decoded", BinaryType())]))


def with_digests(coded: DataFrame) -> DataFrame:
    """doc_id, n_tokens and the SHA-256 of the ids and of the decoded bytes."""
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))

"""Token counts with overlap resynchronisation for huge documents.

Texts up to ``chunk_chars`` are encoded whole. A longer text is normalised once and cut into overlapping
chunks that are encoded apart, so that one text spreads over many tasks. Each chunk reports where its
pre-tokens begin inside its two overlaps, with the number of tokens before each. A place where the pre-tokens
of both neighbours begin is stable: the splitting of text reads from left to right and keeps no state between
pre-tokens, and tokens never cross them, so everything from that place on comes out alike in both. The counts
are spliced there. Where an overlap has no common boundary (one run longer than the overlap), the document
goes through again with a wider overlap, at last as one chunk.

Copies of a huge text are encoded once. Defined results: a null or empty text has 0 bytes and 0 tokens; a
null doc_id passes through; repeated rows each give their row; an empty table gives no rows; further columns
of the input are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flowwatch.llm.common import blocks, id_and_text, map_blocks, prepared, written
from flowwatch.llm.pretokens import word_end_spans
from flowwatch.llm.wordbpe import normal_form, word_bpe

CHUNKS = "key string, segment int, chunk int, body string, fixed int"
MARKS = ("key string, segment int, chunk int, n long, fixed int, "
         "head array<long>, head_n array<long>, tail array<long>, tail_n array<long>")


def chunk_texts(texts: DataFrame, vocabulary: str, chunk_chars: int, overlap: int) -> DataFrame:
    """Rows (key, text) to overlapping chunks of the normalised text, apart for each stretch between special strings."""
    def run(batches):
        encoder = word_bpe(vocabulary)
        special = re.compile("|".join(map(re.escape, encoder.special)) or r"(?!)")
        for part, got in blocks(batches):
            for key, text in zip(part.column("key").to_pylist(), got, strict=True):
                stretches = special.split(text)
                rows = []
                for i, stretch in enumerate(stretches):
                    body = normal_form(stretch)
                    step = chunk_chars - overlap
                    count = max(1, -(-(len(body) - overlap) // step))
                    rows += [(key, i, j, body[j * step:j * step + chunk_chars], 0) for j in range(count)]
                rows[0] = (*rows[0][:4], len(stretches) - 1)
                for at in range(0, len(rows), 256):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x, t) for x, t in zip(zip(*rows[at:at + 256], strict=True), (
                            pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int32()), strict=True)],
                        ["key", "segment", "chunk", "body", "fixed"])
    return texts.mapInArrow(run, CHUNKS)


def chunk_marks(chunks: DataFrame, vocabulary: str, chunk_chars: int, overlap: int) -> DataFrame:
    """Encode each chunk: its tokens, and its boundaries in both overlaps with the tokens before each."""
    step = chunk_chars - overlap

    def marks(part: pa.RecordBatch, bodies: list[str]) -> dict:
        encoder = word_bpe(vocabulary)
        spans = word_end_spans(bodies)
        codes = encoder.codes(spans)
        sums = np.r_[0, np.cumsum(encoder.length[codes])]
        numbers = part.column("chunk").to_pylist()
        out: dict[str, list] = {k: [] for k in ("n", "head", "head_n", "tail", "tail_n")}
        for i, (body, number) in enumerate(zip(bodies, numbers, strict=True)):
            a, b = spans.first[i], spans.first[i + 1]
            starts = spans.start[a:b] - spans.origin[i]
            before = sums[a:b] - sums[a]
            out["n"].append(int(sums[b] - sums[a]))
            # the end of a chunk is no boundary that the text vouches for, nor is its beginning; but for those of the text
            head = (starts > 0) & (starts < overlap)
            tail = (starts >= step) & (starts < len(body))
            out["head"].append(starts[head] + number * step)
            out["head_n"].append(before[head])
            out["tail"].append(starts[tail] + number * step)
            out["tail_n"].append(before[tail])
        lists = pa.list_(pa.int64())
        return {"key": part.column("key"), "segment": part.column("segment"), "chunk": part.column("chunk"),
                "n": pa.array(out["n"], pa.int64()), "fixed": part.column("fixed"),
                **{k: pa.array(out[k], lists) for k in ("head", "head_n", "tail", "tail_n")}}
    return map_blocks(chunks, marks, MARKS, "body")


def splice(marks: DataFrame) -> DataFrame:
    """One row a key: its tokens, or null where a pair of neighbours has no common boundary."""
    w = Window.partitionBy("key", "segment").orderBy("chunk")
    last = F.lead("chunk").over(w).isNull()
    joint = (marks.withColumn("next_head", F.lead("head").over(w)).withColumn("next_n", F.lead("head_n").over(w))
             .withColumn("last", last)
             .withColumn("at", F.array_min(F.array_intersect("tail", "next_head"))))
    kept = F.element_at("tail_n", F.array_position("tail", F.col("at")).cast("int"))
    skipped = F.element_at("next_n", F.array_position("next_head", F.col("at")).cast("int"))
    part = F.when(F.col("last"), F.col("n")).otherwise(kept - skipped)
    return (joint.select("key", part.alias("part"), "fixed").groupBy("key")
            .agg(F.sum("part").alias("parts"), F.count("part").alias("known"), F.count("*").alias("rows"),
                 F.sum("fixed").alias("fixed"))
            .select("key", F.when(F.col("known") == F.col("rows"), F.col("parts") + F.col("fixed")).alias("n_tokens")))


def count_huge(texts: DataFrame, vocabulary: str, chunk_chars: int, overlap: int) -> DataFrame:
    """Tokens of each (key, text); overlaps widen fourfold for the keys whose chunks could not be aligned."""
    done = None
    while True:
        chunks = chunk_texts(texts, vocabulary, chunk_chars, overlap).repartition("key", "segment", "chunk")
        counts = written(splice(chunk_marks(chunks, vocabulary, chunk_chars, overlap)), "token-splice")
        good = counts.filter(F.col("n_tokens").isNotNull())
        done = good if done is None else done.unionByName(good)
        open_keys = counts.filter(F.col("n_tokens").isNull()).select("key")
        if open_keys.isEmpty():
            return done
        texts = texts.join(open_keys, "key", "left_semi")
        overlap *= 4
        chunk_chars = max(chunk_chars, 4 * overlap)


def count_tokens(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048,
                 chunk_chars: int = 32_768, overlap: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit; ``vocabulary`` is the text of a tokenizers ``.json`` file."""
    prepared(df.sparkSession)
    if not 0 < overlap < chunk_chars:
        raise ValueError("the overlap must be shorter than the chunks")
    docs = id_and_text(df, id_col, text_col)
    huge = F.length("text") > chunk_chars
    slim = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
                       F.when(~huge, F.col("text")).alias("text"),
                       F.when(huge, F.sha2("text", 256)).alias("key"))

    def counts(part: pa.RecordBatch, got: list[str]) -> dict:
        n = word_bpe(vocabulary).counts(got)
        return {"doc_id": part.column("doc_id"), "n_bytes": part.column("n_bytes"), "key": part.column("key"),
                "whole": pa.array(n, pa.int64())}
    short = map_blocks(slim, counts, "doc_id long, n_bytes long, key string, whole long")
    texts = written(docs.filter(huge).select(F.sha2("text", 256).alias("key"), "text")
                    .groupBy("key").agg(F.first("text").alias("text")), "huge-texts")
    if texts.isEmpty():
        joined = short.withColumn("n_tokens", F.col("whole"))
    else:
        spliced = count_huge(texts, vocabulary, chunk_chars, overlap)
        rows = written(short, "token-counts")
        # only the rows of huge texts go through the join
        joined = rows.filter("key IS NULL").withColumn("n_tokens", F.col("whole")).unionByName(
            rows.filter("key IS NOT NULL").join(spliced, "key"))
    return joined.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))

"""Registered queries of the text operators, each over its whole table, and their SQL where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowwatch.llm import (
    byte_bpe,
    filter_audit,
    graph_ann,
    ngram_join,
    packing,
    perplexity,
    personal,
    secret_scan,
    string_kernel,
    token_alignment,
    token_counts,
    training_order,
    vector_dedup,
)
from flowwatch.llm.common import documents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def vocabulary(name: str) -> str:
    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        return f.read()


@query
def op1_byte_bpe(spark, sf_dir):
    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return byte_bpe.with_digests(byte_bpe.encode(documents(spark, sf_dir), ranks, table=byte_bpe.token_bytes(spark, ranks)))


@query
def op2_secret_scan(spark, sf_dir):
    return secret_scan.with_digest(secret_scan.find_secrets(documents(spark, sf_dir)))


@query
def op3_ngram_jaccard_join(spark, sf_dir):
    return ngram_join.ngram_components(documents(spark, sf_dir))


@query
def op4_perplexity_quality(spark, sf_dir):
    return perplexity.quality(documents(spark, sf_dir))


@query
def op5_personal_data(spark, sf_dir):
    return personal.with_digest(personal.find_personal(documents(spark, sf_dir)))


@query
def op6_learned_partitions(spark, sf_dir):
    return graph_ann.search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


@query
def op7_string_kernel_language(spark, sf_dir):
    return string_kernel.identify(documents(spark, sf_dir))


@query
def op8_best_fit_packing(spark, sf_dir):
    return packing.pack(documents(spark, sf_dir), vocabulary("word_bpe_49k.json"))


@query
def op9_training_order(spark, sf_dir):
    path = training_order.materialise(documents(spark, sf_dir), vocabulary("word_bpe_49k.json"))
    return training_order.read_sequences(spark, path).select(
        "slot", "shard", "place", "n_tokens", F.crc32("ids").alias("ids_crc32"), F.size("docs").alias("n_documents"),
        F.col("docs")[0]["doc_id"].alias("first_doc_id"))


@query
def op10_token_counts(spark, sf_dir):
    return token_counts.count_tokens(documents(spark, sf_dir), vocabulary("word_bpe_49k.json"))


@query
def op11_token_alignment(spark, sf_dir):
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        return token_alignment.align_documents(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"), f.read())


@query
def op12_filter_audit(spark, sf_dir):
    return filter_audit.audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


ORACLES["op12_filter_audit"] = filter_audit.oracle()


@query
def op13_vector_dedup(spark, sf_dir):
    return vector_dedup.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))

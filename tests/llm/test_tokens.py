"""Byte BPE, token counts and packing against the libraries and plain Python."""

import base64
import hashlib
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer
from util import clashing, docs, odd_texts

from flowwatch.llm import byte_bpe, packing, queries, token_counts
from flowwatch.llm.wordbpe import WordBpe

VOCABULARY = queries.vocabulary("word_bpe_49k.json")
RANKS = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
HF = Tokenizer.from_str(VOCABULARY)
LONG = "word and others, it's 12345 of them. " * 3000
TEXTS = [*odd_texts(), None, "", "", " ", "<|endoftext|> a<|startoftext|>b'S", "same same", "same same", LONG, "x" * 5000]


def tiktoken_ids(text):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, RANKS.splitlines())}
    enc = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda t: enc.encode_ordinary(t or "")


@pytest.mark.parametrize("block_chars", [50, 10_000_000])
def test_byte_bpe_equals_library_and_round_trips(spark, block_chars):
    df = clashing(docs(spark, TEXTS)).repartition(3)
    table = byte_bpe.token_bytes(spark, RANKS)
    coded = byte_bpe.encode(df, RANKS, table=table, block_chars=block_chars)
    got = byte_bpe.with_digests(coded).collect()
    assert byte_bpe.decode(coded.drop("decoded"), table).exceptAll(coded).count() == 0
    ids = tiktoken_ids(None)
    want = {}
    for i, t in enumerate(TEXTS):
        x = ids(t)
        want[i] = (len(x), hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest(),
                   hashlib.sha256((t or "").encode()).hexdigest())
    assert {r["doc_id"]: tuple(r)[1:] for r in got} == want and len(got) == len(TEXTS)


def test_empty_tables(spark):
    none = docs(spark, ["x"]).filter("false")
    assert byte_bpe.encode(none, RANKS).count() == 0
    assert packing.pack(none, VOCABULARY).count() == 0
    assert token_counts.count_tokens(none, VOCABULARY).count() == 0


def test_repeated_and_null_ids(spark):
    df = docs(spark, ["a b", "a b", "c"], [1, 1, None])
    assert sorted(r["n_tokens"] for r in byte_bpe.encode(df, RANKS).collect()) == [1, 2, 2]
    assert sorted(r["n_tokens"] for r in token_counts.count_tokens(df, VOCABULARY).collect()) == [1, 2, 2]
    assert packing.pack(df, VOCABULARY).count() == 3


def test_word_encoder_equals_library():
    texts = [t or "" for t in TEXTS]
    assert [x.tolist() for x in WordBpe(VOCABULARY).encode(texts)] == [
        HF.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("chunk,overlap", [(32_768, 512), (40, 8), (16, 3)])
def test_counts_equal_library_at_every_chunking(spark, chunk, overlap):
    texts = [*TEXTS, "it's " * 40 + "z" * 900 + "'s 've", "é" * 300 + "é<|endoftext|>" + "ab " * 100, "''''" * 200 + "s t"]
    df = clashing(docs(spark, texts)).repartition(2)
    got = {r["doc_id"]: tuple(r)[1:] for r in
           token_counts.count_tokens(df, VOCABULARY, chunk_chars=chunk, overlap=overlap).collect()}
    want = {}
    for i, t in enumerate(texts):
        n = len(HF.encode(t or "", add_special_tokens=False).ids)
        want[i] = (len((t or "").encode()), n, n > 2048)
    assert got == want


def best_fit_bins(lengths, capacity):
    free, placed = [], []
    for x in sorted(lengths, reverse=True):
        fits = [i for i, f in enumerate(free) if f >= x]
        i = min(fits, key=lambda j: free[j]) if fits else len(free)
        if not fits:
            free.append(capacity)
        placed.append((x, i, capacity - free[i]))
        free[i] -= x
    return placed, free


@pytest.mark.parametrize("seed", range(6))
def test_plan_equals_piecewise_best_fit(seed):
    rng = np.random.default_rng(seed)
    lengths = np.minimum(rng.geometric(.03, 700), 100)
    counts = sorted(zip(*map(list, np.unique(lengths, return_counts=True)), strict=True))
    placed = []
    for length, lo, hi, first, each, offset in packing.best_fit_plan([(int(a), int(b)) for a, b in counts], 100):
        for k in range(hi - lo):
            placed.append((length, first + k // each, offset + k % each * length))
    assert len(placed) == len(lengths)
    bins = defaultdict(list)
    for x, b, at in placed:
        bins[b].append((at, x))
    for b in bins.values():
        end = 0
        for at, x in sorted(b):
            assert at == end
            end += x
        assert end <= 100
    _, free = best_fit_bins(lengths.tolist(), 100)
    assert sorted(sum(x for _, x in b) for b in bins.values()) == sorted(100 - f for f in free)


def test_packing_covers_each_document(spark):
    capacity = 64
    df = clashing(docs(spark, TEXTS)).repartition(3)
    packed = packing.place(packing.written(packing.token_pieces(df, VOCABULARY, capacity=capacity, keep_ids=True), "t"),
                           capacity, bucket_rows=20)
    rows = packed.collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
    for i, t in enumerate(TEXTS):
        ids = [*HF.encode(t or "", add_special_tokens=False).ids, 1]
        parts = sorted(by_doc[i], key=lambda r: r["piece"])
        assert [r["start"] for r in parts] == list(range(0, len(ids), capacity))
        assert b"".join(r["ids"] for r in parts) == np.array(ids, "<u4").tobytes()
    for s in by_sequence.values():
        end = 0
        for r in sorted(s, key=lambda r: r["offset"]):
            assert r["offset"] == end
            end += r["length"]
        assert end <= capacity
    _, free = best_fit_bins([r["length"] for r in rows], capacity)
    assert len(by_sequence) == len(free)
    assert {r["sequence_id"]: r["length"] for r in packing.sequences(packed).collect()} == {
        k: sum(r["length"] for r in s) for k, s in by_sequence.items()}

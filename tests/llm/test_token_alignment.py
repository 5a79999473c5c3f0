"""The alignment of two tokenizers against the libraries and a plain count of overlapping byte ranges."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer
from util import SCHEMA, clashing, docs, odd_texts

from flowwatch.llm import token_alignment as ta

VOCABULARY = open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read()
MODEL = open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read()
COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.fixture(scope="module")
def tool():
    return ta.Aligner(VOCABULARY, MODEL)


def brute(rows):
    a = Tokenizer.from_str(VOCABULARY)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_proto=MODEL)
    alphabet = ta.byte_alphabet()
    names = {i: bytes(alphabet[c] for c in t) for t, i in a.get_vocab(with_added_tokens=False).items()}
    out, links, counts = [], [], Counter()
    for doc_id, text in rows:
        ids = [], []
        if text:
            ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            raw = [names[i] for i in ids[0]], [
                bytes([int(p[3:-1], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()
                for i in ids[1] for p in [b.id_to_piece(i)]]
            full = (" " + text).encode()
            if b"".join(raw[0]) != full or b"".join(raw[1]) != full:
                ids = [], []
        if not ids[0]:
            out.append((doc_id, 0, 0, 0, 0, ""))
            links.append([])
            continue
        ends = [np.cumsum([len(x) for x in r]).tolist() for r in raw]
        common = sorted(set(ends[0]) & set(ends[1]))
        of = [[next(k for k, c in enumerate(common) if e <= c) for e in es] if len(text) < 3000
              else np.searchsorted(common, es).tolist() for es in ends]
        text_of = defaultdict(lambda: ([], []))
        for side in (0, 1):
            for i, g in zip(ids[side], of[side], strict=True):
                text_of[g][side].append(str(i))
        digest = ";".join(",".join(text_of[g][0]) + "|" + ",".join(text_of[g][1]) for g in range(len(common)))
        mine, j = [], 0
        for i, e in enumerate(ends[0]):
            s = ends[0][i - 1] if i else 0
            while j and ends[1][j - 1] > s:
                j -= 1
            while j < len(ends[1]) and (ends[1][j - 1] if j else 0) < e:
                if ends[1][j] > s:
                    mine.append((ids[0][i], ids[1][j]))
                j += 1
        counts.update(set(mine))
        links.append(mine)
        out.append((doc_id, len(ids[0]), len(ids[1]), len(common), len(mine), hashlib.sha256(digest.encode()).hexdigest()))
    top = defaultdict(int)
    for (x, _), n in counts.items():
        top[x] = max(top[x], n)
    return sorted((*o[:5], sum(counts[p] == top[p[0]] for p in m), sum(counts[p] for p in m), o[5])
                  for o, m in zip(out, links, strict=True))


def result(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    syllables = ["ka", "lo", "é", "tion", "the", "ing ", " ", "  ", "\n", ".", "'s", "12", "😀", "日本", "<s>"]
    plain = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 200))) for _ in range(60)]
    return ["", None, " ", "   ", "a ", " a", "▁", "a▁b", "a  ▁ b", "<|endoftext|> and </s><unk> <0x41>", "\x00\x01", "ﬁ Ａ é",
            "the cat", "the cat", "x" * 3000, "a\ue000b", "don't  stop\n\n now", *odd_texts(80), *plain]


@pytest.mark.parametrize("block_chars", [200, ta.BLOCK_CHARS])
def test_against_libraries(spark, texts, block_chars):
    got = ta.align_documents(clashing(docs(spark, texts)), VOCABULARY, MODEL, block_chars=block_chars)
    assert result(got) == brute(list(enumerate(texts)))


def test_long_texts_in_stretches(spark, monkeypatch, texts, tool):
    long = [" ".join(t or "" for t in texts).replace("▁", "-"), "ab cd. " * 4000, "y" * 9000, "m" * 5000 + " " + "n" * 5000,
            "word ▁ word " * 500]
    rows = [*long, long[1], "ab cd."]
    assert [tool.huge(t).counts.tolist() for t in rows] == [
        [[x] for x in r[1:5]] for r in sorted(brute(list(enumerate(rows))))]
    monkeypatch.setattr(ta, "STRETCH_CHARS", 700)
    want = brute(list(enumerate(rows)))
    for t, w in zip(rows, want, strict=True):
        one = tool.huge(t)
        assert one.counts[:, 0].tolist() == list(w[1:5]) and one.digests == [w[7]]
        assert int(one.uses.sum()) == w[4]
    assert len(ta.cut_stretches(" " + long[1], 700)) > 30
    assert result(ta.align_documents(docs(spark, rows), VOCABULARY, MODEL)) == want


def test_rows_ids_and_empty_table(spark):
    rows = docs(spark, ["one two", "one two", "one two", None], [7, 7, None, 3])
    got = ta.align_documents(rows, VOCABULARY, MODEL).collect()
    assert len(got) == 4 and sum(r["doc_id"] is None for r in got) == 1
    full = [r for r in got if r["n_a"]]
    assert {(r["n_links"], r["n_best"], r["count_sum"]) for r in full} == {(2, 2, 6)} and len(full) == 3
    assert ta.align_documents(spark.createDataFrame([], SCHEMA), VOCABULARY, MODEL).collect() == []


def test_gallop_is_a_lower_bound():
    rng = np.random.default_rng(2)
    x = [np.unique(rng.integers(0, 4000, n)) for n in (0, 1, 5, 300, 90)]
    y = [np.unique(rng.integers(0, 4000, n)) for n in (0, 7, 400, 900, 90)]
    first = np.cumsum([0, *map(len, x)])
    low = np.cumsum([0, *map(len, y)])
    got = ta.gallop(np.concatenate(x), first[:-1], np.diff(first), np.concatenate(y), low[:-1], low[1:])
    want = np.concatenate([np.searchsorted(b, a) + k for a, b, k in zip(x, y, low, strict=False)])
    assert (got == want).all()

"""Perplexity is scored against the whole table of n-grams, whatever the share of a language."""

import math
import random

import pytest
from test_models import plain_kneser_ney
from util import docs

from flowwatch.llm import perplexity


def test_scores_equal_plain_kneser_ney_in_each_language(spark):
    rng = random.Random(8)
    words = {"big": ["the", "cat", "sat", "on", "mats"], "few": ["été", "là", "où", "ça"]}
    rows = [("big" if i % 10 else "few", i) for i in range(60)]
    texts = [" ".join(rng.choice(words[lang]) for _ in range(rng.randint(5, 60))) for lang, _ in rows]
    df = docs(spark, [*texts, None, ""]).drop("lang")
    langs = spark.createDataFrame([(i, lang) for lang, i in rows], "doc_id long, lang string")
    df = df.join(langs, "doc_id", "left").repartition(3)
    got = {r["doc_id"]: r["log_perplexity"] for r in perplexity.quality(df, order=3, least_count=1, join_bytes=400).collect()}
    assert len(got) == 62 and got[60] is None and got[61] is None
    for lang in words:
        p = plain_kneser_ney([t for t, (x, _) in zip(texts, rows, strict=True) if x == lang], 3)
        for t, (x, i) in zip(texts, rows, strict=True):
            if x == lang:
                raw = bytes(2) + t.encode().lower()
                want = -sum(math.log(p(raw[k:k + 3])) for k in range(len(raw) - 2)) / (len(raw) - 2)
                assert got[i] == pytest.approx(want, rel=1e-5)


def test_a_small_language_keeps_its_long_n_grams(spark):
    """A million n-grams of one language leave those of another, each found a few times, in its model."""
    rng = random.Random(9)
    large = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(60_000)) for _ in range(60)]
    small = [" ".join(rng.choice(["kaló", "pragma", "zitima", "vouno"]) for _ in range(60)) for _ in range(2)]
    df = docs(spark, large + small).selectExpr("doc_id", "text", "IF(doc_id < 60, 'aa', 'bb') AS lang", "source", "n_chars")
    alone = {r["doc_id"]: r["log_perplexity"] for r in perplexity.quality(df.filter("lang = 'bb'")).collect()}
    both = {r["doc_id"]: r["log_perplexity"] for r in perplexity.quality(df).filter("doc_id >= 60").collect()}
    assert both == pytest.approx(alone, rel=1e-6)

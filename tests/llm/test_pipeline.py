"""The pipeline's stages against brute force on their own inputs."""

import re

import pytest
from test_models import plain_counts
from test_ngram_join import brute

import corpus_pipeline
from flowwatch.llm import perplexity, string_kernel
from flowwatch.llm.common import documents, written

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = documents(spark, SMALL)
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(written(stage(spark, out[-1], SMALL), f"test-{name}"))
    return out


def rows(df):
    return {r["doc_id"]: r.asDict() for r in df.collect()}


def test_columns(stages):
    assert all(s.columns == stages[0].columns for s in stages[:5])
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "language", "near_duplicates", "secrets", "pack"]


def test_quality_stage(stages):
    before, after = rows(stages[0]), rows(stages[1])
    verdict = {r["doc_id"]: r["kept"] for r in perplexity.quality(stages[0]).collect()}
    assert set(after) == {i for i in before if verdict[i]}
    for i, r in before.items():
        c = plain_counts(r["text"])
        if c[0] < 50 or 100 * c[4] > 50 * c[0]:
            assert i not in after
    assert all(after[i] == before[i] for i in after)


def test_language_stage(stages):
    before, after = rows(stages[1]), rows(stages[2])
    verdict = {r["doc_id"]: r for r in string_kernel.identify(stages[1]).collect()}
    assert set(after) == {i for i in before if verdict[i]["lang_pred"] != "und" and verdict[i]["score"] >= .25}


def test_near_duplicate_stage(stages):
    before, after = rows(stages[2]), rows(stages[3])
    groups = brute([(i, r["text"]) for i, r in before.items()], percent=80, width=5)
    assert set(after) == {i for i, (_, g) in groups.items() if g == i} and len(after) < len(before)
    assert stages[3].count() == len(after)


def test_secret_stage(stages):
    before, after = rows(stages[3]), rows(stages[4])
    assert set(before) == set(after)
    for i, r in after.items():
        assert not re.search(r"[0-9a-f]{24,}", r["text"]) and r["n_chars"] == len(r["text"])
        if not re.search(r"[0-9a-f]{24,}|AKIA|[:=]", before[i]["text"]):
            assert r["text"] == before[i]["text"]


def test_pack_stage(stages):
    packed = stages[5].collect()
    assert {r["doc_id"] for r in packed} == set(rows(stages[4]))
    ends = {}
    for r in sorted(packed, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends.get(r["sequence_id"], 0)
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(ends.values()) <= 4096


def test_stages_take_odd_rows(spark):
    text = " ".join(f"word{i % 97} and some more of it" for i in range(40))
    odd = [(1, None, None, None, None), (None, text, None, "s", 1), (2, "", "en", "s", 0), (3, text + " x", "en", None, 9),
           (3, text + " x", "en", None, 9), (4, text + " y", None, "s", 2)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept string, `__id2` long"
    df = spark.createDataFrame([(*r, "k", 5) for r in odd], schema)
    for name, stage in corpus_pipeline.STAGES:
        for table in (df, df.filter("false")):
            out = written(stage(spark, table, SMALL), f"odd-{name}")
            assert name == "pack" or out.columns == df.columns
    left = written(corpus_pipeline.near_duplicates(spark, df, SMALL), "odd").collect()
    assert sorted((r["doc_id"] or 0) for r in left) == [0, 1, 2, 3]

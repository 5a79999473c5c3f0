"""Every labelled language has landmarks, whatever the lengths of its texts."""

import random

from flowwatch.llm import string_kernel

SCHEMA = "doc_id long, text string, lang string"
SYLLABLES = {"aa": ["ka", "to", "mi", "re"], "bb": ["sch", "ung", "ein", "au"], "cc": ["é", "eau", "oi", "que"]}


def written_in(rng, lang, n):
    return "".join(rng.choice(SYLLABLES[lang]) + rng.choice(["", " "]) for _ in range(n))


def test_short_and_long_languages_are_learned(spark):
    rng = random.Random(5)
    sizes = {"aa": 12, "bb": 90, "cc": 15_000}  # below, inside and above the range of landmarks
    rows = [(3 * i + k, written_in(rng, lang, n), lang) for k, (lang, n) in enumerate(sizes.items()) for i in range(24)]
    got = {r["doc_id"]: r["lang_pred"] for r in string_kernel.identify(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert sum(got[i] == lang for i, _, lang in rows) >= .97 * len(rows)


def test_only_short_texts_are_learned(spark):
    rng = random.Random(6)
    rows = [(2 * i + k, written_in(rng, lang, 12), lang) for k, lang in enumerate(["aa", "bb"]) for i in range(40)]
    got = {r["doc_id"]: r["lang_pred"] for r in string_kernel.identify(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert sum(got[i] == lang for i, _, lang in rows) >= .95 * len(rows)

"""The language stage rejects texts outside the learned languages and keeps held-out texts of these."""

import random

import numpy as np

from flowwatch.llm import string_kernel

SCHEMA = "doc_id long, text string, lang string"
SYLLABLES = {"aa": ["ka", "to", "mi", "re", "nu"], "bb": ["sch", "ung", "ein", "au"], "cc": ["é", "eau", "oi", "que"],
             "dd": ["shi", "wo", "pe", "gra"]}


def text(rng, parts, n=90):
    return "".join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(n))


def test_other_languages_and_letter_junk_go(spark):
    rng = random.Random(7)
    rows = [(4 * i + k, text(rng, SYLLABLES[lang]), lang) for k, lang in enumerate(SYLLABLES) for i in range(60)]
    foreign = [(1000 + i, text(rng, ["хо", "ды", "бра", "жи"]), None) for i in range(10)]
    foreign += [(1100 + i, text(rng, ["vyx", "dzq", "fub", "lyp"]), None) for i in range(10)]
    foreign += [(1200 + i, "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(300)), None) for i in range(10)]
    own = [(1300 + i, text(rng, SYLLABLES[lang]), None) for i, lang in enumerate([*SYLLABLES] * 5)]
    df = spark.createDataFrame(rows + foreign + own, SCHEMA)
    kept = {r["doc_id"]: r["lang"] for r in string_kernel.recognised_rows(df).collect()}
    assert not any(i in kept for i, _, _ in foreign)
    assert sum(kept.get(i) == [*SYLLABLES][k % 4] for k, (i, _, _) in enumerate(own)) >= 19
    assert sum(i in kept for i, _, _ in rows) >= .97 * len(rows)
    scores = {r["doc_id"]: r["score"] for r in string_kernel.identify(df).collect()}
    assert set(kept) == {i for i, s in scores.items() if s >= .25} and 0 <= min(scores.values()) and max(scores.values()) <= 1


def test_one_language_has_no_second():
    assert np.isinf(string_kernel.lead(np.zeros((2, 1)))).all()
    assert string_kernel.lead(np.array([[.1, .7, .4]])).round(6).tolist() == [.3]

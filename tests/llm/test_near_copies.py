"""The near-duplicate stage links five-word shingle sets from a similarity of 0.8 on."""

import random

from util import docs

import corpus_pipeline


def jaccard(a, b, width=5):
    one, two = ({tuple(t.split()[k:k + width]) for k in range(len(t.split()) - width + 1)} for t in (a, b))
    return len(one & two) / len(one | two)


def brute(texts):
    """The least member of each group of linked texts."""
    first = list(range(len(texts)))
    for j in range(len(texts)):
        for i in range(j):
            if jaccard(texts[i], texts[j]) >= .8:
                a, b = sorted((first[i], first[j]))
                first = [a if x == b else x for x in first]
    return {i for i, x in enumerate(first) if x == i}


def edited(rng, words, at):
    out = list(words)
    for k in at:
        out[k] = f"edit{rng.randint(0, 10 ** 9)}"
    return out


def test_copies_between_the_two_contracts_leave(spark):
    rng = random.Random(4)
    texts = []
    for _ in range(12):
        words = [f"w{rng.randint(0, 5000)}" for _ in range(200)]
        texts.append(" ".join(words))
        texts.append(" ".join(edited(rng, words, range(25, 200, 45))))  # 4 scattered edits: five-word Jaccard 0.81
        texts.append(" ".join([*words[:90], *(f"block{rng.randint(0, 10 ** 9)}" for _ in range(30)), *words[90:]]))
        texts.append(" ".join(edited(rng, words, range(10, 200, 20))))  # 10 edits: below 0.8
    assert {.8 <= jaccard(texts[0], t) < .9 for t in texts[1:3]} == {True} and jaccard(texts[0], texts[3]) < .8
    df = docs(spark, texts).repartition(3)
    left = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, df, "").collect()}
    assert left == brute(texts) and len(left) == 24

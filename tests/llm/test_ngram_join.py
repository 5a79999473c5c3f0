"""The n-gram Jaccard join against all pairs in plain Python."""

import random

import numpy as np
import pytest
from util import clashing, docs

from flowwatch.llm import ngram_join
from flowwatch.llm.components import components


def brute(rows, percent=90, width=3):
    sets, ids = {}, []
    for i, t in rows:
        w = (t or "").encode().lower().split()
        s = {tuple(w[k:k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
        sets[i] = s
        ids.append(i)
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for x in ids:
        for y in ids:
            if x < y and sets[x] and sets[y]:
                both = len(sets[x] & sets[y])
                if 100 * both >= percent * (len(sets[x]) + len(sets[y]) - both):
                    a, b = sorted((root(x), root(y)))
                    parent[b] = a
    return {i: (len(sets[i]), root(i)) for i in ids}


def corpus(seed=5, n=60):
    rng = random.Random(seed)
    vocabulary = ["w%d" % i for i in range(40)] + ["rare%d" % i for i in range(3000)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    texts = []
    for _ in range(n):
        words = [rng.choice(vocabulary[:40] if rng.random() < .6 else vocabulary) for _ in range(rng.randint(1, 150))]
        if rng.random() < .3:
            words += passage
        for _ in range(rng.choice([1, 1, 2, 6])):
            copy = list(words)
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            sep = rng.choice([" ", "  ", "\n", "\t"])
            texts.append(sep.join(w.upper() if rng.random() < .1 else w for w in copy))
    near = [rng.choice(vocabulary) for _ in range(90)]
    for _ in range(50):  # one large group of near copies with links of every strength
        copy = list(near)
        for _ in range(rng.randint(0, 4)):
            copy[rng.randrange(90)] = rng.choice(vocabulary)
        texts.append(" ".join(copy))
    return texts + [None, "", "  \n ", "one", "One", "one two", "one two", "É é x", "é é x"] + ["copy of a text here"] * 7


@pytest.mark.parametrize("elements", [2_000_000, 1500, 300])
def test_components_equal_all_pairs(spark, elements):
    texts = corpus()
    ids = list(range(1000, 1000 + len(texts)))
    random.Random(2).shuffle(ids)
    df = clashing(docs(spark, texts, ids)).repartition(3)
    got = ngram_join.ngram_components(df, region_elements=elements, pivots=3, share=1e-3).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute(list(zip(ids, texts, strict=True)))
    assert len(got) == len(texts)


def test_odd_tables(spark):
    df = docs(spark, ["a b c d", "a b c d", "x y z", None], [3, 3, None, 9])
    got = sorted((r["n_shingles"], r["doc_id"] or 0, r["component_id"] or 0)
                 for r in ngram_join.ngram_components(df).collect())
    assert got == [(0, 9, 9), (1, 0, 0), (2, 3, 3), (2, 3, 3)]
    assert ngram_join.ngram_components(df.filter("false")).count() == 0
    rare = docs(spark, ["a b c d e f", "q r s t u v", "q r s t u v"], [5, 5, 2])  # one id, two texts: one node
    assert {r["component_id"] for r in ngram_join.ngram_components(rare).collect()} == {2}


def test_region_windows_lose_no_link():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 40, 120).astype(np.uint64)
    sets = []
    for _ in range(80):
        s = base.copy()
        k = rng.integers(0, 14)
        s[rng.choice(120, k, replace=False)] = rng.integers(1 << 41, 1 << 42, k)
        sets.append(np.unique(s))
    group = ngram_join.Region(list(range(80)), sets).groups(90)
    plain = np.arange(80)
    for i in range(80):
        for j in range(i):
            s = len(np.intersect1d(sets[i], sets[j]))
            if 100 * s >= 90 * (len(sets[i]) + len(sets[j]) - s):
                plain[plain == plain[i]] = plain[j]
    assert len(set(zip(group.tolist(), plain.tolist(), strict=True))) == len(set(group.tolist())) == len(set(plain.tolist()))


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(8, 60)] + [(70, 71), (71, 70)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert {got[i] for i in range(100, 161)} == {100} and {got[i] for i in range(7, 60)} == {7} and got[71] == 70


def test_slices_part_no_linked_pair():
    rng = np.random.default_rng(8)
    base = rng.choice(1 << 50, 200, replace=False).astype(np.uint64)
    sets = []
    for k in rng.integers(0, 40, 60):
        s = base[: rng.integers(150, 201)].copy()
        s[rng.choice(len(s), k, replace=False)] = rng.integers(1 << 51, 1 << 52, k)
        sets.append(np.unique(s))
    n = np.array([len(s) for s in sets])
    heads = [s[:ngram_join.prefix_length(len(s), 90)] for s in sets]
    group = ngram_join.slice_groups(n, heads, 90)
    for i in range(60):
        for j in range(i):
            s = len(np.intersect1d(sets[i], sets[j]))
            if 100 * s >= 90 * (n[i] + n[j] - s):
                assert group[i] == group[j]
    passage = rng.choice(1 << 40, 8, replace=False).astype(np.uint64)  # first in the order, in texts that share nothing else
    alone = [np.unique(np.r_[passage, rng.integers(1 << 53, 1 << 54, 192).astype(np.uint64)]) for _ in range(20)]
    heads = [s[:2 * ngram_join.prefix_length(len(s), 90)] for s in alone]
    assert len(set(ngram_join.slice_groups(np.full(20, 200), heads, 90).tolist())) == 20

"""Perplexity, string kernels, learned partitions and training order against plain computations."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer
from util import clashing, docs, odd_texts

from flowwatch.llm import graph_ann, perplexity, queries, string_kernel, training_order

VOCABULARY = queries.vocabulary("word_bpe_49k.json")
HF = Tokenizer.from_str(VOCABULARY)


def plain_counts(t):
    words, at = [], 0
    for c in t + " ":
        if c in " \t\n\v\f\r":
            if at:
                words.append(word)
            word, at = "", 0
        else:
            word = word + c if at else c
            at += 1
    lines, dup = set(), 0
    for line in t.split("\n"):
        if any(c not in " \t\v\f\r" for c in line):
            dup += line in lines
            lines.add(line)
    windows = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for k in range(3)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), dup, len(covered))


def test_counts_equal_plain_reading():
    rng = random.Random(6)
    texts = odd_texts(200) + ["\n".join(rng.choice(["a b c", "a b", " ", "", "x # |", "é é é é é"]) for _ in range(rng.randint(0, 12)))
                              for _ in range(300)]
    for t in texts:
        assert tuple(perplexity.text_counts(t)) == plain_counts(t), t


def plain_kneser_ney(texts, order):
    """P(byte | context) by dictionaries, nothing left out."""
    counts = Counter()
    for t in texts:
        raw = bytes(order - 1) + t.encode().lower()
        counts.update(raw[i:i + order] for i in range(len(raw) - order + 1))
    levels = [counts]
    while len(levels) < order:
        levels.append(Counter(g[1:] for g in levels[-1]))
    levels = levels[::-1]
    tables = []
    for k, c in enumerate(levels, 1):
        n = [sum(v == i for v in c.values()) for i in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1]) if n[0] + 2 * n[1] else .5
        d = [min(i, max(0, i - (i + 1) * y * n[i] / n[i - 1])) if n[i - 1] else i / 2 for i in (1, 2, 3)]
        total, kept = Counter(), Counter()
        for g, v in c.items():
            total[g[:-1]] += v
            kept[g[:-1]] += v - d[min(v, 3) - 1]
        tables.append((c, d, total, kept))

    def p(gram):
        if not gram:
            return 1 / 256
        c, d, total, kept = tables[len(gram) - 1]
        lower = p(gram[1:])
        h = gram[:-1]
        if not total[h]:
            return lower
        own = (c[gram] - d[min(c[gram], 3) - 1]) / total[h] if c[gram] else 0
        return own + (1 - kept[h] / total[h]) * lower
    return p


def test_model_equals_plain_kneser_ney(spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["the", "cat", "sat", "on", "mats", "été"]) for _ in range(rng.randint(1, 30))) for _ in range(40)]
    model = perplexity.fit_model(docs(spark, texts).repartition(3), order=3, least_share=0.0, least_count=1)
    p = plain_kneser_ney(texts, 3)
    for t in ["the cat", "zzz", "the zat été", "a"]:
        raw = bytes(2) + t.encode()
        want = -sum(math.log(p(raw[i:i + 3])) for i in range(len(t.encode()))) / len(t.encode())
        assert model.log_perplexity([t], ["en"])[0] == pytest.approx(want, rel=1e-5)
    context = b"th"
    grams = np.array([int.from_bytes(context + bytes([b]), "big") for b in range(256)], np.uint64)
    assert model.probability(grams, np.zeros(256, np.uint64)).sum() == pytest.approx(1, abs=1e-5)


def test_left_out_entries_keep_probabilities_whole(spark):
    texts = ["abcabcabd" * 20 + "xyz", "abcd" * 30]
    model = perplexity.fit_model(docs(spark, texts), order=3, least_share=0.02)
    for context in (b"ab", b"bc", b"xy", b"qq"):
        grams = np.array([int.from_bytes(context + bytes([b]), "big") for b in range(256)], np.uint64)
        assert model.probability(grams, np.zeros(256, np.uint64)).sum() == pytest.approx(1, abs=1e-5)


def prose(rng, words, n=120):
    return " ".join(rng.choice(words) for _ in range(n))


def test_quality_keeps_prose_and_rejects_noise(spark):
    rng = random.Random(2)
    words = ["w" + "".join(rng.choice("aeiounrst") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    good = [prose(rng, words) for _ in range(150)]
    noise = [" ".join("".join(rng.choice("QXZ#@~^{}\\0123456789KJV") for _ in range(7)) for _ in range(90)) for _ in range(3)]
    dull = ["a b " * 200, "short text"]
    texts = [*good, *noise, *dull, None, "", good[0], good[0], "long " + prose(rng, words, 40_000)]
    df = clashing(docs(spark, texts)).repartition(3)
    got = {r["doc_id"]: r for r in perplexity.quality(df).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        r, c = got[i], plain_counts(t or "")
        assert tuple(r[n] for n in perplexity.Counts._fields) == c
        assert r["base_failed"] == (c[0] < 50 or 100 * c[4] > 50 * c[0])
        assert not (r["base_failed"] and r["kept"])
    assert all(got[i]["kept"] for i in range(150)) and not any(got[i]["kept"] for i in range(150, 157))
    kept = perplexity.kept_rows(df)
    assert kept.columns == df.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if r["kept"]}
    assert perplexity.quality(df.filter("false")).count() == 0


def languages(n=60, seed=3):
    rng = random.Random(seed)
    syllables = {"aa": ["ka", "to", "mi", "re"], "bb": ["sch", "ung", "ein", "au"], "cc": ["é", "eau", "oi", "que"]}
    return [("".join(rng.choice(syllables[lang]) + rng.choice(["", " "]) for _ in range(rng.randint(60, 120))), lang)
            for lang in syllables for _ in range(n)]


def test_languages_of_held_out_documents(spark):
    rows = [(i, t, lang, "s", len(t)) for i, (t, lang) in enumerate(languages())]
    rows += [(900, None, "aa", "s", 0), (901, "12 34 !!", "aa", "s", 0), (902, "", None, "s", 0), (None, "ka to", None, "s", 0),
             (904, "ka to mi " * 30_000, None, "s", 0), (905, "日本", None, "s", 0)]
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"))
    got = {r["doc_id"]: r for r in string_kernel.identify(df).collect()}
    assert len(got) == len(rows)
    for i in range(180):
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1)
    held = [i for i in range(180) if got[i]["held_out"]]
    assert sum(got[i]["lang_pred"] == rows[i][2] for i in held) >= .97 * len(held)
    assert [got[i]["lang_pred"] for i in (900, 901, 902)] == ["und"] * 3 and got[904]["lang_pred"] == "aa"
    assert all(0 <= r["score"] <= 1 for r in got.values()) and got[None]["held_out"] is None
    kept = string_kernel.recognised_rows(df)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()}.isdisjoint({900, 901, 902})
    assert string_kernel.identify(df.filter("false")).count() == 0
    assert {r["lang_pred"] for r in string_kernel.identify(df.filter("doc_id IS NULL")).collect()} == {"und"}


def test_prediction_never_reads_the_label_of_a_held_out_row(spark):
    rows = [(i, t, lang, "s", 0) for i, (t, lang) in enumerate(languages())]
    lied = [(i, t, "zz" if zlib.crc32(str(i).encode()) % 3 == 1 else lang, s, n) for i, t, lang, s, n in rows]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    one, two = (sorted(map(tuple, string_kernel.identify(spark.createDataFrame(x, schema)).collect())) for x in (rows, lied))
    assert one == two


def plain_nearest(rows, k=10, every=100):
    out = {}
    for i, v in rows:
        if i % every == 0:
            d = sorted((math.sqrt(sum((a - b) ** 2 for a, b in zip(v, w, strict=True))), j) for j, w in rows if j != i)
            out[i] = d[:k]
    return out


@pytest.mark.parametrize("parts,probes", [(1, None), (6, None)])
def test_search_finds_neighbours(spark, parts, probes):
    rng = np.random.default_rng(parts)
    centres = rng.normal(0, 4, (8, 12))
    rows = [(i, (centres[i % 8] + rng.normal(size=12)).astype(np.float32).tolist()) for i in range(1200)]
    rows += [(5000 + i, rows[200][1]) for i in range(40)]  # copies of a query's vector
    odd = [(300_000, None), (300_100, []), (300_200, [0.0] * 12), (300_300, [float("nan")] * 12), (None, rows[0][1]),
           (300_400, [1.0] * 11), (300_500, [None] + [1.0] * 11), (300_600, [float("inf")] + [1.0] * 11)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").selectExpr(
        "*", "1 AS part", "2 AS id", "3 AS v").repartition(4)
    got = defaultdict(list)
    for r in graph_ann.search(df, parts=parts, block_rows=100, block_queries=3).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    want = plain_nearest(rows)
    assert set(got) == set(want)
    hits = 0
    for q, found in got.items():
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, 11))
        assert [(s, i) for _, i, s in found] == sorted((s, i) for _, i, s in found)
        exact = dict((i, d) for d, i in plain_nearest([x for x in rows if x[0] == q or x[0] in {i for _, i, _ in found}])[q])
        assert all(s == pytest.approx(exact[i], rel=1e-12) for _, i, s in found)
        hits += len({i for _, i, _ in found} & {i for _, i in want[q]})
    assert hits >= (1.0 if parts == 1 else .9) * 10 * len(want)
    if parts == 1:
        assert [i for _, i, _ in got[200]] == list(range(5000, 5010))


def test_search_of_small_tables(spark):
    schema = "vec_id long, embedding array<float>"
    few = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 3.0]), (1, [1.0, 9.0]), (7, [5.0, 2.0])], schema)
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in graph_ann.search(few).orderBy("rank").collect()] == [
        (0, 1, 1, 1.0), (0, 2, 7, 4.0)]
    assert graph_ann.search(few.filter("false")).count() == 0 and graph_ann.search(few.filter("vec_id = 0")).count() == 0


def test_parts_are_balanced():
    x = np.random.default_rng(1).normal(size=(600, 5))
    part = graph_ann.balanced_parts(x, graph_ann.neighbour_graph(x, 8), 7)
    sizes = np.bincount(part, minlength=7)
    assert sizes.max() <= math.ceil(1.1 * 600 / 7) and sizes.min() > 0


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 255, 1000, 4097])
def test_feistel_is_a_permutation(n):
    out = training_order.feistel(np.arange(n), n, 99)
    assert sorted(out.tolist()) == list(range(n))
    if n > 100:
        assert (out != training_order.feistel(np.arange(n), n, 98)).any() and (out != np.arange(n)).mean() > .9


def test_shards_hold_every_token_and_resume(spark, tmp_path):
    texts = [*odd_texts(60), None, "", "same", "same", "many words of a long text " * 400]
    df = clashing(docs(spark, texts)).repartition(3)
    path = training_order.materialise(df, VOCABULARY, str(tmp_path / "order"), length=32, shard_sequences=5)
    rows = sorted(training_order.read_sequences(spark, path).collect(), key=lambda r: r["slot"])
    assert [r["slot"] for r in rows] == list(range(len(rows)))
    assert all(len(r["ids"]) == 64 and (r["shard"], r["place"]) == divmod(r["slot"], 5) for r in rows)
    pieces = defaultdict(dict)
    for r in rows:
        ids, at = np.frombuffer(r["ids"], "<u2").tolist(), 0
        for d in r["docs"]:
            pieces[d["doc_id"]][d["start"]] = ids[at:at + d["length"]]
            at += d["length"]
        assert at == r["n_tokens"] and all(i == 1 for i in ids[at:])
    for i, t in enumerate(texts):
        whole = [x for s in sorted(pieces[i]) for x in pieces[i][s]]
        assert whole == [*HF.encode(t or "", add_special_tokens=False).ids, 1]
    rest = sorted(r["slot"] for r in training_order.read_sequences(spark, path, 13).collect())
    assert rest == list(range(13, len(rows)))
    for slot in (0, 4, 5, len(rows) - 1, len(rows)):
        resumed = training_order.read_sequences(spark, path, slot)
        assert sorted(r["slot"] for r in resumed.collect()) == list(range(slot, len(rows)))
    plan = resumed._jdf.queryExecution().executedPlan().toString()
    assert f"GreaterThanOrEqual(last_slot,{len(rows)})" in plan
    late = training_order.read_sequences(spark, path, len(rows) - 1)
    assert late.select("shard").distinct().count() == 1
    empty = training_order.materialise(df.filter("false"), VOCABULARY, str(tmp_path / "none"))
    assert training_order.read_sequences(spark, empty).count() == 0

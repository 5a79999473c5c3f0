"""The audit of five filters against applying every order to the documents, and exact shares."""

import random
import re
from fractions import Fraction
from itertools import permutations

from util import SCHEMA, clashing, odd_texts

from flowwatch.llm import filter_audit as fa

LABELS = "doc_id long, quality int, toxic int"


def fails(rows):
    smallest = {}
    for doc_id, text, _ in rows:
        if doc_id is not None:
            smallest[text or ""] = min(doc_id, smallest.get(text or "", doc_id))
    for doc_id, text, _ in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        yield {c for c, bad in zip("ABCDE", (
            len(words) < 100, 100 * len(set(words)) < 80 * len(words),
            100 * len(re.findall("[A-Z]", text)) > 10 * len(text), re.search(r"[#$%&*|]", text) is not None,
            doc_id is not None and smallest[text] < doc_id), strict=True) if bad}


def brute(rows, labels):
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    marked = [(lang or "", f, doc_id in good, doc_id in toxic)
              for (doc_id, _, lang), f in zip(rows, fails(rows), strict=True)]
    out = {}
    for part in {m[0] for m in marked}:
        mine, total = [m for m in marked if m[0] == part], dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = mine
            for step, c in enumerate(order, 1):
                gone = [m for m in left if c in m[1]]
                left = [m for m in left if c not in m[1]]
                total[c] += len(gone)
                out[part, "".join(order), step] = [
                    c, len(left), len(gone), sum(c in m[1] for m in mine) - len(gone), sum(m[1] == {c} for m in mine),
                    sum(m[2] for m in gone), sum(m[3] for m in gone)]
        for key, row in out.items():
            if key[0] == part:
                row.append(total[row[0]])
    return {k: tuple(v) for k, v in out.items()}


def table(df):
    rows = df.collect()
    out = {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in (
        "filter", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")) for r in rows}
    assert len(out) == len(rows)
    return out


def sample():
    rng = random.Random(1)
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(rng.choice(words[:rng.choice([60, 400])]) for _ in range(rng.choice([5, 99, 100, 101, 200])))
             for _ in range(60)]
    texts = [t.upper() if rng.random() < 0.2 else t for t in texts]
    texts = [t + rng.choice("#$%&*|") if rng.random() < 0.3 else t for t in texts]
    edge = [" ".join(words[:80] + words[:20]), " ".join(words[:79] + words[:21]), "A" + "b" * 9, "A" + "b" * 8,
            "\x1f".join(words[:150]), " ".join(words[:150]) * 300]
    texts += [*edge, None, "", " \t\n", *odd_texts(20)]
    rows = [(i, t, rng.choice(["en", "de", None, ""])) for i, t in enumerate(texts)]
    rows += [(100 + i, t, rng.choice(["en", "de"])) for i, t in enumerate(texts[::2])]
    rows += [(None, texts[0], "en"), (None, texts[1], None), (5, texts[5], "en"), (5, texts[5], "de"), (5, texts[9], "en")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 150, 2)] + [(4, 1, 1), (None, 1, 1)]
    return rows, labels


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", 0) for i, t, lang in rows], SCHEMA).repartition(3)


def test_against_every_order(spark):
    rows, labels = sample()
    got = fa.audit(clashing(frame(spark, rows)), spark.createDataFrame(labels, LABELS))
    assert table(got) == brute(rows, labels)


def test_shuffled_labels_and_hot_copies(spark, monkeypatch):
    monkeypatch.setattr("flowwatch.llm.common.BROADCAST_ROWS", 0)
    rows, labels = sample()
    rows += [(1000 + i, "same text", "en") for i in range(300)] + [(7, "same text", "de")]
    got = fa.audit(frame(spark, rows), spark.createDataFrame(labels, LABELS))
    assert table(got) == brute(rows, labels)


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert fa.audit(none, spark.createDataFrame([], LABELS)).collect() == []
    one = fa.audit(frame(spark, [(1, "a b", None)]), spark.createDataFrame([], LABELS))
    assert table(one) == brute([(1, "a b", None)], [])


def test_least_squares_are_the_shapley_values():
    rng = random.Random(8)
    for size in (2, 3, 5):
        v = [0] + [rng.randint(0, 50) for _ in range((1 << size) - 1)]
        want = [Fraction(0)] * size
        orders = list(permutations(range(size)))
        for order in orders:
            s = 0
            for i in order:
                want[i] += Fraction(v[s | 1 << i] - v[s], len(orders))
                s |= 1 << i
        assert fa.shapley_values(v) == want

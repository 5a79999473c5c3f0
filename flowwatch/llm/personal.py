"""Personal data: fixed patterns, and boosted trees over candidate spans.

High-recall generators propose overlapping spans (anything around an @, dotted numbers, digit groups with separators).
Each candidate has format features (digits, groups, separators, check digit) and context features (the characters and
words around it). Gradient-boosted trees, one model a kind, learn from the candidates of all texts: pattern matches are
the examples, and counterexamples are clear non-matches only, which have no hint word before them and fail a length, a
check digit or a form, or are another kind's match. What is neither is not learned from. The trait by which the pattern
itself decides (a plus, separators, the dots of a domain, parts up to 255) is hidden from half of the candidates, drawn by
hash, and from every candidate that is judged: a candidate that the pattern refuses is judged by the rest of its format and
by context. Three in ten, also drawn by hash, are held out of the fit; over all of them, with the trait hidden, the least
score that still reaches the asked precision, less half the gap below it, becomes the kind's threshold. Candidates above
it that overlap no pattern match are added, best score first.

The candidates are a table with one row for equal ones and their count; trees grow from sums that Spark adds over it, and
the thresholds come from running sums over the scores, so nothing is collected but sums of a fixed number.

Defined results: a null or empty text has no spans; null doc_ids and repeated rows each give their row; an empty table
gives no rows; a kind with too few examples or counterexamples adds nothing; runs of more than ``LONGEST_ADDRESS``
characters, more than 8 dotted parts, parts of more than 5 digits, and groups of more than 31 digits are no candidates;
further columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowwatch.llm import boosting
from flowwatch.llm.common import id_and_text, map_blocks, prepared, written
from flowwatch.llm.spans import SPANS, Span, as_text, count_of, cut_out, disjoint, in_order
from flowwatch.operators.metrics import count_if
from flowwatch.operators.order import prefix_sums

KINDS = ("email", "ip", "card", "phone")
#: Precision that a threshold must reach on held-out candidates, and the examples of each class it takes.
PRECISION, EXAMPLES = 0.98, 20
#: Share of the features that a tree sees.
COLUMNS = 0.4

EMAIL_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")

DOTTED = re.compile(r"(?<![0-9.])[0-9]++(?:\.[0-9]++){2,}+")
GROUPED = re.compile(r"(?<![0-9])\+?\(?[0-9](?:[\x20().-]{0,2}[0-9])++")
#: Characters of a run without white space that can still be an address: a local part of 64, @, a domain of 255.
LONGEST_ADDRESS = 320
#: Words that stand before personal data.
HINTS = {"email": ("mail", "contact", "write"), "ip": ("ip", "host", "address"), "card": ("card", "visa", "pay"),
         "phone": ("tel", "phone", "call", "fax", "mobile")}


def luhn(digits: str) -> bool:
    odd = digits[-1::-2]
    even = digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(c), 10)) for c in even)) % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or (len(part) == 3 and part <= "255")


def emails(text: str) -> list[Span]:
    """Leftmost matches; the local part is read backwards from each @, so long runs stay linear."""
    out, end = [], 0
    for m in EMAIL_DOMAIN.finditer(text):
        start = m.start()
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < m.start():
            out.append(("email", start, m.end()))
            end = m.end()
    return out


def base_spans(text: str) -> list[Span]:
    out = emails(text) if "@" in text else []
    if DIGIT.search(text):
        out += [("ip", *m.span()) for m in IP.finditer(text) if all(map(_small, m.group().split(".")))]
        for m in CARD.finditer(text):
            digits = re.sub(r"[^0-9]", "", m.group())
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
        if "+" in text:
            out += [("phone", *m.span()) for m in PHONE.finditer(text)
                    if 9 <= sum(c.isdigit() for c in m.group()) <= 15]
    return in_order(out, KINDS)


def _around(text: str, at: int) -> tuple[int, int] | None:
    """The run without white space around a place, without signs at its end; None beyond the longest address."""
    a = b = at
    while a > 0 and not text[a - 1].isspace():
        a -= 1
        if at - a > LONGEST_ADDRESS:
            return None
    while b < len(text) and not text[b].isspace():
        b += 1
        if b - a > LONGEST_ADDRESS:
            return None
    while b > at and not text[b - 1].isalnum():
        b -= 1
    return a, b


def proposals(text: str) -> list[Span]:
    """Candidate spans with the kind that they may be; those of one kind may overlap another's."""
    out: list[Span] = []
    at = text.find("@")
    while at >= 0:
        run = _around(text, at)
        if run and run[0] < at < run[1] - 1 and ("email", *run) not in out[-1:]:
            out.append(("email", *run))
        at = text.find("@", at + 1)
    if DIGIT.search(text):
        out += [("ip", *m.span()) for m in DOTTED.finditer(text)
                if len(parts := m.group().split(".")) <= 8 and max(map(len, parts)) <= 5]
        for m in GROUPED.finditer(text):
            n = sum("0" <= c <= "9" for c in m.group())
            out += [("card", *m.span())] * (11 <= n <= 31) + [("phone", *m.span())] * (7 <= n <= 16)
    return out


def _around_words(text: str, a: int, b: int) -> tuple[str, str]:
    return text[max(0, a - 24):a], text[b:b + 8]


def hinted(text: str, span: Span) -> bool:
    """Whether a word that announces the kind stands before the span."""
    kind, a, b = span
    last = _around_words(text, a, b)[0].lower()
    return any(h in last for h in HINTS[kind])


def features(text: str, span: Span, hide: bool = False) -> list[float]:
    """Format and context; with ``hide`` without the trait by which the kind's pattern decides (-1, or as if absent)."""
    kind, a, b = span
    s = text[a:b]
    before, after = _around_words(text, a, b)
    if hide and kind == "phone":
        s = s.removeprefix("+")
    digits = "".join(c for c in s if "0" <= c <= "9")
    groups = [len(g) for g in re.findall(r"[0-9]+", s)]
    signs = [len(s), len(groups), max(groups, default=0), min(groups, default=0), *map(s.count, ".- ("), s.count("+")]
    if hide and kind == "card":
        signs = [-1] * len(signs)
    name, _, domain = s.partition("@") if kind == "email" else ("", "", "")
    large = sum(int(g) > 255 for g in re.findall(r"[0-9]{1,6}", s)) if kind == "ip" else 0
    return [*map(float, signs), len(digits), s.count("@"), float(kind == "card" and len(digits) > 1 and luhn(digits)),
            float(digits[:1] or -1), -1 if hide else large, len(name), -1 if hide else domain.count("."),
            sum(not (c in LOCAL or c == "@") for c in s) if kind == "email" else 0, float(domain[-3:].isalpha()),
            float(before[-1:].isspace() or not before), float(before[-1:].isalnum()), float(after[:1].isspace() or not after),
            float(after[:1].isalnum()), float(hinted(text, span)), sum(c.isdigit() for c in before + after)]


def example(text: str, span: Span, base: list[Span]) -> bool | None:
    """True for a match of the kind's pattern, False for a clear non-match, None for what can be neither."""
    kind, a, b = span
    over = {k for k, s, e in base if a < e and s < b}
    if kind in over or hinted(text, span):
        return True if kind in over else None
    s = text[a:b]
    groups = re.findall(r"[0-9]+", s)
    n = sum(map(len, groups))
    if over:
        return False
    if kind == "email":
        return False if any(not (c in LOCAL or c == "@") for c in s) or s.count("@") > 1 else None
    if kind == "ip":
        return False if len(groups) != 4 or not all(map(_small, groups)) else None
    if kind == "card":
        return False if not 12 <= n <= 19 or not luhn("".join(groups)) else None
    return False if not 9 <= n <= 15 or len(groups) < 3 else None


#: Length of ``features``.
WIDTH = 24


def labelled(docs: DataFrame) -> DataFrame:
    """The examples and counterexamples of all texts: kind, whether held out, features (``boosting.FEATURES``; held-out ones
    and half of the others with the trait hidden), example or counterexample, and how many are equal."""
    def run(part: pa.RecordBatch, texts: list[str]) -> dict:
        rows = []
        for t in texts:
            found = proposals(t)
            base = base_spans(t) if found else []
            for s in found:
                good = example(t, s, base)
                if good is not None:
                    key = xxhash.xxh3_64_intdigest(f"{s[0]}|{t[max(0, s[1] - 20):s[2] + 20]}".encode()) >> 1
                    held = key % 10 >= 7
                    x = np.array(features(t, s, held or key // 10 % 2 == 0), boosting.FEATURES)
                    rows.append((s[0], held, x.tobytes(), good))
        columns = zip(*rows, strict=True) if rows else [[]] * 4
        kinds = (pa.string(), pa.bool_(), pa.binary(), pa.bool_())
        return {n: pa.array(c, k) for n, c, k in zip(("kind", "held", "x", "y"), columns, kinds, strict=True)}
    found = map_blocks(docs, run, "kind string, held boolean, x binary, y boolean")
    return written(found.groupBy("kind", "held", "x", "y").agg(F.count(F.lit(1)).alias("n")), "personal-candidates")


def calibrated(score: np.ndarray, y: np.ndarray, precision: float) -> float:
    """The least score from which on the share of accepted candidates is at least the precision."""
    order = np.argsort(-score, kind="stable")
    share = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
    last = np.append(score[order][1:] != score[order][:-1], True)
    good = np.flatnonzero((share >= precision) & last)
    return float(score[order][good[-1]]) if len(good) and y.sum() else 2.0


def mid_gap(score: np.ndarray, threshold: float) -> float:
    """The threshold moved half way, in log-odds, to the next lower held-out score (none lies between), but not below 0.5."""
    lower = score[score < threshold]
    if threshold > 1 or not len(lower):
        return threshold
    odds = np.log([threshold / max(1 - threshold, 1e-12), max(lower.max(), 1e-12) / (1 - lower.max())])
    return min(threshold, max(0.5, float(1 / (1 + np.exp(-odds.mean())))))


def thresholds(held: DataFrame, models: dict[str, boosting.Boosted], precision: float) -> dict[str, float]:
    """``calibrated`` and ``mid_gap`` over all held-out candidates, by running sums from the best score down."""
    def run(batches):
        for part in batches:
            x, kinds = boosting.features_of(part, boosting.FEATURES, WIDTH), np.array(part.column("kind").to_pylist(), object)
            score = np.zeros(len(x))
            for kind, model in models.items():
                score[kinds == kind] = model.score(x[kinds == kind])
            yield pa.RecordBatch.from_pydict({"kind": part.column("kind"), "score": score, "y": part.column("y"), "n": part.column("n")})
    scored = held.filter(F.col("kind").isin(list(models))).mapInArrow(run, "kind string, score double, y boolean, n long").groupBy(
        "kind", "score").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("y"), F.col("n")).otherwise(0)).alias("good"))
    scored = written(scored, "personal-scores")
    curve = prefix_sums(scored, "score", {"n": F.sum("n"), "good": F.sum("good")}, ["kind"], descending=True)
    enough = (F.col("cum_good") / F.col("cum_n") >= precision) & (F.col("all_good") > 0)
    cuts = {r["kind"]: 2.0 if r["cut"] is None else r["cut"] for r in curve.groupBy("kind").agg(
        F.min(F.when(enough, F.col("score"))).alias("cut")).collect()}
    cut = F.element_at(F.create_map(*(F.lit(v) for item in cuts.items() for v in item)), F.col("kind"))
    lower = {r["kind"]: r["score"] for r in scored.filter(F.col("score") < cut).groupBy("kind").agg(
        F.max("score").alias("score")).collect()}
    return {kind: mid_gap(np.array([lower[kind]] if kind in lower else []), c) for kind, c in cuts.items()}


def fit_models(docs: DataFrame, precision: float = PRECISION) -> dict[str, tuple[boosting.Boosted, float]]:
    """By kind: trees and threshold."""
    rows = labelled(docs)
    n, held = F.col("n"), F.col("held")
    sizes = rows.groupBy("kind").agg(F.coalesce(F.sum(F.when(~held & F.col("y"), n)), F.lit(0)).alias("good"),
                                     F.coalesce(F.sum(F.when(~held & ~F.col("y"), n)), F.lit(0)).alias("other"),
                                     count_if(held).alias("held")).collect()
    kinds = [r["kind"] for r in sizes if min(r["good"], r["other"]) >= EXAMPLES and r["held"]]
    if not kinds:
        return {}
    models = boosting.fit_groups(rows.filter(~held & F.col("kind").isin(kinds)).drop("held"), WIDTH, columns=COLUMNS)
    cuts = thresholds(rows.filter(held), models, precision)
    return {kind: (models[kind], cuts[kind]) for kind in KINDS if kind in models}


def added(text: str, base: list[Span], models: dict) -> list[Span]:
    """Candidates above their kind's threshold that overlap nothing already found, best first."""
    found = [s for s in proposals(text) if s[0] in models]
    scored: list[tuple[float, Span]] = []
    for kind, (model, threshold) in models.items():
        mine = [s for s in found if s[0] == kind]
        if mine:
            score = model.score(np.array([features(text, s, True) for s in mine]))
            scored += [(p, s) for p, s in zip(score.tolist(), mine, strict=True) if p >= threshold]
    return disjoint([s for _, s in sorted(scored, key=lambda x: (-x[0], x[1][1], KINDS.index(x[1][0])))], base)


def find_personal(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", precision: float = PRECISION) -> DataFrame:
    """doc_id, base (spans of the patterns), spans (with those that the trees add)."""
    spark = prepared(df.sparkSession)
    docs = id_and_text(df, id_col, text_col)
    shared = spark.sparkContext.broadcast(fit_models(docs, precision))

    def scan(part: pa.RecordBatch, texts: list[str]) -> dict:
        bases, everything = [], []
        for t in texts:
            base = base_spans(t)
            spans = in_order(base + added(t, base, shared.value), KINDS)
            bases.append([{"kind": k, "start": s, "end": e} for k, s, e in base])
            everything.append([{"kind": k, "start": s, "end": e} for k, s, e in spans])
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        return {"doc_id": part.column("doc_id"), "base": pa.array(bases, kind), "spans": pa.array(everything, kind)}
    return map_blocks(docs, scan, f"doc_id long, base {SPANS}, spans {SPANS}")


def with_digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", *(count_of(F.col("base"), k).alias(f"n_{k}") for k in KINDS),
                        F.sha2(as_text(F.col("base")), 256).alias("base_sha256"),
                        as_text(F.col("spans")).alias("spans"))


def redact(text: str, spans: list[Span]) -> str:
    return cut_out(text, spans)

"""Secret scan: fixed patterns, and a randomness test battery under length-aware false-discovery control.

Candidates are maximal runs of ``[A-Za-z0-9+/_=-]`` of 20 characters or more. For each, the smallest usual encoding
that holds its characters is inferred, and its symbols are tested for randomness within that alphabet: a chi-squared
test of uniformity over symbols and over classes of symbols, a runs test about the middle of the alphabet, and lag-one
serial correlation. Fisher's sum of their logarithms is the battery's score; a score that random symbols reach once in
a thousand is not random and never a discovery.

The control asks the other way round: how often does ordinary writing score as low? Shorter runs are ordinary. Over all
documents Spark counts which symbol follows which in them and how often a run goes on, for each encoding (alphabets of one
case read letters of both). Writing drawn from these counts goes through the same battery at a grid of lengths; the
share of draws that score as low as a candidate, beyond the draws the tail of a normal fitted to the lower half of
the logarithms, is the candidate's p-value. It is combined by Fisher's rule with the chance that an ordinary run of the
encoding gets so long. The Benjamini-Hochberg procedure then runs in each band of lengths of each encoding, over the
candidates of all documents. Discoveries that overlap no pattern match are added as spans of kind ``random``.

Defined results: a null or empty text has no spans; null doc_ids and repeated rows each give their row; an empty table
gives no rows; candidates of equal score, encoding and length are discovered together or not at all; further columns are
ignored.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowwatch.llm.common import id_and_text, map_blocks, prepared, written
from flowwatch.llm.spans import SPANS, Span, as_text, count_of, cut_out, disjoint, in_order

KINDS = ("assign", "access", "hex", "random")
#: Shortest candidate; shorter runs are ordinary writing.
SHORTEST = 20
#: First lengths of the bands in which false discoveries are controlled.
BANDS = (20, 32, 48, 80)
#: Share of false discoveries, and the p-value under which the battery rejects randomness.
FALSE_DISCOVERIES, NOT_RANDOM = 0.01, 0.001
#: Step of the battery's score in histograms; lengths from the last one on count as that length.
STEP, LAST_LENGTH = 0.25, 512
#: Lengths at which ordinary writing is drawn, and draws at each. A candidate takes the next shorter length, where
#: ordinary writing scores lower, so its p-value is rather too large.
DRAW_LENGTHS, DRAWS = (20, 24, 28, 32, 40, 48, 64, 80, 112, 160, 256), 400
#: Assumed beside what is counted, so that few counts make no small p-values: successors of a symbol, nine in ten of them
#: evenly over its class and the rest over the alphabet; and characters of runs, with the share after which a run goes on.
EVEN, IN_CLASS, RUN_CHARS, RUN_GOES_ON = 200, 0.9, 500, 0.9

#: The patterns of the scan; letters of the names in either case.
ASSIGN = re.compile(
    r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"
    r"|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")

#: Encodings, the smallest alphabet first.
ALPHABETS = [(name, {c: i for i, c in enumerate(a)}) for name, a in (
    ("decimal", "0123456789"),
    ("hex", "0123456789abcdef"),
    ("hex_upper", "0123456789ABCDEF"),
    ("lower", "abcdefghijklmnopqrstuvwxyz"),
    ("upper", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("lower_digits", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("upper_digits", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64url", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
    ("any", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_="))]


SYMBOLS = ALPHABETS[-1][1]
N = len(SYMBOLS)
#: Classes of each alphabet's symbols: lower case, upper case, digits, signs.
CLASSES = [np.array([0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3 for c in a]) for _, a in ALPHABETS]
#: Byte to symbol (N elsewhere), and symbol to the set of encodings that hold it, as bits (all elsewhere).
CODE = np.full(256, N, np.uint8)
CODE[[ord(c) for c in SYMBOLS]] = range(N)
HOLDS = np.array([sum(1 << e for e, (_, a) in enumerate(ALPHABETS) if c in a) for c in SYMBOLS] + [(1 << 16) - 1], np.uint16)


class Candidate(NamedTuple):
    start: int
    end: int
    encoding: int
    step: int  # of the battery's score; -1 where the battery rejects randomness


def base_spans(text: str) -> list[Span]:
    out: list[Span] = []
    if ":" in text or "=" in text:
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [("hex", *m.span()) for m in HEX.finditer(text)]
    return in_order(out, KINDS)


def _upper_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def _chi2_tail(x: float, df: float) -> float:
    """Upper tail by the cube-root approximation."""
    if df <= 0 or x <= 0:
        return 1.0
    return _upper_tail(((x / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df)))


def uniformity(x: np.ndarray, size: int) -> float:
    """Chi-squared over the alphabet; few characters a cell, so its exact moments scale it to the tail's."""
    n = len(x)
    stat = size / n * float((np.bincount(x, minlength=size).astype(float) ** 2).sum()) - n
    spread = math.sqrt(2 * (size - 1) * (n - 1) / n)
    df = 2 * (size - 1)  # the tail of matching skewness
    return _chi2_tail((stat - (size - 1)) / spread * math.sqrt(2 * df) + df, df)


def class_balance(kinds: np.ndarray, alphabet: np.ndarray) -> float:
    """Chi-squared of lower case, upper case, digits and signs against their shares of the alphabet."""
    share = np.bincount(alphabet, minlength=4) / len(alphabet)
    seen = np.bincount(kinds, minlength=4)
    there = share > 0
    expected = len(kinds) * share[there]
    return _chi2_tail(float(((seen[there] - expected) ** 2 / expected).sum()), there.sum() - 1)


def runs(x: np.ndarray, size: int) -> float:
    """Two-sided runs test about the middle of the alphabet."""
    high = x >= size / 2
    a, b = int(high.sum()), int((~high).sum())
    n = a + b
    if not a or not b:
        return 2.0 ** (1 - n) if n < 1000 else 0.0
    mean = 1 + 2 * a * b / n
    var = (mean - 1) * (mean - 2) / (n - 1)
    count = 1 + int((high[1:] != high[:-1]).sum())
    return 1.0 if var <= 0 else 2 * _upper_tail(abs(count - mean) / math.sqrt(var))


def serial_correlation(x: np.ndarray) -> float:
    """Two-sided test of the lag-one correlation."""
    c = x - x.mean()
    total = float((c * c).sum())
    if total == 0:
        return 0.0
    n = len(x)
    return 2 * _upper_tail(abs(float((c[1:] * c[:-1]).sum()) / total + 1 / n) * math.sqrt(n))


def fisher(score: float, tests: int) -> float:
    """Combined p-value of a sum of -ln p; the tail of chi-squared with an even number of degrees in closed form."""
    return min(1.0, math.exp(-score) * sum(score ** i / math.factorial(i) for i in range(tests))) if score < 700 else 0.0


def battery(x: np.ndarray, encoding: int) -> float:
    """Fisher's sum of -ln p over the tests; low for random symbols."""
    classes = CLASSES[encoding]
    ps = (uniformity(x, len(classes)), class_balance(classes[x], classes), runs(x, len(classes)), serial_correlation(x))
    return -sum(math.log(min(1.0, max(p, 1e-300))) for p in ps)


def examine(start: int, word: str) -> Candidate:
    body = word.rstrip("=") or word
    letters = set(body)
    e = next(i for i, (_, a) in enumerate(ALPHABETS) if letters <= a.keys())
    score = battery(np.fromiter(map(ALPHABETS[e][1].__getitem__, body), np.int64, len(body)), e)
    tests = 4 if CLASSES[e].min() < CLASSES[e].max() else 3
    return Candidate(start, start + len(word), e, int(score / STEP) if fisher(score, tests) >= NOT_RANDOM else -1)


def candidates(text: str) -> list[Candidate]:
    return [examine(m.start(), m.group()) for m in CANDIDATE.finditer(text)]


def ordinary_counts(texts: list[str], piece: int = 1 << 22) -> np.ndarray:
    """Of runs shorter than candidates: how often each symbol follows each (N x N, runs joined), then by smallest
    encoding the runs and their characters. Bytes are counted in pieces; a run over a border is two."""
    out = np.zeros(N * N + 2 * len(ALPHABETS), np.int64)
    data = np.frombuffer("\n".join(texts).encode(), np.uint8)
    for at in range(0, len(data), piece):
        codes = CODE[data[at:at + piece]]
        edges = np.flatnonzero(np.diff(np.concatenate(([0], codes < N, [0])).astype(np.int8)))
        starts, ends = edges[::2], edges[1::2]
        short = ends - starts < SHORTEST
        for s, e in zip(starts[~short].tolist(), ends[~short].tolist(), strict=True):
            codes[s:e] = N
        starts, ends = starts[short], ends[short]
        if len(starts):
            kept = codes[codes < N].astype(np.int64)
            held = np.bitwise_and.reduceat(HOLDS[codes], starts).astype(np.int64)
            encoding = np.log2(held & -held).astype(np.int64)
            out += np.concatenate([np.bincount(kept[:-1] * N + kept[1:], minlength=N * N),
                                   np.bincount(encoding, minlength=len(ALPHABETS)),
                                   np.bincount(encoding, ends - starts, len(ALPHABETS)).astype(np.int64)])
    return out


class Ordinary:
    """Ordinary writing as counted: p-values of low scores of the battery."""

    def __init__(self, counts: np.ndarray):
        self.pairs = counts[:N * N].reshape(N, N)
        runs, chars = counts[N * N:].reshape(2, len(ALPHABETS))
        self.goes_on = (chars - runs + RUN_CHARS * RUN_GOES_ON) / (chars + RUN_CHARS)
        self.drawn = lru_cache(maxsize=None)(self._drawn)

    def follows(self, encoding: int) -> np.ndarray:
        """Counts of symbol pairs in the alphabet; an alphabet of one case reads letters of both."""
        alphabet = ALPHABETS[encoding][1]
        one = np.zeros((N, len(alphabet)))
        for i, c in enumerate(SYMBOLS):
            at = alphabet.get(c, alphabet.get(c.swapcase()))
            if at is not None:
                one[i, at] = 1
        return one.T @ self.pairs @ one

    def _drawn(self, encoding: int, length: int) -> np.ndarray:
        """Sorted logarithms of scores of drawn writing."""
        same = CLASSES[encoding][:, None] == CLASSES[encoding]
        follows = self.follows(encoding) + EVEN * (IN_CLASS * same / same.sum(1, keepdims=True) + (1 - IN_CLASS) / len(same))
        rng = np.random.default_rng([encoding, length])
        after = (follows / follows.sum(1, keepdims=True)).cumsum(1)
        x = np.empty((DRAWS, length), np.int64)
        x[:, 0] = rng.choice(len(follows), DRAWS, p=follows.sum(1) / follows.sum())
        for i in range(1, length):
            x[:, i] = np.minimum((after[x[:, i - 1]] < rng.random((DRAWS, 1))).sum(1), len(follows) - 1)
        return np.sort(np.log([max(battery(row, encoding), 0.01) for row in x]))

    def p_value(self, encoding: int, length: int, step: int) -> float:
        """Chance that an ordinary candidate is so long and scores below the end of the step."""
        logs = self.drawn(encoding, max(n for n in DRAW_LENGTHS if n <= length))
        bar, middle = math.log((step + 1) * STEP), float(np.median(logs))
        below = logs[logs <= middle] - middle
        spread = max(math.sqrt(float((below ** 2).mean())), 1e-6)
        low = max(_upper_tail((middle - bar) / spread), np.searchsorted(logs, bar, "right") / len(logs))
        both = -math.log(max(low, 1e-300)) - (length - SHORTEST) * math.log(self.goes_on[encoding])
        return fisher(both, 2)


def band(length: int) -> int:
    return sum(length >= b for b in BANDS) - 1


def discoveries(p: np.ndarray, count: np.ndarray, rate: float) -> float:
    """Benjamini-Hochberg over tied p-values with counts: the largest p-value that is a discovery, or -1."""
    order = np.argsort(p, kind="stable")
    p, seen = p[order], np.cumsum(count[order])
    good = np.flatnonzero(p * seen[-1] <= rate * seen) if len(p) else []
    return float(p[good[-1]]) if len(good) else -1.0


class Thresholds(NamedTuple):
    """Last step of the score that is a discovery, by encoding and length."""

    last: dict[tuple[int, int], int]

    def holds(self, encoding: int, length: int, step: int) -> bool:
        return 0 <= step <= self.last.get((encoding, min(length, LAST_LENGTH)), -1)

    def pick(self, found: list[Candidate], base: list[Span]) -> list[Span]:
        return disjoint([("random", c.start, c.end) for c in found if self.holds(c.encoding, c.end - c.start, c.step)], base)


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id, base spans, candidates (start, end, encoding, step); the first row of a block of texts also holds the
    block's counts of ordinary writing."""
    def scan(part: pa.RecordBatch, texts: list[str]) -> dict:
        base, found = [], []
        for t in texts:
            base.append([{"kind": k, "start": s, "end": e} for k, s, e in base_spans(t)])
            found.append([c._asdict() for c in candidates(t)])
        counts = ordinary_counts(texts)
        cells = np.flatnonzero(counts)
        seen = [[{"cell": c, "n": n} for c, n in zip(cells.tolist(), counts[cells].tolist(), strict=True)]]
        span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
        one = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("encoding", pa.int32()), ("step", pa.int32())])
        cell = pa.struct([("cell", pa.int32()), ("n", pa.int64())])
        return {"doc_id": part.column("doc_id"), "base": pa.array(base, pa.list_(span)),
                "found": pa.array(found, pa.list_(one)),
                "cells": pa.array(seen + [None] * (len(texts) - 1), pa.list_(cell))}
    return map_blocks(docs, scan, f"doc_id long, base {SPANS}, found array<struct<start:long,end:long,encoding:int,step:int>>, "
                                  "cells array<struct<cell:int,n:long>>")


def fit_ordinary(scan: DataFrame) -> Ordinary:
    """From the counts of all documents (at most N * N + 2 numbers an encoding)."""
    counts = np.zeros(N * N + 2 * len(ALPHABETS), np.int64)
    for r in scan.select(F.explode("cells").alias("c")).groupBy("c.cell").agg(F.sum("c.n").alias("n")).collect():
        counts[r["cell"]] = r["n"]
    return Ordinary(counts)


def fit_thresholds(scan: DataFrame, rate: float = FALSE_DISCOVERIES) -> Thresholds:
    """Benjamini-Hochberg in each band of each encoding, from a histogram of all candidates (at most encodings x
    lengths x steps below the battery's own limit)."""
    ordinary = fit_ordinary(scan)
    length = F.least(F.col("c.end") - F.col("c.start"), F.lit(LAST_LENGTH))
    families = defaultdict(list)
    for r in (scan.select(F.explode("found").alias("c"))
              .groupBy("c.encoding", length.alias("length"), "c.step").count().collect()):
        p = ordinary.p_value(r["encoding"], r["length"], r["step"]) if r["step"] >= 0 else 1.0
        families[r["encoding"], band(r["length"])].append((p, r["count"], r["length"], r["step"]))
    last: dict[tuple[int, int], int] = {}
    for (encoding, _), cells in families.items():
        most = discoveries(np.array([c[0] for c in cells]), np.array([c[1] for c in cells]), rate)
        for p, _, n, step in cells:
            if step >= 0 and p <= most:
                last[encoding, n] = max(step, last.get((encoding, n), -1))
    return Thresholds(last)


def find_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 rate: float = FALSE_DISCOVERIES) -> DataFrame:
    """doc_id, base (spans of the patterns), spans (with those that the battery adds)."""
    prepared(df.sparkSession)
    scan = written(scanned(id_and_text(df, id_col, text_col)), "secret-scan")
    thresholds = fit_thresholds(scan, rate)

    def pick(batches):
        for batch in batches:
            rows = []
            for base, found in zip(batch.column("base").to_pylist(), batch.column("found").to_pylist(), strict=True):
                old = [(s["kind"], s["start"], s["end"]) for s in base]
                good = thresholds.pick([Candidate(**c) for c in found], old)
                rows.append([{"kind": k, "start": s, "end": e} for k, s, e in in_order(old + good, KINDS)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("base"),
                                              pa.array(rows, batch.schema.field("base").type)], ["doc_id", "base", "spans"])
    return scan.drop("cells").mapInArrow(pick, f"doc_id long, base {SPANS}, spans {SPANS}")


def with_digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", *(count_of(F.col("base"), k).alias(f"n_{k}") for k in KINDS[:3]),
                        F.sha2(as_text(F.col("base")), 256).alias("base_sha256"),
                        as_text(F.col("spans")).alias("spans"))


def redacted(df: DataFrame, text_col: str = "text", rate: float = FALSE_DISCOVERIES) -> DataFrame:
    """The same rows with each secret replaced by a mask; a null text stays null."""
    prepared(df.sparkSession)
    narrow = df.select(F.lit(None).cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    thresholds = fit_thresholds(written(scanned(narrow).filter("size(found) > 0 or cells is not null"), "secret-scan"), rate)

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            out = []
            for t in batch.column(at).to_pylist():
                if t:
                    base = base_spans(t)
                    spans = base + thresholds.pick(candidates(t), base)
                    t = cut_out(t, spans) if spans else t
                out.append(t)
            yield batch.set_column(at, batch.schema.field(at), pa.array(out, batch.schema.field(at).type))
    return df.mapInArrow(run, df.schema)

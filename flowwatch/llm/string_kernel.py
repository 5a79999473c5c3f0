"""Language identification by string kernels.

A text is the set of byte n-grams of lengths one to three of its lower-cased letters (a blended-spectrum presence
kernel): ``k(x, z) = |x & z| / sqrt(|x| |z|)``, over the n-grams of the landmark texts. The landmarks, some of each
language, give a Nyström map; kernel ridge regression, one language against the rest, is solved on the mapped sample.
Tasks score blocks of documents as matrix products: presence x landmarks x weights.

Landmarks and fit rows are samples of the labelled rows, drawn by a hash of doc_id, with bounds a language
(``LANDMARKS``, ``FIT_ROWS``, about). Landmarks have a range of lengths: texts of that range come first, then windows of longer
texts, then shorter texts joined, so every labelled language has some. Every document is scored whole.

A prediction is recognised if the lead of the best language over the second and the share of the text's three-byte n-grams that
the landmarks have reach limits calibrated on every fifth sampled row, which is not fitted. The score of a recognised text is
0.25 or more, of another one less.

Defined results: a null text, or one without a letter, is ``und`` with score 0; a null doc_id is not learned from and has
held_out null; repeated rows each give their row; an empty table gives no rows; without any labelled rows that have a
letter every prediction is ``und``; further columns are ignored.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flowwatch.llm.common import blocks, prepared, small_side, written

UNKNOWN = "und"
#: Landmarks and fit rows of a language, and the lengths of landmark texts.
LANDMARKS, FIT_ROWS, LANDMARK_CHARS = 32, 800, (200, 20_000)
RIDGE = 1.0
#: Every so many sampled rows of a language calibrate the limits; the quantile of theirs that the limits are set by, and the part of it
#: that is enough; the score from which on a language is recognised.
CALIBRATE, QUANTILE, SLACK, RECOGNISED = 5, 0.01, 0.8, 0.25
#: Documents of one matrix product.
ROWS = 192

LETTER = regex.compile(r"\p{L}")
#: ASCII letters in lower case, other ASCII as blanks, the rest of UTF-8 as it is.
FOLD = bytes(c if c >= 128 else ord(chr(c).lower()) if chr(c).isalpha() else 32 for c in range(256))


def folded(text: str) -> np.ndarray:
    return np.frombuffer(b" " + text.encode("utf-8", "surrogatepass").translate(FOLD) + b" ", np.uint8)


def grams(raw: np.ndarray) -> list[np.ndarray]:
    """Packed n-grams of lengths 1, 2 and 3 at each place."""
    one = raw.astype(np.uint32)
    two = one[:-1] << np.uint32(8) | one[1:]
    three = two[:-1] << np.uint32(8) | one[2:]
    return [one, two, three]


class Spectrum(NamedTuple):
    """N-grams of the landmarks, by length; they number the columns of presence rows."""

    known: tuple[np.ndarray, np.ndarray, np.ndarray]

    @property
    def width(self) -> int:
        return sum(map(len, self.known))

    @classmethod
    def of(cls, texts: list[str]) -> Spectrum:
        lists = [grams(folded(t)) for t in texts]
        return cls(tuple(np.unique(np.concatenate([g[k] for g in lists])) for k in range(3)))

    def tables(self) -> list[np.ndarray]:
        """For each length, from a packed n-gram to its column; the last column takes what is unknown."""
        kind = np.uint16 if self.width < 65535 else np.uint32
        out, first = [], 0
        for k, known in enumerate(self.known):
            table = np.full(1 << 8 * (k + 1), self.width, kind)
            table[known] = np.arange(first, first + len(known))
            first += len(known)
            out.append(table)
        return out

    def presence(self, texts: list[str], tables: list[np.ndarray]) -> np.ndarray:
        return self.seen(texts, tables)[0]

    def seen(self, texts: list[str], tables: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Presence rows, and the known share of each text's three-byte n-grams that are not all blank."""
        known = np.zeros(len(texts))
        flags = np.zeros((len(texts), self.width + 1), bool)
        for i, (row, t) in enumerate(zip(flags, texts, strict=True)):
            for g, table in zip(grams(folded(t)), tables, strict=True):
                columns = table[g]
                row[columns] = True
            written_in = g != 0x202020
            known[i] = (columns[written_in] < self.width).mean() if written_in.any() else 0.0
        return flags[:, :-1].astype(np.float32), known


class KernelModel(NamedTuple):
    langs: tuple[str, ...]
    spectrum: Spectrum
    landmarks: np.ndarray  # n-grams x landmarks, each column scaled by the root of its size
    weights: np.ndarray    # landmarks and a constant x languages
    limits: tuple[float, float] = (0.0, 0.0)  # least lead and known share

    def kernel(self, texts: list[str], tables: list[np.ndarray]) -> np.ndarray:
        return self.measured(texts, tables)[0]

    def measured(self, texts: list[str], tables: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        p, known = self.spectrum.seen(texts, tables)
        return (p @ self.landmarks) / np.sqrt(np.maximum(p.sum(1, keepdims=True), 1)), known

    def predict(self, texts: list[str], tables: list[np.ndarray]) -> tuple[list[str], np.ndarray]:
        kernel, known = self.measured(texts, tables)
        f = kernel @ self.weights[:-1] + self.weights[-1]
        best, raw = f.argmax(1), (np.clip(f.max(1), -1, 1) + 1) / 2
        own = np.ones(len(texts))
        for value, limit in zip((lead(f), known), self.limits, strict=True):
            if limit > 0:
                own = np.minimum(own, value / limit)
        score = np.where(own < 1, np.minimum(raw, np.nextafter(RECOGNISED, 0)) * np.maximum(own, 0), np.maximum(raw, RECOGNISED))
        return [self.langs[i] for i in best], score


def lead(outputs: np.ndarray) -> np.ndarray:
    """The best output over the second; of a single language without bound."""
    if outputs.shape[1] < 2:
        return np.full(len(outputs), np.inf)
    top = np.partition(outputs, -2, axis=1)
    return top[:, -1] - top[:, -2]


def remainder(doc_id: str) -> Column:
    """crc32 of the id as text, modulo 3."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3


def landmark_texts(sample: DataFrame, landmarks: int) -> list[str]:
    """Of each language: texts of ``LANDMARK_CHARS``, windows of longer ones, shorter ones joined, in this order."""
    least, most = LANDMARK_CHARS
    size = F.length("text")
    window = F.expr(f"IF(length(text) > {most}, substring(text, greatest(regexp_instr(text, r'\\p{{L}}'), 1), {most}), text)")
    rows = sample.select("lang", window.alias("text"), "dice", "doc_id",
                         F.when(size > most, 1).when(size < least, 2).otherwise(0).alias("kind"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("kind", "dice", "doc_id", "text"))
    got = rows.withColumn("k", place).filter((F.col("k") <= landmarks) | (F.col("kind") == 2)).orderBy("lang", "k").collect()
    out: dict[str, list[str]] = {}
    pieces: dict[str, list[str]] = {}
    for r in got:
        mine, held = out.setdefault(r["lang"], []), pieces.setdefault(r["lang"], [])
        if len(mine) == landmarks:
            continue
        if r["kind"] < 2:
            mine.append(r["text"])
            continue
        held.append(r["text"])
        if sum(map(len, held)) >= least:
            mine.append(" ".join(held))
            held.clear()
    for lang, held in pieces.items():
        if held and len(out[lang]) < landmarks:
            out[lang].append(" ".join(held))
    return [t for lang in sorted(out) for t in out[lang]]


def fit(docs: DataFrame, landmarks: int = LANDMARKS, fit_rows: int = FIT_ROWS, ridge: float = RIDGE) -> KernelModel | None:
    """From rows (doc_id, text, lang) that may be learned from."""
    spark = docs.sparkSession
    usable = docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull()
                         & F.col("text").rlike(r"\p{L}") & (remainder("doc_id") != 1))
    sizes = written(usable.groupBy("lang").count(), "languages")
    n_langs = sizes.count()
    dice = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    sample = written(usable.join(small_side(sizes, n_langs), "lang")
                     .withColumn("dice", dice * F.col("count")).filter(F.col("dice") < fit_rows), "language-sample")
    turn = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id", "text"), "doc_id", "text"))
    sample = written(sample.withColumn("apart", turn % CALIBRATE == 0), "language-parts")
    marks = landmark_texts(sample.filter("NOT apart"), landmarks)
    if not marks:
        return None
    langs = tuple(sorted(r["lang"] for r in sizes.collect()))
    spectrum = Spectrum.of(marks)
    tables = spectrum.tables()
    columns = spectrum.presence(marks, tables)
    scaled = (columns / np.sqrt(columns.sum(1, keepdims=True))).T
    first = KernelModel(langs, spectrum, np.ascontiguousarray(scaled), np.eye(len(marks), dtype=np.float32))
    shared = spark.sparkContext.broadcast(first)

    def rows(batches):
        for part, texts in blocks(batches):
            tables = shared.value.spectrum.tables()
            for at in range(0, len(texts), ROWS):
                k, known = shared.value.measured(texts[at:at + ROWS], tables)
                yield pa.RecordBatch.from_pydict({"lang": part.column("lang").slice(at, ROWS),
                                                  "apart": part.column("apart").slice(at, ROWS), "known": pa.array(known),
                                                  "k": pa.array(list(k.astype(float)), pa.list_(pa.float64()))})
    found = sample.select("lang", "text", "apart").mapInArrow(
        rows, "lang string, apart boolean, known double, k array<double>").collect()
    got = [r for r in found if not r["apart"]]
    number = {x: i for i, x in enumerate(langs)}
    kernel = np.array([r["k"] for r in got])
    target = np.full((len(got), len(langs)), -1.0)
    target[np.arange(len(got)), [number[r["lang"]] for r in got]] = 1
    own, vectors = np.linalg.eigh(first.kernel(marks, tables).astype(float))
    good = own > 1e-6 * own.max()
    root = vectors[:, good] / np.sqrt(own[good])  # Nyström map: kernel @ root
    phi = np.c_[kernel @ root, np.ones(len(kernel))]
    solved = np.linalg.solve(phi.T @ phi + ridge * np.eye(phi.shape[1]), phi.T @ target)
    weights = np.r_[root @ solved[:-1], solved[-1:]].astype(np.float32)
    return first._replace(weights=weights, limits=calibrated(weights, langs, [r for r in found if r["apart"]]))


def calibrated(weights: np.ndarray, langs: tuple[str, ...], rows: list) -> tuple[float, float]:
    """Limits of lead and known share from labelled rows that were not fitted and that get their own language."""
    if not rows:
        return 0.0, 0.0
    f = np.array([r["k"] for r in rows]) @ weights[:-1] + weights[-1]
    right = np.array([langs[i] == r["lang"] for i, r in zip(f.argmax(1), rows, strict=True)])
    if not right.any():
        return 0.0, 0.0
    known = np.array([r["known"] for r in rows])[right]
    margin = lead(f)[right]
    return (SLACK * float(np.quantile(margin, QUANTILE)) if len(langs) > 1 else 0.0), SLACK * float(np.quantile(known, QUANTILE))


def _predictor(model: KernelModel | None):
    """Predictions of a block of texts; built once a task."""
    tables = model.spectrum.tables() if model else None

    def predict(texts: list[str]) -> tuple[list[str], np.ndarray]:
        preds, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        rows = [i for i, t in enumerate(texts) if model and LETTER.search(t)]
        for at in range(0, len(rows), ROWS):
            some = rows[at:at + ROWS]
            names, own = model.predict([texts[i] for i in some], tables)
            scores[some] = own
            for i, name in zip(some, names, strict=True):
                preds[i] = name
        return preds, scores
    return predict


def identify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
             landmarks: int = LANDMARKS, fit_rows: int = FIT_ROWS, ridge: float = RIDGE) -> DataFrame:
    """doc_id, held_out, lang_pred, score; ``lang`` is read only where doc_id's remainder is not 1."""
    spark = prepared(df.sparkSession)
    docs = _narrow(df, id_col, text_col, lang_col)
    shared = spark.sparkContext.broadcast(fit(docs, landmarks, fit_rows, ridge))

    def run(batches):
        predict = _predictor(shared.value)
        for part, texts in blocks(batches):
            preds, scores = predict(texts)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(preds, pa.string()), pa.array(scores)],
                                             ["doc_id", "lang_pred", "score"])
    return (docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")
            .select("doc_id", (remainder("doc_id") == 1).alias("held_out"), "lang_pred", "score"))


def _narrow(df: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    return df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"),
                     F.col(f"`{lang_col}`").cast("string").alias("lang"))


def recognised_rows(df: DataFrame, least_score: float = RECOGNISED, id_col: str = "doc_id", text_col: str = "text",
                    lang_col: str = "lang") -> DataFrame:
    """The rows whose language is recognised with at least the score, with all their columns; a null ``lang`` is
    filled with the prediction."""
    spark = prepared(df.sparkSession)
    shared = spark.sparkContext.broadcast(fit(_narrow(df, id_col, text_col, lang_col)))

    def run(batches):
        predict = _predictor(shared.value)
        for part, texts in blocks(batches, text_col):
            preds, scores = predict(texts)
            keep = pa.array([p != UNKNOWN and s >= least_score for p, s in zip(preds, scores, strict=True)], pa.bool_())
            at = part.schema.get_field_index(lang_col)
            field = part.schema.field(at)
            filled = pc.coalesce(part.column(at), pa.array(preds, field.type))
            yield part.set_column(at, field, filled).filter(keep)
    return df.mapInArrow(run, df.schema)

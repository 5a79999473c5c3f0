"""Quality rules: counts of words, symbols and repetition, and perplexity bands of a Kneser-Ney language model.

The model is modified Kneser-Ney over bytes (five-grams by default), one for each language of the ``lang`` column
(null is a language of its own), counted over all documents: tasks count the n-grams of blocks of texts, Spark sums them;
the lower orders' continuation counts, the counts of counts, the discounts and the back-off weights are aggregates
of that table. N-grams found fewer than ``LEAST_COUNT`` times in their language are left to the back-off, whose weight takes
up their mass, so probabilities still sum to one. The table of n-grams grows with the corpus and stays distributed: joins give
each n-gram its probability, and each block of documents gets those of its distinct n-grams by a join.

A document's perplexity is taken per byte of its lower-cased text. Each language has a lower and an upper band about
the median log perplexity of its documents that pass the rules; documents outside are rejected.

Defined results: a null or empty text has zero counts and fails the rules (fewer than 50 words); null doc_ids and repeated
rows each give their row; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from flowwatch.llm.common import blocks, prepared, small_side, written, written_in_buckets
from flowwatch.llm.shingles import mixed

ORDER = 5
#: N-grams found fewer times in their language are left to the back-off; a document's own singular n-grams then don't
#: speak for it.
LEAST_COUNT = 2
#: Width of the bands: so many times the distance from the median to the quartile on that side, and at least so much.
WIDTH, LEAST_WIDTH = 8.0, 0.75
BLOCK_BYTES = 1_000_000
#: Bytes of text whose distinct n-grams are joined to the table together.
JOIN_BYTES = 32_000_000
#: Documents of a block that are scored together.
SCORED_ROWS = 500
#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
NO_LANGUAGE = "\x00"


class Counts(NamedTuple):
    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int


def text_counts(text: str) -> Counts:
    words = text.encode("utf-8", "surrogatepass").split()
    blanks = sum(text.count(c) for c in " \t\n\v\f\r")
    symbols = sum(text.count(c) for c in SYMBOLS)
    dup = 0
    if "\n" in text:
        lines = [x for x in text.split("\n") if x.strip(" \t\v\f\r")]
        dup = len(lines) - len(set(lines))
    return Counts(len(words), len(text) - blanks, symbols, dup, repeated_words(words))


def repeated_words(words: list[bytes]) -> int:
    """Words inside three-word windows that occur twice or more."""
    n = len(words) - 2
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    window = mixed(mixed(mixed(h[:-2]) + h[1:-1]) + h[2:])
    order = np.argsort(window, kind="stable")
    same = window[order][1:] == window[order][:-1]
    if not same.any():
        return 0
    again = np.zeros(n, bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[k:n + k] |= again
    return int(covered.sum())


def packed_grams(texts: list[str], order: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram that ends at each byte of each text, packed, with zero bytes before its start; and each text's end."""
    raw = [t.encode("utf-8", "surrogatepass").lower() for t in texts]
    pad = bytes(order - 1)
    flat = np.frombuffer(pad + pad.join(raw), np.uint8).astype(np.uint64)
    key = np.zeros(len(flat), np.uint64)
    for k in range(order):
        key[k:] |= flat[:len(flat) - k] << np.uint64(8 * k)
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    ends = np.cumsum(sizes)
    keep = np.ones(len(flat), bool)
    starts = np.cumsum(sizes + order - 1) - sizes
    keep[(starts[:, None] - np.arange(1, order)).ravel()] = False
    return key[keep], ends


def block_grams(docs: DataFrame, order: int) -> DataFrame:
    """block, lang, gram, n: counts of the highest order by block of documents; a block cut by tasks has several counts."""
    def run(batches):
        held: dict[str, list] = {}
        now = None

        def emit():
            for lang, parts in held.items():
                keys, codes = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
                n = np.bincount(codes, np.concatenate([n for _, n in parts])).astype(np.int64)
                for at in range(0, len(keys), 200_000):
                    k = keys[at:at + 200_000].view(np.int64)
                    yield pa.RecordBatch.from_pydict({"block": pa.array([now] * len(k), pa.int64()),
                                                      "lang": pa.array([lang] * len(k)), "gram": pa.array(k),
                                                      "n": pa.array(n[at:at + 200_000])})
        for part, texts in blocks(batches, chars=BLOCK_BYTES):
            by_lang: dict[tuple[int, str], list[str]] = {}
            for block, lang, t in zip(part.column("block").to_pylist(), part.column("lang").to_pylist(), texts, strict=True):
                by_lang.setdefault((block, lang), []).append(t)
            for (block, lang), mine in by_lang.items():
                if block != now:
                    yield from emit()
                    held, now = {}, block
                codes, keys = pd.factorize(packed_grams(mine, order)[0])
                held.setdefault(lang, []).append((keys, np.bincount(codes, minlength=len(keys))))
        yield from emit()
    return docs.select("block", "text", "lang").mapInArrow(run, "block long, lang string, gram long, n long")


def _discount(n: str) -> F.Column:
    return F.when(F.col(n) == 1, F.col("d1")).when(F.col(n) == 2, F.col("d2")).otherwise(F.col("d3"))


def _shorter(k: int) -> F.Column:
    """The n-gram without the first of its k bytes."""
    return F.col("gram").bitwiseAND(F.lit((1 << 8 * (k - 1)) - 1))


def model_tables(counts: DataFrame, order: int, least_share: float, least_count: int) -> dict[int, tuple[DataFrame, DataFrame]]:
    """By order: (lang, gram, context, good, left) of all n-grams and (lang, context, all, kept, entries)."""
    grams, out = written(counts.groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams"), {}
    n_langs = grams.select("lang").distinct().count()
    for k in range(order, 0, -1):
        # counts of counts and discounts of this order
        ones = [F.sum(F.when(F.col("n") == i, 1).otherwise(0)).alias(f"n{i}") for i in (1, 2, 3, 4)]
        of_lang = grams.groupBy("lang").agg(*ones, F.sum("n").alias("total"))
        y = F.coalesce(F.try_divide(F.col("n1"), F.col("n1") + 2 * F.col("n2")), F.lit(0.5))
        step = lambda i: F.greatest(F.lit(0.0), F.least(F.lit(float(i)), F.coalesce(
            i - (i + 1) * y * F.try_divide(F.col(f"n{i + 1}"), F.col(f"n{i}")), F.lit(i / 2))))
        of_lang = small_side(written(of_lang.select("lang", step(1).alias("d1"), step(2).alias("d2"), step(3).alias("d3"),
                                                    F.greatest(least_share * F.col("total"), F.lit(least_count)).alias("least")),
                                     "discounts"), n_langs)
        rows = grams.join(of_lang, "lang").select(
            "lang", "gram", F.shiftright(F.col("gram"), 8).alias("context"), (F.col("n") >= F.col("least")).alias("good"),
            (F.col("n") - _discount("n")).alias("left"), "n")
        contexts = rows.groupBy("lang", "context").agg(
            F.sum("n").alias("all"), F.sum(F.when(F.col("good"), F.col("left")).otherwise(0.0)).alias("kept"),
            F.sum(F.col("good").cast("int")).alias("entries"))
        out[k] = rows.drop("n"), contexts
        if k > 1:
            grams = written(grams.groupBy("lang", _shorter(k).alias("gram")).agg(F.count("*").alias("n")), "grams")
    return out


def fit_model(docs: DataFrame, order: int = ORDER, least_share: float = 0.0, least_count: int = LEAST_COUNT) -> Model:
    """The model of a small corpus in memory."""
    counts = block_grams(docs.withColumn("block", F.lit(0).cast("long")), order)
    probs, backs = [], []
    for k, (rows, contexts) in model_tables(counts, order, least_share, least_count).items():
        contexts = contexts.filter("entries > 0")
        good = rows.filter("good").join(contexts, ["lang", "context"])
        probs.append((k, good.select("lang", "gram", (F.col("left") / F.col("all")).alias("value")).toPandas()))
        backs.append((k, contexts.select("lang", F.col("context").alias("gram"),
                                         (1 - F.col("kept") / F.col("all")).alias("value")).toPandas()))
    langs = sorted({x for _, t in probs for x in t["lang"].unique()})
    return Model(order, {x: i for i, x in enumerate(langs)}, *_hashed(probs, langs), *_hashed(backs, langs))


def log_probabilities(counts: DataFrame, order: int = ORDER, least_count: int = LEAST_COUNT) -> DataFrame:
    """lang, gram, cost: the negative log probability of every n-gram of the highest order that was counted. Shorter
    n-grams are ends of longer ones, so each finds its back-off in the table of the order below."""
    tables, lower = model_tables(counts, order, 0.0, least_count), None
    for k in range(1, order + 1):
        rows, contexts = tables[k]
        both = rows.join(contexts, ["lang", "context"]).select(
            "lang", "gram", F.when(F.col("good"), F.col("left") / F.col("all")).otherwise(0.0).alias("own"),
            (1 - F.col("kept") / F.col("all")).alias("back"), _shorter(k).alias("short"))
        if lower is None:
            p = both.select("lang", "gram", (F.col("own") + F.col("back") / 256).alias("p"))
        else:
            p = both.join(lower.withColumnRenamed("gram", "short"), ["lang", "short"]).select(
                "lang", "gram", (F.col("own") + F.col("back") * F.col("p")).alias("p"))
        lower = written(p, "probabilities")
    return lower.select("lang", "gram", (-F.log("p")).cast("float").alias("cost"))


def hash_keys(gram: np.ndarray, order: int | np.ndarray, lang: np.ndarray) -> np.ndarray:
    """One-to-one: five bytes of n-gram, the order and the language's number."""
    return mixed(gram.astype(np.uint64) | np.uint64(order) << np.uint64(40) | lang.astype(np.uint64) << np.uint64(44))


def _hashed(tables: list, langs: list[str]) -> tuple[np.ndarray, np.ndarray]:
    number = {x: i for i, x in enumerate(langs)}
    keys = np.concatenate([hash_keys(t["gram"].to_numpy(np.int64).view(np.uint64), k, t["lang"].map(number).to_numpy(np.int64))
                           for k, t in tables])
    values = np.concatenate([t["value"].to_numpy(np.float32) for _, t in tables])
    order = np.argsort(keys)
    return keys[order], values[order]


class Model(NamedTuple):
    """Discounted probabilities and back-off weights in arrays sorted by hash."""

    order: int
    langs: dict[str, int]
    keys: np.ndarray
    values: np.ndarray
    back_keys: np.ndarray
    back_values: np.ndarray

    @staticmethod
    def _find(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, missing: float) -> np.ndarray:
        if not len(keys):
            return np.full(len(wanted), missing)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[at] == wanted, values[at], missing)

    def probability(self, gram: np.ndarray, lang: np.ndarray, k: int | None = None) -> np.ndarray:
        """P(last byte | bytes before) of distinct packed n-grams."""
        k = self.order if k is None else k
        if k == 0:
            return np.full(len(gram), 1 / 256)
        short = gram & np.uint64((1 << 8 * (k - 1)) - 1)
        both, codes = np.unique(short | lang << np.uint64(44), return_inverse=True)
        lower = self.probability(both & np.uint64((1 << 44) - 1), both >> np.uint64(44), k - 1)[codes]
        own = self._find(self.keys, self.values, hash_keys(gram, k, lang), 0.0)
        back = self._find(self.back_keys, self.back_values, hash_keys(gram >> np.uint64(8), k, lang), 1.0)
        return own + back * lower

    def log_perplexity(self, texts: list[str], langs: list[str]) -> np.ndarray:
        """Mean negative log probability per byte; nan for an empty text."""
        grams, ends = packed_grams(texts, self.order)
        sizes = np.diff(ends, prepend=0)
        lang = np.fromiter((self.langs.get(x, len(self.langs)) for x in langs), np.uint64, len(langs))
        codes, keys = pd.factorize(grams | np.repeat(lang, sizes) << np.uint64(44))
        p = self.probability(keys & np.uint64((1 << 44) - 1), keys >> np.uint64(44)) if len(keys) else np.empty(0)
        sums = np.r_[0, np.cumsum(-np.log(p)[codes])] if len(keys) else np.zeros(1)
        with np.errstate(invalid="ignore", divide="ignore"):
            return (sums[ends] - sums[ends - sizes]) / sizes


COUNTED = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean"


def _counted(df: DataFrame, text_col: str, prefix: str, join_bytes: int) -> DataFrame:
    """The rows with their counts, a block of about ``join_bytes`` bytes of text and a place in it."""
    new = StructType.fromDDL(COUNTED + ", block long, place long")

    def run(batches):
        block, place, size = TaskContext.get().partitionId() << 32, 0, 0
        for part, texts in blocks(batches, text_col, BLOCK_BYTES):
            counts = [text_counts(t) for t in texts]
            failed = [c.n_words < 50 or 100 * c.n_repeat_words > 50 * c.n_words for c in counts]
            if size >= join_bytes:
                block, place, size = block + 1, 0, 0
            size += sum(map(len, texts))
            yield pa.RecordBatch.from_arrays(
                [*part.columns, *(pa.array(c, pa.int64()) for c in zip(*counts, strict=True)), pa.array(failed, pa.bool_()),
                 pa.array([block] * len(texts), pa.int64()), pa.array(range(place, place + len(texts)), pa.int64())],
                [*part.schema.names, *(prefix + f.name for f in new)])
            place += len(texts)
    return df.mapInArrow(run, StructType([*df.schema.fields, *(StructField(prefix + f.name, f.dataType) for f in new)]))


def block_scores(docs: pa.Table, grams: pa.Table, order: int) -> pa.Table:
    """block, place, log_perplexity of a block's texts from the costs of its distinct n-grams."""
    names = grams.column("lang").combine_chunks().dictionary_encode()
    names = names.combine_chunks() if isinstance(names, pa.ChunkedArray) else names
    number = {x: i for i, x in enumerate(names.dictionary.to_pylist())}
    keys = grams.column("gram").to_numpy().view(np.uint64) | names.indices.to_numpy().astype(np.uint64) << np.uint64(8 * order)
    keys, first = np.unique(keys, return_index=True)
    costs = grams.column("cost").to_numpy()[first].astype(float)
    places, scores = [], []
    for part in docs.select(["place", "lang", "text"]).combine_chunks().to_batches(max_chunksize=SCORED_ROWS):
        found, ends = packed_grams([t or "" for t in part.column("text").to_pylist()], order)
        sizes = np.diff(ends, prepend=0)
        lang = np.fromiter((number.get(x, len(number)) for x in part.column("lang").to_pylist()), np.uint64, part.num_rows)
        codes, wanted = pd.factorize(found | np.repeat(lang, sizes) << np.uint64(8 * order))
        if len(wanted):
            at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            if not len(keys) or (keys[at] != wanted).any():
                raise ValueError("an n-gram of a block is not among those counted")
            sums = np.r_[0, np.cumsum(costs[at][codes])]
        else:
            sums = np.zeros(1)
        with np.errstate(invalid="ignore", divide="ignore"):
            scores.append((sums[ends] - sums[ends - sizes]) / sizes)
        places.append(part.column("place").to_numpy())
    place = np.concatenate(places) if places else np.empty(0, np.int64)
    score = np.concatenate(scores) if scores else np.empty(0)
    block = docs.column("block")[0].as_py() if docs.num_rows else 0
    return pa.table({"block": pa.array([block] * len(place), pa.int64()), "place": pa.array(place, pa.int64()),
                     "log_perplexity": pa.array(score, pa.float64(), from_pandas=True)})


def with_scores(df: DataFrame, text_col: str, lang_col: str, prefix: str = "", order: int = ORDER,
                least_count: int = LEAST_COUNT, join_bytes: int = JOIN_BYTES) -> DataFrame:
    """The rows with their counts and log perplexity; ``prefix`` keeps the new names apart from the old."""
    rows = written_in_buckets(_counted(df, text_col, prefix, join_bytes), prefix + "block", "quality-rows")
    lang = F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit(NO_LANGUAGE)).alias("lang")
    docs = rows.select(F.col(prefix + "block").alias("block"), F.col(prefix + "place").alias("place"), lang,
                       F.col(f"`{text_col}`").cast("string").alias("text"))
    grams = written(block_grams(docs, order), "block-grams")
    costs = (grams.select(F.col("block").alias("of"), "lang", "gram")
             .join(log_probabilities(grams.drop("block"), order, least_count), ["lang", "gram"]))
    # the texts stay where they were written; only the costs travel
    found = written(docs.groupBy("block").cogroup(costs.groupBy("of")).applyInArrow(
        lambda texts, mine: block_scores(texts, mine, order), "block long, place long, log_perplexity double"), "quality-scores")
    found = found.select(*(F.col(c).alias(prefix + c) for c in found.columns))
    key = [prefix + "block", prefix + "place"]
    return rows.join(small_side(found, found.count()), key).drop(*key)


def bands(scores: DataFrame, width: float = WIDTH, least_width: float = LEAST_WIDTH) -> DataFrame:
    """lang, lower, upper: about the median of the documents that pass the rules."""
    q = scores.filter("NOT base_failed AND log_perplexity IS NOT NULL").groupBy("lang").agg(
        F.percentile_approx("log_perplexity", [0.25, 0.5, 0.75], 10_000).alias("q"))
    side = lambda a, b: F.greatest(F.lit(least_width), width * (F.col("q")[b] - F.col("q")[a]))
    return q.select("lang", (F.col("q")[1] - side(0, 1)).alias("lower"), (F.col("q")[1] + side(1, 2)).alias("upper"))


def _inside(scores: DataFrame, limits: DataFrame, lang: str, prefix: str = "") -> DataFrame:
    limits = limits.select(F.col("lang").alias("__lang"), F.col("lower").alias("__lower"), F.col("upper").alias("__upper"))
    inside = F.col(prefix + "log_perplexity").between(F.col("__lower"), F.col("__upper"))
    return (scores.join(small_side(limits, limits.count()), F.coalesce(F.col(lang), F.lit(NO_LANGUAGE)) == F.col("__lang"), "left")
            .withColumn(prefix + "kept", ~F.col(prefix + "base_failed") & F.coalesce(inside, F.lit(False))))


def _narrow(df: DataFrame, id_col: str | None, text_col: str, lang_col: str) -> DataFrame:
    lang = F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit(NO_LANGUAGE)).alias("lang")
    doc_id = F.col(f"`{id_col}`").cast("long") if id_col else F.lit(None).cast("long")
    return df.select(doc_id.alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"), lang)


def quality(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", order: int = ORDER,
            least_count: int = LEAST_COUNT, width: float = WIDTH, least_width: float = LEAST_WIDTH,
            join_bytes: int = JOIN_BYTES) -> DataFrame:
    """doc_id, the counts, base_failed, log_perplexity, kept."""
    prepared(df.sparkSession)
    docs = _narrow(df, id_col, text_col, lang_col)
    scores = with_scores(docs, "text", "lang", "", order, least_count, join_bytes).drop("text")
    limits = written(bands(scores, width, least_width), "bands")
    return _inside(scores, limits, "lang").select("doc_id", *Counts._fields, "base_failed", "log_perplexity", "kept")


def kept_rows(df: DataFrame, text_col: str = "text", lang_col: str = "lang", order: int = ORDER,
              least_count: int = LEAST_COUNT, width: float = WIDTH, least_width: float = LEAST_WIDTH,
              join_bytes: int = JOIN_BYTES) -> DataFrame:
    """The rows that the rules and the bands keep, with all their columns."""
    prepared(df.sparkSession)
    scores = with_scores(df, text_col, lang_col, "__", order, least_count, join_bytes)
    lang = F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit(NO_LANGUAGE)).alias("lang")
    limits = written(bands(scores.select(lang, F.col("__base_failed").alias("base_failed"),
                                         F.col("__log_perplexity").alias("log_perplexity")), width, least_width), "bands")
    return _inside(scores, limits, lang_col, "__").filter("__kept").select(*(F.col(f"`{c}`") for c in df.columns))

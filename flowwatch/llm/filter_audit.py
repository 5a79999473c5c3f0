"""How five filters interact: removals by every order of application, and Shapley shares by exact least squares.

Each document gets a five-bit mask of the filters that it fails. Four of them follow from the text alone; the fifth,
an exact copy of a text with a smaller doc_id, is counted without joining copies back to rows: rows are grouped by the
digest of their text, and of each group only the rows at its smallest doc_id pass. What leaves Spark's aggregation
is one row a part and mask. From these 32 counts of a part follow, exactly:

* v(S), the documents that the filters of S remove together, for all 32 coalitions S;
* the counts of each of the 120 orders as differences v(prefix + filter) - v(prefix);
* the Shapley values as the solution of least squares over all coalitions between the empty and the full one, weighted
  with the Shapley kernel, under the constraint that the values add up to v(all), solved in rationals.

Defined results: a null text is empty (and a copy of an empty one). A null doc_id is never smaller or larger, so it
fails no copy filter and makes no other row fail it. Rows that repeat a doc_id with one text are all at the smallest
doc_id or all not. A null part is the empty string. Labels are taken per doc_id; a doc_id with several label rows
counts as lost good (toxic) if any of them says so. An empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from fractions import Fraction
from functools import cache
from itertools import permutations
from math import comb

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flowwatch.llm.common import prepared, small_side, written

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
#: Words are runs of other characters than these, and the symbols of filter D.
BLANKS, SYMBOLS = r"[\x20\x09-\x0D]+", r"[#$%&*|]"
SCHEMA = ("part string, filter_order string, step int, filter string, kept long, removed long, redundant long, "
          "unique_fails long, good_lost long, toxic_lost long, shapley long")


def text_mask(text: Column, min_words: int, min_distinct: int, max_capitals: int) -> Column:
    """Bits 0 to 3: the filters that follow from the text. The distinct words are counted only where they matter: a
    text's words are split once."""
    words = F.filter(F.split(text, BLANKS), lambda w: w != "")

    def bits(own: Column) -> Column:
        n = F.size(own)
        capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
        fails = [n < min_words, 100 * F.size(F.array_distinct(own)) < min_distinct * n,
                 100 * capitals > max_capitals * F.length(text), text.rlike(SYMBOLS)]
        return sum((f.cast("int") * (1 << i) for i, f in enumerate(fails)), F.lit(0))
    return F.element_at(F.transform(F.array(words), bits), 1)


def mask_counts(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, part_col: str, min_words: int,
                min_distinct: int, max_capitals: int) -> DataFrame:
    """part, mask, n, good, toxic: documents by the filters that they fail, and those with labels among them."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text.alias("text"),
                       F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"))
    rows = (rows.select("doc_id", "part", F.sha2("text", 256).alias("digest"),
                        text_mask(F.col("text"), min_words, min_distinct, max_capitals).alias("mask"))
            .groupBy("doc_id", "part", "digest", "mask").agg(F.count("*").alias("n")))
    rows = written(rows, "filter-masks")
    marks = (labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
             .agg(F.max((F.col("quality") == 1).cast("int")).alias("good"),
                  F.max((F.col("toxic") == 1).cast("int")).alias("toxic")))
    known = rows.filter("doc_id IS NOT NULL").join(small_side(marks, marks.count()), "doc_id", "left").select(
        *rows.columns, F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
    # of each text by part and label: its rows, and the smallest doc_id with its rows
    texts = (known.groupBy("digest", "part", "mask", "good", "toxic")
             .agg(F.sum("n").alias("n"), F.min(F.struct("doc_id", "n")).alias("first")))
    # n at the smallest doc_id may come from several masks of one digest only if parts or labels differ
    least = F.min("first.doc_id").over(Window.partitionBy("digest"))
    later = F.col("n") - F.when(F.col("first.doc_id") == F.col("least"), F.col("first.n")).otherwise(0)
    split = texts.withColumn("least", least).select(
        "part", "good", "toxic",
        F.explode(F.array(F.struct(F.col("mask").alias("mask"), (F.col("n") - later).alias("n")),
                          F.struct((F.col("mask") + 16).alias("mask"), later.alias("n")))).alias("x"))
    nameless = rows.filter("doc_id IS NULL").select(
        "part", F.lit(0).alias("good"), F.lit(0).alias("toxic"), F.struct("mask", "n").alias("x"))
    return (split.unionByName(nameless).groupBy("part", F.col("x.mask").alias("mask"))
            .agg(F.sum("x.n").alias("n"), F.sum(F.col("x.n") * F.col("good")).alias("good"),
                 F.sum(F.col("x.n") * F.col("toxic")).alias("toxic")))


def coalition_removals(counts: list[int]) -> list[int]:
    """v(S) for all S as bit masks, from the number of documents by mask."""
    full = len(counts) - 1
    return [sum(n for mask, n in enumerate(counts) if mask & s) for s in range(full + 1)]


@cache
def kernel_system(size: int) -> tuple[tuple[tuple[int, ...], ...], tuple[Fraction, ...], tuple[tuple[Fraction, ...], ...]]:
    """Rows z_i - z_last, Shapley kernel weights and inverse normal matrix over the inner coalitions of ``size`` players;
    the last value follows from the constraint."""
    inner = range(1, (1 << size) - 1)
    rows = tuple(tuple((s >> i & 1) - (s >> size - 1 & 1) for i in range(size - 1)) for s in inner)
    weights = tuple(Fraction(size - 1, comb(size, k) * k * (size - k)) for k in (s.bit_count() for s in inner))
    normal = [[sum(w * r[i] * r[j] for w, r in zip(weights, rows, strict=True)) for j in range(size - 1)]
              for i in range(size - 1)]
    return rows, weights, tuple(map(tuple, inverse(normal)))


def inverse(matrix: list[list[Fraction]]) -> list[list[Fraction]]:
    """Of a regular matrix, by elimination in rationals."""
    n = len(matrix)
    work = [[Fraction(x) for x in row] + [Fraction(int(i == j)) for j in range(n)] for i, row in enumerate(matrix)]
    for i in range(n):
        pivot = next(r for r in range(i, n) if work[r][i])
        work[i], work[pivot] = work[pivot], work[i]
        work[i] = [x / work[i][i] for x in work[i]]
        for r in range(n):
            if r != i and work[r][i]:
                work[r] = [x - work[r][i] * y for x, y in zip(work[r], work[i], strict=True)]
    return [row[n:] for row in work]


def shapley_values(v: list[int]) -> list[Fraction]:
    """Constrained weighted least squares: the values phi that minimise the sum over inner coalitions S of
    weight(S) (v(S) - sum of phi over S)^2 while all values add up to v(all); v(empty) is 0."""
    size = (len(v) - 1).bit_length()
    rows, weights, inverted = kernel_system(size)
    right = [sum(w * r[i] * (v[s] - (v[-1] if s >> size - 1 & 1 else 0))
                 for s, (w, r) in enumerate(zip(weights, rows, strict=True), 1)) for i in range(size - 1)]
    head = [sum((a * b for a, b in zip(row, right, strict=True)), Fraction(0)) for row in inverted]
    return [*head, v[-1] - sum(head)]


def order_steps(counts: list[int], good: list[int], toxic: list[int]) -> list[tuple]:
    """(order, step, filter, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of all orders."""
    v, v_good, v_toxic = map(coalition_removals, (counts, good, toxic))
    shares = [x * len(ORDERS) for x in shapley_values(v)]
    if any(x.denominator != 1 for x in shares):
        raise ArithmeticError("a sum over orders is no whole number")
    out = []
    for order in ORDERS:
        before = 0
        for step, letter in enumerate(order, 1):
            i = FILTERS.index(letter)
            after = before | 1 << i
            removed = v[after] - v[before]
            out.append((order, step, letter, sum(counts) - v[after], removed, v[1 << i] - removed, counts[1 << i],
                        v_good[after] - v_good[before], v_toxic[after] - v_toxic[before], int(shares[i])))
            before = after
    return out


def _part_rows(group: pd.DataFrame) -> pd.DataFrame:
    """The rows of one part from its at most 32 mask counts."""
    columns = [[0] * (1 << len(FILTERS)) for _ in range(3)]
    for mask, *values in group[["mask", "n", "good", "toxic"]].astype("int64").itertuples(index=False):
        for column, value in zip(columns, values, strict=True):
            column[mask] = value
    rows = [(group["part"].iloc[0], *r) for r in order_steps(*columns)]
    return pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang",
          min_words: int = 100, min_distinct: int = 80, max_capitals: int = 10) -> DataFrame:
    """One row a part, order and step. Filters: A under ``min_words`` words, B less than ``min_distinct`` percent of them
    distinct, C more than ``max_capitals`` percent capitals A-Z, D one of ``#$%&*|``, E the text of a smaller doc_id.
    ``labels`` has doc_id, quality and toxic."""
    prepared(docs.sparkSession)
    counts = mask_counts(docs, labels, id_col, text_col, part_col, min_words, min_distinct, max_capitals)
    return counts.filter("n > 0").groupBy("part").applyInPandas(_part_rows, SCHEMA)


def oracle() -> str:
    """The same rows in SQL, order by order."""
    orders = ", ".join(f"('{o}')" for o in ORDERS)
    return rf"""
WITH texts AS (
  SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS part,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents),
marks AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good,
                 max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
least AS (SELECT text, min(doc_id) AS first_id FROM texts GROUP BY text),
flags AS (
  SELECT t.part, coalesce(m.good, 0) AS good, coalesce(m.toxic, 0) AS toxic,
         CASE WHEN len(words) < 100 THEN 'A' ELSE '' END
         || CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 'B' ELSE '' END
         || CASE WHEN 100 * length(regexp_replace(t.text, '[^A-Z]+', '', 'g')) > 10 * length(t.text) THEN 'C' ELSE '' END
         || CASE WHEN regexp_matches(t.text, '[#$%&*|]') THEN 'D' ELSE '' END
         || CASE WHEN t.doc_id > l.first_id THEN 'E' ELSE '' END AS fails
  FROM texts t JOIN least l ON l.text = t.text LEFT JOIN marks m ON m.doc_id = t.doc_id),
masks AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM flags GROUP BY part, fails),
orders(filter_order) AS (VALUES {orders}),
steps AS (SELECT filter_order, s.step, substr(filter_order, s.step, 1) AS filter,
                 substr(filter_order, 1, s.step - 1) AS earlier
          FROM orders, (VALUES (1), (2), (3), (4), (5)) AS s(step)),
hits AS (
  SELECT m.part, s.filter_order, s.step, s.filter, m.n, m.good, m.toxic,
         instr(m.fails, s.filter) > 0 AS fails_it,
         m.fails = s.filter AS only_it,
         m.fails <> '' AND translate(m.fails, s.earlier, '') <> m.fails AS gone
  FROM masks m, steps s),
counted AS (
  SELECT part, filter_order, step, filter,
         CAST(sum(CASE WHEN NOT gone AND NOT fails_it THEN n ELSE 0 END) AS BIGINT) AS kept,
         CAST(sum(CASE WHEN NOT gone AND fails_it THEN n ELSE 0 END) AS BIGINT) AS removed,
         CAST(sum(CASE WHEN gone AND fails_it THEN n ELSE 0 END) AS BIGINT) AS redundant,
         CAST(sum(CASE WHEN only_it THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
         CAST(sum(CASE WHEN NOT gone AND fails_it THEN good ELSE 0 END) AS BIGINT) AS good_lost,
         CAST(sum(CASE WHEN NOT gone AND fails_it THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost
  FROM hits GROUP BY part, filter_order, step, filter)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, filter, kept, removed, redundant, unique_fails, good_lost,
       toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley
FROM counted
"""

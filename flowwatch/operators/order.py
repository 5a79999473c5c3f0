"""Global order on distributed rows: hash cuts, dense indexes, prefix sums.

Nothing here sorts a whole table in one task, at any size. Rows are range-partitioned on their
whole sort key, so equal values spread too, and the numbered ranges are written once below the
shared folder: what reads them later, or again after a lost executor, sees the same numbers.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowwatch.functions.exprs import hash_key, q
from flowwatch.session import scratch_path

# Rows of an index block and, about, of a hash cell. Tests lower it to get many of them.
TASK_ROWS = 100_000
# Largest table that is sent to every executor or held on the driver.
SMALL_ROWS = 100_000


def small_rows(df: DataFrame, limit: int | None = None) -> list:
    """Collect a table that must stay small; a larger one is an error, not an OOM."""
    limit = limit or SMALL_ROWS
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"expected at most {limit} rows")
    return rows


def join_small(df: DataFrame, side: DataFrame, on: Sequence[str], how: str = "inner",
               limit: int | None = None) -> DataFrame:
    """Join a side table: broadcast when its counted size is small, shuffle otherwise."""
    limit = limit or SMALL_ROWS
    rows = side.limit(limit + 1).collect()
    if len(rows) > limit:
        return df.join(side, list(on), how)
    local = df.sparkSession.createDataFrame(rows, side.schema)
    return df.join(F.broadcast(local), list(on), how)


def many_range_splits(df: DataFrame, values: Sequence[Column], parts: int, n: int) -> list[list[float]]:
    """Inner boundaries of each value that cut ``n`` rows into about ``parts`` equal ranges.

    Boundaries only balance the work, so they come from a sample with about a
    thousand rows per range; every row is then placed by its own value.
    """
    if parts <= 1:
        return [[] for _ in values]
    probs = [i / parts for i in range(1, parts)]
    accuracy = max(10_000, 10 * parts)
    wanted = max(100_000, 1000 * parts)
    part = df.sample(wanted / n, seed=1) if n > 2 * wanted else df
    row = part.agg(*[F.percentile_approx(v, probs, accuracy).alias(f"b{i}") for i, v in enumerate(values)]).first()
    return [[float(b) for b in (row[f"b{i}"] or [])] for i in range(len(values))]


def range_splits(df: DataFrame, value: Column, parts: int, n: int) -> list[float]:
    return many_range_splits(df, [value], parts, n)[0]


def with_range_bucket(df: DataFrame, value: Column, splits: Sequence[float],
                      out: str = "bucket") -> DataFrame:
    """Bucket number of a value, by binary search over the boundaries."""
    inner = sorted({s for s in splits if math.isfinite(s)})
    if not inner:
        return df.withColumn(out, F.lit(0))
    edges = [-math.inf, *inner, math.inf]
    staged = df.withColumn("_bucket_in", value)
    cut = Bucketizer(splits=edges, inputCol="_bucket_in", outputCol="_bucket_out",
                     handleInvalid="keep").transform(staged)
    return cut.withColumn(out, F.col("_bucket_out").cast("int")).drop("_bucket_in", "_bucket_out")


def sorted_ranges(df: DataFrame, keys: Sequence[Column], drop: Sequence[str] = ()) -> DataFrame:
    """The rows in global order of ``keys``, written without the columns of ``drop``: ``_b`` numbers the ranges and ``_rn``
    (from 0) the rows of one."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    numbered = (df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
                .withColumn("_m", F.monotonically_increasing_id())
                .withColumn("_b", F.shiftright("_m", 33).cast("int"))
                .withColumn("_rn", F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))).drop("_m", *drop))
    path = scratch_path(spark, "ranges")
    numbered.write.parquet(path)
    return spark.read.schema(numbered.schema).parquet(path)


def class_key(by: Sequence[str]) -> Column:
    if not by:
        return F.lit("")
    parts = [F.coalesce(q(c).cast("string"), F.lit("\u0000")) for c in by]
    return F.concat_ws("\u0001", *parts)


def class_counts(df: DataFrame, by: Sequence[str]) -> dict[str, int]:
    """Row count per class, on the driver; the number of classes is checked."""
    grouped = df.groupBy(class_key(by).alias("k")).count()
    return {r["k"]: r["count"] for r in small_rows(grouped)}


def lookup(mapping: Mapping[str, object], key: Column, default=None) -> Column:
    """Literal lookup table of a checked, small mapping."""
    if not mapping:
        return F.lit(default)
    flat: list[Column] = []
    for k, v in mapping.items():
        flat += [F.lit(k), F.lit(v)]
    return F.element_at(F.create_map(*flat), key)


def hash_at_ranks(df: DataFrame, ranks: Mapping[str, Sequence[int]], id_col: str, seed, by: Sequence[str] = (),
                  n_rows: int | None = None) -> dict[tuple[str, int], str]:
    """Per class, the hashes at some 1-based ranks of the hash order.

    A histogram over hash prefixes finds the prefixes that hold the wanted ranks,
    and only rows with those prefixes are ranked: two passes, a tiny shuffle.
    """
    ranks = {k: sorted({int(r) for r in rs if r > 0}) for k, rs in ranks.items()}
    ranks = {k: rs for k, rs in ranks.items() if rs}
    if not ranks:
        return {}
    keyed = df.select(class_key(by).alias("k"), hash_key(id_col, seed).alias("h"))
    keyed = keyed.filter(F.col("k").isin(list(ranks))) if by else keyed
    wanted = F.lit(False)
    for k, rs in ranks.items():
        wanted = wanted | ((F.col("k") == k) & F.col("rn").isin(rs))
    n = keyed.count() if n_rows is None else n_rows
    # as many hex digits as leave about TASK_ROWS rows in a cell
    prefix = max(1, math.ceil(math.log(max(n / TASK_ROWS, 1), 16)))
    cell = F.substring("h", 1, prefix)
    upto = Window.partitionBy("k").orderBy("p").rowsBetween(Window.unboundedPreceding, 0)
    hist = keyed.groupBy("k", cell.alias("p")).agg(F.count(F.lit(1)).alias("n")).withColumn("upto", F.sum("n").over(upto))
    lists = lookup({k: ",".join(map(str, rs)) for k, rs in ranks.items()}, F.col("k"))
    inside = F.exists(F.split(lists, ","), lambda r: (r.cast("long") <= F.col("upto"))
                      & (r.cast("long") > F.col("upto") - F.col("n")))
    cells = {f"{r['k']}\u0001{r['p']}": int(r["upto"] - r["n"]) for r in small_rows(hist.filter(inside))}
    edge = keyed.withColumn("base", lookup(cells, F.concat_ws("\u0001", "k", cell))).filter("base IS NOT NULL")
    rank = F.row_number().over(Window.partitionBy("k", cell).orderBy("h")) + F.col("base")
    hits = edge.withColumn("rn", rank).filter(wanted)
    return {(r["k"], r["rn"]): r["h"] for r in small_rows(hits)}


def hash_cuts(df: DataFrame, quotas: Mapping[str, int], id_col: str, seed, by: Sequence[str] = (),
              n_rows: int | None = None) -> dict[str, str]:
    """Per class, the hash below or at which exactly ``quota`` rows lie.

    Applying the cut is a plain filter. A quota beyond the class size takes the
    whole class ("g" sorts after any hex digit).
    """
    quotas = {k: int(n) for k, n in quotas.items() if n > 0}
    found = hash_at_ranks(df, {k: [n] for k, n in quotas.items()}, id_col, seed, by, n_rows)
    return {k: found.get((k, n), "g") for k, n in quotas.items()}


def below_cut(cuts: Mapping[str, str], id_col: str, seed, by: Sequence[str] = ()) -> Column:
    """True for rows inside the quota found by :func:`hash_cuts`."""
    if not cuts:
        return F.lit(False)
    key = hash_key(id_col, seed)
    if not by:
        return key <= F.lit(cuts[""])
    return F.coalesce(key <= lookup(cuts, class_key(by)), F.lit(False))


def hash_take(df: DataFrame, n: int, id_col: str, seed) -> DataFrame:
    """Exactly ``min(n, rows)`` rows, chosen by hash order."""
    return df.filter(below_cut(hash_cuts(df, {"": n}, id_col, seed), id_col, seed)) if n > 0 else df.limit(0)


def hash_take_per_class(df: DataFrame, quotas: Mapping[str, int], id_col: str, seed,
                        by: Sequence[str]) -> DataFrame:
    cuts = hash_cuts(df, quotas, id_col, seed, by)
    return df.filter(below_cut(cuts, id_col, seed, by))


def hash_positions(df: DataFrame, id_col: str, seed, cols: Mapping[str, Column], out: str = "rank") -> DataFrame:
    """Chosen columns of each row with its 1-based place in the hash order, as :func:`hash_key` gives it; neither the id nor
    the hash goes beyond the sort."""
    keyed = df.select(F.unhex(hash_key(id_col, seed)).alias("_h"), *[c.alias(name) for name, c in cols.items()])
    rows = sorted_ranges(keyed, [F.col("_h")], drop=["_h"])
    offsets, _ = _offsets(df.sparkSession, rows.groupBy("_b").count(), "count")
    placed = rows.join(F.broadcast(offsets), "_b")
    return placed.select((F.col("_off") + F.col("_rn") + 1).alias(out), *[q(name) for name in cols])


def _offsets(spark, sizes: DataFrame, value: str) -> tuple[DataFrame, int]:
    """What lies in the ranges before each; a row a shuffle partition."""
    rows = sorted((r["_b"], r[value]) for r in sizes.collect())
    before, out = 0, []
    for b, n in rows:
        out.append((b, before))
        before += n
    return spark.createDataFrame(out, "_b int, _off long"), before


def dense_index(df: DataFrame, order_col: str, tie_col: str, by: Sequence[str] = (),
                out: str = "idx") -> tuple[DataFrame, int]:
    """0-based position in ``(order_col, tie_col)`` order, per ``by`` group.

    ``tie_col`` must be unique. The rows are written once in ``(by, order, tie)`` order; a position
    is the rows of the ranges before, plus the place in the range, less the group's first position.
    """
    by = list(by)
    rows = sorted_ranges(df, [q(c) for c in dict.fromkeys([*by, order_col, tie_col])])
    offsets, n = _offsets(df.sparkSession, rows.groupBy("_b").count(), "count")
    placed = rows.join(F.broadcast(offsets), "_b").withColumn("_g", F.col("_off") + F.col("_rn"))
    if not by:
        return placed.select(*[q(c) for c in df.columns], F.col("_g").alias(out)), n
    names = [f"_by{i}" for i in range(len(by))]
    # a first place for each group and range: a long group is never joined in one task
    parts = placed.groupBy(*[q(c).alias(k) for c, k in zip(by, names)], F.col("_b").alias("_range")).agg(F.min("_g").alias("_first"))
    firsts = parts.withColumn("_first", F.min("_first").over(Window.partitionBy(*names)))
    held = firsts.limit(SMALL_ROWS + 1).collect()
    if len(held) <= SMALL_ROWS:
        firsts = F.broadcast(df.sparkSession.createDataFrame(held, firsts.schema))
    same = [q(c).eqNullSafe(F.col(k)) for c, k in zip(by, names)] + [F.col("_b") == F.col("_range")]
    return placed.join(firsts, same).select(*[q(c) for c in df.columns], (F.col("_g") - F.col("_first")).alias(out)), n


def first_rows(df: DataFrame, by: Sequence[str], keys: Sequence[Column], n: int, out: str = "rank") -> DataFrame:
    """The first ``n`` rows of each group in the order of ``keys``, numbered from 1.

    A group is cut into parts by a hash of its rows, and only the first rows of each part are ranked together.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.withColumn("_part", F.pmod(F.xxhash64(*[q(c) for c in df.columns]), F.lit(parts)))
    best = dealt.withColumn(out, F.row_number().over(Window.partitionBy(*by, "_part").orderBy(*keys))).filter(q(out) <= n)
    return best.withColumn(out, F.row_number().over(Window.partitionBy(*by).orderBy(*keys))).filter(q(out) <= n).drop("_part")


def prefix_sums(df: DataFrame, value: str, sums: Mapping[str, Column], by: Sequence[str] = (),
                descending: bool = False) -> DataFrame:
    """Cumulative sums over distinct values, per ``by`` group, without a global sort.

    Returns one row per (group, value) with each sum ``s``, its inclusive running total ``cum_s`` and the
    group total ``all_s``. Rows are first merged per distinct value (map-side) and written in ranges of
    values; only range totals are scanned in sequence.
    """
    by = list(by)
    merged = df.filter(q(value).isNotNull()).groupBy(*by, q(value).alias(value)).agg(*[c.alias(s) for s, c in sums.items()])
    rows = sorted_ranges(merged, [*[q(c) for c in by], q(value).desc() if descending else q(value).asc()])
    totals = rows.groupBy(*by, "_b").agg(*[F.sum(s).alias(f"_t_{s}") for s in sums])
    group = by or [F.lit(0)]
    before = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*group)
    names = [f"_by{i}" for i in range(len(by))]
    offsets = totals.select(
        *[q(c).alias(k) for c, k in zip(by, names)], F.col("_b").alias("_range"),
        *[F.coalesce(F.sum(f"_t_{s}").over(before), F.lit(0)).alias(f"_off_{s}") for s in sums],
        *[F.sum(f"_t_{s}").over(whole).alias(f"all_{s}") for s in sums])
    run = Window.partitionBy(*by, "_b").orderBy("_rn").rowsBetween(Window.unboundedPreceding, 0)
    inside = rows.select("*", *[F.sum(s).over(run).alias(f"_in_{s}") for s in sums])
    same = [q(c).eqNullSafe(F.col(k)) for c, k in zip(by, names)] + [F.col("_b") == F.col("_range")]
    return inside.join(offsets, same).select(
        *[q(c) for c in by], q(value), *sums,
        *[(F.col(f"_in_{s}") + F.col(f"_off_{s}")).alias(f"cum_{s}") for s in sums],
        *[F.col(f"all_{s}") for s in sums])


def running(df: DataFrame, idx: str, exprs: Mapping[str, tuple[str, Column]], by: Sequence[str] = ()) -> DataFrame:
    """Inclusive running ``sum`` or ``min`` along a dense index, per ``by`` group.

    Long groups are cut into index blocks; only one total per block is scanned
    in sequence, so a group of any length is spread over many tasks.
    """
    by = list(by)
    fold = {"sum": F.sum, "min": F.min}
    staged = df.select("*", F.floor(q(idx) / TASK_ROWS).cast("long").alias("_blk"),
                       *[c.alias(f"_x_{n}") for n, (_, c) in exprs.items()])
    totals = staged.groupBy(*by, "_blk").agg(*[fold[op](f"_x_{n}").alias(f"_t_{n}") for n, (op, _) in exprs.items()])
    before = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(*by, "_blk", *[
        fold[op](f"_t_{n}").over(before).alias(f"_c_{n}") for n, (op, _) in exprs.items()])
    inner = Window.partitionBy(*by, "_blk").orderBy(idx).rowsBetween(Window.unboundedPreceding, 0)
    local = staged.select("*", *[fold[op](f"_x_{n}").over(inner).alias(f"_l_{n}") for n, (op, _) in exprs.items()])
    joined = join_small(local, carry, [*by, "_blk"])
    merge = {"sum": lambda a, b: F.coalesce(a + b, a, b), "min": lambda a, b: F.least(a, b)}
    return joined.select(*[q(c) for c in df.columns], *[
        merge[op](F.col(f"_l_{n}"), F.col(f"_c_{n}")).alias(n) for n, (op, _) in exprs.items()])

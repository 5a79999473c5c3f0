"""Near duplicates among labelled vectors: spherical k-means cells, blocked cosine products, one of each group.

1. Equal vectors of a label become one node with a multiplicity, so copies are never paired with each other.
2. For each label with more than ``cell_rows`` nodes spherical k-means finds centres on a hash sample. A node belongs to
   the cell of its nearest centre. So that no pair over a border is lost it also visits each cell before its own to
   whose side it is close: for centres c (own) and d the bisecting plane has the normal u = (c - d) / |c - d|, and a
   vector on the other side is at least as far away as the plane, whose angle a has sin a = x.u. Cells with
   x.u <= sin(arccos threshold) are visited, the rest cannot hold a partner.
3. A cell's members are dealt to blocks of bounded size; each pair of blocks of a cell is a task of its own, which
   multiplies the blocks in stripes. It returns how many vectors each node is linked with and a spanning forest of the
   links, never the pairs themselves.
4. Link counts are summed, components follow from the forests, and the smallest vec_id of a component is kept.

The result is exact for any centres. Centres are fitted on at most ``CENTRES * FIT_ROWS`` vectors a label (expected);
with more nodes a label's cells grow, and blocks split them.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and vectors with a null
label, link with nothing and are kept. Vectors of different lengths link with nothing. Each input row gives a row, rows
that repeat a vec_id too, and each of them is a vector of its own. A null vec_id is never the smallest; it is kept only where its
component has no other id. An empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowwatch.llm.common import BROADCAST_ROWS, prepared, small_side, written
from flowwatch.llm.components import components

#: Nodes that a cell is meant to hold.
CELL_ROWS = 1024
#: Centres of a label at most, and sampled vectors for each (a documented bound of the fit).
CENTRES, FIT_ROWS, ROUNDS = 4096, 32, 10
#: Bytes of all centres together, which every task holds; beyond it cells are made larger.
CENTRE_BYTES = 64 << 20
#: Nodes of a block, and rows of it that are multiplied at once.
BLOCK_ROWS, STRIPE = 8192, 512
#: Copies of one vector from which on its rows are not shuffled to its result.
HOT_COPIES = 1000

KEYS = ("label", "dim")


def sound(vector: Column) -> Column:
    """Whether a vector takes part: some components, all finite, not all zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def nodes_of(df: DataFrame, id_col: str, vector_col: str, label_col: str) -> tuple[DataFrame, DataFrame]:
    """(vec_id, digest) of all rows, digest null where the vector takes no part; and the distinct vectors of a label:
    node, digest, label, dim, vector, low (smallest vec_id), n (rows)."""
    vector = F.col(f"`{vector_col}`").cast("array<double>")
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), vector.alias("vector"),
                     F.col(f"`{label_col}`").cast("string").alias("label"))
    digest = F.when(F.col("label").isNotNull() & sound(F.col("vector")),
                    F.sha2(F.concat_ws("\0", F.col("vector").cast("string"), "label"), 256))
    rows = rows.withColumn("digest", digest)
    nodes = (rows.filter("digest IS NOT NULL").groupBy("digest")
             .agg(F.first("label").alias("label"), F.first("vector").alias("vector"), F.min("vec_id").alias("low"),
                  F.count("*").alias("n"))
             .select(F.monotonically_increasing_id().alias("node"), "digest", "label", F.size("vector").alias("dim"),
                     "vector", "low", "n"))
    return rows.select("vec_id", "digest"), written(nodes, "vector-nodes")


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length 1, in double precision without overflow or underflow."""
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    """A list column as rows."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def spherical_kmeans(vectors: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centres of unit length; a centre without vectors moves to the vector that is worst off."""
    centres = vectors[np.linspace(0, len(vectors) - 1, k).astype(np.int64)].copy()
    for _ in range(rounds):
        own, best = nearest(vectors, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, vectors)
        lengths = np.linalg.norm(sums, axis=1)
        lone = np.flatnonzero(lengths < 1e-9)
        sums[lone] = vectors[np.argsort(best, kind="stable")[:len(lone)]]
        lengths[lone] = 1
        centres = sums / lengths[:, None]
    return centres


def nearest(vectors: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each vector and its cosine."""
    own, best = np.empty(len(vectors), np.int64), np.empty(len(vectors))
    for a in range(0, len(vectors), STRIPE):
        cosines = vectors[a:a + STRIPE] @ centres.T
        own[a:a + STRIPE] = cosines.argmax(axis=1)
        best[a:a + STRIPE] = cosines.max(axis=1)
    return own, best


def fit_centres(nodes: DataFrame, cell_rows: int) -> DataFrame:
    """label, dim, centres (one flat array): the centres of each label that has more than one cell."""
    sizes = nodes.groupBy(*KEYS).agg(F.count("*").alias("rows"))
    wish = F.least(F.ceil(F.col("rows") / cell_rows), F.lit(CENTRES))
    total = sizes.agg(F.sum(F.when(wish > 1, wish * F.col("dim") * 8))).head()[0] or 0
    shrink = max(1.0, total / CENTRE_BYTES)
    k = F.floor(F.least(F.ceil(F.col("rows") / cell_rows), F.lit(CENTRES)) / shrink).cast("long")
    plan = written(sizes.withColumn("k", k).filter("k > 1"), "cell-plan")
    share = F.col("k") * FIT_ROWS / F.col("rows")
    place = F.conv(F.substring("digest", 1, 8), 16, 10).cast("double") / float(1 << 32)
    sample = (nodes.select(*KEYS, "digest", "vector").join(small_side(plan, plan.count()), list(KEYS))
              .filter(place < share))

    def fit(group: pa.Table) -> pa.Table:
        dim, k = group.column("dim")[0].as_py(), group.column("k")[0].as_py()
        group = group.take(pc.sort_indices(group.column("digest")))
        vectors = unit(matrix(group.column("vector"), dim))
        centres = spherical_kmeans(vectors, min(k, len(vectors)))
        return pa.table({"label": group.column("label")[:1], "dim": pa.array([dim], pa.int32()),
                         "centres": pa.array([centres.ravel()], pa.list_(pa.float64()))})
    return written(sample.groupBy(*KEYS).applyInArrow(fit, "label string, dim int, centres array<double>"), "centres")


def visits(vectors: np.ndarray, centres: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows (vector, cell) of unit vectors: own cells, then visits to cells of smaller number that can hold a partner;
    and the own cell of each vector."""
    own, _ = nearest(vectors, centres)
    reach = math.sqrt(max(0.0, 1 - threshold * threshold)) + 1e-9
    gaps = np.sqrt(np.maximum(2 - 2 * centres @ centres.T, 0))
    guests, cells = [np.arange(len(vectors))], [own]
    for a in range(0, len(vectors), STRIPE):
        part = vectors[a:a + STRIPE] @ centres.T
        mine = own[a:a + STRIPE]
        lead = part[np.arange(len(part)), mine][:, None] - part
        near = (lead <= reach * gaps[mine] + 1e-12) & (np.arange(len(centres))[None, :] < mine[:, None])
        guest, cell = np.nonzero(near)
        guests.append(guest + a)
        cells.append(cell)
    return np.concatenate(guests), np.concatenate(cells), own


MEMBERS = "label string, dim int, cell int, own boolean, node long, n long, vector array<double>"


def cell_members(nodes: DataFrame, centres: DataFrame, threshold: float) -> DataFrame:
    """Each node as a unit vector in its own cell, and as a guest in the cells that it visits."""
    spark = nodes.sparkSession
    held = {(r["label"], r["dim"]): np.array(r["centres"]).reshape(-1, r["dim"]) for r in centres.collect()}
    shared = spark.sparkContext.broadcast(held)

    def run(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch])
            keys = list(zip(table.column("label").to_pylist(), table.column("dim").to_pylist(), strict=True))
            order: dict[tuple, list[int]] = {}
            for i, key in enumerate(keys):
                order.setdefault(key, []).append(i)
            for (label, dim), places in order.items():
                part = table.take(pa.array(places))
                vectors = unit(matrix(part.column("vector"), dim))
                got = shared.value.get((label, dim))
                row, cell, own = visits(vectors, got, threshold) if got is not None else (
                    np.arange(len(vectors)), np.zeros(len(vectors), np.int64), np.zeros(len(vectors), np.int64))
                for a in range(0, len(row), BLOCK_ROWS):
                    r, c = row[a:a + BLOCK_ROWS], cell[a:a + BLOCK_ROWS]
                    yield pa.RecordBatch.from_pydict({
                        "label": pa.array([label] * len(r), pa.string()), "dim": pa.array([dim] * len(r), pa.int32()),
                        "cell": pa.array(c, pa.int32()), "own": pa.array(own[r] == c),
                        "node": part.column("node").combine_chunks().take(pa.array(r)),
                        "n": part.column("n").combine_chunks().take(pa.array(r)),
                        "vector": pa.ListArray.from_arrays(
                            pa.array(np.arange(len(r) + 1) * dim, pa.int32()), pa.array(vectors[r].ravel()))})
    return nodes.select(*KEYS, "node", "n", "vector").mapInArrow(run, MEMBERS)


def block_pairs(members: DataFrame, block_rows: int) -> DataFrame:
    """Members under each pair of blocks of their cell: ``i`` a block of own members, ``j`` such a block from i on, or
    below 0 a block of guests (-1 - number); ``side`` 0 for i and 1 for j."""
    cell = [*KEYS, "cell"]
    sizes = members.groupBy(*cell).agg(
        F.ceil(F.sum(F.col("own").cast("long")) / block_rows).cast("int").alias("owns"),
        F.ceil(F.sum((~F.col("own")).cast("long")) / block_rows).cast("int").alias("guests"))
    dealt = members.join(small_side(sizes, sizes.count()), cell).filter("owns > 0")
    block = F.pmod(F.xxhash64("node"), F.when(F.col("own"), F.col("owns")).otherwise(F.col("guests"))).cast("int")
    dealt = dealt.withColumn("block", block)

    def row(i, j, side):
        return F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), F.lit(side).alias("side"))
    every = F.sequence(F.lit(0), F.col("owns") - 1)
    guests = F.when(F.col("guests") > 0, F.sequence(F.lit(0), F.col("guests") - 1)).otherwise(F.array().cast("array<int>"))
    mine = F.concat(
        F.transform(F.filter(every, lambda x: x >= F.col("block")), lambda x: row(F.col("block"), x, 0)),
        F.transform(F.filter(every, lambda x: x < F.col("block")), lambda x: row(x, F.col("block"), 1)),
        F.transform(guests, lambda x: row(F.col("block"), -1 - x, 0)))
    other = F.transform(every, lambda x: row(x, -1 - F.col("block"), 1))
    return dealt.withColumn("x", F.explode(F.when(F.col("own"), mine).otherwise(other))).select(
        *cell, "x.i", "x.j", "x.side", "node", "n", "vector")


def forest(edges: tuple[np.ndarray, np.ndarray], low: np.ndarray) -> None:
    """Lower the labels of linked places until links join equal labels; labels stay within components."""
    a, b = edges
    while True:
        least = np.minimum(low[a], low[b])
        open_ = np.flatnonzero((low[a] != least) | (low[b] != least))
        if not len(open_):
            return
        a, b, least = a[open_], b[open_], least[open_]
        # the old labels fall too, so that what was joined before stays joined
        for was in (low[a], low[b]):
            np.minimum.at(low, was, least)
        np.minimum.at(low, a, least)
        np.minimum.at(low, b, least)
        while True:
            up = low[low]
            if (up == low).all():
                break
            low[:] = up


def compare_blocks(group: pa.Table, threshold: float) -> pa.Table:
    """Rows (node, b, n): n linked vectors of a node with b null, or a link of the forest with n 0."""
    dim, same = group.column("dim")[0].as_py(), group.column("i")[0] == group.column("j")[0]
    side = group.column("side").to_numpy()
    node, n = group.column("node").to_numpy(), group.column("n").to_numpy()
    vectors = matrix(group.column("vector"), dim)
    left = np.flatnonzero(side == 0)
    right = left if same else np.flatnonzero(side == 1)
    links, low = np.zeros(len(node), np.int64), np.arange(len(node))
    others = vectors[right].T
    for a in range(0, len(left), STRIPE):
        rows = left[a:a + STRIPE]
        linked = vectors[rows] @ others >= threshold
        if same:
            linked &= rows[:, None] != right[None, :]
        if not linked.any():
            continue
        links[rows] += linked @ n[right]
        if not same:
            links[right] += n[rows] @ linked
        x, y = np.nonzero(linked)
        forest((rows[x], right[y]), low)
    counted, child = np.flatnonzero(links), np.flatnonzero(low != np.arange(len(low)))
    return pa.table({
        "node": np.r_[node[counted], node[child]],
        "b": pa.concat_arrays([pa.nulls(len(counted), pa.int64()), pa.array(node[low[child]], pa.int64())]),
        "n": np.r_[links[counted], np.zeros(len(child), np.int64)]})


def node_links(nodes: DataFrame, threshold: float, cell_rows: int, block_rows: int) -> DataFrame:
    """Rows of ``compare_blocks`` over all cells."""
    members = written(cell_members(nodes, fit_centres(nodes, cell_rows), threshold), "cell-members")
    schema = "node long, b long, n long"
    return written(block_pairs(members, block_rows).groupBy(*KEYS, "cell", "i", "j")
                   .applyInArrow(lambda group: compare_blocks(group, threshold), schema), "cell-links")


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                    threshold: float = 0.98, cell_rows: int = CELL_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """vec_id, n_links, component_id, kept of each row. Vectors of a label link from a cosine of ``threshold`` on."""
    if not 0 < threshold <= 1:
        raise ValueError("the threshold is a cosine above 0, at most 1")
    prepared(df.sparkSession)
    rows, nodes = nodes_of(df, id_col, vector_col, label_col)
    found = node_links(nodes, threshold, cell_rows, block_rows)
    links = found.filter("b IS NULL").groupBy("node").agg(F.sum("n").alias("links"))
    member = components(found.filter("b IS NOT NULL").select(F.col("node").alias("a"), "b"))
    plain = nodes.select("node", "digest", "low", "n")
    lowest = member.join(plain, "node").groupBy("component").agg(F.min("low").alias("component_id"))
    member = member.join(small_side(lowest, lowest.count()), "component").select("node", "component_id")
    known = (plain.join(links, "node", "left").join(member, "node", "left").filter("n > 1 OR links > 0")
             .select("digest", "n", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
                     F.coalesce("component_id", "low").alias("component_id")))
    return with_results(rows, written(known, "vector-groups"))


def with_results(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Results by digest back to the rows. A vector with many copies goes to its rows, not the rows to it."""
    size, columns = known.count(), ["digest", "n_links", "component_id"]
    if size <= BROADCAST_ROWS:
        joined = rows.join(F.broadcast(known.select(columns)), "digest", "left")
    else:
        hot = known.filter(F.col("n") > HOT_COPIES).select(columns)
        hot = written(hot, "hot-vectors")
        near = rows.join(small_side(hot.withColumn("hot", F.lit(True)), hot.count()), "digest", "left")
        rest = near.filter("hot IS NULL AND digest IS NOT NULL").select("vec_id", "digest").join(
            known.filter(F.col("n") <= HOT_COPIES).select(columns), "digest", "left")
        joined = near.filter("hot IS NOT NULL OR digest IS NULL").drop("hot").unionByName(rest)
    component = F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                         component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))

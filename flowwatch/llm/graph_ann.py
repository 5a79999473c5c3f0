"""Approximate nearest neighbours by learned partitions.

On a bounded sample (``SAMPLE`` rows, drawn by a hash of the id) an exact neighbour graph is cut into balanced parts that
keep neighbours together. A small network learns the part of a vector; every row of the table is then indexed
under its most probable part, and a query visits its several most probable parts. How many is calibrated: the fewest at which the
sample's own queries reach ``RECALL`` of their exact neighbours. Parts are dealt into blocks of rows, so that
neither a large part nor many copies of a vector meet in one task, and each block reranks exactly.

Defined results: vectors that are null, empty, zero, hold null or non-finite components, or have another number of
components than most take no part; a null id takes no part; rows that share an id count as one candidate at their
least distance; ties go to the smaller id; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flowwatch.llm.common import prepared, written

#: Rows of the sample, about; parts; neighbours a row has in the graph.
SAMPLE, PARTS, DEGREE = 6_000, 24, 10
RECALL = 0.98
#: Rows and queries of a block.
BLOCK_ROWS, BLOCK_QUERIES = 8_192, 4_096


class Router(NamedTuple):
    """A network with one hidden layer over standardised vectors: probabilities of parts."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum((x - self.mean) / self.scale @ self.w1 + self.b1, 0) @ self.w2 + self.b2


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    v = F.col("v")
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.filter(F.col("id").isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0))


def neighbour_graph(x: np.ndarray, degree: int) -> np.ndarray:
    """Exact neighbours of each sample row, by blocks."""
    out, norms = [], (x * x).sum(1)
    for at in range(0, len(x), 512):
        d = norms - 2 * x[at:at + 512] @ x.T
        d[np.arange(len(d)), np.arange(at, at + len(d))] = np.inf
        k = min(degree, len(x) - 1)
        out.append(np.argpartition(d, k - 1, axis=1)[:, :k])
    return np.concatenate(out)


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, seed: int = 1, rounds: int = 12) -> np.ndarray:
    """Equal parts by halving along directions of largest spread, then moves to where a row's neighbours are, as room allows."""
    part, todo, number = np.zeros(len(x), np.int64), [(np.arange(len(x)), parts)], 0
    while todo:
        rows, k = todo.pop()
        if k == 1:
            part[rows] = number
            number += 1
            continue
        mine = x[rows] - x[rows].mean(0)
        axis = np.linalg.eigh(mine.T @ mine)[1][:, -1]
        order = rows[np.argsort(mine @ axis, kind="stable")]
        cut = len(rows) * (k // 2) // k
        todo += [(order[cut:], k - k // 2), (order[:cut], k // 2)]
    both = [[] for _ in range(len(x))]
    for i, row in enumerate(graph.tolist()):
        for j in row:
            both[i].append(j)
            both[j].append(i)
    room = int(np.ceil(1.1 * len(x) / parts))
    sizes = np.bincount(part, minlength=parts)
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        moved = 0
        for i in rng.permutation(len(x)).tolist():
            votes = np.bincount(part[both[i]], minlength=parts)
            votes[sizes >= room] = 0
            best = int(votes.argmax())
            if votes[best] > votes[part[i]] and votes[best] > (part[both[i]] == part[i]).sum():
                sizes[part[i]] -= 1
                sizes[best] += 1
                part[i] = best
                moved += 1
        if not moved:
            break
    return part


def fit_router(x: np.ndarray, part: np.ndarray, parts: int, hidden: int = 128, epochs: int = 40, seed: int = 1) -> Router:
    """Cross-entropy, minibatch Adam."""
    rng = np.random.default_rng(seed)
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = (x - mean) / scale
    p = [rng.normal(0, np.sqrt(2 / z.shape[1]), (z.shape[1], hidden)), np.zeros(hidden),
         rng.normal(0, np.sqrt(1 / hidden), (hidden, parts)), np.zeros(parts)]
    m, v, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for _ in range(epochs):
        for rows in np.array_split(rng.permutation(len(z)), max(1, len(z) // 128)):
            h = np.maximum(z[rows] @ p[0] + p[1], 0)
            o = h @ p[2] + p[3]
            o = np.exp(o - o.max(1, keepdims=True))
            o /= o.sum(1, keepdims=True)
            o[np.arange(len(rows)), part[rows]] -= 1
            o /= len(rows)
            back = (o @ p[2].T) * (h > 0)
            grads = [z[rows].T @ back, back.sum(0), h.T @ o, o.sum(0)]
            t += 1
            for a, g, m1, v1 in zip(p, grads, m, v, strict=True):
                m1 += .1 * (g - m1)
                v1 += .001 * (g * g - v1)
                a -= 2e-3 * (m1 / (1 - .9 ** t)) / (np.sqrt(v1 / (1 - .999 ** t)) + 1e-8)
    return Router(mean, scale, *p)


def calibrated_probes(x: np.ndarray, graph: np.ndarray, router: Router, recall: float) -> int:
    """The fewest parts at which sample rows, routed like queries, find the share of their exact neighbours."""
    logits = router.logits(x)
    indexed = logits.argmax(1)
    rank = np.argsort(np.argsort(-logits, axis=1), axis=1)
    needed = np.take_along_axis(rank, indexed[graph], axis=1)  # how many parts to visit for each neighbour
    share = np.bincount(needed.ravel(), minlength=logits.shape[1]).cumsum() / needed.size
    return int(np.searchsorted(share, recall) + 1)


def nearest(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, x_ids: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The k nearest rows of a block for each query: query number, id, exact distance; one row an id."""
    out: list[tuple] = []
    unique = len(np.unique(x_ids)) == len(x_ids)
    norms = (x * x).sum(1)
    top = norms.max() if len(x) else 0.0
    for at in range(0, len(q), 256):
        some = q[at:at + 256]
        own = (some * some).sum(1)
        d = own[:, None] + norms - 2 * some @ x.T
        for i in range(len(some)):
            near = np.arange(len(x))
            if unique and len(x) > k + 1:
                # rounding of the fast form cannot part what may belong to the k nearest beside the query itself
                near = np.flatnonzero(d[i] <= np.partition(d[i], k)[k] + 1e-9 * (own[i] + top))
            near = near[x_ids[near] != q_ids[at + i]]
            exact = np.sqrt(((x[near] - some[i]) ** 2).sum(1))
            order = np.lexsort((x_ids[near], exact))
            _, first = np.unique(x_ids[near][order], return_index=True)
            for j in order[np.sort(first)[:k]]:
                out.append((at + i, int(x_ids[near[j]]), float(exact[j])))
    n, ids, dist = zip(*out, strict=True) if out else ((), (), ())
    return np.array(n, np.int64), np.array(ids, np.int64), np.array(dist, float)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def search(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 100, k: int = 10,
           sample: int = SAMPLE, parts: int = PARTS, recall: float = RECALL, block_rows: int = BLOCK_ROWS,
           block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: for each id divisible by ``every`` its k nearest rows found."""
    spark = prepared(df.sparkSession)
    schema = "query_id long, rank int, vec_id long, score double"
    valid = usable(df, id_col, vector_col)
    sizes = sorted((-r["count"], r["n"]) for r in valid.groupBy(F.size("v").alias("n")).count().collect())
    if not sizes:
        return spark.createDataFrame([], schema)
    total, dims = -sizes[0][0], sizes[0][1]
    rows = valid.filter(F.size("v") == dims)
    dice = F.pmod(F.xxhash64("id", "v"), F.lit(1 << 30)) / float(1 << 30)
    drawn = rows.filter(dice < sample / total).select("id", "v").orderBy("id", "v").collect()
    x = np.array([r["v"] for r in drawn]).reshape(-1, dims)
    parts = max(1, min(parts, len(x) // (4 * DEGREE)))
    if parts == 1:
        router, probes = Router(np.zeros(dims), np.ones(dims), np.zeros((dims, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1)), 1
    else:
        graph = neighbour_graph(x, DEGREE)
        router = fit_router(x, balanced_parts(x, graph, parts), parts)
        probes = calibrated_probes(x, graph, router, recall)
    shared = spark.sparkContext.broadcast(router)

    def index(batches):
        for batch in batches:
            part = shared.value.logits(_matrix(batch.column("v"))).argmax(1) if batch.num_rows else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(part.astype(np.int32))], ["id", "v", "part"])
    indexed = written(rows.mapInArrow(index, "id long, v array<double>, part int"), "ann-index")
    held = {r["part"]: r["count"] for r in indexed.groupBy("part").count().collect()}  # parts rows
    room = np.array([held.get(p, 0) for p in range(parts)])

    def route(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            order = np.argsort(-shared.value.logits(_matrix(batch.column("v"))), axis=1, kind="stable")
            # as many parts as calibrated, and more while they hold fewer rows than asked for
            enough = np.argmax(np.cumsum(room[order], axis=1) >= min(k + 1, room.sum()), axis=1) + 1
            lists = [o[:max(probes, n)].astype(np.int32) for o, n in zip(order, enough, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lists, pa.list_(pa.int32()))], ["id", "v", "visits"])
    queries = (indexed.filter(F.col("id") % every == 0).select("id", "v")
               .mapInArrow(route, "id long, v array<double>, visits array<int>")
               .select("id", "v", F.explode("visits").alias("part")))
    asked = {r["part"]: r["count"] for r in queries.groupBy("part").count().collect()}
    blocks_of = spark.createDataFrame([(p, max(1, -(-held.get(p, 0) // block_rows)), max(1, -(-asked.get(p, 0) // block_queries)))
                                       for p in range(parts)], "part int, nb int, nq int")
    blocks_of = F.broadcast(blocks_of)
    mine = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    other = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    base = (indexed.join(blocks_of, "part").filter(F.col("part").isin([p for p in asked] or [-1]))
            .select("id", "v", "part", mine("nb").alias("b"), other("nq").alias("q")))
    asking = queries.join(blocks_of, "part").select("id", "v", "part", mine("nq").alias("q"), other("nb").alias("b"))

    def rerank(left: pa.Table, right: pa.Table) -> pa.Table:
        q_ids = left.column("id").to_numpy()
        if not left.num_rows or not right.num_rows:
            n, ids, d = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        else:
            n, ids, d = nearest(_matrix(left.column("v")), q_ids, _matrix(right.column("v")), right.column("id").to_numpy(), k)
        return pa.table({"query_id": q_ids[n], "vec_id": ids, "score": d})
    found = (asking.groupBy("part", "b", "q").cogroup(base.groupBy("part", "b", "q"))
             .applyInArrow(rerank, "query_id long, vec_id long, score double"))
    best = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int"), "vec_id", "score"))

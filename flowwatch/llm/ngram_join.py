"""Jaccard metric-space join of documents on word n-grams, exact, down to connected components.

Jaccard distance is a metric, and documents link at a distance of at most ``e = 1 - percent / 100``.

1. *Sets.* A document is its set of distinct shingles (64-bit hashes). Documents with equal sets are one class,
   stood for by its least doc_id.
2. *Pivots and windows.* All shingles have one global order, those with a rare word first. Two linked sets differ
   by so few elements that the least shingle they share lies among the first ``n - ceil(n * percent / 100) + 1`` of
   each: a document is replicated to the cells of just these shingles. The least document of a cell is
   a pivot, and a pivot's region is the union of its cells, so every linked pair meets in a region whose documents
   lie near its pivot. (Random pivot documents over the whole corpus cannot prune: unrelated texts have
   distances next to 1 from everything, so that each would be replicated everywhere.)
   Documents that share no more than a passage are told apart before their whole sets travel: the first elements in the
   order are a slice of the universe where both sets are known, the size of a symmetric difference is a metric there
   too, and it can only grow on the whole universe.
3. *Regions.* Only documents still together are read again for their whole sets. Inside a region the distances to some
   pivots give windows: ``|d(x, p) - d(y, p)| <= d(x, y)``, so only documents inside each other's window, and
   not linked already through others, are compared.
4. *Recursion.* A region with too many elements for a task is cut into Voronoi regions of several pivots. A document goes
   to its nearest pivot and, by the triangle inequality, also to each pivot that is at most ``2 e`` farther. A region
   whose documents all link with their pivot is done. Where the windows do not make it smaller, its documents are
   dealt into blocks and each pair of blocks is compared: slower, but still whole and in bounded tasks.
5. Links become components.

Defined results: null, empty or blank texts have an empty set and link with nothing (component: their own doc_id);
rows with a null doc_id get a null component and take no part; rows that share a doc_id are one node; an empty table
gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowwatch.llm.common import blocks, id_and_text, prepared, small_side, written
from flowwatch.llm.components import components
from flowwatch.llm.shingles import Shingler, words_of

#: Words at least this share of all words are listed as frequent: at most 1 / share of them, whatever the corpus.
FREQUENT_SHARE = 1e-7
#: Times the cells' elements that are kept for telling documents apart.
HEADS = 1
#: Set elements (8 bytes each) of a region that one task joins.
REGION_ELEMENTS = 2_000_000
#: Pivots, about, that cut a region, and that give windows inside one.
PIVOTS = 8


def frequent_words(docs: DataFrame, share: float = FREQUENT_SHARE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of frequent words and a class of log frequency; orders the pivots, decides nothing else.

    A word below half the share in a task is left out there, so what is shuffled and what reaches the driver
    is bounded by the share.
    """
    def run(batches):
        counts: Counter[bytes] = Counter()
        total = 0

        def emit() -> pa.RecordBatch:
            least = max(2, share / 2 * total)
            kept = [(w, n) for w, n in counts.items() if n >= least]
            h = np.fromiter((xxhash.xxh3_64_intdigest(w) for w, _ in kept), np.uint64, len(kept))
            return pa.RecordBatch.from_pydict({
                "word": pa.array(np.r_[h.view(np.int64), 0]),
                "n": pa.array(np.r_[np.fromiter((n for _, n in kept), np.int64, len(kept)), 0]),
                "total": pa.array(np.r_[np.zeros(len(kept), np.int64), total])})
        for _, texts in blocks(batches):
            for t in texts:
                words = words_of(t)
                counts.update(words)
                total += len(words)
            if len(counts) > 1_000_000:
                yield emit()
                counts, total = Counter(), 0
        yield emit()
    got = written(docs.select("text").mapInArrow(run, "word long, n long, total long")
                  .groupBy("word").agg(F.sum("n").alias("n"), F.sum("total").alias("total")), "word-counts")
    total = got.agg(F.sum("total")).first()[0] or 0
    if not total:
        return np.empty(0, np.uint64), np.empty(0, np.uint8)
    kept = got.filter((F.col("n") > 0) & (F.col("n") >= share * total)).select("word", "n").toPandas()
    h, n = kept["word"].to_numpy().view(np.uint64), kept["n"].to_numpy()
    order = np.argsort(h)
    return h[order], (1 + np.log2(n[order] / (share * total))).astype(np.uint8)


def prefix_length(n: int, percent: int) -> int:
    """Elements of which a linked set must share one: all that may differ, and one more."""
    return n - (n * percent + 99) // 100 + 1


def document_sets(docs: DataFrame, frequent: tuple[np.ndarray, np.ndarray], width: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, sig (names the set; null if empty), heads (keys of the first shingles in the order)."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches):
        shingler = Shingler(width, shared.value)
        for part, texts in blocks(batches):
            sizes, sigs, heads = [], [], []
            for h, weight in shingler.shingles(texts):
                own = np.unique(h)
                n = len(own)
                sizes.append(n)
                sigs.append(xxhash.xxh3_128_digest(own.tobytes()) if n else None)
                # frequency class of the rarest word in the high byte, then the hash
                keys = np.unique((weight << np.uint64(56)) | (h >> np.uint64(8)))
                heads.append(keys[:HEADS * prefix_length(n, percent)].view(np.int64) if n else [])
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(sigs, pa.binary()),
                 pa.array(heads, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "sig", "heads"])
    return docs.mapInArrow(run, "doc_id long, n_shingles long, sig binary, heads array<long>")


def whole_sets(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n, elements (sorted 64-bit hashes) of documents that have words."""
    def run(batches):
        shingler = Shingler(width)
        for part, texts in blocks(batches):
            sets = [np.unique(h) for h, _ in shingler.shingles(texts)]
            kept = [i for i, s in enumerate(sets) if len(s)]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").take(pa.array(kept, pa.int64())),
                 pa.array([len(sets[i]) for i in kept], pa.int64()),
                 pa.array([sets[i].tobytes() for i in kept], pa.binary())], ["doc_id", "n", "elements"])
    return docs.mapInArrow(run, "doc_id long, n long, elements binary")


def linked(shared: np.ndarray, n: np.ndarray, m: int, percent: int) -> np.ndarray:
    return 100 * shared >= percent * (n + m - shared)


def slice_groups(n: np.ndarray, heads: list[np.ndarray], percent: int) -> np.ndarray:
    """Groups of documents that may link, by the first elements (``heads``, sorted) of sets of ``n`` elements.

    Up to the lesser of two documents' last known elements both sets are known. Linked sets differ in at most
    ``(100 - percent) / (100 + percent)`` of their summed sizes, so a greater difference there parts them.
    """
    m = len(heads)
    known = np.fromiter((h[-1] for h in heads), np.uint64, m)
    order = np.argsort(known, kind="stable")
    n, known, heads = n[order], known[order], [heads[i] for i in order.tolist()]
    sizes = np.fromiter(map(len, heads), np.int64, m)
    flat, bounds, owner = np.concatenate(heads), np.r_[0, np.cumsum(sizes)], np.repeat(np.arange(m), sizes)
    codes = np.unique(flat, return_inverse=True)[1]
    mark = np.zeros(codes.max() + 1, bool)
    group = np.arange(m)
    for i in range(m - 1):
        rest = slice(bounds[i + 1], None)
        mark[codes[bounds[i]:bounds[i + 1]]] = True
        hits = np.bincount(owner[rest][mark[codes[rest]]], minlength=m)
        mark[codes[bounds[i]:bounds[i + 1]]] = False
        if not hits.any():
            continue
        within = np.bincount(owner[rest][flat[rest] <= known[i]], minlength=m)
        apart = sizes[i] + within - 2 * hits
        may = (hits > 0) & ((100 + percent) * apart <= (100 - percent) * (n + n[i]))
        may &= 100 * np.minimum(n, n[i]) >= percent * np.maximum(n, n[i])
        if may.any():
            group[np.isin(group, np.append(group[may], group[i]))] = group[i]
    out = np.empty(m, np.int64)
    out[order] = group
    return out


def near_groups(rows: DataFrame, percent: int) -> DataFrame:
    """Rows (region, doc_id, n, heads) to smaller regions (region, doc_id), named by what they hold."""
    def run(t: pa.Table) -> pa.Table:
        ids = t.column("doc_id").to_numpy()
        group = slice_groups(t.column("n").to_numpy(), [np.asarray(c.values).view(np.uint64) for c in t.column("heads")],
                             percent)
        order = np.lexsort((ids, group))
        cuts = np.flatnonzero(np.diff(group[order], prepend=-1))
        names, kept = [], []
        for one in np.split(ids[order], cuts[1:]):
            if len(one) > 1:
                kept.append(one)
                names.append(np.full(len(one), xxhash.xxh3_64_intdigest(one.tobytes()), np.uint64).view(np.int64))
        empty = np.empty(0, np.int64)
        return pa.table({"region": np.concatenate([empty, *names]), "doc_id": np.concatenate([empty, *kept])})
    return rows.groupBy("region").applyInArrow(run, "region long, doc_id long")


class Region:
    """The documents of one region: shared elements of one against all by marking its elements."""

    def __init__(self, ids: list[int], sets: list[np.ndarray]):
        self.ids = ids
        self.size = np.fromiter(map(len, sets), np.int64, len(sets))
        self.bounds = np.r_[0, np.cumsum(self.size)]
        self.codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
        self.owner = np.repeat(np.arange(len(sets)), self.size)
        self.mark = np.zeros(self.codes.max() + 1, bool)

    def shared(self, i: int, among: np.ndarray) -> np.ndarray:
        """Elements of document i in each of ``among`` (a mask)."""
        mine = self.codes[self.bounds[i]:self.bounds[i + 1]]
        self.mark[mine] = True
        where = among[self.owner]
        hits = self.owner[where][self.mark[self.codes[where]]]
        self.mark[mine] = False
        return np.bincount(hits, minlength=len(self.ids))

    def distance(self, i: int) -> np.ndarray:
        s = self.shared(i, np.ones(len(self.ids), bool))
        return 1 - s / (self.size + self.size[i] - s)

    def groups(self, percent: int, pivots: int = 4) -> np.ndarray:
        """For each document the number of its group by links inside the region."""
        m, reach = len(self.ids), 1 - percent / 100 + 1e-9
        group, away = np.arange(m), []
        far = 0
        for _ in range(min(pivots, m)):  # each next pivot is the document farthest from those before
            away.append(self.distance(far))
            far = int(np.min(away, axis=0).argmax())
        away = np.array(away)
        for i in range(m):
            among = (group != group[i]) & (np.abs(away - away[:, i:i + 1]) <= reach).all(0)
            among[:i] = False
            if among.any():
                s = self.shared(i, among)
                hit = among & linked(s, self.size, int(self.size[i]), percent)
                if hit.any():
                    group[np.isin(group, np.append(group[hit], group[i]))] = group[i]
                if (group == group[0]).all():
                    break
        return group


def region_links(rows: DataFrame, percent: int) -> DataFrame:
    """Rows (region, doc_id, elements) to links (a, b): from each document of a group to the group's least."""
    def run(t: pa.Table) -> pa.Table:
        ids = t.column("doc_id").to_pylist()
        group = Region(ids, [np.frombuffer(b.as_py(), np.uint64) for b in t.column("elements")]).groups(percent)
        least: dict[int, int] = {}
        for g, i in zip(group.tolist(), ids, strict=True):
            least[g] = min(i, least.get(g, i))
        out = [(least[g], i) for g, i in zip(group.tolist(), ids, strict=True) if least[g] != i]
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})
    return rows.groupBy("region").applyInArrow(run, "a long, b long")


def _against_pivots(percent: int):
    """Each document against its region's pivots: its Voronoi region, those within the window, and its links."""
    reach = 1 - percent / 100

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for region, doc_id, n, elements, pivots in zip(*(batch.column(c).to_pylist() for c in (
                    "region", "doc_id", "n", "elements", "pivots")), strict=True):
                own = np.frombuffer(elements, np.uint64)
                away, links = [], []
                for p in pivots:
                    other = np.frombuffer(p["elements"], np.uint64)
                    s = len(np.intersect1d(own, other, assume_unique=True))
                    away.append(1 - s / (len(own) + len(other) - s))
                    links.append(bool(linked(np.array(s), np.array(len(own)), len(other), percent)))
                least = min(away)
                for p, d, link in zip(pivots, away, links, strict=True):
                    inside = d <= least + 2 * reach + 1e-9
                    if inside or link:
                        out.append((region, p["doc_id"], doc_id, n, inside, link))
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*out, strict=True) if out else [[]] * 6, (
                pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_()), strict=True)],
                ["region", "pivot", "doc_id", "n", "inside", "link"])
    return run


def cut_regions(members: DataFrame, sets: DataFrame, percent: int, elements: int, pivots: int) -> DataFrame:
    """Links of regions (region, doc_id, n) that are too large for a task."""
    links = None

    def more(found: DataFrame) -> None:
        nonlocal links
        links = found if links is None else links.unionByName(found)

    turn = 0
    while not members.isEmpty():
        turn += 1
        sizes = members.groupBy("region").agg(F.count("*").alias("m"), F.sum("n").alias("total"),
                                              F.min("doc_id").alias("lead"))
        sized = members.join(sizes, "region")
        dice = F.pmod(F.xxhash64("region", "doc_id", F.lit(turn)), F.lit(1 << 30)) / float(1 << 30)
        chosen = sized.filter((dice * F.col("m") < pivots) | (F.col("doc_id") == F.col("lead"))).select("region", "doc_id")
        lists = (chosen.join(sets, "doc_id").groupBy("region")
                 .agg(F.collect_list(F.struct("doc_id", "elements")).alias("pivots")))
        placed = written(members.join(sets.select("doc_id", "elements"), "doc_id").join(lists, "region")
                         .select("region", "doc_id", "n", "elements", "pivots")
                         .mapInArrow(_against_pivots(percent),
                                     "region long, pivot long, doc_id long, n long, inside boolean, link boolean"),
                         "voronoi")
        more(placed.filter("link AND pivot <> doc_id").select(F.col("pivot").alias("a"), F.col("doc_id").alias("b")))
        cells = placed.filter("inside").withColumn("parent", F.col("region")).withColumn(
            "region", F.xxhash64("parent", "pivot", F.lit(turn)))
        stats = (cells.groupBy("parent", "region")
                 .agg(F.sum("n").alias("cell_total"), F.max((~F.col("link")).cast("int")).alias("open"))
                 .join(sizes.select(F.col("region").alias("parent"), "total"), "parent"))
        state = written(stats.filter("open = 1").select(
            "region", "cell_total", F.when(F.col("cell_total") <= elements, "task")
            .when(F.col("cell_total") <= .8 * F.col("total"), "cut").otherwise("blocks").alias("how")), "voronoi-sizes")
        open_cells = cells.select("region", "doc_id", "n").join(state, "region")
        with_sets = lambda how: open_cells.filter(F.col("how") == how).join(sets.select("doc_id", "elements"), "doc_id")
        more(region_links(with_sets("task").select("region", "doc_id", "elements"), percent))
        more(region_links(_block_pairs(with_sets("blocks"), elements), percent))
        members = written(open_cells.filter("how = 'cut'").select("region", "doc_id", "n").distinct(), "voronoi-next")
    return links


def _block_pairs(rows: DataFrame, elements: int) -> DataFrame:
    """A region dealt into blocks by hash, and one region for each pair of blocks."""
    b = F.greatest(F.lit(1), F.ceil(2 * F.col("cell_total") / F.lit(elements))).cast("int")
    dealt = rows.withColumn("b", b).withColumn("mine", F.pmod(F.xxhash64("doc_id"), F.col("b")).cast("int"))
    return (dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("b") - 1)))
            .select(F.xxhash64("region", F.least("mine", "other"), F.greatest("mine", "other")).alias("region"),
                    "doc_id", "elements"))


def ngram_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3,
                     percent: int = 90, share: float = FREQUENT_SHARE, region_elements: int = REGION_ELEMENTS,
                     pivots: int = PIVOTS) -> DataFrame:
    """doc_id, n_shingles, component_id: one row a document."""
    prepared(df.sparkSession)
    docs = id_and_text(df, id_col, text_col)
    sets = written(document_sets(docs, frequent_words(docs, share), width, percent), "sets")
    there = sets.filter("sig IS NOT NULL AND doc_id IS NOT NULL")
    classes = written(there.groupBy("sig").agg(F.min("doc_id").alias("rep")), "classes")
    # copies leave by a join that moves only their ids, while those are few enough to broadcast
    copies = written(there.select("doc_id", "sig").join(classes, "sig").filter("doc_id <> rep").select("doc_id", "sig").distinct(),
                     "copies")
    heads = (there.join(small_side(copies, copies.count()), ["doc_id", "sig"], "left_anti")
             .select(F.col("doc_id").alias("rep"), "n_shingles", "heads"))
    may_differ = F.col("n_shingles") - F.expr(f"(n_shingles * {int(percent)} + 99) div 100")
    rows = heads.select("rep", F.explode(F.slice("heads", 1, (may_differ + 1).cast("int"))).alias("cell"))
    shared = (rows.groupBy("cell").agg(F.min("rep").alias("region"), F.max("rep").alias("last"))
              .filter("region < last").select("cell", "region"))
    met = written(rows.join(shared, "cell").select("region", F.col("rep").alias("doc_id")).distinct(), "regions")
    meeting = written(met.select("doc_id").distinct(), "meeting-documents")
    heads_of = written(heads.withColumnRenamed("rep", "doc_id").join(small_side(meeting, meeting.count()), "doc_id", "left_semi"),
                       "meeting-heads")
    largest = heads_of.groupBy("doc_id").agg(F.max("n_shingles").alias("n"), F.max(F.size("heads")).alias("k"))
    sized = met.join(largest, "doc_id")
    fits = sized.join(sized.groupBy("region").agg(F.sum("k").alias("total")), "region")
    near = near_groups(fits.filter(F.col("total") <= region_elements).select("region", "doc_id")
                       .join(heads_of, "doc_id").select("region", "doc_id", F.col("n_shingles").alias("n"), "heads"), percent)
    members = written(near.distinct().join(largest.select("doc_id", "n"), "doc_id").select("region", "doc_id", "n")
                      .unionByName(fits.filter(F.col("total") > region_elements).select("region", "doc_id", "n")), "near-regions")
    wanted = written(members.select("doc_id").distinct(), "region-documents")
    read = docs.join(small_side(wanted, wanted.count()), "doc_id", "left_semi")
    elements = written(whole_sets(read, width), "whole-sets")
    sized = members.join(members.groupBy("region").agg(F.sum("n").alias("total")), "region")
    links = region_links(sized.filter(F.col("total") <= region_elements).join(elements.drop("n"), "doc_id")
                         .select("region", "doc_id", "elements"), percent)
    large = written(sized.filter(F.col("total") > region_elements).select("region", "doc_id", "n"), "large-regions")
    if not large.isEmpty():
        links = links.unionByName(cut_regions(large, elements, percent, region_elements, pivots))
    # a doc_id with several texts is one node: its classes belong together
    same = (there.join(classes, "sig").groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b"))
            .filter("a < b").select("a", "b"))
    found = components(links.unionByName(same))
    labels = classes.join(found.withColumnRenamed("node", "rep"), "rep", "left").select(
        "sig", F.coalesce("component", "rep").alias("component"))
    return (sets.select("doc_id", "n_shingles", "sig").join(labels, "sig", "left")
            .select("doc_id", "n_shingles",
                    F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id")))


def one_of_each_group(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3,
                      percent: int = 90) -> DataFrame:
    """The rows with all their columns, of each group of linked documents just the least doc_id, and of rows that repeat
    a doc_id just one; rows with a null doc_id stay."""
    prepared(df.sparkSession)
    key = F.col(f"`{id_col}`").cast("long")
    found = ngram_components(df, id_col, text_col, width, percent)
    gone = written(found.filter("doc_id <> component_id").select(F.col("doc_id").alias("__id")).distinct(), "linked-documents")
    twice = written(df.filter(key.isNotNull()).groupBy(key.alias("__id")).count().filter("count > 1").select("__id"),
                    "repeated-ids")
    left = df.join(small_side(gone, gone.count()), key == F.col("__id"), "left_anti")
    if twice.isEmpty():
        return left
    hint = small_side(twice, twice.count())
    return left.join(hint, key == F.col("__id"), "left_anti").unionByName(
        left.join(hint, key == F.col("__id"), "left_semi").dropDuplicates([id_col]))

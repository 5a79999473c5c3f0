"""Near duplicates of vectors against all pairs."""

import numpy as np
import pytest
from util import clashing

from flowwatch.llm import vector_dedup as vd

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, threshold=0.98):
    def usable(v, label):
        return (label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v))
    n = len(rows)
    ok = [usable(v, label) for _, v, label in rows]
    vectors = [np.array(v, np.float32).astype(float) if u else None for u, (_, v, _) in zip(ok, rows, strict=True)]
    linked = {i: set() for i in range(n)}
    for i in range(n):
        for j in range(i):
            if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(vectors[i]) == len(vectors[j]):
                if vectors[i] @ vectors[j] / np.linalg.norm(vectors[i]) / np.linalg.norm(vectors[j]) >= threshold:
                    linked[i].add(j)
                    linked[j].add(i)
    out, seen = [], {}
    for i in range(n):
        if i not in seen:
            todo, group = [i], {i}
            while todo:
                new = linked[todo.pop()] - group
                group |= new
                todo += new
            ids = [rows[k][0] for k in group if rows[k][0] is not None]
            seen.update(dict.fromkeys(group, min(ids) if ids else None))
        out.append((rows[i][0], len(linked[i]), seen[i], rows[i][0] == seen[i]))
    return sorted(out, key=str)


def result(df):
    return sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in df.collect()), key=str)


def sample(seed=1, n=220, dim=6):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, dim))
    near = base[rng.integers(0, n, 160)] + rng.normal(scale=0.09, size=(160, dim))
    hot = base[0] + rng.normal(scale=0.02, size=(120, dim))
    vectors = np.concatenate([base, near, hot, base[:30], 3 * base[:10], np.repeat(base[5:6], 25, 0)])
    rows = [(int(i), [float(np.float32(x)) for x in v], int(label)) for i, (v, label) in enumerate(
        zip(vectors, rng.integers(0, 3, len(vectors)), strict=True))]
    odd = [None, [], [0.0] * dim, [-0.0] * dim, [1.0, None] + [0.0] * (dim - 2), [float("nan")] * dim,
           [float("inf")] + [0.0] * (dim - 1), [1.0] * (dim + 1), [1.0] * (dim + 1), [1e-30] * dim, [1e30] * dim, [1.0] * dim]
    rows += [(2000 + i, v, 1) for i, v in enumerate(odd)]
    rows += [(3000, rows[1][1], None), (3001, rows[1][1], None), (7, rows[9][1], 2), (7, rows[8][1], 0), (None, rows[3][1], rows[3][2]),
             (None, [5.0, -9.0] * (dim // 2), 9)]
    return rows


@pytest.mark.parametrize(("cell_rows", "block_rows"), [(8, 3), (20, 8192), (8192, 40), (8192, 8192)])
def test_against_all_pairs(spark, cell_rows, block_rows):
    rows = sample()
    df = clashing(spark.createDataFrame(rows, SCHEMA).repartition(4).drop("n"))
    assert result(vd.near_duplicates(df, cell_rows=cell_rows, block_rows=block_rows)) == brute(rows)


def test_wide_angle_and_shuffled_results(spark, monkeypatch):
    for name in ("BROADCAST_ROWS", "HOT_COPIES"):
        monkeypatch.setattr(vd, name, 5)
    monkeypatch.setattr("flowwatch.llm.common.BROADCAST_ROWS", 5)
    rows = sample(4, 120, 4)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert result(vd.near_duplicates(df, threshold=0.9, cell_rows=10, block_rows=7)) == brute(rows, 0.9)


def test_bounded_centres_keep_the_result(spark, monkeypatch):
    monkeypatch.setattr(vd, "CENTRE_BYTES", 400)
    rows = sample(2, 150)
    got = vd.near_duplicates(spark.createDataFrame(rows, SCHEMA), cell_rows=4)
    assert result(got) == brute(rows)


def test_visits_cover_all_borders():
    rng = np.random.default_rng(3)
    x = vd.unit(np.repeat(rng.normal(size=(150, 5)), 3, 0) + rng.normal(scale=0.1, size=(450, 5)))
    centres = vd.spherical_kmeans(x, 40)
    assert np.allclose(np.linalg.norm(centres, axis=1), 1)
    row, cell, own = vd.visits(x, centres, 0.98)
    at = {(r, c) for r, c in zip(row.tolist(), cell.tolist(), strict=True)}
    for i, j in zip(*np.nonzero(x @ x.T >= 0.98), strict=True):
        assert (max(i, j, key=lambda k: own[k]), own[[i, j]].min()) in at
    assert len(row) < 40 * len(x) / 2


def test_empty_table(spark):
    assert vd.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []
    with pytest.raises(ValueError, match="threshold"):
        vd.near_duplicates(spark.createDataFrame([], SCHEMA), threshold=-0.5)

"""Neighbours of every vector against brute force: copies, clusters, odd vectors, skipped cells."""

import random

import numpy as np
import pytest

from lexmill.operators import neighbours as N


def brute(rows, k, threshold):
    rows = [(i, v) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    m = np.array([v for _, v in rows], np.float32).astype(float)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    s = np.round(m @ m.T, 6)
    out = []
    for a, (i, _) in enumerate(rows):
        best = sorted((-s[a, b], j) for b, (j, _) in enumerate(rows) if j != i and s[a, b] >= threshold)[:k]
        out += [(i, j, n) for n, (_, j) in enumerate(best, 1)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, vector array<float>")


def got(df):
    return sorted((r.query_id, r.id, r.puesto) for r in df.collect())


@pytest.mark.parametrize("threshold", [-0.5, 0.3, 0.95])
def test_same_as_brute_force(spark, monkeypatch, threshold):
    """Clusters, a vector that a third of all rows share, pairs of copies, far vectors with few hits, small blocks and cells."""
    monkeypatch.setattr(N, "BLOCK_ROWS", 16)
    monkeypatch.setattr(N, "CELL_ROWS", 20)
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(9, 6))
    vectors = [*(centres[rng.integers(9)] + 0.1 * rng.normal(size=6) for _ in range(180)), *[centres[0]] * 110, *rng.normal(size=(30, 6))]
    vectors += vectors[:15]
    rows = [(int(i), [float(x) for x in v]) for i, v in zip(rng.permutation(len(vectors)), vectors, strict=True)]
    rows += [(1000, None), (1001, []), (1002, [0.0] * 6), (1003, [float("nan")] * 6)]
    assert got(N.all_neighbours(frame(spark, rows), 5, threshold)) == brute(rows, 5, threshold)


def test_cells_are_skipped(spark, monkeypatch):
    """Tight clusters: most pairs of a block and a cell are out of reach."""
    monkeypatch.setattr(N, "CELL_ROWS", 25)
    rng = random.Random(1)
    centres = [[rng.gauss(0, 1) for _ in range(12)] for _ in range(40)]
    rows = [(i, [x + rng.gauss(0, 0.01) for x in centres[i % 40]]) for i in range(1000)]
    classes = N.save(N.vector_classes(frame(spark, rows).withColumnRenamed("vector", "v"), 5), "classes")
    cells = N.cells_of(classes, 5)
    blocks, used = cells.blocks.count(), int(np.isfinite(cells.inner).sum())
    sent = N.sent_vectors(cells, 0.5)
    assert len(cells.pivots) == 40 and sent.count() < blocks * used / 4
    assert set(map(tuple, sent.select("cell", "from_cell").filter("cell = from_cell").distinct().collect())) == {(c, c) for c in np.flatnonzero(np.isfinite(cells.inner)).tolist()}
    assert got(N.all_neighbours(frame(spark, rows), 5, 0.5)) == brute(rows, 5, 0.5)


def test_small_tables(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0])]
    assert got(N.all_neighbours(frame(spark, rows), 3, 0.5)) == [(1, 2, 1), (2, 1, 1)]
    assert got(N.all_neighbours(frame(spark, rows[:1]), 3, 0.5)) == []
    assert got(N.all_neighbours(frame(spark, rows).limit(0), 3)) == []


def test_shuffle_grows_with_the_vectors(spark, monkeypatch):
    """Vectors without structure, no table small enough to be broadcast: four times as many shuffle about four times as much."""
    for name, value in (("BLOCK_ROWS", 8), ("CELL_ROWS", 8), ("PARTS", 4)):
        monkeypatch.setattr(N, name, value, raising=False)
    jvm, rng = spark.sparkContext._jsc.sc(), np.random.default_rng(3)

    def written():
        jvm.listenerBus().waitUntilEmpty()
        executors = jvm.statusStore().executorList(False)
        return sum(executors.apply(k).totalShuffleWrite() for k in range(executors.size()))

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        moved = []
        for n in (400, 1600):
            rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(n, 64)))]
            before = written()
            assert got(N.all_neighbours(frame(spark, rows), 3, -1.0)) == brute(rows, 3, -1.0)
            moved.append(written() - before)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert 0 < moved[1] < 5.5 * moved[0], moved

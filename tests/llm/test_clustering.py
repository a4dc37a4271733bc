"""Heap-bounded clustering against plain rounds, with ties, copies, gaps and odd vectors."""

import hashlib
import math
import random

import numpy as np
import pytest

from reviewlake.llm import clustering as K

SCHEMA = "vec_id long, embedding array<float>, label string, cluster int, distance string"


def plain(rows, k, rounds, size):
    """Every vector against every centroid, with Python integers."""
    kept = []
    for vec_id, v in rows:
        if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v):
            kept.append((vec_id, [max(-K.LIMIT, min(K.LIMIT, math.floor(64 * float(np.float32(x))))) for x in v], [float(np.float32(x)) for x in v]))
    name = lambda i: hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    centroids = [v for _, v, raw in sorted(kept, key=lambda r: (name(r[0]), r[2]))[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for left in range(rounds, -1, -1):
        got = [min((far(v, c), j) for j, c in enumerate(centroids)) for _, v, _ in kept]
        if left:
            for j in range(len(centroids)):
                mine = [v for (_, v, _), g in zip(kept, got, strict=True) if g[1] == j]
                if mine:
                    centroids[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    return sorted(((i is None, i or 0), j, d) for (i, _, _), (d, j) in zip(kept, got, strict=True)), centroids


def vectors(seed, n, size):
    rng = random.Random(seed)
    middles = [[rng.gauss(0, 1) for _ in range(size)] for _ in range(5)]
    rows = [(i, [m + rng.gauss(0, 0.3) for m in rng.choice(middles)]) for i in range(n)]
    rows += [(1000 + i, [0.5] * size) for i in range(60)]  # a large group of copies
    rows += [(2000 + i, [float(rng.choice([0, 1])) for _ in range(size)]) for i in range(40)]  # many ties
    rows += [rows[3], rows[3], (None, rows[4][1]), (3000, None), (3001, []), (3002, [0.1] * (size - 1)), (3003, [None] * size)]
    rows += [(3004, [float("nan")] * size), (3005, [float("inf")] * size), (3, [0.25] * size), (3006, [3e6, -3e6] + [0.0] * (size - 2))]
    return rows


@pytest.mark.parametrize(("k", "rounds", "size", "batch"), [(16, 3, 64, 10000), (4, 6, 3, 50), (7, 5, 2, 17), (1, 2, 4, 100), (5, 0, 3, 40)])
def test_equals_plain_rounds(spark, docs, k, rounds, size, batch):
    rows = vectors(k, 300, size)
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA).repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got, centroids = K.cluster(df, k, rounds, size)
        found = sorted(((r.vec_id is None, r.vec_id or 0), r.cluster, r.distance) for r in got.collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert (found, centroids) == plain(rows, k, rounds, size)


def test_few_and_no_vectors(spark, docs):
    three = [(i, [float(i), 0.0]) for i in range(3)]
    make = lambda rows: spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA)
    got, centroids = K.cluster(make(three), 16, 3, 2)
    assert len(centroids) == 3 and sorted((r.vec_id, r.distance) for r in got.collect()) == [(0, 0), (1, 0), (2, 0)]
    got, centroids = K.cluster(make([]), 16, 3, 2)
    assert centroids == [] and got.count() == 0 and got.columns == ["vec_id", "cluster", "distance"]


def test_bounds_save_work():
    """Later rounds measure only vectors whose gap has expired."""
    rng = np.random.default_rng(5)
    middles = rng.normal(0, 60, (6, 8))
    data = np.floor(middles[rng.integers(0, 6, 3000)] + rng.normal(0, 2, (3000, 8))).astype(np.int64)
    block = K.Block(K.pa.array(range(3000), K.pa.int64()), data, 6)
    centroids, drift = np.floor(middles).astype(np.int64), np.zeros(6)
    block.measure(np.arange(3000), centroids, drift)
    moved = centroids + rng.integers(-1, 2, centroids.shape)
    drift += K._moves(centroids, moved)
    again = K.Block.of(dict(zip([f.name for f in K._STATE], block.row(), strict=True)), 6)
    popped = again.expired(drift)
    again.measure(popped, moved, drift)
    assert len(popped) < 300 and np.array_equal(again.cluster, K.distances(data, moved).argmin(1))
    assert sum(map(len, again.heaps)) == 3000

"""Kd-tree filtering against plain Lloyd rounds in whole numbers, and its defined results at the edges."""

import hashlib
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vellum.llm import centroids

LARGEST = 2**63 - 1


def plain(rows, k, rounds, width, seed=2):
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    key = lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    centres = [list(v) for _, v in sorted(kept, key=key)[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centres)) for _, v in kept]

    for _ in range(rounds):
        near = assign()
        for n in range(len(centres)):
            own = [v for (_, v), (_, c) in zip(kept, near) if c == n]
            if own:
                centres[n] = [sum(x) // len(own) for x in zip(*own)]
    near = assign()
    by = {n: sum(d for d, c in near if c == n) for n in range(len(centres))}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((i, c, min(d, LARGEST), min(by[c], LARGEST), min(sum(by.values()), LARGEST), sha[c]) for (i, _), (d, c) in zip(kept, near)), key=repr)


def rows_of(df, **kw):
    return sorted((tuple(r) for r in centroids.clusters(df, **kw).collect()), key=repr)


def cloud(n, width, seed, spread=0.02):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(12, width))
    return (middle[rng.integers(0, 12, n)] + spread * rng.normal(size=(n, width))).round(3)


@pytest.mark.parametrize("width, spread, points", [(3, 0.02, 1 << 15), (3, 1.0, 200), (16, 0.1, 333)])
def test_equals_plain_rounds(spark, width, spread, points):
    rows = [(k, list(map(float, v))) for k, v in enumerate(cloud(1500, width, width, spread))]
    rows += [(5000 + k, rows[0][1]) for k in range(600)]  # one vector very often
    rows += [(7, [0.0] * width)] * 40  # repeated rows, and ties
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    assert rows_of(df, k=20, rounds=4, width=width, points=points) == plain(rows, 20, 4, width)


def test_ties_go_to_the_smaller_number(spark):
    rows = [(k, [float(x), 0.0]) for k, x in enumerate([-1, 0, 1, 2, -2, 0, 1, 1, -1] * 60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert rows_of(df, k=9, rounds=3, width=2) == plain(rows, 9, 3, 2)


@pytest.mark.parametrize("size", [3e3, 5e6, 1e15, 1e21])
def test_large_components_are_exact(spark, size):
    rng = random.Random(1)
    rows = [(k, [rng.choice([-1, 1]) * size * rng.random() if rng.random() < 0.5 else rng.random() for _ in range(4)]) for k in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(2)
    assert rows_of(df, k=7, rounds=3, width=4) == plain(rows, 7, 3, 4)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [1.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (None, [0.5, 0.25]), (7, [-0.001, 0.001]), (8, [3.0, 3.0]), (8, [2.0, 3.0]), (9, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit("clash") for c in ("cluster", "key", "points", "count", "value")})
    assert rows_of(df, k=3, rounds=2, width=2) == plain(rows, 3, 2, 2)
    assert rows_of(df, k=40, rounds=5, width=2) == plain(rows, 40, 5, 2)  # fewer vectors than centroids
    assert rows_of(df.filter("vec_id < 7"), k=3, rounds=2, width=2) == []
    assert centroids.clusters(df.limit(0)).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_nodes_are_pruned_and_assigned_whole():
    points = np.floor(cloud(4096, 8, 5, 0.01) * 256)
    leaves = centroids.leaf_rows(pa.array(range(len(points))), points)
    assert leaves.num_rows == 128 and {len(x) for x in leaves.column("ids").to_pylist()} == {32}
    centres = [[int(x) for x in v] for v in points[:: 4096 // 12][:12]]
    forest, totals = centroids.Forest(leaves, centres), centroids.Totals(12, 8)
    totals.add_forest(forest)
    assert totals.resolved < len(points) / 2 and sum(totals.count) == len(points)
    assert (totals.sums.sum(0) == points.sum(0)).all() and sum(totals.squares) == (points**2).sum()


def test_query(spark, sf_dir):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    assert sorted((tuple(r) for r in centroids.op12_centroid_clustering(spark, sf_dir).collect()), key=repr) == plain(rows, 40, 5, 64)

"""Centroid clustering of whole-number vectors by kd-tree filtering, exactly.

Each component x becomes floor(256 * x). Every partition of the table becomes kd-trees of at most ``POINTS`` vectors, split
at the median of the widest side, written once as rows of leaves: the points, their count, componentwise sums, sum of
squares and box. Leaves stand in the tree's order, so pairs of neighbours give the nodes above them, up to the root.

A round sends the centroids down every tree. At a node, the candidate nearest to the box's middle is compared with each
other one at the vertex of the box that favours the other most; if the other is farther even there, no point of the
box can belong to it and it is pruned (strictly: equal distances prune nothing). A node with one candidate left is
assigned whole by its count, sums and squares; leaves with several are resolved point by point. Tasks give a sum for each
centroid and component, which Spark adds; the driver gets these for k centroids, never a vector of the table.

Arithmetic is exact: in float64 where every term is below 2**53, else in Python's whole numbers. Scaled components of 2**80 or
more raise an error; distances and sums beyond a long are given as the largest long.

Vectors that are null, of another length, or with null or non-finite components take no part. A null vec_id is hashed like an
empty string; of rows with equal hashes the least vector comes first as a centroid. Repeated rows count each. With fewer
vectors than centroids every vector is one; an empty table gives an empty result. Columns other than vec_id and embedding
are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm.common import map_batches, shared_checkpoint, table

K, ROUNDS, SEED, WIDTH, SCALE = 40, 5, 2, 64, 256
POINTS = 1 << 15  # of a tree
LEAF = 32  # points of a leaf at most
LARGEST = 2**63 - 1
LEAVES = "ids array<long>, points binary, kind string, count long, low binary, high binary, sums binary, squares long"
SQUARES, COUNT = -1, -2  # places of what is summed besides the components


def kept_vectors(vectors: DataFrame, width: int) -> DataFrame:
    v = F.col("embedding").cast("array<double>")
    fine = (F.size("embedding") == width) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("embedding")).filter(F.col("embedding").isNotNull() & fine)


def whole(values: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) as float64, which holds it exactly: SCALE is a power of two."""
    with np.errstate(over="ignore"):
        out = np.floor(values * SCALE)
    if np.abs(out).max(initial=0) >= 2.0**80:
        raise ValueError("a scaled component of 2**80 or more")
    return out


def tree_order(points: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray]:
    """The points' order in a kd-tree, and the borders of its leaves, whose number is a power of two."""
    n = len(points)
    depth = max(0, math.ceil(math.log2(n / leaf))) if n else 0
    order, edges = np.arange(n), np.array([0, n])
    for _ in range(depth):
        middle = (edges[:-1] + edges[1:]) // 2
        for a, m, b in zip(edges[:-1], middle, edges[1:]):
            own = points[order[a:b]]
            side = int(np.argmax(own.max(0) - own.min(0)))
            order[a:b] = order[a:b][np.argpartition(own[:, side], m - a)]
        edges = np.r_[np.c_[edges[:-1], middle].ravel(), n]
    return order, edges


def leaf_rows(ids: pa.Array, points: np.ndarray) -> pa.RecordBatch:
    order, edges = tree_order(points)
    points, ids = points[order], ids.take(pa.array(order))
    largest = np.abs(points).max(initial=0)
    kind = "<i2" if largest < 2**15 else "<i4" if largest < 2**19 else "<f8"
    small = points.astype(kind)
    sums = np.add.reduceat(points, edges[:-1], axis=0) if kind != "<f8" else np.zeros((len(edges) - 1, points.shape[1]))
    squares = np.add.reduceat((points**2).sum(1), edges[:-1]) if kind != "<f8" else np.zeros(len(edges) - 1)  # made when they are read, as whole numbers of any size
    low, high = np.minimum.reduceat(small, edges[:-1], axis=0), np.maximum.reduceat(small, edges[:-1], axis=0)
    raw = lambda rows: pa.array([r.tobytes() for r in rows], pa.binary())
    return pa.record_batch(
        [
            pa.ListArray.from_arrays(pa.array(edges, pa.int32()), ids),
            raw(small[a:b] for a, b in zip(edges, edges[1:])),
            pa.array([kind] * (len(edges) - 1)),
            pa.array(np.diff(edges)),
            raw(low),
            raw(high),
            raw(sums.astype(np.int64)),
            pa.array(squares.astype(np.int64)),
        ],
        names=["ids", "points", "kind", "count", "low", "high", "sums", "squares"],
    )


def trees(kept: DataFrame, points: int = POINTS) -> DataFrame:
    """The leaves of the kd-trees of each partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                held.append(batch.slice(at, points - size))
                size += held[-1].num_rows
                at += held[-1].num_rows
                if size == points:
                    yield leaf_rows(*gathered(held))
                    held, size = [], 0
        if size:
            yield leaf_rows(*gathered(held))

    def gathered(held: list[pa.RecordBatch]) -> tuple[pa.Array, np.ndarray]:
        t = pa.Table.from_batches(held).combine_chunks()
        v = t.column("embedding").chunk(0)
        return t.column("vec_id").chunk(0), whole(v.flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1))

    return map_batches(kept, run, LEAVES)


class Level:
    """Nodes of one height: boxes and what they hold."""

    def __init__(self, low: np.ndarray, high: np.ndarray, count: np.ndarray, sums: np.ndarray, squares: np.ndarray):
        self.low, self.high, self.count, self.sums, self.squares = low, high, count, sums, squares

    def above(self) -> Level:
        """Neighbours two by two; the last of an odd number alone."""
        at = np.arange(0, len(self.low), 2)
        return Level(*(f.reduceat(x, at, axis=0) for f, x in ((np.minimum, self.low), (np.maximum, self.high), (np.add, self.count), (np.add, self.sums), (np.add, self.squares))))


class Forest:
    """A run of leaves as read from the table: one tree, or a part of one, or several."""

    def __init__(self, batch: pa.RecordBatch, centres: list[list[int]]):
        kinds = batch.column("kind").to_pylist()
        column = lambda name, kind=None: [np.frombuffer(x, kind or k).astype(np.float64) for x, k in zip(batch.column(name).to_pylist(), kinds)]
        low, high, points = np.stack(column("low")), np.stack(column("high")), np.concatenate(column("points")).reshape(-1, len(centres[0]))
        self.ids = batch.column("ids").flatten()
        self.count = batch.column("count").to_numpy().astype(np.int64)
        self.edges = np.r_[0, np.cumsum(self.count)]
        largest = max(np.abs(low).max(), np.abs(high).max(), *(abs(x) for c in centres for x in c), 1)
        self.exact = 8 * len(centres[0]) * float(largest) ** 2 < 2**53 and "<f8" not in kinds
        if self.exact:
            self.points, self.centres = points, np.array(centres, np.float64)
            sums, squares = np.stack(column("sums", "<i8")).astype(np.int64), batch.column("squares").to_numpy().astype(np.int64)
        else:
            integers = np.frompyfunc(int, 1, 1)
            self.points, low, high = integers(points), integers(low), integers(high)
            self.centres = np.array(centres, object)
            sums, squares = (np.add.reduceat(x, self.edges[:-1], axis=0) for x in (self.points, (self.points**2).sum(1)))
        self.levels = [Level(low, high, self.count, sums, squares)]
        while len(self.levels[-1].low) > 1:
            self.levels.append(self.levels[-1].above())

    def least(self, scores: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """The candidate of the least score, the first of equal ones."""
        return np.argmin(np.where(mask, scores, np.inf if self.exact else scores.max() + 1), axis=1)

    def pruned(self, low: np.ndarray, high: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """The candidates that aren't strictly dominated in the boxes."""
        c = self.centres
        squares = (c**2).sum(1)
        star = self.least(squares - (low + high) @ c.T, mask)
        mask = mask.copy()
        for s in np.unique(star):
            rows = np.flatnonzero(star == s)
            u = c - c[s]
            farther = (squares - squares[s]) - 2 * (high[rows] @ np.maximum(u, 0).T + low[rows] @ np.minimum(u, 0).T) > 0
            mask[rows] &= ~farther.astype(bool)
        return mask

    def filter(self, totals: Totals | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The owner of each leaf, -1 where points are to be resolved; such leaves, and their candidates. What is
        assigned whole is added to ``totals``."""
        owner = np.full(len(self.count), -1)
        active, mask = np.array([0]), np.ones((1, len(self.centres)), bool)
        for height in range(len(self.levels) - 1, -1, -1):
            level = self.levels[height]
            mask = self.pruned(level.low[active], level.high[active], mask)
            alone = mask.sum(1) == 1
            owners, nodes = mask[alone].argmax(1), active[alone]
            for o, n in zip(owners, nodes):
                owner[n << height : (n + 1) << height] = o
            if totals:
                totals.add(owners, level.count[nodes], level.sums[nodes], level.squares[nodes])
            active, mask = active[~alone], mask[~alone]
            if height:
                children = np.c_[2 * active, 2 * active + 1].ravel()
                there = children < len(self.levels[height - 1].low)
                active, mask = children[there], np.repeat(mask, 2, axis=0)[there]
        return owner, active, mask

    def resolve(self, leaves: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The points of these leaves, and the nearest candidate of each."""
        sizes = self.count[leaves]
        rows = np.repeat(self.edges[leaves] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        columns = np.flatnonzero(mask.any(0))
        c = self.centres[columns]
        scores = (c**2).sum(1) - 2 * (self.points[rows] @ c.T)
        return rows, columns[self.least(scores, np.repeat(mask[:, columns], sizes, axis=0))]

    def nearest(self) -> tuple[np.ndarray, np.ndarray]:
        """Cluster and squared distance of each point."""
        owner, leaves, mask = self.filter()
        cluster = np.repeat(owner, self.count)
        if len(leaves):
            rows, found = self.resolve(leaves, mask)
            cluster[rows] = found
        return cluster, ((self.points - self.centres[cluster]) ** 2).sum(1)


class Totals:
    """Counts, sums and sums of squares by centroid, in whole numbers of any size."""

    def __init__(self, k: int, width: int):
        self.count, self.sums, self.squares = np.zeros(k, object), np.zeros((k, width), object), np.zeros(k, object)
        self.k, self.resolved, self.points = k, 0, 0

    def add(self, owner: np.ndarray, count: np.ndarray, sums: np.ndarray, squares: np.ndarray) -> None:
        for c in np.unique(owner):
            own = owner == c
            self.count[c] += int(count[own].sum())
            self.sums[c] += sums[own].sum(0).astype(object)
            self.squares[c] += int(squares[own].sum())

    def add_forest(self, forest: Forest) -> None:
        _, leaves, mask = forest.filter(self)
        self.points += len(forest.points)
        if len(leaves):
            rows, cluster = forest.resolve(leaves, mask)
            points = forest.points[rows].astype(np.int64 if forest.exact else object)
            self.add(cluster, np.ones(len(rows), np.int64), points, (points**2).sum(1))
            self.resolved += len(rows)


def forests(batches: Iterator[pa.RecordBatch], centres: list[list[int]], leaves: int = POINTS // LEAF) -> Iterator[Forest]:
    for batch in batches:
        for at in range(0, batch.num_rows, leaves):
            yield Forest(batch.slice(at, leaves), centres)


def cluster_totals(leaves: DataFrame, centres: list[list[int]]) -> dict[tuple[int, int], int]:
    """(cluster, place) -> sum. k * (width + 2) numbers come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = Totals(len(centres), len(centres[0]))
        for forest in forests(batches, centres):
            totals.add_forest(forest)
        rows = [(c, place, Decimal(int(x))) for c in range(totals.k) if totals.count[c] for place, x in ((COUNT, totals.count[c]), (SQUARES, totals.squares[c]), *enumerate(totals.sums[c]))]
        if rows:
            cluster, place, value = zip(*rows)
            yield pa.record_batch([pa.array(cluster, pa.int32()), pa.array(place, pa.int32()), pa.array(split(value), pa.struct([("high", pa.decimal128(38, 0)), ("low", pa.decimal128(38, 0))]))], names=["cluster", "place", "value"])

    found = map_batches(leaves, run, "cluster int, place int, value struct<high: decimal(38,0), low: decimal(38,0)>")
    summed = found.groupBy("cluster", "place").agg(F.sum("value.high").alias("high"), F.sum("value.low").alias("low"))
    return {(r["cluster"], r["place"]): int(r["high"]) * PART + int(r["low"]) for r in summed.collect()}


PART = 10**29


def split(values: tuple[Decimal, ...]) -> list[dict[str, Decimal]]:
    """Each as high * PART + low, so that Spark's decimals hold sums of 10**9 of them."""
    parts = [divmod(int(v), PART) for v in values]
    if any(abs(h) >= PART for h, _ in parts):
        raise ValueError("a sum of 10**58 or more")
    return [{"high": Decimal(h), "low": Decimal(low)} for h, low in parts]


def first_centres(kept: DataFrame, k: int, seed: int) -> list[list[int]]:
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = kept.select(key.alias("key"), "embedding").orderBy("key", "embedding").limit(k).collect()  # k vectors
    return [[int(x) for x in whole(np.array(r["embedding"]))] for r in rows]


def clusters(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, seed: int = SEED, width: int = WIDTH, points: int = POINTS) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    spark, kept = vectors.sparkSession, kept_vectors(vectors, width)
    centres = first_centres(kept, k, seed)
    schema = "vec_id long, cluster int, distance long"
    known = "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"
    if not centres:
        return spark.createDataFrame([], schema).join(spark.createDataFrame([], known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
    leaves = shared_checkpoint(trees(kept, points))
    for _ in range(rounds):
        found = cluster_totals(leaves, centres)
        centres = [[found[c, i] // found[c, COUNT] for i in range(width)] if (c, COUNT) in found else old for c, old in enumerate(centres)]
    found = cluster_totals(leaves, centres)
    own = {c: found[c, SQUARES] - 2 * sum(x * found[c, i] for i, x in enumerate(centre)) + found[c, COUNT] * sum(x * x for x in centre) for c, centre in enumerate(centres) if (c, COUNT) in found}
    total = min(sum(own.values()), LARGEST)
    rows = [(c, min(x, LARGEST), total, hashlib.sha256(",".join(map(str, centres[c])).encode()).hexdigest()) for c, x in own.items()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for forest in forests(batches, centres):
            cluster, distance = forest.nearest()
            yield pa.record_batch([forest.ids, pa.array(cluster, pa.int32()), pa.array(np.minimum(distance, LARGEST if not forest.exact else 2.0**53).astype(np.int64))], names=["vec_id", "cluster", "distance"])

    assigned = map_batches(leaves, run, schema)
    return assigned.join(F.broadcast(spark.createDataFrame(rows, known)), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters(table(spark, sf_dir, "embeddings"))

"""K-means on array columns: assignment, steps from given centres, inertia, silhouettes, Voronoi grids; library fits."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions.tables import remove, shared_checkpoint, shared_folder, spread, totals
from vellum.operators.vectors import as_double, matrix

BLOCK_BYTES = 1 << 24  # vectors and bounds of a block
SLACK = 1 + 1e-9  # a bound counts only where it is beyond what rounding could change
STATE = "x binary, own binary, upper binary, lower binary, stats binary"


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def centre_literal(centres: list[list[float]]) -> Column:
    """k centres are few by nature and travel in the plan: points are never joined with them."""
    return F.array(*(F.array(*(F.lit(float(x)) for x in c)) for c in centres))


def assign(points: DataFrame, centres: list[list[float]], vector: str = "embedding") -> DataFrame:
    """Adds cluster, the nearest centre (the first of equally near ones), and squared distance, both null for a null vector; one
    scan, no shuffle."""
    near = F.transform(centre_literal(centres), lambda c, i: F.struct(squared_distance(as_double(F.col(vector)), c).alias("d"), i.alias("i")))
    df = points.withColumn("_near", F.when(F.col(vector).isNotNull(), F.array_min(near)))
    return df.withColumns({"cluster": F.col("_near.i"), "distance2": F.col("_near.d")}).drop("_near")


def distances(points: DataFrame, centres: list[list[float]], vector: str = "embedding") -> DataFrame:
    return points.withColumn("distances", F.transform(centre_literal(centres), lambda c: F.sqrt(squared_distance(as_double(F.col(vector)), c))))


def means(points: DataFrame, group: str, width: int, vector: str = "embedding") -> DataFrame:
    """group, centre: component averages by partial aggregates, not by a row for each component."""
    v = as_double(F.col(vector))
    return points.groupBy(group).agg(F.array(*(F.avg(v[k]) for k in range(width))).alias("centre"))


def inertia(points: DataFrame, centres: list[list[float]], vector: str = "embedding") -> DataFrame:
    out = assign(points, centres, vector).agg(F.sum("distance2").alias("inertia"))
    return out.select(F.round("inertia", 6).alias("inertia"), F.round(-F.col("inertia"), 6).alias("score"))


def lloyd(points: DataFrame, centres: list[list[float]], steps: int = 1, vector: str = "embedding") -> list[list[float]]:
    """Centres after some steps; a centre without points stays. What comes to the driver is k centres a step."""
    for _ in range(steps):
        found = {r["cluster"]: r["centre"] for r in means(assign(points, centres, vector), "cluster", len(centres[0]), vector).collect()}
        centres = [list(found.get(k, c)) for k, c in enumerate(centres)]
    return centres


def nearest(x: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray, centres: np.ndarray) -> int:
    """Moves points to their nearest centres (the first of equally near ones), in place, and returns how many distances
    that took. ``upper`` is at least the distance to the own centre, ``lower`` at most that to each centre."""
    between = np.sqrt(((centres[:, None] - centres[None]) ** 2).sum(2))
    np.fill_diagonal(between, np.inf)
    loose = upper * SLACK >= between.min(1)[own] / 2
    rows = np.flatnonzero(loose)
    tight, tried = np.zeros(len(x), dtype=bool), 0
    for c in range(len(centres)):
        beaten = lambda r: (own[r] != c) & (upper[r] * SLACK >= lower[r, c]) & (upper[r] * SLACK >= between[own[r], c] / 2)  # noqa: B023, E731
        near = rows[beaten(rows)]
        stale = near[~tight[near]]
        upper[stale] = np.sqrt(((x[stale] - centres[own[stale]]) ** 2).sum(1))
        lower[stale, own[stale]] = upper[stale]
        tight[stale] = True
        near = near[beaten(near)]
        lower[near, c] = np.sqrt(((x[near] - centres[c]) ** 2).sum(1))
        tried += len(stale) + len(near)
        closer = near[(lower[near, c] < upper[near]) | ((lower[near, c] == upper[near]) & (c < own[near]))]
        own[closer], upper[closer] = c, lower[closer, c]
    return tried


def elkan(points: DataFrame, centres: list[list[float]], steps: int = 1, vector: str = "embedding") -> tuple[list[list[float]], list[int]]:
    """The centres of ``lloyd`` after ``steps``, or when no point moves any more, and how many distances each step took.

    By the triangle inequality: each point keeps an upper bound of the distance to its centre and a lower bound for every centre, and
    both follow the centres' moves, so a distance is evaluated only where the bounds leave it open. Vectors stand with their
    bounds in blocks, written anew by each step, as the next one reads both; sums of the blocks are what is
    aggregated. Vectors that are null, hold a null or have another length take no part; a centre without points stays.
    Centres come to the driver, points don't.
    """
    spark, k, width = points.sparkSession, len(centres), len(centres[0])
    most = max(1, BLOCK_BYTES // (8 * (width + k + 2)))
    v = F.col(vector)
    usable = spread(points.filter((F.size(v) == width) & ~F.exists(v, lambda x: x.isNull())).select(as_double(v).alias("v")))
    folder = f"{shared_folder(spark, 'elkan')}/elkan-{uuid.uuid4().hex}"

    def state(x: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray, tried: int, moved: int) -> pa.RecordBatch:
        member = (own[:, None] == np.arange(k)).astype(float)
        stats = np.concatenate([(member.T @ x).ravel(), member.sum(0), (tried, moved)])
        return pa.RecordBatch.from_pydict({name: [m.tobytes()] for name, m in zip(("x", "own", "upper", "lower", "stats"), (x, own, upper, lower, stats))})

    def first(now: np.ndarray):
        def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in parts:
                for lo in range(0, part.num_rows, most):
                    x = part.column(0).slice(lo, most).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
                    lower = np.stack([np.sqrt(((x - c) ** 2).sum(1)) for c in now], 1)
                    own = lower.argmin(1)
                    yield state(x, own, lower.min(1), lower, lower.size, len(x))

        return run

    def further(now: np.ndarray, gone: np.ndarray):
        def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in parts:
                for row in zip(*(part.column(name) for name in ("x", "own", "upper", "lower"))):
                    x, own, upper, lower = (np.frombuffer(m.as_buffer(), dtype).copy() for m, dtype in zip(row, (float, np.int64, float, float)))
                    x, lower, before = x.reshape(-1, width), lower.reshape(-1, k), own.copy()
                    lower = np.maximum(lower - gone, 0)
                    upper += gone[own]
                    tried = nearest(x, own, upper, lower, now)
                    yield state(x, own, upper, lower, tried, int((own != before).sum()))

        return run

    def sums(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(k * width + k + 2)
        for part in parts:
            for row in part.column(0):
                out += np.frombuffer(row.as_buffer())
        yield pa.RecordBatch.from_pydict({"k": pa.array(np.arange(len(out), dtype="int32")), "value": pa.array(out)})

    now, gone, taken = np.array(centres, dtype=float), np.zeros(k), []
    try:
        for n in range(steps):
            last, path = f"{folder}/{n - 1}", f"{folder}/{n}"
            held = usable.mapInArrow(first(now), STATE) if n == 0 else spark.read.schema(STATE).parquet(last).mapInArrow(further(now, gone), STATE)
            held.write.parquet(path)
            if n:
                remove(spark, last)
            found = totals(spark.read.schema(STATE).parquet(path).select("stats").mapInArrow(sums, "k int, value double"), k * width + k + 2)
            total, size = found[: k * width].reshape(k, width), found[k * width : -2]
            taken.append(int(found[-2]))
            if not found[-1]:
                break
            after = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], now)
            now, gone = after, np.sqrt(((after - now) ** 2).sum(1))
    finally:
        remove(spark, folder)
    return now.tolist(), taken


def kmeans(points: DataFrame, k: int, seed: int = 1, tries: int = 1, vector: str = "embedding"):
    """The library's fit of least cost over ``tries`` seeds, on a vector column."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    data = points.withColumn("features", array_to_vector(as_double(F.col(vector))))
    fits = [KMeans(k=k, seed=seed + t, featuresCol="features").fit(data) for t in range(tries)]
    return min(fits, key=lambda m: m.summary.trainingCost)


def elbow(points: DataFrame, most: int, vector: str = "embedding") -> list[tuple[int, float]]:
    return [(k, kmeans(points, k, vector=vector).summary.trainingCost) for k in range(2, most + 1)]


def far(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances between the rows of ``x`` and ``y``, as a product of matrices; where that would lose digits, from differences."""
    norms = (x**2).sum(1)[:, None] + (y**2).sum(1)
    squares = norms - 2 * (x @ y.T)
    norms *= 1e-6
    row, at = np.nonzero(squares <= norms)
    for lo in range(0, len(row), 1 << 14):
        r, c = row[lo : lo + (1 << 14)], at[lo : lo + (1 << 14)]
        squares[r, c] = ((x[r] - y[c]) ** 2).sum(1)
    return np.sqrt(squares, out=squares)


def tiles(length: int, size: int) -> list[slice]:
    return [slice(lo, lo + size) for lo in range(0, length, size)]


def by_place(d: np.ndarray, place: np.ndarray, k: int) -> np.ndarray:
    """Sums over the columns of each cluster; those of one cluster stand side by side."""
    out, starts = np.zeros((len(d), k)), np.flatnonzero(np.diff(place, prepend=-1))
    out[:, place[starts]] = np.add.reduceat(d, starts, axis=1)
    return out


def silhouette(points: DataFrame, cluster: str, key: str = "vec_id", vector: str = "embedding", block: int = BLOCK_BYTES) -> DataFrame:
    """key, cluster, silhouette with Euclidean distances, exactly; 0 for a point without vector or cluster.

    Every point needs its mean distance to every cluster, which is quadratic in the points by definition. Equal vectors
    of a cluster count as one, with their number. Vectors are dealt into blocks of about ``block`` bytes, with their sums; two
    blocks meet once, in a task that adds up distances for both, and what comes of it is a row for each block. Clusters are few
    by nature, their sizes come to the driver.
    """
    rows = points.select(F.col(key).alias("k"), F.col(cluster).cast("long").alias("c"), F.col(vector).alias("v"))
    once = rows.filter(F.col("c").isNotNull() & F.col("v").isNotNull()).groupBy("c", "v").agg(F.count(F.lit(1)).alias("n"))
    once = shared_checkpoint(once.withColumn("id", F.monotonically_increasing_id()))
    found = once.groupBy("c").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("items"), F.max(F.size("v")).alias("width")).orderBy("c").collect()  # a row for each cluster
    k, width, items = max(1, len(found)), max((r["width"] for r in found), default=1), sum(r["items"] for r in found)
    clusters, size = np.array([r["c"] for r in found], dtype=np.int64), F.array(*(F.lit(r["n"]) for r in found)).cast("array<double>")
    n = max(1, -(-items * 8 * (width + k + 2) // block), min(points.sparkSession.sparkContext.defaultParallelism, items // 1024))
    tasks = min(n * (n + 1), 1024)
    dealt = once.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int"))
    left = dealt.withColumnRenamed("b", "i").withColumn("j", F.explode(F.sequence(F.col("i"), F.lit(n - 1)))).repartition(tasks, "i", "j")
    other = dealt.select(*(F.col(c).alias(f"other_{c}") for c in ("c", "v", "n", "id")), F.col("b").alias("other_j"))
    right = other.withColumn("other_i", F.explode(F.sequence(F.lit(0), F.col("other_j")))).repartition(tasks, "other_i", "other_j")

    def held(t: pa.Table) -> tuple[np.ndarray, ...]:
        """Vectors, places of their clusters, numbers and ids, in one order by cluster."""
        t = t.rename_columns([c.removeprefix("other_") for c in t.column_names]).sort_by([("c", "ascending"), ("id", "ascending")])
        return matrix(t.column("v"), width).astype(float), np.searchsorted(clusters, t.column("c").to_numpy()), t.column("n").to_numpy(), t.column("id").to_numpy()

    def sums(group: tuple[pa.Scalar, ...], own: pa.Table, other: pa.Table) -> pa.Table:
        if not len(own) or not len(other):  # an empty side comes without columns
            return pa.table({"b": pa.array([], pa.int32()), "ids": pa.array([], pa.binary()), "totals": pa.array([], pa.binary())})
        (x, a, na, ids), (y, b, nb, others) = held(own), held(other)
        to, back = np.zeros((len(x), k)), np.zeros((len(y), k))
        for part, beside in product(tiles(len(x), 256), tiles(len(y), 512)):  # small enough for a core's cache
            d = far(x[part], y[beside])
            back[beside] += by_place((d * na[part, None]).T, a[part], k)
            d *= nb[beside]
            to[part] += by_place(d, b[beside], k)
        i, j = (g.as_py() for g in group)
        sides = [(i, ids, to), (j, others, back)][: 1 + (i != j)]
        return pa.table({"b": pa.array([x for x, *_ in sides], pa.int32()), "ids": [x.tobytes() for _, x, _ in sides], "totals": [x.tobytes() for *_, x in sides]})

    def added(parts: pa.Table) -> pa.Table:
        ids = np.frombuffer(parts.column("ids")[0].as_buffer(), dtype=np.int64)
        total = np.zeros(len(ids) * k)
        for part in parts.column("totals"):
            total += np.frombuffer(part.as_buffer())
        return pa.table({"id": ids, "totals": pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1, dtype=np.int32) * k), pa.array(total))})

    met = left.groupBy("i", "j").cogroup(right.groupBy("other_i", "other_j")).applyInArrow(sums, "b int, ids binary, totals binary")
    total = met.groupBy("b").applyInArrow(added, "id long, totals array<double>").join(once, "id")
    places = F.array(*(F.lit(int(c)) for c in clusters)).cast("array<long>")
    mean = F.transform("totals", lambda t, i: F.struct((F.get(places, i) == F.col("c")).alias("own"), t.alias("t"), F.get(size, i).alias("n")))
    a = F.get(F.transform(F.filter(mean, lambda m: m["own"]), lambda m: F.try_divide(m["t"], m["n"] - 1)), F.lit(0))
    b = F.array_min(F.transform(F.filter(mean, lambda m: ~m["own"]), lambda m: m["t"] / m["n"]))
    value = total.select("c", "v", F.try_divide(b - a, F.greatest(a, b)).alias("s"))
    return rows.join(value, ["c", "v"], "left").select(F.col("k").alias(key), F.col("c").alias(cluster), F.coalesce("s", F.lit(0.0)).alias("silhouette"))


def voronoi(spark: SparkSession, centres: list[list[float]], low: float, high: float, steps: int) -> DataFrame:
    """x, y, cluster on a grid over two dimensions."""
    axis = F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda i: F.round(F.lit(low) + i * ((high - low) / (steps - 1)), 9))
    grid = spark.range(1).select(F.explode(axis).alias("x")).select("x", F.explode(axis).alias("y"))
    return assign(grid.withColumn("embedding", F.array("x", "y")), centres).select("x", "y", "cluster")


def blobs(spark: SparkSession, rows: int, centres: list[list[float]], spread: list[float], seed: int = 7) -> DataFrame:
    """id, label, embedding: normal clouds around centres."""
    df = spark.range(rows).withColumn("label", (F.col("id") % len(centres)).cast("int"))
    centre, width = F.element_at(centre_literal(centres), F.col("label") + 1), F.element_at(F.array(*map(F.lit, spread)), F.col("label") + 1)
    return df.withColumn("embedding", F.array(*(centre[k] + width * F.randn(seed + k) for k in range(len(centres[0])))))


def painted(pixels: DataFrame, centres: list[list[float]], vector: str = "embedding") -> DataFrame:
    """Image segmentation: each pixel in the colour of its centre."""
    return assign(pixels, centres, vector).withColumn("colour", F.element_at(centre_literal(centres), F.col("cluster") + 1))

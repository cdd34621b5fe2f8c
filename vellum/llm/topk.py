"""Exact top-k inner products by pivot-table elimination.

Vectors become whole numbers floor(256 * x), and a table of them is written with the distance of each to ``PIVOTS``
pivots. For a query q and a candidate c the triangle inequality gives |q - c| >= max over pivots |d(q, p) - d(c, p)|, and
as 2 q.c = |q|^2 + |c|^2 - |q - c|^2, an upper bound of the score. Candidates are evaluated in the order of this bound, in
steps, until the bound of the next one falls below the k-th best score: no other can do better, so the result is
exact. A step of a group of queries is one product of matrices over the candidates due for any of them. Pivots are vectors
far from one another out of a bounded sample, which is all that the driver gets.

The queries are a stated set. Candidates are dealt out to cells and queries to blocks, both of bounded size; a task has one
cell and one block at a time, by a cogroup, and gives the k best of the cell for each query of the block. The k best of all
cells are chosen by a window over the query, which keeps k rows a task before the shuffle.
Scores are computed in float64 where every inner product is surely below 2**53, else in Python's whole numbers.

Vectors that are null or hold null or non-finite components take no part. Vectors are only compared with those of the
same length. Rows with the query's own vec_id are not candidates; equal scores go to the smaller vec_id; a candidate row
that is repeated counts as often as it stands there. Of several query rows of one vec_id the least vector asks. A row
without vec_id takes no part. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellum.llm.common import map_batches, shared_checkpoint, table

K = 5
EVERY = 50
PIVOTS = 24
BLOCK = 50_000  # queries at most in a block, on average
CELL = 50_000  # candidates in a cell, on average, where there are very many
LEAST_CELL = 2048
BATCH = 8192
STEPS = (64, 512)


def whole_numbers(vectors: DataFrame) -> DataFrame:
    """vec_id and v (array<double>, all whole numbers) of the vectors that take part."""
    v = F.col("embedding").cast("array<double>")
    fine = F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select("vec_id", "embedding").filter(fine).select("vec_id", F.transform(v, lambda x: F.rint(F.floor(x * 256).cast("double"))).alias("v"))


def matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of the vectors, and all components one after another."""
    return np.diff(column.offsets.to_numpy()), column.flatten().to_numpy(zero_copy_only=False)


def exact_in_floats(q: np.ndarray, c: np.ndarray) -> bool:
    return np.abs(q).max(initial=0) * np.abs(c).max(initial=0) * max(q.shape[1], 1) < 2**53


def exact_scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """q @ c.T in whole numbers. q and c hold whole numbers as float64."""
    if exact_in_floats(q, c):
        return (q @ c.T).astype(np.int64)
    return np.array([[max(-(2**63), min(2**63 - 1, sum(int(x) * int(y) for x, y in zip(a, b)))) for b in c] for a in q], np.int64).reshape(len(q), len(c))


class Queries:
    """Queries of one length with their distances to the pivots."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, to_pivots: np.ndarray):
        self.ids, self.vectors, self.to_pivots = ids, vectors, to_pivots
        self.squares = (vectors**2).sum(1)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a**2).sum(1)[:, None] + (b**2).sum(1) - 2 * a @ b.T, 0))


def search(queries: Queries, ids: np.ndarray, vectors: np.ndarray, to_pivots: np.ndarray, best: tuple[np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best (scores, ids) of each query after these candidates too; ``best`` is sorted by falling score."""
    squares = (vectors**2).sum(1)
    scores, keys = best
    columns_ = np.ascontiguousarray(to_pivots.T)
    largest = max(x.max(initial=0) for x in (to_pivots, queries.to_pivots, np.sqrt(squares), np.sqrt(queries.squares)))
    for lo in range(0, len(queries.ids), 64):
        own = slice(lo, lo + 64)
        gap = np.zeros((min(64, len(queries.ids) - lo), len(ids)), np.float32)
        work = np.empty_like(gap)
        for p in range(len(columns_)):
            np.subtract(queries.to_pivots[own, p, None], columns_[p], out=work)
            np.maximum(gap, np.abs(work, out=work), out=gap)
        gap = np.maximum(gap * (1 - 1e-5) - (1e-2 + 2e-6 * largest), 0)  # distances are rounded
        bound = (queries.squares[own, None] + squares[None, :] - gap.astype(np.float64) ** 2) / 2
        bound += np.abs(bound) * 1e-12 + 1e-3
        small = exact_in_floats(queries.vectors[own], vectors)
        for step in (*STEPS, len(ids)):  # so many of the highest bounds that aren't evaluated yet
            enough = scores[own, -1][:, None]  # an equal score may have a smaller id
            if step < len(ids):
                enough = np.maximum(enough, np.partition(bound, -step, axis=1)[:, -step, None])
            due = bound >= enough
            columns = np.flatnonzero(due.any(0))
            if not len(columns):
                break
            due = due[:, columns] & (ids[columns] != queries.ids[own, None])
            found = (queries.vectors[own] @ vectors[columns].T).astype(np.int64) if small else exact_scores(queries.vectors[own], vectors[columns])
            due &= found >= scores[own, -1][:, None]
            for q in np.flatnonzero(due.any(1)):
                hits = np.flatnonzero(due[q])
                if len(hits) > 4 * k:
                    least = np.partition(found[q, hits], -k)[-k]
                    hits = hits[found[q, hits] >= least]
                both, named = np.r_[scores[lo + q], found[q, hits]], np.r_[keys[lo + q], ids[columns[hits]]]
                first = np.lexsort((named, -both))[:k]
                scores[lo + q], keys[lo + q] = both[first], named[first]
            bound[:, columns] = np.where(bound[:, columns] >= enough, -np.inf, bound[:, columns])
    return scores, keys


LEAST = -(2**63) + 1


def with_distances(vectors: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """``far``: the distances to the pivots of the vector's length, none where it has no pivots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, flat = matrix(batch.column("v"))
            at, far = np.r_[0, np.cumsum(size)], [[]] * len(size)
            for width in np.unique(size):
                rows = np.flatnonzero(size == width)
                if width in pivots:
                    for r, d in zip(rows, distances(flat[at[rows][:, None] + np.arange(width)], pivots[width]).astype(np.float32)):
                        far[r] = d
            yield pa.record_batch([*batch.columns, pa.array(far, pa.list_(pa.float32()))], names=[*batch.schema.names, "far"])

    return map_batches(vectors, run, "vec_id long, v array<double>, far array<float>")


def by_width(rows: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Ids, vectors and distances to the pivots, by the vectors' length."""
    rows = rows.combine_chunks()
    column = lambda name: rows.column(name).chunk(0)
    if not rows.num_rows:
        return {}
    (size, flat), (count, far) = matrix(column("v")), matrix(column("far"))
    at, begin, ids, out = np.r_[0, np.cumsum(size)], np.r_[0, np.cumsum(count)], column("vec_id").to_numpy(), {}
    for width in np.unique(size):
        own = np.flatnonzero(size == width)
        out[int(width)] = ids[own], flat[at[own][:, None] + np.arange(width)], far[begin[own][:, None] + np.arange(count[own[0]])]
    return out


def search_cell(k: int):
    """For the candidates of a cell and the queries of a block: query_id, vec_id, score of the k best of each query."""

    def run(candidates: pa.Table, asked: pa.Table) -> pa.Table:
        found, there = [], by_width(candidates)
        for width, (ids, vectors, to_pivots) in by_width(asked).items():
            if width not in there:
                continue
            queries, best = Queries(ids, vectors, to_pivots), (np.full((len(ids), k), LEAST), np.full((len(ids), k), 2**63 - 1))
            own, theirs, far = there[width]
            for lo in range(0, len(own), BATCH):
                part = slice(lo, lo + BATCH)
                best = search(queries, own[part], theirs[part], far[part], best, k)
            row, place = np.nonzero(best[0] > LEAST)
            found.append((ids[row], best[1][row, place], best[0][row, place]))
        columns = [np.concatenate(x) for x in zip(*found)] if found else [np.zeros(0, np.int64)] * 3
        return pa.table([pa.array(x, pa.int64()) for x in columns], names=["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, is_query: F.Column, k: int = K, pivots: int = PIVOTS, block: int = BLOCK, cell: int = CELL) -> DataFrame:
    """query_id, rank, vec_id, score."""
    spark, whole = vectors.sparkSession, whole_numbers(vectors)
    sample = whole.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(64 * pivots).toArrow().combine_chunks()
    known = {}
    if sample.num_rows:
        size, flat = matrix(sample.column("v").chunk(0))
        at = np.r_[0, np.cumsum(size)]
        known = {int(w): spread(flat[at[np.flatnonzero(size == w)][:, None] + np.arange(w)], pivots) for w in np.unique(size)}
    own = shared_checkpoint(with_distances(whole, known))
    asked = own.filter(is_query).groupBy("vec_id").agg(F.min(F.struct("v", "far")).alias("least")).select("vec_id", "least.*")
    rows, questions = own.count(), asked.count()
    blocks = max(1, -(-questions // block))
    cells = max(1, -(-rows // cell), min(2 * spark.sparkContext.defaultParallelism, -(-rows // LEAST_CELL)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = own.withColumn("cell", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(cells)).cast("int")).withColumn("block", every(blocks))
    asking = asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")).withColumn("cell", every(cells))
    found = dealt.groupBy("block", "cell").cogroup(asking.groupBy("block", "cell")).applyInArrow(search_cell(k), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def spread(known: np.ndarray, pivots: int) -> np.ndarray:
    """Vectors far from one another: each the farthest from those before it."""
    chosen = [0]
    far = distances(known, known[:1])[:, 0]
    while len(chosen) < min(pivots, len(known)):
        chosen.append(int(far.argmax()))
        far = np.minimum(far, distances(known, known[chosen[-1:]])[:, 0])
    return known[chosen]


def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % EVERY == 0)

"""Exact nearest neighbours by cosine similarity, on ARRAY columns."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null if either vector has no length."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def cosine_topk(vectors: DataFrame, query: list[float], k: int = 8, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k rows most similar to one query vector, ties to the smaller key. The vector is a literal of the plan, so
    this is one scan that ends in TakeOrderedAndProject: no shuffle of rows, k rows from each task."""
    literal = F.array(*(F.lit(float(x)) for x in query))
    scored = vectors.select(key, F.round(cosine(F.col(vector), literal), 6).alias("similarity")).filter(F.col("similarity").isNotNull())
    return scored.orderBy(F.desc("similarity"), key).limit(k)


def cosine_topk_batch(vectors: DataFrame, questions: DataFrame, k: int = 8, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k most similar rows for each question (question_id, question). ``questions`` is a bounded set by contract
    (``BATCH`` at most, checked), so it is broadcast; each task keeps k rows a question (WindowGroupLimit). A pair without a
    similarity (a null vector, one without length, vectors of two lengths) takes no part."""
    scored = vectors.crossJoin(F.broadcast(questions)).select("question_id", key, F.round(cosine(F.col(vector), F.col("question")), 6).alias("similarity"))
    rank = F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("similarity"), key))
    return scored.filter(F.col("similarity").isNotNull()).withColumn("rank", rank).filter(F.col("rank") <= k)


def usable(vectors: DataFrame, key: str, vector: str, *more: str) -> DataFrame:
    """key, v (array<double>), width and ``more`` of the vectors that have a similarity to others: neither null nor with null or
    non-finite components nor all zeros. Rows without a key are left out."""
    v = F.col(vector).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    own = vectors.filter(F.col(key).isNotNull() & F.col(vector).isNotNull())
    return own.select(F.col(key).cast("long").alias("key"), v.alias("v"), F.size(vector).alias("width"), fine.alias("fine"), *more).filter("fine").drop("fine")


def matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width) if len(column) else np.zeros((0, width))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled first, so that no square overflows."""
    x = x / np.abs(x).max(1, keepdims=True, initial=0)
    return x / np.sqrt((x**2).sum(1, keepdims=True))


CELL_BYTES = 8 << 20  # of the vectors of a cell, or the questions of a block, on average


def shares(df: DataFrame, size: int) -> int:
    return max(1, -(-(df.agg(F.sum(8 * F.col("width").cast("long"))).first()[0] or 0) // size))


def every(n: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))


def best_dealt(dealt: DataFrame, asking: DataFrame, groups: tuple[str, ...], k: int, key: str) -> DataFrame:
    """question_id, key, similarity, rank: the k best vectors (key, v) for each question (key, v) among those that stand in
    a group with it; the first of ``groups`` is the width."""

    def best(group: tuple[pa.Scalar, ...], own: pa.Table, asked: pa.Table) -> pa.Table:
        width, ids, keys, sims = group[0].as_py(), [], [], []
        x, q, names = unit(matrix(own.column("v"), width)), unit(matrix(asked.column("v"), width)), own.column("key").to_numpy()
        for lo in range(0, len(q) if len(x) else 0, 64):
            scores = np.round(q[lo : lo + 64] @ x.T, 6)
            least = np.partition(scores, -k, axis=1)[:, -k, None] if k < len(x) else np.full((len(scores), 1), -np.inf)
            row, at = np.nonzero(scores >= least)
            order = np.lexsort((names[at], -scores[row, at], row))
            row, at = row[order], at[order]
            first = np.searchsorted(row, np.arange(len(scores)))[row]
            row, at = (c[np.arange(len(row)) - first < k] for c in (row, at))
            ids.append(asked.column("key").to_numpy()[lo + row])
            keys.append(names[at])
            sims.append(scores[row, at])
        columns = [np.concatenate(c) if c else [] for c in (ids, keys, sims)]
        return pa.table([pa.array(c, kind) for c, kind in zip(columns, (pa.int64(), pa.int64(), pa.float64()))], names=["question_id", "key", "similarity"])

    found = dealt.groupBy(*groups).cogroup(asking.groupBy(*groups)).applyInArrow(best, "question_id long, key long, similarity double")
    rank = F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("similarity"), "key"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("question_id", F.col("key").alias(key), "similarity", F.col("rank").cast("long").alias("rank"))


def cosine_topk_table(vectors: DataFrame, questions: DataFrame, k: int = 8, key: str = "vec_id", vector: str = "embedding", size: int = CELL_BYTES) -> DataFrame:
    """question_id, key, similarity, rank: what ``cosine_topk_batch`` gives, for a table of questions of any size.

    Vectors are dealt out to cells and questions to blocks of about ``size`` bytes, by hashes of their keys; a task takes one
    cell and one block, as a product of matrices, and gives the k best of the cell for each question of the block. The k
    best of all cells are chosen by a window, which keeps k rows a task before the shuffle."""
    own, asked = usable(vectors, key, vector), usable(questions, "question_id", "question")
    cells, blocks = shares(own, size), shares(asked, size)
    dealt = own.withColumn("cell", F.pmod(F.xxhash64("key", "v"), F.lit(cells)).cast("int")).withColumn("block", every(blocks))
    asking = asked.withColumn("block", F.pmod(F.xxhash64("key", "v"), F.lit(blocks)).cast("int")).withColumn("cell", every(cells))

    return best_dealt(dealt, asking, ("width", "block", "cell"), k, key)


BATCH = 10_000
PROBES = 6


def checked(questions: DataFrame, most: int = BATCH) -> DataFrame:
    """``questions`` if they are at most ``most``; a larger set is to be asked in several calls."""
    if questions.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} questions; ask in blocks")
    return questions


def blocks(questions: DataFrame, most: int = BATCH, key: str = "question_id") -> list[DataFrame]:
    """``questions`` in checked blocks of at most ``most``, dealt out by a hash of the key."""
    n = questions.count()
    shares = 1 if n <= most else -(-2 * n // most)
    return [checked(questions if shares == 1 else questions.filter(F.pmod(F.xxhash64(key), F.lit(shares)) == b), most) for b in range(shares)]


def in_blocks(questions: DataFrame, ask, most: int = BATCH, key: str = "question_id") -> DataFrame:
    """``ask`` of all questions, block by block."""
    return reduce(DataFrame.unionAll, [ask(part) for part in blocks(questions, most, key)])


def ivf_cells(vectors: DataFrame, k: int, seed: int = 1, sample: float = 1.0, vector: str = "embedding") -> tuple[DataFrame, list[list[float]]]:
    """The inverted file: vectors with their cell, and the cells' centres. K-means may be fitted on a sample; every
    vector is put into a cell. Stored by cell (partitionBy), a probe reads only the cells that it needs."""
    from vellum.operators import clustering

    fitted = clustering.kmeans(vectors if sample >= 1 else vectors.sample(sample, seed), k, seed, vector=vector)
    centres = [list(map(float, c)) for c in fitted.clusterCenters()]
    return clustering.assign(vectors, centres, vector).drop("distance2").withColumnRenamed("cluster", "cell"), centres


def ivf_topk(indexed: DataFrame, centres: list[list[float]], query: list[float], k: int = 8, probes: int = PROBES, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Approximate top k: only the ``probes`` cells nearest to the query are scanned, by a filter that prunes."""
    near = np.argsort(((np.array(centres) - np.array(query)) ** 2).sum(1), kind="stable")[:probes]
    return cosine_topk(indexed.filter(F.col("cell").isin(*map(int, near))), query, k, key, vector)


def near_cells(question: Column, centres: list[list[float]], probes: int) -> Column:
    """The cells of the ``probes`` centres nearest to the question."""
    distance2 = lambda c: F.aggregate(F.zip_with(as_double(question), F.array(*map(F.lit, c)), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    cells = F.array(*(F.struct(distance2(c).alias("distance2"), F.lit(i).alias("cell")) for i, c in enumerate(centres)))
    return F.slice(F.array_sort(cells), 1, probes)["cell"]


def ivf_topk_batch(indexed: DataFrame, centres: list[list[float]], questions: DataFrame, k: int = 8, probes: int = PROBES, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Approximate top k for each of the ``checked`` questions (question_id, question), each in its own ``probes``
    cells."""
    near = questions.select("question_id", "question", F.explode(near_cells(F.col("question"), centres, probes)).alias("cell"))
    scored = indexed.join(F.broadcast(near), "cell").select("question_id", key, F.round(cosine(F.col(vector), F.col("question")), 6).alias("similarity")).filter(F.col("similarity").isNotNull())
    rank = F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("similarity"), key))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= k)


def ivf_topk_table(indexed: DataFrame, centres: list[list[float]], questions: DataFrame, k: int = 8, probes: int = PROBES, key: str = "vec_id", vector: str = "embedding", size: int = CELL_BYTES) -> DataFrame:
    """What ``ivf_topk_batch`` gives, for a table of questions of any size: each cell is dealt out to parts of about
    ``size`` bytes at most, and a task takes one part and one block of the questions that probe its cell, as in ``cosine_topk_table``."""
    own, asked = usable(indexed, key, vector, "cell"), usable(questions, "question_id", "question")
    parts, blocks = shares(own, size), shares(asked, size)
    dealt = own.withColumn("part", F.pmod(F.xxhash64("key", "v"), F.lit(parts)).cast("int")).withColumn("block", every(blocks))
    near = asked.withColumn("cell", F.explode(near_cells(F.col("v"), centres, probes)))
    asking = near.withColumn("block", F.pmod(F.xxhash64("key", "v"), F.lit(blocks)).cast("int")).withColumn("part", every(parts))
    return best_dealt(dealt, asking, ("width", "block", "cell", "part"), k, key)

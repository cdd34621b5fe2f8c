"""A stored graph index for cosine search: navigable small worlds, one for each shard of the vectors.

Vectors are dealt out to shards of ``SHARD`` on average by a hash of their key. A shard's task makes one node of equal
vectors (with all their keys), links each node to near ones that aren't nearer to one another, to the nodes that link to it,
and to a few drawn at random, which keep the graph in one piece. The index is a table of nodes, to be written as
Parquet and read again by later sessions.

A search sends blocks of questions to all shards. In a shard, beams of ``beam`` nodes start from a few entries and go on to the
neighbours of the best node that hasn't been expanded, for all questions of a block together, until no beam changes. The
k best of each shard are merged by a window, which keeps k rows a task before the shuffle.

Null vectors, those with null or non-finite components, of another length, or without length (norm 0) have no similarity and
take no part, nor do rows without a key. Equal similarities go to the smaller key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellum.operators.vectors import matrix, unit, usable

SHARD = 8192  # vectors
LINKS = 16  # chosen for each node; as many again may come from others
FAR = 4  # links drawn at random
ENTRIES = 16
BEAM = 64
QUESTIONS = 4096  # of a block
NODES = "shard int, place int, keys array<long>, vector array<double>, links array<int>"


def near(x: np.ndarray, links: int, block: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """From, to: each node's links to near nodes, none nearer to a link chosen before than to the node itself; places
    left over go to the nearest of the others."""
    n, most = len(x), min(2 * links, len(x) - 1)
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for lo in range(0, n if most > 0 else 0, block):
        own = np.arange(lo, min(lo + block, n))
        s = x[own] @ x.T
        s[np.arange(len(own)), own] = -np.inf
        found = np.argpartition(-s, most - 1, axis=1)[:, :most]
        order = np.argsort(-np.take_along_axis(s, found, 1), axis=1, kind="stable")
        found = np.take_along_axis(found, order, 1)
        s = np.take_along_axis(s, found, 1)
        between = x[found] @ x[found].transpose(0, 2, 1)
        kept = np.zeros(found.shape, bool)
        for j in range(most):
            kept[:, j] = (np.where(kept, between[:, j], -np.inf).max(1) < s[:, j]) & (kept.sum(1) < links)
        rank = np.argsort(~kept, axis=1, kind="stable")[:, :links]
        to = np.take_along_axis(found, rank, 1)
        out.append((np.repeat(own, to.shape[1]), to.ravel()))
    return tuple(np.concatenate(c) for c in zip(*out))


def graph(x: np.ndarray, links: int = LINKS, far: int = FAR, seed: int = 1) -> list[np.ndarray]:
    """The links of each node of a shard; x holds unit vectors, all different."""
    a, b = near(x, links)
    a, b = np.r_[a, b], np.r_[b, a]
    pairs = np.unique(a * len(x) + b)
    a, b = pairs // len(x), pairs % len(x)
    order = np.lexsort((-(x[a] * x[b]).sum(1), a))
    a, b = a[order], b[order]
    at = np.searchsorted(a, np.arange(len(x) + 1))
    drawn = np.random.default_rng(seed).integers(0, len(x), (len(x), far))
    return [np.unique(np.r_[b[at[i] : min(at[i + 1], at[i] + 2 * links)], drawn[i][drawn[i] != i]]) for i in range(len(x))]


def build(vectors: DataFrame, width: int, key: str = "vec_id", vector: str = "embedding", shard: int = SHARD, links: int = LINKS) -> DataFrame:
    """The index: NODES' columns. A group is a shard, which holds ``shard`` vectors on average whatever the table holds."""
    rows = usable(vectors, key, vector).filter(F.col("width") == width)
    shards = max(1, -(-rows.count() // shard))

    def nodes(group: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(batches).sort_by("key")
        v, keys, own = matrix(t.column("v"), width), t.column("key").to_numpy(), group[0].as_py()
        _, first, back = np.unique(v, axis=0, return_index=True, return_inverse=True)
        order = np.argsort(back.ravel(), kind="stable")
        at = np.searchsorted(back.ravel()[order], np.arange(len(first) + 1))
        joined = graph(unit(v[first]).astype(np.float32), links)
        for lo in range(0, len(first), 1024):
            part = range(lo, min(lo + 1024, len(first)))
            columns = [pa.array([own] * len(part), pa.int32()), pa.array(part, pa.int32()), pa.array([keys[order[at[i] : at[i + 1]]] for i in part]), pa.array(list(v[first[lo : part.stop]])), pa.array([joined[i] for i in part], pa.list_(pa.int32()))]
            yield pa.record_batch(columns, names=["shard", "place", "keys", "vector", "links"])

    return rows.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int")).groupBy("shard").applyInArrow(nodes, NODES)


class Shard:
    """A shard's graph, ready for searches."""

    def __init__(self, nodes: pa.Table, width: int):
        nodes = nodes.sort_by("place")
        self.vectors, links = matrix(nodes.column("vector"), width), nodes.column("links").to_pylist()
        self.keys = nodes.column("keys").to_pylist()
        self.vectors = unit(self.vectors)
        self.x = self.vectors.astype(np.float32)
        self.links = np.full((len(links), max(map(len, links))), -1, np.int64)
        for i, own in enumerate(links):
            self.links[i, : len(own)] = own
        middle = int(np.argmax(self.x @ self.x.mean(0)))
        self.entries = np.unique(np.r_[middle, np.linspace(0, len(links) - 1, min(ENTRIES, len(links))).astype(np.int64)])

    def beams(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The nodes of each question's beam, -1 where there are fewer, and how many nodes each question has met."""
        n, width = len(q), max(beam, len(self.entries))
        ids, sims, done = np.full((n, width), -1), np.full((n, width), -np.inf, np.float32), np.zeros((n, width), bool)
        ids[:, : len(self.entries)] = self.entries
        sims[:, : len(self.entries)] = q @ self.x[self.entries].T
        met = np.zeros((n, len(self.x)), bool)
        met[:, self.entries] = True
        while True:
            open_ = np.where(done, -np.inf, sims)
            best = open_.argmax(1)
            rows = np.flatnonzero(open_[np.arange(n), best] > -np.inf)
            if not len(rows):
                return ids, met.sum(1)
            done[rows, best[rows]] = True
            beside = self.links[ids[rows, best[rows]]]
            new = (beside >= 0) & ~met[rows[:, None], beside]
            at, column = np.nonzero(new)
            met[rows[at], beside[at, column]] = True
            found = np.full(beside.shape, -np.inf, np.float32)
            found[at, column] = (self.x[beside[at, column]] * q[rows[at]]).sum(1)
            all_ids, all_sims = np.c_[ids[rows], np.where(new, beside, -1)], np.c_[sims[rows], found]
            top = np.argpartition(-all_sims, width - 1, axis=1)[:, :width]
            ids[rows], sims[rows] = np.take_along_axis(all_ids, top, 1), np.take_along_axis(all_sims, top, 1)
            done[rows] = np.take_along_axis(np.c_[done[rows], np.zeros(beside.shape, bool)], top, 1)

    def search(self, asked: np.ndarray, k: int, beam: int) -> list[tuple[list[float], list[int], int]]:
        """Similarities and keys of the k best, and the nodes met, for each question."""
        asked = unit(asked)
        ids, met = self.beams(asked.astype(np.float32), max(beam, k))
        out = []
        for q, own, n in zip(asked, ids, met):
            own = own[own >= 0]
            sims = np.round(self.vectors[own] @ q, 6)
            top = sorted((-s, key) for s, i in zip(sims.tolist(), own) for key in self.keys[i][:k])[:k]  # a node's keys are sorted
            out.append(([-s for s, _ in top], [key for _, key in top], int(n)))
        return out


def search(index: DataFrame, questions: DataFrame, width: int, k: int = 8, beam: int = BEAM, block: int = QUESTIONS) -> DataFrame:
    """question_id, key, similarity, rank, met (nodes met in all shards) for questions (question_id, question)."""
    asked = usable(questions, "question_id", "question").filter(F.col("width") == width)
    shards = (index.agg(F.max("shard")).first()[0] or 0) + 1
    blocks = max(1, -(-asked.count() // block))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = asked.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int")).withColumn("shard", every(shards))
    nodes = index.withColumn("block", every(blocks))

    def run(own: pa.Table, asked: pa.Table) -> pa.Table:
        ids, keys, sims, met = [], [], [], []
        if own.num_rows and asked.num_rows:
            shard, q, names = Shard(own, width), matrix(asked.column("v"), width), asked.column("key").to_pylist()
            for lo in range(0, len(q), 256):
                for name, (s, found, n) in zip(names[lo : lo + 256], shard.search(q[lo : lo + 256], k, beam)):
                    ids += [name] * len(s)
                    sims, keys, met = sims + s, keys + found, met + [n] * len(s)
        return pa.table([pa.array(ids, pa.int64()), pa.array(keys, pa.int64()), pa.array(sims, pa.float64()), pa.array(met, pa.int64())], names=["question_id", "key", "similarity", "met"])

    found = nodes.groupBy("block", "shard").cogroup(dealt.groupBy("block", "shard")).applyInArrow(run, "question_id long, key long, similarity double, met long")
    rank = F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("similarity"), "key"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("question_id", "key", "similarity", F.col("rank").cast("long").alias("rank"), "met")


def write(index: DataFrame, path: str) -> None:
    index.write.mode("overwrite").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(NODES).parquet(path)

"""Searches on weighted graphs: fewest hops, least cost, greedy and A*, depth limits.

Breadth-first and least-cost searches keep one best row a node and advance a frontier of nodes by joins with the edges,
so their size follows the nodes, not the paths. The informed searches follow one frontier with priorities; they take a
small graph of literal edges to the driver by contract.
"""

from __future__ import annotations

import heapq
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.functions.tables import shared_checkpoint


def undirected(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst", "w").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))


def best_paths(edges: DataFrame, start: str, by_hops: bool = False, most: int | None = None) -> DataFrame:
    """node, hops, cost, path from ``start``: fewest hops (then least cost) or least cost (then fewest hops), then the
    least path. Runs until no node gets better; where ``most`` rounds are set and don't suffice, it raises. State is cut by
    checkpoints in the shared folder."""
    spark = edges.sparkSession
    edges = undirected(edges)
    rank = F.struct("hops", "cost", "path") if by_hops else F.struct("cost", "hops", "path")
    best = shared_checkpoint(spark.createDataFrame([(start, 0, 0, [start])], "node string, hops int, cost long, path array<string>"))
    frontier = best
    for turn in count():
        if turn == most:
            raise ValueError(f"paths still get better after {most} rounds")
        reached = frontier.join(edges, frontier.node == edges.src).filter(~F.array_contains("path", F.col("dst")))
        reached = reached.select(F.col("dst").alias("node"), (F.col("hops") + 1).alias("hops"), (F.col("cost") + F.col("w")).alias("cost"), F.concat("path", F.array("dst")).alias("path"))
        every = best.withColumn("new", F.lit(0)).unionByName(reached.withColumn("new", F.lit(1)))
        now = shared_checkpoint(every.groupBy("node").agg(F.min(F.struct(rank.alias("rank"), "new", "hops", "cost", "path")).alias("b")).select("node", "b.hops", "b.cost", "b.path", "b.new"))
        frontier = now.filter("new = 1").drop("new")
        best = now.drop("new")
        if frontier.isEmpty():
            return best


def neighbours(edges: list[tuple[str, str, int]]) -> dict[str, list[tuple[str, int]]]:
    out: dict[str, list[tuple[str, int]]] = {}
    for a, b, w in edges:
        out.setdefault(a, []).append((b, w))
        out.setdefault(b, []).append((a, w))
    return {k: sorted(v) for k, v in out.items()}


def informed(edges: list[tuple[str, str, int]], h: dict[str, int], start: str, goal: str, greedy: bool = False) -> tuple[list[str], int] | None:
    """A* (or greedy by h alone): path and cost."""
    around = neighbours(edges)
    queue, done = [(h.get(start, 0), 0, [start])], set()
    while queue:
        _, cost, path = heapq.heappop(queue)
        node = path[-1]
        if node == goal:
            return path, cost
        if node in done:
            continue
        done.add(node)
        for other, w in around.get(node, ()):
            if other not in done:
                heapq.heappush(queue, (h.get(other, 0) + (0 if greedy else cost + w), cost + w, [*path, other]))
    return None


def depth_limited(edges: list[tuple[str, str, int]], start: str, goal: str, limit: int) -> list[str] | str | None:
    """A path of at most ``limit`` hops found depth first; ``cutoff`` if the limit was met, None if there is none."""
    around = neighbours(edges)

    def walk(path: list[str], left: int):
        if path[-1] == goal:
            return path
        if left == 0:
            return "cutoff"
        met = None
        for other, _ in around.get(path[-1], ()):
            if other not in path:
                found = walk([*path, other], left - 1)
                if isinstance(found, list):
                    return found
                met = found or met
        return met

    return walk([start], limit)


def iterative_deepening(edges: list[tuple[str, str, int]], start: str, goal: str, most: int = 50) -> list[str] | None:
    for limit in range(most + 1):
        found = depth_limited(edges, start, goal, limit)
        if found != "cutoff":
            return found
    return None

"""Batches of texts under two caps, a token budget, and resumable loads.

Greedy batching is sequential, but a batch holds ``most_texts`` rows at most. So each range partition, with as many
rows of the next range at hand, knows for every row where a batch that begins there ends; from this it knows for
every place where its first batch may begin where the first batch of the next range begins. Chaining these short
tables on the driver gives each range its real beginning, and all ranges number their batches at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from vellum.functions.tables import free_name, in_ranges

# Caps of a batch, and the budget's margin.
MOST_TEXTS = 1000
MOST_TOKENS = 150_000
MARGIN = 1.25


def pending(chunks: DataFrame, stored: DataFrame, key: str = "id") -> DataFrame:
    return chunks.join(stored.select(key), key, "left_anti")


def batch_ends(tokens: np.ndarray, most_texts: int, most_tokens: int) -> np.ndarray:
    """For each row, the row after the batch that begins there. A row over the cap is a batch of its own."""
    total = np.r_[0, np.cumsum(tokens.astype(np.int64))]
    at = np.arange(len(tokens))
    by_tokens = np.searchsorted(total, total[:-1] + most_tokens, "right") - 1
    return np.minimum(np.maximum(by_tokens, at + 1), at + most_texts)


class Filling:
    """Greedy batches over a run of rows that comes in pieces."""

    def __init__(self, skip: int, batch: int, most_texts: int, most_tokens: int):
        self.skip, self.batch, self.most_texts, self.most_tokens = skip, batch - 1, most_texts, most_tokens
        self.texts, self.tokens = most_texts, 0  # the batch begun before takes ``skip`` rows and no more

    def take(self, tokens: np.ndarray) -> np.ndarray:
        """The batches of the rows that come next."""
        out = np.full(len(tokens), self.batch, np.int64)
        i = min(self.skip, len(tokens))
        self.skip -= i
        if i < len(tokens) and self.texts < self.most_texts:  # rows for the batch that is open
            total = np.cumsum(tokens[i : i + self.most_texts - self.texts])
            n = int(np.searchsorted(total, self.most_tokens - self.tokens, "right"))
            self.texts, self.tokens, i = self.texts + n, self.tokens + int(total[n - 1] if n else 0), i + n
        ends = batch_ends(tokens, self.most_texts, self.most_tokens) if i < len(tokens) else ()
        while i < len(tokens):
            self.batch, end = self.batch + 1, int(ends[i])
            out[i:end] = self.batch
            self.texts, self.tokens, i = end - i, int(tokens[i:end].sum()), end
        return out


def greedy_batches(items: DataFrame, order: str = "id", tokens: str = "tokens", most_texts: int = MOST_TEXTS, most_tokens: int = MOST_TOKENS) -> DataFrame:
    """``items`` with batch, from 0, in ``order`` (unique); a column batch is replaced.

    The rows are written once in ranges of ``order`` (``in_ranges``). What is shuffled besides is a number a row; the other
    columns are only read again, to be given their batch.
    """
    spark = items.sparkSession
    items = items.drop("batch")
    names = items.columns
    part, at, size = (free_name(items, x) for x in ("_part", "_at", "_n"))
    ranged = in_ranges(items.withColumn(size, F.coalesce(F.col(tokens), F.lit(0)).cast("long")), order, part=part, at=at)
    placed = ranged.select(F.col(part).alias("part"), F.col(at).alias("at"), F.col(size).alias("n"))
    counts = {r["part"]: r["rows"] for r in placed.groupBy("part").agg(F.count(F.lit(1)).alias("rows")).collect()}  # a row for each range
    parts = sorted(counts)
    follows = {p: q for p, q in zip(parts, parts[1:])}
    # The head of each range stands behind the ranges that may need it.
    heads = []
    for p in parts:
        left, q = most_texts, p
        while left > 0 and q in follows:
            q = follows[q]
            heads.append((p, q, left))
            left -= counts[q]
    ahead = spark.createDataFrame(heads, "owner int, part int, most int")
    extra = placed.filter(F.col("at") < most_texts).join(F.broadcast(ahead), "part").filter(F.col("at") < F.col("most")).select(F.col("owner"), F.col("part"), "at", "n")
    rows = placed.select(F.col("part").alias("owner"), "part", "at", "n").unionAll(extra)

    def table_of(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(batches).sort_by([("part", "ascending"), ("at", "ascending")])
        owner, part, n = (t.column(c).to_numpy() for c in ("owner", "part", "n"))
        own = int((part == owner).sum())
        ends = batch_ends(n, most_texts, most_tokens)
        exit_, made = np.zeros(own, np.int64), np.zeros(own, np.int64)
        for i in range(own - 1, -1, -1):
            e = int(ends[i])
            exit_[i], made[i] = (e - own, 1) if e >= own else (exit_[e], made[e] + 1)
        first = min(own, most_texts)
        yield pa.record_batch([pa.array([int(owner[0])], pa.int32()), pa.array([own], pa.int64()), pa.array([exit_[:first].tolist()], pa.list_(pa.int64())), pa.array([made[:first].tolist()], pa.list_(pa.int64()))], names=["part", "rows", "exit", "made"])

    found = {r["part"]: r for r in rows.groupBy("owner").applyInArrow(table_of, "part int, rows long, exit array<long>, made array<long>").collect()}  # most_texts numbers a range
    begin, place, batches = {}, 0, 0
    for p in parts:
        begin[p] = place, batches
        r = found[p]
        if place >= r["rows"]:
            place -= r["rows"]
        else:
            batches, place = batches + r["made"][place], r["exit"][place]

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, filling, seen = None, None, 0
        for rows in batches:
            own = rows.column(part).to_numpy()
            edges = np.r_[0, np.flatnonzero(own[1:] != own[:-1]) + 1, len(own)] if len(own) else [0]
            for lo, hi in zip(edges, edges[1:]):
                piece = rows.slice(lo, hi - lo)
                if own[lo] != here:
                    here, seen = int(own[lo]), 0
                    filling = Filling(*begin[here], most_texts, most_tokens)
                places = piece.column(at).to_numpy()
                if (places != np.arange(seen, seen + len(places))).any():
                    raise ValueError("the rows of a range aren't in their order")
                seen += len(places)
                batch = filling.take(piece.column(size).to_numpy())
                yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in names), pa.array(batch)], schema=pa.schema([*(piece.schema.field(c) for c in names), pa.field("batch", pa.int64())]))

    return ranged.mapInArrow(numbered, StructType([*items.schema.fields, StructField("batch", LongType())]))


def batch_totals(batched: DataFrame, tokens: str = "tokens") -> DataFrame:
    return batched.groupBy("batch").agg(F.count(F.lit(1)).alias("texts"), F.sum(tokens).cast("long").alias("tokens"))


def within_budget(totals: DataFrame, used: int, limit: int, margin: float = MARGIN, block: int = 4096) -> DataFrame:
    """The batches before the first whose estimate, with a margin, would pass the limit. ``totals`` has a row for each
    batch; sums run within blocks of batches, after sums over the blocks before."""
    own, before, spent = (free_name(totals, x) for x in ("_block", "_before", "_spent"))
    blocked = totals.withColumn(own, F.floor(F.col("batch") / block))
    sums = blocked.groupBy(own).agg(F.sum("tokens").alias("t"))
    starts = sums.select(own, (F.sum("t").over(Window.orderBy(own)) - F.col("t")).alias(before))  # a row for ``block`` batches
    order = Window.partitionBy(own).orderBy("batch").rowsBetween(Window.unboundedPreceding, -1)
    summed = blocked.join(starts, own).withColumn(spent, F.lit(used) + F.col(before) + F.coalesce(F.sum("tokens").over(order), F.lit(0)))
    over = F.col(spent) + F.floor(F.col("tokens") * margin) > limit
    first = summed.agg(F.min(F.when(over, F.col("batch"))).alias(own))  # one row
    return totals.join(F.broadcast(first), F.col("batch") < F.coalesce(F.col(own), F.col("batch") + 1)).select(*totals.columns)


def upsert_new(stored: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Stored rows and the new ones whose key isn't there, the first of equal keys. Rows are told apart by all columns."""
    first = new.groupBy(key).agg(F.min(F.struct(*[c for c in new.columns if c != key])).alias("r")).select(key, "r.*")
    return stored.unionByName(first.join(stored.select(key), key, "left_anti").select(*stored.columns))


def tokens_used(ledger: DataFrame, model: str) -> DataFrame:
    return ledger.filter(F.col("model") == model).agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"))

"""Benchmark decontamination by greedy string tiling.

Words are hashed in lower case. A document and a test item share a seed where a run of ``MATCH`` words has the same
Karp-Rabin hash in both. Each pair with a seed is tiled: matches are extended as far as they go, the longest is marked
in both texts, matches that meet marked words are cut back and come again with the words left to them, until no match
of ``MATCH`` words is left. The share of the item's words under tiles is its coverage; a passage whose parts were put
in another order is covered as well as before. From coverage ``COVERAGE`` on the document is contaminated.

Most pairs of a common phrase are never tiled. A seed that over ``COMMON`` items share brings up only those items whose
coverage such seeds alone can make enough; any other item needs a rarer seed as well. For the items that come up, the
words that all shared seeds together would cover bound the coverage. A pair with very many places to match (``PLACES``), as
of texts that repeat themselves, is tiled by hashing all free windows of one length after the other (running Karp-Rabin),
in memory that follows the two texts.

The benchmark reaches the tasks in blocks of at most ``BLOCK`` characters, by a hash of the item, one pass over the
documents for each block: what is broadcast doesn't grow with the benchmark. Documents are never shuffled.

An item of fewer than MATCH words has no tile and contaminates nothing; null or empty texts and items match nothing;
an empty benchmark leaves everything clean. Repeated rows are judged alike, and extra columns are kept by ``clean``.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm.common import U64, bounds, chunks, map_batches, shared_checkpoint, span_hash, table, windows, word_hashes

MATCH = 5
COVERAGE = 0.6
BLOCK = 8_000_000
COMMON = 16
PLACES = 1_000_000


def covered_by(places: np.ndarray, match: int) -> int:
    """Words under windows of ``match`` words at the sorted ``places``."""
    return int(np.minimum(np.diff(places), match).sum()) + match if len(places) else 0


class Items:
    """The items of a block: their words, their seeds in order, and an index from seeds to the items they bring up."""

    def __init__(self, ids: list, texts: list[str | None], match: int, coverage: float = COVERAGE):
        self.ids, self.match, self.coverage = ids, match, coverage
        words, rows = [np.zeros(0, U64)], [np.zeros(0, np.int64)]
        for lo, _, raw, offsets in chunks(pa.array(texts, pa.string()), lower=True):
            w, row = word_hashes(raw, offsets)
            words.append(w)
            rows.append(row + lo)
        self.words = np.concatenate(words)
        row = np.concatenate(rows)
        self.at = bounds(row, len(ids))
        self.seeds, self.place = windows(self.words, row, match)
        item = row[self.place]
        self.first = bounds(item, len(ids))  # of an item's seeds
        order = np.lexsort((item, self.seeds))
        seeds, items = self.seeds[order], item[order]
        new = np.r_[True, (seeds[1:] != seeds[:-1]) | (items[1:] != items[:-1])] if len(seeds) else np.zeros(0, bool)
        seeds, items = seeds[new], items[new]
        sharing = np.searchsorted(seeds, seeds, "right") - np.searchsorted(seeds, seeds, "left")
        common = np.unique(seeds[sharing > COMMON])
        enough = np.zeros(len(ids), bool)  # by common seeds alone
        is_common = np.isin(self.seeds, common)
        for i in np.unique(items[sharing > COMMON]):
            own = slice(self.first[i], self.first[i + 1])
            enough[i] = covered_by(self.place[own][is_common[own]], match) >= coverage * (self.at[i + 1] - self.at[i])
        keep = (sharing <= COMMON) | enough[items]
        self.keys, self.items = seeds[keep], items[keep]
        self.bits = 64 - max(16, min(26, 4 + int(len(self.seeds)).bit_length()))
        self.maybe = np.zeros(1 << (64 - self.bits), bool)
        self.maybe[(self.seeds >> U64(self.bits)).astype(np.int64)] = True

    def brought_up(self, seeds: np.ndarray) -> np.ndarray:
        """The items that one of these seeds brings up."""
        left, right = (np.searchsorted(self.keys, seeds, side) for side in ("left", "right"))
        count = right - left
        left, count = left[count > 0], count[count > 0]
        total = np.cumsum(count)
        return np.unique(self.items[np.repeat(left - total + count, count) + np.arange(total[-1])]) if len(left) else left


def free_runs(free: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.r_[0, free.astype(np.int8), 0])
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def tiled(d: np.ndarray, i: np.ndarray, match: int, doc_words: int, words: int) -> tuple[int, list[tuple[int, int, int]]]:
    """Covered words of an item, and the tiles (place in the document, place in the item, words), from the places
    (document, item) where ``match`` words agree. Of equally long matches the first in the document goes first, then
    the first in the item."""
    order = np.lexsort((d, d - i))
    d, i = d[order], i[order]
    new = np.flatnonzero(np.r_[True, (d[1:] != d[:-1] + 1) | (i[1:] != i[:-1] + 1)])
    size = np.diff(np.r_[new, len(d)]) - 1 + match
    heap = list(zip((-size).tolist(), d[new].tolist(), i[new].tolist()))
    heapq.heapify(heap)
    in_doc, in_item = np.zeros(doc_words, bool), np.zeros(words, bool)
    tiles, covered = [], 0
    while heap and covered < words:
        size, a, b = heapq.heappop(heap)
        free = ~(in_doc[a : a - size] | in_item[b : b - size])
        if free.all():
            in_doc[a : a - size] = in_item[b : b - size] = True
            covered -= size
            tiles.append((a, b, -size))
            continue
        for lo, hi in zip(*free_runs(free)):
            if hi - lo >= match:
                heapq.heappush(heap, (int(lo - hi), a + int(lo), b + int(lo)))
    return covered, tiles


def tiled_by_length(doc: np.ndarray, item: np.ndarray, match: int) -> tuple[int, list[tuple[int, int, int]]]:
    """What ``tiled`` gives, from the words themselves: the greatest length at which free windows of both agree is found
    by halving, and all its matches are marked in order."""
    in_doc, in_item = np.zeros(len(doc), bool), np.zeros(len(item), bool)
    tiles, most = [], min(len(doc), len(item))

    def free_windows(words: np.ndarray, marked: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        total = np.r_[0, np.cumsum(marked)]
        at = np.flatnonzero(total[n:] == total[:-n]) if n <= len(words) else np.zeros(0, np.int64)
        return span_hash(words, at, at + n), at

    while most >= match:
        least = match - 1  # a length that agrees, or none
        while least < most:
            n = (least + most + 1) // 2
            if np.isin(free_windows(doc, in_doc, n)[0], free_windows(item, in_item, n)[0]).any():
                least = n
            else:
                most = n - 1
        if most < match:
            break
        (own, at), (keys, place) = free_windows(doc, in_doc, most), free_windows(item, in_item, most)
        order = np.argsort(keys, kind="stable")
        keys, place = keys[order], place[order]
        left, right = np.searchsorted(keys, own, "left"), np.searchsorted(keys, own, "right")
        for k in np.flatnonzero(right > left):
            a = int(at[k])
            if in_doc[a : a + most].any():
                continue
            for b in place[left[k] : right[k]]:
                if not (in_item[b] or in_item[b + most - 1]):  # marks of this length or longer would reach an end
                    in_doc[a : a + most] = in_item[b : b + most] = True
                    tiles.append((a, int(b), most))
                    break
        most -= 1
    return int(in_item.sum()), tiles


def found_in(texts: pa.Array, items: Items) -> Iterator[tuple[int, int, int, int, list[tuple[int, int, int]]]]:
    """(row, item number, words covered, words, tiles) for each row and item whose coverage is enough."""
    match, coverage = items.match, items.coverage
    for lo, hi, raw, offsets in chunks(texts, lower=True):
        words, row = word_hashes(raw, offsets)
        seeds, place = windows(words, row, match)
        hits = np.flatnonzero(items.maybe[(seeds >> U64(items.bits)).astype(np.int64)])
        at, of = bounds(row, hi - lo), row[place[hits]]
        for r in np.unique(of):
            own = hits[slice(*np.searchsorted(of, [r, r + 1]))]
            keys, back = np.unique(seeds[own], return_inverse=True)
            order = np.argsort(back, kind="stable")
            places, of_key = (place[own] - at[r])[order], bounds(back[order], len(keys))
            for item in items.brought_up(keys):
                mine = slice(items.first[item], items.first[item + 1])
                total, begin = int(items.at[item + 1] - items.at[item]), items.place[mine] - items.at[item]
                key = np.minimum(np.searchsorted(keys, items.seeds[mine]), len(keys) - 1)
                shared = keys[key] == items.seeds[mine]
                begin, key = begin[shared], key[shared]
                if covered_by(begin, match) < coverage * total:
                    continue  # even all matches together cover too little
                count = of_key[key + 1] - of_key[key]
                if count.sum() > PLACES:
                    covered, tiles = tiled_by_length(words[at[r] : at[r + 1]], items.words[items.at[item] : items.at[item + 1]], match)
                else:
                    ends = np.cumsum(count)
                    d = places[np.repeat(of_key[key] - ends + count, count) + np.arange(ends[-1])]
                    covered, tiles = tiled(d, np.repeat(begin, count), match, int(at[r + 1] - at[r]), total)
                if covered >= coverage * total:
                    yield lo + int(r), int(item), covered, total, tiles


def blocks(benchmark: DataFrame, match: int, coverage: float, size: int) -> Iterator[Items]:
    own = benchmark.select(F.col("item_id"), F.col("text")).filter(F.col("text").isNotNull())
    total = own.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-total // size)
    for k in range(n):
        part = own if n == 1 else own.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        found = part.toArrow().sort_by([("item_id", "ascending"), ("text", "ascending")])
        yield Items(found.column("item_id").to_pylist(), found.column("text").to_pylist(), match, coverage)


def contaminated(docs: DataFrame, benchmark: DataFrame, match: int = MATCH, coverage: float = COVERAGE, block: int = BLOCK) -> DataFrame:
    """A row for each document and item whose coverage reaches ``coverage``: doc_id, item_id, words of the item,
    words covered, tiles, coverage."""
    spark, out = docs.sparkSession, None
    schema = "doc_id long, item_id long, words int, covered int, tiles int, coverage double"
    for items in blocks(benchmark, match, coverage, block):
        shared = spark.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = list(found_in(batch.column("text"), shared.value))
                rows, ids = [f[0] for f in found], [shared.value.ids[f[1]] for f in found]
                yield pa.record_batch([batch.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(ids, pa.int64()), *(pa.array(x, pa.int32()) for x in ([f[3] for f in found], [f[2] for f in found], [len(f[4]) for f in found])), pa.array([f[2] / f[3] for f in found], pa.float64())], names=["doc_id", "item_id", "words", "covered", "tiles", "coverage"])

        part = map_batches(docs.select("doc_id", "text"), run, schema)
        out = part if out is None else out.unionAll(part)
    return spark.createDataFrame([], schema) if out is None else out


def clean(docs: DataFrame, benchmark: DataFrame, match: int = MATCH, coverage: float = COVERAGE, block: int = BLOCK) -> DataFrame:
    """The rows of ``docs`` that aren't contaminated, with all columns. What a block of items leaves is written before the
    next block comes, so that a task has one block at a time."""
    first = True
    for items in blocks(benchmark, match, coverage, block):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                keep[[f[0] for f in found_in(batch.column("text"), shared.value)]] = False
                yield batch.filter(pa.array(keep))

        docs = map_batches(docs if first else shared_checkpoint(docs), run, docs.schema)
        first = False
    return docs


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))

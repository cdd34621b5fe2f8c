"""What the operators of this subpackage share: reading tables, cutting lineage, vectorised text arrays.

Texts are worked on as Arrow buffers: a column's UTF-8 bytes are one numpy array, and words, shingles, sentences
and passages are index arrays into it, so no Python object is made per word. A null text counts as an empty one.
Chunks of about ``CHUNK`` bytes bound the temporaries of the tasks.

Python workers serve many tasks of different stages. ``map_batches`` gives what a task's allocators still hold back to
the system when the task ends, so that a worker's memory follows its present task and not the largest it has had.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from vellum.functions.tables import shared_checkpoint, shared_folder, spread  # noqa: F401  the subpackage takes them from here

CHUNK = 1 << 20
U64 = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables; those that hold the work of single rows use all cores, however few row groups they have."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in ("documents", "embeddings") else df


def release() -> None:
    """Give unused memory of this process back to the system, where its allocators can."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """``df.mapInArrow(run, schema)``, with ``release`` at the end of each task."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return df.mapInArrow(task, schema)


def labelled_sample(docs: DataFrame, label: DataFrame, learn: F.Column, rows: int, size: int) -> DataFrame:
    """The texts of at most ``rows`` labelled documents of at most ``size`` characters together, chosen by a hash of
    their id: doc_id, text, y.

    ``label`` has doc_id and y; ``learn`` is the condition on doc_id under which a label may be learned from. Both
    bounds are the documented limits of what a classifier is fitted on. Texts are taken whole, those of over a
    hundredth of ``size`` last. Of several rows with one doc_id the least text and the largest y count. The ids of the
    sample are broadcast, and their number is at most ``rows``.
    """
    ids = (
        label.filter(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & learn)
        .groupBy("doc_id")
        .agg(F.max("y").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
    )
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id")
    found = shared_checkpoint(found.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y")))
    sized = found.select("doc_id", F.length("text").cast("long").alias("n"))
    order = Window.orderBy((F.col("n") * 100 > size).cast("int"), F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    fits = sized.withColumn("total", F.sum("n").over(order)).filter(F.col("total") <= size).select("doc_id")  # ``rows`` pairs of numbers
    return found.join(F.broadcast(fits), "doc_id", "left_semi")


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64 on an array of uint64."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


BASE = 0x9E3779B97F4A7C15
KEPT_POWERS = 5 * CHUNK // 4  # a chunk and a bit; longer ones, for single long texts, are made when they are needed
_powers: dict[int, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n."""
    out = []
    for base in (BASE, pow(BASE, -1, 1 << 64)):
        own = _powers.get(base)
        if own is None or len(own) < n:
            own = np.full(KEPT_POWERS if n <= KEPT_POWERS else n, U64(base))
            own[0] = 1
            np.cumprod(own, dtype=U64, out=own)
            if n <= KEPT_POWERS:
                _powers[base] = own
        out.append(own[:n])
    return out[0], out[1]


def span_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of values[start:end] for each span, from one prefix sum (Karp-Rabin)."""
    n = len(values)
    if n == 0 or len(start) == 0:
        return np.zeros(len(start), U64)
    fwd, inv = powers(n + 1)
    prefix = np.zeros(n + 1, U64)
    np.cumsum((values.astype(U64) + U64(1)) * fwd[:n], out=prefix[1:])
    return mix((prefix[end] - prefix[start]) * inv[start] + (end - start).astype(U64) * U64(0xD6E8FEB86659FD93))


def chunks(texts: pa.Array, lower: bool = False, size: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets of the rows in the bytes) of runs of rows of about ``size`` bytes."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    sizes = np.r_[0, np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)]
    row, n = 0, len(texts)
    while row < n:
        end = max(row + 1, int(np.searchsorted(sizes, sizes[row] + size, "right")) - 1)
        part = pc.fill_null(texts.slice(row, end - row).cast(pa.large_string()), "")
        if lower:
            part = pc.utf8_lower(part)
        _, at, data = part.buffers()
        offsets = np.frombuffer(at, np.int64, len(part) + 1, part.offset * 8)
        raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        yield row, end, raw[offsets[0] : offsets[-1]], offsets - offsets[0]
        row = end


#: Letters and digits of ASCII, and every byte of a character beyond it, belong to words.
IS_WORD = np.zeros(256, bool)
IS_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each word; a word never crosses the border of a row."""
    n = len(raw)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    is_word = IS_WORD[raw]
    border = np.zeros(n + 1, bool)
    border[offsets] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = is_word[:-1]
    start = np.flatnonzero(is_word & (~before | border[:n]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = is_word[1:]
    end = np.flatnonzero(is_word & (~after | border[1:])) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each word."""
    start, end, row = word_spans(raw, offsets)
    return span_hash(raw, start, end), row


#: Odd multipliers, one for each place in a shingle.
PLACES = mix(np.arange(1, 257, dtype=U64)) | U64(1)


def windows(words: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first word of each run of ``n`` words inside a row."""
    m = len(words)
    if m < n:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    out = np.zeros(m - n + 1, U64)
    for k in range(n):
        out += words[k : m - n + 1 + k] * PLACES[k]
    at = np.flatnonzero(row[: m - n + 1] == row[n - 1 :])
    return mix(out[at]), at


def shingles(words: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each run of ``n`` words. A row of fewer words, but some, has one shingle of all of them."""
    out, at = windows(words, row, n)
    at = row[at]
    if len(words):
        first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        count = np.diff(np.r_[first, len(words)])
        few = np.flatnonzero(count < n)
        if len(few):
            extra = np.array([mix((words[first[i] : first[i] + count[i]] * PLACES[: count[i]]).sum(keepdims=True) + U64(count[i]))[0] for i in few], U64)
            out, at = np.r_[out, extra], np.r_[at, row[first[few]]]
            order = np.argsort(at, kind="stable")
            out, at = out[order], at[order]
    return out, at


def bounds(row: np.ndarray, n: int) -> np.ndarray:
    """n + 1 offsets into ``row``, which is sorted."""
    return np.searchsorted(row, np.arange(n + 1))


def byte_slices(batch: pa.RecordBatch, size: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``size`` bytes of text, one row at least."""
    sizes = np.r_[0, np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False), dtype=np.int64)]
    row = 0
    while row < batch.num_rows:
        end = max(row + 1, int(np.searchsorted(sizes, sizes[row] + size, "right")) - 1)
        yield batch.slice(row, end - row)
        row = end


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -50, 50)))

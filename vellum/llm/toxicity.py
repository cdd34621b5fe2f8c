"""Toxicity by multiple-instance learning: sentence scores combined by noisy-or.

A document is a bag of sentences. A sentence has the probability sigmoid(b + sum of the weights of its different
words and word beginnings), all hashed; a document is toxic with probability 1 - product(1 - p), the noisy-or. The weights are
trained from document labels alone by gradient steps (Adam) in numpy on a bounded sample of labelled documents
(``SAMPLE`` rows and ``SAMPLE_CHARS`` characters at most, parameters); every whole text of the corpus is then scored on the executors, and the sentence with
the highest probability is given with its place in bytes of the UTF-8 text.

An empty or null text has no sentence and the score 0. A text without labels is scored like any other. With no label
of either class to learn from, every score is the share of label 1 (0 if there are none). Repeated rows are scored
alike; columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm.common import bounds, chunks, labelled_sample, map_batches, shared_checkpoint, sigmoid, span_hash, table, word_spans

SAMPLE = 4000
SAMPLE_CHARS = 16_000_000
BITS = 18
STEMS = (5, 6, 7)  # bytes at the beginning of a word that are hashed besides the word
RARE = 0.003
ENDS = np.zeros(256, bool)
ENDS[[10, 33, 46, 63]] = True  # line feed ! . ?


def sentence_words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sentence and bucket of each word, the same bucket once a sentence; row, start and end of each sentence."""
    start, end, row = word_spans(raw, offsets)
    if not len(start):
        z = np.zeros(0, np.int64)
        return z, z, z, z, z
    bucket = (span_hash(raw, start, end) >> np.uint64(64 - BITS)).astype(np.int64)
    stems = [(np.flatnonzero(end - start >= size), size) for size in STEMS]
    stops = np.r_[0, np.cumsum(ENDS[raw])]
    new = np.r_[True, (row[1:] != row[:-1]) | (stops[start[1:]] > stops[end[:-1]])]
    sentence = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(start)] - 1
    stem = [(sentence[at] << BITS) | (span_hash(raw, start[at], start[at] + size) + np.uint64(size << 50) >> np.uint64(64 - BITS)).astype(np.int64) for at, size in stems]
    pair = np.unique(np.concatenate([(sentence << BITS) | bucket, *stem]))
    return pair >> BITS, pair & ((1 << BITS) - 1), row[first], start[first], end[last]


def per_document(run_on: DataFrame, schema: str, fold) -> DataFrame:
    """``fold``(sentence, bucket) of each document, which gives the value of the column that follows doc_id and y."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, raw, offsets in chunks(batch.column("text"), lower=True):
                sentence, bucket, row, *_ = sentence_words(raw, offsets)
                at = bounds(row[sentence] if len(sentence) else sentence, hi - lo)
                blobs = [fold(sentence[a:b] - sentence[a] if b > a else sentence[a:b], bucket[a:b]) for a, b in zip(at[:-1], at[1:])]
                yield pa.record_batch([batch.column("doc_id").slice(lo, hi - lo), batch.column("y").slice(lo, hi - lo).cast(pa.int32()), pa.array(blobs, pa.list_(pa.int32()) if "array" in schema else pa.binary())], names=["doc_id", "y", "bag"])

    return map_batches(run_on, run, schema)


def bags(docs: DataFrame) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """For training: the buckets to learn, (sentence, place of the bucket) pairs of each document, and the ys.

    ``docs`` (doc_id, text, y) is a bounded sample. Buckets of fewer documents than ``RARE`` of it can only be learned
    by heart and are left out before anything reaches the driver.
    """
    docs = shared_checkpoint(docs.select("doc_id", "text", "y").dropDuplicates(["doc_id"]))
    least = max(3, RARE * docs.count())
    used = per_document(docs, "doc_id long, y int, bag array<int>", lambda sentence, bucket: np.unique(bucket).astype(np.int32)).select(F.explode("bag").alias("bucket"))
    used = used.groupBy("bucket").count().filter(F.col("count") >= least).select("bucket").toArrow().column("bucket").to_numpy()  # 1 / RARE times the buckets of a document
    used = np.sort(used).astype(np.int64)

    def fold(sentence: np.ndarray, bucket: np.ndarray) -> bytes:
        place = np.minimum(np.searchsorted(used, bucket), max(len(used) - 1, 0))
        known = used[place] == bucket if len(used) else np.zeros(len(bucket), bool)
        last = sentence[-1:]  # so that the number of sentences stays known
        return np.r_[last + 1, sentence[known]].astype("<i4").tobytes() + place[known].astype("<i4").tobytes() if len(sentence) else b""

    found = per_document(docs, "doc_id long, y int, bag binary", fold).toArrow().sort_by("doc_id")
    return used, [np.frombuffer(x, "<i4") for x in found.column("bag").to_pylist()], found.column("y").to_numpy()


def train(used: np.ndarray, found: list[np.ndarray], y: np.ndarray, steps: int = 300, rate: float = 0.1, lasso: float = 5e-5) -> tuple[np.ndarray, float, float]:
    """Weights of the buckets, bias of a sentence, and the share of label 1. A document in ``found`` is its number of
    sentences, the sentences of its pairs, the places of their buckets."""
    weights, bias = np.zeros(1 << BITS, np.float64), -4.0
    base = float(y.mean()) if len(y) else 0.0
    keep = [i for i, x in enumerate(found) if len(x)]
    if not keep or base in (0.0, 1.0):
        return weights, bias, base
    y = y[keep].astype(np.float64)
    size = np.array([found[i][0] for i in keep], np.int64)
    shift = np.cumsum(size) - size
    sentence = np.concatenate([found[i][1 : len(found[i]) // 2 + 1] + s for i, s in zip(keep, shift)])
    column = np.concatenate([found[i][len(found[i]) // 2 + 1 :] for i in keep])
    doc_of = np.repeat(np.arange(len(keep)), size)
    balance = np.where(y == 1, 0.5 / max(y.mean(), 1e-3), 0.5 / max(1 - y.mean(), 1e-3)) / len(y)
    w, m, v = np.zeros(len(used) + 1), np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    w[-1] = bias
    for t in range(1, steps + 1):
        z = np.bincount(sentence, w[column], len(doc_of)) + w[-1]
        none = np.add.reduceat(-np.logaddexp(0, z), shift)  # log of the probability that no sentence is toxic
        some = np.maximum(1 - np.exp(none), 1e-9)
        slope = sigmoid(z) * np.where(y == 1, -(np.exp(none) / some), 1.0)[doc_of] * balance[doc_of]
        g = np.r_[np.bincount(column, slope[sentence], len(used)), slope.sum()]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = rate / (np.sqrt(v / (1 - 0.99**t)) + 1e-5)
        w -= step * (m / (1 - 0.9**t))
        w[:-1] = np.sign(w[:-1]) * np.maximum(np.abs(w[:-1]) - step[:-1] * lasso, 0)
    weights[used] = w[:-1]
    return weights, float(w[-1]), base


def score(docs: DataFrame, model: tuple[np.ndarray, float, float]) -> DataFrame:
    """doc_id, score and the worst sentence of each document: its place in bytes and its probability."""
    weights, bias, base = model
    flat = base in (0.0, 1.0) or not weights.any()
    shared = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))  # 2**BITS weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            for lo, hi, raw, offsets in chunks(batch.column("text"), lower=True):
                n = hi - lo
                scores, worst, start, end = np.zeros(n), np.zeros(n), np.full(n, -1), np.full(n, -1)
                sentence, bucket, row, first, last = sentence_words(raw, offsets)
                if len(row):
                    z = np.bincount(sentence, w[bucket], len(row)) + bias
                    scores = -np.expm1(-np.bincount(row, np.logaddexp(0, z), n))
                    order = np.lexsort((-first, z, row))
                    top = order[np.r_[row[order][1:] != row[order][:-1], True]]
                    worst[row[top]], start[row[top]], end[row[top]] = sigmoid(z[top]), first[top] - offsets[row[top]], last[top] - offsets[row[top]]
                if flat:
                    scores[:] = base
                yield pa.record_batch([batch.column("doc_id").slice(lo, n), pa.array(scores, pa.float64()), pa.array(worst, pa.float64()), pa.array(start, pa.int64()), pa.array(end, pa.int64())], names=["doc_id", "score", "worst_score", "worst_start", "worst_end"])

    return map_batches(docs.select("doc_id", "text"), run, "doc_id long, score double, worst_score double, worst_start long, worst_end long")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = F.crc32(F.col("doc_id").cast("string")) % 5
    label = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("y"))
    model = train(*bags(labelled_sample(docs, label, fold != 0, SAMPLE, SAMPLE_CHARS)))
    return score(docs, model).select("doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "worst_score", "worst_start", "worst_end")

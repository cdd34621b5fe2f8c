"""Language identification: averaged hashed subword embeddings with a linear softmax and calibrated rejection.

The subwords of a text are its words and their runs of 2 to 4 bytes, with a mark at either end of a word, hashed into
2**BITS buckets. The text's vector is the average of its subwords' embeddings; a linear softmax over it gives the
language. Embeddings and softmax are trained together by stochastic gradient descent in numpy on a bounded sample of
documents with a language (``SAMPLE`` rows and ``SAMPLE_CHARS`` characters at most, parameters). A tenth of the sample is set aside to calibrate: a
temperature for the softmax, and the threshold under which a prediction is rejected (``accepted`` false), chosen so
that at most ``MISSES`` of the right predictions are rejected.

As the softmax is linear, embeddings times softmax weights are folded into one table of a weight for each bucket and
language before texts are scored. A null text, or one with no letter, gets ``und`` and score 0; repeated rows are scored
alike; with no language to learn from every text gets ``und``. Columns other than doc_id, text and lang are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm.common import U64, bounds, chunks, labelled_sample, map_batches, mix, span_hash, table, word_spans

SAMPLE = 4000
SAMPLE_CHARS = 16_000_000
BITS = 16
WIDTH = 16
MISSES = 0.01


def subwords(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and row of each subword, in no order of rows."""
    start, end, row = word_spans(raw, offsets)
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    size = end - start + 2
    edge = np.r_[0, np.cumsum(size)]
    marked = np.full(edge[-1], 1, U64)  # the bytes of all words, 1 before and after each
    at = np.arange(edge[-1]) - np.repeat(edge[:-1], size)
    inside = (at > 0) & (at < np.repeat(size, size) - 1)
    marked[inside] = raw[(np.repeat(start, size) + at - 1)[inside]]
    of_row, left = np.repeat(row, size), np.repeat(size, size) - at
    out, rows = [span_hash(raw, start, end) >> U64(64 - BITS)], [row]
    code = marked.copy()
    for n in (2, 3, 4):
        code = code[:-1] * U64(257) + marked[n - 1 :] if len(code) > 1 else code[:0]
        whole = left[: len(code)] >= n
        out.append(mix(code[whole] + U64(n << 40)) >> U64(64 - BITS))
        rows.append(of_row[: len(code)][whole])
    return np.concatenate(out).astype(np.int64), np.concatenate(rows)


def histograms(docs: DataFrame) -> tuple[list[tuple[np.ndarray, np.ndarray]], list[str]]:
    """(buckets, counts) of each document of a bounded sample, and the languages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, raw, offsets in chunks(batch.column("text"), lower=True):
                bucket, row = subwords(raw, offsets)
                pair, count = np.unique(row << BITS | bucket, return_counts=True)
                at = bounds(pair >> BITS, hi - lo)
                blobs = [np.stack([pair[a:b] & ((1 << BITS) - 1), count[a:b]]).astype("<i4").tobytes() for a, b in zip(at[:-1], at[1:])]
                yield pa.record_batch([batch.column("doc_id").slice(lo, hi - lo), batch.column("lang").slice(lo, hi - lo), pa.array(blobs, pa.binary())], names=["doc_id", "lang", "bag"])

    found = map_batches(docs.select("doc_id", "text", "lang"), run, "doc_id long, lang string, bag binary").dropDuplicates(["doc_id"]).toArrow().sort_by("doc_id")
    parts = [np.frombuffer(b, "<i4").reshape(2, -1) for b in found.column("bag").to_pylist()]
    return [(p[0], p[1]) for p in parts], found.column("lang").to_pylist()


def train(found: list[tuple[np.ndarray, np.ndarray]], langs: list[str], epochs: int = 4, rate: float = 0.5, seed: int = 5) -> tuple[list[str], np.ndarray, np.ndarray, float, float]:
    """Languages, the weight of each bucket for each, biases, temperature, and the least accepted probability."""
    names = sorted(set(langs))
    if not names:
        return [], np.zeros((1 << BITS, 1), np.float32), np.zeros(1, np.float32), 1.0, 0.0
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 0.3, (1 << BITS, WIDTH)).astype(np.float32)
    soft, bias = np.zeros((WIDTH, len(names)), np.float32), np.zeros(len(names), np.float32)
    y = np.array([names.index(x) for x in langs])
    some = [i for i in rng.permutation(len(y)) if len(found[i][0])]
    aside, own = some[: len(some) // 10], some[len(some) // 10 :]
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for i in rng.permutation(own) if own else []:
            bucket, count = found[i]
            share = (count / count.sum()).astype(np.float32)
            mean = share @ emb[bucket]
            z = mean @ soft + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            g = soft @ p
            soft -= step * np.outer(mean, p)
            bias -= step * 0.1 * p
            emb[bucket] -= (step * 8) * share[:, None] * g
    logits = np.array([(c / c.sum()) @ (emb[b] @ soft) + bias for b, c in (found[i] for i in aside)]).reshape(-1, len(names))
    truth = y[aside]
    best = (np.inf, 1.0, 0.0)
    for t in np.geomspace(0.05, 4, 40):
        z = logits / t
        p = np.exp(z - z.max(1, keepdims=True)) if len(z) else z
        p = p / p.sum(1, keepdims=True) if len(p) else p
        loss = -np.log(np.maximum(p[np.arange(len(p)), truth], 1e-12)).mean() if len(p) else 0.0
        right = p[np.arange(len(p)), truth][p.argmax(1) == truth] if len(p) else np.zeros(0)
        if loss < best[0]:
            best = (loss, t, float(np.quantile(right, MISSES)) if len(right) else 0.0)
    return names, (emb @ soft).astype(np.float32), bias, best[1], best[2]


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray, float, float]) -> DataFrame:
    names, weights, bias, temperature, least = model
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # 2**BITS rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = np.ascontiguousarray(shared.value.T)
        known = np.array(names or ["und"])
        for batch in batches:
            lettered = pc.fill_null(pc.match_substring_regex(batch.column("text"), r"\pL"), False).to_numpy(zero_copy_only=False)
            for lo, hi, raw, offsets in chunks(batch.column("text"), lower=True):
                n = hi - lo
                bucket, row = subwords(raw, offsets)
                total = np.maximum(np.bincount(row, minlength=n), 1)
                z = np.stack([np.bincount(row, x[bucket], n) / total for x in w], 1) + bias
                p = np.exp((z - z.max(1, keepdims=True)) / temperature)
                p /= p.sum(1, keepdims=True)
                top, told = p.argmax(1), lettered[lo:hi] & bool(names)
                score = np.where(told, p[np.arange(n), top], 0.0)
                yield pa.record_batch([batch.column("doc_id").slice(lo, n), pa.array(np.where(told, known[top], "und").tolist(), pa.string()), pa.array(score, pa.float64()), pa.array(told & (score >= least))], names=["doc_id", "lang_pred", "score", "accepted"])

    return map_batches(docs.select("doc_id", "text"), run, "doc_id long, lang_pred string, score double, accepted boolean")


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = F.crc32(F.col("doc_id").cast("string")) % 3
    sample = labelled_sample(docs, docs.select("doc_id", F.col("lang").alias("y")), fold != 1, SAMPLE, SAMPLE_CHARS)
    model = train(*histograms(sample.withColumnRenamed("y", "lang")))
    return predict(docs, model).select("doc_id", F.coalesce(fold == 1, F.lit(False)).alias("held_out"), "lang_pred", "score", "accepted")

"""Quality by attention over the passages of a document (multiple-instance learning).

A text is cut into passages of ``WORDS`` words. Each passage is encoded: the square roots of its shares of each ASCII
byte and of other bytes, its mean word length, its share of words met before in the passage and of three-word runs met
before in the document. A layer of ``HIDDEN`` tanh units gives the passage's representation h; gated attention
a = softmax(w . (tanh(V h) * sigmoid(U h))) weighs the passages; the document's score is sigmoid(c . sum(a h) + b).
Everything is trained from document labels by Adam in numpy on a bounded sample of labelled documents (``SAMPLE``
rows and ``SAMPLE_CHARS`` characters at most, parameters), which bounds what the driver gets. Every whole text of the corpus is scored on the executors.

An empty or null text, or one without words, is one passage of no shares. With no label of either class to learn from,
every score is the share of label 1 (1 if there are no labels, so that nothing is rejected). Repeated rows are scored
alike; columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions.tables import free_name
from vellum.llm.common import U64, bounds, chunks, labelled_sample, map_batches, mix, sigmoid, span_hash, table, word_spans

SAMPLE = 6000
SAMPLE_CHARS = 32_000_000
WORDS = 100
HIDDEN = 24
GATES = 12
FEATURES = 129 + 3
THRESHOLD = 0.7


def repeated(keys: np.ndarray) -> np.ndarray:
    """Whether each key has come before."""
    _, first = np.unique(keys, return_index=True)
    out = np.ones(len(keys), bool)
    out[first] = False
    return out


def passages(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features and row of each passage. Every row has one at least."""
    n = len(offsets) - 1
    start, end, row = word_spans(raw, offsets)
    first_word = bounds(row, n)
    nth = np.arange(len(start)) - first_word[row]
    count = np.maximum(1, -(-np.diff(first_word) // WORDS))
    first_passage = np.r_[0, np.cumsum(count)]
    of_word = first_passage[row] + nth // WORDS
    total = int(first_passage[-1])
    cuts = offsets[np.repeat(np.arange(n), count)].astype(np.int64)  # a passage begins at its first word, the row's first at the row's start
    later = (nth % WORDS == 0) & (nth > 0)
    cuts[of_word[later]] = start[later]
    size = np.diff(np.r_[cuts, len(raw)])
    of_byte = np.repeat(np.arange(total), size)
    shares = np.bincount(of_byte * 129 + np.minimum(raw, 128), minlength=total * 129).reshape(total, 129).astype(np.float32)
    x = np.zeros((total, FEATURES), np.float32)
    x[:, :129] = np.sqrt(shares / np.maximum(size, 1)[:, None])
    if len(start):
        hashed = span_hash(raw, start, end)
        words = np.maximum(np.bincount(of_word, minlength=total), 1)
        x[:, 129] = np.bincount(of_word, end - start, total) / words / 10
        x[:, 130] = np.bincount(of_word, repeated(hashed * U64(3) + mix(of_word.astype(U64))), total) / words
        if len(start) > 2:
            runs = mix(hashed[:-2] * U64(5) + hashed[1:-1] * U64(7) + hashed[2:] * U64(11)) + mix(row[:-2].astype(U64))
            x[:, 131] = np.bincount(of_word[:-2], repeated(runs) & (row[:-2] == row[2:]), total) / words
    return x, np.repeat(np.arange(n), count)


def encoded(docs: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Passages of all documents of a bounded sample, offsets of the documents in them, and their ys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, raw, offsets in chunks(batch.column("text")):
                x, row = passages(raw, offsets)
                at = bounds(row, hi - lo)
                blobs = [x[a:b].astype("<f4").tobytes() for a, b in zip(at[:-1], at[1:])]
                yield pa.record_batch([batch.column("doc_id").slice(lo, hi - lo), batch.column("y").slice(lo, hi - lo).cast(pa.int32()), pa.array(blobs, pa.binary())], names=["doc_id", "y", "bag"])

    found = map_batches(docs.select("doc_id", "text", "y"), run, "doc_id long, y int, bag binary").dropDuplicates(["doc_id"]).toArrow().sort_by("doc_id")
    parts = [np.frombuffer(b, "<f4").reshape(-1, FEATURES) for b in found.column("bag").to_pylist()]
    return np.concatenate(parts) if parts else np.zeros((0, FEATURES), np.float32), np.cumsum([0, *map(len, parts)]), found.column("y").to_numpy()


def forward(p: dict[str, np.ndarray], x: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """Logit of each bag, and what the backward pass needs. ``at``: offsets of the bags, none of them empty."""
    h = np.tanh(((x - p["mean"]) * p["scale"]) @ p["W"] + p["b"])
    tanh, gate = np.tanh(h @ p["V"]), sigmoid(h @ p["U"])
    e = (tanh * gate) @ p["w"]
    of = np.repeat(np.arange(len(at) - 1), np.diff(at))
    e = np.exp(e - np.maximum.reduceat(e, at[:-1])[of])
    a = e / np.add.reduceat(e, at[:-1])[of]
    z = np.add.reduceat(a[:, None] * h, at[:-1])
    return z @ p["c"] + p["d"][0], h, tanh, gate, a, z, of


def train(x: np.ndarray, at: np.ndarray, y: np.ndarray, epochs: int = 30, batch: int = 256, rate: float = 3e-3, seed: int = 7) -> dict[str, np.ndarray] | float:
    """The parameters, or the share of label 1 if there is but one class."""
    if not len(y) or y.mean() in (0, 1):
        return float(y.mean()) if len(y) else 1.0
    rng = np.random.default_rng(seed)
    p = {"mean": x.mean(0), "scale": 1 / (x.std(0) + 0.02)}
    own = {"W": rng.normal(0, 1 / np.sqrt(FEATURES), (FEATURES, HIDDEN)), "b": np.zeros(HIDDEN), "V": rng.normal(0, 0.3, (HIDDEN, GATES)), "U": rng.normal(0, 0.3, (HIDDEN, GATES)), "w": rng.normal(0, 0.3, GATES), "c": rng.normal(0, 0.3, HIDDEN), "d": np.zeros(1)}
    p |= {k: v.astype(np.float32) for k, v in own.items()}
    m, v, t = {k: 0.0 for k in own}, {k: 0.0 for k in own}, 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for lo in range(0, len(y), batch):
            pick = order[lo : lo + batch]
            rows = np.concatenate([np.arange(at[i], at[i + 1]) for i in pick])
            sub = np.r_[0, np.cumsum(at[pick + 1] - at[pick])]
            xs = x[rows]
            logit, h, tanh, gate, a, z, of = forward(p, xs, sub)
            dl = ((sigmoid(logit) - y[pick]) / len(pick)).astype(np.float32)
            dz = dl[:, None] * p["c"]
            da = (dz[of] * h).sum(1)
            de = a * (da - np.add.reduceat(a * da, sub[:-1])[of])
            dg = de[:, None] * p["w"]
            dt, ds = dg * gate * (1 - tanh**2), dg * tanh * gate * (1 - gate)
            dh = (a[:, None] * dz[of] + dt @ p["V"].T + ds @ p["U"].T) * (1 - h**2)
            g = {"W": ((xs - p["mean"]) * p["scale"]).T @ dh, "b": dh.sum(0), "V": h.T @ dt, "U": h.T @ ds, "w": (tanh * gate).T @ de, "c": z.T @ dl, "d": dl.sum(keepdims=True)}
            t += 1
            for k in own:
                g[k] = g[k] + 1e-4 * p[k]
                m[k], v[k] = 0.9 * m[k] + 0.1 * g[k], 0.999 * v[k] + 0.001 * g[k] ** 2
                p[k] = (p[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return p


def score(docs: DataFrame, model: dict[str, np.ndarray] | float, keep: str = "") -> DataFrame:
    """doc_id and score; with ``keep`` all columns of ``docs`` and the score last, in a column of that name, which must be
    a new one."""
    schema, name = "doc_id long", keep or "score"
    docs = docs if keep else docs.select("doc_id", "text")
    if keep:
        if free_name(docs, keep) != keep:
            raise ValueError(f"there is a column {keep}")
        from pyspark.sql import types as T

        schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])
    else:
        schema += ", score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = np.full(batch.num_rows, model if isinstance(model, float) else 0.0)
            if not isinstance(model, float):
                for lo, hi, raw, offsets in chunks(batch.column("text")):
                    x, row = passages(raw, offsets)
                    scores[lo:hi] = sigmoid(forward(model, x, bounds(row, hi - lo))[0])
            columns = batch.columns if keep else [batch.column("doc_id")]
            names = batch.schema.names if keep else ["doc_id"]
            yield pa.record_batch([*columns, pa.array(scores, pa.float64())], names=[*names, name])

    return map_batches(docs, run, schema)


def learned(docs: DataFrame, labels: DataFrame, learn: F.Column, rows: int = SAMPLE, size: int = SAMPLE_CHARS) -> dict[str, np.ndarray] | float:
    return train(*encoded(labelled_sample(docs, labels.select("doc_id", F.col("quality").alias("y")), learn, rows, size)))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = F.crc32(F.col("doc_id").cast("string")) % 4
    model = learned(docs, table(spark, sf_dir, "labels"), fold != 2)
    return score(docs, model).select("doc_id", F.coalesce(fold == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))

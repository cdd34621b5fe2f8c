"""Document scores by masked pseudo-likelihood under a bidirectional window network.

Each word is predicted from the ``SIDE`` words on either side of it, and a document's score is the sum of the log
probabilities of all its words. The network: the neighbours' embeddings, weighted by place, are summed and go through
tanh; a two-level softmax gives the class of the word (one of ``CLASSES``) and the word within its class.

1. Words are hashed into ``BUCKETS`` buckets, whose counts over the whole corpus are summed by Spark. The most frequent
   buckets get ids of their own, the others share the last ``SHARED`` ids. Counts also set the softmax's biases.
2. Documents are dealt out by a hash of id and words to shares of ``SHARE`` words on average, so many as the corpus needs, and
   stand there in the order of the hash. What is trained follows from the corpus alone, not from the session's cores or
   the table's partitions. Words travel as bucket numbers of two bytes.
3. ``ROUNDS`` times every share trains a copy of the network in numpy (Adagrad) on its own documents, at every
   ``ROUNDS``-th word beginning at a place that differs by document and moves on with the round, so that every word of
   every document is trained at exactly once; copies are averaged, weighted by the words they saw, in levels of groups of
   ``FAN_IN`` copies at most. The network's size is fixed, and what is gathered grows with the corpus.
4. All words of all documents are scored on the executors: the network's probability of the word's id times the share
   of the word's bucket in that id.

A null or empty text, or one without words, has log_prob 0, 0 words and no mean. Repeated rows are scored alike. An
empty corpus gives an empty result. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm.common import CHUNK, bounds, chunks, map_batches, shared_checkpoint, table, word_hashes

BUCKETS = 1 << 16
CLASSES = 64
IDS = CLASSES * CLASSES
SHARED = 512
WIDTH = 24
SIDE = 2
PLACES = [-2, -1, 1, 2]
ROUNDS = 2
BATCH = 4096
SCORED = 8192  # words scored at a time
SLICE = 8192
SHARE = 1 << 20  # words, on average
RATE = 0.15
FAN_IN = 64


def word_buckets(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    hashed, row = word_hashes(raw, offsets)
    return (hashed >> np.uint64(48)).astype(np.int64), row


def bucket_counts(docs: DataFrame) -> np.ndarray:
    """Words of the corpus in each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for _, _, raw, offsets in chunks(batch.column("text"), lower=True):
                total += np.bincount(word_buckets(raw, offsets)[0], minlength=BUCKETS)
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(some), pa.array(total[some])], names=["bucket", "words"])

    found = map_batches(docs.select("text"), run, "bucket long, words long").groupBy("bucket").agg(F.sum("words").alias("words")).toArrow()
    out = np.zeros(BUCKETS, np.int64)
    out[found.column("bucket").to_numpy()] = found.column("words").to_numpy()
    return out


class Vocabulary:
    """The id of each bucket, and log shares of the classes, of the ids within them and of the buckets within their
    ids. Id 0 stands beside texts."""

    def __init__(self, counts: np.ndarray):
        order = np.lexsort((np.arange(BUCKETS), -counts))
        self.ids = np.empty(BUCKETS, np.int64)
        own = IDS - SHARED - 1
        self.ids[order[:own]] = 1 + np.arange(own)
        self.ids[order[own:]] = 1 + own + np.arange(BUCKETS - own) % SHARED
        shares = np.bincount(self.ids, counts, IDS).reshape(CLASSES, CLASSES) + 0.5
        self.class_bias = np.log(shares.sum(1) / shares.sum()).astype(np.float32)
        self.id_bias = np.log(shares / shares.sum(1, keepdims=True)).astype(np.float32)
        counts = counts + 0.5
        self.bucket_share = np.log(counts / np.bincount(self.ids, counts, IDS)[self.ids])


def fresh(seed: int = 11) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    normal = lambda *shape: rng.normal(0, 0.3, shape).astype(np.float32)
    return {"E": normal(IDS, WIDTH), "P": np.ones((len(PLACES), WIDTH), np.float32), "b": np.zeros(WIDTH, np.float32), "C": normal(CLASSES, WIDTH) * 0.1, "M": normal(CLASSES, CLASSES, WIDTH) * 0.1}


SIZES = {k: v.shape for k, v in fresh().items()}


def flat(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in SIZES])


def shaped(x: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, shape in SIZES.items():
        n = int(np.prod(shape))
        out[k] = x[at : at + n].reshape(shape).astype(np.float32)
        at += n
    return out


def neighbours(ids: np.ndarray, row: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Ids of the words beside those at ``at``, one column for each of PLACES; 0 beyond the text."""
    out = np.zeros((len(at), len(PLACES)), np.int64)
    for k, d in enumerate(PLACES):
        other = np.clip(at + d, 0, len(ids) - 1)
        out[:, k] = np.where((at + d == other) & (row[other] == row[at]), ids[other], 0)
    return out


def largest(z: np.ndarray) -> np.ndarray:
    """Of each row, by halves of its columns, a power of two of them; a reduction by rows takes three times as long."""
    while z.shape[1] > 1:
        half = z.shape[1] // 2
        z = np.maximum(z[:, :half], z[:, half:])
    return z


def softmax(z: np.ndarray) -> np.ndarray:
    """In place, where a copy would cost as much as the rest; a row's sum is a product with ones."""
    z -= largest(z)
    np.exp(z, out=z)
    z /= z @ np.ones((z.shape[1], 1), z.dtype)
    return z


def hidden(p: dict[str, np.ndarray], beside: np.ndarray) -> np.ndarray:
    return np.tanh(np.einsum("nkd,kd->nd", np.take(p["E"], beside, axis=0), p["P"]) + p["b"])


def log_probabilities(p: dict[str, np.ndarray], v: Vocabulary, beside: np.ndarray, target: np.ndarray) -> np.ndarray:
    order = np.argsort((target // CLASSES).astype(np.uint16), kind="stable")  # the words of a class are one run
    kind, member = np.divmod(target[order], CLASSES)
    h, every = hidden(p, beside[order]), np.arange(len(target))

    def chosen(z: np.ndarray, at: np.ndarray) -> np.ndarray:
        z -= largest(z)
        own = z[every, at]
        return own - np.log(np.exp(z, out=z) @ np.ones(CLASSES, z.dtype))

    z = h @ p["C"].T
    z += v.class_bias
    got = chosen(z, kind)
    at = bounds(kind, CLASSES)
    for c in np.flatnonzero(np.diff(at)):
        own = slice(at[c], at[c + 1])
        np.matmul(h[own], p["M"][c].T, out=z[own])
        z[own] += v.id_bias[c]
    out = np.empty(len(target))
    out[order] = got + chosen(z, member)
    return out


def learn(p: dict[str, np.ndarray], sums: dict[str, np.ndarray], v: Vocabulary, beside: np.ndarray, target: np.ndarray, rate: float = RATE) -> None:
    """One Adagrad step on a batch, in place."""
    n, every = len(target), np.arange(len(target))
    order = np.argsort((target // CLASSES).astype(np.uint16), kind="stable")  # the words of a class are one run
    beside, target = beside[order], target[order]
    kind, member = np.divmod(target, CLASSES)
    at = bounds(kind, CLASSES)
    some = np.flatnonzero(np.diff(at))
    runs = [(c, slice(at[c], at[c + 1])) for c in some]
    near = np.take(p["E"], beside, axis=0)
    h = np.tanh(np.einsum("nkd,kd->nd", near, p["P"]) + p["b"])
    dc = softmax(h @ p["C"].T + v.class_bias)
    dc[every, kind] -= 1
    dm = v.id_bias[kind]
    for c, own in runs:
        dm[own] += h[own] @ p["M"][c].T
    dm = softmax(dm)
    dm[every, member] -= 1
    dh, gM = dc @ p["C"], np.empty((len(some), CLASSES, WIDTH), np.float32)
    for k, (c, own) in enumerate(runs):
        dh[own] += dm[own] @ p["M"][c]
        gM[k] = dm[own].T @ h[own]
    da = dh * (1 - h * h)
    gP = np.einsum("nd,nkd->kd", da, near)
    each = beside.ravel().astype(np.uint16)
    order = np.argsort(each, kind="stable")
    each = each[order]
    first = np.flatnonzero(np.r_[True, each[1:] != each[:-1]])
    used = each[first].astype(np.int64)
    gE = np.add.reduceat(np.take((da[:, None, :] * p["P"]).reshape(-1, WIDTH), order, axis=0), first, axis=0)
    for key, at_, g in (("C", slice(None), dc.T @ h), ("P", slice(None), gP), ("b", slice(None), da.sum(0)), ("E", used, gE), ("M", some if len(some) < CLASSES else slice(None), gM)):
        g = g * n**-0.5  # a Python float, so that single precision stays
        seen = sums[key][at_] + g * g
        sums[key][at_] = seen
        seen += 1e-3
        np.sqrt(seen, out=seen)
        g *= rate
        g /= seen
        p[key][at_] -= g


def dealt_out(docs: DataFrame, words: int, share: int = SHARE) -> DataFrame:
    """share and words (two bytes a word) of the documents that have words, dealt out and sorted, written once."""
    n = max(1, -(-words // share))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, raw, offsets in chunks(batch.column("text"), lower=True):
                bucket, row = word_buckets(raw, offsets)
                at = bounds(row, hi - lo)
                some = np.flatnonzero(np.diff(at))
                data = pa.LargeBinaryArray.from_buffers(pa.large_binary(), hi - lo, [None, pa.py_buffer(2 * at.astype(np.int64)), pa.py_buffer(bucket.astype("<u2"))])
                yield pa.record_batch([batch.column("doc_id").slice(lo, hi - lo).take(pa.array(some)), data.take(pa.array(some)).cast(pa.binary())], names=["doc_id", "words"])

    coded = map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, words binary")
    keyed = coded.withColumn("key", F.xxhash64("doc_id", "words")).withColumn("share", F.pmod("key", F.lit(n)).cast("int"))
    return shared_checkpoint(keyed.repartitionById(n, F.col("share")).sortWithinPartitions("share", "key", "doc_id", "words").select("share", "words"))


def document_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Share, buckets and rows of runs of documents of one share, of about ``CHUNK`` bytes."""
    for batch in batches:
        share, column = batch.column("share").to_numpy(), batch.column("words").cast(pa.large_binary())
        at = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
        data = np.frombuffer(column.buffers()[2], np.uint8) if len(column) else None
        row = 0
        while row < len(share):
            end = max(row + 1, int(np.searchsorted(at, at[row] + CHUNK, "right")) - 1)
            end = row + int(np.searchsorted(share[row:end], share[row], "right"))
            own = np.frombuffer(data[at[row] : at[end]].tobytes(), "<u2").astype(np.int64)
            yield int(share[row]), own, np.repeat(np.arange(end - row), np.diff(at[row : end + 1]) // 2)
            row = end


class Copy:
    """A copy of the network in training."""

    def __init__(self, share: int, start: np.ndarray, v: Vocabulary):
        self.share, self.v, self.words = share, v, 0
        self.p = shaped(start.copy())
        self.sums = {k: np.zeros(shape, np.float32) for k, shape in SIZES.items()}
        self.held: list[tuple[np.ndarray, np.ndarray]] = []

    def take(self, bucket: np.ndarray, row: np.ndarray, turn: int) -> None:
        ids = self.v.ids[bucket]
        first = bounds(row, int(row[-1]) + 1)[row]
        at = np.flatnonzero((np.arange(len(ids)) - first + bucket[first] + turn) % ROUNDS == 0)
        self.words += len(at)
        self.held.append((neighbours(ids, row, at), ids[at]))
        if sum(len(t) for _, t in self.held) >= BATCH:
            self.learn(BATCH)

    def learn(self, batch: int) -> None:
        """From what is held, in whole batches; the rest stays."""
        beside, target = (np.concatenate(x) for x in zip(*self.held))
        whole = len(target) // batch * batch
        for lo in range(0, whole, batch):
            learn(self.p, self.sums, self.v, beside[lo : lo + batch], target[lo : lo + batch])
        self.held = [(beside[whole:], target[whole:])]

    def rows(self) -> pa.RecordBatch:
        if left := sum(len(t) for _, t in self.held):
            self.learn(left)
        x = flat(self.p)
        slices = [x[lo : lo + SLICE] for lo in range(0, len(x), SLICE)]
        columns = [pa.array([self.share] * len(slices), pa.int32()), pa.array(range(len(slices)), pa.int32()), pa.array([float(self.words)] * len(slices)), pa.array([s.astype("<f4").tobytes() for s in slices], pa.binary())]
        return pa.record_batch(columns, names=["part", "slice", "words", "values"])


def trained_copies(dealt: DataFrame, start: np.ndarray, v: Vocabulary, turn: int) -> DataFrame:
    """part, slice, words and values of each share's copy; a row for each slice of the parameters."""
    shared = dealt.sparkSession.sparkContext.broadcast((start, v))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, v = shared.value
        copy = None
        for share, bucket, row in document_runs(batches):
            if copy and copy.share != share:
                yield copy.rows()
                copy = None
            copy = copy or Copy(share, start, v)
            copy.take(bucket, row, turn)
        if copy:
            yield copy.rows()

    return map_batches(dealt, run, "part int, slice int, words double, values binary")


def averaged(copies: DataFrame, fan_in: int = FAN_IN) -> np.ndarray | None:
    """The parameters' mean over all copies, by levels of groups of ``fan_in`` copies at most of a slice."""

    def mean(rows: pd.DataFrame) -> pd.DataFrame:
        rows, words = rows.sort_values("part"), rows["words"].sum()
        total = sum(np.frombuffer(x, "<f4").astype(np.float64) * w for x, w in zip(rows["values"], rows["words"]))
        return pd.DataFrame({"part": [rows["part"].min() // fan_in], "slice": [rows["slice"].iloc[0]], "words": [words], "values": [(total / max(words, 1)).astype("<f4").tobytes()]}).astype({"part": "int32"})

    schema = "part int, slice int, words double, values binary"
    left = (copies.agg(F.max("part")).first()[0] or 0) + 1
    while True:
        copies = copies.groupBy("slice", F.floor(F.col("part") / fan_in).alias("share")).applyInPandas(mean, schema)
        if (left := -(-left // fan_in)) == 1:
            break
    rows = copies.toArrow().sort_by("slice")  # the parameters, once
    return np.concatenate([np.frombuffer(x, "<f4") for x in rows.column("values").to_pylist()]) if rows.num_rows else None


def fit(docs: DataFrame, share: int = SHARE) -> tuple[dict[str, np.ndarray], Vocabulary]:
    counts = bucket_counts(docs)
    v, dealt = Vocabulary(counts), dealt_out(docs, int(counts.sum()), share)
    p = flat(fresh())
    for turn in range(ROUNDS):
        found = averaged(shared_checkpoint(trained_copies(dealt, p, v, turn)))
        p = p if found is None else found
    return shaped(p), v


def score(docs: DataFrame, model: tuple[dict[str, np.ndarray], Vocabulary]) -> DataFrame:
    """doc_id, log_prob, n_words, mean_log_prob."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, v = shared.value
        for batch in batches:
            for lo, hi, raw, offsets in chunks(batch.column("text"), lower=True):
                bucket, row = word_buckets(raw, offsets)
                ids = v.ids[bucket]
                logs = np.zeros(len(ids))
                for a in range(0, len(ids), SCORED):
                    at = np.arange(a, min(a + SCORED, len(ids)))
                    logs[at] = log_probabilities(p, v, neighbours(ids, row, at), ids[at]) + v.bucket_share[bucket[at]]
                words = np.bincount(row, minlength=hi - lo)
                total = np.bincount(row, logs, hi - lo)
                mean = pa.array(total / np.maximum(words, 1), pa.float64(), mask=words == 0)
                yield pa.record_batch([batch.column("doc_id").slice(lo, hi - lo), pa.array(total, pa.float64()), pa.array(words, pa.int64()), mean], names=["doc_id", "log_prob", "n_words", "mean_log_prob"])

    return map_batches(docs.select("doc_id", "text"), run, "doc_id long, log_prob double, n_words long, mean_log_prob double")


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs))

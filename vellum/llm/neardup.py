"""N-gram Jaccard join by MinHash banding.

1. Each whole text becomes its set of five-word shingles (64-bit hashes). Texts with the same set are one class, named
   by a 128-bit fingerprint of the set; everything that follows is done once for a class, so exact copies cost nothing.
2. ``plan_bands`` picks the least number of hash functions, as bands of rows, that finds a pair of the wanted
   similarity with the wanted recall.
3. Classes are shuffled on band hashes as (bucket, fingerprint); counts drop the buckets of one class, and buckets that
   hold the same classes as one of an earlier band are dropped.
4. A bucket of more than ``BLOCK`` classes is dealt out as pairs of blocks, so no task gets a whole large bucket. A task
   compares only classes that no earlier band brings together, verifies each pair on the full shingle sets, and gives
   back for each class the number of documents it is linked to and one edge to its group: pairs are never written.
5. Groups are the connected components of the links, found by alternating large and small stars on a table of edges
   that is cut by checkpoints.

The result has one row for each document: class_id (the least doc_id of its group), copy_id (the least doc_id of its
class) and n_links (documents of similarity ``SIMILARITY`` or more, copies included). A text of one to four words has
one shingle of all its words. A null or empty text, or one without words, has no shingle: it has no links, and
class_id and copy_id are its own doc_id. Repeated rows are copies of each other. A null doc_id is kept and is the
least only where a class has no other. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm.common import U64, bounds, chunks, map_batches, mix, shared_checkpoint, shingles, table, word_hashes

WORDS = 5
SIMILARITY = 0.8
RECALL = 0.9995
BLOCK = 384
BROADCAST_ROWS = 1_000_000


def plan_bands(similarity: float = SIMILARITY, recall: float = RECALL, chance: float = 1e-3, low: float = 0.3) -> tuple[int, int]:
    """(bands, rows): the fewest hash functions that bring a pair of ``similarity`` together in a band with
    probability ``recall``, among those that do so with a pair of similarity ``low`` with under bands * ``chance``."""
    plans = []
    for rows in range(1, 17):
        if low**rows > chance * 3:
            continue
        bands = int(np.ceil(np.log(1 - recall) / np.log(1 - similarity**rows)))
        plans.append((bands * rows, bands, rows))
    return min(plans)[1:]


def multipliers(n: int) -> np.ndarray:
    return mix(np.arange(1000, 1000 + n, dtype=U64)) | U64(1)


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The different shingles of each row, sorted, and the row of each."""
    s, row = shingles(*word_hashes(raw, offsets), n)
    if not len(s):
        return s, row
    at = bounds(row, len(offsets) - 1)
    parts = [np.unique(s[a:b]) for a, b in zip(at[:-1], at[1:])]
    return np.concatenate(parts), np.repeat(np.arange(len(parts)), [len(p) for p in parts])


def fingerprints(s: np.ndarray, first: np.ndarray) -> np.ndarray:
    """16 bytes for each set; sets begin at ``first``."""
    return np.stack([np.add.reduceat(mix(s + U64(k)), first) for k in (17, 91)], 1)


def signatures(docs: DataFrame, bands: int, rows: int, n: int = WORDS) -> DataFrame:
    """doc_id, key, fp, the bands' hashes as bytes. fp is null where there is no shingle."""
    own = multipliers(bands * rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, raw, offsets in chunks(batch.column("text"), lower=True):
                s, row = shingle_sets(raw, offsets, n)
                count = hi - lo
                fp, hashes = [None] * count, [None] * count
                if len(s):
                    first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
                    least = np.stack([np.minimum.reduceat(s * a, first) for a in own], 1).reshape(len(first), bands, rows)
                    folded = np.zeros((len(first), bands), U64)
                    for k in range(rows):
                        folded = mix(folded * U64(31) + least[:, :, k])
                    folded = mix(folded + np.arange(bands, dtype=U64))
                    prints = fingerprints(s, first)
                    for k, r in enumerate(row[first]):
                        fp[r], hashes[r] = prints[k].tobytes(), folded[k].tobytes()
                yield pa.record_batch([batch.column("doc_id").slice(lo, count), batch.column("key").slice(lo, count), pa.array(fp, pa.binary()), pa.array(hashes, pa.binary())], names=["doc_id", "key", "fp", "bands"])

    return map_batches(docs.select("doc_id", "text", text_key().alias("key")), run, "doc_id long, key binary, fp binary, bands binary")


def text_key() -> F.Column:
    """128 bits for each different text, so that even among very many no two share a key."""
    return F.unhex(F.md5(F.coalesce(F.col("text"), F.lit(""))))


def sets_of(docs: DataFrame, n: int = WORDS) -> DataFrame:
    """fp and the sorted shingles as bytes, of each different text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, raw, offsets in chunks(batch.column("text"), lower=True):
                s, row = shingle_sets(raw, offsets, n)
                fp, sets = [], []
                if len(s):
                    first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
                    fp = [p.tobytes() for p in fingerprints(s, first)]
                    sets = [x.tobytes() for x in np.split(s, first[1:])]
                yield pa.record_batch([pa.array(fp, pa.binary()), pa.array(sets, pa.binary())], names=["fp", "shingles"])

    return map_batches(docs.select("text"), run, "fp binary, shingles binary").dropDuplicates(["fp"])


def overlaps(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the pairs of sets. Many pairs are counted together, as products of the sets'
    incidence matrices over slices of the shingles that two sets at least share; few pairs one by one."""
    if len(left) < 64:
        return np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(left, right)], np.int64)
    used = np.unique(np.r_[left, right])
    place = np.zeros(len(sets), np.int64)
    place[used] = np.arange(len(used))
    owner = np.repeat(np.arange(len(used)), [len(sets[i]) for i in used])
    keys, column, times = np.unique(np.concatenate([sets[i] for i in used]), return_inverse=True, return_counts=True)
    wide = np.cumsum(times > 1) - 1
    keep = times[column] > 1
    owner, column = owner[keep], wide[column[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    counts = np.zeros((len(used), len(used)), np.float32)
    total, step = int(wide[-1]) + 1 if len(wide) else 0, 4096
    for lo in range(0, total, step):
        a, b = np.searchsorted(column, [lo, lo + step])
        m = np.zeros((len(used), min(step, total - lo)), np.float32)
        m[owner[a:b], column[a:b] - lo] = 1
        counts += m @ m.T
    return np.rint(counts[place[left], place[right]]).astype(np.int64)


def verifier(bands: int, similarity: float):
    """For the rows of a task, (bucket, side, fp, docs, bands, shingles): fp, root and links of each linked class.

    Pairs are made between side 0 and side 1 of a bucket, or within side 2. A pair counts in the first band only in
    which both have the same hash, ``bucket`` being that hash.
    """

    def run(task: pd.DataFrame) -> pd.DataFrame:
        fps = task["fp"].to_numpy()
        links: dict[bytes, int] = {}
        root: dict[bytes, bytes] = {}

        def find(x: bytes) -> bytes:
            while (up := root.setdefault(x, x)) != x:
                root[x] = root[up]
                x = root[x]
            return x

        for bucket, rows in task.groupby(["bucket", "deal"], sort=False).indices.items():
            rows = rows[np.argsort(fps[rows])]
            hashes = np.stack([np.frombuffer(x, U64) for x in task["bands"].iloc[rows]])
            sets = [np.frombuffer(x, U64) for x in task["shingles"].iloc[rows]]
            size, side, weight = np.array([len(s) for s in sets]), task["side"].to_numpy()[rows], task["docs"].to_numpy()[rows]
            here = np.flatnonzero((hashes == np.frombuffer(bucket[0], U64)).any(0))[0]
            ok = np.minimum.outer(size, size) >= similarity * np.maximum.outer(size, size)
            ok &= np.triu((side[:, None] != side[None, :]) | (side[:, None] == 2), 1)
            for k in range(here):
                ok &= hashes[:, None, k] != hashes[None, :, k]
            left, right = np.nonzero(ok)
            if not len(left):
                continue
            common = overlaps(sets, left, right)
            linked = common >= similarity * (size[left] + size[right] - common) - 1e-9
            for i, j in zip(left[linked], right[linked]):
                a, b = fps[rows[i]], fps[rows[j]]
                links[a] = links.get(a, 0) + int(weight[j])
                links[b] = links.get(b, 0) + int(weight[i])
                a, b = find(a), find(b)
                if a != b:
                    root[max(a, b)] = min(a, b)
        return pd.DataFrame({"fp": list(links), "root": [find(x) for x in links], "links": list(links.values())}, columns=["fp", "root", "links"])

    return run


def components(edges: DataFrame) -> DataFrame:
    """u, v: the least node v of the component of each node u but the least. ``edges``: u, v.

    Least neighbours are written before they are joined, so that the join stands on two plain exchanges and adaptive
    execution can split a centre of very many edges."""
    edges = shared_checkpoint(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = None
    while True:
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state or not now[0]:
            return edges
        state = now
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = shared_checkpoint(both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m")))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = shared_checkpoint(large)
        least = shared_checkpoint(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").filter("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
        edges = shared_checkpoint(small.distinct())


def links_of(docs: DataFrame, classes: DataFrame, bands: int, similarity: float, n: int, block: int) -> DataFrame:
    """fp, root, links: for each class and task that found links, the documents linked to, and an edge."""
    hashed = classes.select("fp", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda k: F.substring(F.col("bands"), k * 8 + 1, F.lit(8)))).alias("band", "bucket"))
    mark = F.xxhash64("fp")
    counted = hashed.groupBy("bucket").agg(F.count(F.lit(1)).alias("members"), F.sum(mark.cast("decimal(20,0)")).alias("total"), F.bit_xor(mark).alias("odd"), F.min("band").alias("band")).filter("members > 1")
    kept = counted.groupBy("members", "total", "odd").agg(F.min(F.struct("band", "bucket")).alias("first")).select("first.bucket", "members")
    members = shared_checkpoint(hashed.drop("band").join(kept, "bucket"))

    wanted = shared_checkpoint(members.select("fp").distinct().join(classes, "fp").select("fp", "key", "docs", "bands"))
    keys = wanted.select("key").distinct()
    own = docs.select("text").withColumn("key", text_key())
    texts = own.join(F.broadcast(keys) if wanted.count() <= BROADCAST_ROWS else keys, "key", "left_semi").dropDuplicates(["key"])
    sets = sets_of(texts, n).join(wanted, "fp")

    shares = F.ceil(F.col("members") / block).cast("long")
    dealt = members.withColumn("of", shares).withColumn("own", F.pmod(F.xxhash64("fp", "bucket"), F.col("of")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("of") - 1)))
    side = F.when(F.col("own") < F.col("other"), 0).when(F.col("own") > F.col("other"), 1).otherwise(2)
    deal = F.least("own", "other") * F.col("of") + F.greatest("own", "other")
    tasks = max(1, members.count() // 1500)
    task = F.when(F.col("of") == 1, F.pmod(F.xxhash64("bucket"), F.lit(tasks))).otherwise(F.xxhash64("bucket", deal))
    dealt = dealt.select("fp", "bucket", deal.alias("deal"), side.alias("side"), task.alias("task"))
    return dealt.join(sets, "fp").groupBy("task").applyInPandas(verifier(bands, similarity), "fp binary, root binary, links long")


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL, n: int = WORDS, block: int = BLOCK) -> DataFrame:
    """doc_id, key (of the text), fp, group, class_id, copy_id, n_links: a row for each document."""
    bands, rows = plan_bands(similarity, recall)
    docs = docs.select("doc_id", "text")
    signed = shared_checkpoint(signatures(docs, bands, rows, n))
    classes = signed.filter("fp is not null").groupBy("fp").agg(F.min("doc_id").alias("copy_id"), F.min("key").alias("key"), F.count(F.lit(1)).alias("docs"), F.min("bands").alias("bands"))
    classes = shared_checkpoint(classes)
    found = shared_checkpoint(links_of(docs, classes, bands, similarity, n, block))
    joined = components(found.select(F.col("fp").alias("u"), F.col("root").alias("v")))
    linked = found.groupBy("fp").agg(F.sum("links").alias("links"))
    linked = linked.join(joined.withColumnRenamed("u", "fp"), "fp", "left").select("fp", "links", F.coalesce("v", "fp").alias("group"))
    linked = linked.join(classes.select("fp", "copy_id"), "fp")
    least = linked.groupBy("group").agg(F.min("copy_id").alias("class_id"))
    linked = linked.join(least, "group").select("fp", "links", "group", "class_id")
    told = classes.select("fp", "copy_id", "docs").join(linked, "fp", "left")
    told = told.select("fp", "copy_id", F.coalesce("class_id", "copy_id").alias("class_id"), F.coalesce("group", "fp").alias("group"), (F.col("docs") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    told = shared_checkpoint(told)  # so that the join below stands on two plain exchanges, which adaptive execution splits
    out = signed.select("doc_id", "key", "fp").join(told, "fp", "left")
    return out.select("doc_id", "key", "fp", "group", F.when(F.col("fp").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.when(F.col("fp").isNull(), F.col("doc_id")).otherwise(F.col("copy_id")).alias("copy_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def one_of_each(docs: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs``, all columns, less all but one of each group: the one of least doc_id. Texts without a
    shingle all stay."""
    told = shared_checkpoint(near_duplicates(docs, **settings).select("doc_id", "key", "group"))
    best = told.filter("group is not null").groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key")).alias("best"))
    best = best.select(F.col("best.doc_id").alias("keep_id"), F.col("best.key").alias("keep_key")).distinct()
    marked = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("own_id"), text_key().alias("own_key"), word_like().alias("whole"))
    stay = marked.filter("whole").join(best, F.col("own_id").eqNullSafe(F.col("keep_id")) & (F.col("own_key") == F.col("keep_key")))
    stay = stay.groupBy("own_id", "own_key").agg(F.first("row").alias("row")).select("row.*")  # of rows with the same id and text
    return stay.unionAll(marked.filter("not whole").select("row.*"))


def word_like() -> F.Column:
    """Whether a text has a word in the sense of ``common.word_spans``."""
    return F.coalesce(F.col("text").rlike(r"[0-9A-Za-z\u0080-\x{10FFFF}]"), F.lit(False))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "copy_id", "n_links")

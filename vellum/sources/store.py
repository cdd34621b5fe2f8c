"""A versioned store of chunks and their ledger, with an index of ids, and loads that resume.

A load writes its chunks (a folder for each bucket of ids), its ledger rows and the index of its ids into folders of its own
and then publishes them by one file of the commit log. Readers take the folders that the log names, so they see chunks and
ledger of one version; what a crashed load has written is named nowhere, and ``vacuum`` removes it. Versions are numbered, and
the file of a version is made by a rename that fails if it is there: of two loads that ran side by side one has to
begin again.

The index is a Bloom filter for each commit and bucket, as a table: the words of the filter that aren't 0. Whether ids may
be stored is a join of their bits with these words, so a load reads only the folders that it may hit, in full
parallel, and nothing of the store passes through the driver but the names of folders.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from vellum.functions.tables import free_name
from vellum.operators import batching

BUCKETS = 64
BITS_PER_ID = 16
HASHES = 6
LEDGER = "load string, batch long, model string, chunks long, tokens long"


@dataclass(frozen=True)
class Commit:
    """An entry of the log. ``bits``: the size of each bucket's filter."""

    version: int
    load: str
    folder: str
    buckets: list[int]
    bits: int


class Store:
    """The store in a folder. ``schema`` is that of the chunks; ``key`` their id."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, key: str = "id", buckets: int = BUCKETS):
        self.spark, self.path, self.schema, self.key, self.buckets = spark, path.rstrip("/"), schema, key, buckets
        self.jvm = spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()

    def hadoop_path(self, *parts: str):
        return self.jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))

    def files(self):
        return self.hadoop_path().getFileSystem(self.conf)

    def commits(self, version: int | None = None) -> list[Commit]:
        """The entries of the log up to a version, all of them by default."""
        log = self.hadoop_path("log")
        if not self.files().exists(log):
            return []
        rows = self.spark.read.schema("version long, load string, folder string, buckets array<int>, bits long").json(f"{self.path}/log").collect()  # a row for each commit
        return [Commit(**r.asDict()) for r in sorted(rows) if version is None or r["version"] <= version]

    def version(self) -> int:
        return max((c.version for c in self.commits()), default=-1)

    def read(self, folders: list[str], schema: StructType | str) -> DataFrame:
        return self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def chunks(self, version: int | None = None) -> DataFrame:
        return self.read([f"{self.path}/{c.folder}/chunks" for c in self.commits(version) if c.buckets], self.schema)

    def ledger(self, version: int | None = None) -> DataFrame:
        return self.read([f"{self.path}/{c.folder}/ledger" for c in self.commits(version)], LEDGER)

    def bucket(self) -> F.Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def bits_of(self, ids: DataFrame, sizes: list[int]) -> DataFrame:
        """bits (the filter's size), bucket, word, mask, place: a row for each bit that an id sets, for filters of each size."""
        bit = lambda k, size: F.pmod(F.xxhash64(F.lit(k), self.key), size)
        each = F.array(*(F.struct(F.lit(s).cast("long").alias("bits"), F.lit(k).alias("place"), bit(k, F.lit(s)).alias("at")) for s in sizes for k in range(HASHES)))
        found = ids.select(self.key, self.bucket().alias("bucket"), F.explode(each).alias("b"))
        return found.select(self.key, "bucket", "b.bits", "b.place", F.shiftright("b.at", 6).alias("word"), F.expr("shiftleft(1L, cast(b.at & 63 AS INT))").alias("mask"))

    def hits(self, ids: DataFrame) -> list[str]:
        """The folders that may hold some of the ids."""
        commits = [c for c in self.commits() if c.buckets]
        if not commits:
            return []
        by_load = self.spark.createDataFrame([(c.load, c.bits) for c in commits], "load string, bits long")
        index = self.read([f"{self.path}/{c.folder}/index" for c in commits], "load string, bucket int, word long, filter long").join(F.broadcast(by_load), "load")  # two values a commit
        asked = self.bits_of(ids.select(self.key).distinct(), sorted({c.bits for c in commits}))
        met = asked.join(index, ["bits", "bucket", "word"]).filter(F.col("filter").bitwiseAND(F.col("mask")) != 0)
        whole = met.groupBy("load", "bucket", self.key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == HASHES)
        folder = {c.load: c.folder for c in commits}
        return sorted(f"{self.path}/{folder[r['load']]}/chunks/bucket={r['bucket']}" for r in whole.select("load", "bucket").distinct().collect())  # names of folders

    def pending(self, chunks: DataFrame) -> DataFrame:
        """The chunks that the store doesn't have, after reading the folders that may have them; of equal keys the least row."""
        rest = [c for c in chunks.columns if c != self.key]
        first = chunks.filter(F.col(self.key).isNotNull()).groupBy(self.key).agg(F.min(F.struct(*rest)).alias("least")).select(self.key, "least.*") if rest else chunks.select(self.key).distinct()
        stored = self.read(self.hits(chunks), self.schema).select(self.key)
        return first.select(*chunks.columns).join(stored, self.key, "left_anti").select(*chunks.columns)

    def commit(self, chunks: DataFrame, ledger: DataFrame, load: str, expected: int | None = None) -> int:
        """Writes chunks and ledger and publishes them as the version after ``expected`` (the last one by default)."""
        expected = self.version() if expected is None else expected
        folder = f"data/{expected + 1:010d}-{uuid.uuid4().hex}"
        bucket = free_name(chunks, "bucket")
        if bucket != "bucket":
            raise ValueError("a column bucket stands in the chunks")
        chunks.select(*self.schema.names).withColumn("bucket", self.bucket()).repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/{folder}/chunks")
        written = self.spark.read.schema(StructType([*self.schema.fields]).add("bucket", IntegerType())).parquet(f"{self.path}/{folder}/chunks")
        counts = {r["bucket"]: r["n"] for r in written.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each bucket
        bits = 1 << max(6, (BITS_PER_ID * max(counts.values(), default=1) - 1).bit_length())
        index = self.bits_of(written, [bits]).groupBy("bucket", "word").agg(F.bit_or("mask").alias("filter"))
        index.select(F.lit(load).alias("load"), "bucket", "word", "filter").write.parquet(f"{self.path}/{folder}/index")
        ledger.select("load", "batch", "model", "chunks", "tokens").write.parquet(f"{self.path}/{folder}/ledger")
        self.publish(Commit(expected + 1, load, folder, sorted(counts), bits))
        return expected + 1

    def publish(self, c: Commit) -> None:
        """The one step that makes a load visible."""
        temporary, final = self.hadoop_path("tmp", uuid.uuid4().hex), self.hadoop_path("log", f"{c.version:010d}.json")
        self.files().mkdirs(final.getParent())
        out = self.files().create(temporary, True)
        out.write(bytearray(json.dumps(c.__dict__).encode()))
        out.close()
        none = self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0)
        self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(temporary.toUri() if temporary.toUri().getScheme() else self.files().getUri(), self.conf).rename(self.files().makeQualified(temporary), self.files().makeQualified(final), none)

    def vacuum(self) -> int:
        """Removes the folders that no version names; not to be run beside a load. How many there were."""
        data, named = self.hadoop_path("data"), {c.folder.split("/", 1)[1] for c in self.commits()}
        gone = [s.getPath() for s in self.files().listStatus(data) if s.getPath().getName() not in named] if self.files().exists(data) else []
        for p in gone:
            self.files().delete(p, True)
        return len(gone)


def load(chunks: DataFrame, store: Store, embed: Callable[[DataFrame], DataFrame], model: str, limit: int | None = None, per_commit: int = 64, tokens: str = "tokens", most_texts: int = batching.MOST_TEXTS, most_tokens: int = batching.MOST_TOKENS) -> list[int]:
    """Loads the chunks that the store doesn't have, in greedy batches, up to a budget of tokens; the versions it made.

    What is pending is written once with its batches, by commits of ``per_commit`` batches. Each commit takes its rows through ``embed``
    (which adds the store's columns and may add used_tokens, what the service counted) and publishes them with a ledger
    row for each batch. A load that dies in between has published whole commits only; called again, it goes on with what the
    store doesn't have, so every chunk is stored once and every stored chunk is in the ledger once. The service
    may be asked again for rows of a commit that wasn't published.
    """
    spark, version = store.spark, store.version()

    batched = batching.greedy_batches(store.pending(chunks), store.key, tokens, most_texts, most_tokens)
    if limit is not None:
        used = batching.tokens_used(store.ledger(), model).first()["tokens"]
        batched = batched.join(batching.within_budget(batching.batch_totals(batched, tokens), used, limit).select("batch"), "batch", "left_semi")
    name, plan = uuid.uuid4().hex, f"{store.path}/plans/{uuid.uuid4().hex}"
    batched.withColumn("_step", F.floor(F.col("batch") / per_commit).cast("int")).write.partitionBy("_step").parquet(plan)
    schema = StructType([*batched.schema.fields]).add("_step", IntegerType())
    planned = spark.read.schema(schema).parquet(plan)
    made = []
    for step in sorted(r["_step"] for r in planned.select("_step").distinct().collect()):  # a number for each commit
        done = embed(planned.filter(F.col("_step") == step).drop("_step"))
        folder = f"{plan}-{step}"
        done.write.parquet(folder)  # the service is asked once for what is stored and what is counted
        done = spark.read.schema(done.schema).parquet(folder)
        spent = F.sum("used_tokens" if "used_tokens" in done.columns else tokens)
        ledger = done.groupBy("batch").agg(F.count(F.lit(1)).alias("chunks"), F.coalesce(spent, F.lit(0)).cast("long").alias("tokens"))
        version = store.commit(done, ledger.select(F.lit(name).alias("load"), "batch", F.lit(model).alias("model"), "chunks", "tokens"), f"{name}-{step}", version)
        made.append(version)
    return made

"""The store: one version for chunks and ledger, crashes between the writes, loads that resume, the index of ids."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructType

from vellum.operators import batching
from vellum.sources.store import LEDGER, Store, load

SCHEMA = StructType().add("id", StringType()).add("text", StringType()).add("tokens", LongType()).add("vector", ArrayType(DoubleType()))


def texts(spark, ids):
    return spark.createDataFrame([(f"c{i:05d}", f"text {i}", 10 + i % 7) for i in ids], "id string, text string, tokens long")


def embed(df):
    return df.withColumn("vector", F.array(F.length("text").cast("double"))).withColumn("used_tokens", F.col("tokens") + 1)


def ledger(spark, rows):
    return spark.createDataFrame([("l", b, "m", n, t) for b, n, t in rows], LEDGER)


def test_versions(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), SCHEMA, buckets=4)
    assert store.version() == -1 and store.chunks().count() == 0 and store.ledger().count() == 0 and store.vacuum() == 0
    assert store.commit(embed(texts(spark, range(5))), ledger(spark, [(0, 5, 50)]), "a") == 0
    assert store.commit(embed(texts(spark, range(5, 8))), ledger(spark, [(1, 3, 30)]), "b") == 1
    assert store.chunks().count() == 8 and store.chunks(0).count() == 5 and store.chunks().columns == SCHEMA.names
    assert store.ledger(0).agg(F.sum("tokens")).first()[0] == 50 and store.ledger().agg(F.sum("tokens")).first()[0] == 80


@pytest.mark.parametrize("at", ["ledger", "publish"])
def test_a_crash_between_the_writes_leaves_neither(spark, tmp_path, monkeypatch, at):
    store = Store(spark, str(tmp_path / "s"), SCHEMA, buckets=4)
    store.commit(embed(texts(spark, range(5))), ledger(spark, [(0, 5, 50)]), "a")
    own = embed(texts(spark, range(5, 9)))
    with monkeypatch.context() as m:
        bad = ledger(spark, [(1, 4, 40)])
        if at == "ledger":
            bad = bad.withColumn("tokens", F.raise_error(F.lit("the ledger's disk is gone")).cast("long"))
        else:
            m.setattr(store, "publish", lambda c: (_ for _ in ()).throw(OSError("killed")))
        with pytest.raises(Exception):
            store.commit(own, bad, "b")
    again = Store(spark, str(tmp_path / "s"), SCHEMA, buckets=4)
    assert again.version() == 0 and again.chunks().count() == 5 and again.ledger().count() == 1
    assert again.pending(texts(spark, range(3, 9))).count() == 4
    assert again.commit(own, ledger(spark, [(1, 4, 40)]), "b") == 1 and again.chunks().count() == 9 and again.ledger().count() == 2
    assert again.vacuum() == 1 and again.chunks().count() == 9


def test_of_two_loads_at_once_one_fails(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), SCHEMA, buckets=4)
    store.commit(embed(texts(spark, [1])), ledger(spark, [(0, 1, 1)]), "a", expected=-1)
    with pytest.raises(Exception, match="(?i)exist"):
        store.commit(embed(texts(spark, [1])), ledger(spark, [(0, 1, 1)]), "b", expected=-1)
    assert store.chunks().count() == 1 and store.ledger().count() == 1


def test_only_folders_that_may_hit_are_read(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), SCHEMA, buckets=32)
    for v in range(4):
        store.commit(embed(texts(spark, range(1000 * v, 1000 * v + 600))), ledger(spark, [(v, 600, 1)]), f"l{v}")
    whole = len(store.chunks().inputFiles())
    assert whole == 4 * 32
    new = texts(spark, range(50_000, 50_040))
    assert len(store.hits(new)) <= 6  # false alarms
    old = texts(spark, [7, 8, 2005])
    hits = store.hits(old)
    assert 3 <= len(hits) <= 6 and len(store.read(hits, SCHEMA).inputFiles()) == len(hits)
    assert {r["id"] for r in store.pending(texts(spark, [7, 8, 2005, 9999])).collect()} == {"c09999"}
    every = texts(spark, range(0, 3600))
    assert store.pending(every).count() == 3600 - 2400  # no stored id is missed


def test_a_load_resumes(spark, tmp_path):
    chunks = texts(spark, range(200))
    store, dead = Store(spark, str(tmp_path / "s"), SCHEMA, buckets=4), []

    def dying(df):
        """A service that fails in the middle of the third commit."""
        if len(dead) == 2:
            df = df.withColumn("text", F.when(F.col("id") % 2 == 0, F.raise_error(F.lit("no answer"))).otherwise(F.col("text")))
        dead.append(1)
        return embed(df)

    settings = {"most_texts": 8, "most_tokens": 100, "per_commit": 3}
    with pytest.raises(Exception):
        load(chunks, store, dying, "m", **settings)
    assert store.version() == 1 and 0 < store.chunks().count() < 200
    assert store.chunks().agg(F.sum(F.col("tokens") + 1)).first()[0] == store.ledger().agg(F.sum("tokens")).first()[0]
    versions = load(chunks.unionAll(chunks), store, embed, "m", **settings)
    assert versions == list(range(2, 2 + len(versions))) and len(versions) > 3
    rows = sorted((r["id"], r["text"], r["tokens"]) for r in store.chunks().collect())
    assert rows == sorted(tuple(r) for r in chunks.collect())
    assert store.ledger().agg(F.sum("chunks"), F.sum("tokens")).first()[:] == (200, sum(t + 1 for *_, t in rows))
    assert load(chunks, store, embed, "m", **settings) == []


def test_a_load_keeps_to_its_budget(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), SCHEMA, buckets=4)
    chunks, caps = texts(spark, range(60)), {"most_texts": 8, "most_tokens": 100}
    load(chunks, store, embed, "m", limit=400, per_commit=2, **caps)
    want = batching.greedy_batches(chunks, **caps)
    fits = batching.within_budget(batching.batch_totals(want), 0, 400)
    assert store.chunks().count() == want.join(fits, "batch", "left_semi").count() < 60
    used = store.ledger().agg(F.sum("tokens")).first()[0]
    assert load(chunks, store, embed, "m", limit=used, **caps) == []
    load(chunks, store, embed, "m", **caps)
    assert store.chunks().count() == 60

"""Batches and numbers in a global order, for tables whose ranges aren't the same at each evaluation."""

import random
from contextlib import contextmanager

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellum.operators import batching as B
from vellum.operators import inventory as I


@contextmanager
def settings(spark, **kw):
    """Settings of Spark SQL, those of a fresh session unless stated."""
    own = {"spark.sql.adaptive.enabled": "true", "spark.sql.shuffle.partitions": "200", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64m"} | {k.replace("_", "."): v for k, v in kw.items()}
    before = {k: spark.conf.get(k, None) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def fold(tokens, most_texts, most_tokens):
    batch, texts, used, out = 0, 0, 0, []
    for t in tokens:
        if texts and (texts >= most_texts or used + t > most_tokens):
            batch, texts, used = batch + 1, 0, 0
        texts, used = texts + 1, used + t
        out.append(batch)
    return out


def sized(spark, rows):
    return spark.range(rows).select("id", (1 + F.pmod(F.xxhash64("id"), F.lit(60))).alias("tokens"))


def batches_of(df, most_texts, most_tokens):
    rows = B.greedy_batches(df, most_texts=most_texts, most_tokens=most_tokens).select("id", "tokens", "batch").toArrow().sort_by("id")
    assert fold(rows.column("tokens").to_pylist(), most_texts, most_tokens) == rows.column("batch").to_pylist()
    return rows.num_rows


def test_wide_rows(spark):
    with settings(spark):
        wide = sized(spark, 60_000).withColumn("payload", F.repeat(F.sha2(F.col("id").cast("string"), 512), 32))
        assert batches_of(wide, 12, 300) == 60_000
        numbers = I.numbered(wide, "id").select("id", "ord").toArrow().sort_by("id")
        assert numbers.column("ord").to_pylist() == list(range(60_000))


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_many_narrow_rows(spark, adaptive):
    with settings(spark, spark_sql_adaptive_enabled=adaptive, spark_sql_shuffle_partitions="20"):
        assert batches_of(sized(spark, 1_000_000), 12, 300) == 1_000_000
        numbers = I.numbered(spark.range(1_000_000).select(F.reverse(F.col("id").cast("string")).alias("k")), "k").select("ord").toArrow().column("ord").to_numpy()
        assert (np.sort(numbers) == np.arange(1_000_000)).all()


def test_twice_on_one_table_with_clashing_names(spark):
    items = spark.createDataFrame([(i, i % 7, "x", "y", 1.5) for i in range(500)], "id int, tokens int, _part string, _n string, batch double")
    first, again = B.greedy_batches(items, most_texts=5, most_tokens=20), B.greedy_batches(items, most_texts=5, most_tokens=20)
    assert items.columns == ["id", "tokens", "_part", "_n", "batch"] and first.columns == ["id", "tokens", "_part", "_n", "batch"]
    assert sorted(map(tuple, first.collect())) == sorted(map(tuple, again.collect()))
    assert [r["batch"] for r in first.orderBy("id").collect()] == fold([i % 7 for i in range(500)], 5, 20)
    assert {(r["_part"], r["_n"]) for r in first.collect()} == {("x", "y")}


def test_null_sizes_and_empty_tables(spark):
    df = spark.createDataFrame([(1, None), (2, 400), (3, None), (4, 0)], "id int, tokens int")
    assert [r["batch"] for r in B.greedy_batches(df, most_texts=3, most_tokens=100).orderBy("id").collect()] == [0, 1, 2, 2]
    assert B.greedy_batches(df.limit(0)).collect() == [] and B.greedy_batches(df.limit(0)).columns == ["id", "tokens", "batch"]
    assert I.numbered(df.limit(0), "id").collect() == []


def test_filling_in_pieces():
    rng = random.Random(2)
    for _ in range(300):
        tokens = [rng.choice([0, 1, 5, 20, 90, 250]) for _ in range(rng.randint(0, 60))]
        most_texts, most_tokens = rng.randint(1, 9), rng.choice([10, 100, 10**9])
        filling, got, at = B.Filling(0, 0, most_texts, most_tokens), [], 0
        while at < len(tokens):
            n = rng.randint(1, 7)
            got += filling.take(np.array(tokens[at : at + n])).tolist()
            at += n
        assert got == fold(tokens, most_texts, most_tokens)


def test_budget_over_blocks(spark):
    rng = random.Random(3)
    totals = [(b, rng.randint(0, 50)) for b in range(1000)]
    df = spark.createDataFrame(rng.sample(totals, len(totals)), "batch long, tokens long").withColumn("_block", F.lit("clash"))
    for limit in (0, 30, 5000, 10**6):
        spent, want = 7, []
        for b, t in totals:
            if spent + int(t * B.MARGIN) > limit:
                break
            want.append(b)
            spent += t
        for block in (1, 16, 4096):
            assert sorted(r["batch"] for r in B.within_budget(df, 7, limit, block=block).collect()) == want

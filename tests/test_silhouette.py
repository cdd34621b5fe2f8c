"""Silhouettes against a plain computation, with copies, clusters of one and missing vectors; cells searched as a table."""

import numpy as np
from pyspark.sql import functions as F

from vellum.operators import clustering as K
from vellum.operators import vectors as V


def plain(rows):
    """What each point's definition says; 0 for a cluster of one."""
    out = {}
    for key, c, x in rows:
        if c is None or x is None:
            out[key] = 0.0
            continue
        mean = {}
        for k2, c2, y in rows:
            if k2 != key and c2 is not None and y is not None:
                mean.setdefault(c2, []).append(float(np.sqrt(((np.array(x, float) - np.array(y, float)) ** 2).sum())))
        a, b = np.mean(mean[c]) if c in mean else None, min((np.mean(v) for k, v in mean.items() if k != c), default=None)
        out[key] = 0.0 if a is None or b is None or max(a, b) == 0 else (b - a) / max(a, b)
    return out


def test_silhouette_blocks(spark):
    r = np.random.default_rng(3)
    rows = [(i, int(i % 3) * 7, [float(x) for x in r.normal(i % 3, 1, 5)]) for i in range(60)]
    rows += [(100 + i, 14, rows[2][2]) for i in range(20)] + [(200, 5, [9.0] * 5), (201, 0, None), (202, None, [1.0] * 5)]
    rows += [(300 + i, 0, [1e4 + 1e-6 * i] * 5) for i in range(5)]
    df = spark.createDataFrame(rows, "vec_id long, label long, embedding array<double>")
    for block in (1 << 24, 1000):
        got = {x["vec_id"]: x["silhouette"] for x in K.silhouette(df, "label", block=block).collect()}
        wanted = plain(rows)
        assert got.keys() == wanted.keys() and all(abs(got[k] - wanted[k]) < 1e-9 for k in wanted)
    same = spark.createDataFrame([(i, i % 2, [0.1, 0.2, 0.7]) for i in range(9)], "vec_id long, label long, embedding array<float>")
    assert {x["silhouette"] for x in K.silhouette(same, "label").collect()} == {0.0}
    assert K.silhouette(df.limit(0), "label").count() == 0


def test_blocks_meet_in_arrow(spark):
    """Two blocks meet in a cogroup; no group in Pandas is left."""
    df = spark.createDataFrame([(i, i % 2, [float(i), 1.0]) for i in range(200)], "vec_id long, label long, embedding array<double>")
    plan = K.silhouette(df, "label", block=4800)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "FlatMapGroupsInPandas" not in plan


def test_cells_as_a_table(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    indexed, centres = V.ivf_cells(df, 8)
    questions = df.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("question_id"), F.col("embedding").alias("question"))
    wanted = {(x["question_id"], x["vec_id"], x["rank"]) for x in V.ivf_topk_batch(indexed, centres, questions).collect()}
    for size in (8 << 20, 20_000):
        found = V.ivf_topk_table(indexed, centres, questions, size=size)
        assert {(x["question_id"], x["vec_id"], x["rank"]) for x in found.collect()} == wanted
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().optimizedPlan().toString()

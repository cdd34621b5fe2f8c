"""Queries over the embeddings table: neighbours, clusters, a small network."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions.tables import shared_folder
from vellum.operators import clustering as K
from vellum.operators import graph_index as G
from vellum.operators import mlp
from vellum.operators import vectors as V


def table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def first_vector(df: DataFrame) -> list[float]:
    row = df.filter("vec_id = 0").select("embedding").first()
    return row[0] if row else []


def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir)
    return V.cosine_topk(df, first_vector(df))


def cosine_topk_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir)
    questions = df.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("question_id"), F.col("embedding").alias("question"))
    return V.cosine_topk_table(df, questions)


def ivf_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir)
    indexed, centres = V.ivf_cells(df, 8)
    questions = df.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("question_id"), F.col("embedding").alias("question"))
    return V.ivf_topk_table(indexed, centres, questions)


def nsw_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored graph index of the whole table, read back and asked every vec_id % 100 = 0."""
    df = table(spark, sf_dir)
    width, path = len(first_vector(df)) or 1, f"{shared_folder(spark, 'indexes')}/nsw-{uuid.uuid4().hex}"
    G.write(G.build(df, width), path)
    questions = df.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("question_id"), F.col("embedding").alias("question"))
    return G.search(G.read(spark, path), questions, width).select("question_id", F.col("key").alias("vec_id"), "similarity", "rank")


def centres(spark: SparkSession, sf_dir: str) -> list[list[float]]:
    """Means of the labels, in their order: fixed centres for the queries below."""
    df = table(spark, sf_dir)
    rows = K.means(df, "label", len(first_vector(df))).orderBy("label").collect()  # a row for each label
    return [[round(x, 9) for x in r["centre"]] for r in rows]


def lloyd_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    assigned = K.assign(table(spark, sf_dir), centres(spark, sf_dir))
    out = assigned.groupBy("cluster").agg(F.count(F.lit(1)).alias("points"), F.round(F.avg(F.col("embedding")[0].cast("double")), 6).alias("x0"), F.round(F.avg(F.col("embedding")[1].cast("double")), 6).alias("x1"))
    return out.select(F.col("cluster").cast("long").alias("cluster"), "points", "x0", "x1")


def elkan_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster, component, value: all components of the centres after three steps from the labels' means."""
    start = centres(spark, sf_dir)
    found, _ = K.elkan(table(spark, sf_dir), start, ELKAN_STEPS) if start else ([], [])
    return spark.createDataFrame([(c, k, round(x, 6)) for c, row in enumerate(found) for k, x in enumerate(row)], "cluster long, component long, value double")


def inertia(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.inertia(table(spark, sf_dir), centres(spark, sf_dir))


def silhouette(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.silhouette(table(spark, sf_dir), "label").select("vec_id", "label", F.round("silhouette", 6).alias("silhouette"))


def voronoi(spark: SparkSession, sf_dir: str) -> DataFrame:
    plane = [c[:2] for c in centres(spark, sf_dir)]
    return K.voronoi(spark, plane, -0.5, 0.5, 21).select("x", "y", F.col("cluster").cast("long").alias("cluster"))


def one_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir).select("vec_id", F.array_join(F.transform(mlp.one_hot(F.col("label"), 8), lambda x: x.cast("string")), "").alias("hot"))


LAYERS = [([[0.5, -0.25, 1.0, 0.75], [-1.0, 0.5, 0.25, -0.5], [0.125, 0.25, -0.75, 1.0]], [0.1, -0.2, 0.3]), ([[1.0, -0.5, 0.25], [-0.25, 0.75, 0.5], [0.5, 0.5, -1.0]], [0.0, 0.1, -0.1])]


def mlp_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    inputs = F.slice(V.as_double(F.col("embedding")), 1, 4)
    out = table(spark, sf_dir).select("vec_id", "label", mlp.forward(inputs, LAYERS).alias("o"))
    error = mlp.squared_error(F.col("o"), F.transform(mlp.one_hot(F.col("label") % 3, 3), lambda x: x.cast("double")))
    return out.select("vec_id", *(F.round(F.col("o")[k], 6).alias(f"o{k}") for k in range(3)), F.round(error, 6).alias("error"))


def mlp_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir).select(F.col("vec_id").alias("id"), F.slice(V.as_double(F.col("embedding")), 1, 4).alias("inputs"), F.transform(mlp.one_hot(F.col("label") % 3, 3), lambda x: x.cast("double")).alias("wanted"))
    return mlp.train(rows)


def mlp_gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Epoch and error of a network that learns the label from all components, by four gradients an epoch."""
    df = table(spark, sf_dir)
    rows = df.select(F.col("vec_id").alias("id"), V.as_double(F.col("embedding")).alias("inputs"), F.transform(mlp.one_hot(F.col("label"), 8), lambda x: x.cast("double")).alias("wanted"))
    _, errors = mlp.descend(rows, (len(first_vector(df)) or 1, 16, 8), rate=8.0, epochs=20, batches=4)
    return spark.createDataFrame([(n, round(e, 6)) for n, e in enumerate(errors)], "epoch int, error double")


def kmeans_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    fitted = K.kmeans(table(spark, sf_dir), 5)
    return K.assign(table(spark, sf_dir), [list(map(float, c)) for c in fitted.clusterCenters()]).select("vec_id", "cluster")


def blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.blobs(spark, 2000, [[0.2, 2.3], [-1.5, 2.3], [-2.8, 1.8], [-2.8, 2.8], [-2.8, 1.3]], [0.4, 0.3, 0.1, 0.1, 0.1])


QUERIES = {f.__name__: f for f in (cosine_topk, cosine_topk_batch, ivf_topk, nsw_topk, lloyd_step, elkan_steps, inertia, silhouette, voronoi, one_hot, mlp_forward, mlp_train, mlp_gradient, kmeans_fit, blobs)}
CENTRES = """parts AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS k FROM embeddings),
    means AS (SELECT label, k, round(avg(x), 9) AS m FROM parts GROUP BY label, k), numbered AS (SELECT label, k, m, dense_rank() OVER (ORDER BY label) - 1 AS cluster FROM means),
    dist AS (SELECT vec_id, cluster, sum((x - m) * (x - m)) AS d FROM parts JOIN numbered USING (k) GROUP BY vec_id, cluster),
    near AS (SELECT vec_id, cluster, d FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, cluster) AS n FROM dist) WHERE n = 1)"""


ELKAN_STEPS = 3


def lloyd_sql(steps: int) -> str:
    """Centres m0 to m{steps}, each the means of the vectors nearest to the ones before; a centre without vectors stays."""
    parts = ["m0 AS (SELECT cluster, k, m FROM numbered)"]
    for n in range(steps):
        parts.append(f"d{n} AS (SELECT vec_id, cluster, sum((x - m) * (x - m)) AS d FROM parts JOIN m{n} USING (k) GROUP BY vec_id, cluster)")
        parts.append(f"n{n} AS (SELECT vec_id, cluster FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, cluster) AS n FROM d{n}) WHERE n = 1)")
        parts.append(f"m{n + 1} AS (SELECT cluster, k, coalesce(a.m, b.m) AS m FROM m{n} b LEFT JOIN (SELECT cluster, k, avg(x) AS m FROM n{n} JOIN parts USING (vec_id) GROUP BY cluster, k) a USING (cluster, k))")
    return ", ".join(parts)


def unit(weights: list[float], bias: float, names: list[str]) -> str:
    return "1 / (1 + exp(-(" + " + ".join([str(bias), *(f"({w}) * {n}" for w, n in zip(weights, names))]) + ")))"


HIDDEN = ", ".join(f"{unit(w, b, [f'embedding[{k + 1}]::DOUBLE' for k in range(4)])} AS h{i}" for i, (w, b) in enumerate(zip(*LAYERS[0])))
OUT = ", ".join(f"{unit(w, b, ['h0', 'h1', 'h2'])} AS p{i}" for i, (w, b) in enumerate(zip(*LAYERS[1])))
ORACLES = {
    "cosine_topk": """
        SELECT vec_id, similarity FROM (
            SELECT e.vec_id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS similarity
            FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q)
        ORDER BY similarity DESC, vec_id LIMIT 8""",
    "cosine_topk_batch": """WITH scored AS (SELECT q.vec_id AS question_id, e.vec_id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS similarity
        FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id % 100 = 0) q)
        SELECT question_id, vec_id, similarity, n AS rank FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY similarity DESC, vec_id) AS n FROM scored WHERE similarity IS NOT NULL) WHERE n <= 8""",
    "lloyd_step": f"""WITH {CENTRES} SELECT cluster, count(*) AS points, round(avg(embedding[1]::DOUBLE), 6) AS x0, round(avg(embedding[2]::DOUBLE), 6) AS x1 FROM near JOIN embeddings USING (vec_id) GROUP BY cluster""",
    "elkan_steps": f"WITH {CENTRES}, {lloyd_sql(ELKAN_STEPS)} SELECT cluster, k - 1 AS component, round(m, 6) AS value FROM m{ELKAN_STEPS}",
    "inertia": f"WITH {CENTRES} SELECT round(sum(d), 6) AS inertia, round(-sum(d), 6) AS score FROM near",
    "silhouette": """WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings), pairs AS (SELECT a.vec_id, a.label, b.label AS other, list_distance(a.e, b.e) AS d FROM v a, v b WHERE a.vec_id <> b.vec_id),
        m AS (SELECT vec_id, label, other, avg(d) AS d FROM pairs GROUP BY vec_id, label, other), ab AS (SELECT vec_id, label, max(CASE WHEN label = other THEN d END) AS a, min(CASE WHEN label <> other THEN d END) AS b FROM m GROUP BY vec_id, label)
        SELECT vec_id, label, round(coalesce((b - a) / greatest(a, b), 0), 6) AS silhouette FROM ab""",
    "voronoi": f"""WITH {CENTRES}, axis AS (SELECT round(-0.5 + i * (1.0::DOUBLE / 20), 9) AS v FROM range(21) t(i)), plane AS (SELECT cluster, max(CASE WHEN k = 1 THEN m END) AS cx, max(CASE WHEN k = 2 THEN m END) AS cy FROM numbered GROUP BY cluster),
        d AS (SELECT a.v AS x, b.v AS y, cluster, row_number() OVER (PARTITION BY a.v, b.v ORDER BY (a.v - cx) * (a.v - cx) + (b.v - cy) * (b.v - cy), cluster) AS n FROM axis a, axis b, plane) SELECT x, y, cluster FROM d WHERE n = 1""",
    "one_hot": "SELECT vec_id, array_to_string(list_transform(range(8), lambda i: CASE WHEN i = label THEN 1 ELSE 0 END), '') AS hot FROM embeddings",
    "mlp_forward": f"""WITH h AS (SELECT vec_id, label, {HIDDEN} FROM embeddings), o AS (SELECT vec_id, label, {OUT} FROM h)
        SELECT vec_id, round(p0, 6) AS o0, round(p1, 6) AS o1, round(p2, 6) AS o2, round({" + ".join(f"(p{k} - CASE WHEN label % 3 = {k} THEN 1 ELSE 0 END) ** 2" for k in range(3))}, 6) AS error FROM o""",
}

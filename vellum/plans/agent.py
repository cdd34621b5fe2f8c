"""Queries of the agent, of graph searches and of event windows. Cited texts and fragments are made of conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions.tables import shared_checkpoint, spread
from vellum.operators import agent as A
from vellum.operators import graphs as G
from vellum.operators import vectors as V


LEAST = 0.45  # similarity of a fragment that the stand-in for the model takes


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/conversations.parquet")


def last_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.last_turns(messages(spark, sf_dir), most=3).select("conv_id", "turn", "role")


def thread_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = A.history(messages(spark, sf_dir))
    return out.select("conv_id", F.size("history").cast("long").alias("messages"), F.array_join(F.transform("history", lambda m: F.concat(m["role"], F.lit(":"), F.length(m["content"]).cast("string"))), ",").alias("history"))


def valid_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("conv-"), F.lpad(F.col("conv_id").cast("string"), 4, "0"), F.when(F.col("turn") == 1, "_x").otherwise(""))
    return messages(spark, sf_dir).select("conv_id", "turn", F.coalesce(A.valid_request(F.col("text"), name), F.lit(False)).alias("valid"))


def cited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, turn, total, answer: citations from the numbers of the turn, one of them too large for an int."""
    t = F.col("turn")
    n = lambda c: F.concat(F.lit("["), c.cast("string"), F.lit("]"))
    text = F.when(t % 3 == 2, "sin citas").otherwise(F.concat(F.lit("Uno "), n(t % 5 + 1), F.lit(", dos "), n(t % 2), F.lit(" y "), n(t % 5 + 1), n(F.lit(99999999999)), F.lit(" tres "), n((t + F.col("conv_id")) % 4 + 1)))
    return messages(spark, sf_dir).groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("_")).select("conv_id", "turn", (F.col("conv_id") % 4 + 1).cast("int").alias("total"), text.alias("answer"))


CITED = """cited AS (SELECT DISTINCT conv_id, turn, conv_id % 4 + 1 AS total, CASE WHEN turn % 3 = 2 THEN 'sin citas' ELSE 'Uno [' || (turn % 5 + 1) || '], dos [' || (turn % 2) || '] y [' || (turn % 5 + 1) || '][99999999999] tres [' ||
    ((turn + conv_id) % 4 + 1) || ']' END AS answer FROM conversations),
    found AS (SELECT conv_id, turn, total, n, min(k) AS k FROM (SELECT conv_id, turn, total, unnest(regexp_extract_all(answer, '\\[(\\d+)\\]', 1))::BIGINT AS n, generate_subscripts(regexp_extract_all(answer, '\\[(\\d+)\\]', 1), 1) AS k FROM cited)
        WHERE n BETWEEN 1 AND total GROUP BY conv_id, turn, total, n)"""


def eval_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cited(spark, sf_dir).select("conv_id", "turn", F.array_join(F.transform(A.citations(F.col("answer"), F.col("total")), lambda n: n.cast("string")), ",").alias("picked"))


def answer_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    relevant = F.sequence(F.lit(1), F.col("total"))
    return cited(spark, sf_dir).select("conv_id", "turn", F.array_join(F.transform(A.sources(F.col("answer"), relevant), lambda n: n.cast("string")), ",").alias("sources"))


def fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    f = F.struct(F.col("doc_id").alias("id"), A.citation(F.concat(F.lit("Libro "), "source"), (F.col("doc_id") % 50 + 1).cast("int"), (F.col("doc_id") % 50 + 1 + F.col("doc_id") % 2).cast("int")).alias("cite"), F.array("source").alias("path"), F.array().cast("array<string>").alias("dubious_units"), F.substring("text", 1, A.FRAGMENT_CHARS).alias("text"))
    return A.embed(docs.select("doc_id", f.alias("fragment"), "text"), "text", A.hashed_embedding()).select("doc_id", "fragment", "embedding")


def ask(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A whole run with offline stand-ins for the ports: the texts of all benchmark items. The library is embedded and
    written once, as ids and vectors; fragments are read for what was found."""
    questions = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("question_id"), F.col("text").alias("question"))
    library = fragments(spark, sf_dir)
    vectors = shared_checkpoint(library.select("doc_id", "embedding"))

    def reformulate(df: DataFrame) -> DataFrame:
        return df.withColumn("query", F.when(F.size("tried") == 0, F.substring_index("question", ".", 1)).otherwise(F.col("question")))

    def search(df: DataFrame) -> DataFrame:
        asked = shared_checkpoint(A.embed(df, "query", A.hashed_embedding(), "question_vector"))
        scored = V.cosine_topk_table(vectors, asked.select("question_id", F.col("question_vector").alias("question")), A.K, "doc_id")
        own = scored.join(library.select("doc_id", "fragment"), "doc_id").groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("rank", "similarity", "fragment"))).alias("hits"))
        return asked.join(own, "question_id", "left").withColumn("fragments", F.coalesce(F.transform("hits", lambda h: h["fragment"]), F.array()))

    def evaluate(df: DataFrame) -> DataFrame:
        good = F.transform(F.filter("hits", lambda h: h["similarity"] >= LEAST), lambda h: h["rank"].cast("int"))
        return df.withColumn("picked", F.coalesce(good, F.array().cast("array<int>"))).drop("hits")

    def write(df: DataFrame) -> DataFrame:
        return df.withColumn("answer", F.concat(F.lit("Según la biblioteca [1]: "), F.substring("question", 1, 40)))

    return A.answer_questions(questions, reformulate, search, evaluate, write)


def agent_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ask(spark, sf_dir)[0].select("question_id", "found", "answer", F.array_join(F.transform("sources", lambda n: n.cast("string")), ",").alias("sources"), F.size("relevant").alias("relevant"))


def agent_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ask(spark, sf_dir)[1]


def sse_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages(spark, sf_dir).select("conv_id", "turn", A.event(F.lit("paso"), F.struct(F.col("role").alias("nodo"), F.length("text").alias("fragmentos"))).alias("event"))


# A road map, and straight-line distances to one of its towns.
ROADS = [
    ("Arad", "Zerind", 75), ("Arad", "Sibiu", 140), ("Arad", "Timisoara", 118), ("Zerind", "Oradea", 71), ("Oradea", "Sibiu", 151), ("Timisoara", "Lugoj", 111), ("Lugoj", "Mehadia", 70),
    ("Mehadia", "Drobeta", 75), ("Drobeta", "Craiova", 120), ("Craiova", "Rimnicu Vilcea", 146), ("Craiova", "Pitesti", 138), ("Sibiu", "Rimnicu Vilcea", 80), ("Sibiu", "Fagaras", 99),
    ("Rimnicu Vilcea", "Pitesti", 97), ("Fagaras", "Bucharest", 211), ("Pitesti", "Bucharest", 101), ("Bucharest", "Giurgiu", 90), ("Bucharest", "Urziceni", 85), ("Urziceni", "Hirsova", 98),
    ("Hirsova", "Eforie", 86), ("Urziceni", "Vaslui", 142), ("Vaslui", "Iasi", 92), ("Iasi", "Neamt", 87),
]
TO_PITESTI = {"Timisoara": 230, "Arad": 260, "Sibiu": 144, "Rimnicu Vilcea": 97, "Pitesti": 0, "Lugoj": 155, "Mehadia": 155, "Drobeta": 170, "Craiova": 104}


def searched(spark: SparkSession, by_hops: bool) -> DataFrame:
    edges = spark.createDataFrame(ROADS, "src string, dst string, w int")
    out = G.best_paths(edges, "Zerind", by_hops)
    return out.select("node", F.col("hops").cast("long").alias("hops"), "cost", F.array_join("path", " > ").alias("path"))


def bfs_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return searched(spark, True)


def ucs_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return searched(spark, False)


def informed_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(name, *found) for name, greedy in (("greedy", True), ("a_star", False)) if (found := G.informed(ROADS, TO_PITESTI, "Timisoara", "Pitesti", greedy))]
    return spark.createDataFrame(rows, "search string, path array<string>, cost int").withColumn("path", F.array_join("path", " > "))


def rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users with five errors or more in ten minutes, by windows that slide by five."""
    from vellum.streaming.limits import failures

    return failures(spark.read.parquet(f"{sf_dir}/events.parquet"), least=2, size="10 minutes", slide="5 minutes")


QUERIES = {f.__name__: f for f in (last_turns, thread_history, valid_requests, eval_filter, answer_sources, agent_loop, agent_events, sse_events, bfs_path, ucs_path, informed_paths, rate_limit)}
EDGES = "edges(a, b, w) AS (VALUES " + ", ".join(f"('{a}', '{b}', {w})" for a, b, w in ROADS) + "), both_ways AS (SELECT a, b, w FROM edges UNION ALL SELECT b, a, w FROM edges)"
WALK = f"""WITH RECURSIVE {EDGES}, walks(node, hops, cost, path) AS (SELECT 'Zerind', 0::BIGINT, 0::BIGINT, ['Zerind'] UNION ALL
    SELECT b, hops + 1, cost + w, list_append(path, b) FROM walks JOIN both_ways ON a = node WHERE NOT list_contains(path, b))
    SELECT node, hops, cost, array_to_string(path, ' > ') AS path FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY {{}}, path) AS n FROM walks) WHERE n = 1"""
ORACLES = {
    "last_turns": "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 3",
    "thread_history": """SELECT conv_id, count(*) AS messages, string_agg(role || ':' || length(text), ',' ORDER BY turn) AS history FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 6 GROUP BY conv_id""",
    "valid_requests": "SELECT conv_id, turn, length(text) BETWEEN 1 AND 2000 AND regexp_full_match('conv-' || lpad(conv_id::VARCHAR, 4, '0') || CASE WHEN turn = 1 THEN '_x' ELSE '' END, '[A-Za-z0-9-]{8,64}') AS valid FROM conversations",
    "eval_filter": f"WITH {CITED} SELECT c.conv_id, c.turn, coalesce(string_agg(n::VARCHAR, ',' ORDER BY k), '') AS picked FROM cited c LEFT JOIN found f USING (conv_id, turn) GROUP BY c.conv_id, c.turn",
    "answer_sources": f"WITH {CITED} SELECT c.conv_id, c.turn, coalesce(string_agg(n::VARCHAR, ',' ORDER BY n), array_to_string(range(1, any_value(c.total) + 1), ',')) AS sources FROM cited c LEFT JOIN found f USING (conv_id, turn) GROUP BY c.conv_id, c.turn",
    "sse_events": """SELECT conv_id, turn, 'event: paso' || chr(10) || 'data: {"nodo":"' || role || '","fragmentos":' || length(text) || '}' || chr(10) || chr(10) AS event FROM conversations""",
    "bfs_path": WALK.format("hops, cost"),
    "ucs_path": WALK.format("cost, hops"),
    "informed_paths": """SELECT * FROM (VALUES ('greedy', 'Timisoara > Lugoj > Mehadia > Drobeta > Craiova > Pitesti', 514), ('a_star', 'Timisoara > Arad > Sibiu > Rimnicu Vilcea > Pitesti', 435)) t(search, path, cost)""",
    "rate_limit": """WITH starts AS (SELECT user_id, unnest([time_bucket(INTERVAL 5 MINUTE, ts), time_bucket(INTERVAL 5 MINUTE, ts) - INTERVAL 5 MINUTE]) AS window_start FROM events WHERE event_type = 'error')
        SELECT user_id, window_start, count(*) AS failures FROM starts GROUP BY user_id, window_start HAVING count(*) >= 2""",
}

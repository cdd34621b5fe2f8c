"""Whole runs of the agent over the tables against a plain loop over questions."""

import json
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from vellum.operators import agent as A
from vellum.plans import agent as P

WIDTH = 64


def vector(text):
    v = np.zeros(WIDTH)
    for word in (text or "").lower().split():
        h = zlib.crc32(word.encode())
        v[h % WIDTH] += 1 if h & 0x10000 else -1
    return v


def cosines(x, q):
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.round(x @ q / (np.linalg.norm(x, axis=1) * np.linalg.norm(q)), 6)


@pytest.fixture(scope="module")
def plain(sf_dir):
    """(answers, events) by one question after another."""
    docs = sorted((r["doc_id"], r["text"]) for r in pq.read_table(f"{sf_dir}/documents.parquet", columns=["doc_id", "text"]).to_pylist())
    ids, x = [d for d, _ in docs], np.stack([vector(t) for _, t in docs])
    answers, events = {}, []
    for item in pq.read_table(f"{sf_dir}/benchmark.parquet").to_pylist():
        name, question, seq = item["item_id"], item["text"], 0
        for n in range(2):
            query = question if n else question.split(".")[0]
            sims = cosines(x, vector(query))
            hits = sorted((-s, d) for s, d in zip(sims, ids) if not np.isnan(s))[:8]
            good = [d for s, d in hits if -s >= 0.45]
            events += [(name, seq, "paso", {"nodo": "reformular", "consulta": query}), (name, seq + 1, "paso", {"nodo": "buscar", "fragmentos": len(hits)}), (name, seq + 2, "paso", {"nodo": "evaluar", "relevantes": len(good)})]
            seq += 3
            if good:
                break
        text = f"Según la biblioteca [1]: {question[:40]}" if good else A.NO_INFORMATION
        cited = [1] if good else []
        answers[name] = (bool(good), text, ",".join(map(str, cited)), len(good))
        events.append((name, 6, "respuesta", {"texto": text, "encontro_informacion": bool(good), "advertencias": [], "fuentes": cited}))
    return answers, events


def test_answers(spark, sf_dir, plain):
    found = P.agent_loop(spark, sf_dir).collect()
    assert len(found) == len(plain[0]) and {r["question_id"]: (r["found"], r["answer"], r["sources"], r["relevant"]) for r in found} == plain[0]
    assert len({r["found"] for r in found}) == 2, "both outcomes are in the tables"


def test_events(spark, sf_dir, plain):
    key = lambda e: (e[0], e[1])
    found = [(r["question_id"], r["seq"], r["kind"], json.loads(r["data"])) for r in P.agent_events(spark, sf_dir).collect()]
    assert sorted(found, key=key) == sorted(plain[1], key=key)


def test_ports_run_once_a_question(spark):
    """Each pass calls the ports for the questions that are open, however often its result is read; warnings name dubious units."""
    calls = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def model(q):
        calls.add(1)
        return f"consulta {q}"

    piece = F.struct(F.lit("Libro, pág. 2").alias("cite"), F.array(F.lit("5 rng")).alias("dubious_units"))
    search = lambda df: df.withColumn("fragments", F.array(piece))
    pick = lambda df: df.withColumn("picked", F.when((F.col("question") == "a") | (F.size("tried") > 0) & (F.col("question") == "b"), F.array(F.lit(1), F.lit(7))).otherwise(F.array().cast("array<int>")))
    questions = spark.createDataFrame([(0, "a"), (1, "b"), (2, None)], "question_id long, question string")
    answers, events = A.answer_questions(questions, lambda df: df.withColumn("query", model("question")), search, pick, lambda df: df.withColumn("answer", F.lit("sin cita")))
    rows = {r["question_id"]: r for r in answers.collect()}
    assert len(events.collect()) == 3 * 3 + 2 * 3 + 3 and calls.value == 3 + 2
    assert [rows[n]["found"] for n in range(3)] == [True, True, False] and rows[2]["answer"] == A.NO_INFORMATION
    assert rows[0]["sources"] == [1] and rows[0]["warnings"] == ["[1] Libro, pág. 2: " + A.WARNING % "5 rng"] and rows[2]["warnings"] == []

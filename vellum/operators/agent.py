"""The retrieval agent as tables: bounded search turns, citations, sources, warnings, conversations, events.

A language model and an embedding service are ports: Python callables on text that run in Arrow batches. Everything
around them is expressions. Turns are two bounded passes over the questions that are still open.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions.tables import shared_checkpoint

# Limits and texts of the agent.
LAST_TURNS = 6
FRAGMENT_CHARS = 2500
K = 8
SEARCHES = 2
NO_INFORMATION = "No encontré información sobre esto en la biblioteca."
WARNING = "la unidad en «%s» puede estar mal digitalizada; verifícala en el libro."


def citations(text: Column, total: Column) -> Column:
    """Numbers [n] from 1 to ``total``, each once, in order. A number too large for any list is no citation."""
    numbers = F.transform(F.regexp_extract_all(text, F.lit(r"\[(\p{Nd}+)\]"), F.lit(1)), lambda x: x.try_cast("int"))
    return F.array_distinct(F.filter(numbers, lambda n: n.isNotNull() & (n >= 1) & (n <= total)))


def useful(picked: Column, total: Column) -> Column:
    return F.array_distinct(F.filter(picked, lambda n: (n >= 1) & (n <= total)))


def citation(document: Column, first: Column, last: Column) -> Column:
    page = F.when(last.isNull() | (last == first), F.concat(F.lit(", pág. "), first.cast("string"))).otherwise(F.concat(F.lit(", págs. "), first.cast("string"), F.lit("-"), last.cast("string")))
    return F.concat(document, F.when(first.isNull(), "").otherwise(page))


def sources(text: Column, relevant: Column) -> Column:
    """Sorted numbers of the cited fragments, all if none is cited."""
    cited = citations(text, F.size(relevant))
    every = F.when(F.size(relevant) > 0, F.sequence(F.lit(1), F.size(relevant))).otherwise(F.array().cast("array<int>"))
    return F.array_sort(F.when(F.size(cited) > 0, cited).otherwise(every))


def warnings(numbers: Column, fragments: Column) -> Column:
    """One for each dubious unit of a cited fragment (cite, dubious_units)."""
    one = lambda n: F.transform(F.element_at(fragments, n)["dubious_units"], lambda u: F.concat(F.lit("["), n.cast("string"), F.lit("] "), F.element_at(fragments, n)["cite"], F.lit(": "), F.format_string(WARNING, u)))
    return F.flatten(F.transform(numbers, one))


def shown(fragments: Column) -> Column:
    """Numbered fragments (cite, path, dubious_units, text) as the model reads them."""

    def one(f: Column, i: Column) -> Column:
        section = F.when(F.size(f["path"]) > 0, F.array_join(f["path"], " > ")).otherwise("sin sección")
        dubious = F.when(F.size(f["dubious_units"]) > 0, F.concat(F.lit("\nUNIDADES DUDOSAS: "), F.array_join(f["dubious_units"], "; "))).otherwise("")
        return F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), f["cite"], F.lit(" — "), section, dubious, F.lit("\n"), F.substring(f["text"], 1, FRAGMENT_CHARS))

    return F.array_join(F.transform(fragments, one), "\n\n---\n\n")


def last_turns(messages: DataFrame, thread: str = "conv_id", turn: str = "turn", most: int = LAST_TURNS) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(thread).orderBy(F.desc(turn)))
    return messages.withColumn("_n", rank).filter(F.col("_n") <= most).drop("_n")


def history(messages: DataFrame, thread: str = "conv_id") -> DataFrame:
    """thread, history: the last turns as an array, oldest first."""
    own = last_turns(messages, thread).groupBy(thread).agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("history"))
    return own.withColumn("history", F.transform("history", lambda m: F.struct(m["role"].alias("role"), m["text"].alias("content"))))


def valid_request(question: Column, conversation: Column) -> Column:
    return F.length(question).between(1, 2000) & conversation.rlike(r"\A[A-Za-z0-9-]{8,64}\z")


def event(kind: Column, data: Column) -> Column:
    return F.concat(F.lit("event: "), kind, F.lit("\ndata: "), F.to_json(data), F.lit("\n\n"))


def hashed_embedding(width: int = 64) -> Callable[[pd.Series], pd.Series]:
    """An offline stand-in for the embedding service: hashed words, the same on every machine."""
    import zlib

    import numpy as np

    def embed(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            v = np.zeros(width)
            for word in (text or "").lower().split():
                h = zlib.crc32(word.encode())
                v[h % width] += 1 if h & 0x10000 else -1
            out.append((v / (np.linalg.norm(v) or 1)).tolist())
        return pd.Series(out)

    return embed


def embed(df: DataFrame, text: str, service: Callable[[pd.Series], pd.Series], name: str = "embedding") -> DataFrame:
    from pyspark.sql.types import ArrayType, DoubleType

    port = F.pandas_udf(service, ArrayType(DoubleType()))
    return df.withColumn(name, port(F.col(text)))


def with_retries(service: Callable, transient: tuple[type[Exception], ...], tries: int = 6, wait: float = 2.0, sleep: Callable[[float], None] | None = None) -> Callable:
    """Calls again after transient errors, waiting twice as long each time; other errors pass."""
    import time

    pause = sleep or time.sleep

    def call(*args):
        for n in range(tries):
            try:
                return service(*args)
            except transient:
                if n == tries - 1:
                    raise
                pause(wait * 2**n)

    return call


def halving(service: Callable[[list], list], too_large: type[Exception]) -> Callable[[list], list]:
    """Splits a batch that is too large in halves until it passes; one item that is too large raises."""

    def call(items: list) -> list:
        try:
            return service(items)
        except too_large:
            if len(items) < 2:
                raise
            return call(items[: len(items) // 2]) + call(items[len(items) // 2 :])

    return call


def answer_questions(questions: DataFrame, reformulate, search, evaluate, write, searches: int = SEARCHES) -> tuple[DataFrame, DataFrame]:
    """(answers, events) for questions (question_id, question).

    ``reformulate(df)`` adds query from question and tried (array of queries); ``search(df)`` adds fragments (array);
    ``evaluate(df)`` adds picked (array<int>, from 1); ``write(df)`` adds answer from question and relevant. Each pass
    takes the questions without relevant fragments; there are ``searches`` passes at most. A pass is written once and only
    read by its events, the answers and the next pass, so ports are called once for each open question.
    """
    open_ = questions.select("question_id", "question", F.array().cast("array<string>").alias("tried"))
    solved, events = None, None
    for n in range(searches):
        df = shared_checkpoint(evaluate(search(reformulate(open_))))
        df = df.withColumn("relevant", F.transform(useful(F.col("picked"), F.size("fragments")), lambda k: F.element_at(F.col("fragments"), k)))
        step = lambda node, seq, **data: df.select("question_id", F.lit(3 * n + seq).alias("seq"), F.lit("paso").alias("kind"), F.to_json(F.struct(F.lit(node).alias("nodo"), *(c.alias(k) for k, c in data.items()))).alias("data"))  # noqa: B023, E731
        log = step("reformular", 0, consulta=F.col("query")).unionAll(step("buscar", 1, fragmentos=F.size("fragments"))).unionAll(step("evaluar", 2, relevantes=F.size("relevant")))
        events = log if events is None else events.unionAll(log)
        done = df if n == searches - 1 else df.filter(F.size("relevant") > 0)
        done = done.select("question_id", "question", "relevant")
        solved = done if solved is None else solved.unionAll(done)
        open_ = df.filter(F.size("relevant") == 0).select("question_id", "question", F.concat("tried", F.array("query")).alias("tried"))
    found = F.size("relevant") > 0
    answers = write(solved).withColumn("answer", F.when(found, F.col("answer")).otherwise(F.lit(NO_INFORMATION)))
    answers = answers.withColumn("sources", F.when(found, sources(F.col("answer"), F.col("relevant"))).otherwise(F.array().cast("array<int>")))
    answers = answers.withColumn("warnings", warnings(F.col("sources"), F.col("relevant"))).withColumn("found", found)
    last = answers.select("question_id", F.lit(3 * searches).alias("seq"), F.lit("respuesta").alias("kind"), F.to_json(F.struct(F.col("answer").alias("texto"), F.col("found").alias("encontro_informacion"), F.col("warnings").alias("advertencias"), F.col("sources").alias("fuentes"))).alias("data"))
    return answers, events.unionAll(last)

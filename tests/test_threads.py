"""Threads as keyed state: histories, questions and their searches, repeats, late messages, expiry."""

import random
from datetime import datetime, timedelta

import pytest

from vellum.streaming import events as E
from vellum.streaming import threads as T

START = datetime(2024, 1, 1)
SCHEMA = "thread string, turn long, role string, text string, ts timestamp"


@pytest.fixture(autouse=True)
def state_store(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, E.STATE_STORE)
    yield
    spark.conf.set(key, before)


def streamed(spark, tmp_path, batches, **settings):
    """Rows by thread and turn, and threads left in state at the end; each batch of messages is a file of its own."""
    folder = tmp_path / "in"
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder / f"b={n}"))
    source = spark.readStream.schema(SCHEMA + ", b int").option("maxFilesPerTrigger", 1).parquet(str(folder))
    out = []

    def keep(df, n):
        out.extend((r["thread"], r["turn"], [tuple(m) for m in r["history"]], r["question"], r["tried"], r["searches"]) for r in df.collect())

    query = T.thread_state(source, **settings).writeStream.option("checkpointLocation", str(tmp_path / "state")).foreachBatch(keep).trigger(availableNow=True).start()
    try:
        assert query.awaitTermination(200)
    finally:
        query.stop()
    return sorted(out, key=str)


def at(minutes):
    return START + timedelta(minutes=minutes)


def plain(rows, most, keep):
    """Every message of the threads in order, by what came before it alone."""
    out, seen = [], {}
    for thread, turn, role, text, ts in rows:
        before = seen.setdefault(thread, [])
        if before and ts - before[-1][3] > keep:
            before.clear()
        before.append((turn, role, text, ts))
        told = [(r, x) for _, r, x, _ in before if r != T.SEARCH][-most:]
        asked = max((n for n, m in enumerate(before) if m[1] == T.QUESTION), default=None)
        tried = [] if asked is None else [x for _, r, x, _ in before[asked:] if r == T.SEARCH]
        out.append((thread, turn, told, None if asked is None else before[asked][2], tried, len(tried)))
    return sorted(out, key=str)


def test_histories_questions_and_gaps(spark, tmp_path):
    """Messages in order, cut into batches at random, against a plain version; gaps come with and without a timer between."""
    rng, rows, turns, now = random.Random(3), [], {}, 0
    for n in range(240):
        now += rng.choice([0, 1, 1, 2, 30])
        thread = f"t{rng.randrange(12)}"
        turns[thread] = turns.get(thread, -1) + 1
        rows.append((thread, turns[thread], rng.choice([T.QUESTION, "assistant", T.SEARCH]), f"m{n}", at(now)))
    cuts = sorted(rng.sample(range(1, len(rows)), 5))
    batches = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)])]
    # the watermark trails far behind, so that no message is late; gaps are found by the messages' own times
    found = streamed(spark, tmp_path, batches, most=3, keep_ms=60 * 60_000, late="100 days")
    assert found == plain(rows, 3, timedelta(hours=1))


def test_repeats_late_messages_and_nulls(spark, tmp_path):
    first = [("a", 4, T.QUESTION, "q4", at(4)), ("a", 5, T.SEARCH, "s5", at(5)), (None, 1, T.QUESTION, "x", at(1)), ("a", None, T.QUESTION, "x", at(1))]
    second = [("a", 4, T.QUESTION, "q4", at(4)), ("a", 5, T.SEARCH, "s5", at(5)), ("a", 2, T.QUESTION, "q2", at(2)), ("a", 6, None, None, None)]
    found = streamed(spark, tmp_path, [first, second], most=2)
    assert found == [
        ("a", 2, [("user", "q2")], None, [], 0),
        ("a", 4, [("user", "q4")], "q4", [], 0),
        ("a", 5, [("user", "q4")], "q4", ["s5"], 1),
        ("a", 6, [("user", "q4"), (None, None)], "q4", ["s5"], 1),
    ]


def test_timers_forget_threads(spark, tmp_path):
    """After the watermark has passed a thread's time, a message without a time finds nothing of it."""
    batches = [
        [("a", 0, T.QUESTION, "old", at(0)), ("b", 0, T.QUESTION, "kept", at(300))],
        [("b", 1, "assistant", "later", at(301))],
        [("c", 0, "assistant", "x", at(302))],
        [("a", 1, "assistant", "new", None), ("b", 2, "assistant", "last", None)],
    ]
    found = streamed(spark, tmp_path, batches, keep_ms=60 * 60_000)
    assert ("a", 1, [("assistant", "new")], None, [], 0) in found
    assert ("b", 2, [("user", "kept"), ("assistant", "later"), ("assistant", "last")], "kept", [], 0) in found


def test_empty(spark, tmp_path):
    assert streamed(spark, tmp_path, [[]]) == []

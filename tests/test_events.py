"""Event streams cut at every byte, in any order, with repeats; batches written once."""

import random
from datetime import datetime, timedelta

import pytest

from vellum.streaming import events as E

START = datetime(2024, 1, 1)
SCHEMA = "stream string, seq long, piece binary, ts timestamp"
EVENTS = [("paso", '{"nodo": "buscar"}'), ("paso", '{"nodo": "ñandú 🐦"}'), ("respuesta", '{"texto": "sí"}')]
TEXT = "".join(f"event: {k}\ndata: {d}\n\n" for k, d in EVENTS).encode()


@pytest.fixture(autouse=True)
def state_store(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, E.STATE_STORE)
    yield
    spark.conf.set(key, before)


def streamed(spark, tmp_path, batches, **settings):
    """The rows that come of some batches of messages, each a file of its own."""
    folder = tmp_path / "in"
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder / f"b={n}"))
    source = spark.readStream.schema(SCHEMA + ", b int").option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(folder))
    out = []
    query = E.parsed(source, **settings).writeStream.option("checkpointLocation", str(tmp_path / "state")).foreachBatch(lambda df, n: out.extend(tuple(r) for r in df.collect())).trigger(availableNow=True).start()
    try:
        assert query.awaitTermination(150)
    finally:
        query.stop()
    return sorted(out)


def test_frames():
    assert E.frame("event: a\ndata: b") == ("a", "b") and E.frame("data: b\nid: 1\nevent: a\ndata: c") == ("a", "b")
    assert E.frame("event: a") is None and E.frame(": event: a\ndata: b") is None and E.frame("") is None and E.frame("event: \ndata: b") is None


def test_cut_at_every_byte_in_any_order(spark, tmp_path):
    wanted = [(n, *e) for n, e in enumerate(EVENTS)]
    rows = []
    for cut in range(len(TEXT) + 1):
        rows += [(f"cut {cut:03}", 0, TEXT[:cut], START), (f"cut {cut:03}", 1, TEXT[cut:], START)]
    rows += [("bytes", n, TEXT[n : n + 1], START) for n in range(len(TEXT))]
    rows += [("bytes", 3, b"other", START), ("bytes", 1000, b"late", START), (None, 0, TEXT, START), ("empty", 0, None, START), ("odd", 0, b"event: x\n\ndata: y\n\n\n\nevent: a\ndata: b\n\n", None)]
    firsts = {}
    for r in rows:
        firsts.setdefault(r[:2], r)
    rows = list(firsts.values())
    random.Random(4).shuffle(rows)
    third = len(rows) // 3
    batches = [rows[:third], rows[third : 2 * third] + rows[:20], rows[2 * third :]]
    found = streamed(spark, tmp_path, batches)
    names = [f"cut {c:03}" for c in range(len(TEXT) + 1)] + ["bytes"]
    assert [r for r in found if r[0] in names] == sorted((name, *w) for name in names for w in wanted)
    assert [r for r in found if r[0] not in names] == [("odd", 0, "a", "b")]


def test_streams_that_stop_are_closed_and_forgotten(spark, tmp_path):
    half, late = TEXT[:40], START + timedelta(hours=2)
    batches = [[("whole", 0, TEXT, START), ("half", 0, half, START)], [("later", 0, TEXT[:60], late)], [("later", 1, TEXT[60:], late)], [("later", 2, b"", late + timedelta(hours=1))]]
    found = streamed(spark, tmp_path, batches, keep_ms=60_000, late="1 minute")
    assert [r[1:3] for r in found if r[0] == "whole"] == [(0, "paso"), (1, "paso"), (2, "respuesta")]
    assert [r[1:] for r in found if r[0] == "half"] == [(0, *EVENTS[0]), (1, E.CLOSED, None)]
    assert [r[2] for r in found if r[0] == "later"] == ["paso", "paso", "respuesta"]


def test_written_batches_count_once(spark, tmp_path):
    spark.dataSource.register(E.EventSink)
    folder, sink = tmp_path / "in", str(tmp_path / "sink")
    assert E.committed(spark, sink).count() == 0
    rows = [(f"s{i}", n, k, d) for i in range(20) for n, (k, d) in enumerate(EVENTS)]
    for n in range(3):
        spark.createDataFrame(rows[n::3], E.OUT).coalesce(1).write.mode("append").parquet(str(folder))
    for _ in range(2):
        query = spark.readStream.schema(E.OUT).option("maxFilesPerTrigger", 1).parquet(str(folder)).writeStream.format("event_files").option("path", sink).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        assert query.awaitTermination(120)
    assert sorted(tuple(r) for r in E.committed(spark, sink).collect()) == sorted((s, n, f"event: {k}\ndata: {d}\n\n") for s, n, k, d in rows)


def test_a_repeated_batch_and_one_without_commit_leave_nothing(tmp_path):
    from pyspark.sql import Row

    writer = E.EventWriter(str(tmp_path))
    one = lambda text: writer.write(iter([Row(stream="s", number=0, kind="paso", data=text)]))
    first, second, lost = one("1"), one("2"), one("3")
    writer.commit([first, None], 0)
    writer.commit([second], 0)
    writer.abort([lost, None], 1)
    assert [p.name for p in (tmp_path / "events").iterdir()] == [first.file] and [p.name for p in (tmp_path / "commits").iterdir()] == ["0.json"]

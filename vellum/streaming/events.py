"""Event streams: frames cut over message borders are joined by keyed state, and events are written batch by batch.

A frame is ``event: kind``, a line end, ``data: ...`` and an empty line, in UTF-8.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, WriterCommitMessage
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: ``spark.sql.streaming.stateStore.providerClass`` has to be this for ``parsed``.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
FRAME_END = b"\n\n"
LAST = ("respuesta", "error")  # fixed values: kinds after which nothing of a stream counts
CLOSED = "closed"
LINE = r"(?:\A|[\n\r\u2028\u2029])%s: ([^\n\r\u2028\u2029]+)"
KIND, DATA = (re.compile(LINE % name) for name in ("event", "data"))
OUT = "stream string, number long, kind string, data string"


def frame(text: str) -> tuple[str, str] | None:
    """Kind and data of a frame, nothing where it lacks either."""
    kind, data = KIND.search(text), DATA.search(text)
    return (kind.group(1), data.group(1)) if kind and data else None


class Joined(StatefulProcessor):
    """State of a stream: the next message's number, how many events came, whether the last one did, when to forget it, and
    the bytes after the last whole frame; besides messages that came too early, by number."""

    def __init__(self, keep: int):
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.at = handle.getValueState("at", "due long, events long, ended boolean, expires long, held binary")
        self.early = handle.getMapState("early", "seq long", "piece binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        due, events, ended, expires, held = self.at.get() if self.at.exists() else (0, 0, False, 0, b"")
        buffer, start, seen = bytearray(held), max(0, len(held) - 1), timerValues.getCurrentWatermarkInMs()
        out, waiting = [], {}
        for batch in rows:
            for seq, piece, ms in zip(batch["seq"], batch["piece"], batch["ms"]):
                if pd.notna(ms):
                    seen = max(seen, int(ms))
                if pd.notna(seq) and seq >= due and not ended:
                    waiting.setdefault(int(seq), piece or b"")
            while not ended and (due in waiting or self.early.containsKey((due,))):
                piece = waiting.pop(due, None)
                if self.early.containsKey((due,)):
                    piece = self.early.getValue((due,))[0]
                    self.early.removeKey((due,))
                buffer += piece
                due += 1
                done = 0
                while not ended and (end := buffer.find(FRAME_END, max(done, start))) >= 0:
                    found = frame(bytes(buffer[done:end]).decode("utf-8", "replace"))
                    done = start = end + len(FRAME_END)
                    if found:
                        out.append((key[0], events, *found))
                        events, ended = events + 1, found[0] in LAST
                del buffer[:done]
                start = max(0, len(buffer) - 1)
        if ended:
            buffer, waiting = bytearray(), {}
            self.early.clear()
        for seq, piece in waiting.items():
            if seq > due and not self.early.containsKey((seq,)):
                self.early.updateValue((seq,), (piece,))
        until = seen + self.keep
        if until > expires:
            if expires:
                self.handle.deleteTimer(expires)
            self.handle.registerTimer(until)
            expires = until
        self.at.update((due, events, ended, expires, bytes(buffer)))
        yield pd.DataFrame(out, columns=["stream", "number", "kind", "data"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = self.at.get() if self.at.exists() else None
        self.at.clear()
        self.early.clear()
        if at and not at[2]:
            yield pd.DataFrame([(key[0], at[1], CLOSED, None)], columns=["stream", "number", "kind", "data"])

    def close(self) -> None:
        pass


def parsed(messages: DataFrame, keep_ms: int = 600_000, late: str = "10 minutes") -> DataFrame:
    """stream, number, kind, data: the events of streams of messages (stream, seq from 0, piece, ts), numbered from 0.

    Pieces are bytes cut anywhere, within a letter too. Messages may come in any order and twice: those that come too
    early wait in state, of two with one number the first counts. Frames without kind or data are passed over, as is what follows a
    last event. A stream of which nothing came for ``keep_ms`` of event time is forgotten; if its last event is missing,
    an event ``CLOSED`` says so. Null streams and numbers take no part, null pieces are empty. State holds one
    unfinished frame a stream and the messages that wait.
    """
    own = messages.filter(F.col("stream").isNotNull() & F.col("seq").isNotNull())
    own = own.select(F.col("stream").cast("string").alias("stream"), F.col("seq").cast("long").alias("seq"), "piece", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"), F.col("ts").cast("timestamp").alias("ts"))
    return own.withWatermark("ts", late).groupBy("stream").transformWithStateInPandas(Joined(keep_ms), OUT, "Append", "EventTime")


@dataclass
class Written(WriterCommitMessage):
    file: str


class EventWriter(DataSourceStreamWriter):
    """Files of a batch count when its commit names them. A batch that is repeated after a failure has its commit already, or
    has none and its first files count for nothing."""

    def __init__(self, root: str):
        self.root = Path(root)

    def write(self, rows: Iterator[Row]) -> Written:
        folder = self.root / "events"
        folder.mkdir(parents=True, exist_ok=True)
        file = folder / f"{uuid.uuid4().hex}.json"
        with open(file, "w", encoding="utf-8") as out:
            for r in rows:
                text = f"event: {r['kind']}\ndata: {'null' if r['data'] is None else r['data']}\n\n"
                out.write(json.dumps({"stream": r["stream"], "number": r["number"], "frame": text}) + "\n")
            out.flush()
            os.fsync(out.fileno())
        return Written(file.name)

    def commit(self, messages: list[Written | None], batchId: int) -> None:  # noqa: N803 - the interface's name
        folder = self.root / "commits"
        folder.mkdir(parents=True, exist_ok=True)
        draft = folder / f".{uuid.uuid4().hex}"
        draft.write_text(json.dumps([m.file for m in messages if m]), encoding="utf-8")
        try:
            os.link(draft, folder / f"{batchId}.json")
        except FileExistsError:
            self.abort(messages, batchId)
        finally:
            draft.unlink()

    def abort(self, messages: list[Written | None], batchId: int) -> None:  # noqa: N803
        for m in messages:
            if m:
                (self.root / "events" / m.file).unlink(missing_ok=True)


class EventSink(DataSource):
    """``writeStream.format("event_files").option("path", ...)`` after ``spark.dataSource.register(EventSink)``: rows of stream,
    number, kind, data (one line of text) as frames. The path is on a file system that all machines have mounted."""

    @classmethod
    def name(cls) -> str:
        return "event_files"

    def streamWriter(self, schema, overwrite: bool) -> EventWriter:  # noqa: N802
        return EventWriter(self.options["path"])


def committed(spark: SparkSession, path: str) -> DataFrame:
    """stream, number, frame of all batches with a commit."""
    files = sorted({f"{path}/events/{name}" for c in Path(path, "commits").glob("[0-9]*.json") for name in json.loads(c.read_text(encoding="utf-8"))})
    schema = "stream string, number long, frame string"
    return spark.read.schema(schema).json(files) if files else spark.createDataFrame([], schema)

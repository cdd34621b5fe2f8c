"""Conversations as a stream: the last messages of each thread as durable keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState

from vellum.operators.agent import LAST_TURNS

OUT = "conv_id long, turn long, history array<string>"
#: Roles of messages: a question begins a turn of the agent, a search is a query that found nothing useful.
QUESTION, SEARCH = "user", "search"
THREAD = "thread string, turn long, role string, history array<struct<role string, content string>>, question string, tried array<string>, searches int"


def thread_memory(messages: DataFrame, most: int = LAST_TURNS) -> DataFrame:
    """For each message (conv_id, turn, text) that arrives, the last ``most`` messages of its thread, itself included.
    State holds ``most`` messages a thread and survives restarts with the query's checkpoint. Threads stay for ever;
    ``thread_state`` forgets them."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        for batch in batches:
            rows = []
            batch = batch.sort_values("turn")
            for turn, text in zip(batch["turn"], batch["text"]):
                held = [*held, text][-most:]
                rows.append((key[0], turn, held))
            yield pd.DataFrame(rows, columns=["conv_id", "turn", "history"])
        state.update((held,))

    return messages.groupBy("conv_id").applyInPandasWithState(step, OUT, "held array<string>", "append", "NoTimeout")


class Thread(StatefulProcessor):
    """State of a thread: its last messages and the open question's searches as lists in the order of turn; the question,
    its turn and when to forget the thread as one value."""

    def __init__(self, most: int, keep: int):
        self.most, self.keep = most, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getListState("last", "turn long, role string, text string")
        self.searches = handle.getListState("searches", "turn long, text string")
        self.open = handle.getValueState("open", "asked long, question string, expires long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last, tried = ([tuple(r) for r in s.get()] if s.exists() else [] for s in (self.last, self.searches))
        asked, question, expires = self.open.get() if self.open.exists() else (None, None, 0)
        timer = expires
        for batch in rows:
            out = []
            batch = batch.sort_values(["turn", "ms"], kind="stable")
            for turn, role, text, ms in zip(*(batch[c] for c in ("turn", "role", "text", "ms"))):
                turn = int(turn)
                if pd.notna(ms):
                    if expires and ms > expires:
                        last, tried, asked, question = [], [], None, None
                    expires = max(expires, int(ms) + self.keep)
                if any(turn == t for t, *_ in (*last, *tried)):
                    continue
                if role == SEARCH:
                    if asked is not None and turn > asked:
                        tried = sorted([*tried, (turn, text)], key=lambda t: t[0])
                else:
                    last = sorted([*last, (turn, role, text)], key=lambda m: m[0])
                    if role == QUESTION and (asked is None or turn > asked):
                        asked, question, tried = turn, text, [t for t in tried if t[0] > turn]
                until = [m for m in last if m[0] <= turn][-self.most :]
                last = last[-self.most :]
                own = asked is not None and turn >= asked
                before = [t for n, t in tried if n <= turn] if own else []
                out.append((key[0], turn, role, [{"role": r, "content": t} for _, r, t in until], question if own else None, before, len(before)))
            yield pd.DataFrame(out, columns=["thread", "turn", "role", "history", "question", "tried", "searches"])
        expires = expires or timerValues.getCurrentWatermarkInMs() + self.keep
        if expires != timer:
            if timer:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(expires)
        for state, rows_ in ((self.last, last), (self.searches, tried)):
            if rows_:
                state.put(rows_)
            else:
                state.clear()
        self.open.update((asked, question, expires))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        for state in (self.last, self.searches, self.open):
            state.clear()
        return iter([])

    def close(self) -> None:
        pass


def thread_state(messages: DataFrame, most: int = LAST_TURNS, keep_ms: int = 3_600_000, late: str = "10 minutes") -> DataFrame:
    """For each message (thread, turn, role, text, ts) that arrives: the thread's last ``most`` messages up to it, and the open
    question with the searches made for it, which begin anew with each question.

    Messages of role ``SEARCH`` are searches and not part of the history. A message that comes late takes its place by turn
    among those held; it changes no question that is newer, and if the question held is newer, its own is null. A turn that is held
    already is a repeat and gives no row. A thread without messages for ``keep_ms`` of event time is forgotten: by a timer
    when the watermark passes, and for a message that comes after such a gap before the timer has run. Null threads and turns take no
    part, null texts are kept, messages without a time don't prolong a thread's life. State holds ``most`` messages and one
    question's searches for a thread; a task holds one Arrow batch besides. The session needs the RocksDB state store
    (``events.STATE_STORE``).
    """
    ts = F.col("ts").cast("timestamp")
    own = messages.filter(F.col("thread").isNotNull() & F.col("turn").isNotNull())
    own = own.select(F.col("thread").cast("string").alias("thread"), F.col("turn").cast("long").alias("turn"), "role", "text", F.unix_millis(ts).alias("ms"), ts.alias("ts"))
    return own.withWatermark("ts", late).groupBy("thread").transformWithStateInPandas(Thread(most, keep_ms), THREAD, "Append", "EventTime")

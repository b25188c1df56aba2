"""Replies and sessions as keyed state: what has to be remembered of a stream, and for how long.

Both are state processors, so they need the RocksDB state store (``rocksdb``). A key's state is let go of by an
event-time timer (replies) or by a delete and the time to live of its trace (sessions).
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
NO_DATA = "spark.sql.streaming.noDataMicroBatches.enabled"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextlib.contextmanager
def rocksdb(spark: SparkSession, **more: str):
    """Queries started inside keep their state in RocksDB; others in the session are not touched."""
    settings = {PROVIDER: ROCKSDB, **more}
    before = {name: spark.conf.get(name, None) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def millis(duration: str) -> int:
    """Milliseconds of a duration such as ``10 seconds``."""
    return int(pd.Timedelta(duration).total_seconds() * 1000)


# ---- replies ---------------------------------------------------------------------

FRAGMENT = ["seq", "at", "token", "usage", "is_end"]
# Fragments of one row of state: every row is coded by itself on its way, which costs more than a fragment.
PACK = 1024
PIECE = "piece long, first_seq long, text string, chars long, usage_seq long, usage long, ended boolean"


def packed(fragments: list[tuple]) -> list[tuple]:
    """Rows of state, each with the values of up to PACK fragments side by side."""
    return [tuple(map(list, zip(*fragments[lo:lo + PACK]))) for lo in range(0, len(fragments), PACK)]


class ReplyState(StatefulProcessor):
    """Fragments of one request, released in order.

    ``held`` are fragments that an earlier one may still overtake, ``passed`` is what has gone out. A fragment
    goes out when the watermark has reached its time: nothing earlier can arrive then. One that is older than
    what has gone out, or that has gone out before, is left out; so are fragments behind the end mark.
    """

    def __init__(self, idle_ms: int, forget_ms: int):
        self.idle_ms, self.forget_ms = idle_ms, forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "seq array<long>, at array<long>, token array<string>, usage array<long>, is_end array<boolean>")
        self.passed = handle.getValueState("passed", "seq long, pieces long, last_at long, ended boolean")

    # Lists, not frames: a request mostly has a few fragments, and a frame's operations cost more than they do.
    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seq, _, _, ended = self.passed.get() or (None, 0, 0, False)
        new = [x for part in rows for x in zip(*(part[name].tolist() for name in FRAGMENT)) if not ended and (seq is None or x[0] > seq)]
        if new:
            self.held.appendList(packed(new))
            self.handle.registerTimer(min(x[1] for x in new))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        seq, pieces, last_at, ended = self.passed.get() or (-1, 0, 0, False)
        ripe, later = {}, []
        for x in (x for part in self.held.get() for x in zip(*part)):
            if x[1] > now:
                later.append(x)
            elif x[0] > seq:
                ripe.setdefault(x[0], x)
        out = [ripe[n] for n in sorted(ripe)]
        end = next((i for i, x in enumerate(out) if x[4]), None)
        if end is not None:
            out, ended, later = out[:end + 1], True, []
        if out:
            used = [x for x in out if x[3] > 0]
            seq, pieces, last_at = out[-1][0], pieces + 1, max(last_at, max(x[1] for x in out))
            yield pd.DataFrame({
                **{name: [value] for name, value in zip(self.keys, key)},
                "piece": [pieces - 1], "first_seq": [out[0][0]], "text": ["".join(x[2] for x in out)],
                "chars": [sum(len(x[2]) for x in out)], "usage_seq": [used[-1][0] if used else -1],
                "usage": [used[-1][3] if used else 0], "ended": [ended],
            })
        over = last_at + (self.forget_ms if ended else self.idle_ms)
        if not len(later) and over <= now:
            self.held.clear()
            self.passed.clear()
            return
        self.passed.update((seq, pieces, last_at, ended))
        if len(later):
            self.held.put(packed(later))
            self.handle.registerTimer(min(x[1] for x in later))
        else:
            self.held.clear()
            self.handle.registerTimer(over)

    def close(self) -> None:
        pass


def live_replies(
    fragments: DataFrame, ts: str = "ts", late: str = "1 minute", idle: str = "10 minutes", forget: str = "1 hour", key: str = "request_id",
    seq: str = "seq",
) -> DataFrame:
    """Pieces of every reply in fragment order, for append mode: key, piece, first_seq, text, chars, usage_seq, usage, ended.

    ``fragments`` have token, usage and is_end (``decode_marked``). A piece holds what the watermark has passed
    since the one before. State holds the fragments of the last ``late`` of a request and one row of numbers; it
    is empty ``forget`` after the end mark (fragments behind the mark are left out as long as that), or after
    ``idle`` without a mark. Repeated fragments count once, late ones not at all.
    """
    at = F.unix_millis(ts)
    timed = (
        fragments.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
        .select(key, ts, F.col(seq).alias("seq"), at.alias("at"), "token", "usage", "is_end")
    )
    processor = ReplyState(millis(idle), millis(forget))
    processor.keys = [key]
    kind = fragments.schema[key].dataType.simpleString()
    return timed.groupBy(key).transformWithStateInPandas(processor, f"`{key}` {kind}, {PIECE}", "Append", "EventTime")


def whole_replies(pieces: DataFrame, key: str = "request_id") -> DataFrame:
    """Pieces of ``live_replies`` put together: text, chars, server_tokens, ended."""
    return pieces.groupBy(key).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", "text"))), lambda x: x["text"]), "").alias("text"),
        F.sum("chars").alias("chars"),
        F.coalesce(F.max_by("usage", F.when(F.col("usage") > 0, F.col("usage_seq"))), F.lit(0)).alias("server_tokens"),
        F.bool_or("ended").alias("ended"),
    )


# ---- sessions --------------------------------------------------------------------

SESSION_ROW = "title string, messages long, created_at long, deleted boolean"


class SessionState(StatefulProcessor):
    """One living session: title of its first message, number of messages, age. A delete leaves a trace for ``trace_ms``."""

    def __init__(self, trace_ms: int):
        self.trace_ms = trace_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.session = handle.getValueState("session", "first_turn long, title string, messages long, created_at long")
        self.gone = handle.getValueState("gone", "deleted boolean", self.trace_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if self.gone.exists():
            return
        new = pd.concat(list(rows), ignore_index=True)
        deleted = bool(new["deleted"].any())
        said = new[~new["deleted"]]
        first_turn, title, messages, created_at = self.session.get() or (None, None, 0, None)
        if len(new):
            start = int(new["ts"].min())
            created_at = start if created_at is None else min(created_at, start)
        if len(said):
            first = said.loc[said["turn"].idxmin()]
            if first_turn is None or first["turn"] < first_turn:
                first_turn, title = int(first["turn"]), first["title"]
            messages += len(said)
        if deleted:
            self.session.clear()
            self.gone.update((True,))
        else:
            self.session.update((first_turn, title, messages, created_at))
        yield pd.DataFrame({
            **{name: [value] for name, value in zip(self.keys, key)},
            "title": [title], "messages": [messages], "created_at": [created_at], "deleted": [deleted],
        })

    def close(self) -> None:
        pass


def live_sessions(messages: DataFrame, title, trace: str = "30 days", key: str = "session_id") -> DataFrame:
    """Changed sessions of every micro-batch, for update mode: key, title, messages, created_at, deleted.

    ``messages`` have turn, text, ts (milliseconds) and deleted; ``title`` makes a title of a text. State follows
    the living sessions. Messages to a deleted session are left out as long as its trace is kept.
    """
    processor = SessionState(millis(trace))
    processor.keys = [key]
    kind = messages.schema[key].dataType.simpleString()
    rows = messages.select(key, "turn", title(F.col("text")).alias("title"), "ts", "deleted")
    return rows.groupBy(key).transformWithStateInPandas(processor, f"`{key}` {kind}, {SESSION_ROW}", "Update", "ProcessingTime")

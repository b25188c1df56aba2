"""Replies and sessions as state, recorded replies as a source."""

import json
import os
import tempfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpusloom.functions.text import session_title
from corpusloom.sources import frames as fr
from corpusloom.sources import replies as rp
from corpusloom.streaming import jobs, live

BASE = 1_700_000_000  # seconds


@pytest.fixture(autouse=True)
def few_partitions(spark):
    """Every partition of a stateful query has a state store of its own."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def fresh():
    return tempfile.mkdtemp(prefix="corpusloom-test-")


def put(path, data, mode="ab"):
    with open(path, mode) as f:
        f.write(data)


def model(raw, size):
    """What a reader of ``size`` bytes at a time takes from a response."""
    out, buffer, at = [], b"", 0
    for k in range(0, len(raw), size):
        *lines, buffer = (buffer + raw[k:k + size]).split(b"\n")
        done = False
        for line in lines:
            at += len(line) + 1
            if not done:
                out.append((k // size, at, line.decode("utf-8", "replace")))
            done = done or (line.strip().startswith(b"data:") and line.strip()[5:].strip() == b"[DONE]")
    return out


RAW = {
    "a": b'data: {"x": 1}\n\ndata: [DONE]\ndata: late\n' + b"data: next read\n" * 9 + b"  data:[DONE] \r\nx\ny\n" + b"no line feed",
    "b": b"only a rest", "c": b"\n", "d": "data: \u6f22\u5b57 \xe9\n".encode() * 7 + b"data: [DONE]\n", "e": b"",
    "f": b"z" * 20_000 + b"\ndata: [DONE]\nq\n",
}


@pytest.mark.parametrize("size", [1, 7, 40, 16_384])
def test_frames_are_reads_of_a_response(spark, size, monkeypatch):
    monkeypatch.setattr(fr, "SPLIT_BYTES", 3 * size)  # many spans of one file
    path = fresh()
    small = {k: v for k, v in RAW.items() if size > 1 or len(v) < 200}
    for name, raw in small.items():
        put(f"{path}/{name}.log", raw)
    put(f"{path}/_SUCCESS", b"data: no\n")
    got = sorted((r.request_id, r.frame, r.seq, r.value) for r in fr.read_reply_frames(spark, path, size).collect())
    assert got == sorted((name, *row) for name, raw in small.items() for row in model(raw, size))


def test_small_replies_are_read_together(spark, monkeypatch):
    path = fresh()
    texts = {"a b/c": "x\ny\nz", "+%": "data: [DONE]\n", "e": "", ".": "q\n", "\u6f22": "r\n"}
    assert fr.write_replies(spark.createDataFrame(list(texts.items()), "request_id string, value string"), path) == 5
    got = sorted((r.request_id, r.value) for r in fr.read_reply_frames(spark, path).collect())
    assert got == sorted([("a b/c", "x"), ("a b/c", "y"), ("+%", "data: [DONE]"), (".", "q"), ("\u6f22", "r")])
    for k in range(20):
        put(f"{path}/{k}.log", b"one\ntwo\n")
    monkeypatch.setattr(fr, "SPLIT_FILES", 10)
    reader = fr.FrameReader({"path": path})
    monkeypatch.setattr(fr.Folder, "open", None)  # the driver opens no file
    tasks = reader.partitions()
    assert [len(t.spans) for t in tasks] == [10, 10, 4]


def test_frames_of_a_missing_folder(spark):
    assert fr.read_reply_frames(spark, fresh() + "/none").count() == 0
    with pytest.raises(Exception):
        fr.read_reply_frames(spark, fresh(), 0).count()


def test_growing_files_and_restarts_give_the_rows_of_one_read(spark):
    """Files grow by odd steps between runs of one stream; each run goes on from the last offset."""
    path, out, size = fresh(), fresh() + "/out", 40
    start = {name: 0 for name in RAW}
    for step in (5, 98, 30_000):
        for name, raw in RAW.items():
            put(f"{path}/{name}.log", raw[start[name]:start[name] + step])
            start[name] += step
        stream = fr.stream_reply_frames(spark, path, size)
        jobs.write_epochs(stream, out, out + "-checkpoint", "append").awaitTermination()
    rows = spark.read.parquet(out)
    got = sorted((r.request_id, r.frame, r.seq, r.value) for r in rows.collect())
    assert got == sorted((name, *row) for name, raw in RAW.items() for row in model(raw, size))


def test_a_repeated_batch_gives_the_same_rows(spark):
    path = fresh()
    for name, raw in RAW.items():
        put(f"{path}/{name}.log", raw)
    reader = fr.FrameStreamReader({"path": path, "frame_bytes": "40"})
    end = reader.latestOffset()
    rows = lambda spans: [r for s in spans for b in reader.read(s) for r in b.to_pylist()]
    first = rows(reader.partitions(reader.initialOffset(), end))
    put(f"{path}/a.log", b"more\n")  # grows after the offset was taken
    assert rows(reader.partitions(reader.initialOffset(), json.loads(json.dumps(end)))) == first
    assert [r["value"] for r in rows(reader.partitions(end, reader.latestOffset()))] == ["no line feedmore"]


# ---- replies ---------------------------------------------------------------------


def line(seq, at, body, request="r"):
    value = "data: [DONE]" if body is None else "data: " + json.dumps(
        {"choices": [{"text": body}]} if isinstance(body, str) else {"choices": [], "usage": {"completion_tokens": body}}
    )
    return request, seq, BASE + at, value


def drain(spark, batches, **options):
    """Pieces after every batch has been a run of its own, and the rows of state that are left."""
    source, out = fresh(), fresh() + "/out"
    left = None
    for i, rows in enumerate(batches):
        frame = spark.createDataFrame(rows, "request_id string, seq long, at long, value string")
        frame.select("request_id", "seq", F.timestamp_seconds("at").alias("ts"), "value").coalesce(1).write.mode("append").parquet(source)
        lines = spark.readStream.schema("request_id string, seq long, ts timestamp, value string").parquet(source)
        stream = live.live_replies(rp.decode_marked(lines), **options)
        with live.rocksdb(spark):
            query = jobs.write_epochs(stream, out, out + "-checkpoint", "append")
        query.awaitTermination()
        left = query.lastProgress["stateOperators"][0]["numRowsTotal"] if query.lastProgress else left
    return spark.read.parquet(out), left


def test_late_and_repeated_fragments(spark):
    pieces, left = drain(spark, [
        [line(2, 2, "b"), line(1, 1, "a"), line(1, 1, "a"), line(3, 3, 7), line(9, 500, "x", "clock")],
        # behind the watermark (440 s): dropped; a repeated one: counted once
        [line(1, 1, "a"), line(0, 0, "late"), line(5, 501, "d"), line(4, 500, "c"), line(5, 501, "d"), line(6, 502, None), line(7, 503, "after"),
         line(10, 2000, "y", "clock")],
        [line(8, 2001, "after the end"), line(11, 9000, "z", "clock")],
        [line(12, 20_000, "w", "clock")],
        [line(13, 30_000, None, "clock"), line(14, 90_000, "v", "tick")],
        [line(15, 190_000, "u", "tick")],
    ], late="1 minute", idle="10 minutes", forget="1 hour")
    mine = pieces.where("request_id = 'r'").orderBy("piece").collect()
    assert [(p.piece, p.text, p.ended) for p in mine] == [(0, "ab", False), (1, "cd", True)]
    whole = {r.request_id: (r.text, r.chars, r.server_tokens, r.ended) for r in live.whole_replies(pieces).collect()}
    assert whole["r"] == ("abcd", 4, 7, True)
    assert left is not None and left <= 2  # only the last fragment of "tick" is held


def test_state_is_empty_after_the_end_mark(spark):
    rows = [line(i, i, f"t{i} ", f"r{i % 5}") for i in range(50)] + [line(100 + i, 60, None, f"r{i}") for i in range(5)]
    _, left = drain(spark, [rows, [line(200, 100_000, None, "clock")], [line(201, 900_000, None, "last")]], late="1 minute", forget="1 minute")
    assert left is not None and left <= 2  # the marks of "last"


def test_marked_replies_end_at_the_mark(spark):
    rows = [line(1, 1, "a"), line(2, 2, "b"), line(2, 2, "b"), line(70_000, 3, "c"), line(70_001, 4, None), line(70_002, 5, "d"), line(200_000, 6, "e"),
            line(1, 1, "only", "s"), line(2, 2, None, "t"), line(3, 3, "gone", "t"), line(3, 3, 5, "s")]
    lines = spark.createDataFrame(rows, "request_id string, seq long, at long, value string").drop("at")
    got = rp.assemble_replies(rp.decode_marked(lines)).orderBy("request_id", "part").collect()
    assert [(r.request_id, r.part, r.text, r.chars, r.server_tokens) for r in got] == [
        ("r", 0, "ab", 3, 0), ("r", 1, "c", 3, 0), ("s", 0, "only", 4, 5), ("t", 0, "", 0, 0)]


# ---- sessions --------------------------------------------------------------------


def test_sessions_live_and_go(spark):
    source, out = fresh(), fresh() + "/sessions"
    batches = [
        [("a", 0, "hello a", 10, False), ("a", 1, "more", 11, False), ("b", 1, "second", 5, False)],
        [("b", 0, "first of b", 4, False), ("a", 2, "", 12, True), ("c", 0, "c", 1, False)],
        [("a", 3, "too late", 13, False), ("c", 1, "c again", 2, False)],
        [("d", 0, "d", 1, False), ("d", 1, "", 2, True)],
        [("e", 0, "x" * 60, 1, False)],
    ]
    sizes = []
    for rows in batches:
        frame = spark.createDataFrame([(s, t, "user", x, ts, d) for s, t, x, ts, d in rows], "session_id string, turn int, role string, text string, ts long, deleted boolean")
        frame.coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(frame.schema).parquet(source)
        jobs.stream_sessions(stream, out, out + "-checkpoint", compact_every=2).awaitTermination()
        view = jobs.sessions_of(spark, out)
        sizes.append(sum(os.path.getsize(f.removeprefix("file://")) for f in view.inputFiles()))
    got = sorted((r.session_id, r.title, r.messages, r.created_at) for r in view.collect())
    cut = spark.range(1).select(session_title(F.lit("x" * 60))).first()[0]
    assert got == [("b", "first of b", 2, 4), ("c", "c", 2, 1), ("e", cut, 1, 1)]
    # a snapshot of the living sessions takes the place of the changes before it
    assert {f.split("generation=")[1][0] for f in view.inputFiles()} == {"2"}


def test_bytes_read_follow_living_sessions(spark):
    """Sessions come and go; what the view reads stays what the living ones need."""
    source, out = fresh(), fresh() + "/sessions"
    read = []
    for k in range(4):
        rows = [(f"s{k}-{i}", 0, "user", f"hello {i}", i, False) for i in range(200)]
        rows += [(f"s{k - 1}-{i}", 1, "user", "", i, True) for i in range(200)] if k else []
        frame = spark.createDataFrame(rows, "session_id string, turn int, role string, text string, ts long, deleted boolean")
        frame.coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(frame.schema).parquet(source)
        jobs.stream_sessions(stream, out, out + "-checkpoint", compact_every=1).awaitTermination()
        view = jobs.sessions_of(spark, out)
        read.append(sum(os.path.getsize(f.removeprefix("file://")) for f in view.inputFiles()))
        assert view.count() == 200
    assert max(read[1:]) < 1.3 * min(read[1:])


class Kept:
    """State of one key in memory; ``written`` counts the rows of lists that were sent."""

    def __init__(self):
        self.lists, self.values, self.timers, self.written = {}, {}, [], 0

    def getListState(self, name, schema):
        return ListOf(self, name)

    def getValueState(self, name, schema, ttl=None):
        return ValueOf(self, name)

    def registerTimer(self, at):
        self.timers.append(at)


class ListOf:
    def __init__(self, kept, name):
        self.kept, self.name = kept, name

    def get(self):
        return iter(self.kept.lists.get(self.name, []))

    def appendList(self, rows):
        self.kept.written += len(rows)
        self.kept.lists.setdefault(self.name, []).extend(rows)

    def put(self, rows):
        self.clear()
        self.appendList(rows)

    def clear(self):
        self.kept.lists.pop(self.name, None)


class ValueOf:
    def __init__(self, kept, name):
        self.kept, self.name = kept, name

    def get(self):
        return self.kept.values.get(self.name)

    def update(self, value):
        self.kept.values[self.name] = value

    def clear(self):
        self.kept.values.pop(self.name, None)


class At:
    def __init__(self, now):
        self.now = now

    def getCurrentWatermarkInMs(self):
        return self.now


def test_fragments_are_kept_many_to_a_row_of_state():
    kept, processor = Kept(), live.ReplyState(10**9, 10**9)
    processor.keys = ["request_id"]
    processor.init(kept)
    n = 3000
    order = [(i * 7) % n for i in range(n)] + [5]  # out of order, one twice
    frame = pd.DataFrame({"seq": order, "at": [1000 + i for i in order], "token": [f"t{i} " for i in order],
                          "usage": [i if i % 500 == 0 else 0 for i in order], "is_end": [False] * len(order)})
    assert list(processor.handleInputRows((1,), iter([frame[:1000], frame[1000:]]), None)) == []
    assert kept.written <= 3 and kept.timers == [1000]
    first = list(processor.handleExpiredTimer((1,), At(1000 + 1999), None))
    assert [(r.piece, r.first_seq, r.usage_seq, r.usage, r.ended) for r in first[0].itertuples()] == [(0, 0, 1500, 1500, False)]
    assert first[0]["text"][0] == "".join(f"t{i} " for i in range(2000)) and first[0]["chars"][0] == len(first[0]["text"][0])
    assert kept.written <= 5 and kept.timers[-1] == 3000
    late = pd.DataFrame({"seq": [3, n, n + 1], "at": [1003, 1000 + n, 1001 + n], "token": ["late", "", "behind"], "usage": [0, 0, 0],
                         "is_end": [False, True, False]})
    list(processor.handleInputRows((1,), iter([late]), None))
    rest = list(processor.handleExpiredTimer((1,), At(10_000), None))
    assert rest[0]["text"][0] == "".join(f"t{i} " for i in range(2000, n)) and bool(rest[0]["ended"][0]) and rest[0]["piece"][0] == 1
    assert not kept.lists and list(processor.handleInputRows((1,), iter([late]), None)) == [] and not kept.lists

"""Recorded replies as a Spark source: raw bytes of one response per file, read in frames.

A response arrives in reads of some bytes. Its lines are split at line feeds, what follows the last one waits for
the next read (and is dropped if none comes), and an end mark ends the read it is in: later lines of the same read
are dropped, those of the next read are not. Here a read is a frame, ``frame_bytes`` of the file, and a line belongs
to the frame that its line feed is in. So the rows depend on the files alone, not on triggers or partitions, and a
replay after a restart gives the same rows.

``read_reply_frames`` and ``stream_reply_frames`` are the batch and the streaming form. The driver lists the files
and opens none; a task reads many of them, since most responses are small. The offset of the stream is the size of
every file, so a folder should hold the responses of an hour or a day, not of years.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from urllib.parse import unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

NAME = "reply_frames"
SCHEMA = "request_id string, frame long, seq long, value string"
FRAME_BYTES = 16_384
#: Bytes of a file that one task reads; a multiple of the frame. Small files are read together, up to as many bytes.
SPLIT_BYTES = 64 << 20
SPLIT_FILES = 256
ROWS_AT_ONCE = 4_096
LOOK_BACK = 8_192
END = b"[DONE]"


@dataclass
class Span:
    """Lines of a file whose line feed is in the bytes ``start`` to ``stop``."""

    name: str
    start: int
    stop: int


@dataclass
class Spans(InputPartition):
    """What one task reads."""

    spans: list[Span]


class Folder:
    """The files below a path, on any file system that Arrow knows."""

    def __init__(self, path: str):
        self.system, root = fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1)) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
        self.root = root.rstrip("/")

    def sizes(self) -> dict[str, int]:
        found = self.system.get_file_info(fs.FileSelector(self.root, allow_not_found=True, recursive=True))
        files = {f.path[len(self.root) + 1:]: f.size for f in found if f.type == fs.FileType.File}
        return {n: s for n, s in sorted(files.items()) if not any(p.startswith(("_", ".")) for p in n.split("/"))}

    def open(self, name: str):
        return self.system.open_input_file(f"{self.root}/{name}")

    def line_start(self, name: str, at: int) -> int:
        """The first byte of the line that byte ``at`` is in, or of the next one if a line ends in front of it."""
        with self.open(name) as file:
            while at > 0:
                back = max(0, at - LOOK_BACK)
                file.seek(back)
                found = file.read(at - back).rfind(b"\n")
                if found >= 0:
                    return back + found + 1
                at = back
        return 0


def _is_end(line: bytes) -> bool:
    clean = line.strip()
    return clean.startswith(b"data:") and clean[5:].strip() == END


def _lines(folder: Folder, span: Span, frame_bytes: int) -> Iterator[tuple[int, int, bytes]]:
    """(frame, position behind the line feed, line) of a span, without lines behind an end mark of their frame."""
    begin = folder.line_start(span.name, span.start // frame_bytes * frame_bytes)
    done_in = -1
    with folder.open(span.name) as file:
        file.seek(begin)
        at, rest = begin, b""
        while at + len(rest) < span.stop:
            block = file.read(min(1 << 20, span.stop - at - len(rest)))
            if not block:
                break
            *lines, rest = (rest + block).split(b"\n")
            for line in lines:
                at += len(line) + 1
                frame = (at - 1) // frame_bytes
                if frame == done_in:
                    continue
                if _is_end(line):
                    done_in = frame
                if at > span.start:
                    yield frame, at, line


class _Frames:
    """What both readers share: plain options, so that they can be sent to tasks."""

    def __init__(self, options):
        self.path = options["path"]
        self.frame_bytes = int(options.get("frame_bytes", FRAME_BYTES))
        if self.frame_bytes < 1:
            raise ValueError("frame_bytes must be positive")

    def sizes(self) -> dict[str, int]:
        return {n: size for n, size in Folder(self.path).sizes().items() if size}

    def tasks(self, start: dict[str, int], end: dict[str, int]) -> list[Spans]:
        """The new bytes of all files, dealt to tasks in the order of the names."""
        out, held, size = [], [], 0
        for span in self.spans(start, end):
            if held and (len(held) == SPLIT_FILES or size + span.stop - span.start > SPLIT_BYTES):
                out.append(Spans(held))
                held, size = [], 0
            held.append(span)
            size += span.stop - span.start
        return out + [Spans(held)] if held else out

    def spans(self, start: dict[str, int], end: dict[str, int]) -> list[Span]:
        step = max(SPLIT_BYTES // self.frame_bytes, 1) * self.frame_bytes
        out = []
        for name, stop in end.items():
            at = start.get(name, 0)
            while at < stop:
                to = min(at // step * step + step, stop)
                out.append(Span(name, at, to))
                at = to
        return out

    def rows(self, task: Spans | None) -> Iterator[pa.RecordBatch]:
        if task is None:  # what Spark reads of a source without partitions
            return
        source, held = Folder(self.path), []
        for span in task.spans:
            folder, _, file = span.name.rpartition("/")
            value = folder.rpartition("/")[2].partition("=")[2]
            request = unquote(value) if value else file.rsplit(".", 1)[0]
            for row in _lines(source, span, self.frame_bytes):
                held.append((request, *row))
                if len(held) == ROWS_AT_ONCE:
                    yield self._batch(held)
                    held = []
        if held:
            yield self._batch(held)

    @staticmethod
    def _batch(rows: list) -> pa.RecordBatch:
        request, frame, seq, line = zip(*rows)
        return pa.RecordBatch.from_arrays(
            [pa.array(request), pa.array(frame, pa.int64()), pa.array(seq, pa.int64()),
             pa.array([x.decode("utf-8", "replace") for x in line])],
            ["request_id", "frame", "seq", "value"],
        )


class FrameReader(_Frames, DataSourceReader):
    def partitions(self) -> Sequence[InputPartition]:
        return self.tasks({}, self.sizes())

    def read(self, partition: Spans) -> Iterator[pa.RecordBatch]:
        return self.rows(partition)


class FrameStreamReader(_Frames, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"files": {}}

    def latestOffset(self) -> dict:
        return {"files": self.sizes()}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        return self.tasks(start["files"], end["files"])

    def read(self, partition: Spans) -> Iterator[pa.RecordBatch]:
        return self.rows(partition)


class ReplyFrames(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FrameReader:
        return FrameReader(self.options)

    def streamReader(self, schema) -> FrameStreamReader:
        return FrameStreamReader(self.options)


def write_files(files: DataFrame, path: str) -> int:
    """Write a file for each row (name, value) below a path, and count them.

    For files as small as a reply, the calls that Spark's writer makes for each one, and the driver for putting them
    in place, take longer than the bytes. A file is complete when it has its name, so a repeated task does no harm.
    """

    def put(batches):
        target, made = Folder(path), set()
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                folder, _, last = f"{target.root}/{name}".rpartition("/")
                if folder not in made:
                    target.system.create_dir(folder)
                    made.add(folder)
                part = f"{folder}/_{uuid.uuid4().hex}"
                with target.system.open_output_stream(part) as out:
                    out.write(data)
                target.system.move(part, f"{folder}/{last}")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    rows = files.select("name", F.col("value").cast("binary").alias("value"))
    return rows.mapInArrow(put, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def write_replies(replies: DataFrame, path: str, key: str = "request_id", value: str = "value") -> int:
    """Record each reply in a file of its own, in a folder named by its request."""
    named = F.replace(F.url_encode(F.col(key).cast("string")), F.lit("+"), F.lit("%20"))
    name = F.concat(F.lit(f"{key}="), F.coalesce(F.nullif(named, F.lit("")), F.lit("__HIVE_DEFAULT_PARTITION__")), F.lit("/reply.log"))
    return write_files(replies.select(name.alias("name"), F.col(value).alias("value")), path)


def read_reply_frames(spark: SparkSession, path: str, frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """request_id, frame, seq (position behind the line) and value of every line of the folder's replies.

    A request is named by its file, or by the folder above if that is a partition (``name=value``).
    """
    spark.dataSource.register(ReplyFrames)
    return spark.read.format(NAME).option("path", path).option("frame_bytes", frame_bytes).load()


def stream_reply_frames(spark: SparkSession, path: str, frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """The same rows as a stream; files may grow and come in between triggers."""
    spark.dataSource.register(ReplyFrames)
    return spark.readStream.format(NAME).option("path", path).option("frame_bytes", frame_bytes).load()

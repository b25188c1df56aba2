"""Files as rows: whole trees, attachments, logs."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.sources.frames import Folder

#: Bytes of contents, and files, that a task reads before it hands them on.
READ_BYTES = 4 << 20
READ_FILES = 1_024
#: Entries of a listing that a task hands on together.
LISTED_AT_ONCE = 4_096
# Fixed value: characters by which Spark takes a path for a pattern.
GLOB = frozenset("{}[]*?\\")


def _relative(path: Column, root: str) -> Column:
    """Path below ``root``; listings carry a scheme in front of it."""
    bare = root.rstrip("/")
    bare = bare.split(":", 1)[1].lstrip("/") if "://" in bare or bare.startswith("file:") else bare.lstrip("/")
    at = F.locate(bare + "/", path)
    return F.substr(path, at + F.lit(len(bare) + 1))


def _binary(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)


def scan_listing(spark: SparkSession, root: str) -> DataFrame:
    """(path, size) of every file; contents are not read."""
    return _binary(spark, root).select(_relative(F.col("path"), root).alias("path"), F.col("length").alias("size"))


def scan_corpus(spark: SparkSession, root: str, max_kb: int | None = None) -> DataFrame:
    """(path, size, content) of a tree as UTF-8 text.

    ``max_kb`` is pushed into the reader, so larger files are never opened.
    """
    files = _binary(spark, root)
    if max_kb is not None:
        files = files.where(F.col("length") <= max(1, max_kb) * 1024)
    return files.select(
        _relative(F.col("path"), root).alias("path"),
        F.col("length").alias("size"),
        F.make_valid_utf8(F.col("content").cast("string")).alias("content"),
    )


def _shown(name: str, folder: bool) -> bool:
    """Whether Spark's file sources see a name."""
    data = not (name.startswith(".") or name.startswith("_") and "=" not in name)
    listed = data and not name.endswith("._COPYING_") or name.startswith(("_metadata", "_common_metadata"))
    return listed and (folder or data)


def _inside(source: Folder, path: str) -> Iterator[tuple[str, int | None]]:
    """(path, size) of what a folder holds; folders have no size. Files without bytes are left out, as by Spark."""
    at = f"{source.root}/{path}" if path else source.root or "/"
    for found in source.system.get_file_info(fs.FileSelector(at)):
        folder = found.type == fs.FileType.Directory
        if (folder or found.type == fs.FileType.File and found.size) and _shown(found.base_name, folder):
            yield f"{path}/{found.base_name}" if path else found.base_name, None if folder else found.size


def _listed(at: str, deep: bool):
    """A map that puts what a folder holds in its place, with ``deep`` all files below it."""

    def entries(source: Folder, path: str) -> Iterator[tuple[str, int | None]]:
        folders = [path]
        while folders:
            for inner, size in _inside(source, folders.pop()):
                if deep and size is None:
                    folders.append(inner)
                else:
                    yield inner, size

    def rows(batches) -> Iterator[tuple[str, int | None]]:
        source = Folder(at)
        for batch in batches:
            for path, size in zip(*(c.to_pylist() for c in batch.columns)):
                yield from entries(source, path) if size is None else [(path, size)]

    def walk(batches):
        found = rows(batches)
        while some := list(islice(found, LISTED_AT_ONCE)):
            paths, sizes = zip(*some)
            yield pa.RecordBatch.from_arrays([pa.array(paths), pa.array(sizes, pa.int64())], ["path", "size"])

    return walk


def _contents(at: str):
    """A map from (path, size) to the files' bytes."""

    def batch_of(held: list) -> pa.RecordBatch:
        paths, sizes, data = zip(*held)
        return pa.RecordBatch.from_arrays([pa.array(paths), pa.array(sizes, pa.int64()), pa.array(data, pa.binary())], ["path", "size", "content"])

    def read(batches):
        source, held, size = Folder(at), [], 0
        for batch in batches:
            for path, length in zip(*(c.to_pylist() for c in batch.columns)):
                with source.open(path) as file:
                    held.append((path, length, file.read()))
                size += len(held[-1][-1])
                if size >= READ_BYTES or len(held) == READ_FILES:
                    yield batch_of(held)
                    held, size = [], 0
        if held:
            yield batch_of(held)

    return read


def _address(spark: SparkSession, root: str) -> str | None:
    """Where the folder is, or null for a pattern, a file and what Arrow does not reach."""
    if GLOB.intersection(root):
        return None
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(root)
    at = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(hadoop).toUri().toASCIIString()
    try:
        source = Folder(at)
        return at if source.system.get_file_info(source.root or "/").type == fs.FileType.Directory else None
    except (OSError, pa.ArrowException):
        return None


def read_tree(spark: SparkSession, root: str, max_kb: int | None = None) -> DataFrame:
    """The rows of ``scan_corpus`` for trees of many files: tasks list the folders and deal out the files among them.

    A task lists one folder at a time, whole, and reads one file after the other; the driver knows no file. The tree is
    listed when the rows are asked for. Where Arrow does not reach the root, Spark's reader lists it in the driver.
    """
    at = _address(spark, root)
    if at is None:
        return scan_corpus(spark, root, max_kb)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    found = spark.range(0, 1, 1, 1).select(F.lit("").alias("path"), F.lit(None).cast("long").alias("size"))
    for deep in (False, True):
        found = found.mapInArrow(_listed(at, deep), "path string, size long").repartition(tasks, "path")
    if max_kb is not None:
        found = found.where(F.col("size") <= max(1, max_kb) * 1024)
    return found.mapInArrow(_contents(at), "path string, size long, content binary").select(
        "path", "size", F.make_valid_utf8(F.col("content").cast("string")).alias("content")
    )


def attach_files(spark: SparkSession, root: str, max_kb: int = 256) -> DataFrame:
    """Files small enough to attach, by name."""
    picked = read_tree(spark, root, max_kb)
    return picked.select(
        F.element_at(F.split("path", "/"), -1).alias("name"), "content", F.lit(False).alias("is_repository")
    )


# Fixed value: shape of one log line.
LOG_LINE = r"^(\S+) \[([A-Z]+)\] \[([^\]]*)\] (.*)\z"


def parse_logs(lines: DataFrame, value: str = "value") -> DataFrame:
    """Log lines as (ts, level, scope, message, details, record).

    ``record`` is the details as a VARIANT when they are JSON, else null.
    """
    line = F.col(value)
    rest = F.regexp_extract(line, LOG_LINE, 4)
    at = F.locate(" | ", rest)
    details = F.when(at > 0, F.substr(rest, at + F.lit(3)))
    kept = [c for c in lines.columns if c != value]
    return lines.where(line.rlike(LOG_LINE)).select(
        *kept,
        F.regexp_extract(line, LOG_LINE, 1).alias("ts"),
        F.regexp_extract(line, LOG_LINE, 2).alias("level"),
        F.regexp_extract(line, LOG_LINE, 3).alias("scope"),
        F.when(at > 0, F.left(rest, at - 1)).otherwise(rest).alias("message"),
        details.alias("details"),
        F.try_parse_json(details).alias("record"),
    )


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    return parse_logs(spark.read.text(path))

"""From files to a collection: select, chunk, enrich, embed, replace."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import files as ff
from corpusloom.functions.models import embed
from corpusloom.functions.text import java_symbols_at, keyword_entities
from corpusloom.operators.chunking import emit_chunks, line_spans, merge_small
from corpusloom.operators.filters import ObservedScan, keep_files, running_cap
from corpusloom.operators.metrics import index_summary, project_type
from corpusloom.options import ChunkBudgets, IndexOptions
from corpusloom.session import spread
from corpusloom.sources.collections import collection_exists, read_collection, replace_collection

EMBEDDED_FIELDS = (
    "path", "file_name", "extension", "folder", "language", "file_type",
    "class_name", "method_name", "project_type", "content",
)


def describe_files(files: DataFrame, project: DataFrame | str | None = None) -> DataFrame:
    """Name, folder, extension, language, file type and project type of each file.

    The project type comes from the files at the root of each workspace unless
    it is given.
    """
    keys = ["workspace"] if "workspace" in files.columns else []
    named = files.withColumn("file_name", ff.file_name(F.col("path")))
    if isinstance(project, str):
        typed = named.withColumn("project_type", F.lit(project))
    else:
        if project is None:
            roots = named.where(~F.contains(F.col("path"), F.lit("/"))).select(
                *(keys or [F.lit("").alias("workspace")]), F.col("file_name").alias("name")
            )
            project = project_type(roots)
        if keys:
            typed = named.join(project, keys, "left")
        else:
            typed = named.withColumn("project_type", project.agg(F.max("project_type")).scalar())
        typed = typed.withColumn("project_type", F.coalesce("project_type", F.lit("generic")))
    language = ff.language(F.col("file_name"))
    return typed.select(
        *files.columns,
        "file_name",
        ff.extension(F.col("file_name")).alias("extension"),
        ff.folder(F.col("path")).alias("folder"),
        language.alias("file_language"),
        ff.ecosystem_language(language, F.col("project_type")).alias("language"),
        ff.file_type(F.col("file_name")).alias("file_type"),
        "project_type",
    )


def enrich_file_dims(rows: DataFrame, dims: DataFrame) -> DataFrame:
    """Bring file attributes of an extension table (extension, language) to rows.

    Spark broadcasts the table when its size, which it knows, allows it.
    """
    return rows.join(dims, "extension", "left").withColumn("language", F.coalesce("language", F.lit("text")))


def collect_chunks(
    files: DataFrame,
    options: IndexOptions = IndexOptions(),
    project: DataFrame | str | None = None,
    merge: bool = False,
    chunker: Callable[[Column, ChunkBudgets], Column] = line_spans,
) -> DataFrame:
    """Chunk rows of a table of files (path, size, content); all of them unless ``options.max_chunks`` is set.

    ``chunker`` gives the spans (start, end) of a text under the budgets.
    """
    return _chunks_of(keep_files(files, options).select(*files.columns), options, project, merge, chunker)


def _chunks_of(kept: DataFrame, options: IndexOptions, project, merge: bool, chunker) -> DataFrame:
    cap = options.max_chunks
    spans = chunker(F.col("content"), options.budgets)
    if merge:
        spans = merge_small(spans, options.budgets)
    described = spread(describe_files(kept, project))
    cut = described.withColumn("_spans", spans)
    if cap is not None:
        counted = cut.select("path", F.size("_spans").alias("chunk_count"))
        cut = cut.join(running_cap(counted, cap).select("path"), "path", "left_semi")
    # Symbols look at the text before a chunk's end: found once in the whole
    # file, and in Java files only.
    body = F.when(F.col("file_language") == "java", F.col("content"))
    with_symbols = cut.withColumn("_symbols", java_symbols_at(body, F.transform("_spans", lambda s: s["end"])))
    rows = emit_chunks(with_symbols, F.col("_spans"), entities=False, spread_out=False)
    symbols = F.get(F.col("_symbols"), F.col("chunk_index"))
    return rows.select(
        ff.chunk_id(F.col("path"), F.col("chunk_index")).alias("id"),
        *(["workspace"] if "workspace" in kept.columns else []),
        "path", "file_name", "extension", "folder", "language", "file_type",
        F.coalesce(symbols["class_name"], F.lit("")).alias("class_name"),
        F.coalesce(symbols["method_name"], F.lit("")).alias("method_name"),
        "project_type", "chunk_index", "chunk_count", "chunk_start", "chunk_end",
        F.col("text").alias("content"),
        F.array_join(keyword_entities(F.col("text")), "|").alias("keyword_entities"),
    )


def join_embeddings(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Chunks with their vectors by id; a chunk without one is an error."""
    missing = chunks.select("id").join(vectors.select("id"), "id", "left_anti").limit(1).count()
    if missing:
        raise ValueError("embedding count mismatch: some chunks have no vector")
    return chunks.join(vectors.select("id", "embedding"), "id")


def embed_chunks(chunks: DataFrame, make_embed: Callable, batch_size: int = 32) -> DataFrame:
    text = ff.embedding_input(*[F.col(c) for c in EMBEDDED_FIELDS])
    embedded = embed(chunks.withColumn("_input", text), "_input", make_embed, batch_size, spread_out=False)
    return embedded.drop("_input")


def index_corpus(
    files: DataFrame,
    make_embed: Callable,
    path: str,
    collection_id: str,
    previous_id: str | None = None,
    options: IndexOptions = IndexOptions(),
    indexed_at_ms: int | None = None,
    project: DataFrame | str | None = None,
    chunker: Callable[[Column, ChunkBudgets], Column] = line_spans,
    write: Callable[..., None] = replace_collection,
    read: Callable[..., DataFrame] = read_collection,
) -> DataFrame | None:
    """Index files into a collection; the summary row, or None without chunks.

    Scan, filters and chunking are narrow; the embedding is the one step in
    Python and the write the one action over the data. ``chunker`` cuts the
    texts; ``write(rows, path, id, previous_id)`` and ``read(spark, path, id)``
    are the store.
    """
    spark = files.sparkSession
    if keep_files(files, options).isEmpty():  # a kept file has at least one chunk
        return None
    chunks = collect_chunks(files, options, project, chunker=chunker)
    write(embed_chunks(chunks, make_embed, options.embed_batch), path, collection_id, previous_id)
    return index_summary(read(spark, path, collection_id), indexed_at_ms)


def index_with_stats(
    files: DataFrame,
    make_embed: Callable,
    path: str,
    collection_id: str,
    previous_id: str | None = None,
    options: IndexOptions = IndexOptions(),
    indexed_at_ms: int | None = None,
    project: DataFrame | str | None = None,
    chunker: Callable[[Column, ChunkBudgets], Column] = line_spans,
) -> tuple[DataFrame | None, DataFrame]:
    """Index files and tell what the scan met: the summary row (None without chunks) and the row of ``scan_stats``.

    The statistics are counted by the very write that indexes (``ObservedScan``), so the texts are read once.
    """
    spark = files.sparkSession
    scan = ObservedScan(files, options)
    chunks = _chunks_of(scan.kept.select(*files.columns), options, project, False, chunker)
    replace_collection(embed_chunks(chunks, make_embed, options.embed_batch), path, collection_id, previous_id)
    if not collection_exists(spark, path, collection_id):  # no chunks
        return None, scan.stats(0).withColumn("indexed_chunks", F.lit(0).cast("long"))
    stored = read_collection(spark, path, collection_id)
    arrived = stored.select("path").distinct().count()  # a kept file has at least one chunk
    stats = scan.stats(arrived).withColumn("indexed_chunks", stored.agg(F.count("*")).scalar())
    return index_summary(stored, indexed_at_ms), stats

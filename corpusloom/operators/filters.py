"""Which files enter an index: dispositions, filters, caps and scan counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from corpusloom.functions import files as ff
from corpusloom.functions.text import is_blank
from corpusloom.operators.prefix import with_prefix_sums
from corpusloom.options import IndexOptions


def size_limit(max_kb: int) -> int:
    return max(1, max_kb) * 1024


def filter_size(df: DataFrame, max_kb: int = 512) -> DataFrame:
    return df.where(F.col("size") <= size_limit(max_kb))


def filter_empty(df: DataFrame) -> DataFrame:
    return df.where(~is_blank(F.col("content")))


def filter_binary(df: DataFrame, sample: int | None = None) -> DataFrame:
    return df.where(~ff.is_binary(F.col("content"), sample))


def filter_glob(df: DataFrame, globs) -> DataFrame:
    return df.where(~ff.matches_globs(F.col("path"), globs))


def filter_dirs(df: DataFrame, dirs) -> DataFrame:
    return df.where(~ff.in_ignored_dir(F.col("path"), dirs))


def disposition(options: IndexOptions) -> Column:
    """First failing test of a considered file; cheap tests come first."""
    content, path = F.col("content"), F.col("path")
    return (
        F.when(F.col("size") > size_limit(options.max_file_kb), F.lit("size"))
        .when(content.isNull(), F.lit("read_error"))
        .when(is_blank(content), F.lit("empty"))
        .when(ff.is_binary(content, options.binary_sample), F.lit("binary"))
        .when(ff.matches_globs(path, options.exclude_globs), F.lit("glob"))
        .otherwise(F.lit("kept"))
    )


def scan_disposition(df: DataFrame, options: IndexOptions = IndexOptions()) -> DataFrame:
    """Files outside ignored folders, each with its disposition."""
    return filter_dirs(df, options.exclude_dirs).withColumn("disposition", disposition(options))


def keep_files(df: DataFrame, options: IndexOptions = IndexOptions()) -> DataFrame:
    """Files that pass every test.

    Written as separate conditions and not as ``disposition = 'kept'``, so the
    size and path tests reach the scan on their own.
    """
    kept = filter_glob(filter_dirs(filter_size(df, options.max_file_kb), options.exclude_dirs), options.exclude_globs)
    return filter_binary(filter_empty(kept.where(F.col("content").isNotNull())), options.binary_sample)


def _counters() -> list[Column]:
    """Files of every disposition."""

    def counted(kind):
        return F.count_if(F.col("disposition") == kind)

    return [
        F.count("*").alias("considered_files"),
        counted("size").alias("skipped_by_size"),
        counted("empty").alias("skipped_empty"),
        counted("binary").alias("skipped_binary"),
        counted("glob").alias("skipped_by_glob"),
        counted("read_error").alias("read_errors"),
        counted("kept").alias("kept_files"),
    ]


def _with_walk(counters: DataFrame, files: DataFrame) -> DataFrame:
    """``counters`` with the folders and entries that a walk meets; reads the paths of ``files`` only."""
    parts = F.split("path", "/")
    folders = files.select(
        F.explode(
            F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
        ).alias("folder")
    ).distinct()
    return counters.withColumn("visited_directories", folders.agg(F.count("*")).scalar()).withColumn(
        "visited_entries", F.col("considered_files") + F.col("visited_directories") - 1
    )


def scan_stats(dispositions: DataFrame, chunks: DataFrame | None = None) -> DataFrame:
    """One row of counters over the files seen, all from partial sums.

    Folders and entries are those a walk meets: every folder above a file,
    and each file and folder once.
    """
    out = _with_walk(dispositions.agg(*_counters()), dispositions)
    if chunks is not None:
        out = out.withColumn("indexed_chunks", chunks.agg(F.count("*")).scalar())
    return out


class ObservedScan:
    """Scan statistics taken on the way, by the job that reads the files anyway.

    ``kept`` are the files to go on with. After one action over it, ``stats`` gives the row of ``scan_stats``
    without a second look at the texts; the folders come from the paths alone. Spark may count tasks twice that it
    runs again after the loss of an executor, so the caller says how many kept files have arrived: if the counters
    say otherwise, the files are counted once more.
    """

    def __init__(self, files: DataFrame, options: IndexOptions = IndexOptions()):
        self.seen = scan_disposition(files, options)
        self.observed = Observation()
        self.kept = self.seen.observe(self.observed, *_counters()).where("disposition = 'kept'").drop("disposition")

    def stats(self, kept_files: int) -> DataFrame:
        found = self.observed.get
        if found.get("kept_files") != kept_files:
            return scan_stats(self.seen)
        names = list(found)
        row = self.seen.sparkSession.createDataFrame([tuple(found[n] for n in names)], ", ".join(f"{n} long" for n in names))
        return _with_walk(row, self.seen.select("path"))


def error_samples(dispositions: DataFrame, reason: Column, failed: Column, n: int = 12) -> DataFrame:
    """The first ``n`` failures by path: a distributed top-n."""
    return dispositions.where(failed).select("path", reason.alias("reason")).orderBy("path").limit(n)


def running_cap(files: DataFrame, cap: int, count: str = "chunk_count", order: str = "path") -> DataFrame:
    """Files in path order until the chunks before them reach ``cap``.

    The file that crosses the cap is kept whole. Running sums go by ranges of
    the path, whatever the cap.
    """
    cap = max(1, cap)
    counted = files.where(F.col(count) > 0)
    summed = with_prefix_sums(counted, [order], {"_upto": F.col(count)})
    return (
        summed.withColumn("chunks_before", F.col("_upto") - F.col(count))
        .where(F.col("chunks_before") < cap)
        .drop("_upto")
    )


def path_filter(paths: DataFrame, column: str = "path") -> DataFrame:
    """Usable paths of a filter list, distinct, entries that must be ignored removed."""
    return (
        paths.withColumn(column, ff.normalise_path(F.col(column))).where(F.col(column).isNotNull()).distinct()
    )


def path_in_filter(chunks: DataFrame, paths: DataFrame) -> DataFrame:
    """Chunks of the listed paths; an empty list means no filter."""
    wanted = path_filter(paths.select("path"))
    if wanted.isEmpty():
        return chunks
    return chunks.join(wanted, "path", "left_semi")


def valid_records(df: DataFrame) -> DataFrame:
    return df.where(F.col("content").isNotNull() & (F.size("embedding") > 0))


def nonblank_queries(queries: DataFrame, column: str = "text") -> DataFrame:
    return queries.where(~is_blank(F.col(column)))


# Limits on incoming payloads.
MAX_NAME, MAX_FILE, MAX_PROMPT, MAX_CODE = 1024, 2_000_000, 100_000, 1_000_000


# Payload types that carry nothing to check.
PLAIN_TYPES = (
    "webviewReady", "stopGeneration", "startServer", "stopServer", "startEmbeddingsServer",
    "stopEmbeddingsServer", "openFilePicker", "requestSessionsUpdate", "requestActiveEditorRefresh", "indexAll",
)


def validate_payload(df: DataFrame, prompt_type: str = "ask", sections: tuple[str, ...] = ()) -> DataFrame:
    """Mark each payload row (type, value, attached_files and, optionally, flags) valid or say why not.

    ``prompt_type`` is the client's name for a payload with a prompt.
    ``flags`` maps the names of boolean fields to their text in the payload;
    ``sections`` are those that a payload with the state of the settings has.
    Attachments may have ``is_automatic`` and ``is_repository`` as text.
    """
    value, files = F.col("value"), F.col("attached_files")
    flags = F.col("flags") if "flags" in df.columns else F.lit(None).cast("map<string,string>")
    fields = df.schema["attached_files"].dataType.elementType.names

    def is_flag(text):
        return F.coalesce(text.isin("true", "false"), F.lit(False))

    def bad_file(f):
        name, content = f["name"], f["content"]
        bad = (
            name.isNull() | content.isNull() | (F.length(name) < 1) | (F.length(name) > MAX_NAME)
            | (F.length(content) > MAX_FILE)
        )
        for field in {"is_automatic", "is_repository"} & set(fields):
            bad = bad | (f[field].isNotNull() & ~is_flag(f[field].cast("string")))
        return bad

    state = F.lit(True)
    for name in sections:
        state = state & is_flag(flags[name])

    kind = F.col("type")
    reason = (
        F.when(kind.isNull(), F.lit("no type"))
        .when(kind.isin(*PLAIN_TYPES), F.lit(None))
        .when(
            kind == "setActiveTab",
            F.when(F.coalesce(value.isin("chat", "settings"), F.lit(False)), F.lit(None)).otherwise(F.lit("bad tab")),
        )
        .when(
            kind == "deleteSession",
            F.when(F.coalesce(F.length(value) > 0, F.lit(False)), F.lit(None)).otherwise(F.lit("no session")),
        )
        .when(kind == "selectSession", F.lit(None))
        .when(kind == "setRagEnabled", F.when(~is_flag(flags["rag_enabled"]), F.lit("bad flag")))
        .when(kind == "setSettingsAccordionState", F.when(~state, F.lit("bad flag")))
        .when(
            kind == "applyCode",
            F.when(value.isNull() | (F.length(value) > MAX_CODE), F.lit("bad code")).otherwise(F.lit(None)),
        )
        .when(
            kind == prompt_type,
            F.when(F.exists(F.coalesce(files, F.array()), bad_file), F.lit("bad attachment")).when(
                value.isNull() | (F.length(value) > MAX_PROMPT), F.lit("bad prompt")
            ).when(flags["rag_enabled"].isNotNull() & ~is_flag(flags["rag_enabled"]), F.lit("bad flag")),
        )
        .otherwise(F.lit("unknown type"))
    )
    return df.withColumn("reject_reason", reason).withColumn("valid", F.col("reject_reason").isNull())

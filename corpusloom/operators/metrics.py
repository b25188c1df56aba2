"""Counters and summaries: requests, snapshots, idle sessions, projects, indexes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.files import PROJECT_MARKERS
from corpusloom.operators.prefix import in_ranges, range_starts, with_prefix_sums


def request_metrics(requests: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Requests, errors and the rounded mean duration."""
    return requests.groupBy(*(by or [])).agg(
        F.count("*").alias("requests"),
        F.count_if("is_error").alias("errors"),
        F.round(F.avg("duration_ms")).cast("long").alias("avg_ms"),
    )


def metrics_snapshots(requests: DataFrame, order: list[str], every: int = 10) -> DataFrame:
    """Running counts and mean at every ``every``-th request of one global order."""
    summed = with_prefix_sums(
        requests.select(*order, "duration_ms", "is_error"),
        order,
        {
            "requests": F.lit(1).cast("long"),
            "errors": F.col("is_error").cast("long"),
            "_total": F.col("duration_ms"),
        },
    )
    return summed.where(F.col("requests") % every == 0).select(
        "requests", "errors", F.round(F.col("_total") / F.col("requests")).cast("long").alias("avg_ms")
    )


def idle_requests(
    events: DataFrame, gap: str = "10 seconds", key: str = "user_id", ts: str = "ts", slice_by: str = "hour"
) -> DataFrame:
    """Stretches of activity per key that end after more than ``gap`` of silence.

    First within time slices, so that one busy key is many groups. The
    slice-level stretches then lie in ranges of (key, time), so that a busy key
    may have many ranges; the last stretch of a range tells the next one
    whether its first goes on.
    """
    part = (
        events.groupBy(key, F.date_trunc(slice_by, F.col(ts)).alias("_slice"), F.session_window(ts, gap).alias("w"))
        .agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count("*").alias("events"))
        .drop("w", "_slice")
    )
    ranged = in_ranges(part, [key, "first_ts"])
    # one row per range from here to the join
    edges = ranged.groupBy("_range").agg(F.max(F.struct(F.col(key).alias("k"), F.col("first_ts").alias("f"), F.col("last_ts").alias("l"))).alias("_end"))
    edges = edges.select("_range", F.lag("_end").over(Window.orderBy("_range")).alias("_end"))
    inside = Window.partitionBy("_range").orderBy(key, "first_ts")
    joined = ranged.join(F.broadcast(edges), "_range")
    before = F.coalesce(F.lag(F.struct(F.col(key).alias("k"), F.col("last_ts").alias("l"))).over(inside), F.struct("_end.k", "_end.l"))
    goes_on = F.col("_before.k").eqNullSafe(F.col(key)) & (F.col("first_ts") <= F.col("_before.l") + F.expr(f"INTERVAL {gap}"))
    opened = joined.withColumn("_before", before).withColumn("_new", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1))
    opened = opened.withColumn("_inside", F.sum("_new").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    # a session that goes on in the next range keeps its number: sums of what the ranges before opened
    starts = range_starts(opened.groupBy("_range").agg(F.sum("_new").alias("_base")), ["_base"])
    return (
        opened.join(starts, "_range").withColumn("_session", F.col("_inside") + F.col("_base"))
        .groupBy(key, "_session")
        .agg(F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"), F.sum("events").alias("events"))
        .drop("_session")
    )


def project_type(listing: DataFrame) -> DataFrame:
    """Project type per workspace from marker files (workspace, name) at its root."""
    found = [
        F.when(F.bool_or(F.col("name").isin(*names)), F.lit(kind)) for kind, names in PROJECT_MARKERS
    ]
    return listing.groupBy("workspace").agg(F.coalesce(*found, F.lit("generic")).alias("project_type"))


def index_summary(chunks: DataFrame, indexed_at_ms: int | None = None) -> DataFrame:
    """Status, number of chunks and time per collection; nothing for no chunks."""
    at = F.lit(indexed_at_ms).cast("long") if indexed_at_ms is not None else F.unix_millis(F.current_timestamp())
    return (
        chunks.groupBy("collection_id")
        .agg(F.count("*").alias("indexed_files"))
        .select("collection_id", F.lit("indexed").alias("status"), "indexed_files", at.alias("indexed_at"))
    )


def unique_files(chunks: DataFrame, approximate: bool = False) -> DataFrame:
    count = F.approx_count_distinct("path") if approximate else F.count_distinct("path")
    return chunks.agg(count.alias("unique_files"))


def chunks_per_file(chunks: DataFrame) -> DataFrame:
    """Each chunk with its file's chunk count, from a partial count joined back."""
    counts = chunks.groupBy("path").agg(F.count("*").alias("chunks_in_file"))
    return chunks.join(counts, "path")


def batch_number(rows: DataFrame, size: int, order: list[str]) -> DataFrame:
    """1-based batch of each row in one global order, and the number of batches."""
    numbered = with_prefix_sums(rows, order, {"_n": F.lit(1).cast("long")})
    total = rows.agg(F.ceil(F.count("*") / size).cast("long"))
    return (
        numbered.withColumn("batch", (F.floor((F.col("_n") - 1) / size) + 1).cast("long"))
        .withColumn("batches", total.scalar())
        .drop("_n")
    )


def agent_totals(steps: DataFrame) -> DataFrame:
    """Tool calls, matches and tokens over the steps of a conversation."""
    return steps.groupBy("conv_id").agg(
        F.sum(F.col("is_call").cast("long")).alias("tool_calls"),
        F.sum("matches").alias("retrieved_matches"),
        F.sum("tokens").alias("tokens"),
        F.sum("server_tokens").alias("server_tokens"),
    )


def references(hits: DataFrame, key: str = "conv_id", path: str = "path") -> DataFrame:
    """Sorted distinct hit labels per conversation.

    Distinct first, so a label that is hit again and again is gathered once; an
    agent run has at most rounds times matches of them.
    """
    return hits.select(key, path).distinct().groupBy(key).agg(F.array_sort(F.collect_list(path)).alias("references"))

"""Structured Streaming jobs. Each has a batch twin with the same result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from corpusloom.functions.text import session_title
from corpusloom.sources.replies import decode_replies, reply_parts
from corpusloom.streaming.live import NO_DATA, SESSION_ROW, live_sessions, rocksdb

EPOCH = "_epoch"


def stream_decode(lines: DataFrame, value: str = "value") -> DataFrame:
    """Fragments of an unbounded source of reply lines; stateless."""
    return decode_replies(lines, value)


def stream_replies(fragments: DataFrame, key: str = "request_id", seq: str = "seq") -> DataFrame:
    """Running text of every reply part, for update mode.

    State is one bounded list per part, ordered by sequence number on output,
    so the arrival order of fragments does not matter.
    """
    return reply_parts(fragments, key, seq)


def stream_finished_replies(
    fragments: DataFrame, ts: str = "ts", idle: str = "10 seconds", late: str = "1 minute", key: str = "request_id",
    seq: str = "seq",
) -> DataFrame:
    """Replies that have been silent for ``idle``, for append mode.

    The watermark lets go of the state of finished replies, so this form can
    run for as long as there are requests.
    """
    timed = _event_time(fragments, ts).withWatermark(ts, late)
    return reply_parts(timed, key, seq, F.session_window(ts, idle).alias("w"))


def _event_time(stream: DataFrame, ts: str) -> DataFrame:
    """Event times need a time zone; those without one are taken in the session's."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp"))


def stream_metrics(requests: DataFrame, ts: str = "ts", size: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Requests, errors and summed duration per time window, for update mode."""
    return (
        _event_time(requests, ts).withWatermark(ts, late)
        .groupBy(F.window(ts, size).alias("w"))
        .agg(
            F.count("*").alias("requests"),
            F.count_if("is_error").alias("errors"),
            F.round(F.avg("duration_ms")).cast("long").alias("avg_ms"),
        )
        .select(F.col("w.start").alias("window_start"), "requests", "errors", "avg_ms")
    )


def stream_idle(events: DataFrame, gap: str = "10 seconds", key: str = "user_id", ts: str = "ts", late: str = "1 minute"):
    """Finished stretches of activity per key, for append mode."""
    return (
        _event_time(events, ts).withWatermark(ts, late)
        .groupBy(key, F.session_window(ts, gap).alias("w"))
        .agg(F.count("*").alias("events"))
        .select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")
    )


def write_epochs(stream: DataFrame, path: str, checkpoint: str, mode: str = "update", once: bool = True):
    """Write each micro-batch to its own folder, so a repeated one replaces itself."""

    def put(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/{EPOCH}={epoch}")

    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(put)
    return (writer.trigger(availableNow=True) if once else writer).start()


def latest(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The newest version of every key of an update stream.

    A partial aggregate: no window, and old versions do not leave their task.
    """
    log = spark.read.parquet(path)
    rest = [c for c in log.columns if c not in keys and c != EPOCH]
    return log.groupBy(*keys).agg(F.max_by(F.struct(*rest), EPOCH).alias("_v")).select(
        *keys, *[F.col(f"_v.{c}").alias(c) for c in rest]
    )


# Changes of this many micro-batches are read beside a snapshot before the next one is made.
COMPACT_EVERY = 16
CHANGE = f"session_id {{}}, {SESSION_ROW}"


def stream_sessions(
    messages: DataFrame, path: str, checkpoint: str, once: bool = True, compact_every: int = COMPACT_EVERY, trace: str = "30 days"
):
    """Keep the living sessions of a stream of (session_id, turn, role, text, ts, deleted).

    A row with ``deleted`` ends its session. State is one row for each living session, the log holds one row for
    each session that a micro-batch changed. Every ``compact_every`` micro-batches a snapshot of the living
    sessions begins a new generation of the log, and ``sessions_of`` reads the newest generation only.
    """
    kind = messages.schema["session_id"].dataType.simpleString()
    changes = live_sessions(messages, session_title, trace)

    def put(batch: DataFrame, epoch: int) -> None:
        spark, generation = batch.sparkSession, epoch // compact_every
        batch.write.mode("overwrite").parquet(f"{path}/generation={generation}/changes/{EPOCH}={epoch}")
        # a repeated micro-batch finds its snapshot made: readers may be at it
        if (epoch + 1) % compact_every == 0 and _generation(spark, path) <= generation:
            following = f"{path}/generation={generation + 1}"
            _living(spark, path, generation, kind).write.mode("overwrite").parquet(f"{following}/snapshot")
            batch.limit(0).write.mode("overwrite").parquet(f"{following}/changes/{EPOCH}={epoch}")
            spark.range(1).write.mode("overwrite").parquet(f"{path}/current/generation={generation + 1}")

    writer = changes.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(put)
    # a time to live runs by the clock, for which Spark would go on with empty micro-batches
    with rocksdb(messages.sparkSession, **{NO_DATA: "false"}):
        return (writer.trigger(availableNow=True) if once else writer).start()


def _generation(spark: SparkSession, path: str) -> int:
    """The newest generation whose snapshot is complete; 0 has none."""
    try:
        return spark.read.parquet(f"{path}/current").agg(F.max("generation")).first()[0] or 0
    except AnalysisException:
        return 0


def _living(spark: SparkSession, path: str, generation: int, kind: str | None = None) -> DataFrame:
    """The newest state of every session of a generation that is not deleted."""
    reader = spark.read if kind is None else spark.read.schema(CHANGE.format(kind) + f", {EPOCH} long")
    rows = reader.parquet(f"{path}/generation={generation}/changes")
    rows = rows.withColumn(EPOCH, F.col(EPOCH).cast("long"))
    if generation:
        snapshot = spark.read.parquet(f"{path}/generation={generation}/snapshot")
        rows = rows.unionByName(snapshot.withColumn(EPOCH, F.lit(-1).cast("long")))
    names = [c for c in rows.columns if c not in ("session_id", EPOCH)]
    newest = rows.groupBy("session_id").agg(F.max_by(F.struct(*names), EPOCH).alias("v"))
    return newest.where("not v.deleted").select("session_id", "v.*")


def sessions_of(spark: SparkSession, path: str) -> DataFrame:
    """One row per living session: title from its first message, size, age."""
    return _living(spark, path, _generation(spark, path)).select("session_id", "title", "messages", "created_at")

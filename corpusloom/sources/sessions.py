"""Session stores: the JSON documents of a client and the table kept by Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.settings import message_files, message_text
from corpusloom.functions.text import relative_time, session_title

SESSION = "struct<id:string,title:string,createdAt:bigint,messages:array<struct<role:string,content:variant>>>"


def parse_sessions(stores: DataFrame, value: str = "value") -> DataFrame:
    """Messages of session stores in either layout.

    A store is a bare array of sessions (older) or an object with a
    ``sessions`` field. One row per message; a session without messages has
    one row with null turn.
    """
    kept = [c for c in stores.columns if c != value]
    record = F.try_parse_json(F.col(value))
    is_list = F.startswith(F.schema_of_variant(record), F.lit("ARRAY"))
    listed = F.when(is_list, record).otherwise(F.try_variant_get(record, "$.sessions", "variant"))
    sessions = stores.select(
        *kept, F.posexplode(F.from_json(F.to_json(listed), f"array<{SESSION}>")).alias("insert_seq", "s")
    )
    return sessions.select(*kept, "insert_seq", "s", F.posexplode_outer("s.messages").alias("turn", "m")).select(
        *kept,
        "insert_seq",
        F.col("s.id").alias("session_id"),
        F.col("s.title").alias("title"),
        F.col("s.createdAt").alias("created_at"),
        "turn",
        F.col("m.role").alias("role"),
        message_text(F.col("m.content")).alias("text"),
        message_files(F.col("m.content")).alias("files"),
    )


def read_session_stores(spark: SparkSession, path: str) -> DataFrame:
    """Session stores kept as one JSON document per file."""
    return parse_sessions(spark.read.text(path, wholetext=True))


def write_sessions(messages: DataFrame, path: str, created_at: str = "created_at") -> None:
    """Replace the days that occur in ``messages`` (session rows, one per message).

    Kept as message rows, never as one array per session, so a long session is
    no larger a unit than a short one.
    """
    day = F.to_date(F.timestamp_millis(F.col(created_at)))
    (
        messages.withColumn("created_on", day)
        .hint("rebalance", F.col("created_on"))  # few files per day, a busy day split by size
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("created_on")
        .parquet(path)
    )


def read_sessions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def list_sessions(sessions: DataFrame, now_ms) -> DataFrame:
    """Newest inserted first, with title and age. A global sort, range-partitioned."""
    now = now_ms if not isinstance(now_ms, int) else F.lit(now_ms)
    return sessions.select(
        "session_id",
        "insert_seq",
        session_title(F.col("first_text")).alias("title"),
        relative_time(F.col("created_at"), now).alias("age"),
    ).orderBy(F.desc("insert_seq"))

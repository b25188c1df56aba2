"""Streamed replies: ``data:`` lines into fragments, fragments into replies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import js_trim
from corpusloom.functions.tokens import reply_tokens
from corpusloom.schemas import REPLY_FRAGMENT

DONE = "[DONE]"
# Fragments of one reply are put together in parts of this many sequence numbers.
PART_SPAN = 65_536


def decode_marked(lines: DataFrame, value: str = "value") -> DataFrame:
    """Fragments of reply lines: token, usage, whether the JSON was bad, whether the line is an end mark.

    Blank lines and lines without the prefix carry nothing and are left out. Works the same on a stream.
    """
    clean = js_trim(F.col(value))
    payload = js_trim(F.substr(clean, F.lit(6)))
    kept = [c for c in lines.columns if c != value]
    is_end = payload == DONE
    parsed = lines.where(F.startswith(clean, F.lit("data:"))).select(
        *kept, is_end.alias("is_end"),
        F.when(~is_end, F.from_json(payload, REPLY_FRAGMENT, {"columnNameOfCorruptRecord": "_corrupt_record"})).alias("p"),
    )
    choice = F.get(F.col("p.choices"), F.lit(0))
    return parsed.select(
        *kept,
        F.coalesce(choice["delta"]["content"], choice["text"], F.lit("")).alias("token"),
        F.coalesce(F.col("p.usage.completion_tokens"), F.lit(0)).alias("usage"),
        F.col("p._corrupt_record").isNotNull().alias("is_bad"),
        "is_end",
    )


def decode_replies(lines: DataFrame, value: str = "value") -> DataFrame:
    """Fragments of reply lines without the end marks, which carry nothing themselves."""
    return decode_marked(lines, value).where(~F.col("is_end")).drop("is_end")


def until_done(lines: DataFrame, batch: list[str], seq: str = "seq", value: str = "value") -> DataFrame:
    """Drop the lines that follow an end mark inside the same read batch."""
    clean = js_trim(F.col(value))
    ends = lines.where(
        F.startswith(clean, F.lit("data:")) & (js_trim(F.substr(clean, F.lit(6))) == DONE)
    ).groupBy(*batch).agg(F.min(seq).alias("_end"))
    return lines.join(ends, batch, "left").where(F.col("_end").isNull() | (F.col(seq) < F.col("_end"))).drop("_end")


def read_reply_lines(spark: SparkSession, path: str) -> DataFrame:
    return decode_replies(spark.read.text(path))


def reply_parts(fragments: DataFrame, key: str = "request_id", seq: str = "seq", *more) -> DataFrame:
    """Text of each reply part in fragment order, with its characters and usage.

    A part covers a fixed range of sequence numbers, so no group grows with
    the length of a reply. Valid as a streaming aggregate too. Fragments with
    ``is_end`` (``decode_marked``) are cut at the end mark, of which ``end_seq``
    tells the place, and a repeated fragment counts once.
    """
    used = F.col("usage") > 0
    grouped = fragments.groupBy(key, F.floor(F.col(seq) / PART_SPAN).cast("long").alias("part"), *more)
    if "is_end" not in fragments.columns:
        return grouped.agg(
            F.array_join(
                F.transform(
                    F.array_sort(F.collect_list(F.when(F.col("token") != "", F.struct(seq, "token")))),
                    lambda x: x["token"],
                ),
                "",
            ).alias("text"),
            F.sum(F.length("token")).alias("part_chars"),
            F.max(F.when(used, F.struct(F.col(seq).alias("seq"), F.col("usage").alias("usage")))).alias("last_usage"),
        )
    said = F.when((F.col("token") != "") | used, F.struct(F.col(seq).alias("seq"), "token", "usage"))
    ends = grouped.agg(F.array_sort(F.collect_set(said)).alias("said"), F.min(F.when(F.col("is_end"), F.col(seq))).alias("end_seq"))
    cut = ends.withColumn("said", F.filter("said", lambda x: F.col("end_seq").isNull() | (x["seq"] < F.col("end_seq"))))
    text = F.array_join(F.transform("said", lambda x: x["token"]), "")
    last = F.array_max(F.transform(F.filter("said", lambda x: x["usage"] > 0), lambda x: F.struct(x["seq"].alias("seq"), x["usage"].alias("usage"))))
    return cut.withColumn("text", text).select(
        key, "part", *[c for c in cut.columns if c not in (key, "part", "said", "end_seq", "text")], "text",
        F.length("text").cast("long").alias("part_chars"), last.alias("last_usage"), "end_seq",
    )


def finish_replies(parts: DataFrame, key: str = "request_id") -> DataFrame:
    """Reply parts with the totals of their reply: characters, usage, tokens.

    Parts behind the one with the end mark are no part of the reply.
    """
    if "end_seq" in parts.columns:
        ended = F.min(F.when(F.col("end_seq").isNotNull(), F.col("part"))).over(Window.partitionBy(key))  # a row a part
        parts = parts.withColumn("_last", ended).where(F.col("_last").isNull() | (F.col("part") <= F.col("_last")))
    totals = parts.groupBy(key).agg(
        F.sum("part_chars").alias("chars"),
        F.coalesce(F.max("last_usage")["usage"], F.lit(0)).alias("server_tokens"),
    )
    return (
        parts.select(key, "part", "text")
        .join(totals, key)
        .withColumn("tokens", reply_tokens(F.col("server_tokens"), F.col("chars")))
    )


def assemble_replies(fragments: DataFrame, key: str = "request_id", seq: str = "seq") -> DataFrame:
    """Replies as ordered parts (almost always one) with their totals; fragments with ``is_end`` end at the mark."""
    return finish_replies(reply_parts(fragments, key, seq), key)

"""Exact duplicates by progressive refinement: length, then prefix hash, then full hash.

Every step looks only at what the step before left over. A text alone in its length, or alone with its
prefix, is never hashed in full.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import ascii_lower, free_name, maybe_in, two_columns
from corpusloom.session import checkpoint

PREFIX_CHARS = 256


def _keys(rows: DataFrame, prefix: int) -> DataFrame:
    return rows.withColumns({
        "length": F.octet_length("text"),
        "head": F.xxhash64(ascii_lower(F.substring("text", 1, prefix))),
    })


def _surviving(narrow: DataFrame) -> DataFrame:
    """(length, head) of groups of at least two rows. Partial counts merge copies before the shuffle."""
    lengths = narrow.groupBy("length").count().where("count > 1").select("length")
    alike = narrow.join(lengths, "length", "left_semi")
    return alike.groupBy("length", "head").count().where("count > 1").select("length", "head")


def _groups(docs: DataFrame, id_col: str, text_col: str, prefix: int):
    rows = _keys(two_columns(docs, id_col, text_col), prefix)
    narrow = checkpoint(rows.select("row", "doc_id", "length", "head"), "exact-keys")
    groups = checkpoint(_surviving(narrow), "exact-heads")
    full = checkpoint(
        maybe_in(rows, groups, "length", "head").where("maybe")
        .select("row", "doc_id", "length", "head", "text")
        .join(groups, ["length", "head"], "left_semi")
        .select("row", "doc_id", F.sha2(ascii_lower(F.col("text")), 256).alias("full_hash")),
        "exact-full",
    )
    best = full.groupBy("full_hash").agg(
        F.max(F.struct("doc_id", "row")).alias("best"), F.count("*").alias("group_size")
    ).where("group_size > 1")
    copies = full.join(best, "full_hash").select(
        "row", F.col("best.doc_id").alias("keep_id"), F.col("best.row").alias("keep_row"), "group_size", "full_hash"
    )
    return narrow, groups, copies


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: int = PREFIX_CHARS) -> DataFrame:
    """One row per row of ``docs``: row, doc_id, keep_id, group_size, kept.

    Texts are equal when they are identical after lower-casing A-Z; a null text is an empty one. Of equal
    texts the row with the largest doc_id stays (a null id is the smallest); of rows that repeat that id
    too, the one read last. Empty tables give no rows; other columns are ignored.
    """
    narrow, _, copies = _groups(docs, id_col, text_col, prefix)
    return narrow.join(copies, "row", "left").select(
        "row", "doc_id",
        F.when(F.col("keep_row").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("keep_row") == F.col("row"), F.lit(True)).alias("kept"),
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: int = PREFIX_CHARS) -> DataFrame:
    """The rows of ``docs`` that ``exact_dedup`` keeps, with all their columns.

    Rows of no surviving group stay where they are; only the others are shuffled to be compared.
    """
    _, groups, copies = _groups(docs, id_col, text_col, prefix)
    names = docs.columns
    row, text = free_name(docs, "__row"), free_name(docs, "__text")
    dropped = copies.where("row <> keep_row").select(F.col("row").alias(row))
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("doc"), F.monotonically_increasing_id().alias(row))
    keyed = packed.withColumn("text", F.coalesce(F.col(f"doc.`{text_col}`"), F.lit("")))
    flagged = maybe_in(_keys(keyed, prefix), groups, "length", "head")
    alone = flagged.where("not maybe").select("doc.*")
    judged = flagged.where("maybe").select(row, "doc").join(dropped, row, "left_anti").select("doc.*")
    return alone.unionByName(judged)

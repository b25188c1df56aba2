"""What several operators share: row numbers, free names, spreading, ASCII lower case."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def quoted(name: str) -> str:
    return f"`{name.replace('`', '``')}`"


def free_name(df: DataFrame, name: str) -> str:
    """A column name that the frame does not have yet, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def two_columns(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, doc_id, text) of a table: other columns cannot clash, null texts are empty.

    ``row`` tells repeated rows apart. It is the position in the scan, so ``docs`` has to be a table or
    another plan that returns its rows alike when read again.
    """
    return docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(quoted(id_col)).alias("doc_id"),
        F.coalesce(F.col(quoted(text_col)), F.lit("")).alias("text"),
    )


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else; the fast path holds where every character is ASCII."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def crc_mod(id_col: Column, k: int) -> Column:
    """crc32 of an id as text, modulo k; a null id counts as the empty string."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % k


def size_of(df: DataFrame) -> int:
    """Partitions for a step that shuffles: what the session is set to."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


#: Bits of the filter that keeps rows without a partner out of a shuffle: 128 maps of 4 KB, whatever the input.
FILTER_BITS = 1 << 22
MAP_BITS = 32768


def maybe_in(rows: DataFrame, members: DataFrame, *key: str) -> DataFrame:
    """``rows`` with ``maybe``: false only where no row of ``members`` has the same key.

    A one-hash Bloom filter of fixed size. With more members than bits it lets more rows through; the join
    that follows decides.
    """
    bit = F.pmod(F.xxhash64(*key), F.lit(FILTER_BITS))
    maps = (
        members.select(bit.alias("bit"))
        .groupBy((F.col("bit") / MAP_BITS).cast("long").alias("map_no"))
        .agg(F.expr(f"bitmap_construct_agg(bit % {MAP_BITS})").alias("bits"))
    )
    at = F.col("bit_no") % MAP_BITS
    byte = F.conv(F.hex(F.substring(F.col("bits"), (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return (
        rows.withColumn("bit_no", bit)
        .withColumn("map_no", (F.col("bit_no") / MAP_BITS).cast("long"))
        .join(F.broadcast(maps), "map_no", "left")  # at most FILTER_BITS / MAP_BITS rows of 4 KB
        .withColumn("maybe", F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False)))
        .drop("bit_no", "map_no", "bits")
    )

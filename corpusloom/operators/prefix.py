"""Running sums over one global order, without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.session import checkpoint

#: Rows of a range at most, as far as Spark's sample of the order is even.
RANGE_ROWS = 200_000
#: Ranges whose totals are summed in one task; the totals of such blocks are summed in another.
BLOCK_RANGES = 1_024


def range_count(df: DataFrame) -> int:
    """Ranges for a written table: from its rows, and no fewer than the session's shuffle partitions."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // RANGE_ROWS))


def in_ranges(df: DataFrame, order: list[str], partitions: int | None = None) -> DataFrame:
    """``df`` in ranges of ``order``, written to the shared folder, with the number of the range as ``_range``.

    The rows are written before they are dealt, so that counting them and sampling their order reads files instead
    of computing ``df`` again.
    """
    written = df
    if partitions is None:
        written = checkpoint(df)
        partitions = range_count(written)
    return checkpoint(written.repartitionByRange(partitions, *order).withColumn("_range", F.spark_partition_id()))


def range_starts(totals: DataFrame, names: list[str]) -> DataFrame:
    """(_range, *names): for every range the sums of ``names`` over all ranges before it.

    In two levels: ranges within a block, and blocks. The one task that sees all blocks has a row for each of them.
    """
    blocked = totals.withColumn("_block", F.floor(F.col("_range") / BLOCK_RANGES))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    inside = before(Window.partitionBy("_block").orderBy("_range"))
    blocks = blocked.groupBy("_block").agg(*[F.sum(n).alias(n) for n in names]).select(
        "_block", *[F.sum(n).over(before(Window.orderBy("_block"))).alias(f"_b_{n}") for n in names]
    )
    within = blocked.select("_range", "_block", *[F.sum(n).over(inside).alias(n) for n in names])
    return within.join(blocks, "_block").select(
        "_range", *[(F.coalesce(n, F.lit(0)) + F.coalesce(f"_b_{n}", F.lit(0))).alias(n) for n in names]
    )


def with_prefix_sums(
    df: DataFrame, order: list[str], sums: dict[str, Column], partitions: int | None = None
) -> DataFrame:
    """Add inclusive running sums of ``sums`` in the order of ``order``.

    ``order`` must be unique per row. Rows are split into ranges of that order
    and kept in the shared folder, so that a retried task sees the same ranges;
    one total per range gives each range its starting value (``range_starts``),
    and only then is each range summed by itself.
    """
    ranged = in_ranges(df.select("*", *[v.alias(f"_v_{k}") for k, v in sums.items()]), order, partitions)
    totals = ranged.groupBy("_range").agg(*[F.sum(f"_v_{k}").alias(f"_s_{k}") for k in sums])
    starts = range_starts(totals, [f"_s_{k}" for k in sums])
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    # the window deals rows by range in any case, so a join by range adds no shuffle where it is no broadcast
    return ranged.join(starts, "_range").select(
        *df.columns, *[(F.sum(f"_v_{k}").over(inside) + F.col(f"_s_{k}")).alias(k) for k in sums]
    )

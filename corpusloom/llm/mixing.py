"""Mixing sources to target weights by Pfair scheduling.

The rows of a source are dealt into blocks. While it has rows, a source is due ``weight`` blocks of every
slot; block j of it may not start before the slot in which its ideal share passes j - 1 (release) and must
be placed by the slot in which it passes j (deadline). Earliest deadline first over the released blocks
meets every deadline, so after any number of slots a source is less than one block off its ideal share.
When a source is used up, its share goes to the others in proportion to their weights; no row is dropped
and none is repeated.

Two levels keep the schedule small at any size. At most ``max_blocks`` coarse blocks (and one more for each
source) are scheduled over the whole corpus. The order of the sources in a window of ``WINDOW`` coarse slots
is then repeated on blocks of ``fine_rows`` rows until the window's rows are placed, so that sources also
alternate within a coarse block. At the ends of windows a source is less than one coarse block off; inside,
less than two fine blocks more. Only in a window in which a source runs out its last rows are spread over
the whole window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import free_name
from corpusloom.session import checkpoint

MAX_BLOCKS = 4096
WINDOW = 64
FINE_ROWS = 4
#: Rows that one ranking window holds on average; a source has as many as it needs.
BUCKET_ROWS = 4_000
EPS = 1e-9


def _edf(windows: Column, slots: Column) -> Column:
    """Source index for each slot: earliest deadline first over arrays of (r, d), one array for each source."""

    def step(state: Column, slot: Column) -> Column:
        def offer(w, i):
            used = F.get(state["used"], i)
            block = F.get(w, used)
            return F.when(used < F.size(w), F.struct((block["r"] > slot).alias("early"), block["d"].alias("d"), i.alias("i")))

        best = F.array_min(F.filter(F.transform(windows, offer), lambda x: x.isNotNull()))["i"]
        after = F.transform(F.array(best), lambda b: F.struct(
            F.transform(state["used"], lambda n, i: F.when(i == b, n + 1).otherwise(n)).alias("used"),
            F.concat(state["picks"], F.array(b)).alias("picks"),
        ))
        return F.get(after, F.lit(0))

    start = F.struct(F.transform(windows, lambda w: F.lit(0)).alias("used"), F.array().cast("array<int>").alias("picks"))
    return F.aggregate(F.sequence(F.lit(0), slots - 1), start, step)["picks"]


def plan(counts: DataFrame, weights: DataFrame | None, exponent: float, max_blocks: int) -> DataFrame:
    """One row per source: key, n, tier, weight, block_rows, n_blocks, and ``share``, the sources of its tier.

    Sources without a positive weight are tier 1: they follow, in proportion to their size, when all others
    are used up. Without ``weights`` a source weighs its number of rows to the power of ``exponent``.
    """
    if weights is None:
        weighed = counts.withColumn("weight", F.pow(F.col("n").cast("double"), F.lit(exponent)))
    else:
        given = weights.groupBy(_key(F.col("source")).alias("key")).agg(F.sum("weight").cast("double").alias("weight"))
        weighed = counts.join(given, "key", "left")
    good = (F.coalesce("weight", F.lit(0.0)) > 0) & ~F.isnan(F.coalesce("weight", F.lit(0.0)))
    total = counts.agg(F.sum("n")).scalar()
    placed = (
        weighed.withColumn("tier", F.when(good, 0).otherwise(1))
        .withColumn("weight", F.when(good, F.col("weight")).otherwise(F.col("n").cast("double")))
        .withColumn("block_rows", F.greatest(F.lit(1), F.ceil(total / max_blocks)).cast("long"))
        .withColumn("n_blocks", F.ceil(F.col("n") / F.col("block_rows")).cast("long"))
    )
    # one row per source and one array per tier: as many as there are sources, not rows
    tiers = placed.groupBy("tier").agg(
        F.sort_array(F.collect_list(F.struct("key", "weight", "n_blocks"))).alias("share"), F.sum("n_blocks").alias("slots")
    )
    return placed.join(tiers, "tier")


def _key(source: Column) -> Column:
    """A null source is a source of its own."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def coarse_schedule(planned: DataFrame) -> DataFrame:
    """(tier, key, block, slot): block j of each source, from 0, and the coarse slot it is placed in."""
    tiers = planned.select("tier", "share", "slots").distinct()

    def reached(share: Column, u: Column) -> Column:
        """Slots passed when every source has had ``u`` times its weight, or all it has."""
        return F.aggregate(share, F.lit(0.0), lambda a, s: a + F.least(s["weight"] * u, s["n_blocks"].cast("double")))

    def windows(share: Column) -> Column:
        return F.transform(share, lambda s: F.transform(F.sequence(F.lit(1).cast("long"), s["n_blocks"]), lambda j: F.struct(
            F.floor(reached(share, (j - 1) / s["weight"]) + EPS).alias("r"), F.ceil(reached(share, j / s["weight"]) - EPS).alias("d")
        )))

    picks = tiers.withColumn("windows", windows(F.col("share"))).select(
        "tier", "share", F.posexplode(_edf(F.col("windows"), F.col("slots").cast("int"))).alias("slot", "pick")
    )
    order = Window.partitionBy("tier", "key").orderBy("slot")  # at most all coarse slots
    return picks.select("tier", F.get("share", "pick")["key"].alias("key"), "slot").withColumn("block", F.row_number().over(order) - 1)


def fine_schedule(coarse: DataFrame) -> DataFrame:
    """(tier, window, key, quota, first_block, places): the slots of a source in one turn through a window."""
    return coarse.groupBy("tier", F.expr(f"slot div {WINDOW}").alias("window"), "key").agg(
        F.count("*").alias("quota"), F.min("block").alias("first_block"), F.sort_array(F.collect_list(F.col("slot") % WINDOW)).alias("places")
    )


def mix_sources(
    docs: DataFrame, weights: DataFrame | None = None, id_col: str = "doc_id", source_col: str = "source",
    exponent: float = 0.5, max_blocks: int = MAX_BLOCKS, fine_rows: int = FINE_ROWS, bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Every row of ``docs`` with three more columns: mix_window, mix_slot, mix_rank.

    Read in the order of mix_window, mix_slot and mix_rank, the rows are mixed to ``weights`` (source,
    weight; null: size to the power of ``exponent``). mix_window counts windows of coarse slots, those of
    sources without a positive weight last; mix_slot is the fine slot in the window, mix_rank the place in
    its source by the md5 of the id, then id. Rows that repeat an id get a rank each, in no set order.
    A null source is a source of its own. Columns of these three names are replaced.
    """
    docs = docs.drop("mix_window", "mix_slot", "mix_rank")
    names = docs.columns
    row = free_name(docs, "__doc")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias(row)).select(
        row, _key(F.col(f"{row}.`{source_col}`")).alias("key"),
        F.md5(F.coalesce(F.col(f"{row}.`{id_col}`").cast("string"), F.lit("")).cast("binary")).alias("order"),
        F.col(f"{row}.`{id_col}`").alias("id"),
    )
    counts = checkpoint(rows.groupBy("key").agg(F.count("*").alias("n")), "mix-counts")
    planned = checkpoint(plan(counts, weights, exponent, max_blocks), "mix-plan")
    coarse = checkpoint(coarse_schedule(planned), "mix-coarse")
    fine = checkpoint(fine_schedule(coarse), "mix-fine")
    windows = coarse.withColumn("window", F.expr(f"slot div {WINDOW}")).join(fine, ["tier", "window", "key"]).select(
        "key", "block", "tier", "window", "quota", "first_block", "places"
    )
    offset = fine.groupBy("tier").agg((F.max("window") + 1).alias("windows")).where("tier = 0").agg(F.sum("windows")).scalar()

    # rank in the source: ranges of the md5 order, as many as the source needs, so that no window holds a source
    ranges = counts.select("key", F.ceil(F.col("n") / bucket_rows).cast("long").alias("buckets"))
    bucketed = rows.join(ranges, "key").withColumn(
        "bucket", F.floor(F.conv(F.substring("order", 1, 8), 16, 10).cast("double") * F.col("buckets") / float(1 << 32)).cast("long")
    ).drop("buckets")
    sizes = bucketed.groupBy("key", "bucket").agg(F.count("*").alias("size"))
    before = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("key", "bucket", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("key", "bucket").orderBy("order", "id")
    ranked = bucketed.withColumn("place", F.row_number().over(inside)).join(starts, ["key", "bucket"]).withColumn(
        "mix_rank", F.col("start") + F.col("place") - 1
    )
    block = ranked.join(planned.select("key", "block_rows"), "key").withColumn("block", F.expr("mix_rank div block_rows").cast("int"))
    placed = block.join(windows, ["key", "block"])
    index = F.expr(f"(mix_rank - first_block * block_rows) div {fine_rows}")
    return placed.withColumn("index", index).select(
        f"{row}.*",
        F.when(F.col("tier") == 0, F.col("window")).otherwise(F.col("window") + F.coalesce(offset, F.lit(0))).cast("long").alias("mix_window"),
        F.expr(f"(index div quota) * {WINDOW} + places[cast(index % quota as int)]").cast("long").alias("mix_slot"),
        F.col("mix_rank").cast("long").alias("mix_rank"),
    )

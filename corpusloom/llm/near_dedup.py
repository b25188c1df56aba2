"""Near duplicates by min-max hashing: minimum and maximum of every permutation are kept.

One hash evaluation gives two signature values, and both agree for two sets with a probability equal to
their Jaccard similarity. The values are banded; texts that share a band are candidates, and a candidate
is linked only if the whole sets confirm it.

Texts with the same set are one class from the start. Of a band's bucket, all members are compared with one
leader first. Members of buckets that this leaves in several components are compared further, at last by a
join on their rarest shingles that finds every pair of theirs at the threshold, so that no link between
components is lost. Members that only share frequent shingles make no pair; those that stay just below the
threshold with each other still do.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import free_name, maybe_in, two_columns
from corpusloom.llm.components import components, extended
from corpusloom.llm.kernels import distinct, first_of, mix, ngrams, slices, stream, utf8, words
from corpusloom.session import checkpoint

SHINGLE = 5
#: Permutations, of which each gives two values; values in a band. A pair of similarity 0.85 shares none of
#: the 24 bands with a probability of 2e-8, one of 0.8 with 3e-6.
PERMUTATIONS = 48
BAND_VALUES = 4
#: Rounds in which members are compared with one leader of their bucket each.
LEADER_ROUNDS = 3


def shingle_sets(batch: pa.RecordBatch, n: int):
    """(hashes sorted by text and hash, first of each text): the set of every text in the batch."""
    data, offsets = utf8(batch.column("text"))
    key, doc = distinct(*ngrams(words(data, offsets), n, batch.num_rows), batch.num_rows)
    return key, first_of(doc, batch.num_rows)


def min_max(key: np.ndarray, first: np.ndarray, permutations: int) -> np.ndarray:
    """One row per text: minima, then maxima of its set under each permutation (texts with a set only)."""
    at = first[:-1][np.diff(first) > 0]
    out = np.zeros((len(at), 2 * permutations), np.uint64)
    if len(at):
        factor, shift = stream(41, permutations) | np.uint64(1), stream(43, permutations)
        for j in range(permutations):
            value = key * factor[j] + shift[j]
            out[:, j] = np.minimum.reduceat(value, at)
            out[:, permutations + j] = np.maximum.reduceat(value, at)
    return out


def signatures(rows: DataFrame, n: int = SHINGLE, permutations: int = PERMUTATIONS, band_values: int = BAND_VALUES) -> DataFrame:
    """row, doc_id, n_shingles, set_a and set_b (128 bits that stand for the set), bands."""

    def sign(batches):
        for batch in slices(batches, "text"):
            key, first = shingle_sets(batch, n)
            size = np.diff(first)
            total = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)]) for x in (mix(key), mix(key ^ np.uint64(0x5BD1E995)))]
            ids = [(t[first[1:]] - t[first[:-1]]).view(np.int64) for t in total]
            values = min_max(key, first, permutations).reshape(-1, 2 * permutations // band_values, band_values)
            weight = stream(47, band_values) | np.uint64(1)
            bands = mix((values * weight).sum(axis=2, dtype=np.uint64) + np.arange(values.shape[1], dtype=np.uint64))
            ends = np.concatenate([[0], np.cumsum((size > 0) * bands.shape[1])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([
                batch.column("row"), batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(ids[0]), pa.array(ids[1]),
                pa.ListArray.from_arrays(pa.array(ends), pa.array(bands.reshape(-1).view(np.int64))),
            ], ["row", "doc_id", "n_shingles", "set_a", "set_b", "bands"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(sign, f"row long, doc_id {kind}, n_shingles long, set_a long, set_b long, bands array<long>")


def full_sets(rows: DataFrame, n: int = SHINGLE) -> DataFrame:
    """node, shingles: the whole set of every row."""

    def collect(batches):
        for batch in slices(batches, "text"):
            key, first = shingle_sets(batch, n)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(key.view(np.int64)))],
                ["node", "shingles"],
            )

    return rows.mapInArrow(collect, "node long, shingles array<long>")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets have at least ``percent`` in common."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    both = pairs.join(right, "b").join(left, "a").withColumn("common", F.size(F.array_intersect("sa", "sb")))
    return both.where(100 * F.col("common") >= percent * (F.size("sa") + F.size("sb") - F.col("common"))).select("a", "b")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85, shingle: int = SHINGLE,
    permutations: int = PERMUTATIONS, band_values: int = BAND_VALUES,
) -> DataFrame:
    """One row per row of ``docs``: row, doc_id, n_shingles, class_row, component, component_id.

    Words are separated by ASCII white space, A-Z lower-cased; the set of a text has its distinct runs of
    ``shingle`` words, or all its words as one if there are fewer. Two texts are linked when ``percent`` of
    the union of their sets is in both. ``component_id`` is the smallest doc_id that links reach,
    ``component`` the smallest row. A text without words is linked with nothing. Rows with equal texts have
    one ``class_row``, also where they repeat a doc_id; null ids count as larger than others.
    """
    rows = two_columns(docs, id_col, text_col)
    signed = checkpoint(signatures(rows, shingle, permutations, band_values), "near-signed")
    same = ["n_shingles", "set_a", "set_b"]
    classes = checkpoint(
        signed.where("n_shingles > 0").groupBy(*same).agg(F.min("row").alias("node"), F.min("doc_id").alias("least")), "near-classes"
    )
    nodes = classes.select("node", "least", F.col("n_shingles").alias("size"))
    # one row per class: its first row
    firsts = signed.join(classes.select(F.col("node").alias("row")), "row", "left_semi")
    banded = firsts.select(F.col("row").alias("node"), F.col("n_shingles").alias("size"), F.posexplode("bands").alias("band", "hash"))
    shared = banded.groupBy("band", "hash").agg(F.count("*").alias("n"), F.min("node").alias("leader")).where("n > 1")
    buckets = checkpoint(
        banded.join(shared.drop("n"), ["band", "hash"]).select(F.xxhash64("band", "hash").alias("bucket"), "node", "size", "leader"), "near-buckets"
    )
    wanted = checkpoint(buckets.select(F.col("node").alias("row")).distinct(), "near-wanted")
    texts = maybe_in(rows.select("row", "text"), wanted, "row").where("maybe").select("row", "text").join(wanted, "row", "left_semi")
    sets = checkpoint(full_sets(texts, shingle), "near-sets")

    alike = lambda x, y: (F.least(x, y) * 100 >= F.greatest(x, y) * percent)
    # every member with the smallest leader of its buckets
    first_pairs = buckets.where("node <> leader").groupBy("node", "size").agg(F.min("leader").alias("a"))
    sizes = nodes.select(F.col("node").alias("a"), F.col("size").alias("size_a"))
    pairs = checkpoint(
        first_pairs.join(sizes, "a").where(alike(F.col("size"), F.col("size_a"))).select("a", F.col("node").alias("b")), "near-pairs"
    )
    tested, labels = pairs, components(checkpoint(_confirmed(pairs, sets, percent), "near-links"))
    for turn in range(LEADER_ROUNDS + 1):
        open_ones = checkpoint(_unresolved(buckets, labels), "near-open")
        if open_ones.isEmpty():
            break
        if turn in (0, LEADER_ROUNDS):
            bounds = _bounds(open_ones, sets, percent)
        open_ones = open_ones.join(bounds, "node")
        if turn < LEADER_ROUNDS:
            near = alike(F.col("size_a"), F.col("size_b")) & _reaches("bound_a", "bound_b", "size_a", "size_b", percent)
            found = _with_leader(open_ones, turn).where(near).select("a", "b").distinct()
        else:
            found = _across(open_ones, sets, percent)
        pairs = checkpoint(found.join(tested, ["a", "b"], "left_anti"), "near-pairs")
        tested = tested.unionByName(pairs)
        labels = extended(labels, checkpoint(_confirmed(pairs, sets, percent), "near-links"))
    joined = nodes.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    decided = classes.select(*same, "node").join(joined.select("node", "component"), "node").join(least, "component")
    return signed.select("row", "doc_id", *same).join(decided, same, "left").select(
        "row", "doc_id", "n_shingles",
        F.coalesce("node", "row").alias("class_row"), F.coalesce("component", "row").alias("component"),
        F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
    )


def _unresolved(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of buckets that still have several components; ``main`` tells those of the largest."""
    labelled = buckets.join(labels, "node", "left").select("bucket", "node", "size", F.coalesce("component", "node").alias("component"))
    counts = labelled.groupBy("bucket", "component").agg(F.count("*").alias("n"))
    most = counts.groupBy("bucket").agg(F.count("*").alias("parts"), F.max(F.struct("n", "component"))["component"].alias("largest")).where("parts > 1")
    return labelled.join(most.select("bucket", "largest"), "bucket").select(
        "bucket", "node", "size", "component", (F.col("component") == F.col("largest")).alias("main")
    )


def _bounds(open_ones: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(node, bound) of the members that can still be linked: ``bound`` is the most they have in common with any other.

    A shingle that only one of the open members has is in no intersection. Members with too many of those
    leave, which leaves others with more; two passes.
    """
    nodes = open_ones.select("node", "size").distinct()
    for _ in range(2):
        owned = sets.join(nodes.select("node"), "node", "left_semi").select("node", F.explode("shingles").alias("shingle"))
        alone = owned.groupBy("shingle").agg(F.count("*").alias("n"), F.min("node").alias("node")).where("n = 1")
        alone = alone.groupBy("node").agg(F.count("*").alias("alone"))
        bound = F.col("size") - F.coalesce("alone", F.lit(0))
        nodes = checkpoint(
            nodes.select("node", "size").join(alone, "node", "left").select("node", "size", bound.alias("bound")).where(100 * bound >= percent * F.col("size")),
            "near-bounds",
        )
    return nodes.select("node", "bound")


def _reaches(bound_a: str, bound_b: str, size_a: str, size_b: str, percent: int):
    """Whether two sets can have ``percent`` of their union in common, by their bounds."""
    return (100 + percent) * F.least(bound_a, bound_b) >= percent * (F.col(size_a) + F.col(size_b))


def _pair(x: str, y: str) -> list:
    swap = F.col(f"{x}.node") > F.col(f"{y}.node")
    return [F.when(swap, F.col(f"{p}.{c}")).otherwise(F.col(f"{q}.{c}")).alias(f"{name}{end}") for c, name in (
        ("node", ""), ("size", "size_"), ("bound", "bound_")) for p, q, end in ((y, x, "a"), (x, y, "b"))]


def _with_leader(open_ones: DataFrame, turn: int) -> DataFrame:
    """Every member outside the largest component of its bucket with one of its members."""
    leader = open_ones.where("main").groupBy("bucket").agg(F.min(F.struct(F.xxhash64("node", F.lit(turn), "bucket"), "node", "size", "bound")).alias("l"))
    leader = leader.select("bucket", "l.node", "l.size", "l.bound")
    return open_ones.where("not main").alias("x").join(leader.alias("y"), "bucket").select(*_pair("x", "y"))


def _prefixes(nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """node, size, component, shingle, place: the first shingles of every set in one order of all shingles, rarest first.

    Two sets that reach ``percent`` have one of these in common. ``place`` counts the shingles before it, also those
    that no other member has: they come first and make no row.
    """
    owned = sets.join(nodes, "node").select("node", "size", "component", F.explode("shingles").alias("shingle"))
    shared = owned.groupBy("shingle").agg(F.count("*").alias("n")).where("n > 1")
    ordered = owned.join(shared, "shingle").groupBy("node", "size", "component").agg(
        F.array_sort(F.collect_list(F.struct("n", "shingle"))).alias("order")  # a part of one text's set
    )
    length = F.col("size") - F.ceil(percent * F.col("size") / 100) + 1
    head = ordered.withColumn("alone", F.col("size") - F.size("order")).where(length > F.col("alone"))
    first = F.slice("order", F.lit(1), (length - F.col("alone")).cast("int"))
    return head.select("node", "size", "component", "alone", F.posexplode(first).alias("i", "e")).select(
        "node", "size", "component", F.col("e.shingle").alias("shingle"), (F.col("alone") + F.col("i")).alias("place")
    )


def _across(open_ones: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs of members of different components that can reach ``percent``: they share one of their rarest shingles.

    A join of prefixes, so members that have little but frequent shingles in common are never paired. The smaller
    set of a pair is met by a shorter prefix, since more of it must be in common; lengths and places bound what two
    sets can still share. It does not matter here whether the two have a bucket in common.
    """
    nodes = checkpoint(open_ones.select("node", "size", "component").distinct(), "near-members")
    prefix = checkpoint(_prefixes(nodes, sets, percent), "near-prefixes")
    short = F.col("size") - F.ceil(2 * percent * F.col("size") / (100 + percent)) + 1
    x, y = prefix.where(F.col("place") < short).alias("x"), prefix.alias("y")
    ordered = (F.col("x.size") < F.col("y.size")) | ((F.col("x.size") == F.col("y.size")) & (F.col("x.node") < F.col("y.node")))
    left = F.least(F.col("x.size") - F.col("x.place"), F.col("y.size") - F.col("y.place"))
    reaches = (100 * F.col("x.size") >= percent * F.col("y.size")) & (
        (100 + percent) * left >= percent * (F.col("x.size") + F.col("y.size")))
    met = x.join(y, (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.component") != F.col("y.component")) & ordered & reaches)
    return met.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85, **options) -> DataFrame:
    """The rows of ``docs`` without near duplicates of another row, all columns kept.

    Of every component the row with the smallest doc_id stays (of rows that repeat it, the first; null ids
    last). Texts without words all stay.
    """
    judged = checkpoint(near_duplicates(docs, id_col, text_col, percent, **options), "near-judged")
    best = judged.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("void"), "doc_id", "row"))["row"].alias("stays"), F.count("*").alias("n"))
    row = free_name(docs, "__row")
    names = docs.columns
    dropped = checkpoint(
        judged.join(best.where("n > 1"), "component").where("row <> stays").select("row"), "near-dropped"
    )
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("doc"), F.monotonically_increasing_id().alias("row"))
    flagged = maybe_in(packed, dropped, "row")
    alone = flagged.where("not maybe").select("doc.*")
    return alone.unionByName(flagged.where("maybe").select("row", "doc").join(dropped, "row", "left_anti").select("doc.*"))

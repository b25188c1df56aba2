"""Importance resampling towards a target distribution of hashed word features.

Two scans of the texts: one adds up the features of every bucket (one array for a task), the other scores each
text against the array of gains. The cutoff of the draw is found without sorting all scores: a quantile sketch
brackets it, exact counts outside the bracket validate the bracket or widen it, and only the rows inside are
sorted. Ranks are given to drawn rows by ranges of their order, so no task holds more than one range.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import two_columns
from corpusloom.llm.kernels import ALNUM, first_of, slices, utf8, word_counts, words
from corpusloom.session import checkpoint

BUCKETS = 10_000
#: Rows of a range when rows are ranked.
RANGE_ROWS = 500_000
#: Counters of the sketch; its ranks are off by at most the number of rows divided by this.
ACCURACY = 1_000
#: Spans up to this length are hashed together, a byte at a time; longer ones by themselves.
SHORT_SPAN = 64

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


_CRC = _crc_table()


def crc_of_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """crc32 of every span of ``data``."""
    length = end - start
    order = np.argsort(-np.minimum(length, SHORT_SPAN + 1), kind="stable")
    at, size = start[order], length[order]
    many = int((size > SHORT_SPAN).sum())
    crc = np.full(len(order), 0xFFFFFFFF, np.uint32)
    live = len(order)
    for step in range(min(int(length.max(initial=0)), SHORT_SPAN)):
        live = int(np.searchsorted(-size[many:], -step, "left")) + many if many < live else many
        if live == many:
            break
        part = crc[many:live]
        crc[many:live] = _CRC[(part ^ data[at[many:live] + step]) & 0xFF] ^ (part >> np.uint32(8))
    crc = crc ^ np.uint32(0xFFFFFFFF)
    for i in range(many):
        crc[i] = zlib.crc32(data[at[i]:at[i] + size[i]].tobytes())
    out = np.empty_like(crc)
    out[order] = crc
    return out


def features(batch: pa.RecordBatch, runs: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, row of the batch) of every run of 1 to ``runs`` words, and the words of every row."""
    data, offsets = utf8(batch.column("text"))
    w = words(data, offsets, ALNUM)
    counts = word_counts(w, batch.num_rows)
    length = w.end - w.start
    # all words in lower case, one space after each
    end = np.cumsum(length + 1) - 1
    start = end - length
    joined = np.full(int(end[-1]) + 1 if len(end) else 0, 32, np.uint8)
    shift = np.repeat(w.start - start, length)
    place = np.arange(int(length.sum())) + np.repeat(np.arange(len(length)), length)
    joined[place] = _LOWER[data[place + shift]]
    found, owner = [], []
    for run in range(1, runs + 1):
        n = len(start) - run + 1
        if n <= 0:
            break
        whole = np.flatnonzero(w.doc[:n] == w.doc[run - 1:])
        found.append(crc_of_spans(joined, start[whole], end[whole + run - 1]).astype(np.int64) % buckets)
        owner.append(w.doc[whole])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *found]), np.concatenate([none, *owner]), counts


def bucket_counts(rows: DataFrame, runs: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all rows in each bucket: every task sends one array, the driver gets one number a bucket."""

    def add_up(batches):
        total = np.zeros(buckets, np.int64)
        for batch in slices(batches, "text"):
            bucket, _, _ = features(batch, runs, buckets)
            total += np.bincount(bucket, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some])], ["bucket", "n"])

    counts = rows.select("text").mapInArrow(add_up, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in counts.collect():  # at most ``buckets`` rows
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of target to source in each bucket, one count added to every bucket, floored."""
    k, s_all, t_all = len(source), int(source.sum()), int(target.sum())
    return np.array([
        math.floor(1000 * math.log(float((t + 1) * (s_all + k)) / float((s + 1) * (t_all + k))))
        for s, t in zip(source.tolist(), target.tolist())
    ], np.int64)


def weigh(rows: DataFrame, gain: np.ndarray, runs: int = 1) -> DataFrame:
    """row, doc_id, n_words, n_features and weight, the floored mean gain of a text's features (none: 0)."""
    buckets = len(gain)

    def score(batches):
        for batch in slices(batches, "text"):
            bucket, owner, counts = features(batch, runs, buckets)
            order = np.argsort(owner, kind="stable") if runs > 1 else slice(None)
            first = first_of(owner, batch.num_rows)
            total = np.concatenate([[0], np.cumsum(gain[bucket[order]])])
            n = np.diff(first)
            weight = (total[first[1:]] - total[first[:-1]]) // np.maximum(n, 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("doc_id"), *[pa.array(x.astype(np.int64)) for x in (counts, n, weight)]],
                ["row", "doc_id", "n_words", "n_features", "weight"],
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(score, f"row long, doc_id {kind}, n_words long, n_features long, weight long")


def gumbel(id_col: Column, seed: int) -> Column:
    """Thousandths of a Gumbel number made from the digest of "seed:id", floored."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def _order() -> tuple:
    """Highest score first; of equal scores the smaller id, null ids last, of rows that repeat an id the first."""
    return F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row")


def _ranked(rows: DataFrame, n: int, range_rows: int) -> DataFrame:
    """``rows`` (``n`` of them) with ``rank`` in the order of the draw, from 1 on: places in a range plus the sizes of the ranges before."""
    ranges = -(-n // range_rows)
    ranged = checkpoint(
        rows.repartitionByRange(max(ranges, 1), *_order()).withColumn("range_no", F.spark_partition_id()), "importance-ranges"
    )
    sizes, before, at = sorted((r.range_no, r.n) for r in ranged.groupBy("range_no").agg(F.count("*").alias("n")).collect()), [], 0
    for number, size in sizes:  # one row a range
        before.append((number, at))
        at += size
    starts = rows.sparkSession.createDataFrame(before, "range_no int, before long")
    inside = F.row_number().over(Window.partitionBy("range_no").orderBy(*_order()))
    return ranged.join(F.broadcast(starts), "range_no").withColumn("rank", inside + F.col("before")).drop("range_no", "before")


def cutoff(scored: DataFrame, n: int, draw: int, accuracy: int = ACCURACY, range_rows: int = RANGE_ROWS) -> tuple[int, object, int]:
    """(score, doc_id, row) of the last of the ``draw`` first rows of ``scored`` (``n`` of them) in the order of the draw.

    The sketch gives two scores that should lie on both sides of the cutoff. Exact counts tell whether they do:
    fewer than ``draw`` rows above the bracket, at least ``draw`` down to its lower end. If not, the bracket is
    twice as wide the next time, in the end it takes in all scores.
    """
    margin = 2.0 / accuracy
    while True:
        low, high = max(1 - draw / n - margin, 0.0), min(1 - draw / n + margin, 1.0)
        quantile = lambda p: F.percentile_approx("score", p, accuracy)
        lo, hi = scored.agg(
            F.min("score") if low == 0 else quantile(low), F.max("score") if high == 1 else quantile(high)
        ).first()
        above, down_to = scored.agg(F.count_if(F.col("score") > hi), F.count_if(F.col("score") >= lo)).first()
        if above < draw <= down_to:
            break
        margin *= 2
    inside = scored.where(F.col("score").between(lo, hi)).select("score", "doc_id", "row")
    last = _ranked(inside, down_to - above, range_rows).where(F.col("rank") == draw - above).first()
    return last.score, last.doc_id, last.row


def resample(
    docs: DataFrame, target: DataFrame, percent: int = 10, min_words: int = 20, runs: int = 1, buckets: int = BUCKETS,
    seed: int = 2024, id_col: str = "doc_id", text_col: str = "text", accuracy: int = ACCURACY, range_rows: int = RANGE_ROWS,
) -> DataFrame:
    """One row per row of ``docs``: row, doc_id, n_words, n_features, weight, score, rank (null: not drawn).

    Words are runs of ASCII letters and digits and of anything beyond ASCII, A-Z lower-cased. Features are all
    runs of 1 to ``runs`` words, put into ``buckets`` by crc32. Of the rows with at least ``min_words`` words the
    ``percent`` of 100 with the highest scores are drawn: weight plus a Gumbel number of the id, so a draw
    without replacement in proportion to the weights. Ties go to the smaller id, null ids last (they count as
    an empty id in the digest), rows that repeat an id in the order of the scan. Null and empty texts have no
    features and weight 0. An empty ``docs`` gives no rows, an empty ``target`` counts nothing; other columns
    are not looked at.
    """
    rows = two_columns(docs, id_col, text_col)
    wanted = target.select(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    gain = gains(bucket_counts(rows, runs, buckets), bucket_counts(wanted, runs, buckets))
    scored = checkpoint(weigh(rows, gain, runs).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)), "importance-scored")
    able = scored.where(F.col("n_words") >= min_words)
    n = able.count()
    draw = percent * n // 100
    none = F.lit(None).cast("long").alias("rank")
    if not draw:
        return scored.select("row", "doc_id", "n_words", "n_features", "weight", "score", none)
    score, doc_id, row = cutoff(able, n, draw, accuracy, range_rows)
    same_id = F.col("doc_id").eqNullSafe(F.lit(doc_id))
    earlier = F.col("doc_id").isNotNull() if doc_id is None else F.col("doc_id") < F.lit(doc_id)
    first = (F.col("score") > score) | (
        (F.col("score") == score) & (F.coalesce(earlier, F.lit(False)) | (same_id & (F.col("row") <= row)))
    )
    drawn = (F.col("n_words") >= min_words) & first
    ranked = _ranked(scored.where(drawn), draw, range_rows)
    names = ("row", "doc_id", "n_words", "n_features", "weight", "score")
    return ranked.select(*names, F.col("rank").cast("long").alias("rank")).unionByName(scored.where(~drawn).select(*names, none))

"""Centroid clustering of whole-number vectors by bit planes and popcounts.

A vector's components are integers in two's complement. Bit plane ``b`` of 64 components is one 64-bit word,
and the dot product of two vectors is the sum over pairs of planes of their weights times the popcount of the
planes' AND. So distances are exact integers, and a vector of 64 components of ten bits is ten words.

A round is a map over the packed vectors. Every task adds up its own vectors by cluster and sends one row for
each cluster; the driver sees only the sums of ``k`` clusters.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import quoted
from corpusloom.session import checkpoint

#: Components need at most this many bits, sign included: squared distances of 64 of them then fit a long.
MAX_BITS = 28
#: Vectors that are compared with all centroids at once.
BLOCK = 512


def plane_bits(largest: int) -> int:
    """Bits, sign included, of integers x with max(x, -x - 1) <= ``largest``."""
    return max(int(largest), 0).bit_length() + 1


def planes_of(values: np.ndarray, bits: int) -> np.ndarray:
    """(vectors, bits, words) of an integer array (vectors, components): each plane packed 64 components to a word."""
    n, dim = values.shape
    words = -(-dim // 64)
    wide = np.zeros((n, words * 64), np.int64)
    wide[:, :dim] = values
    out = np.zeros((n, bits, words), np.uint64)
    for b in range(bits):
        plane = ((wide >> b) & 1).astype(np.uint8)
        out[:, b] = np.packbits(plane, axis=1, bitorder="little").view("<u8")
    return out


def weights(bits: int) -> list[int]:
    """What a set bit of each plane counts: the last plane is the sign."""
    return [1 << b for b in range(bits - 1)] + [-(1 << (bits - 1))]


def dots(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Dot products of all rows of ``x`` with all rows of ``y``, both packed by ``planes_of``."""
    shape = len(x), len(y)
    both, count = np.empty(shape, np.uint64), np.empty(shape, np.uint8)
    # one sum of popcounts for every exponent; a pair with one sign plane counts down
    kind = np.int16 if 64 * x.shape[1] * x.shape[2] < 1 << 15 else np.int64
    by_exponent = np.zeros((x.shape[1] + y.shape[1] - 1, *shape), kind)
    for i in range(x.shape[1]):
        for j in range(y.shape[1]):
            step = np.subtract if (i == x.shape[1] - 1) != (j == y.shape[1] - 1) else np.add
            for word in range(x.shape[2]):
                np.bitwise_and(x[:, i, word, None], y[None, :, j, word], out=both)
                np.bitwise_count(both, out=count)
                step(by_exponent[i + j], count, out=by_exponent[i + j])
    total = np.zeros(shape, np.int64)
    for exponent, sums in enumerate(by_exponent):
        total += sums.astype(np.int64) << exponent
    return total


def norms(x: np.ndarray) -> np.ndarray:
    """Dot product of every row with itself."""
    total = np.zeros(len(x), np.int64)
    for i, wi in enumerate(weights(x.shape[1])):
        for j, wj in enumerate(weights(x.shape[1])):
            total += wi * wj * np.bitwise_count(x[:, i] & x[:, j]).sum(axis=1, dtype=np.int64)
    return total


def plane_sums(x: np.ndarray, cluster: np.ndarray, k: int, dim: int) -> np.ndarray:
    """(k, dim): componentwise sums of the packed vectors of every cluster."""
    order = np.argsort(cluster, kind="stable")
    present, first = np.unique(cluster[order], return_index=True)
    out = np.zeros((k, dim), np.int64)
    for b, w in enumerate(weights(x.shape[1])):
        raw = np.ascontiguousarray(x[order, b]).astype("<u8", copy=False).view(np.uint8)
        bit = np.unpackbits(raw, axis=1, bitorder="little", count=dim)
        out[present] += w * np.add.reduceat(bit, first, axis=0, dtype=np.int64)
    return out


def nearest(x: np.ndarray, centroids: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest centroid, squared distance) of packed vectors; of equals the smaller number.

    ``own`` holds the centroids' dot products with themselves.
    """
    cluster, distance = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    for at in range(0, len(x), BLOCK):
        block = x[at:at + BLOCK]
        far = norms(block)[:, None] + own[None, :] - 2 * dots(block, centroids)
        best = far.argmin(axis=1)
        cluster[at:at + BLOCK], distance[at:at + BLOCK] = best, far[np.arange(len(block)), best]
    return cluster, distance


def _packed_rows(batch: pa.RecordBatch, bits: int, words: int) -> np.ndarray:
    flat = np.frombuffer(b"".join(batch.column("planes").to_pylist()), "<u8")
    return flat.reshape(batch.num_rows, bits, words)


def pack_vectors(
    vectors: DataFrame, dim: int = 64, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """vec_id, ints: vectors of exactly ``dim`` components, none null or non-finite, as floor(scale * x)."""
    vector = F.col(quoted(vector_col))
    finite = F.forall(vector, lambda x: F.coalesce(x - x == F.lit(0), F.lit(False)))
    return (
        vectors.where((F.size(vector) == dim) & finite)
        .select(F.col(quoted(id_col)).alias("vec_id"), F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double"))).alias("ints"))
    )


def cluster_vectors(
    vectors: DataFrame, k: int = 40, rounds: int = 5, dim: int = 64, scale: int = 256, seed: int = 2,
    id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """One row per kept vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid, centroid_sha256.

    A vector is kept if it has exactly ``dim`` components, none null or non-finite; its integers are
    floor(scale * x). Centroids start as the ``k`` kept vectors with the smallest sha256 of "seed:vec_id" (all of
    them if there are fewer); of rows that repeat an id, the smaller vectors first, and a null id counts as an
    empty one. Each of ``rounds`` rounds assigns every vector to its nearest centroid (squared Euclidean distance,
    of equals the smaller number) and moves every centroid that has vectors to the floor of their mean. Then
    vectors are assigned once more. Repeated rows count as often as they occur, and a table without kept
    vectors gives no rows. Other columns are not looked at. Integers beyond 27 bits raise an error, because
    their distances do not fit a long.
    """
    spark = vectors.sparkSession
    kept = pack_vectors(vectors, dim, scale, id_col, vector_col)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    start = [r.ints for r in kept.orderBy(digest, "ints").limit(k).select("ints").collect()]  # k vectors
    width = F.greatest(F.array_max("ints"), -F.array_min("ints") - 1)
    bits = plane_bits(kept.agg(F.max(width).alias("w")).first().w or 0)
    if bits > MAX_BITS:
        raise ValueError(f"components of {bits} bits: squared distances would leave 64 bits")
    words = -(-dim // 64)
    kind = vectors.select(F.col(quoted(id_col)).alias("vec_id")).schema["vec_id"].dataType.simpleString()

    def pack(batches):
        for batch in batches:
            flat = batch.column("ints").flatten().to_numpy()
            raw = planes_of(flat.reshape(-1, dim), bits).astype("<u8", copy=False).reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array([r.tobytes() for r in raw], pa.binary())], ["vec_id", "planes"]
            )

    packed = checkpoint(kept.mapInArrow(pack, f"vec_id {kind}, planes binary"), "packed-vectors")
    centroids = np.array(start, np.int64).reshape(-1, dim)
    for _ in range(rounds if len(centroids) else 0):
        centroids = _moved(packed, centroids, bits, words)

    wide, own, live = *_prepared(centroids, bits), len(centroids)

    def assign(batches):
        for batch in batches:
            if batch.num_rows and live:
                cluster, distance = nearest(_packed_rows(batch, bits, words), wide, own)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id"), pa.array(cluster, pa.int32()), pa.array(distance)], ["vec_id", "cluster", "distance"]
                )

    assigned = checkpoint(packed.mapInArrow(assign, f"vec_id {kind}, cluster int, distance long"), "assigned-vectors")
    sums = {r.cluster: r.d for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}  # k rows
    rows = [
        (c, sums[c], sum(sums.values()), centroids[c].tolist(), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest())
        for c in sorted(sums)
    ]
    table = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid array<long>, centroid_sha256 string")
    return assigned.join(F.broadcast(table), "cluster").select(  # k rows
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid", "centroid_sha256"
    )


def _prepared(centroids: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    wide = planes_of(centroids, bits)
    return wide, norms(wide)


def _moved(packed: DataFrame, centroids: np.ndarray, bits: int, words: int) -> np.ndarray:
    """The centroids after one round: floors of exact means; those without vectors stay."""
    wide, own = _prepared(centroids, bits)
    k, dim = centroids.shape

    def add_up(batches):
        sums, counts = np.zeros((k, dim), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            if batch.num_rows:
                x = _packed_rows(batch, bits, words)
                cluster, _ = nearest(x, wide, own)
                sums += plane_sums(x, cluster, k, dim)
                counts += np.bincount(cluster, minlength=k)
        some = np.flatnonzero(counts)
        ends = pa.array(np.arange(0, len(some) * dim + 1, dim), pa.int32())
        yield pa.RecordBatch.from_arrays(
            [pa.array(some, pa.int32()), pa.array(counts[some]), pa.ListArray.from_arrays(ends, pa.array(sums[some].reshape(-1)))],
            ["cluster", "n", "sums"],
        )

    parts = packed.mapInArrow(add_up, "cluster int, n long, sums array<long>")
    total = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[i]) for i in range(dim)]).alias("sums"))
    moved = centroids.copy()
    for r in total.collect():  # k rows
        moved[r.cluster] = [s // r.n for s in r.sums]
    return moved

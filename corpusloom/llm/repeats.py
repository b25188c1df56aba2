"""Repeated byte strings across documents: every byte inside a string of ``length`` bytes that also starts earlier.

All suffixes are compared to a depth of ``length`` bytes, no deeper. Three passes over the texts, which are
read in chunks of bounded size:

1. Sample: of every ``length``-byte string the smallest hash of its ``ANCHOR``-byte substrings. Equal strings
   have the same sample. Neighbouring suffixes with one sample are a stretch; stretches meet by ranges of
   their sample. A sample that occurs once is discarded with its suffixes. Of stretches with the same bytes
   all but the first, in the order of (doc_id, row, start), are repeats as a whole.
2. Name: the suffixes of the first stretches get a 96-bit name for their first ``length`` bytes, and the names
   meet by ranges. Of equal names all but the first are repeats.
3. Remove: the bytes that repeats cover.

What travels between the passes are sorted hashes, packed by chunk and range, once per chunk however often
they occur in it; answers travel back as bits. So a passage that is in a third of all documents is a few
entries per chunk.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import size_of, two_columns
from corpusloom.llm.kernels import mix, powers, stream, utf8
from corpusloom.session import checkpoint

LENGTH = 100
ANCHOR = 44
#: Bytes of text in a chunk, unless one text is longer, and bytes that are hashed together.
CHUNK_BYTES = 6 << 20
PIECE = 1 << 19
#: Bytes of text for each range of keys; there are at least as many ranges as the session's shuffle partitions.
RANGE_BYTES = 16 << 20

#: Bits of a key that are its sample; the rest are of the name, which has 32 more bits than a number.
SAMPLE_BITS = 48

#: Of two hashes: the first one samples and names, the second one widens the names.
_BYTE = (stream(61, 256), stream(67, 256))
_BASE = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F))
_POWERS: dict[int, np.ndarray] = {}


def _powers(which: int = 0) -> np.ndarray:
    if which not in _POWERS:
        _POWERS[which] = powers(_BASE[which], PIECE + 1024)
    return _POWERS[which]


def _sums(part: np.ndarray, which: int) -> np.ndarray:
    """Running sums of byte values times powers."""
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[which][part] * _powers(which)[:len(part)], dtype=np.uint64)])


def rolling(total: np.ndarray, length: int, n: int) -> np.ndarray:
    """Hashes of the n strings of ``length`` bytes, from running sums of byte values times powers."""
    lift = _powers()[PIECE + 512 - np.arange(n)]
    return mix((total[length:length + n] - total[:n]) * lift)


def sliding(x: np.ndarray, width: int, best) -> np.ndarray:
    """best of every ``width`` consecutive values."""
    step = 1
    while step * 2 <= width:
        x = best(x[:-step], x[step:])
        step *= 2
    return x if step == width else best(x[:len(x) - (width - step)], x[width - step:])


def pieces(data: np.ndarray, offsets: np.ndarray, length: int):
    """(first start, number of starts, whether a string lies inside one text, running sums of both hashes) of every piece."""
    last = len(data) - length + 1
    for at in range(0, max(last, 0), PIECE):
        n = min(PIECE, last - at)
        part = data[at:at + n + length - 1]
        totals = [_sums(part, which) for which in range(2)]
        valid = np.ones(n, bool)
        lo, hi = np.searchsorted(offsets, [at + 1, at + n + length])
        for cut in offsets[lo:hi].tolist():  # strings that go across the start of a text
            valid[max(cut - length + 1 - at, 0):max(cut - at, 0)] = False
        yield at, n, valid, totals


def stretches(data: np.ndarray, offsets: np.ndarray, length: int):
    """(first start, number of starts, sample, names of the bytes by both hashes, whether the sample occurs in it twice) of stretches by start.

    A stretch has at most as many starts as a sample can serve, so its first and its last string overlap or
    touch and name all its bytes.
    """
    width, found = length - ANCHOR + 1, []
    for at, n, valid, totals in pieces(data, offsets, length):
        anchors = rolling(totals[0], ANCHOR, n + width - 1)
        least = sliding(anchors, width, np.minimum)
        edge = np.concatenate([[True], (least[1:] != least[:-1]) | (valid[1:] != valid[:-1])])
        start = np.flatnonzero(edge)
        count = np.diff(np.append(start, n))
        kept = valid[start]
        start, count = start[kept], count[kept]
        turns = -(-count // width)
        turn = np.arange(turns.sum()) - np.repeat(np.cumsum(turns) - turns, turns)
        start = np.repeat(start, turns) + turn * width
        count = np.minimum(np.repeat(count, turns) - turn * width, width)
        ends = [[_named(totals, which, x, length) for x in (start, start + count - 1)] for which in range(2)]
        names = [mix(a * np.uint64(0x9E3779B97F4A7C15) + b + count.astype(np.uint64)) for a, b in ends]
        reach = count + width - 1
        begin = np.cumsum(reach) - reach
        same = anchors[np.arange(reach.sum()) + np.repeat(start - begin, reach)] == np.repeat(least[start], reach)
        twice = np.add.reduceat(same, begin, dtype=np.int64) > 1 if len(begin) else np.zeros(0, bool)
        found.append((start + at, count, mix(least[start]) >> np.uint64(64 - SAMPLE_BITS), *names, twice))  # minima crowd at 0, mixed ones do not
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), *[np.zeros(0, np.uint64)] * 3, np.zeros(0, bool)
    return tuple(np.concatenate(x) for x in zip(*found))


def _named(totals: list[np.ndarray], which: int, start: np.ndarray, length: int) -> np.ndarray:
    total = totals[which]
    return mix((total[start + length] - total[start]) * _powers(which)[PIECE + 512 - start])


def suffix_names(data: np.ndarray, offsets: np.ndarray, length: int, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of the first ``length`` bytes of suffixes, 64 bits and 32 more; ``start`` ascends."""
    out, more = np.zeros(len(start), np.uint64), np.zeros(len(start), np.uint32)
    for at, n, _, totals in pieces(data, offsets, length):
        lo, hi = np.searchsorted(start, [at, at + n])
        out[lo:hi] = _named(totals, 0, start[lo:hi] - at, length)
        more[lo:hi] = _named(totals, 1, start[lo:hi] - at, length) >> np.uint64(32)
    return out, more


def pack(values: np.ndarray) -> bytes:
    """Numbers by planes of their bytes, compressed."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(blob: bytes, kind) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).reshape(-1).view(kind)


def pack_sorted(values: np.ndarray) -> bytes:
    return pack(np.diff(values, prepend=values.dtype.type(0)))


def unpack_sorted(blob: bytes, kind) -> np.ndarray:
    return np.cumsum(unpack(blob, kind), dtype=kind)


def ranges(values: np.ndarray, bits: int, parts: int) -> np.ndarray:
    """Where each of ``parts`` equal ranges of hashes starts in a sorted array, and its end."""
    edge = [(p << bits) // parts for p in range(1, parts)]
    return np.concatenate([[0], np.searchsorted(values, np.array(edge, values.dtype)), [len(values)]])


class Chunk:
    """Texts of some rows, in the order of (doc_id, row); null ids last."""

    def __init__(self, table: pa.Table):
        table = table.combine_chunks().sort_by([("doc_id", "ascending"), ("row", "ascending")])
        self.row = np.asarray(table.column("row"))
        self.ids = np.asarray(table.column("doc_id").fill_null(np.iinfo(np.int64).max))
        self.table = table
        text = table.column("text")
        text = text.chunk(0) if text.num_chunks else pa.array([], text.type)
        self.data, self.offsets = utf8(text)


def chunks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[int, pa.Table]]:
    """(number of the first row, rows) of chunks; the cuts depend on the rows alone, not on the batches."""
    held, held_bytes = [], 0
    for batch in batches:
        _, offsets = utf8(batch.column("text"))
        at = 0
        for i in range(batch.num_rows):
            n = int(offsets[i + 1] - offsets[i])
            if held_bytes and held_bytes + n > size:
                held.append(batch.slice(at, i - at))
                yield _chunk(held)
                held, held_bytes, at = [], 0, i
            held_bytes += n
        held.append(batch.slice(at))
    if held and sum(len(b) for b in held):
        yield _chunk(held)


def _chunk(held: list[pa.RecordBatch]) -> tuple[int, pa.Table]:
    table = pa.Table.from_batches([b for b in held if b.num_rows])
    return table.column("row")[0].as_py(), table


def _packed(rows: DataFrame, size: int) -> DataFrame:
    """chunk, texts: the rows of a chunk as one compressed value."""

    def wrap(batches):
        for number, table in chunks(batches, size):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(table)
            yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["chunk", "texts"])

    return rows.mapInArrow(wrap, "chunk long, texts binary")


def _unpacked(texts: bytes) -> Chunk:
    return Chunk(pa.ipc.open_stream(texts).read_all())


def pack_ids(ids: np.ndarray) -> bytes:
    """Ids as the distinct ones and the place of each among them."""
    known, place = np.unique(ids, return_inverse=True)
    first = pack_sorted(known)
    wide = len(known) > 1 << 16
    return len(first).to_bytes(4, "little") + bytes([wide]) + first + pack(place.astype(np.uint32 if wide else np.uint16))


def unpack_ids(blob: bytes) -> np.ndarray:
    n = int.from_bytes(blob[:4], "little")
    return unpack_sorted(blob[5:5 + n], np.int64)[unpack(blob[5 + n:], np.uint32 if blob[4] else np.uint16)]


def _groups(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, first of each group in it, group sizes) of entries with equal keys; stable."""
    order = np.argsort(keys[0], kind="stable") if len(keys) == 1 else np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for key in keys:
        new[1:] |= key[order][1:] != key[order][:-1]
    first = np.flatnonzero(new)
    return order, first, np.diff(np.append(first, len(order)))


def _late(keys: list[np.ndarray], ids: np.ndarray) -> np.ndarray:
    """Which entries are not the first of their key: smallest id, of equal ids the one that comes first."""
    order, first, size = _groups(keys)
    out = np.zeros(len(order), bool)
    if len(order):
        own = ids[order]
        place = np.where(own == np.repeat(np.minimum.reduceat(own, first), size), np.arange(len(own)), len(own))
        out[order] = np.arange(len(own)) != np.repeat(np.minimum.reduceat(place, first), size)
    return out


def _answered(entries: DataFrame, parts: int, whole: bool) -> DataFrame:
    """chunk, part, late, repeated: for each packed entry whether its key is earlier elsewhere, and its sample repeated.

    ``whole``: entries are stretches, their keys are (sample and a part of the name, the name, the rest of it);
    else the keys are (name, rest of the name).
    """

    def meet(batches):
        blobs = [x for b in batches for x in b.to_pylist()]
        for part in sorted({b["part"] for b in blobs}):
            own = sorted((b for b in blobs if b["part"] == part), key=lambda b: b["chunk"])  # chunks are in the order of rows
            keys = [unpack_sorted(b["keys"], np.uint64) for b in own]
            cuts = np.concatenate([[0], np.cumsum([len(k) for k in keys])])
            key = np.concatenate(keys)
            more = [np.concatenate([unpack(b[n], kind) for b in own]) for n, kind in (WIDE_STRETCH if whole else WIDE_NAME)]
            late = _late([key, *more], np.concatenate([unpack_ids(b["ids"]) for b in own]))
            repeated = np.zeros(len(key), bool)
            if whole:
                order, _, size = _groups([key >> np.uint64(64 - SAMPLE_BITS)])
                repeated[order] = np.repeat(size > 1, size)
                repeated |= np.concatenate([np.unpackbits(np.frombuffer(b["several"], np.uint8), count=len(k)).astype(bool) for b, k in zip(own, keys)])
            yield pa.RecordBatch.from_arrays([
                pa.array([b["chunk"] for b in own], pa.int64()), pa.array([part] * len(own), pa.int32()),
                *[pa.array([np.packbits(x[lo:hi]).tobytes() for lo, hi in zip(cuts, cuts[1:])], pa.binary()) for x in (late, repeated)],
            ], ["chunk", "part", "late", "repeated"])

    return entries.repartitionById(parts, F.col("part")).mapInArrow(meet, "chunk long, part int, late binary, repeated binary")


def _gathered(answers: DataFrame) -> DataFrame:
    """chunk, answers: all the answers of a chunk, one for each range at most."""
    return answers.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("part", "late", "repeated"))).alias("answers"))


def _emit(number: int, parts: int, keys: np.ndarray, ids: np.ndarray, rest: np.ndarray, more: np.ndarray | None = None, several: np.ndarray | None = None) -> pa.RecordBatch:
    edge = ranges(keys, 64, parts)
    full = [(p, slice(a, b)) for p, (a, b) in enumerate(zip(edge, edge[1:])) if b > a]
    return pa.RecordBatch.from_arrays([
        pa.array([number] * len(full), pa.int64()), pa.array([p for p, _ in full], pa.int32()),
        pa.array([pack_sorted(keys[x]) for _, x in full], pa.binary()), pa.array([pack_ids(ids[x]) for _, x in full], pa.binary()),
        pa.array([pack(rest[x]) for _, x in full], pa.binary()),
        pa.array([None if more is None else pack(more[x]) for _, x in full], pa.binary()),
        pa.array([None if several is None else np.packbits(several[x]).tobytes() for _, x in full], pa.binary()),
    ], ["chunk", "part", "keys", "ids", "rest", "more", "several"])


def _bits(answers: list[dict] | None, name: str, keys: np.ndarray, parts: int) -> np.ndarray:
    out, edge = np.zeros(len(keys), bool), ranges(keys, 64, parts)
    for x in answers or ():
        a, b = edge[x["part"]], edge[x["part"] + 1]
        out[a:b] = np.unpackbits(np.frombuffer(x[name], np.uint8), count=b - a)
    return out


class Stretches:
    """Stretches of a chunk in the order of their keys; ``new`` tells the first of each key in the chunk."""

    def __init__(self, chunk: Chunk, length: int):
        start, count, sample, name, wider, twice = stretches(chunk.data, chunk.offsets, length)
        key, rest = sample << np.uint64(64 - SAMPLE_BITS) | wider >> np.uint64(SAMPLE_BITS), (wider >> np.uint64(32)).astype(np.uint16)
        order, first, _ = _groups([key, name, rest])
        self.start, self.count, self.key, self.more, self.rest = start[order], count[order], key[order], name[order], rest[order]
        self.new = np.zeros(len(order), bool)
        self.new[first] = True
        by_sample, _, size = _groups([self.key >> np.uint64(64 - SAMPLE_BITS)])
        self.several = twice[order]
        self.several[by_sample] |= np.repeat(size > 1, size)


def _suffixes(chunk: Chunk, answers: list[dict], length: int, parts: int):
    """(starts and counts of stretches that are repeats; starts, names and rests of names of the other suffixes left, by name; first of each name)."""
    s = Stretches(chunk, length)
    late, repeated = ~s.new, s.several.copy()
    late[s.new] = _bits(answers, "late", s.key[s.new], parts)
    repeated[s.new] |= _bits(answers, "repeated", s.key[s.new], parts)
    left = s.new & ~late & repeated
    order = np.argsort(s.start[left])
    first, count = s.start[left][order], s.count[left][order]
    start = np.repeat(first, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    name, rest = suffix_names(chunk.data, chunk.offsets, length, start)
    order, first, _ = _groups([name, rest])
    new = np.zeros(len(order), bool)
    new[first] = True
    return (s.start[late], s.count[late]), start[order], name[order], rest[order], new


def parts_of(rows: DataFrame) -> int:
    """Ranges of keys, so that what meets in one is bounded at every input size."""
    n_bytes = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    return max(size_of(rows), -(-n_bytes // RANGE_BYTES))


ENTRY = "chunk long, part int, keys binary, ids binary, rest binary, more binary, several binary"
#: What tells entries with equal keys apart, in the order of the sort.
WIDE_STRETCH = (("more", np.uint64), ("rest", np.uint16))
WIDE_NAME = (("rest", np.uint32),)


def repeated_bytes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, chunk_bytes: int = CHUNK_BYTES, with_text: bool = False,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (and kept, the bytes left).

    Texts are UTF-8 bytes, null counts as empty. A byte is removed if a string of ``length`` bytes that covers
    it also starts earlier: in a row with a smaller doc_id (null ids last, of equal ids the row read first), or
    before it in the same text; strings may overlap. Spans are maximal ranges (start, end) of removed bytes. Texts shorter than
    ``length`` lose nothing. Ids are integers; other columns are ignored.
    """
    rows = two_columns(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    parts = parts_of(rows)

    def ids_of(chunk, start):
        return chunk.ids[np.searchsorted(chunk.offsets, start, "right") - 1]

    def sample(batches):
        for number, table in chunks(batches, chunk_bytes):
            chunk = Chunk(table)
            s = Stretches(chunk, length)
            yield _emit(number, parts, s.key[s.new], ids_of(chunk, s.start[s.new]), s.rest[s.new], s.more[s.new], s.several[s.new])

    def name(batches):
        for batch in batches:
            for number, texts, answers in zip(*[batch.column(n) for n in ("chunk", "texts", "answers")]):
                chunk = _unpacked(texts.as_py())
                _, start, names, rest, new = _suffixes(chunk, answers.as_py(), length, parts)
                yield _emit(number.as_py(), parts, names[new], ids_of(chunk, start[new]), rest[new])

    def remove(batches):
        for batch in batches:
            for texts, answers, later in zip(*[batch.column(n) for n in ("texts", "answers", "later")]):
                chunk = _unpacked(texts.as_py())
                (whole, count), start, names, _, new = _suffixes(chunk, answers.as_py(), length, parts)
                repeat = ~new
                repeat[new] = _bits(later.as_py(), "late", names[new], parts)
                from_, to = np.concatenate([whole, start[repeat]]), np.concatenate([whole + count - 1, start[repeat]]) + length
                yield _removed(chunk, from_, to, with_text)

    packed = _packed(rows, chunk_bytes)
    first = checkpoint(_gathered(_answered(rows.mapInArrow(sample, ENTRY), parts, True)), "repeat-samples")
    asked = packed.join(first, "chunk", "left")
    second = checkpoint(_gathered(_answered(asked.mapInArrow(name, ENTRY), parts, False)), "repeat-names")
    out = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start: long, end: long>>"
    return packed.join(first, "chunk", "left").join(second.withColumnRenamed("answers", "later"), "chunk", "left").mapInArrow(
        remove, out + (", kept binary" if with_text else "")
    )


def _removed(chunk: Chunk, from_: np.ndarray, to: np.ndarray, with_text: bool) -> pa.RecordBatch:
    change = np.zeros(len(chunk.data) + 1, np.int32)
    np.add.at(change, from_, 1)
    np.subtract.at(change, to, 1)
    gone = np.cumsum(change)[:-1] > 0
    columns: list[list] = [[] for _ in range(6)]
    for a, b in zip(chunk.offsets[:-1].tolist(), chunk.offsets[1:].tolist()):
        own = gone[a:b]
        left = chunk.data[a:b][~own].tobytes()
        edge = np.diff(np.concatenate([[0], own.astype(np.int8), [0]]))
        spans = [{"start": x, "end": y} for x, y in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist())]
        for column, value in zip(columns, (b - a, int(own.sum()), len(spans), hashlib.sha256(left).hexdigest(), spans, left)):
            column.append(value)
    names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary()]
    used = 6 if with_text else 5
    ids = chunk.table.column("doc_id")
    return pa.RecordBatch.from_arrays(
        [ids.chunk(0) if ids.num_chunks else pa.array([], pa.int64()), *[pa.array(c, k) for c, k in zip(columns[:used], kinds)]], ["doc_id", *names[:used]]
    )

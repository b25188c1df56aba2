"""Vectorised words and hashes over Arrow text: what runs inside the tasks, one slice of rows at a time."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are looked at together. A longer text is a slice of its own and is cut between words.
SLICE_BYTES = 2 << 20

_LOWERED = np.arange(256, dtype=np.uint8)
_LOWERED[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
NOT_SPACE = ~SPACE
#: Digits, letters and everything beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def stream(seed: int, n: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit numbers."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


_BYTE = stream(11, 256)
_BYTE_LOW = _BYTE[_LOWERED]
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets from 0) of a text column, nulls as empty; the bytes are not copied."""
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_binary())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], text: str, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``size`` bytes of text, or one row."""
    for batch in batches:
        _, offsets = utf8(batch.column(text))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to


class Words(NamedTuple):
    """Words in order: 64-bit hash, number of the text, first byte and the byte after the last."""

    key: np.ndarray
    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray


def _spans(data: np.ndarray, cuts: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of words; a word does not go across ``cuts`` (positions at which a text starts)."""
    inside = is_word[data]
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    before[cuts] = False
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    after[cuts[cuts > 0] - 1] = False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray = NOT_SPACE, lower: bool = True, size: int = SLICE_BYTES) -> Words:
    """Words of texts that lie one after the other, hashed after lower-casing A-Z.

    Worked through in pieces that end between words, so memory beyond the result is bounded unless one
    word is longer than a piece.
    """
    table = _BYTE_LOW if lower else _BYTE
    found, at, n = [], 0, len(data)
    while at < n:
        to = min(at + size, n)
        while to < n:  # back to a place between words, or forth where there is none
            k = np.flatnonzero(~is_word[data[at:to]])
            inner = offsets[np.searchsorted(offsets, at, "right"):np.searchsorted(offsets, to, "right")]
            cut = max(at + int(k[-1]) + 1 if len(k) else at, int(inner[-1]) if len(inner) else at)
            if cut > at:
                to = cut
                break
            to = min(to + size, n)
        piece = data[at:to]
        lo, hi = np.searchsorted(offsets, [at, to])
        cuts = offsets[lo:hi] - at
        start, end = _spans(piece, np.unique(cuts), is_word)
        if len(start):
            length = end - start
            place = np.arange(len(piece), dtype=np.int64)
            within = np.zeros(len(piece), np.int64)
            within[start] = np.diff(np.concatenate([[0], start]))
            within = place - np.cumsum(within)
            value = table[piece]
            value[~is_word[piece]] = 0
            value *= powers(_BASE, int(length.max()) + 1)[np.minimum(within, int(length.max()))]
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value, dtype=np.uint64)])
            key = mix(total[end] - total[start] + length.astype(np.uint64))
            start, end = start + at, end + at
            found.append((key, np.searchsorted(offsets, start, "right") - 1, start, end))
        at = to
    if not found:
        return Words(np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3)
    return Words(*[np.concatenate(x) for x in zip(*found)])


def span_keys(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of spans that do not overlap, A-Z lower-cased; for slices of bounded size."""
    length = end - start
    place = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
    value = _BYTE_LOW[data[place + np.repeat(start, length)]] * powers(_BASE, int(length.max(initial=0)) + 1)[place]
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value, dtype=np.uint64)])
    stop = np.cumsum(length)
    return mix(total[stop] - total[stop - length] + length.astype(np.uint64))


def word_counts(w: Words, rows: int) -> np.ndarray:
    return np.bincount(w.doc, minlength=rows)


def first_of(doc: np.ndarray, rows: int) -> np.ndarray:
    """Where each text's items start in an array sorted by text, and its length at the end."""
    return np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=rows))])


def ngrams(w: Words, n: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text number) of every n consecutive words; a text with fewer gives all its words as one."""
    base = stream(23, n)
    count = word_counts(w, rows)
    if len(w.key) >= n:
        key = np.zeros(len(w.key) - n + 1, np.uint64)
        for i in range(n):
            key += w.key[i:len(key) + i] * (base[i] | np.uint64(1))
        whole = w.doc[:len(key)] == w.doc[n - 1:]
        key, doc = mix(key[whole] + np.uint64(n)), w.doc[:len(whole)][whole]
    else:
        key, doc = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    short = (count > 0) & (count < n)
    if short.any():
        starts = np.concatenate([[0], np.cumsum(count)])
        place = np.minimum(np.arange(len(w.key)) - starts[w.doc], n - 1)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(w.key * (base[place] | np.uint64(1)), dtype=np.uint64)])
        own = np.flatnonzero(short)
        whole_text = mix(total[starts[own + 1]] - total[starts[own]] + count[own].astype(np.uint64))
        key, doc = np.concatenate([key, whole_text]), np.concatenate([doc, own])
        order = np.argsort(doc, kind="stable")
        key, doc = key[order], doc[order]
    return key, doc


def distinct(key: np.ndarray, doc: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of every text, sorted by text and hash."""
    first = first_of(doc, rows).tolist()
    for a, b in zip(first, first[1:]):
        key[a:b].sort()
    if not len(key):
        return key, doc
    new = np.concatenate([[True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])])
    return key[new], doc[new]

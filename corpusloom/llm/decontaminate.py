"""Benchmark decontamination with a generalised suffix automaton over the words of the test items.

The automaton is built once from the normalised items and goes to the tasks; texts are streamed past it
and never shuffled. At every word it holds the longest run of words, ending there, that occurs in an item.
A run of at least ``window`` words is a hit, whichever item it is from.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import free_name, quoted
from corpusloom.llm.kernels import ALNUM, first_of, slices, utf8, words

WINDOW = 13
#: Words of one automaton. More items make more automata, which every slice of texts is streamed past in turn.
BLOCK_WORDS = 200_000
#: Words of all items together that may be sent to the executors, about 250 bytes each. Beyond it the caller
#: has to split the items into several calls.
MAX_ITEM_WORDS = 2_000_000
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


class Automaton:
    """Suffix automaton of several word sequences, kept apart by restarting at the root.

    ``edges`` maps (state << 32 | word number) to a state; ``length`` and ``link`` are those of the states.
    ``ending`` has the whole short items that end in a state, ``items`` the items in which the longest run
    of a state, if it has at least ``window`` words, occurs.
    """

    def __init__(self, items: list[tuple[str, np.ndarray]], window: int):
        self.window = window
        self.names = [name for name, _ in items]
        self.vocabulary = np.unique(np.concatenate([np.zeros(0, np.uint64), *[k for _, k in items]]))
        self.edges: dict[int, int] = {}
        self.length, self.link, self.out = [0], [-1], [[]]
        self.short: dict[int, list[tuple[int, int]]] = {}
        held: dict[int, set[int]] = {}
        coded = [np.searchsorted(self.vocabulary, keys).tolist() for _, keys in items]
        for code in coded:
            last = 0
            for c in code:
                last = self._extend(last, c)
        for i, code in enumerate(coded):
            state, n, whole = 0, 0, min(len(code), window)
            for c in code:
                state, n = self.step(state, n, c)
                if n >= whole:
                    s = self.at_least(state, whole)
                    if whole == window:
                        held.setdefault(s, set()).add(i)
                    elif n >= len(code):
                        self.short.setdefault(s, []).append((whole, i))
        self.least = min([window, *[len(code) for code in coded if code]])
        self.held = {s: sorted(v) for s, v in held.items()}
        # pairs of neighbours, to skip what no item has
        pairs = [a * np.uint64(31) + b for _, k in items for a, b in [(k[:-1], k[1:])] if len(k) > 1]
        self.pairs = np.unique(np.concatenate([np.zeros(0, np.uint64), *pairs]))
        self.out = None

    def _extend(self, last: int, c: int) -> int:
        edges, length, link, out = self.edges, self.length, self.link, self.out
        known = edges.get(last << 32 | c)
        if known is not None:
            return known if length[known] == length[last] + 1 else self._split(last, c, known)
        new = self._state(length[last] + 1)
        p = last
        while p != -1 and (p << 32 | c) not in edges:
            edges[p << 32 | c] = new
            out[p].append(c)
            p = link[p]
        if p == -1:
            link[new] = 0
        else:
            q = edges[p << 32 | c]
            link[new] = q if length[q] == length[p] + 1 else self._split(p, c, q)
        return new

    def _state(self, length: int) -> int:
        self.length.append(length)
        self.link.append(0)
        self.out.append([])
        return len(self.length) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        """A state for the runs of ``q`` that are one word longer than those of ``p``."""
        edges = self.edges
        twin = self._state(self.length[p] + 1)
        for x in self.out[q]:
            edges[twin << 32 | x] = edges[q << 32 | x]
        self.out[twin] = list(self.out[q])
        self.link[twin], self.link[q] = self.link[q], twin
        while p != -1 and edges.get(p << 32 | c) == q:
            edges[p << 32 | c] = twin
            p = self.link[p]
        return twin

    def step(self, state: int, n: int, c: int) -> tuple[int, int]:
        """The longest run after one more word, as its state and length."""
        edges = self.edges
        to = edges.get(state << 32 | c)
        while to is None and state:
            state = self.link[state]
            n = self.length[state]
            to = edges.get(state << 32 | c)
        return (0, 0) if to is None else (to, n + 1)

    def at_least(self, state: int, n: int) -> int:
        """The state of the suffix of n words."""
        while self.length[self.link[state]] >= n:
            state = self.link[state]
        return state

    def hits(self, code: list[int]) -> Iterator[tuple[int, int, int]]:
        """(first word, word after the last, item) of every occurrence of a window."""
        state, n, window = 0, 0, self.window
        for at, c in enumerate(code):
            state, n = self.step(state, n, c)
            if n < self.least:
                continue
            s = state
            while s > 0:
                if n >= window and self.length[self.link[s]] < window <= self.length[s]:
                    for i in self.held.get(s, ()):
                        yield at + 1 - window, at + 1, i
                for size, i in self.short.get(s, ()):
                    if n >= size:
                        yield at + 1 - size, at + 1, i
                s = self.link[s]

    def runs(self, keys: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, list[int]]]:
        """(first word, word numbers) of stretches in which every word and every pair of neighbours is known."""
        if not len(keys) or not len(self.vocabulary):
            return
        code = np.minimum(np.searchsorted(self.vocabulary, keys), len(self.vocabulary) - 1)
        known = self.vocabulary[code] == keys
        joined = np.zeros(len(keys), bool)  # to the word before
        if len(self.pairs) and len(keys) > 1:
            pair = keys[:-1] * np.uint64(31) + keys[1:]
            at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
            joined[1:] = (self.pairs[at] == pair) & known[1:] & known[:-1]
        joined[first[first < len(keys)]] = False
        starts = np.flatnonzero(known & ~joined)
        goes_on = np.append(joined[1:], False)
        ends = np.flatnonzero(known & ~goes_on) + 1
        long = ends - starts >= self.least
        for a, b in zip(starts[long].tolist(), ends[long].tolist()):
            yield a, code[a:b].tolist()


def _items(benchmark: DataFrame, id_col: str, text_col: str, limit: int) -> list[tuple[str, np.ndarray]]:
    """(id as text, word hashes) of every distinct item; their number of words is counted before they are fetched."""
    rows = benchmark.select(
        F.coalesce(F.col(quoted(id_col)).cast("string"), F.lit("")).alias("id"),
        F.coalesce(F.col(quoted(text_col)), F.lit("")).alias("text"),
    ).distinct()
    n = rows.agg(F.coalesce(F.sum(F.regexp_count("text", F.lit(WORD))), F.lit(0))).first()[0]
    if n > limit:
        raise ValueError(f"the items have {n} words; split them into several calls of at most {limit} words")
    out = []
    for row in rows.sort("id", "text").toLocalIterator():
        data = np.frombuffer(row.text.encode(), np.uint8)
        keys = words(data, np.array([0, len(data)]), ALNUM).key
        if len(keys):
            out.append((row.id, keys))
    return out


def build(benchmark: DataFrame, id_col: str, text_col: str, window: int, limit: int = MAX_ITEM_WORDS) -> list[Automaton]:
    automata, block, size = [], [], 0
    for item in _items(benchmark, id_col, text_col, limit):
        block.append(item)
        size += len(item[1])
        if size >= BLOCK_WORDS:
            automata.append(Automaton(block, window))
            block, size = [], 0
    return automata + ([Automaton(block, window)] if block else [])


def scan(automata: list[Automaton], data: np.ndarray, offsets: np.ndarray):
    """(words, hits, items, marks, word table) for texts that lie one after the other."""
    rows = len(offsets) - 1
    w = words(data, offsets, ALNUM)
    first = first_of(w.doc, rows)
    change = np.zeros(len(w.key) + 1, np.int64)
    items: dict[int, set[str]] = {}
    for automaton in automata:
        for start, code in automaton.runs(w.key, first):
            doc = int(w.doc[start])
            for a, b, i in automaton.hits(code):
                change[start + a] += 1
                change[start + b] -= 1
                items.setdefault(doc, set()).add(automaton.names[i])
    marks = np.cumsum(change)[:-1] > 0
    n_hit = np.bincount(w.doc[marks], minlength=rows)
    return np.diff(first), n_hit, items, marks, w


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_id_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, one_in: int = 20,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_hit, item_ids (sorted), spans (character ranges), contaminated.

    Words are runs of ASCII digits and letters and of anything beyond ASCII, A-Z lower-cased. A window is
    ``window`` consecutive words of an item, or a shorter item as a whole. ``contaminated`` says that at
    least one word in ``one_in`` is hit. Null and empty texts have no
    words. Items without words never occur; items that repeat an id count as one. Spans are byte ranges.
    """
    automata = build(benchmark, item_id_col, item_text_col, window)
    shared = docs.sparkSession.sparkContext.broadcast(automata)  # MAX_ITEM_WORDS bounds it
    rows = docs.select(F.col(quoted(id_col)).alias("doc_id"), F.col(quoted(text_col)).alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def judge(batches):
        for batch in slices(batches, "text"):
            data, offsets = utf8(batch.column("text"))
            n_words, n_hit, items, marks, w = scan(shared.value, data, offsets)
            spans: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            edge = np.diff(np.concatenate([[0], marks.astype(np.int8), [0]]))
            for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()):
                while a < b:  # a run may go on in the next text
                    to = min(b, int(np.searchsorted(w.doc, w.doc[a], "right")))
                    base = offsets[w.doc[a]]
                    spans[w.doc[a]].append({"start": int(w.start[a] - base), "end": int(w.end[to - 1] - base)})
                    a = to
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()),
                pa.array([sorted(items.get(i, ())) for i in range(batch.num_rows)], pa.list_(pa.string())),
                pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                pa.array((n_hit > 0) & (one_in * n_hit >= n_words), pa.bool_()),
            ], ["doc_id", "n_words", "n_hit", "item_ids", "spans", "contaminated"])

    return rows.mapInArrow(judge, (
        f"doc_id {id_type}, n_words long, n_hit long, item_ids array<string>, "
        "spans array<struct<start: long, end: long>>, contaminated boolean"
    ))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, one_in: int = 20) -> DataFrame:
    """The rows of ``docs`` that ``decontaminate`` does not call contaminated, with all their columns; no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(build(benchmark, item_id_col, item_text_col, window))
    text = free_name(docs, "__text")
    names = docs.columns

    def keep(batches):
        for batch in slices(batches, text):
            n_words, n_hit, *_ = scan(shared.value, *utf8(batch.column(text)))
            yield batch.filter(pa.array(~((n_hit > 0) & (one_in * n_hit >= n_words)))).select(names)

    return docs.withColumn(text, F.col(quoted(text_col))).mapInArrow(keep, docs.schema)


def items_digest(item_ids: list[str]) -> str:
    return hashlib.sha256(",".join(item_ids).encode()).hexdigest()

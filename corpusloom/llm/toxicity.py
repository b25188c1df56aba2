"""Toxicity: a lexicon trie intersected with Levenshtein automata, and windows around each hit.

The lexicon is learned from labelled texts: words, and stems with many endings. Words below a stem stay, for their
misspellings. The automata of all its terms
run along the trie together; their product is a table of states, built once, through which the words of a
text are stepped byte by byte, all words of a slice at a time. A hit counts by how often its term, at that
number of edits, stood in texts labelled toxic, and apart from the others where the window around it is a
quotation or its words are those around harmless hits.
"""

from __future__ import annotations

from collections import defaultdict
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import crc_mod, free_name, quoted
from corpusloom.llm.kernels import ALNUM, NOT_SPACE, Words, slices, span_keys, utf8, words
from corpusloom.llm.labelled import FOLDS, HELD_OUT, MAX_LABELLED, fit_logistic, labelled_sample, probability

#: Lexicon terms at most, words below a stem apart, of which there are at most as many again; the labelled texts that a term must be in, and its share of toxic ones.
MAX_TERMS = 150
LEAST_TEXTS = 8
LEAST_SHARE = 0.9
#: A stem has at least so many bytes, and so many words that start with it.
STEM_BYTES = 4
STEM_WORDS = 5
#: How far a misspelling that no labelled text has is trusted, as a part of the term itself.
MISSPELLED = 0.9
#: Words on either side of a hit.
WINDOW = 6
#: Hashed context words; harmless hits from which on they are used.
CONTEXT_BUCKETS = 4096
CONTEXT_HITS = 50
QUOTES = ("\"", "“", "”", "„", "«", "»")
DEAD, START = 0, 1
#: Bytes of text looked at together.
SLICE = 1 << 20


def edits_for(term: bytes) -> int:
    """Edits (inserted, dropped or changed bytes) that a whole term may have."""
    return 0 if len(term) < 4 else 1 if len(term) < 10 else 2


class Matcher:
    """The product of the lexicon trie and the Levenshtein automata of its terms, as a table.

    ``code`` of a state is 0 or the number of a (term, edits) in ``meaning``; a state in ``final`` accepts
    whatever follows (a stem).
    """

    def __init__(self, terms: list[bytes], stems: list[bytes]):
        self.meaning: list[tuple[int, int]] = [(-1, 0)]
        self.terms = [*terms, *stems]
        children: list[dict[int, int]] = [{}]
        ends: dict[int, int] = {}
        stem_at: dict[int, int] = {}
        most = [0]  # edits allowed below a node
        for number, term in enumerate(self.terms):
            node, k = 0, edits_for(term) if number < len(terms) else 0
            most[0] = max(most[0], k)
            for c in term:
                if c not in children[node]:
                    children[node][c] = len(children)
                    children.append({})
                    most.append(0)
                node = children[node][c]
                most[node] = max(most[node], k)
            (ends if number < len(terms) else stem_at)[node] = number
        letters = sorted({c for t in self.terms for c in t})
        self.letter = np.zeros(256, np.int64)
        for i, c in enumerate(letters, 1):
            self.letter[c] = i
        for c in range(65, 91):
            self.letter[c] = self.letter[c + 32]

        def closed(pairs: dict[int, int]) -> tuple:
            """With what is reached by dropping bytes of a term; of each node the fewest edits."""
            todo = list(pairs.items())
            while todo:
                node, e = todo.pop()
                if pairs.get(node, 99) < e:
                    continue
                for child in children[node].values():
                    if e + 1 <= most[child] and pairs.get(child, 99) > e + 1:
                        pairs[child] = e + 1
                        todo.append((child, e + 1))
            return tuple(sorted(pairs.items()))

        def after(state: tuple, c: int) -> tuple:
            pairs: dict[int, int] = {}

            def put(node, e):
                if e <= most[node] and pairs.get(node, 99) > e:
                    pairs[node] = e

            for node, e in state:
                put(node, e + 1)
                for x, child in children[node].items():
                    put(child, e if x == c else e + 1)
            return closed(pairs)

        codes: dict[tuple[int, int], int] = {}

        def code_of(state: tuple) -> tuple[int, bool]:
            for node, e in state:
                if e == 0 and node in stem_at:
                    found, last = (stem_at[node], 0), True
                    break
            else:
                own = [(e, ends[node]) for node, e in state if node in ends and e <= edits_for(self.terms[ends[node]])]
                if not own:
                    return 0, False
                e, number = min(own)
                found, last = (number, e), False
            if found not in codes:
                codes[found] = len(self.meaning)
                self.meaning.append(found)
            return codes[found], last

        first = closed({0: 0})
        known = {(): DEAD, first: START}
        rows, code, final, todo = [[DEAD] * (len(letters) + 1)], [0], [True], [first]
        while todo:
            state = todo.pop(0)
            own, last = code_of(state)
            code.append(own)
            final.append(last)
            row = []
            for c in [-1, *letters]:
                to = () if last else after(state, c)
                if to not in known:
                    known[to] = len(known)
                    todo.append(to)
                row.append(known[to])
            rows.append(row)
        self.table = np.array(rows, np.int32)
        self.code = np.array(code, np.int32)
        self.final = np.array(final, bool)

    def match(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Code of every word, 0 for none."""
        out = np.zeros(len(start), np.int32)
        live, state, step = np.arange(len(start)), np.full(len(start), START, np.int32), 0
        while len(live):
            more = start[live] + step < end[live]
            out[live[~more]] = self.code[state[~more]]
            live, state = live[more], state[more]
            state = self.table[state, self.letter[data[start[live] + step]]]
            over = self.final[state]
            out[live[over]] = self.code[state[over]]
            live, state = live[~over], state[~over]
            step += 1
        return out


def stripped(data: np.ndarray, w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of words without what is neither letter nor digit at their ends."""
    start, end = w.start.copy(), w.end.copy()
    for move, at in ((1, start), (-1, end)):
        live = np.arange(len(at))
        while len(live):
            live = live[(start[live] < end[live])]
            live = live[~ALNUM[data[at[live] - (move < 0)]]]
            at[live] += move
    return start, end


class Hits(NamedTuple):
    doc: np.ndarray
    code: np.ndarray
    is_quote: np.ndarray
    context: list[list[int]]


def find_hits(matcher: Matcher, data: np.ndarray, offsets: np.ndarray, window: int) -> tuple[Hits, np.ndarray]:
    """Hits of all texts, and the number of words of every text."""
    w = words(data, offsets, NOT_SPACE)
    start, end = stripped(data, w)
    code = matcher.match(data, start, end)
    at = np.flatnonzero(code)
    raw, quotes, contexts = data.tobytes() if len(at) else b"", [], []
    for i in at.tolist():
        doc = w.doc[i]
        lo, hi = max(i - window, 0), min(i + window, len(w.doc) - 1)
        while w.doc[lo] != doc:
            lo += 1
        while w.doc[hi] != doc:
            hi -= 1
        before = raw[w.start[lo]:start[i]].decode("utf-8", "ignore")
        behind = raw[end[i]:w.end[hi]].decode("utf-8", "ignore")
        quotes.append(any(q in before for q in QUOTES) and any(q in behind for q in QUOTES))
        contexts.append([int(k % CONTEXT_BUCKETS) for j, k in enumerate(w.key[lo:hi + 1].tolist(), lo) if j != i])
    return Hits(w.doc[at], code[at], np.array(quotes, bool), contexts), np.bincount(w.doc, minlength=len(offsets) - 1)


class Model(NamedTuple):
    matcher: Matcher
    strength: np.ndarray  # by code
    context: np.ndarray  # by hashed word, over 0 around abuse
    weights: np.ndarray
    window: int


def features(matcher: Matcher, strength: np.ndarray, context: np.ndarray, window: int, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Per text: direct and quoted strength (log), the strongest direct hit, context, strength for each word."""
    hits, n_words = find_hits(matcher, data, offsets, window)
    n = len(offsets) - 1
    own = strength[hits.code]
    around = np.array([context[c].mean() if c else 0.0 for c in hits.context])
    direct = np.bincount(hits.doc, own * ~hits.is_quote, n)
    cited = np.bincount(hits.doc, own * hits.is_quote, n)
    strongest = np.zeros(n)
    np.maximum.at(strongest, hits.doc, own * ~hits.is_quote)
    count = np.maximum(np.bincount(hits.doc, minlength=n), 1)
    return np.column_stack([
        np.log1p(direct), np.log1p(cited), strongest, np.bincount(hits.doc, around, n) / count, np.sqrt((direct + cited) / np.maximum(n_words, 1)),
    ])


def _lexicon(sample: DataFrame) -> tuple[list[bytes], list[bytes]]:
    """Whole terms and stems, by counts over the labelled texts."""

    def spell(batches):
        for batch in slices(batches, "text", SLICE):
            data, offsets = utf8(batch.column("text"))
            w = words(data, offsets, NOT_SPACE)
            start, end = stripped(data, w)
            w = w._replace(key=span_keys(data, start, end))
            kept = np.flatnonzero((end > start) & (end - start <= 40))
            # each word once per text, then texts by label for each word
            order = kept[np.lexsort((w.key[kept], w.doc[kept]))]
            new = np.ones(len(order), bool)
            new[1:] = (w.key[order][1:] != w.key[order][:-1]) | (w.doc[order][1:] != w.doc[order][:-1])
            order = order[new]
            toxic = (np.asarray(batch.column("label").fill_null(0)) > 0)[w.doc[order]]
            known, one, place = np.unique(w.key[order], return_index=True, return_inverse=True)
            if len(known):
                raw, at = data.tobytes().lower(), order[one]
                yield pa.RecordBatch.from_arrays([
                    pa.array([raw[a:b] for a, b in zip(start[at].tolist(), end[at].tolist())], pa.binary()),
                    pa.array(np.bincount(place, toxic).astype(np.int64)), pa.array(np.bincount(place, ~toxic).astype(np.int64)),
                ], ["word", "toxic", "clean"])

    counts = sample.mapInArrow(spell, "word binary, toxic long, clean long").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    share = F.col("toxic") / (F.col("toxic") + F.col("clean"))
    # prefixes of words: texts are counted once per word, so a stem's counts are upper bounds with the right share
    stems = counts.where(F.length("word") >= STEM_BYTES).select("toxic", "clean", F.explode(F.sequence(F.lit(STEM_BYTES), F.least(F.length("word"), F.lit(8)))).alias("n"), "word").groupBy(
        F.expr("substring(word, 1, n)").alias("stem")
    ).agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"), F.count("*").alias("words"))
    good = (F.col("toxic") >= LEAST_TEXTS) & (share >= LEAST_SHARE)
    chosen = lambda df, name: [bytes(r[0]) for r in df.where(good).orderBy(F.desc("toxic"), name).limit(4 * MAX_TERMS).select(name).collect()]
    several = chosen(stems.where((F.col("words") >= STEM_WORDS) & (F.col("toxic") >= 4 * LEAST_TEXTS)), "stem")
    short = [s for s in several if not any(s != t and s.startswith(t) for t in several)]
    short = short[:MAX_TERMS]
    words_ = chosen(counts, "word")
    below = [t for t in words_ if any(t.startswith(s) for s in short)]
    whole = [t for t in words_ if t not in set(below)]
    return [*whole[:MAX_TERMS - len(short)], *below[:MAX_TERMS]], short


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", limit: int = MAX_LABELLED, window: int = WINDOW) -> Model:
    """A model from labelled rows outside the held-out fold. Without labels it has an empty lexicon and scores low."""
    sample = labelled_sample(docs, labels, label, id_col, text_col, limit)
    matcher = Matcher(*_lexicon(sample))
    shared = sample.sparkSession.sparkContext.broadcast(matcher)

    def scan(batches):
        for batch in slices(batches, "text", SLICE):
            hits, _ = find_hits(shared.value, *utf8(batch.column("text")), window)
            toxic = (np.asarray(batch.column("label").fill_null(0)) > 0).astype(int).tolist()
            counts = defaultdict(lambda: [0, 0])
            for doc, code in set(zip(hits.doc.tolist(), hits.code.tolist())):
                counts["t", code][toxic[doc]] += 1
            for doc, context in zip(hits.doc.tolist(), hits.context):
                counts["n", 0][toxic[doc]] += 1
                for c in set(context):
                    counts["c", c][toxic[doc]] += 1
            if counts:
                yield pa.RecordBatch.from_arrays([
                    pa.array([k[0] for k in counts]), pa.array([k[1] for k in counts], pa.int64()),
                    pa.array([v[1] for v in counts.values()], pa.int64()), pa.array([v[0] for v in counts.values()], pa.int64()),
                ], ["kind", "number", "toxic", "clean"])

    counted = sample.mapInArrow(scan, "kind string, number long, toxic long, clean long").groupBy("kind", "number").agg(F.sum("toxic"), F.sum("clean"))
    rows = counted.collect()  # codes of the lexicon and hashed context words: both bounded
    by_code = {r[1]: (r[2], r[3]) for r in rows if r[0] == "t"}
    share = np.zeros(len(matcher.meaning))
    term_share: dict[int, float] = {}
    for code in sorted(range(1, len(matcher.meaning)), key=lambda c: matcher.meaning[c][1]):  # fewest edits first
        term, _ = matcher.meaning[code]
        t, n = by_code.get(code, (0, 0))
        # two texts' worth of trust in what the term was with fewer edits
        share[code] = term_share[term] = (t + 2 * MISSPELLED * term_share.get(term, 1.0)) / (t + n + 2)
    strength = np.maximum(2 * share - 1, 0.0)  # 0 where the label is a toss-up
    totals = next(((r[2], r[3]) for r in rows if r[0] == "n"), (0, 0))
    context = np.zeros(CONTEXT_BUCKETS)
    if totals[1] >= CONTEXT_HITS:
        for r in rows:
            if r[0] == "c":
                context[r[1]] = np.log((r[2] + 1) / (totals[0] + 2)) - np.log((r[3] + 1) / (totals[1] + 2))
    parts = sample.sparkSession.sparkContext.broadcast((strength, context))

    def describe(batches):
        for batch in slices(batches, "text", SLICE):
            x = features(shared.value, *parts.value, window, *utf8(batch.column("text")))
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), batch.column("label")], ["x", "label"])

    table = sample.mapInArrow(describe, "x array<double>, label int").toArrow()  # at most ``limit`` labels, five numbers each
    x = np.array(table.column("x").to_pylist(), float).reshape(-1, 5)
    y = np.array(table.column("label").to_pylist(), float).reshape(-1) > 0
    weights = fit_logistic(x, y) if len(y) else np.append(np.zeros(5), -5.0)
    return Model(matcher, strength, context, weights, window)


def score_slice(model: Model, batch: pa.RecordBatch, text: str) -> np.ndarray:
    return probability(features(model.matcher, model.strength, model.context, model.window, *utf8(batch.column(text))), model.weights)


def score_toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score (0 to 1), predicted.

    Whole texts are scored where they lie; null and empty texts have no hits. Only the text counts. Words are
    separated by white space, A-Z lower-cased, punctuation at their ends ignored, edits counted in bytes.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(
        F.col(quoted(id_col)).alias("doc_id"), (crc_mod(F.col(quoted(id_col)), FOLDS) == HELD_OUT).alias("held_out"),
        F.col(quoted(text_col)).alias("text"),
    )

    def score(batches):
        for batch in slices(batches, "text", SLICE):
            p = score_slice(shared.value, batch, "text")
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(p), pa.array((p >= threshold).astype(np.int32))],
                ["doc_id", "held_out", "score", "predicted"],
            )

    return rows.mapInArrow(score, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with all their columns; no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    text, names = free_name(docs, "__text"), docs.columns

    def keep(batches):
        for batch in slices(batches, text, SLICE):
            yield batch.filter(pa.array(score_slice(shared.value, batch, text) < threshold)).select(names)

    return docs.withColumn(text, F.col(quoted(text_col))).mapInArrow(keep, docs.schema)

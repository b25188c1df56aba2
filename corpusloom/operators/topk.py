"""Exact top-k of every query over a whole corpus, without a cross join.

Each task streams its share of the corpus against a block of queries with one
matrix product per batch and keeps its best ``k`` rows per query. Only those
leave the task; two merge steps bring them together. Queries are dealt into
blocks of bounded rows and bytes; every block is one scan of the corpus, which
is never shuffled, and one block is the same path as many.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.session import checkpoint, spread

# Bounds of a query block, which travels with every task.
MAX_BLOCK_ROWS = 4096
MAX_BLOCK_BYTES = 64 << 20
ROWS_AT_ONCE = 1024
# Spread of one query's candidates in the first merge step.
MERGE_SALTS = 64
WORD = re.compile(r"[a-z0-9_./-]+")

RESULT = "query_id {q}, id {c}, score double, first double, second double"


@dataclass(frozen=True)
class Scoring:
    """What a row scores for a query.

    kind: ``exact`` (cosine with a lexical share), ``near`` (distance only),
    ``words`` (token hits in metadata and in content) or ``contains`` (the
    whole needle is part of the text; every match scores the same).
    """

    kind: str
    k: int
    weights: tuple[float, float] = (1.0, 0.0)
    minimum: float | None = None
    metric: str = "l2"
    digits: int | None = None

    def rounded(self, values, extra: int = 0):
        """Rounded half away from zero, as SQL does."""
        if self.digits is None:
            return values
        scale = 10.0 ** (self.digits + extra)
        return np.sign(values) * np.floor(np.abs(values) * scale + 0.5) / scale


class TokenIndex:
    """Which query tokens occur as substrings of a text.

    Tokens hold no separators, so one lies inside a word of the text; the
    tokens of each distinct word are looked up once and remembered.
    """

    LONG = 48
    REMEMBERED = 200_000

    def __init__(self, token_lists):
        names = sorted({t for tokens in token_lists for t in tokens})
        self.position = {t: i for i, t in enumerate(names)}
        self.sizes = sorted({len(t) for t in names})
        self.known: dict[str, np.ndarray] = {}
        # Queries of each token, one entry per occurrence: duplicates count.
        asked = [[] for _ in names]
        for q, tokens in enumerate(token_lists):
            for t in tokens:
                asked[self.position[t]].append(q)
        self.first = np.concatenate([[0], np.cumsum([len(a) for a in asked], dtype=np.int64)])
        self.query = np.array([q for a in asked for q in a], dtype=np.int64)
        self.total = np.array([max(len(t), 1) for t in token_lists], dtype=float)

    def inside(self, word: str) -> np.ndarray:
        found = self.known.get(word)
        if found is None:
            if len(word) > self.LONG:
                at = [i for t, i in self.position.items() if t in word]
            else:
                pieces = {word[s : s + n] for n in self.sizes for s in range(len(word) - n + 1)}
                at = [self.position[p] for p in pieces if p in self.position]
            found = np.array(at, dtype=np.int32)
            if len(self.known) >= self.REMEMBERED:
                self.known.clear()
            self.known[word] = found
        return found

    def ratios(self, texts) -> np.ndarray:
        """Share of each query's tokens found, as (texts, queries); tokens are kept as lists, not as a matrix."""
        rows, tokens = [], []
        for row, text in enumerate(texts):
            found = [at for word in set(WORD.findall((text or "").lower())) if len(at := self.inside(word))]
            if found:
                own = np.unique(np.concatenate(found))
                rows.append(np.full(len(own), row))
                tokens.append(own)
        out = np.zeros((len(texts), len(self.total)))
        if rows:
            row, token = np.concatenate(rows), np.concatenate(tokens)
            n = self.first[token + 1] - self.first[token]
            at = np.repeat(self.first[token] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            out = np.bincount(np.repeat(row, n) * len(self.total) + self.query[at], minlength=out.size).reshape(out.shape)
        return out / self.total


class QueryBlock:
    """Queries in matrix form, built once per task."""

    def __init__(self, pdf: pd.DataFrame, scoring: Scoring):
        self.ids = pdf["query_id"].tolist()
        self.scoring = scoring
        self.tokens = TokenIndex([list(t) for t in pdf["tokens"]]) if "tokens" in pdf else None
        self.needles = pdf["needle"].tolist() if "needle" in pdf else None
        # A query with a path list sees rows of those paths only.
        lists = pdf["paths"].tolist() if "paths" in pdf else None
        self.allowed: dict[str, np.ndarray] | None = None
        if lists is not None:
            self.unlisted = np.array([paths is None for paths in lists])
            positions: dict[str, list[int]] = {}
            for q, paths in enumerate(lists):
                for path in [] if paths is None else paths:
                    positions.setdefault(path, []).append(q)
            self.allowed = {path: np.array(at) for path, at in positions.items()}
        self.by_width: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        if "embedding" in pdf:
            vectors = [np.asarray(v, dtype=float) for v in pdf["embedding"]]
            for width in {len(v) for v in vectors}:
                at = np.array([i for i, v in enumerate(vectors) if len(v) == width])
                self.by_width[width] = (at, np.stack([vectors[i] for i in at]))

    def _vectors(self, rows: pd.DataFrame):
        """Yield (row positions, query positions, rows, queries) of equal width."""
        vectors = [np.asarray(v, dtype=float) for v in rows["embedding"]]
        for width, (at, queries) in self.by_width.items():
            here = np.array([i for i, v in enumerate(vectors) if len(v) == width], dtype=int)
            if len(here) and width:
                yield here, at, np.stack([vectors[i] for i in here]), queries

    def cosines(self, rows) -> np.ndarray:
        out = np.zeros((len(rows), len(self.ids)))
        for here, at, a, b in self._vectors(rows):
            scale = np.outer(np.sqrt((a * a).sum(1)), np.sqrt((b * b).sum(1)))
            dots = a @ b.T
            out[np.ix_(here, at)] = np.divide(dots, scale, out=np.zeros_like(dots), where=scale > 0)
        return out

    def distances(self, rows) -> np.ndarray:
        if self.scoring.metric == "cosine":
            return 1 - self.cosines(rows)
        out = np.full((len(rows), len(self.ids)), np.nan)
        for here, at, a, b in self._vectors(rows):
            if self.scoring.metric == "ip":
                out[np.ix_(here, at)] = 1 - a @ b.T
            else:
                squares = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)
                out[np.ix_(here, at)] = np.maximum(squares, 0.0)
        return out

    def visible(self, paths: pd.Series) -> np.ndarray:
        """Which queries may see each row, by its path."""
        codes, names = pd.factorize(paths)
        table = np.tile(self.unlisted, (len(names), 1))
        for i, name in enumerate(names):
            if name in self.allowed:
                table[i, self.allowed[name]] = True
        return table[codes]

    def score(self, rows):
        """(score, first, second) matrices and the mask of rows that count."""
        score, first, second, keep = self._score(rows)
        return score, first, second, keep if self.allowed is None else keep & self.visible(rows["path"])

    def _score(self, rows):
        s = self.scoring
        if s.kind == "contains":
            texts = rows["searchable"]
            keep = np.stack([texts.str.contains(n, regex=False).to_numpy(bool) for n in self.needles], axis=1)
            same = keep.astype(float)
            return same, same, same, keep
        if s.kind == "near":
            dist = s.rounded(self.distances(rows))
            return -dist, dist, np.zeros_like(dist), ~np.isnan(dist)
        if s.kind == "exact":
            # Three more digits take the noise of the sums out of what follows.
            first = s.rounded(self.cosines(rows), 3)
            second = self.tokens.ratios(rows["searchable"]) if self.tokens is not None else np.zeros_like(first)
            keep = first >= s.minimum
        else:
            first = self.tokens.ratios(rows["searchable"])
            second = self.tokens.ratios(rows["content"])
        score = first * s.weights[0] + second * s.weights[1]
        if s.kind == "words":
            keep = score > 0
        return s.rounded(score), s.rounded(first), s.rounded(second), keep

    def best(self, batches: Iterator[pd.DataFrame]) -> pd.DataFrame:
        """The best ``k`` rows per query over all batches; ties go to the smaller id."""
        k = self.scoring.k
        held: list[list[tuple]] = [[] for _ in self.ids]
        floor = np.full(len(self.ids), -np.inf)
        for batch in batches:
            for lo in range(0, len(batch), ROWS_AT_ONCE):
                rows = batch.iloc[lo : lo + ROWS_AT_ONCE]
                ids = rows["id"].tolist()
                score, first, second, keep = self.score(rows)
                masked = np.where(keep, score, -np.inf)
                better = keep & (masked >= floor)
                for q in np.flatnonzero(better.any(axis=0)):
                    at = np.flatnonzero(better[:, q])
                    if len(at) > k:
                        column = masked[at, q]
                        at = at[column >= np.partition(column, -k)[-k]]
                    held[q] += [(-masked[i, q], ids[i], first[i, q], second[i, q]) for i in at]
                    held[q].sort(key=lambda h: h[:2])
                    del held[q][k:]
                    if len(held[q]) == k:
                        floor[q] = -held[q][-1][0]
        rows = [(self.ids[q], h[1], -h[0], h[2], h[3]) for q, hs in enumerate(held) for h in hs]
        return pd.DataFrame(rows, columns=["query_id", "id", "score", "first", "second"])


def merge_topk(partials: DataFrame, k: int) -> DataFrame:
    """Best ``k`` per query with a rank.

    One query can have candidates from very many tasks, so they are first cut
    down inside ``MERGE_SALTS`` shares and only the survivors meet.
    """
    order = [F.desc("score"), F.asc("id")]
    salted = partials.withColumn("_salt", F.pmod(F.xxhash64("id"), F.lit(MERGE_SALTS)))
    share = Window.partitionBy("query_id", "_salt").orderBy(*order)
    cut = salted.withColumn("_r", F.row_number().over(share)).where(F.col("_r") <= k).drop("_r", "_salt")
    whole = Window.partitionBy("query_id").orderBy(*order)
    return cut.withColumn("rank", F.row_number().over(whole)).where(F.col("rank") <= k)


def scan_topk(queries: DataFrame, corpus: DataFrame, scoring: Scoring, max_block_rows: int = MAX_BLOCK_ROWS) -> DataFrame:
    """Top-k rows of ``corpus`` (id, ...) for each of ``queries`` (query_id, ...).

    Query columns: ``embedding`` and/or ``tokens``, and ``paths`` (null for
    none) where queries have path lists. Corpus columns as the scoring needs
    them: ``embedding``, ``searchable``, ``content``, ``path``.
    """
    corpus = spread(corpus)
    spark = queries.sparkSession
    types = {"q": queries.schema["query_id"].dataType.simpleString(), "c": corpus.schema["id"].dataType.simpleString()}
    schema = RESULT.format(**types)
    partials = [_scan(corpus, spark.sparkContext.broadcast(block), scoring, schema) for block in _blocks(queries, max_block_rows)]
    if not partials:  # nothing asked: the corpus is not read
        partials = [spark.createDataFrame([], schema)]
    return merge_topk(functools.reduce(DataFrame.unionByName, partials), scoring.k)


def _scan(corpus: DataFrame, block, scoring: Scoring, schema: str) -> DataFrame:
    def run(batches):
        yield QueryBlock(block.value, scoring).best(batches)

    return corpus.mapInPandas(run, schema)


def _blocks(queries: DataFrame, most: int) -> Iterator[pd.DataFrame]:
    """The queries once, in blocks within both bounds (or of one query); the driver holds one block at a time."""
    names, rows, weight = queries.columns, [], 0
    for row in checkpoint(queries.withColumn("_weight", _weight(queries)), "queries").toLocalIterator():
        if rows and (len(rows) >= most or weight + row["_weight"] > MAX_BLOCK_BYTES):
            yield pd.DataFrame(rows, columns=names)
            rows, weight = [], 0
        rows.append(tuple(row)[:-1])
        weight += row["_weight"]
    if rows:
        yield pd.DataFrame(rows, columns=names)


def scan_first(needles: DataFrame, rows: DataFrame, k: int, **scan) -> DataFrame:
    """First ``k`` rows by id whose text contains the needle."""
    return scan_topk(needles, rows, Scoring("contains", k), **scan)


def _weight(queries: DataFrame):
    """Bytes a query row takes in a block."""

    def one(field):
        kind, c = field.dataType.simpleString(), F.col(field.name)
        if kind == "array<string>":
            size = F.aggregate(c, F.lit(0), lambda s, x: s + F.length(x) + 50)
        else:
            size = F.size(c) * 8 if kind.startswith("array") else F.length(c.cast("string"))
        return F.coalesce(size, F.lit(0)) + 8

    total = F.lit(0).cast("long")
    for field in queries.schema:
        total = total + one(field)
    return total

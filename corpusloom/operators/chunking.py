"""Chunking under token budgets: line packing, window splits, small-chunk merge."""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf, pandas_udf

from corpusloom.functions.bind import bind
from corpusloom.functions.text import keyword_entities
from corpusloom.options import ChunkBudgets
from corpusloom.schemas import SPAN
from corpusloom.session import spread

CHARS_PER_TOKEN = 4
SPANS_PER_RUN = 24
NO_SPANS = f"array<{SPAN}>"


def _span(start: Column, end: Column) -> Column:
    return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"))


def windows(start: Column, end: Column, max_tokens: int) -> Column:
    """Cut ``[start, end)`` into the longest prefixes that fit ``max_tokens``."""
    width = max_tokens * CHARS_PER_TOKEN
    starts = F.sequence(start, F.greatest(start, end - 1), F.lit(width))
    return F.transform(starts, lambda s: _span(s, F.least(s + width, end)))


def line_spans(content: Column, budgets: ChunkBudgets) -> Column:
    """Greedy line packing as one fold over the line lengths.

    Whole lines (newline included) join the open span while it fits the
    fallback budget. A line that alone exceeds it is cut into windows of the
    larger max budget.
    """
    room = min(budgets.fallback, budgets.max) * CHARS_PER_TOKEN
    lengths = bind(
        F.split(content, "\n"),
        lambda lines: F.transform(lines, lambda x, i: F.length(x) + F.when(i < F.size(lines) - 1, 1).otherwise(0)),
    )
    zero = F.struct(F.lit(0).alias("start"), F.lit(0).alias("cursor"), *_no_cuts())

    def state(start, cursor, cuts):
        return F.struct(start.cast("int").alias("start"), cursor.cast("int").alias("cursor"), *cuts)

    def step(acc, n):
        start, cursor = acc["start"], acc["cursor"]
        after = cursor + n
        open_one = F.when(cursor > start, F.array(_span(start, cursor))).otherwise(F.array().cast(NO_SPANS))
        return (
            F.when(after - start <= room, state(start, after, _same(acc)))
            .when(n <= room, state(cursor, after, _with(acc, open_one)))
            .otherwise(state(after, after, _with(acc, F.concat(open_one, windows(cursor, after, budgets.max)))))
        )

    def finish(acc):
        open_end = F.when(acc["cursor"] > acc["start"], F.array(_span(acc["start"], acc["cursor"]))).otherwise(F.array().cast(NO_SPANS))
        return _all(acc, open_end)

    return F.aggregate(lengths, zero, step, finish)


# Spans that a fold collects before it files them. A fold copies its lists when it adds to them, so the
# open list stays short and the filed ones are only pointed to: the work is linear in the text.
FILED = 128


def _no_cuts() -> list[Column]:
    return [F.array().cast(NO_SPANS).alias("recent"), F.array().cast(f"array<{NO_SPANS}>").alias("filed")]


def _same(acc: Column) -> list[Column]:
    return [acc["recent"].alias("recent"), acc["filed"].alias("filed")]


def _with(acc: Column, more: Column) -> list[Column]:
    recent = F.concat(acc["recent"], more)
    full = F.size(acc["recent"]) + F.size(more) >= FILED
    return [
        F.when(full, F.array().cast(NO_SPANS)).otherwise(recent).alias("recent"),
        F.when(full, F.concat(acc["filed"], F.array(recent))).otherwise(acc["filed"]).alias("filed"),
    ]


def _all(acc: Column, more: Column) -> Column:
    return F.flatten(F.concat(acc["filed"], F.array(F.concat(acc["recent"], more))))


def merge_small(spans: Column, budgets: ChunkBudgets) -> Column:
    """Join neighbours when one is under the minimum and both together fit the target."""
    small, target = budgets.min, budgets.target

    def tokens(start, end):
        return F.ceil((end - start) / CHARS_PER_TOKEN)

    def state(start, end, cuts):
        return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), *cuts)

    def step(acc, x):
        start, end = acc["start"], acc["end"]  # the open span; -1 before the first
        little = (tokens(start, end) < small) | (tokens(x["start"], x["end"]) < small)
        fits = tokens(start, x["end"]) <= target
        return (
            F.when(start < 0, state(x["start"], x["end"], _same(acc)))
            .when(little & fits, state(start, x["end"], _same(acc)))
            .otherwise(state(x["start"], x["end"], _with(acc, F.array(_span(start, end)))))
        )

    def finish(acc):
        return F.when(acc["start"] < 0, F.array().cast(NO_SPANS)).otherwise(_all(acc, F.array(_span(acc["start"], acc["end"]))))

    return F.aggregate(spans, F.struct(F.lit(-1).alias("start"), F.lit(-1).alias("end"), *_no_cuts()), step, finish)


def emit_chunks(
    docs: DataFrame, spans: Column, content: str = "content", entities: bool = True, spread_out: bool = True
) -> DataFrame:
    """One row per span: index, count, bounds, text and (optionally) entities.

    Finding a character position walks the text from its start, so a long text
    is first cut into runs of ``SPANS_PER_RUN`` spans and those into chunks.
    """
    kept = [c for c in docs.columns if c != content]
    start, end = F.col("_span.start"), F.col("_span.end")
    runs = F.transform(
        F.sequence(F.lit(0), F.greatest(F.size("_cut") - 1, F.lit(0)), F.lit(SPANS_PER_RUN)),
        lambda i: F.slice("_cut", i + 1, F.lit(SPANS_PER_RUN)),
    )
    base, top = F.col("_run")[0]["start"], F.element_at("_run", -1)["end"]
    cut_runs = (
        (spread(docs) if spread_out else docs)
        .select(*kept, content, spans.alias("_cut"))
        .where(F.size("_cut") > 0)
        .select(*kept, content, F.size("_cut").alias("chunk_count"), F.posexplode(runs).alias("_at", "_run"))
        .select(
            *kept, "chunk_count", "_at", "_run", base.alias("_base"),
            F.substr(F.col(content), base + 1, top - base).alias("_part"),
        )
    )
    out = cut_runs.select(
        *kept, "chunk_count", "_at", "_base", "_part", F.posexplode("_run").alias("_in", "_span")
    ).select(
        *kept,
        (F.col("_at") * SPANS_PER_RUN + F.col("_in")).alias("chunk_index"),
        "chunk_count",
        start.alias("chunk_start"),
        end.alias("chunk_end"),
        F.substr(F.col("_part"), start - F.col("_base") + 1, end - start).alias("text"),
    )
    if entities:
        out = out.withColumn("keyword_entities", F.array_join(keyword_entities(F.col("text")), "|"))
    return out


def chunk_lines(docs: DataFrame, budgets: ChunkBudgets = ChunkBudgets(), content: str = "content", **kw) -> DataFrame:
    return emit_chunks(docs, line_spans(F.col(content), budgets), content, **kw)


def split_oversized(docs: DataFrame, max_tokens: int, content: str = "content", **kw) -> DataFrame:
    body = F.col(content)
    spans = F.when(F.length(body) > 0, windows(F.lit(0), F.length(body), max_tokens)).otherwise(
        F.array().cast(NO_SPANS)
    )
    return emit_chunks(docs, spans, content, **kw)


def merged_lines(docs: DataFrame, budgets: ChunkBudgets = ChunkBudgets(), content: str = "content", **kw) -> DataFrame:
    return emit_chunks(docs, merge_small(line_spans(F.col(content), budgets), budgets), content, **kw)


def chunk_plain(docs: DataFrame, budgets: ChunkBudgets = ChunkBudgets(), content: str = "content") -> DataFrame:
    """Text and bounds only."""
    kept = [c for c in docs.columns if c != content]
    return chunk_lines(docs, budgets, content, entities=False).select(
        *kept, "text", F.col("chunk_start").alias("start"), F.col("chunk_end").alias("end")
    )


def chunk_with_encoder(
    docs: DataFrame,
    make_ends: Callable[[], Callable[[str], list]],
    budgets: ChunkBudgets = ChunkBudgets(),
    content: str = "content",
    **kw,
) -> DataFrame:
    """Line packing by a user's tokens, in Arrow batches.

    ``make_ends`` builds the encoder once per Python worker; its function gives
    the end of every token of a text, in characters and ascending. A text is
    encoded once. Whole lines join a chunk while its tokens fit the fallback
    budget; a line that alone exceeds it is cut behind its tokens, as many at a
    time as the max budget holds. Rows stay where they are.
    """
    cache: list = []
    room = min(budgets.fallback, budgets.max)

    @pandas_udf(NO_SPANS)
    def spans(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if not cache:
            cache.append(make_ends())
        for texts in batches:
            yield texts.map(lambda t: list(_token_spans(t or "", cache[0](t or ""), room, budgets.max)))

    return emit_chunks(docs, spans(F.col(content)), content, **kw)


def _token_spans(text: str, ends, room: int, most: int) -> Iterator[dict]:
    """Spans of ``text``; a token belongs to the span in which it ends."""
    ends = np.asarray(ends, dtype=np.int64)
    lines = np.flatnonzero(np.frombuffer(text.encode("utf-32-le"), np.uint32) == ord("\n")) + 1
    if len(text) and (not len(lines) or lines[-1] < len(text)):
        lines = np.append(lines, len(text))
    tokens_to = np.searchsorted(ends, lines, "right")  # tokens that end by the end of each line
    start, line, used = 0, 0, 0
    while line < len(lines):
        fitting = int(np.searchsorted(tokens_to, used + room, "right"))
        if fitting > line:  # lines that fit together
            yield {"start": start, "end": int(lines[fitting - 1])}
            line = fitting
        else:
            stop, total = int(lines[line]), int(tokens_to[line])
            for n in range(used + most, total, most):
                yield {"start": start, "end": int(ends[n - 1])}
                start = int(ends[n - 1])
            yield {"start": start, "end": stop}
            line += 1
        start, used = int(lines[line - 1]), int(tokens_to[line - 1])


# Line starts that open a declaration, per language family.
DECLARATION_STARTS = (
    r"(?:export\s|import\s|from\s|class\s|interface\s|enum\s|struct\s|type\s|function\s|async\s|def\s|const\s|let\s"
    r"|var\s|public\s|private\s|protected\s|static\s)"
)


def declaration_spans(content: Column) -> Column:
    """A one-level unit tree from line starts that look like declarations.

    Each unit runs to the next such line. Text before the first one is a unit
    that is not preferred.
    """
    pieces = F.split(content, rf"(?m)^(?={DECLARATION_STARTS})")
    zero = F.array().cast("array<struct<start:int,end:int,parent:int,preferred:boolean>>")

    def step(acc, piece):
        start = F.coalesce(F.try_element_at(acc, F.lit(-1))["end"], F.lit(0))
        unit = F.struct(
            start.cast("int").alias("start"),
            (start + F.length(piece)).cast("int").alias("end"),
            F.lit(-1).alias("parent"),
            piece.rlike(rf"^{DECLARATION_STARTS}").alias("preferred"),
        )
        return F.when(F.length(piece) > 0, F.concat(acc, F.array(unit))).otherwise(acc)

    return F.aggregate(pieces, zero, step)


def chunk_structured(
    docs: DataFrame, units: str = "units", budgets: ChunkBudgets = ChunkBudgets(), content: str = "content", **kw
) -> DataFrame:
    """Chunks along a tree of units.

    ``units`` is an array column of (start, end, parent, preferred); parents
    come before their children and -1 is the whole text. A unit larger than the
    max budget is opened: its preferred children, or all children when none is
    preferred, take its place and the text between them is left out. Oversized
    leaves are cut into windows, neighbours are merged, and a document without
    usable units falls back to line packing.
    """
    width = budgets.max * CHARS_PER_TOKEN

    def leaves(text, nodes):
        children: dict[int, list[int]] = {}
        for i, node in enumerate(nodes):
            children.setdefault(node["parent"], []).append(i)

        def bounds(i):
            return (0, len(text)) if i < 0 else (nodes[i]["start"], nodes[i]["end"])

        def cut(i):
            start, end = bounds(i)
            return [(s, min(s + width, end)) for s in range(start, end, width)]

        # A stack of (unit, pieces before it was opened); None marks a unit not yet seen.
        out, todo = [], [(-1, None)]
        while todo:
            i, before = todo.pop()
            if before is not None:
                if len(out) == before:  # the children left nothing
                    out += cut(i)
                continue
            start, end = bounds(i)
            if end <= start or not text[start:end].strip():
                continue
            kids = children.get(i, [])
            kids = [k for k in kids if nodes[k]["preferred"]] or kids
            if i >= 0 and end - start <= width:
                out.append((start, end))
            elif kids:
                todo.append((i, len(out)))
                todo += [(k, None) for k in reversed(kids)]
            else:
                out += cut(i)
        return out

    @arrow_udf(NO_SPANS)
    def select_units(texts: pa.Array, trees: pa.Array) -> pa.Array:
        # one text and its tree at a time: the trees of a batch as Python objects are many times their bytes
        ends, starts, stops = [0], array("i"), array("i")
        for text, tree in zip(texts, trees):
            nodes = tree.as_py()
            for s, e in leaves(text.as_py() or "", nodes) if nodes else []:
                starts.append(s)
                stops.append(e)
            ends.append(len(starts))
        spans = pa.StructArray.from_arrays([pa.array(starts, pa.int32()), pa.array(stops, pa.int32())], ["start", "end"])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), spans)

    chosen = docs.withColumn("_units", select_units(F.col(content), F.col(units))).drop(units)
    spans = F.when(F.size("_units") > 0, merge_small(F.col("_units"), budgets)).otherwise(
        line_spans(F.col(content), budgets)
    )
    return emit_chunks(chosen.withColumn("_units", spans), F.col("_units"), content, **kw).drop("_units")

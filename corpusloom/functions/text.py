"""Text scalars: whitespace, control characters, escaping, previews, entities."""

from __future__ import annotations

import re
from bisect import bisect_left

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.bind import bind

# First and last code points of the runs that count as whitespace.
SPACE_RUNS = (
    (0x09, 0x0D), (0x20, 0x20), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029),
    (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000), (0xFEFF, 0xFEFF),
)
SPACE_CHARS = "".join(chr(code) for first, last in SPACE_RUNS for code in range(first, last + 1))
# The same set as the inside of a character class.
SPACE_CLASS = "".join(
    rf"\x{{{first:x}}}" + (rf"-\x{{{last:x}}}" if last > first else "") for first, last in SPACE_RUNS
)

# Control characters that never reach a prompt.
CONTROL_CLASS = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"


def js_trim(c: Column) -> Column:
    """Strip all Unicode whitespace at both ends, in time linear in the text."""
    return F.btrim(c, F.lit(SPACE_CHARS))


def is_blank(c: Column) -> Column:
    return js_trim(c) == ""


def strip_control(c: Column) -> Column:
    return F.regexp_replace(c, CONTROL_CLASS, "")


def xml_escape(c: Column) -> Column:
    """Escape the five markup characters; the ampersand goes first."""
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        c = F.replace(c, F.lit(raw), F.lit(entity))
    return c


def query_preview(c: Column, length: int = 140) -> Column:
    def cut(flat):
        return F.when(F.length(flat) <= length, flat).otherwise(F.concat(F.left(flat, F.lit(length)), F.lit("...")))

    return bind(js_trim(F.regexp_replace(c, f"[{SPACE_CLASS}]+", " ")), cut)


def base_name(name: Column) -> Column:
    """Drop a trailing ``:n`` or ``:n-m`` line range."""
    return F.regexp_replace(name, r":\d+(-\d+)?\z", "")


def range_label(name: Column, start_line: Column, end_line: Column) -> Column:
    """Name plus a line range; ``start_line`` is null when nothing is selected."""
    one = F.concat(name, F.lit(":"), start_line.cast("string"))
    return (
        F.when(start_line.isNull(), name)
        .when(start_line == end_line, one)
        .otherwise(F.concat(one, F.lit("-"), end_line.cast("string")))
    )


# Patterns of the four entity families. Each has one repetition
# level only, so a long run of word characters costs linear time.
ENTITY_NAME = r"([A-Za-z_$][A-Za-z0-9_$]*)"
TYPE_ENTITY = rf"(?:class|interface|enum|struct)[{SPACE_CLASS}]+{ENTITY_NAME}"
CALL_ENTITY = rf"[{SPACE_CLASS}]{ENTITY_NAME}\("
VARIABLE_ENTITY = rf"(?:const|let|var|static)[{SPACE_CLASS}]+{ENTITY_NAME}"
IMPORT_ENTITY = rf"(?:import|from|require)[{SPACE_CLASS}]+['\"]([^'\"\n]+)"


def keyword_entities(content: Column) -> Column:
    """Distinct lower-cased entity names in first-seen order, as an array."""

    def found(pattern, shortest):
        names = F.transform(F.regexp_extract_all(content, F.lit(pattern), F.lit(1)), js_trim)
        return F.filter(names, lambda n: F.length(n) >= shortest)

    return F.array_distinct(
        F.transform(
            F.concat(found(TYPE_ENTITY, 1), found(CALL_ENTITY, 3), found(VARIABLE_ENTITY, 3), found(IMPORT_ENTITY, 3)),
            F.lower,
        )
    )


# Words that look like a method name in front of a bracket.
NOT_METHODS = ("if", "for", "while", "switch", "catch", "try", "return", "new")
JAVA_TYPE = rf"(?:^|[^A-Za-z0-9_])(?:class|interface|enum|record)[{SPACE_CLASS}]+([A-Za-z_][A-Za-z0-9_]*)"
JAVA_METHOD = rf"[A-Za-z0-9_<>,\[\]?][{SPACE_CLASS}]+([A-Za-z_][A-Za-z0-9_]*)[{SPACE_CLASS}]*\("


def _last(names: Column) -> Column:
    return F.coalesce(F.try_element_at(names, F.lit(-1)), F.lit(""))


def java_symbols(content: Column, end: Column) -> Column:
    """Last type name and last method-with-body name before ``end``.

    A method is looked for only in the stretch between the previous ``;``,
    ``{`` or ``}`` and an opening brace, and only its first ``name(`` counts:
    plain splitting instead of one pattern over the whole text, which could
    backtrack without bound.
    """

    def symbols(scope):
        types = F.regexp_extract_all(scope, F.lit(JAVA_TYPE), F.lit(1))
        before_braces = bind(F.split(scope, r"\{"), lambda parts: F.slice(parts, F.lit(1), F.size(parts) - 1))
        heads = F.transform(before_braces, lambda p: js_trim(F.element_at(F.split(p, "[;}]"), -1)))
        methods = F.filter(
            F.transform(
                F.filter(heads, lambda h: F.endswith(h, F.lit(")"))),
                lambda h: F.regexp_extract(h, JAVA_METHOD, 1),
            ),
            lambda n: (n != "") & ~n.isin(*NOT_METHODS),
        )
        return F.struct(_last(types).alias("class_name"), _last(methods).alias("method_name"))

    return bind(F.substring(content, F.lit(1), end.cast("int")), symbols)


# The same patterns with the white space itself in the character class.
TYPE_IN_TEXT, METHOD_IN_HEAD = (re.compile(p.replace(SPACE_CLASS, SPACE_CHARS)) for p in (JAVA_TYPE, JAVA_METHOD))
HEAD_END = re.compile("[{;}]")


def symbol_positions(text: str) -> tuple[list[int], list[str], list[int], list[str]]:
    """(starts of type names, the names, places of opening braces that have a method in front, its names), each in order."""
    starts, types, braces, methods = [], [], [], []
    for found in TYPE_IN_TEXT.finditer(text):
        starts.append(found.start(1))
        types.append(found.group(1))
    behind = 0
    for found in HEAD_END.finditer(text):
        if found.group() == "{":
            head = text[behind:found.start()].strip(SPACE_CHARS)
            method = METHOD_IN_HEAD.search(head) if head.endswith(")") else None
            if method and method.group(1) not in NOT_METHODS:
                braces.append(found.start())
                methods.append(method.group(1))
        behind = found.end()
    return starts, types, braces, methods


def java_symbols_at(content: Column, ends: Column) -> Column:
    """``java_symbols`` at every one of ``ends``: the text is looked through once, each end is a binary search.

    An array of (class_name, method_name) beside ``ends``; null where the content is null.
    """

    @F.pandas_udf("array<struct<class_name:string,method_name:string>>")
    def symbols(contents: pd.Series, places: pd.Series) -> pd.Series:
        out = []
        for text, stops in zip(contents, places):
            if text is None or stops is None:
                out.append(None)
                continue
            starts, types, braces, methods = symbol_positions(text)
            row = []
            for end in stops:
                i, j = bisect_left(starts, end) - 1, bisect_left(braces, end) - 1
                # a text that ends inside a name has the part before the end
                row.append({"class_name": types[i][:end - starts[i]] if i >= 0 else "", "method_name": methods[j] if j >= 0 else ""})
            out.append(row)
        return pd.Series(out)

    return symbols(content, ends)


def session_title(text: Column) -> Column:
    """Text after the instruction marker when there is any, cut to 40 characters."""
    tail = js_trim(F.get(F.split(text, "User instruction:"), F.lit(1)))

    def cut(clean):
        return F.when(F.length(clean) > 40, F.concat(F.left(clean, F.lit(37)), F.lit("..."))).otherwise(clean)

    return bind(F.coalesce(F.nullif(tail, F.lit("")), text), cut)


def relative_time(created_ms: Column, now_ms: Column) -> Column:
    minutes = F.floor((now_ms - created_ms) / 60000)
    hours = F.floor(minutes / 60)
    days = F.floor(hours / 24)
    return (
        F.when(minutes < 1, F.lit("Just now"))
        .when(minutes < 60, F.concat(minutes.cast("string"), F.lit(" min ago")))
        .when(hours < 24, F.concat(hours.cast("string"), F.lit(" h ago")))
        .when(days == 1, F.lit("Yesterday"))
        .otherwise(F.concat(days.cast("string"), F.lit(" days ago")))
    )


def duration_seconds(ms: Column) -> Column:
    return F.format_string("%.2f", ms.cast("double") / 1000)

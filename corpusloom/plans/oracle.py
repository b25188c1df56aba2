"""The same views for DuckDB, and the assembly of a statement from them."""

from __future__ import annotations

import re

from corpusloom.functions.files import CONFIG_EXTENSIONS, CONFIG_WORDS, LANGUAGE_BY_EXTENSION
from corpusloom.functions.text import SPACE_CHARS, SPACE_CLASS
from corpusloom.options import EXCLUDED_DIRS
from corpusloom.plans.views import MARKERS, NAMES


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def texts(values) -> str:
    return "[" + ", ".join(map(text, values)) + "]"


def pick(values, index: str) -> str:
    return f"({texts(values)})[{index} % {len(values)} + 1]"


SPACE = text(SPACE_CHARS)
WS = SPACE_CLASS


def trim(c: str) -> str:
    return f"trim({c}, {SPACE})"


def is_env(n: str) -> str:
    return f"(lower({n}) = '.env' OR starts_with(lower({n}), '.env.'))"


def extension(n: str) -> str:
    return rf"lower(regexp_extract({n}, '\.([^.]+)$', 1))"


LANGUAGES = "MAP {" + ", ".join(f"{text(k)}: {text(v)}" for k, v in LANGUAGE_BY_EXTENSION.items()) + "}"


def language(n: str) -> str:
    return f"CASE WHEN {is_env(n)} THEN 'properties' ELSE coalesce(({LANGUAGES})[{extension(n)}], 'text') END"


def words_config(n: str) -> str:
    return f"regexp_matches(lower({n}), '{'|'.join(CONFIG_WORDS)}')"


def file_type(n: str) -> str:
    known = ", ".join(map(text, CONFIG_EXTENSIONS))
    return (
        f"CASE WHEN {is_env(n)} OR {extension(n)} IN ({known}) OR {words_config(n)} "
        "THEN 'configuration' ELSE 'source_code' END"
    )


def attached_extension(n: str) -> str:
    return rf"regexp_extract(string_split({n}, '/')[-1], '.(\.[^.]*)$', 1)"


def file_type_attached(n: str) -> str:
    known = ", ".join(text("." + e) for e in CONFIG_EXTENSIONS)
    return (
        f"CASE WHEN lower({attached_extension(n)}) IN ({known}) OR {words_config(n)} "
        "THEN 'configuration' ELSE 'source_code' END"
    )


def tokens(c: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({c}), '[^a-z0-9_./-]+'), lambda t: length(t) >= 2)"


def ratio(toks: str, hay: str) -> str:
    return (
        f"CASE WHEN len({toks}) > 0 AND trim({hay}) <> '' "
        f"THEN len(list_filter({toks}, lambda t: contains({hay}, t))) / len({toks}) ELSE 0.0 END"
    )


def escape(c: str) -> str:
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        c = f"replace({c}, {text(raw)}, {text(entity)})"
    return c


def strip_control(c: str) -> str:
    return rf"regexp_replace({c}, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g')"


def base_name(c: str) -> str:
    return rf"regexp_replace({c}, ':\d+(-\d+)?$', '')"


def role(c: str) -> str:
    return f"CASE {c} WHEN 'assistant' THEN 'ai' WHEN 'system' THEN 'system' ELSE 'human' END"


def chars4(c: str) -> str:
    return f"CAST(ceil(length({c}) / 4) AS BIGINT)"


def message_tokens(r: str, c: str) -> str:
    return chars4(f"({role(r)}) || ': ' || {c}")


def title(c: str) -> str:
    tail = trim(f"coalesce(string_split({c}, 'User instruction:')[2], '')")
    clean = f"(CASE WHEN {tail} <> '' THEN {tail} ELSE {c} END)"
    return f"CASE WHEN length({clean}) > 40 THEN left({clean}, 37) || '...' ELSE {clean} END"


def spans(content: str, fallback: int, top: int) -> str:
    """Greedy line packing as a fold over line lengths; a list of {s, e}."""
    room, width = 4 * min(fallback, top), 4 * top
    state = "{{'s': {s}, 'c': {c}, 'n': 0::BIGINT, 'k': {k}}}"
    empty = "[]::STRUCT(s BIGINT, e BIGINT)[]"
    closed = "(CASE WHEN a.c > a.s THEN list_append(a.k, {'s': a.s, 'e': a.c}) ELSE a.k END)"
    cut = (
        f"list_concat({closed}, list_transform(range(a.c, a.c + b.n, {width}), "
        f"lambda p: {{'s': p, 'e': least(p + {width}, a.c + b.n)}}))"
    )
    lines = (
        f"list_transform(string_split({content}, chr(10)), lambda x, i: "
        + state.format(s="0::BIGINT", c="0::BIGINT", k=empty).replace(
            "'n': 0::BIGINT",
            f"'n': CAST(length(x) + CASE WHEN i < len(string_split({content}, chr(10))) THEN 1 ELSE 0 END AS BIGINT)",
        )
        + ")"
    )
    folded = (
        f"list_reduce({lines}, lambda a, b: CASE "
        f"WHEN a.c + b.n - a.s <= {room} THEN {state.format(s='a.s', c='a.c + b.n', k='a.k')} "
        f"WHEN b.n <= {room} THEN {state.format(s='a.c', c='a.c + b.n', k=closed)} "
        f"ELSE {state.format(s='a.c + b.n', c='a.c + b.n', k=cut)} END, "
        f"{state.format(s='0::BIGINT', c='0::BIGINT', k=empty)})"
    )
    return folded


def finished(fold: str) -> str:
    """Close the span a fold leaves open."""
    return f"CASE WHEN {fold}.c > {fold}.s THEN list_append({fold}.k, {{'s': {fold}.s, 'e': {fold}.c}}) ELSE {fold}.k END"


def merged(sp: str, low: int, target: int) -> str:
    """Left-to-right merge of small neighbours; the first span seeds the fold."""
    one = "{{'s': {s}, 'e': {e}, 'k': {k}}}"
    empty = "[]::STRUCT(s BIGINT, e BIGINT)[]"
    rows = f"list_transform({sp}, lambda x: {one.format(s='x.s', e='x.e', k=empty)})"
    tok = "ceil(({e} - {s}) / 4)"
    small = f"({tok.format(s='a.s', e='a.e')} < {low} OR {tok.format(s='b.s', e='b.e')} < {low})"
    fits = f"{tok.format(s='a.s', e='b.e')} <= {target}"
    pair = "{'s': a.s, 'e': a.e}"
    pushed = one.format(s="b.s", e="b.e", k=f"list_append(a.k, {pair})")
    return (
        f"list_reduce({rows}, lambda a, b: CASE WHEN {small} AND {fits} "
        f"THEN {one.format(s='a.s', e='b.e', k='a.k')} ELSE {pushed} END)"
    )


def entities(c: str) -> str:
    name = "([A-Za-z_$][A-Za-z0-9_$]*)"

    def found(pattern, shortest):
        return (
            f"list_filter(list_transform(regexp_extract_all({c}, {text(pattern)}, 1), lambda n: {trim('n')}), "
            f"lambda n: length(n) >= {shortest})"
        )

    every = ", ".join([
        found(f"(?:class|interface|enum|struct)[{WS}]+{name}", 1),
        found(rf"[{WS}]{name}\(", 3),
        found(f"(?:const|let|var|static)[{WS}]+{name}", 3),
        found(f"(?:import|from|require)[{WS}]+['\"]([^'\"\n]+)", 3),
    ])
    flat = f"list_transform(flatten([{every}]), lambda n: lower(n))"
    return f"array_to_string(list_filter({flat}, lambda x, i: list_position({flat}, x) = i), '|')"


CTES = {
    "corpus": f"""SELECT doc_id, source || '/' || lang || '/d' || CAST(doc_id AS VARCHAR) || '/' || {pick(NAMES, 'doc_id')} AS path,
        text AS content, CAST(strlen(text) AS BIGINT) AS size FROM documents""",
    "named": f"""SELECT doc_id, path, file_name, folder, {extension('file_name')} AS extension, {language('file_name')} AS language
        FROM (SELECT doc_id, path, string_split(path, '/')[-1] AS file_name,
              array_to_string(string_split(path, '/')[:-2], '/') AS folder FROM corpus)""",
    "dirty": """SELECT doc_id, path, content, CAST(strlen(content) AS BIGINT) AS size FROM (
        SELECT doc_id, CASE WHEN doc_id % 11 = 3 THEN 'node_modules/' || path ELSE path END AS path,
        CASE WHEN doc_id % 17 = 0 THEN ' ' || chr(10) || chr(9)
             WHEN doc_id % 19 = 0 THEN repeat(chr(1), 400) || content
             WHEN doc_id % 23 = 0 THEN content || content ELSE content END AS content FROM corpus)""",
    "dispositions": rf"""SELECT *, CASE WHEN size > 16384 THEN 'size' WHEN {trim('content')} = '' THEN 'empty'
        WHEN contains(left(content, 4096), chr(0)) OR (length(left(content, 4096)) - length(regexp_replace(left(content, 4096),
          '[\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g'))) / greatest(length(left(content, 4096)), 1) > 0.08 THEN 'binary'
        WHEN regexp_matches(path, '(?i)^(?:.*/[^/]*\.bin|.*/[^/]*\.class|.*/[^/]*\.jar|.*/[^/]*\.lock)$') THEN 'glob'
        ELSE 'kept' END AS disposition
        FROM dirty WHERE NOT list_has_any(string_split(path, '/')[:-2], {texts(EXCLUDED_DIRS)})""",
    "whole_dispositions": None,
    "code": """SELECT doc_id, path, 'import "mod' || doc_id || '.core"' || chr(10) || 'class Doc' || doc_id || ' {' || chr(10)
        || '  public int run' || (doc_id % 5) || '(int a, String b) {' || chr(10)
        || '    if (a > 0) { return helper(a); }' || chr(10) || '  }' || chr(10) || '}' || chr(10)
        || 'const total' || doc_id || ' = compute(1);' || chr(10) || content AS content FROM corpus""",
    "listing": f"SELECT source || '-' || lang AS workspace, {pick(MARKERS, 'doc_id')} AS name FROM documents",
    "asked": """SELECT item_id AS query_id, text, CAST(embedding AS DOUBLE[]) AS embedding
        FROM benchmark JOIN embeddings ON item_id = vec_id""",
    "chunks_vec": """SELECT path || '::chunk-0' AS id, n.*, c.content, CAST(e.embedding AS DOUBLE[]) AS embedding, e.label
        FROM named n JOIN (SELECT doc_id, content FROM corpus) c USING (doc_id) JOIN embeddings e ON doc_id = vec_id""",
    "corpus_chunks": "SELECT path || '::chunk-0' AS id, n.*, content FROM named n JOIN (SELECT doc_id, content FROM corpus) USING (doc_id)",
    "query_paths": """SELECT query_id, path FROM (SELECT item_id AS query_id, unnest(range(item_id, item_id + 3)) AS doc_id
        FROM benchmark) JOIN corpus USING (doc_id) SEMI JOIN (SELECT doc_id FROM labels WHERE quality = 1) l USING (doc_id)""",
    "neighbours": """SELECT x.vec_id, CAST(x.embedding AS DOUBLE[]) AS a, CAST(y.embedding AS DOUBLE[]) AS b
        FROM embeddings x JOIN embeddings y ON y.vec_id = x.vec_id + 1""",
    "messages": """SELECT conv_id, turn, role, CASE WHEN turn % 3 = 2 THEN 'Observation: ' || text ELSE text END AS text
        FROM conversations""",
    "attachments": """SELECT conv_id, turn, 0 AS pos, 'file' || (turn % 3) || '.ts' || CASE WHEN turn % 4 = 0 THEN ':' || (turn + 1) ELSE '' END AS name,
        text AS content, conv_id % 11 = 0 AS is_repository FROM conversations WHERE role = 'user'
        UNION ALL SELECT conv_id, turn, 1, 'app.config', '<k>&''' || role || chr(7) || '''"</k>', false
        FROM conversations WHERE role = 'user'""",
    "last_turns": f"""SELECT conv_id, {base_name('name')} AS base, max(turn) AS last_turn FROM attachments
        WHERE NOT is_repository GROUP BY ALL""",
    "active_files": f"""SELECT conv_id, turn, pos, base, name, content FROM (SELECT *, {base_name('name')} AS base
        FROM attachments WHERE NOT is_repository) JOIN last_turns USING (conv_id, base) WHERE turn = last_turn""",
    "agent_turns": r"""SELECT conv_id, turn, CASE (conv_id + turn) % 6
        WHEN 0 THEN 'Thought: look' || chr(10) || 'Action: agent_search("' || word || '")'
        WHEN 1 THEN 'Thought: done' || chr(10) || 'Final Answer: ' || text
        WHEN 2 THEN 'Thought' || chr(13) || chr(10) || '  action: search ( ''' || lower(word) || ''' ) '
        WHEN 3 THEN 'FINAL ANSWER: [Your answer here]' WHEN 4 THEN 'Action: agent_search("same words")'
        ELSE 'Action: search()' || chr(10) || 'Action: search(' || word || ')' END AS text
        FROM (SELECT *, regexp_split_to_array(text, '\s+')[1] AS word FROM conversations WHERE role = 'assistant')""",
    "fragments": """SELECT user_id AS request_id, event_id AS seq, CASE WHEN event_id % 31 = 0 THEN ''
        WHEN event_id % 41 = 0 THEN ': ' || event_type || ' '
        ELSE 'data: ' || CASE WHEN event_id % 50 = 0 THEN '[DONE]' WHEN event_id % 77 = 0 THEN '{"choices": ['
          WHEN event_id % 3 = 0 THEN '{"choices":[{"text":"' || event_type || ' "}]}'
          WHEN event_id % 7 = 0 THEN '{"choices":[],"usage":{"completion_tokens":' || (event_id % 9) || '}}'
          ELSE '{"choices":[{"delta":{"content":"' || event_type || ' "}}]}' END END AS value FROM events""",
    "decoded": """SELECT request_id, seq, coalesce(CASE WHEN ok THEN coalesce(json_extract_string(p, '$.choices[0].delta.content'),
        json_extract_string(p, '$.choices[0].text')) END, '') AS token,
        coalesce(CASE WHEN ok THEN CAST(json_extract_string(p, '$.usage.completion_tokens') AS BIGINT) END, 0) AS usage, NOT ok AS is_bad
        FROM (SELECT *, json_valid(p) AS ok FROM (SELECT request_id, seq, trim(substr(value, 6)) AS p FROM fragments
              WHERE starts_with(value, 'data:')) WHERE p <> '[DONE]')""",
    "requests": """SELECT event_id, ts, user_id, CAST(round(value * 1000) AS BIGINT) AS duration_ms, event_type = 'error' AS is_error FROM events""",
    "log_lines": """SELECT event_id, '2024-01-01T00:00:00.000Z [' || CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END
        || '] [rag] saw ' || event_type || CASE WHEN event_id % 4 = 0 THEN '' ELSE ' | ' || props END AS value FROM events""",
    "sized": f"SELECT *, {message_tokens('role', 'text')} AS tokens FROM messages",
    "packed": f"SELECT doc_id, path, content, {spans('content', 300, 512)} AS f FROM corpus",
    "packed_spans": f"SELECT doc_id, path, content, {finished('f')} AS k FROM packed",
    "line_chunks": """SELECT doc_id, path, i - 1 AS chunk_index, len(k) AS chunk_count, k[i].s AS chunk_start, k[i].e AS chunk_end,
        substr(content, k[i].s + 1, k[i].e - k[i].s) AS text FROM (SELECT *, unnest(range(1, len(k) + 1)) AS i FROM packed_spans)""",
}


# The same tests with the default size limit.
CTES["whole_dispositions"] = CTES["dispositions"].replace("16384", "524288")


def statement(body: str) -> str:
    """``body`` with exactly the views it reaches in front of it."""
    wanted: list[str] = []

    def reach(sql: str) -> None:
        for name, definition in CTES.items():
            if name not in wanted and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", sql):
                reach(definition)
                if name not in wanted:
                    wanted.append(name)

    reach(body)
    head = ", ".join(f"{n} AS ({CTES[n]})" for n in wanted)
    return f"WITH {head} {body}" if head else body

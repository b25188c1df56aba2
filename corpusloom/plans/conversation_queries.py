"""Queries over conversations: tokens, attachments, history, pruning, agent texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import prompting as pr
from corpusloom.functions import settings as st
from corpusloom.functions import text as tx
from corpusloom.functions import tokens as tk
from corpusloom.operators import conversation as cv
from corpusloom.operators import filters as fl
from corpusloom.operators import metrics as mt
from corpusloom.operators.agent import parse_replies
from corpusloom.options import MemoryOptions, ReportOptions
from corpusloom.plans import oracle as o
from corpusloom.plans import views as v
from corpusloom.plans.registry import query
from corpusloom.sources.sessions import list_sessions

LONG = "long"
MEMORY = MemoryOptions(safety_threshold=v.THRESHOLD)
NOW_MS = 1_704_100_000_000
SYSTEM = "Answer from the given context."


# ---- tokens ------------------------------------------------------------------


@query("message_tokens", sql="SELECT conv_id, turn, tokens FROM sized")
def message_tokens(spark, sf):
    return v.messages(spark, sf).select(
        "conv_id", "turn", tk.message_tokens(F.col("role"), F.col("text")).alias("tokens")
    )


@query("count_tokens", sql=f"SELECT doc_id, {o.chars4('text')} AS tokens FROM documents")
def count_tokens(spark, sf):
    return v.table(spark, sf, "documents").select("doc_id", tk.count_tokens(F.col("text")).alias("tokens"))


@query("token_breakdown", sql=f"SELECT conv_id, turn, {o.role('role')} AS role, tokens, left(text, 50) AS preview FROM sized")
def token_breakdown(spark, sf):
    return cv.token_breakdown(v.messages(spark, sf))


@query("conversation_tokens", sql="SELECT conv_id, count(*) AS messages, CAST(sum(tokens) AS BIGINT) AS total_tokens FROM sized GROUP BY conv_id")
def conversation_tokens(spark, sf):
    return cv.conversation_tokens(v.messages(spark, sf))


@query(
    "session_tokens", "session_token_estimate",
    sql="""SELECT conv_id, CAST(round((t + coalesce(a, 0)) / 4) AS BIGINT) AS token_estimate
        FROM (SELECT conv_id, sum(length(text)) AS t FROM conversations GROUP BY conv_id)
        LEFT JOIN (SELECT conv_id, sum(length(content)) AS a FROM attachments GROUP BY conv_id) USING (conv_id)""",
)
def session_tokens(spark, sf):
    return cv.session_tokens(v.with_files(spark, sf))


@query(
    "over_budget",
    sql=f"SELECT conv_id, sum(tokens) > {v.THRESHOLD} AS over FROM sized GROUP BY conv_id",
)
def over_budget(spark, sf):
    totals = cv.conversation_tokens(v.messages(spark, sf))
    return totals.select("conv_id", tk.over_budget(F.col("total_tokens"), v.THRESHOLD).alias("over"))


@query(
    "safety_threshold", "prune_target",
    sql="""SELECT conv_id, CAST(floor(t * 0.8::DOUBLE) AS BIGINT) AS threshold, CAST(floor(floor(t * 0.8::DOUBLE) * 0.6::DOUBLE) AS BIGINT) AS target
        FROM (SELECT conv_id, sum(tokens)::DOUBLE AS t FROM sized GROUP BY conv_id)""",
)
def safety_threshold(spark, sf):
    limit = tk.safety_threshold(F.col("total_tokens"))
    return cv.conversation_tokens(v.messages(spark, sf)).select(
        "conv_id", limit.alias("threshold"), F.floor(limit * 0.6).cast(LONG).alias("target")
    )


@query("map_role", sql=f"SELECT conv_id, turn, {o.role('role')} AS mapped, CASE role WHEN 'assistant' THEN 'ai' ELSE 'human' END AS legacy FROM conversations")
def map_role(spark, sf):
    return v.table(spark, sf, "conversations").select(
        "conv_id", "turn", tk.map_role(F.col("role")).alias("mapped"), tk.map_role(F.col("role"), True).alias("legacy")
    )


# ---- pruning -----------------------------------------------------------------

OBSERVED = "(starts_with(text, 'Observation:') OR starts_with(text, 'Tool:'))"
CUT = f"CASE {o.role('role')} WHEN 'human' THEN 'Observation: {MEMORY.marker}' WHEN 'ai' THEN '{MEMORY.marker}' ELSE text END"


@query("is_observation", sql=f"SELECT conv_id, turn FROM messages WHERE {OBSERVED}")
def is_observation(spark, sf):
    return v.messages(spark, sf).where(cv.is_observation(F.col("text"))).select("conv_id", "turn")


@query("truncate_observation", sql=f"SELECT conv_id, turn, CASE WHEN {OBSERVED} THEN {CUT} ELSE text END AS text FROM messages")
def truncate_observation(spark, sf):
    text = F.col("text")
    cut = cv.truncate_observation(F.col("role"), text, MEMORY.marker)
    return v.messages(spark, sf).select(
        "conv_id", "turn", F.when(cv.is_observation(text), cut).otherwise(text).alias("text")
    )


NUMBERED = """SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS n,
    CAST(sum(tokens) OVER (PARTITION BY conv_id) AS BIGINT) AS total FROM sized"""
KEPT = "(i >= n - 2 OR (i = 0 AND role = 'system'))"
CANDIDATE = f"(i = n - 3 AND NOT {KEPT})"
SHOWN = f"CASE WHEN {OBSERVED} THEN {CUT} ELSE text END"
PRUNE = f"""SELECT *, total > {v.THRESHOLD} AS pruned, {KEPT} AS kept, {CANDIDATE} AND
    {o.message_tokens('role', SHOWN)} + sum(CASE WHEN {KEPT} THEN tokens ELSE 0 END) OVER (PARTITION BY conv_id)
    <= {tk.prune_target(v.THRESHOLD)} AS fits FROM ({NUMBERED})"""


@query("keep_recent", sql=f"SELECT conv_id, turn, role, text FROM ({NUMBERED}) WHERE {KEPT}")
def keep_recent(spark, sf):
    return cv.keep_recent(v.messages(spark, sf), MEMORY)


@query(
    "prune_context",
    sql=f"""SELECT conv_id, turn, role, CASE WHEN pruned AND fits THEN {SHOWN} ELSE text END AS text, pruned AND fits AS restored, pruned
        FROM ({PRUNE}) WHERE NOT pruned OR kept OR fits""",
)
def prune_context(spark, sf):
    return cv.prune_context(v.messages(spark, sf), MEMORY)


@query(
    "prune_summary",
    sql=f"""SELECT conv_id, max(n) AS messages_before, bool_or(pruned) AS pruned, max(total) AS tokens_before,
        CAST(sum(CASE WHEN NOT pruned OR kept THEN tokens WHEN fits THEN {o.message_tokens('role', SHOWN)} ELSE 0 END) AS BIGINT) AS tokens_after,
        max(n) - count(*) FILTER (NOT pruned OR kept OR fits) AS messages_removed,
        CASE WHEN bool_or(pruned) THEN 'Token count exceeded threshold: ' || max(total) || ' > {v.THRESHOLD}'
          ELSE 'Token count within safe threshold' END AS reason FROM ({PRUNE}) GROUP BY conv_id""",
)
def prune_summary(spark, sf):
    return cv.prune_summary(v.messages(spark, sf), MEMORY)


# ---- attachments and history ---------------------------------------------------


@query(
    "dedupe_attachments",
    sql="""SELECT conv_id, name, min(p) AS pos, arg_max(content, p) AS content, arg_max(is_repository, p) AS is_repository
        FROM (SELECT *, turn * 2 + pos AS p FROM attachments) GROUP BY conv_id, name""",
)
def dedupe_attachments(spark, sf):
    attached = v.attachments(spark, sf).withColumn("pos", F.col("turn") * 2 + F.col("pos")).withColumn(
        "is_automatic", F.lit(False)
    )
    return cv.dedupe_attachments(attached, ("conv_id",)).drop("is_automatic")


@query("explicit_attachments", sql="SELECT conv_id, turn, name FROM attachments WHERE NOT is_repository")
def explicit_attachments(spark, sf):
    files = v.with_files(spark, sf).select("conv_id", "turn", F.explode(pr.explicit_files(F.col("files"))).alias("f"))
    return files.select("conv_id", "turn", "f.name")


@query("latest_attachments", sql="SELECT conv_id, turn, base, name, content FROM active_files")
def latest_attachments(spark, sf):
    return cv.latest_attachments(v.with_files(spark, sf)).drop("pos")


@query(
    "flow_type",
    sql="""SELECT conv_id, turn, CASE WHEN h AND r THEN 'DEEP_REACT_AGENT' WHEN h THEN 'LOCAL_RAG' WHEN r THEN 'GLOBAL_REACT_AGENT' ELSE 'DIRECT_LLM' END AS flow
        FROM (SELECT conv_id, turn, turn % 2 = 0 AS r, EXISTS (SELECT 1 FROM attachments a WHERE a.conv_id = c.conv_id AND a.turn = c.turn
            AND NOT a.is_repository) AS h FROM conversations c)""",
)
def flow_type(spark, sf):
    return v.with_files(spark, sf).select(
        "conv_id", "turn", pr.flow_type(F.col("files"), F.col("turn") % 2 == 0).alias("flow")
    )


BLOCK = f"""'<attached_file>' || chr(10) || '<name>' || {o.escape('name')} || '</name>' || chr(10) || '<content>' || chr(10)
    || {o.escape(o.strip_control('content'))} || chr(10) || '</content>' || chr(10) || '</attached_file>'"""
HISTORY = f"""SELECT c.conv_id, c.turn, c.role, coalesce(b || chr(10) || chr(10), '') || 'User instruction:' || chr(10) || text AS text
    FROM conversations c LEFT JOIN (SELECT conv_id, turn, string_agg({BLOCK}, chr(10) || chr(10) ORDER BY pos) AS b FROM active_files
    GROUP BY conv_id, turn) a ON a.conv_id = c.conv_id AND a.turn = c.turn WHERE c.role = 'user'"""


@query("history_user_content", sql=f"SELECT conv_id, turn, text FROM ({HISTORY})")
def history_user_content(spark, sf):
    users = cv.with_active_files(v.with_files(spark, sf)).where(F.col("role") == "user")
    return users.select("conv_id", "turn", pr.history_user_content(F.col("text"), F.col("active")).alias("text"))


def prompts(spark, sf):
    return v.table(spark, sf, "conversations").groupBy("conv_id").agg(
        F.concat(F.lit("Prompt "), F.max("turn").cast("string")).alias("prompt")
    )


BUILT = f"""SELECT c.conv_id, c.turn, c.role, CASE WHEN c.role = 'user' AND c.turn = m THEN 'Prompt ' || m WHEN c.role = 'user' THEN h.text ELSE c.text END AS text
    FROM conversations c JOIN (SELECT conv_id, max(turn) AS m FROM conversations GROUP BY conv_id) l ON l.conv_id = c.conv_id
    LEFT JOIN ({HISTORY}) h ON h.conv_id = c.conv_id AND h.turn = c.turn"""
SYSTEM_ROWS = f"""SELECT conv_id, min(turn) - 1 AS turn, 'system' AS role, '{SYSTEM}' AS text FROM conversations GROUP BY conv_id
    HAVING NOT bool_or(role = 'system')"""


@query("build_messages", sql=f"{BUILT} UNION ALL {SYSTEM_ROWS}")
def build_messages(spark, sf):
    return cv.build_messages(v.with_files(spark, sf), prompts(spark, sf), SYSTEM)


@query("ensure_system", sql=f"SELECT conv_id, turn, role, text FROM conversations UNION ALL {SYSTEM_ROWS}")
def ensure_system(spark, sf):
    return cv.ensure_system(v.table(spark, sf, "conversations"), SYSTEM)


@query(
    "append_turn",
    sql="""SELECT conv_id, turn, role, text FROM conversations UNION ALL
        SELECT conv_id, max(turn) + 1, 'assistant', 'seen ' || max(turn) FROM conversations GROUP BY conv_id UNION ALL
        SELECT conv_id, max(turn) + 2, 'user', 'go on' FROM conversations GROUP BY conv_id""",
)
def append_turn(spark, sf):
    base = v.table(spark, sf, "conversations")
    added = base.groupBy("conv_id").agg(F.concat(F.lit("seen "), F.max("turn").cast("string")).alias("assistant"))
    return cv.append_turn(base, added.withColumn("user", F.lit("go on")))


def stored(spark, sf):
    """Message content as a client stores it: text for replies, objects for users."""
    base = v.with_files(spark, sf)
    files = F.transform(
        "files",
        lambda f: F.struct(f["name"].alias("name"), f["content"].alias("content"), f["is_repository"].alias("isRepository")),
    )
    whole = F.to_json(F.struct(F.col("text").alias("text"), files.alias("filesMetadata")))
    odd = F.when(F.col("turn") % 5 == 4, F.lit('{"tokens": 3}')).otherwise(F.to_json(F.struct(F.col("text").alias("text"))))
    raw = F.when(F.col("role") == "user", whole).otherwise(odd)
    plain = F.col("turn") % 2 == 1
    return base.select("conv_id", "turn", "text", plain.alias("plain"), F.try_parse_json(raw).alias("c"))


@query(
    "message_text",
    sql="SELECT conv_id, turn, CASE WHEN role <> 'user' AND turn % 5 = 4 THEN '' ELSE text END AS text FROM conversations",
)
def message_text(spark, sf):
    return stored(spark, sf).select("conv_id", "turn", st.message_text(F.col("c")).alias("text"))


@query(
    "message_files",
    sql="""SELECT c.conv_id, c.turn, coalesce(names, '') AS names FROM conversations c LEFT JOIN (SELECT conv_id, turn,
        string_agg(name || '=' || is_repository, ',' ORDER BY pos) AS names FROM attachments GROUP BY ALL) a ON a.conv_id = c.conv_id AND a.turn = c.turn""",
)
def message_files(spark, sf):
    files = F.transform(
        st.message_files(F.col("c")), lambda f: F.concat(f["name"], F.lit("="), f["is_repository"].cast("string"))
    )
    return stored(spark, sf).select("conv_id", "turn", F.array_join(files, ",").alias("names"))


# ---- rendering -----------------------------------------------------------------

FILE_BLOCK = f"""'File: ' || {o.escape('name')} || chr(10) || 'Type: ' || {o.file_type_attached('name')} || chr(10) || 'Extension: ' ||
    CASE WHEN {o.attached_extension('name')} = '' THEN 'no extension' ELSE {o.escape(o.attached_extension('name'))} END || chr(10) || '```' || chr(10) ||
    {o.escape(o.strip_control('content'))} || chr(10) || '```'"""
PAYLOAD = f"""SELECT conv_id, turn, string_agg({FILE_BLOCK}, chr(10) || chr(10) ORDER BY pos) AS payload FROM attachments
    WHERE NOT is_repository GROUP BY conv_id, turn"""


@query("target_files_payload", sql=f"SELECT c.conv_id, c.turn, coalesce(payload, '') AS payload FROM conversations c LEFT JOIN ({PAYLOAD}) p ON p.conv_id = c.conv_id AND p.turn = c.turn")
def target_files_payload(spark, sf):
    return v.with_files(spark, sf).select("conv_id", "turn", pr.target_files_payload(F.col("files")).alias("payload"))


TEMPLATE = "Q: {{user_query}} F: {{target_files}} again {{user_query}}"


@query(
    "render_prompt",
    sql=f"""SELECT c.conv_id, c.turn, replace(replace('{TEMPLATE}', '{{{{user_query}}}}', text), '{{{{target_files}}}}', coalesce(payload, '')) AS prompt
        FROM conversations c LEFT JOIN ({PAYLOAD}) p ON p.conv_id = c.conv_id AND p.turn = c.turn""",
)
def render_prompt(spark, sf):
    return v.with_files(spark, sf).select(
        "conv_id", "turn",
        pr.flow_prompt(F.lit(TEMPLATE), pr.flow_type(F.col("files"), F.lit(True)), F.col("text"), F.col("files")).alias("prompt"),
    )


FRAGMENT = "Part {index} {index} of {path}{distance}\n{content}\n"


@query(
    "render_fragment",
    sql="""SELECT doc_id, 'Part ' || doc_id || ' {index} of ' || path || ' d=' || size || chr(10) || content || chr(10) AS text FROM corpus""",
)
def render_fragment(spark, sf):
    return v.corpus(spark, sf).select(
        "doc_id",
        pr.render_fragment(
            F.lit(FRAGMENT), F.col("doc_id"), F.col("path"), F.concat(F.lit(" d="), F.col("size").cast("string")), F.col("content")
        ).alias("text"),
    )


@query(
    "render_file",
    sql=f"SELECT conv_id, turn, name || ' ' || {o.file_type_attached('name')} || ' ' || {o.attached_extension('name')} || ' ' || content AS text FROM attachments",
)
def render_file(spark, sf):
    name = F.col("name")
    return v.attachments(spark, sf).select(
        "conv_id", "turn",
        pr.render_file(F.lit("{name} {type} {extension} {content}"), name, pr.file_type_attached(name), pr.attached_extension(name), F.col("content")).alias("text"),
    )


@query("render_query_label", sql="SELECT item_id, 'Asked: ' || text || ' {prompt}' AS label FROM benchmark")
def render_query_label(spark, sf):
    return v.table(spark, sf, "benchmark").select(
        "item_id", pr.render_query_label(F.lit("Asked: {prompt} {prompt}"), F.col("text")).alias("label")
    )


@query("render_mode", sql="SELECT conv_id, turn, '<' || role || '>' || chr(10) || 'SCOPE ' || turn || chr(10) || 'Instruction: ' || text || chr(10) || '</execution_mode>' AS text FROM conversations")
def render_mode(spark, sf):
    return v.table(spark, sf, "conversations").select(
        "conv_id", "turn",
        pr.render_mode(
            F.concat(F.lit("<"), F.col("role"), F.lit(">")), F.concat(F.lit("SCOPE "), F.col("turn").cast("string")), F.col("text")
        ).alias("text"),
    )


AGENT = ReportOptions()


@query(
    "render_observation",
    sql=f"""SELECT conv_id, CASE WHEN conv_id % 3 = 0 THEN 'Tool: agent_search' || chr(10) || 'Query: q' || conv_id || chr(10) || '{AGENT.no_match}'
        ELSE 'Tool: agent_search' || chr(10) || 'Query: q' || conv_id || chr(10) || chr(10) ||
          string_agg('Result ' || rn || ' | Source: ' || role || chr(10) || '```' || chr(10) || text || chr(10) || '```', chr(10) ORDER BY turn) END AS observation,
        'Tool: agent_search' || chr(10) || 'Query: q' || conv_id || chr(10) || '{AGENT.repeated}' AS repeated
        FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM (SELECT * FROM conversations
          QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= {AGENT.max_matches})) GROUP BY conv_id""",
)
def render_observation(spark, sf):
    """The newest turns of every conversation as the hits of one query; a report lists so many."""
    listed = cv.newest(v.table(spark, sf, "conversations"), AGENT.max_matches).groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", F.col("role").alias("path"), F.col("text").alias("content")))).alias("h")
    )
    asked = F.concat(F.lit("q"), F.col("conv_id").cast("string"))
    hits = F.when(F.col("conv_id") % 3 == 0, F.slice("h", 1, 0)).otherwise(F.col("h"))
    return listed.select(
        "conv_id", pr.observation_text(asked, hits, AGENT).alias("observation"), pr.repeated_text(asked, AGENT).alias("repeated")
    )


# ---- agent replies ---------------------------------------------------------------

FOUND = f"""SELECT *, CASE WHEN p > 0 THEN nullif({o.trim('substr(text, p + 13)')}, '') END AS answer
    FROM (SELECT *, strpos(lower(text), 'final answer:') AS p FROM agent_turns)"""
ACTION_LINE = r"(?i)^action:\s*[a-z_]*search\s*\((.*)\)$"
ACTION = f"""SELECT conv_id, turn, nullif(CASE WHEN length(raw) >= 2 AND ((starts_with(raw, '"') AND ends_with(raw, '"')) OR (starts_with(raw, '''') AND ends_with(raw, '''')))
    THEN {o.trim('substr(raw, 2, length(raw) - 2)')} ELSE raw END, '') AS query FROM (SELECT conv_id, turn, {o.trim(f"regexp_extract(lines[1], '{ACTION_LINE}', 1)")} AS raw
    FROM (SELECT conv_id, turn, list_filter(list_transform(regexp_split_to_array(text, '\\r?\\n'), lambda x: {o.trim('x')}),
    lambda x: regexp_matches(x, '{ACTION_LINE}')) AS lines FROM agent_turns))"""


@query("final_answer", sql=f"SELECT conv_id, turn, answer FROM ({FOUND})")
def final_answer(spark, sf):
    return v.agent_turns(spark, sf).select("conv_id", "turn", pr.final_answer(F.col("text")).alias("answer"))


@query(
    "is_placeholder_answer",
    sql=f"""SELECT conv_id, turn, a = '' OR contains(a, '[your comprehensive') OR contains(a, '[your answer') OR contains(a, 'your comprehensive, professional')
        OR a = '<your answer>' AS placeholder FROM (SELECT conv_id, turn, lower(coalesce(answer, '')) AS a FROM ({FOUND}))""",
)
def is_placeholder_answer(spark, sf):
    return parse_replies(v.agent_turns(spark, sf)).select("conv_id", "turn", "placeholder")


@query("action_query", sql=ACTION)
def action_query(spark, sf):
    return v.agent_turns(spark, sf).select("conv_id", "turn", pr.action_query(F.col("text")).alias("query"))


def steps(spark, sf):
    return v.agent_turns(spark, sf).select(
        "conv_id", F.col("turn").alias("step"), pr.action_query(F.col("text")).alias("query")
    ).where("query IS NOT NULL")


@query(
    "duplicate_queries",
    sql=f"SELECT conv_id, turn AS step, query, row_number() OVER (PARTITION BY conv_id, lower(query) ORDER BY turn) > 1 AS repeated FROM ({ACTION}) WHERE query IS NOT NULL",
)
def duplicate_queries(spark, sf):
    return cv.duplicate_queries(steps(spark, sf))


@query(
    "agent_totals",
    sql=f"""SELECT conv_id, count(query) AS tool_calls, CAST(sum(turn % 6) AS BIGINT) AS retrieved_matches,
        CAST(sum({o.chars4('text')}) AS BIGINT) AS tokens, CAST(sum(length(text)) AS BIGINT) AS server_tokens
        FROM ({ACTION}) JOIN agent_turns USING (conv_id, turn) GROUP BY conv_id""",
)
def agent_totals(spark, sf):
    text = F.col("text")
    return mt.agent_totals(
        v.agent_turns(spark, sf).select(
            "conv_id", pr.action_query(text).isNotNull().alias("is_call"), (F.col("turn") % 6).alias("matches"),
            tk.chars4(text).alias("tokens"), F.length(text).cast(LONG).alias("server_tokens"),
        )
    )


@query(
    "references", "sorted_references",
    sql='SELECT label, array_to_string(list_sort(list(DISTINCT path)), \'|\') AS "references" FROM (SELECT label, source || \'/\' || lang AS path FROM embeddings JOIN documents ON doc_id = vec_id) GROUP BY label',
)
def references(spark, sf):
    docs = v.table(spark, sf, "documents").select(F.col("doc_id").alias("vec_id"), F.concat_ws("/", "source", "lang").alias("path"))
    hits = v.table(spark, sf, "embeddings").select("vec_id", F.col("label").cast("int").alias("label")).join(docs, "vec_id")
    return mt.references(hits.select(F.col("label").cast(LONG).alias("label"), "path"), "label").select(
        "label", F.array_join("references", "|").alias("references")
    )


# ---- sessions and settings -------------------------------------------------------

CREATED = f"{NOW_MS} - conv_id * conv_id * 37000"
TITLED = "CASE WHEN conv_id % 3 = 0 THEN 'File x' || chr(10) || 'User instruction:' || chr(10) || text WHEN conv_id % 7 = 0 THEN left(text, 20) ELSE text END"
AGE = f"""CASE WHEN m < 1 THEN 'Just now' WHEN m < 60 THEN m || ' min ago' WHEN m // 60 < 24 THEN (m // 60) || ' h ago'
    WHEN m // 1440 = 1 THEN 'Yesterday' ELSE (m // 1440) || ' days ago' END"""


def opened(spark, sf):
    conv = F.col("conv_id")
    text = (
        F.when(conv % 3 == 0, F.concat(F.lit("File x\nUser instruction:\n"), F.col("text")))
        .when(conv % 7 == 0, F.left("text", F.lit(20)))
        .otherwise(F.col("text"))
    )
    return v.table(spark, sf, "conversations").select(
        conv.alias("session_id"), F.col("turn"), conv.alias("insert_seq"), text.alias("first_text"),
        (F.lit(NOW_MS) - conv * conv * 37000).alias("created_at"),
    )


@query("session_title", sql=f"SELECT conv_id AS session_id, turn, {o.title('t')} AS title FROM (SELECT conv_id, turn, {TITLED} AS t FROM conversations)")
def session_title(spark, sf):
    return opened(spark, sf).select("session_id", "turn", tx.session_title(F.col("first_text")).alias("title"))


@query("relative_time", sql=f"SELECT conv_id AS session_id, turn, {AGE} AS age FROM (SELECT conv_id, turn, ({NOW_MS} - ({CREATED})) // 60000 AS m FROM conversations)")
def relative_time(spark, sf):
    return opened(spark, sf).select("session_id", "turn", tx.relative_time(F.col("created_at"), F.lit(NOW_MS)).alias("age"))


@query("list_sessions", sql=f"""SELECT session_id, session_id AS insert_seq, {o.title('t')} AS title, {AGE} AS age FROM
    (SELECT conv_id AS session_id, ({NOW_MS} - ({CREATED})) // 60000 AS m, {TITLED} AS t FROM
     (SELECT conv_id, arg_min(text, turn) AS text FROM conversations GROUP BY conv_id))""")
def list_all_sessions(spark, sf):
    first = opened(spark, sf).groupBy("session_id", "insert_seq", "created_at").agg(
        F.min_by("first_text", "turn").alias("first_text")
    )
    return list_sessions(first, NOW_MS)


@query("duration_seconds", sql="SELECT event_id, printf('%.2f', CAST(round(value * 1000) AS BIGINT) / 1000) AS seconds FROM events")
def duration_seconds(spark, sf):
    return v.requests(spark, sf).select("event_id", tx.duration_seconds(F.col("duration_ms")).alias("seconds"))


def props(spark, sf):
    """Server properties of every layout, made of events."""
    i, kind = F.col("event_id"), F.col("event_type")

    def js(template):
        return F.replace(F.replace(F.lit(template), F.lit("@t"), kind), F.lit("@i"), i.cast("string"))

    raw = (
        F.when(i % 6 == 0, js('{"model": " @t-@i ", "n_ctx": @i}'))
        .when(i % 6 == 1, js('{"model_name": "  ", "default_generation_settings": {"n_ctx": @i, "params": {"model": "@t"}}}'))
        .when(i % 6 == 2, js('{"model_path": "/models/@t/@i.gguf", "n_ctx": "12"}'))
        .when(i % 6 == 3, js('{"default_generation_settings": {"n_ctx": @i.5, "params": {"model_path": "c:\\\\m\\\\@t.gguf"}}}'))
        .when(i % 6 == 4, js('{"model_alias": "@t", "model_name": 7}'))
        .otherwise(F.lit("not json"))
    )
    return v.table(spark, sf, "events").select("event_id", F.try_parse_json(raw).alias("p"))


@query(
    "model_name",
    sql="""SELECT event_id, CASE event_id % 6 WHEN 0 THEN event_type || '-' || event_id WHEN 1 THEN event_type WHEN 2 THEN event_id || '.gguf'
        WHEN 3 THEN event_type || '.gguf' WHEN 4 THEN event_type ELSE 'local' END AS name FROM events""",
)
def model_name(spark, sf):
    return props(spark, sf).select("event_id", st.model_name(F.col("p")).alias("name"))


@query(
    "context_window",
    sql="SELECT event_id, CASE WHEN event_id % 6 IN (0, 1, 3) THEN event_id ELSE 0 END AS n_ctx FROM events",
)
def context_window(spark, sf):
    return props(spark, sf).select("event_id", st.context_window(F.col("p")).alias("n_ctx"))


@query("metadata_string", sql="SELECT event_id, 'none' AS text, CASE WHEN event_id % 2 = 0 THEN 'v' || event_type ELSE '' END AS kind FROM events")
def metadata_string(spark, sf):
    """``k`` is a number in every record, ``kind`` is absent from half of them."""
    extra = F.concat(F.lit('{"kind": "v'), F.col("event_type"), F.lit('", "k": 1}'))
    raw = F.when(F.col("event_id") % 2 == 0, extra).otherwise(F.col("props"))
    rows = v.table(spark, sf, "events").select("event_id", F.try_parse_json(raw).alias("m"))
    return rows.select("event_id", st.metadata_string(F.col("m"), "k", "none").alias("text"),
                       st.metadata_string(F.col("m"), "kind").alias("kind"))


SECTION = {"header": "<mode>", "scope": "all", "instruction": "read"}


@query(
    "merge_template",
    sql="""SELECT conv_id, turn, CASE WHEN turn % 4 = 3 THEN '<mode>' ELSE '<' || role || '>' END AS header, 'all' AS scope,
        CASE WHEN turn % 4 = 0 THEN 'do ' || turn ELSE 'read' END AS instruction,
        CASE WHEN turn % 4 = 1 THEN 'new' WHEN turn % 4 = 2 THEN 'old' ELSE 'system' END AS system_prompt, 'user' AS user_prompt FROM conversations""",
)
def merge_template(spark, sf):
    turn = F.col("turn")
    head = F.concat(F.lit('"header": "<'), F.col("role"), F.lit('>"'))
    raw = (
        F.when(turn % 4 == 0, F.concat(F.lit('{"mode": {'), head, F.lit(', "instruction": "do '), turn.cast("string"), F.lit('"}}')))
        .when(turn % 4 == 1, F.concat(F.lit('{"system": "old", "systemPrompt": "new", "mode": {'), head, F.lit("}}")))
        .when(turn % 4 == 2, F.concat(F.lit('{"system": "old", "mode": {'), head, F.lit("}}")))
    )
    rows = v.table(spark, sf, "conversations").select("conv_id", "turn", F.try_parse_json(raw).alias("t"))
    return rows.select(
        "conv_id", "turn", st.merge_section(F.col("t"), "mode", SECTION).alias("s"),
        st.merge_conversation_template(F.col("t"), "system", "user").alias("c"),
    ).select("conv_id", "turn", "s.*", "c.*")


@query(
    "config_coalesce",
    sql="SELECT user_id, coalesce(max(CASE WHEN event_type = 'click' THEN value END), max(CASE WHEN event_type = 'error' THEN value END), -1.0) AS setting FROM events GROUP BY user_id",
)
def config_coalesce(spark, sf):
    """Settings rows per user: ``click`` is the key, ``error`` its older name."""
    def setting(name):
        return F.max(F.when(F.col("event_type") == name, F.col("value")))

    rows = v.table(spark, sf, "events").groupBy("user_id")
    return rows.agg(st.config_coalesce(setting("click"), setting("error"), -1.0).alias("setting"))


@query(
    "validate_payload",
    sql="""SELECT doc_id, reject_reason IS NULL AS valid, reject_reason FROM (SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN NULL
        WHEN 1 THEN CASE WHEN length(t) > 100000 THEN 'bad prompt' WHEN doc_id % 32 = 9 THEN 'bad flag' END WHEN 2 THEN 'bad attachment'
        WHEN 3 THEN CASE doc_id % 32 WHEN 11 THEN 'bad flag' WHEN 27 THEN 'unknown type' END
        WHEN 4 THEN 'bad tab' WHEN 5 THEN 'no session' WHEN 6 THEN CASE WHEN length(t) > 1000000 THEN 'bad code' END
        ELSE 'no type' END AS reject_reason FROM (SELECT doc_id, CASE WHEN doc_id % 16 = 1 THEN repeat(text, 400) ELSE text END AS t FROM documents))""",
)
def validate_payload(spark, sf):
    doc = F.col("doc_id")
    kinds = ("indexAll", "ask", "ask", "format", "setActiveTab", "deleteSession", "applyCode")
    flagged = (doc % 8 == 3) & (doc % 32 != 27)
    kind = F.when(flagged, F.when(doc % 32 == 19, F.lit("setSettingsAccordionState")).otherwise(F.lit("setRagEnabled"))).when(
        doc % 8 != 7, F.get(F.array(*map(F.lit, kinds)), (doc % 8).cast("int"))
    )
    flag = F.when(doc % 32 == 9, F.lit("maybe")).when(doc % 32 == 11, F.lit("1")).otherwise(F.lit("true"))
    flags = F.when(flagged | (doc % 32 == 9), F.create_map(F.lit("rag_enabled"), flag, F.lit("open"), F.lit("false")))
    value = F.when(doc % 16 == 1, F.repeat("text", F.lit(400))).when(doc % 8 == 5, F.lit("")).otherwise(F.col("text"))
    files = F.when(doc % 8 == 2, F.array(F.struct(F.lit("").alias("name"), F.col("text").alias("content"))))
    rows = v.table(spark, sf, "documents").select("doc_id", kind.alias("type"), value.alias("value"), files.alias("attached_files"), flags.alias("flags"))
    return fl.validate_payload(rows, sections=("open",)).select("doc_id", "valid", "reject_reason")

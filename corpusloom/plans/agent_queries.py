"""Queries over model calls: search reports, generation, agent runs, replies."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions.models import embed, generate
from corpusloom.operators import agent as ag
from corpusloom.operators import search as se
from corpusloom.options import SearchOptions
from corpusloom.plans import oracle as o
from corpusloom.plans import views as v
from corpusloom.plans.registry import query
from corpusloom.plans.search_queries import SEARCHABLE
from corpusloom.plans.store_queries import profile
from corpusloom.plans.stubs import AGENT, make_counter_reply, make_embed, make_generate
from corpusloom.session import fresh_path
from corpusloom.sources.collections import read_collection, replace_collection

LONG = "long"
OPTIONS = SearchOptions(digits=6, trust_content=True)


def embedded_chunks(spark, sf):
    return embed(v.corpus_chunks(spark, sf), "content", make_embed)


def collection(spark, sf):
    """The embedded chunks written as a collection: an agent reads it every round."""
    path = fresh_path(spark, "agent-collection")
    replace_collection(embedded_chunks(spark, sf), path, "docs_1")
    return read_collection(spark, path, "docs_1")


def hits_sql(asked: str, k: int = 5) -> str:
    """Ranked hits of (query_id, text) rows over letter-count vectors of all documents."""
    return f"""SELECT query_id, rank, path, content FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY combined DESC, distance, id) AS rank
        FROM (SELECT *, round(1 / (1 + distance) * 0.7 + {o.ratio('t', 's')} * 0.3, 6) AS combined FROM (
          SELECT query_id, id, path, content, distance, {SEARCHABLE} AS s, {o.tokens('text')} AS t, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS pool_rank
          FROM (SELECT *, round(list_distance(qv, cv) ** 2, 6) AS distance FROM (SELECT query_id, text, {profile(o.trim('text'))} AS qv FROM ({asked}))
            CROSS JOIN (SELECT *, {profile(o.trim('content'))} AS cv FROM corpus_chunks))) WHERE pool_rank <= 50)) WHERE rank <= {k}"""


ITEMS = "SELECT item_id AS query_id, text FROM benchmark"
REPORT = """'Tool: agent_search' || chr(10) || 'Query: ' || any_value(q.text) || chr(10) || chr(10) || string_agg('Result ' || rank || ' | Source: ' || path || chr(10)
    || '```' || chr(10) || content || chr(10) || '```', chr(10) ORDER BY rank)"""


@query(
    "agent_search",
    sql=f"""SELECT query_id, count(*) AS matches, string_agg(path, '|' ORDER BY rank) AS paths, md5({REPORT}) AS observation_md5
        FROM ({hits_sql(ITEMS)}) JOIN ({ITEMS}) q USING (query_id) GROUP BY query_id""",
)
def agent_search(spark, sf):
    items = v.table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.concat(F.lit(" "), F.col("text")).alias("text"))
    found = se.agent_search(embed(items, "text", make_embed), embedded_chunks(spark, sf), OPTIONS)
    return found.select(
        "query_id", F.col("matches").cast(LONG).alias("matches"), F.array_join("paths", "|").alias("paths"),
        F.md5("observation").alias("observation_md5"),
    )


@query("generate", sql="SELECT conv_id, count(*) || ' ' || arg_max(role, turn) AS text, count(*) AS tokens FROM conversations GROUP BY conv_id")
def generate_replies(spark, sf):
    return generate(v.table(spark, sf, "conversations"), make_counter_reply).select("conv_id", "text", "tokens")


WORDS = r"""SELECT conv_id AS query_id, regexp_split_to_array(trim(text), '\s+')[1] AS text FROM (SELECT conv_id, arg_max(text, turn) AS text FROM conversations GROUP BY conv_id)"""
SYSTEM = "Search before you answer."


def last_text(spark, sf):
    return v.table(spark, sf, "conversations").groupBy("conv_id").agg(F.max_by("text", "turn").alias("prompt"))


@query(
    "batch_agent",
    sql=f"""SELECT query_id AS conv_id, 'about ' || any_value(q.text) AS text, CAST(2 AS BIGINT) AS tokens, CAST(2 AS BIGINT) AS server_tokens,
        CAST(1 AS BIGINT) AS tool_calls, count(*) AS retrieved_matches, array_to_string(list_sort(list(path)), '|') AS "references", NULL::VARCHAR AS error
        FROM ({hits_sql(WORDS)}) JOIN ({WORDS}) q USING (query_id) GROUP BY query_id""",
)
def batch_agent(spark, sf):
    out = ag.batch_agent(
        v.table(spark, sf, "conversations"), last_text(spark, sf), collection(spark, sf), make_generate, make_embed,
        SYSTEM, AGENT, search=OPTIONS,
    )
    return out.withColumn("references", F.array_join("references", "|"))


TEMPLATES = {
    "DIRECT_LLM": ("direct", "{{user_query}}"),
    "LOCAL_RAG": ("local", "{{user_query}}\n{{target_files}}"),
    "GLOBAL_REACT_AGENT": ("global", "{{user_query}}"),
    "DEEP_REACT_AGENT": ("deep", "{{user_query}}\n{{target_files}}"),
}


@query(
    "batch_reply",
    sql=f"""SELECT conv_id, flow, CASE WHEN conv_id % 2 = 0 THEN 'about ' || w.text ELSE 'Thought: look' || chr(10) || 'Action: agent_search("' || w.text || '")' END AS text,
        CAST(CASE WHEN conv_id % 2 = 0 THEN 1 ELSE 0 END AS BIGINT) AS tool_calls, CAST(CASE WHEN conv_id % 2 = 0 THEN 5 ELSE 0 END AS BIGINT) AS retrieved_matches
        FROM (SELECT conv_id, CASE WHEN conv_id % 3 = 0 THEN CASE WHEN conv_id % 2 = 0 THEN 'DEEP_REACT_AGENT' ELSE 'LOCAL_RAG' END
          WHEN conv_id % 2 = 0 THEN 'GLOBAL_REACT_AGENT' ELSE 'DIRECT_LLM' END AS flow FROM conversations GROUP BY conv_id) JOIN ({WORDS}) w ON w.query_id = conv_id""",
)
def batch_reply(spark, sf):
    file = F.struct(
        F.lit("a.ts").alias("name"), F.col("prompt").alias("content"), F.lit(False).alias("is_automatic"),
        (F.col("conv_id") % 3 != 0).alias("is_repository"),
    )
    requests = last_text(spark, sf).withColumn("files", F.array(file)).withColumn("rag_enabled", F.col("conv_id") % 2 == 0)
    out = ag.batch_reply(
        v.table(spark, sf, "conversations"), requests, TEMPLATES, collection(spark, sf), make_generate, make_embed,
        AGENT, search=OPTIONS,
    )
    return out.select("conv_id", "flow", "text", "tool_calls", "retrieved_matches")

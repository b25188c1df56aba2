"""Batch agent runs: whole tables of conversations, a few rounds, one model call each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import prompting as pr
from corpusloom.functions.models import embed, generate
from corpusloom.operators.conversation import append_turn, build_messages, prune_context
from corpusloom.operators.metrics import references
from corpusloom.operators.search import agent_search, search_hybrid
from corpusloom.options import AgentOptions, MemoryOptions, SearchOptions
from corpusloom.session import checkpoint


def parse_replies(replies: DataFrame) -> DataFrame:
    """Answer, placeholder flag and action query of each reply text."""
    answer = pr.final_answer(F.col("text"))
    return replies.withColumn("answer", answer).withColumn(
        "placeholder", pr.is_placeholder(answer)
    ).withColumn("action", pr.action_query(F.col("text")))


def _pruned(messages: DataFrame, memory: MemoryOptions) -> DataFrame:
    """Pruned messages with turns that put a restored message first."""
    cut = prune_context(messages, memory)
    turn = F.when(F.col("restored"), F.lit(-2).cast("long")).otherwise(F.col("turn").cast("long"))
    return cut.select("conv_id", turn.alias("turn"), "role", "text")


def batch_agent(
    messages: DataFrame,
    prompts: DataFrame,
    chunks: DataFrame | None,
    make_generate: Callable,
    make_embed: Callable,
    system_prompt,
    agent: AgentOptions,
    memory: MemoryOptions = MemoryOptions(),
    search: SearchOptions = SearchOptions(),
    max_request_tokens: int | None = None,
    retrieve: Callable[..., DataFrame] = search_hybrid,
) -> DataFrame:
    """Answer every conversation in at most ``max_rounds`` rounds of search.

    All open conversations take one round together: prune, generate, read the
    reply, then either accept the answer, ask for a search first, ask for a
    readable reply, refuse a repeated query or report its hits. What is still
    open afterwards gets one forced answer. A conversation whose request is
    longer than ``max_request_tokens`` ends with its error and no text.
    ``retrieve(queries, chunks, options)`` finds the hits. Each round is written to the
    shared folder, so a lost executor costs one round and never a second call
    of the model for finished rounds.
    """
    working = checkpoint(
        build_messages(messages, prompts, system_prompt).withColumn("turn", F.col("turn").cast("long"))
    )
    zero = F.lit(0).cast("long")
    state = working.select("conv_id").distinct().select(
        "conv_id", zero.alias("tool_calls"), zero.alias("retrieved_matches"), zero.alias("tokens"),
        zero.alias("server_tokens"), F.lit(None).cast("string").alias("answer"), F.lit(None).cast("string").alias("error"),
    )
    state = checkpoint(state)
    asked = state.select("conv_id", F.lit("").alias("key")).limit(0)
    seen = state.select("conv_id", F.lit("").alias("path")).limit(0)

    for _ in range(agent.max_rounds):
        open_ones = state.where(F.col("answer").isNull() & F.col("error").isNull())
        if open_ones.isEmpty():
            break
        now = checkpoint(_pruned(working.join(open_ones, "conv_id", "left_semi"), memory))
        replies = checkpoint(parse_replies(generate(now, make_generate, max_request_tokens)).withColumnRenamed("answer", "found"))
        told = checkpoint(_observed(_classified(replies, state, asked), chunks, make_embed, agent, search, retrieve))
        going_on = told.where(~F.col("kind").isin("answer", "error"))
        working = append_turn(
            now.join(going_on, "conv_id", "left_semi"),
            going_on.select(
                "conv_id", F.coalesce("text", F.lit("")).alias("assistant"), F.col("user_text").alias("user")
            ),
        )
        asked = asked.unionByName(
            told.where(F.col("kind") == "search").select("conv_id", F.lower("action").alias("key"))
        )
        seen = seen.unionByName(told.select("conv_id", F.explode("paths").alias("path")))
        state = checkpoint(_advanced(state, told))

    left = state.where(F.col("answer").isNull() & F.col("error").isNull())
    if not left.isEmpty():
        now = _pruned(working.join(left, "conv_id", "left_semi"), memory)
        last = now.groupBy("conv_id").agg((F.max("turn") + 1).alias("turn"))
        ask = last.select("conv_id", "turn", F.lit("user").alias("role"), F.lit(agent.answer_now).alias("text"))
        replies = checkpoint(parse_replies(generate(now.unionByName(ask), make_generate, max_request_tokens)))
        real = F.col("answer").isNotNull() & ~F.col("placeholder")
        forced = replies.select(
            "conv_id",
            F.when(F.col("error").isNull(), F.when(real, F.col("answer")).otherwise(F.trim(F.coalesce("text", F.lit(""))))).alias("_answer"),
            F.col("error").alias("_error"),
            F.col("tokens").alias("_tokens"),
            F.col("server_tokens").alias("_server"),
        )
        state = state.join(forced, "conv_id", "left").select(
            "conv_id", "tool_calls", "retrieved_matches",
            (F.col("tokens") + F.coalesce("_tokens", F.lit(0))).alias("tokens"),
            (F.col("server_tokens") + F.coalesce("_server", F.lit(0))).alias("server_tokens"),
            F.coalesce("answer", "_answer").alias("answer"),
            F.coalesce("error", "_error").alias("error"),
        )
    cited = references(seen)
    return state.join(cited, "conv_id", "left").select(
        "conv_id",
        F.col("answer").alias("text"),
        "tokens", "server_tokens", "tool_calls", "retrieved_matches",
        F.coalesce("references", F.array().cast("array<string>")).alias("references"),
        "error",
    )


def _classified(replies: DataFrame, state: DataFrame, asked: DataFrame) -> DataFrame:
    """What each reply calls for, in the order the rules are tried."""
    real = F.col("found").isNotNull() & ~F.col("placeholder")
    keyed = replies.join(state.select("conv_id", "tool_calls"), "conv_id").withColumn("key", F.lower("action"))
    marked = keyed.join(asked.withColumn("_again", F.lit(True)), ["conv_id", "key"], "left")
    kind = (
        F.when(F.col("error").isNotNull(), F.lit("error"))
        .when(real & (F.col("tool_calls") > 0), F.lit("answer"))
        .when(real, F.lit("early"))
        .when(F.col("action").isNull(), F.lit("format"))
        .when(F.col("_again"), F.lit("repeat"))
        .otherwise(F.lit("search"))
    )
    return marked.withColumn("kind", kind).drop("_again", "key", "tool_calls")


def _observed(step, chunks, make_embed, agent, search, retrieve) -> DataFrame:
    """Each step with the user turn that follows it and the paths it consulted."""
    queries = step.where(F.col("kind") == "search").select(F.col("conv_id").alias("query_id"), F.col("action").alias("text"))
    if chunks is None:
        report = queries.select(
            F.col("query_id").alias("conv_id"), F.lit(0).alias("matches"),
            F.array().cast("array<string>").alias("paths"),
            F.concat(F.lit(f"Tool: {agent.tool_name}\nQuery: "), F.col("text"), F.lit("\n" + agent.unavailable)).alias(
                "observation"
            ),
        )
    else:
        # conversations ask for the same things: each text is embedded and searched once
        asked = checkpoint(queries.groupBy("text").agg(F.min("query_id").alias("query_id")), "searches")
        found = agent_search(embed(asked, "text", make_embed), chunks, search, agent, retrieve).select(
            "query_id", "matches", "paths", "observation"
        )
        report = queries.join(asked.join(found, "query_id").drop("query_id"), "text").select(
            F.col("query_id").alias("conv_id"), "matches", "paths", "observation"
        )
    text = (
        F.when(F.col("kind") == "early", F.lit(agent.search_first))
        .when(F.col("kind") == "format", F.lit(agent.fix_format))
        .when(F.col("kind") == "repeat", pr.continuation(pr.repeated_text(F.col("action"), agent), agent))
        .when(F.col("kind") == "search", pr.continuation(F.col("observation"), agent))
    )
    return step.join(report, "conv_id", "left").select(
        *step.columns,
        F.coalesce("matches", F.lit(0)).alias("matches"),
        F.coalesce("paths", F.array().cast("array<string>")).alias("paths"),
        text.alias("user_text"),
    )


def _advanced(state: DataFrame, told: DataFrame) -> DataFrame:
    """Totals after a round; a refused query counts as a tool call too."""
    called = F.col("kind").isin("search", "repeat")
    moved = told.select(
        "conv_id",
        called.cast("long").alias("_calls"),
        F.col("matches").cast("long").alias("_matches"),
        F.col("tokens").alias("_tokens"),
        F.col("server_tokens").alias("_server"),
        F.when(F.col("kind") == "answer", F.col("found")).alias("_answer"),
        F.when(F.col("kind") == "error", F.col("error")).alias("_error"),
    )

    def plus(name, other):
        return (F.col(name) + F.coalesce(other, F.lit(0))).alias(name)

    return state.join(moved, "conv_id", "left").select(
        "conv_id", plus("tool_calls", "_calls"), plus("retrieved_matches", "_matches"), plus("tokens", "_tokens"),
        plus("server_tokens", "_server"), F.coalesce("answer", "_answer").alias("answer"),
        F.coalesce("error", "_error").alias("error"),
    )


def batch_reply(
    messages: DataFrame,
    requests: DataFrame,
    templates: dict[str, tuple[str, str]],
    chunks: DataFrame | None,
    make_generate: Callable,
    make_embed: Callable,
    agent: AgentOptions,
    memory: MemoryOptions = MemoryOptions(),
    search: SearchOptions = SearchOptions(),
    max_request_tokens: int | None = None,
    retrieve: Callable[..., DataFrame] = search_hybrid,
) -> DataFrame:
    """Reply to every request (conv_id, prompt, files, rag_enabled).

    The flow of a request picks its template (system, user) and whether the
    agent runs or the model is called once. All requests of a kind run
    together. A request that was refused has its error and no text.
    """
    flow = pr.flow_type(F.col("files"), F.col("rag_enabled"))
    table = F.create_map(
        *[x for name, pair in templates.items() for x in (F.lit(name), F.struct(
            F.lit(pair[0]).alias("system_prompt"), F.lit(pair[1]).alias("user_prompt")))]
    )
    routed = requests.withColumn("flow", flow).withColumn("_t", F.element_at(table, F.col("flow")))
    routed = checkpoint(
        routed.select(
            "conv_id", "flow", F.col("_t.system_prompt").alias("system_prompt"),
            pr.flow_prompt(F.col("_t.user_prompt"), F.col("flow"), F.col("prompt"), F.col("files")).alias("prompt"),
        )
    )
    react = F.col("flow").isin("GLOBAL_REACT_AGENT", "DEEP_REACT_AGENT")
    deep = routed.where(react)
    parts = []
    if not deep.isEmpty():
        run = batch_agent(
            messages.join(deep, "conv_id", "left_semi"), deep.select("conv_id", "prompt"), chunks, make_generate,
            make_embed, deep.select("conv_id", "system_prompt"), agent, memory, search, max_request_tokens, retrieve,
        )
        parts.append(checkpoint(run))
    plain = routed.where(~react)
    if not parts or not plain.isEmpty():  # without any request: no rows, of the same columns
        history = build_messages(
            messages.join(plain, "conv_id", "left_semi"), plain.select("conv_id", "prompt"),
            plain.select("conv_id", "system_prompt"),
        )
        zero = F.lit(0).cast("long")
        parts.append(
            checkpoint(
                generate(history, make_generate, max_request_tokens).select(
                    "conv_id", "text", "tokens", "server_tokens", zero.alias("tool_calls"),
                    zero.alias("retrieved_matches"), F.array().cast("array<string>").alias("references"), "error",
                )
            )
        )
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return out.join(routed.select("conv_id", "flow"), "conv_id")

"""Operators over messages (conv_id, turn, role, text [, files]).

No step gathers a conversation in one task: per-conversation facts are partial
aggregates or per-task top-n, joined back to the messages. A conversation that
holds a large part of all rows is spread by the adaptive skew join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import prompting as pr
from corpusloom.functions import tokens as tk
from corpusloom.functions.tokens import Counter, chars4
from corpusloom.options import MemoryOptions


# ---- tokens ----------------------------------------------------------------


def token_breakdown(messages: DataFrame, counter: Counter = chars4) -> DataFrame:
    """Turn, counted role, tokens and the first 50 characters of each message."""
    return messages.select(
        "conv_id",
        "turn",
        tk.map_role(F.col("role")).alias("role"),
        tk.message_tokens(F.col("role"), F.col("text"), counter).alias("tokens"),
        F.substring(F.coalesce("text", F.lit("")), 1, 50).alias("preview"),
    )


def conversation_tokens(messages: DataFrame, counter: Counter = chars4) -> DataFrame:
    return (
        messages.select("conv_id", tk.message_tokens(F.col("role"), F.col("text"), counter).alias("tokens"))
        .groupBy("conv_id")
        .agg(F.count("*").alias("messages"), F.sum("tokens").alias("total_tokens"))
    )


def session_tokens(messages: DataFrame) -> DataFrame:
    """Characters of texts and attachments over four, rounded, per conversation."""
    chars = F.length(F.coalesce("text", F.lit(""))).cast("long")
    if "files" in messages.columns:
        chars = chars + F.aggregate(
            F.coalesce("files", F.array()),
            F.lit(0).cast("long"),
            lambda s, f: s + F.coalesce(F.length(f["content"]), F.lit(0)).cast("long"),
        )
    return (
        messages.select("conv_id", chars.alias("chars"))
        .groupBy("conv_id")
        .agg(F.round(F.sum("chars") / 4).cast("long").alias("token_estimate"))
    )


# ---- attachments -----------------------------------------------------------


def dedupe_attachments(attached: DataFrame, keys=("conv_id", "turn")) -> DataFrame:
    """One attachment per exact name: last value, first position."""
    return attached.groupBy(*keys, "name").agg(
        F.min("pos").alias("pos"),
        F.max_by("content", "pos").alias("content"),
        F.coalesce(F.max_by("is_automatic", "pos"), F.lit(False)).alias("is_automatic"),
        F.coalesce(F.max_by("is_repository", "pos"), F.lit(False)).alias("is_repository"),
    )


def latest_turns(messages: DataFrame) -> DataFrame:
    """Last user turn per (conversation, attachment base name)."""
    named = (
        messages.where(F.col("role") == "user")
        .select("conv_id", "turn", F.explode(pr.explicit_files(F.col("files"))).alias("f"))
        .select("conv_id", "turn", pr.file_base(F.col("f")).alias("base"))
    )
    return named.groupBy("conv_id", "base").agg(F.max("turn").alias("last_turn"))


def latest_attachments(messages: DataFrame) -> DataFrame:
    """Keep an attachment only in the last user message that names its base."""
    spread = (
        messages.where(F.col("role") == "user")
        .select("conv_id", "turn", F.posexplode(pr.explicit_files(F.col("files"))).alias("pos", "f"))
        .withColumn("base", pr.file_base(F.col("f")))
    )
    return (
        spread.join(latest_turns(messages), ["conv_id", "base"])
        .where(F.col("turn") == F.col("last_turn"))
        .select("conv_id", "turn", "pos", "base", F.col("f.name").alias("name"), F.col("f.content").alias("content"))
    )


def with_active_files(messages: DataFrame) -> DataFrame:
    """Each message with its still-current attachments as one array.

    The re-grouped array is as large as the message's own list, never more.
    """
    if "files" not in messages.columns:
        return messages.withColumn("active", F.array().cast("array<struct<pos:int,name:string,content:string>>"))
    active = (
        latest_attachments(messages)
        .groupBy("conv_id", "turn")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "name", "content"))).alias("active"))
    )
    return messages.join(active, ["conv_id", "turn"], "left")


# ---- history ---------------------------------------------------------------


def ensure_system(messages: DataFrame, system_prompt) -> DataFrame:
    """Prepend a system row to conversations without one.

    ``system_prompt`` is a text or a DataFrame (conv_id, system_prompt). The
    new row has the turn before the first one.
    """
    facts = messages.groupBy("conv_id").agg(
        F.min("turn").alias("_first"), F.bool_or(F.col("role") == "system").alias("_has")
    )
    missing = facts.where(~F.col("_has"))
    if isinstance(system_prompt, DataFrame):
        missing = missing.join(system_prompt, "conv_id")
        text = F.col("system_prompt")
    else:
        text = F.lit(system_prompt)
    rows = missing.select(
        "conv_id", (F.col("_first") - 1).alias("turn"), F.lit("system").alias("role"), text.alias("text")
    )
    return messages.select("conv_id", "turn", "role", "text").unionByName(rows)


def build_messages(messages: DataFrame, prompts: DataFrame, system_prompt) -> DataFrame:
    """History as it is sent: superseded attachments gone, last prompt rendered.

    ``prompts`` (conv_id, prompt) replaces the last message when it is a user
    turn. Earlier user turns carry their current attachments and instruction.
    """
    last = messages.groupBy("conv_id").agg(F.max("turn").alias("_last"))
    user, is_last = F.col("role") == "user", F.col("turn") == F.col("_last")
    told = (
        with_active_files(messages)
        .join(last, "conv_id")
        .join(prompts.select("conv_id", F.col("prompt").alias("_prompt")), "conv_id", "left")
    )
    text = (
        F.when(user & is_last, F.coalesce("_prompt", F.lit("")))
        .when(user, pr.history_user_content(F.col("text"), F.col("active")))
        .otherwise(F.coalesce("text", F.lit("")))
    )
    return ensure_system(told.select("conv_id", "turn", "role", text.alias("text")), system_prompt)


def append_turn(messages: DataFrame, added: DataFrame) -> DataFrame:
    """Append an assistant and a user row (conv_id, assistant, user) to each conversation."""
    last = messages.groupBy("conv_id").agg(F.max("turn").alias("_last"))
    pair = F.array(
        F.struct(F.lit(1).alias("n"), F.lit("assistant").alias("role"), F.col("assistant").alias("text")),
        F.struct(F.lit(2).alias("n"), F.lit("user").alias("role"), F.col("user").alias("text")),
    )
    rows = (
        added.join(last, "conv_id")
        .select("conv_id", "_last", F.explode(pair).alias("p"))
        .select("conv_id", (F.col("_last") + F.col("p.n")).alias("turn"), F.col("p.role").alias("role"),
                F.col("p.text").alias("text"))
    )
    return messages.select("conv_id", "turn", "role", "text").unionByName(rows)


def duplicate_queries(steps: DataFrame) -> DataFrame:
    """Steps (conv_id, step, query) with a flag for queries asked before, ignoring case.

    The first asking comes from a partial aggregate, not from a window over
    the conversation.
    """
    keyed = steps.withColumn("_key", F.lower("query"))
    first = keyed.groupBy("conv_id", "_key").agg(F.min("step").alias("_first"))
    return (
        keyed.join(first, ["conv_id", "_key"])
        .withColumn("repeated", F.col("step") > F.col("_first"))
        .drop("_key", "_first")
    )


# ---- pruning ---------------------------------------------------------------


def is_observation(text):
    return F.startswith(text, F.lit("Observation:")) | F.startswith(text, F.lit("Tool:"))


def truncate_observation(role, text, marker: str):
    return (
        F.when(tk.map_role(role) == "human", F.lit(f"Observation: {marker}"))
        .when(tk.map_role(role) == "ai", F.lit(marker))
        .otherwise(text)
    )


def newest(messages: DataFrame, n: int) -> DataFrame:
    """The last ``n`` messages of each conversation.

    A rank with a limit: each task keeps ``n`` rows per conversation before
    anything is shuffled.
    """
    window = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return messages.withColumn("_back", F.row_number().over(window)).where(F.col("_back") <= n)


def _first_system(messages: DataFrame) -> DataFrame:
    """The opening message of conversations that open with a system message."""
    first = messages.groupBy("conv_id").agg(F.min_by("role", "turn").alias("_role"), F.min("turn").alias("_system"))
    return first.where(F.col("_role") == "system").select("conv_id", "_system")


def keep_recent(messages: DataFrame, options: MemoryOptions = MemoryOptions()) -> DataFrame:
    """An opening system message (when kept) and the last messages."""
    recent = newest(messages, options.keep_recent).drop("_back")
    if not options.keep_system:
        return recent
    opening = messages.join(_first_system(messages), "conv_id").where(F.col("turn") == F.col("_system"))
    return recent.unionByName(opening.drop("_system")).dropDuplicates(["conv_id", "turn"])


def _prune_facts(messages: DataFrame, options: MemoryOptions, counter: Counter) -> DataFrame:
    """One row per conversation: totals, what stays, and the one row that may return."""
    n = options.keep_recent
    sized = messages.select(
        "conv_id", "turn", "role", "text", tk.message_tokens(F.col("role"), F.col("text"), counter).alias("tokens")
    )
    totals = sized.groupBy("conv_id").agg(
        F.count("*").alias("messages_before"),
        F.sum("tokens").alias("tokens_before"),
        F.min_by(F.struct("turn", "role", "tokens"), "turn").alias("_open"),
    )
    recent = F.col("_back") <= n
    tail = (
        newest(sized, n + 1)
        .groupBy("conv_id")
        .agg(
            F.min(F.when(recent, F.col("turn"))).alias("_from"),
            F.coalesce(F.sum(F.when(recent, F.col("tokens"))), F.lit(0)).alias("_recent_tokens"),
            F.count_if(recent).alias("_recent"),
            F.max(F.when(~recent, F.struct("turn", "role", "text", "tokens"))).alias("_cand"),
        )
    )
    facts = totals.join(tail, "conv_id")
    keeps_open = F.lit(options.keep_system) & (F.col("_open.role") == "system")
    # The opening message is extra only when it is not among the recent ones.
    extra = keeps_open & (F.col("_from").isNull() | (F.col("_open.turn") < F.col("_from")))
    marked = truncate_observation(F.col("_cand.role"), F.col("_cand.text"), options.marker)
    shown = F.when(is_observation(F.col("_cand.text")), marked).otherwise(F.col("_cand.text"))
    facts = (
        facts.withColumn("_extra", extra)
        .withColumn("_kept_tokens", F.col("_recent_tokens") + F.when(extra, F.col("_open.tokens")).otherwise(0))
        .withColumn("_kept", F.col("_recent") + F.when(extra, 1).otherwise(0))
        .withColumn("_shown", shown)
    )
    shown_tokens = tk.message_tokens(F.col("_cand.role"), F.col("_shown"), counter)
    facts = facts.withColumn("pruned", F.col("tokens_before") > options.safety_threshold).withColumn(
        "_shown_tokens", shown_tokens
    )
    restored = (
        F.col("_cand").isNotNull()
        & ~(F.col("_extra") & (F.col("_cand.turn") == F.col("_open.turn")))
        & (F.col("_shown_tokens") + F.col("_kept_tokens") <= tk.prune_target(options.safety_threshold))
    )
    return facts.withColumn("_restored", F.col("pruned") & F.coalesce(restored, F.lit(False)))


def prune_context(
    messages: DataFrame, options: MemoryOptions = MemoryOptions(), counter: Counter = chars4
) -> DataFrame:
    """Prune conversations above the token threshold; others pass unchanged.

    Kept: an opening system message and the last messages. The one message
    before those returns (observations shortened) when it fits the target; it
    then goes in front of all others: order by ``restored`` descending, turn.
    """
    facts = _prune_facts(messages, options, counter)
    limits = facts.select(
        "conv_id",
        "pruned",
        F.col("_from"),
        F.when(F.col("_extra"), F.col("_open.turn")).alias("_open_turn"),
        F.when(F.col("_restored"), F.col("_cand.turn")).alias("_back_turn"),
        F.when(F.col("_restored"), F.col("_shown")).alias("_back_text"),
    )
    turn = F.col("turn")
    restored = F.coalesce(turn == F.col("_back_turn"), F.lit(False))
    kept = (
        ~F.col("pruned")
        | F.coalesce(turn >= F.col("_from"), F.lit(False))
        | F.coalesce(turn == F.col("_open_turn"), F.lit(False))
        | restored
    )
    return (
        messages.join(limits, "conv_id")
        .where(kept)
        .select(
            "conv_id", "turn", "role",
            F.when(restored, F.col("_back_text")).otherwise(F.col("text")).alias("text"),
            restored.alias("restored"), "pruned",
        )
    )


def prune_summary(
    messages: DataFrame, options: MemoryOptions = MemoryOptions(), counter: Counter = chars4
) -> DataFrame:
    """Counts and tokens before and after pruning, and the reason, per conversation."""
    facts = _prune_facts(messages, options, counter)
    back = F.when(F.col("_restored"), F.col("_shown_tokens")).otherwise(0)
    after = F.when(F.col("pruned"), F.col("_kept_tokens") + back).otherwise(F.col("tokens_before"))
    left = F.when(F.col("pruned"), F.col("_kept") + F.when(F.col("_restored"), 1).otherwise(0)).otherwise(
        F.col("messages_before")
    )
    over = F.concat(
        F.lit("Token count exceeded threshold: "), F.col("tokens_before").cast("string"),
        F.lit(f" > {options.safety_threshold}"),
    )
    return facts.select(
        "conv_id",
        "messages_before",
        "pruned",
        "tokens_before",
        after.alias("tokens_after"),
        (F.col("messages_before") - left).alias("messages_removed"),
        F.when(F.col("pruned"), over).otherwise(F.lit("Token count within safe threshold")).alias("reason"),
    )

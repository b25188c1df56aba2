"""Token counts. A counter is any ``Column -> Column``; the default needs no vocabulary."""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

Counter = Callable[[Column], Column]

# Role names as they appear in counted messages.
COUNTED_ROLE = {"assistant": "ai", "ai": "ai", "system": "system"}


def chars4(text: Column) -> Column:
    """One token per four characters, rounded up."""
    return F.ceil(F.length(text) / 4).cast("long")


def encoder_counter(make_encode: Callable[[], Callable[[str], list]]) -> Counter:
    """A counter from a user's encoder, built once per Python worker."""
    cache: list = []

    @pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        if not cache:
            cache.append(make_encode())
        return texts.map(lambda t: 0 if t is None else len(cache[0](t)))

    return count


def count_tokens(text: Column, counter: Counter = chars4) -> Column:
    return counter(text)


def map_role(role: Column, legacy_roles: bool = False) -> Column:
    """assistant to ai, everything else to human; a system role is kept unless
    ``legacy_roles`` asks for the old folding of system into human."""
    out = F.when(role.isin("assistant", "ai"), F.lit("ai"))
    if not legacy_roles:
        out = out.when(role == "system", F.lit("system"))
    return out.otherwise(F.lit("human"))


def unmap_role(role: Column) -> Column:
    return (
        F.when(role == "ai", F.lit("assistant")).when(role == "system", F.lit("system")).otherwise(F.lit("user"))
    )


def message_tokens(role: Column, content: Column, counter: Counter = chars4) -> Column:
    return counter(F.concat(map_role(role), F.lit(": "), F.coalesce(content, F.lit(""))))


def safety_threshold(limit: Column, margin: float = 0.8) -> Column:
    return F.floor(limit * margin).cast("long")


def prune_target(threshold: int) -> int:
    return math.floor(threshold * 0.6)


def over_budget(tokens: Column, threshold) -> Column:
    return tokens > threshold


def reply_tokens(server_tokens: Column, chars: Column) -> Column:
    """The server's count when positive, else one token per 3.2 characters."""
    return F.when(server_tokens > 0, server_tokens).otherwise(F.round(chars / 3.2).cast("long"))

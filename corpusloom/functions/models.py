"""The model seams: embedding and generation functions supplied by the user."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions.text import js_trim
from corpusloom.functions.tokens import chars4, message_tokens
from corpusloom.session import spread

def embed(
    df: DataFrame,
    text: str,
    make_embed: Callable[[], Callable],
    batch_size: int = 32,
    out: str = "embedding",
    spread_out: bool = True,
) -> DataFrame:
    """Add vectors of the trimmed texts, ``batch_size`` at a time.

    ``make_embed`` builds the model once per Python worker; the function it
    returns takes an array of texts and must give one vector for each.
    """

    def make():
        model = make_embed()

        def predict(texts):
            return model([str(t) for t in texts])

        return predict

    udf = predict_batch_udf(make, return_type=T.ArrayType(T.DoubleType()), batch_size=batch_size)
    return (spread(df) if spread_out else df).withColumn(out, udf(js_trim(F.coalesce(F.col(text), F.lit("")))))


GENERATED = "text string, tokens bigint, server_tokens bigint, error string"


def generate(
    messages: DataFrame, make_generate: Callable[[], Callable], max_tokens: int | None = None
) -> DataFrame:
    """One reply per conversation: (conv_id, text, tokens, server_tokens, error).

    ``make_generate`` builds the model once per task; its function takes a list
    of ``{"role", "content"}`` and returns ``(text, tokens, server_tokens)``.
    A request is gathered whole, as the model needs it. With ``max_tokens``, the
    model's context, a longer conversation is answered with an error instead
    and its messages are not gathered.
    """
    kind = messages.schema["conv_id"].dataType.simpleString()
    if max_tokens is None:
        return _requests(messages).mapInPandas(_replier(make_generate), f"conv_id {kind}, {GENERATED}")
    size = messages.groupBy("conv_id").agg(F.sum(message_tokens(F.col("role"), F.col("text"), chars4)).alias("_size"))
    fits = size.where(F.col("_size") <= max_tokens).select("conv_id")
    requests = _requests(messages.join(fits, "conv_id", "left_semi"))
    done = requests.mapInPandas(_replier(make_generate), f"conv_id {kind}, {GENERATED}")
    refused = size.where(F.col("_size") > max_tokens).select(
        "conv_id",
        F.lit(None).cast("string").alias("text"),
        F.lit(0).cast("long").alias("tokens"),
        F.lit(0).cast("long").alias("server_tokens"),
        F.lit("context exceeded").alias("error"),
    )
    return done.unionByName(refused)


def _requests(messages: DataFrame) -> DataFrame:
    return messages.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("request"))


def _replier(make_generate: Callable[[], Callable]) -> Callable:
    def run(batches):
        model = make_generate()
        for batch in batches:
            replies = [
                model([{"role": m["role"], "content": m["text"]} for m in request]) for request in batch["request"]
            ]
            yield pd.DataFrame(
                {
                    "conv_id": batch["conv_id"],
                    "text": [r[0] for r in replies],
                    "tokens": [r[1] for r in replies],
                    "server_tokens": [r[2] for r in replies],
                    "error": None,
                }
            )

    return run

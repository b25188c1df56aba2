"""A bounded sample of labelled texts, and a logistic model on a few features."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import crc_mod, quoted
from corpusloom.session import checkpoint

#: Labelled rows that a classifier is fitted on, at most; taken by a hash of their id.
MAX_LABELLED = 20_000
#: crc32 of the id as text modulo FOLDS is HELD_OUT: labels of these rows are not looked at.
FOLDS, HELD_OUT = 5, 0


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, id_col: str, text_col: str, limit: int = MAX_LABELLED) -> DataFrame:
    """(text, label) of at most ``limit`` labelled ids outside the held-out fold.

    An id with several labels counts with the largest; null ids and labels are left out.
    """
    chosen = (
        labels.select(F.col(quoted(id_col)).alias("doc_id"), F.col(quoted(label)).cast("int").alias("label"))
        .where("doc_id is not null and label is not null").where(crc_mod(F.col("doc_id"), FOLDS) != HELD_OUT)
        .groupBy("doc_id").agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    )
    texts = docs.select(F.col(quoted(id_col)).alias("doc_id"), F.coalesce(F.col(quoted(text_col)), F.lit("")).alias("text"))
    return checkpoint(texts.join(F.broadcast(chosen), "doc_id").select("text", "label"), "labelled")  # ``limit`` ids


def fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, rounds: int = 60) -> np.ndarray:
    """Weights, the last one the constant, by Newton steps on the penalised likelihood."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], penalty)
    ridge[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (y - p) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def probability(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))

"""Quality by attention-based multiple-instance learning.

A text is a bag of passages. Every passage is encoded from its words and bytes; a gated attention network
learns from the labels of whole texts which passages tell, and the weighted sum of their encodings is scored.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import crc_mod, quoted
from corpusloom.llm.kernels import NOT_SPACE, first_of, slices, utf8, words
from corpusloom.llm.labelled import FOLDS, HELD_OUT, MAX_LABELLED, labelled_sample

#: Words of a passage; numbers that describe it.
PASSAGE = 48
N_FEATURES = 20
HIDDEN = 16
#: Passages kept of a text while fitting, spread evenly over it; scoring reads every passage.
FIT_PASSAGES = 12
STEPS = 1200
BATCH = 256

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_STOP = np.zeros(256, bool)
_STOP[[33, 46, 63]] = True
_COMMA = np.zeros(256, bool)
_COMMA[[44, 58, 59]] = True
_BAR = np.zeros(256, bool)
_BAR[[124]] = True
_SIGN = np.zeros(256, bool)
_SIGN[33:48] = _SIGN[58:65] = _SIGN[91:97] = _SIGN[123:127] = True
_SIGN &= ~(_STOP | _COMMA | _BAR)
_VOWEL = np.zeros(256, bool)
_VOWEL[[ord(c) for c in "aeiouAEIOU"]] = True


def passages(data: np.ndarray, offsets: np.ndarray, size: int = PASSAGE) -> tuple[np.ndarray, np.ndarray]:
    """(encodings, text number) of the passages of all texts; a text without words has one passage of zeros."""
    n = len(offsets) - 1
    w = words(data, offsets, NOT_SPACE)
    first = first_of(w.doc, n)
    per_doc = np.maximum(-(-np.diff(first) // size), 1)
    doc = np.repeat(np.arange(n), per_doc)
    number = np.arange(len(doc)) - np.repeat(np.cumsum(per_doc) - per_doc, per_doc)
    a = np.minimum(first[doc] + number * size, first[doc + 1])
    b = np.minimum(a + size, first[doc + 1])
    x = np.zeros((len(doc), N_FEATURES), np.float32)
    some = np.flatnonzero(b > a)
    if not len(some):
        return x, doc
    a, b = a[some], b[some]
    lo, hi = w.start[a], w.end[b - 1]
    size_bytes, n_words = (hi - lo).astype(float), (b - a).astype(float)

    def share(kind):
        total = np.concatenate([[0], np.cumsum(kind[data], dtype=np.int64)])
        return (total[hi] - total[lo]) / size_bytes

    length = (w.end - w.start).astype(float)
    sums = lambda v: np.add.reduceat(np.append(v, 0.0), np.column_stack([a, b]).reshape(-1))[::2]
    place = np.repeat(np.arange(len(a)), b - a)
    order = np.lexsort((w.key, place))
    sorted_key = w.key[order]
    new = np.concatenate([[True], (sorted_key[1:] != sorted_key[:-1]) | (place[order][1:] != place[order][:-1])])
    unique = np.bincount(place[order][new], minlength=len(a))
    again = np.concatenate([[False], w.key[1:] == w.key[:-1]]).astype(float)
    first_byte, last_byte = data[w.start], data[w.end - 1]
    signs = np.concatenate([[0], np.cumsum(_SIGN[data], dtype=np.int64)])
    word_signs = (signs[w.end] - signs[w.start]).astype(float)
    mean = sums(length) / n_words
    lines = np.concatenate([[0], np.cumsum(data == 10, dtype=np.int64)])
    doc_words = np.diff(first)[doc[some]]
    x[some] = np.column_stack([
        share(_LETTER), share(_UPPER), share(_DIGIT), share(_STOP), share(_COMMA), share(_BAR), share(_SIGN), share(_VOWEL),
        mean / 10, np.sqrt(np.maximum(sums(length * length) / n_words - mean * mean, 0)) / 10, unique / n_words, sums(again) / n_words,
        sums(_UPPER[first_byte].astype(float)) / n_words, sums(_STOP[last_byte].astype(float)) / n_words, sums((word_signs >= 2).astype(float)) / n_words,
        sums((length <= 3).astype(float)) / n_words, sums((length >= 12).astype(float)) / n_words,
        (lines[hi] - lines[lo]) / n_words, n_words / size, np.log1p(doc_words) / 10,
    ])
    return x, doc


class Model(NamedTuple):
    mean: np.ndarray
    scale: np.ndarray
    encode: np.ndarray  # features (and 1) to hidden
    tanh: np.ndarray
    gate: np.ndarray
    attend: np.ndarray
    out: np.ndarray  # hidden (and 1) to the score


def forward(p: dict, x: np.ndarray, start: np.ndarray, count: np.ndarray):
    """Scores of bags of passages (``start``, ``count`` in x) and what the gradient needs."""
    z = np.column_stack([x, np.ones(len(x), x.dtype)]) @ p["encode"]
    h = np.maximum(z, 0)
    t, g = np.tanh(h @ p["tanh"]), 1 / (1 + np.exp(-np.clip(h @ p["gate"], -30, 30)))
    e = (t * g) @ p["attend"]
    top = np.maximum.reduceat(e, start)
    a = np.exp(e - np.repeat(top, count))
    a = a / np.repeat(np.add.reduceat(a, start), count)
    bag = np.add.reduceat(a[:, None] * h, start)
    logit = bag @ p["out"][:-1] + p["out"][-1]
    return logit, (z, h, t, g, a, bag)


def fit_bags(x: np.ndarray, start: np.ndarray, count: np.ndarray, y: np.ndarray, steps: int = STEPS, seed: int = 7) -> Model:
    """Adam on the log loss of bags; a fixed seed."""
    rng = np.random.default_rng(seed)
    mean, scale = x.mean(0), x.std(0) + 1e-3
    x = ((x - mean) / scale).astype(np.float32)
    k = x.shape[1]
    p = {
        "encode": rng.normal(0, 0.3, (k + 1, HIDDEN)), "tanh": rng.normal(0, 0.3, (HIDDEN, HIDDEN)), "gate": rng.normal(0, 0.3, (HIDDEN, HIDDEN)),
        "attend": rng.normal(0, 0.3, HIDDEN), "out": np.append(rng.normal(0, 0.3, HIDDEN), 0.0),
    }
    m, v = ({n: np.zeros_like(w) for n, w in p.items()} for _ in range(2))
    for step in range(1, steps + 1):
        bags = rng.integers(0, len(start), min(BATCH, len(start)))
        n = count[bags]
        own_start = np.cumsum(n) - n
        rows = np.repeat(start[bags] - own_start, n) + np.arange(n.sum())
        xb, yb = x[rows], y[bags]
        logit, (z, h, t, g, a, bag) = forward(p, xb, own_start, n)
        d = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - yb) / len(bags)
        dbag = d[:, None] * p["out"][:-1]
        wide = np.repeat(dbag, n, axis=0)
        da = (wide * h).sum(1)
        de = a * (da - np.repeat(np.add.reduceat(a * da, own_start), n))
        dtg = de[:, None] * p["attend"]
        dt, dg = dtg * g * (1 - t * t), dtg * t * g * (1 - g)
        dz = (a[:, None] * wide + dt @ p["tanh"].T + dg @ p["gate"].T) * (z > 0)
        grads = {
            "out": np.append(bag.T @ d, d.sum()), "attend": (t * g).T @ de, "tanh": h.T @ dt, "gate": h.T @ dg,
            "encode": np.column_stack([xb, np.ones(len(xb), xb.dtype)]).T @ dz,
        }
        rate = 0.01 * (1 - step / (steps + 1)) + 1e-4
        for name, grad in grads.items():
            grad = grad + 1e-4 * p[name]
            m[name] = 0.9 * m[name] + 0.1 * grad
            v[name] = 0.99 * v[name] + 0.01 * grad * grad
            p[name] = p[name] - rate * (m[name] / (1 - 0.9 ** step)) / (np.sqrt(v[name] / (1 - 0.99 ** step)) + 1e-8)
    return Model(mean, scale, p["encode"], p["tanh"], p["gate"], p["attend"], p["out"])


def score_bags(model: Model, x: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(score of every text, its largest attention weight)."""
    x = ((x - model.mean) / model.scale).astype(np.float32)
    count = np.bincount(doc, minlength=n)
    start = np.cumsum(count) - count
    logit, (_, _, _, _, a, _) = forward(model._asdict(), x, start, count)
    return 1 / (1 + np.exp(-np.clip(logit, -30, 30))), np.maximum.reduceat(a, start)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", limit: int = MAX_LABELLED) -> Model | None:
    """A model from labelled rows outside the held-out fold; none without such rows."""
    sample = labelled_sample(docs, labels, label, id_col, text_col, limit)

    def encode(batches):
        for batch in slices(batches, "text"):
            x, doc = passages(*utf8(batch.column("text")))
            count = np.bincount(doc, minlength=batch.num_rows)
            start = np.cumsum(count) - count
            kept = [np.unique(np.linspace(s, s + c - 1, FIT_PASSAGES).astype(int)) for s, c in zip(start, count)]
            yield pa.RecordBatch.from_arrays([
                pa.array([x[k].reshape(-1) for k in kept], pa.list_(pa.float32())), batch.column("label"),
            ], ["x", "label"])

    table = sample.mapInArrow(encode, "x array<float>, label int").toArrow()  # at most ``limit`` labels, FIT_PASSAGES * N_FEATURES numbers each
    if not table.num_rows:
        return None
    table = table.combine_chunks()
    sizes = np.array([len(v) for v in table.column("x")]) // N_FEATURES
    x = np.concatenate([np.asarray(c.flatten()) for c in table.column("x").chunks]).reshape(-1, N_FEATURES)
    y = (np.asarray(table.column("label")) > 0).astype(float)
    return fit_bags(x, np.cumsum(sizes) - sizes, sizes, y)


def score_quality(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score (0 to 1, higher is better), predicted, n_passages, attention.

    Every passage of a text is read; ``attention`` is the largest weight of one. A null or empty text is one
    passage of zeros. Without a model every score is 0.5.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(
        F.col(quoted(id_col)).alias("doc_id"), (crc_mod(F.col(quoted(id_col)), FOLDS) == HELD_OUT).alias("held_out"),
        F.col(quoted(text_col)).alias("text"),
    )

    def score(batches):
        for batch in slices(batches, "text"):
            x, doc = passages(*utf8(batch.column("text")))
            n = batch.num_rows
            p, most = (np.full(n, 0.5), np.zeros(n)) if shared.value is None else score_bags(shared.value, x, doc, n)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), batch.column("held_out"), pa.array(p), pa.array((p >= threshold).astype(np.int32)),
                pa.array(np.bincount(doc, minlength=n), pa.int64()), pa.array(most.astype(float)),
            ], ["doc_id", "held_out", "score", "predicted", "n_passages", "attention"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(score, f"doc_id {kind}, held_out boolean, score double, predicted int, n_passages long, attention double")

"""A log-bilinear language model trained with noise-contrastive estimation.

The next token's vector is predicted as a sum of linear maps of the vectors of the tokens before it; its dot
product with a token's vector, plus a bias, is that token's score. The vocabulary grows with the corpus: its
size is ``GROWTH`` times the cube root of the training tokens. Its tokens are cut by frequency into classes
of about the square root of that size; one more class holds all other tokens. A probability is that of the
class, a softmax over classes, times that of the token, a softmax over the words of its class; among the
other tokens it is the add-one share of their training counts. So log-probabilities are normalised over all
tokens, and a token costs two square roots of the vocabulary.

Texts are split and looked up by Arrow, a few MB at a time, and encoded once, into token numbers that are
written; both training rounds and the scoring read those.
Training reads all training tokens. Every task trains its own copy with noise-contrastive estimation on the
texts it reads, starting from the parameters of the round before; the copies are averaged, weighted by
tokens, by parameter row. A task reads ``SHARE`` times the text that it sends parameters.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import crc_mod, quoted
from corpusloom.llm.kernels import slices, utf8
from corpusloom.session import checkpoint

#: Tokens with vectors of their own for each cube root of a training token; dimensions; tokens looked back at.
GROWTH = 32
DIMENSIONS = 16
CONTEXT = 4
ROUNDS = 2
#: Tokens of a gradient step, and noise samples that they share (as many of tokens as of classes).
STEP_TOKENS = 1024
NOISE = 32
RATE = 0.1
#: Longest token with a vector of its own, in bytes: the vocabulary goes to every task.
TOKEN_BYTES = 64
#: Bytes of text that a training task reads for each byte of parameters it sends, and bytes of a token.
SHARE, BYTES_OF_TOKEN = 8, 6
#: Rows of one batched product; scores up to which the sum of their exponentials is finite.
ROWS = 1024
SAFE = 70.0
FOLDS, HELD_OUT = 7, 2
#: Bytes of text that are split together; distinct tokens, and bytes of them, that a task gathers before it sends them on.
SPLIT_BYTES = 2 << 20
GATHER, GATHER_BYTES = 400_000, 32 << 20
#: Most frequent tokens whose counts go to every task, at most (2 MB of words): only the texts' other tokens meet theirs in a join.
LISTED = 1 << 18


def tokens_of(column: pa.Array) -> pa.ListArray:
    """Words between ASCII white space of every text, A-Z lower-cased, then one end: the empty token, which no word is."""
    text = pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(column.cast(pa.string()), "")))
    # a blank at the end is split into the word before it and an empty one; an empty text is split into an empty one
    split = pc.ascii_split_whitespace(pc.if_else(pc.equal(pc.binary_length(text), 0), text, pc.binary_join_element_wise(text, "", " ")))
    return split.cast(pa.list_(pa.binary()))


class Model(NamedTuple):
    words: int  # tokens with vectors; the next number is all others, the one after it stands before the start
    inputs: np.ndarray  # (words + 2, d)
    maps: np.ndarray  # (context, d, d)
    outputs: np.ndarray  # (words + classes, d): words by frequency, then classes, the last one all others
    bias: np.ndarray


def width_of(words: int) -> int:
    """Words of a class."""
    return max(1, math.isqrt(max(words - 1, 0)) + 1)


def class_of(model: Model, code: np.ndarray) -> np.ndarray:
    """Class of every token: blocks of words by frequency, then all others."""
    return np.where(code < model.words, code // width_of(model.words), len(model.outputs) - model.words - 1)


def streamed(code: np.ndarray, first: np.ndarray, before: int) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of all texts, each behind CONTEXT times ``before``; places of the tokens in them)."""
    size = np.diff(first)
    place = np.arange(len(code)) + np.repeat(CONTEXT * np.arange(1, len(size) + 1), size)
    out = np.full(len(code) + CONTEXT * len(size), before, np.int32)
    out[place] = code
    return out, place


def before(vectors: np.ndarray, k: int) -> np.ndarray:
    """The vectors ``k + 1`` places before every token of a stream but the first CONTEXT."""
    return vectors[CONTEXT - k - 1:len(vectors) - k - 1]


def combined(vectors: np.ndarray, maps: np.ndarray) -> np.ndarray:
    """Predicted vector of every token of a stream but the first CONTEXT, from the vectors of the stream."""
    out = np.empty((len(vectors) - CONTEXT, maps.shape[2]), vectors.dtype)
    for lo in range(0, len(out), ROWS):
        own, part = vectors[lo:lo + ROWS + CONTEXT], out[lo:lo + ROWS]
        np.matmul(before(own, 0), maps[0], out=part)
        for k in range(1, CONTEXT):
            part += before(own, k) @ maps[k]
    return out


def predicted(model: Model, context: np.ndarray) -> np.ndarray:
    """Predicted vector for each row of numbers before a token, the nearest first."""
    return sum(model.inputs[context[:, k]] @ model.maps[k] for k in range(CONTEXT))


def log_softmax_at(guess: np.ndarray, vectors: np.ndarray, bias: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Log-probability of output ``at`` among ``vectors``, for each row of ``guess`` (a predicted vector, then 1)."""
    if len(vectors) == 1:  # certain, without rounding
        return np.zeros(len(guess))
    out, product, ones = np.empty(len(guess)), np.concatenate([vectors.T, bias[None]]), np.ones(len(vectors), vectors.dtype)
    farthest = np.sqrt(np.einsum("ij,ij->j", product, product).max())
    for lo in range(0, len(guess), ROWS):
        own = guess[lo:lo + ROWS]
        score = own @ product
        out[lo:lo + ROWS] = score.ravel().take(np.arange(0, score.size, len(vectors)) + at[lo:lo + ROWS])
        # no score is beyond the product of the lengths: mostly exp cannot overflow, and the largest stays in
        if farthest * np.sqrt(np.einsum("ij,ij->i", own, own).max()) >= SAFE:
            score -= (top := score.max(1))[:, None]
            out[lo:lo + ROWS] -= top
        out[lo:lo + ROWS] -= np.log(np.exp(score, out=score) @ ones)
    return out


def with_one(rows: np.ndarray) -> np.ndarray:
    """The rows with a 1 at their end, which a bias is multiplied with."""
    out = np.empty((len(rows), rows.shape[1] + 1), rows.dtype)
    out[:, :-1], out[:, -1] = rows, 1
    return out


def sorted_places(code: np.ndarray) -> np.ndarray:
    """Places of ``code`` in ascending order, equal ones as they come; numbers of 16 bits are dealt instead of compared."""
    return np.argsort(code.astype(np.uint16) if len(code) and code.max() < 1 << 16 else code, kind="stable")


def scored(model: Model, code: np.ndarray, guess: np.ndarray) -> np.ndarray:
    """Natural log-probability of every token, given the predicted vectors: of its class, plus within the class."""
    group, words, width = class_of(model, code), model.words, width_of(model.words)
    guess = with_one(guess)
    out = log_softmax_at(guess, model.outputs[words:], model.bias[words:], group)
    classes = len(model.outputs) - words - 1
    order = sorted_places(group)
    cuts = np.searchsorted(group.take(order), np.arange(classes + 1))
    order = order[:cuts[-1]]  # all others are a class of their own
    guess, code, within = guess.take(order, axis=0), code.take(order), np.empty(len(order))
    for c in np.flatnonzero(np.diff(cuts)):
        rows = slice(cuts[c], cuts[c + 1])
        a, b = c * width, min((c + 1) * width, words)
        within[rows] = log_softmax_at(guess[rows], model.outputs[a:b], model.bias[a:b], code[rows] - a)
    out[order] += within
    return out


def log_probabilities(model: Model, code: np.ndarray, context: np.ndarray) -> np.ndarray:
    """Natural log-probability of every token after the numbers of its ``context``; all others are one token."""
    return scored(model, code, predicted(model, context))


def runs_of(code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places in ascending order of ``code``, distinct codes, first of each among the places)."""
    order = sorted_places(code)
    known = code.take(order)
    first = np.flatnonzero(np.concatenate([[True], known[1:] != known[:-1]]))
    return order, known.take(first), first


def by_row(code: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct codes, sums of their rows)."""
    order, known, first = runs_of(code)
    return known, np.add.reduceat(values.take(order, axis=0), first)


def noise_of(model: Model, counts: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(first output, cumulated shares, log of expected noise) of words, then of classes.

    ``counts`` are those of the words and of all others.
    """
    words, classes = model.words, len(model.outputs) - model.words
    grouped_ = np.bincount(class_of(model, np.arange(words + 1)), counts, classes)
    out = []
    for start, n in ((0, counts[:words]), (words, grouped_)):
        if len(n):
            share = n / n.sum()
            out.append((start, np.cumsum(share), np.log(share * NOISE).astype(np.float32)))
    return out


def drawn(noise: list, steps: int, rng: np.random.Generator) -> np.ndarray:
    """NOISE outputs of each part of ``noise``, for every step."""
    at = rng.random((steps, len(noise), NOISE))
    return np.concatenate([
        start + np.minimum(np.searchsorted(cumulated, at[:, i]), len(cumulated) - 1) for i, (start, cumulated, _) in enumerate(noise)
    ], axis=1)


def contrast(model: Model, expected: np.ndarray, other: np.ndarray, seen: list, guess: np.ndarray):
    """One batch against shared noise: (gradient of ``guess``, outputs touched, gradients of their vectors and biases).

    ``guess`` are predicted vectors, then 1, ``expected`` the logs of the expected noise of the outputs, ``other`` the noise.
    ``seen`` are, for each part of the noise, the outputs seen and the rows that have none.
    """
    n, d = len(guess), guess.shape[1] - 1
    only = guess[:, :d]
    theirs = model.outputs.take(other, axis=0)
    product = np.empty((d + 1, len(other)), guess.dtype)
    np.negative(theirs.T, out=product[:d])
    product[d] = expected.take(other) - model.bias.take(other) + np.float32(math.log(n))
    down = guess @ product
    with np.errstate(over="ignore"):  # beyond the largest number a share is 0
        np.exp(down, out=down)
    down += n
    np.reciprocal(down, out=down)  # towards 0 for noise, a share of the batch
    gradients, of_bias = np.empty((n * len(seen) + len(other), d), guess.dtype), np.empty(n * len(seen) + len(other), guess.dtype)
    back = np.zeros((n, d), guess.dtype)
    for i, (outputs, without) in enumerate(seen):
        mine = model.outputs.take(outputs, axis=0)
        good = np.einsum("ij,ij->i", only, mine) + model.bias.take(outputs) - expected.take(outputs)
        with np.errstate(over="ignore"):
            up = 1 / ((1 + np.exp(good)) * n)  # towards 1 for the output seen
        up[without] = 0
        down[without, i * NOISE:(i + 1) * NOISE] = 0
        of_bias[i * n:(i + 1) * n] = up
        np.multiply(up[:, None], only, out=gradients[i * n:(i + 1) * n])
        mine *= up[:, None]
        back += mine
    noise_sums = down.T @ guess
    np.negative(noise_sums[:, :d], out=gradients[n * len(seen):])
    np.negative(noise_sums[:, d], out=of_bias[n * len(seen):])
    back -= down @ theirs
    return back, np.concatenate([*(outputs for outputs, _ in seen), other]), gradients, of_bias


def nce_steps(model: Model, speed: list[np.ndarray], stream: np.ndarray, noise: list, rng: np.random.Generator, rate: float) -> None:
    """Gradient steps of noise-contrastive estimation over a stream, in place.

    Words and classes have noise of their own. ``speed`` sums up squared gradients for each row (AdaGrad).
    """

    def move(values, sums, rows, gradient):
        """Moves each of the rows along its gradient."""
        flat_ = gradient.reshape(len(gradient), -1)
        more = sums.take(rows)
        more += np.einsum("ij,ij->i", flat_, flat_) / flat_.shape[1]
        sums[rows] = more
        step = (rate / np.sqrt(more + 1e-8)).reshape(-1, *[1] * (gradient.ndim - 1))
        values[rows] = values.take(rows, axis=0) + step * gradient

    of_input, of_map, of_output, of_bias = speed
    d, words = model.maps.shape[2], model.words
    groups = class_of(model, np.arange(words + 2)) + words
    expected = np.concatenate([log_noise for _, _, log_noise in noise])
    every, starts = np.arange(CONTEXT), range(CONTEXT, len(stream), STEP_TOKENS)
    for lo, other in zip(starts, drawn(noise, len(starts), rng)):
        own = stream[lo - CONTEXT:lo + STEP_TOKENS]
        target, n = own[CONTEXT:], len(own) - CONTEXT
        # words of their own have a word and a class, all others a class, starts nothing
        of_words, of_classes = np.flatnonzero(target >= words), np.flatnonzero(target > words)
        if len(of_classes) == n:
            continue
        vectors = model.inputs.take(own, axis=0)
        classes = (groups.take(target), of_classes)
        seen = [(np.where(target < words, target, 0), of_words), classes] if words else [classes]
        back, touched, gradients, bias_gradients = contrast(model, expected, other, seen, with_one(combined(vectors, model.maps)))
        d_maps, d_in = np.empty_like(model.maps), np.zeros((n + CONTEXT, d), back.dtype)
        for k in every:
            np.matmul(before(vectors, k).T, back, out=d_maps[k])
            part = before(d_in, k)
            part += back @ model.maps[k].T
        move(model.maps, of_map, every, d_maps)
        move(model.inputs, of_input, *by_row(own, d_in))
        order, rows, first = runs_of(touched)
        move(model.outputs, of_output, rows, np.add.reduceat(gradients.take(order, axis=0), first))
        move(model.bias, of_bias, rows, np.add.reduceat(bias_gradients.take(order), first))


def start_model(vocabulary: pa.Array | dict[bytes, int], counts: np.ndarray, seed: int = 13) -> Model:
    """A model to start from; ``counts`` are those of the words by their numbers, then of all others."""
    rng = np.random.default_rng(seed)
    words = len(vocabulary)
    classes = -(-words // width_of(words)) + 1
    vec = lambda rows: rng.normal(0, 0.1, (rows, DIMENSIONS)).astype(np.float32)
    model = Model(
        words, vec(words + 2), np.stack([np.eye(DIMENSIONS, dtype=np.float32)] * CONTEXT), vec(words + classes),
        np.zeros(words + classes, np.float32),
    )
    grouped_ = np.bincount(class_of(model, np.arange(words + 1)), counts, classes)
    model.bias[:] = np.log(np.concatenate([counts[:words] / max(counts[:words].sum(), 1), grouped_ / counts.sum()]))
    return model


def flat(model: Model) -> np.ndarray:
    """Parameters as rows of DIMENSIONS + 1 numbers."""
    wide = lambda x: np.column_stack([x, np.zeros(len(x), np.float32)])
    return np.concatenate([wide(model.inputs), wide(model.maps.reshape(-1, DIMENSIONS)), np.column_stack([model.outputs, model.bias])])


def unflat(words: int, rows: np.ndarray) -> Model:
    a, b = words + 2, words + 2 + CONTEXT * DIMENSIONS
    copy = lambda part: np.array(part, np.float32, order="C")
    return Model(words, copy(rows[:a, :-1]), copy(rows[a:b, :-1]).reshape(CONTEXT, DIMENSIONS, DIMENSIONS), copy(rows[b:, :-1]), copy(rows[b:, -1]))


def kind_of(words: int) -> type:
    """The numbers that texts are written in: 16 bits hold those of a small vocabulary, and the two after them."""
    return np.uint16 if words + 2 <= 1 << 16 else np.int32


def numbers(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """(token numbers of all texts, first of each text)."""
    data, offsets = utf8(column)
    return data.view(kind).astype(np.int32), offsets // np.dtype(kind).itemsize


def summed(parts: list[pa.Table]) -> pa.Table:
    return pa.concat_tables(parts).group_by("token", use_threads=False).aggregate([("n", "sum")]).rename_columns(["token", "n"])


def token_counts(rows: DataFrame) -> DataFrame:
    """(token, n) over all texts of the training rows."""

    def count(batches):
        held = []
        full = lambda part: max(sum(t.num_rows for t in held) / GATHER, sum(t.nbytes for t in held) / GATHER_BYTES) > part
        for part in slices(batches, "text", SPLIT_BYTES):
            tokens, times = tokens_of(part.column("text")).flatten().value_counts().flatten()
            held.append(pa.table([tokens, times], ["token", "n"]))
            if full(1):
                held = [summed(held)]
                if full(1 / 2):
                    yield from held[0].to_batches()
                    held = []
        if held:
            yield from summed(held).to_batches()

    return rows.select("text").mapInArrow(count, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n"))


def encode(rows: DataFrame, listed: pa.Array, counts: np.ndarray, words: int) -> DataFrame:
    """Written (row, doc_id, held_out, codes, n_tokens, n_other, n_listed, log_listed, log_other, rare) of every text.

    ``listed`` are the most frequent tokens with their ``counts``; the first ``words`` of them are the vocabulary.
    ``codes`` are the numbers of a text's tokens, ``n_other`` how many are not in the vocabulary, ``n_listed`` how
    many are listed. ``log_listed`` is the sum of log10(count + 1) over the listed ones, ``log_other`` over those of
    them that are not in the vocabulary. ``rare`` are the tokens that are not listed with the times they occur.
    """
    shared = rows.sparkSession.sparkContext.broadcast((listed, np.append(np.log10(counts + 1), 0.0)))

    def number(batches):
        listed_, log_n = shared.value
        kind, log_other = kind_of(words), np.append(np.zeros(words), log_n[words:])
        for part in slices(batches, "text", SPLIT_BYTES):
            lists = tokens_of(part.column("text"))
            tokens, first = lists.flatten(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            place = pc.fill_null(pc.index_in(tokens, value_set=listed_), len(listed_)).to_numpy()
            code = np.minimum(place, words).astype(kind)
            # every text's other tokens once, with the times they occur
            outside = np.flatnonzero(place == len(listed_))
            rare = tokens.take(pa.array(outside)).dictionary_encode()
            text = np.searchsorted(first, outside, "right") - 1
            pair, times = np.unique(text * max(len(rare.dictionary), 1) + rare.indices.to_numpy(), return_counts=True)
            text, token = np.divmod(pair, max(len(rare.dictionary), 1))
            cuts = np.searchsorted(text, np.arange(len(first)))
            pairs = pa.StructArray.from_arrays([rare.dictionary.take(pa.array(token)), pa.array(times)], ["token", "times"])
            data = pa.BinaryArray.from_buffers(
                pa.binary(), len(part), [None, pa.py_buffer((first * code.itemsize).astype(np.int32)), pa.py_buffer(code)]
            )
            sums = lambda v: pa.array(np.add.reduceat(v, first[:-1]))
            yield pa.RecordBatch.from_arrays([
                part.column("row"), part.column("doc_id"), part.column("held_out"), data, pa.array(np.diff(first).astype(np.int64)),
                sums((place >= words).astype(np.int64)), sums((place < len(listed_)).astype(np.int64)),
                sums(log_n.take(place)), sums(log_other.take(place)), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pairs),
            ], ["row", "doc_id", "held_out", "codes", "n_tokens", "n_other", "n_listed", "log_listed", "log_other", "rare"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return checkpoint(rows.select("row", "doc_id", "held_out", "text").mapInArrow(number, (
        f"row long, doc_id {kind}, held_out boolean, codes binary, n_tokens long, n_other long, n_listed long, log_listed double, "
        "log_other double, rare array<struct<token: binary, times: long>>"
    )), "lm-encoded")


def train(rows: DataFrame, model: Model, counts: np.ndarray, rounds: int = ROUNDS) -> Model:
    """The model after ``rounds`` passes over all ``codes`` of the training rows.

    ``counts`` are those of the words and of all others, none of them 0.
    """
    sc = rows.sparkSession.sparkContext
    names = [f"p{i}" for i in range(DIMENSIONS + 1)]
    sent_bytes = len(flat(model)) * 4 * (DIMENSIONS + 4)
    tasks = max(sc.defaultParallelism, int(counts.sum() * BYTES_OF_TOKEN / (SHARE * sent_bytes)))
    for turn in range(rounds):
        shared = sc.broadcast((flat(model), counts, model.words))

        def learn(batches, turn=turn, shared=shared):
            rows_, counts_, words = shared.value
            own, rng, seen = unflat(words, rows_), np.random.default_rng(turn), 0
            noise = noise_of(own, counts_)
            speed = [np.zeros(len(p), np.float32) for p in own[1:]]
            for batch in batches:
                column = batch.column("codes")
                for lo in range(0, len(column), 100):
                    code, first = numbers(column.slice(lo, 100), kind_of(words))
                    nce_steps(own, speed, streamed(code, first, words + 1)[0], noise, rng, RATE / (1 + turn))
                    seen += len(code)
            if seen:
                out = flat(own)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(len(out)), pa.int32()), pa.array(np.full(len(out), seen), pa.int64()), *map(pa.array, out.T)],
                    ["place", "seen", *names],
                )

        sent = rows.select("codes").coalesce(tasks).mapInArrow(learn, "place int, seen long, " + ", ".join(f"{n} float" for n in names))
        mean = sent.groupBy("place").agg(*[(F.sum(F.col(n).cast("double") * F.col("seen")) / F.sum("seen")).alias(n) for n in names])
        found = mean.orderBy("place").toArrow()  # one row of DIMENSIONS + 1 numbers for each row of parameters
        if not found.num_rows:
            return model
        model = unflat(model.words, np.column_stack([found.column(n).to_numpy() for n in names]))
    return model


def frequent_tokens(counts: DataFrame, size_for) -> tuple[int, int, int, pa.Table]:
    """(all tokens, distinct tokens, size of the vocabulary, most frequent tokens of at most TOKEN_BYTES with their counts).

    ``size_for`` gives the size for the number of tokens. The table begins with the vocabulary, ties going to the smaller
    token, and goes on to LISTED tokens at most. Only tokens of at least the count that this takes are sorted, which a
    histogram tells, so that no task gets more of them when there are more counts.
    """
    short = F.length("token") <= TOKEN_BYTES
    bins = counts.groupBy(F.floor(F.log2("n") * 4).alias("bin")).agg(
        F.sum("n").alias("n"), F.count("*").alias("tokens"), F.count(F.when(short, 1)).alias("short"),
        F.min("n").alias("least"),
    ).orderBy(F.desc("bin")).collect()  # fewer than 256
    total, distinct = sum(b.n for b in bins), sum(b.tokens for b in bins)
    size, least, listed, short_so_far = size_for(total), 1, 0, 0
    for b in bins:
        if short_so_far >= size and short_so_far + b.short > LISTED:
            break
        short_so_far, least = short_so_far + b.short, b.least
        listed = short_so_far if short_so_far <= LISTED else listed
    frequent = counts.where(short & (F.col("n") >= least)).orderBy(F.desc("n"), "token").limit(max(size, listed)).toArrow()
    return total, distinct, size, frequent


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", top: int | None = None, rounds: int = ROUNDS) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Rows with crc32(id as text) mod 7 = 2 are held out; all others are learned from. ``base_score`` is the
    add-one unigram log10 probability of the text, ``score`` the model's. ``top`` sets the size of the
    vocabulary; by default it follows from the training tokens, ties going to the smaller token. A null or
    empty text is one end; a null id counts as the empty string. Texts are read whole, however long. Rows that
    repeat an id are scored each. If all rows are held out, nothing is known and both scores are those of no
    counts. An empty table gives an empty result. Other columns of ``docs`` are not looked at.
    """
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(quoted(id_col)).alias("doc_id"),
        (crc_mod(F.col(quoted(id_col)), FOLDS) == HELD_OUT).alias("held_out"), F.col(quoted(text_col)).alias("text"),
    )
    counts = checkpoint(token_counts(rows.where("not held_out")), "lm-counts")
    # some 800,000 words for 100 TB
    total, distinct, size, frequent = frequent_tokens(counts, lambda n: math.ceil(GROWTH * n ** (1 / 3)) if top is None else top)
    listed = pa.concat_arrays(frequent.column("token").chunks) if frequent.num_rows else pa.array([], pa.binary())
    listed_counts, vocabulary = frequent.column("n").to_numpy().astype(float), listed[:size]
    known = listed_counts[:size]
    other_total, other_distinct = int(total - known.sum()), int(distinct - len(known))
    encoded = encode(rows, listed, listed_counts, len(vocabulary))
    smooth = np.append(known, other_total) + 1.0
    model = train(encoded.where("not held_out"), start_model(vocabulary, smooth), smooth, rounds)
    shared = docs.sparkSession.sparkContext.broadcast((flat(model), model.words))
    base = np.log10(total + distinct + 1)
    rest = np.log10(other_total + other_distinct + 1)
    kept = ["row", "doc_id", "held_out", "n_tokens", "n_other", "n_listed", "log_listed", "log_other"]

    def score(batches):
        rows_, words = shared.value
        own = unflat(words, rows_)
        for batch in batches:
            column, out = batch.column("codes"), []
            for lo in range(0, len(column), 200):
                code, first = numbers(column.slice(lo, 200), kind_of(words))
                stream, place = streamed(code, first, words + 1)
                log_p = scored(own, code, combined(own.inputs.take(stream, axis=0), own.maps).take(place - CONTEXT, axis=0))
                out.append(np.add.reduceat(log_p, first[:-1]) / np.log(10))
            values = np.concatenate(out) if out else np.empty(0)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(values)], [*kept, "score_top"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    marked = encoded.select(*kept, "codes").mapInArrow(
        score, f"row long, doc_id {kind}, held_out boolean, n_tokens long, n_other long, n_listed long, log_listed double, "
        "log_other double, score_top double"
    )
    # counts of the tokens that are not listed by a join, once per text
    asked = encoded.select("row", F.explode("rare").alias("r")).select("row", "r.token", "r.times")
    found = asked.join(counts, "token").groupBy("row").agg(
        F.sum("times").alias("times"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("log_n")
    )
    log_n = F.coalesce("log_n", F.lit(0.0))
    return marked.join(found, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_listed") + F.coalesce("times", F.lit(0))).alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("log_listed") + log_n - F.col("n_tokens") * float(base)).alias("base_score"),
        (F.col("score_top") + F.col("log_other") + log_n - F.col("n_other") * float(rest)).alias("score"),
    )

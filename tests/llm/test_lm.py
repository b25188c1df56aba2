"""The language model against a plain one: same numbers token by token, same sums text by text."""

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from corpusloom.llm import lm


def plain_log_probability(model, before, token):
    """log p(token) after the list ``before``, one product at a time."""
    d = lm.DIMENSIONS
    start = model.words + 1
    history = ([start] * lm.CONTEXT + list(before))[-lm.CONTEXT:][::-1]
    guess = [sum(float(model.inputs[h][i]) * float(model.maps[k][i][j]) for k, h in enumerate(history) for i in range(d)) for j in range(d)]
    score = lambda o: sum(guess[j] * float(model.outputs[o][j]) for j in range(d)) + float(model.bias[o])
    share = lambda o, among: score(o) - math.log(sum(math.exp(score(x)) for x in among))
    width = lm.width_of(model.words)
    classes = range(model.words, len(model.outputs))
    if token >= model.words:
        return share(classes[-1], classes)
    c = token // width
    return share(model.words + c, classes) + share(token, range(c * width, min((c + 1) * width, model.words)))


def small_model(words, seed=3):
    rng = np.random.default_rng(seed)
    model = lm.start_model({bytes([65 + i]): i for i in range(words)}, rng.integers(1, 50, words + 1).astype(float))
    return lm.Model(words, *[p + rng.normal(0, 0.3, p.shape).astype(np.float32) for p in model[1:]])


@pytest.mark.parametrize("words", [1, 2, 7, 16, 23])
def test_scores_equal_the_plain_model(words):
    model, rng = small_model(words), np.random.default_rng(words)
    texts = [rng.integers(0, words + 1, n) for n in (1, 3, 9, 30)]
    code, first = np.concatenate(texts).astype(np.int32), np.cumsum([0, *map(len, texts)])
    stream, place = lm.streamed(code, first, words + 1)
    got = lm.scored(model, code, lm.combined(model.inputs[stream], model.maps)[place - lm.CONTEXT])
    want = [plain_log_probability(model, t[:i], t[i]) for t in texts for i in range(len(t))]
    assert np.allclose(got, want, atol=1e-4)
    total = sum(math.exp(plain_log_probability(model, texts[2][:4], t)) for t in range(words + 1))
    assert math.isclose(total, 1, rel_tol=1e-6)


def test_blocks_of_a_product_do_not_show(monkeypatch):
    model, rng = small_model(20), np.random.default_rng(0)
    code = rng.integers(0, 21, 500).astype(np.int32)
    context = rng.integers(0, 22, (500, lm.CONTEXT))
    whole = lm.log_probabilities(model, code, context)
    monkeypatch.setattr(lm, "ROWS", 7)
    assert np.allclose(lm.log_probabilities(model, code, context), whole, atol=1e-5)


def test_training_learns_what_follows_what():
    words, rng = 30, np.random.default_rng(5)
    code = (np.cumsum(rng.integers(1, 3, 60_000)) % words).astype(np.int32)  # one or two further each time
    counts = np.append(np.bincount(code, minlength=words), 1).astype(float)
    model = lm.start_model({bytes([65 + i]): i for i in range(words)}, counts)
    stream, place = lm.streamed(code, np.array([0, len(code)]), words + 1)
    mean = lambda: lm.scored(model, code, lm.combined(model.inputs[stream], model.maps)[place - lm.CONTEXT]).mean()
    before = mean()
    speed = [np.zeros(len(p), np.float32) for p in model[1:]]
    noise, draws = lm.noise_of(model, counts), np.random.default_rng(1)
    for _ in range(4):
        lm.nce_steps(model, speed, stream, noise, draws, lm.RATE)
    assert before < -3.3 and mean() > -1.6  # log(1 / 30) = -3.4, the best there is log(1 / 2) = -0.7


def test_all_numbers_of_a_text_are_added_up(docs_of):
    rows = [(i, " ".join("abcdefg"[(i * k) % 7] for k in range(i % 40))) for i in range(200)] + [(900, "a b " * 60_000), (901, None)]
    got = {r.doc_id: r for r in lm.score_texts(docs_of(rows), rounds=0).collect()}
    token = lambda t: (t or "").encode().lower().split() + [b""]
    train = Counter(x for d, t in rows if not got[d].held_out for x in token(t))
    listed = sorted(train, key=lambda t: (-train[t], t))
    model = lm.start_model({t: i for i, t in enumerate(listed)}, np.array([*[train[t] + 1.0 for t in listed], 1.0]))
    for d, t in rows[:60] + rows[-1:]:
        code = [listed.index(x) for x in token(t)]
        assert math.isclose(got[d].score, sum(plain_log_probability(model, code[:i], c) for i, c in enumerate(code)) / math.log(10), rel_tol=1e-4)
    assert got[900].n_tokens == 120_001 and got[900].score < -10_000


def test_vocabulary_grows_with_the_training_tokens(docs_of, monkeypatch):
    sizes, start = [], lm.start_model
    monkeypatch.setattr(lm, "GROWTH", 2)
    monkeypatch.setattr(lm, "start_model", lambda v, c, **o: sizes.append(len(v)) or start(v, c, **o))
    for n in (40, 320):
        lm.score_texts(docs_of([(i, " ".join(f"w{(i * 31 + k * k) % 997}" for k in range(50))) for i in range(n)]), rounds=0)
    assert sizes[0] > 20 and 1.9 < sizes[1] / sizes[0] < 2.1


def test_empty_table_and_all_held_out(docs_of):
    assert lm.score_texts(docs_of([])).collect() == []
    rows = [(i, "a b a") for i in range(60)]
    out = [r[0] for r in rows if r[0] in {x.doc_id for x in lm.score_texts(docs_of(rows)).where("held_out").collect()}]
    got = lm.score_texts(docs_of([(d, "a b a") for d in out])).collect()
    assert len(got) == len(out) > 2
    assert all(r.held_out and (r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) == (4, 0, 0, 0, 0) for r in got)


def test_scores_beyond_the_range_of_an_exponential():
    rng = np.random.default_rng(8)
    guess, vectors, bias = rng.normal(0, 1, (2100, 5)), rng.normal(0, 1, (9, 5)), rng.normal(0, 1, 9)
    at = rng.integers(0, 9, len(guess))
    for scale in (1, 300):
        score = scale * guess @ vectors.T + bias
        top = score.max(1)
        want = score[np.arange(len(at)), at] - top - np.log(np.exp(score - top[:, None]).sum(1))
        got = lm.log_softmax_at(lm.with_one((scale * guess).astype(np.float32)), vectors.astype(np.float32), bias.astype(np.float32), at)
        assert np.allclose(got, want, rtol=1e-5, atol=1e-4 * scale)


def test_places_of_numbers_of_more_than_16_bits():
    code = np.random.default_rng(2).integers(0, 200_000, 5000)
    assert (lm.sorted_places(code) == np.argsort(code, kind="stable")).all()
    assert (lm.sorted_places(code % 300) == np.argsort(code % 300, kind="stable")).all()
    assert len(lm.sorted_places(code[:0])) == 0


def test_texts_are_split_like_words_between_ascii_blanks():
    texts = ["", None, "  ", " \t x\x0bY\x0c z\r\n", "é\x1cÀ\x85 x\xa0y", "İ ſ K ẞ", "a" * 70 + " A", "\x00 \x00\x00 a", "one"]
    want = [(t or "").encode().lower().split() + [b""] for t in texts]
    assert lm.tokens_of(pa.array(texts)).to_pylist() == want
    assert lm.tokens_of(pa.array(["skipped", *texts], pa.large_string())[1:]).to_pylist() == want


def test_only_tokens_that_are_not_listed_are_left_for_the_join(docs_of, monkeypatch):
    encoded, encode = [], lm.encode
    monkeypatch.setattr(lm, "encode", lambda *a: encoded.append(encode(*a)) or encoded[-1])
    rows = [(i, " ".join(f"w{k * k % (i % 60 + 3)} c{k % 7}" for k in range(50)) + f" only{i} " + "l" * 65) for i in range(80)] + [(900, None)]
    got = {}
    for listed in (1 << 18, 20, 0):
        monkeypatch.setattr(lm, "LISTED", listed)
        got[listed] = sorted(lm.score_texts(docs_of(rows), top=5, rounds=0).collect())
    left = [sum(len(r.rare) for r in e.collect()) for e in encoded]
    train = {r.doc_id for r in got[0] if not r.held_out}
    # tokens that no training text has, and the one that is too long for the list
    assert left[0] == sum(len({x for x in t.split() if len(x) > 64 or x[:4] == "only" and i not in train}) for i, t in rows[:-1])
    assert left[0] < left[1] < left[2]
    for a, b in ((1 << 18, 0), (20, 0)):
        assert [x[:5] for x in got[a]] == [x[:5] for x in got[b]]
        assert np.allclose([x[5:] for x in got[a]], [x[5:] for x in got[b]], rtol=1e-12)


@pytest.mark.parametrize("top, listed, want", [(3, 0, 3), (3, 4, 4), (0, 5, 4), (9, 6, 9), (40, 6, 26), (2, 100, 26)])
def test_most_frequent_tokens_by_a_histogram(spark, monkeypatch, top, listed, want):
    monkeypatch.setattr(lm, "LISTED", listed)
    n = [90, 40, 7, 7, 3, 3, 3, *[1] * 19]  # one of them too long
    rows = [(f"{chr(122 - i)}".encode(), x) for i, x in enumerate(n)] + [(b"l" * 65, 50)]
    total, distinct, size, found = lm.frequent_tokens(spark.createDataFrame(rows, "token binary, n long"), lambda _: top)
    ordered = sorted(((t, x) for t, x in rows if len(t) <= 64), key=lambda r: (-r[1], r[0]))
    assert (total, distinct, size) == (sum(n) + 50, 27, top)
    assert list(zip(*found.to_pydict().values())) == ordered[:want]


def test_numbers_beyond_16_bits_are_written_whole():
    for words in (65_534, 65_535, 100_000):
        kind = lm.kind_of(words)
        code = np.array([0, words + 1, 7, words], kind)
        column = pa.array([code[:1].tobytes(), b"", code[1:].tobytes()], pa.binary())
        got, first = lm.numbers(column[1:], kind)
        assert got.tolist() == [words + 1, 7, words] and first.tolist() == [0, 0, 3]


@pytest.mark.parametrize("gather, most", [(400_000, 32 << 20), (3, 32 << 20), (400_000, 50)])
def test_tokens_are_counted_whole_however_few_are_gathered(docs_of, monkeypatch, gather, most):
    monkeypatch.setattr(lm, "GATHER", gather)
    monkeypatch.setattr(lm, "GATHER_BYTES", most)
    monkeypatch.setattr(lm, "SPLIT_BYTES", 40)
    rows = [(i, f"a A b{i % 5} {'long' * i}") for i in range(60)] + [(60, None), (61, " ")]
    got = {bytes(r.token): r.n for r in lm.token_counts(docs_of(rows)).collect()}
    assert got == Counter(x for _, t in rows for x in (t or "").encode().lower().split() + [b""])

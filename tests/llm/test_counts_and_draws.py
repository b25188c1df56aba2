"""Token counts, importance resampling and centroid clustering against plain Python."""

import hashlib
import math
import random
import re
import tempfile
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from brute import lower
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpusloom.llm import centroids as ce
from corpusloom.llm import importance as im
from corpusloom.llm import token_counts as tc

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
SF = "/root/testdata/sf0.001"


# ---- token counts ----------------------------------------------------------------


def library_counts(texts):
    model = Tokenizer.from_file(WORD_BPE)
    model.no_truncation()
    model.no_padding()
    return [len(e.ids) for e in model.encode_batch([t or "" for t in texts], add_special_tokens=False)]


ODD = [
    (3, "Same  Text"), (9, "same text"), (9, "same text"), (4, None), (5, ""), (None, "same\ttext"), (6, "J̌ Äé"), (7, "ǰ äé"),
    (8, "<|endoftext|> a <|ENDOFTEXT|>"), (10, "<|endoftext|> a <|endoftext|>"), (11, "x" * 70_000), (12, "don 't  can't " * 30_000), (13, " \n\t"),
    (14, "漢字　かな"), (15, "a\x0bb\x1cc\x85d"),
]


def test_counts_are_those_of_the_library(docs_of, spark):
    frame = docs_of(ODD)
    cache = tempfile.mkdtemp(prefix="corpusloom-test-") + "/cache"
    want = Counter((d, len((t or "").encode()), n, n > 2048) for (d, t), n in zip(ODD, library_counts([t for _, t in ODD])))
    cold = tc.count_tokens(frame, WORD_BPE, cache).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in cold) == want
    assert not any(r.cached for r in cold)
    held = spark.read.parquet(cache).count()
    assert held == len({r.digest for r in cold}) < len(ODD)
    warm = tc.count_tokens(frame, WORD_BPE, cache).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in warm) == want
    assert all(r.cached for r in warm) and spark.read.parquet(cache).count() == held
    assert tc.count_tokens(frame.where("false"), WORD_BPE, cache).count() == 0
    assert spark.read.parquet(cache).count() == held


def test_only_misses_are_encoded(docs_of, spark):
    cache = tempfile.mkdtemp(prefix="corpusloom-test-") + "/cache"
    tc.count_tokens(docs_of([(1, "one"), (2, "two")]), WORD_BPE, cache).count()
    digest = tc.load_encoder(WORD_BPE).digest
    # a planted count shows whether the cache or the encoder answered; other tokenizers' rows are not looked at
    marked = spark.read.parquet(cache).withColumn("n_tokens", F.lit(77).cast("long"))
    other = marked.withColumn("tokenizer", F.lit("other"))
    path = tempfile.mkdtemp(prefix="corpusloom-test-") + "/cache"
    marked.limit(1).unionByName(other).write.parquet(path)
    rows = tc.count_tokens(docs_of([(1, "one"), (2, "TWO"), (3, "three"), (4, "three ")]), WORD_BPE, path).collect()
    assert sorted((r.n_tokens, r.cached) for r in rows) == [(1, False)] * 3 + [(77, True)]
    added = spark.read.parquet(path).where(F.col("tokenizer") == digest).count()
    assert added == 3  # one before, two new texts


def test_hot_text(docs_of):
    rows = [(i, "again and again") for i in range(3000)] + [(5000 + i, f"text {i}") for i in range(1500)]
    got = tc.count_tokens(docs_of(rows), WORD_BPE).collect()
    assert Counter((r.doc_id, r.n_tokens) for r in got) == Counter((d, n) for (d, _), n in zip(rows, library_counts([t for _, t in rows])))


def test_words_and_normal_forms_add_up(spark):
    rng = random.Random(3)
    letters = [chr(i) for i in range(128)] + list("  \t\n\r''<|>sStTaBcD") * 6 + list("éıİǰ̌́ÅK漢字  Σς") + ["<|endoftext|>"] * 4
    texts = ["".join(rng.choices(letters, k=rng.randrange(0, 150))) for _ in range(3000)]
    encoder = tc.load_encoder(WORD_BPE)
    whole, words = library_counts(texts), tc.WordCounter(encoder)
    assert [words(t) for t in texts] == whole
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")
    forms = [r.n for r in frame.select("i", tc.normal_form(F.col("t"), encoder).alias("n")).orderBy("i").collect()]
    assert [words(t) for t in forms] == whole
    assert " ".join(tc.pieces("ab cd  ef g", 3)) == "ab cd  ef g" and tc.pieces("x" * 9, 3) == ["x" * 9]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_other_vocabularies(docs_of, name):
    path = public_tokenizers.path(name)
    texts = [t for _, t in ODD if len(t or "") < 1000]
    if name.endswith(".model"):
        import sentencepiece

        want = [len(x) for x in sentencepiece.SentencePieceProcessor(model_file=path).encode([t or "" for t in texts])]
    else:
        want = [len(e.ids) for e in Tokenizer.from_file(path).encode_batch([t or "" for t in texts], add_special_tokens=False)]
    got = tc.count_tokens(docs_of([(i, t) for i, t in enumerate(texts)]), path).collect()
    assert {r.doc_id: r.n_tokens for r in got} == dict(enumerate(want))


def test_words_kept_are_bounded(monkeypatch):
    monkeypatch.setattr(tc, "KEPT_WORDS", 5)
    monkeypatch.setattr(tc, "CALL_CHARS", 20)
    words = tc.WordCounter(tc.load_encoder(WORD_BPE))
    texts = [" ".join(f"word{i * j}" for j in range(9)) for i in range(20)]
    assert [words(t) for t in texts] == library_counts(texts)
    assert len(words.known) <= 9


# ---- importance resampling -------------------------------------------------------


def draw(rows, items, percent=10, min_words=20, runs=1, buckets=10_000, seed=2024):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

    def found(text):
        w = pattern.findall(lower(text))
        return w, [zlib.crc32(" ".join(w[i:i + n]).encode()) % buckets for n in range(1, runs + 1) for i in range(len(w) - n + 1)]

    source, target = Counter(), Counter()
    docs = [(d, *found(t)) for d, t in rows]
    for _, _, f in docs:
        source.update(f)
    for _, t in items:
        target.update(found(t)[1])
    s_all, t_all = sum(source.values()), sum(target.values())
    gain = {b: math.floor(1000 * math.log((target[b] + 1) * (s_all + buckets) / ((source[b] + 1) * (t_all + buckets)))) for b in source}
    out = []
    for d, w, f in docs:
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append([d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(w)])
    able = sorted((i for i, r in enumerate(out) if r[5] >= min_words), key=lambda i: (-out[i][3], out[i][0] is None, out[i][0] or 0, i))
    for rank, i in enumerate(able[:percent * len(able) // 100], 1):
        out[i][4] = rank
    return Counter(tuple(r[:5]) for r in out)


def drawn(frame, target, **options):
    return Counter((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in im.resample(frame, target, **options).collect())


def test_draw_against_brute_force(docs_of, spark):
    rng = random.Random(8)
    word = lambda: rng.choice(["aa", "Bb", "cc", "d1", "é", "x" * 80, "f", "g" * 7])
    rows = [(i, " ".join(word() for _ in range(rng.randrange(15, 60)))) for i in range(400)]
    same = " ".join(["aa"] * 30)
    rows += [(1000 + i, same) for i in range(200)] + [(7, same), (7, same), (None, same), (None, same), (900, None), (901, ""), (902, "--"), (903, "long " * 40_000)]
    items = [(i, " ".join(word() for _ in range(30))) for i in range(10)] + [(11, None), (12, "aa aa")]
    frame, target = docs_of(rows), spark.createDataFrame(items, "item_id long, text string")
    assert drawn(frame, target) == draw(rows, items)
    assert drawn(frame, target, percent=37, min_words=0, runs=3, buckets=101, range_rows=13) == draw(rows, items, 37, 0, 3, 101)
    for percent in (1, 50, 99, 100):  # a coarse sketch: brackets have to be widened
        assert drawn(frame, target, percent=percent, accuracy=3, range_rows=50) == draw(rows, items, percent)
    assert drawn(frame, target, percent=0) == draw(rows, items, 0)
    assert drawn(frame, target.where("false")) == draw(rows, [])
    assert im.resample(frame.where("false"), target).count() == 0


def test_bracket_is_validated(spark, monkeypatch):
    """Whatever the sketch says, the cutoff is the one of a full sort."""
    rng = random.Random(1)
    scored = spark.createDataFrame([(rng.choice([5, 5, 5, rng.randrange(100)]), i % 90, i) for i in range(500)], "score long, doc_id long, row long")
    want = sorted(((-r.score, r.doc_id, r.row) for r in scored.collect()))
    exact = F.percentile_approx
    for shift in (0.0, 0.4, -0.4):
        wrong = lambda c, p, a, s=shift: exact(c, min(max(p + s, 0.0), 1.0), a)
        monkeypatch.setattr(im.F, "percentile_approx", wrong)
        for k in (1, 50, 250, 499, 500):
            score, doc_id, row = im.cutoff(scored, 500, k, 100, 40)
            assert (-score, doc_id, row) == want[k - 1]


# ---- centroid clustering ---------------------------------------------------------


def lloyd(rows, k=40, rounds=5, dim=64):
    kept = [(d, [math.floor(256 * x) for x in v]) for d, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    digest = lambda d: hashlib.sha256(f"2:{'' if d is None else d}".encode()).hexdigest()
    centers = [v for _, v in sorted(kept, key=lambda r: (digest(r[0]), r[1]))[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), i) for i, c in enumerate(centers))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        centers = [[sum(x) // len(groups[i]) for x in zip(*groups[i])] if i in groups else c for i, c in enumerate(centers)]
    found = [(d, *near(v)) for d, v in kept]
    sums = Counter()
    for _, distance, c in found:
        sums[c] += distance
    return Counter((d, c, distance, sums[c], sum(sums.values()), hashlib.sha256(",".join(map(str, centers[c])).encode()).hexdigest()) for d, distance, c in found)


def clustered(frame, **options):
    return Counter(
        (r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in ce.cluster_vectors(frame, **options).collect()
    )


def test_clusters_against_brute_force(spark):
    rng = random.Random(4)
    rows = [(i, [rng.gauss(i % 5, 0.3) for _ in range(64)]) for i in range(150)] + [(3, [0.5] * 64)] * 30
    rows += [(None, [-1.0] * 64), (200, None), (201, []), (202, [1.0] * 63), (203, [1.0] * 65), (204, [None] + [1.0] * 63)]
    rows += [(205, [float("nan")] + [1.0] * 63), (206, [float("inf")] * 64), (207, [-0.001] * 64), (208, [1000.25] * 64)]
    for kind in ("double", "float"):
        path = tempfile.mkdtemp(prefix="corpusloom-test-") + "/vectors"
        spark.createDataFrame([(*r, "x", "y") for r in rows], f"vec_id long, embedding array<{kind}>, cluster string, distance string").write.parquet(path)
        frame = spark.read.parquet(path)
        if kind == "double":
            assert clustered(frame) == lloyd(rows)
        assert clustered(frame, k=3, rounds=2) == lloyd([(r.vec_id, r.embedding) for r in frame.collect()], 3, 2)
    assert clustered(frame, k=500, rounds=1) == lloyd([(r.vec_id, r.embedding) for r in frame.collect()], 500, 1)
    assert ce.cluster_vectors(frame.where("false")).count() == 0
    with pytest.raises(ValueError):
        ce.cluster_vectors(spark.createDataFrame([(1, [1e30] * 64)], "vec_id long, embedding array<double>"))


def test_popcounts_are_exact():
    g = np.random.default_rng(0)
    for dim, largest in ((64, 300), (64, 2**27 - 1), (3, 5), (130, 1000), (64, 0)):
        x, y = g.integers(-largest - 1, largest + 1, (90, dim)), g.integers(-largest - 1, largest + 1, (7, dim))
        bits = ce.plane_bits(largest)
        a, b = ce.planes_of(x, bits), ce.planes_of(y, bits)
        assert (ce.dots(a, b) == x @ y.T).all() and (ce.norms(a) == (x * x).sum(axis=1)).all()
        cluster = g.integers(0, 5, 90)
        sums = ce.plane_sums(a, cluster, 6, dim)
        assert all((sums[k] == x[cluster == k].sum(axis=0)).all() for k in range(6))

"""The other operators against brute force, and on nulls, empty texts, ties, repeated rows and empty tables."""

import datetime
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from brute import held_out, lower
from pyspark.sql import functions as F

from corpusloom.llm import lm, quality, toxicity, warc
from corpusloom.llm.decontaminate import decontaminate, drop_contaminated
from corpusloom.llm.exact_dedup import drop_exact_duplicates, exact_dedup
from corpusloom.llm.kernels import ALNUM, NOT_SPACE, words
from corpusloom.llm.mixing import mix_sources
from corpusloom.llm.url_filter import url_filter

ODD = [(3, "Same text"), (9, "sAME TEXT"), (9, "same text"), (4, None), (5, ""), (None, "same text"), (6, "ÄB c"), (7, "äB c"), (8, "x" * 70_000)]


@pytest.mark.parametrize("alphabet, pattern", [(NOT_SPACE, rb"[^\x20\x09-\x0D]+"), (ALNUM, rb"[0-9a-zA-Z\x80-\xff]+")])
@pytest.mark.parametrize("size", [3, 17, 1 << 20])
def test_words(alphabet, pattern, size):
    texts = ["", "a", " Ab ab-AB\tç", "ab", "ab", "\n", "x y  z", "long" * 20 + " end"]
    raw = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0] + [len(r) for r in raw])
    w = words(data, offsets, alphabet, size=size)
    want = [(i, m.start() + offsets[i], m.end() + offsets[i], m.group().lower()) for i, r in enumerate(raw) for m in re.finditer(pattern, r)]
    assert list(zip(w.doc.tolist(), w.start.tolist(), w.end.tolist())) == [x[:3] for x in want]
    keys = {}
    for x, k in zip(want, w.key.tolist()):
        assert keys.setdefault(x[3], k) == k
    assert len(set(keys.values())) == len(keys)


def test_exact_dedup(docs_of):
    frame = docs_of(ODD)
    got = exact_dedup(frame, prefix=4).collect()
    groups = {}
    for d, t in ODD:
        groups.setdefault(lower(t), []).append(d)
    for r in got:
        pass
    counts = Counter((r.doc_id, r.keep_id, r.group_size) for r in got)
    want = Counter((d, max((x for x in groups[lower(t)] if x is not None), default=None), len(groups[lower(t)])) for d, t in ODD)
    assert counts == want
    assert sum(r.kept for r in got) == len(groups)
    kept = drop_exact_duplicates(frame, prefix=4)
    assert kept.columns == frame.columns
    assert Counter(lower(r.text) for r in kept.collect()) == Counter(groups.keys())
    assert exact_dedup(frame.where("false")).count() == 0 and drop_exact_duplicates(frame.where("false")).count() == 0


def check_mix(rows, weights, fine_rows, max_blocks):
    """Every weighted source stays by its share until the window in which one runs out."""
    rows = sorted(rows, key=lambda r: (r.mix_window, r.mix_slot, r.mix_rank))
    sources, taken, total = {r.source for r in rows}, Counter(), sum(weights.values())
    block = max(1, math.ceil(len(rows) / max_blocks))
    stop = min(max(r.mix_window for r in rows if r.source == s) for s in weights)
    assert stop > 3
    for n, r in enumerate(rows, 1):
        if r.mix_window == stop:
            break
        taken[r.source] += 1
        for s, w in weights.items():
            assert abs(taken[s] - n * w / total) < block + (2 * fine_rows if block > 1 else 0), (n, s)
    for s in sources:
        assert [r.mix_rank for r in rows if r.source == s] == list(range(sum(r.source == s for r in rows)))


def test_mixing(spark):
    rng = random.Random(2)
    rows = [(i, rng.choices(["a", "b", "c", None, "zero"], [60, 20, 10, 6, 4])[0], "t", "s") for i in range(4000)] + [(1, "a", "t", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, mix_slot string")
    weights = {"a": 3.0, "b": 2.0, "c": 1.0, None: 0.5}
    table = spark.createDataFrame([*weights.items(), ("zero", 0.0), ("gone", 4.0)], "source string, weight double")
    for fine, blocks in ((1, 4096), (1, 1000), (2, 500)):
        mixed = mix_sources(docs, table, fine_rows=fine, max_blocks=blocks, bucket_rows=300)
        got = mixed.collect()
        assert Counter((r.doc_id, r.source) for r in got) == Counter(r[:2] for r in rows)
        check_mix(got, weights, fine, blocks)
        last = max((r.mix_window, r.mix_slot) for r in got if r.source != "zero")
        assert all((r.mix_window, r.mix_slot) > last for r in got if r.source == "zero")
    assert mix_sources(docs.where("false")).count() == 0


def test_decontamination(docs_of, spark):
    rng = random.Random(4)
    word = lambda: rng.choice(["aa", "bb", "cc", "d1", "é"])
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([20, 13, 14, 5, 1, 40, 0])] + [(7, None), (20, "-- --"), (21, "Solo!"), (22, "solo")]
    items[4] = (4, "unique")
    texts = [" ".join(word() for _ in range(60)) for _ in range(40)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(100 + i, f"x {t} y".upper()) for i, (_, t) in enumerate(items)] + [(200, None), (201, ""), (202, "a solo unique b"), (202, "a solo unique b")]
    rows += [(300 + n, "solo " + "z " * (n - 1)) for n in (19, 20, 21, 60, 140)]
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    coded = [(str(i), pattern.findall(lower(t))) for i, t in items]
    want = Counter()
    for d, t in rows:
        w, hit, found = pattern.findall(lower(t)), set(), set()
        for name, item in coded:
            n = min(len(item), 13)
            grams = {tuple(item[k:k + n]) for k in range(len(item) - n + 1)} if n else set()
            for k in range(len(w) - n + 1):
                if tuple(w[k:k + n]) in grams:
                    hit |= set(range(k, k + n))
                    found.add(name)
        want[d, len(w), len(hit), tuple(sorted(found)), len(hit) > 0 and 20 * len(hit) >= len(w)] += 1
    frame = docs_of(rows)
    bench = spark.createDataFrame(items + items[:2], "item_id long, text string")
    got = decontaminate(frame, bench).collect()
    assert Counter((r.doc_id, r.n_words, r.n_hit, tuple(r.item_ids), r.contaminated) for r in got) == want
    for r in got:
        raw = next(t for d, t in rows if d == r.doc_id)
        inside = sum(len(pattern.findall(lower((raw or "").encode()[s.start:s.end].decode()))) for s in r.spans)
        assert inside == r.n_hit
    kept = drop_contaminated(frame, bench)
    assert kept.columns == frame.columns
    assert kept.count() == sum(n for k, n in want.items() if not k[4])
    assert decontaminate(frame, bench.where("false")).where("contaminated").count() == 0
    assert decontaminate(frame.where("false"), bench).count() == 0


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def test_automaton():
    rng = random.Random(8)
    terms = [b"idiot", b"moron", b"abcabcabca", b"abd", b"worthless"]
    matcher = toxicity.Matcher(terms, [b"vequ"])
    tries = [bytes(rng.choices(b"abcdiotmrn", k=rng.randrange(1, 12))) for _ in range(3000)] + [b"vequx", b"vequ", b"xvequ", b"veq"]
    for t in terms:
        for _ in range(300):
            x = bytearray(t)
            for _ in range(rng.randrange(4)):
                k = rng.randrange(len(x)) if x else 0
                x[k:k + rng.randrange(2)] = bytes(rng.choices(b"abcdiotmrnz", k=rng.randrange(2)))
            tries.append(bytes(x))
    tries = [t for t in tries if t]
    data, end = np.frombuffer(b"".join(tries), np.uint8), np.cumsum([len(t) for t in tries])
    found = matcher.match(data, end - [len(t) for t in tries], end)
    for t, code in zip(tries, found):
        near = [(levenshtein(t, x), i) for i, x in enumerate(terms) if levenshtein(t, x) <= toxicity.edits_for(x)]
        want = (5, 0) if t.startswith(b"vequ") else (min(near)[1], min(near)[0]) if near else (-1, 0)
        assert matcher.meaning[code] == want, t


def labelled(seed, n, bad, make):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        is_bad = rng.random() < 0.3
        rows.append((i, make(rng, is_bad)))
        labels.append((i, 0 if is_bad == (bad == "quality") else 1))
    return rows, labels


def test_toxicity(docs_of, spark):
    def make(rng, toxic):
        w = ["".join(rng.choices("etaoinshr", k=rng.randrange(2, 7))) for _ in range(40)]
        if toxic:
            for _ in range(3):
                w[rng.randrange(40)] = rng.choice(["wretch", "Dolt!", "imbecile", "grumb" + "".join(rng.choices("aeiou", k=3))])
        return " ".join(w)

    rows, labels = labelled(1, 900, "toxic", make)
    extra = [(5000, "you imbecille and dollt, wretchh"), (5001, None), (5002, ""), (5003, "quiet text"), (None, "an imbecile"), (5000, "you imbecille and dollt, wretchh")]
    frame = docs_of(rows + extra)
    table = spark.createDataFrame(labels + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.fit(frame, table)
    got = toxicity.score_toxicity(frame, model).collect()
    truth = dict(labels)
    out = [r for r in got if r.doc_id in truth and r.held_out]
    assert sum(r.predicted == truth[r.doc_id] for r in out) >= 0.95 * len(out)
    by = {r.doc_id: r for r in got}
    assert by[5000].predicted == 1 and by[5001].predicted == by[5002].predicted == by[5003].predicted == 0
    assert all(r.held_out == held_out(r.doc_id, 5, 0) and 0 <= r.score <= 1 for r in got) and len(got) == len(rows) + len(extra)
    kept = toxicity.drop_toxic(frame, model)
    assert kept.columns == frame.columns and kept.count() == sum(not r.predicted for r in got)
    nothing = toxicity.fit(frame.where("false"), table.where("false"))
    assert toxicity.score_toxicity(frame, nothing).where("predicted = 1").count() == 0


def test_toxicity_of_misspelled_stems_and_short_terms(docs_of, spark):
    endings = ["idiot", "idiots", "idiotic", "idiott", "idiocy"]

    def make(rng, toxic):
        w = ["".join(rng.choices("etaonshr", k=rng.randrange(2, 7))) for _ in range(40)]
        if toxic:
            for _ in range(3):
                w[rng.randrange(40)] = rng.choice([*endings, *endings, "zqx"])
        return " ".join(w)

    rows, labels = labelled(2, 900, "toxic", make)
    extra = [(5000, "you iidiot"), (5001, "you idxot"), (5002, "you zqx"), (5003, "you zqxx"), (5004, "idiotism")]
    model = toxicity.fit(docs_of(rows), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert any(b"idiot".startswith(t) and len(t) < 5 for t in model.matcher.terms)  # a stem
    by = {r.doc_id: r.predicted for r in toxicity.score_toxicity(docs_of(extra), model).collect()}
    assert by == {5000: 1, 5001: 1, 5002: 1, 5003: 0, 5004: 1}


def test_quotations_count_less():
    matcher = toxicity.Matcher([b"imbecile"], [])
    raw = 'they said "an imbecile wrote it" then an imbecile'.encode()
    hits, n = toxicity.find_hits(matcher, np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), 3)
    assert hits.is_quote.tolist() == [True, False] and n.tolist() == [9]


def test_quality(docs_of, spark):
    def make(rng, bad):
        w = ["".join(rng.choices("etaoinshr", k=rng.randrange(2, 7))) for _ in range(rng.randrange(20, 300))]
        k = rng.randrange(len(w))
        return " ".join(w[:k] + [w[k]] * 30 + w[k:] if bad else w)

    rows, labels = labelled(2, 900, "quality", make)
    frame = docs_of(rows + [(5001, None), (5002, ""), (None, "a b")])
    table = spark.createDataFrame(labels, "doc_id long, quality int")
    got = quality.score_quality(frame, quality.fit(frame, table)).collect()
    truth = dict(labels)
    out = [r for r in got if r.doc_id in truth and r.held_out]
    assert sum(r.predicted == truth[r.doc_id] for r in out) >= 0.9 * len(out)
    assert len(got) == len(rows) + 3 and all(0 <= r.score <= 1 for r in got)
    assert quality.score_quality(frame, quality.fit(frame, table.where("false"))).where("score <> 0.5").count() == 0


def test_lm(docs_of):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice(["the cat sat", "a dog ran", "Wort"]) if rng.random() < 0.8 else "".join(rng.choices("abc", k=4)) for _ in range(30))) for i in range(300)]
    rows += [(400, None), (401, ""), (402, "neverseen Neverseen"), (None, "the cat"), (7, rows[7][1])]
    got = lm.score_texts(docs_of(rows), top=5).collect()
    token = lambda t: lower(t).encode().split() + [b""]
    train = Counter(x for d, t in rows if not held_out(d, 7, 2) for x in token(t))
    n, v = sum(train.values()), len(train)
    want = Counter()
    for d, t in rows:
        base = sum(math.log10((train[x] + 1) / (n + v + 1)) for x in token(t))
        want[d, held_out(d, 7, 2), len(token(t)), sum(train[x] > 0 for x in token(t)), n, round(base, 6)] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 for r in got)
    out = [r for r in got if r.held_out and r.n_tokens > 10]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_lm_trains_on_from_the_mean_of_all_tasks(docs_of):
    rng = random.Random(11)
    rows = [(i, " ".join(rng.choice(["the cat sat", "a dog ran"]) for _ in range(40))) for i in range(400)]
    frame = docs_of(rows).repartition(4, "doc_id")
    held = lambda **o: sum(r.score for r in lm.score_texts(frame, top=8, **o).collect() if r.held_out)
    assert held() > held(rounds=1)


def test_lm_is_normalised():
    vocabulary = {b"a": 0, b"b": 1, b"": 2}
    model = lm.start_model(vocabulary, np.array([4.0, 3.0, 2.0, 5.0]))
    context = np.array([[0, 1, 4, 4]] * 4, np.int32)
    assert math.isclose(np.exp(lm.log_probabilities(model, np.arange(4), context)).sum(), 1, rel_tol=1e-5)


def test_url_filter_has_an_answer_for_every_row(spark):
    day = datetime.date
    captures = spark.createDataFrame([
        (1, "http://a.b.example.com/x/y?q", day(2020, 5, 1)), (2, "https://u:p@B.Example.com:80/", day(2020, 1, 1)), (3, None, day(2020, 1, 1)),
        (4, "nonsense", day(2020, 1, 1)), (5, "http://example.com/x", None), (1, "http://a.b.example.com/x/y?q", day(2020, 5, 1)),
        (6, "http://a.b.example.com/x", day(2019, 1, 1)), (7, "http://c.org/x/yy", day(2020, 6, 1)),
    ], "capture_id long, url string, fetched_on date")
    entries = spark.createDataFrame([
        ("l", "example.com", "block", day(2019, 6, 1), True), ("l", "example.com", "block", day(2020, 4, 1), False),
        ("m", "b.example.com", "allow", day(2019, 12, 1), True), ("k", "b.example.com", "block", day(2019, 12, 1), True),
        ("m", "c.org/x", "block", day(2020, 6, 1), True), ("m", "c.org/x/y", "block", day(2020, 6, 1), True), (None, "c.org", "allow", day(2020, 1, 1), True),
        ("l", None, "block", day(2019, 6, 1), True), ("l", "c.org", "block", None, True),
    ], "list_name string, pattern string, action string, listed_on date, listed boolean")
    got = Counter((r.capture_id, r.decision, r.pattern, r.list_name, r.n_active) for r in url_filter(captures, entries, 5).collect())
    assert got == Counter([
        (1, "allow", "b.example.com", "m", 2), (1, "allow", "b.example.com", "m", 2), (2, "allow", "b.example.com", "m", 3), (3, "none", None, None, 0),
        (4, "none", None, None, 0), (5, "none", None, None, 0), (6, "none", None, None, 0), (7, "block", "c.org/x", "m", 1),
    ])
    assert url_filter(captures.where("false"), entries).count() == 0
    assert url_filter(captures, entries.where("false")).where("decision <> 'none'").count() == 0


def test_url_filter_keeps_the_case_of_paths(spark):
    day = datetime.date(2020, 6, 1)
    captures = spark.createDataFrame([(1, "http://Example.com/Ads/x", day), (2, "http://example.com/ads/x", day)], "capture_id long, url string, fetched_on date")
    entries = spark.createDataFrame([("l", "EXAMPLE.com/Ads", "block", day, True)], "list_name string, pattern string, action string, listed_on date, listed boolean")
    got = {(r.capture_id, r.decision, r.pattern) for r in url_filter(captures, entries).collect()}
    assert got == {(1, "block", "example.com/Ads"), (2, "none", None)}


def test_loser_tree():
    rng = random.Random(9)
    for k in (0, 1, 2, 3, 5, 8, 13):
        runs = [sorted(rng.randrange(20) for _ in range(rng.randrange(8))) for _ in range(k)]
        assert list(warc.LoserTree([iter(r) for r in runs], lambda x: x)) == sorted(x for r in runs for x in r)


def test_warc_round_trip(spark):
    import base64
    import hashlib

    time = datetime.datetime(2022, 1, 2, 3, 4, 5)
    html = ["<p>a</p>", "<p>a</p>", None, "", "é\r\n\r\nWARC/1.1\r\nWARC-Type: x\r\n\r\n", "x" * 50_000, "<p>a</p>\n"]
    rows = [(i, f"http://h{i % 3}.example.org/p {i}", h, time) for i, h in enumerate(html)] + [(9, None, "<p>a</p>", None), (9, None, "<p>a</p>", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, fetched_at timestamp")
    got = warc.archive(pages).collect()
    first = {}
    for i, _, h, _ in rows:
        first[h or ""] = min(first.get(h or "", i), i)
    want = Counter()
    for i, _, h, _ in rows:
        raw = (h or "").encode()
        f = first[h or ""]
        want[i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if f == i else "revisit", None if f == i else f] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
    order = [(r.key, r.at or "", r.page_id) for r in sorted(got, key=lambda r: (r.range_no, r.place))]
    assert order == sorted(order)
    assert warc.archive(pages.where("false")).count() == 0
    big = warc.archive(pages, least_bytes=10).collect()
    assert sum(r.record_type == "revisit" for r in big) == 0

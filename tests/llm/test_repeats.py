import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from brute import repeats

from corpusloom.llm import repeats as rp
from corpusloom.llm.repeats import repeated_bytes


def expected(rows, n):
    out = []
    for i, (b, mask) in repeats(rows, n).items():
        runs = sum(1 for k, x in enumerate(mask) if x and (k == 0 or not mask[k - 1]))
        left = bytes(c for c, x in zip(b, mask) if not x)
        out.append((rows[i][0], len(b), sum(mask), runs, hashlib.sha256(left).hexdigest()))
    return sorted(out, key=repr)


def found(frame, **options):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeated_bytes(frame, **options).collect()), key=repr)


def test_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    assert found(docs) == expected(rows, 100)


@pytest.mark.parametrize("chunk_bytes", [500, 5000, 1 << 20])
def test_planted(docs_of, chunk_bytes):
    rng = random.Random(3)
    word = lambda n: "".join(rng.choices("abé ", k=n))
    passages = [word(n) for n in (100, 101, 130, 260, 99)]
    rows = [(i, word(rng.randrange(80)) + rng.choice(passages)[rng.randrange(20):] + word(rng.randrange(80))) for i in range(60)]
    rows += [(200, "x" * 450), (199, "xyz" * 90), (5, rows[5][1]), (5, passages[3]), (None, passages[3]), (None, passages[3]), (300, None), (301, ""), (302, passages[3])]
    rng.shuffle(rows)
    frame = docs_of(rows)
    got = found(frame, chunk_bytes=chunk_bytes)
    want = expected(rows, 100)
    if got != want:  # rows with equal ids are taken in the order in which they are read
        read = [(r.doc_id, r.text) for r in frame.collect()]
        want = expected(read, 100)
    assert got == want


def test_empty(docs_of):
    frame = docs_of([(1, "a" * 300)])
    assert found(frame.where("doc_id > 1")) == []


def chunk_of(texts):
    return rp.Chunk(pa.table({"row": pa.array(range(len(texts))), "doc_id": pa.array(range(len(texts))), "text": pa.array(texts)}))


def test_ranges_of_stretches_are_even(docs_of, monkeypatch):
    rng = random.Random(8)
    s = rp.Stretches(chunk_of(["".join(rng.choices("abcdefgh ", k=50_000)) for _ in range(8)]), 100)
    size = np.diff(rp.ranges(s.key, 64, 24))
    assert size.max() < 1.5 * size.mean()
    monkeypatch.setattr(rp, "RANGE_BYTES", 10)
    assert rp.parts_of(docs_of([(1, "a" * 5000)])) == 500


def test_names_have_more_than_64_bits(spark):
    key, ids = np.array([5, 9], np.uint64), np.array([1, 1])
    entries = lambda rest, more: spark.createDataFrame(pa.Table.from_batches([
        rp._emit(n, 2, key, ids + n, np.array([7, r], rest), None if more is None else np.array([3, 4], more), np.array([False, False])) for n, r in ((0, 8), (1, 6))
    ]).to_pylist(), rp.ENTRY)
    for rest, more in ((np.uint16, np.uint64), (np.uint32, None)):
        got = {r.chunk: np.unpackbits(np.frombuffer(r.late, np.uint8), count=2).tolist() for r in rp._answered(entries(rest, more), 2, more is not None).collect()}
        assert got == {0: [0, 0], 1: [1, 0]}  # the second differs in the last bits of its name alone


def test_samples_that_differ_stay_apart():
    rng = random.Random(8)
    s = rp.Stretches(chunk_of(["".join(rng.choices("abcdefgh ", k=1_000_000)) for _ in range(4)]), 100)
    sample = s.key >> np.uint64(64 - rp.SAMPLE_BITS)
    assert rp.SAMPLE_BITS >= 48 and s.new.all() and len(sample) > 100_000
    assert np.sum(sample[1:] == sample[:-1]) <= len(sample) * 0.01 and sample.max() > np.uint64(2**47)

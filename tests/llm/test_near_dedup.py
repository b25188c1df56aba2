import random

from brute import near
from pyspark.sql import functions as F

from corpusloom.llm import components, near_dedup
from corpusloom.llm.near_dedup import drop_near_duplicates, near_duplicates

SF = "/root/testdata/sf0.01"


def judged(frame, **options):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(frame, **options).collect()), key=repr)


def test_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert judged(docs) == sorted(near(rows), key=repr)


def test_chains_of_edits(docs_of):
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    rows, base = [], [word() for _ in range(120)]
    for i in range(160):  # a large group whose members are mostly not linked with each other
        own = list(base)
        for k in rng.sample(range(120), rng.choice((1, 2, 3, 4))):
            own[k] = word()
        rows.append((1000 - i, " ".join(own)))
        if i % 10 == 0:
            base = own
    rows += [(5, rows[3][1]), (5, rows[3][1].upper()), (None, rows[4][1]), (7, None), (8, ""), (9, " \t\n"), (10, "one Two"), (11, "one two"), (12, "two one")]
    assert judged(docs_of(rows)) == sorted(near(rows), key=repr)
    assert judged(docs_of(rows), percent=60) == sorted(near(rows, 60), key=repr)


def test_drop_keeps_one_of_each(docs_of):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(3, text), (2, text + " more"), (2, text + " more"), (4, "else entirely"), (5, None), (6, ""), (None, text)]
    frame = docs_of(rows)
    kept = drop_near_duplicates(frame)
    assert kept.columns == frame.columns
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr)
    assert got == sorted([(2, text + " more"), (4, "else entirely"), (5, None), (6, "")], key=repr)
    assert drop_near_duplicates(frame.where(F.lit(False))).count() == 0


def edited(n, changes, length=120, seed=3):
    """Texts of one base with own words at a few places."""
    rng = random.Random(seed)
    base = [f"b{i}" for i in range(length)]
    rows = []
    for i in range(n):
        own = list(base)
        for k in rng.sample(range(length), changes):
            own[k] = f"x{i}-{k}"
        rows.append((i, " ".join(own)))
    return rows


def test_pairs_grow_with_the_texts_not_their_square(docs_of, monkeypatch):
    counted = []
    confirmed = near_dedup._confirmed
    monkeypatch.setattr(near_dedup, "_confirmed", lambda pairs, *rest: counted.append(pairs.count()) or confirmed(pairs, *rest))
    totals = {}
    for n in (150, 600):
        counted.clear()
        rows = edited(n, 4)
        assert judged(docs_of(rows)) == sorted(near(rows), key=repr)
        totals[n] = sum(counted)
    assert totals[600] <= 5 * totals[150] and totals[600] < 20 * 600, totals


def test_a_link_is_walked_once_however_many_rounds_of_pairs(docs_of, monkeypatch):
    counted = {"near-links": [], "cc-links": []}
    written = near_dedup.checkpoint

    def counting(df, name):
        out = written(df, name)
        if name in counted:
            counted[name].append(out.count())
        return out

    monkeypatch.setattr(near_dedup, "checkpoint", counting)
    monkeypatch.setattr(components, "checkpoint", counting)
    rows = edited(60, 1) + [(100 + i, t) for i, t in edited(40, 2, seed=4)] + [(200 + i, t) for i, t in edited(60, 4, seed=6)]
    assert judged(docs_of(rows)) == sorted(near(rows), key=repr)
    assert len([n for n in counted["near-links"] if n]) > 1, counted
    assert sum(counted["cc-links"]) <= 2 * sum(counted["near-links"]), counted


def test_thresholds_in_one_large_group(docs_of):
    rows = edited(60, 1) + [(100 + i, t) for i, t in edited(40, 2, seed=4)] + [(200 + i, t) for i, t in edited(30, 3, 80, seed=5)]
    for percent in (60, 82):
        assert judged(docs_of(rows), percent=percent) == sorted(near(rows, percent), key=repr)


def test_empty_table_and_long_text(docs_of):
    assert near_duplicates(docs_of([(1, "x")]).where("false")).count() == 0
    long = " ".join(f"w{i % 7000}-{i // 9}" for i in range(120_000))
    rows = [(3, long), (1, long + " end"), (2, long[: len(long) // 2]), (4, "y" * 300_000), (4, "y" * 300_000)]
    assert judged(docs_of(rows)) == sorted(near(rows), key=repr)

"""Every stage of the pipeline against a plain version, on what the stage before kept."""

import re

from brute import lower, near

import corpus_pipeline
from corpusloom.llm import toxicity
from corpusloom.session import fresh_path

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def ids(docs):
    return {r.doc_id for r in docs.select("doc_id").collect()}


def exact(docs, spark):
    best = {}
    for r in docs.collect():
        best[lower(r.text)] = max(best.get(lower(r.text), -1), r.doc_id)
    return set(best.values())


def nearly(docs, spark):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    return {d for d, n, c in near(rows, 80) if d == c or n == 0}


def clean(docs, spark):
    grams = {}
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = WORD.findall(lower(r.text))
        n = min(len(w), 13)
        for k in range(len(w) - n + 1 if n else 0):
            grams.setdefault(n, set()).add(tuple(w[k:k + n]))
    out = set()
    for r in docs.collect():
        w, hit = WORD.findall(lower(r.text)), set()
        for n, known in grams.items():
            for k in range(len(w) - n + 1):
                if tuple(w[k:k + n]) in known:
                    hit |= set(range(k, k + n))
        if not hit or 20 * len(hit) < len(w):
            out.add(r.doc_id)
    return out


def mild(docs, spark):
    model = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    return {r.doc_id for r in toxicity.score_toxicity(docs, model).collect() if r.score < 0.5}


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    plain = {"toxicity": mild, "exact_dedup": exact, "near_dedup": nearly, "decontamination": clean, "mixing": lambda d, s: ids(d)}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        path = fresh_path(spark, "test-stage")
        out.write.parquet(path)
        kept = spark.read.parquet(path)
        assert kept.columns[:len(names)] == names and (name == "mixing" or kept.columns == names)
        assert kept.count() == len(ids(kept))
        assert ids(kept) == plain[name](docs, spark), name
        docs = kept
    assert docs.select("mix_window", "mix_slot", "mix_rank").distinct().count() > 1


def test_stages_on_nothing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 0")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0

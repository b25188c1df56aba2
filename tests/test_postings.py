"""Lexical search by postings gives the hits of the scan, and looks at few rows."""

import tempfile

import pytest

from corpusloom.functions import scoring as sc
from corpusloom.operators import postings as ps
from corpusloom.operators.search import search_lexical
from corpusloom.options import SearchOptions

CHUNK = "id string, path string, content string"


def made(spark, chunks):
    path = tempfile.mkdtemp(prefix="corpusloom-test-") + "/postings"
    ps.write_postings(chunks, path)
    return ps.read_postings(spark, path)


def hits(frame):
    return sorted((r.query_id, r["rank"], r.id, r.combined, r.metadata_score, r.content_score, r.content) for r in frame.collect())


def test_hits_are_those_of_the_scan(spark):
    rows = [(f"c{i:03}", f"src/mod{i % 7}/file{i}.ts", f"common words here item{i} group{i % 9} " + "pad " * (i % 5)) for i in range(300)]
    rows += [("x1", "a/b.ts", None), ("x2", "a/c.ts", ""), ("x3", "a/d.ts", "z" * 50_000 + " needle"), ("x4", "Odd/KEY.ts", "Ünï ÇODE İtem12 Kelvin")]
    chunks = spark.createDataFrame(rows, CHUNK)
    queries = spark.createDataFrame([
        (1, "item12"), (2, "common words"), (3, "common words item7"), (4, "to be or"), (5, "nowhere-at-all"), (6, "  "), (7, "needle zzzz"),
        (8, "file3.ts item31 common common"), (9, "ts"), (10, "kelvin key.ts"), (11, "group3 group4 here"), (12, "!!"),
    ], "query_id long, text string")
    index = made(spark, chunks)
    assert index.total == 303
    for options, share in ((SearchOptions(digits=6), 0.02), (SearchOptions(max_results=3), 0.2)):
        want = hits(search_lexical(queries, chunks, options))
        assert hits(ps.search_postings(queries, chunks, index, options, share)) == want


def test_rows_looked_at_follow_the_rare_tokens(spark):
    rows = [(f"c{i:04}", f"p/{i}.md", f"shared text of all item{i}x") for i in range(2000)]
    chunks = spark.createDataFrame(rows, CHUNK)
    index = made(spark, chunks)
    queries = spark.createDataFrame([(i, f"item{i * 100}x") for i in range(20)], "query_id long, text string")
    asked = queries.select("query_id", sc.tokenize(queries["text"]).alias("tokens"))
    found, bounds = ps.candidates(asked, index, SearchOptions(), 0.02)
    assert found.count() <= 20 * 40  # of 40,000 pairs
    assert all(r.bound == 0 for r in bounds.collect())
    got = ps.search_postings(queries, chunks, index, SearchOptions(digits=6))
    assert sorted((r.query_id, r.id) for r in got.collect() if r["rank"] == 1) == [(i, f"c{i * 100:04}") for i in range(20)]


@pytest.mark.parametrize("empty", ["chunks", "queries"])
def test_empty_tables(spark, empty):
    chunks = spark.createDataFrame([] if empty == "chunks" else [("a", "p", "some text")], CHUNK)
    queries = spark.createDataFrame([] if empty == "queries" else [(1, "some text")], "query_id long, text string")
    assert ps.search_postings(queries, chunks, made(spark, chunks)).count() == 0


def test_texts_are_read_once_and_a_hot_gram_is_many_parts(spark):
    n, read = 400, spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(len(batch))
            yield batch

    rows = [(f"c{i:04}", f"p/{i}.md", "shared text") for i in range(n)]
    chunks = spark.createDataFrame(rows, CHUNK).mapInPandas(counted, CHUNK)
    path = tempfile.mkdtemp(prefix="corpusloom-test-") + "/postings"
    ps.write_postings(chunks, path)
    assert read.value <= 3 * n  # for the metadata, for the content, for the total
    hot = ps.read_postings(spark, path).rows.where("field = 'c' and gram = 'sha'")
    assert hot.count() == n and hot.select("_metadata.file_path").distinct().count() > 1

"""Queries over tables whose layout or texts differ from those of the small ones."""

from oracle_check import compare, connect

import __spark_entry__ as entry
from corpusloom.plans import views as v
from corpusloom.session import fresh_path
from corpusloom.streaming import jobs


def test_a_table_in_a_folder_is_streamed(spark, tmp_path):
    sf = str(tmp_path)
    rows = spark.range(6).selectExpr("id AS event_id").repartition(3)
    rows.write.parquet(f"{sf}/events.parquet")
    rows.coalesce(1).write.parquet(f"{sf}/eventsXparquet")  # another table, not to be read
    path = fresh_path(spark, "streamed")
    jobs.write_epochs(v.table_stream(spark, sf, "events"), path, f"{path}-checkpoint", "append").awaitTermination()
    assert sorted(r.event_id for r in spark.read.parquet(path).collect()) == list(range(6))


def test_a_long_prompt_with_a_bad_attachment(spark, tmp_path):
    sf = str(tmp_path)
    docs = spark.createDataFrame([(2, "x" * 100_001), (10, "short"), (8, "x" * 100_001)], "doc_id long, text string")
    docs.coalesce(1).write.parquet(f"{sf}/parts")
    next(tmp_path.glob("parts/*.parquet")).rename(tmp_path / "documents.parquet")
    plan, sql = entry.queries()["validate_payload"], entry.oracle_sql()["validate_payload"]
    assert compare(spark, connect(sf), plan, sql, sf)[2] is None


def test_equal_searches_are_made_once(spark, monkeypatch):
    from corpusloom.operators import agent as ag
    from corpusloom.operators import search as se
    from corpusloom.options import SearchOptions
    from corpusloom.plans.stubs import AGENT, make_embed, make_generate

    texts = {1: "aa", 2: "tea", 3: "aa", 4: "eat", 5: "aa"}  # of "tea" and "eat" the vectors are equal
    messages = spark.createDataFrame([(c, 0, "user", t) for c, t in texts.items()], "conv_id long, turn long, role string, text string")
    chunks = spark.createDataFrame(
        [(f"c{i}", f"src/{n}.ts", n, [float(n.count(x)) for x in "aent"]) for i, n in enumerate(["tea", "eat", "aaa", "net"])],
        "id string, path string, content string, embedding array<double>",
    )
    vectors, scan, asked = [], se.scan_topk, []

    def counted(queries, *rest, **more):
        vectors.append(queries.count())
        return scan(queries, *rest, **more)

    def retrieve(queries, rows, options):
        asked.append(sorted(r.text for r in queries.collect()))
        return se.search_hybrid(queries, rows, options)

    monkeypatch.setattr(se, "scan_topk", counted)
    prompts = messages.select("conv_id", messages.text.alias("prompt"))
    out = ag.batch_agent(messages, prompts, chunks, make_generate, make_embed, "S", AGENT, search=SearchOptions(digits=6), retrieve=retrieve)
    assert {r.conv_id: (r.text, r.retrieved_matches) for r in out.collect()} == {c: (f"about {t}", 4) for c, t in texts.items()}
    assert (asked, vectors) == ([["aa", "eat", "tea"], []], [2, 0])  # the second round has answers only


def test_records_of_two_collections_are_made_once(spark, monkeypatch):
    from corpusloom.plans import registry, store_queries

    read, records = spark.sparkContext.accumulator(0), store_queries.records

    def counted(batches):
        for batch in batches:
            read.add(len(batch))
            yield batch

    def counting(spark, sf):
        rows = records(spark, sf)
        return rows.mapInPandas(counted, rows.schema)

    monkeypatch.setattr(store_queries, "records", counting)
    left = registry.QUERIES["drop_collection"](spark, "/root/testdata/sf0.001").collect()
    assert [r.collection_id for r in left] == ["b"] and read.value == left[0].n > 0


def test_structured_chunks_without_text_or_tree(spark):
    from corpusloom.operators import chunking as ch
    from corpusloom.options import ChunkBudgets

    tree = "units array<struct<start: int, end: int, parent: int, preferred: boolean>>"
    text = "x = 1\n" + "def f():\n" + "    pass\n" * 40 + "def g():\n" + "    pass\n" * 40
    cut = text.index("def g")
    whole = [(0, 6, -1, False), (6, cut, -1, True), (cut, len(text), -1, True), (6, 15, 1, True)]
    docs = spark.createDataFrame([("a", text, whole), ("b", text, None), ("c", text, []), ("d", None, whole), ("e", "  ", whole)], f"path string, content string, {tree}")
    budgets = ChunkBudgets(min=1, max=200)
    got = ch.chunk_structured(docs, budgets=budgets, entities=False).collect()
    spans = {p: [(r.chunk_start, r.chunk_end) for r in sorted(got, key=lambda r: r.chunk_start) if r.path == p] for p in "abcde"}
    assert spans["a"] == [(6, cut), (cut, len(text))]
    assert spans["b"] == spans["c"] and spans["b"][0][0] == 0 and spans["b"][-1][1] == len(text)

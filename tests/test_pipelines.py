import json
import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom.functions.models import embed, generate
from corpusloom.operators import agent as ag
from corpusloom.operators import search as se
from corpusloom.operators import index as ix
from corpusloom.operators import metrics as mt
from corpusloom.options import AgentOptions, IndexOptions, SearchOptions
from corpusloom.plans.stubs import make_embed
from corpusloom.session import fresh_path, shared_dir
from corpusloom.sources import collections as co
from corpusloom.sources import files as fs
from corpusloom.sources import replies as rp
from corpusloom.sources import sessions as ss
from corpusloom.streaming import jobs


# ---- files, sessions, collections ----------------------------------------------


@pytest.fixture
def tree(tmp_path):
    for name, data in {"a.py": b"x = 1", "d/e/b.txt": "é\n".encode(), "d/bad.txt": b"a\xffb", "d/big.txt": b"z" * 3000}.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)
    return str(tmp_path)


def test_scan_corpus(spark, tree):
    rows = {r.path: r for r in fs.scan_corpus(spark, tree, 2).collect()}
    assert set(rows) == {"a.py", "d/e/b.txt", "d/bad.txt"}
    assert rows["d/e/b.txt"].content == "é\n" and rows["d/e/b.txt"].size == 3
    assert rows["d/bad.txt"].content == "a�b"
    assert {r.path: r.size for r in fs.scan_listing(spark, tree).collect()}["d/big.txt"] == 3000


def test_size_limit_reaches_the_reader(spark, tree):
    plan = fs.scan_corpus(spark, tree, 2)._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(length,2048)" in plan


def test_collection_ids_are_escaped(spark):
    path = fresh_path(spark, "ids")
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "id string, n int")
    for name in ("a:b", "x=1%", "007"):
        co.replace_collection(rows, path, name)
        assert co.collection_exists(spark, path, name)
        assert {r.n for r in co.read_collection(spark, path, name).collect()} == {1, 2, 3}
    assert {r[0] for r in co.list_collections(spark, path).collect()} == {"a:b", "x=1%", "007"}
    co.drop_collection(spark, path, "a:b")
    assert not co.collection_exists(spark, path, "a:b")
    page = co.collection_get(co.read_collection(spark, path, "007"), offset=1)
    assert sorted(r.id for r in page.collect()) == ["b", "c"]


def test_attach_files(spark, tree):
    assert sorted(r.name for r in fs.attach_files(spark, tree, 1).collect()) == ["a.py", "b.txt", "bad.txt"]


def test_logs(spark, tmp_path):
    (tmp_path / "x.log").write_text(
        '2024-05-01T10:00:00.000Z [INFO] [rag] Index done | {"n": 3}\n2024-05-01T10:00:01.000Z [ERROR] [chat] broke\nnoise\n'
    )
    rows = fs.read_logs(spark, str(tmp_path)).select("level", "scope", "message", F.try_variant_get("record", "$.n", "int").alias("n"))
    assert sorted(map(tuple, rows.collect())) == [("ERROR", "chat", "broke", None), ("INFO", "rag", "Index done", 3)]


def test_both_session_layouts(spark, tmp_path):
    session = {"id": "s1", "title": "t", "createdAt": 5, "messages": [
        {"role": "user", "content": {"text": "q", "filesMetadata": [{"name": "a", "content": "c"}]}}, {"role": "assistant", "content": "plain"}]}
    (tmp_path / "old.json").write_text(json.dumps([session]))
    (tmp_path / "new.json").write_text(json.dumps({"sessions": [{**session, "id": "s2"}, {"id": "s3", "title": "e", "createdAt": 6, "messages": []}], "uiState": {}}))
    rows = ss.read_session_stores(spark, str(tmp_path)).select("session_id", "turn", "role", "text", F.size("files").alias("n")).collect()
    assert sorted(map(tuple, rows), key=str) == sorted([
        ("s1", 0, "user", "q", 1), ("s1", 1, "assistant", "plain", 0), ("s2", 0, "user", "q", 1),
        ("s2", 1, "assistant", "plain", 0), ("s3", None, None, "", 0)], key=str)


def test_collections(spark):
    path = fresh_path(spark, "t")
    rows = spark.createDataFrame([("a", "p/1"), ("b", "p/2"), ("c", "p/3")], "id string, path string")
    co.replace_collection(rows, path, "one")
    co.replace_collection(rows.where("id < 'c'"), path, "two", previous_id="one")
    assert not co.collection_exists(spark, path, "one") and co.collection_exists(spark, path, "two")
    with pytest.raises(ValueError):
        co.drop_collection(spark, path, "one")
    two = co.read_collection(spark, path, "two")
    wanted = spark.createDataFrame([("p\\2",), ("/p/1",)], "path string")
    assert [r.id for r in co.collection_get(two, wanted, columns=["id"]).collect()] == ["b"]
    assert [r.id for r in co.collection_get(two, limit=1, offset=1).collect()] == ["b"]
    assert co.collection_get(two, wanted.limit(0)).count() == 2


def test_shared_dir_is_the_session_setting():
    from unittest.mock import MagicMock

    session = MagicMock()
    session.conf.get.side_effect = lambda key, default=None: {"spark.checkpoint.dir": "hdfs://x/shared"}.get(key, default)
    session.sparkContext.getCheckpointDir.return_value = None
    assert shared_dir(session) == "hdfs://x/shared"
    session.sparkContext.setCheckpointDir.assert_called_once_with("hdfs://x/shared")
    assert fresh_path(session, "x").startswith("hdfs://x/shared/corpusloom/x-")


def test_index_without_files_writes_nothing(spark):
    empty = spark.createDataFrame([("a.txt", " ", 1)], "path string, content string, size long")
    path = fresh_path(spark, "none")
    assert ix.index_corpus(empty, make_embed, path, "c_1") is None
    assert not co.collection_exists(spark, path, "c_1")


def test_index_replaces_the_previous_collection(spark):
    files = spark.createDataFrame([("a.txt", "one two", 7), ("b/c.py", "x = f(1)", 8)], "path string, content string, size long")
    path = fresh_path(spark, "idx")
    ix.index_corpus(files, make_embed, path, "c_1")
    done = ix.index_corpus(files, make_embed, path, "c_2", "c_1", IndexOptions(max_chunks=None), indexed_at_ms=9).first()
    assert (done.status, done.indexed_files, done.collection_id, done.indexed_at) == ("indexed", 2, "c_2", 9)
    assert not co.collection_exists(spark, path, "c_1")


def test_wrong_number_of_vectors_fails(spark):
    df = spark.createDataFrame([("a",), ("b",)], "t string").coalesce(1)

    def make():
        import numpy as np

        return lambda texts: np.zeros((1, 2))

    with pytest.raises(Exception):
        embed(df, "t", make, spread_out=False).collect()


# ---- replies and streams -------------------------------------------------------


def lines(spark):
    rows = [
        (1, 0, 'data: {"choices":[{"delta":{"content":"Hel"}}]}'), (1, 1, "  "), (1, 2, ": ping"),
        (1, 3, 'data: {"choices":[{"text":"lo"}],"usage":{"completion_tokens":4}}'), (1, 4, "data: {broken"), (1, 5, "data: [DONE]"),
        (1, 6, 'data: {"choices":[{"delta":{"content":"!"}}]}'), (2, 0, 'data:{"choices":[],"usage":{"completion_tokens":0}}'),
        (2, rp.PART_SPAN + 1, 'data:{"choices":[{"text":"sixteen letters!"}]}'),
    ]
    return spark.createDataFrame(rows, "request_id long, seq long, value string")


def test_replies(spark):
    fragments = rp.decode_replies(lines(spark).repartition(3))
    assert fragments.where("is_bad").count() == 1
    out = {(r.request_id, r.part): (r.text, r.chars, r.server_tokens, r.tokens) for r in rp.assemble_replies(fragments).collect()}
    assert out == {(1, 0): ("Hello!", 6, 4, 4), (2, 0): ("", 16, 0, 5), (2, 1): ("sixteen letters!", 16, 0, 5)}


def test_lines_after_the_end_mark(spark):
    kept = rp.until_done(lines(spark), ["request_id"])
    assert kept.where("request_id = 1").count() == 5 and kept.where("request_id = 2").count() == 2


def test_streams_equal_their_batch_twins(spark):
    source = fresh_path(spark, "lines")
    for n in range(3):
        lines(spark).where(F.col("seq") % 3 == n).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(lines(spark).schema).option("maxFilesPerTrigger", 1).parquet(source)
    out = fresh_path(spark, "out")
    jobs.write_epochs(jobs.stream_replies(jobs.stream_decode(stream)), out, out + "-c").awaitTermination()
    streamed = rp.finish_replies(jobs.latest(spark, out, ["request_id", "part"]))
    batch = rp.assemble_replies(rp.decode_replies(lines(spark)))
    assert sorted(map(str, streamed.collect())) == sorted(map(str, batch.select(*streamed.columns).collect()))


def events(spark):
    seconds = [0, 3, 8, 40, 41, 5_000]
    rows = [(1, s, s % 2 == 0, s * 10) for s in seconds] + [(2, 10, False, 5), (2, 5_001, True, 7)]
    return spark.createDataFrame(rows, "user_id long, s long, is_error boolean, duration_ms long").select(
        "user_id", F.timestamp_seconds("s").alias("ts"), "is_error", "duration_ms", F.col("s").alias("seq")
    )


def test_idle_stream_emits_finished_stretches(spark):
    source = fresh_path(spark, "events")
    events(spark).coalesce(1).write.parquet(source)
    stream = spark.readStream.schema(events(spark).schema).parquet(source)
    out = fresh_path(spark, "idle")
    jobs.write_epochs(jobs.stream_idle(stream, "10 seconds"), out, out + "-c", "append").awaitTermination()
    got = {(r.user_id, r.events) for r in spark.read.parquet(out).collect()}
    batch = mt.idle_requests(events(spark), "10 seconds").where("last_ts < timestamp_seconds(4900)")
    assert got == {(r.user_id, r.events) for r in batch.collect()} == {(1, 3), (1, 2), (2, 1)}


def test_finished_replies_stream(spark):
    source = fresh_path(spark, "frag")
    rows = events(spark).select(F.col("user_id").alias("request_id"), "ts", "seq", F.lit("ab").alias("token"), F.lit(0).cast("long").alias("usage"))
    rows.coalesce(1).write.parquet(source)
    stream = spark.readStream.schema(rows.schema).parquet(source)
    out = fresh_path(spark, "finished")
    jobs.write_epochs(jobs.stream_finished_replies(stream), out, out + "-c", "append").awaitTermination()
    assert sorted((r.request_id, r.text) for r in spark.read.parquet(out).collect()) == [(1, "abab"), (1, "ababab"), (2, "ab")]


# ---- agent ---------------------------------------------------------------------


def chunks(spark):
    rows = [(f"c{i}", f"src/f{i}.ts", f"text {'a' * i}", [float(i), 0.0, 0.0, 1.0]) for i in range(8)]
    return spark.createDataFrame(rows, "id string, path string, content string, embedding array<double>")


def scripted():
    """A model that plays every rule of the loop, by conversation."""

    def make():
        def reply(messages):
            said = [m["content"] for m in messages if m["role"] == "assistant" and m["content"] != "hi"]
            script = next(m["content"] for m in messages if m["content"].startswith("play "))[5:].split("|")
            return script[min(len(said), len(script) - 1)], 3, 1

        return reply

    return make


SCRIPTS = {
    1: 'Action: agent_search("aa")|Final Answer: one',
    2: "Final Answer: early|Action: search(b)|Final Answer: late",
    3: "no format|Action: search(X)|Action: search(x)|Final Answer: [your answer]|Final Answer: done",
    4: "Action: search(q)",
    5: "Action: search()",
}


TEXTS = {"search_first": "search first", "fix_format": "fix", "answer_now": "answer", "keep_going": "go on"}


def run_agent(spark, more={}, **options):
    messages = spark.createDataFrame(
        [(c, t, r, x) for c in SCRIPTS for t, r, x in ((0, "user", "hello"), (1, "assistant", "hi"), (2, "user", "q"))],
        "conv_id long, turn long, role string, text string",
    )
    prompts = spark.createDataFrame([(c, f"play {s}") for c, s in SCRIPTS.items()], "conv_id long, prompt string")
    out = ag.batch_agent(messages, prompts, chunks(spark), scripted(), make_embed, "SYS", AgentOptions(**TEXTS | options), search=SearchOptions(digits=6), **more)
    return {r.conv_id: r for r in out.collect()}


def test_agent_rules(spark):
    out = run_agent(spark)
    got = {c: (r.text, r.tool_calls, r.retrieved_matches, r.tokens, len(r.references)) for c, r in out.items()}
    assert got == {
        1: ("one", 1, 5, 6, 5),
        2: ("late", 1, 5, 9, 5),
        3: ("done", 2, 5, 15, 5),  # the refused query counts as a call
        4: ("Action: search(q)", 6, 5, 21, 5),  # forced answer: the whole reply
        5: ("Action: search()", 0, 0, 21, 0),
    }
    assert out[1].references == sorted(out[1].references)


def test_a_refused_request_ends_with_its_error(spark, monkeypatch):
    monkeypatch.setitem(SCRIPTS, 6, "x" * 40_000)
    out = run_agent(spark, {"max_request_tokens": 5000})
    assert {c: r.error for c, r in out.items()} == {c: "context exceeded" if c == 6 else None for c in SCRIPTS}
    assert out[6].text is None and out[1].text == "one"


def test_agent_with_another_retriever(spark):
    out = run_agent(spark, {"retrieve": se.search_exact})
    assert out[1].text == "one" and out[1].tool_calls == 1


def test_agent_round_limit(spark):
    assert run_agent(spark, max_rounds=1)[1].text == "one"


def test_requests_beyond_a_context_are_refused(spark):
    messages = spark.createDataFrame([(1, 0, "user", "x" * 100), (2, 0, "user", "y")], "conv_id long, turn long, role string, text string")
    out = {r.conv_id: (r.text, r.error) for r in generate(messages, lambda: (lambda m: (m[0]["content"], 1, 1)), max_tokens=20).collect()}
    assert out == {1: (None, "context exceeded"), 2: ("y", None)}


def test_attach_files_leaves_long_documents_to_the_operator(spark, tmp_path, monkeypatch):
    from corpusloom.plans import store_queries

    texts = ["short", "a\nb", "x" * 262_143, "x" * 262_144, "x" * 600_000, None]  # a file has one more byte
    spark.createDataFrame([(t,) for t in texts], "text string").write.parquet(str(tmp_path / "documents.parquet"))
    seen, attach = [], store_queries.fs.attach_files

    def spy(spark, root, **options):
        seen.append((sorted(r["length"] for r in spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(root).select("length").collect()), options))
        return attach(spark, root, **options)

    monkeypatch.setattr(store_queries.fs, "attach_files", spy)
    got = [tuple(r) for r in store_queries.attach_files(spark, str(tmp_path)).collect()]
    assert seen == [([4, 6, 262_144, 262_145, 600_001], {})]
    assert got == [(False, 4 + 6 + 262_144)]


def test_attach_files_lists_in_tasks(spark, tmp_path):
    root = tmp_path / "a b%41é"
    names = ["x.txt", "_h.txt", ".h.txt", "_k=1.txt", "y._COPYING_", "_metadata", "_metadata=z", "d/x.txt", "d/empty", "d/e/f/%20 ü.txt", "_h/a", ".h/a",
             "_k=1/in_k", "_metadata_d/in_m", "c._COPYING_/a", "part=1/p.txt", "big", "bad"]
    for name in names:
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes({"d/empty": b"", "big": b"z" * 3000, "bad": b"a\xffb"}.get(name, name.encode()))
    (root / "gone").symlink_to(root / "nothing")
    (root / "link").symlink_to(root / "d")
    assert fs.attach_files(spark, str(root), 2).inputFiles() == []  # the driver holds no listing
    for at, kb in ((str(root), None), (str(root), 2), (f"file://{root}/", None), (str(root / "d" / "e"), None)):
        expected = sorted(map(tuple, fs.scan_corpus(spark, at, kb).collect()))
        assert sorted(map(tuple, fs.read_tree(spark, at, kb).collect())) == expected and expected
    names = sorted(r.path.rpartition("/")[2] for r in fs.scan_corpus(spark, str(root), 2).collect())
    assert sorted(r.name for r in fs.attach_files(spark, str(root), 2).collect()) == names
    for at in (f"{tmp_path}/*/d", str(root / "x.txt")):  # patterns and files go to Spark's reader
        assert fs.attach_files(spark, at).count() == fs.scan_corpus(spark, at, 256).count() > 0
    (tmp_path / "none").mkdir()
    assert fs.attach_files(spark, str(tmp_path / "none")).collect() == []
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        fs.attach_files(spark, str(tmp_path / "absent"))


def test_read_tree_in_small_batches(spark, tmp_path, monkeypatch):
    for i in range(40):
        (tmp_path / f"{i % 3}").mkdir(exist_ok=True)
        (tmp_path / f"{i % 3}" / f"{i}.txt").write_text("x" * (i + 1))
    expected = sorted(map(tuple, fs.scan_corpus(spark, str(tmp_path)).collect()))
    for name in ("READ_BYTES", "READ_FILES", "LISTED_AT_ONCE"):
        monkeypatch.setattr(fs, name, 3)
    batches = [b for b in fs._listed(str(tmp_path), True)([pa.RecordBatch.from_pydict({"path": pa.array([""]), "size": pa.array([None], pa.int64())})])]
    assert [b.num_rows for b in batches] == [3] * 13 + [1]
    read = [b for b in fs._contents(str(tmp_path))(batches)]
    assert max(b.num_rows for b in read) <= 3 and len(read) > 13
    assert sorted((r["path"], r["size"], r["content"].decode()) for b in read for r in b.to_pylist()) == expected


def test_attach_files_query_spreads_documents_over_folders(spark, tmp_path, monkeypatch):
    from corpusloom.plans import store_queries

    spark.range(0, 2_500, 1, 1).selectExpr("concat('t', id) AS text").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    seen, attach = [], store_queries.fs.attach_files

    def spy(spark, root, **options):
        seen.extend(len([f for f in files if f.endswith(".txt")]) for _, _, files in os.walk(root.removeprefix("file:")))
        return attach(spark, root, **options)

    monkeypatch.setattr(store_queries.fs, "attach_files", spy)
    got = [tuple(r) for r in store_queries.attach_files(spark, str(tmp_path)).collect()]
    assert got == [(False, sum(len(f"t{i}") + 1 for i in range(2_500)))]
    assert sum(seen) == 2_500 and max(seen) <= 1_024

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import chunking as ch
from corpusloom.operators import conversation as cv
from corpusloom.operators import filters as fl
from corpusloom.operators import index as ix
from corpusloom.operators import metrics as mt
from corpusloom.operators import search as se
from corpusloom.operators.prefix import with_prefix_sums
from corpusloom.options import ChunkBudgets, IndexOptions, MemoryOptions, SearchOptions


def fold(text, budgets):
    """Greedy packing of lines, one line at a time."""
    tok = lambda s: math.ceil(len(s) / 4)
    out, start, cursor = [], 0, 0
    room = min(budgets.fallback, budgets.max)

    def windows(a, b):
        while a < b:
            out.append((a, min(b, a + 4 * budgets.max)))
            a = out[-1][1]

    while cursor < len(text):
        end = text.find("\n", cursor)
        end = len(text) if end < 0 else end + 1
        if tok(text[start:end]) <= room:
            cursor = end
        elif start == cursor:
            windows(start, end)
            start = cursor = end
        else:
            out.append((start, cursor))
            start = cursor
    if start < len(text):
        windows(start, len(text))
    return out


def merge(spans, budgets):
    tok = lambda a, b: math.ceil((b - a) / 4)
    out = []
    for a, b in spans:
        if out and (tok(*out[-1]) < budgets.min or tok(a, b) < budgets.min) and tok(out[-1][0], b) <= budgets.target:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def texts():
    rng = random.Random(7)
    out = ["", "\n", "a", "x" * 5000, "é\n" * 700, "a\n\n\nb"]
    for _ in range(60):
        out.append("\n".join("wé" * rng.choice([0, 1, 5, 40, 200, 700]) for _ in range(rng.randint(0, 60))))
    return out


@pytest.mark.parametrize("budgets", [ChunkBudgets(), ChunkBudgets(80, 100, 40, 60), ChunkBudgets(40, 64, 10, 32)])
def test_lines_tile_the_text(spark, budgets):
    rows = list(enumerate(texts()))
    docs = spark.createDataFrame(rows, "doc long, content string")
    got, merged = {}, {}
    for r in ch.chunk_lines(docs, budgets).collect():
        got.setdefault(r.doc, []).append((r.chunk_index, r.chunk_start, r.chunk_end, r.text, r.chunk_count))
    for r in ch.merged_lines(docs, budgets).collect():
        merged.setdefault(r.doc, []).append((r.chunk_index, r.chunk_start, r.chunk_end))
    for doc, text in rows:
        parts = sorted(got.get(doc, []))
        assert [(p[1], p[2]) for p in parts] == fold(text, budgets)
        assert "".join(p[3] for p in parts) == text
        assert all(p[4] == len(parts) and len(p[3]) <= 4 * budgets.max for p in parts)
        assert [p[1:] for p in sorted(merged.get(doc, []))] == merge(fold(text, budgets), budgets)


def test_encoder_chunks_match_the_default_counter(spark):
    docs = spark.createDataFrame(list(enumerate(texts())), "doc long, content string")
    budgets = ChunkBudgets(80, 100, 40, 60)
    cols = ("doc", "chunk_index", "chunk_start", "chunk_end")
    mine = ch.chunk_with_encoder(docs, lambda: (lambda t: list(range(1, len(t) + 1))), ChunkBudgets(320, 400, 160, 240)).select(*cols)
    assert sorted(mine.collect()) == sorted(ch.chunk_lines(docs, budgets).select(*cols).collect())


def test_encoder_chunks_hold_whole_tokens(spark):
    import re

    docs = spark.createDataFrame(list(enumerate(texts())), "doc long, content string")
    budgets = ChunkBudgets(32, 64, 8, 32)
    ends = lambda t: [m.end() for m in re.finditer(r"\S+\s*|^\s+", t)]
    rows = ch.chunk_with_encoder(docs, lambda: ends, budgets).collect()
    for doc, text in enumerate(texts()):
        parts = sorted((r.chunk_start, r.chunk_end, r.text) for r in rows if r.doc == doc)
        assert "".join(p[2] for p in parts) == text
        assert all(sum(p[0] < e <= p[1] for e in ends(text)) <= 64 for p in parts)


def test_structured_units(spark):
    text = "/* c */" + "import a\n" + "class A {" + "x" * 600 + "}" + "tail"
    head, cls = text.index("import"), text.index("class")
    end = text.index("tail")
    units = [
        (0, head, -1, False), (head, cls, -1, True), (cls, end, -1, True), (cls + 9, cls + 9 + 200, 2, True),
        (cls + 209, end - 1, 2, True), (end, len(text), -1, False),
    ]
    docs = spark.createDataFrame(
        [(1, text, units), (2, "plain", [])],
        "doc long, content string, units array<struct<start:int,end:int,parent:int,preferred:boolean>>",
    )
    got = {}
    for r in ch.chunk_structured(docs, budgets=ChunkBudgets(64, 64, 1, 32)).orderBy("doc", "chunk_index").collect():
        got.setdefault(r.doc, []).append((r.chunk_start, r.chunk_end))
    body = cls + 209
    assert got[1] == [(head, cls), (cls + 9, body)] + [(body, body + 256), (body + 256, end - 1)]
    assert got[2] == [(0, 5)]


def test_declaration_units_cover_the_text(spark):
    text = "note\nimport a\nclass B {\n}\ndef f():\n  pass\n"
    docs = spark.createDataFrame([(1, text)], "doc long, content string")
    units = docs.select(ch.declaration_spans(F.col("content")).alias("u")).first().u
    assert "".join(text[u.start:u.end] for u in units) == text
    assert [u.preferred for u in units] == [False, True, True, True]


# ---- search ----------------------------------------------------------------


@pytest.fixture(scope="module")
def space(spark):
    rng = np.random.default_rng(3)
    words = ["alpha", "beta", "gamma", "lph", "src", "x1", "delta/e"]
    chunks = []
    for i in range(400):
        vec = rng.normal(size=6).round(2).tolist() if i % 50 else []
        body = " ".join(rng.choice(words, 5)) if i % 77 else None
        chunks.append((f"id{i:04d}", f"src/f{i % 9}.ts", f"f{i % 9}.ts", "src", body, vec))
    queries = [(q, " ".join(rng.choice(words, 4)) if q % 10 else "  ", rng.normal(size=6).round(2).tolist()) for q in range(30)]
    c = spark.createDataFrame(chunks, "id string, path string, file_name string, folder string, content string, embedding array<float>")
    q = spark.createDataFrame(queries, "query_id long, text string, embedding array<double>")
    return chunks, queries, c, q


def tokens(text):
    import re

    return [t for t in re.split(r"[^a-z0-9_./-]+", text.lower()) if len(t) >= 2]


def ratio(text, hay):
    t = tokens(text)
    return sum(w in hay for w in t) / len(t) if t else 0.0


def brute(chunks, queries, kind, k):
    out = set()
    for q, text, vec in queries:
        if not text.strip():
            continue
        scored = []
        for cid, path, name, folder, body, emb in chunks:
            meta = f"{path} {name} {folder}".lower()
            a, b = np.array(np.array(emb, dtype=np.float32), dtype=float), np.array(vec)
            if kind == "words":
                if body is not None:
                    score = round(ratio(text, meta) * 0.7 + ratio(text, body.lower()) * 0.3, 6)
                    if score > 0:
                        scored.append((-score, cid))
            elif body is not None and len(a):
                if kind == "exact":
                    cos = a @ b / (np.linalg.norm(a) * np.linalg.norm(b))
                    if round(cos, 9) >= 0.2:
                        scored.append((-round(0.75 * cos + 0.25 * ratio(text, meta), 6), cid))
                else:
                    scored.append((round(((a - b) ** 2).sum(), 6), cid))
        out |= {(q, cid, r + 1) for r, (_, cid) in enumerate(sorted(scored)[:k])}
    return out


def hits(df, rank="rank"):
    return {(r.query_id, r.id, r[rank]) for r in df.select("query_id", "id", rank).collect()}


@pytest.mark.parametrize("scan", [{}, {"max_block_rows": 7}, {"max_block_rows": 100}])
def test_searches_against_brute_force(space, scan):
    chunks, queries, c, q = space
    options = SearchOptions(digits=6, max_results=9, candidate_pool=20)
    assert hits(se.search_exact(q, c, options, **scan)) == brute(chunks, queries, "exact", 9)
    assert hits(se.search_lexical(q, c, options, **scan)) == brute(chunks, queries, "words", 9)
    assert hits(se.candidate_pool(q, c, options, **scan), "pool_rank") == brute(chunks, queries, "near", 20)


def test_topk_is_a_prefix(space):
    _, _, c, q = space
    few = hits(se.search_hybrid(q, c, SearchOptions(digits=6, max_results=3)))
    assert few <= hits(se.search_hybrid(q, c, SearchOptions(digits=6, max_results=8)))


@pytest.mark.parametrize("most,scan", [(200_000, {}), (0, {}), (200_000, {"max_block_rows": 7})])
def test_path_filter_narrows_only_its_queries(space, monkeypatch, most, scan):
    _, _, c, q = space
    monkeypatch.setattr(se, "MAX_FILTER_ROWS", most)
    paths = q.sparkSession.createDataFrame([(1, "src\\f3.ts"), (1, "../x"), (2, "/abs")], "query_id long, path string")
    options = SearchOptions(digits=6)
    for search in (se.search_hybrid, se.search_lexical):
        wide, narrow = search(q, c, options), search(q, c, options, paths, **scan)
        assert {r.path for r in narrow.where("query_id = 1").collect()} == {"src/f3.ts"}
        assert hits(narrow.where("query_id <> 1")) == hits(wide.where("query_id <> 1"))


def test_metrics(space):
    _, _, c, q = space
    for metric in ("cosine", "ip"):
        pool = se.candidate_pool(q, c, SearchOptions(metric=metric, candidate_pool=5, max_results=5))
        assert pool.count() == 27 * 5


def test_every_query_is_embedded_once(spark, space):
    _, _, c, _ = space
    from pyspark.sql import functions as F

    calls = spark.sparkContext.accumulator(0)

    @F.udf("array<double>")
    def vector(text):
        calls.add(1)
        return [1.0] * 6

    queries = spark.createDataFrame([(i, f"q{i}") for i in range(10)], "query_id long, text string").repartition(2)
    se.agent_search(queries.withColumn("embedding", vector("text")), c).collect()
    assert calls.value == 10


def test_many_long_queries_stay_small():
    from corpusloom.operators.topk import TokenIndex

    index = TokenIndex([[f"t{q}x{i}" for i in range(40)] for q in range(4096)])
    held = sum(x.nbytes for x in vars(index).values() if hasattr(x, "nbytes"))
    assert held < 8 << 20
    out = index.ratios(["t5x1 t5x2 t7x0", "nothing"])
    assert out[0, 5] == 2 / 40 and out[0, 7] == 1 / 40 and np.count_nonzero(out) == 2


def test_no_queries_reads_no_corpus(space):
    _, _, c, q = space
    assert se.search_exact(q.where("query_id < 0"), c).count() == 0


def test_fetch_limit(space):
    _, _, c, q = space
    seen = se.search_lexical(q, c, SearchOptions(), fetch_limit=10)
    assert {r.id for r in seen.collect()} <= {f"id{i:04d}" for i in range(11)}
    paths = q.sparkSession.createDataFrame([(1, "src/f8.ts")], "query_id long, path string")
    narrow = se.search_lexical(q, c, SearchOptions(), paths, fetch_limit=2).where("query_id = 1")
    assert {r.id for r in narrow.collect()} == {"id0008", "id0017"}


def test_agent_search_reports(space):
    _, _, c, q = space
    out = {r.query_id: r for r in se.agent_search(q, c).collect()}
    assert out[0].matches == 0 and out[0].observation.endswith("No indexed code matched the query.")
    assert out[1].matches == 5 and "Result 5 | Source: src/" in out[1].observation


def test_file_names(spark):
    files = spark.createDataFrame([(f"d{i % 3}/F{i:02d}.ts", f"F{i:02d}.ts", f"d{i % 3}") for i in range(40)],
                                  "path string, file_name string, folder string")
    needles = spark.createDataFrame([("f", " f0"), ("d", "D1"), ("all", ""), ("no", "zz")], "query_id string, text string")
    got = {}
    for r in se.file_name_search(needles, files).orderBy("rank").collect():
        got.setdefault(r.query_id, []).append(r.path)
    names = sorted(r.path for r in files.collect())
    assert got["f"] == [n for n in names if "F0" in n][:10]
    assert got["d"] == [n for n in names if n.startswith("d1")][:10]
    assert got["all"] == names[:10] and "no" not in got


# ---- conversations -----------------------------------------------------------


def prune(messages, memory):
    """The sequential rule, message by message."""
    role = lambda r: {"assistant": "ai", "system": "system"}.get(r, "human")
    tok = lambda m: math.ceil(len(f"{role(m[1])}: {m[2]}") / 4)
    if sum(map(tok, messages)) <= memory.safety_threshold:
        return [m[:1] + m[2:] for m in messages]
    n, target = len(messages), math.floor(memory.safety_threshold * 0.6)
    kept = set(range(max(0, n - memory.keep_recent), n))
    if memory.keep_system and messages[0][1] == "system":
        kept.add(0)
    out = [m for i, m in enumerate(messages) if i in kept]
    for i in range(n - memory.keep_recent - 1, -1, -1):
        if i in kept:
            continue
        m = messages[i]
        if m[2].startswith(("Observation:", "Tool:")):
            short = {"human": f"Observation: {memory.marker}", "ai": memory.marker}.get(role(m[1]), m[2])
            m = (m[0], m[1], short)
            if sum(map(tok, [m, *out])) <= target:
                out.insert(0, m)
        elif sum(map(tok, [m, *out])) <= target:
            out.insert(0, m)
        else:
            break
        if sum(map(tok, out)) <= target:
            break
    return [m[:1] + m[2:] for m in out]


@pytest.mark.parametrize("recent", [0, 1, 2, 4])
def test_pruning_follows_the_sequential_rule(spark, recent):
    rng = random.Random(recent)
    rows, expected = [], {}
    memory = MemoryOptions(safety_threshold=100, keep_recent=recent, marker="[cut]")
    for conv in range(150):
        messages = []
        for turn in range(rng.randint(1, 7)):
            role = "system" if turn == 0 and rng.random() < 0.5 else rng.choice(["user", "assistant", "system"])
            text = rng.choice(["", "Observation: ", "Tool: "]) + "w" * rng.choice([0, 20, 90, 200, 400])
            messages.append((turn, role, text))
        rows += [(conv, *m) for m in messages]
        expected[conv] = prune(messages, memory)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {}
    for r in cv.prune_context(df, memory).orderBy("conv_id", F.desc("restored"), "turn").collect():
        got.setdefault(r.conv_id, []).append((r.turn, r.text))
    assert got == {k: v for k, v in expected.items() if v}
    for r in cv.prune_summary(df, memory).collect():
        assert r.messages_before - r.messages_removed == len(expected[r.conv_id])


def test_history_keeps_the_latest_attachment(spark):
    files = "array<struct<name:string,content:string,is_automatic:boolean,is_repository:boolean>>"
    rows = [
        (1, 0, "user", "first", [("app.ts:1-3", "v1", False, False), ("utils.ts", "u", False, False)]),
        (1, 1, "assistant", "ok", None),
        (1, 2, "user", "second", [("app.ts", "v2 <b>", False, False), ("Repository", "r", False, True)]),
        (1, 3, "assistant", "ok2", None),
        (1, 4, "user", "third", None),
    ]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, text string, files {files}")
    prompts = spark.createDataFrame([(1, "PROMPT")], "conv_id long, prompt string")
    out = {r.turn: (r.role, r.text) for r in cv.build_messages(df, prompts, "SYS").collect()}
    assert out[-1] == ("system", "SYS") and out[4] == ("user", "PROMPT") and out[1] == ("assistant", "ok")
    assert "u\n" in out[0][1] and "v1" not in out[0][1] and out[0][1].endswith("\n\nUser instruction:\nfirst")
    assert "v2 &lt;b&gt;" in out[2][1] and "Repository" not in out[2][1]


def test_last_attachment_wins_in_first_position(spark):
    rows = [(1, 0, "a.ts", "old", 0, None, None), (1, 0, "b.ts", "b", 1, True, None), (1, 0, "a.ts", "new", 2, None, True)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, name string, content string, pos int, is_automatic boolean, is_repository boolean")
    out = [tuple(r) for r in cv.dedupe_attachments(df).orderBy("pos").select("name", "content", "is_automatic", "is_repository").collect()]
    assert out == [("a.ts", "new", False, True), ("b.ts", "b", True, False)]


# ---- running sums, sessions, caps, index ---------------------------------------


def test_prefix_sums(spark):
    rows = [(i, (i * 7) % 11) for i in range(1000)]
    df = spark.createDataFrame(rows, "k long, v long").repartition(5)
    out = {r.k: r.s for r in with_prefix_sums(df, ["k"], {"s": F.col("v")}, 7).collect()}
    total, expected = 0, {}
    for k, v in rows:
        total += v
        expected[k] = total
    assert out == expected


def test_idle_gap_is_exact_and_crosses_days(spark):
    seconds = [0, 9, 19, 29, 86_395, 86_401, 86_411, 90_000]  # a gap of just the limit does not end a stretch
    df = spark.createDataFrame([(1, s) for s in seconds], "user_id long, s long").select(
        "user_id", F.timestamp_seconds("s").alias("ts")
    )
    out = mt.idle_requests(df, "10 seconds").select(F.unix_seconds("first_ts"), F.unix_seconds("last_ts"), "events")
    assert sorted(map(tuple, out.collect())) == [
        (0, 29, 4), (86_395, 86_411, 3), (90_000, 90_000, 1),
    ]


def test_cap_keeps_the_crossing_file_whole(spark):
    df = spark.createDataFrame([("a", 2), ("b", 0), ("c", 3), ("d", 1)], "path string, chunk_count long")
    assert [r.path for r in fl.running_cap(df, 3).orderBy("path").collect()] == ["a", "c"]
    assert [r.path for r in fl.running_cap(df, 2_000_000).orderBy("path").collect()] == ["a", "c", "d"]


def test_collect_chunks(spark):
    java = "class A {\n  int go(int x) {\n    return 1;\n  }\n}\n"
    files = [("pom.xml", "<p/>"), ("src/A.java", java), ("src/b.ts", "const total = 1"), ("out/c.ts", "x"), ("e.txt", " \n"),
             ("z/d.bin", "x"), ("big.txt", "y" * 2000)]
    df = spark.createDataFrame([(p, c, len(c)) for p, c in files], "path string, content string, size long")
    rows = {r.path: r for r in ix.collect_chunks(df, IndexOptions(max_file_kb=1)).collect()}
    assert set(rows) == {"pom.xml", "src/A.java", "src/b.ts"}
    a = rows["src/A.java"]
    assert (a.language, a.class_name, a.method_name, a.project_type, a.id) == ("java", "A", "go", "java", "src/A.java::chunk-0")
    assert rows["src/b.ts"].language == "java-ecosystem" and rows["src/b.ts"].keyword_entities == "total"
    capped = ix.collect_chunks(df, IndexOptions(max_file_kb=1, max_chunks=1)).collect()
    assert [r.path for r in capped] == ["pom.xml"]


def test_missing_vector_is_an_error(spark):
    chunks = spark.createDataFrame([("a",), ("b",)], "id string")
    vectors = spark.createDataFrame([("a", [1.0])], "id string, embedding array<double>")
    with pytest.raises(ValueError):
        ix.join_embeddings(chunks, vectors)


def test_whole_texts_are_judged_binary_or_not(spark):
    late, early = "a" * 5000 + "\x00", "\x01" * 400 + "a" * 9000
    df = spark.createDataFrame([("late.txt", 5001, late), ("early.txt", 9400, early)], "path string, size long, content string")
    names = lambda rows: {r.path for r in rows.collect()}
    looked = IndexOptions(binary_sample=4096)
    assert names(fl.filter_binary(df)) == names(fl.keep_files(df)) == names(ix.collect_chunks(df)) == {"early.txt"}
    assert names(fl.filter_binary(df, 4096)) == names(fl.keep_files(df, looked)) == {"late.txt"}
    assert {r.path: r.disposition for r in fl.scan_disposition(df).collect()} == {"late.txt": "binary", "early.txt": "kept"}


def test_ranges_follow_the_rows_and_blocks_add_up(spark, monkeypatch):
    from corpusloom.operators import prefix

    monkeypatch.setattr(prefix, "RANGE_ROWS", 50)
    monkeypatch.setattr(prefix, "BLOCK_RANGES", 4)
    for n in (800, 3200):
        df = spark.range(n).select(F.col("id").alias("k"), (F.col("id") % 7).alias("v"))
        sizes = [r["count"] for r in prefix.in_ranges(df, ["k"]).groupBy("_range").count().collect()]
        assert sum(sizes) == n and max(sizes) <= 3 * 50
        got = {r.k: r.s for r in prefix.with_prefix_sums(df, ["k"], {"s": F.col("v")}).collect()}
        total = 0
        for k in range(n):
            total += k % 7
            assert got[k] == total
    assert prefix.with_prefix_sums(spark.range(0), ["id"], {"s": F.col("id")}).count() == 0


def test_scan_statistics_come_from_the_write(spark, monkeypatch):
    from corpusloom.operators import filters as fl
    from corpusloom.operators import index as ix
    from corpusloom.options import IndexOptions
    from corpusloom.plans.stubs import make_embed
    from corpusloom.session import fresh_path

    rows = [("src/a.ts", 12, "let a = 1\n"), ("src/sub/b.ts", 5, "  \n"), ("node_modules/x.js", 3, "x"), ("c.ts", 9_000_000, "big"), ("d.ts", 4, None),
            ("e.bin", 4, "\x00\x00ab")] + [(f"m/f{i}.py", 30, f"def f{i}(): pass\n" * 3) for i in range(40)]
    files = spark.createDataFrame(rows, "path string, size long, content string")
    options = IndexOptions()
    want = fl.scan_stats(fl.scan_disposition(files, options)).first().asDict()
    counted = []
    monkeypatch.setattr(fl, "scan_stats", lambda *a: counted.append(a))
    _, stats = ix.index_with_stats(files, make_embed, fresh_path(spark, "observed"), "c_1", options=options)
    got = stats.first().asDict()
    assert got.pop("indexed_chunks") >= 41
    assert got == want and not counted  # no second look at the texts
    monkeypatch.undo()
    # counters that do not fit what has arrived are not trusted
    scan = fl.ObservedScan(files, options)
    scan.kept.count()
    assert scan.stats(7).first().asDict() == want
    _, stats = ix.index_with_stats(files.where("false"), make_embed, fresh_path(spark, "observed"), "c_2", options=options)
    assert stats.first().considered_files == 0 and stats.first().indexed_chunks == 0


def test_no_requests_no_replies(spark):
    from corpusloom.operators.agent import batch_reply
    from corpusloom.plans import agent_queries as aq
    from corpusloom.plans.stubs import AGENT, make_embed, make_generate
    from corpusloom.schemas import ATTACHMENTS

    messages = spark.createDataFrame([(1, 0, "user", "hello")], "conv_id long, turn int, role string, text string")
    requests = spark.createDataFrame([], "conv_id long, prompt string, rag_enabled boolean").withColumn("files", F.lit(None).cast(ATTACHMENTS))
    out = batch_reply(messages, requests, aq.TEMPLATES, None, make_generate, make_embed, AGENT)
    assert out.count() == 0
    assert {"conv_id", "flow", "text", "tool_calls", "retrieved_matches", "references", "error"} <= set(out.columns)

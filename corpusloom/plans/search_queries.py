"""Queries over the three search operators and their scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import scoring as sc
from corpusloom.operators import filters as fl
from corpusloom.operators import metrics as mt
from corpusloom.operators import postings as ps
from corpusloom.operators import search as se
from corpusloom.options import SearchOptions
from corpusloom.plans import oracle as o
from corpusloom.plans import views as v
from corpusloom.plans.registry import query
from corpusloom.session import fresh_path, spread

OPTIONS = SearchOptions(digits=6)
LONG = "long"
SEARCHABLE = "lower(concat_ws(' ', path, file_name, folder, extension, language))"


def shown(hits, *scores):
    return hits.select("query_id", F.col("rank").cast(LONG).alias("rank"), "path", F.md5("content").alias("content_md5"), *scores)


@query("tokenize", sql=f"SELECT doc_id, len(t) AS n, md5(array_to_string(t, ' ')) AS tokens_md5 FROM (SELECT doc_id, {o.tokens('text')} AS t FROM documents)")
def tokenize(spark, sf):
    docs = spread(v.table(spark, sf, "documents").select("doc_id", "text"))
    t = docs.select("doc_id", sc.tokenize(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast(LONG).alias("n"), F.md5(F.array_join("t", " ")).alias("tokens_md5"))


@query(
    "lexical_path_score",
    sql=f"SELECT doc_id, round({o.ratio('t', 's')}, 6) AS score FROM (SELECT doc_id, {o.tokens('content')} AS t, {SEARCHABLE} AS s FROM corpus_chunks)",
)
def lexical_path_score(spark, sf):
    chunks = spread(v.corpus_chunks(spark, sf))
    score = sc.lexical_path_score(sc.tokenize(F.col("content")), se.searchable_text(chunks))
    return chunks.select("doc_id", F.round(score, 6).alias("score"))


CONTENT_SCORE = f"SELECT doc_id, round({o.ratio('t', 's')}, 6) AS score FROM (SELECT doc_id, {o.tokens('path')} AS t, lower(content) AS s FROM corpus)"


@query("lexical_content_score", sql=CONTENT_SCORE)
def lexical_content_score(spark, sf):
    score = sc.lexical_content_score(sc.tokenize(F.col("path")), F.col("content"))
    return v.corpus(spark, sf).select("doc_id", F.round(score, 6).alias("score"))


@query("positive_score", sql=f"SELECT * FROM ({CONTENT_SCORE.replace('path', 'lang')}) WHERE score > 0".replace("FROM corpus", "FROM (SELECT doc_id, lang, text AS content FROM documents)"))
def positive_score(spark, sf):
    score = sc.lexical_content_score(sc.tokenize(F.col("lang")), F.col("text"))
    return v.table(spark, sf, "documents").select("doc_id", F.round(score, 6).alias("score")).where("score > 0")


@query("cosine", sql="SELECT vec_id, round(list_cosine_similarity(a, b), 6) AS cosine FROM neighbours")
def cosine(spark, sf):
    return v.neighbours(spark, sf).select("vec_id", F.round(sc.cosine(F.col("a"), F.col("b")), 6).alias("cosine"))


@query("min_cosine", sql="SELECT * FROM (SELECT vec_id, round(list_cosine_similarity(a, b), 6) AS cosine FROM neighbours) WHERE cosine >= 0.1")
def min_cosine(spark, sf):
    return cosine(spark, sf).where("cosine >= 0.1")


@query("vector_score", sql="SELECT vec_id, round(1 / (1 + list_distance(a, b) ** 2), 6) AS score FROM neighbours")
def vector_score(spark, sf):
    score = sc.vector_score(sc.distance(F.col("a"), F.col("b")))
    return v.neighbours(spark, sf).select("vec_id", F.round(score, 6).alias("score"))


@query("combined_score", sql="SELECT vec_id, round(0.75 * list_cosine_similarity(a, b) + 0.25 / (1 + list_distance(a, b) ** 2), 6) AS score FROM neighbours")
def combined_score(spark, sf):
    a, b = F.col("a"), F.col("b")
    score = sc.combined_score(sc.cosine(a, b), sc.vector_score(sc.distance(a, b)), 0.75, 0.25)
    return v.neighbours(spark, sf).select("vec_id", F.round(score, 6).alias("score"))


@query("valid_record", sql="SELECT id FROM chunks_vec WHERE content <> '' AND label % 2 = 0 AND len(embedding) > 0")
def valid_record(spark, sf):
    """Records of odd labels lose their vector, empty texts become null."""
    rows = v.chunks_vec(spark, sf).select(
        "id",
        F.nullif(F.col("content"), F.lit("")).alias("content"),
        F.when(F.col("label") % 2 == 0, F.col("embedding")).otherwise(F.array().cast("array<float>")).alias("embedding"),
    )
    return fl.valid_records(rows).select("id")


PAIRS = f"""SELECT query_id, q.text, c.id, c.path, c.content, list_cosine_similarity(q.embedding, c.embedding) AS cosine,
    list_distance(q.embedding, c.embedding) ** 2 AS d, {SEARCHABLE} AS s, {o.tokens('q.text')} AS t FROM asked q CROSS JOIN chunks_vec c"""


def exact_sql(k: int) -> str:
    return f"""SELECT query_id, rank, path, md5(content) AS content_md5, round(cosine, 6) AS cosine, round(lexical, 6) AS lexical, combined FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY combined DESC, id) AS rank FROM (
          SELECT *, round(0.75 * cosine + 0.25 * lexical, 6) AS combined FROM (
            SELECT * EXCLUDE (cosine), round(cosine, 9) AS cosine, {o.ratio('t', 's')} AS lexical
            FROM ({PAIRS})) WHERE cosine >= 0.2)) WHERE rank <= {k}"""


@query("search_exact", sql=exact_sql(12))
def search_exact(spark, sf):
    return shown(se.search_exact(v.queries(spark, sf), v.chunks_vec(spark, sf), OPTIONS), "cosine", "lexical", "combined")


@query("exact_topk", sql=exact_sql(5))
def exact_topk(spark, sf):
    five = SearchOptions(digits=6, max_results=5)
    return shown(se.search_exact(v.queries(spark, sf), v.chunks_vec(spark, sf), five), "cosine", "lexical", "combined")


def pool_sql(allowed: str = "") -> str:
    return f"""SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS pool_rank FROM (
        SELECT *, round(d, 6) AS distance FROM ({PAIRS}) {allowed})"""


ALLOWED = """x WHERE EXISTS (SELECT 1 FROM query_paths p WHERE p.query_id = x.query_id AND p.path = x.path)
    OR NOT EXISTS (SELECT 1 FROM query_paths p WHERE p.query_id = x.query_id)"""


def hybrid_sql(k: int, allowed: str = "", columns: str = "") -> str:
    return f"""SELECT {columns or "query_id, rank, path, md5(content) AS content_md5, distance, vector, lexical, combined"} FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY combined DESC, distance, id) AS rank FROM (
          SELECT *, round(vector0 * 0.7 + lexical0 * 0.3, 6) AS combined, round(vector0, 6) AS vector, round(lexical0, 6) AS lexical FROM (
            SELECT *, 1 / (1 + greatest(distance, 0)) AS vector0, {o.ratio('t', 's')} AS lexical0
            FROM ({pool_sql(allowed)}) WHERE pool_rank <= 50))) WHERE rank <= {k}"""


@query("candidate_pool", sql=f"SELECT query_id, id, pool_rank, distance FROM ({pool_sql()}) WHERE pool_rank <= 50")
def candidate_pool(spark, sf):
    pool = se.candidate_pool(v.queries(spark, sf), v.chunks_vec(spark, sf), OPTIONS)
    return pool.select("query_id", "id", F.col("pool_rank").cast(LONG).alias("pool_rank"), "distance")


@query("search_hybrid", "rerank_topk", sql=hybrid_sql(12))
def search_hybrid(spark, sf):
    hits = se.search_hybrid(v.queries(spark, sf), v.chunks_vec(spark, sf), OPTIONS)
    return shown(hits, "distance", "vector", "lexical", "combined")


@query("search_hybrid_filtered", sql=hybrid_sql(12, ALLOWED))
def search_hybrid_filtered(spark, sf):
    hits = se.search_hybrid(v.queries(spark, sf), v.chunks_vec(spark, sf), OPTIONS, v.query_paths(spark, sf))
    return shown(hits, "distance", "vector", "lexical", "combined")


@query("agent_topk", sql=hybrid_sql(5))
def agent_topk(spark, sf):
    five = SearchOptions(digits=6, max_results=5)
    hits = se.search_hybrid(v.queries(spark, sf), v.chunks_vec(spark, sf), five)
    return shown(hits, "distance", "vector", "lexical", "combined")


@query("top_summary", sql=hybrid_sql(5, columns="query_id, rank, path, combined, vector, lexical, distance"))
def top_summary(spark, sf):
    hits = se.search_hybrid(v.queries(spark, sf), v.chunks_vec(spark, sf), OPTIONS)
    return se.top_summary(hits).select(
        "query_id", F.col("rank").cast(LONG).alias("rank"), "path", "combined", "vector", "lexical", "distance"
    )


@query(
    "rank_hits",
    sql="""SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY combined DESC, distance, id) AS rank
        FROM (SELECT user_id AS query_id, event_id AS id, round(value, 0) AS combined, length(props) AS distance FROM events)
        QUALIFY rank <= 12""",
)
def rank_hits(spark, sf):
    """Twelve best per user of scored events; ties are many."""
    scored = v.table(spark, sf, "events").select(
        F.col("user_id").alias("query_id"), F.col("event_id").alias("id"), F.round("value", 0).alias("combined"),
        F.length("props").alias("distance"),
    )
    return se.rank_hits(scored, 12).select("query_id", "id", F.col("rank").cast(LONG).alias("rank"))


def lexical_sql(k: int, allowed: str = "") -> str:
    return f"""SELECT query_id, rank, path, md5(content) AS content_md5, round(m, 6) AS metadata_score, round(c, 6) AS content_score, combined FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY combined DESC, id) AS rank FROM (
          SELECT *, round(m * 0.7 + c * 0.3, 6) AS combined FROM (
            SELECT *, {o.ratio('t', 's')} AS m, {o.ratio('t', 'low')} AS c FROM (
              SELECT query_id, {o.tokens('text')} AS t, id, path, content, lower(content) AS low, {SEARCHABLE} AS s
              FROM (SELECT item_id AS query_id, text FROM benchmark) CROSS JOIN corpus_chunks) {allowed})) WHERE combined > 0) WHERE rank <= {k}"""


def items(spark, sf):
    return v.table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")


@query("search_lexical", sql=lexical_sql(12))
def search_lexical(spark, sf):
    hits = se.search_lexical(items(spark, sf), v.corpus_chunks(spark, sf), OPTIONS)
    return shown(hits, "metadata_score", "content_score", "combined")


@query("search_postings", sql=lexical_sql(12))
def search_postings(spark, sf):
    """The same hits through postings that are made of the corpus first."""
    chunks, path = v.corpus_chunks(spark, sf), fresh_path(spark, "postings")
    ps.write_postings(chunks, path)
    hits = ps.search_postings(items(spark, sf), chunks, ps.read_postings(spark, path), OPTIONS)
    return shown(hits, "metadata_score", "content_score", "combined")


@query("lexical_topk", sql=lexical_sql(5))
def lexical_topk(spark, sf):
    hits = se.search_lexical(items(spark, sf), v.corpus_chunks(spark, sf), SearchOptions(digits=6, max_results=5))
    return shown(hits, "metadata_score", "content_score", "combined")


@query("search_lexical_filtered", sql=lexical_sql(12, ALLOWED))
def search_lexical_filtered(spark, sf):
    hits = se.search_lexical(items(spark, sf), v.corpus_chunks(spark, sf), OPTIONS, v.query_paths(spark, sf))
    return shown(hits, "metadata_score", "content_score", "combined")


@query(
    "semi_path_filter",
    sql="""SELECT label AS query_id, path FROM chunks_vec c SEMI JOIN (SELECT label, path FROM chunks_vec JOIN labels USING (doc_id)
        WHERE quality = 1) p ON p.label = c.label AND p.path = c.path""".replace("SELECT label AS", "SELECT CAST(c.label AS BIGINT) AS"),
)
def semi_path_filter(spark, sf):
    pairs = v.chunks_vec(spark, sf).select(F.col("label").cast(LONG).alias("query_id"), "path", "doc_id")
    good = v.table(spark, sf, "labels").where("quality = 1").select("doc_id")
    return se.semi_path_filter(pairs.drop("doc_id"), pairs.join(good, "doc_id").drop("doc_id"))


@query(
    "file_name_search",
    sql="""SELECT query_id, rank, path FROM (SELECT query_id, path, row_number() OVER (PARTITION BY query_id ORDER BY path) AS rank
        FROM (SELECT DISTINCT lang AS query_id, CASE WHEN lang = 'de' THEN '' ELSE lang END AS t FROM documents
              UNION ALL SELECT DISTINCT source, source FROM documents) CROSS JOIN named
        WHERE contains(lower(file_name), t) OR contains(lower(folder), t)) WHERE rank <= 10""",
)
def file_name_search(spark, sf):
    docs = v.table(spark, sf, "documents")
    by_lang = docs.select("lang").distinct().select(
        F.col("lang").alias("query_id"),
        F.when(F.col("lang") == "de", F.lit("  ")).otherwise(F.concat(F.lit(" "), F.upper("lang"))).alias("text"),
    )
    by_source = docs.select("source").distinct().select(F.col("source").alias("query_id"), F.col("source").alias("text"))
    found = se.file_name_search(by_lang.unionByName(by_source), v.named(spark, sf))
    return found.select("query_id", F.col("rank").cast(LONG).alias("rank"), "path")


# ---- collections read as tables ------------------------------------------------


@query("unique_files", sql="SELECT count(DISTINCT path) AS unique_files FROM line_chunks")
def unique_files(spark, sf):
    from corpusloom.operators.chunking import chunk_lines

    return mt.unique_files(chunk_lines(v.corpus(spark, sf).select("path", "content"), entities=False))


@query("chunks_per_file", sql="SELECT path, chunk_start, count(*) OVER (PARTITION BY path) AS chunks_in_file FROM line_chunks")
def chunks_per_file(spark, sf):
    from corpusloom.operators.chunking import chunk_lines

    chunks = chunk_lines(v.corpus(spark, sf).select("path", "content"), entities=False)
    return mt.chunks_per_file(chunks.select("path", F.col("chunk_start").cast(LONG).alias("chunk_start")))


@query(
    "batch_number",
    sql="""SELECT path, (row_number() OVER (ORDER BY path) - 1) // 64 + 1 AS batch, CAST(ceil(count(*) OVER () / 64) AS BIGINT) AS batches
        FROM corpus""",
)
def batch_number(spark, sf):
    return mt.batch_number(v.corpus(spark, sf).select("path"), 64, ["path"])

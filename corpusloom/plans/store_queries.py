"""Queries over stores: session documents, collections, embeddings, indexing."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions.files import BINARY_SAMPLE
from corpusloom.functions.models import embed
from corpusloom.operators import index as ix
from corpusloom.operators import metrics as mt
from corpusloom.options import IndexOptions
from corpusloom.plans import oracle as o
from corpusloom.plans import views as v
from corpusloom.plans.registry import query
from corpusloom.plans.stubs import LETTERS, make_embed
from corpusloom.session import fresh_path
from corpusloom.sources import collections as co
from corpusloom.sources import files as fs
from corpusloom.sources import sessions as ss
from corpusloom.sources.frames import write_files

LONG = "long"


def profile(c: str) -> str:
    return "[" + ", ".join(f"CAST(length({c}) - length(replace({c}, '{x}', '')) AS DOUBLE)" for x in LETTERS) + "]"


def joined(vector: str) -> str:
    return f"array_to_string(list_transform({vector}, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ',')"


def vector_text(column: str):
    return F.array_join(F.transform(column, lambda x: x.cast(LONG).cast("string")), ",")


@query("scan_corpus", sql="SELECT lang, CAST(sum(strlen(text) + 1) AS BIGINT) AS bytes, CAST(sum(length(text) + 1) AS BIGINT) AS chars FROM documents GROUP BY lang")
def scan_corpus(spark, sf):
    """Documents exported as text files below one folder per language, then scanned."""
    path = fresh_path(spark, "tree")
    docs = v.table(spark, sf, "documents").select("lang", F.col("text").alias("value"))
    docs.write.option("maxRecordsPerFile", 1000).partitionBy("lang").text(path)
    found = fs.scan_corpus(spark, path).where(F.endswith("path", F.lit(".txt")))
    lang = F.regexp_extract("path", r"^lang=([^/]*)/", 1)
    return found.groupBy(lang.alias("lang")).agg(
        F.sum("size").alias("bytes"), F.sum(F.length("content").cast(LONG)).alias("chars")
    )


@query("attach_files", sql="SELECT false AS is_repository, CAST(sum(length(text) + 1) AS BIGINT) AS chars FROM documents WHERE strlen(text) < 262144")
def attach_files(spark, sf):
    """Every document exported as a text file of its own; those below the operator's size limit are picked up as attachments."""
    path = fresh_path(spark, "attached")
    docs = v.table(spark, sf, "documents").where("text is not null")
    numbered = docs.select("text", F.monotonically_increasing_id().alias("n"))  # the same ones in a repeated task
    # At most 1,024 files in a folder, so that no listing grows with the table.
    names = F.concat(F.lit("part="), F.shiftright("n", 10).cast("string"), F.lit("/"), F.col("n").cast("string"), F.lit(".txt"))
    write_files(numbered.select(names.alias("name"), F.concat("text", F.lit("\n")).alias("value")), path)
    found = fs.attach_files(spark, path).where(F.endswith("name", F.lit(".txt")))
    return found.groupBy("is_repository").agg(F.sum(F.length("content").cast(LONG)).alias("chars"))


@query(
    "read_sessions",
    sql="""SELECT conv_id AS doc, turn AS doc_turn, 'c' || conv_id AS session_id, 'T' || conv_id AS title, conv_id * 1000 AS created_at, CAST(0 AS BIGINT) AS turn, role,
        CASE WHEN role <> 'user' AND turn % 5 = 4 THEN '' ELSE text END AS text, CAST(CASE WHEN role = 'user' THEN 2 ELSE 0 END AS BIGINT) AS files FROM conversations""",
)
def read_sessions(spark, sf):
    """One store document per message, in both layouts."""
    base = v.with_files(spark, sf)
    files = F.transform("files", lambda f: F.struct(f["name"].alias("name"), f["content"].alias("content")))
    user = F.to_json(F.struct("text", files.alias("filesMetadata")))
    reply = F.when(F.col("turn") % 5 == 4, F.lit('{"time": "1.00"}')).otherwise(F.to_json(F.struct("text")))
    content = F.when(F.col("role") == "user", user).otherwise(reply)
    conv = F.col("conv_id").cast("string")
    session = F.concat(
        F.lit('{"id":"c'), conv, F.lit('","title":"T'), conv, F.lit('","createdAt":'), (F.col("conv_id") * 1000).cast("string"),
        F.lit(',"messages":[{"role":"'), F.col("role"), F.lit('","content":'), content, F.lit("}]}"),
    )
    value = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("["), session, F.lit("]"))).otherwise(
        F.concat(F.lit('{"sessions":['), session, F.lit('],"uiState":{}}'))
    )
    stores = base.select(F.col("conv_id").alias("doc"), F.col("turn").alias("doc_turn"), value.alias("value"))
    return ss.parse_sessions(stores).select(
        "doc", "doc_turn", "session_id", "title", "created_at", F.col("turn").cast(LONG).alias("turn"), "role", "text",
        F.size("files").cast(LONG).alias("files"),
    )


@query("write_sessions", sql="SELECT conv_id AS session_id, turn, role, text, 1700000000000 + conv_id * 7200000 AS created_at FROM conversations")
def write_sessions(spark, sf):
    rows = v.table(spark, sf, "conversations").select(
        F.col("conv_id").alias("session_id"), "turn", "role", "text",
        (F.lit(1_700_000_000_000) + F.col("conv_id") * 7_200_000).alias("created_at"),
    )
    path = fresh_path(spark, "session-store")
    ss.write_sessions(rows, path)
    return ss.read_sessions(spark, path).drop("created_on")


RECORDS = "SELECT id, path, content, label FROM chunks_vec"


def records(spark, sf):
    return v.chunks_vec(spark, sf).select("id", "path", "content", F.col("label").cast(LONG).alias("label"))


@query("replace_collection", sql=f"SELECT 'code_2' AS collection_id, * FROM ({RECORDS})")
def replace_collection(spark, sf):
    """Written, replaced under the same id, then succeeded by another one."""
    path = fresh_path(spark, "collections")
    rows = records(spark, sf)
    co.replace_collection(rows.withColumn("content", F.lit("first")), path, "code_1")
    co.replace_collection(rows.withColumn("content", F.lit("second")), path, "code_1")
    co.replace_collection(rows, path, "code_2", previous_id="code_1")
    return spark.read.parquet(path)


@query("drop_collection", sql=f"SELECT 'b' AS collection_id, count(*) AS n FROM ({RECORDS})")
def drop_collection(spark, sf):
    """Written under one id, from there under another, the first one dropped."""
    path = fresh_path(spark, "collections")
    co.replace_collection(records(spark, sf), path, "a")
    co.replace_collection(co.read_collection(spark, path, "a"), path, "b")
    co.drop_collection(spark, path, "a")
    return spark.read.parquet(path).groupBy("collection_id").agg(F.count("*").alias("n"))


@query("collection_exists", sql=f"SELECT DISTINCT 'l' || label AS name, true AS found FROM ({RECORDS}) UNION ALL SELECT DISTINCT 'l' || source, false FROM documents")
def collection_exists(spark, sf):
    """One collection per label; names of labels and of sources are looked up."""
    path = fresh_path(spark, "collections")
    rows = records(spark, sf)
    rows.withColumn("collection_id", F.concat(F.lit("l"), F.col("label").cast("string"))).write.partitionBy(
        "collection_id"
    ).parquet(path)
    known = co.list_collections(spark, path).withColumn("found", F.lit(True))
    sources = v.table(spark, sf, "documents").select(F.col("source").alias("name"))
    names = rows.select(F.col("label").cast("string").alias("name")).unionByName(sources).distinct()
    asked = names.select(F.concat(F.lit("l"), F.col("name")).alias("collection_id"))
    return asked.join(known, "collection_id", "left").select(
        F.col("collection_id").alias("name"), F.coalesce("found", F.lit(False)).alias("found")
    )


@query("collection_get", sql=f"SELECT id, path FROM ({RECORDS}) WHERE path IN (SELECT path FROM corpus JOIN labels USING (doc_id) WHERE quality = 1) ORDER BY id LIMIT 100 OFFSET 20")
def collection_get(spark, sf):
    good = v.corpus(spark, sf).select("doc_id", "path").join(v.table(spark, sf, "labels").where("quality = 1"), "doc_id")
    return co.collection_get(records(spark, sf), good.select("path"), limit=100, offset=20, columns=["id", "path"])


@query("index_summary", sql="SELECT 'l' || label AS collection_id, 'indexed' AS status, count(*) AS indexed_files, 1710000000000 AS indexed_at FROM chunks_vec GROUP BY label")
def index_summary(spark, sf):
    named = records(spark, sf).withColumn("collection_id", F.concat(F.lit("l"), F.col("label").cast("string")))
    return mt.index_summary(named, 1_710_000_000_000)


@query("join_embeddings", sql="SELECT id, path, len(embedding) AS dims FROM chunks_vec")
def join_embeddings(spark, sf):
    vectors = v.chunks_vec(spark, sf).select("id", "embedding")
    joined_ = ix.join_embeddings(records(spark, sf), vectors)
    return joined_.select("id", "path", F.size("embedding").cast(LONG).alias("dims"))


@query("embed", sql=f"SELECT doc_id, {joined(profile(o.trim('text')))} AS vector FROM documents")
def embed_texts(spark, sf):
    docs = v.table(spark, sf, "documents").select("doc_id", "text")
    return embed(docs, "text", make_embed).select("doc_id", vector_text("embedding").alias("vector"))


KEPT_SPANS = f"""SELECT *, string_split(path, '/')[-1] AS file_name FROM (SELECT path, content, {o.finished('f')} AS k
    FROM (SELECT path, content, {o.spans('content', 300, 512)} AS f FROM whole_dispositions WHERE disposition = 'kept'))"""
INDEX_INPUT = f"""concat_ws(chr(10), path, file_name, {o.extension('file_name')}, array_to_string(string_split(path, '/')[:-2], '/'),
    {o.language('file_name')}, {o.file_type('file_name')}, '', '', 'generic', text)"""


@query(
    "index_with_stats",
    sql="""SELECT count(*) AS considered_files, count(*) FILTER (disposition = 'size') AS skipped_by_size,
        count(*) FILTER (disposition = 'empty') AS skipped_empty, count(*) FILTER (disposition = 'binary') AS skipped_binary,
        count(*) FILTER (disposition = 'glob') AS skipped_by_glob, CAST(0 AS BIGINT) AS read_errors,
        count(*) FILTER (disposition = 'kept') AS kept_files, max(d) AS visited_directories, count(*) + max(d) - 1 AS visited_entries,
        (SELECT CAST(sum(len(k)) AS BIGINT) FROM (%s)) AS indexed_chunks
        FROM whole_dispositions, (SELECT count(DISTINCT folder) AS d FROM (SELECT unnest(list_transform(range(0, len(parts)),
            lambda n: array_to_string(parts[1:n], '/'))) AS folder FROM (SELECT string_split(path, '/') AS parts FROM whole_dispositions)))""" % KEPT_SPANS,
)
def index_with_stats(spark, sf):
    """What the scan of an index run met, counted by the run itself."""
    files = v.dirty(spark, sf).select("path", "size", "content")
    _, stats = ix.index_with_stats(files, make_embed, fresh_path(spark, "index"), "counted_1", options=IndexOptions(binary_sample=BINARY_SAMPLE))
    return stats


@query(
    "index_corpus",
    sql=f"""SELECT 'whole_1' AS collection_id, path || '::chunk-' || (i - 1) AS id, CAST(len(k) AS BIGINT) AS chunk_count, k[i].e AS chunk_end,
        {o.language('file_name')} AS language, md5(text) AS text_md5, {joined(profile(o.trim(INDEX_INPUT)))} AS vector
        FROM (SELECT *, substr(content, k[i].s + 1, k[i].e - k[i].s) AS text FROM (SELECT *, unnest(range(1, len(k) + 1)) AS i FROM ({KEPT_SPANS})))""",
)
def index_corpus(spark, sf):
    path = fresh_path(spark, "index")
    files = v.dirty(spark, sf).select("path", "size", "content")
    ix.index_corpus(files, make_embed, path, "whole_1", options=IndexOptions(binary_sample=BINARY_SAMPLE))
    return co.read_collection(spark, path, "whole_1").select(
        "collection_id", "id", F.col("chunk_count").cast(LONG).alias("chunk_count"),
        F.col("chunk_end").cast(LONG).alias("chunk_end"), "language", F.md5("content").alias("text_md5"),
        vector_text("embedding").alias("vector"),
    )

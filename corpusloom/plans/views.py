"""The views the registered queries run over, all derived from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import files as ff
from corpusloom.operators.index import describe_files

# File names given to documents in turn, so that every rule on names is met.
NAMES = (
    "Main.java", "mod.py", "view.ts", "comp.tsx", "app.js", "data.json", "config.yaml",
    "pom.xml", "notes.md", ".env", "a.bin", "deps.LOCK", "README",
)
MARKERS = ("pom.xml", "package.json", "requirements.txt", "Cargo.toml", "go.mod", "main.c", "build.gradle")
PROJECTS = ("java", "node", "python", "generic")
THRESHOLD = 600


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def table_stream(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """The same table as a stream of its files: a pattern, since a table may be one file or a folder of them."""
    schema = table(spark, sf, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf}/{name}.parque[t]")


def pick(values, index):
    return F.element_at(F.array(*map(F.lit, values)), (index % len(values) + 1).cast("int"))


def corpus(spark, sf) -> DataFrame:
    doc = F.col("doc_id")
    return table(spark, sf, "documents").select(
        "doc_id",
        F.concat_ws("/", "source", "lang", F.concat(F.lit("d"), doc.cast("string")), pick(NAMES, doc)).alias("path"),
        F.col("text").alias("content"),
        F.octet_length("text").cast("long").alias("size"),
    )


def named(spark, sf) -> DataFrame:
    """Corpus paths with their file attributes; texts are not read."""
    c = corpus(spark, sf)
    name = ff.file_name(F.col("path"))
    return c.select("doc_id", "path", name.alias("file_name"), ff.folder(F.col("path")).alias("folder"),
                    ff.extension(name).alias("extension"), ff.language(name).alias("language"))


def dirty(spark, sf) -> DataFrame:
    """The corpus with empty, binary-looking and doubled texts and ignored folders."""
    doc, text = F.col("doc_id"), F.col("content")
    content = (
        F.when(doc % 17 == 0, F.lit(" \n\t"))
        .when(doc % 19 == 0, F.concat(F.repeat(F.lit("\x01"), F.lit(400)), text))
        .when(doc % 23 == 0, F.concat(text, text))
        .otherwise(text)
    )
    path = F.when(doc % 11 == 3, F.concat(F.lit("node_modules/"), F.col("path"))).otherwise(F.col("path"))
    return corpus(spark, sf).select("doc_id", path.alias("path"), content.alias("content")).withColumn(
        "size", F.octet_length("content").cast("long")
    )


def code(spark, sf) -> DataFrame:
    """Documents below an invented code header."""
    doc = F.col("doc_id").cast("string")
    header = F.concat(
        F.lit('import "mod'), doc, F.lit('.core"\nclass Doc'), doc, F.lit(" {\n  public int run"),
        (F.col("doc_id") % 5).cast("string"), F.lit("(int a, String b) {\n    if (a > 0) { return helper(a); }\n  }\n}\n"),
        F.lit("const total"), doc, F.lit(" = compute(1);\n"),
    )
    return corpus(spark, sf).select("doc_id", "path", F.concat(header, "content").alias("content"))


def listing(spark, sf) -> DataFrame:
    return table(spark, sf, "documents").select(
        F.concat_ws("-", "source", "lang").alias("workspace"), pick(MARKERS, F.col("doc_id")).alias("name")
    )


def queries(spark, sf) -> DataFrame:
    """Every benchmark item, with the vector of the same id."""
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("item_id"), "embedding")
    return table(spark, sf, "benchmark").join(vectors, "item_id").select(
        F.col("item_id").alias("query_id"), "text", "embedding"
    )


def chunks_vec(spark, sf) -> DataFrame:
    """One chunk per document that has a vector."""
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding", "label")
    return corpus_chunks(spark, sf).join(vectors, "doc_id")


def corpus_chunks(spark, sf) -> DataFrame:
    """One chunk per document, vectors or not."""
    name = ff.file_name(F.col("path"))
    return corpus(spark, sf).select(
        ff.chunk_id(F.col("path"), F.lit(0)).alias("id"), "doc_id", "path", name.alias("file_name"),
        ff.folder(F.col("path")).alias("folder"), ff.extension(name).alias("extension"),
        ff.language(name).alias("language"), "content",
    )


def query_paths(spark, sf) -> DataFrame:
    """Files listed per benchmark item: the good ones of three; some items list none."""
    near = table(spark, sf, "benchmark").select(
        F.col("item_id").alias("query_id"), F.explode(F.sequence("item_id", F.col("item_id") + 2)).alias("doc_id")
    )
    good = table(spark, sf, "labels").where("quality = 1").select("doc_id")
    listed = near.join(good, "doc_id").join(corpus(spark, sf).select("doc_id", "path"), "doc_id")
    return listed.select("query_id", "path")


def neighbours(spark, sf) -> DataFrame:
    """Each vector beside the next one."""
    v = table(spark, sf, "embeddings")
    return v.select("vec_id", F.col("embedding").alias("a")).join(
        v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b")), "vec_id"
    )


def messages(spark, sf) -> DataFrame:
    """Conversations in which some turns are tool observations."""
    text = F.when(F.col("turn") % 3 == 2, F.concat(F.lit("Observation: "), F.col("text"))).otherwise(F.col("text"))
    return table(spark, sf, "conversations").select("conv_id", "turn", "role", text.alias("text"))


def attachments(spark, sf) -> DataFrame:
    """Two attachments per user turn; names repeat across turns."""
    turn = F.col("turn")
    first = F.struct(
        F.lit(0).alias("pos"),
        F.concat(F.lit("file"), (turn % 3).cast("string"), F.lit(".ts"),
                 F.when(turn % 4 == 0, F.concat(F.lit(":"), (turn + 1).cast("string"))).otherwise(F.lit(""))).alias("name"),
        F.col("text").alias("content"),
        (F.col("conv_id") % 11 == 0).alias("is_repository"),
    )
    second = F.struct(
        F.lit(1).alias("pos"), F.lit("app.config").alias("name"),
        F.concat(F.lit("<k>&'"), F.col("role"), F.lit("\x07'\"</k>")).alias("content"), F.lit(False).alias("is_repository"),
    )
    users = table(spark, sf, "conversations").where(F.col("role") == "user")
    return users.select("conv_id", "turn", F.explode(F.array(first, second)).alias("f")).select("conv_id", "turn", "f.*")


def with_files(spark, sf) -> DataFrame:
    """Messages with their attachments as an array (two at most)."""
    lists = attachments(spark, sf).groupBy("conv_id", "turn").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("pos", "name", "content", "is_repository"))),
            lambda f: F.struct(f["name"].alias("name"), f["content"].alias("content"), F.lit(False).alias("is_automatic"),
                               f["is_repository"].alias("is_repository")),
        ).alias("files")
    )
    return table(spark, sf, "conversations").join(lists, ["conv_id", "turn"], "left")


def agent_turns(spark, sf) -> DataFrame:
    """Assistant turns rewritten as agent replies of every kind."""
    word = F.element_at(F.split("text", r"\s+"), 1)
    kind = (F.col("conv_id") + F.col("turn")) % 6
    text = (
        F.when(kind == 0, F.concat(F.lit('Thought: look\nAction: agent_search("'), word, F.lit('")')))
        .when(kind == 1, F.concat(F.lit("Thought: done\nFinal Answer: "), F.col("text")))
        .when(kind == 2, F.concat(F.lit("Thought\r\n  action: search ( '"), F.lower(word), F.lit("' ) ")))
        .when(kind == 3, F.lit("FINAL ANSWER: [Your answer here]"))
        .when(kind == 4, F.lit('Action: agent_search("same words")'))
        .otherwise(F.concat(F.lit("Action: search()\nAction: search("), word, F.lit(")")))
    )
    return table(spark, sf, "conversations").where(F.col("role") == "assistant").select("conv_id", "turn", text.alias("text"))


def fragments(spark, sf, events=None, *more) -> DataFrame:
    """Reply lines made of events: both fragment layouts, usage, end marks, bad JSON."""
    events = table(spark, sf, "events") if events is None else events
    i = F.col("event_id")
    piece = F.concat(F.col("event_type"), F.lit(" "))
    body = (
        F.when(i % 50 == 0, F.lit("[DONE]"))
        .when(i % 77 == 0, F.lit('{"choices": ['))
        .when(i % 3 == 0, F.concat(F.lit('{"choices":[{"text":"'), piece, F.lit('"}]}')))
        .when(i % 7 == 0, F.concat(F.lit('{"choices":[],"usage":{"completion_tokens":'), (i % 9).cast("string"), F.lit("}}")))
        .otherwise(F.concat(F.lit('{"choices":[{"delta":{"content":"'), piece, F.lit('"}}]}')))
    )
    line = F.when(i % 31 == 0, F.lit("")).when(i % 41 == 0, F.concat(F.lit(": "), piece)).otherwise(
        F.concat(F.lit("data: "), body)
    )
    return events.select(F.col("user_id").alias("request_id"), F.col("event_id").alias("seq"), line.alias("value"), *more)


def requests(spark, sf, events=None) -> DataFrame:
    events = table(spark, sf, "events") if events is None else events
    return events.select(
        "event_id", "ts", "user_id", F.round(F.col("value") * 1000).cast("long").alias("duration_ms"),
        (F.col("event_type") == "error").alias("is_error"),
    )


def log_lines(spark, sf) -> DataFrame:
    level = F.when(F.col("event_type") == "error", F.lit("ERROR")).otherwise(F.lit("INFO"))
    tail = F.when(F.col("event_id") % 4 == 0, F.lit("")).otherwise(F.concat(F.lit(" | "), F.col("props")))
    return table(spark, sf, "events").select(
        "event_id",
        F.concat(F.lit("2024-01-01T00:00:00.000Z ["), level, F.lit("] [rag] saw "), F.col("event_type"), tail).alias("value"),
    )


def described(spark, sf) -> DataFrame:
    return describe_files(corpus(spark, sf), "java")

"""Lexical search by postings: which chunks hold a run of three characters, kept beside a collection.

A token can only be part of a text that holds all its trigrams, so the postings of its rarest one are candidates,
and the exact scores of ``search_lexical`` decide on them. Tokens whose rarest gram is frequent are not looked up.
Instead they bound what a chunk outside the candidates can score: if the last of a query's ``max_results`` hits is
above that, the query is settled, and only what is left is scanned. So the hits are always those of the scan.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import scoring as sc
from corpusloom.operators.filters import nonblank_queries
from corpusloom.operators.search import _labelled, _ranked, _rounded, search_lexical, searchable_text
from corpusloom.options import SearchOptions
from corpusloom.session import checkpoint

META, CONTENT = "m", "c"
#: A gram is looked up if at most this share of all chunks has it.
SHARE = 0.02
#: Parts of one gram's postings.
PARTS = 32


@dataclass(frozen=True)
class Postings:
    """rows: field, gram, id; counts: field, gram, n; total: chunks."""

    rows: DataFrame
    counts: DataFrame
    total: int


def grams(text: Column, n: int) -> Column:
    """Distinct runs of ``n`` token characters, overlapping ones too, in one pass over the text."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?=([a-z0-9_./-]{{{n}}}))"), F.lit(1)))


def posting_rows(chunks: DataFrame) -> DataFrame:
    """field, gram, id: pairs and triples of the metadata, triples of the content. Chunks without content are in no search."""
    rows = chunks.where(F.col("content").isNotNull()).select("id", searchable_text(chunks).alias("s"), F.lower("content").alias("c"))
    meta = rows.select(F.lit(META).alias("field"), F.explode(F.concat(grams(F.col("s"), 2), grams(F.col("s"), 3))).alias("gram"), "id")
    return meta.unionByName(rows.select(F.lit(CONTENT).alias("field"), F.explode(grams(F.col("c"), 3)).alias("gram"), "id"))


def write_postings(chunks: DataFrame, path: str) -> None:
    """Postings of all chunks, sorted in every file: a lookup reads the row groups of its grams.

    A gram is dealt over ``PARTS`` files at most, so a hot one is many parts; ranges would need the texts read twice.
    """
    parts = int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = posting_rows(chunks).repartition(parts, "field", "gram", F.pmod(F.xxhash64("id"), F.lit(PARTS)))
    dealt.sortWithinPartitions("field", "gram", "id").write.mode("overwrite").parquet(f"{path}/rows")
    rows = chunks.sparkSession.read.parquet(f"{path}/rows")
    rows.groupBy("field", "gram").agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{path}/counts")
    chunks.agg(F.count("content").alias("total")).write.mode("overwrite").parquet(f"{path}/total")


def read_postings(spark: SparkSession, path: str) -> Postings:
    read = lambda name: spark.read.parquet(f"{path}/{name}")
    return Postings(read("rows"), read("counts"), read("total").first().total)


def _looked_up(tokens: DataFrame, postings: Postings) -> DataFrame:
    """query_id, token, times, field with the rarest gram of every token and its count.

    A token with a gram that no chunk has is nowhere (n = 0). One that is too short for the grams of a field has no
    gram there and counts as frequent.
    """
    fields = tokens.select("token").distinct().withColumn("field", F.explode(F.array(F.lit(META), F.lit(CONTENT))))
    pairs = F.when(F.col("field") == META, grams(F.col("token"), 2)).otherwise(F.array().cast("array<string>"))
    each = fields.withColumn("gram", F.explode_outer(F.when(F.length("token") >= 3, grams(F.col("token"), 3)).otherwise(pairs)))
    counted = each.join(postings.counts, ["field", "gram"], "left").withColumn(
        "n", F.when(F.col("gram").isNull(), F.lit(postings.total + 1)).otherwise(F.coalesce("n", F.lit(0)))
    )
    rarest = counted.groupBy("token", "field").agg(F.min(F.struct("n", "gram")).alias("g")).select("token", "field", "g.n", "g.gram")
    return tokens.join(rarest, "token")


def candidates(asked: DataFrame, postings: Postings, options: SearchOptions, share: float = SHARE) -> tuple[DataFrame, DataFrame]:
    """(query_id, id) of every chunk that may hold a rare token, and (query_id, bound) of what others can score.

    ``asked`` has query_id and tokens.
    """
    tokens = asked.select("query_id", F.size("tokens").alias("size"), F.explode("tokens").alias("token")).groupBy("query_id", "size", "token").agg(
        F.count("*").alias("times")
    )
    looked = checkpoint(_looked_up(tokens, postings), "posting-tokens")
    rare = F.col("n") <= int(share * postings.total)
    wanted = looked.where(rare & (F.col("n") > 0)).select("query_id", "field", "gram").distinct()
    found = wanted.join(postings.rows, ["field", "gram"]).select("query_id", "id").distinct()
    weight = F.when(F.col("field") == META, F.lit(options.metadata_weight)).otherwise(F.lit(options.content_weight))
    open_share = F.sum(F.when(rare, F.lit(0.0)).otherwise(weight * F.col("times") / F.col("size")))
    return found, looked.groupBy("query_id").agg(open_share.alias("bound"))


def search_postings(
    queries: DataFrame, chunks: DataFrame, postings: Postings, options: SearchOptions = SearchOptions(), share: float = SHARE, **scan
) -> DataFrame:
    """The hits of ``search_lexical``: token hits in metadata and content, positive scores only, top-k.

    ``postings`` are those of ``chunks``. Queries whose hits could be beaten by a chunk outside their candidates
    are answered by the scan.
    """
    asked = checkpoint(nonblank_queries(queries).select("query_id", "text", sc.tokenize(F.col("text")).alias("tokens")), "posting-queries")
    found, bounds = candidates(asked, postings, options, share)
    rows = chunks.where(F.col("content").isNotNull()).select("id", searchable_text(chunks).alias("searchable"), "content")
    scored = found.join(asked.select("query_id", "tokens"), "query_id").join(rows, "id").select(
        "query_id", "id",
        sc.lexical_path_score(F.col("tokens"), F.col("searchable")).alias("first"),
        sc.lexical_content_score(F.col("tokens"), F.col("content")).alias("second"),
    )
    scored = scored.withColumn("score", F.col("first") * options.metadata_weight + F.col("second") * options.content_weight)
    best = checkpoint(
        _ranked(_rounded(scored, options).where(F.col("score") > 0), options.max_results, F.desc("score"), F.asc("id")), "posting-hits"
    )
    last = best.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("last"))
    # room for the last bits of the sums; ties with the bound are not settled, since the smaller id would win
    above = (F.col("n") >= options.max_results) & (F.col("last") > F.col("bound") + 10.0 ** -(options.digits or 9))
    settled = checkpoint(bounds.join(last, "query_id", "left").where((F.col("bound") == 0) | F.coalesce(above, F.lit(False))).select("query_id"), "posting-settled")
    hits = best.join(settled, "query_id", "left_semi").select(
        "query_id", "id", "rank", F.col("score").alias("combined"), F.col("first").alias("metadata_score"), F.col("second").alias("content_score"),
    )
    shown = _labelled(hits, chunks)
    rest = checkpoint(asked.join(settled, "query_id", "left_anti").select("query_id", "text"), "posting-rest")
    if rest.isEmpty():
        return shown
    return shown.unionByName(search_lexical(rest, chunks, options, **scan).select(*shown.columns))

"""Token counts by a digest cache: a text whose normal form was counted before is not encoded again.

The cache is a table of (tokenizer, digest, n_tokens). Texts are joined to it by the digest of their normal form
and the digest of the tokenizer: file, kind and library version. Only distinct texts that miss are encoded, and
their counts are appended. Texts that share their digest with no other and miss for sure are encoded where they
are read; a Bloom filter of fixed size tells which ones may not, and only those are shuffled.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from corpusloom.llm.common import maybe_in, two_columns
from corpusloom.llm.kernels import slices
from corpusloom.session import checkpoint

CACHE_SCHEMA = "tokenizer string, digest binary, n_tokens long"
#: Characters of a long text that are looked at together, where its words can be counted one by one.
CALL_CHARS = 1 << 18
#: Words that a task keeps with their counts, and words that are encoded in one call.
KEPT_WORDS = 1 << 19
CALL_WORDS = 1 << 12
#: A digest of more than one in this many rows meets its count by a broadcast; there are fewer of them than this.
HEAVY = 1_000


class Encoder(NamedTuple):
    """A tokenizer file with what tells its counts from those of others."""

    data: bytes
    kind: str
    digest: str
    #: Whether white space only separates and A-Z count like a-z, so that texts have a normal form.
    folds: bool


def load_encoder(path: str) -> Encoder:
    """The tokenizer of a ``.json`` (tokenizers) or ``.model`` (sentencepiece) file.

    The file is read once on the driver and goes to the tasks with the plan; it does not grow with the data.
    """
    import json

    with open(path, "rb") as f:
        data = f.read()
    if path.endswith(".model"):
        import sentencepiece

        kind, version, folds = "sentencepiece", sentencepiece.__version__, False
    else:
        import tokenizers

        kind, version = "tokenizers", tokenizers.__version__
        folds = _folds(json.loads(data))
    name = f"{kind} {version} {hashlib.sha256(data).hexdigest()}"
    return Encoder(data, kind, hashlib.sha256(name.encode()).hexdigest(), folds)


def _folds(spec: dict) -> bool:
    """Whether the file lower-cases, makes white space one blank and leaves it out between pieces."""
    normalizer = spec.get("normalizer") or {}
    steps = normalizer.get("normalizers", [normalizer])
    first = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])[0]
    return (
        any(s.get("type") == "Lowercase" for s in steps)
        and any(s.get("type") == "Replace" and s.get("pattern") == {"Regex": r"\s+"} and s.get("content") == " " for s in steps)
        and first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") is True
        and r"[^\s" in str(first.get("pattern", {}).get("Regex"))
        and all("<|" in t["content"] for t in spec.get("added_tokens", []))
    )


def normal_form(text: Column, encoder: Encoder) -> Column:
    """The text, or another one of the same count that more texts share.

    Only where the tokenizer folds: runs of blanks, tabs and line ends are one blank, none at the ends. If the text
    is ASCII without "<|", which special strings have, A-Z are lower-cased as well: beyond ASCII lower-casing does
    not commute with composition, and special strings are told apart by case.
    """
    if not encoder.folds:
        return text
    plain = (F.octet_length(text) == F.char_length(text)) & ~F.contains(text, F.lit("<|"))
    spaced = F.trim(F.regexp_replace(text, "[ \t\n\r]+", " "))
    return F.when(plain, F.lower(spaced)).otherwise(spaced)


def counter(encoder: Encoder):
    """A function from a list of texts to their token counts, without added tokens, truncation or padding."""
    if encoder.kind == "sentencepiece":
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_proto=encoder.data)
        return lambda texts: [len(ids) for ids in model.encode(texts, num_threads=1)]
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    model = Tokenizer.from_str(encoder.data.decode())
    model.no_truncation()
    model.no_padding()
    encode = getattr(model, "encode_batch_fast", model.encode_batch)
    return lambda texts: [len(e.ids) for e in encode(texts, add_special_tokens=False)]


def pieces(text: str, size: int = CALL_CHARS) -> list[str]:
    """A text cut at blanks into pieces of ``size`` characters, or longer where no blank comes."""
    out, at = [], 0
    while len(text) - at > size:
        to = text.find(" ", at + size)
        if to < 0:
            break
        out.append(text[at:to])
        at = to + 1
    return [*out, text[at:]]


class WordCounter:
    """Counts for tokenizers that fold: no token goes across a blank, so counts of words add up.

    Every distinct word is encoded once, as long as it is among the words kept; texts are never held as lists of
    words beyond one piece.
    """

    def __init__(self, encoder: Encoder):
        self.count, self.known = counter(encoder), {}

    def __call__(self, text: str) -> int:
        total = 0
        for piece in pieces(text):
            words = piece.split(" ")
            missing = [w for w in set(words) if w not in self.known]
            if missing:
                if len(self.known) + len(missing) > KEPT_WORDS:
                    self.known.clear()
                    missing = list(set(words))
                for at in range(0, len(missing), CALL_WORDS):
                    part = missing[at:at + CALL_WORDS]
                    self.known.update(zip(part, self.count(part)))
            total += sum(map(self.known.__getitem__, words))
        return total


def encoded(rows: DataFrame, encoder: Encoder) -> DataFrame:
    """digest, n_tokens of every row (digest, text) by its whole text, which may be the normal form."""

    def encode(batches):
        if encoder.folds:
            words = WordCounter(encoder)
            many = lambda texts: list(map(words, texts))
        else:
            one = counter(encoder)
            many = lambda texts: [n for t in texts for n in one([t])]
        for batch in slices(batches, "text"):
            found = many(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(found, pa.int64())], ["digest", "n_tokens"])

    return rows.select("digest", "text").mapInArrow(encode, "digest binary, n_tokens long")


def read_cache(spark, path: str | None, encoder: Encoder) -> DataFrame:
    """digest, n_tokens that the cache holds for this tokenizer; a cache that is not there yet is empty.

    Runs that missed the same text at the same time have both appended it: one row of them is taken.
    """
    rows = spark.createDataFrame([], CACHE_SCHEMA)
    if path is not None:
        try:
            rows = spark.read.schema(CACHE_SCHEMA).parquet(path)
        except AnalysisException:
            pass
    return rows.where(F.col("tokenizer") == encoder.digest).groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"))


def count_tokens(
    docs: DataFrame, tokenizer_path: str, cache: str | None = None, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: row, doc_id, digest, cached, n_bytes, n_tokens, over_limit (more than ``limit``).

    ``cache`` is a Parquet folder that all executors reach; it is made if missing, and misses are appended to it.
    Without one, distinct texts are still encoded once. Null texts are empty and have no tokens; null ids and
    repeated rows each give their row; an empty table gives none and appends none. Other columns are not looked
    at. Special strings inside texts count as the library takes them by default.
    """
    spark, encoder = docs.sparkSession, load_encoder(tokenizer_path)
    texts = two_columns(docs, id_col, text_col).select(
        "row", "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), normal_form(F.col("text"), encoder).alias("text")
    ).withColumn("digest", F.unhex(F.sha2("text", 256)))
    keyed = checkpoint(texts.select("row", "doc_id", "digest", "n_bytes"), "token-keys")
    groups = keyed.groupBy("digest").agg(F.count("*").alias("n"), F.min("row").alias("row"))
    state = checkpoint(groups.join(read_cache(spark, cache, encoder), "digest", "left"), "token-state")
    misses = state.where("n_tokens is null")
    # digests that are not simply encoded where they are met
    held = state.where("n_tokens is not null or n > 1").select("digest")
    marked = maybe_in(texts.select("row", "digest", "text"), held, "digest")
    alone = marked.where("not maybe")
    firsts = marked.where("maybe").join(misses.select("row"), "row", "left_semi")
    fresh = checkpoint(encoded(alone.select("digest", "text").unionByName(firsts.select("digest", "text")), encoder), "token-counts")
    if cache is not None:
        fresh.select(F.lit(encoder.digest).alias("tokenizer"), "digest", "n_tokens").write.mode("append").parquet(cache)
    hits = state.where("n_tokens is not null").select("digest", "n_tokens", F.lit(True).alias("cached"))
    known = hits.unionByName(fresh.withColumn("cached", F.lit(False)))
    # a hot text would be one group of the join: fewer than HEAVY digests have more than one in HEAVY rows
    total = keyed.count()
    heavy = known.join(F.broadcast(state.where(F.col("n") * HEAVY > total).select("digest")), "digest", "left_semi")
    light = keyed.join(F.broadcast(heavy.select("digest")), "digest", "left_anti").join(known, "digest")
    hot = keyed.join(F.broadcast(heavy), "digest")
    return hot.unionByName(light).select(
        "row", "doc_id", F.lower(F.hex("digest")).alias("digest"), "cached", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )

"""Scores: token hit ratios, cosine, distance, weighted sums."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.bind import bind

# Fixed value: everything outside this set separates tokens.
TOKEN_BREAK = "[^a-z0-9_./-]+"


def tokenize(text: Column) -> Column:
    """Lower-cased tokens of two characters or more; duplicates are kept."""
    return F.filter(F.split(F.lower(text), TOKEN_BREAK), lambda t: F.length(t) >= 2)


def searchable(*fields: Column) -> Column:
    """Metadata fields as one lower-cased text; an absent field is ``''``."""
    return F.lower(F.concat_ws(" ", *[F.coalesce(f, F.lit("")) for f in fields]))


def hit_ratio(tokens: Column, text: Column) -> Column:
    """Share of tokens found as substrings of ``text``; 0 when either is empty."""

    def ratio(pair):
        words, hay = pair["words"], pair["hay"]
        hits = F.size(F.filter(words, lambda t: F.contains(hay, t)))
        return F.when((F.size(words) > 0) & (F.btrim(hay) != ""), hits / F.size(words)).otherwise(F.lit(0.0))

    return bind(F.struct(tokens.alias("words"), text.alias("hay")), ratio)


def lexical_path_score(tokens: Column, searchable_text: Column) -> Column:
    return hit_ratio(tokens, searchable_text)


def lexical_content_score(tokens: Column, content: Column) -> Column:
    return hit_ratio(tokens, F.lower(content))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x
    )


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """Cosine of two vectors; 0 on unequal length, empty vector or zero norm."""
    na, nb = (norm(a) if norm_a is None else norm_a), (norm(b) if norm_b is None else norm_b)
    usable = (F.size(a) == F.size(b)) & (F.size(a) > 0)
    return F.when(usable & (na > 0) & (nb > 0), _dot(a, b) / (na * nb)).otherwise(F.lit(0.0))


def distance(a: Column, b: Column, metric: str = "l2") -> Column:
    if metric == "cosine":
        return 1 - cosine(a, b)
    if metric == "ip":
        return 1 - _dot(a, b)
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double")), F.lit(0.0), lambda s, d: s + d * d
    )


def vector_score(dist: Column) -> Column:
    return F.when(dist.isNull(), F.lit(0.0)).otherwise(1 / (1 + F.greatest(dist, F.lit(0.0))))


def combined_score(first: Column, second: Column, w_first: float = 0.7, w_second: float = 0.3) -> Column:
    return first * w_first + second * w_second

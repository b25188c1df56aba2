"""Temporal URL filter lists: dated list entries become validity intervals, captures are joined as of their date.

An entry lists or unlists a host suffix (``example.com``) or a URL prefix (``example.com/path``) on a list at
a date. A capture is judged by the entries that were in force on the day it was fetched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Days of one join bucket: an interval is repeated in every bucket it touches, a capture is in one.
BUCKET_DAYS = 32
AUTHORITY = r"(?i)^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)"
PATH = r"(?i)^[a-z][a-z0-9+.\-]*://[^/?#]*(/[^?#]*)"


def host_of(url: Column) -> Column:
    """The host in lower case, '' where there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, AUTHORITY, 1), F.lit("")))


def keys_of(url: Column) -> Column:
    """What an entry can say of a URL: every suffix of its host and every prefix of its path, as host/a/b."""
    host, path = host_of(url), F.coalesce(F.regexp_extract(url, PATH, 1), F.lit(""))
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    prefixes = F.when(F.size(parts) > 0, F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat(host, F.lit("/"), F.array_join(F.slice(parts, 1, i), "/"))
    )).otherwise(F.array().cast("array<string>"))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(suffixes, prefixes)))


def normal_pattern(pattern: Column) -> Column:
    """The host in lower case, the path as it is."""
    host = F.substring_index(pattern, "/", 1)
    return F.concat(F.lower(host), F.substr(pattern, F.length(host) + 1))


def intervals(entries: DataFrame) -> DataFrame:
    """(list_name, pattern, action, valid_from, valid_to) of entries (list_name, pattern, action, listed_on, listed).

    ``listed`` true puts the pattern on the list from that day on, false takes it off. Of entries for one
    pattern, list and day the largest (listed, action) holds, so a window over one pattern has a row per day
    at most. Entries with a null list, pattern or date are void. An open end is null.
    """
    daily = (
        entries.where("list_name is not null and pattern is not null and listed_on is not null")
        .groupBy("list_name", normal_pattern(F.col("pattern")).alias("pattern"), "listed_on")
        .agg(F.max(F.struct(F.coalesce("listed", F.lit(False)).alias("listed"), F.coalesce("action", F.lit("block")).alias("action"))).alias("last"))
    )
    following = Window.partitionBy("list_name", "pattern").orderBy("listed_on")
    return (
        daily.withColumn("valid_to", F.lead("listed_on").over(following))
        .where("last.listed")
        .select("list_name", "pattern", "last.action", F.col("listed_on").alias("valid_from"), "valid_to")
    )


def url_filter(captures: DataFrame, entries: DataFrame, bucket_days: int = BUCKET_DAYS) -> DataFrame:
    """One row per capture (capture_id, url, fetched_on): row, capture_id, fetched_on, decision, pattern, list_name, n_active.

    The longest pattern in force decides; of one pattern, ``allow`` goes before ``block``, then the smaller
    list name. ``decision`` is ``none`` (pattern and list null) where nothing is in force, where the URL has
    no host and where URL or date are null. ``n_active`` counts the entries in force. Repeated rows are
    judged each; other columns are ignored.
    """
    rows = captures.select(F.monotonically_increasing_id().alias("row"), "capture_id", "url", "fetched_on")
    day = lambda c: F.unix_date(F.col(c))
    bucket = lambda days: F.floor(days / bucket_days)
    first_day = captures.agg(F.unix_date(F.min("fetched_on"))).scalar()
    next_day = captures.agg(F.unix_date(F.max("fetched_on")) + 1).scalar()
    spans = (
        intervals(entries)
        .withColumn("from_day", F.greatest(day("valid_from"), first_day))
        .withColumn("to_day", F.least(F.coalesce(day("valid_to"), next_day), next_day))
        .where("from_day < to_day")
        .withColumn("bucket", F.explode(F.sequence(bucket(F.col("from_day")), bucket(F.col("to_day") - 1))))
        .select("pattern", "bucket", "from_day", "to_day", "list_name", "action")
    )
    asked = (
        rows.where("fetched_on is not null and url is not null")
        .select("row", day("fetched_on").alias("at"), bucket(day("fetched_on")).alias("bucket"), F.explode(keys_of(F.col("url"))).alias("pattern"))
    )
    rank = F.struct(F.length("pattern").alias("size"), (F.col("action") == "allow").alias("allow"))
    hits = asked.join(spans, ["pattern", "bucket"]).where("at >= from_day and at < to_day")
    # smallest list name of the best rank: min over (-size, not allow, list)
    order = F.struct((-rank["size"]).alias("a"), (~rank["allow"]).alias("b"), F.col("list_name").alias("list_name"), F.col("pattern").alias("pattern"), F.col("action").alias("action"))
    judged = hits.groupBy("row").agg(F.min(order).alias("best"), F.count("*").alias("n_active"))
    return rows.select("row", "capture_id", "fetched_on").join(judged, "row", "left").select(
        "row", "capture_id", "fetched_on",
        F.coalesce("best.action", F.lit("none")).alias("decision"),
        F.col("best.pattern").alias("pattern"), F.col("best.list_name").alias("list_name"),
        F.coalesce("n_active", F.lit(0)).cast("long").alias("n_active"),
    )

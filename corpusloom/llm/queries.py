"""Registered queries of the training-data operators and their DuckDB twins."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import quality, toxicity, warc
from corpusloom.llm.centroids import cluster_vectors
from corpusloom.llm.common import ascii_lower
from corpusloom.llm.decontaminate import decontaminate
from corpusloom.llm.exact_dedup import exact_dedup
from corpusloom.llm.importance import resample
from corpusloom.llm.lm import score_texts
from corpusloom.llm.mixing import mix_sources
from corpusloom.llm.near_dedup import near_duplicates
from corpusloom.llm.repeats import repeated_bytes
from corpusloom.llm.token_counts import count_tokens
from corpusloom.llm.url_filter import host_of, url_filter
from corpusloom.session import fresh_path, ship_package

QUERIES = {}
ORACLES = {}


def query(name: str, sql: str | None = None):
    def add(plan):
        @functools.wraps(plan)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return plan(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return plan

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


DUCK_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query("op2_mixing", """
    WITH RECURSIVE docs AS (
      SELECT doc_id, source, coalesce('=' || source, '') AS key,
        row_number() OVER (PARTITION BY source ORDER BY md5(coalesce(doc_id::VARCHAR, '')), doc_id) - 1 AS mix_rank FROM documents),
    counts AS (SELECT key, count(*) AS n FROM docs GROUP BY key),
    src AS (
      SELECT key, n, block_rows, sqrt(n) AS weight, ceil(n / block_rows)::BIGINT AS n_blocks, row_number() OVER (ORDER BY key) AS i
      FROM counts, (SELECT greatest(1, ceil(sum(n) / 4096))::BIGINT AS block_rows FROM counts)),
    ends AS (
      SELECT s.i, j, sum(least(k.weight * (j - 1) / s.weight, k.n_blocks)) AS a, sum(least(k.weight * j / s.weight, k.n_blocks)) AS b
      FROM (SELECT i, weight, unnest(range(1, n_blocks + 1)) AS j FROM src) s, src k GROUP BY s.i, j),
    arrays AS (
      SELECT list(w ORDER BY i) AS w, sum(len(w)) AS slots
      FROM (SELECT i, list({'r': floor(a + 1e-9), 'd': ceil(b - 1e-9)} ORDER BY j) AS w FROM ends GROUP BY i)),
    edf AS (
      SELECT 0 AS t, list_transform(w, lambda x: 0) AS used, 0::BIGINT AS pick FROM arrays
      UNION ALL
      SELECT t + 1, list_transform(used, lambda n, i: CASE WHEN i = best THEN n + 1 ELSE n END), best
      FROM (SELECT t, used, list_sort(list_transform(
          list_filter(range(1, len(w) + 1), lambda i: used[i] < len(w[i])),
          lambda i: {'early': w[i][used[i] + 1].r > t, 'd': w[i][used[i] + 1].d, 'i': i}))[1].i AS best, slots FROM edf, arrays WHERE t < slots)),
    coarse AS (
      SELECT pick AS i, t - 1 AS slot, (t - 1) // 64 AS win, row_number() OVER (PARTITION BY pick ORDER BY t) - 1 AS block FROM edf WHERE t > 0),
    fine AS (SELECT win, i, count(*) AS quota, min(block) AS first_block, list(slot % 64 ORDER BY slot) AS places FROM coarse GROUP BY win, i)
    SELECT doc_id, source, f.win::BIGINT AS mix_window,
      ((x.idx // quota) * 64 + places[(x.idx % quota) + 1])::BIGINT AS mix_slot, mix_rank
    FROM docs d JOIN src USING (key) JOIN coarse c ON c.i = src.i AND c.block = mix_rank // block_rows
    JOIN fine f ON f.win = c.win AND f.i = c.i, LATERAL (SELECT (mix_rank - first_block * block_rows) // 4 AS idx) x""")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place in the mix, source weights the square root of their size."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return mix_sources(docs)


@query("op3_exact_dedup", f"""
    WITH d AS (SELECT doc_id, sha256({DUCK_LOWER}) AS text_sha256 FROM documents),
    g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY ALL)
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)""")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What exact deduplication decides on every document, and the digest of every text."""
    docs = table(spark, sf_dir, "documents")
    digests = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.sha2(ascii_lower(F.coalesce("text", F.lit(""))), 256).alias("text_sha256"),
    )
    return exact_dedup(docs).join(digests, "row").select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


#: Capture dates and filter lists of the url query. The lists are made from the hosts that occur: a host, or the
#: domain above it, is listed at a date, taken off again in two of three cases and listed once more in one of three.
#: The digits of an md5 decide.
FIRST_DAY = "2021-01-01"
DAYS = 1200


def captures_of(pages: DataFrame) -> DataFrame:
    return pages.select(
        F.col("page_id").alias("capture_id"), "url",
        F.date_add(F.lit(FIRST_DAY).cast("date"), (F.col("page_id") * 37 % DAYS).cast("int")).alias("fetched_on"),
    )


def entries_of(pages: DataFrame) -> DataFrame:
    host = pages.select(host_of(F.col("url")).alias("host")).where("host <> ''").distinct()
    number = lambda at: F.conv(F.substring(F.md5(F.col("host").cast("binary")), at, 3), 16, 10).cast("int")
    parts = F.split("host", r"\.")
    listed = host.select(
        F.when(number(1) % 4 == 0, F.array_join(F.slice(parts, 2, F.size(parts)), ".")).otherwise(F.col("host")).alias("pattern"),
        F.when(number(4) % 5 == 0, F.lit("allow")).otherwise(F.lit("block")).alias("action"),
        F.element_at(F.array(*map(F.lit, ("adult", "malware", "spam"))), number(7) % 3 + 1).alias("list_name"),
        (number(10) % 600).alias("a"), (number(13) % 400 + 1).alias("b"), (number(16) % 200 + 1).alias("c"), (number(19) % 3).alias("steps"),
    ).where("pattern like '%.%'")
    day = lambda n: F.date_add(F.lit(FIRST_DAY).cast("date"), n)
    events = F.array(
        F.struct(day(F.col("a")).alias("listed_on"), F.lit(True).alias("listed"), F.lit(0).alias("step")),
        F.struct(day(F.col("a") + F.col("b")).alias("listed_on"), F.lit(False).alias("listed"), F.lit(1).alias("step")),
        F.struct(day(F.col("a") + F.col("b") + F.col("c")).alias("listed_on"), F.lit(True).alias("listed"), F.lit(2).alias("step")),
    )
    return listed.select("list_name", "pattern", "action", "steps", F.explode(events).alias("e")).where("e.step <= steps").select(
        "list_name", "pattern", "action", "e.listed_on", "e.listed"
    )


_N = "('0x' || substr(md5(host), {}, 3))::INT"


@query("op8_url_filters", f"""
    WITH captures AS (
      SELECT page_id AS capture_id, DATE '{FIRST_DAY}' + (page_id * 37 % {DAYS})::INT AS fetched_on,
        lower(regexp_extract(url, '(?i)^[a-z][a-z0-9+.\\-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS host,
        regexp_extract(url, '(?i)^[a-z][a-z0-9+.\\-]*://[^/?#]*(/[^?#]*)', 1) AS path
      FROM pages),
    hosts AS (SELECT DISTINCT host FROM captures WHERE host <> ''),
    made AS (
      SELECT CASE WHEN {_N.format(1)} % 4 = 0 THEN array_to_string(string_split(host, '.')[2:], '.') ELSE host END AS pattern,
        CASE WHEN {_N.format(4)} % 5 = 0 THEN 'allow' ELSE 'block' END AS action,
        ['adult', 'malware', 'spam'][{_N.format(7)} % 3 + 1] AS list_name,
        {_N.format(10)} % 600 AS a, {_N.format(13)} % 400 + 1 AS b, {_N.format(16)} % 200 + 1 AS c, {_N.format(19)} % 3 AS steps
      FROM hosts),
    events AS (
      SELECT list_name, pattern, action, DATE '{FIRST_DAY}' + a AS listed_on, TRUE AS listed FROM made WHERE pattern LIKE '%.%'
      UNION ALL SELECT list_name, pattern, action, DATE '{FIRST_DAY}' + a + b, FALSE FROM made WHERE pattern LIKE '%.%' AND steps >= 1
      UNION ALL SELECT list_name, pattern, action, DATE '{FIRST_DAY}' + a + b + c, TRUE FROM made WHERE pattern LIKE '%.%' AND steps >= 2),
    daily AS (
      SELECT list_name, pattern, listed_on, bool_or(listed) AS listed,
        coalesce(max(action) FILTER (listed), max(action)) AS action FROM events GROUP BY ALL),
    spans AS (
      SELECT list_name, pattern, listed, action, listed_on AS valid_from,
        lead(listed_on) OVER (PARTITION BY list_name, pattern ORDER BY listed_on) AS valid_to FROM daily),
    keys AS (
      SELECT capture_id, fetched_on, host, unnest(list_distinct(list_concat(
        list_transform(range(1, len(string_split(host, '.')) + 1), lambda i: array_to_string(string_split(host, '.')[i:], '.')),
        list_transform(range(1, len(list_filter(string_split(path, '/'), lambda p: p <> '')) + 1),
          lambda i: host || '/' || array_to_string(list_filter(string_split(path, '/'), lambda p: p <> '')[1:i], '/'))))) AS pattern
      FROM captures WHERE host <> ''),
    hits AS (
      SELECT k.capture_id, s.pattern, s.action, s.list_name FROM keys k JOIN spans s
      ON k.pattern = s.pattern AND s.listed AND k.fetched_on >= s.valid_from AND (s.valid_to IS NULL OR k.fetched_on < s.valid_to)),
    best AS (
      SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY length(pattern) DESC, action, list_name) AS place,
        count(*) OVER (PARTITION BY capture_id) AS n FROM hits)
    SELECT c.capture_id AS page_id, c.fetched_on::VARCHAR AS fetched_on, coalesce(b.action, 'none') AS decision, b.pattern, b.list_name,
      coalesce(b.n, 0) AS n_active
    FROM captures c LEFT JOIN best b ON c.capture_id = b.capture_id AND b.place = 1""")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page judged by the list entries in force on its fetch date."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter(captures_of(pages), entries_of(pages)).select(
        F.col("capture_id").alias("page_id"), F.col("fetched_on").cast("string").alias("fetched_on"), "decision", "pattern", "list_name", "n_active"
    )


@query("op4_minhash_dedup")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents at a similarity of 0.85."""
    judged = near_duplicates(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


@query("op7_decontamination", """
    WITH item_words AS (
      SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
    windows AS (
      SELECT DISTINCT item_id, least(len(w), 13) AS size,
        unnest(list_transform(range(1, greatest(len(w) - 12, 1) + 1), lambda i: array_to_string(w[i:i + least(len(w), 13) - 1], ' '))) AS gram
      FROM item_words WHERE len(w) > 0),
    doc_words AS (
      SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
    sizes AS (SELECT DISTINCT size FROM windows),
    grams AS (
      SELECT doc_id, size, unnest(range(1, len(w) - size + 2)) AS pos,
        unnest(list_transform(range(1, len(w) - size + 2), lambda i: array_to_string(w[i:i + size - 1], ' '))) AS gram
      FROM doc_words, sizes WHERE len(w) >= size),
    hits AS (SELECT doc_id, pos, g.size, item_id FROM grams g JOIN windows x ON g.gram = x.gram AND g.size = x.size),
    places AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + size)) AS place FROM (SELECT DISTINCT doc_id, pos, size FROM hits)),
    counted AS (SELECT doc_id, count(*) AS n_hit FROM places GROUP BY doc_id),
    named AS (SELECT doc_id, list_sort(list_distinct(list(item_id::VARCHAR))) AS items FROM hits GROUP BY doc_id)
    SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(c.n_hit, 0)::BIGINT AS n_hit, coalesce(len(n.items), 0)::BIGINT AS n_items,
      sha256(coalesce(array_to_string(n.items, ','), '')) AS items_sha256,
      coalesce(c.n_hit, 0) > 0 AND 20 * coalesce(c.n_hit, 0) >= len(d.w) AS contaminated
    FROM doc_words d LEFT JOIN counted c USING (doc_id) LEFT JOIN named n USING (doc_id)""")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows of 13 words in every document."""
    judged = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return judged.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated",
    )


@query("op10_suffix_dedup")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strings of 100 bytes that also start earlier, removed from every document."""
    judged = repeated_bytes(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query("op5_toxicity")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from labels outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_toxicity(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


@query("op6_quality")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learned from labels outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    return quality.score_quality(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


@query("op9_warc", """
    WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
    h AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS hex FROM p),
    bits AS (
      SELECT page_id, payload_bytes, hex, array_to_string(list_transform(range(0, 32), lambda i:
        substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (((
          ('0x' || substr(hex, 1 + (i * 5 // 40) * 10, 10))::BIGINT >> (35 - i * 5 % 40)) & 31)::INT), 1)), '') AS payload_digest FROM h),
    f AS (SELECT hex, min(page_id) AS first_page FROM h GROUP BY hex)
    SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first_page THEN 'response' ELSE 'revisit' END AS record_type,
      CASE WHEN page_id <> first_page THEN first_page END AS refers_to FROM bits JOIN f USING (hex)""")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a record of an archive that was written, read back and merged into one order by URL and time."""
    pages = table(spark, sf_dir, "pages").withColumn(
        "fetched_at", F.timestamp_seconds(F.unix_seconds(F.lit(f"{FIRST_DAY} 00:00:00").cast("timestamp")) + F.col("page_id") * 613 % 100_000_000)
    )
    return warc.archive(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op1_lm_scoring")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probability of every document under a log-bilinear model of the training documents."""
    return score_texts(table(spark, sf_dir, "documents"))


@query("op11_token_counts")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document by the word vocabulary, through a cache that this run starts."""
    import public_tokenizers

    counted = count_tokens(
        table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), cache=fresh_path(spark, "token-cache")
    )
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")


@query("op12_importance", f"""
    WITH crc AS (
      SELECT list(list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n) ORDER BY n) AS t
      FROM range(256) r(n)),
    docs AS (SELECT row_number() OVER () AS id, doc_id, regexp_extract_all({DUCK_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
    items AS (SELECT regexp_extract_all({DUCK_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
    used AS (SELECT id, unnest(w) AS word FROM docs),
    wanted AS (SELECT unnest(w) AS word FROM items),
    coded AS (
      SELECT word, xor(list_reduce(
          list_transform(range(1, strlen(word) + 1), lambda i: ('0x' || substr(hex(word), (2 * i - 1)::INT, 2))::BIGINT),
          lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8), 4294967295), 4294967295) % 10000 AS bucket
      FROM (SELECT DISTINCT word FROM (SELECT word FROM used UNION ALL SELECT word FROM wanted)), crc),
    s AS (SELECT bucket, count(*) AS s FROM used JOIN coded USING (word) GROUP BY bucket),
    t AS (SELECT bucket, count(*) AS t FROM wanted JOIN coded USING (word) GROUP BY bucket),
    gain AS (
      SELECT bucket, floor(1000 * ln(((coalesce(t, 0) + 1) * ((SELECT sum(s) FROM s) + 10000))::DOUBLE
        / ((s + 1) * (coalesce((SELECT sum(t) FROM t), 0) + 10000))::DOUBLE))::BIGINT AS gain
      FROM s LEFT JOIN t USING (bucket)),
    sums AS (SELECT id, sum(gain)::BIGINT AS total, count(*) AS n FROM used JOIN coded USING (word) JOIN gain USING (bucket) GROUP BY id),
    weighed AS (
      SELECT doc_id, len(w)::BIGINT AS n_features, coalesce((total - ((total % n) + n) % n) // n, 0)::BIGINT AS weight,
        ('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h FROM docs LEFT JOIN sums USING (id)),
    scored AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM weighed),
    placed AS (
      SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST) AS place,
        count(*) FILTER (n_features >= 20) OVER () AS n FROM scored)
    SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * n // 100 THEN place END AS rank FROM placed""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the documents drawn towards the words of the benchmark."""
    drawn = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


_NEAREST = """
    a{i} AS MATERIALIZED (
      SELECT id, min({{'d': list_inner_product(k.v, k.v) - 2 * list_inner_product(k.v, c.v) + list_inner_product(c.v, c.v), 'c': c.c}}) AS best
      FROM kept k, c{i} c GROUP BY id)"""
_MOVED = """
    p{i} AS (SELECT best.c AS c, unnest(v)::BIGINT AS x, generate_subscripts(v, 1) AS pos FROM a{i} JOIN kept USING (id)),
    m{i} AS (SELECT c, pos, sum(x)::BIGINT AS s, count(*) AS n FROM p{i} GROUP BY c, pos),
    c{j} AS MATERIALIZED (
      SELECT c.c, coalesce(m.v, c.v) AS v FROM c{i} c
      LEFT JOIN (SELECT c, list(((s - ((s % n) + n) % n) // n)::DOUBLE ORDER BY pos) AS v FROM m{i} GROUP BY c) m ON m.c = c.c)"""


@query("op13_centroids", """
    WITH kept AS MATERIALIZED (
      SELECT row_number() OVER () AS id, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
      WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    c0 AS MATERIALIZED (
      SELECT row_number() OVER (ORDER BY sha256('2:' || coalesce(vec_id::VARCHAR, '')), v) - 1 AS c, v FROM kept QUALIFY c < 40),"""
       + ",".join(_NEAREST.format(i=i) + "," + _MOVED.format(i=i, j=i + 1) for i in range(5)) + "," + _NEAREST.format(i=5) + """,
    far AS (SELECT id, best.c AS c, best.d::BIGINT AS d FROM a5),
    sums AS (SELECT c, sum(d)::BIGINT AS s FROM far GROUP BY c)
    SELECT vec_id, c::INT AS cluster, d AS distance, s AS cluster_inertia, (SELECT sum(d)::BIGINT FROM far) AS inertia,
      sha256(array_to_string(list_transform(c5.v, lambda x: x::BIGINT::VARCHAR), ',')) AS centroid_sha256
    FROM far JOIN kept USING (id) JOIN sums USING (c) JOIN c5 USING (c)""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's cluster after five rounds of forty centroids."""
    found = cluster_vectors(table(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")

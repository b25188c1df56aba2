"""Queries over files: scalars, filters, scan counters, chunking."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import files as ff
from corpusloom.functions import text as tx
from corpusloom.operators import chunking as ch
from corpusloom.operators import filters as fl
from corpusloom.operators import metrics as mt
from corpusloom.operators.index import enrich_file_dims
from corpusloom.options import EXCLUDED_DIRS, EXCLUDED_GLOBS, ChunkBudgets, IndexOptions
from corpusloom.plans import oracle as o
from corpusloom.plans import views as v
from corpusloom.plans.registry import query
from corpusloom.session import spread

OPTIONS = IndexOptions(max_file_kb=16, max_chunks=None, binary_sample=ff.BINARY_SAMPLE)  # the twins judge by the reference's sample
LONG = "long"


def named_file(spark, sf):
    return v.corpus(spark, sf).select("doc_id", "path", ff.file_name(F.col("path")).alias("n"))


@query("extension", sql=f"SELECT doc_id, {o.extension('file_name')} AS extension FROM named")
def extension(spark, sf):
    return named_file(spark, sf).select("doc_id", ff.extension(F.col("n")).alias("extension"))


@query("path_parts", sql="SELECT doc_id, file_name, folder FROM named")
def path_parts(spark, sf):
    return v.named(spark, sf).select("doc_id", "file_name", "folder")


@query("language", sql="SELECT doc_id, language FROM named")
def language(spark, sf):
    return v.named(spark, sf).select("doc_id", "language")


@query("file_type", sql=f"SELECT doc_id, {o.file_type('file_name')} AS file_type FROM named")
def file_type(spark, sf):
    return named_file(spark, sf).select("doc_id", ff.file_type(F.col("n")).alias("file_type"))


@query(
    "file_type_attached",
    sql=f"SELECT doc_id, {o.file_type_attached('file_name')} AS file_type, {o.attached_extension('file_name')} AS dotted FROM named",
)
def file_type_attached(spark, sf):
    return named_file(spark, sf).select(
        "doc_id", ff.file_type_attached(F.col("n")).alias("file_type"), ff.attached_extension(F.col("n")).alias("dotted")
    )


@query(
    "ecosystem_language",
    sql=f"""SELECT doc_id, CASE p WHEN 'java' THEN CASE WHEN language = 'java' THEN language ELSE 'java-ecosystem' END
        WHEN 'node' THEN CASE WHEN language IN ('javascript', 'typescript') THEN language ELSE 'node-ecosystem' END
        WHEN 'python' THEN CASE WHEN language = 'python' THEN language ELSE 'python-ecosystem' END ELSE language END AS language
        FROM (SELECT *, {o.pick(v.PROJECTS, 'doc_id')} AS p FROM named)""",
)
def ecosystem_language(spark, sf):
    return v.named(spark, sf).select(
        "doc_id", ff.ecosystem_language(F.col("language"), v.pick(v.PROJECTS, F.col("doc_id"))).alias("language")
    )


@query("chunk_id", sql="SELECT doc_id, path || '::chunk-' || (doc_id % 7) AS id FROM corpus")
def chunk_id(spark, sf):
    return v.corpus(spark, sf).select("doc_id", ff.chunk_id(F.col("path"), F.col("doc_id") % 7).alias("id"))


@query(
    "embedding_input",
    sql=f"""SELECT doc_id, md5(concat_ws(chr(10), path, file_name, extension, folder, language, {o.file_type('file_name')},
        '', '', 'java', content)) AS input_md5 FROM corpus_chunks""",
)
def embedding_input(spark, sf):
    name = ff.file_name(F.col("path"))
    empty = F.lit("")
    whole = ff.embedding_input(
        F.col("path"), name, ff.extension(name), ff.folder(F.col("path")), ff.language(name), ff.file_type(name),
        empty, empty, F.lit("java"), F.col("content"),
    )
    return v.corpus(spark, sf).select("doc_id", F.md5(whole).alias("input_md5"))


@query("filter_size", sql="SELECT doc_id, size FROM dirty WHERE size <= 16384")
def filter_size(spark, sf):
    return fl.filter_size(v.dirty(spark, sf), 16).select("doc_id", "size")


@query("filter_empty", sql=f"SELECT doc_id, size FROM dirty WHERE {o.trim('content')} <> ''")
def filter_empty(spark, sf):
    return fl.filter_empty(v.dirty(spark, sf)).select("doc_id", "size")


@query(
    "filter_binary",
    sql=r"""SELECT doc_id, size FROM (SELECT *, left(content, 4096) AS s FROM dirty) WHERE NOT (contains(s, chr(0)) OR
        (length(s) - length(regexp_replace(s, '[\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g'))) / greatest(length(s), 1) > 0.08)""",
)
def filter_binary(spark, sf):
    return fl.filter_binary(v.dirty(spark, sf), ff.BINARY_SAMPLE).select("doc_id", "size")


@query("filter_glob", sql=r"SELECT doc_id, path FROM dirty WHERE NOT regexp_matches(path, '(?i)^(?:.*/[^/]*\.bin|.*/[^/]*\.class|.*/[^/]*\.jar|.*/[^/]*\.lock)$')")
def filter_glob(spark, sf):
    return fl.filter_glob(v.dirty(spark, sf), EXCLUDED_GLOBS).select("doc_id", "path")


@query(
    "filter_dirs",
    sql=f"SELECT doc_id, path FROM dirty WHERE NOT list_has_any(string_split(path, '/')[:-2], {o.texts((*EXCLUDED_DIRS, 'src3'))})",
)
def filter_dirs(spark, sf):
    return fl.filter_dirs(v.dirty(spark, sf), (*EXCLUDED_DIRS, "src3")).select("doc_id", "path")


@query("scan_disposition", sql="SELECT doc_id, path, disposition FROM dispositions")
def scan_disposition(spark, sf):
    return fl.scan_disposition(v.dirty(spark, sf), OPTIONS).select("doc_id", "path", "disposition")


@query("keep_files", sql="SELECT doc_id, path FROM dispositions WHERE disposition = 'kept'")
def keep_files(spark, sf):
    return fl.keep_files(v.dirty(spark, sf), OPTIONS).select("doc_id", "path")


@query(
    "scan_stats",
    sql="""SELECT count(*) AS considered_files, count(*) FILTER (disposition = 'size') AS skipped_by_size,
        count(*) FILTER (disposition = 'empty') AS skipped_empty, count(*) FILTER (disposition = 'binary') AS skipped_binary,
        count(*) FILTER (disposition = 'glob') AS skipped_by_glob, CAST(0 AS BIGINT) AS read_errors,
        count(*) FILTER (disposition = 'kept') AS kept_files, max(d) AS visited_directories,
        count(*) + max(d) - 1 AS visited_entries
        FROM dispositions, (SELECT count(DISTINCT folder) AS d FROM (SELECT unnest(list_transform(range(0, len(parts)),
            lambda n: array_to_string(parts[1:n], '/'))) AS folder FROM (SELECT string_split(path, '/') AS parts FROM dispositions)))""",
)
def scan_stats(spark, sf):
    return fl.scan_stats(fl.scan_disposition(v.dirty(spark, sf), OPTIONS))


@query(
    "error_samples",
    sql="SELECT path, disposition AS reason FROM dispositions WHERE disposition IN ('size', 'binary') ORDER BY path LIMIT 12",
)
def error_samples(spark, sf):
    seen = fl.scan_disposition(v.dirty(spark, sf), OPTIONS)
    return fl.error_samples(seen, F.col("disposition"), F.col("disposition").isin("size", "binary"))


CAP_SQL = """SELECT path, chunk_count, chunks_before FROM (SELECT *, CAST(sum(chunk_count) OVER (ORDER BY path) - chunk_count AS BIGINT)
    AS chunks_before FROM (SELECT path, CAST(ceil(length(content) / 2048) AS BIGINT) AS chunk_count FROM corpus) WHERE chunk_count > 0)
    WHERE chunks_before < 500"""


def counted(spark, sf):
    return v.corpus(spark, sf).select("path", F.ceil(F.length("content") / 2048).cast(LONG).alias("chunk_count"))


@query("cap_chunks", sql=CAP_SQL)
def cap_chunks(spark, sf):
    return fl.running_cap(counted(spark, sf), 500)


@query("running_cap", sql=CAP_SQL.replace("500", "10000000"))
def running_cap(spark, sf):
    """A cap above the top-n limit: running sums by range."""
    return fl.running_cap(counted(spark, sf), 10_000_000)


@query("enrich_file_dims", sql="SELECT doc_id, path, coalesce((" + o.LANGUAGES + ")[extension], 'text') AS language FROM named")
def enrich(spark, sf):
    pairs = F.create_map(*[F.lit(x) for item in ff.LANGUAGE_BY_EXTENSION.items() for x in item])
    dims = spark.range(1).select(F.explode(pairs).alias("extension", "language"))
    rows = v.named(spark, sf).select("doc_id", "path", "extension")
    return enrich_file_dims(rows, dims).select("doc_id", "path", "language")


@query(
    "project_type",
    sql="""SELECT workspace, CASE WHEN bool_or(name IN ('pom.xml', 'build.gradle')) THEN 'java'
        WHEN bool_or(name = 'package.json') THEN 'node' WHEN bool_or(name IN ('pyproject.toml', 'requirements.txt')) THEN 'python'
        WHEN bool_or(name = 'Cargo.toml') THEN 'rust' WHEN bool_or(name = 'go.mod') THEN 'go' ELSE 'generic' END AS project_type
        FROM listing GROUP BY workspace""",
)
def project_type(spark, sf):
    return mt.project_type(v.listing(spark, sf))


LISTED = """SELECT path FROM (SELECT replace(trim(CASE WHEN doc_id % 5 = 0 THEN '/' || path WHEN doc_id % 7 = 0 THEN './' || path
    WHEN doc_id % 2 = 0 THEN ' ' || replace(path, '/', '\\') || ' ' WHEN doc_id % 9 = 0 THEN path || ' (copy)' ELSE path END), '\\', '/') AS path
    FROM corpus JOIN labels USING (doc_id) WHERE toxic = 1) WHERE NOT starts_with(path, '/') AND regexp_matches(path, '^[A-Za-z0-9_./-]+$')
    AND NOT list_has_any(string_split(path, '/'), ['.', '..'])""".replace("\\\\", "\\")


@query("path_in_filter", sql=f"SELECT doc_id, path FROM corpus WHERE path IN ({LISTED})")
def path_in_filter(spark, sf):
    doc, path = F.col("doc_id"), F.col("path")
    toxic = v.table(spark, sf, "labels").where("toxic = 1").select("doc_id")
    entry = (
        F.when(doc % 5 == 0, F.concat(F.lit("/"), path))
        .when(doc % 7 == 0, F.concat(F.lit("./"), path))
        .when(doc % 2 == 0, F.concat(F.lit(" "), F.replace(path, F.lit("/"), F.lit("\\")), F.lit(" ")))
        .when(doc % 9 == 0, F.concat(path, F.lit(" (copy)")))
        .otherwise(path)
    )
    listed = v.corpus(spark, sf).join(toxic, "doc_id").select(entry.alias("path"))
    return fl.path_in_filter(v.corpus(spark, sf).select("doc_id", "path"), listed)


@query(
    "collection_id",
    sql=rf"""SELECT doc_id, CASE WHEN s = '' THEN 'workspace' ELSE s END || '_' || (1710000000000 + doc_id) AS collection_id
        FROM (SELECT doc_id, lower(trim(regexp_replace(regexp_replace(regexp_replace(r, '[{o.WS}-]+', '_', 'g'),
          '[^A-Za-z0-9_]', '_', 'g'), '_+', '_', 'g'), '_')) AS s FROM (SELECT doc_id, {o.trim("CASE WHEN doc_id % 10 = 0 THEN '()' ELSE source || '  -' || lang || ' (' || (doc_id % 13) || ')' END")} AS r FROM documents))""",
)
def collection_id(spark, sf):
    doc = F.col("doc_id")
    root = F.concat(
        F.lit("/ws/"),
        F.when(doc % 10 == 0, F.lit("()")).otherwise(
            F.concat("source", F.lit("  -"), "lang", F.lit(" ("), (doc % 13).cast("string"), F.lit(")"))
        ),
        F.lit("/"),
    )
    return v.table(spark, sf, "documents").select(
        "doc_id", ff.collection_id(root, F.lit(1710000000000) + doc).alias("collection_id")
    )


FLAT = o.trim(f"regexp_replace(text, '[{o.WS}]+', ' ', 'g')")


@query(
    "query_preview",
    sql=f"SELECT doc_id, CASE WHEN length(f) <= 140 THEN f ELSE left(f, 140) || '...' END AS preview FROM (SELECT doc_id, {FLAT} AS f FROM documents)",
)
def query_preview(spark, sf):
    docs = spread(v.table(spark, sf, "documents").select("doc_id", "text"))
    return docs.select("doc_id", tx.query_preview(F.col("text")).alias("preview"))


@query(
    "hit_label",
    sql="""SELECT doc_id, coalesce(CASE WHEN doc_id % 6 = 0 THEN NULL ELSE path END, 'document-' || (doc_id + 1)) ||
        CASE WHEN doc_id % 4 = 0 THEN '' ELSE ' [chunk ' || (doc_id % 4 + 1) || '/9]' END AS label FROM corpus""",
)
def hit_label(spark, sf):
    doc = F.col("doc_id")
    path = F.when(doc % 6 != 0, F.col("path"))
    index = F.when(doc % 4 != 0, doc % 4)
    return v.corpus(spark, sf).select("doc_id", ff.hit_label(path, index, F.lit(9), doc + 1).alias("label"))


@query(
    "nonblank_query",
    sql=f"SELECT doc_id FROM (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN chr(160) || chr(9) ELSE text END AS t FROM documents) WHERE {o.trim('t')} <> ''",
)
def nonblank_query(spark, sf):
    blank = F.when(F.col("doc_id") % 5 == 0, F.lit("\xa0\t")).otherwise(F.col("text"))
    return fl.nonblank_queries(v.table(spark, sf, "documents").select("doc_id", blank.alias("text"))).select("doc_id")


# ---- chunking ----------------------------------------------------------------

CHUNK_COLUMNS = ("doc_id", "chunk_index", "chunk_count", "chunk_start", "chunk_end")


def bounds(chunks, *more):
    return chunks.select(
        "doc_id", *[F.col(c).cast(LONG).alias(c) for c in CHUNK_COLUMNS[1:]], F.md5("text").alias("text_md5"), *more
    )


LINES_SQL = """SELECT doc_id, CAST(chunk_index AS BIGINT) AS chunk_index, CAST(chunk_count AS BIGINT) AS chunk_count,
    chunk_start, chunk_end, md5(text) AS text_md5 FROM line_chunks"""


@query("chunk_lines", sql=LINES_SQL)
def chunk_lines(spark, sf):
    return bounds(ch.chunk_lines(v.corpus(spark, sf).select("doc_id", "content"), entities=False))


@query(
    "split_oversized",
    sql="""SELECT doc_id, i // 256 AS chunk_index, CAST(ceil(length(content) / 256) AS BIGINT) AS chunk_count, i AS chunk_start,
        least(i + 256, length(content)) AS chunk_end, md5(substr(content, i + 1, 256)) AS text_md5
        FROM (SELECT doc_id, content, unnest(range(0, length(content), 256)) AS i FROM corpus)""",
)
def split_oversized(spark, sf):
    return bounds(ch.split_oversized(v.corpus(spark, sf).select("doc_id", "content"), 64, entities=False))


SMALL = ChunkBudgets(target=80, max=100, min=40, fallback=60)


@query(
    "merge_small",
    sql=f"""SELECT doc_id, CAST(i - 1 AS BIGINT) AS chunk_index, CAST(len(k) AS BIGINT) AS chunk_count, k[i].s AS chunk_start, k[i].e AS chunk_end,
        md5(substr(content, k[i].s + 1, k[i].e - k[i].s)) AS text_md5 FROM (SELECT *, unnest(range(1, len(k) + 1)) AS i FROM
        (SELECT doc_id, content, list_append(m.k, {{'s': m.s, 'e': m.e}}) AS k FROM (SELECT doc_id, content, {o.merged('sp', 40, 80)} AS m FROM
        (SELECT doc_id, content, {o.finished('f')} AS sp FROM (SELECT doc_id, content, {o.spans('content', 60, 100)} AS f FROM corpus)) WHERE len(sp) > 0)))""",
)
def merge_small(spark, sf):
    return bounds(ch.merged_lines(v.corpus(spark, sf).select("doc_id", "content"), SMALL, entities=False))


@query(
    "chunk_emit",
    sql=f"""SELECT doc_id, CAST(chunk_index AS BIGINT) AS chunk_index, path || '::chunk-' || chunk_index AS id, md5(text) AS text_md5,
        {o.entities('text')} AS keyword_entities FROM line_chunks""",
)
def chunk_emit(spark, sf):
    docs = v.corpus(spark, sf).select("doc_id", "path", "content")
    return ch.chunk_lines(docs).select(
        "doc_id", F.col("chunk_index").cast(LONG).alias("chunk_index"),
        ff.chunk_id(F.col("path"), F.col("chunk_index")).alias("id"), F.md5("text").alias("text_md5"), "keyword_entities",
    )


@query("chunk_plain", sql='SELECT doc_id, chunk_start AS "start", chunk_end AS "end", md5(text) AS text_md5 FROM line_chunks')
def chunk_plain(spark, sf):
    return ch.chunk_plain(v.corpus(spark, sf).select("doc_id", "content")).select(
        "doc_id", F.col("start").cast(LONG).alias("start"), F.col("end").cast(LONG).alias("end"),
        F.md5("text").alias("text_md5"),
    )


# Line starts that open a declaration, written out for the twin.
OPENS = (
    "(?:export\\s|import\\s|from\\s|class\\s|interface\\s|enum\\s|struct\\s|type\\s|function\\s|async\\s|def\\s|const\\s|let\\s"
    "|var\\s|public\\s|private\\s|protected\\s|static\\s)"
)


@query(
    "chunk_structured",
    sql=f"""SELECT doc_id, CAST(i - 1 AS BIGINT) AS chunk_index, CAST(len(k) AS BIGINT) AS chunk_count, k[i].s AS chunk_start, k[i].e AS chunk_end,
        md5(substr(content, k[i].s + 1, k[i].e - k[i].s)) AS text_md5 FROM (SELECT *, unnest(range(1, len(k) + 1)) AS i FROM
        (SELECT doc_id, content, list_append(m.k, {{'s': m.s, 'e': m.e}}) AS k FROM (SELECT doc_id, content, {o.merged('sp', 120, 350)} AS m FROM
        (SELECT doc_id, content, flatten(list_transform(list_filter(u, lambda x: (x.p OR NOT anyp) AND {o.trim('substr(content, x.s + 1, x.e - x.s)')} <> ''),
          lambda x: list_transform(range(x.s, x.e, 2048), lambda p: {{'s': p, 'e': least(p + 2048, x.e)}}))) AS sp FROM
        (SELECT *, len(list_filter(u, lambda x: x.p)) > 0 AS anyp FROM (SELECT doc_id, content, list_transform(pieces, lambda x, i:
          {{'s': coalesce(list_sum(list_transform(pieces[:i - 1], lambda y: length(y))), 0)::BIGINT,
            'e': list_sum(list_transform(pieces[:i], lambda y: length(y)))::BIGINT, 'p': regexp_matches(x, '^{OPENS}')}}) AS u
          FROM (SELECT doc_id, content, list_filter(string_split(regexp_replace(content, '(?m)^({OPENS})', chr(1) || '\\1', 'g'), chr(1)), lambda x: x <> '') AS pieces
            FROM code)))))))""",
)
def chunk_structured(spark, sf):
    docs = v.code(spark, sf).select("doc_id", "content")
    return bounds(ch.chunk_structured(docs.withColumn("units", ch.declaration_spans(F.col("content"))), entities=False))


@query("keyword_entities", "distinct_entities", sql=f"SELECT doc_id, {o.entities('content')} AS keyword_entities FROM code")
def keyword_entities(spark, sf):
    return spread(v.code(spark, sf)).select(
        "doc_id", F.array_join(tx.keyword_entities(F.col("content")), "|").alias("keyword_entities")
    )


HEADS = (
    f"list_transform(string_split(c, '{{')[1:-2], lambda p: {o.trim('regexp_split_to_array(p, ' + o.text('[;}]') + ')[-1]')})"
)
METHOD = rf"[A-Za-z0-9_<>,\[\]?][{o.WS}]+([A-Za-z_][A-Za-z0-9_]*)[{o.WS}]*\("


@query(
    "java_symbols",
    sql=rf"""SELECT doc_id, coalesce(regexp_extract_all(c, '(?:^|[^A-Za-z0-9_])(?:class|interface|enum|record)[{o.WS}]+([A-Za-z_][A-Za-z0-9_]*)', 1)[-1], '') AS class_name,
        coalesce(list_filter(list_transform(list_filter({HEADS}, lambda h: ends_with(h, ')')), lambda h: regexp_extract(h, '{METHOD}', 1)),
          lambda n: n <> '' AND n NOT IN ('if', 'for', 'while', 'switch', 'catch', 'try', 'return', 'new'))[-1], '') AS method_name
        FROM (SELECT doc_id, content AS c FROM code)""",
)
def java_symbols(spark, sf):
    return spread(v.code(spark, sf)).select(
        "doc_id", tx.java_symbols(F.col("content"), F.length("content")).alias("s")
    ).select("doc_id", "s.class_name", "s.method_name")


# ---- hostile text --------------------------------------------------------------


@query("strip_control", sql=f"SELECT page_id, md5({o.strip_control('chr(7) || html || chr(27)')}) AS clean_md5, length({o.strip_control('chr(7) || html')}) AS n FROM pages")
def strip_control(spark, sf):
    pages = v.table(spark, sf, "pages")
    return pages.select(
        "page_id",
        F.md5(tx.strip_control(F.concat(F.lit("\x07"), F.col("html"), F.lit("\x1b")))).alias("clean_md5"),
        F.length(tx.strip_control(F.concat(F.lit("\x07"), F.col("html")))).cast(LONG).alias("n"),
    )


@query("xml_escape", sql=f"SELECT page_id, md5({o.escape('html')}) AS escaped_md5 FROM pages")
def xml_escape(spark, sf):
    return v.table(spark, sf, "pages").select("page_id", F.md5(tx.xml_escape(F.col("html"))).alias("escaped_md5"))


@query("base_name", sql=f"SELECT conv_id, turn, CAST(pos AS BIGINT) AS pos, {o.base_name('name')} AS base FROM attachments")
def base_name(spark, sf):
    return v.attachments(spark, sf).select("conv_id", "turn", F.col("pos").cast(LONG).alias("pos"), tx.base_name(F.col("name")).alias("base"))


@query(
    "range_label",
    sql="""SELECT conv_id, turn, role || CASE WHEN turn % 3 = 0 THEN '' WHEN turn % 3 = 1 THEN ':' || (turn + 1)
        ELSE ':' || (turn + 1) || '-' || (turn + 4) END AS label FROM conversations""",
)
def range_label(spark, sf):
    turn = F.col("turn")
    start = F.when(turn % 3 != 0, turn + 1)
    end = F.when(turn % 3 == 1, turn + 1).otherwise(turn + 4)
    return v.table(spark, sf, "conversations").select(
        "conv_id", "turn", tx.range_label(F.col("role"), start, end).alias("label")
    )

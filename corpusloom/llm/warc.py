"""WARC archives: written by Spark's text sink, read back, and their index merged into one global order.

Every task writes archives and knows the order of what it wrote: a run, sorted by URL key and time. The runs
meet by ranges of (key, time, page); in each range a loser tree merges the sorted pieces of all runs, which
gives the capture history of every URL in order, ranges after one another.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import size_of
from corpusloom.session import checkpoint, fresh_path

#: Bytes of payload in one archive file on average, and index rows in one range.
ARCHIVE_BYTES = 16 << 20
RANGE_ROWS = 50_000
CRLF = "\r\n"
#: Record id of a page without an id.
NO_PAGE = "<urn:nil>"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32(hexadecimal: Column) -> Column:
    """Upper-case base32 of 40 hexadecimal digits, five of them (four base32 digits) at a time."""
    digits = [F.lpad(F.lower(F.conv(F.substring(hexadecimal, i, 5), 16, 32)), 4, "0") for i in range(1, 40, 5)]
    return F.translate(F.concat(*digits), "0123456789abcdefghijklmnopqrstuv", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def url_key(url: Column) -> Column:
    """Host labels from the right, then port, path and query: captures of a site sort together."""
    rest = F.lower(F.regexp_replace(F.coalesce(url, F.lit("")), r"(?i)^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?", ""))
    host = F.regexp_extract(rest, r"^([^/?#:]*)", 1)
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.regexp_replace(F.substring(rest, F.length(host) + 1, 2147483647), "#.*$", ""))


def records(pages: DataFrame) -> DataFrame:
    """page_id, url, at (ISO time), payload, digest, and refers_to: the smallest page of the same payload, if that is another.

    Of pages that repeat an id and a payload, the row read first is the response. A null id counts as the largest.
    """
    own = pages.select(
        F.monotonically_increasing_id().alias("row"), "page_id", F.coalesce("url", F.lit("")).alias("url"),
        F.date_format("fetched_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("at"), F.coalesce("html", F.lit("")).alias("payload"),
    ).withColumn("digest", F.sha1(F.col("payload").cast("binary")))
    first = own.groupBy("digest").agg(F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "row")).alias("first"), F.count("*").alias("n")).where("n > 1")
    copies = checkpoint(first.select("digest", F.col("first.page_id").alias("first_page"), F.col("first.row").alias("first_row")), "warc-copies")
    return own.join(copies, "digest", "left").withColumn("revisit", F.coalesce(F.col("row") != F.col("first_row"), F.lit(False)))


def urn(page: Column) -> Column:
    """A page id as a record id: text is escaped, null has a name of its own."""
    return F.coalesce(F.concat(F.lit("<urn:page:"), F.url_encode(page.cast("string")), F.lit(">")), F.lit(NO_PAGE))


def page_of(name: Column, kind: str) -> Column:
    """The page id of a record id; null where the page had none."""
    return F.when(name != NO_PAGE, F.url_decode(F.regexp_extract(name, "^<urn:page:(.*)>$", 1))).cast(kind)


def write_warc(pages: DataFrame, path: str, least_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Archives of ``pages`` (page_id, url, html, fetched_at) under ``path``: gzip files of WARC/1.1 records.

    Of records with the same payload of at least ``least_bytes`` bytes, the one with the smallest page_id is a
    response; the others are revisits, which name it and carry no payload. A null html is an empty payload; a
    null page_id is the largest. Ids are integers or text.
    Archives are cut by the bytes of payload, so that one reads into a task whole.
    """
    rows = records(pages).withColumn("revisit", F.col("revisit") & (F.octet_length("payload") >= least_bytes))
    clean = F.regexp_replace(F.col("url"), r"[\x00-\x20\x7F]", "%20")
    size = F.octet_length("payload")
    head = [
        F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), F.when(F.col("revisit"), F.lit("revisit")).otherwise(F.lit("response"))),
        F.concat(F.lit("WARC-Record-ID: "), urn(F.col("page_id"))),
        F.when(F.col("at").isNotNull(), F.concat(F.lit("WARC-Date: "), F.col("at"))),
        F.concat(F.lit("WARC-Target-URI: "), clean),
        F.when(F.col("revisit"), F.lit(f"WARC-Profile: {REVISIT}")),
        F.when(F.col("revisit"), F.concat(F.lit("WARC-Refers-To: "), urn(F.col("first_page")))),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), base32(F.col("digest"))),
        F.concat(F.lit("X-Payload-Length: "), size.cast("string")),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.when(F.col("revisit"), F.lit(0)).otherwise(size).cast("string")),
    ]
    body = F.when(F.col("revisit"), F.lit("")).otherwise(F.col("payload"))
    record = F.concat(F.concat_ws(CRLF, *head), F.lit(CRLF * 2), body)
    total = pages.agg(F.coalesce(F.sum(F.octet_length("html")), F.lit(0))).first()[0]
    files = max(1, -(-int(total) // archive_bytes))
    key = url_key(F.col("url"))
    (
        rows.select(record.alias("value"), key.alias("key"), "at", "page_id")
        .repartition(files, F.xxhash64("page_id", "row")).sortWithinPartitions("key", "at", "page_id")
        .select("value").write.option("lineSep", CRLF * 2).option("compression", "gzip").text(path)
    )


class LoserTree:
    """Merges sorted iterators: the losers of each match stay in the tree, so one step replays one path."""

    def __init__(self, runs: list[Iterator], key):
        self.key, self.runs = key, runs
        self.head = [next(r, None) for r in runs]
        self.size = max(len(runs), 1)
        self.tree = [-1] * self.size
        for i in range(len(runs)):
            self._play(i)

    def _before(self, a: int, b: int) -> bool:
        if self.head[a] is None or self.head[b] is None:
            return self.head[b] is None and (self.head[a] is not None or a < b)
        x, y = self.key(self.head[a]), self.key(self.head[b])
        return x < y or x == y and a < b

    def _play(self, i: int) -> None:
        """Carry run i up; at a node without a loser it waits for its opponent."""
        node = (i + self.size) // 2
        while node > 0:
            if self.tree[node] == -1:
                self.tree[node] = i
                return
            if self._before(self.tree[node], i):
                self.tree[node], i = i, self.tree[node]
            node //= 2
        self.tree[0] = i

    def __iter__(self):
        while self.runs and self.head[self.tree[0]] is not None:
            i = self.tree[0]
            yield self.head[i]
            self.head[i] = next(self.runs[i], None)
            node = (i + self.size) // 2
            while node > 0:
                if self._before(self.tree[node], i):
                    self.tree[node], i = i, self.tree[node]
                node //= 2
            self.tree[0] = i


def parse(data: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, headers, block) of every record; Content-Length alone says where a block ends."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8").split(CRLF)
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at {at}")
        headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
        size = int(headers["Content-Length"])
        stop = end + 4 + size + 4
        yield at, stop - at, headers, data[end + 4:end + 4 + size]
        at = stop


CDX = "key string, at string, page_id string, file string, offset long, length long, url string, payload_bytes long, payload_digest string, record_type string, refers_to string, run string"


def read_index(spark: SparkSession, path: str, id_kind: str = "long") -> DataFrame:
    """One row per record of the archives: where it is and what it is; digests of responses are taken from their payloads.

    ``id_kind`` is the type of the page ids, ``long`` or ``string``.
    """
    import base64
    import gzip
    import hashlib

    def index(batches):
        for batch in batches:
            for file, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                rows = []
                for offset, length, head, block in parse(gzip.decompress(content.as_py())):
                    revisit = head["WARC-Type"] == "revisit"
                    digest = head["WARC-Payload-Digest"][5:] if revisit else base64.b32encode(hashlib.sha1(block).digest()).decode()
                    rows.append({
                        "at": head.get("WARC-Date"), "page_id": head["WARC-Record-ID"], "file": file, "offset": offset, "length": length,
                        "url": head.get("WARC-Target-URI", ""), "payload_bytes": int(head["X-Payload-Length"]) if revisit else len(block),
                        "payload_digest": digest, "record_type": head["WARC-Type"], "refers_to": head["WARC-Refers-To"] if revisit else None, "run": file,
                    })
                kinds = [("at", pa.string()), ("page_id", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()), ("run", pa.string())]
                yield from pa.Table.from_pylist(rows, pa.schema(kinds)).to_batches()

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("path", "content")
    rows = files.mapInArrow(index, CDX.replace("key string, ", "")).withColumns({c: page_of(F.col(c), id_kind) for c in ("page_id", "refers_to")})
    return rows.select(url_key(F.col("url")).alias("key"), *rows.columns)


def merge_index(index: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """The index rows in ranges of (key, at, page_id), each range merged from its runs; ``range_no`` and ``place`` give the order.

    A range is cut inside a key where one has many captures. Of equal (key, at, page_id) the run with the
    smaller name is first. Null times and pages come first.
    """
    n = index.count()
    parts = max(size_of(index), -(-n // range_rows))
    ranged = index.repartitionByRange(parts, "key", "at", "page_id", "run", "offset").sortWithinPartitions("run", "key", "at", "page_id", "offset")
    names = index.columns

    def merge(batches):
        from pyspark import TaskContext

        rows, runs, last = [], [], None
        for batch in batches:  # a range is bounded by ``range_rows``
            for row in batch.to_pylist():
                if row["run"] != last:
                    rows, last = [], row["run"]
                    runs.append(rows)
                rows.append(row)
        order = lambda r: (r["key"], r["at"] or "", r["page_id"] is not None, 0 if r["page_id"] is None else r["page_id"], r["offset"])
        number, place, out = TaskContext.get().partitionId(), 0, []
        for row in LoserTree([iter(r) for r in runs], order):
            out.append({**row, "range_no": number, "place": place})
            place += 1
            if len(out) == 5000:
                yield from pa.Table.from_pylist(out, kinds).to_batches()
                out = []
        if out:
            yield from pa.Table.from_pylist(out, kinds).to_batches()

    kinds = pa.schema([(c, pa.int64() if t == "bigint" else pa.string()) for c, t in index.dtypes] + [("range_no", pa.int64()), ("place", pa.int64())])
    return ranged.mapInArrow(merge, ", ".join(f"{c} {t}" for c, t in index.dtypes) + ", range_no long, place long").select(*names, "range_no", "place")


def archive(pages: DataFrame, path: str | None = None, least_bytes: int = 0) -> DataFrame:
    """Write ``pages`` as WARC, read the archives back and merge their index; see ``write_warc`` and ``merge_index``."""
    spark = pages.sparkSession
    path = path or fresh_path(spark, "warc")
    write_warc(pages, path, least_bytes)
    id_kind = "string" if pages.schema["page_id"].dataType.typeName() == "string" else "long"
    return merge_index(read_index(spark, path, id_kind))

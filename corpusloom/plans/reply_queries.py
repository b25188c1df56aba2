"""Queries over reply streams, request metrics and logs, in batch and streaming."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions.tokens import reply_tokens
from corpusloom.operators import metrics as mt
from corpusloom.plans import oracle as o
from corpusloom.plans import views as v
from corpusloom.plans.registry import query
from corpusloom.session import fresh_path
from corpusloom.sources import files as fs
from corpusloom.sources import frames
from corpusloom.sources import replies as rp
from corpusloom.streaming import jobs, live

LONG = "long"
EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"


def micros(column: str):
    """Microseconds since the epoch, whatever the session time zone."""
    return F.expr(f"timestampdiff(MICROSECOND, {EPOCH}, {column})")


DECODED = "SELECT request_id, seq, token, usage, is_bad FROM decoded"


@query("read_reply_stream", sql=DECODED)
def read_reply_stream(spark, sf):
    return rp.decode_replies(v.fragments(spark, sf))


@query(
    "until_done",
    sql="""SELECT request_id, seq FROM fragments f LEFT JOIN (SELECT request_id, min(seq) AS e FROM fragments WHERE value = 'data: [DONE]'
        GROUP BY request_id) USING (request_id) WHERE e IS NULL OR seq < e""",
)
def until_done(spark, sf):
    return rp.until_done(v.fragments(spark, sf), ["request_id"]).select("request_id", "seq")


TOKENS = "CASE WHEN server_tokens > 0 THEN server_tokens ELSE CAST(round(chars / 3.2::DOUBLE) AS BIGINT) END"
REPLIES = f"""SELECT request_id, part, text, chars, server_tokens, {TOKENS} AS tokens FROM (SELECT request_id, seq // {rp.PART_SPAN} AS part,
    coalesce(string_agg(token, '' ORDER BY seq), '') AS text FROM decoded GROUP BY ALL) JOIN (SELECT request_id, CAST(sum(length(token)) AS BIGINT) AS chars,
    coalesce(arg_max(usage, seq) FILTER (usage > 0), 0) AS server_tokens FROM decoded GROUP BY request_id) USING (request_id)"""


# Lines up to the end mark of their request, which is one of them.
ENDED = f"""lines AS (SELECT f.request_id, f.seq, f.seq // {rp.PART_SPAN} AS part, f.value = 'data: [DONE]' AS is_end, token, usage, ts
        FROM fragments f JOIN events ON event_id = f.seq LEFT JOIN decoded d ON d.request_id = f.request_id AND d.seq = f.seq WHERE starts_with(f.value, 'data:')),
      ends AS (SELECT request_id, min(seq) FILTER (is_end) AS e FROM lines GROUP BY request_id),
      kept AS (SELECT lines.* FROM lines JOIN ends USING (request_id) WHERE e IS NULL OR seq <= e)"""
TOTALS = """CAST(coalesce(sum(length(token)), 0) AS BIGINT) AS chars, coalesce(arg_max(usage, seq) FILTER (usage > 0), 0) AS server_tokens"""


@query(
    "assemble_reply",
    sql=f"""SELECT request_id, part, text, chars, server_tokens, {TOKENS} AS tokens FROM (WITH {ENDED},
        parts AS (SELECT request_id, part, coalesce(string_agg(token, '' ORDER BY seq), '') AS text FROM kept GROUP BY ALL),
        totals AS (SELECT request_id, {TOTALS} FROM kept GROUP BY request_id) SELECT * FROM parts JOIN totals USING (request_id))""",
)
def assemble_reply(spark, sf):
    """Replies up to their end mark."""
    return rp.assemble_replies(rp.decode_marked(v.fragments(spark, sf)))


@query("reply_token_fallback", sql=f"SELECT event_id, {TOKENS} AS tokens FROM (SELECT event_id, event_id % 3 AS server_tokens, length(props) + event_id AS chars FROM events)")
def reply_token_fallback(spark, sf):
    tokens = reply_tokens(F.col("event_id") % 3, F.length("props") + F.col("event_id"))
    return v.table(spark, sf, "events").select("event_id", tokens.alias("tokens"))


@query("request_metrics", sql="SELECT user_id, count(*) AS requests, count(*) FILTER (is_error) AS errors, CAST(round(avg(duration_ms)) AS BIGINT) AS avg_ms FROM requests GROUP BY user_id")
def request_metrics(spark, sf):
    return mt.request_metrics(v.requests(spark, sf), ["user_id"])


@query(
    "metrics_snapshots",
    sql="""SELECT n AS requests, CAST(e AS BIGINT) AS errors, CAST(round(t / n) AS BIGINT) AS avg_ms FROM (SELECT row_number() OVER w AS n,
        sum(is_error::INT) OVER w AS e, sum(duration_ms) OVER w AS t FROM requests WINDOW w AS (ORDER BY event_id)) WHERE n % 10 = 0""",
)
def metrics_snapshots(spark, sf):
    return mt.metrics_snapshots(v.requests(spark, sf), ["event_id"])


@query(
    "idle_requests",
    sql="""SELECT user_id, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us, count(*) AS events FROM (
        SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)
          <= INTERVAL 4 HOUR THEN 0 ELSE 1 END AS n FROM events)) GROUP BY user_id, s""",
)
def idle_requests(spark, sf):
    found = mt.idle_requests(v.table(spark, sf, "events"), "4 hours")
    return found.select("user_id", micros("first_ts").alias("first_us"), micros("last_ts").alias("last_us"), "events")


@query(
    "read_logs",
    sql="""SELECT event_id, '2024-01-01T00:00:00.000Z' AS ts, CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END AS level, 'rag' AS scope,
        'saw ' || event_type AS message, CASE WHEN event_id % 4 <> 0 THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k FROM events""",
)
def read_logs(spark, sf):
    rows = fs.parse_logs(v.log_lines(spark, sf))
    return rows.select("event_id", "ts", "level", "scope", "message", F.try_variant_get("record", "$.k", "bigint").alias("k"))


# ---- streaming -------------------------------------------------------------------
# Each stream runs over the whole table until nothing is left, writes to the
# shared folder and is read back.


def drained(stream, path, mode):
    jobs.write_epochs(stream, path, f"{path}-checkpoint", mode).awaitTermination()
    return path


@query("stream_decode", sql=DECODED)
def stream_decode(spark, sf):
    lines = v.fragments(spark, sf, v.table_stream(spark, sf, "events"))
    path = drained(jobs.stream_decode(lines), fresh_path(spark, "decoded"), "append")
    return spark.read.parquet(path).drop(jobs.EPOCH)


@query("stream_replies", sql=REPLIES)
def stream_replies(spark, sf):
    lines = v.fragments(spark, sf, v.table_stream(spark, sf, "events"))
    path = drained(jobs.stream_replies(jobs.stream_decode(lines)), fresh_path(spark, "replies"), "update")
    return rp.finish_replies(jobs.latest(spark, path, ["request_id", "part"]))


@query(
    "stream_live_replies",
    sql=f"""SELECT request_id, text, chars, server_tokens, ended FROM (WITH {ENDED},
        passed AS (SELECT * FROM kept WHERE epoch_ms(ts) <= (SELECT epoch_ms(max(ts)) - 60000 FROM events))
        SELECT request_id, coalesce(string_agg(token, '' ORDER BY seq), '') AS text, {TOTALS}, bool_or(is_end) AS ended FROM passed GROUP BY request_id)""",
)
def stream_live_replies(spark, sf):
    """Replies as far as the watermark has passed them. Requests last for days in this table, and so does what is remembered of them."""
    events = v.table_stream(spark, sf, "events")
    lines = v.fragments(spark, sf, events, "ts")
    pieces = live.live_replies(rp.decode_marked(lines), idle="60 days", forget="60 days")
    with live.rocksdb(spark):
        path = drained(pieces, fresh_path(spark, "live-replies"), "append")
    return live.whole_replies(spark.read.parquet(path))


FRAME = 512
# What a reader of FRAME bytes at a time takes from the recorded replies: whole lines, none behind an end mark of the same read.
FRAMED = f"""SELECT request_id, frame, place AS seq, token, usage, is_bad, is_end FROM (WITH placed AS (
      SELECT request_id, seq, value, sum(strlen(value) + 1) OVER w AS place, row_number() OVER w AS nth, count(*) OVER (PARTITION BY request_id) AS n
      FROM fragments WINDOW w AS (PARTITION BY request_id ORDER BY seq ROWS UNBOUNDED PRECEDING)),
    framed AS (
      SELECT *, CAST((place - 1) // {FRAME} AS BIGINT) AS frame, value = 'data: [DONE]' AS is_end FROM placed WHERE request_id % 5 <> 0 OR nth < n),
    marked AS (SELECT *, min(place) FILTER (is_end) OVER (PARTITION BY request_id, frame) AS e FROM framed)
    SELECT m.request_id, frame, CAST(place AS BIGINT) AS place, coalesce(token, '') AS token, coalesce(usage, 0) AS usage,
      coalesce(is_bad, false) AS is_bad, is_end
    FROM marked m LEFT JOIN decoded d ON d.request_id = m.request_id AND d.seq = m.seq
    WHERE (e IS NULL OR place <= e) AND starts_with(value, 'data:'))"""


def recorded(spark, sf) -> str:
    """A folder with the bytes of every request's lines; those of every fifth request end without a line feed."""
    lines = v.fragments(spark, sf).groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("seq", "value"))).alias("lines"))
    text = F.array_join(F.transform("lines", lambda x: x["value"]), "\n")
    path = fresh_path(spark, "recorded")
    whole = lines.select("request_id", F.when(F.col("request_id") % 5 == 0, text).otherwise(F.concat(text, F.lit("\n"))).alias("value"))
    frames.write_replies(whole, path)
    return path


@query("read_reply_frames", sql=FRAMED)
def read_reply_frames(spark, sf):
    return _decoded_frames(frames.read_reply_frames(spark, recorded(spark, sf), FRAME))


@query("stream_reply_frames", sql=FRAMED)
def stream_reply_frames(spark, sf):
    """The same rows through a stream that reads the folder by offsets."""
    lines = frames.stream_reply_frames(spark, recorded(spark, sf), FRAME)
    path = drained(_decoded_frames(lines), fresh_path(spark, "frames"), "append")
    return spark.read.parquet(path).drop(jobs.EPOCH)


def _decoded_frames(lines):
    return rp.decode_marked(lines.withColumn("request_id", F.col("request_id").cast("long")))


@query(
    "stream_metrics",
    sql="""SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS window_us, count(*) AS requests, count(*) FILTER (is_error) AS errors,
        CAST(round(avg(duration_ms)) AS BIGINT) AS avg_ms FROM requests GROUP BY ALL""",
)
def stream_metrics(spark, sf):
    requests = v.requests(spark, sf, v.table_stream(spark, sf, "events"))
    path = drained(jobs.stream_metrics(requests), fresh_path(spark, "metrics"), "update")
    newest = jobs.latest(spark, path, ["window_start"])
    return newest.select(micros("window_start").alias("window_us"), "requests", "errors", "avg_ms")


@query(
    "stream_sessions",
    sql=f"""SELECT session_id, {o.title('t')} AS title, messages, created_at FROM (SELECT conv_id AS session_id, arg_min(text, turn) AS t,
        count(*) AS messages, min(1700000000000 + conv_id * 1000 + turn) AS created_at FROM conversations WHERE conv_id % 10 <> 7 OR conv_id IN
        (SELECT conv_id FROM conversations GROUP BY conv_id HAVING max(turn) < 2) GROUP BY conv_id)""",
)
def stream_sessions(spark, sf):
    """Conversations as they come in; some are deleted at their third turn."""
    conv, turn = F.col("conv_id"), F.col("turn")
    arriving = v.table_stream(spark, sf, "conversations").select(
        conv.alias("session_id"), "turn", "role", "text", (F.lit(1_700_000_000_000) + conv * 1000 + turn).alias("ts"),
        ((conv % 10 == 7) & (turn == 2)).alias("deleted"),
    )
    path = fresh_path(spark, "sessions")
    jobs.stream_sessions(arriving, path, f"{path}-checkpoint").awaitTermination()
    return jobs.sessions_of(spark, path)


@query(
    "stream_idle",
    sql="""SELECT user_id, epoch_us(min(ts)) AS start_us, count(*) AS events FROM (
        SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)
          <= INTERVAL 4 HOUR THEN 0 ELSE 1 END AS n FROM events)) GROUP BY user_id, s
        HAVING max(ts) + INTERVAL 4 HOUR <= (SELECT max(ts) - INTERVAL 1 MINUTE FROM events)""",
)
def stream_idle(spark, sf):
    """Stretches that are over by the time the stream has been read."""
    events = v.table_stream(spark, sf, "events").select("user_id", "ts")
    path = drained(jobs.stream_idle(events, "4 hours"), fresh_path(spark, "idle"), "append")
    return spark.read.parquet(path).select("user_id", micros("start").alias("start_us"), "events")

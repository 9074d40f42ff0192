"""Queries over the driver's tables, one for each operator, and their SQL.

events is the log: stream = event type, arrival = event id, payload = props.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions import events as sse
from tidelog.functions import media, offsets, payload, requests
from tidelog.operators import append as appending
from tidelog.operators import read as reading
from tidelog.operators import scan, streams

NOW = "2024-06-15 00:00:00"


def _events(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/events.parquet")


def _appends(spark: SparkSession, d: str) -> DataFrame:
    """Events as appends: every third has a seq that mostly rises, some bodies are arrays, some are bad."""
    e = _events(spark, d)
    body = F.when(F.col("event_id") % 11 == 0, F.concat(F.lit("["), F.col("props"), F.lit(","), F.col("props"), F.lit("]"))).when(F.col("event_id") % 13 == 0, F.lit("[]")).when(F.col("event_id") % 17 == 0, F.lit("{bad")).otherwise(F.col("props"))
    seq = F.when(F.col("event_id") % 3 == 0, F.format_string("%012d", F.col("event_id") + F.pmod(F.col("event_id") * 7919, F.lit(1000))))
    return e.select(F.col("event_type").alias("stream_id"), F.col("event_id").alias("arrival"), F.lit("application/json; charset=utf-8").alias("content_type"), body.alias("body"), seq.alias("seq"))


def _messages(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d).select(F.col("event_type").alias("stream_id"), F.col("event_id").alias("arrival"), F.col("props").alias("data"))
    return appending.number(e).withColumn("n_bytes", F.octet_length("data"))


def _turns(spark: SparkSession, d: str) -> DataFrame:
    c = spark.read.parquet(f"{d}/conversations.parquet")
    return c.select(F.col("conv_id").cast("string").alias("stream_id"), (F.col("turn") + 1).alias("idx"), "role", F.coalesce("text", F.lit("")).alias("data")).withColumn("n_bytes", F.octet_length("data"))


def log_offsets(spark, d):
    return _messages(spark, d).select("stream_id", "arrival", "idx", "offset")


def stream_head(spark, d):
    s = _events(spark, d).select(F.col("event_type").alias("stream_id")).distinct()
    return streams.head(s, _messages(spark, d)).select("stream_id", "tail", "next_offset")


def catchup_page(spark, d):
    return reading.catch_up(_messages(spark, d), "0000000010", 500)


def page_rows(spark, d):
    return reading.page(reading.after(_messages(spark, d), "0000000010"), 500).select("stream_id", "idx", "offset", "data")


def all_pages(spark, d):
    return reading.pages(_messages(spark, d), 300).groupBy("stream_id", "page").agg(F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"), F.sum("n_bytes").cast("long").alias("bytes"))


def seq_gate(spark, d):
    return appending.sequence_gate(_appends(spark, d)).select("stream_id", "arrival", "accepted")


def _streams(spark, d):
    return _events(spark, d).select(F.col("event_type").alias("stream_id")).distinct().select("stream_id", F.lit("application/json").alias("content_type"), F.lit(None).cast("timestamp").alias("expires_at"))


def append_status(spark, d):
    results, _ = appending.append(_appends(spark, d), _streams(spark, d), F.lit(NOW).cast("timestamp"))
    return results.select("stream_id", "arrival", "status")


def append_messages(spark, d):
    _, messages = appending.append(_appends(spark, d), _streams(spark, d), F.lit(NOW).cast("timestamp"))
    return messages.select("stream_id", "arrival", "pos", "idx", "offset", F.col("n_bytes").cast("long").alias("n_bytes"), "data")


def incremental_tail(spark, d):
    """Two batches, the second numbered from the tails that the first left."""
    e = _events(spark, d).select(F.col("event_type").alias("stream_id"), F.col("event_id").alias("arrival"), F.col("props").alias("data"))
    first = appending.number(e.where("arrival % 10 < 4 or arrival < 0"))
    tails = first.groupBy("stream_id").agg(F.max("idx").alias("tail"))
    second = appending.number(e.where("arrival % 10 >= 4"), tails=tails)
    return first.unionByName(second).groupBy("stream_id").agg(F.count(F.lit(1)).alias("n"), F.max("offset").alias("tail_offset"), F.sum(F.when(F.col("arrival") % 10 >= 4, F.col("idx"))).alias("late_idx"), F.sum(F.octet_length("data")).cast("long").alias("bytes"))


def notifications(spark, d):
    """What a subscriber of each stream is told: the tail after each accepted append."""
    rows = appending.decided(_appends(spark, d), _streams(spark, d), F.lit(NOW).cast("timestamp"))
    return rows.where("status = 'ok'").select("stream_id", "arrival", offsets.to_offset(F.col("first") + F.col("n")).alias("next_offset"))


def reader_chunks(spark, d):
    """What a reader that catches up from the start gets, read by read."""
    p = reading.pages(_messages(spark, d), 700).groupBy("stream_id", "page").agg(F.min("idx").alias("first"), F.max("idx").alias("last"), F.sum("n_bytes").cast("long").alias("bytes"))
    tails = p.groupBy("stream_id").agg(F.max("last").alias("tail"))
    return p.join(tails, "stream_id").select("stream_id", "page", offsets.to_offset(F.col("first") - 1).alias("asked"), offsets.to_offset(F.col("last")).alias("next_offset"), "bytes", (F.col("last") == F.col("tail")).alias("up_to_date"))


def source_lives(spark, d):
    """A store's messages through the data source, after one stream was deleted and began anew."""
    import uuid

    from tidelog.sources import datasource
    from tidelog.sources.store import LogStore

    datasource.register(spark)
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    store = LogStore(spark, f"{shared.rstrip('/')}/log-{uuid.uuid4().hex}")
    e = _events(spark, d).select(F.col("event_type").alias("stream_id"), F.col("event_id").alias("arrival"), F.lit("text/plain").alias("content_type"), F.col("props").alias("body"), F.lit(None).cast("string").alias("seq"))
    for (name,) in e.select("stream_id").distinct().where("stream_id is not null").collect():  # the streams of the log: a few
        store.create(name, "text/plain")
    store.append(e)
    store.delete("click")
    store.create("click", "text/plain")
    store.append(e.where("stream_id = 'click' and arrival % 3 = 0"))
    rows = spark.read.format("tidelog").option("path", store.root).load()
    return rows.select("stream_id", "epoch", "idx", "offset", F.decode("data", "utf-8").alias("data"))


def append_files(spark, d):
    """Whole files appended to one stream, in the order of their paths."""
    rows = appending.from_files(spark, f"{d}/{{nation,region,supplier}}.parquet", "files", "application/octet-stream")
    streams_ = spark.createDataFrame([("files", "application/octet-stream", None)], "stream_id string, content_type string, expires_at timestamp")
    _, messages = appending.append(rows, streams_, F.lit(NOW).cast("timestamp"), most=1 << 30)
    return messages.select("stream_id", "arrival", "idx", "offset", "n_bytes", F.sha2("data", 256).alias("sha256"))


def json_wrap(spark, d):
    m = _turns(spark, d).withColumn("data", F.to_json(F.struct("data")))
    return m.groupBy("stream_id").agg(payload.wrapped(F.col("data"), F.col("idx")).alias("body")).select("stream_id", F.md5(F.col("body").cast("binary")).alias("body_md5"), F.octet_length("body").cast("long").alias("n_bytes"))


def text_concat(spark, d):
    m = _turns(spark, d)
    return m.groupBy("stream_id").agg(payload.joined(F.col("data"), F.col("idx")).alias("body")).select("stream_id", F.md5(F.col("body").cast("binary")).alias("body_md5"), F.octet_length("body").cast("long").alias("n_bytes"))


def response_body(spark, d):
    """response_pages under a budget of 2000 bytes a page."""
    return response_pages(spark, d, 2000)


def response_pages(spark, d, limit=requests.CHUNK):
    """The bodies that reading each stream from its start answers, page by page: every message is in one body."""
    m = _messages(spark, d).withColumn("content_type", F.when(F.col("stream_id") == "click", "text/plain").otherwise(" Application/JSON ; q=1"))
    p = reading.pages(m, limit, keep=("content_type", "data"))
    return p.groupBy("stream_id", "page").agg(F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"), payload.body(F.col("content_type"), F.col("data"), F.col("idx")).alias("body"))


def json_flatten(spark, d):
    e = _events(spark, d).groupBy(F.floor(F.col("event_id") / 4).alias("batch")).agg(payload.wrapped(F.col("props"), F.col("event_id")).alias("body"))
    return payload.flatten(e, "body").select("batch", F.col("pos").cast("long").alias("pos"), "data")


def json_explode(spark, d):
    e = _events(spark, d).groupBy(F.floor(F.col("event_id") / 4).alias("batch")).agg(payload.wrapped(F.col("props"), F.col("event_id")).alias("body"))
    return e.select("batch", F.posexplode(payload.raw_elements("body")).alias("pos", "data")).select("batch", F.col("pos").cast("long").alias("pos"), "data")


def json_validity(spark, d):
    return _appends(spark, d).select("arrival", payload.json_status(F.col("body")).alias("status"))


def message_decode(spark, d):
    return _events(spark, d).select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


def _typed(spark, d):
    kinds = F.array(*[F.lit(x) for x in ("application/json", "Application/JSON; charset=utf-8", "text/plain", " text/HTML ;x", "application/octet-stream", "application/jsonl", "")])
    return _events(spark, d).select("event_id", F.element_at(kinds, (F.col("event_id") % 7 + 1).cast("int")).alias("content_type"))


def content_type_class(spark, d):
    t, c = _typed(spark, d), F.col("content_type")
    return t.select("event_id", media.media_type(c).alias("media_type"), media.is_json(c).alias("is_json"), media.same(c, F.lit("TEXT/plain;a=b")).alias("is_plain"), media.event_stream_able(c).alias("sse"), media.framing(c).alias("framing"))


def expiry_filter(spark, d):
    e = _events(spark, d).select("event_id", F.when(F.col("event_id") % 4 != 0, F.col("ts").cast("timestamp")).alias("expires_at"))
    mid = F.lit("2024-01-01 06:00:00").cast("timestamp")
    return streams.alive(e, mid).select("event_id")


def idempotent_create(spark, d):
    e = _events(spark, d)
    kind = F.when(F.col("event_id") % 5 == 0, "TEXT/plain; charset=x").when(F.col("event_id") % 7 == 0, "application/json").otherwise("text/plain")
    r = e.select(F.col("user_id").cast("string").alias("stream_id"), F.col("event_id").alias("arrival"), kind.alias("content_type"), F.when(F.col("event_id") % 50 == 0, F.lit(60)).cast("long").alias("ttl_seconds"), F.lit(None).cast("timestamp").alias("expires_at"))
    return streams.create(r).select("stream_id", "arrival", "status")


def delete_antijoin(spark, d):
    m = _messages(spark, d)
    s = _events(spark, d).select(F.col("event_type").alias("stream_id")).distinct()
    return streams.delete(s, m, s.where("stream_id < 'd'"))[1].groupBy("stream_id").agg(F.count(F.lit(1)).alias("n"))


def stream_epochs(spark, d):
    ops = _events(spark, d).select(F.col("user_id").cast("string").alias("stream_id"), F.col("event_id").alias("arrival"), F.when(F.col("event_id") % 10 == 0, "delete").otherwise("append").alias("op"))
    return streams.epochs(ops)


def sse_frames(spark, d):
    m = _turns(spark, d)
    return m.select("stream_id", "idx", sse.encode(F.col("data"), F.lit(False), offsets.to_offset(F.col("idx")), F.lit("c1")).alias("frame"))


def sse_decode(spark, d):
    m = sse_frames(spark, d).select("stream_id", "idx", F.inline(sse.decoded("frame")))
    return m.select("stream_id", "idx", "pos", "type", F.when(F.col("type") == "data", F.col("data")).alias("data"), "next_offset", "cursor")


def offset_parse(spark, d):
    forms = F.array(*[F.lit(x) for x in ("", "-1", "invalid", "12abc", "-2")])
    e = _events(spark, d).select("event_id", F.when(F.col("event_id") % 2 == 0, offsets.to_offset(F.col("event_id"))).when(F.col("event_id") % 3 == 0, F.col("event_id").cast("string")).otherwise(F.element_at(forms, (F.col("event_id") % 5 + 1).cast("int"))).alias("offset"))
    return e.select("event_id", "offset", offsets.to_index(F.col("offset")).alias("idx"), offsets.status(F.col("offset"), F.lit(500)).alias("status"))


def offset_compare(spark, d):
    a, b = F.col("event_id").cast("string"), (F.col("event_id") * 7 % 1000).cast("string")
    return _events(spark, d).select("event_id", offsets.compare(a, b).cast("long").alias("order"))


def etag(spark, d):
    m = _messages(spark, d)
    next_offset = offsets.to_offset(F.col("idx") + 1)
    return m.select("arrival", requests.etag(F.col("stream_id"), F.col("offset"), next_offset).alias("etag"), requests.up_to_date(next_offset, F.lit("0000000021")).alias("up_to_date"))


def ttl_validate(spark, d):
    forms = F.array(*[F.lit(x) for x in ("", "0", "+5", "007", "x", "-3", "1.5", "3600")])
    e = _events(spark, d).select("event_id", F.element_at(forms, (F.col("event_id") % 8 + 1).cast("int")).alias("ttl"))
    return e.select("event_id", "ttl", requests.ttl_seconds(F.col("ttl")).alias("seconds"))


def expires_validate(spark, d):
    forms = F.array(*[F.lit(x) for x in ("2026-01-15T12:00:00Z", "2026-01-15", "not-a-timestamp", "2026-01-15T12:00:00+02:00", "2026-01-15 12:00:00Z", "2026-13-15T12:00:00Z")])
    e = _events(spark, d).select("event_id", F.element_at(forms, (F.col("event_id") % 6 + 1).cast("int")).alias("header"))
    return e.select("event_id", "header", F.unix_seconds(requests.expires_at(F.col("header"))).alias("at"))


def create_headers(spark, d):
    ttl = F.when(F.col("event_id") % 2 == 0, "60").when(F.col("event_id") % 3 == 0, "bad")
    exp = F.when(F.col("event_id") % 5 == 0, "2026-01-15T12:00:00Z").when(F.col("event_id") % 7 == 0, "bad")
    return _events(spark, d).select("event_id", requests.create_status(ttl, exp).alias("status"))


def read_params(spark, d):
    k = F.col("event_id") % 9
    offs = F.when(k == 0, F.array(F.lit("1"), F.lit("2"))).when(k == 1, F.array(F.lit(""))).when(k == 2, F.array(F.lit("123,456"))).when(k == 3, F.array(F.lit("123 456"))).when(k == 8, F.array().cast("array<string>")).otherwise(F.array(F.lit("0000000001")))
    live = F.when(k == 4, F.array(F.lit("invalid"))).when(k == 5, F.array(F.lit("sse"), F.lit("sse"))).when(k >= 7, F.array(F.lit("long-poll"))).otherwise(F.array().cast("array<string>"))
    return _events(spark, d).select("event_id", requests.read_status(offs, live).alias("status"))


def size_limit(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", requests.too_large(F.col("text"), 3000).alias("too_large"))


def routes(spark, d):
    method = F.element_at(F.array(*[F.lit(x) for x in ("PUT", "POST", "GET", "HEAD", "DELETE", "PATCH")]), (F.col("event_id") % 6 + 1).cast("int"))
    return _events(spark, d).select("event_id", F.coalesce(requests.route(method), F.lit("bad_request")).alias("operation"))


def call_counts(spark, d):
    return routes(spark, d).groupBy("operation").agg(F.count(F.lit(1)).alias("calls"))


def live_poll(spark, d):
    at = F.pmod(F.col("idx") * 37, F.lit(400))
    tails = _messages(spark, d).groupBy("stream_id").agg(F.max("idx").alias("tail"))
    m = _messages(spark, d).join(tails, "stream_id")
    return m.select("arrival", reading.live_status(at, F.col("tail")).cast("long").alias("status"), F.when(at < F.col("tail"), offsets.to_offset(F.col("tail"))).otherwise(offsets.to_offset(at)).alias("next_offset"))


def error_status(spark, d):
    """What each failed append is answered; the codes that no append of these has are dealt over the others by their arrival."""
    from tidelog import errors

    rows = [(i, c, errors.status_of(c), errors.retryable(errors.status_of(c)), errors.client_code(errors.status_of(c)), type(errors.from_transport(errors.client_code(errors.status_of(c)), errors.status_of(c))).__name__) for i, c in enumerate(errors.STATUS)]
    known = spark.createDataFrame(rows, "i long, code string, http int, retry boolean, client string, raised string")  # eight rows
    failed = append_status(spark, d).where("status <> 'ok'").withColumn("i", F.col("arrival") % len(rows))
    own = failed.join(F.broadcast(known.drop("i").withColumnRenamed("code", "status")), "status")
    dealt = failed.select("i").join(F.broadcast(known.withColumnRenamed("code", "status")), "i").withColumn("status", F.concat(F.lit("any "), "status"))
    cols = ["status", "http", "retry", "client", "raised"]
    every = own.select(*cols).unionByName(dealt.select(*cols))
    return every.groupBy(*cols).agg(F.count(F.lit(1)).alias("n")).select("status", "n", F.col("http").cast("long").alias("http"), "retry", "client", "raised")


def backoff_schedule(spark, d):
    from tidelog.streaming.middleware import Backoff

    k = _events(spark, d).select((F.col("event_id") % 12 + 1).alias("attempt")).distinct()
    return k.select("attempt", Backoff(retries=12).wait_ms(F.col("attempt") - 1).alias("wait_ms"))


_M = "SELECT event_type AS stream_id, event_id AS arrival, props AS data, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS idx, octet_length(encode(props)) AS n_bytes FROM events"
_A = """SELECT event_type AS stream_id, event_id AS arrival,
  CASE WHEN event_id % 11 = 0 THEN '[' || props || ',' || props || ']' WHEN event_id % 13 = 0 THEN '[]' WHEN event_id % 17 = 0 THEN '{bad' ELSE props END AS body,
  CASE WHEN event_id % 3 = 0 THEN printf('%012d', event_id + (event_id * 7919) % 1000) END AS seq FROM events"""
_ST = f"""a AS ({_A}), s AS (SELECT *, NOT json_valid(body) OR body = '[]' AS bad FROM a),
g AS (SELECT *, max(seq) OVER (PARTITION BY stream_id ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM s WHERE NOT bad),
r AS (SELECT stream_id, arrival, 'bad_request' AS status FROM s WHERE bad UNION ALL SELECT stream_id, arrival, CASE WHEN seq IS NULL OR top IS NULL OR seq > top THEN 'ok' ELSE 'conflict' END FROM g)"""
_T = "SELECT CAST(conv_id AS VARCHAR) AS stream_id, turn + 1 AS idx, coalesce(text, '') AS data FROM conversations"
_OFF = "printf('%010d', {})"
_PAGED = f"""WITH RECURSIVE m AS MATERIALIZED ({_M}), w(stream_id, idx, page, used) AS (
      SELECT stream_id, idx, CAST(1 AS BIGINT), CAST(n_bytes AS BIGINT) FROM m WHERE idx = 1 UNION ALL
      SELECT m.stream_id, m.idx, CASE WHEN w.used + m.n_bytes <= {{limit}} THEN w.page ELSE w.page + 1 END, CASE WHEN w.used + m.n_bytes <= {{limit}} THEN w.used + m.n_bytes ELSE m.n_bytes END
      FROM w JOIN m ON m.stream_id = w.stream_id AND m.idx = w.idx + 1)"""

SQL = {
    "log_offsets": f"SELECT stream_id, arrival, idx, {_OFF.format('idx')} AS \"offset\" FROM ({_M})",
    "stream_head": f"SELECT stream_id, max(idx) AS tail, {_OFF.format('max(idx)')} AS next_offset FROM ({_M}) GROUP BY 1",
    "catchup_page": f"""WITH m AS ({_M}), t AS (SELECT stream_id, max(idx) AS tail FROM m GROUP BY 1),
      p AS (SELECT *, sum(n_bytes) OVER w AS b, row_number() OVER w AS k FROM m WHERE idx > 10 WINDOW w AS (PARTITION BY stream_id ORDER BY idx)),
      g AS (SELECT stream_id, count(*) AS n, sum(n_bytes) AS bytes, max(idx) AS last FROM p WHERE b <= 500 OR k = 1 GROUP BY 1)
      SELECT stream_id, CASE WHEN 10 > tail THEN 'gone' ELSE 'ok' END AS status, coalesce(n, 0) AS n_messages, CAST(coalesce(bytes, 0) AS BIGINT) AS n_bytes,
      CASE WHEN 10 <= tail THEN {_OFF.format('coalesce(last, 10)')} END AS next_offset, {_OFF.format('tail')} AS tail_offset, 10 <= tail AND coalesce(last, 10) = tail AS up_to_date FROM t LEFT JOIN g USING (stream_id)""",
    "page_rows": f"""SELECT stream_id, idx, {_OFF.format('idx')} AS "offset", data FROM (SELECT *, sum(n_bytes) OVER w AS b, row_number() OVER w AS k FROM ({_M}) WHERE idx > 10 WINDOW w AS (PARTITION BY stream_id ORDER BY idx)) WHERE b <= 500 OR k = 1""",
    "all_pages": _PAGED.format(limit=300) + """ SELECT w.stream_id, page, min(w.idx) AS first_idx, max(w.idx) AS last_idx, CAST(sum(n_bytes) AS BIGINT) AS bytes FROM w JOIN m ON m.stream_id = w.stream_id AND m.idx = w.idx GROUP BY 1, 2""",
    "seq_gate": f"SELECT stream_id, arrival, coalesce(seq IS NULL OR top IS NULL OR seq > top, true) AS accepted FROM (SELECT *, max(seq) OVER (PARTITION BY stream_id ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM ({_A}))",
    "append_status": f"WITH {_ST} SELECT * FROM r",
    "append_messages": f"""WITH {_ST}, k AS (SELECT a.*, CASE WHEN arrival % 11 = 0 THEN 2 ELSE 1 END AS k, props FROM a JOIN r USING (stream_id, arrival) JOIN events e ON e.event_id = arrival WHERE status = 'ok'),
      n AS (SELECT *, coalesce(sum(k) OVER (PARTITION BY stream_id ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS n FROM k),
      x AS (SELECT *, unnest(range(0, k)) AS pos FROM n)
      SELECT stream_id, arrival, CAST(pos AS INTEGER) AS pos, CAST(n + pos + 1 AS BIGINT) AS idx, {_OFF.format('CAST(n + pos + 1 AS BIGINT)')} AS "offset", CAST(octet_length(encode(CASE WHEN k = 2 THEN replace(props, ' ', '') ELSE props END)) AS BIGINT) AS n_bytes, CASE WHEN k = 2 THEN replace(props, ' ', '') ELSE props END AS data FROM x""",
    "incremental_tail": f"""WITH m AS ({_M}), b AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY CASE WHEN arrival % 10 < 4 THEN 0 ELSE 1 END, arrival) AS k FROM m)
      SELECT stream_id, count(*) AS n, {_OFF.format('count(*)')} AS tail_offset, CAST(sum(k) FILTER (arrival % 10 >= 4) AS BIGINT) AS late_idx, CAST(sum(n_bytes) AS BIGINT) AS bytes FROM b GROUP BY 1""",
    "text_concat": f"SELECT stream_id, md5(b) AS body_md5, CAST(octet_length(encode(b)) AS BIGINT) AS n_bytes FROM (SELECT stream_id, string_agg(data, '' ORDER BY idx) AS b FROM ({_T}) GROUP BY 1)",
    "json_wrap": f"SELECT stream_id, md5(b) AS body_md5, CAST(octet_length(encode(b)) AS BIGINT) AS n_bytes FROM (SELECT stream_id, '[' || string_agg('{{\"data\":' || to_json(data) || '}}', ',' ORDER BY idx) || ']' AS b FROM ({_T}) GROUP BY 1)",
    "response_body": _PAGED.format(limit=2000) + """ SELECT w.stream_id, page, min(w.idx) AS first_idx, max(w.idx) AS last_idx,
      CASE WHEN w.stream_id = 'click' THEN string_agg(data, '' ORDER BY w.idx) ELSE '[' || string_agg(data, ',' ORDER BY w.idx) || ']' END AS body FROM w JOIN m ON m.stream_id = w.stream_id AND m.idx = w.idx GROUP BY 1, 2""",
    "json_flatten": "SELECT event_id // 4 AS batch, row_number() OVER (PARTITION BY event_id // 4 ORDER BY event_id) - 1 AS pos, replace(props, ' ', '') AS data FROM events",
    "json_explode": "SELECT event_id // 4 AS batch, row_number() OVER (PARTITION BY event_id // 4 ORDER BY event_id) - 1 AS pos, props AS data FROM events",
    "json_validity": f"SELECT arrival, CASE WHEN NOT json_valid(body) OR body = '[]' THEN 'bad_request' ELSE 'ok' END AS status FROM ({_A})",
    "message_decode": "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",
    "content_type_class": """WITH t AS (SELECT event_id, lower(trim(split_part(['application/json', 'Application/JSON; charset=utf-8', 'text/plain', ' text/HTML ;x', 'application/octet-stream', 'application/jsonl', ''][event_id % 7 + 1], ';', 1))) AS m FROM events)
      SELECT event_id, m AS media_type, m = 'application/json' AS is_json, m = 'text/plain' AS is_plain, m = 'application/json' OR starts_with(m, 'text/') AS sse, CASE WHEN m = 'application/json' THEN 'json' WHEN starts_with(m, 'text/') THEN 'text' ELSE 'binary' END AS framing FROM t""",
    "expiry_filter": "SELECT event_id FROM events WHERE event_id % 4 = 0 OR ts IS NULL OR ts >= TIMESTAMP '2024-01-01 06:00:00'",
    "idempotent_create": """WITH r AS (SELECT CAST(user_id AS VARCHAR) AS stream_id, event_id AS arrival, CASE WHEN event_id % 5 = 0 THEN 'text/plain' WHEN event_id % 7 = 0 THEN 'application/json' ELSE 'text/plain' END AS m, CASE WHEN event_id % 50 = 0 THEN 60 END AS ttl FROM events),
      f AS (SELECT *, min(arrival) OVER (PARTITION BY stream_id) AS a, arg_min(m, arrival) OVER (PARTITION BY stream_id) AS fm, first_value(ttl) OVER (PARTITION BY stream_id ORDER BY arrival) AS ft FROM r)
      SELECT stream_id, arrival, CASE WHEN arrival = a THEN 'created' WHEN m = fm AND ttl IS NOT DISTINCT FROM ft THEN 'ok' ELSE 'conflict' END AS status FROM f""",
    "delete_antijoin": "SELECT event_type AS stream_id, count(*) AS n FROM events WHERE NOT event_type < 'd' GROUP BY 1",
    "stream_epochs": "SELECT CAST(user_id AS VARCHAR) AS stream_id, event_id AS arrival, CASE WHEN event_id % 10 = 0 THEN 'delete' ELSE 'append' END AS op, CAST(coalesce(sum(CASE WHEN event_id % 10 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS epoch FROM events",
    "sse_frames": f"""SELECT stream_id, idx, 'event: data' || chr(10) || 'data: ' || replace(data, chr(10), chr(10) || 'data: ') || chr(10) || chr(10) || 'event: control' || chr(10) || 'data: {{"streamNextOffset":"' || {_OFF.format('idx')} || '","streamCursor":"c1"}}' || chr(10) || chr(10) AS frame FROM ({_T})""",
    "sse_decode": f"""SELECT stream_id, idx, 0 AS pos, 'data' AS type, data, NULL AS next_offset, NULL AS cursor FROM ({_T})
      UNION ALL SELECT stream_id, idx, 1, 'control', NULL, {_OFF.format('idx')}, 'c1' FROM ({_T})""",
    "offset_parse": """WITH o AS (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN printf('%010d', event_id) WHEN event_id % 3 = 0 THEN CAST(event_id AS VARCHAR) ELSE ['', '-1', 'invalid', '12abc', '-2'][event_id % 5 + 1] END AS o FROM events),
      i AS (SELECT *, CASE WHEN o IN ('', '-1') THEN 0 ELSE TRY_CAST(nullif(regexp_extract(o, '^[+-]?[0-9]+'), '') AS BIGINT) END AS idx FROM o)
      SELECT event_id, o AS "offset", idx, CASE WHEN idx IS NULL THEN 'bad_request' WHEN idx < 0 OR idx > 500 THEN 'gone' ELSE 'ok' END AS status FROM i""",
    "offset_compare": "SELECT event_id, CAST(CASE WHEN CAST(event_id AS VARCHAR) < CAST(event_id * 7 % 1000 AS VARCHAR) THEN -1 WHEN CAST(event_id AS VARCHAR) > CAST(event_id * 7 % 1000 AS VARCHAR) THEN 1 ELSE 0 END AS BIGINT) AS \"order\" FROM events",
    "etag": f"SELECT arrival, stream_id || ':' || {_OFF.format('idx')} || ':' || {_OFF.format('idx + 1')} AS etag, idx + 1 = 21 AS up_to_date FROM ({_M})",
    "ttl_validate": "WITH t AS (SELECT event_id, ['', '0', '+5', '007', 'x', '-3', '1.5', '3600'][event_id % 8 + 1] AS ttl FROM events) SELECT event_id, ttl, CASE WHEN regexp_full_match(ttl, '0|[1-9][0-9]*') THEN TRY_CAST(ttl AS BIGINT) END AS seconds FROM t",
    "expires_validate": """WITH t AS (SELECT event_id, ['2026-01-15T12:00:00Z', '2026-01-15', 'not-a-timestamp', '2026-01-15T12:00:00+02:00', '2026-01-15 12:00:00Z', '2026-13-15T12:00:00Z'][event_id % 6 + 1] AS header FROM events)
      SELECT event_id, header, CASE header WHEN '2026-01-15T12:00:00Z' THEN CAST(1768478400 AS BIGINT) WHEN '2026-01-15T12:00:00+02:00' THEN CAST(1768471200 AS BIGINT) END AS at FROM t""",
    "create_headers": """WITH t AS (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN '60' WHEN event_id % 3 = 0 THEN 'bad' END AS a, CASE WHEN event_id % 5 = 0 THEN 'good' WHEN event_id % 7 = 0 THEN 'bad' END AS b FROM events)
      SELECT event_id, CASE WHEN a IS NOT NULL AND b IS NOT NULL OR a = 'bad' OR b = 'bad' THEN 'bad_request' ELSE 'ok' END AS status FROM t""",
    "read_params": "SELECT event_id, CASE WHEN event_id % 9 IN (6, 7) THEN 'ok' ELSE 'bad_request' END AS status FROM events",
    "size_limit": "SELECT doc_id, octet_length(encode(text)) > 3000 AS too_large FROM documents",
    "routes": "SELECT event_id, ['create', 'append', 'read', 'head', 'delete', 'bad_request'][event_id % 6 + 1] AS operation FROM events",
    "call_counts": "SELECT ['create', 'append', 'read', 'head', 'delete', 'bad_request'][event_id % 6 + 1] AS operation, count(*) AS calls FROM events GROUP BY 1",
    "live_poll": f"WITH m AS ({_M}), t AS (SELECT *, max(idx) OVER (PARTITION BY stream_id) AS tail, idx * 37 % 400 AS pos FROM m) SELECT arrival, CAST(CASE WHEN pos < tail THEN 200 ELSE 204 END AS BIGINT) AS status, CASE WHEN pos < tail THEN {_OFF.format('tail')} ELSE {_OFF.format('pos')} END AS next_offset FROM t",
    "error_status": f"""WITH {_ST}, f AS (SELECT status, arrival % 8 AS i FROM r WHERE status <> 'ok'),
      k(i, code, http, retry, client, raised) AS (VALUES (0, 'bad_request', 400, false, 'BAD_REQUEST', 'BadRequest'), (1, 'not_found', 404, false, 'NOT_FOUND', 'NotFound'), (2, 'conflict', 409, false, 'CONFLICT', 'Conflict'), (3, 'gone', 410, false, 'GONE', 'Gone'),
        (4, 'payload_too_large', 413, false, 'UNKNOWN', 'TransportError'), (5, 'too_many_requests', 429, true, 'RATE_LIMITED', 'TransportError'), (6, 'internal', 500, true, 'UNKNOWN', 'TransportError'), (7, 'not_implemented', 501, true, 'UNKNOWN', 'TransportError')),
      x AS (SELECT status, http, retry, client, raised FROM f JOIN k ON code = status UNION ALL SELECT 'any ' || code, http, retry, client, raised FROM f JOIN k USING (i))
      SELECT status, count(*) AS n, CAST(http AS BIGINT) AS http, retry, client, raised FROM x GROUP BY ALL""",
    "backoff_schedule": "SELECT DISTINCT event_id % 12 + 1 AS attempt, CAST(least(100 * pow(2, event_id % 12), 10000) AS BIGINT) AS wait_ms FROM events",
    "notifications": f"""WITH {_ST}, k AS (SELECT r.stream_id, arrival, CASE WHEN arrival % 11 = 0 THEN 2 ELSE 1 END AS k FROM r WHERE status = 'ok')
      SELECT stream_id, arrival, {_OFF.format('CAST(sum(k) OVER (PARTITION BY stream_id ORDER BY arrival) AS BIGINT)')} AS next_offset FROM k""",
    "reader_chunks": _PAGED.format(limit=700)
    + f""", p AS (SELECT w.stream_id, page, min(w.idx) AS a, max(w.idx) AS b, CAST(sum(n_bytes) AS BIGINT) AS bytes FROM w JOIN m ON m.stream_id = w.stream_id AND m.idx = w.idx GROUP BY 1, 2)
      SELECT stream_id, page, {_OFF.format('a - 1')} AS asked, {_OFF.format('b')} AS next_offset, bytes, b = max(b) OVER (PARTITION BY stream_id) AS up_to_date FROM p""",
    "source_lives": f"""WITH e AS (SELECT event_type AS stream_id, event_id, props AS data, CASE WHEN event_type = 'click' THEN 1 ELSE 0 END AS epoch FROM events WHERE event_type IS NOT NULL AND (event_type <> 'click' OR event_id % 3 = 0)),
      n AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY event_id) AS idx FROM e) SELECT stream_id, CAST(epoch AS BIGINT) AS epoch, idx, {_OFF.format('idx')} AS "offset", data FROM n""",
}

#: Without SQL, and held to plain loops by tests: response_pages, append_files.
QUERIES = {k: globals()[k] for k in [*SQL, "response_pages", "append_files"]}

"""Appending batches: checks, JSON flattening, the sequence gate and dense offsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions import media, offsets, payload, requests
from tidelog.operators import scan


def sequence_gate(rows: DataFrame, order: str = "arrival", last: DataFrame | None = None, by: str = "stream_id", span: int = scan.SPAN) -> DataFrame:
    """rows with accepted: seq is absent, or above (bytewise) every earlier seq of its stream.

    A rejected seq never exceeds the running maximum, so the maximum over all earlier rows
    is that over the accepted ones. last: stream_id, last_seq from earlier batches.
    """
    seq = F.nullif(F.col("seq"), F.lit(""))
    run = scan.before(rows, by, order, maxima={"_top": seq}, span=span)
    if last is not None:
        run = run.join(last.select(by, "last_seq"), by, "left").withColumn("_top", F.greatest("_top", "last_seq")).drop("last_seq")
    return run.withColumn("accepted", seq.isNull() | F.col("_top").isNull() | (seq > F.col("_top"))).drop("_top")


def number(rows: DataFrame, order: str = "arrival", tails: DataFrame | None = None, by: str = "stream_id", span: int = scan.SPAN) -> DataFrame:
    """rows with idx and offset: dense from the stream's tail on. tails: stream_id, tail."""
    out = scan.before(rows, by, order, sums={"_n": F.lit(1).cast("long")}, span=span)
    base = F.lit(0)
    if tails is not None:
        out, base = out.join(tails.select(by, "tail"), by, "left"), F.coalesce("tail", F.lit(0))
    return out.withColumn("idx", (F.col("_n") + base + 1).cast("long")).withColumn("offset", offsets.to_offset(F.col("idx"))).drop("_n", "tail")


def _text(body: Column, kind: str) -> Column:
    """A body as text; null where bytes are no UTF-8."""
    return F.try_validate_utf8(body.cast("string")) if kind == "binary" else body


def check(appends: DataFrame, streams: DataFrame, now: Column, most: int = requests.MAX_APPEND, by: tuple[str, ...] = ("stream_id",)) -> DataFrame:
    """appends with status (before the sequence gate), json and, where the status is ok, n: the messages of the body.

    Columns: stream_id, arrival, content_type, body (text or bytes), seq. What depends on
    the body alone is found before rows meet their streams: bodies are shuffled with them
    only where they are asked for. by: what rows and streams are joined by.
    """
    s = streams.select(*by, F.col("content_type").alias("_type"), F.col("expires_at").alias("_expires"))
    is_json = media.is_json(F.col("_type"))
    status = (
        F.when(F.col("_type").isNull() | ~requests.alive(F.col("_expires"), now), "not_found")
        .when(F.col("content_type").isNull() | (F.trim("content_type") == ""), "bad_request")
        .when(~media.same(F.col("content_type"), F.col("_type")), "conflict")
        .when(F.col("_large"), "payload_too_large")
        .when(F.col("_empty"), "bad_request")
        .when(is_json & F.col("_parts").isNull(), "bad_request")
        .otherwise("ok")
    )
    text, large = _text(F.col("body"), dict(appends.dtypes)["body"]), requests.too_large(F.col("body"), most)
    rows = appends.withColumns({"_json": payload.json_status(text), "_large": large, "_empty": F.coalesce(F.octet_length("body"), F.lit(0)) == 0})
    # The messages of a good JSON body, -1 if Spark can't tell them; null for others.
    rows = rows.withColumn("_parts", F.when((F.col("_json") == "ok") & ~F.col("_large"), F.coalesce(F.size(payload.elements(text)).cast("long"), F.lit(-1).cast("long"))))
    rows = rows.join(s, list(by), "left").withColumns({"status": status, "json": F.coalesce(is_json, F.lit(False))})
    n = F.when(F.col("status") == "ok", F.when(~F.col("json"), F.lit(1).cast("long")).when(F.col("_parts") >= 0, F.col("_parts")))
    return rows.withColumn("n", n).drop("_type", "_expires", "_json", "_large", "_empty", "_parts")


def items(kind: str) -> Column:
    """The messages of a good append, of the body's type."""
    body = F.col("body")
    parts = payload.elements(_text(body, kind))
    return F.when(F.col("json"), F.transform(parts, lambda x: x.cast("binary")) if kind == "binary" else parts).otherwise(F.array(body))


def decided(appends: DataFrame, streams: DataFrame, now: Column, tails: DataFrame | None = None, last: DataFrame | None = None, most: int = requests.MAX_APPEND, span: int = scan.SPAN) -> DataFrame:
    """appends with status, json, and of the good ones first, the index before their first message, and n, their messages.

    One pass over the rows: the checks, then the gate and the numbering as windows over
    the same exchange. Bad rows stand in it with no seq and no messages. Where streams are
    large, rows meet the tables of streams by stream and span.
    """
    own, by = appends.columns, ("stream_id",)
    big = scan.large(appends, "stream_id", "arrival", span)

    def side(df: DataFrame) -> DataFrame:
        return df if big is None else scan.spread(df, "stream_id", big)

    rows = appends
    if big is not None:
        rows, by = scan.spanned(appends, "stream_id", "arrival", big), ("stream_id", "_span")
    rows = check(rows, side(streams), now, most, by)
    good, seq = F.col("status") == "ok", F.nullif(F.col("seq"), F.lit(""))
    rows = scan.before(rows, "stream_id", "arrival", maxima={"_top": F.when(good, seq)}, span=span, streams=big)
    if last is not None:
        rows = rows.join(side(last.select("stream_id", F.col("last_seq").alias("_last"))), list(by), "left").withColumn("_top", F.greatest("_top", "_last"))
    late = good & seq.isNotNull() & F.coalesce(seq <= F.col("_top"), F.lit(False))
    rows = rows.withColumn("status", F.when(late, "conflict").otherwise(F.col("status")))
    rows = scan.before(rows, "stream_id", "arrival", sums={"first": F.when(good, F.col("n"))}, span=span, streams=big)
    if tails is not None:
        rows = rows.join(side(tails.select("stream_id", F.col("tail").alias("_tail"))), list(by), "left").withColumn("first", F.col("first") + F.coalesce("_tail", F.lit(0)))
    return rows.select(*own, "status", "json", F.when(good, F.col("first")).cast("long").alias("first"), F.when(good, F.col("n")).alias("n"))


def stored(decided_: DataFrame) -> DataFrame:
    """The messages of decided appends."""
    idx = (F.col("first") + F.col("pos") + 1).cast("long")
    each = decided_.where("status = 'ok'").select("stream_id", "arrival", "first", F.posexplode(items(dict(decided_.dtypes)["body"])).alias("pos", "data"))
    return each.select("stream_id", "arrival", "pos", "data", idx.alias("idx"), offsets.to_offset(idx).alias("offset"), F.octet_length("data").alias("n_bytes"))


def append(appends: DataFrame, streams: DataFrame, now: Column, tails: DataFrame | None = None, last: DataFrame | None = None, most: int = requests.MAX_APPEND, span: int = scan.SPAN) -> tuple[DataFrame, DataFrame]:
    """(appends with their status, the messages stored).

    A JSON array becomes a message an element; its seq counts once, for the whole batch.
    """
    rows = decided(appends, streams, now, tails, last, most, span)
    return rows.drop("first", "n"), stored(rows)


def from_files(spark: SparkSession, path: str, stream_id: str, content_type: str, seq: str | None = None) -> DataFrame:
    """Whole files as appends to one stream, in the order of their paths; executors read them.

    Files are numbered from their names alone; contents follow by a join. The names are
    range-sorted, so numbering them is a place in a sorted part plus the sizes of the parts
    before it. Contents are bytes. Empty files, which Spark's reader passes over, append
    nothing; seq goes with the first file.
    """
    files = spark.read.format("binaryFile").load(path)
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    names = files.select("path").repartitionByRange("path").sortWithinPartitions("path").withColumn("_at", F.monotonically_increasing_id())
    names = names.persist()  # names only: what is in each part must not change between the two uses
    begin, total = [], 0
    for r in names.groupBy(part.alias("p")).count().orderBy("p").collect():  # a row for each part
        begin.append((r["p"], total))
        total += r["count"]
    sizes = spark.createDataFrame(begin, "p long, before long")
    numbered = names.join(F.broadcast(sizes), part == F.col("p")).select("path", (F.col("before") + place + 1).alias("arrival"))
    rows = files.select("path", F.col("content").alias("body")).join(numbered, "path")
    first = F.when(F.col("arrival") == 1, F.lit(seq)).cast("string")
    return rows.select(F.lit(stream_id).alias("stream_id"), "arrival", F.lit(content_type).alias("content_type"), "body", first.alias("seq"))

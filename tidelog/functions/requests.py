"""Checks of request values: time to live, expiry, read parameters, sizes, routes; and response values made from them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Limits and the vocabulary of the wire.
MAX_APPEND, CHUNK = 10 << 20, 1 << 20
LONG_POLL_S, EVENTS_CLOSE_S, EVENTS_POLL_S = 30, 60, 5
HEADERS = ("Stream-TTL", "Stream-Expires-At", "Stream-Seq", "Stream-Cursor", "Stream-Next-Offset", "Stream-Up-To-Date")
LIVE = ("long-poll", "sse")
ROUTES = {"PUT": "create", "POST": "append", "GET": "read", "HEAD": "head", "DELETE": "delete"}
_RFC3339 = r"^\d{4}-\d{2}-\d{2}[Tt]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"


def ttl_seconds(header: Column) -> Column:
    """Whole seconds without sign or leading zeros; null where the header isn't that."""
    return F.when(header.rlike(r"^(0|[1-9][0-9]*)$"), header.try_cast("long"))


def expires_at(header: Column) -> Column:
    """An RFC 3339 instant; null where the header isn't one."""
    return F.when(header.rlike(_RFC3339), F.try_to_timestamp(F.upper(header)))


def create_status(ttl: Column, expires: Column) -> Column:
    """bad_request for both headers at once or a bad one."""
    both = ttl.isNotNull() & expires.isNotNull()
    bad = (ttl.isNotNull() & ttl_seconds(ttl).isNull()) | (expires.isNotNull() & expires_at(expires).isNull())
    return F.when(both | bad, "bad_request").otherwise("ok")


def alive(expires: Column, now: Column) -> Column:
    """Not expired at `now`. A time to live alone never expires a stream."""
    return expires.isNull() | (now <= expires)


def read_status(offsets: Column, lives: Column) -> Column:
    """Of the arrays of offset and live parameters: one of each at most, no empty or malformed offset, a known live mode with an offset."""
    offset, live = F.get(offsets, F.lit(0)), F.get(lives, F.lit(0))
    bad = (
        (F.size(offsets) > 1)
        | (F.size(lives) > 1)
        | F.coalesce((offset == "") | offset.rlike(r"[, \t\n\r]"), F.lit(False))
        | F.coalesce(~live.isin("", *LIVE), F.lit(False))
        | F.coalesce(live.isin(*LIVE) & offset.isNull(), F.lit(False))
    )
    return F.when(bad, "bad_request").otherwise("ok")


def etag(stream_id: Column, offset: Column, next_offset: Column) -> Column:
    return F.concat_ws(":", stream_id, F.coalesce(offset, F.lit("")), next_offset)


def up_to_date(next_offset: Column, tail_offset: Column) -> Column:
    return next_offset == tail_offset


def too_large(body: Column, most: int = MAX_APPEND) -> Column:
    return F.octet_length(body) > (most if most > 0 else MAX_APPEND)


def route(method: Column) -> Column:
    """The operation of a method; null (a bad request) for others."""
    return F.coalesce(*[F.when(method == k, v) for k, v in ROUTES.items()])

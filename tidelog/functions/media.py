"""Content types: only the media type counts, without case, blanks or parameters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT = "application/octet-stream"
JSON = "application/json"


def media_type(content_type: Column) -> Column:
    return F.lower(F.trim(F.split_part(content_type, F.lit(";"), F.lit(1))))


def is_json(content_type: Column) -> Column:
    return media_type(content_type) == JSON


def same(a: Column, b: Column) -> Column:
    return media_type(a) == media_type(b)


def event_stream_able(content_type: Column) -> Column:
    """JSON and text can be sent as server-sent events."""
    return is_json(content_type) | F.startswith(media_type(content_type), F.lit("text/"))


def framing(content_type: Column) -> Column:
    """json: one array; text and binary: plain concatenation."""
    return F.when(is_json(content_type), "json").when(F.startswith(media_type(content_type), F.lit("text/")), "text").otherwise("binary")

"""Offsets: positions after a message, as ten-digit strings that sort bytewise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

START = ("", "-1")
ZERO = "0000000000"


def to_offset(idx: Column) -> Column:
    """Ten digits at least; a longer number keeps all of its digits."""
    return F.format_string("%010d", idx)


def is_start(offset: Column) -> Column:
    return offset.isNull() | offset.isin(*START)


def to_index(offset: Column) -> Column:
    """The number an offset begins with; 0 at the start; null where there is none (a bad request)."""
    digits = F.regexp_extract(offset, r"^[+-]?[0-9]+", 0)
    return F.when(is_start(offset), F.lit(0).cast("long")).otherwise(F.nullif(digits, F.lit("")).try_cast("long"))


def compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1 by bytes."""
    return F.when(a < b, -1).when(a > b, 1).otherwise(0)


def status(offset: Column, tail: Column) -> Column:
    """ok; bad_request where the offset is no number; gone where it lies before the start or beyond the tail."""
    at = to_index(offset)
    return F.when(at.isNull(), "bad_request").when((at < 0) | (at > tail), "gone").otherwise("ok")

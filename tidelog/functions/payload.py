"""Payloads: flattening JSON bodies into messages, and putting messages together again.

Elements of an array are written anew (keys sorted, no blanks); a value that is no array
is kept as it is. Numbers keep Spark's form: whole numbers keep all digits. With
duplicate keys the last wins if spark.sql.variant.allowDuplicateKeys is set.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.functions.media import is_json


def _refuse(name: str):
    raise ValueError(name)


@F.pandas_udf(T.BooleanType())
def strict_json(text: pd.Series) -> pd.Series:
    """Whether a text is one whole JSON value: nothing after it, no NaN or Infinity."""

    def ok(x) -> bool:
        try:
            json.loads(x, parse_constant=_refuse)
        except (ValueError, TypeError, RecursionError):
            return False
        return True

    return text.map(ok).astype(bool)


def is_array(text: Column) -> Column:
    return F.startswith(F.ltrim(F.regexp_replace(text, r"^[\t\n\r]+", " ")), F.lit("["))


def json_status(text: Column) -> Column:
    """ok, or bad_request: not one JSON value, or an array without elements."""
    empty = text.rlike(r"^[ \t\n\r]*\[[ \t\n\r]*\][ \t\n\r]*$")
    return F.when(~F.coalesce(strict_json(text), F.lit(False)) | empty, "bad_request").otherwise("ok")


def elements(text: Column) -> Column:
    """The messages of a valid JSON body: an array's elements, one level deep, or the body itself."""
    values = F.transform(F.try_parse_json(text).cast("array<variant>"), lambda x: F.to_json(x))
    return F.when(is_array(text), values).otherwise(F.array(text))


def flatten(df: DataFrame, body: str, pos: str = "pos", data: str = "data") -> DataFrame:
    """A row for each message of the body column, with its place in it."""
    return df.select("*", F.posexplode(elements(F.col(body))).alias(pos, data))


def wrapped(data: Column, idx: Column) -> Column:
    """Aggregate: messages in order as one JSON array."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(idx.alias("i"), data.cast("string").alias("d")))), lambda x: x["d"])
    return F.concat(F.lit("["), F.array_join(ordered, ","), F.lit("]"))


def joined(data: Column, idx: Column) -> Column:
    """Aggregate: messages in order, end to end."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(idx.alias("i"), data.cast("string").alias("d")))), lambda x: x["d"])
    return F.array_join(ordered, "")


def body(content_type: Column, data: Column, idx: Column) -> Column:
    """Aggregate: the response body of messages, by the stream's content type."""
    # A stream has one content type; the least is the same in every run.
    return F.when(is_json(F.min(content_type)), wrapped(data, idx)).otherwise(joined(data, idx))


def sliced(text: str | None) -> list[str] | None:
    """The elements of a JSON array as they are written; empty for blank text; None for anything else."""
    x = (text or "").strip(" \t\n\r")
    if not x:
        return []
    if x[0] != "[" or x[-1] != "]":
        return None
    decoder, out, at = json.JSONDecoder(parse_constant=_refuse), [], 1
    try:
        while True:
            while x[at] in " \t\n\r":
                at += 1
            if x[at] == "]" and not out:
                return out if at == len(x) - 1 else None
            _, end = decoder.raw_decode(x, at)
            out.append(x[at:end])
            at = end
            while x[at] in " \t\n\r":
                at += 1
            if x[at] == "]":
                return out if at == len(x) - 1 else None
            if x[at] != ",":
                return None
            at += 1
    except (ValueError, IndexError):
        return None


@F.pandas_udf(T.ArrayType(T.StringType()))
def raw_elements(text: pd.Series) -> pd.Series:
    return text.map(sliced)

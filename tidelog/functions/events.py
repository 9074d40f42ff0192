"""Server-sent events: frames as text, both ways."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_EVENTS = T.ArrayType(T.StructType([T.StructField("pos", T.IntegerType()), *(T.StructField(n, T.StringType()) for n in ("type", "data", "next_offset", "cursor"))]))


def _lines(text: Column) -> Column:
    return F.array_join(F.transform(F.split(text, "\n"), lambda x: F.concat(F.lit("data: "), x)), "\n")


def encode(data: Column, json_data: Column, next_offset: Column, cursor: Column | None = None) -> Column:
    """A data event (JSON: one line; text: a line each) and the control event with the offset after it."""
    payload = F.when(json_data, F.concat(F.lit("data: "), data)).otherwise(_lines(data))
    fields = [next_offset.alias("streamNextOffset")] + ([cursor.alias("streamCursor")] if cursor is not None else [])
    return F.concat(F.lit("event: data\n"), payload, F.lit("\n\nevent: control\ndata: "), F.to_json(F.struct(*fields)), F.lit("\n\n"))


def frames(lines: Iterable[str]) -> Iterator[tuple[str, str]]:
    """(type, data) of each frame with a type; comments and unknown fields are passed over, one leading blank is cut."""
    kind, data = "", []
    for line in lines:
        line = line.rstrip("\r\n")
        if not line:
            if kind:
                yield kind, "\n".join(data) if data else "{}"
            kind, data = "", []
        elif line.startswith("event:"):
            kind = line[6:].strip()
        elif line.startswith("data:"):
            data.append(line[5:].removeprefix(" "))


def decode(text: str) -> list[dict]:
    """The events of a text; a control event's offset and cursor are taken from its JSON."""
    out = []
    for i, (kind, data) in enumerate(frames(text.split("\n"))):
        control = json.loads(data) if kind == "control" else {}
        out.append({"pos": i, "type": kind, "data": data, "next_offset": control.get("streamNextOffset"), "cursor": control.get("streamCursor")})
    return out


@F.pandas_udf(_EVENTS)
def decoded(text: pd.Series) -> pd.Series:
    return text.map(lambda x: decode(x or ""))

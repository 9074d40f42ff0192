"""Reading: offset ranges under a byte budget, pages, and what responses say of them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.functions import offsets, requests
from tidelog.operators import scan


def after(messages: DataFrame, offset: str | int | None) -> DataFrame:
    """Messages after an offset; on a table with idx statistics the filter is pushed into the scan."""
    at = offset if isinstance(offset, int) else parse(offset)
    return messages.where(F.col("idx") > at)


def parse(offset: str | None) -> int:
    """The number of an offset; ValueError if it has none."""
    import re

    if offset is None or offset in offsets.START or offset == "earliest":
        return 0
    found = re.match(r"[+-]?[0-9]+", offset)
    if not found:
        raise ValueError(f"bad offset {offset!r}")
    return int(found[0])


def page(messages: DataFrame, limit: int = 0, span: int = scan.SPAN) -> DataFrame:
    """Of each stream the messages whose running size is within the limit, the first in any case; no limit if it isn't positive."""
    if limit <= 0:
        return messages
    run = scan.before(messages, "stream_id", "idx", sums={"_bytes": F.col("n_bytes").cast("long"), "_count": F.lit(1).cast("long")}, span=span)
    return run.where((F.col("_bytes") + F.col("n_bytes") <= limit) | (F.col("_count") == 0)).drop("_bytes", "_count")


def catch_up(messages: DataFrame, offset: str | None = None, limit: int = requests.CHUNK, span: int = scan.SPAN) -> DataFrame:
    """A row for each stream: what a read from the offset answers, without the data. Offsets are normalised."""
    at = parse(offset)
    # One pass: rows up to the offset count for nothing in the running sums, and the tail is the maximum of all.
    late = F.col("idx") > at
    size = F.when(late, F.col("n_bytes").cast("long"))
    run = messages
    if limit > 0:
        run = scan.before(messages, "stream_id", "idx", sums={"_bytes": size, "_count": late.cast("long")}, span=span)
    fits = late & ((F.col("_bytes") + size <= limit) | (F.col("_count") == 0)) if limit > 0 else late
    rows = run.groupBy("stream_id").agg(F.max("idx").alias("tail"), F.count_if(fits).alias("n"), F.sum(F.when(fits, size)).alias("bytes"), F.max(F.when(fits, F.col("idx"))).alias("last"))
    gone = (F.lit(at) < 0) | (F.lit(at) > F.col("tail"))
    last = F.coalesce("last", F.lit(at).cast("long"))
    return rows.select(
        "stream_id",
        F.when(gone, "gone").otherwise("ok").alias("status"),
        F.coalesce("n", F.lit(0)).alias("n_messages"),
        F.coalesce("bytes", F.lit(0)).alias("n_bytes"),
        F.when(~gone, offsets.to_offset(last)).alias("next_offset"),
        offsets.to_offset(F.col("tail")).alias("tail_offset"),
        F.when(~gone, last == F.col("tail")).otherwise(F.lit(False)).alias("up_to_date"),
    )


def pages(messages: DataFrame, limit: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """messages (stream_id, idx, n_bytes and the columns in keep) with page, from 1: each page takes what fits the limit, one message at least.

    Where a page ends depends on all before it, so a stream is one sorted run; it is
    walked batch by batch with the state of one page, so its size doesn't matter to memory.
    """

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stream, number, used = None, 0, 0
        for df in batches:
            size, ids = df["n_bytes"].to_numpy(np.int64), df["stream_id"].to_numpy(object)
            out = np.empty(len(df), np.int64)
            edges = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1), len(df)]
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                if ids[a] != stream:
                    stream, number, used = ids[a], 0, limit + 1
                total = np.cumsum(size[a:b])
                i, done = 0, 0
                while i < b - a:
                    j = int(np.searchsorted(total, done + limit - used, "right")) if number else i
                    if j > i:
                        out[a + i : a + j] = number
                        used += int(total[j - 1]) - done
                        done, i = int(total[j - 1]), j
                    if i < b - a:
                        number, out[a + i] = number + 1, number + 1
                        used, done, i = int(size[a + i]), int(total[i]), i + 1
            yield df.assign(page=out)

    ordered = messages.select("stream_id", "idx", "n_bytes", *keep).repartition("stream_id").sortWithinPartitions("stream_id", "idx")
    own = "".join(f"`{n}` {t}, " for n, t in ordered.select(*keep).dtypes) if keep else ""
    return ordered.mapInPandas(walk, f"stream_id string, idx long, n_bytes int, {own}page long")


def live_status(idx: Column, tail: Column) -> Column:
    """What a long poll answers: data (200) or, with none until the time is up, 204 and the offset that was asked for."""
    return F.when(idx < tail, F.lit(200)).otherwise(F.lit(204))

"""Streams: creation, configuration, head, expiry and deletion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.functions import media, offsets, requests
from tidelog.operators import scan


def same_config(a: str, b: str) -> Column:
    """Equal media type, time to live and expiry (as an instant) of two structs."""
    f = lambda s, n: F.col(f"{s}.{n}")
    return media.same(f(a, "content_type"), f(b, "content_type")) & f(a, "ttl_seconds").eqNullSafe(f(b, "ttl_seconds")) & f(a, "expires_at").eqNullSafe(f(b, "expires_at"))


def create(requests_: DataFrame, existing: DataFrame | None = None, order: str = "arrival") -> DataFrame:
    """requests_ with status: created for the first of a new stream, ok for an equal configuration, conflict otherwise.

    Columns: stream_id, `order`, content_type, ttl_seconds, expires_at. The first writer
    wins; its configuration is found by an aggregate, not by ordering each stream.
    """
    cfg = F.struct("content_type", "ttl_seconds", "expires_at")
    first = requests_.groupBy("stream_id").agg(F.min_by(cfg, order).alias("first"), F.min(order).alias("_at"))
    if existing is None:
        held = first.select("stream_id", "first", "_at")
    else:
        old = existing.select("stream_id", cfg.alias("old"))
        held = first.join(old, "stream_id", "left").select("stream_id", F.coalesce("old", "first").alias("first"), F.when(F.col("old").isNull(), F.col("_at")).alias("_at"))
    rows = requests_.withColumn("own", cfg).join(held, "stream_id")
    status = F.when(F.col(order).eqNullSafe(F.col("_at")) & F.col("_at").isNotNull(), "created").when(same_config("own", "first"), "ok").otherwise("conflict")
    return rows.withColumn("status", status).drop("own", "first", "_at")


def alive(streams: DataFrame, now: Column) -> DataFrame:
    return streams.where(requests.alive(F.col("expires_at"), now))


def head(streams: DataFrame, messages: DataFrame, now: Column | None = None) -> DataFrame:
    """Configuration and tail of each live stream; reads no data."""
    live = streams if now is None else alive(streams, now)
    tails = messages.groupBy("stream_id").agg(F.max("idx").alias("tail"))
    tail = F.coalesce("tail", F.lit(0))
    return live.join(tails, "stream_id", "left").withColumn("tail", tail).withColumn("next_offset", offsets.to_offset(F.col("tail")))


def delete(streams: DataFrame, messages: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Streams and messages without those whose ids are in gone (expired or not)."""
    ids = gone.select("stream_id").distinct()
    return streams.join(ids, "stream_id", "left_anti"), messages.join(ids, "stream_id", "left_anti")


def epochs(ops: DataFrame, order: str = "arrival") -> DataFrame:
    """ops with epoch: how many deletes of the stream came before. A stream created anew begins a new life at offset 1."""
    return scan.before(ops, "stream_id", order, sums={"epoch": (F.col("op") == "delete").cast("long")})

"""Running sums and maxima along each stream.

A stream of at most `span` rows is one group of a window. A window over a larger stream
would be one task, however large the stream, so its order column is cut into spans - as
many as it takes for `span` rows each, if they lie evenly -: windows run inside (stream,
span), the spans' totals - one row each - are scanned, and each row adds what came before
its span. Rows find their span by a broadcast of the large streams, and meet a table of
streams by stream and span: a join by stream alone would leave them partitioned so, which
also does for a window in (stream, span), and a stream would be one task again. Which streams are large is found by one count of each stream, before the plan
is made; pass the table itself, or one that is staged, not a plan that is dear to run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPAN = 1 << 20


def large(df: DataFrame, by: str, order: str, span: int = SPAN) -> DataFrame | None:
    """`by`, _low, _step, _spans of the streams with more than `span` rows; None without such."""
    counts = df.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.min(F.coalesce(order, F.lit(0))).cast("long").alias("low"), F.max(F.coalesce(order, F.lit(0))).cast("long").alias("high")).where(F.col("n") > span)
    rows = []
    for r in counts.collect():  # one row for `span` rows of df at most
        step = max(1, (r["high"] - r["low"] + 1) // -(-r["n"] // span))
        rows.append((r[by], r["low"], step, (r["high"] - r["low"]) // step + 1))
    return df.sparkSession.createDataFrame(rows, f"`{by}` {dict(df.dtypes)[by]}, _low long, _step long, _spans long") if rows else None


def spanned(df: DataFrame, by: str, order: str, streams: DataFrame) -> DataFrame:
    """df with _span: the span of its stream that a row lies in, 0 in a stream that isn't large."""
    at = F.coalesce(F.floor((F.coalesce(F.col(order), F.lit(0)) - F.col("_low")) / F.col("_step")).cast("long"), F.lit(0))
    return df.join(F.broadcast(streams), by, "left").withColumn("_span", at).drop("_low", "_step", "_spans")


def spread(df: DataFrame, by: str, streams: DataFrame) -> DataFrame:
    """df, which has a row a stream, with _span: each row once for each span of its stream."""
    every = F.sequence(F.lit(0).cast("long"), F.coalesce("_spans", F.lit(1)) - 1)
    return df.join(F.broadcast(streams), by, "left").withColumn("_span", F.explode(every)).drop("_low", "_step", "_spans")


def before(df: DataFrame, by: str, order: str, sums: dict[str, Column] | None = None, maxima: dict[str, Column] | None = None, span: int = SPAN, streams: DataFrame | bool | None = True) -> DataFrame:
    """df with, for each name, the sum (0 if none) or maximum (null if none) over the earlier rows of the same stream.

    `order` is a whole number, unique in its stream; rows without one come first.
    streams: what `large` gave for these rows, which may be `spanned` already; True to find out.
    """
    sums, maxima = sums or {}, maxima or {}
    if streams is True:
        streams = large(df, by, order, span)
    whole = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    if streams is None:
        out = {k: F.coalesce(F.sum(v).over(whole), F.lit(0)) for k, v in sums.items()} | {k: F.max(v).over(whole) for k, v in maxima.items()}
        return df.select(*[c for c in df.columns if c not in out], *[v.alias(k) for k, v in out.items()])
    rows = df if "_span" in df.columns else spanned(df, by, order, streams)
    rows = rows.withColumns({f"_v_{k}": v for k, v in (sums | maxima).items()})
    inside = Window.partitionBy(by, "_span").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(by).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    # Totals read what the rows' windows read, so one shuffle serves for all: the key is an aggregate, as the join below would filter nulls
    # of a grouping key from the table, and maxima take the order along.
    totals = rows.groupBy(F.col(by).alias("_by"), "_span").agg(F.max(by).alias(by), *[F.sum(f"_v_{k}").alias(f"_t_{k}") for k in sums], *[F.max(F.struct(F.col(f"_v_{k}").alias("v"), order))["v"].alias(f"_t_{k}") for k in maxima])
    totals = totals.select(by, "_span", *[F.sum(f"_t_{k}").over(earlier).alias(f"_p_{k}") for k in sums], *[F.max(f"_t_{k}").over(earlier).alias(f"_p_{k}") for k in maxima])
    local = rows.select("*", *[F.sum(f"_v_{k}").over(inside).alias(f"_l_{k}") for k in sums], *[F.max(f"_v_{k}").over(inside).alias(f"_l_{k}") for k in maxima])
    met = local.join(totals, [by, "_span"], "left")
    out = {k: F.coalesce(f"_l_{k}", F.lit(0)) + F.coalesce(f"_p_{k}", F.lit(0)) for k in sums} | {k: F.greatest(f"_l_{k}", f"_p_{k}") for k in maxima}
    return met.withColumns(out).select(*[c for c in df.columns if c not in out], *out)

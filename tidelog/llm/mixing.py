"""Mixing sources to target weights by hash-threshold histograms; DataFrame functions only.

Every document has a place in its source's order: a 36-bit hash of its id. A
source's take is all documents below a threshold, so shares are nested: a larger
budget keeps what a smaller one took. The threshold comes from sums of tokens by
source and hash bucket (4096 buckets a level): cumulative sums find the bucket in
which the budget ends, and only that bucket is split again, three levels deep.
Nothing is sorted and nothing but sums is shuffled.

Defined cases: null text has size 0; a null source is a source of its own, last in
order; empty tables give empty results; rows that repeat (same id) share one hash, so
all of them are taken or none, and rows without an id share the first place; sizes of 0 are taken as 0; extra columns are ignored
here and kept by `mix`, whose own columns start with `_mix_`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm.cluster import written

BITS, LEVELS = 12, 3
#: A take has at most this many times its source's tokens.
MOST = 3
#: Up to so many sources, the table of one row a source is broadcast; beyond, it is joined by shuffle.
BROADCAST_SOURCES = 10_000


def size_of(text: Column) -> Column:
    """Number of words; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _with(df: DataFrame, few: DataFrame, how: str) -> DataFrame:
    return df.join(few, "_mix_source", how)


def targets(by_source: DataFrame, weights: tuple[float, ...], total: Column | None = None) -> DataFrame:
    """_mix_source, size -> target. Weights repeat over the sources in code-point order, null last.

    Water filling without a loop: source i is capped at MOST x its size; sources are
    met in the order of cap / weight; what is left of the total, shared by the weights not
    yet capped, rises while a source's cap is below its share and falls after, so its
    maximum is the level. One row a source.
    """
    one = Window.partitionBy(F.lit(0))
    ranked = by_source.withColumn("_n", F.row_number().over(one.orderBy(F.col("_mix_source"))) - 1)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("_n") % len(weights)).cast("int") + 1)
    order = one.orderBy(F.col("_level"), F.col("_n"))
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    return (
        ranked.withColumns({"_w": w, "_cap": F.col("source_size") * float(MOST), "_all": F.sum("source_size").over(one)})
        .withColumn("_level", F.col("_cap") / F.col("_w"))
        .withColumn("_here", (F.col("_all") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(after))
        .withColumn("_fill", F.max("_here").over(one))
        .select("_mix_source", "source_size", F.least(F.col("_cap"), F.col("_w") * F.col("_fill")).alias("target"))
    )


def thresholds(sized: DataFrame, by_source: DataFrame) -> DataFrame:
    """by_source with `_whole` (times that every document is taken) and `_below` (those with a smaller hash place are taken once more)."""
    have = F.greatest(F.col("source_size"), F.lit(1)).cast("double")
    state = by_source.withColumn("_whole", F.floor(F.col("target") / have + 1e-9).cast("long")).withColumns(
        {"_left": F.greatest(F.lit(0.0), F.col("target") - F.col("_whole") * F.col("source_size")), "_prefix": F.lit(0).cast("long")}
    )
    for level in range(1, LEVELS + 1):
        shift = BITS * (LEVELS - level)
        bucket = F.shiftright(F.col("_place"), shift)
        rows = sized
        if level > 1:
            rows = _with(sized, state.select("_mix_source", "_prefix"), "inner").where(F.shiftright(F.col("_place"), shift + BITS) == F.col("_prefix"))
        hist = rows.groupBy("_mix_source", bucket.alias("_bucket")).agg(F.sum("size").alias("_tokens"))
        run = Window.partitionBy("_mix_source").orderBy("_bucket")
        upto = F.sum("_tokens").over(run)
        found = (
            _with(hist, state.select("_mix_source", "_left"), "inner")
            .select("_mix_source", "_bucket", "_left", (upto - F.col("_tokens")).alias("_under"), upto.alias("_upto"))
            .where(F.col("_upto") > F.col("_left"))
            .groupBy("_mix_source")
            .agg(F.min(F.struct("_bucket", "_under", "_upto")).alias("_b"))
        )
        last = level == LEVELS
        # At the last level the bucket itself is taken if that comes nearer to the budget.
        edge = F.col("_b._bucket") + (F.when((F.col("_b._upto") - F.col("_left")) < (F.col("_left") - F.col("_b._under")), 1).otherwise(0) if last else 0)
        every = F.shiftleft(F.lit(1).cast("long"), BITS * level)
        state = state.join(found, "_mix_source", "left").select(
            "_mix_source", "source_size", "target", "_whole",
            F.coalesce(edge, every).cast("long").alias("_prefix"),
            (F.col("_left") - F.coalesce(F.col("_b._under"), F.lit(0))).alias("_left"),
        )
        state = written(state, "mix-state")
    return state.withColumnRenamed("_prefix", "_below")


def mix(docs: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row a document: `id_col`, the columns of `keep`, size, source_size, target, taken (tokens the mix takes, repeats counted), times (how often the document is taken)."""
    spark = docs.sparkSession
    # Sources are told apart by a string that no source can equal, so that null joins too and sorts last.
    source = F.when(F.col(source_col).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(source_col).cast("string")))
    place = F.coalesce(F.conv(F.substring(F.md5(F.col(id_col).cast("string")), 1, BITS * LEVELS // 4), 16, 10).cast("long"), F.lit(0))
    rows = docs.select(F.col(id_col), *[F.col(c) for c in keep], source.alias("_mix_source"), size_of(F.col(text_col)).alias("size"), place.alias("_place"))
    sized = rows if keep else written(rows, "mix-sizes")
    slim = written(rows.select("_mix_source", "size", "_place"), "mix-sizes") if keep else sized
    by_source = slim.groupBy("_mix_source").agg(F.sum("size").alias("source_size"))
    state = thresholds(slim, written(targets(by_source, weights), "mix-targets"))
    few = state.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    out = sized.join(F.broadcast(state) if few else state, "_mix_source")
    times = F.least(F.col("_whole") + F.when(F.col("_place") < F.col("_below"), 1).otherwise(0), F.lit(MOST))
    return out.select(id_col, *keep, "size", "source_size", "target", (times * F.col("size")).cast("long").alias("taken"), times.cast("int").alias("times"))

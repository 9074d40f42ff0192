"""Connected components of an edge table, and joins that spread hot keys.

Each task first joins up the edges it holds: of every component among them it keeps a
star - one edge from each vertex to the least. Then alternating large and small stars
bring the tasks' stars together, and each table they write is again joined up by the task
that writes it. Where the edges fit one task from the start, nothing is left to do.

The hub of a giant component is one key of the joins by vertex; spread_join keeps it out
of the shuffle.

Defined cases: edges from a vertex to itself, repeated edges and either direction count
for nothing; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.cluster import tasks, written

#: Edges that are joined up at once.
FOLD = 1 << 20


def spread_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """left inner join right, which has one row a key. left is read several times.

    The keys with most rows, four for each task, are looked up in a broadcast table of so
    many rows at most and stay where they are; all others meet in a shuffle.
    """
    top = left.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).orderBy(F.col("_n").desc(), key).limit(4 * tasks(left.sparkSession)).select(key)
    hot = F.broadcast(right.join(F.broadcast(top), key))
    return left.join(hot, key).unionByName(left.join(F.broadcast(top), key, "left_anti").join(right, key))


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The vertices of edges a - b, and the least vertex of the component of each."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    up = np.arange(len(ids))
    while True:
        low, high = np.minimum(up[x], up[y]), np.maximum(up[x], up[y])
        if (low == high).all():
            return ids, ids[up]
        np.minimum.at(up, high, low)
        while (up[up] != up).any():
            up = up[up]


def _joined_up(edges: DataFrame) -> DataFrame:
    """u, v (the least vertex that the edges of the same task reach from u), u > v."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u, v, size = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0

        def fold() -> None:
            ids, low = roots(np.concatenate(u), np.concatenate(v))
            away = ids != low
            u[:], v[:] = [ids[away]], [low[away]]

        for batch in batches:
            u.append(batch.column(0).to_numpy(zero_copy_only=False))
            v.append(batch.column(1).to_numpy(zero_copy_only=False))
            size += batch.num_rows
            if size >= FOLD:
                fold()
                size = 0
        fold()
        for a in range(0, len(u[0]), 1 << 17):
            yield pa.RecordBatch.from_arrays([pa.array(u[0][a : a + (1 << 17)]), pa.array(v[0][a : a + (1 << 17)])], ["u", "v"])

    return written(edges.select("u", "v").mapInArrow(run, "u long, v long"), "star")


def components_of(edges: DataFrame) -> DataFrame:
    """v, root: the least vertex that the edges a - b reach, of each vertex that isn't the least itself."""
    e = _joined_up(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while True:
        # Done when each vertex has one edge down, and none that edges lead down to has one.
        ends = e.select(F.col("u").alias("x"), F.lit(1).alias("down"), F.lit(0).alias("low")).union(e.select("v", F.lit(0), F.lit(1)))
        open_ = ends.groupBy("x").agg(F.sum("down").alias("down"), F.max("low").alias("low")).where(F.col("down") + F.col("low") > 1)
        if len(e.inputFiles()) <= 1 or not open_.take(1):
            return e.select(F.col("u").alias("v"), F.col("v").alias("root"))
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = spread_join(both, least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = written(large.where("u <> v").distinct(), "star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = spread_join(large, least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        e = _joined_up(small.distinct())

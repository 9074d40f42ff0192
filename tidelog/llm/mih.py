"""Approximate nearest neighbours by multi-index hashing.

Vectors get binary codes: signs of their components in learned rotations (the principal
axes of a bounded sample, turned by iterative quantisation). A code is split into
substrings of 8 bits, each with a table from its value to the vectors that have it. By
the pigeonhole principle a code within the radius of a query's lies within a substring
radius of it in one of the tables at least; those radii add up to radius - tables + 1.
So probing the tables finds every code within the radius; the others found are dropped
by their full distance, and what is left is ranked by inner products in double precision.

The radius is calibrated on the sample: that within which the RECALL share of neighbours
lies that are as rare in the sample as the k nearest are among all vectors. Vectors of
unequal length are lifted by one component, so that large inner products are small angles.

Vectors and queries meet in blocks (each block of vectors with each block of queries): the
tables of a block are built once, and only vectors that probes retrieve are compared, first
by their codes, then by their floats. Each block's k best are merged. Of equal vectors in a
block, only the k + 1 smallest ids can matter.

Codes are made from vectors scaled by the largest component there is, so finite vectors of
any size take part. A product beyond the range of doubles is infinite, as it is in double
precision; one that isn't a number (opposite infinities) comes last.

Defined cases: vectors that are null, zero, of another length than most, or hold null or
non-finite components take no part, nor do rows without an id; of rows that repeat an id
the least vector counts; with fewer than k candidates all that are found are returned;
ties go to the smaller id; an empty table gives an empty result; extra columns are ignored,
whatever their names.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm.cluster import column, written

BITS, SUB = 128, 8
SAMPLE, TURNS, RECALL = 4096, 30, 0.985
BLOCK, QUERY_BLOCK = 4096, 4096
#: Bits in which two values of a substring differ.
_APART = np.bitwise_count(np.arange(256, dtype=np.uint8)[:, None] ^ np.arange(256, dtype=np.uint8))


class Codes:
    """Learned rotations, and the radius for neighbours as rare as k among n. largest: the largest component; top: the greatest length, as a multiple of it."""

    def __init__(self, sample: np.ndarray, largest: float, top: float, k: int, n: int, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.largest, self.top = largest, top
        x = self.lifted(sample)
        self.mean = x.mean(axis=0) if len(x) > 1 else np.zeros(x.shape[1])
        centred = x - self.mean
        d = x.shape[1]
        axes = np.linalg.svd(centred, full_matrices=False)[2] if len(x) > d else np.eye(d)
        self.turns = []
        left = BITS
        while left:
            use = axes[: min(left, len(axes))]
            v = centred @ use.T
            turn = np.linalg.qr(rng.standard_normal((len(use), len(use))))[0]
            for _ in range(TURNS):
                u, _, w = np.linalg.svd(np.sign(v @ turn).T @ v)
                turn = (u @ w).T
            self.turns.append(use.T @ turn)
            left -= len(use)
        self.turn = np.concatenate(self.turns, axis=1)
        self.radius = self._radius(sample, k, n)

    def lifted(self, x: np.ndarray) -> np.ndarray:
        x = x / self.largest
        rest = np.sqrt(np.maximum(0.0, self.top**2 - (x * x).sum(axis=1, keepdims=True)))
        return np.concatenate([x, rest], axis=1) / self.top

    def of(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        """Codes as bytes. A query has no lifted component."""
        if query:
            x = x / np.abs(x).max(axis=1, keepdims=True)
            x = np.concatenate([x / np.linalg.norm(x, axis=1, keepdims=True), np.zeros((len(x), 1))], axis=1)
        else:
            x = self.lifted(x)
        return np.packbits((x - self.mean) @ self.turn > 0, axis=1)

    def _radius(self, sample: np.ndarray, k: int, n: int) -> int:
        asked = sample[:512]
        if len(sample) < 64:
            return BITS
        score = (asked / self.largest) @ (sample / self.largest).T
        score[np.arange(len(asked)), np.arange(len(asked))] = -np.inf
        m = max(1, ceil(k * len(sample) / max(n, 1)))
        near = np.argsort(-score, axis=1)[:, : min(m, len(sample) - 1)]
        far = np.bitwise_count(self.of(asked, True)[:, None, :] ^ self.of(sample)[near]).sum(axis=2)
        return int(min(BITS, np.quantile(far, RECALL, method="higher")))


def radii(radius: int, tables: int) -> np.ndarray:
    """Substring radii: at least one substring lies within its own if the whole code lies within the radius."""
    total = radius - tables + 1
    out = np.full(tables, total // tables)
    out[: total % tables] += 1
    return out  # -1: that table needn't be probed


class Tables:
    """The substring tables of codes (bytes): from each value of each substring to the codes that have it."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.order = [np.argsort(codes[:, t], kind="stable") for t in range(codes.shape[1])]
        self.begin = [np.searchsorted(codes[o, t], np.arange(257)) for t, o in enumerate(self.order)]

    def retrieved(self, asked: np.ndarray, radius: int) -> tuple[np.ndarray, int]:
        """queries x codes: whether a probe of some table reaches the code; how many entries the probes visit."""
        found, visits = np.zeros((len(asked), len(self.codes)), bool), 0
        for t, r in enumerate(radii(radius, asked.shape[1])):
            if r < 0:
                continue
            order, begin = self.order[t], self.begin[t]
            for v in np.unique(asked[:, t]):
                rows = np.flatnonzero(asked[:, t] == v)
                reached = np.concatenate([order[begin[p] : begin[p + 1]] for p in np.flatnonzero(_APART[v] <= r)])
                found[np.ix_(rows, reached)] = True
                visits += len(rows) * len(reached)
        return found, visits

    def within(self, asked: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, code) of all pairs within the radius: those retrieved, less those whose whole codes are further apart."""
        i, j = np.nonzero(self.retrieved(asked, radius)[0])
        far = np.zeros(len(i), np.uint16)
        a, b = (np.ascontiguousarray(x).view(np.uint64) for x in (asked, self.codes))
        for lane in range(a.shape[1]):
            far += np.bitwise_count(a[i, lane] ^ b[j, lane])
        near = far <= radius
        return i[near], j[near]


def search(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: up to k nearest of each query among all others. is_query: a condition on vec_id."""
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    v = F.col("v")
    rows = vectors.select(column(id_col).cast("long").alias("vec_id"), column(vector_col).cast("array<double>").alias("v"))
    rows = rows.where(F.col("vec_id").isNotNull() & v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0))
    index = written(rows.groupBy("vec_id").agg(F.min("v").alias("v")).select("vec_id", "v", F.array_max(F.transform("v", lambda x: F.abs(x))).alias("m"), is_query.alias("q")), "mih-vectors")
    sizes = index.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("q").cast("long")).alias("nq"), F.max("m").alias("m")).orderBy(F.col("n").desc(), "d").first()
    if not sizes or not sizes["nq"]:
        return spark.createDataFrame([], schema)
    d, n, n_queries, largest = sizes["d"], sizes["n"], sizes["nq"], sizes["m"]
    index = index.where(F.size("v") == d)
    square = F.aggregate(F.transform("v", lambda x: x / F.lit(largest)), F.lit(0.0), lambda a, x: a + x * x)
    top = float(np.sqrt(index.agg(F.max(square)).first()[0]))
    bound = min(1.0, 1.5 * SAMPLE / n)
    few = index.where(F.shiftrightunsigned(F.xxhash64("vec_id"), 40) < int(bound * (1 << 24))).select("v").limit(3 * SAMPLE).collect()
    sample = np.array([r["v"] for r in few], np.float64).reshape(-1, d)
    shared = spark.sparkContext.broadcast(Codes(sample, largest, top, k, n))
    blocks, query_blocks = ceil(n / BLOCK), ceil(n_queries / QUERY_BLOCK)

    def code(batches):
        c = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(1).values.to_numpy(zero_copy_only=False).reshape(-1, d) if not batch.column(1).offset else np.array(batch.column(1).to_pylist())
            yield batch.append_column("code", pa.array([r.tobytes() for r in c.of(x)], pa.binary())).append_column("asks", pa.array([r.tobytes() for r in c.of(x, True)], pa.binary()))

    coded = index.select("vec_id", "v", "q").mapInArrow(code, "vec_id long, v array<double>, q boolean, code binary, asks binary")
    in_block = F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(blocks)).cast("int")
    in_query_block = F.pmod(F.xxhash64("vec_id", F.lit(4)), F.lit(query_blocks)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    base = coded.select(in_block.alias("b"), every(query_blocks).alias("a"), F.lit(False).alias("ask"), "vec_id", "v", "code")
    asks = coded.where("q").select(every(blocks).alias("b"), in_query_block.alias("a"), F.lit(True).alias("ask"), "vec_id", "v", F.col("asks").alias("code"))

    def cell(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("vec_id")
        asking = table["ask"].to_numpy()
        ids = table["vec_id"].to_numpy()
        x = table["v"].combine_chunks().flatten().to_numpy().reshape(-1, d)
        codes = np.frombuffer(b"".join(table["code"].to_pylist()), np.uint8).reshape(-1, BITS // 8)
        q, q_ids, q_codes = x[asking], ids[asking], codes[asking]
        x, ids, codes = x[~asking], ids[~asking], codes[~asking]
        out: list[tuple] = []
        if len(x) and len(q):
            # Of equal vectors (in order of id) the k + 1 smallest ids.
            same = np.unique(np.ascontiguousarray(x).view(np.dtype((np.void, 8 * d))).ravel(), return_inverse=True)[1].ravel()
            order = np.argsort(same, kind="stable")
            place = np.arange(len(order)) - np.searchsorted(same[order], same[order])
            keep = np.sort(order[place <= k])
            x, ids, codes = x[keep], ids[keep], codes[keep]
            radius, tables = shared.value.radius, Tables(np.ascontiguousarray(codes))
            for a in range(0, len(q), 256):
                asks, near = tables.within(np.ascontiguousarray(q_codes[a : a + 256]), radius)
                edges = np.searchsorted(asks, np.arange(len(q[a : a + 256]) + 1))
                for i, (low, high) in enumerate(zip(edges, edges[1:]), a):
                    at = near[low:high]
                    at = at[ids[at] != q_ids[i]]
                    with np.errstate(over="ignore", invalid="ignore"):
                        score = (x[at] * q[i]).sum(axis=1)
                    best = np.lexsort((ids[at], -np.where(np.isnan(score), -np.inf, score)))[:k]
                    out.append((np.full(len(best), q_ids[i]), ids[at][best], score[best]))
        if not out:
            out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        return pa.table([pa.array(np.concatenate(c)) for c in zip(*out)], ["query_id", "vec_id", "score"])

    found = base.union(asks).groupBy("a", "b").applyInArrow(cell, "query_id long, vec_id long, score double")
    by = Window.partitionBy("query_id").orderBy(F.nanvl("score", F.lit(float("-inf"))).desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

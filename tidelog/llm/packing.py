"""Best-fit packing of documents into token sequences.

Bulk-synchronous best-fit decreasing. Pieces are range-sorted by length, which gives
each its rank; gaps are kept as runs of sequences with equal gaps, sorted by gap. In
each superstep all pieces of one length (from the longest down) sweep over the gap
runs for their successors - the smallest gaps that hold them; pieces that want the
same gap are told apart by rank, the gaps shrink, and the next length follows. As
lengths and gaps are whole numbers up to `capacity`, a superstep's state is the
histogram of lengths and the list of gap runs: both bounded by the capacity, not by
the number of documents, so supersteps need no job each. What grows with the corpus -
tokenising, sorting, ranks and placing - is distributed, and pieces find their places
by their global rank.

Defined cases: null text is empty (just the end token); repeated rows are packed like
any other; an empty table packs into nothing; texts of any length are cut whole.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.cluster import tasks, written

CAPACITY = 2048
_encoders: dict[str, object] = {}


def encoder(path: str):
    """text -> ids of the tokenizer in a `tokenizers` JSON file, without special tokens added.

    A byte-level BPE file is run by tiktoken, which gives the same ids about four
    times as fast; texts that hold an added token's string go to the file's own tokenizer.
    """
    if path in _encoders:
        return _encoders[path]
    import json

    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    spec = json.load(open(path, encoding="utf-8"))
    pre = spec.get("pre_tokenizer") or {}
    plain = spec["model"].get("type", "BPE") == "BPE" and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and not spec.get("normalizer")
    slow = lambda text: own.encode(text, add_special_tokens=False).ids
    if not plain:
        _encoders[path] = slow
        return slow
    import public_tokenizers
    import tiktoken

    # Byte-level vocabularies write each byte as a printable character: itself where printable, else the next free one from 256 on.
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    char = {chr(b): b for b in shown}
    char |= {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(shown)))}
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    ranks = {bytes(char[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    names = list(special)

    def encode(text: str):
        return slow(text) if any(s in text for s in names) else fast.encode_ordinary(text)

    _encoders[path] = encode
    return encode


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each document's ids and the end id, cut into pieces of `capacity` (the first may be shorter) if longer."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in batches:
            ids_of, rows = batch.column(0).to_pylist(), []
            for doc, text in zip(ids_of, batch.column(1)):
                ids = np.array([*encode(text.as_py() or ""), end_id], "<u4")
                n = len(ids)
                first = n if n <= capacity else n % capacity or capacity
                edges = [0, *range(first, n + 1, capacity)]
                rows += [(doc, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(edges, edges[1:]))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int]]:
    """Supersteps over the histogram of lengths -> (first rank, first sequence, offset) of each run of pieces, by rank; lengths in descending order.

    A run's i-th piece goes to its i-th sequence; runs that open sequences with several
    pieces each are cut into one run for each place in the sequence.
    """
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> runs (first sequence, count)
    sizes: list[int] = []  # the gaps there are, sorted
    out: list[tuple[int, int, int]] = []
    rank, opened = 0, 0

    def put(gap: int, first: int, n: int) -> None:
        if gap and n:
            if gap not in gaps:
                bisect.insort(sizes, gap)
            gaps.setdefault(gap, []).append((first, n))

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            k = bisect.bisect_left(sizes, length)
            if k == len(sizes):
                n = -(-left // (capacity // length))  # sequences that the rest of this length fills
                first, offset = opened, 0
                opened += n
                m = min(n, left)
                out.append((rank, first, 0))
                rank, left = rank + m, left - m
                put(capacity - length, first, n)
                continue
            gap = sizes[k]
            first, n = gaps[gap].pop()
            m = min(n, left)
            if m < n:
                gaps[gap].append((first + m, n - m))
            elif not gaps[gap]:
                del gaps[gap], sizes[k]
            out.append((rank, first, capacity - gap))
            rank, left = rank + m, left - m
            put(gap - length, first, m)
    return out


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The rows of `pieces` with sequence_id and offset: best fit, longest first."""
    spark = cut.sparkSession
    if capacity > 1 << 16:
        raise ValueError("the supersteps' state is bounded by the capacity; 65536 at most")
    keys = ["doc_id", "piece", "start"]
    cut = written(cut, "pieces")  # range bounds are sampled from it, so it is read twice
    ordered = cut.repartitionByRange(tasks(spark), F.col("length").desc(), F.xxhash64(*keys), *keys).sortWithinPartitions(F.col("length").desc(), F.xxhash64(*keys), *keys)
    ordered = ordered.checkpoint()  # fixes each row's partition and place in it
    at = ordered.withColumn("_at", F.monotonically_increasing_id())
    part = F.shiftright(F.col("_at"), 33)
    sums = at.groupBy(part.alias("p"), "length").count().groupBy("length").agg(F.sum("count").alias("n"))
    counts = {r["length"]: r["n"] for r in sums.collect()}  # at most `capacity` rows
    sizes = at.groupBy(part.alias("p")).count().collect()  # a row for each partition
    begin, total = {}, 0
    for r in sorted(sizes, key=lambda r: r["p"]):
        begin[r["p"]], total = total, total + r["count"]
    steps = np.array(plan(counts, capacity), np.int64).reshape(-1, 3)
    shared = spark.sparkContext.broadcast((begin, steps))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin, steps = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            where = batch.column(batch.schema.get_field_index("_at")).to_numpy(zero_copy_only=False)
            rank = where & ((1 << 33) - 1)
            rank = rank + np.array([begin[p] for p in (where >> 33).tolist()], np.int64)
            k = np.searchsorted(steps[:, 0], rank, "right") - 1
            rows = batch.drop_columns(["_at"])
            yield rows.append_column("sequence_id", pa.array(steps[k, 1] + rank - steps[k, 0])).append_column("offset", pa.array(steps[k, 2]))

    return at.mapInArrow(place, ", ".join(f"{n} {t}" for n, t in [*cut.dtypes, ("sequence_id", "long"), ("offset", "long")]))

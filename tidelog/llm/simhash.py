"""SimHash fingerprints of whole texts, and permuted block tables for radius search.

A text's terms are its runs of five words (lower-cased A-Z); a text with fewer words
is one term. Each occurrence votes, so a term weighs as often as it occurs. A bit of
the 128-bit fingerprint is set where the votes for it outweigh those against it.

Search: the bits are cut into BLOCKS blocks; two fingerprints within RADIUS agree on all
but RADIUS of them at most, so in one of the permuted tables - one for each choice of the
other blocks, keyed by them - both stand under one key. Each distinct fingerprint is in
each table once. A key that many have is dealt over cells (pairs of blocks of its
fingerprints), so no task holds an unbounded group. `near_first` tells of each document the
first one within the radius: a fingerprint is compared with earlier ones only until one is
near, so a large group of near copies costs no more than its size. `links` gives all pairs.

Defined cases: null and empty texts, and texts without words, have the fingerprint of
zeros; equal texts have equal fingerprints; repeated rows are neighbours in order; very
long texts are counted in pieces; null ids come first in order and are named by no
search; an empty table gives an empty result; extra columns are ignored, whatever their
names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm import text as words
from tidelog.llm.cluster import column, release, tasks, written
from tidelog.llm.graph import spread_join

WIDTH, BITS = 5, 128
#: Bytes of text whose votes are counted at once.
CHUNK = 1 << 20
#: The chosen radius and number of blocks: 28 tables with keys of 32 bits.
RADIUS, BLOCKS = 6, 8
#: Fingerprints of one key in one block of a cell; keys with fewer are one cell.
CELL = 4096
#: One class in so many is looked at to find the keys that many have.
LOOK = 64


#: The bits of each byte, the highest first, as the bytes of a number.
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).view(np.uint64).ravel()


def votes_to_bits(terms: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Packed fingerprints (texts x BITS/8 bytes) of the term hashes of consecutive texts."""
    n = len(first) - 1
    out = np.zeros((n, BITS // 8), np.uint8)
    count = np.diff(first)
    have = np.flatnonzero(count > 0)
    if not len(have):
        return out
    # Eight bits of a hash become eight counters of a byte each in one number; a run of up to 255 terms is summed at once.
    runs = -(-count[have] // 255)
    begin = np.concatenate([[0], np.cumsum(runs)[:-1]])
    owner = np.repeat(np.arange(len(have)), runs)
    at = first[:-1][have][owner] + 255 * (np.arange(len(owner)) - begin[owner])
    for lane in range(BITS // 64):
        h = words.mix(terms ^ np.uint64(0x5851F42D4C957F2D * (lane + 1) % (1 << 64))).view(np.uint8).reshape(-1, 8)
        for byte in range(8):
            counters = np.add.reduceat(_SPREAD[h[:, byte]], at).view(np.uint8).reshape(-1, 8)
            total = np.add.reduceat(counters, begin, axis=0, dtype=np.int32)
            out[have, lane * 8 + byte] = np.packbits(2 * total > count[have, None], axis=1).ravel()
    return out


def fingerprints(texts: list[bytes]) -> np.ndarray:
    """Fingerprints of UTF-8 texts, counted in chunks of bounded size; a longer text is counted in pieces."""
    out, k = np.zeros((len(texts), BITS // 8), np.uint8), 0
    while k < len(texts):
        stop, size = k, 0
        while stop < len(texts) and (stop == k or size + len(texts[stop]) <= CHUNK):
            size += len(texts[stop])
            stop += 1
        h, first = words.hash_words(*words.joined(texts[k:stop]))
        terms, begin = words.shingles(h, first, WIDTH)
        if stop == k + 1 and len(terms) > 4 * CHUNK // 8:
            out[k] = _long(terms)
        else:
            out[k:stop] = votes_to_bits(terms, begin)
        k = stop
    return out


def _long(terms: np.ndarray) -> np.ndarray:
    parts = []
    for lane in range(BITS // 64):
        total = np.zeros(64, np.int64)
        for a in range(0, len(terms), 1 << 18):
            h = words.mix(terms[a : a + (1 << 18)] ^ np.uint64(0x5851F42D4C957F2D * (lane + 1) % (1 << 64)))
            total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        parts.append(np.packbits(2 * total > len(terms)))
    return np.concatenate(parts)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal bits, row by row."""
    return 1.0 - np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64) / float(BITS)


def in_order(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Each partition holds runs of documents in ascending order, each run followed by the first document of the next (last=True).

    Texts are compressed and moved once. Ranges of ids come from approximate quantiles;
    the driver holds two numbers for each range. Null ids come first.
    """
    spark = docs.sparkSession
    n = tasks(spark)
    ids = docs.select(column(id_col).cast("long").alias("id"))
    cuts = ids.agg(F.percentile_approx("id", [i / n for i in range(1, n)], 10000)).first()[0] if n > 1 else []
    bounds = np.array(sorted(set(cuts or [])), np.int64)

    def range_of(column: pa.Array) -> np.ndarray:
        low = np.iinfo(np.int64).min
        return np.searchsorted(bounds, column.fill_null(low).to_numpy(zero_copy_only=False), "right")

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            r, v = range_of(batch.column(0)), batch.column(0)
            if len(r):
                low = np.iinfo(np.int64).min
                values = v.fill_null(low).to_numpy(zero_copy_only=False)
                k = np.lexsort((values, r))
                first = k[np.flatnonzero(np.r_[True, np.diff(r[k]) > 0])]
                yield pa.RecordBatch.from_arrays([pa.array(r[first], pa.int32()), v.take(pa.array(first))], ["r", "id"])

    # One row for each range that has rows. A null id is the least there is.
    mins = ids.mapInArrow(least, "r int, id long").groupBy("r").agg(F.min(F.struct("id")).alias("m")).collect()
    mins = sorted((r["r"], r["m"]["id"]) for r in mins)
    sends = {value: mins[i - 1][0] for i, (_, value) in enumerate(mins)}  # first id of a range -> the range before, around the end

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            r, ids = range_of(batch.column(0)), batch.column(0).to_pylist()
            texts = [pack((x.as_py() or "").encode()) for x in batch.column(1)]
            rows = [(int(p), False, i, z) for p, i, z in zip(r, ids, texts)]
            rows += [(sends[i], True, i, z) for i, z in zip(ids, texts) if i in sends]
            for a in range(0, len(rows), 1024):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[a : a + 1024]), (pa.int32(), pa.bool_(), pa.int64(), pa.binary()))], ["r", "last", "id", "z"])

    dealt = docs.select(column(id_col).cast("long").alias("id"), column(text_col).cast("string").alias("text")).mapInArrow(deal, "r int, last boolean, id long, z binary")
    return dealt.repartitionById(n, "r").sortWithinPartitions("r", "last", "id", "z")  # each range is a partition


def edited(text: str, following: str) -> str:
    """text with its last quarter (rounded down, in code points) replaced by as much of the beginning of `following`."""
    q = len(text) // 4
    return text[: len(text) - q] + following[:q]


def compare(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each document and of its edited text, and how alike they and the next document's are."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        held: list[tuple] = []  # (range, last, id, text) from the first without a known successor on

        def out(block: list[tuple]) -> pa.RecordBatch:
            # A row's successor is the row after it; the copies that close a range are successors only, the first of them.
            pairs = [(a, b) for a, b in zip(block, block[1:]) if not a[1]]
            texts = [a[3] for a, _ in pairs]
            changed = [edited(a[3], b[3]) for a, b in pairs]
            every = fingerprints([x.encode() for x in [*texts, *changed, *[b[3] for _, b in pairs]]]) if len(pairs) < 2 else None
            m = len(pairs)
            if every is None:
                own = fingerprints([x.encode() for x in [*texts, pairs[-1][1][3]]])
                new = fingerprints([x.encode() for x in changed])
                odd = [i for i in range(m - 1) if pairs[i][1] is not pairs[i + 1][0]]
                following = own[1:].copy()
                if odd:
                    following[odd] = fingerprints([pairs[i][1][3].encode() for i in odd])
                own = own[:m]
            else:
                own, new, following = every[:m], every[m : 2 * m], every[2 * m :]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([a[2] for a, _ in pairs], pa.int64()),
                    pa.array([len(x) for x in texts], pa.int64()),
                    pa.array([hashlib.sha256(x.encode()).hexdigest() for x in changed]),
                    pa.array([x.tobytes().hex() for x in own]),
                    pa.array([x.tobytes().hex() for x in new]),
                    pa.array(likeness(own, new)),
                    pa.array(likeness(own, following)),
                ],
                ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

        size = 0
        for batch in batches:
            for r, last, i, z in zip(*(batch.column(k) for k in range(4))):
                row = (r.as_py(), last.as_py(), i.as_py(), unpack(z.as_py()).decode())
                if held and held[-1][1] and row[1] and held[-1][0] == row[0]:
                    continue  # of equal ids that close a range, the first in order
                held.append(row)
                size += len(row[3])
                if size > 2 * CHUNK and len(held) > 1:
                    if any(not a[1] for a in held[:-1]):
                        yield out(held)
                    held, size = [row], len(row[3])
        if any(not a[1] for a in held[:-1]):
            yield out(held)

    return in_order(docs, id_col, text_col).mapInArrow(rows, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def _choices(radius: int, blocks: int) -> list[tuple[int, ...]]:
    if not 0 <= radius < blocks or BITS % blocks or BITS // blocks % 8:
        raise ValueError("blocks must be whole bytes, divide the bits and exceed the radius")
    if (blocks - radius) * BITS // blocks > 56:
        raise ValueError("keys of more than 56 bits: choose fewer blocks or a larger radius")
    return list(combinations(range(blocks), blocks - radius))


def keyed(cls: DataFrame, radius: int, blocks: int) -> DataFrame:
    """key (table and blocks), class_id, hi, lo: each fingerprint in each permuted table."""
    choices = _choices(radius, blocks)
    size = BITS // blocks // 8

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                part = batch.slice(a, 4096)
                raw = np.frombuffer(bytes.fromhex("".join(part.column(1).to_pylist())), np.uint8).reshape(-1, BITS // 8)
                lanes = np.ascontiguousarray(raw).view(np.int64)
                for t, chosen in enumerate(choices):
                    key = np.full(len(raw), t, np.int64)
                    for b in chosen:
                        for k in range(b * size, (b + 1) * size):
                            key = (key << 8) | raw[:, k]
                    yield pa.RecordBatch.from_arrays([pa.array(key), part.column(0), pa.array(lanes[:, 0]), pa.array(lanes[:, 1])], ["key", "class_id", "hi", "lo"])

    return cls.select("class_id", "fingerprint").mapInArrow(run, "key long, class_id long, hi long, lo long")


def in_cells(cls: DataFrame, radius: int, blocks: int) -> DataFrame:
    """key, one, two, part, class_id, hi, lo in order of the first three and class_id: runs of equal (key, one, two) are the cells; part: the block that a row is of."""
    n = F.col("n") * LOOK
    some = keyed(cls.where(F.pmod(F.xxhash64("class_id", F.lit(5)), F.lit(LOOK)) == 0), radius, blocks)
    large = written(some.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(n >= CELL).select("key", F.ceil(n / CELL).cast("int").alias("k")), "simhash-keys")
    rows = keyed(cls, radius, blocks).join(large, "key", "left").withColumn("k", F.coalesce("k", F.lit(1)))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("class_id", F.lit(6)), F.col("k")).cast("int"))
    other = F.when(F.col("k") == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("k") - 1))
    dealt = rows.select("key", "part", "class_id", "hi", "lo", F.explode(other).alias("other"))
    dealt = dealt.select("key", F.least("part", "other").alias("one"), F.greatest("part", "other").alias("two"), "part", "class_id", "hi", "lo")
    return dealt.repartition("key", "one", "two").sortWithinPartitions("key", "one", "two", "class_id")


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """(one, two, part, class_id, lanes) of each cell of at least two rows; a cell may span batches."""
    held: list[np.ndarray] | None = None

    def cut(columns: list[np.ndarray], last: bool):
        nonlocal held
        key, one, two = columns[:3]
        edge = np.flatnonzero((key[1:] != key[:-1]) | (one[1:] != one[:-1]) | (two[1:] != two[:-1])) + 1
        begin, end = np.r_[0, edge], np.r_[edge, len(key)]
        if not last:
            held = [c[begin[-1] :] for c in columns]
            begin, end = begin[:-1], end[:-1]
        for a, b in zip(begin[end - begin > 1], end[end - begin > 1]):
            yield one[a], two[a], columns[3][a:b], columns[4][a:b], np.stack([columns[5][a:b], columns[6][a:b]], 1).view(np.uint64)

    for batch in batches:
        if batch.num_rows:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            yield from cut([np.concatenate(x) for x in zip(held, columns)] if held else columns, False)
    if held:
        yield from cut(held, True)


def firsts(prints: np.ndarray, radius: int) -> np.ndarray:
    """Of fingerprints in order (rows of two lanes) the place of the first earlier one within the radius; -1 if there is none."""
    out, left = np.full(len(prints), -1), np.arange(1, len(prints))
    for a in range(0, len(prints) - 1, 64):
        left = left[left > a]
        if not len(left):
            break
        block = prints[a : a + 64]
        far = sum(np.bitwise_count(prints[left, k, None] ^ block[None, :, k]).astype(np.int16) for k in (0, 1))
        near = (far <= radius) & (np.arange(a, a + len(block)) < left[:, None])
        hit = near.any(axis=1)
        out[left[hit]] = a + near[hit].argmax(axis=1)
        left = left[~hit]
    return out


def near_first(prints: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, id_col: str = "doc_id", print_col: str = "fingerprint") -> DataFrame:
    """fingerprint, near_first: of each distinct fingerprint the smallest id that has one within the radius, its own included."""
    cls = written(_distinct(prints, id_col, print_col), "simhash-classes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, _, ids, lanes in _cells(batches):
            at = firsts(lanes, radius)
            hit = np.flatnonzero(at >= 0)
            if len(hit):
                yield pa.RecordBatch.from_arrays([pa.array(ids[hit]), pa.array(ids[at[hit]])], ["class_id", "first"])

    found = in_cells(cls.where("class_id is not null"), radius, blocks).mapInArrow(run, "class_id long, first long")
    least = found.groupBy("class_id").agg(F.min("first").alias("first"))
    return cls.join(least, "class_id", "left").select("fingerprint", F.coalesce("first", "class_id").alias("near_first"))


def links(prints: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, id_col: str = "doc_id", print_col: str = "fingerprint") -> DataFrame:
    """All pairs (a < b, distance) of distinct fingerprints within the radius, each named by its smallest id; `classes` gives the members."""
    cls = written(_distinct(prints, id_col, print_col), "simhash-classes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for one, two, part, ids, lanes in _cells(batches):
            for a in range(0, len(ids), 256):
                far = sum(np.bitwise_count(lanes[a : a + 256, k, None] ^ lanes[None, :, k]).astype(np.int16) for k in (0, 1))
                near = (far <= radius) & (ids[a : a + 256, None] < ids)
                if one != two:  # pairs inside a block are another cell's
                    near &= part[a : a + 256, None] != part
                i, j = np.nonzero(near)
                if len(i):
                    yield pa.RecordBatch.from_arrays([pa.array(ids[a + i]), pa.array(ids[j]), pa.array(far[i, j].astype(np.int32))], ["a", "b", "distance"])

    return in_cells(cls.where("class_id is not null"), radius, blocks).mapInArrow(run, "a long, b long, distance int").distinct()


def _distinct(prints: DataFrame, id_col: str, print_col: str) -> DataFrame:
    return prints.groupBy(column(print_col).alias("fingerprint")).agg(F.min(column(id_col).cast("long")).alias("class_id"))


def searched(docs: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `compare` with near_first: the smallest id of a document whose fingerprint is within the radius, its own included (null where none has an id)."""
    rows = written(compare(docs, id_col, text_col), "simhash-prints")
    release(docs.sparkSession)  # the shuffle files of the texts go, before those of the tables come
    return spread_join(rows, written(near_first(rows, radius, blocks), "simhash-near"), "fingerprint").select(*rows.columns, "near_first")


def classes(prints: DataFrame, id_col: str = "doc_id", print_col: str = "fingerprint") -> DataFrame:
    """member, class_id (smallest id with the same fingerprint), fingerprint."""
    rows = prints.select(F.col(id_col).alias("member"), F.col(print_col).alias("fingerprint"))
    least = rows.groupBy("fingerprint").agg(F.min("member").alias("class_id"))
    return rows.join(least, "fingerprint").select("member", "class_id", "fingerprint")

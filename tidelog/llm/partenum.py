"""Exact Jaccard join of word n-gram sets by PartEnum signatures, and its connected components.

Two sets link when den * |intersection| >= num * |union|. Sizes are cut into bands so
narrow that linked sets lie in the same band or in neighbouring ones; each set takes
part in its own band's instance and the next band's. In an instance the sets' symmetric
difference is at most k, so if the feature domain is cut into parts, few parts differ:

- up to k = SMALL, the domain is cut into k + max(2, k) parts, and each choice of all but
  k of them is a signature; linked sets agree on one choice at least;
- beyond, the domain is cut into k + 1 + e parts, each a signature, of which linked sets
  share 1 + e at least. So each class drops the e signatures under which it meets the
  most others: of those that two linked classes share, the rarest stays with both. This
  takes out empty parts and those of common lines and passages, ahead of any comparison.

Equal sets are one class ahead of all that, so copies meet once. Classes under one
signature are compared with the least of them first; then, where a signature still
holds several components, in blocks against blocks (each pair of blocks once, however
many signatures share it). Parity bitmaps, which never differ in more bits than the sets
in features, rule most pairs out; the others are verified on whole sets, unless they are
in one component by then. So no pair that a signature brings together goes unseen, and
no task or row holds a group of unbounded size.

Features are told apart by 64-bit hashes: of n distinct n-grams, two share one with
probability n^2 / 2^65, which changes a verdict only where they stand in two sets of one
comparison. Classes have 64-bit names too, but an equal name alone makes no class: a
second, independent 64-bit name is compared for every class, and where two sets share only
the first, they get names of their own (probability of a false equality: n^2 / 2^129).

Defined cases: null, empty and wordless texts have empty sets, linked with nothing;
texts with fewer words than the n-gram are one feature; rows that repeat are one class;
an empty table gives an empty result; a null id can't name a component that has another;
very long texts are one set each, held by one task at a time; extra columns, whatever
their names, are ignored by `components` and kept by `representatives`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm import text as words
from tidelog.llm.cluster import MAP_BITS, bitmap, column, in_map, release, written
from tidelog.llm.graph import components_of, spread_join

SMALL = 3
BLOCK = 256
CHUNK = 1 << 20


@lru_cache(maxsize=None)
def instance(i: int, num: int, den: int) -> tuple[int, int, int, int, int]:
    """Least and largest size of band i, the k of its instance, parts and spare parts."""
    low = 1 if i == 0 else instance(i - 1, num, den)[1] + 1
    high = max(low, low * den // num)
    k = 2 * high * (den - num) // (den + num)
    if k <= SMALL:
        return low, high, k, k + max(2, k) if k else 1, 0
    e = max(1, k // 4)
    return low, high, k, k + 1 + e, e


@lru_cache(maxsize=None)
def _edges(num: int, den: int, largest: int) -> np.ndarray:
    out = [1]
    while out[-1] <= largest:
        out.append(instance(len(out) - 1, num, den)[1] + 1)
    return np.array(out)


def sets_of(data: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """The sorted distinct n-gram hashes of each text."""
    h, first = words.hash_words(data, offsets)
    s, begin = words.shingles(h, first, width)
    return [_distinct(s[a:b]) for a, b in zip(begin, begin[1:])]


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.r_[True, x[1:] != x[:-1]]] if len(x) else x


#: Renamed classes: (name, second name) -> name.
Apart = dict[tuple[int, int], int]


def class_of(sets: list[np.ndarray], apart: Apart | None = None) -> np.ndarray:
    """A 64-bit name of each set; 0 for the empty one. apart: names of sets that share a first name."""
    one, two = names_of(sets)
    if apart:
        for i in np.flatnonzero(np.isin(one, np.array([k[0] for k in apart], np.int64))):
            one[i] = apart.get((int(one[i]), int(two[i])), one[i])
    return one


def names_of(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit names of each set; 0 for the empty one."""
    n = np.array([len(x) for x in sets], np.int64)
    if not n.sum():
        return np.zeros(len(sets), np.int64), np.zeros(len(sets), np.int64)
    every, begin = np.concatenate(sets), np.r_[0, np.cumsum(n)]
    out = []
    for seed in (0x1F83D9ABFB41BD6B, 0x9B05688C2B3E6C1F):
        total = np.r_[np.uint64(0), np.cumsum(words.mix(every ^ np.uint64(seed)))]
        name = words.mix(total[begin[1:]] - total[begin[:-1]] + n.astype(np.uint64))
        out.append(np.where(n > 0, np.maximum(name, np.uint64(1)), np.uint64(0)).view(np.int64))
    return out[0], out[1]


def signatures(sets: list[np.ndarray], num: int, den: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signatures of non-empty sets, the index of the set of each, and 2 * how many of its instance a link shares at least + the instance (0: the band's own, 1: the next)."""
    n = np.array([len(x) for x in sets], np.int64)
    edges = _edges(num, den, int(n.max()))
    band = np.searchsorted(edges, n, "right") - 1
    every = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), n)
    out_s, out_i, out_a = [], [], []
    for step in (0, 1):
        what = {b: instance(int(b), num, den) for b in np.unique(band + step)}
        parts = np.array([what[b][3] for b in band + step], np.int64)
        seed = words.mix((band + step).astype(np.uint64) + np.uint64(0xABCD))
        base = np.r_[0, np.cumsum(parts)]
        place = words.mix(every ^ seed[owner])
        slot = base[owner] + (place % parts.astype(np.uint64)[owner]).astype(np.int64)
        value = words.mix(place ^ np.uint64(0x2545F4914F6CDD1D))
        m = int(base[-1])
        low = np.bincount(slot, (value & np.uint64(0xFFFFFFFF)).astype(np.float64), m).astype(np.uint64)
        high = np.bincount(slot, (value >> np.uint64(32)).astype(np.float64), m).astype(np.uint64)
        who = np.repeat(np.arange(len(sets)), parts)
        number = (np.arange(m) - base[who]).astype(np.uint64)
        content = words.mix(((high << np.uint64(32)) + low) ^ words.mix(seed[who] + number))
        small = np.array([what[b][2] <= SMALL for b in band + step])
        spare = np.array([what[b][4] for b in band + step], np.int64)
        keep = ~small[who]
        out_s.append(content[keep])
        out_i.append(who[keep])
        out_a.append((2 * (spare + 1) + step)[who[keep]])
        for b in np.unique((band + step)[small]):
            _, _, k, p, _ = what[b]
            rows = np.flatnonzero((band + step) == b)
            grid = content[base[rows][:, None] + np.arange(p)]
            for c, chosen in enumerate(combinations(range(p), p - k)):
                out_s.append(words.mix(grid[:, chosen].sum(axis=1, dtype=np.uint64) + np.uint64(c)))
                out_i.append(rows)
                out_a.append(np.full(len(rows), 2 + step))
    return np.concatenate(out_s), np.concatenate(out_i), np.concatenate(out_a).astype(np.int32)


def _chunks(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + CHUNK, "right")) - 1)
        yield a, min(b, n)
        a = b


def text_id(text: Column) -> Column:
    return F.xxhash64(text.cast("string")).alias("text_id")


def classified(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, text_id (a hash of the text), n_shingles, cls, second (the names of its set) of the columns doc_id and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = words.buffers(batch.column(1))
            for a, b in _chunks(data, offsets):
                sets = sets_of(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], width)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array([len(x) for x in sets], pa.int64()), *map(pa.array, names_of(sets))], ["doc_id", "text_id", "n_shingles", "cls", "second"])

    return docs.select("doc_id", "text", text_id(F.col("text"))).mapInArrow(run, "doc_id long, text_id long, n_shingles long, cls long, second long")


#: Sets that share a first name: of 10^12 classes, some 27,000 pairs are to be expected.
MOST_APART = 1 << 20


def told_apart(classes: DataFrame) -> tuple[DataFrame, DataFrame, Apart]:
    """(classes, owners: cls and the least doc_id of each class, the names of sets that share a first name)."""
    owners = written(classes.where("cls <> 0").groupBy("cls").agg(F.min("doc_id").alias("id"), F.min("second").alias("low"), F.max("second").alias("high")), "join-owners")
    odd = owners.where("low <> high").select("cls")
    if not odd.take(1):
        return classes.drop("second"), owners.select("cls", "id"), {}
    rows = classes.join(F.broadcast(odd), "cls", "left_semi").select("cls", "second").distinct().limit(MOST_APART + 1).collect()
    if len(rows) > MOST_APART:
        raise ValueError("more shared names than chance can make")
    taken, apart = set(), {}
    for cls, second in sorted(map(tuple, rows)):
        name = int(words.mix(np.array([cls, second], np.int64).view(np.uint64)).sum() & np.uint64((1 << 63) - 1)) or 1
        while name in taken:
            name += 1
        taken.add(name)
        apart[cls, second] = name
    names = F.broadcast(classes.sparkSession.createDataFrame([(*k, v) for k, v in apart.items()], "cls long, second long, name long"))  # MOST_APART rows at most
    classes = written(classes.join(names, ["cls", "second"], "left").withColumn("cls", F.coalesce("name", "cls")).drop("name", "second"), "join-classes")
    return classes, classes.where("cls <> 0").groupBy("cls").agg(F.min("doc_id").alias("id")), apart


def signed(docs: DataFrame, width: int, num: int, den: int, apart: Apart) -> DataFrame:
    """sig, cls, ask: the signatures of each class that a task meets, once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for batch in batches:
            data, offsets = words.buffers(batch.column(0))
            for a, b in _chunks(data, offsets):
                sets = sets_of(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], width)
                names = class_of(sets, apart)
                new = [i for i, c in enumerate(names.tolist()) if c and c not in done and not done.add(c)]
                if new:
                    s, i, ask = signatures([sets[k] for k in new], num, den)
                    s, c = s.view(np.int64), names[np.array(new)][i]
                    for k in range(0, len(s), 1 << 17):
                        yield pa.RecordBatch.from_arrays([pa.array(s[k : k + (1 << 17)]), pa.array(c[k : k + (1 << 17)]), pa.array(ask[k : k + (1 << 17)])], ["sig", "cls", "ask"])

    return docs.select("text").mapInArrow(run, "sig long, cls long, ask int")


def _map_bit(*columns: str) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(MAP_BITS))


def sets_for(docs: DataFrame, owners: DataFrame, wanted: DataFrame, width: int, whole: bool, apart: Apart) -> DataFrame:
    """cls, n and sketch or (whole) items of the wanted classes (column cls), made from one text of each."""
    spark = docs.sparkSession
    one = written(owners.join(wanted, "cls", "left_semi"), "join-wanted")
    shared = spark.sparkContext.broadcast(bitmap(_map_bit("id"), one))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            rows = pa.array(np.flatnonzero(in_map(bits, batch.column(2).to_numpy(zero_copy_only=False))))
            if not len(rows):
                continue
            ids, texts = batch.column(0).take(rows), batch.column(1).take(rows)
            data, offsets = words.buffers(texts)
            for a, b in _chunks(data, offsets):
                sets = sets_of(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], width)
                n = np.array([len(x) for x in sets], np.int64)
                if whole:
                    value = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)].astype(np.int32)), pa.array(np.concatenate(sets).view(np.int64)))
                else:
                    value = pa.array([sketch(x) for x in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array(class_of(sets, apart)), pa.array(n), value], ["id", "cls", "n", "items" if whole else "sketch"])

    found = docs.select("doc_id", "text", _map_bit("doc_id").alias("h")).mapInArrow(run, "id long, cls long, n long, " + ("items array<long>" if whole else "sketch binary"))
    return found.join(one.select("cls"), "cls", "left_semi").drop("id").dropDuplicates(["cls"])


def _linked(a: str, b: str, num: int, den: int):
    both = F.size(F.array_intersect(a, b)).cast("long")
    return den * both >= num * (F.size(a) + F.size(b) - both)


def _labelled(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """rows with lab: the root of cls."""
    return rows.join(roots.withColumnRenamed("v", "cls"), "cls", "left").withColumn("lab", F.coalesce("root", "cls")).drop("root")


def sketch(items: np.ndarray) -> bytes:
    """A parity bitmap of at least four bits a feature: two sets' bitmaps differ in no more bits than the sets in features."""
    bits = 256
    while bits < 4 * len(items):
        bits *= 2
    place = (words.mix(items ^ np.uint64(0x6A09E667F3BCC909)) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(place, minlength=bits) & 1).astype(bool), bitorder="little").tobytes()


def _folded(x: np.ndarray, width: int) -> np.ndarray:
    """Bitmaps (rows) folded to `width` words."""
    while x.shape[1] > width:
        x = x[:, : x.shape[1] // 2] ^ x[:, x.shape[1] // 2 :]
    return x


def _possible(n: np.ndarray, m: np.ndarray, apart: np.ndarray, num: int, den: int) -> np.ndarray:
    """Whether sets of n and m features that differ in `apart` at least can be linked."""
    both = np.minimum((n + m - apart) // 2, np.minimum(n, m))
    return den * both >= num * (n + m - both)


def close(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (c, cls) whose sizes and bitmaps allow a link."""
    slim = sets.select("cls", "n", "sketch")
    rows = pairs.join(slim, "cls").join(slim.toDF("c", "m", "other"), "c").select("c", "cls", "n", "m", "sketch", "other")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            apart = np.zeros(len(n), np.int64)
            for i, (x, y) in enumerate(zip(batch.column(4), batch.column(5))):
                x, y = (np.frombuffer(z.as_py(), np.uint64)[None] for z in (x, y))
                w = min(x.shape[1], y.shape[1])
                apart[i] = np.bitwise_count(_folded(x, w) ^ _folded(y, w)).sum()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["c", "cls"]).filter(pa.array(_possible(n, m, apart, num, den)))

    return rows.mapInArrow(run, "c long, cls long")


def _cell_pairs(num: int, den: int):
    """Of a cell (one block, or two): the pairs from different components whose sizes and bitmaps allow a link."""

    def run(table: pa.Table) -> pa.Table:
        cls, lab, n = (table[x].to_numpy() for x in ("cls", "lab", "n"))
        maps = [np.frombuffer(x.as_py(), np.uint64) for x in table["sketch"]]
        widths = np.array([len(x) for x in maps])
        out = []
        for w in np.unique(widths):
            # Sets so unlike in size that one's bitmap is over twice the other's can't be linked.
            few, more = np.flatnonzero(widths == w), np.flatnonzero((widths >= w) & (widths <= 2 * w))
            x = np.stack([maps[i] for i in few])
            y = np.concatenate([_folded(np.stack([maps[i] for i in more if widths[i] == v]), w) for v in (w, 2 * w) if (widths[more] == v).any()])
            more = np.concatenate([[i for i in more if widths[i] == v] for v in (w, 2 * w)]).astype(np.int64)
            for a in range(0, len(few), 64):
                f = few[a : a + 64]
                apart = np.zeros((len(f), len(more)), np.int64)
                for k in range(w):
                    apart += np.bitwise_count(x[a : a + 64, k, None] ^ y[None, :, k])
                hit = _possible(n[f][:, None], n[more][None, :], apart, num, den) & (lab[f][:, None] != lab[more][None, :]) & (cls[f][:, None] != cls[more][None, :])
                i, j = np.nonzero(hit)
                out.append((np.maximum(cls[f[i]], cls[more[j]]), np.minimum(cls[f[i]], cls[more[j]])))
        found = np.unique(np.concatenate([np.stack(x, 1) for x in out]), axis=0) if out else np.zeros((0, 2), np.int64)
        return pa.table([pa.array(found[:, 1]), pa.array(found[:, 0])], ["c", "cls"])

    return run


def verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """a, b: those of the pairs (c, cls) that are links, by their whole sets."""
    full, other = sets.select("cls", "items"), sets.select(F.col("cls").alias("c"), F.col("items").alias("others"))
    found = pairs.join(full, "cls").join(other, "c").where(_linked("items", "others", num, den))
    return written(found.select(F.col("c").alias("a"), F.col("cls").alias("b")), "join-links")


def proven(pairs: DataFrame, sets_of_: Callable[[DataFrame], DataFrame], num: int, den: int) -> DataFrame:
    """Links among the pairs, enough of them to give all components that the pairs' links make.

    Each class is compared with one other first; pairs that this puts in one component needn't be.
    """
    sets = written(sets_of_(pairs.select("cls").union(pairs.select(F.col("c").alias("cls"))).distinct()), "join-sets")
    one = verified(pairs.groupBy("cls").agg(F.min("c").alias("c")), sets, num, den)
    roots = components_of(one)
    far = _labelled(pairs, roots).withColumnRenamed("lab", "x").join(roots.toDF("c", "root"), "c", "left").where(F.col("x") != F.coalesce("root", "c"))
    far = written(far.select("c", "cls"), "join-pairs")
    return one.union(verified(far, sets, num, den)) if far.take(1) else one


def grouped(rows: DataFrame) -> DataFrame:
    """The distinct rows whose signature has several classes, with the least of them (c) and their number (size)."""
    by = Window.partitionBy("sig")
    once = rows.select("sig", "cls", "ask").repartition("sig").groupBy("sig", "cls").agg(F.max("ask").alias("ask"))  # one exchange for both
    return once.withColumns({"c": F.min("cls").over(by), "size": F.count(F.lit(1)).over(by)}).where("size > 1")


def rare(met: DataFrame) -> DataFrame:
    """met without the signatures under which each class meets the most others, as many as a link shares less one.

    Classes that share t signatures share one that isn't among the t - 1 commonest of
    either (the rarest that they share), so all links still meet; common lines and
    passages, which make the largest groups, mostly don't.
    """
    by = Window.partitionBy("cls", F.col("ask") % 2).orderBy(F.col("size").desc(), "sig")
    return met.withColumn("_k", F.row_number().over(by)).where(F.col("_k") >= F.shiftright("ask", 1)).drop("_k", "c")


def roots_of(docs: DataFrame, owners: DataFrame, width: int, num: int, den: int, apart: Apart) -> DataFrame:
    """v, root: the least class of the component of each class that isn't the least itself."""
    met = written(grouped(signed(docs, width, num, den, apart)), "join-met")
    release(docs.sparkSession)  # of the signatures most are met once; their shuffle files are the largest there are
    met = written(grouped(rare(met)), "join-met")
    pairs = written(met.where("cls <> c").select("c", "cls").distinct(), "join-pairs")
    wanted = pairs.select("cls").union(pairs.select(F.col("c").alias("cls"))).distinct()
    sets = written(sets_for(docs, owners, wanted, width, False, apart), "join-sketches")
    whole = lambda some: sets_for(docs, owners, some, width, True, apart)
    first = components_of(proven(written(close(pairs, sets, num, den), "join-close"), whole, num, den))
    # Signatures whose classes, the least one apart, are still in several components. Home: where a class's block is.
    open_ = written(_labelled(met.where("cls <> c"), first), "join-labelled")
    mixed = open_.groupBy("sig").agg(F.min("lab").alias("x"), F.max("lab").alias("y")).where("x <> y").select("sig")
    rest = written(spread_join(open_, mixed, "sig"), "join-open")
    if not rest.take(1):
        return first
    # The least that any class under one of its signatures meets: then those that meet often share a home, and blocks are full.
    least = rest.groupBy("cls").agg(F.min("c").alias("home"))
    near = rest.select("sig", "cls").join(least, "cls").groupBy("sig").agg(F.min("home").alias("home"))
    home = spread_join(rest.select("sig", "cls", "lab"), near, "sig").groupBy("cls", "lab").agg(F.min("home").alias("home"))
    sizes = home.groupBy("home").agg(F.ceil(F.count(F.lit(1)) / F.lit(float(BLOCK))).alias("k"))
    home = written(home.join(sizes, "home").select("cls", "lab", F.struct("home", F.pmod(F.xxhash64("cls"), F.col("k")).alias("i")).alias("block")), "join-blocks")
    at = rest.select("sig", "cls").join(home, "cls").select("sig", "block").distinct()
    cells = at.join(at.withColumnRenamed("block", "other"), "sig").where("block <= other").select("block", "other").distinct()
    rows = cells.select("block", "other", F.explode(F.array_distinct(F.array("block", "other"))).alias("own")).join(home.withColumnRenamed("block", "own"), "own").join(sets.select("cls", "n", "sketch"), "cls")
    second = rows.select("block", "other", "cls", "lab", "n", "sketch").groupBy("block", "other").applyInArrow(_cell_pairs(num, den), "c long, cls long")
    second = written(second.distinct(), "join-close")
    if not second.take(1):
        return first
    new = proven(second, whole, num, den)
    if not new.take(1):
        return first
    # The new links join the roots of the first components.
    up = first.toDF("b", "y")
    over = _labelled(new.select(F.col("b"), F.col("a").alias("cls")), first).join(up, "b", "left").select(F.col("lab").alias("a"), F.coalesce("y", "b").alias("b"))
    more = components_of(over)
    moved = first.join(more.toDF("root", "top"), "root", "left").select("v", F.coalesce("top", "root").alias("root"))
    return written(moved.union(more), "join-roots")


def components(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, text_id, n_shingles, cls (its class of equal sets), component_id (the least id that links reach, its own included)."""
    rows = docs.select(column(id_col).cast("long").alias("doc_id"), column(text_col).cast("string").alias("text"))
    classes, owners, apart = told_apart(written(classified(rows, width), "join-classes"))
    roots = roots_of(rows, owners, width, num, den, apart)
    # By class first: a giant component is many rows of one label, and copies many of one class.
    named = written(_labelled(owners, roots), "join-named")
    named = spread_join(named, named.groupBy("lab").agg(F.min("id").alias("component_id")), "lab").select("cls", "component_id")
    own = ["doc_id", "text_id", "n_shingles", "cls", "component_id"]
    linked = spread_join(classes.where("cls <> 0"), written(named, "join-named"), "cls").select(*own)
    return linked.union(classes.where("cls = 0").withColumn("component_id", F.col("doc_id")).select(*own))


def representatives(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs less all but one document of each component: the one with the least id (and text hash) stays.

    Documents without words are in no group and stay. Of rows that repeat both id and
    text one stays.
    """
    found = written(components(docs, width, num, den, id_col, text_col), "join-components")
    release(docs.sparkSession)
    first = found.where("cls <> 0").groupBy("component_id").agg(F.min(F.struct("doc_id", "text_id")).alias("k")).select("k.doc_id", "k.text_id")
    every = found.groupBy("doc_id", "text_id").agg(F.count(F.lit(1)).alias("n"), F.max("cls").alias("cls"), F.min("cls").alias("low"))
    stays = first.withColumn("first", F.lit(True))
    same = every["doc_id"].eqNullSafe(stays["doc_id"]) & (every["text_id"] == stays["text_id"])
    marked = every.join(stays, same, "left").select(every["doc_id"], every["text_id"], "n", (F.coalesce("first", F.lit(False)) | ((F.col("cls") == 0) & (F.col("low") == 0))).alias("kept"))
    marked = written(marked, "join-kept")
    # Most rows stay and don't repeat. The others are in a map; rows outside it pass where they are, those in it are joined.
    odd = marked.where(~F.col("kept") | (F.col("n") > 1))
    shared = docs.sparkSession.sparkContext.broadcast(bitmap(_map_bit("doc_id", "text_id"), odd))
    # Rows are carried whole, so that no name of a column matters.
    rows = docs.select(F.struct(*map(column, docs.columns)).alias("row"), column(id_col).cast("long").alias("id"), text_id(column(text_col))).withColumn("bit", _map_bit("id", "text_id"))
    schema = rows.schema

    def passing(inside: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                hit = in_map(shared.value, batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False))
                yield batch.filter(pa.array(hit == inside))

        return rows.mapInArrow(run, schema)

    key = ["id", "text_id", "null"]
    kept = marked.where("kept").select(F.col("doc_id").alias("id"), "text_id").withColumns({"null": F.col("id").isNull()}).withColumn("id", F.coalesce("id", F.lit(0).cast("long")))
    joined = passing(True).withColumn("null", F.col("id").isNull()).withColumn("id", F.coalesce("id", F.lit(0).cast("long"))).join(kept, key, "left_semi").dropDuplicates(key)
    return passing(False).select("row.*").union(joined.select("row.*"))

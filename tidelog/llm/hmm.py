"""A hidden Markov language model, trained by Baum-Welch over the whole corpus.

Tokens are words (lower-cased A-Z) and an end after each text. The STATES latent states
emit symbols: each of the most frequent words, the end, and classes of all other words
(by their last two bytes and length). Within a class a word has its share of the
class's training tokens, and words never seen together have the share that once-seen
words have (Good-Turing), counted as one event, as in the base model. So every
text has an exact probability: the scaled forward recursion over its symbols times the
shares of its class words.

What is counted: every training token, by word, in one distributed sum. Words at or
above a count that HEAD words exceed at most are looked up in a broadcast table of that
bound; all others meet their counts in a join, so no count is dropped or hashed away.
(Words are told apart by 64-bit hashes.) In a pass of Baum-Welch each task sums the
expected counts of its texts and Spark adds them up by symbol. Every pass runs over all
training texts, from a start made of the counts alone. From pass LEAST on, one that gains
less than TOLERANCE in log10 likelihood a token is the last; nothing else bounds their
number (no likelihood is above 0, so gains of that size run out).

Defined cases: null text is empty and consists of the end alone; rows that repeat are
scored (and learned from) as often as they occur; a null id belongs to the training
part; without any training text the base has N = V = 0 and the model its prior; a very
long text is scored and learned from whole, in pieces of CHUNK tokens that hand on their
state, so what a task holds of it at once is bounded but for its symbols; an empty table
gives an empty result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm import text as words
from tidelog.llm.cluster import column, written
from tidelog.llm.langid import held_out

STATES = 8
#: Most words with a broadcast count, and most with emissions of their own.
HEAD, OWN = 1 << 18, 1 << 14
CLASSES = 1 << 10
#: Baum-Welch: passes before gains count, and the gain in log10 likelihood a token below which a pass is the last.
LEAST, TOLERANCE = 5, 0.005
#: Weight of the corpus distribution in each state's emissions, and of even transitions, in tokens.
PRIOR, EVEN = 200.0, 1.0
FLUSH, CHUNK = 1 << 22, 1 << 19


def classes(shape: np.ndarray) -> np.ndarray:
    return (words.mix(shape.astype(np.uint64)) % np.uint64(CLASSES)).astype(np.int32)


def count_words(docs: DataFrame) -> DataFrame:
    """w (hash), cls, c: how often each word occurs in the column text, summed in each task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, k, size = [], [], 0

        def flush():
            w, first, n = np.unique(np.concatenate(h), return_index=True, return_counts=True)
            c = np.concatenate(k)[first]
            for a in range(0, len(w), 1 << 16):
                b = slice(a, a + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(w[b].view(np.int64)), pa.array(c[b]), pa.array(n[b])], ["w", "cls", "c"])

        for batch in batches:
            data, offsets = words.buffers(batch.column(0))
            for a in range(0, len(offsets) - 1, 1024):
                o = offsets[a : a + 1025]
                w, _, shape = words.hash_words(data[o[0] : o[-1]], o - o[0], shapes=True)
                h.append(w)
                k.append(classes(shape))
                size += len(w)
                if size >= FLUSH:
                    yield from flush()
                    h, k, size = [], [], 0
        if size:
            yield from flush()

    return docs.select("text").mapInArrow(run, "w long, cls int, c long").groupBy("w", "cls").agg(F.sum("c").alias("c"))


@dataclass
class Words:
    """The broadcast part of the counts. Symbols: 0..own-1 words, then the end, then the classes."""

    tokens: int
    distinct: int
    texts: int
    keys: np.ndarray  # sorted hashes of the head
    counts: np.ndarray
    symbols: np.ndarray  # symbol of each head word
    own: int
    totals: np.ndarray  # tokens of each class
    unseen: np.ndarray  # weight of never seen words in each class
    weight: np.ndarray  # training tokens of each symbol

    def share(self, c: np.ndarray, cls: np.ndarray) -> np.ndarray:
        """log10 of a class word's share of its class."""
        return np.log10(np.where(c > 0, c, self.unseen[cls]) / (self.totals[cls] + self.unseen[cls]))

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.5) / (self.tokens + 0.5 * (self.distinct + 1)))


def head(counts: DataFrame, texts: int) -> Words:
    """The words whose counts reach bounds that at most HEAD and OWN words reach; class totals of all others."""
    # Counts up to 64 have a level each, larger ones 16 a doubling: about a thousand levels.
    level = F.when(F.col("c") <= 64, F.col("c")).otherwise(F.lit(65) + F.floor(F.log2(F.col("c") / 64.0) * 16)).cast("int")
    rows = counts.select("w", "cls", "c", level.alias("level"))
    levels = sorted(((r["level"], r["n"], r["s"]) for r in rows.groupBy("level").agg(F.count(F.lit(1)).alias("n"), F.sum("c").alias("s")).collect()), reverse=True)
    cut, own_cut, seen = 1 << 30, 1 << 30, 0
    for lv, n, _ in levels:
        seen += n
        cut = lv if seen <= HEAD else cut
        own_cut = lv if seen <= OWN else own_cut
    top = rows.where(F.col("level") >= cut).select("w", "cls", "c", (F.col("level") >= own_cut).alias("own")).toPandas()
    w = top["w"].to_numpy(np.int64, copy=True).view(np.uint64)
    order = np.argsort(w)
    w, c, cls, own = w[order], top["c"].to_numpy(np.int64)[order], top["cls"].to_numpy(np.int32)[order], top["own"].to_numpy(bool)[order]
    n_own = int(own.sum())
    symbols = np.where(own, np.cumsum(own) - 1, n_own + 1 + cls).astype(np.int32)
    rest = rows.where(F.col("level") < own_cut).groupBy("cls").agg(F.sum("c").alias("t"), F.sum((F.col("c") == 1).cast("long")).alias("once")).collect()
    totals, unseen = np.zeros(CLASSES), np.full(CLASSES, 0.5)
    for r in rest:
        totals[r["cls"]] = r["t"]
        unseen[r["cls"]] += r["once"]
    tokens = sum(s for *_, s in levels) + texts
    weight = np.concatenate([c[own], [max(texts, 0.5)], totals + 0.5])
    return Words(tokens, sum(n for _, n, _ in levels) + (texts > 0), texts, w, c, symbols, n_own, totals, unseen, weight)


SEEN = "rid long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, shared double, symbols binary, tail binary"


def encode(docs: DataFrame, known: Words) -> DataFrame:
    """Each text as symbols, with what the broadcast counts give; `tail` holds (hash, class) of the words they don't have."""
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, pack = shared.value, zstandard.ZstdCompressor(level=1).compress
        end_base = float(v.base(np.array(v.texts)))
        for batch in batches:
            data, offsets = words.buffers(batch.column(3))
            for a in range(0, batch.num_rows, 512):
                o = offsets[a : a + 513]
                w, first, shape = words.hash_words(data[o[0] : o[-1]], o - o[0], shapes=True)
                cls = classes(shape)
                at = np.minimum(np.searchsorted(v.keys, w), max(0, len(v.keys) - 1))
                hit = v.keys[at] == w if len(v.keys) else np.zeros(len(w), bool)
                c = np.where(hit, v.counts[at], 0) if len(v.keys) else np.zeros(len(w), np.int64)
                symbol = np.where(hit, v.symbols[at], v.own + 1 + cls) if len(v.keys) else v.own + 1 + cls
                symbol = symbol.astype(np.int32)
                base = np.where(hit, v.base(c), 0.0)
                inside = np.where(hit & (symbol > v.own), v.share(c, cls), 0.0)
                run_sum = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[first])
                n = len(o) - 1
                ids = [pack(np.append(symbol[p:q], v.own).astype(np.int32).tobytes()) for p, q in zip(first, first[1:])]
                tails = []
                for p, q in zip(first, first[1:]):
                    miss = np.flatnonzero(~hit[p:q]) + p
                    tails.append(w[miss].tobytes() + cls[miss].tobytes())
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).slice(a, n) for i in range(3)), pa.array(np.diff(first) + 1), pa.array(run_sum(hit) + (v.texts > 0)), pa.array(run_sum(base) + end_base), pa.array(run_sum(inside)), pa.array(ids, pa.binary()), pa.array(tails, pa.binary())],
                    [x.split()[0] for x in SEEN.split(", ")],
                )

    return docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "held_out", "text").mapInArrow(run, SEEN)


def tail_scores(seen: DataFrame, counts: DataFrame, known: Words) -> DataFrame:
    """rid, and the sums over its tail words of known, base and shared, by a join with the counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [(r, x.as_py()) for r, x in zip(batch.column(0).to_pylist(), batch.column(1))]
            for a in range(0, len(parts), 256):
                rid, w, cls = [], [], []
                for r, raw in parts[a : a + 256]:
                    n = len(raw) // 12
                    w.append(np.frombuffer(raw, np.int64, n))
                    cls.append(np.frombuffer(raw, np.int32, n, 8 * n))
                    rid.append(np.full(n, r))
                if w:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(rid).astype(np.int64)), pa.array(np.concatenate(w)), pa.array(np.concatenate(cls))], ["rid", "w", "cls"])

    rows = seen.where(F.octet_length("tail") > 0).select("rid", "tail").mapInArrow(run, "rid long, w long, cls int")
    sizes = seen.sparkSession.createDataFrame([(i, float(t), float(u)) for i, (t, u) in enumerate(zip(known.totals, known.unseen))], "cls int, t double, u double")
    c = F.coalesce(F.col("c"), F.lit(0))
    # A table of CLASSES rows is broadcast.
    met = rows.join(counts.select("w", "c"), "w", "left").join(F.broadcast(sizes), "cls")
    return met.groupBy("rid").agg(
        F.sum((c > 0).cast("long")).alias("k"),
        F.sum(F.log10((c + 0.5) / (known.tokens + 0.5 * (known.distinct + 1)))).alias("b"),
        F.sum(F.log10(F.when(c > 0, c.cast("double")).otherwise(F.col("u")) / (F.col("t") + F.col("u")))).alias("s"),
    )


@dataclass
class Model:
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray  # symbols x states


def grouped(symbols: list[np.ndarray]) -> Iterator[list[int]]:
    """Texts in groups of bounded size, longest first, so that a group's texts are about as long."""
    group, size = [], 0
    for i in sorted(range(len(symbols)), key=lambda i: -len(symbols[i])):
        if group and size + len(symbols[i]) > CHUNK:
            yield group
            group, size = [], 0
        group.append(i)
        size += len(symbols[i])
    if group:
        yield group


def _by_step(symbols: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of texts (longest first) step by step, and where each step begins."""
    n = np.array([len(x) for x in symbols])
    active = np.searchsorted(-n, -np.arange(n[0]), "left")
    begin = np.concatenate([[0], np.cumsum(active)])
    out = np.empty(int(begin[-1]), np.int32)
    for j, x in enumerate(symbols):
        out[begin[: len(x)] + j] = x
    return out, begin


def forward(model: Model, symbols: list[np.ndarray], keep: bool = False):
    """log10 likelihood of each text (longest first) by the scaled forward recursion; with `keep`, what the backward pass needs."""
    order, begin = _by_step(symbols)
    e = model.emit[order]
    logs = np.zeros(len(symbols))
    scale = np.empty(len(order)) if keep else None
    alpha = None
    for t in range(len(begin) - 1):
        a, b = begin[t], begin[t + 1]
        now = e[a:b] * (model.start if t == 0 else alpha[: b - a] @ model.move)
        c = now.sum(axis=1)
        now /= c[:, None]
        logs[: b - a] += np.log10(c)
        alpha = now
        if keep:
            scale[a:b] = c
            e[a:b] /= c[:, None]
            if t == 0:
                alphas = np.empty_like(e)
            alphas[a:b] = now
    return (logs, order, begin, e, alphas) if keep else logs


def expected(model: Model, symbols: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected starts, moves and emissions of texts, and their log10 likelihood."""
    h = len(model.start)
    start, move, emit, total = np.zeros(h), np.zeros((h, h)), np.zeros(model.emit.shape), 0.0
    for group in grouped(symbols):
        if len(group) == 1 and len(symbols[group[0]]) > CHUNK:
            for mine, more in zip((start, move, emit), pieces := _long_expected(model, symbols[group[0]])):
                mine += more
            total += pieces[3]
            continue
        logs, order, begin, e, gamma = forward(model, [symbols[i] for i in group], keep=True)
        total += logs.sum()
        beta = np.ones((begin[-1] - begin[-2], h))
        for t in range(len(begin) - 3, -1, -1):
            a, b, c = begin[t], begin[t + 1], begin[t + 2]
            weighted = e[b:c] * beta
            move += gamma[a : a + c - b].T @ weighted
            gamma[b:c] *= beta
            beta = np.ones((b - a, h))
            beta[: c - b] = weighted @ model.move.T
        gamma[: begin[1]] *= beta
        start += gamma[: begin[1]].sum(axis=0)
        for s in range(h):
            emit[:, s] += np.bincount(order, gamma[:, s], len(emit))
    return start, move * model.move, emit, total


def _piece(model: Model, x: np.ndarray, alpha: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, float]:
    """Scaled emissions and forward states of a piece of a text, and its log10 likelihood after the state before it (None: at the start)."""
    e = model.emit[x]
    alphas, log = np.empty_like(e), 0.0
    for t in range(len(x)):
        now = e[t] * (model.start if alpha is None else alpha @ model.move)
        c = now.sum()
        e[t] /= c
        alphas[t] = alpha = now / c
        log += np.log10(c)
    return e, alphas, log


def _long_forward(model: Model, x: np.ndarray) -> float:
    """forward of one text, piece by piece."""
    alpha, log = None, 0.0
    for a in range(0, len(x), CHUNK):
        _, alphas, more = _piece(model, x[a : a + CHUNK], alpha)
        alpha, log = alphas[-1], log + more
    return log


def _long_expected(model: Model, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """What one text adds to the sums of `expected`: forward for the state before each piece, then backward piece by piece."""
    before, total = [None], 0.0
    for a in range(0, len(x), CHUNK):
        _, alphas, log = _piece(model, x[a : a + CHUNK], before[-1])
        before.append(alphas[-1])
        total += log
    h = len(model.start)
    move, emit, beta = np.zeros((h, h)), np.zeros(model.emit.shape), np.ones(h)
    for k in range(len(before) - 2, -1, -1):
        part = x[k * CHUNK : (k + 1) * CHUNK]
        e, alphas, _ = _piece(model, part, before[k])
        gamma = np.empty_like(e)
        for t in range(len(part) - 1, -1, -1):
            gamma[t] = alphas[t] * beta
            e[t] *= beta
            beta = model.move @ e[t]
        move += alphas[:-1].T @ e[1:]
        if k:
            move += np.outer(before[k], e[0])
        for s in range(h):
            emit[:, s] += np.bincount(part, gamma[:, s], len(emit))
    return gamma[0], move, emit, total


def maximised(start, move, emit, weight) -> Model:
    corpus = weight / weight.sum()
    emit = emit + PRIOR * corpus[:, None]
    start, move = start + EVEN, move + EVEN
    return Model(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def begin(known: Words, seed: int = 17) -> Model:
    """States of slightly different emissions that like to stay."""
    rng = np.random.default_rng(seed)
    corpus = known.weight / known.weight.sum()
    emit = corpus[:, None] * rng.gamma(2.0, 0.5, (len(corpus), STATES))
    move = np.full((STATES, STATES), 0.1 / STATES) + 0.9 * np.eye(STATES)
    return Model(np.full(STATES, 1 / STATES), move, emit / emit.sum(axis=0))


def unpacked(column: pa.Array) -> list[np.ndarray]:
    unpack = zstandard.ZstdDecompressor().decompress
    return [np.frombuffer(unpack(x.as_py()), np.int32) for x in column]


def aggregated(rows: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, float, int]:
    """Expected starts, moves and emissions of the column symbols of all rows, their log10 likelihood and number of tokens: sums of tasks' sums."""
    shared, h = rows.sparkSession.sparkContext.broadcast(model), len(model.start)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        start, move, emit, log, n = np.zeros(h), np.zeros((h, h)), np.zeros(m.emit.shape), 0.0, 0
        for batch in batches:
            if batch.num_rows:
                symbols = unpacked(batch.column(0))
                s, x, e, more = expected(m, symbols)
                start, move, emit, log, n = start + s, move + x, emit + e, log + more, n + sum(map(len, symbols))
        if n:
            # Rows below zero: -1 the starts, -2 the likelihood and the tokens, -3 - i the moves from state i.
            used = np.flatnonzero(emit.any(axis=1))
            ids = np.concatenate([used, [-1, -2], -3 - np.arange(h)])
            values = np.concatenate([emit[used], start[None], [[log, n] + [0] * (h - 2)], move])
            yield pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int32)), *(pa.array(np.ascontiguousarray(values[:, k])) for k in range(h))], ["id", *(f"s{k}" for k in range(h))])

    # A row for each symbol: bounded by OWN + CLASSES.
    sums = rows.select("symbols").mapInArrow(run, "id int, " + ", ".join(f"s{k} double" for k in range(h))).groupBy("id").agg(*(F.sum(f"s{k}").alias(f"s{k}") for k in range(h))).toPandas()
    ids, values = sums["id"].to_numpy(), sums[[f"s{k}" for k in range(h)]].to_numpy()
    emit, move = np.zeros(model.emit.shape), np.zeros((h, h))
    if not len(ids):
        return np.zeros(h), move, emit, 0.0, 0
    emit[ids[ids >= 0]] = values[ids >= 0]
    move[-3 - ids[ids < -2]] = values[ids < -2]
    log, n = values[ids == -2][0][:2]
    return values[ids == -1][0], move, emit, float(log), int(n)


def baum_welch(seen: DataFrame, known: Words) -> Model:
    """Trained on all rows of `seen` that aren't held out, in every pass."""
    rows, model = seen.where(~F.col("held_out")), begin(known)
    if not known.texts:
        return model
    last = -np.inf
    for k in count(1):
        *counts, log, n = aggregated(rows, model)
        model = maximised(*counts, known.weight)
        if k >= LEAST and not log / n - last >= TOLERANCE:
            return model
        last = log / n


def likelihoods(seen: DataFrame, model: Model) -> DataFrame:
    """rid, forward: log10 likelihood of the symbols."""
    shared = seen.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            symbols = unpacked(batch.column(batch.schema.get_field_index("symbols")))
            out = np.zeros(len(symbols))
            for group in grouped(symbols):
                long = len(group) == 1 and len(symbols[group[0]]) > CHUNK
                out[group] = _long_forward(shared.value, symbols[group[0]]) if long else forward(shared.value, [symbols[i] for i in group])
            yield batch.drop_columns(["symbols"]).append_column("forward", pa.array(out))

    names = ["rid", "doc_id", "held_out", "n_tokens", "n_known", "base", "shared"]
    kinds = dict(seen.dtypes)
    return seen.select(*names, "symbols").mapInArrow(run, ", ".join([*(f"{n} {kinds[n]}" for n in names), "forward double"]))


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int = 5, part: int = 1) -> DataFrame:
    """Trains on the rows outside the held-out part and scores all: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    rows = docs.select(column(id_col).cast("long").alias("doc_id"), held_out(column(id_col), parts, part).alias("held_out"), column(text_col).cast("string").alias("text"))
    counts = written(count_words(rows.where(~F.col("held_out"))), "lm-counts")
    known = head(counts, rows.where(~F.col("held_out")).count())
    seen = written(encode(rows, known), "lm-symbols")
    model = baum_welch(seen, known)
    done = likelihoods(seen, model).join(tail_scores(seen, counts, known), "rid", "left")
    return done.select(
        "doc_id", "held_out", "n_tokens",
        (F.col("n_known") + F.coalesce("k", F.lit(0))).alias("n_known"),
        F.lit(known.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("b", F.lit(0.0))).alias("base_score"),
        (F.col("forward") + F.col("shared") + F.coalesce("s", F.lit(0.0))).alias("score"),
    )

"""Language identification by interpolated Kneser-Ney character models.

For each language an order-4 model over lower-cased characters, with one discount for
each order (Ney's estimate from the counts of counts) and continuation counts below
the top order. The models of all languages stand side by side in one table for each
order: a sorted array of hashed n-grams, with the log probabilities of all languages
in each row; a second sorted array holds the back-off weights of the contexts. A text
goes to the language with the lowest cross-entropy per character.

A symbol is a code point of the fitting sample, in 16 bits; those that the sample doesn't
hold are one unknown symbol. If the sample holds more code points than 16 bits number, the
symbols are UTF-16 units instead, so that none is merged with another.

The fit uses a bounded sample of labelled rows: up to PER_LANGUAGE texts of each
language, of at most FIT_CHARS characters each, in the order of the hash of their ids.
A language with fewer such texts is filled up with passages of FIT_CHARS characters from
longer ones, each at a place given by the hash of its id. Beyond TEXTS / PER_LANGUAGE
languages each gets an equal share of TEXTS, LEAST_TEXTS at least. Every text is scored whole.

Rejection: on a part of the sample kept from the fit, each language's cross-entropy
has a mean and a variance a + b / n_chars; a text is rejected if it has no letter or
lies over REJECT standard deviations above the mean of its best language; its score falls
with the distance.

Defined cases: null, empty and letterless texts are `und` with score 0; ties go to the
language first in code-point order; without labelled rows (an empty table too) there is no
model and everything is `und`, rejected; rows that repeat are scored alike; very long texts
are scored in chunks of bounded size; extra columns stay in `classify`, but for those named
(in any case) like a result, which the result replaces.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.llm.cluster import column
from tidelog.llm.text import mix

ORDER = 4
#: Bits of a symbol: ORDER symbols fill 64.
BITS = 16
PER_LANGUAGE, FIT_CHARS = 400, 20_000
TEXTS, LEAST_TEXTS = 40_000, 8
REJECT = 12.0
#: Characters of text that are scored at once.
CHUNK = 1 << 19
#: The score is the share of the best language where each language's likelihood is taken to this power for a character.
SHARPNESS = 0.25
START = "\x02"
_LETTER = regex.compile(r"\p{L}")


@dataclass
class Table:
    """Sorted hashes, with a column of values for each language; the index gives where each leading part of a hash begins."""

    keys: np.ndarray
    values: np.ndarray
    bits: int = 0
    index: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int32))
    deepest: int = 0

    @classmethod
    def of(cls, grams: np.ndarray, values: np.ndarray) -> Table:
        keys = mix(grams.astype(np.uint64))
        k = np.argsort(keys)
        keys, values = keys[k], values[k].astype(np.float32)
        bits = max(1, int(len(keys)).bit_length())
        index = np.searchsorted(keys >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.int32)
        return cls(np.append(keys, ~np.uint64(0)), np.vstack([values, np.zeros((1, values.shape[1]), np.float32)]), bits, index, int(np.diff(index).max(initial=0)))

    def find(self, grams: np.ndarray) -> np.ndarray:
        """Row of each n-gram; -1 where it isn't there."""
        keys = mix(grams)
        at = self.index[(keys >> np.uint64(64 - self.bits)).astype(np.int64)]
        hit = self.keys[at] == keys
        row = np.where(hit, at, -1)
        left = np.flatnonzero(~hit)
        for step in range(1, self.deepest):
            if not len(left):
                break
            here = np.minimum(at[left] + step, len(self.keys) - 1)
            hit = self.keys[here] == keys[left]
            row[left[hit]] = here[hit]
            left = left[~hit]
        return row


@dataclass
class Model:
    languages: list[str]
    letters: np.ndarray  # code point (or UTF-16 unit) -> symbol; 0: unknown
    grams: list[Table]  # by order from 2: log probabilities
    contexts: list[Table]  # by order from 2: log weight of backing off
    unigram: np.ndarray
    mean: np.ndarray
    spread: np.ndarray  # a and b of each language
    units: bool = False  # whether symbols stand for UTF-16 units


def lines(texts: list[str], units: bool = False) -> np.ndarray:
    """Code points (or UTF-16 units) of the texts, each after ORDER - 1 start marks."""
    pad = START * (ORDER - 1)
    whole = "".join(pad + x.lower().replace(START, " ") for x in texts)
    return np.frombuffer(whole.encode("utf-16-le"), np.uint16) if units else np.frombuffer(whole.encode("utf-32-le"), np.uint32)


def _grams(symbols: np.ndarray, order: int) -> np.ndarray:
    """n-gram ending at each place, packed in BITS bits a symbol."""
    out = symbols.astype(np.uint64)
    for k in range(1, order):
        out[k:] |= symbols[:-k].astype(np.uint64) << np.uint64(BITS * k)
    return out


def _kneser_ney(counts: dict[int, list[tuple[np.ndarray, np.ndarray]]], size: int):
    """Log probabilities and back-off weights of one language. counts[order]: the n-grams of the order and what they count."""
    unigrams, n = counts[1]
    prob1 = np.zeros(size)
    prob1[unigrams.astype(np.int64)] = n
    d = _discount(n)
    total = prob1.sum()
    prob1 = np.maximum(prob1 - d, 0) / total + d * len(n) / total / size
    lower_keys, lower_prob = np.arange(size, dtype=np.uint64), prob1
    tables = {1: prob1}
    for order in range(2, ORDER + 1):
        g, n = counts[order]
        d = _discount(n)
        context = g >> np.uint64(BITS)
        ctx, inverse = np.unique(context, return_inverse=True)
        total = np.bincount(inverse, n)
        gamma = d * np.bincount(inverse) / total
        suffix = g & np.uint64((1 << (BITS * (order - 1))) - 1)
        at = np.searchsorted(lower_keys, suffix)
        prob = np.maximum(n - d, 0) / total[inverse] + gamma[inverse] * lower_prob[at]
        tables[order] = (g, prob, ctx, gamma)
        lower_keys, lower_prob = g, prob
    return tables


def _discount(n: np.ndarray) -> float:
    n1, n2 = int((n == 1).sum()), int((n == 2).sum())
    return min(0.95, max(0.1, n1 / (n1 + 2 * n2))) if n1 else 0.5


def _prob(tables, order: int, grams: np.ndarray) -> np.ndarray:
    """The model's probability of any n-grams, seen or not."""
    if order == 1:
        return tables[1][(grams & np.uint64((1 << BITS) - 1)).astype(np.int64)]
    keys, prob, ctx, gamma = tables[order]
    at = np.minimum(np.searchsorted(keys, grams), len(keys) - 1)
    seen = keys[at] == grams
    out = np.where(seen, prob[at], 0.0)
    rest = np.flatnonzero(~seen)
    if len(rest):
        c = grams[rest] >> np.uint64(BITS)
        k = np.minimum(np.searchsorted(ctx, c), len(ctx) - 1)
        out[rest] = np.where(ctx[k] == c, gamma[k], 1.0) * _prob(tables, order - 1, grams[rest] & np.uint64((1 << (BITS * (order - 1))) - 1))
    return out


def _symbols(samples: dict[str, list[str]], units: bool) -> np.ndarray:
    """The code points (or UTF-16 units) of the samples; NUL stays unknown, so that units always fit BITS bits."""
    found = np.unique(np.concatenate([np.unique(lines(v, units)) for v in samples.values()]))
    return found[found > 0]


def fit(samples: dict[str, list[str]]) -> Model:
    """A model from texts of each language; without any, one that knows no language."""
    languages = sorted(samples)
    if not languages:
        return Model([], np.zeros(0x110000, np.uint16), [], [], np.zeros((1, 0), np.float32), np.zeros(0), np.zeros((0, 2)))
    kept = {k: [x for i, x in enumerate(v) if i % 4 != 3] or v for k, v in samples.items()}
    held = {k: [x for i, x in enumerate(v) if i % 4 == 3] or v for k, v in samples.items()}
    units, points = False, _symbols(kept, False)
    if len(points) >= 1 << BITS:
        units, points = True, _symbols(kept, True)
    letters = np.zeros(1 << 16 if units else 0x110000, np.uint16)
    letters[points] = np.arange(1, len(points) + 1)
    size, models = len(points) + 1, []
    start = int(letters[ord(START)])
    for k in languages:
        symbols = letters[lines(kept[k], units)]
        counts: dict = {}
        g = _grams(symbols, ORDER)[ORDER - 1 :]
        keep = (g & np.uint64((1 << BITS) - 1)) != start
        top, n = np.unique(g[keep], return_counts=True)
        counts[ORDER] = (top, n.astype(float))
        for order in range(ORDER - 1, 0, -1):  # continuation counts: in how many ways the n-gram is preceded
            above = counts[order + 1][0]
            g, n = np.unique(above & np.uint64((1 << (BITS * order)) - 1), return_counts=True)
            counts[order] = (g, n.astype(float))
        models.append(_kneser_ney(counts, size))
    grams, contexts = [], []
    for order in range(2, ORDER + 1):
        every = np.unique(np.concatenate([m[order][0] for m in models]))
        grams.append(Table.of(every, np.log(np.stack([_prob(m, order, every) for m in models], 1))))
        ctx = np.unique(np.concatenate([m[order][2] for m in models]))
        gamma = np.ones((len(ctx), len(models)))
        for j, m in enumerate(models):
            gamma[np.searchsorted(ctx, m[order][2]), j] = m[order][3]
        contexts.append(Table.of(ctx, np.log(gamma)))
    unigram = np.log(np.stack([m[1] for m in models], 1)).astype(np.float32)
    model = Model(languages, letters, grams, contexts, unigram, np.zeros(len(languages)), np.zeros((len(languages), 2)), units)
    for j, k in enumerate(languages):
        texts = [x for x in held[k] if _LETTER.search(x)] or [" "]
        # Pieces of several lengths show how the spread falls with the length.
        texts += [x[a : a + n] for n in (20, 60, 200) for x in texts[:100] for a in range(0, min(len(x), 4 * n), n)]
        total, n = totals(model, texts)
        ce = -total[:, j] / n
        model.mean[j] = np.average(ce, weights=np.minimum(n, 200))
        square = (ce - model.mean[j]) ** 2
        design = np.stack([np.ones(len(n)), 1 / n], 1)
        a, b = np.linalg.lstsq(design, square, rcond=None)[0]
        model.spread[j] = max(a, 1e-4), max(b, 1e-2)
    return model


def totals(model: Model, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Log likelihoods (texts x languages) and lengths, in bounded chunks."""
    out, n = np.zeros((len(texts), len(model.languages))), np.zeros(len(texts), np.int64)
    k = 0
    while k < len(texts):
        stop, size = k, 0
        while stop < len(texts) and (stop == k or size + len(texts[stop]) <= CHUNK):
            size += len(texts[stop])
            stop += 1
        symbols = model.letters[lines(texts[k:stop], model.units)]
        starts = symbols == model.letters[ord(START)]
        # A text's symbols follow its start marks; where lower-casing changed the length, the marks still tell.
        begin = np.flatnonzero(starts)[ORDER - 2 :: ORDER - 1] + 1
        end = np.append(begin[1:] - (ORDER - 1), len(symbols))
        n[k:stop] = end - begin
        for a in range(0, len(symbols), CHUNK):
            low, high = max(0, a - ORDER + 1), min(len(symbols), a + CHUNK)
            logs = _logs(model, symbols[low:high])[a - low :]
            logs[starts[a:high]] = 0
            cut = np.clip(begin - a, 0, high - a)
            inside = np.flatnonzero((end > a) & (begin < high) & (end > begin))
            if len(inside):
                sums = np.add.reduceat(logs, cut[inside], axis=0, dtype=np.float64)
                out[k + inside] += sums
        k = stop
    return out, np.maximum(n, 1)


def _logs(model: Model, symbols: np.ndarray) -> np.ndarray:
    grams = _grams(symbols, ORDER)
    out = np.empty((len(grams), len(model.languages)), np.float32)
    rest, g = np.arange(len(grams)), grams
    for order in range(ORDER, 1, -1):
        row = model.grams[order - 2].find(g)
        hit = row >= 0
        values = model.grams[order - 2].values[row]
        if order == ORDER:
            out[:] = values
            out[~hit] = 0
        else:
            out[rest[hit]] += values[hit]
        rest, g = rest[~hit], g[~hit]
        if not len(rest):
            return out
        c = model.contexts[order - 2].find(g >> np.uint64(BITS))
        seen = c >= 0
        out[rest[seen]] += model.contexts[order - 2].values[c[seen]]
        g = g & np.uint64((1 << (BITS * (order - 1))) - 1)
    out[rest] += model.unigram[g.astype(np.int64)]
    return out


def predict(model: Model, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, scores (0 to 1), and which are accepted."""
    good = [i for i, x in enumerate(texts) if x and _LETTER.search(x)] if model.languages else []
    lang, score, accepted = ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
    if good:
        total, n = totals(model, [texts[i] for i in good])
        best = np.argmax(total, axis=1)
        share = np.exp((total - total.max(axis=1, keepdims=True)) * SHARPNESS)
        score[good] = 1 / share.sum(axis=1)
        ce = -total[np.arange(len(best)), best] / n
        far = (ce - model.mean[best]) / (REJECT * np.sqrt(model.spread[best, 0] + model.spread[best, 1] / n))
        accepted[good] = far <= 1
        score[good] *= np.exp(np.minimum(0.0, 1 - far))
        for i, b in zip(good, best):
            lang[i] = model.languages[b]
    return lang, score, accepted


def held_out(id_col: Column, parts: int = 4, part: int = 2) -> Column:
    """Whether crc32 of the id as text falls in the part that is not learned from; false for null ids."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % parts == part, F.lit(False))


def sample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE, fit_chars: int = FIT_CHARS) -> dict[str, list[str]]:
    """The bounded fitting sample: of each language, the first texts in the order of the hash of their ids; passages of long texts where short ones are too few."""
    text, of_id = F.col(text_col).cast("string"), F.col(id_col).cast("string")
    size = F.length(text)
    rows = docs.where(F.col(lang_col).isNotNull() & ~held_out(F.col(id_col)) & (size > 0))
    long = size > fit_chars
    # A hash bound for each language leaves about twice what is wanted, without sorting its rows.
    hashed = F.shiftrightunsigned(F.xxhash64(of_id, F.lit(7)), 32)
    below = lambda wanted, n: F.lit(min(1 << 32, 1000 + 3 * wanted * (1 << 32) // n) if wanted > 0 and n else 0).cast("long")
    known = rows.groupBy(lang_col).agg(F.count_if(~long), F.count_if(long)).collect()  # a row for each language
    per_language = min(per_language, max(LEAST_TEXTS, TEXTS // max(1, len(known))))
    bound = [F.when(F.col(lang_col) == name, F.when(long, below(per_language - n, m)).otherwise(below(per_language, n))) for name, n, m in known]
    if not bound:
        return {}
    begin = (F.pmod(F.xxhash64(of_id, F.lit(8)), size - fit_chars + 1) + 1).cast("int")
    passage = F.when(long, F.substring(text, begin, F.lit(fit_chars))).otherwise(text)
    few = rows.where(hashed < F.coalesce(*bound)).select(lang_col, long.alias("long"), hashed.alias("h"), passage.alias("t")).collect()
    out: dict[str, list] = {}
    for r in sorted(few, key=lambda r: (r[0], r["long"], r["h"], r["t"])):
        have = out.setdefault(r[0], [])
        if len(have) < per_language:
            have.append(r["t"])
    return out


def classify(docs: DataFrame, model: Model, text_col: str = "text", names: tuple[str, str, str] = ("lang_pred", "score", "accepted")) -> DataFrame:
    """docs with the predicted language, its score and whether it is accepted; rows stay where they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    own = {n.lower() for n in names}
    keep = [c for c in docs.columns if c.lower() not in own]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                lang, score, ok = predict(shared.value, batch.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang), pa.array(score), pa.array(ok)], ["row", "lang", "score", "ok"])

    # Rows are carried whole, so that no name of a column matters.
    rows = docs.select(F.struct(*map(column, keep)).alias("row"), column(text_col).cast("string").alias("text"))
    kind = T.StructType([T.StructField("row", rows.schema["row"].dataType), T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("ok", T.BooleanType())])
    return rows.mapInArrow(run, kind).select("row.*", *[F.col(c).alias(n) for c, n in zip(("lang", "score", "ok"), names)])

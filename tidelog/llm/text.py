"""Vectorised words, shingles and hashes over Arrow string batches.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D. All hashes are
64-bit and depend on the bytes alone, so every executor computes the same ones.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SEGMENT = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LANE = np.uint64(0x9E3779B97F4A7C15)
#: Keeps the first k bytes of eight.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser with full avalanche (splitmix64), elementwise."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without copying the text; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offs, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offs, kind, len(column) + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = offsets[0]
    return raw[first : offsets[-1]], offsets - first


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(x) for x in texts], out=offsets[1:])
    return np.frombuffer(b"".join(texts), np.uint8), offsets


def _cut(data: np.ndarray, offsets: np.ndarray, at: int) -> int:
    """First place from `at` on where no word is cut: a space or the start of a text."""
    n = len(data)
    if at >= n:
        return n
    k = int(np.searchsorted(offsets, at))
    edge = int(offsets[k]) if k < len(offsets) else n
    while at < edge:
        found = np.flatnonzero(_SPACE[data[at : min(edge, at + 65536)]])
        if len(found):
            return at + int(found[0])
        at = min(edge, at + 65536)
    return edge


def _hashes(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A hash of each word (its first byte, its length) of data, which ends in eight spare bytes.

    A word is cut into lanes of eight bytes. Each lane is mixed, again with its number, and
    the results are summed: unlike a polynomial modulo 2^64 - which words built from a
    Thue-Morse sequence make collide, whatever its base - the sum isn't linear in the bytes.
    """
    eight = np.ndarray((len(data) - 7,), "<u8", np.ascontiguousarray(data), strides=(1,))  # the eight bytes from each place on
    total = mix(eight[start] & _FIRST[np.minimum(size, 8)])
    long = np.flatnonzero(size > 8)
    if len(long):
        n = (size[long] - 1) >> 3  # lanes after the first
        begin = np.concatenate([[0], np.cumsum(n)[:-1]])
        owner = np.repeat(np.arange(len(long)), n)
        lane = np.arange(len(owner)) - begin[owner] + 1
        value = eight[start[long][owner] + 8 * lane] & _FIRST[np.minimum(size[long][owner] - 8 * lane, 8)]
        total[long] += np.add.reduceat(mix(mix(value) + lane.astype(np.uint64) * _LANE), begin)
    return mix(total + size.astype(np.uint64))


def hash_words(data: np.ndarray, offsets: np.ndarray, lower: bool = True, shapes: bool = False) -> tuple[np.ndarray, ...]:
    """Hash of every word, and for each text the index of its first word (one more at the end); with `shapes`, also each word's last two bytes and length class as one number."""
    parts, places, shape, n, a = [], [], [], len(data), 0
    while a < n:
        b = _cut(data, offsets, a + SEGMENT)
        seg = data[a:b]
        word = ~_SPACE[seg]
        edge = np.zeros(len(seg) + 1, bool)
        inner = offsets[np.searchsorted(offsets, a) : np.searchsorted(offsets, b, "right")] - a
        edge[inner] = True
        start = word.copy()
        start[1:] &= ~word[:-1] | edge[1:-1]
        stop = word.copy()
        stop[:-1] &= ~word[1:] | edge[1:-1]
        s, e = np.flatnonzero(start), np.flatnonzero(stop) + 1
        if len(s):
            small = np.concatenate([_LOWER[seg] if lower else seg, np.zeros(8, np.uint8)])
            parts.append(_hashes(small, s, e - s))
            places.append(s + a)
            if shapes:
                last, other = small[e - 1].astype(np.int32), small[np.maximum(e - 2, s)].astype(np.int32)
                shape.append((np.minimum((e - s) >> 2, 3).astype(np.int32) << 16) | (other << 8) | last)
        a = b
    h = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    p = np.concatenate(places) if places else np.zeros(0, np.int64)
    first = np.searchsorted(p, offsets)
    return (h, first, np.concatenate(shape) if shape else np.zeros(0, np.int32)) if shapes else (h, first)


def shingles(words: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of `width` words of each text; a shorter, non-empty text gives its whole sequence."""
    count = np.diff(first)
    acc = np.zeros(max(0, len(words) - width + 1), np.uint64)
    for i in range(width):
        acc *= np.uint64(0xD6E8FEB86659FD93)
        acc += words[i : i + len(acc)]
    acc = mix(acc)
    n_out = np.where(count >= width, count - width + 1, (count > 0).astype(np.int64))
    out_first = np.zeros(len(first), np.int64)
    np.cumsum(n_out, out=out_first[1:])
    out = np.empty(int(out_first[-1]), np.uint64)
    owner = np.repeat(np.arange(len(count)), n_out)
    inside = np.arange(len(out)) - out_first[:-1][owner]
    source = first[:-1][owner] + inside
    full = count[owner] >= width
    out[full] = acc[source[full]]
    for i in np.flatnonzero((count > 0) & (count < width)):
        h = np.uint64(0)
        with np.errstate(over="ignore"):
            for w in words[first[i] : first[i + 1]]:
                h = h * np.uint64(0xA0761D6478BD642F) + w
            out[out_first[i]] = mix(np.array([h + np.uint64(count[i])], np.uint64))[0]
    return out, out_first

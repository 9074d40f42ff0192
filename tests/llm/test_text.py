import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tidelog.llm import text


@given(st.lists(st.text(alphabet="aB \t\n\x0b\x1fé漢", max_size=30), max_size=8))
@settings(max_examples=80, deadline=None)
def test_words_and_shingles(texts):
    data, offsets = text.buffers(pa.array(texts, pa.string()))
    h, first = text.hash_words(data, offsets)
    low = [re.findall(rb"[^\x20\x09-\x0d]+", bytes(c + 32 if 65 <= c <= 90 else c for c in x.encode())) for x in texts]
    assert [len(w) for w in low] == np.diff(first).tolist()
    seen = {}
    for words, a in zip(low, first):
        for k, w in enumerate(words):
            assert seen.setdefault(w, h[a + k]) == h[a + k]
    assert len(set(seen.values())) == len(seen)
    s, begin = text.shingles(h, first, 3)
    want = [[tuple(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [tuple(w)] * bool(w) for w in low]
    assert [len(x) for x in want] == np.diff(begin).tolist()
    names = {}
    for x, a in zip(want, begin):
        for k, g in enumerate(x):
            assert names.setdefault(g, s[a + k]) == s[a + k]
    assert len(set(names.values())) == len(names)


def test_segments_do_not_cut_words(monkeypatch):
    x = [" ".join(f"w{i % 97}" for i in range(3000)), "a" * 5000, ""]
    data, offsets = text.buffers(pa.array([None, *x]))
    whole = text.hash_words(data, offsets)
    monkeypatch.setattr(text, "SEGMENT", 100)
    parts = text.hash_words(data, offsets)
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all()


def test_long_words_stay_apart():
    """Thue-Morse words collide under any polynomial hash modulo 2^64; words that differ in one byte, or in the order of their lanes, stay apart too."""
    import random

    tm = "".join("ab"[bin(i).count("1") & 1] for i in range(4096))
    other = tm.translate(str.maketrans("ab", "ba"))
    rng = random.Random(1)
    base = "".join(rng.choice("abcdefgh") for _ in range(64))
    lanes = [base[i : i + 8] for i in range(0, 64, 8)]
    every = [tm, other, tm[:1024], other[:1024], tm + "b", base, "".join(reversed(lanes)), "".join(lanes[:1] + lanes[2:3] + lanes[1:2] + lanes[3:])]
    every += [base[:i] + "x" + base[i + 1 :] for i in range(64)] + [base[:i] for i in range(1, 64)] + ["a" * n for n in range(1, 40)]
    data, offsets = text.buffers(pa.array(every))
    assert len(set(text.hash_words(data, offsets)[0].tolist())) == len(set(every))

"""Each operator against a plain version of itself, with nulls, empty and long texts, ties, repeats and clashing columns."""

import collections
import hashlib
import io
import random
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidelog.llm import hmm, html, langid, licenses, mih, mixing, packing, partenum, simhash, warc

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
WORD = re.compile(r"[^\x20\x09-\x0d]+")


def documents(spark, rows):
    """Documents with columns whose names clash with those of results."""
    full = [(i, t, lang, source, len(t or ""), 1, "x") for i, t, lang, source in rows]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, size int, cls string")


def corpus(n=60, seed=5):
    rng = random.Random(seed)
    vocabulary = {"en": "the of and house river walking stone light".split(), "de": "der die und haus fluß gehen stein licht".split()}
    rows = []
    for i in range(n):
        lang = rng.choice(["en", "de"])
        rows.append((i, " ".join(rng.choice(vocabulary[lang]) + rng.choice(["", "", "er", "en"]) for _ in range(rng.randint(5, 120))), lang, rng.choice(["a", "b", None, "hot", "hot"])))
    base = rows[3][1] + " " + rows[4][1] + " " + rows[5][1]
    rows += [(n, None, None, None), (n + 1, "", "en", "a"), (n + 2, " \t\n", "en", "a"), (n + 3, "one", "en", "b"), (n + 4, "12 34", None, "b"), (None, "no id at all here", "en", "a")]
    rows += [(n + 5, base, "en", "a"), (n + 6, base + " tail", "en", "a"), (n + 7, base, "de", "b"), (n + 8, "start " + base.upper(), "en", "hot"), (0, rows[0][1], rows[0][2], rows[0][3]), (n + 9, "long " * 20000, "en", "b")]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark, corpus()).repartition(5).cache()


# 1


def test_search(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((900, 16)) * rng.uniform(0.5, 2, (900, 1))
    x[50:90] = x[0]
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)] + [(1000, None, 1), (1001, [0.0] * 16, 1), (1002, [float("nan")] + [1.0] * 15, 1), (1003, [1.0] * 3, 1), (1004, [None] + [1.0] * 15, 1), (None, x[1].tolist(), 1), (7, x[7].tolist(), 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int")
    got = collections.defaultdict(list)
    for r in mih.search(df, F.col("vec_id") % 20 == 0, k=20).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    hits = 0
    for q in range(0, 900, 20):
        s = (x * x[q]).sum(axis=1)
        order = [i for i in np.lexsort((np.arange(900), -s)) if i != q][:20]
        hits += len({v for v, _ in got[q]} & set(order))
        assert all(abs(s[v] - sc) < 1e-12 for v, sc in got[q]) and q not in [v for v, _ in got[q]]
        assert got[q] == sorted(got[q], key=lambda p: (-p[1], p[0]))
    assert hits / (45 * 20) >= 0.9
    assert [v for v, _ in got[0]][:20] == sorted(range(50, 70)) or s[0] < 0  # ties of equal vectors go to the smallest ids
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (20, [0.0, 2.0])], "vec_id long, embedding array<double>")
    assert mih.search(few, F.col("vec_id") % 20 == 0).count() == 4
    assert mih.search(few.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_search_takes_finite_vectors_of_any_size(spark):
    rows = [(0, [1e-170, 0.0]), (20, [1e200, 1.0]), (1, [5e-324, 5e-324]), (2, [1.7e308, -1.7e308]), (3, [1.0, 1.0]), (4, [0.0, 0.0]), (5, [float("inf"), 0.0])]
    got = [tuple(r) for r in mih.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect()]
    good = {i: np.array(v) for i, v in rows if i < 4 or i == 20}
    with np.errstate(over="ignore"):
        want = [(q, i, float((good[q] * v).sum())) for q in (0, 20) for i, v in good.items() if i != q]
    want.sort(key=lambda r: (r[0], -r[2], r[1]))
    assert [(q, i, s) for q, _, i, s in got] == want and [r for _, r, *_ in got] == [1, 2, 3, 4] * 2


@given(st.integers(0, 2**32), st.integers(0, 60))
@settings(max_examples=40, deadline=None)
def test_probes_retrieve_every_code_within_the_radius(seed, radius):
    """And at small radii few others: it is the probing that finds them."""
    rng = np.random.default_rng(seed)
    have = rng.integers(0, 256, (300, 16), dtype=np.uint8)
    asked = np.ascontiguousarray(have[:40])
    asked[:, rng.integers(0, 16)] ^= rng.integers(0, 256, 40, dtype=np.uint8)
    far = np.bitwise_count(asked[:, None] ^ have).sum(axis=2)
    tables = mih.Tables(have)
    assert sorted(zip(*map(np.ndarray.tolist, tables.within(asked, radius)))) == sorted(zip(*map(np.ndarray.tolist, np.nonzero(far <= radius))))
    found, visits = tables.retrieved(asked, radius)
    assert visits >= found.sum() and (radius > 15 or found.mean() < 0.1)


def test_radii_are_pigeonholes():
    for radius in range(0, 60):
        for tables in (4, 16):
            assert (mih.radii(radius, tables) + 1).sum() == radius + 1


# 2


def test_simhash(spark, docs):
    rows = sorted(((r[0], r[1] or "") for r in corpus()), key=lambda r: (r[0] is not None, r[0] or 0))
    got = simhash.compare(docs).collect()
    assert len(got) == len(rows)
    texts = [t for _, t in rows]
    prints = simhash.fingerprints([t.encode() for t in texts])
    want = []
    for k, (i, t) in enumerate(rows):
        new = simhash.edited(t, texts[(k + 1) % len(texts)])
        f = simhash.fingerprints([new.encode()])
        want.append((i, len(t), hashlib.sha256(new.encode()).hexdigest(), prints[k].tobytes().hex(), f[0].tobytes().hex(), float(simhash.likeness(prints[k][None], f)[0]), float(simhash.likeness(prints[k][None], prints[(k + 1) % len(texts)][None])[0])))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert simhash.compare(docs.limit(0)).count() == 0
    assert simhash.compare(docs.where("doc_id = 5")).first()["near_next"] == 1.0


def test_simhash_counts_votes():
    texts = [b"a b c d e f g", b"", b"one", b"x " * 300000]
    whole = simhash.fingerprints(texts)
    assert not whole[1].any() and (whole == np.concatenate([simhash.fingerprints([t]) for t in texts])).all()


def plain_fingerprint(text):
    """The fingerprint by a vote of one term after another, in whole numbers."""
    top = (1 << 64) - 1

    def mix(x):
        x = (x + 0x9E3779B97F4A7C15) & top
        x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & top
        x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & top
        return x ^ (x >> 31)

    def word(w):
        lanes = [int.from_bytes(w[i : i + 8], "little") for i in range(0, len(w), 8)]
        total = mix(lanes[0]) + sum(mix((mix(v) + k * 0x9E3779B97F4A7C15) & top) for k, v in enumerate(lanes[1:], 1))
        return mix((total + len(w)) & top)

    def fold(hashes, by):
        out = 0
        for h in hashes:
            out = (out * by + h) & top
        return out

    h = [word(w) for w in re.findall(rb"[^\x20\x09-\x0d]+", text.translate(LOWER).encode())]
    terms = [mix(fold(h[i : i + 5], 0xD6E8FEB86659FD93)) for i in range(len(h) - 4)] if len(h) >= 5 else [mix((fold(h, 0xA0761D6478BD642F) + len(h)) & top)] if h else []
    votes = [0] * 128
    for t in terms:
        for lane in (0, 1):
            v = mix(t ^ (0x5851F42D4C957F2D * (lane + 1) & top))
            for bit in range(64):
                votes[64 * lane + bit] += 1 if v >> bit & 1 else -1
    return sum(1 << bit for bit, v in enumerate(votes[:64]) if v > 0).to_bytes(8, "little").hex(), sum(1 << bit for bit, v in enumerate(votes[64:]) if v > 0).to_bytes(8, "little").hex()


def test_simhash_equals_plain_votes():
    texts = [t or "" for _, t, *_ in corpus()[:70] if len(t or "") < 3000] + ["A b", "Ab cD é漢 " * 40, "averyveryverylongwordindeed " * 3 + "x y z"]
    got = simhash.fingerprints([t.encode() for t in texts])
    for t, g in zip(texts, got):
        flipped = np.packbits(np.unpackbits(g, bitorder="big").reshape(-1, 8)[:, :], axis=1).ravel()
        assert flipped.tobytes().hex() == "".join(plain_fingerprint(t)), t[:50]


@pytest.mark.parametrize("cell,look", [(4096, 64), (8, 1)])
def test_simhash_search(spark, monkeypatch, cell, look):
    """Pairs and firsts against every pair; with small cells, groups of near copies are dealt over many of them."""
    monkeypatch.setattr(simhash, "CELL", cell)
    monkeypatch.setattr(simhash, "LOOK", look)
    rng = np.random.default_rng(3)
    prints = [rng.integers(0, 256, 16, dtype=np.uint8) for _ in range(30)]
    for base in (prints[0], prints[1]):
        for _ in range(40):
            x = np.unpackbits(base)
            x[rng.choice(128, rng.integers(0, 9), replace=False)] ^= 1
            prints.append(np.packbits(x))
    prints += [prints[5], prints[0], np.zeros(16, np.uint8), np.zeros(16, np.uint8)]
    ids = rng.permutation(len(prints))
    rows = [(int(i), p.tobytes().hex()) for i, p in zip(ids, prints)] + [(None, prints[0].tobytes().hex()), (None, "ff" * 16)]
    df = spark.createDataFrame(rows, "doc_id long, fingerprint string").repartition(3)
    least = {}
    for i, f in rows:
        least[f] = i if least.get(f) is None else least[f] if i is None else min(least[f], i)
    far = lambda a, b: (int(a, 16) ^ int(b, 16)).bit_count()
    named = sorted((i, f) for f, i in least.items() if i is not None)
    want = sorted((i, j, far(f, g)) for i, f in named for j, g in named if i < j and far(f, g) <= 6)
    assert sorted(map(tuple, simhash.links(df).collect())) == want and len(want) > 100
    first = {f: min([j for j, g in named if far(f, g) <= 6 and (i is None or j <= i)], default=None) if i is not None else None for f, i in least.items()}
    assert {tuple(r) for r in simhash.near_first(df).collect()} == set(first.items())
    assert simhash.links(df, radius=3, blocks=4).count() == sum(d <= 3 for *_, d in want)
    assert simhash.links(df.limit(0)).count() == 0 and simhash.near_first(df.limit(0)).count() == 0


def test_simhash_query_rows(spark, docs):
    got = {(r["doc_id"], r["fingerprint"]): r["near_first"] for r in simhash.searched(docs).collect()}
    far = lambda a, b: (int(a, 16) ^ int(b, 16)).bit_count()
    for (i, f), first in got.items():
        assert first == min((j for j, g in got if j is not None and far(f, g) <= 6), default=None)
    assert simhash.searched(docs.limit(0)).count() == 0


# 3


def test_html():
    w = html.fit(html.labelled())
    wrong = 0
    for page, _ in html.labelled(150, seed=99):
        want = [x for p in html.pieces(page) if p[0] == "text" and "zq" in p[1] for x in p[1].split()]
        wrong += html.extract(page, w).split() != want
    assert wrong <= 4
    page = '<html><head><title>t</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><a href=/>Home</a></nav><!-- ad --><div class="ad">Buy it now</div><article><h1>A  &amp; B</h1><p><b>First words of the article are here<br><p>Second &lt;part&gt;\n of the text</p></article><section class=comments><p>nice one, thanks a lot for all of this</p></section><footer>&copy; all</footer>'
    assert html.extract(page, w) == "A & B\nFirst words of the article are here\nSecond <part> of the text"
    assert html.extract("", w) == "" and html.extract("plain words only and more of them", w) == "plain words only and more of them" and html.extract("<p>" * 500 + "<script>x", w) == ""


def test_html_keeps_article_text_with_hints():
    w = html.fit(html.labelled())
    words = "some ordinary words of the article stand here in a row"
    for hold in ("article", "main"):
        for part in ('<h2 id="how-to-register">{}</h2>', '<h2 class="related-work">{}</h2>', '<section id="discussion"><p>{}</p></section>', '<div class="section level2" id="discussion"><h2>{}</h2></div>', '<div class="legal-analysis">{}</div>', '<table><tr><td class="notice">{}</td></tr></table>', '<ul><li id="follow">{}</li></ul>', '<p><a id="search" href="#x">{}</a></p>', '<blockquote class="popular">{}</blockquote>'):
            page = f"<body><{hold}><h1>The title</h1><p>{words}</p>{part.format('kept ' + words)}<p>{words}</p></{hold}></body>"
            assert html.extract(page, w) == f"The title\n{words}\nkept {words}\n{words}", part
        for part in ("<div class=ad>{}</div>", '<div class="promo-box">{}</div>', '<aside class="x">{}</aside>', "<ul class='social share'><li>{}</ul>", '<div id="comments"><p>{}</p></div>', '<section class="comments">{}</section>'):
            page = f"<body><{hold}><h1>The title</h1><p>{words}</p>{part.format('gone ' + words)}<p>{words}</p></{hold}></body>"
            assert html.extract(page, w) == f"The title\n{words}\n{words}", part


def test_html_without_article_is_not_parted_by_what_is_dropped():
    w = html.fit(html.labelled())
    words = "some ordinary words of the text stand here in a row"
    for part in ("<div class=ad>" + "buy it now " * 300 + "</div>", '<div class="related"><ul>' + "<li><a href=/x>more of that</a></li>" * 100 + "</ul></div>"):
        page = f"<body><div class=post><h1>The title</h1><p>{words}</p>{part}<h2 id='how-to-register'>Next part</h2><p>{words}</p></div></body>"
        assert html.extract(page, w) == f"The title\n{words}\nNext part\n{words}"


def test_html_time_is_linear():
    """Markup that never closes, at a size where a quadratic scan would take minutes."""
    import time

    w = html.fit(html.labelled())
    for bad in ('<div class="x' * 80000, "<a" * 400000, '<a b=">" ' * 100000 + '"', "<div>" * 100000 + "</section>" * 100000, "<script" * 100000, "<p class='" * 100000, "<!--" * 200000):
        began = time.process_time()
        html.extract(bad, w)
        assert time.process_time() - began < 10
    assert html.extract("<article><p>a &#0000000065; &#99999999999; &#" + "9" * 9000 + "; &#x41; b", w) == "a A \ufffd \ufffd A b"


def test_html_layouts_whose_names_say_nothing():
    """Held-out pages of the same makes, and layouts of other makes: comments, footers and menus go, all of the article stays."""
    w = html.fit(html.labelled())
    right = collections.Counter()
    for i, (page, _) in enumerate(html.labelled(200, seed=77)):
        want = [x for p in html.pieces(page) if p[0] == "text" and "zq" in p[1] for x in p[1].split()]
        right[i % 2] += html.extract(page, w).split() == want
    assert right[0] >= 97 and right[1] >= 90
    words = "some ordinary words of the article stand here in a row and a few more of them follow"
    body = f"<h1>The title of it</h1><p>{words}</p><p>{words}</p><ul><li>first of them</li><li>second of them</li></ul><p>{words}</p>"
    text = f"The title of it\n{words}\n{words}\nfirst of them\nsecond of them\n{words}"
    unit = '<div class="k2"><i>Some Body</i> <i>3 days ago</i><p>what a nice thing to read, thank you</p><a href="#r">Reply</a></div>'
    for page in (
        f'<body><div class="a1"><a href="/">Site</a><a href="/x">One</a><a href="/y">Two</a></div><div class="a2">{body}</div><div class="a3">{unit * 4}</div><div class="a4">&copy; 2020 Some Site. All rights reserved.</div></body>',
        f'<body><table><tr><td><a href="/">Home</a><br><a href="/n">News</a></td><td>{body}</td></tr><tr><td>Copyright Some Site and others</td></tr></table></body>',
        f'<body><section><ul><li><a href="/">Home</a></li><li><a href="/n">News</a></li></ul></section><section>{body}</section><section><h3>2 comments</h3>{unit * 2}</section><section><p>Copyright 2021</p></section></body>',
        f'<body><center><div>{body}</div></center><div><div>{unit}</div></div><div><a href=/p>Privacy</a> <a href=/t>Terms</a></div></body>',
    ):
        assert html.extract(page, w) == text


def test_html_rows(spark):
    df = spark.createDataFrame([(1, "u", None, 1), (1, "u", None, 1), (2, None, "<article><p>x y z and more words", 2)], "page_id long, url string, html string, text int")
    got = sorted(map(tuple, html.main_text(df).collect()))
    assert got == [(1, "u", "", 0), (1, "u", "", 0), (2, None, "x y z and more words", 20)]
    assert html.main_text(df.limit(0)).count() == 0 and html.main_text(df.limit(0)).columns == ["page_id", "url", "text", "n_chars"]


@given(st.lists(st.integers(-5, 5), max_size=12))
def test_best_run(scores):
    a, b = html.best_run(scores)
    best = max((sum(scores[i:j]) for i in range(len(scores)) for j in range(i, len(scores) + 1)), default=0)
    assert sum(scores[a:b]) == max(best, 0)


# 4


@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), max_size=12))
@settings(max_examples=200, deadline=None)
def test_plan_is_best_fit(counts):
    steps = packing.plan(counts, 40)
    total, place, filled = sum(counts.values()), 0, collections.defaultdict(list)
    lengths = [n for n in sorted(counts, reverse=True) for _ in range(counts[n])]
    for (r, s, o), following in zip(steps, [*[x[0] for x in steps[1:]], total]):
        for rank in range(r, following):
            filled[s + rank - r].append((o, lengths[rank]))
            place += 1
    assert place == total
    for parts in filled.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 40
    gaps = []  # best-fit decreasing, one by one; supersteps open a length's sequences together, which may differ a little
    for n in lengths:
        fits = [g for g in gaps if g >= n]
        if fits:
            gaps.remove(min(fits))
            gaps.append(min(fits) - n)
        else:
            gaps.append(40 - n)
    assert len(filled) <= len(gaps) * 11 / 9 + 1


def test_pack(spark, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    extra = documents(spark, [(900, "<|endoftext|> it's  12 ,,, \n\n x", "en", "a")])
    rows = packing.pack(packing.pieces(docs.union(extra), path, 128), 128).collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 128
    want = []
    for i, x, *_ in [*corpus(), (900, "<|endoftext|> it's  12 ,,, \n\n x", 0, 0)]:
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 0]
        n = len(ids)
        first = n if n <= 128 else n % 128 or 128
        cuts = [0, *range(first, n + 1, 128)]
        want += [(i, k, a, b - a, zlib.crc32(struct.pack(f"<{b - a}I", *ids[a:b]))) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted(map(repr, (tuple(r)[:5] for r in rows))) == sorted(map(repr, want))
    assert len(by) <= -(-sum(r["length"] for r in rows) // 128) + 2
    assert packing.pack(packing.pieces(docs.limit(0), path)).count() == 0


# 5


def test_licenses(spark):
    mit = licenses.NOTICES["mit"]
    changed = " ".join(w if k % 40 else "CHANGED" for k, w in enumerate(mit.split()))
    filler = "some other words that say nothing of the kind " * 30
    rows = [(1, None), (2, ""), (3, filler + mit + filler), (4, "All rights reserved."), (5, "all RIGHTS -- reserved"), (6, filler + changed), (7, "rights reserved"), (8, "Licensed under CC BY-NC 4.0."), (9, filler), (3, filler + mit + filler)]
    got = {(r["doc_id"], r["license"]): r["containment"] for r in licenses.scan(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, m int")).collect()}
    assert set(got) == {(3, "mit"), (4, "all-rights-reserved"), (5, "all-rights-reserved"), (6, "mit"), (8, "cc-by-nc-4.0-line")}
    assert got[3, "mit"] == 1.0 and 0.8 <= got[6, "mit"] < 1


# 6


def test_langid(spark, docs):
    model = langid.fit(langid.sample(docs))
    assert model.languages == ["de", "en"]
    out = langid.classify(docs, model, names=("lang_pred", "score", "accepted")).collect()
    good = [r for r in out if r["lang"] and len(r["text"] or "") > 60 and r["doc_id"] is not None and r["doc_id"] < 60]
    assert sum(r["lang"] == r["lang_pred"] for r in good) / len(good) > 0.95
    for r in out:
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == "und") == (not letters) and 0 <= r["score"] <= 1 and (letters or not r["accepted"])
    assert langid.predict(langid.fit({"en": ["a"]}), ["b", None, "1"])[0] == ["en", "und", "und"]
    empty = langid.sample(docs.limit(0))
    assert empty == {}
    clash = docs.withColumn("Score", F.lit(1)).withColumn("lang_pred", F.lit("x"))
    assert {(r["doc_id"], r["text"], r["lang_pred"], r["score"]) for r in langid.classify(clash, model).collect()} == {(r["doc_id"], r["text"], r["lang_pred"], r["score"]) for r in out}


def test_langid_without_labels(spark, docs):
    for rows in (docs.limit(0), docs.withColumn("lang", F.lit(None).cast("string")), docs.withColumn("text", F.lit(None).cast("string"))):
        model = langid.fit(langid.sample(rows))
        out = langid.classify(rows, model, names=("lang_pred", "score", "accepted")).collect()
        assert len(out) == rows.count() and all((r["lang_pred"], r["score"], r["accepted"]) == ("und", 0.0, False) for r in out)


def test_langid_shares_the_sample(spark, monkeypatch):
    monkeypatch.setattr(langid, "TEXTS", 60)
    rows = [(i, f"text {i} of it", f"l{i % 5}", "a") for i in range(400)]
    assert {k: len(v) for k, v in langid.sample(documents(spark, rows)).items()} == {f"l{k}": 12 for k in range(5)}


class PlainKneserNey:
    """Interpolated Kneser-Ney over characters with dictionaries, one gram at a time."""

    def __init__(self, texts, alphabet, order=4):
        self.order, self.size = order, len(alphabet) + 1
        padded = ["\x02" * (order - 1) + t.lower() for t in texts]
        top = collections.Counter(p[i - order + 1 : i + 1] for p in padded for i in range(order - 1, len(p)))
        self.counts = {order: top}
        for n in range(order - 1, 0, -1):
            self.counts[n] = collections.Counter(g[1:] for g in self.counts[n + 1])
        self.discount = {}
        for n, c in self.counts.items():
            ones, twos = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
            self.discount[n] = min(0.95, max(0.1, ones / (ones + 2 * twos))) if ones else 0.5
        self.after = {n: collections.defaultdict(list) for n in self.counts}
        for n, c in self.counts.items():
            for g, v in c.items():
                self.after[n][g[:-1]].append(v)

    def p(self, gram):
        n = len(gram)
        d, rest = self.discount[n], self.after[n].get(gram[:-1])
        lower = 1 / self.size if n == 1 else self.p(gram[1:])
        return lower if rest is None else max(self.counts[n].get(gram, 0) - d, 0) / sum(rest) + d * len(rest) / sum(rest) * lower

    def log(self, text):
        padded = "\x02" * (self.order - 1) + text.lower()
        return sum(np.log(self.p(padded[i - self.order + 1 : i + 1])) for i in range(self.order - 1, len(padded)))


def test_langid_equals_plain_kneser_ney():
    rows = corpus()
    samples = {k: [t for _, t, lang, _ in rows[:60] if lang == k] for k in ("de", "en")}
    model = langid.fit(samples)
    fitted = {k: [x for i, x in enumerate(v) if i % 4 != 3] for k, v in samples.items()}
    alphabet = {c for v in fitted.values() for x in v for c in x.lower()} | {"\x02"}
    plain = {k: PlainKneserNey(v, alphabet) for k, v in fitted.items()}
    texts = [t for _, t, *_ in rows[:12]] + ["Zebra!! 12", "the ßß river qq", "x", "long " * 400]
    total, n = langid.totals(model, texts)
    for i, t in enumerate(texts):
        assert n[i] == len(t)
        assert np.allclose(total[i], [plain[k].log("".join(c if c in alphabet else "\0" for c in t.lower())) for k in model.languages], rtol=1e-4, atol=1e-3)


def test_langid_samples_long_texts_where_short_ones_are_few(spark):
    rng = random.Random(8)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    rows = [(i, text(30), "en", "a") for i in range(60)] + [(100 + i, text(500), "en", "a") for i in range(60)] + [(200 + i, text(400), "de", "a") for i in range(60)]
    rows += [(i, text(20), "fr", "a") for i in range(300, 304)] + [(400 + i, text(400), "fr", "a") for i in range(3000)]
    got = langid.sample(documents(spark, rows), per_language=10, fit_chars=50)
    assert {k: len(v) for k, v in got.items()} == {"en": 10, "de": 10, "fr": 10}
    assert {len(x) for x in got["en"]} == {30} and {len(x) for x in got["de"]} == {50}
    short = [t for i, t, *_ in rows if 300 <= i < 304 and zlib.crc32(str(i).encode()) % 4 != 2]
    assert sorted(x for x in got["fr"] if len(x) < 50) == sorted(short) and {len(x) for x in got["fr"]} == {20, 50}
    whole = {k: [t for _, t, lang, _ in rows if lang == k] for k in got}
    assert all(any(x in t for t in whole[k]) for k, v in got.items() for x in v)


def test_langid_is_a_distribution():
    model = langid.fit({"en": ["the river and the stone " * 20, "walking by the house", "light and stone", "and so on"], "de": ["der fluß und der stein " * 20, "licht und haus", "gehen", "und so"]})
    symbols = [int(s) for s in np.unique(model.letters) if s and s != model.letters[ord(langid.START)]]
    for context in ("th", "ß u", "zz"):
        head = langid.lines([context])
        rows = np.stack([langid._logs(model, np.append(model.letters[head], np.uint8(s)))[-1] for s in [0, *symbols]])
        assert np.all(np.exp(rows).sum(axis=0) <= 1 + 1e-4) and np.all(np.exp(rows).sum(axis=0) > 0.95)


def test_langid_pieces_add_up(monkeypatch):
    model = langid.fit({"en": ["the river and the stone"] * 4, "de": ["der fluß und der stein"] * 4})
    texts = ["the stone " * 50, "x", "", "der stein"]
    whole = langid.totals(model, texts)
    monkeypatch.setattr(langid, "CHUNK", 37)
    parts = langid.totals(model, texts)
    assert np.allclose(whole[0], parts[0]) and (whole[1] == parts[1]).all()


def test_langid_tells_scripts_apart():
    """Scripts with few short texts beside others with large alphabets."""
    rng = random.Random(6)

    def texts(first, size, n, words):
        return [" ".join("".join(chr(first + rng.randrange(size)) for _ in range(rng.randint(1, 5))) for _ in range(words)) for _ in range(n)]

    small = {"ka": (0x10D0, 33), "am": (0x1200, 60), "hi": (0x0915, 36), "el": (0x03B1, 25), "ff": (0x1E922, 34)}  # ff: beyond 16 bits
    samples = {"zh": texts(0x4E00, 3000, 40, 60), "ko": texts(0xAC00, 2000, 40, 60)} | {k: texts(*v, 6, 8) for k, v in small.items()}
    model = langid.fit(samples)
    assert all(model.letters[ord(c)] for v in samples.values() for i, x in enumerate(v) if i % 4 != 3 for c in x.lower())
    for k, v in {"zh": (0x4E00, 3000), "ko": (0xAC00, 2000), **small}.items():
        lang, _, _ = langid.predict(model, texts(*v, 10, 12))
        assert lang == [k] * 10


def test_langid_rejects_a_script_nobody_learned():
    rng = random.Random(6)

    def texts(first, size, n, words):
        """Prose: of the script's words, the earlier are the commoner."""
        own = random.Random(first)
        v = ["".join(chr(first + own.randrange(size)) for _ in range(own.randint(1, 5))) for _ in range(max(60, size))]
        return [" ".join(v[min(int(rng.paretovariate(0.7)) - 1, len(v) - 1)] for _ in range(words)) for _ in range(n)]

    big, small = {"zh": (0x4E00, 3000), "ko": (0xAC00, 2000)}, {"ka": (0x10D0, 33), "am": (0x1200, 60), "hi": (0x0915, 36), "el": (0x03B1, 25)}
    model = langid.fit({k: texts(*v, 40, 200) for k, v in big.items()} | {k: texts(*v, 6, 30) for k, v in small.items()})
    for k, v in {**big, **small}.items():
        lang, _, accepted = langid.predict(model, texts(*v, 10, 40))
        assert lang == [k] * 10 and all(accepted)
    assert not any(langid.predict(model, texts(0x0E01, 46, 10, 40))[2])  # Thai


def test_langid_more_code_points_than_symbols():
    """Over 65,535 code points: nothing is merged, each UTF-16 unit is a symbol."""
    every = [*range(0x3400, 0x4DB0), *range(0x4E00, 0x9FF0), *range(0xAC00, 0xD7A0), *range(0x20000, 0x2A6D0)]
    cut = ["".join(map(chr, every[a : a + 1000])) for a in range(0, len(every), 1000)]
    samples = {"big": [x for x in cut for _ in range(4)], "en": ["the river and the stone"] * 4}
    model = langid.fit(samples)
    assert model.units and all(model.letters[langid.lines([x], True)].all() for x in cut)
    assert langid.predict(model, [cut[-1], "the stone"])[0] == ["big", "en"]


# 7


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(4)
    h, m = 2, 4
    norm = lambda x, axis: x / x.sum(axis=axis, keepdims=True)
    model = hmm.Model(norm(rng.random(h), 0), norm(rng.random((h, h)), 1), norm(rng.random((m, h)), 0))
    texts = [np.array(x, np.int32) for x in ([0, 1, 2, 3, 1], [3, 3], [2])]
    from itertools import product

    start, move, emit = np.zeros(h), np.zeros((h, h)), np.zeros((m, h))
    for k, x in enumerate(texts):
        paths = {p: np.prod([model.start[p[0]] if t == 0 else model.move[p[t - 1], p[t]] for t in range(len(x))]) * np.prod([model.emit[s, q] for s, q in zip(x, p)]) for p in product(range(h), repeat=len(x))}
        total = sum(paths.values())
        assert np.isclose(hmm.forward(model, [x])[0], np.log10(total))
        for p, v in paths.items():
            start[p[0]] += v / total
            for t in range(len(x)):
                emit[x[t], p[t]] += v / total
                if t:
                    move[p[t - 1], p[t]] += v / total
    got = hmm.expected(model, texts)
    assert np.allclose(got[0], start) and np.allclose(got[1], move) and np.allclose(got[2], emit)
    before = got[3]
    better = hmm.Model(got[0] / got[0].sum(), got[1] / got[1].sum(axis=1, keepdims=True), got[2] / got[2].sum(axis=0))
    assert hmm.expected(better, texts)[3] >= before


def test_long_texts_in_pieces(monkeypatch):
    rng = np.random.default_rng(9)
    h, m = 3, 6
    norm = lambda x, axis: x / x.sum(axis=axis, keepdims=True)
    model = hmm.Model(norm(rng.random(h), 0), norm(rng.random((h, h)), 1), norm(rng.random((m, h)), 0))
    texts = [rng.integers(0, m, n).astype(np.int32) for n in (1, 5, 50, 97, 100)]
    whole = hmm.expected(model, texts)
    logs = [hmm.forward(model, [x])[0] for x in texts]
    for chunk in (7, 10, 99):
        monkeypatch.setattr(hmm, "CHUNK", chunk)
        assert all(np.allclose(a, b) for a, b in zip(whole, hmm.expected(model, texts)))
        assert np.allclose(logs, [hmm._long_forward(model, x) for x in texts])


def test_training_is_aggregated(spark, docs, monkeypatch):
    """The sums over tasks are those of all texts at once, however the rows are dealt; every pass over all texts gains."""
    monkeypatch.setattr(hmm, "HEAD", 24)
    monkeypatch.setattr(hmm, "OWN", 10)
    rows = docs.select("doc_id", F.lit(False).alias("held_out"), "text")
    counts = hmm.count_words(rows)
    known = hmm.head(counts, rows.count())
    seen = hmm.encode(rows, known).cache()
    model = hmm.begin(known)
    symbols = hmm.unpacked(pa.array([r["symbols"] for r in seen.select("symbols").collect()], pa.binary()))
    last = -np.inf
    for n in (1, 7, 3):
        got = hmm.aggregated(seen.repartition(n), model)
        want = hmm.expected(model, symbols)
        assert all(np.allclose(a, b) for a, b in zip(got, want)) and got[4] == sum(map(len, symbols)) and got[3] > last
        last, model = got[3], hmm.Model(got[0] / got[0].sum(), got[1] / got[1].sum(axis=1, keepdims=True), got[2] / got[2].sum(axis=0))


def test_every_pass_reads_all_training_texts(spark, monkeypatch):
    """On half a million tokens, the model is that of plain passes over all training texts until one gains too little."""
    rng = random.Random(8)
    topics = [[f"{a}{i}" for i in range(60)] for a in "pqr"]
    rows = [(i, " ".join(rng.choices(rng.choice(topics), k=40) * 25), i % 5 == 1) for i in range(630)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, held_out boolean")
    train = docs.where("not held_out")
    known = hmm.head(hmm.count_words(train), train.count())
    seen = hmm.encode(docs.select("doc_id", "held_out", "text"), known).cache()
    symbols = hmm.unpacked(pa.array([r["symbols"] for r in seen.where("not held_out").select("symbols").collect()], pa.binary()))
    assert known.tokens == sum(map(len, symbols)) == 504 * 1001
    want, last = hmm.begin(known), -np.inf
    gains = []
    while len(gains) < hmm.LEAST or gains[-1] >= hmm.TOLERANCE:
        *sums, log = hmm.expected(want, symbols)
        want = hmm.maximised(*sums, known.weight)
        gains.append(log / known.tokens - last)
        last = log / known.tokens
    read, plain = [], hmm.aggregated
    monkeypatch.setattr(hmm, "aggregated", lambda *x: read.append((got := plain(*x))[4]) or got)
    model = hmm.baum_welch(seen, known)
    assert read == [known.tokens] * len(gains)
    assert all(np.allclose(a, b) for a, b in zip((model.start, model.move, model.emit), (want.start, want.move, want.emit)))


def test_lm_scores(spark, docs, monkeypatch):
    monkeypatch.setattr(hmm, "HEAD", 24)
    monkeypatch.setattr(hmm, "OWN", 10)
    rows = corpus()
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    tokens = lambda t: [*WORD.findall((t or "").translate(LOWER)), None]
    c = collections.Counter(w for i, t, *_ in rows if not out(i) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    want = []
    for i, t, *_ in rows:
        x = tokens(t)
        want.append((str(i), out(i), len(x), sum(c[w] > 0 for w in x), n, round(sum(np.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in x), 6)))
    got = hmm.score(docs).collect()
    assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == sorted(want)
    kept = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in kept) > sum(r["base_score"] for r in kept) and all(r["score"] <= 0 for r in got)
    assert hmm.score(docs.limit(0)).count() == 0


# 8


def brute(rows, width, num, den):
    sets = {}
    for k, (_, t) in enumerate(rows):
        w = WORD.findall((t or "").translate(LOWER))
        sets[k] = frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return sorted((str(i), len(sets[k]), str(least.get(find(k)))) for k, (i, _) in enumerate(rows))


def test_join(spark, docs):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(400)]
    rows = [(r[0], r[1]) for r in corpus()]
    for f in range(6):
        base = [rng.choice(words) for _ in range(rng.choice([3, 9, 12, 40, 150]))]
        for _ in range(14):
            x = list(base)
            for _ in range(rng.randint(0, max(1, len(x) // 25))):
                x[rng.randrange(len(x))] = rng.choice(words)
            rows.append((1000 + len(rows), " ".join(x)))
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_shingles int").repartition(7)
    for width, num in ((3, 90), (5, 80), (1, 60)):
        got = sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in partenum.components(df, width, num, 100).collect())
        assert got == brute(rows, width, num, 100)
    kept = partenum.representatives(df, 5, 80, 100)
    assert kept.columns == df.columns
    want = brute(rows, 5, 80, 100)
    groups = {c for _, n, c in want if n}
    assert kept.count() == len(groups) + len({(i, t) for i, t in rows if not WORD.findall(t or "")})
    assert partenum.components(df.limit(0)).count() == 0 and partenum.representatives(df.limit(0)).count() == 0


@given(st.integers(0, 2**32), st.integers(1, 60), st.integers(0, 8), st.sampled_from([(90, 100), (80, 100)]))
@settings(max_examples=150, deadline=None)
def test_linked_sets_share_what_they_should(seed, n, change, gamma):
    rng = np.random.default_rng(seed)
    num, den = gamma
    a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
    drop = rng.integers(0, change + 1)
    b = np.unique(np.r_[a[min(drop, len(a) - 1) :], rng.integers(0, 2**63, change - drop).astype(np.uint64)])
    both = len(np.intersect1d(a, b))
    if den * both < num * (len(a) + len(b) - both):
        return
    s, i, ask = partenum.signatures([a, b], num, den)
    shared = np.intersect1d(s[i == 0], s[i == 1])
    needs = [ask[(i == k) & np.isin(s, shared)] // 2 for k in (0, 1)]
    assert len(shared) and all(len(shared) >= x.max() for x in needs)
    x, y = (np.frombuffer(partenum.sketch(z), np.uint64)[None] for z in (a, b))
    w = min(x.shape[1], y.shape[1])
    assert np.bitwise_count(partenum._folded(x, w) ^ partenum._folded(y, w)).sum() <= len(a) + len(b) - 2 * both


# 9


def test_mixing(spark, docs):
    rows = corpus()
    got = mixing.mix(docs, keep=("text",)).collect()
    assert len(got) == len(rows)
    size = lambda t: len(WORD.findall(t or ""))
    by = collections.Counter()
    for _, t, _, s in rows:
        by[s] += size(t)
    order = sorted(by, key=lambda s: (s is None, s or ""))
    weight = {s: k % 3 + 1.0 for k, s in enumerate(order)}
    target, capped = {}, set()
    while True:
        free = [s for s in order if s not in capped]
        left = sum(by.values()) - sum(3.0 * by[s] for s in capped)
        target = {s: 3.0 * by[s] if s in capped else left * weight[s] / sum(weight[x] for x in free) for s in order}
        over = {s for s in free if target[s] > 3 * by[s]}
        if not over:
            break
        capped |= over
    source = {(i, t): s for i, t, _, s in rows}
    taken, largest = collections.Counter(), collections.Counter()
    for r in got:
        s = source[r["doc_id"], r["text"]]
        assert r["size"] == size(r["text"]) and r["source_size"] == by[s] and np.isclose(r["target"], target[s])
        assert r["taken"] == r["times"] * r["size"] and 0 <= r["times"] <= 3
        taken[s] += r["taken"]
        largest[s] = max(largest[s], r["size"] * (2 if r["doc_id"] == 0 else 1))
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in order)
    assert sorted(map(repr, mixing.mix(docs.repartition(3), keep=("text",)).collect())) == sorted(map(repr, got))
    assert mixing.mix(docs.limit(0)).count() == 0


# 10


def test_warc(spark, monkeypatch):
    long = "é" * 200000
    rows = [(3, "u\r\nx", "a" * 100), (1, None, "a" * 100), (2, "u", "a" * 100), (4, "u", None), (5, "u", ""), (6, "u", "b" * 99), (7, "u", "b" * 99), (8, "u", long), (1, None, "a" * 100), (9, "u", long)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "page_id long, url string, html string, payload_bytes int").repartition(3)
    got = sorted((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.round_trip(df).collect())
    want = []
    for i, _, h in rows:
        p = (h or "").encode()
        first = min(j for j, _, g in rows if (g or "") == (h or ""))
        again = len(p) >= 100 and i != first
        want.append((i, len(p), hashlib.sha256(p).hexdigest(), "revisit" if again else "response", first if again else None))
    assert got == sorted(want, key=lambda r: r[:2])
    monkeypatch.setattr(warc, "MAP_BITS", 2)  # all bits set: every page is told by the join
    again = warc.round_trip(df).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, again), key=lambda r: (r[0], r[1])) == got
    assert warc.round_trip(df.limit(0)).count() == 0


def test_warc_frames_and_checks():
    import zstandard

    trained = zstandard.train_dictionary(1024, [f"record {i} with some common text {i % 7}".encode() * 3 for i in range(200)]).as_bytes()
    for dictionary in (b"", trained):
        c = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else zstandard.ZstdCompressor()
        raw = [warc.record(1, "u", b"x" * 70000, None), warc.record(2, "u", b"x", 1)]
        archive = warc.leading_frame(dictionary) + b"".join(map(c.compress, raw))
        assert list(warc.records(io.BytesIO(archive))) == raw
        with pytest.raises(ValueError):
            list(warc.records(io.BytesIO(archive[:-3])))
    with pytest.raises(ValueError):
        list(warc.records(io.BytesIO(b"12345678")))
    good = warc.record(1, "u", b"payload", None)
    assert warc.parse(good)["payload_bytes"] == 7
    for bad in (good.replace(b"payload\r", b"pAyload\r"), good[:-1], good.replace(b"WARC/1.1", b"WARC/9.9"), good.replace(b"WARC-Date", b"WARC-Dote")):
        with pytest.raises(ValueError):
            warc.parse(bad)


# the pipeline


def test_pipeline(spark, docs, tmp_path):
    import corpus_pipeline as p

    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    one = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = p.language(spark, one, str(tmp_path))
    assert kept.columns == one.columns and not kept.where("text is null or trim(text) = ''").count()
    unique = p.near_duplicates(spark, kept, str(tmp_path))
    assert sorted(r["component_id"] for r in partenum.components(unique).collect() if r["component_id"] is not None) == sorted(r["doc_id"] for r in unique.collect() if r["doc_id"] is not None)
    mixed = p.mixture(spark, unique, str(tmp_path))
    want = collections.Counter({(r["doc_id"], r["text"]): r["times"] for r in mixing.mix(unique, keep=("text",)).collect() if r["times"]})
    assert collections.Counter((r["doc_id"], r["text"]) for r in mixed.collect()) == want and mixed.columns == one.columns
    packed = p.run(spark, str(tmp_path))
    assert packed.agg(F.sum("length")).first()[0] == packing.pieces(mixed, __import__("public_tokenizers").path("byte_bpe_50k.json")).agg(F.sum("length")).first()[0]


def test_pipeline_equals_plain_version(spark, tmp_path):
    """run() against each stage done by plain loops: language models, all pairs, thresholds over sorted places, the file's own tokenizer."""
    import corpus_pipeline as p
    import public_tokenizers
    from tokenizers import Tokenizer

    rng = random.Random(12)
    foreign = [(500 + k, " ".join("".join(chr(first + rng.randrange(40)) for _ in range(6)) for _ in range(30)), None, "a") for k, first in enumerate((0x0E01, 0x0410, 0x4E00, 0x0E01))]
    rows = [r for r in corpus() if r[0] is not None] + foreign
    documents(spark, rows).select("doc_id", "text", "lang", "source", "n_chars").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    table_ = spark.read.parquet(str(tmp_path / "documents.parquet"))
    # 1. The sample is the operator's choice of texts; models and verdicts are plain.
    samples = langid.sample(table_)
    fitted = {k: [x for i, x in enumerate(v) if i % 4 != 3] or v for k, v in samples.items()}
    held = {k: [x for i, x in enumerate(v) if i % 4 == 3] or v for k, v in samples.items()}
    alphabet = {c for v in fitted.values() for x in v for c in x.lower()} | {"\x02"}
    plain = {k: PlainKneserNey(v, alphabet) for k, v in fitted.items()}
    known = lambda t: "".join(c if c in alphabet else "\0" for c in t.lower())
    bounds = {}
    for k, v in held.items():
        texts = [x[:4000] for x in v if any(c.isalpha() for c in x)] or [" "]
        texts += [x[a : a + n] for n in (20, 60, 200) for x in texts[:100] for a in range(0, min(len(x), 4 * n), n)]
        n = np.array([len(x) for x in texts])
        ce = np.array([-plain[k].log(known(x)) / len(x) for x in texts])
        mean = np.average(ce, weights=np.minimum(n, 200))
        a, b = np.linalg.lstsq(np.stack([np.ones(len(n)), 1 / n], 1), (ce - mean) ** 2, rcond=None)[0]
        bounds[k] = mean, max(a, 1e-4), max(b, 1e-2)

    def accepted(t):
        if not t or not any(c.isalpha() for c in t):
            return False
        t = t[:6000]  # the one longer text repeats itself
        logs = {k: m.log(known(t)) for k, m in plain.items()}
        best = max(sorted(logs), key=logs.get)
        mean, a, b = bounds[best]
        return -logs[best] / len(t) <= mean + langid.REJECT * np.sqrt(a + b / len(t))

    kept = [r for r in rows if accepted(r[1])]
    assert {r[0] for r in rows} - {r[0] for r in kept} >= {500, 501, 502, 503, 60, 61, 62} and {r[0] for r in kept} >= set(range(60))
    # 2. One document of each component of all pairs.
    component = {i: c for i, _, c in brute([(i, t) for i, t, *_ in kept], 5, 80, 100)}
    least, once = {}, {}
    for r in kept:
        least[component[str(r[0])]] = min(least.get(component[str(r[0])], r[0]), r[0])
        once[r[0], r[1]] = r
    unique = [r for (i, _), r in once.items() if i in least.values()]
    # 3. Targets by filling up, takes by places in order.
    size = lambda t: len(WORD.findall(t or ""))
    by = collections.Counter()
    for _, t, _, s in unique:
        by[s] += size(t)
    order = sorted(by, key=lambda s: (s is None, s or ""))
    weight = {s: k % 3 + 1.0 for k, s in enumerate(order)}
    capped = set()
    while True:
        free = [s for s in order if s not in capped]
        left = sum(by.values()) - sum(3.0 * by[s] for s in capped)
        target = {s: 3.0 * by[s] if s in capped else left * weight[s] / sum(weight[x] for x in free) for s in order}
        if not (over := {s for s in free if target[s] > 3 * by[s]}):
            break
        capped |= over
    want = collections.Counter()
    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    for s in order:
        whole = int(target[s] / by[s] + 1e-9)
        left, upto = max(0.0, target[s] - whole * by[s]), 0
        for _, i, x in sorted((int(hashlib.md5(str(i).encode()).hexdigest()[:9], 16), i, x) for i, x, _, src in unique if src == s):
            more = upto + size(x) <= left or (upto <= left and upto + size(x) - left < left - upto)
            upto += size(x)
            # 4. Tokens and the end, cut from the back into sequences.
            ids = [*t.encode(x, add_special_tokens=False).ids, 0]
            first = len(ids) if len(ids) <= 2048 else len(ids) % 2048 or 2048
            cuts = [0, *range(first, len(ids) + 1, 2048)]
            for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                want[i, k, a, b - a, zlib.crc32(struct.pack(f"<{b - a}I", *ids[a:b]))] += min(3, whole + more)
    got = p.run(spark, str(tmp_path)).collect()
    assert collections.Counter(tuple(r)[:5] for r in got) == +want
    filled = collections.defaultdict(list)
    for r in got:
        filled[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in filled.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 2048
    assert len(filled) <= -(-sum(r["length"] for r in got) // 2048) + 2


def test_pipeline_without_labels_and_with_clashing_columns(spark, docs, tmp_path):
    import corpus_pipeline as p

    odd = docs.select("doc_id", "text", "lang", "source", *[F.lit("x").alias(n) for n in ("lid_lang", "Lid_Score", "lid_accepted", "_id", "id", "bit", "null", "text_id", "row", "time", "times", "size", "taken", "_mix_source", "_place", "cls", "a.b")])
    one = p.language(spark, odd, "")
    assert one.columns == odd.columns and one.count() > 60
    two = p.near_duplicates(spark, one, "")
    assert two.columns == odd.columns and 0 < two.count() < one.count()
    three = p.mixture(spark, two, "")
    assert three.columns == odd.columns and three.count() > 0
    assert p.packed(spark, three, "").count() >= three.count()
    for rows in (docs.limit(0), docs.withColumn("lang", F.lit(None).cast("string"))):
        for name, stage in p.STAGES:
            out = stage(spark, rows, "")
            assert name == "language ID" and not out.take(1) or rows.take(1) or not out.take(1)
            rows = out

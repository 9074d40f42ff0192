"""Main text of web pages by the maximum-scoring subsequence.

A page is read as a sequence of tags and runs of words. Each has a score: the log odds,
learned from labelled pages, that what looks like it belongs to the article. Words of
ordinary prose score above zero, those of links, menus and the like below, tags below.
One linear scan finds the contiguous run with the largest sum; of it, what stands in
elements that are never article text (forms, adverts, comments and so on) is left out.
As it is left out anyway, it scores near zero and does not part what stands around it.

Names of classes and ids hint at such elements. Inside the article only whole names of
wrappers do; ids of headings and sections are slugs of their text and never do. Layouts
whose names say nothing are told by their structure: of a page without article or main,
the core is the container that holds most words of its own (and of large containers just
inside it); what stands in it, in small containers inside it, or elsewhere are three
different looks, as are short runs with the marks of notices and footers.

Labelled pages are (html with the article's text marked) pairs; `labelled` makes a fixed
set in several layouts, half of them with names that mean nothing, and others can be
given to `fit`.

Text: character references are decoded, white space inside a block becomes one space,
blocks are trimmed, empty ones left out, and the rest is joined in order by line breaks.

Time is linear in the page: a tag that never closes is text, and once a quoted attribute
doesn't end, quotes count no more in the rest of the page.

Defined cases: null and empty html give empty text; pages without tags are one block;
unclosed elements end with what holds them; unclosed comments, scripts and styles reach
to the end; very long pages are read whole; rows that repeat are extracted alike; an empty
table gives an empty result; extra columns are ignored, whatever their names; references
to no code point become the replacement character.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator
from html import unescape
from math import log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_RAW = r"<(script|style|noscript|template|svg|iframe|title|textarea|object|math)\b[^>]*>.*?(?:</\1\s*>|\Z)"
#: At a "<" with a ">" after it: an element without markup inside, a tag (closing, name, attributes), or a declaration.
_WHOLE = re.compile(_RAW + r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?/][^>]*>", re.S | re.I)
_PLAIN = re.compile(_RAW + r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>|<[!?/][^>]*>", re.S | re.I)
_NAMED = re.compile(r"<[/a-zA-Z]")
BLOCKS = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Containers whose ends are looked for; other elements don't matter to the context.
HOLDERS = BLOCKS - {"p", "hr", "body", "html"} | {"a", "span"}
#: Elements that hold text of their own; what stands inside others belongs to the next of these.
CONTAINERS = frozenset("div section td article main aside header footer nav form center body".split())
#: Containers inside the core with so many words of their own are parts of it.
LARGE = 60
NEVER = frozenset("nav aside form footer button select menu dialog head".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
HINTS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion promoted banner cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup signin login register menu menus nav navbar navigation breadcrumb breadcrumbs sidebar widget widgets related recommended recommendations trending popular share sharing social follow comment comments disqus reply replies respond discussion footer foot masthead topbar toolbar pagination pager copyright legal disclaimer search skip".split()
)
#: Inside the article: the elements that hints hold for, and the words that may stand beside a hint in a whole name.
WRAPPERS = frozenset("div section aside ul".split())
PLAIN = frozenset("area bar block box container inner list panel section slot unit wrap wrapper".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
COMMENTS = frozenset("comment comments disqus reply replies respond discussion".split())
_ATTR = re.compile(r"\b(class|id|role|hidden|style|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_SOME = re.compile(r"class|id|role|hidden|style", re.I)
#: What short runs of footers, notices and comments often hold.
_MARKS = re.compile(r"\u00a9|copyright|rights reserved|privacy|terms of (?:use|service)|cookie|newsletter|subscribe|sign up|log in|advertis|sponsored|leave a (?:comment|reply)|\breply\b|\d+ comments?\b|\bago\b", re.I)
_ZEROS, _DIGITS = re.compile(r"&#0+(?=[0-9])"), re.compile(r"&#[1-9][0-9]{7,};?")


def _decoded(raw: str) -> str:
    """raw with its character references decoded; numbers of any length are read in linear time."""
    return unescape(_DIGITS.sub("\ufffd", _ZEROS.sub("&#", raw))) if "&" in raw else raw


def _tags(html: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """Start, end, lower-case name ("" for what is no tag), whether it closes, and attributes of all markup; each part of the page is looked at a bounded number of times."""
    at, last, pattern = 0, html.rfind(">"), _WHOLE
    while (at := html.find("<", at)) >= 0:
        if html.startswith("<!--", at):
            end = html.find("-->", at + 4)
            end = len(html) if end < 0 else end + 3
            yield at, end, "", False, ""
            at = end
            continue
        if at > last:
            return
        m = pattern.match(html, at)
        if not m and pattern is _WHOLE and _NAMED.match(html, at):
            m = (pattern := _PLAIN).match(html, at)  # its quotes never end
        if m:
            yield at, m.end(), (m[3] or "").lower(), bool(m[2]), m[4] or ""
            at = m.end()
        else:
            at += 1


def _whole(value: str) -> set[str]:
    """The hints among names that consist of hints and plain words only."""
    out: set[str] = set()
    for one in value.split():
        words = {w.lower() for w in _PART.findall(one)}
        if words <= HINTS | PLAIN:
            out |= words & HINTS
    return out


def _flags(name: str, attributes: str, in_article: bool) -> tuple[bool, bool, bool]:
    """Whether an element is never article text, is the article, or holds comments."""
    out, article, comments = name in NEVER or (name == "header" and not in_article), name in ("article", "main"), False
    if attributes and _SOME.search(attributes):
        found = [(m[1].lower(), m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(attributes)]
        # Headings and sections (<section>, <div class="section level2">) have slugs of their text as ids.
        slug = name == "section" or name in HEADINGS or any(key == "class" and "section" in value.lower().split() for key, value in found)
        for key, value in found:
            if key == "role":
                out |= value.lower() in ROLES
                article |= value.lower() in ("main", "article")
            elif key == "hidden" or (key == "aria-hidden" and value.lower() == "true"):
                out = True
            elif key == "style":
                out |= "display:none" in value.replace(" ", "").lower()
            elif name not in ("body", "html", "main") and not (key == "id" and slug and (in_article or name in HEADINGS)):
                words = _whole(value) if in_article and name in WRAPPERS else set() if in_article else {w.lower() for w in _PART.findall(value)}
                comments |= bool(words & COMMENTS)
                out |= bool(words & HINTS) or (not in_article and "header" in words)
    return out, article, comments


def parsed(html: str) -> tuple[list[tuple], list[int]]:
    """("tag", name, dropped) and ("text", text, dropped, linked, in article, block, container) in page order; the container around each container."""
    out: list[tuple] = []
    stack: list[tuple] = []  # element, dropped, in article, in comments, container
    opened: Counter = Counter()
    around = [0]
    dropped = article = comments = False
    block, linked, at, container = "body", 0, 0, 0

    def text(raw: str) -> None:
        if raw:
            out.append(("text", _decoded(raw), dropped, bool(linked), article, block, container))

    for start, end, name, closing, attributes in _tags(html):
        if start > at:
            text(html[at:start])
        at = end
        if not name:
            continue
        spot = len(out)
        out.append(("tag", name if not closing else "/" + name, dropped))
        if name in BLOCKS:
            block = "body" if closing else name
        if name not in HOLDERS:
            continue
        if closing:
            if opened[name]:
                while True:
                    gone = stack.pop()[0]
                    opened[gone] -= 1
                    linked -= gone == "a"
                    if gone == name:
                        break
                dropped, article, comments, container = stack[-1][1:] if stack else (False, False, False, 0)
        elif not attributes.endswith("/"):
            if name == "a":
                linked += 1
            own, is_article, of_comments = _flags(name, attributes, article)
            comments = comments or of_comments
            # An article inside a hinted wrapper is an article again, but not one among comments.
            dropped = own if is_article and not comments else dropped or own
            article = article or (is_article and not dropped)
            if name in CONTAINERS:
                around.append(container)
                container = len(around) - 1
            stack.append((name, dropped, article, comments, container))
            opened[name] += 1
            out[spot] = ("tag", name, dropped)
    if at < len(html):
        text(html[at:])
    return out, around


def pieces(html: str) -> list[tuple]:
    return parsed(html)[0]


def _core(page: list[tuple], around: list[int]) -> tuple[int, list[int]]:
    """The container with most words of its own and 0.7 of those of large ones just inside it (the first, if several); each container's own words."""
    own, score = [0] * len(around), [0.0] * len(around)
    for p in page:
        if p[0] == "text" and not p[2] and not p[3]:
            own[p[6]] += len(p[1].split())
    for c in range(len(around)):
        score[c] += own[c]
        if c and own[c] >= LARGE:
            score[around[c]] += 0.7 * own[c]
    return max(range(len(around)), key=lambda c: (score[c], -c)), own


def _kinds(page: list[tuple], around: list[int]) -> list[tuple[tuple, int]]:
    """What each piece looks like, and how many words it has (tags: 0)."""
    has = any(p[0] == "text" and p[4] for p in page)
    place_of: list[str] = []
    if not has:
        core, own = _core(page, around)
        for c, outer in enumerate(around):  # a container comes after the one around it
            if c == core:
                place_of.append("core")
            elif c and place_of[outer] in ("core", "inner"):
                place_of.append("core" if own[c] >= LARGE and place_of[outer] == "core" else "inner")
            else:
                place_of.append("rim")
    out = []
    for p in page:
        if p[0] == "tag":
            name = p[1].lstrip("/")
            out.append((("tag", name if name in BLOCKS or name in ("a", "br", "img", "input") else "inline"), 0))
        else:
            _, text, dropped, linked, article, block, container = p
            n = len(text.split())
            place = "in" if article else "beside" if has else place_of[container]
            size = 0 if n < 4 else 1 if n < 12 else 2
            kind = "p" if block in ("p", "blockquote", "pre") else "h" if block[:1] == "h" and block[1:].isdigit() else "li" if block in ("li", "td", "th", "dd", "dt") else "other"
            mark = n <= 25 and not article and bool(_MARKS.search(text))
            out.append((("word", dropped, mark, (place, kind, size, linked)), n))
    return out


def fit(pages: list[tuple[str, str]]) -> dict[tuple, float]:
    """Scores by feature, from pages as (html, marker): words that start with the marker are the article's."""
    good, bad = Counter(), Counter()
    for html, marker in pages:
        page, around = parsed(html)
        inside = [p[0] == "text" and any(w.startswith(marker) for w in p[1].split()) for p in page]
        spots = [i for i, x in enumerate(inside) if x]
        for i, (kind, n) in enumerate(_kinds(page, around)):
            within = bool(spots) and spots[0] <= i <= spots[-1]
            if kind[0] == "tag":
                (good if within else bad)[kind] += 1
            elif n:
                for j, value in enumerate(kind[1:]):
                    (good if inside[i] else bad)[(j, value)] += n
    words_good, words_bad = (sum(v for k, v in c.items() if k[0] == 0) for c in (good, bad))
    tags_good, tags_bad = (sum(v for k, v in c.items() if k[0] == "tag") for c in (good, bad))
    out = {}
    for k in {*good, *bad}:
        a, b = (tags_good, tags_bad) if k[0] == "tag" else (words_good, words_bad)
        odds = log((good[k] + 1) / (a + 2)) - log((bad[k] + 1) / (b + 2))
        out[k] = min(-0.2, odds) if k[0] == "tag" else odds
    return out


def best_run(scores: list[float]) -> tuple[int, int]:
    """Start and end of the contiguous run with the largest sum (the first, if several); (0, 0) if none is above zero."""
    best, run, begin, found = 0.0, 0.0, 0, (0, 0)
    for i, s in enumerate(scores):
        if run <= 0:
            run, begin = 0.0, i
        run += s
        if run > best:
            best, found = run, (begin, i + 1)
    return found


def extract(html: str, weights: dict[tuple, float]) -> str:
    page, around = parsed(html)
    kinds = _kinds(page, around)
    scores = []
    for p, (kind, n) in zip(page, kinds):
        if p[2]:
            scores.append(-0.01 * n)  # left out below; it should not part a heading from its text
        elif kind[0] == "tag":
            scores.append(weights.get(kind, -0.3))
        else:
            scores.append(n * sum(weights.get((j, v), 0.0) for j, v in enumerate(kind[1:])) if n else 0.0)
    a, b = best_run(scores)
    blocks: list[str] = []
    parts: list[str] = []
    for p in page[a:b]:
        if p[0] == "text":
            if not p[2]:
                parts.append(p[1])
        elif p[1].lstrip("/") == "br":
            parts.append(" ")
        elif p[1].lstrip("/") in BLOCKS:
            blocks.append("".join(parts))
            parts = []
    blocks.append("".join(parts))
    return "\n".join(x for x in (" ".join(y.split()) for y in blocks) if x)


def labelled(n: int = 240, seed: int = 11) -> list[tuple[str, str]]:
    """Made pages in several layouts; the article's words start with "zq". In every other page no name means anything."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeilmnorstu") for _ in range(rng.randint(2, 9)))
    some = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b)))
    mine = lambda a, b: " ".join("zq" + word() for _ in range(rng.randint(a, b)))
    links = lambda k: "".join(f'<li><a href="/{word()}">{some(1, 2)}</a></li>' for _ in range(k))
    return [(_unnamed(rng, word, some, mine, links) if i % 2 else _named(rng, word, some, mine, links), "zq") for i in range(n)]


def _article(rng, mine, advert: str) -> str:
    body = f"<h1>{mine(3, 10)}</h1>"
    for _ in range(rng.randint(1, 9)):
        kind = rng.random()
        body += f"<p>{mine(2, 90)}</p>" if kind < 0.6 else f"<p><b>{mine(4, 60)}<br><p>{mine(2, 40)}</p>" if kind < 0.75 else f"<ul><li>{mine(2, 12)}</li><li>{mine(2, 12)}</li></ul>" if kind < 0.85 else f'<p>{mine(4, 30)} <a href="/x">{mine(1, 3)}</a> {mine(4, 30)}</p>' if kind < 0.9 else f"<div>{mine(6, 60)}</div>" if kind < 0.95 else f"{mine(6, 40)}<br>{mine(6, 40)}<p>" if kind < 0.98 else advert
    return body


def _named(rng, word, some, mine, links) -> str:
    nav = f"<{(t := rng.choice(['nav', 'div']))}{rng.choice(['', ' class=menu']) if t == 'nav' else ' class=menu'}><ul>{links(rng.randint(3, 9))}</ul></{t}>"
    ad = f'<div class="{rng.choice(["ad", "advert", "promo-box", "cookie-notice", "sponsored"])}">{some(4, 30)}</div>'
    head = f"<header><h1><a href=/>{some(1, 3)}</a></h1><p>{some(2, 8)}</p></header>" if rng.random() < 0.5 else ""
    side = f'<{(t := rng.choice(["aside", "div"]))} class="sidebar"><h3>{some(1, 3)}</h3><ul>{links(4)}</ul><p>{some(5, 25)}</p></{t}>' if rng.random() < 0.5 else ""
    talk = '<section class="comments"><h2>' + some(1, 2) + "</h2>" + "".join(f"<div class=comment><p>{some(3, 40)}</p></div>" for _ in range(rng.randint(1, 5))) + "</section>" if rng.random() < 0.5 else ""
    form = f"<form><label>{some(1, 2)}</label><input><button>{word()}</button></form>" if rng.random() < 0.4 else ""
    foot = f"<footer><p>&copy; {some(2, 20)}</p></footer>" if rng.random() < 0.7 else f'<div id="footer">{some(2, 20)}</div>'
    hold = rng.choice(["article", "article", "article", "main", "div class=post", "div id=content"])
    parts = [f"<{hold}>{_article(rng, mine, ad)}</{hold.split()[0]}>", *rng.sample([ad, side, form], 3)[: rng.randint(0, 3)]]
    if rng.random() < 0.5:
        parts = parts[::-1]
    return f"<html><head><title>{some(2, 6)}</title></head><body>{head}{nav}{''.join(parts)}{talk}{foot}</body></html>"


def _unnamed(rng, word, some, mine, links) -> str:
    """Wrappers with names out of letters, no article or main."""
    wrap = lambda inner, tags=("div", "div", "section"): f'<{(t := rng.choice(tags))} class="q{rng.randint(1, 99)}">{inner}</{t}>'
    top = wrap(f"<a href=/>{some(1, 3)}</a>" + rng.choice(["", f"<span>{some(1, 6)}</span>"])) + wrap(rng.choice([f"<ul>{links(rng.randint(3, 9))}</ul>", "".join(f"<a href=/{word()}>{word()}</a> " for _ in range(6))]))
    body = _article(rng, mine, "")
    if rng.random() < 0.25:  # an article in large parts
        body = f"<h1>{mine(3, 9)}</h1>" + "".join(wrap(f"<h2>{mine(1, 6)}</h2>" + "".join(f"<p>{mine(40, 90)}</p>" for _ in range(rng.randint(2, 3)))) for _ in range(rng.randint(2, 4)))
    side = wrap(f"<h3>{some(1, 3)}</h3><ul>{links(4)}</ul>" + rng.choice(["", f"<p>{some(4, 20)}</p>"])) if rng.random() < 0.5 else ""
    who = lambda: rng.choice([f"<b>{some(1, 2)}</b>", f"<span>{some(1, 2)}</span> <span>{rng.randint(1, 20)} days ago</span>", f"<h4>{some(1, 2)}</h4>"])
    unit = lambda c: f'<div class="{c}">{who()}<p>{some(3, 45)}</p>{rng.choice(["", "<a href=#>Reply</a>"])}</div>'
    talk = wrap(rng.choice(["", f"<h3>{rng.randint(1, 9)} comments</h3>", f"<h3>{some(1, 2)}</h3>"]) + "".join(unit(c) for c in [f"u{rng.randint(1, 9)}"] * rng.randint(1, 6))) if rng.random() < 0.6 else ""
    foot = wrap(rng.choice(["&copy; ", "Copyright ", "", ""]) + f"{some(2, 16)} " + rng.choice(["", "All rights reserved", f"<a href=/p>{some(1, 2)}</a> <a href=/t>{some(1, 2)}</a>"]))
    return f"<html><head><title>{some(2, 6)}</title></head><body>{top}{rng.choice(['', side])}{wrap(body)}{side}{talk}{foot}</body></html>"


def main_text(pages: DataFrame, weights: dict[tuple, float] | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page; rows stay where they are."""
    scores = weights or fit(labelled())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                texts = [extract(x.as_py() or "", scores) for x in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html")).mapInArrow(run, "page_id long, url string, text string, n_chars long")

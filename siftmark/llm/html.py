"""Main text of web pages by a maximum-scoring subsequence of words and tags.

A page is read once into words and tags. Words score positive and tags negative; how much, by tag name and by the kind of
element a word stands in, is the log ratio of its counts inside and outside the main text of labelled pages. A linear scan
finds the contiguous region of the largest sum. Blocks that the region touches are the text, without those inside
navigation, adverts, forms, scripts and the like, which tag and class names tell; names never hide the only article of a page. If the region holds words of article or main elements, what lies outside all of these goes;
what the elements hold outside the region goes too.

Labelled pages are a bounded sample (``label_pages``) of the pages that mark their main text by an article or main element; a table
of labelled pages may be given instead. Without any, fixed starting weights are used.

Defined results: null and empty pages and pages without words give an empty text; unclosed tags, comments and elements end with the
page; every row, repeated or without id, gets its own result; texts of any length are read whole; extra columns pass through.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape
from math import log

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LABEL_PAGES = 400

# Fixed values of the HTML standard and of common page furniture.
BLOCKS = set(
    "address article aside blockquote body caption dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup "
    "hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template svg iframe object textarea title head".split())
FURNITURE = set("nav aside footer form button select label menu dialog fieldset".split())
MAIN = set("article main".split())
NAMES = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert\w*|banner|sponsor\w*|promo\w*|cookie\w*|consent|notice|alert|popup|modal|newsletter|subscribe|"
    r"nav\w*|menu|breadcrumbs?|sidebar|side|widget|footer|masthead|comments?|replies|respond|share|social|related|login|search)(?:$|[\s_-])",
    re.I,
)
ADVERTS = re.compile(r"(?:^|[\s_-])(?:ad|ads|advert\w*|sponsor\w*|promo\w*)(?:$|[\s_-])", re.I)
# Furniture that may stand around a whole page, so that the first article inside it counts.
WRAPPERS = set("form label fieldset dialog".split())
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>")
_NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)

# Starting weights, and how strongly they count against the labelled pages.
TAG_SCORE, WORD_SCORE = -0.5, 1.0
# The mildest score a tag can learn, and the weakest of a word outside furniture.
LEAST_TAG, LEAST_WORD = -0.02, 0.1

Token = tuple[str, str, int]  # kind of scored thing, its text (words) or "", number of words


def tokens(page: str) -> Iterator[tuple[str, str, bool, str]]:
    """(what, name or text, closing, attributes): what is "tag" or "text". One pass; a stray < is text."""
    at, size = 0, len(page)
    while at < size:
        if page[at] != "<":
            stop = page.find("<", at)
            stop = size if stop < 0 else stop
            yield "text", page[at:stop], False, ""
            at = stop
        elif page.startswith("<!--", at):
            stop = page.find("-->", at + 4)
            at = size if stop < 0 else stop + 3
        elif page.startswith(("<!", "<?"), at):
            stop = page.find(">", at)
            at = size if stop < 0 else stop + 1
        else:
            m = _TAG.match(page, at)
            if not m:
                stop = page.find("<", at + 1)
                stop = size if stop < 0 else stop
                yield "text", page[at:stop], False, ""
                at = stop
                continue
            name = m[2].lower()
            yield "tag", name, bool(m[1]), m[3]
            at = m.end()
            if name in ("script", "style", "textarea", "title", "iframe", "noscript") and not m[1] and not m[3].rstrip().endswith("/"):
                close = re.compile(rf"</{name}", re.I).search(page, at)
                at = close.start() if close else size


class Block:
    """Text between block tags, the scored things that precede and make it up, and where it stands."""

    __slots__ = ("pieces", "things", "hidden", "main")

    def __init__(self, hidden: bool, main: int):
        self.pieces, self.things, self.hidden, self.main = [], [], hidden, main

    def text(self) -> str:
        return " ".join(unescape("".join(self.pieces)).split())


def blocks(page: str | None) -> list[Block]:
    """The blocks of a page in order. ``main`` numbers the outermost article or main element around a block, 0 for none.

    If every article and main element is hidden, by its own class names or by those of a wrapper, the first one is read as the main text
    and what hides it does not count.
    """
    found = _blocks(page, False)
    if any(b.main and not b.hidden and b.text() for b in found) or not re.search(r"<(?:article|main)[\s>]", page or "", re.I):
        return found
    freed = _blocks(page, True)
    return freed if any(b.main and not b.hidden and b.text() for b in freed) else found


def _blocks(page: str | None, free_first: bool) -> list[Block]:
    out: list[Block] = []
    stack: list[tuple[str, bool, bool]] = []  # name, hides its content, is a main element
    hidden = mains = seen = links = 0
    paragraph = False  # is the open paragraph hidden
    advert, depth = "", 0  # the inline element that hides its text, and how many of its name are open
    current = Block(False, 0)
    out.append(current)
    for what, name, closing, attributes in tokens(page or ""):
        if what == "text":
            if depth:
                continue
            current.pieces.append(name)
            words = len(name.split())
            if words:
                kind = "word furniture" if hidden else "word link" if links else "word"
                current.things.append((kind, words))
            continue
        thing = (f"tag {name}", 1)
        if name == "br":
            current.pieces.append(" ")
        if name == "a":
            links = 0 if closing else 1
        breaks = name in BLOCKS
        if breaks:
            links = 0 if depth and advert == "a" else links
            paragraph, depth = False, 0
        elif depth:
            depth += (name == advert) * (-1 if closing else 1)
        elif not closing and name not in VOID and name not in RAW and name not in FURNITURE and not attributes.rstrip().endswith("/"):
            if any(ADVERTS.search(a or b or c) for a, b, c in _NAMED.findall(attributes)):
                advert, depth = name, 1
        if closing:
            if any(s[0] == name for s in stack):
                while stack:
                    top, hides, is_main = stack.pop()
                    hidden -= hides
                    mains -= is_main
                    if top == name:
                        break
        elif name not in VOID and not attributes.rstrip().endswith("/") and (breaks or name in RAW or name in FURNITURE):
            named = " ".join(a or b or c for a, b, c in _NAMED.findall(attributes))
            first = free_first and name in MAIN and seen == 0 and not any(hides and (n in RAW or (n in FURNITURE and n not in WRAPPERS)) for n, hides, _ in stack)
            if first:
                stack = [(n, False, m) for n, _, m in stack]
                hidden = 0
            is_main = name in MAIN and not hidden
            hides = not first and (name in RAW or name in FURNITURE or (name == "header" and not mains) or (name not in ("html", "body", "main") and bool(named) and bool(NAMES.search(named))))
            if is_main and not hides and mains == 0:
                seen += 1
            if name == "p":
                paragraph = hides
            else:  # paragraphs end where the next block begins and hold no others
                stack.append((name, hides, is_main and not hides))
                hidden += hides
                mains += is_main and not hides
        if breaks or name in RAW or name in FURNITURE:
            current = Block(hidden > 0 or paragraph, seen if mains else 0)
            out.append(current)
        current.things.append(thing)
    return out


def counts(page: str | None, inside: list[bool] | None = None) -> tuple[Counter, Counter]:
    """Scored things inside and outside the main text; by default the blocks of main elements that are not hidden."""
    found = blocks(page)
    marks = inside or [b.main > 0 and not b.hidden for b in found]
    both = Counter(), Counter()
    for block, mark in zip(found, marks):
        for kind, n in block.things:
            both[0 if mark else 1][kind] += n
    return both


def weights_of(inside: dict[str, int], outside: dict[str, int]) -> dict[str, float]:
    """Score by kind: log ratios of smoothed shares, words kept positive outside furniture and tags negative."""
    out = {"word": WORD_SCORE, "word link": WORD_SCORE / 4, "word furniture": -WORD_SCORE}
    total_in, total_out = sum(inside.values()) + 1, sum(outside.values()) + 1
    for kind in set(inside) | set(outside):
        ratio = log((inside.get(kind, 0) + 1) / total_in) - log((outside.get(kind, 0) + 1) / total_out)
        if kind == "word furniture":
            out[kind] = min(-LEAST_WORD, ratio)
        elif kind.startswith("word"):
            out[kind] = max(LEAST_WORD, min(2.0, ratio))
        else:
            out[kind] = min(LEAST_TAG, max(-4.0, ratio))
    return out


def learned(pages: DataFrame, label_pages: int = LABEL_PAGES) -> dict[str, float]:
    """Weights from at most ``label_pages`` pages that hold an article or main element, the first by hash of the page."""
    marked = pages.select(F.col("html").cast("string").alias("html")).where(F.col("html").rlike("(?i)<(article|main)[\\s>]"))
    keyed = marked.withColumn("_key", F.xxhash64("html"))
    cut = keyed.select("_key").distinct().orderBy("_key").limit(label_pages).agg(F.max("_key")).first()[0]
    sample = keyed.where(F.col("_key") <= F.lit(cut)).groupBy("_key").agg(F.first("html").alias("html"))  # copies of a page count once

    @F.udf("struct<inside:map<string,bigint>,outside:map<string,bigint>>")
    def of_page(page):
        inside, outside = counts(page)
        return dict(inside), dict(outside)

    inside, outside = Counter(), Counter()
    for row in sample.select(of_page("html").alias("c")).collect():
        inside.update(row["c"]["inside"])
        outside.update(row["c"]["outside"])
    return weights_of(inside, outside)


def best_region(scores: list[float]) -> tuple[int, int]:
    """First and last index (inclusive) of the contiguous run of the largest sum; (0, -1) if none is positive."""
    best, first, last, total, start = 0.0, 0, -1, 0.0, 0
    for i, score in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += score
        if total > best:
            best, first, last = total, start, i
    return first, last


def main_text(page: str | None, weights: dict[str, float]) -> str:
    found = blocks(page)
    owners = [i for i, b in enumerate(found) for _ in b.things]
    shown = [i for i, b in enumerate(found) if b.main and not b.hidden and any(kind.startswith("word") for kind, _ in b.things)]
    between = range(shown[0], shown[-1]) if shown else range(0)  # what stands between main elements goes anyway and parts no region
    scores = [0.0 if (b.main and b.hidden) or (not b.main and i in between) else weights.get(kind, TAG_SCORE if kind.startswith("tag") else WORD_SCORE) * n for i, b in enumerate(found) for kind, n in b.things]
    first, last = best_region(scores)
    if last < first:
        return ""
    low, high = owners[first], owners[last]
    region = found[low : high + 1]
    chosen = [b for b in region if b.main and not b.hidden and any(kind.startswith("word") for kind, _ in b.things)] or region
    return "\n".join(t for b in chosen if not b.hidden and (t := b.text()))


def extract(pages: DataFrame, labelled: DataFrame | None = None, label_pages: int = LABEL_PAGES) -> DataFrame:
    """All columns of ``pages`` and ``_main``, the main text; weights are learned from ``labelled`` or the pages themselves."""
    weights = learned(pages if labelled is None else labelled, label_pages)

    @F.pandas_udf("string")
    def of_pages(texts):
        import pandas as pd

        return pd.Series([main_text(t, weights) for t in texts], dtype=object)

    return pages.withColumn("_main", of_pages(F.coalesce(F.col("html").cast("string"), F.lit(""))))

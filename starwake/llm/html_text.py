"""Main text of web pages by the distribution of text over blocks."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Blocks in a sliding window.
WINDOW = 3
#: Characters in a window from which text surges. Inside a marked article any text counts.
SURGE = 86

# HTML element names.
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol "
    "option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("noscript template svg math iframe object canvas select button".split())
FURNITURE = frozenset("nav footer aside form menu dialog title head".split())
ARTICLE = frozenset(["article", "main"])
#: Words in class, id or role that mark menus, notices, adverts, sidebars and reader comments.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion "
    "sidebar menu nav navbar navigation breadcrumb breadcrumbs footer header masthead topbar toolbar "
    "cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter "
    "subscribe subscription signup login social share sharing related recommended comment comments "
    "commentlist disqus respond replies reply pagination pager widget complementary contentinfo "
    "search skip".split()
)

#: Marks of reader comments: such an element can be most of a page.
COMMENTS = frozenset("comment comments commentlist disqus respond replies reply".split())
#: A name with one of these says what a page has or lacks, not what the element is.
NEGATED = frozenset("has no not with without hide".split())
#: Words of the article itself: with one of these a header or a wrapper is part of it.
CONTENT = frozenset("article page post entry content main story section body".split())
WRAPPED = frozenset("header wrap wrapper container layout".split())
#: Share of the page's unlinked text from which an element with a mark is a wrapper of the page.
SHARE = 0.5

# The inside of a tag ends at the next < or > outside of quotes. A quote counts as one only if what
# follows its end can stand behind an attribute; else it was never closed and is a character as any other.
_INSIDE = r"(?:\"[^\"]*\"(?=[\s/>])|'[^']*'(?=[\s/>])|[^<>])*+"
# From left to right, so that a comment in a script and a script in a comment are only what they are in.
# Every part takes what it has looked at, so no place of a page is looked at again and again.
_CUT = re.compile(
    rf"(?P<raw><(script|style|textarea)(?=[\s/>]){_INSIDE}>(?:.*?</\2(?=[\s/>])[^<>]*>?|.*\Z))"
    rf"|<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[|\]\]>|<[!?][^<>]*>?"
    rf"|(?P<tag></?[A-Za-z]{_INSIDE}>?)",
    re.S | re.I,
)
_TAG = re.compile(r"<(/?)([A-Za-z][^\s/<>\"']*)((?:\"[^\"]*\"|'[^']*'|[^'\"<>])*+)>")
_QUOTES = str.maketrans("", "", "\"'<")
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?")
_NONE = re.compile(r"display\s*:\s*none", re.I)
_WORD = re.compile(r"[a-z]+")


@dataclass
class Block:
    text: str
    linked: int  # characters inside links
    article: bool


def _attributes(text: str) -> dict[str, str]:
    """The attributes of a tag by lower-case name; of several with a name the first counts."""
    out: dict[str, str] = {}
    for found in _ATTRIBUTE.finditer(text):
        out.setdefault(found[1].lower(), found[2] or found[3] or found[4] or "")
    return out


def _marks(attributes: dict[str, str]) -> set[str]:
    """Words in class, id and role that mark an element as furniture."""
    out: set[str] = set()
    for name in ("class", "id", "role"):
        for token in attributes.get(name, "").lower().split():
            words = set(_WORD.findall(token))
            if words & NEGATED or words & CONTENT and words & WRAPPED:
                continue
            out |= words & MARKS
    return out


class _Outline:
    """What the closed elements of a page hold: articles, headings, and shares of the unlinked text."""

    def __init__(self, page: str, tags: list[re.Match], closes: dict[int, int]) -> None:
        self.names = [tag[2].lower() for tag in tags]
        self.mains, self.headings, self.articles = [0], [0], [0]
        self.unlinked = [0]  # before each tag
        links, skipped, position = 0, -1, 0
        for at, (tag, name) in enumerate(zip(tags, self.names)):
            length = len(page[position : tag.start()].strip()) if links == 0 and at > skipped else 0
            self.unlinked.append(self.unlinked[-1] + length)
            position = tag.end()
            opened = not tag[1] and at in closes
            if name == "a":
                links = max(0, links + (-1 if tag[1] else 1))
            if opened and (name in RAW or name in FURNITURE and name != "form"):
                skipped = max(skipped, closes[at])
            own = opened and name == "article" and COMMENTS.isdisjoint(_marks(_attributes(tag[3])))
            self.articles.append(self.articles[-1] + own)
            self.mains.append(self.mains[-1] + (opened and name == "main"))
            self.headings.append(self.headings[-1] + (opened and name == "h1"))
        self.total = self.unlinked[-1] + len(page[position:].strip())

    def inside(self, counts: list[int], low: int, high: int) -> int:
        return counts[high] - counts[low + 1]

    def share(self, low: int, high: int) -> float:
        return (self.unlinked[high + 1] - self.unlinked[low + 1]) / max(1, self.total)


def _furniture(tag: re.Match, at: int, end: int, articles: int, nested: int, outline: _Outline) -> bool:
    """``articles``: open articles and mains; ``nested``: open articles."""
    name = outline.names[at]
    if name in RAW:
        return True
    by_name = name in FURNITURE or name == "header" and not articles
    if by_name and name in ("head", "title"):
        return True
    if name in ("body", "html") or name in ARTICLE or not by_name and not tag[3].strip():
        return False
    attributes = _attributes(tag[3])
    hidden = (
        "hidden" in attributes
        or attributes.get("aria-hidden", "").strip().lower() == "true"
        or bool(_NONE.search(attributes.get("style", "")))
    )
    marks = _marks(attributes)
    if articles or re.fullmatch("h[1-6]", name):
        marks.discard("header")
    if not (by_name or hidden or marks):
        return False
    if outline.inside(outline.mains, at, end):
        return False
    strict = by_name and name not in ("form", "header")
    if not strict and not nested and outline.inside(outline.articles, at, end):
        return False
    if strict or hidden:
        return True
    if not marks.isdisjoint(COMMENTS):
        return not outline.inside(outline.headings, at, end)
    return outline.share(at, end) <= SHARE


def _closed(tag: str) -> str:
    """A tag that ends and whose quotes do, as it was or without its quotes."""
    whole = tag if tag.endswith(">") else f"{tag}>"
    return whole if _TAG.fullmatch(whole) else f"<{whole[1:].translate(_QUOTES)}"


def find_blocks(page: str) -> list[Block]:
    """The page's blocks of text in order, without markup and without page furniture."""
    page = _CUT.sub(
        lambda found: _closed(found["tag"]) if found["tag"] else " " if found["raw"] else "", page
    )
    tags = list(_TAG.finditer(page))
    closes: dict[int, int] = {}
    waiting: dict[str, list[int]] = {}
    for at, tag in enumerate(tags):
        name = tag[2].lower()
        if name in VOID:
            continue
        if not tag[1]:
            if not tag[3].endswith("/"):
                waiting.setdefault(name, []).append(at)
        elif waiting.get(name):
            closes[waiting[name].pop()] = at
    outline = _Outline(page, tags, closes)
    blocks: list[Block] = []
    parts: list[str] = []
    linked, articles, nested, links = 0, 0, 0, 0

    def flush() -> None:
        nonlocal parts, linked
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            blocks.append(Block(text, linked, articles > 0))
        parts, linked = [], 0

    at, position = 0, 0
    while at < len(tags):
        tag = tags[at]
        text = page[position : tag.start()]
        parts.append(text)
        if links > 0:
            linked += len(text.strip())
        name, closing = tag[2].lower(), bool(tag[1])
        if name in BLOCKS:
            flush()
        if not closing and at in closes and _furniture(tag, at, closes[at], articles, nested, outline):
            flush()
            at = closes[at]
            tag = tags[at]
        elif name in ARTICLE and (closing or at in closes):
            articles = max(0, articles + (-1 if closing else 1))
            if name == "article":
                nested = max(0, nested + (-1 if closing else 1))
        elif name == "a":
            links = max(0, links + (-1 if closing else 1))
        position = tag.end()
        at += 1
    parts.append(page[position:])
    flush()
    return blocks


def main_blocks(blocks: list[Block], window: int = WINDOW, surge: int = SURGE) -> list[str]:
    """Blocks between the points where text surges and dives.

    The length of a block is its characters outside of links. The distribution at a block is the sum
    of lengths over the window that starts there. Text surges where the sum reaches ``surge`` and
    dives where it falls below; if it never surges the fullest window counts. All blocks from a
    surge up to its dive are kept. On a page that marks its article only blocks in it are looked at,
    links count as text, and any text is a surge.
    """
    lengths = [max(0, len(block.text) - block.linked) for block in blocks]
    if any(block.article for block in blocks):
        blocks, surge = [block for block in blocks if block.article], 1
        lengths = [len(block.text) for block in blocks]
    sums = [sum(lengths[at : at + window]) for at in range(len(lengths))]
    level = min(surge, max(sums, default=0))
    kept: list[str] = []
    at = 0
    while at < len(blocks) and level > 0:
        if sums[at] < level:
            at += 1
            continue
        while at < len(blocks) and not lengths[at]:
            at += 1  # a window reaches the text before its first block does
        end = at
        while end < len(blocks) and (sums[end] >= level or lengths[end]):
            end += 1
        kept.extend(block.text for block in blocks[at:end])
        at = max(end, at + 1)
    return kept


def extract_text(page: str | None) -> str:
    return " ".join(main_blocks(find_blocks(page))) if page else ""


def main_text(page: Column) -> Column:
    @F.pandas_udf("string")
    def extracted(pages: pd.Series) -> pd.Series:
        return pd.Series([extract_text(page) for page in pages], dtype=object)

    return extracted(page)


def extract_main_text(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """``page_id``, ``url``, ``text`` and ``n_chars`` (code points) of every row.

    Markup is stripped into blocks; character references are decoded, white space inside a block is
    one space, and blocks are joined by one space in page order. Menus, headers, footers, sidebars,
    forms, notices, adverts, comments of readers, scripts and styles are left out, by their elements
    or by words in class, id and role; an element that is never closed is not taken for one of them,
    only script, style and textarea run to the end of the page. An element around an article or main
    stays, and so does one that only a word marks with more than ``SHARE`` of the page's unlinked text
    in it. Elements hidden by hidden, aria-hidden or style go.
    What is left goes through :func:`main_blocks`.

    A null or empty page has an empty text. A tag that is not closed ends before the next one, and a
    quote in it that is not closed counts for nothing. Very long pages are read whole, in time in
    proportion to their length. Repeated rows are extracted each; other columns are not
    returned. An empty table gives an empty result. Pages are handled one by one, nothing is
    shuffled.
    """
    text = pages.select(
        F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), main_text(F.col(html_col)).alias("text")
    )
    return text.withColumn("n_chars", F.char_length("text").cast("bigint"))

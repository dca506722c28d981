"""HTML extraction: tree scoring.

A page is read into a tree. Every block of text passes points, for its length and its commas and less for the share that is
links, to the elements around it; the element with the most points is the article, with those siblings that hold text as well.
Menus, headers, footers, sidebars, notices, adverts, forms, comments and the like neither score nor are kept.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Elements without content, elements whose content is no markup, elements that begin a block, and what is never part of an article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe xmp noembed noframes plaintext".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre "
    "section summary table tbody td tfoot th thead tr ul".split()
)
UNWANTED_TAGS = frozenset("head script style noscript template iframe object embed canvas svg math audio video map nav header footer aside form fieldset input select option textarea button label dialog menu xmp noembed noframes".split())
UNWANTED_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar form".split())
UNWANTED_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs byline comment comments commentlist consent cookie cookies disqus discussion footer gdpr header masthead menu modal nav navbar "
    "navigation newsletter notice notices notification overlay pager pagination paywall popup promo promotion promoted related recommended respond replies reply share sharing sidebar signup skip social sponsor sponsored subscribe "
    "subscription toolbar widget widgets".split()
)
#: Of these, what marks an article as a reader's comment; and words beside which `header` names the article's own heading.
COMMENT_WORDS = frozenset("comment comments commentlist discussion disqus replies reply respond".split())
CONTENT_WORDS = frozenset("article content entry post story".split())
#: Elements that are paragraphs themselves: what they hold counts for the element around them.
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 li dd dt td th pre blockquote figcaption caption summary address".split())
#: An open element of the first kind is closed by the start of any of the second, within the third.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dd": ({"dd", "dt"}, {"dl"}),
    "dt": ({"dd", "dt"}, {"dl"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select"}),
}
#: Shares of a block's points for the elements around it, from the inside, and the share of the best element's points from which a sibling is kept.
SHARES, SIBLING = (1.0, 0.5, 1 / 3, 0.25), 0.2

#: A quote that is never closed doesn't hide the end of its tag.
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?=>|\Z)|[^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)|[^<]+|<", re.DOTALL)
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.IGNORECASE) for tag in RAW}


class Element:
    """up: the nearest block, or the page, around it; inside: whether it or a block around it is kept, once that is known."""

    __slots__ = ("tag", "parent", "unwanted", "points", "place", "block", "up", "in_article", "inside")

    def __init__(self, tag: str, parent: Element | None, unwanted: bool, place: int):
        self.tag, self.parent, self.unwanted, self.points, self.place, self.inside = tag, parent, unwanted, 0.0, place, None
        self.up = parent.block if parent else None
        self.block = self if tag in BLOCK or parent is None else self.up
        self.in_article = tag == "article" or parent is not None and parent.in_article


class Block:
    __slots__ = ("owner", "text", "linked")

    def __init__(self, owner: Element, text: str, linked: int):
        self.owner, self.text, self.linked = owner, text, linked


def unwanted(tag: str, attrs: str, in_article: bool = False) -> bool:
    """By the element's name, its role, or a word of its class or id. in_article: whether it stands in an article.

    The page's own frame and an article are kept whatever they are called, but for an article within another or one whose class or id is a comment's."""
    if tag in UNWANTED_TAGS:
        return True
    if tag in ("html", "body", "main") or not attrs.strip():
        return False
    for m in ATTRIBUTE.finditer(attrs):
        name, value = m[1].lower(), html.unescape(m[2] or m[3] or m[4] or "").lower()
        if tag == "article" and not in_article:
            if name in ("class", "id") and any(re.split(r"[^a-z]", w)[0] in COMMENT_WORDS for w in value.split()):
                return True
            continue
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "role" and value in UNWANTED_ROLES:
            return True
        if name == "style" and re.search(r"display\s*:\s*none", value):
            return True
        if name in ("class", "id"):
            for each in value.split():
                words = set(re.findall(r"[a-z]+", each))
                if words & UNWANTED_WORDS - ({"header"} if words & CONTENT_WORDS else set()):
                    return True
    return False


def parse(page: str) -> list[Block]:
    """The blocks of text in order, without what is unwanted. White space in them is one space; character references are decoded once."""
    root = Element("#page", None, False, 0)
    open_, blocks, made = [root], [], 1
    count: Counter = Counter()  # of open elements, by tag
    parts: list[str] = []
    linked = links = 0

    def flush() -> None:
        nonlocal linked
        if parts and (text := " ".join("".join(parts).split())):
            blocks.append(Block(open_[-1].block, text, min(linked, len(text))))
        parts.clear()
        linked = 0

    def close_from(k: int) -> None:
        nonlocal links
        if any(e.tag in BLOCK for e in open_[k:]):
            flush()
        for e in open_[k:]:
            links -= e.tag == "a"
            count[e.tag] -= 1
        del open_[k:]

    at, size = 0, len(page)
    while at < size:
        m = TOKEN.match(page, at)
        at = m.end()
        tag = m["tag"]
        if tag is None:
            text = m[0]
            if text[0] != "<" or text == "<":
                if not open_[-1].unwanted:
                    text = html.unescape(text) if "&" in text else text
                    parts.append(text)
                    if links:
                        linked += len(text)
            continue
        tag = tag.lower()
        if m["end"]:
            if not count[tag]:
                continue
            for k in range(len(open_) - 1, 0, -1):
                if open_[k].tag == tag:
                    close_from(k)
                    break
                if tag not in BLOCK and open_[k].tag in BLOCK:  # an inline end doesn't reach out of its block
                    break
            continue
        if tag == "br" or tag == "wbr":
            parts.append(" " if tag == "br" and not open_[-1].unwanted else "")
            continue
        if tag in BLOCK:
            for k in range(len(open_) - 1, 0, -1):  # a block ends an open paragraph
                if open_[k].tag == "p":
                    close_from(k)
                    break
                if open_[k].tag in BLOCK and open_[k].tag not in ("p", *PARAGRAPHS):
                    break
            if tag in CLOSES:
                kinds, within = CLOSES[tag]
                for k in range(len(open_) - 1, 0, -1):
                    if open_[k].tag in within:
                        break
                    if open_[k].tag in kinds:
                        close_from(k)
                        if tag != "tr" or not any(e.tag == "tr" for e in open_[k:]):
                            break
            flush()
        if tag in VOID:
            continue
        attrs = m["attrs"]
        element = Element(tag, open_[-1], open_[-1].unwanted or unwanted(tag, attrs, open_[-1].in_article), made)
        made += 1
        if tag in RAW:  # all of them are unwanted, or the title
            end = RAW_END[tag].search(page, at)
            at = end.end() if end else size
            continue
        if tag == "a":
            links += 1
        if not attrs.endswith("/") or tag in BLOCK or tag == "a":
            open_.append(element)
            count[tag] += 1
    flush()
    return blocks


def points(block: Block) -> float:
    """One, one more for each comma, up to three for length, less the share that is linked."""
    commas = sum(map(block.text.count, ",，、،"))
    return (1 + commas + min(3.0, len(block.text) / 100)) * (1 - block.linked / len(block.text))


def around(block: Block) -> list[Element]:
    """The elements that a block passes points to, from the inside; a paragraph's own element is not one."""
    e = block.owner.up if block.owner.tag in PARAGRAPHS and block.owner.up else block.owner
    out = []
    while e is not None and len(out) < len(SHARES):
        out.append(e)
        e = e.up
    return out


def is_inside(e: Element | None, kept: set[int]) -> bool:
    """Whether e or a block around it is kept. What is found out is noted, so that each element is looked at once, however deep a page is."""
    path = []
    while e is not None and e.inside is None:
        path.append(e)
        if e.place in kept:
            e.inside = True
            break
        e = e.up
    found = e is not None and bool(e.inside)
    for x in path:
        x.inside = found
    return found


def extract(page: str | None) -> str:
    """The article's blocks joined by two line ends; empty if a page has none."""
    blocks = parse(page or "")
    scored: dict[int, Element] = {}
    for block in blocks:
        for share, e in zip(SHARES, around(block), strict=False):
            e.points += share * points(block)
            scored[e.place] = e
    if not scored:
        return ""
    best = max(scored.values(), key=lambda e: (e.points, -e.place))
    e = best
    while e is not None:  # part of a marked article stands for all of it
        if e.tag in ("article", "main"):
            best = e
            break
        e = e.up
    kept, loose = {best.place}, None
    if best.tag not in ("article", "main") and best.up is not None:
        kept |= {e.place for e in scored.values() if e.parent is best.parent and e.points >= SIBLING * best.points}
        loose = best.parent.place
    out = []
    for block in blocks:
        first = around(block)[0]
        beside = loose is not None and first.place == loose and block.linked < len(block.text) / 3  # a paragraph beside the best element
        if is_inside(first, kept) or beside:
            out.append(block.text)
    return "\n\n".join(out)


def with_text(pages: DataFrame, column: str = "html", name: str = "text") -> DataFrame:
    """pages with the main text of a column of HTML; a column of that name is replaced."""

    @F.pandas_udf("string")
    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for found in batches:
            yield pd.Series([extract(x) for x in found], dtype="object")

    return pages.withColumn(name, apply(F.col(column)))


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text, n_chars of all pages. Null html is empty and gives an empty text; ids and urls are carried as they are; repeated rows stay."""
    found = with_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))

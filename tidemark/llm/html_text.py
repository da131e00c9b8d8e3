"""Main text of web pages by two passes of rules over blocks.

A page is cut into blocks at block-level tags. The first pass decides on a block by itself: what
stands in navigation, forms, asides, notices, comments and the like is boilerplate; what is mostly
links is boilerplate; long blocks with many stop words are text; very short ones are undecided. That a block is
in the page's article is a weight there, no verdict. In the second pass, undecided blocks take the label that
their nearest decided neighbours (on the same side of an article's edge) agree on; where they disagree or there
are none the block is boilerplate, unless the page marks it as part of its article or it is a heading of text.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Frequent function words of the languages read.
STOP_WORDS = frozenset(
    """
    the of and to a in is that for it as was with be by on not he this are or his from at which but have an
    had they you were their one all we can her has there been if more when will would who so no
    de la le les et des en un une du que qui dans pour pas sur au par il plus est avec ce son se ne sont
    der die und das von zu den mit sich des auf für ist im dem nicht ein eine als auch es an er hat aus bei
    el los las y del se por con una su para al lo como más o pero sus le ha me si sin sobre
    """.split()
)

BLOCK_TAGS = frozenset(
    """
    address article aside blockquote body br button caption center dd details dialog div dl dt fieldset figcaption
    figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main menu nav
    noscript object ol optgroup option p pre search section select summary table tbody td textarea tfoot th
    thead title tr ul video audio canvas svg template
    """.split()
)
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Elements whose content is no text at all.
RAW_TAGS = frozenset("script style noscript template svg iframe object textarea title head".split())
BOILERPLATE_TAGS = frozenset("nav header footer aside form button select menu dialog fieldset search".split())
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog form menu menubar".split())
# Parts of class names and ids, between other characters than letters.
BOILERPLATE_NAMES = frozenset(
    """
    ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu
    breadcrumb breadcrumbs sidebar aside widget footer header masthead cookie cookies consent gdpr notice popup modal
    overlay newsletter subscribe subscription signup login share sharing social related recommended comment comments
    reply replies respond disqus discussion reactions pagination pager copyright legal disclaimer toolbar
    """.split()
)
ARTICLE_TAGS = frozenset(("article", "main"))

_TAG = re.compile(
    r"<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*)(?:>|$)", re.S
)
_ATTRIBUTE = re.compile(r"\b(class|id|role|itemprop|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_NAME = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_WORD = re.compile(r"\w+")


@dataclass
class Block:
    text: str
    linked: int
    bad: bool
    article: bool
    heading: bool


def _signs(attributes: str, article: bool) -> tuple[bool, bool]:
    """Whether a tag's attributes mark boilerplate or something hidden, and whether the article."""
    bad = good = False
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id"):
            for part in value.split():
                names = _NAME.findall(_CAMEL.sub("-", part).lower())
                bad |= any(n in BOILERPLATE_NAMES and not (article and n in ("header", "masthead")) for n in names)
        elif name == "role":
            bad |= value.lower() in BOILERPLATE_ROLES
            good |= value.lower() in ("main", "article")
        elif name == "itemprop":
            good |= value.lower() == "articlebody"
        elif name == "hidden":
            bad = True
        elif name == "aria-hidden":
            bad |= value.lower() == "true"
        else:
            bad |= "display:none" in value.replace(" ", "").lower()
    return bad, good


def _end_of_raw(page: str, tag: str, place: int) -> int | None:
    """Where the element ends whose content begins at ``place``: after its end tag, a head also before the body."""
    at = re.compile(rf"</{tag}\b" if tag != "head" else r"</head\b|<body\b", re.I).search(page, place)
    if at and at[0][1] == "/":
        end = page.find(">", at.end())
        if end >= 0:
            return end + 1
        # No tag is closed from here on, but a body may begin.
        at = re.compile(r"<body\b", re.I).search(page, at.end()) if tag == "head" else None
    return at.start() if at else None


def blocks_of(page: str) -> list[Block]:
    """The blocks of a page in order, white space and character references resolved."""
    out: list[Block] = []
    open_tags: list[tuple[str, bool, bool]] = []
    # How many of each are open, and raw elements that no end tag follows any more.
    opened: Counter[str] = Counter()
    endless: set[str] = set()
    parts: list[str] = []
    bad = article = 0
    links = linked = 0
    place = 0
    heading = False

    def close() -> None:
        nonlocal linked, heading
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            out.append(Block(text, linked, bad > 0, article > 0, heading))
        parts.clear()
        linked = 0
        heading = False

    for m in _TAG.finditer(page):
        if m.start() < place:
            continue
        piece = page[place:m.start()]
        place = m.end()
        if piece:
            parts.append(piece)
            if links:
                linked += len(html.unescape(piece).strip())
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if tag in RAW_TAGS and not m[1]:
            # All up to the end tag belongs to the element; without one, a head ends at the body.
            stop = None if tag in endless else _end_of_raw(page, tag, place)
            if stop is not None:
                close()
                place = stop
            elif tag in ("script", "style", "textarea"):
                close()
                place = len(page)
            else:
                endless.add(tag)
            continue
        if tag in BLOCK_TAGS:
            close()
            heading = not m[1] and tag in HEADINGS
        if tag in VOID_TAGS:
            continue
        if not m[1]:
            if (m[3] or "").rstrip().endswith("/") and tag in ("path", "g"):
                continue
            marked, good = _signs(m[3], article > 0) if m[3] and m[3].strip() else (False, False)
            marked |= tag in BOILERPLATE_TAGS and not (tag == "header" and article)
            good |= tag in ARTICLE_TAGS
            # An article's or a page's own wrapper is not boilerplate, whatever its class says.
            marked &= tag not in ("html", "body", "article", "main")
            if tag == "p" or tag == "li":
                # These end by themselves where the next one begins.
                while open_tags and open_tags[-1][0] == tag:
                    _, b, a = open_tags.pop()
                    opened[tag] -= 1
                    bad -= b
                    article -= a
            open_tags.append((tag, marked, good))
            opened[tag] += 1
            bad += marked
            article += good
            links += tag == "a"
        elif opened[tag]:
            while open_tags:
                t, b, a = open_tags.pop()
                opened[t] -= 1
                bad -= b
                article -= a
                links -= t == "a"
                if t == tag:
                    break
    if place < len(page):
        parts.append(page[place:])
    close()
    return out


TEXT, BOILERPLATE, UNDECIDED = 1, 0, -1


def classify(blocks: list[Block], short: int = 60, stop_density: float = 0.12, link_density: float = 0.4) -> list[bool]:
    """Whether each block is main text. The article mark halves the stop words asked for and allows half as many links again."""

    def linked(block: Block) -> bool:
        return block.linked > link_density * (1.5 if block.article else 1) * len(block.text)

    counts = []
    for block in blocks:
        words = [w.lower() for w in _WORD.findall(block.text)]
        counts.append((sum(w in STOP_WORDS for w in words), max(1, len(words))))
    # Where an article as a whole has few stop words, it is in a language whose words are not known.
    read = [c for b, c in zip(blocks, counts) if b.article and not b.bad and not linked(b) and len(b.text) >= short]
    foreign = sum(n for n, _ in read) < stop_density / 2 * sum(m for _, m in read)
    labels = []
    for block, (stops, words) in zip(blocks, counts):
        if block.bad:
            labels.append(BOILERPLATE)
        elif linked(block):
            labels.append(UNDECIDED if block.article and block.heading else BOILERPLATE)
        else:
            dense = stops >= stop_density * (0.5 if block.article else 1) * words
            labels.append(TEXT if len(block.text) >= short and (dense or block.article and foreign) else UNDECIDED)

    def nearest(order: list[tuple[Block, int]]) -> list[int]:
        # What stands on the other side of an article's edge says nothing.
        found, last, inside = [], UNDECIDED, False
        for block, label in order:
            if block.article != inside:
                last, inside = UNDECIDED, block.article
            last = label if label != UNDECIDED else last
            found.append(last)
        return found

    both = list(zip(blocks, labels))
    before, after = nearest(both), nearest(both[::-1])[::-1]
    kept = []
    for block, label, a, b in zip(blocks, labels, after, before):
        if label == UNDECIDED:
            near = {x for x in (a, b) if x != UNDECIDED}
            # Nothing but its neighbours speaks for a block outside the article.
            kept.append(near == {TEXT} or block.article and near != {BOILERPLATE} or block.heading and a == TEXT)
        else:
            kept.append(label == TEXT)
    return kept


def main_text(page: str | None) -> str:
    blocks = blocks_of(page or "")
    return " ".join(b.text for b, keep in zip(blocks, classify(blocks)) if keep)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(0, batch.num_rows, 64):
            part = batch.slice(row, 64)
            texts = [main_text(x) for x in part.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("url"), pa.array(texts, pa.string())], ["id", "url", "text"])


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row of ``pages``: its id, ``url`` and ``text``.

    The text of the main blocks in page order, joined by one space; white space within a block is one
    space. Null or empty html, and pages without main text, give empty text. Unclosed tags and cut-off
    pages are read as far as they go. Repeated rows are answered each. Other columns are ignored. An
    empty table gives an empty result.
    """
    id_type = pages.schema[id_col].dataType.simpleString()
    return (
        pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.col(f"`{html_col}`").alias("html"))
        .mapInArrow(_extract, f"id {id_type}, url string, text string")
        .withColumnsRenamed({"id": id_col, "url": url_col})
    )

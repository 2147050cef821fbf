"""Main text of web pages by two passes of block rules.

A page is cut into blocks at block-level tags. Pass one decides a block where its length, stop-word density and link
density are clear. Where a block stands is evidence beside these: an element or role that says what it is (menus,
footers, sidebars, forms) excludes it; words of a class or id only make it suspect, and suspects are kept out if any
other block is good by its densities, and judged like the rest if none is; containers that hold most of the dense text
raise the bar for what is outside. Pass two gives each undecided, mostly short, block the label of its nearest decided
neighbours in the same container: both sides good or both bad decide; where they differ the nearer one does, and inside
an article element the undecided stay.

Stop words are those of four languages. A page whose long blocks have hardly any of them is of another language: there
sentence marks take the place of stop words, and a character of a script without spaces counts as three.

Defined results: a null or empty page gives an empty text; pages without markup are one block; unclosed scripts,
styles and comments run to the end of the page; of other elements without an end only the tag is skipped, self-closed
ones are empty, and a head without an end tag ends at the body or the first content; character references are decoded
after the tags are taken out.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements whose content is no text of the page.
DROPPED = "script|style|noscript|template|svg|math|iframe|object|canvas|select|textarea|button|title|audio|video"
# Elements that run to the end of the page if they are not closed; elements that may stand in a head.
RAW = frozenset("script style".split())
HEAD_PARTS = frozenset("html head base basefont bgsound link meta title style script noscript template".split())
# Block-level elements.
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
# Elements, roles and words of class or id that mark what is not the article.
BAD_TAGS = frozenset("nav footer aside form menu dialog fieldset".split())
BAD_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
BAD_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice "
    "notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social sidebar side widget widgets related "
    "recommended recommendations trending menu submenu nav navbar navigation breadcrumb breadcrumbs masthead footer copyright legal disclaimer "
    "comment comments commentlist disqus reply replies respond discussion search form pagination pager tagcloud skip".split()
)
# Those of them that also name subjects of articles, and say nothing beside a word for the article.
DOUBTFUL_WORDS = frozenset("legal notice notices discussion search share sharing social side related form alert trending reply replies respond disclaimer copyright promo promotion".split())
HEADER_WORDS = frozenset("header topbar toolbar".split())
GOOD_WORDS = frozenset("article content post entry story main body text".split())
# Frequent function words of English, French, German and Spanish.
STOP_WORDS = {
    "en": frozenset("the of and to in a is that it for on was be with as by this from at are or an not have has but they you he she we which their his her had were all will would there been if can".split()),
    "fr": frozenset("le la les de des du un une et en est que qui dans pour sur par pas au aux avec ce cette il elle ils nous vous se ne plus ou mais sont son sa ses été être".split()),
    "de": frozenset("der die das und in den von zu mit ist nicht ein eine einer eines dem des sich auf für als auch es an im am bei nach aus wie sie er wir ich oder aber war sind wird".split()),
    "es": frozenset("el la los las de del que y en un una es se no por con para su sus al lo como más pero o este esta son fue ha le ya entre cuando muy sin sobre".split()),
}

_TAG = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<drop>{DROPPED})\b(?P<dattr>[^>]*+)>"
    r"|<(?P<close>/?)(?P<name>[a-z][a-z0-9:-]*+)(?P<attr>(?:[^>\"'<]++|\"[^\"<]*+\"|'[^'<]*+')*+|[^>]*+)>|<[!?][^>]*+>",
    re.S | re.I,
)
_END = {name: re.compile(rf"</{name}\s*+>", re.I) for name in [*DROPPED.split("|"), "head"]}
_ATTR = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_WORD = re.compile(r"[^\W\d_]+")
_SPACE = re.compile(r"\s+")

_SENTENCE = re.compile(r"[.!?…。！？।؟]")
_NO_SPACES = re.compile("[\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\u0e00-\u0eff]")

GOOD, BAD, OPEN = 1, -1, 0
#: Where a block stands: an element that excludes it, one whose class or id makes it suspect, neither, or an article.
EXCLUDED, SUSPECT, PLAIN, ARTICLE = -2, -1, 0, 1
LONG, MIDDLE, HIGH_STOPS, LOW_STOPS, MAX_LINKS = 140, 60, 0.25, 0.12, 0.4


@dataclass
class Block:
    text: str
    linked: int
    inside: int
    container: int
    label: int = OPEN


def _marks(name: str, attr: str, in_article: bool) -> tuple[int, bool]:
    """(EXCLUDED, SUSPECT or PLAIN; whether it is an article container) by an element's name and attributes."""
    excluded = name in BAD_TAGS or (name == "header" and not in_article)
    good, suspect = name in ("article", "main"), False
    if attr:
        for key, *values in _ATTR.findall(attr):
            key, value = key.lower(), "".join(values).lower()
            if key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and re.search(r"display\s*:\s*none", value)):
                excluded = True
            elif key == "role":
                excluded |= value in BAD_ROLES
                good |= value in ("main", "article")
            elif key in ("class", "id"):
                words = set(re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", "".join(values)).lower()))
                article = name in ("div", "section", "td", "article", "main") and bool(words & GOOD_WORDS or name in ("article", "main"))
                bad = words & BAD_WORDS
                suspect |= bool(bad - DOUBTFUL_WORDS if article else bad) or (not in_article and bool(words & HEADER_WORDS))
                good |= article
    return EXCLUDED if excluded else SUSPECT if suspect else PLAIN, good and not (excluded or suspect)


def blocks_of(page: str) -> list[Block]:
    out: list[Block] = []
    stack: list[tuple[str, int, bool, int]] = [("", PLAIN, False, 0)]  # element, its worst mark, in an article, container
    text: list[str] = []
    linked, in_link, own, at, containers = 0, False, PLAIN, 0, 0
    head = False
    unclosed: set[str] = set()  # elements that have no end tag from here on

    def end_block() -> None:
        nonlocal text, linked, own
        if text:
            whole = _SPACE.sub(" ", entities.unescape("".join(text))).strip()
            if whole:
                _, mark, article, container = stack[-1]
                out.append(Block(whole, linked, min(mark, own) or (ARTICLE if article else PLAIN), container))
        text, linked, own = [], 0, PLAIN

    def add(piece: str) -> None:
        nonlocal linked
        if piece:
            text.append(piece)
            if in_link:
                linked += len(piece.strip())

    def end_of(name: str, start: int) -> int:
        """Where the element's end tag ends, -1 without one."""
        found = None if name in unclosed else _END[name].search(page, start)
        if not found:
            unclosed.add(name)
        return found.end() if found else -1

    while tag := _TAG.search(page, at):
        piece = page[at : tag.start()]
        at = tag.end()
        name, drop = (tag["name"] or "").lower(), (tag["drop"] or "").lower()
        if head and (piece.strip() or (name or drop or "head") not in HEAD_PARTS):
            head = False
        add(piece)
        if not name:
            if drop:
                add(" ")
                if drop in RAW or not tag["dattr"].endswith("/"):
                    end = end_of(drop, at)
                    at = end if end >= 0 else len(page) if drop in RAW else at
            continue
        if name == "head" and not tag["close"]:
            end = end_of(name, at)
            head, at = end < 0, max(at, end)
        elif head:
            continue
        elif name == "a":
            in_link = not tag["close"]
        elif name == "br":
            add(" ")
        elif name in BLOCKS:
            end_block()
            in_link = in_link and name not in ("nav", "article", "footer", "body")
            if tag["close"]:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == name:
                        del stack[k:]
                        break
            elif name in ("p", "hr", "h1", "h2", "h3", "h4", "h5", "h6"):
                own = _marks(name, tag["attr"], stack[-1][2])[0]
            elif not tag["attr"].endswith("/"):
                if name in ("li", "dt", "dd", "tr", "td", "th") and stack[-1][0] == name:
                    stack.pop()
                _, mark, article, container = stack[-1]
                new, good = _marks(name, tag["attr"], article)
                if new or good:
                    containers += 1
                    container = containers
                stack.append((name, min(mark, new), article or good, container))
    add(page[at:])
    end_block()
    return out


def _stop_density(text: str) -> float:
    words = [w.lower() for w in _WORD.findall(text)]
    return max(sum(w in stops for w in words) for stops in STOP_WORDS.values()) / len(words) if words else 0.0


def _size(text: str) -> int:
    """Length, with characters of scripts without spaces as three."""
    return len(text) + (0 if text.isascii() else 2 * len(_NO_SPACES.findall(text)))


def _densities(blocks: list[Block]) -> tuple[list[int], list[float]]:
    """Each block's length and stop-word density; sentence marks instead on pages of other languages."""
    sizes = [_size(b.text) for b in blocks]
    stops = [_stop_density(b.text) if b.inside > EXCLUDED and n >= MIDDLE else 0.0 for b, n in zip(blocks, sizes, strict=True)]
    long = [(n, s) for b, n, s in zip(blocks, sizes, stops, strict=True) if b.inside > EXCLUDED and n >= LONG and b.linked <= MAX_LINKS * len(b.text)]
    if long and sum(n * s for n, s in long) < LOW_STOPS * sum(n for n, _ in long):
        stops = [HIGH_STOPS if n >= MIDDLE and _SENTENCE.search(b.text) else s for b, n, s in zip(blocks, sizes, stops, strict=True)]
    return sizes, stops


def classify(blocks: list[Block]) -> None:
    """Both passes, without suspects; if no block is good without them, with them."""
    sizes, stops = _densities(blocks)
    places = [b.inside for b in blocks]
    _decide(blocks, places, sizes, stops)
    if SUSPECT in places and not any(b.label == GOOD for b in blocks):
        for b in blocks:
            b.label = OPEN
        _decide(blocks, [PLAIN if p == SUSPECT else p for p in places], sizes, stops)


def _decide(blocks: list[Block], places: list[int], sizes: list[int], densities: list[float]) -> None:
    """Pass one by density, length and place; pass two by the nearest decided neighbours."""
    dense = [0, 0]
    for b, place, size, stops in zip(blocks, places, sizes, densities, strict=True):
        if place >= PLAIN and b.linked <= MAX_LINKS * len(b.text) and stops >= (LOW_STOPS if size >= LONG else HIGH_STOPS):
            dense[place] += len(b.text)
    # Containers that hold most of the dense text are evidence against what is outside: it must be clearly prose then.
    has_article = ARTICLE in places and dense[1] >= dense[0]
    for b, place, size, stops in zip(blocks, places, sizes, densities, strict=True):
        links = b.linked / len(b.text)
        if place < PLAIN:
            b.label = BAD
        elif has_article and place == PLAIN:
            b.label = GOOD if size >= LONG and stops >= HIGH_STOPS and links <= MAX_LINKS and "©" not in b.text else BAD
        elif links > MAX_LINKS and (place == PLAIN or links > 0.8):
            b.label = BAD if place == PLAIN or size < LONG else OPEN
        elif "©" in b.text and size < LONG and place == PLAIN:
            b.label = BAD
        elif size >= MIDDLE:
            if stops >= (LOW_STOPS if size >= LONG else HIGH_STOPS):
                b.label = GOOD
            elif place == PLAIN and stops < LOW_STOPS / 2:
                b.label = BAD
    decided = [b.label for b in blocks]
    before: list[tuple[int, int]] = []
    last = (OPEN, 0)
    for k, b in enumerate(blocks):
        if k and blocks[k - 1].container != b.container and places[k] == ARTICLE:
            last = (OPEN, 0)
        before.append(last)
        if decided[k]:
            last = (decided[k], k)
    last = (OPEN, 0)
    for k in range(len(blocks) - 1, -1, -1):
        b = blocks[k]
        if k + 1 < len(blocks) and blocks[k + 1].container != b.container and places[k] == ARTICLE:
            last = (OPEN, 0)
        if not decided[k]:
            (left, i), (right, j) = before[k], last
            if places[k] == ARTICLE:
                b.label = BAD if left == right == BAD else GOOD
            elif left and right and left != right:
                b.label = left if k - i < j - k else right
            else:
                b.label = left or right or (GOOD if len(blocks) == 1 else BAD)
        else:
            last = (decided[k], k)


def main_text(page: str | None) -> str:
    """The kept blocks of a page in its order, joined by blank lines."""
    blocks = blocks_of(page or "")
    classify(blocks)
    return "\n\n".join(b.text for b in blocks if b.label == GOOD)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) for each row of ``pages``."""
    rows = pages.select(F.col(id_col).alias(id_col), F.col(url_col).alias(url_col), F.col(html_col).cast("string").alias("_html"))
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in (id_col, url_col)) + ", text string, n_chars bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py()) for h in batch.column(2)]
            columns = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[id_col, url_col, "text", "n_chars"])

    return rows.mapInArrow(run, schema)

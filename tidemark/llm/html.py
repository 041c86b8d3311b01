"""Main text of web pages by block rules in two passes.

A page falls into blocks at its block-level tags. The first pass gives each block points: for its share of stop words
and its length, against its share of link text, and for or against what markup says of it (an article; navigation,
footers, forms, adverts, comments). Enough points either way decide it. The others, mostly short ones, are ambiguous; the
second pass gives each the label of its nearest decided neighbours. A marked article is a wall: what stands outside says
nothing of the blocks inside. All steps take time in proportion to the length of the page.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

from pyspark.sql import DataFrame

from tidemark.llm.common import frugal, pieces

#: Frequent function words of English, German, French and Spanish.
STOP = frozenset(
    """
    a about after all also an and are as at be been but by can could do for from had has have he her his how i if in
    into is it its more no not of on one or our out she so some than that the their them then there these they this to
    up was we were what when which who will with would you your
    aber als am an auch auf aus bei bis das dass dem den der des die durch ein eine einem einen einer er es für hat ich
    im in ist man mit nach nicht noch nur oder sein sich sie sind über um und uns vom von vor war was wie wir wird zu
    zum zur
    au aux avec ce ces cette dans de des du elle en est et il ils je la le les leur lui mais ne nous on ou où par pas
    plus pour qu que qui sa se ses si son sont sur un une vous
    al como con cuando de del el ella en era es esta este ha hay la las le lo los más me muy no nos o para pero por
    porque que se sin sobre su sus también un una y ya
    """.split()
)
#: Fixed values of HTML: elements that end a block, that have no end tag, and whose content is not markup.
BLOCK = frozenset(
    """address article aside blockquote body button caption center col colgroup dd details dialog dir div dl dt fieldset
    figcaption figure footer form frame frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li link main
    menu meta nav noframes noscript ol optgroup option p pre search section select summary table tbody td template tfoot
    th thead title tr ul""".split()
)
VOID = frozenset("area base br col embed frame hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: Elements that never hold the article's text; a header does only inside an article.
OUT = frozenset("nav footer aside form button select dialog menu noscript template svg math object canvas head search".split())
OUT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog menu menubar toolbar".split())
OUT_NAMES = frozenset(
    """ad ads adv advert advertisement advertising adsense banner breadcrumb breadcrumbs comment comments commentlist
    consent cookie cookies copyright disqus footer gdpr legal menu modal nav navbar navigation newsletter notice pager
    pagination popup promo promoted promotion related respond share sharing sidebar signup skip social sponsor sponsored
    subscribe tags toolbar widget widgets""".split()
)
#: Names that say something only outside an article.
PAGE_NAMES = frozenset("header masthead topbar site".split())

#: Parts of names that turn the next part into something else: no-sidebar, has-comments.
TURNED = frozenset("no not non has with without is hide hidden".split())

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z))?+)*+)(?:>|\Z)""", re.S)
ATTR = re.compile(r"""([a-zA-Z][\w:-]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?""")
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
WORD = re.compile(r"\w+")
#: Numbers that no character has, and that are too long to be read as numbers.
NO_CHAR = re.compile(r"&#(?:[0-9]{8,}|[xX][0-9a-fA-F]{8,});?")

SHORT, LONG = 70, 200
STOP_LOW, STOP_HIGH = 0.10, 0.30
LINKS = 0.5
GOOD, BAD, AMBIGUOUS = 1, -1, 0
#: Points that decide a block.
ENOUGH = 2


class Block:
    __slots__ = ("text", "links", "out", "home", "label", "turn")

    def __init__(self, text: str, links: int, out: bool, home: int):
        self.text, self.links, self.out, self.home, self.label, self.turn = text, links, out, home, AMBIGUOUS, 1


def _attributes(raw: str) -> dict[str, str]:
    return {k.lower(): a or b or c for k, a, b, c in ATTR.findall(raw)}


def _is_out(tag: str, raw: str, inside: bool) -> bool:
    """Whether markup says that an element isn't part of an article."""
    if tag in OUT or tag == "header" and not inside:
        return True
    if len(raw) < 6 or tag in ("html", "body", "main"):
        return False
    a = _attributes(raw)
    if "hidden" in a or a.get("aria-hidden", "").lower() == "true" or "display:none" in a.get("style", "").replace(" ", "").lower():
        return True
    if a.get("role", "").lower() in OUT_ROLES:
        return True
    parts = [x.lower() for x in NAME.findall(_plain(f"{a.get('class', '')} {a.get('id', '')} {a.get('itemprop', '')}"))]
    names = {x for x, before in zip(parts, ["", *parts], strict=False) if before not in TURNED}
    return not names.isdisjoint(OUT_NAMES) or not inside and not names.isdisjoint(PAGE_NAMES)


def _plain(text: str) -> str:
    """text with its character references decoded."""
    return unescape(NO_CHAR.sub("\ufffd", text)) if "&" in text else text


class Open:
    """The open elements, with the places of each tag and of the block-level ones, so that none is searched for."""

    def __init__(self):
        self.stack: list[tuple[str, bool, int, bool]] = []  # tag, out, home, link
        self.places: dict[str, list[int]] = {}
        self.levels: list[int] = []

    def state(self) -> tuple[bool, int, bool]:
        return self.stack[-1][1:] if self.stack else (False, 0, False)

    def push(self, tag: str, out: bool, home: int, link: bool) -> None:
        self.places.setdefault(tag, []).append(len(self.stack))
        if tag in BLOCK:
            self.levels.append(len(self.stack))
        self.stack.append((tag, out, home, link))

    def cut(self, place: int) -> None:
        while len(self.stack) > place:
            tag = self.stack.pop()[0]
            self.places[tag].pop()
            if tag in BLOCK:
                self.levels.pop()

    def ended(self, tag: str) -> int:
        """The place of the element that an end tag closes, -1 for none. An inline one doesn't close blocks around it."""
        known = self.places.get(tag)
        if not known or tag not in BLOCK and self.levels and self.levels[-1] > known[-1]:
            return -1
        return known[-1]


def blocks(html: str) -> tuple[list[Block], dict[int, str]]:
    """The blocks of a page in order, and the tag of each home: the innermost article or main element, 0 for none."""
    found: list[Block] = []
    homes: dict[int, str] = {}
    elements = Open()
    out, home, link = False, 0, False
    parts: list[str] = []
    linked = 0
    at = 0

    def text(piece: str) -> None:
        nonlocal linked
        piece = _plain(piece)
        parts.append(piece)
        if link:
            linked += len("".join(piece.split()))

    def close() -> None:
        nonlocal linked
        if parts:
            if joined := " ".join("".join(parts).split()):
                found.append(Block(joined, linked, out, home))
            parts.clear()
        linked = 0

    while True:
        m = TAG.search(html, at)
        stop = m.start() if m else len(html)
        if stop > at:
            text(html[at:stop])
        if not m:
            break
        at = m.end()
        end, tag, raw = m.groups()
        if tag is None:
            if html.startswith("<![CDATA[", stop):
                text(html[stop + 9 : at].removesuffix("]]>"))
            continue
        tag = tag.lower()
        if end:
            if tag == "br":
                parts.append(" ")
                continue
            if tag in BLOCK:
                close()
            place = elements.ended(tag)
            if place >= 0:
                if elements.levels and elements.levels[-1] >= place:
                    close()
                elements.cut(place)
                out, home, link = elements.state()
            continue
        if tag in RAW:
            if raw.endswith("/") and tag == "iframe":
                continue
            gone = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(html, at)
            at = gone.end() if gone else len(html)
            if tag in BLOCK:
                close()
            continue
        if tag in ("br", "wbr"):
            parts.append(" " if tag == "br" else "")
            continue
        if tag in BLOCK:
            close()
            if elements.levels:  # these end where the next one begins
                level = elements.levels[-1]
                inner = elements.stack[level][0]
                if inner == "p" or inner == tag and tag in ("li", "dt", "dd", "tr", "td", "th", "option"):
                    elements.cut(level)
                    out, home, link = elements.state()
        if tag in VOID:
            continue
        out = out or _is_out(tag, raw, home > 0)
        link = link or tag == "a"
        if tag in ("article", "main") or "articlebody" in raw.lower():
            home = len(homes) + 1
            homes[home] = "main" if tag == "main" else "article"
        elements.push(tag, out, home, link)
    close()
    return found, homes


def stop_share(text: str) -> float:
    words = WORD.findall(text.lower())
    return sum(w in STOP for w in words) / max(1, len(words))


def points(b: Block, inside: bool, marked: bool) -> int:
    """What speaks for a block (above zero) or against it. marked: whether the page marks an article, inside: whether
    the block is in it."""
    total = 0
    if b.links > LINKS * max(len(b.text) - b.text.count(" "), 1):
        total -= 2
    elif len(b.text) >= SHORT:
        share = stop_share(b.text)
        total += 2 if share >= STOP_HIGH else 1 if share >= STOP_LOW else 0
        total += 0 if len(b.text) < LONG else 1 if share >= STOP_LOW else -2
    if b.out or marked and not inside:
        return total - 8
    return total + (1 if inside else 0)


def judged(html: str | None) -> list[Block]:
    """The blocks of a page with their labels, and the pass (`turn`) that gave them."""
    found, homes = blocks(html or "")
    named = {h for h, t in homes.items() if t == "article"}
    if not any(b.home in named and not b.out for b in found):
        named = set(homes)
    marked = any(b.home in named and not b.out for b in found)
    for b in found:
        p = points(b, b.home in named, marked)
        b.label = GOOD if p >= ENOUGH else BAD if p <= -ENOUGH else AMBIGUOUS
    # In a marked article what markup has ruled out is no neighbour: the text goes on behind an advert.
    near = [b for b in found if b.home in named and not b.out] if marked else found
    decided = [i for i, b in enumerate(near) if b.label]
    k = 0
    for i, b in enumerate(near):
        if b.label:
            continue
        while k < len(decided) and decided[k] < i:
            k += 1
        before = decided[k - 1] if k else None
        after = decided[k] if k < len(decided) else None
        b.turn = 2
        if before is None and after is None:
            b.label = GOOD if marked or len(b.text) >= SHORT else BAD
        elif before is None or after is not None and after - i < i - before:
            b.label = near[after].label
        elif after is None or i - before < after - i:
            b.label = near[before].label
        else:  # good wins a tie
            b.label = max(near[before].label, near[after].label)
    return found


def extract(html: str | None) -> str:
    """The main text: its blocks joined by newlines."""
    return "\n".join(b.text for b in judged(html) if b.label > 0)


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages (page_id, url, html).

    Defined cases: a null or empty html gives an empty text; null ids and addresses stay null; repeated rows give
    repeated results; other columns are ignored; an empty table gives no rows. Pages may have any length; unclosed tags,
    comments and quotes run as far as browsers let them, at most to the end of the page.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in pieces(batches, "html", 4_000_000):
            texts = [extract(h) for h in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(frugal(run), f"page_id {kind}, url string, text string, n_chars long")

"""Main text of web pages by two-pass block rules.

A page is cut into blocks at its block-level tags. The first pass decides what can be decided
from a block alone: its place (menus, headers, footers, sidebars, forms, notices, adverts and
reader comments, by element or by the words of class and id), the share of its characters that
are links, the share of its words that are stop words, and its length. Short or middling blocks
stay open. The second pass gives an open block the label of the nearest decided block.

Pages are independent of each other: one Arrow pass, no shuffle.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stagewise.llm.common import map_arrow

# The commonest function words of some languages, element names of HTML, and the
# words that page authors use in class and id.
STOP_WORDS = frozenset("""
a about all also an and are as at be been but by can for from had has have he her his i in into
is it its more not of on one or our she so that the their there they this to was we were which
who will with you
aber als am auch auf aus bei das dass dem den der des die durch ein eine einen er es für hat ich
im ist mit nach nicht noch nur oder sich sie sind über um und von vor war wie wird zu zum zur
au aux avec ce cette comme dans de du elle en est et il ils la le les leur mais ne nous ont ou
par pas plus pour qu que qui sa se ses son sont sur un une vous à été
al como con cuando del ella entre era esta este ha hay lo los las más muy no nos o para pero por
sin sobre son su sus también todo y ya
che di e gli non per sono
da dos em mas na não os uma
""".split())
BREAKS = frozenset("""
address article aside blockquote body caption center dd details dialog dir div dl dt fieldset
figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html legend li main menu
nav ol p pre section summary table tbody tfoot thead tr ul
""".split())
SPACES = frozenset("br td th option".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements whose content is no text of the page, skipped up to their end tag.
SKIPPED = frozenset("""
script style noscript template title textarea select iframe object svg math audio video canvas
""".split())
#: Elements without content.
EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that end where one of the given opens (p: any block).
ENDS_AT = {"li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"])}
#: A link ends with these at the latest, also an unclosed one.
LINK_ENDS = frozenset("p li tr ul ol nav article section table header footer".split())
ASIDE_ELEMENTS = frozenset("nav footer aside form menu dialog button fieldset".split())
ARTICLE_ELEMENTS = frozenset("article main".split())
ASIDE_WORDS = frozenset("""
ad ads advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs byline
consent cookie cookies copyright disclaimer foot footer gdpr header legal login masthead menu
menubar modal nav navbar navigation newsletter notice notices notification outbrain overlay pager
paginate pagination popup promo promoted promotion recommended related share sharing sidebar
sidenav signup skip social sponsor sponsored subscribe subscription taboola tags teaser toolbar
widget
""".split())
COMMENT_WORDS = frozenset("""
comment comments commentlist disqus discussion replies reply respond responses
""".split())
ARTICLE_WORDS = frozenset("article articlebody content entry main post story".split())
COMMENT_HEADING = re.compile(
    r"\W*(\d+\s+|leave a |post a |add a |reader |user |write a |all )?"
    r"(comments?|kommentare?|commentaires?|comentarios?|reply)\W*(\d+)?\W*", re.I)
ADVERT = re.compile(r"\W*(advertisement|advertisements|sponsored|anzeige|werbung|publicité|"
                    r"publicidad|patrocinado)\W*", re.I)

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^">]*"|'[^'>]*')*+)>""")
_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_ATTRIBUTE = re.compile(r"""(?:^|[\s"'/])(class|id|role|itemprop)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_WORD = re.compile(r"[^\W\d_]+")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_BLOCKS = BREAKS | ARTICLE_ELEMENTS | ASIDE_ELEMENTS
_INNER = HEADINGS | {"p", "span"}

#: Rules of the first pass. Lengths are in characters.
LINKS_BAD, LINKS_GOOD = 0.5, 0.3
SHORT, LONG = 60, 200
STOPS = 0.1
HEADING_CHARS = 60
GOOD, BAD, OPEN = 1, 0, -1


class _Place:
    """What the open elements say about the text inside them."""

    __slots__ = ("name", "aside", "firm", "inside")

    def __init__(self, name: str, aside: bool, firm: bool, inside: bool):
        self.name, self.aside, self.firm, self.inside = name, aside, firm, inside


class _Block:
    __slots__ = ("text", "links", "anchors", "aside", "inside", "heading", "item", "label")

    def __init__(self, text, links, anchors, place, heading, item):
        self.text, self.links, self.anchors = text, links, anchors
        self.aside, self.inside = place.aside, place.inside
        self.heading, self.item, self.label = heading, item, OPEN


def _hints(attributes: str) -> set[str]:
    found = set()
    for name, value in _ATTRIBUTE.findall(attributes):
        for word in value.strip("\"'").split():
            parts = [p.lower() for p in _PART.findall(word)]
            # "has-sidebar", "no-ads" speak of something else than this element.
            if parts and parts[0] not in ("has", "no", "with", "without"):
                found.update(parts)
    return found


def _opened(name: str, attributes: str, outer: _Place) -> _Place:
    """The place inside a new element."""
    if name in ("html", "body"):
        return _Place(name, False, False, False)
    words = _hints(attributes) if "=" in attributes else ()
    comments = bool(words) and not COMMENT_WORDS.isdisjoint(words)
    if outer.aside and outer.firm:
        return _Place(name, True, True, outer.inside)
    if name in ASIDE_ELEMENTS or comments and name != "main":
        return _Place(name, True, True, outer.inside)
    if name in ARTICLE_ELEMENTS:
        return _Place(name, False, False, True)
    if name == "header":
        return _Place(name, True, not outer.inside, outer.inside)
    if outer.aside:
        return _Place(name, True, False, outer.inside)
    if words and not ASIDE_WORDS.isdisjoint(words):
        return _Place(name, True, False, outer.inside)
    if words and not ARTICLE_WORDS.isdisjoint(words) and name in ("div", "section", "td"):
        return _Place(name, False, False, True)
    return _Place(name, False, False, outer.inside)


def blocks(page: str) -> list[_Block]:
    """The page's blocks with text, in order. Time and memory grow with its length only."""
    found: list[_Block] = []
    base = _Place("", False, False, False)
    stack, counts = [base], {}
    pieces, links, anchors, in_link = [], 0, 0, 0
    heading = item = False
    breaks = 0

    def flush():
        nonlocal pieces, links, anchors, heading, item, breaks
        text = " ".join(unescape("".join(pieces)).split()) if pieces else ""
        if text:
            place = stack[-1]
            block = _Block(text, min(links, len(text)), anchors, place, heading, item)
            found.append(block)
            if heading and not links and len(text) <= HEADING_CHARS \
                    and COMMENT_HEADING.fullmatch(text):
                # Comments are what follows up to the end of the heading's container.
                around = next(p for p in reversed(stack) if p.name not in _INNER)
                block.label, around.aside, around.firm = BAD, True, True
        pieces, links, anchors, heading, item, breaks = [], 0, 0, False, False, 0

    def add(piece):
        nonlocal links, breaks
        if piece:
            pieces.append(piece)
            if in_link:
                links += len(unescape(piece).strip())
            if breaks and not piece.isspace():
                breaks = 0

    at, last = 0, page.rfind(">") + 1
    lower = None
    while True:
        open_at = page.find("<", at)
        if open_at < 0 or open_at >= last:
            rest = page[at:]
            add(rest[:rest.find("<!--")] if "<!--" in rest else rest)
            break
        tag = _TAG.match(page, open_at)
        if tag:
            closing, name, attributes = tag.groups()
            end = tag.end()
        elif page.startswith("<!--", open_at):
            add(page[at:open_at])
            close = page.find("-->", open_at + 4)
            at = len(page) if close < 0 else close + 3
            continue
        elif page.startswith(("<!", "<?", "</"), open_at) and not _NAME.match(page, open_at):
            add(page[at:open_at])
            close = page.find(">", open_at)
            at = len(page) if close < 0 else close + 1
            continue
        else:
            named = _NAME.match(page, open_at)
            if not named:
                add(page[at:open_at + 1])
                at = open_at + 1
                continue
            closing, name = named.groups()
            end = _end_of_tag(page, named.end())
            attributes = page[named.end():end - 1]
        add(page[at:open_at])
        at, name = end, name.lower()
        if name == "a":
            anchors += not closing
            in_link = 0 if closing else 1
            continue
        if name in SKIPPED and not closing:
            if attributes.endswith("/") and name in ("svg", "math"):
                continue
            if lower is None:
                lower = page.lower() if len(page.lower()) == len(page) else _ascii_lower(page)
            close = lower.find("</" + name, at)
            # Without an end tag, scripts and the like run to the end of the page.
            at = len(page) if close < 0 else close
            continue
        if name in SPACES:
            pieces.append(" ")
            if name == "br":
                breaks += 1
                if breaks > 1:
                    flush()
            continue
        if name == "span":
            # Inline, but for a span that is a place of its own.
            if closing and stack[-1].name == name:
                if stack[-1].aside != stack[-2].aside:
                    flush()
                counts[stack.pop().name] -= 1
            elif not closing and attributes:
                place = _opened(name, attributes, stack[-1])
                if place.aside != stack[-1].aside:
                    flush()
                stack.append(place)
                counts[name] = counts.get(name, 0) + 1
            elif not closing:
                stack.append(_Place(name, stack[-1].aside, stack[-1].firm, stack[-1].inside))
                counts[name] = counts.get(name, 0) + 1
            continue
        if name not in _BLOCKS:
            continue
        flush()
        if name in LINK_ENDS:
            in_link = 0
        if closing:
            if counts.get(name):
                while stack[-1].name != name:
                    counts[stack.pop().name] -= 1
                counts[stack.pop().name] -= 1
            continue
        while stack[-1].name in ("p", "span") or name in ENDS_AT.get(stack[-1].name, ()):
            counts[stack.pop().name] -= 1
        heading, item = name in HEADINGS, name == "li"
        if name not in EMPTY and not attributes.endswith("/"):
            stack.append(_opened(name, attributes, stack[-1]))
            counts[name] = counts.get(name, 0) + 1
    flush()
    return found


def _ascii_lower(page: str) -> str:
    return page.translate({c: c + 32 for c in range(65, 91)})


def _end_of_tag(page: str, at: int) -> int:
    """Behind the ">" of a tag whose quoted values hold such characters; a quote that is never
    closed is none."""
    first = page.find(">", at)
    while True:
        close = page.find(">", at)
        if close < 0:
            return first + 1
        quote = min((q for q in (page.find('"', at, close), page.find("'", at, close)) if q >= 0),
                    default=-1)
        if quote < 0:
            return close + 1
        ended = page.find(page[quote], quote + 1, quote + 100_000)
        if ended < 0:
            return first + 1
        at = ended + 1


def _first_pass(found: list[_Block]) -> None:
    inside = any(b.inside and not b.aside for b in found)
    for b in found:
        if b.label != OPEN:
            continue
        size = len(b.text)
        share = b.links / size
        if b.aside and not (b.heading and b.inside):
            b.label = BAD
        elif inside and not b.inside:
            b.label = BAD
        elif ADVERT.fullmatch(b.text):
            b.label = BAD
        elif share > LINKS_BAD and (not b.inside or b.item or b.anchors > 1):
            b.label = BAD
        elif b.heading:
            continue
        elif share <= LINKS_GOOD and size >= SHORT:
            words = _WORD.findall(b.text.lower())
            stops = sum(w in STOP_WORDS for w in words)
            if stops >= STOPS * max(1, len(words)) or b.inside and size >= LONG:
                b.label = GOOD


def _second_pass(found: list[_Block]) -> None:
    """Open blocks take the label of the nearest decided block; of two as near, a heading goes
    with what follows, other blocks stay if either is good. With none decided, they stay."""
    before: list[tuple[int, int] | None] = []
    latest = None
    for i, b in enumerate(found):
        before.append(latest)
        if b.label != OPEN:
            latest = (i, b.label)
    latest = None
    chosen = {}
    for i in range(len(found) - 1, -1, -1):
        b = found[i]
        if b.label != OPEN:
            latest = (i, b.label)
            continue
        # Inside an article only what is around it in the article counts.
        near = [d for d in (before[i], latest)
                if d and (not b.inside or found[d[0]].inside and not found[d[0]].aside)]
        if not near:
            chosen[i] = GOOD
        elif b.heading and latest in near:
            chosen[i] = latest[1]
        else:
            least = min(abs(i - at) for at, _ in near)
            chosen[i] = max(label for at, label in near if abs(i - at) == least)
    for i, label in chosen.items():
        found[i].label = label


def main_text(page: str) -> str:
    found = blocks(page)
    _first_pass(found)
    _second_pass(found)
    return "\n\n".join(b.text for b in found if b.label == GOOD)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars: the main text of every page's html, "" if it has none.

    A null html is an empty page; null ids and urls are kept. Repeated rows each get their row,
    an empty table an empty result. Markup need not be well formed: unclosed elements end with
    their container, unclosed comments and scripts with the page. Pages are taken whole, one at
    a time, with some hundred bytes per tag of the longest. Other columns are ignored, whatever
    their names.
    """
    def read(batches):
        for batch in batches:
            texts = [main_text(h) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"])

    own = pages.select(
        pages["page_id"].cast("bigint").alias("page_id"), pages["url"].cast("string").alias("url"),
        F.coalesce(pages["html"].cast("string"), F.lit("")).alias("html"))
    return map_arrow(own, read, "page_id bigint, url string, text string, n_chars bigint")

"""Main-text extraction by two passes of block rules.

A page is cut into blocks at block-level tags. The first pass decides blocks by where they stand (menus,
footers, forms, comments and the like are boilerplate), by link density, and by length and stop-word
density; a block twice as long needs no stop words if it has few links, so other languages are text, too. A class or id that only ends in a hint ("entry-footer") is a lean: dense blocks in it are main text,
its ambiguous blocks look for decided ones in it alone, and without such they are boilerplate. Blocks that this leaves ambiguous, being short or without stop words, then inherit the label of
the nearest decided blocks of their region: the nearer of the two sides, main text on a tie. A region is
an article or main element, or all that is outside such; without a decided block in it, its ambiguous
blocks are main text.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import free_name, text_batches

# Fixed values of this module: element names and hints of boilerplate, and stop words of four languages.
RAW = {"script", "style", "noscript", "template", "textarea", "iframe", "canvas", "select", "head", "title", "audio", "video", "annotation", "annotation-xml"}
#: Elements whose inside is no markup: without an end tag they reach to the end of the page.
TEXT_ONLY = {"script", "style", "textarea", "title", "iframe"}
#: Elements whose inside is no article text either: without an end tag they reach to the next block-level tag.
NOT_TEXT = {"select", "template"}
BOILERPLATE = {"nav", "footer", "aside", "form", "menu", "button", "dialog"}
#: Boilerplate outside article and main elements, text in them.
LOOSE = {"fieldset", "label", "address", "header"}
REGIONS = {"article", "main"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = BOILERPLATE | LOOSE | REGIONS | set(
    "address blockquote body caption center dd details div dl dt figcaption figure frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSED_BY_BLOCK = {"p"}
HINTS = set(
    "nav navbar navigation menu menubar header masthead footer sidebar aside ad ads advert adverts advertisement advertising banner promo promotion sponsor sponsored sponsors cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social comment comments commentlist disqus reply replies respond related recommended recommendations breadcrumb breadcrumbs pagination pager widget toolbar copyright skip outbrain taboola".split()
)
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "menu", "menubar", "form"}
STOP_WORDS = set(
    """the of and to in is that for it as was with be by on not he his but at are this have from or had an they which one you were all her she there would their we him been has when who will no more if out so a
    le la les de des du un une et est que qui dans pour sur pas au aux par avec plus ce cette ne se son sa ses il elle nous vous mais ou comme sont en
    der die das den dem des und ist nicht ein eine einer von zu mit sich auf für als auch es im an so dass wird aus bei nach wie er sie wir
    el los las y en del al lo con por para su sus no más como pero una o este esta se ha son""".split()
)

SHORT, LONG, LINKED, FEW_LINKS, DENSE = 70, 140, 0.5, 0.1, 0.15
NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
SPECIAL = re.compile("[>\"']")
ATTRIBUTE = re.compile(r"""(?:^|[\s"'/])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
#: Last parts of a class or id that say only that it is a box; first parts that say what an element has or lacks.
BOXES = set("area bar block body box buttons container content group inner item items links list posts section slot text unit wrap wrapper".split())
ABOUT = set("has have no not with without is".split())
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
EDGE = ".,;:!?\"'()[]«»…*&%$#|-"


class Block(NamedTuple):
    text: str
    label: str  # "main" or "boilerplate"
    reason: str
    region: int


BLOCK_TAG = re.compile(rf"</?(?:{'|'.join(sorted(BLOCK))})(?=[\s/>])", re.I)
FIRM, LEAN = 2, 1


def hint_of(token: str, name: str, region: int) -> int:
    """FIRM if a class or id is a hint of boilerplate, but for words for a box; LEAN if it ends in one; else 0."""
    parts = [p.lower() for p in PARTS.findall(token)]
    if not parts or parts[0] in ABOUT:
        return 0
    bare = list(parts)
    while len(bare) > 1 and bare[-1] in BOXES:
        bare.pop()
    if "header" in (bare[-1], parts[-1]) and (region or name in HEADINGS):  # as the element: an article's own header is text
        return 0
    if token.lower() in HINTS or (len(bare) == 1 and bare[0] in HINTS):
        return FIRM
    return LEAN if parts[-1] in HINTS and name not in HEADINGS else 0


def hinted(name: str, attributes: str, region: int = 0) -> tuple[int, int]:
    """Whether an element is boilerplate by its class or id (0, LEAN or FIRM), and by its role or for being hidden (0 or FIRM)."""
    by_class, other = 0, 0
    for key, value in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'")
        if key in ("class", "id"):
            # body and article elements carry page-wide classes
            if name not in REGIONS and name not in ("body", "html"):
                by_class = max([by_class, *(hint_of(t, name, region) for t in value.split())])
        elif key == "role":
            if value.lower() in ROLES:
                other = FIRM
        elif key == "style":
            if re.search(r"display\s*:\s*none", value, re.I):
                other = FIRM
        elif key == "hidden" or value.lower() == "true":
            other = FIRM
    return by_class, other


class _Tokens:
    """Comments, declarations and tags of a page, in order, in time that grows in proportion to it.

    A tag ends at the first ``>`` outside quotes; an opening without one is text. Where such a search has failed
    no later one goes again: it would fail too.
    """

    def __init__(self, html: str):
        self.html, self.bare, self.failed = html, len(html) + 1, set()
        self.last = {q: html.rfind(q) for q in "\"'"}

    def _end(self, at: int) -> int:
        """The place after the tag whose attributes begin at ``at``; -1 if it has no end."""
        seen = []
        while at < self.bare:
            found = SPECIAL.search(self.html, at)
            if found is None:
                self.bare = at
                break
            q = found.start()
            if found[0] == ">":
                return q + 1
            seen.append(q)
            if q in self.failed or self.last[found[0]] <= q:
                break
            at = self.html.index(found[0], q + 1) + 1
        self.failed.update(seen)
        return -1

    def after(self, at: int) -> tuple[int, int, bool, str, str] | None:
        """(start, end, closing, name, attributes) of the next token from ``at``; name is empty for what is no tag."""
        html = self.html
        while (i := html.find("<", at)) >= 0:
            if html.startswith("<!--", i):
                close = html.find("-->", i + 4)
                return i, close + 3 if close >= 0 else len(html), False, "", ""
            if html.startswith(("<!", "<?"), i):
                close = html.find(">", i + 2)
                return i, close + 1 if close >= 0 else len(html), False, "", ""
            if (tag := NAME.match(html, i)) and (end := self._end(tag.end())) >= 0:
                return i, end, bool(tag[1]), tag[2].lower(), html[tag.end() : end - 1]
            at = i + 1
        return None


def cut_blocks(html: str) -> list[tuple[str, int, bool, int, int, bool]]:
    """(text, characters in links, in boilerplate, region, lean, in a list) of the page's blocks, in order; region and lean 0 are outside all.

    An article ends an inherited lean, a main element any inherited class or id.
    """
    out: list[tuple[str, int, bool, int, int, bool]] = []
    stack: list[tuple[str, bool, bool, int, int]] = [("", False, False, 0, 0)]  # element, in boilerplate by place, by class, region, lean
    parts: list[str] = []
    links: list[str] = []  # those of them in links
    link, regions, leans, breaks, at = False, 0, 0, 0, 0
    unclosed: set[str] = set()  # elements with no end tag further on

    opened: Counter = Counter()  # elements on the stack, by name

    def drop() -> str:
        name = stack.pop()[0]
        opened[name] -= 1
        return name

    def tidy(pieces: list[str]) -> str:
        text = "".join(pieces)
        return " ".join((unescape(text) if "&" in text else text).split())

    def end() -> None:
        if parts:
            if text := tidy(parts):
                out.append((text, len(tidy(links)) if links else 0, stack[-1][1] or stack[-1][2], *stack[-1][3:], any(opened[e] for e in ("li", "dd", "dt"))))
            parts.clear()
        links.clear()

    def say(text: str) -> None:
        nonlocal breaks
        if text:
            parts.append(text)
            if link:
                links.append(text)
            if not text.isspace():
                breaks = 0

    tokens, blocks_end = _Tokens(html), False
    while True:
        found = tokens.after(at)
        if found is None:
            say(html[at:])
            break
        start, stop, closing, name, attributes = found
        say(html[at:start])
        at = stop
        if not name:
            continue
        if name in RAW and not closing:
            if not attributes.endswith("/"):
                close = None if name in unclosed else re.compile(rf"</{re.escape(name)}(?=[\s/>]|$)[^>]*>?", re.I).search(html, at)
                if close:
                    at = close.end()
                elif name in TEXT_ONLY:
                    at = len(html)
                else:  # of others only the tag is skipped; what else a head may hold has no text
                    unclosed.add(name)
                    if name in NOT_TEXT:
                        block = None if blocks_end else BLOCK_TAG.search(html, at)
                        blocks_end = block is None
                        at = block.start() if block else at
            continue
        if name == "a":
            link = not closing
        elif name == "br":
            breaks += 1
            if breaks > 1:
                end()
            else:
                parts.append(" ")
        elif name in BLOCK or (not closing and name not in VOID and attributes and any(hinted(name, attributes, stack[-1][3]))) or (closing and opened[name]):
            end()
            breaks = 0
            if closing:
                if opened[name]:
                    while drop() != name:
                        pass
                    link = link and name not in ("p", "li", "td", "nav", "ul", "article")
            elif name not in VOID:
                if stack[-1][0] in CLOSED_BY_BLOCK and name in BLOCK:
                    drop()
                if name == "li" and stack[-1][0] == "li":
                    drop()
                _, bad, by_class, region, lean = stack[-1]
                if name in REGIONS and not region:
                    regions += 1
                    region = regions
                own, other = hinted(name, attributes, region) if attributes else (0, 0)
                if name in REGIONS:
                    lean = 0
                    by_class = by_class and name != "main"
                if own == LEAN:
                    leans += 1
                    lean = leans
                bad = bad or name in BOILERPLATE or (name in LOOSE and not region) or other == FIRM
                opened[name] += 1
                stack.append((name, bad, by_class or own == FIRM, region, lean))
    end()
    return out


def stop_density(text: str) -> float:
    words = text.lower().split()
    return sum(w in STOP_WORDS or w.strip(EDGE) in STOP_WORDS for w in words) / max(1, len(words))


def classify(html: str | None) -> list[Block]:
    """The blocks of a page with their labels. A null or empty page has none."""
    blocks = cut_blocks(html or "")
    labels: list[tuple[str | None, str]] = []
    for text, linked, bad, region, _, listed in blocks:
        if bad:
            labels.append(("boilerplate", "place"))
        elif linked > LINKED * len(text):
            # in an article only lists of links are menus; a paragraph that is a link is as good as its neighbours
            labels.append((None, "a link") if region and not listed else ("boilerplate", "links"))
        elif len(text) >= SHORT and stop_density(text) >= DENSE:
            labels.append(("main", "stop words"))
        elif len(text) >= LONG and linked <= FEW_LINKS * len(text):  # of whatever language
            labels.append(("main", "long"))
        else:
            labels.append((None, "short" if len(text) < SHORT else "no stop words"))
    # distance to the nearest decided block of the region on either side; what is out of place decides nothing
    sides = []
    for order in (range(len(blocks)), range(len(blocks) - 1, -1, -1)):
        last: dict[tuple[int, int], tuple[int, str]] = {}
        near: dict[int, tuple[int, str] | None] = {}
        for i in order:
            region = blocks[i][3:5]
            if labels[i][0] is None:
                near[i] = last.get(region)
            elif labels[i][1] != "place" and not (labels[i][1] == "links" and region[0]):  # a list of links in an article says nothing of what is beside it
                last[region] = (i, labels[i][0])
        sides.append(near)
    out = []
    for i, ((text, _, _, region, lean, _), (label, reason)) in enumerate(zip(blocks, labels, strict=True)):
        if label is None:
            near = [(abs(i - s[i][0]), s[i][1] != "main", s[i][1]) for s in sides if s[i]]
            label, reason = (min(near)[2], f"{reason}, near {min(near)[2]}") if near else ("boilerplate" if lean else "main", f"{reason}, alone")
        out.append(Block(text, label, reason, region))
    return out


def main_text(html: str | None) -> tuple[str, int]:
    """The main text, blocks joined by a line feed, and the number of its blocks."""
    kept = [b.text for b in classify(html) if b.label == "main"]
    return "\n".join(kept), len(kept)


def extract(pages: DataFrame, html: str = "html", text: str = "text") -> DataFrame:
    """``pages`` with ``text`` (empty if there is no main text), n_chars (code points) and n_blocks instead of ``html``.

    Work is per row: nothing is shuffled; a null page is an empty one; repeated rows stay; a page is held
    in memory whole, however long, in time that grows in proportion; an empty table gives an empty result.
    Columns of ``pages`` with a new one's name, in any case of letters, are replaced.
    """

    @F.pandas_udf("text string, n_blocks int")
    def of(pages: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([main_text(x) for x in pages], columns=["text", "n_blocks"]).astype({"n_blocks": "int32"})

    text_batches(pages.sparkSession)
    new = {html.lower(), text.lower(), "n_chars", "n_blocks"}
    kept, own = [F.col(f"`{c}`") for c in pages.columns if c.lower() not in new], free_name("found", pages)
    found = pages.select(*kept, of(F.col(f"`{html}`")).alias(own))
    return found.select(*kept, F.col(f"{own}.text").alias(text), F.char_length(f"{own}.text").cast("long").alias("n_chars"), F.col(f"{own}.n_blocks").alias("n_blocks"))


def blocks(pages: DataFrame, page_id: str = "page_id", html: str = "html") -> DataFrame:
    """One row for each block: page_id, place from 0, text, label, reason, region."""

    @F.pandas_udf("array<struct<text:string,label:string,reason:string,region:int>>")
    def of(pages: pd.Series) -> pd.Series:
        return pages.map(lambda x: [b._asdict() for b in classify(x)])

    return pages.select(F.col(page_id).alias("page_id"), F.posexplode(of(F.col(html))).alias("place", "b")).select("page_id", "place", "b.*")

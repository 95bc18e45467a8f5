"""Main text of web pages by two passes of block rules.

A page is cut into blocks at block-level tags. The first pass looks at each block
alone: its link density, its length and its density of stop words make it good,
bad or undecided. In the second pass undecided blocks, the short ones above all,
inherit the label of their nearest decided neighbours.

Element names, classes and the like are evidence beside that. They never make a
block good. What lies in a menu, footer, form, advert or the comments of readers
is bad whatever its density; an article keeps undecided blocks to itself, so that
its short lines look for neighbours inside it, and wins where these are at odds.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import in_arrow

#: Frequent function words of the languages that are told from lists and menus.
STOP_WORDS = frozenset(
    "the of and to in is that it for on with as was be by at this from are or an not but have has had his her they you we which their will would"
    " der die das und ist von zu mit den im ein eine nicht auf für des dem sich auch es als an werden aus er hat dass sie nach bei um"
    " le la les de des du et est un une en que qui dans pour pas sur au avec ce il elle sont plus par ne se aux son"
    " el los las y es un una en que del por con no para se su al lo como más o pero sus ya si"
    " di il che e non per una sono con è della nel do da em os um uma não na de het een van dat op te"
    " i w z nie się na do jest to że och att det som en på är av för den til og ikke и в не на что с по как это из к у за от".split()
)
#: Frequent function characters of texts written without spaces.
STOP_CHARACTERS = frozenset("的是了在不有和人这中为以の はがをにでとも은는이가을를의에".replace(" ", ""))
#: Names of elements. Of RAW ones the content is no markup; what is in OUTSIDE ones is not the page's text, nor what is in ones NOT_SHOWN as text.
RAW = frozenset("script style textarea title iframe noembed noframes".split())
OUTSIDE = frozenset("nav footer aside form menu dialog".split())
NOT_SHOWN = frozenset("noscript template object svg math canvas select option button datalist audio video".split())
BLOCKS = frozenset(
    "html head body div section article main nav header footer aside form menu dialog ul ol dl table tr td figure blockquote details fieldset"
    " p li dt dd h1 h2 h3 h4 h5 h6 pre hr th tbody thead tfoot caption figcaption summary address center legend label".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An element of the key is ended by the start of one like it, up to the nearest of the values.
ENDED_BY_NEXT = {"li": "ul ol menu", "dt": "dl", "dd": "dl", "tr": "table", "td": "table", "th": "table", "option": "select datalist"}
#: Words in class, id and role attributes. STRONG ones rule an element out; WEAK ones do while the page has other text.
#: A stem counts at the start of a word too, as in "commentsection".
STRONG = frozenset("ad ads adv advertisement advertising nav menu footer cookies consent gdpr replies respond disclaimer contentinfo copyright sidebar complementary navigation".split())
STEMS = re.compile(r"(?:comment(?!ar|at)|advert|sponsor|cookie|newsletter|subscri|sidebar|breadcrumb|navbar|disqus|popup|footer)")
WEAK = frozenset(
    "promo promotion promoted banner notice notices alert modal overlay signup widget widgets related recommended share sharing social login search pagination pager toolbar".split()
)
OUTSIDE_HEADERS = frozenset("header masthead".split())
#: Clues after one of these words only say what is beside an element.
BESIDE = re.compile(r"\b(?:has|with|no|without|hide)[-_]\w+")

SHORT, LONG = 70, 200
LINKS, FEW_STOPS, MANY_STOPS = 0.5, 0.10, 0.25
GOOD, BAD, SHORT_BLOCK, NEAR, SPARSE = "good", "bad", "short", "near", "sparse"
DENSITY, EVIDENCE, NEIGHBOURS = "density", "evidence", "neighbours"

#: A tag whose quoted values may hold ">"; where a page's quotes don't pair up, its tags end at the first ">".
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+|[\"'])*+)>")
PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
ATTRIBUTE = re.compile(r"(?<![^\s\"'/])(class|id|role|hidden|aria-hidden|style)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>\"']++)))?(?![\w-])", re.I)
LINK = re.compile(r"<(/?)a(?=[\s/>])", re.I)
WORD = re.compile(r"[^\W\d_]+")
UNSPACED = re.compile("[\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af]")


@dataclass
class Block:
    """A block: its text, characters of it in links, and what speaks for or against it."""

    text: str
    linked: int = 0
    ruled_out: bool = False
    doubts: int = 0
    article: int = 0
    heading: bool = False
    label: str = ""
    by: str = ""


#: What speaks against an element: it is not shown, ruled out, or doubtful.
UNSEEN, RULED_OUT, DOUBTFUL, NOTHING = 3, 2, 1, 0


def _against(tag: str, rest: str, in_article: bool) -> int:
    """What speaks against an element by its name and attributes."""
    if tag in NOT_SHOWN:
        return UNSEEN
    worst = RULED_OUT if tag in OUTSIDE or (tag == "header" and not in_article) else NOTHING
    if not rest.strip(" /"):
        return worst
    for name, *values in ATTRIBUTE.findall(rest):
        name, value = name.lower(), "".join(values).lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none", value)):
            return UNSEEN
        if name in ("class", "id", "role") and tag not in ("html", "body", "main"):
            words = set(re.split(r"[^a-z0-9]+", BESIDE.sub(" ", value)))
            if words & STRONG or any(STEMS.match(w) for w in words) or (not in_article and words & OUTSIDE_HEADERS):
                worst = RULED_OUT
            elif words & WEAK:
                worst = max(worst, DOUBTFUL)
    return worst


class _Reader:
    """Reads one page into blocks, in one pass over it."""

    def __init__(self, html: str):
        self.html, self.out = html, []
        self.parts: list[str] = []
        self.linked = 0
        #: The start of an open link: how many elements were open, or None.
        self.link: int | None = None
        #: Open elements: name, the worst of what rules it out, doubts, article, innermost block, open inline elements by name in that block.
        self.stack: list[tuple[str, int, int, int, str, dict[str, int]]] = [("", NOTHING, 0, 0, "", {})]
        self.blocks_open: dict[str, int] = {}
        self.articles = 0
        self.link_tags: list[tuple[int, bool]] | None = None

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        _, out, doubts, article, block, _ = self.stack[-1]
        if text and out < UNSEEN:
            self.out.append(Block(text, self.linked, out == RULED_OUT, doubts, article, len(block) == 2 and block[0] == "h" and block[1].isdigit()))
        self.parts, self.linked = [], 0

    def add(self, raw: str) -> None:
        if raw:
            raw = unescape(raw)
            self.parts.append(raw)
            if self.link is not None:
                self.linked += len(" ".join(raw.split()))

    def pop(self) -> str:
        #: Text of an inline element on the stack, which something speaks against, is a block by itself.
        self.flush()
        tag, *_ = self.stack.pop()
        if tag in BLOCKS:
            self.blocks_open[tag] -= 1
        else:
            self.stack[-1][5][tag] -= 1
        if self.link is not None and len(self.stack) < self.link:
            self.link = None
        return tag

    def closed_next(self, at: int) -> bool:
        """Whether the next tag of a link from a place on is an end; a link that isn't closed before the next ends with its block."""
        if self.link_tags is None:
            self.link_tags = [(m.start(), bool(m[1])) for m in LINK.finditer(self.html)]
        k = bisect_left(self.link_tags, (at, False))
        return k < len(self.link_tags) and self.link_tags[k][1]

    def start(self, tag: str, rest: str, at: int) -> None:
        if tag == "br":
            self.parts.append(" ")
        elif tag == "a":
            self.link = len(self.stack)
        if tag in VOID:
            if tag == "hr":
                self.flush()
            return
        block = tag in BLOCKS
        if block:
            self.flush()
            if self.link is not None and not self.closed_next(at):
                self.link = None
            if self.stack[-1][4] == "p":
                while self.pop() != "p":
                    pass
        until = ENDED_BY_NEXT.get(tag)
        if until and self._open(tag, until.split()):
            while self.pop() != tag:
                pass
        _, out, doubts, article, inside, open_inline = self.stack[-1]
        against = _against(tag, rest, bool(article))
        if not block and against == NOTHING:
            return
        if tag in ("article", "main") and not article:
            self.articles += 1
            article = self.articles
        if block:
            inside, open_inline = tag, {}
            self.blocks_open[tag] = self.blocks_open.get(tag, 0) + 1
        else:
            self.flush()
            open_inline[tag] = open_inline.get(tag, 0) + 1
        self.stack.append((tag, max(out, against), doubts + (against == DOUBTFUL), article, inside, open_inline))

    def _open(self, tag: str, until: list[str]) -> bool:
        """Whether an element of this name is open inside the nearest of until, looking no further than a few elements up."""
        for name, *_ in reversed(self.stack[-8:]):
            if name == tag:
                return True
            if name in until:
                return False
        return False

    def end(self, tag: str) -> None:
        if tag == "a":
            self.link = None
        if tag in BLOCKS:
            self.flush()
            if self.blocks_open.get(tag, 0):
                while self.pop() != tag:
                    pass
        elif self.stack[-1][5].get(tag, 0):
            while self.pop() != tag:
                pass

    def read(self) -> list[Block]:
        html, at, tags = self.html, 0, TAG
        closeless: set[str] = set()
        while True:
            k = html.find("<", at)
            if k < 0:
                self.add(html[at:])
                break
            self.add(html[at:k])
            follows = html[k + 1 : k + 2]
            if follows in ("!", "?") or (follows == "/" and not html[k + 2 : k + 3].isalpha()):
                at = self._declaration(k, closeless)
                continue
            if not (follows == "/" or (follows.isascii() and follows.isalpha())):
                self.parts.append("<")
                at = k + 1
                continue
            m = tags.match(html, k)
            if not m and tags is TAG:
                tags = PLAIN_TAG
                m = tags.match(html, k)
            if not m:
                if html.find(">", k) < 0:
                    break
                self.parts.append("<")
                at = k + 1
                continue
            at = m.end()
            tag = m[2].lower()
            if m[1]:
                self.end(tag)
            elif tag in RAW:
                if not m[3].endswith("/") and tag not in closeless:
                    close = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(html, at)
                    if close:
                        at = close.end()
                    elif tag in ("script", "style"):
                        break
                    else:
                        closeless.add(tag)
            elif not (m[3].endswith("/") and tag in NOT_SHOWN):
                self.start(tag, m[3], at)
        self.flush()
        return self.out

    def _declaration(self, k: int, closeless: set[str]) -> int:
        """The end of a comment, declaration or the like at k; the text of marked sections is added."""
        html = self.html
        if html.startswith("<!--", k):
            if html.startswith((">", "->"), k + 4):
                return html.index(">", k) + 1
            end = html.find("-->", k + 4)
            return len(html) if end < 0 else end + 3
        if html.startswith("<![CDATA[", k) and "]]>" not in closeless:
            end = html.find("]]>", k)
            if end >= 0:
                self.parts.append(html[k + 9 : end])
                return end + 3
            closeless.add("]]>")
        end = html.find(">", k)
        return len(html) if end < 0 else end + 1


def blocks(html: str | None) -> list[Block]:
    """The blocks of a page with a text, in page order, without scripts, styles and the like; none for null and empty pages."""
    return _Reader(html or "").read()


def stop_density(text: str) -> float:
    """The share of stop words among the words of a text; two characters written without spaces count as a word. 0 without words."""
    words = WORD.findall(text.lower())
    if not text.isascii() and (unspaced := UNSPACED.findall(text)):
        #: These languages write function words as single characters, some of them inside other words, hence half the weight.
        n = len(unspaced) / 2 + sum(not UNSPACED.search(w) for w in words)
        return (sum(c in STOP_CHARACTERS for c in unspaced) + sum(w in STOP_WORDS for w in words)) / max(1.0, n)
    return sum(w in STOP_WORDS for w in words) / max(1, len(words))


def by_density(b: Block) -> str:
    """The first pass for one block: good, bad, or one of the undecided kinds short, near (to good) and sparse (in stop words)."""
    size = len(b.text)
    if b.linked > LINKS * size:
        return BAD
    if size < SHORT:
        return BAD if b.linked * 5 > size else SHORT_BLOCK
    stops = stop_density(b.text)
    if stops >= MANY_STOPS:
        return GOOD if size >= LONG else NEAR
    return NEAR if stops >= FEW_STOPS else SPARSE


def classify(found: list[Block]) -> list[Block]:
    """Labels each block of a page good or bad, and says by what; see the module."""
    for b in found:
        b.label, b.by = by_density(b), DENSITY
    # Neighbouring blocks near to good that are long together are good.
    k = 0
    while k < len(found):
        end, size = k, 0
        while end < len(found) and found[end].label == NEAR and found[end].article == found[k].article and found[end].ruled_out == found[k].ruled_out:
            size += len(found[end].text)
            end += 1
        for b in found[k:end] if size >= LONG and end - k > 1 else ():
            b.label = GOOD
        k = max(end, k + 1)
    # Evidence against blocks. The least doubted text of a page counts as its text.
    free = [b.doubts for b in found if b.label == GOOD and not b.ruled_out]
    doubts = min(free, default=min((b.doubts for b in found if not b.ruled_out), default=0))
    for b in found:
        if b.ruled_out or b.doubts > doubts or b.text[0] == "©":
            if b.label != BAD:
                b.label, b.by = BAD, EVIDENCE
        elif b.label == SPARSE and not b.article:
            b.label = BAD
    _by_neighbours(found)
    # Where most of the text is in articles, the page's text is theirs.
    sizes = [sum(len(b.text) for b in found if b.label == GOOD and bool(b.article) == side) for side in (False, True)]
    if sizes[1] >= sizes[0]:
        for b in found:
            if b.label == GOOD and not b.article and sizes[1]:
                b.label, b.by = BAD, EVIDENCE
    return found


def _by_neighbours(found: list[Block]) -> None:
    """The second pass: undecided blocks take the label of their nearest decided neighbour, within their article if they are in one."""
    n = len(found)
    decided = [b.label if b.label in (GOOD, BAD) else None for b in found]
    near: list[list[tuple[str | None, int]]] = []
    for order in (range(n), range(n - 1, -1, -1)):
        last: dict[int, tuple[str, int]] = {}
        seen = [(None, 0)] * n
        for i in order:
            b = found[i]
            label, at = last.get(b.article, (None, 0))
            seen[i] = (label, abs(i - at))
            # In an article, what is ruled out says nothing about the text around it.
            if decided[i] and not (b.article and decided[i] == BAD and b.by == EVIDENCE):
                last[b.article] = decided[i], i
        near.append(seen)
    for b, label, (before, far), (after, far_after) in zip(found, decided, *near):
        if label:
            continue
        own = GOOD if b.article else BAD
        before, after = before or after or own, after or before or own
        if before == after:
            chosen = before
        elif b.label == NEAR:
            chosen = GOOD
        elif b.heading:
            chosen = after
        else:
            chosen = before if far < far_after else after if far_after < far else own
        b.label, b.by = chosen, NEIGHBOURS


def main_text(html: str | None) -> str:
    """The main text of a page; empty for null, empty and text-free pages."""
    return " ".join(b.text for b in classify(blocks(html)) if b.label == GOOD)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars long, blocks array<struct<text, good, by>>) for every row of pages.

    by says what decided a block: density, evidence or neighbours. Null and empty
    html: an empty text and no blocks. Broken markup is read as far
    as it goes; nothing is cut. Repeated pages have equal rows. Other columns of
    pages are left out.
    """
    block = T.StructType([T.StructField("text", T.StringType()), T.StructField("good", T.BooleanType()), T.StructField("by", T.StringType())])
    schema = T.StructType(
        [pages.schema["page_id"], pages.schema["url"], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("blocks", T.ArrayType(block))]
    )
    kind = pa.list_(pa.struct([("text", pa.string()), ("good", pa.bool_()), ("by", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                found = [classify(blocks(x)) for x in part.column(2).to_pylist()]
                texts = [" ".join(b.text for b in page if b.label == GOOD) for page in found]
                own = pa.array([[{"text": b.text, "good": b.label == GOOD, "by": b.by} for b in page] for page in found], kind)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64()), own], schema.names)

    return in_arrow(pages.select("page_id", "url", "html"), run, schema)

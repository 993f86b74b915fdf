"""HTML extraction by two passes of block rules.

Markup cuts a page into blocks of text. The first pass sees each block alone: what stands in navigation, forms, adverts,
notices, side and comment sections, or consists of links, is bad; long blocks with enough stop words are good; the rest
is ambiguous (long ones "near", short ones "short"). The second pass gives ambiguous blocks the label of their nearest
decided neighbours. The edge of an article counts as a good neighbour for what is inside it, the edge of the page as a bad
one; so a page of one-word paragraphs is decided by where it stands.

A page is a row: nothing is shuffled, and each is read in one scan forward whose open elements are a stack. Broken markup
(unclosed or stray tags, comments and scripts that never end, stray "<") is read on as browsers do. A null or empty page,
and one without a good block, has an empty text. Repeated rows are read each; ids may be null or repeat; other columns are
not read. Texts are never cut, whatever their length.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

#: the commonest function words of English, German, French and Spanish
STOP_WORDS = frozenset(
    """a and are as at be but by for from had has have he in is it not of on or she that the they this to was were which with you
    als auch auf aus bei das dem den der des die ein eine er es für im ist mit nicht sich sie sind und von war zu
    au aux avec ce dans de des du elle en est et il la le les mais ne ou par pas pour que qui se sont sur un une
    con del el ella entre fue las lo los más muy no para pero por se sin su sus una y""".split()
)


@dataclass(frozen=True)
class Rules:
    """Bounds of the first pass; lengths are code points."""

    stop_words: frozenset = STOP_WORDS
    #: blocks of fewer characters are short
    short: int = 70
    #: blocks of at least so many characters are good by stop words alone
    long: int = 100
    #: least share of stop words of good blocks; shares below the lower one speak against a block outside of articles
    high: float = 0.25
    low: float = 0.05
    #: greatest share of characters in links
    links: float = 0.34
    #: the same for blocks of an article
    article_links: float = 0.6


#: elements whose content is no markup (it ends with their end tag, or with the page), and others whose content is no text of the page
RAW = frozenset("script style textarea title iframe noscript template".split())
SILENT = RAW | frozenset("object svg math select button audio video canvas".split())
#: elements that begin and end a block
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BOILERPLATE = frozenset("nav footer aside form dialog menu search".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
#: parts of class names and ids that mark menus, headers, footers, sidebars, notices, adverts, forms and comments
MARKS = frozenset(
    """ad ads adsbygoogle advert adverts advertisement adsense advertising aside banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies copyright
    disclaimer disqus footer footnav gdpr header legal login masthead menu modal nav navbar navigation navi newsletter notice notification overlay pager pagination
    popup promo promoted promotion recommended recommendations related replies respond responses search share sharing sidebar signup skip
    social sponsor sponsored subscribe subscription teaser toolbar topbar widget widgets""".split()
)
#: marks that the head of an article may carry
HEADS = frozenset(["header"])
#: parts of class names and ids that mark the article where no element does
CONTENT = frozenset("article articlebody content entry post story main".split())
#: class names that say what a page has or lacks, not what an element is
STATES = re.compile(r"(?:has|no|with|without|is|hide|show)-|.*-(?:open|closed|free|enabled|disabled)$")
COMMENTS = re.compile(r"\W*(?:\d+\W+)?(?:reader |user )?(?:comments?|replies|responses|leave a (?:reply|comment)|kommentare?|commentaires?|comentarios?)\W*\d*\W*", re.I)
RIGHTS = re.compile(r"©|\(c\)\s*\d{4}|all rights reserved|alle rechte vorbehalten|tous droits réservés|todos los derechos reservados", re.I)
#: what closes an open element of the same list or table that markup left open
ENDS = {"li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "tr": frozenset(["td", "th", "tr"]), "option": frozenset(["option"])}

MARKUP = re.compile(
    r"""<!--(?:>|->|.*?(?:--!?>|\Z))      # a comment, to the end if never closed
      | <[!?][^>]*(?:>|\Z)                # declarations
      | <(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>]*+))*+)(?:>|\Z)""",
    re.S | re.X,
)
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]++)\s*+(?:=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]++)))?""")
PARTS = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]*")
LETTERS = re.compile(r"[^\W\d_]+")


@dataclass
class Block:
    """A block's text and what the rules read of it."""

    text: str
    kind: str
    article: bool
    bad: bool
    parent: int
    linked: float = 0.0
    stops: float = 0.0
    label: str = ""


@dataclass
class _Element:
    name: str
    bad: bool
    article: bool
    number: int


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(raw)}


def _marks(values: str) -> set[str]:
    """The lower-case parts of class names and ids, each name also as a whole."""
    out: set[str] = set()
    for name in values.split():
        if not STATES.match(name.lower()):
            out.update(p.lower() for p in PARTS.findall(name))
            out.add(name.lower())
    return out


class _Reader:
    """Cuts one page into blocks."""

    def __init__(self, strict: bool):
        self.blocks: list[Block] = []
        self.open = [_Element("", False, False, 0)]
        self.counts: dict[str, int] = {}
        self.text: list[str] = []
        self.linked = self.links = self.made = self.breaks = 0
        self.kind = "p"
        #: whether elements and not class names say where the article is
        self.strict = strict

    def end_block(self) -> None:
        words = "".join(self.text).split()
        if words:
            at = self.open[-1]
            text = " ".join(words)
            self.blocks.append(Block(text, self.kind, at.article, at.bad, at.number, self.linked / (len(text) - len(words) + 1)))
            if self.kind in HEADINGS and COMMENTS.fullmatch(text):
                # all that follows in the same section is what readers wrote
                self.blocks[-1].bad = True
                inside = self.open[-2] if at.name in HEADINGS and len(self.open) > 1 else at
                if inside.name not in ("", "html", "body", "main", "article"):
                    inside.bad = True
        self.text, self.linked, self.breaks = [], 0, 0
        self.kind = "p"

    def say(self, raw: str) -> None:
        text = html.unescape(raw)
        self.text.append(text)
        if self.breaks and not text.isspace():
            self.breaks = 0
        if self.links:
            self.linked += len("".join(text.split()))

    def pop(self) -> None:
        self.counts[self.open.pop().name] -= 1

    def start(self, name: str, raw: str) -> None:
        if name == "br":
            self.text.append(" ")
            self.breaks += 1
            if self.breaks == 2:
                self.end_block()
            return
        if name == "a":
            self.links = 1
            return
        if name not in BLOCK:
            return
        self.end_block()
        if name in VOID:
            return
        if self.open[-1].name == "p" or name in HEADINGS and self.open[-1].name in HEADINGS:
            self.pop()
        while self.open[-1].name in ENDS.get(name, ()):
            self.pop()
        if name in ("article", "main"):
            while self.counts.get("nav"):
                self.pop()
        self.made += 1
        at = self.open[-1]
        self.open.append(_Element(name, at.bad or self._is_bad(name, raw, at), at.article or self._is_article(name, raw), self.made))
        self.counts[name] = self.counts.get(name, 0) + 1
        if name in HEADINGS:
            self.kind = name

    def _is_bad(self, name: str, raw: str, at: _Element) -> bool:
        if name in BOILERPLATE or name == "header" and not at.article:
            return True
        if not raw or name in ("html", "body", "main"):
            return False
        has = _attributes(raw)
        if "hidden" in has or has.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", has.get("style", "")) or has.get("role", "").lower() in ROLES:
            return True
        marks = _marks(has.get("class", "") + " " + has.get("id", "")) & MARKS
        return bool(marks - HEADS if at.article or marks & HEADS and _marks(has.get("class", "")) & CONTENT else marks)

    def _is_article(self, name: str, raw: str) -> bool:
        if name in ("article", "main"):
            return True
        if not raw or name in ("html", "body"):
            return False
        has = _attributes(raw)
        return has.get("role", "").lower() in ("main", "article") or has.get("itemprop", "").lower() == "articlebody" or not self.strict and bool(_marks(has.get("class", "") + " " + has.get("id", "")) & CONTENT)

    def end(self, name: str) -> None:
        if name == "a":
            self.links = 0
            return
        if name not in BLOCK:
            return
        self.end_block()
        if self.counts.get(name):
            while self.open[-1].name != name:
                self.pop()
            self.pop()

    def read(self, page: str) -> list[Block]:
        at, end = 0, len(page)
        closers: dict[str, re.Pattern] = {}
        endless: set[str] = set()
        while at < end:
            m = MARKUP.search(page, at)
            if m is None:
                self.say(page[at:])
                break
            if m.start() > at:
                self.say(page[at : m.start()])
            at = m.end()
            if not m[2]:
                continue
            name = m[2].lower()
            if m[1]:
                self.end(name)
            elif name in SILENT:
                if name in endless or m[3].endswith("/") and name not in RAW:
                    continue
                close = closers.setdefault(name, re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I))
                found = close.search(page, at)
                if found:
                    at = found.end()
                elif name in RAW:
                    at = end
                else:
                    endless.add(name)
            else:
                self.start(name, m[3])
        self.end_block()
        return self.blocks


def _strict(page: str) -> bool:
    return bool(re.search(r"<(?:article|main)[\s>/]", page, re.I))


def _first_pass(b: Block, rules: Rules, strict: bool) -> str:
    words = LETTERS.findall(b.text.lower())
    b.stops = sum(map(rules.stop_words.__contains__, words)) / max(1, len(words))
    size = len(b.text)
    if b.bad or b.linked > (rules.article_links if b.article and b.kind not in HEADINGS else rules.links if not b.article else 1.0):
        return "bad"
    if b.article:
        return "short" if size < rules.short else "good" if b.stops >= rules.low else "near"
    if strict or RIGHTS.search(b.text):
        return "bad"
    if size < rules.short:
        return "bad" if b.linked else "short"
    if b.stops >= rules.high:
        return "good" if size >= rules.long else "near"
    return "near" if b.stops >= rules.low else "bad"


def _neighbours(labels: list[str], blocks: list[Block]) -> list[tuple]:
    """Of each block: label, distance and parent of the decided neighbours before and after it."""
    out: list[list] = [[] for _ in blocks]
    for order in (range(len(blocks)), range(len(blocks) - 1, -1, -1)):
        near, at, was = ("bad", -1), None, False
        for k, i in enumerate(order):
            b = blocks[i]
            inside = b.article and not b.bad
            if inside != was:
                # an edge of the article: good for what is inside, bad for what is outside
                near, at, was = ("good" if inside else "bad", -1), k - 1, inside
            out[i].append((near[0], k - (at if at is not None else -1), near[1]))
            if labels[i] in ("good", "bad"):
                near, at = (labels[i], b.parent), k
    return [tuple(x) for x in out]


def _second_pass(labels: list[str], blocks: list[Block]) -> list[str]:
    out = list(labels)
    for i, ((before, d1, p1), (after, d2, p2)) in enumerate(_neighbours(labels, blocks)):
        if labels[i] in ("good", "bad"):
            continue
        if before == after:
            out[i] = before
        elif labels[i] == "near":
            out[i] = "good"
        elif d1 != d2:
            out[i] = before if d1 < d2 else after
        elif blocks[i].kind in HEADINGS:
            out[i] = after
        else:
            # as near to both: it belongs with the good one if they share an element
            out[i] = "good" if (p1 if before == "good" else p2) == blocks[i].parent else "bad"
    return out


@dataclass
class Page:
    blocks: list[Block] = field(default_factory=list)

    @property
    def text(self) -> str:
        return "\n".join(b.text for b in self.blocks if b.label == "good")


def read_page(page: str | None, rules: Rules = Rules()) -> Page:
    """The labelled blocks of one page."""
    if not page:
        return Page()
    strict = _strict(page)
    blocks = _Reader(strict).read(page)
    for b, label in zip(blocks, _second_pass([_first_pass(b, rules, strict) for b in blocks], blocks), strict=True):
        b.label = label
    return Page(blocks)


def extract(pages: DataFrame, carry: list[str], markup: str = "html", rules: Rules = Rules()) -> DataFrame:
    """The columns ``carry`` and text, the main text of the column ``markup``: its good blocks in page order, one a line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 64):
                part = b.slice(i, 64)
                text = pa.array([read_page(x, rules).text for x in part.column(part.num_columns - 1).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], text], names=[*part.schema.names[:-1], "text"])

    kept = [F.col(f"`{c}`") for c in carry]
    schema = StructType([*pages.select(*kept).schema.fields]).add("text", StringType())
    return pages.select(*kept, F.col(f"`{markup}`").cast("string").alias("text")).mapInArrow(run, schema)


def blocks(pages: DataFrame, key: str = "page_id", markup: str = "html", rules: Rules = Rules()) -> DataFrame:
    """A row for each block: the column ``key``, place (from 0), kind (p or h1 to h6), text, linked and stops (shares of characters in links and of stop words), label (good or bad)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                found = read_page(b.column(1)[i].as_py(), rules).blocks
                cols = [pa.array([getattr(x, c) for x in found], kind) for c, kind in (("kind", pa.string()), ("text", pa.string()), ("linked", pa.float64()), ("stops", pa.float64()), ("label", pa.string()))]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([i] * len(found), pa.int64())), pa.array(range(len(found)), pa.int32()), *cols], names=[key, "place", "kind", "text", "linked", "stops", "label"])

    rows = pages.select(F.col(f"`{key}`"), F.col(f"`{markup}`").cast("string").alias("markup"))
    schema = StructType([rows.schema.fields[0]]).add("place", "integer").add("kind", "string").add("text", "string").add("linked", "double").add("stops", "double").add("label", "string")
    return rows.mapInArrow(run, schema)


def page_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row; reads page_id, url and html."""
    return extract(pages, ["page_id", "url"]).withColumn("n_chars", F.char_length("text").cast("long"))

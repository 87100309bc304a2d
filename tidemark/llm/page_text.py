"""Main-text extraction by consensus host paths.

Every page's containers are scored by the running text below them against all
text below them, and the best one's generalised tag-class path is the page's
vote, widened to what stands around it without further links.  Spark counts the votes of each host; pages are then extracted again from
the containers at their host's winning path.  A page without such a container,
or whose own best container scores more than ``OVERRULE`` times as much, keeps
its own choice.

Menus, page headers, footers, sidebars, notices, adverts, forms, scripts,
styles and reader comments are left out wherever they stand: by element name,
by a ``hidden`` attribute or a role, by class and id values, and comments also by
their heading.  A class or id counts if all of its words are of such elements or
usual beside them (``social-links``, not ``social-history``), and an id of a
paragraph, heading or section is a place to jump to and doesn't count.  A form, or an element that only a word of its
class or id leaves out, stays if it holds most of the page's running text and,
where the page has any, a main heading, article or main element (of comments:
a main heading), so a page in one wrapper of an unlucky name keeps its article.

Where no block of a page is long enough to speak for a container, all of the page's
blocks are its text.

Reading takes time in proportion to the page, however deep its elements nest.

Edge cases: null or empty html gives the empty text; markup errors (unclosed or
stray tags, unfinished comments) are read as browsers do in the common cases;
a null or unreadable url has the host ''; ties between paths go to the greater
summed score, then the greater digest; repeated rows agree; an empty table gives
an empty result; extra columns are kept, and columns named ``text`` or
``n_chars`` are replaced.
"""

from __future__ import annotations

import hashlib
import html as html_lib
import re
from collections import Counter
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import field, named, packed, ship_package, unpacked, written

OVERRULE = 2.0
#: Blocks shorter than this don't speak for a container.
SPEAKING_CHARS = 40

RAW = "script|style|noscript|template|textarea|iframe|svg|math|title|xmp|noembed|noframes"
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 head header hgroup html legend li main menu nav ol optgroup option p pre search section "
    "select summary table tbody td tfoot th thead tr ul hr".split()
)
CONTAINERS = frozenset("article body div main section td".split())
#: Elements that never hold main text; a form may, as many servers put a page in one.
LEFT_OUT = frozenset("nav aside footer head select button menu dialog object audio video canvas map datalist".split())
#: Words of class or id values that mark such elements.
LEFT_OUT_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu "
    "breadcrumb breadcrumbs sidebar side aside footer header masthead topbar toolbar cookie cookies consent gdpr notice "
    "notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social related "
    "recommended recommendations widget pagination pager skip search form".split()
)
COMMENT_WORDS = frozenset("comment comments commentlist reply replies respond responses disqus discussion discussions guestbook voices".split())
#: Words that may stand beside those above in a name; with any other word it names a subject (``social-history``).
BESIDE_WORDS = frozenset(
    "box bar area wrap wrapper container block blocks list item items link links button buttons btn icon icons main top bottom left right "
    "site page global primary secondary post posts article articles story stories news content inner outer section panel row group unit slot zone "
    "region module body text title logo image img mobile desktop sticky fixed inline user reader the your our my us here more all new latest popular "
    "toggle tools form input field fields div id js css ui app tag tags category categories meta author bio message info warning policy".split()
)
#: Elements whose id is a place to jump to, not what they are.
ANCHORED = frozenset("p section h1 h2 h3 h4 h5 h6 li dt dd blockquote pre figure table".split())
#: Words beside which a name tells of a page's arrangement, not of the element.
ARRANGEMENT_WORDS = frozenset("with without has have no layout grid columns col cols free theme".split())
#: Headings of reader comments.
COMMENT_HEADING = re.compile(
    r"\W*(\d+\s+)?((reader|readers'?|user|visitor)\s+)?(comments?|replies|responses|discussion|leave a (reply|comment)|(leser)?kommentare|commentaires|comentarios)\W*(\d+)?\W*", re.I
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Roles of the same meaning.
LEFT_OUT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())

_INSIDE = r"""[^>"']*+(?:(?:"[^"]*+"|'[^']*+')[^>"']*+)*+"""
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({RAW})\b{_INSIDE}>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][^\s/>]*)({_INSIDE})>|<[!?/][^>]*>",
    re.S | re.I,
)
_RAW_END = re.compile(r"</\w+\s*>\Z")
_ATTRIBUTE = re.compile(r"""([^\s"'=/>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_CLOSES_P = BLOCK - {"option", "optgroup", "legend", "summary"}

#: Why an element is left out: for certain, by a name only, or as reader comments.
CERTAIN, NAMED, COMMENTS = "certain", "named", "comments"


@dataclass(slots=True)
class Element:
    tag: str
    path: bytes
    reason: str | None
    owner: Element | None
    number: int
    first: int  # blocks from here
    last: int = 0  # up to here are below it,
    until: int = 0  # and elements up to here
    weight: int = 0
    chars: int = 0
    linked: int = 0
    heads: int = 0  # main headings in it,
    marks: int = 0  # and those, articles and main elements
    out: bool = False

    def score(self) -> float:
        bonus = 1.5 if self.tag in ("article", "main") else 1.0
        return bonus * self.weight * self.weight / (self.chars + 1)


def _named_words(value: str) -> set[str]:
    """Words of the names in a class or id value that tell what the element is."""
    found: set[str] = set()
    for name in value.split():
        words = {w.lower() for w in _WORD.findall(name)}
        known = words & (LEFT_OUT_WORDS | COMMENT_WORDS)
        if words.isdisjoint(ARRANGEMENT_WORDS) and words - known <= BESIDE_WORDS:
            found |= known
    return found


def _label(tag: str, attributes: str) -> tuple[str, str | None]:
    """The path step of an element, and why its attributes leave it out."""
    names, words, reason = "", set(), None
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values)
        if name == "hidden" or name == "role" and value.strip().lower() in LEFT_OUT_ROLES:
            reason = CERTAIN
        elif name in ("class", "id"):
            words |= _named_words(value) if name == "class" or tag not in ANCHORED else set()
            if name == "class":
                names = ".".join(sorted(re.sub(r"\d+", "", value.lower()).split()))
    if reason is None and not words.isdisjoint(COMMENT_WORDS):
        reason = COMMENTS
    if reason is None and not words.isdisjoint(LEFT_OUT_WORDS):
        reason = NAMED
    return (f"{tag}.{names}" if names else tag), reason


def _below(path: bytes, step: str) -> bytes:
    """A path of any depth as eight bytes."""
    return hashlib.blake2b(path + step.encode("utf-8", "surrogatepass"), digest_size=8).digest()


class PageReader:
    """Reads one page into blocks of text under elements."""

    def __init__(self, page: str):
        self.elements = [Element("body", _below(b"", "body"), None, None, 0, 0)]
        self.stack = [self.elements[0]]
        self.open = Counter()
        self.blocks: list[tuple[str, int, int, Element]] = []
        self.pieces: list[str] = []
        self.links = self.open_links = 0
        at, last = 0, page.rfind(">") + 1  # behind it nothing is markup
        for m in _TOKEN.finditer(page, 0, last):
            if m.start() > at:
                self.text(page[at : m.start()])
            at = m.end()
            if tag := m[3]:
                (self.end if m[2] else self.start)(tag.lower(), m[4])
            elif m[1] or m[0].startswith("<!--"):
                if m[1]:
                    self.pieces.append(" ")
                if at == last and not (_RAW_END.search(m[0]) if m[1] else m[0].endswith("-->")):
                    at = len(page)  # unfinished to the end
        self.text(page[at:].partition("<!--")[0])
        self.flush()
        self.close(0)
        self.settle()

    def text(self, data: str) -> None:
        self.pieces.append(data)
        if self.open_links:
            self.links += len(data)

    def flush(self) -> None:
        """End the current block and note it under the innermost element."""
        if not self.pieces:
            return
        raw = "".join(self.pieces)
        block = " ".join((html_lib.unescape(raw) if "&" in raw else raw).split())
        links, self.links, self.pieces = self.links, 0, []
        if not block:
            return
        top = self.stack[-1]
        weight = 0 if len(block) < SPEAKING_CHARS else max(0, len(block) - 2 * links)
        if top.tag in HEADINGS:
            top.heads += top.tag == "h1"
            top.marks += top.tag == "h1"
            above = top.owner
            if above is not None and above.owner is not None and above.first == len(self.blocks) and above.reason is None and COMMENT_HEADING.fullmatch(block):
                above.reason = COMMENTS
        self.blocks.append((block, weight, links, top))

    def close(self, depth: int) -> None:
        """End the open elements from ``depth`` on."""
        for element in self.stack[depth:]:
            element.last, element.until = len(self.blocks), len(self.elements)
            self.open[element.tag] -= 1
        del self.stack[depth:]

    def start(self, tag: str, attributes: str) -> None:
        if tag == "br":
            self.pieces.append(" ")
            return
        if tag not in BLOCK and tag not in LEFT_OUT:
            self.open_links += tag == "a"
            return
        self.flush()
        self.open_links = 0
        if tag in VOID:
            return
        if tag in ("html", "body"):
            if self.stack[-1].tag == "head":
                self.close(len(self.stack) - 1)
            return
        if tag in _CLOSES_P and self.stack[-1].tag == "p" or tag in ("li", "dd", "dt", "tr", "td", "th", "option") and self.stack[-1].tag == tag:
            self.close(len(self.stack) - 1)
        if self.stack[-1].tag == "head" and tag not in LEFT_OUT:
            self.close(len(self.stack) - 1)
        above = self.stack[-1]
        step, reason = _label(tag, attributes) if attributes.strip() else (tag, None)
        if tag in LEFT_OUT or tag == "header" and not self.open["article"] + self.open["main"]:
            reason = CERTAIN
        elif tag == "form":
            reason = reason or NAMED
        element = Element(tag, _below(above.path, step), reason, above, len(self.elements), len(self.blocks), marks=int(tag in ("article", "main")))
        self.elements.append(element)
        self.stack.append(element)
        self.open[tag] += 1

    def end(self, tag: str, _: str) -> None:
        if tag == "a":
            self.open_links = max(0, self.open_links - 1)
            return
        if tag not in BLOCK and tag not in LEFT_OUT:
            return
        self.flush()
        if self.open[tag] > 0:
            depth = len(self.stack) - 1
            while self.stack[depth].tag != tag:
                depth -= 1
            if depth:
                self.close(depth)

    def add_up(self) -> None:
        """Weights, lengths and main headings of all elements from the blocks below them."""
        for e in self.elements:
            e.weight = e.chars = e.linked = 0
        for block, weight, links, top in self.blocks:
            top.chars += len(block)
            if not top.out:
                top.weight += weight
                top.linked += links
        for e in reversed(self.elements):
            if e.owner is not None:
                e.owner.chars += e.chars
                e.owner.weight += e.weight
                e.owner.linked += e.linked

    def settle(self) -> None:
        """Decide which elements are left out, then count what is left."""
        self.add_up()
        for e in reversed(self.elements):
            if e.owner is not None:
                e.owner.heads += e.heads
                e.owner.marks += e.marks
        page, total = self.elements[0], self.elements[0].weight
        for e in self.elements:
            held = e.heads if e.reason == COMMENTS else e.marks or not page.marks
            most = held and 2 * e.weight > total
            e.out = e.owner is not None and (e.owner.out or e.reason == CERTAIN or e.reason is not None and not most)
        self.add_up()
        self.containers = [e for e in self.elements if e.tag in CONTAINERS and not e.out]

    def best(self) -> Element:
        """The container of the greatest score; of equal ones the last begun.  Where nothing speaks, the whole page."""
        found = max(reversed(self.containers), key=Element.score)
        return self.widened(found) if found.weight else self.elements[0]

    def widened(self, found: Element) -> Element:
        """The outermost element, below the page's, that holds no more links than ``found``: its other blocks are short parts of the text."""
        above = found.owner
        while found.tag not in ("article", "main") and above is not None and above.owner is not None and above.tag in CONTAINERS and not above.out and above.linked == found.linked:
            found, above = above, above.owner
        return found

    def at(self, path: bytes) -> list[Element]:
        """Outermost containers at a path, in page order."""
        found: list[Element] = []
        for c in self.containers:
            if c.path == path and (not found or c.number >= found[-1].until):
                found.append(c)
        return found

    def blocks_of(self, element: Element) -> list[str]:
        return [block for block, _, _, top in self.blocks[element.first : element.last] if not top.out]


def vote(page: str | None) -> tuple[bytes | None, float]:
    """A page's path and its score; no vote (null) without running text."""
    best = PageReader(page or "").best()
    return (best.path, best.score()) if best.weight else (None, 0.0)


def main_text(page: str | None, path: bytes | None) -> str:
    reader = PageReader(page or "")
    best = reader.best()
    chosen = reader.at(path) if path else []
    if sum(c.score() for c in chosen) * OVERRULE < best.score() or not any(reader.blocks_of(c) for c in chosen):
        chosen = [best]
    return "\n\n".join(block for c in chosen for block in reader.blocks_of(c))


def host_of(url: Column) -> Column:
    """Lower-case host without port and user; '' if there is none."""
    host = F.regexp_extract(F.lower(url), r"^\s*[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.coalesce(host, F.lit(""))


def winning_paths(pages: DataFrame, url: str = "url", page: str = "html") -> DataFrame:
    """One row (host, path) for each host with a vote; a path is the digest of its steps."""
    ship_package(pages.sparkSession)

    @F.pandas_udf("path binary, score double")
    def votes(series: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([vote(p) for p in series], columns=["path", "score"])

    cast = pages.select(host_of(named(url)).alias("host"), votes(named(page)).alias("v"))
    counted = cast.where("v.path is not null").groupBy("host", F.col("v.path").alias("path")).agg(F.count("*").alias("n"), F.sum(F.round("v.score", 3).cast("decimal(38,3)")).alias("s"))
    return counted.groupBy("host").agg(F.max_by("path", F.struct("n", "s", "path")).alias("path"))


def extract_main_text(pages: DataFrame, url: str = "url", page: str = "html") -> DataFrame:
    """``pages`` with ``text`` and ``n_chars``.

    The winners (one short row a host) are written before the join, so Spark
    knows their size: it broadcasts a small table and shuffles for a large one.
    """
    ship_package(pages.sparkSession)

    @F.pandas_udf("string")
    def texts(series: pd.Series, paths: pd.Series) -> pd.Series:
        return pd.Series([main_text(p, path) for p, path in zip(series, paths, strict=True)], dtype=object)

    winners = written(winning_paths(pages, url, page))
    rows = packed(pages).withColumn("own", host_of(field(url))).join(winners, F.col("own") == F.col("host"), "left")
    found = rows.select("row", texts(field(page), "path").alias("found"))
    return unpacked(found, text=F.col("found"), n_chars=F.char_length("found").cast("long"))

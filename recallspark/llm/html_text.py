"""Main text of web pages: parser events, text-to-tag ratio per line, Gaussian smoothing, threshold clustering."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from html import unescape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recallspark.llm._common import fresh, map_batches, require, slices, table

#: Elements whose start and end break a line.  Each set below holds names of the HTML standard.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead title tr ul video".split())
#: Elements that are kept on the stack as containers of lines.
CONTAINERS = frozenset("html body main article section div td table ul ol dl blockquote figure details".split())
#: Elements that never hold article text.
OUTSIDE = frozenset("head nav aside footer script style noscript template iframe object svg canvas button select textarea datalist dialog menu search audio video map math".split())
#: Elements that hold no blocks of text: one that is not ended ends where such a block begins.
NARROW = ("iframe", "button", "select", "textarea")
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 article section main header footer nav aside ul ol table blockquote figure".split())
#: Words that only place or shape what a name says.
LAYOUT = frozenset("left right top bottom main site page global primary secondary wrapper wrap container box area block inner outer link links list bar slot section content panel row col column item items button buttons icon icons form text title head heading body group set unit zone region element module sticky fixed float inline post article story".split())
HIDDEN = re.compile(r"display\s*:\s*none")
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Elements that the next one of their name ends.
SELF_CLOSING = frozenset("li dt dd tr td th option".split())
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Words of a class or id that mark boilerplate where they begin or end the name.
STRONG = frozenset(
    "ad ads adsense advert adverts advertisement advertising banner breadcrumb breadcrumbs consent cookie cookies footer gdpr login masthead menu menus modal nav navbar "
    "navigation newsletter notice notices pager pagination popup promo promotion share sharing sidebar sidebars signup skip social sponsor sponsored subscribe "
    "subscription toolbar widget widgets".split()
)
#: Words that mark what readers wrote.
COMMENTS = frozenset("comment comments commentlist disqus replies reply respond".split())
#: Words that may as well name a part of the article: there, the clusters decide.
WEAK = frozenset("alert dialog discussion feedback recommended related search tags warning".split())
ROLES = {"navigation": 3, "contentinfo": 3, "complementary": 3, "menu": 3, "menubar": 3, "search": 3, "dialog": 3, "banner": 2, "alert": 1, "alertdialog": 3}
#: First words of a name that only says how a page is laid out.
MODIFIERS = frozenset("has with without no not is hide show can js".split())
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: How boilerplate a container is: by no sign, weakly, as a page header, by a strong word, as comments, by its element.
CLEAN, MAYBE, HEADER, MARKED, READERS, NEVER = range(6)


@lru_cache(1 << 16)
def mark_of(name: str) -> int:
    """The mark that one class name or id gives its container."""
    words = [w.lower() for w in WORD.findall(name)]
    if not words or words[0] in MODIFIERS:
        return CLEAN
    ends = {words[0], words[-1]}
    if not COMMENTS.isdisjoint(ends):
        return READERS
    if not STRONG.isdisjoint(ends):
        return MARKED
    if "header" in ends:
        return HEADER
    return CLEAN if WEAK.isdisjoint(words) and STRONG.isdisjoint(words) else MAYBE


@lru_cache(1 << 16)
def names_part(name: str) -> bool:
    """A strong word stands beside one that says more than a place, as in social-history: inside an article that is a part of it, unless the text around says otherwise."""
    words = {w.lower() for w in WORD.findall(name)}
    return bool(words - STRONG - WEAK - LAYOUT)


class Node:
    """A container: its parent, its own mark, and what is summed up of its lines."""

    __slots__ = ("tag", "id", "parent", "mark", "article", "barred", "saved", "out", "titles", "top", "weak", "weight", "ratios", "count", "links", "prose", "region")

    def __init__(self, tag: str, id: int, parent: Node | None, mark: int):
        self.tag, self.id, self.parent, self.mark = tag, id, parent, mark
        self.article = tag in ("article", "main") or parent is not None and parent.article
        self.barred = mark in (NEVER, READERS) or parent is not None and parent.barred
        self.saved = self.out = self.titles = self.region = False
        self.top: Node | None = None
        self.weak: Node | None = None
        self.weight = self.ratios = self.count = self.links = self.prose = 0


class Lines(HTMLParser):
    """Turns parser events into lines: the text between two block borders, with its tags, links and container."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[dict] = []
        self.nodes = [Node("", 0, None, CLEAN)]
        self.stack = [self.nodes[0]]
        self.open: Counter[str] = Counter()
        self.text: list[str] = []
        self.tags = self.links = self.in_link = 0
        self.heading = self.item = False
        self.begun: set[str] = set()
        self.unended: list[str] = []

    def _flush(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            self.lines.append({"text": text, "tags": self.tags, "links": self.links, "heading": self.heading, "item": self.item, "node": self.stack[-1]})
        self.text = []
        self.tags = self.links = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in TEXTUAL:
            for name in self.unended:
                if self.open[name]:
                    self.handle_endtag(name)
        if tag in BLOCKS:
            self._flush()
            self.heading, self.item = tag in HEADINGS, tag == "li"
            if (last := self.stack[-1].tag) == "p" or last == tag and tag in SELF_CLOSING:
                self.stack.pop()
                self.open[last] -= 1
        elif tag == "br":
            self.text.append(" ")
        self.tags += 1
        if tag == "a":
            self.in_link = 1
        if tag in VOID:
            return
        # A form is dropped by a mark that an article or nearly all prose inside it can lift, as some pages are one form.
        mark = NEVER if tag in OUTSIDE else MARKED if tag == "form" else HEADER if tag == "header" else CLEAN
        inside = self.stack[-1].article
        for name, value in attrs if tag in BLOCKS and tag not in HEADINGS else ():
            if not value:
                if name == "hidden":
                    mark = NEVER
            elif name == "class" and tag not in ("html", "body", "main"):
                mark = max(mark, *(MAYBE if inside and mark_of(x) == MARKED and names_part(x) else mark_of(x) for x in value.split()), CLEAN)
            elif name == "id" and tag not in ("html", "body", "main"):
                mark = max(mark, MAYBE if inside and mark_of(value) == MARKED and names_part(value) else mark_of(value))
            elif name == "role":
                mark = max(mark, ROLES.get(value.strip().lower(), CLEAN))
            elif name == "hidden" or name == "style" and HIDDEN.search(value):
                mark = NEVER
        if tag in ("article", "main", "h1") and mark < HEADER:
            self._wrapped("h1" if tag == "h1" else "article")
        if mark or tag in CONTAINERS:
            self.nodes.append(Node(tag, len(self.nodes), self.stack[-1], mark))
            self.stack.append(self.nodes[-1])
            self.open[tag] += 1

    def _wrapped(self, kind: str) -> None:
        """What wraps the first article, or the first title of the page, is no boilerplate, whatever its class says."""
        if kind not in self.begun and not self.stack[-1].barred:
            self.begun.add(kind)
            for x in self.stack:
                x.saved = True

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in ("script", "style"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self._flush()
            self.heading = self.item = False
        self.tags += 1
        if tag == "a":
            self.in_link = 0
        if self.open[tag]:
            while (closed := self.stack.pop().tag) != tag:
                self.open[closed] -= 1
            self.open[tag] -= 1

    def handle_data(self, data: str) -> None:
        tag = self.stack[-1].tag
        if tag != "script" and tag != "style":
            self.text.append(data)
            if self.in_link:
                self.links += len(data)

    def unknown_decl(self, data: str) -> None:
        pass


def _fed(html: str) -> Lines:
    """The events of a page, in time that grows with its length.

    The parser stops at a tag or comment that is not ended, and would look at the rest again from each < on.  Instead its next > ends it, and the
    rest is read on; after some of those, or without one, the rest is text without tags.
    """
    parser = Lines()
    low = html.lower()
    parser.unended = [x for x in NARROW if low.count(f"<{x}") > low.count(f"</{x}")]
    parser.feed(html)
    for _ in range(16):
        rest = parser.rawdata
        if parser.cdata_elem is not None or "<" not in rest:
            break
        if (at := rest.find(">")) < 0:
            break
        parser.rawdata = ""
        parser.feed(rest[at + 1 :])
    rest, parser.rawdata = parser.rawdata, ""
    if rest and parser.cdata_elem is None:
        parser.handle_data(unescape(re.sub(r"<[^<>]*>", " ", rest)))
    parser._flush()
    return parser


def lines_of(html: str) -> tuple[list[dict], list[Node]]:
    try:
        parser = _fed(html)
    except AssertionError:  # a malformed marked section
        parser = _fed(html.replace("<![", "&lt;!["))
    return parser.lines, parser.nodes


def smooth(values: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian smoothing whose weights are renormalised at the ends."""
    r = max(1, int(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    return np.convolve(values, kernel)[r : r + len(values)] / np.convolve(np.ones(len(values)), kernel)[r : r + len(values)]


def _settle(nodes: list[Node], lines: list[dict]) -> None:
    """Which containers, and so which lines, are boilerplate by their own or an outer mark; of an article's header, headings stay."""
    for x in nodes:  # parents come first
        up = x.parent
        own = x.mark == NEVER or x.mark >= HEADER and not x.saved and not (x.mark == HEADER and x.article)
        x.out = own or up is not None and up.out
        x.titles = x.mark == HEADER and x.article or up is not None and up.titles
        x.top = up.top if up and up.top else x if own and not x.barred else None
        x.weak = x if x.mark == MAYBE and not x.saved else up.weak if up else None
    for line in lines:
        line["out"] = line["node"].out or line["node"].titles and not line["heading"]


def _rescue(nodes: list[Node], lines: list[dict]) -> bool:
    """If nearly all prose of a page stands in one marked container, the mark is wrong: the container is saved."""
    prose = lambda x: max(0, len(x["text"]) - x["links"]) if len(x["text"]) >= 60 else 0
    free = 0
    for line in lines:
        if not line["out"]:
            free += prose(line)
        elif line["node"].top and not line["node"].barred:
            line["node"].top.prose += prose(line)
    best = max(nodes, key=lambda x: x.prose)
    best.saved = best.prose > 10 * free
    return best.saved


def _ratios(lines: list[dict], sigma: float) -> np.ndarray:
    """Smoothed characters outside links for each tag; half of it in containers with a weak mark, nothing in boilerplate."""
    own = [0.0 if x["out"] else max(0, len(x["text"]) - x["links"]) / max(1, x["tags"]) / (2 if x["node"].weak else 1) for x in lines]
    return smooth(np.array(own), sigma)


def _regions(nodes: list[Node], total: float) -> list[Node]:
    """The outermost article and main elements, if they hold a fair part of the clusters; else the smallest container that holds most."""
    told = [x for x in nodes if x.tag in ("article", "main") and not x.out and x.weight and not (x.parent and x.parent.article)]
    if sum(x.weight for x in told) >= 0.3 * total:
        return told
    return [max((x for x in nodes if x.weight >= 0.7 * total), key=lambda x: x.id)]


def main_text(html: str | None, sigma: float = 1.0, strength: float = 1.0) -> str:
    """The main text of one page, or "" if it has none."""
    lines, nodes = lines_of(html) if html else ([], [])
    _settle(nodes, lines)
    if lines and _rescue(nodes, lines):
        _settle(nodes, lines)
    if all(x["out"] for x in lines):
        return ""
    ratio = _ratios(lines, sigma)
    threshold = strength * ratio.std()
    for k, x in enumerate(lines):  # a weakly marked container stays if it looks like the text around it
        if (own := x["node"].weak) and not x["out"]:
            own.ratios, own.count, own.links = own.ratios + ratio[k] * len(x["text"]), own.count + len(x["text"]), own.links + x["links"]
    for x in lines:
        own = x["node"].weak
        x["out"] = x["out"] or own is not None and (own.ratios < threshold * own.count or 2 * own.links > own.count)
    good = [k for k, x in enumerate(lines) if not x["out"]]
    seeds = [k for k in good if ratio[k] >= threshold] or good
    if not seeds:
        return ""
    for k in seeds:
        lines[k]["node"].weight += len(lines[k]["text"])
    for x in reversed(nodes[1:]):
        x.parent.weight += x.weight
    regions = _regions(nodes, nodes[0].weight)
    chosen = {x.id for x in regions}
    for x in nodes:
        x.region = x.id in chosen or x.parent is not None and x.parent.region
    inside = [k for k in good if lines[k]["node"].region]
    if regions[0].tag in ("", "html", "body"):  # no region of its own: the clusters, what lies between, and what stands beside them
        beside = {lines[k]["node"].id for k in seeds}
        inside = [k for k in _unlisted(lines, inside) if seeds[0] <= k <= seeds[-1] or lines[k]["node"].id in beside]
    return "\n\n".join(lines[k]["text"] for k in inside)


def _unlisted(lines: list[dict], rows: list[int]) -> list[int]:
    """rows without runs of three or more list items that are links only: menus of pages that name nothing."""
    out: list[int] = []
    run: list[int] = []
    for k in [*rows, None]:
        if k is not None and lines[k]["item"] and lines[k]["links"] >= 0.8 * len(lines[k]["text"]):
            run.append(k)
            continue
        out += run if len(run) < 3 else []
        run = []
        if k is not None:
            out.append(k)
    return out


def extract(df: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",), sigma: float = 1.0, strength: float = 1.0) -> DataFrame:
    """Main text of every page; a map over the rows, with no shuffle.

    The standard library's parser streams events; the text between block borders is a line, and its ratio is its
    characters outside links for each of its tags.  Ratios are smoothed by a Gaussian of `sigma` lines; lines at or above
    `strength` standard deviations are the content clusters.  The region is made of the outermost article and main elements
    if they hold a fair part of the clusters, else it is the smallest container that holds most of them; all its lines are returned
    but boilerplate.  Menus, headers, footers, asides, forms, scripts and hidden parts go by their element; notices,
    adverts, sidebars, comments and the like by a class or id that begins or ends with such a word, but what wraps the article or
    nearly all prose of a page is never taken for one.  Words that may name a part of an article (discussion, warning, related)
    only halve the ratios of their container, and it goes only if it falls out of the clusters or is mostly links.  Ids of headings mean nothing.

    Returns id_col, the columns of `keep`, text (blocks joined by an empty line; "" if there is none) and n_chars.
    Null or empty html gives "".  Other columns are left out; so a clash of names with `text` is no matter.  Broken
    markup gives what the parser makes of it.  Repeated rows stay.
    """
    require(df, id_col, html_col, *keep)
    kept = [c for c in (id_col, *keep) if c not in ("text", "n_chars")]
    schema = T.StructType([*[df.schema[c] for c in kept], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        for part in slices(batch):
            texts = [main_text(x, sigma, strength) for x in part.column(len(kept)).to_pylist()]
            yield {c: part.column(k) for k, c in enumerate(kept)} | {"text": texts, "n_chars": [len(x) for x in texts]}

    return map_batches(df.select(*kept, F.col(html_col).cast("string").alias(fresh(kept, "_html"))), run, schema)


def op4_html_main_text(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


QUERIES = {"op4_html_main_text": op4_html_main_text}
ORACLES: dict[str, str] = {}

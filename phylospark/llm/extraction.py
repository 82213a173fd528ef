"""Main text of web pages: parser events, text-to-tag ratios, Gaussian smoothing and threshold clusters.

The standard library's parser streams events. Text between block-level tags is one line, whatever element it stands in, menus and
footers too; only what a browser doesn't show as text is no line (scripts, styles, hidden elements, fields). Each line keeps its
number of characters, of tags and of characters inside links, and its element.

Elements that bear a name, role, class or id of furniture (menus, headers, footers, sidebars, notices, adverts, forms, comments of readers) are
marked; a header inside an article is no mark. Lines below a mark don't take part, unless the marked element holds the page: if what is
outside it has less than a ``PRIOR``-th of its characters outside links, it is taken for the page, and the same is asked of the marks inside it.
So an article in a "notice-board" is found as any other. Comments of readers, asides, menus and footers (``NEVER``) hold the page only where there are no other characters.

The text-to-tag ratio of the remaining lines (without characters in links) is smoothed with a Gaussian kernel, and a fraction of the smoothed
ratio's standard deviation is the threshold: runs of lines that reach it are clusters of content, those whose own ratio reaches it too are
their cores. The region is the deepest element, no paragraph or inline one, that holds every core. In an article or main element all lines of the
region belong to the text. Elsewhere the clusters decide: a line of the region belongs to the text if it is in a cluster, or
between two clusters and not mostly links. A heading (h1, h2) before the region that is in a cluster belongs to the text as well.

White space inside a line becomes one space; lines are joined by one space in page order. Defined cases: null or empty html gives
an empty text; broken markup never fails: end tags without a start are ignored, open elements end with an enclosing one or with the
page; a page whose lines all have ratio 0 (links only) gives those outside marked elements; pages are independent, so ties and repeated rows don't
matter; an empty table gives an empty result; columns beyond those named are ignored, so their names can't clash. Time and memory are in proportion
to the page's length, however deep its elements are.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phylospark.llm._shared import slices, small_batches

SIGMA, THRESHOLD, PRIOR = 1.5, 1.0, 50

# Names of HTML elements.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "br", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup",
    "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "option", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "title", "tr", "ul",
}
SILENT = {"head", "title", "script", "style", "noscript", "template", "iframe", "object", "svg", "canvas", "button", "select", "textarea", "audio", "video", "map"}
FURNITURE = {"nav", "footer", "aside", "form", "menu", "dialog"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "menu", "menubar", "toolbar", "alert", "alertdialog", "dialog", "form", "status"}
CLOSES_P = BLOCKS - {"br", "option", "caption", "td", "th", "tr", "tbody", "thead", "tfoot", "legend", "summary"}
ALIKE = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"ul", "ol", "dl", "table", "select", "article", "main", "section", "div", "body", "nav", "aside"}
TITLES = {"h1", "h2"}
REGIONS = {"article", "main"}
#: Elements that can be a region; others are parts of a text.
HOLDERS = {"", "html", "body", "article", "main", "section", "div", "center", "details", "fieldset", "table", "tbody", "td", "ul", "ol", "dl"}

#: Words of a class or id that mark furniture; on an article or main element only the second set does, inside one not the third.
WORDS = (
    "ad ads advert adverts advertisement advertising banner banners sponsor sponsored sponsors promo promos promotion promotions sidebar side-bar menu menus nav navbar navigation breadcrumb breadcrumbs header masthead footer notice notices "
    "cookie cookies consent gdpr popup modal overlay newsletter subscribe subscription signup login search share sharing social related recommended comment comments replies respond disqus discussion pagination pager toolbar widget widgets "
    "disclaimer copyright skip-link toc tags alert"
)
#: Names and elements that hold no main text but where there is no other.
NEVER_WORDS = set("comment comments replies respond disqus discussion".split())
NEVER = {"aside", "nav", "footer"}
ON_REGIONS = "ad ads advert advertisement sponsored promo related recommended comment comments replies teaser"
NOT_INSIDE = {"header", "masthead"}


def marks(words: str) -> re.Pattern:
    return re.compile(rf"(?:^|[\s_-])({'|'.join(words.split())})(?=$|[\s_-]|[0-9])", re.I)


MARKS, REGION_MARKS = marks(WORDS), marks(ON_REGIONS)
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
LAYOUT = re.compile(r"\b(?:has|with|no|without|show|hide|is|not)[-_][\w-]+")


def found_marks(value: str, tag: str, inside: bool) -> set[str]:
    """The words of a class or id that name furniture."""
    value = LAYOUT.sub(" ", CAMEL.sub("-", value))
    found = {m[1].lower() for m in (REGION_MARKS if tag in REGIONS else MARKS).finditer(value)}
    return found - NOT_INSIDE if inside else found


@dataclass
class Element:
    tag: str
    parent: int
    depth: int
    silent: bool  # what it holds isn't shown as text
    mark: int  # the nearest element named as furniture, itself or above; 0: none
    never: bool  # named as what holds no main text
    region: bool  # in an article or main


@dataclass
class Line:
    element: int
    text: str = ""
    tags: int = 0
    linked: int = 0


@dataclass
class Page:
    elements: list[Element] = field(default_factory=lambda: [Element("", -1, 0, False, 0, False, False)])
    lines: list[Line] = field(default_factory=list)


class Events(HTMLParser):
    """Collects lines and elements while the page streams by."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.page = Page()
        self.open: list[int] = [0]
        self.count: Counter[str] = Counter()
        self.pieces: list[str] = []
        self.tags = self.linked = self.links = 0

    def flush(self):
        text = " ".join("".join(self.pieces).split())
        if text:
            self.page.lines.append(Line(self.open[-1], text, self.tags, min(self.linked, len(text))))
            self.tags = 0
        self.pieces, self.linked = [], 0

    def shut(self, at: int):
        """End the open element at this place of the stack and all inside it."""
        for i in self.open[at:]:
            self.links -= self.page.elements[i].tag == "a"
            self.count[self.page.elements[i].tag] -= 1
        del self.open[at:]

    def imply(self, tag: str):
        """End what a start tag ends without an end tag."""
        wanted, stops = (ALIKE[tag], SCOPES) if tag in ALIKE else ({"p"}, SCOPES) if tag in CLOSES_P else (set(), SCOPES)
        if not any(self.count[x] for x in wanted):
            return
        for at in range(len(self.open) - 1, 0, -1):
            name = self.page.elements[self.open[at]].tag
            if name in wanted:
                self.shut(at)
                if tag != "tr":
                    return
            elif name in stops:
                return

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS:
            self.flush()
            self.imply(tag)
        self.tags += 1
        if tag in VOID:
            return
        above = self.page.elements[self.open[-1]]
        named = {k: v or "" for k, v in attrs}
        silent = above.silent or tag in SILENT or "hidden" in named or named.get("aria-hidden", "").lower() == "true"
        never = tag in NEVER
        marked = tag in FURNITURE or named.get("role", "").lower() in ROLES or (tag == "header" and not above.region)
        if not marked and tag not in ("html", "body"):
            words = set().union(*(found_marks(named[k], tag, above.region) for k in ("class", "id") if named.get(k)))
            marked, never = bool(words), bool(words & NEVER_WORDS)
        mark = len(self.page.elements) if marked else above.mark
        self.page.elements.append(Element(tag, self.open[-1], above.depth + 1, silent, mark, never, above.region or tag in REGIONS))
        self.open.append(len(self.page.elements) - 1)
        self.count[tag] += 1
        self.links += tag == "a"

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in BLOCKS:
            self.flush()
        self.tags += 1
        for at in range(len(self.open) - 1, 0, -1) if self.count[tag] else ():
            if self.page.elements[self.open[at]].tag == tag:
                self.shut(at)
                return

    def handle_data(self, data):
        if not self.page.elements[self.open[-1]].silent:
            self.pieces.append(data)
            if self.links:
                self.linked += len(data)

    def close(self):
        super().close()
        self.flush()


def smooth(ratio: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing; at the ends the kernel's weight inside counts."""
    reach = int(np.ceil(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    inside = slice(reach, reach + len(ratio))
    return np.convolve(ratio, kernel)[inside] / np.convolve(np.ones(len(ratio)), kernel)[inside]


def holder(page: Page) -> int:
    """The marked element that holds the page, by characters outside links; 0: none."""
    mass = Counter()
    for x in page.lines:
        mass[page.elements[x.element].mark] += len(x.text) - x.linked
    total, below = mass.copy(), {}
    for i in range(len(page.elements) - 1, 0, -1):
        e = page.elements[i]
        if e.mark == i:
            above = page.elements[e.parent].mark
            total[above] += total[i]
            below.setdefault(above, []).append(i)
    chosen = 0
    while True:
        outside = mass[chosen]
        able = [i for i in below.get(chosen, ()) if total[i] > (0 if page.elements[i].never else PRIOR - 1) * outside and (not page.elements[i].never or not outside)]
        if not able:
            return chosen
        chosen = max(able, key=lambda i: (not page.elements[i].never, total[i], -i))


def clusters(lines: list[Line]) -> tuple[np.ndarray, np.ndarray]:
    """(content, core) of every line: whether its smoothed ratio reaches the threshold, and whether its own does too."""
    ratio = np.array([(len(x.text) - x.linked) / max(1, x.tags) for x in lines], float)
    smoothed = smooth(ratio)
    threshold = min(THRESHOLD * smoothed.std(), smoothed.max())
    content = smoothed >= threshold
    core = content & (ratio >= threshold) & (ratio > 0)
    return content, core if core.any() else content & (ratio == ratio[content].max())


def region_of(page: Page, chosen: list[int]) -> int:
    """The deepest element that can be a region and holds all of these; elements are numbered as they open, so the least and the greatest decide."""
    end = list(range(len(page.elements)))
    for i in range(len(end) - 1, 0, -1):
        above = page.elements[i].parent
        end[above] = max(end[above], end[i])
    at, last = min(chosen), max(chosen)
    while end[at] < last or page.elements[at].tag not in HOLDERS:
        at = page.elements[at].parent
    return at


def main_text(html: str | None) -> str:
    """The text of the page's content region."""
    events = Events()
    events.feed(html or "")
    events.close()
    page = events.page
    top = holder(page)
    lines = [x for x in page.lines if page.elements[x.element].mark == top]
    if not lines:
        return ""
    content, core = clusters(lines)
    chosen = region_of(page, [x.element for x, good in zip(lines, core, strict=True) if good])
    inside = np.zeros(len(page.elements), bool)
    for i, e in enumerate(page.elements):  # parents come first
        inside[i] = i == chosen or (i and inside[e.parent])
    first = int(core.argmax())
    held = [k for k, x in enumerate(lines) if content[k] and inside[x.element]]

    def belongs(k: int, x: Line) -> bool:
        e = page.elements[x.element]
        if not inside[x.element]:
            return content[k] and k < first and e.tag in TITLES
        return content[k] or e.region or (held[0] < k < held[-1] and x.linked < 0.8 * len(x.text))

    return " ".join(x.text for k, x in enumerate(lines) if belongs(k, x))


def extract(df: DataFrame, key: str, html: str, carry: list[str] = ()) -> DataFrame:
    """(key, *carry, text)."""
    rows = small_batches(df).select(F.col(f"`{key}`").alias("key"), *(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carry)), F.coalesce(F.col(f"`{html}`"), F.lit("")).alias("html"))
    kept = rows.schema.fields[:-1]

    def read(batches):
        for batch in slices(batches, "html"):
            texts = pa.array(map(main_text, batch.column("html").to_pylist()), pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), texts], [*(f.name for f in kept), "text"])

    out = rows.mapInArrow(read, ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in kept), "text string"]))
    return out.withColumnsRenamed({"key": key, **{f"c{i}": c for i, c in enumerate(carry)}})


def op4_extraction(spark, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return extract(pages, "page_id", "html", ["url"]).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))

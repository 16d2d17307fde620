"""Main text of HTML pages, from parser events and text-to-tag ratios.

The standard library's parser reads a page in portions and its events are cut into lines: the text between two block-level tags. Every line has
its text, the number of tags in it, how much of it is linked, and the element it stands in. Text-to-tag ratios of the lines that are not inside page furniture
are smoothed with a Gaussian and divided into two clusters by a threshold; the upper cluster is content. The region around it is then kept as
a whole: article and main elements, unless they hold hardly any of the content; or else the innermost element that holds most of the content, and for content outside it
the elements found in the same way there, until no content line is left out. So short lines of an article stay, and nothing is capped. Content beside the article
elements is kept too where it is a good part of all content. A table, list or quotation is kept whole; headings that come directly before kept lines stay. Lines that are
mostly links are left out of a page without such elements, unless they are headings or paragraphs.

Furniture are elements that are so by name, and elements that are hidden. Headers, footers, asides, forms, and elements with a telling role, or class or id (a word of it,
but not in names such as with-sidebar or has-header) are furniture unless they wrap the page: unless they hold half of its text and an article or main element, or
(but for header, footer and aside elements) WHOLE of its text with a line of prose.
Headings and paragraphs are furniture only by the class or id of an advert, and in an article or main element the word header makes none. A byline is text of the article, and so is
a list of links in it.

Elements are records with a link to the one around them, and inline elements that aren't links have none, so unclosed tags cost no more than others. What is summed over elements is
added up from the last one to the first.

Defined results: a null or empty page has the empty text; a page without main text too; unclosed and stray tags are tolerated; text after an
unclosed script is script; blocks more than DEPTH deep count as part of the one around them. Other columns are carried along by `extracted`, but for a text, which the new one replaces.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser
from math import exp, log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.arrow import in_batches, numbered, renamed
from quillspark.llm.text import pieces

# Names of HTML elements, and words that mark furniture in roles, classes and ids.
BLOCKS = set("address article aside blockquote body br canvas caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol option p pre section select summary table tbody td template textarea tfoot th thead title tr ul video audio object iframe svg".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
FURNITURE = set("head script style noscript template nav button select textarea option svg canvas iframe object video audio dialog menu".split())
EDGES = set("header footer aside".split())
ROLES = set("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search status toolbar".split())
MARKS = set("ad ads adbox adslot adunit advert adverts advertisement advertising alert banner billboard breadcrumb breadcrumbs captcha comment comments commentlist commentary consent cookie cookies copyright dialog disclaimer discussion discussions disqus footer gdpr header login masthead menu modal nav navbar navigation navi newsletter notice notification overlay pager pagination popup promo promoted promotion recommended recommendations related reply replies respond responses search share sharing shares sidebar signin signup skip social sponsor sponsored sponsors subscribe subscription tagcloud tags teaser thread threads toc toolbar tracking widget widgets".split())
#: First words of names that tell what a page has, not what an element is.
MODIFIERS = set("with has no without is not show hide".split())
#: Words that mark an article element as none of the page's own, and a heading or paragraph as none of the text.
ARTICLE_MARKS = set("comment comments reply ad promo teaser related card".split())
ADVERT_MARKS = set("ad ads advert adverts advertisement advertising sponsor sponsored sponsors promo promoted promotion share shares sharing newsletter subscribe cookie cookies captcha".split())
#: Elements whose class or id says nothing of their use, and whose text stays though it's linked.
PROSE = set("h1 h2 h3 h4 h5 h6 p".split())
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
PORTION = 1 << 16
#: Of the Gaussian, in lines; share of the content that the region of a page without an article must hold; share of linked text that makes a menu.
SIGMA, SHARE, LINKED = 1.5, 0.8, 0.5
#: Share of a page's text that an element holds which wraps the page, and which wraps it if it has an article inside.
WHOLE, HALF = 0.9, 0.5
#: Characters of a line that is prose for sure.
LONG = 80


#: Share of the content that article elements hold at least, if they decide alone; blocks around a block that have a record of their own.
OUTSIDE, DEPTH = 0.67, 400
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
#: Elements that are kept whole.
WHOLES = set("table ul ol dl blockquote pre".split())


class Element:
    """An open or closed element. furniture: 2 if it is furniture, 1 if it is unless it wraps the page; mass and prose: of all lines in it; dropped, main: it or one around it is furniture, is an article."""

    __slots__ = ("tag", "parent", "furniture", "main", "mass", "prose", "dropped", "holds_main", "depth")

    def __init__(self, tag: str, parent: Element | None, furniture: int) -> None:
        self.tag, self.parent, self.furniture = tag, parent, furniture
        self.main = self.prose = self.dropped = self.holds_main = False
        self.mass = 0
        self.depth = parent.depth + 1 if parent else 0

    def ancestors(self) -> Iterator[Element]:
        """This element and those around it."""
        element: Element | None = self
        while element is not None:
            yield element
            element = element.parent


class Line:
    __slots__ = ("text", "tags", "linked", "hidden", "element", "prose")

    def __init__(self, text: str, tags: int, linked: int, hidden: bool, element: Element, prose: bool) -> None:
        self.text, self.tags, self.linked, self.hidden, self.element, self.prose = text, tags, linked, hidden, element, prose

    @property
    def menu(self) -> bool:
        return self.linked > LINKED * len(self.text)

    @property
    def mass(self) -> int:
        """Characters of text, if it isn't a menu's."""
        return 0 if self.hidden or self.menu else len(self.text)


def names_furniture(value: str, marks: set[str]) -> bool:
    """Whether a class or id has a telling word; in a name that begins with a modifier no word tells."""
    for name in value.split():
        words = [w.lower() for w in _WORDS.findall(name)]
        if words and (len(words) == 1 or words[0] not in MODIFIERS) and any(w in marks for w in words):
            return True
    return False


def furniture_of(tag: str, attrs: list[tuple[str, str | None]], marks: set[str] = MARKS) -> int:
    """2: an element is furniture; 1: it is unless it wraps the page; 0: it isn't."""
    if tag in FURNITURE:
        return 2
    found = int(tag in EDGES or tag == "form")
    for name, value in attrs:
        value = value or ""
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and _HIDDEN.search(value)):
            return 2
        if name == "role" and value.strip().lower() in ROLES:
            found = 1
        if name in ("class", "id") and tag not in ("html", "body", "article", "main") and names_furniture(value, ADVERT_MARKS if tag in PROSE else marks):
            found = 1
        if name in ("class", "id") and tag == "article" and names_furniture(value, ARTICLE_MARKS):
            found = 1
    return found


class Lines(HTMLParser):
    """Events to lines and elements."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.elements = [Element("", None, 0)]
        self.open = [self.elements[0]]
        self.count: Counter = Counter()  # open elements by tag
        self.tags = self.linked = self.hidden = self.inside = self.prose = 0
        self.parts: list[str] = []

    def cut(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.lines.append(Line(text, self.tags, self.linked, self.hidden > 0, self.open[-1], self.prose > 0))
        self.parts, self.tags, self.linked = [], 0, 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        # the heading block of an article is part of it
        furniture = furniture_of(tag, attrs)
        if furniture == 1 and self.inside:
            furniture = 0 if tag == "header" else furniture_of(tag, attrs, MARKS - {"header"})
        if tag in BLOCKS or furniture:
            self.cut()
        self.tags += 1
        if tag in VOID:
            return
        if tag == "p":
            self.close_open("p", {"div", "article", "section", "main", "body", "td", "li", "blockquote", "aside", "header", "footer"})
        elif tag == "li":
            self.close_open("li", {"ul", "ol", "menu"})
        elif tag == "body":
            self.close_open("head", {"html"})
        elif tag == "a":
            self.close_open("a", set())
        if not furniture and (tag not in BLOCKS or len(self.open) > DEPTH) and tag not in ("a", "article", "main"):
            return
        element = Element(tag, self.open[-1], furniture)
        self.elements.append(element)
        self.open.append(element)
        self.counted(element, 1)
        element.main = tag in ("article", "main") and not furniture

    def counted(self, element: Element, by: int) -> None:
        self.count[element.tag] += by
        self.hidden += by * (element.furniture == 2)
        self.inside += by * (element.tag in ("article", "main"))
        self.prose += by * (element.tag in PROSE)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def close_open(self, tag: str, until: set[str]) -> None:
        """Closes an element that the next tag ends, if none of until has begun in it."""
        for i in range(len(self.open) - 1, 0, -1) if self.count[tag] else ():
            if self.open[i].tag == tag:
                self.pop_to(i)
                return
            if self.open[i].tag in until:
                return

    def pop_to(self, at: int) -> None:
        if any(element.furniture for element in self.open[at:]):
            self.cut()
        for element in self.open[at:]:
            self.counted(element, -1)
        del self.open[at:]

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self.cut()
        self.tags += 1
        for i in range(len(self.open) - 1, 0, -1) if self.count[tag] else ():
            if self.open[i].tag == tag:
                self.pop_to(i)
                return

    def handle_data(self, data: str) -> None:
        self.parts.append(data)
        if self.count["a"]:
            self.linked += len(data.strip())


def lines_of(html: str) -> list[Line]:
    """The lines of a page that aren't furniture; their elements know whether they are in an article or main element."""
    parser = Lines()
    for i in range(0, len(html), PORTION):
        parser.feed(html[i : i + PORTION])
    parser.close()
    parser.cut()
    for line in parser.lines:
        line.element.mass += line.mass
        line.element.prose |= line.mass >= LONG
    for element in reversed(parser.elements[1:]):
        parent = element.parent
        parent.mass += element.mass
        parent.prose |= element.prose
        parent.holds_main |= element.main or element.holds_main
    total = parser.elements[0].mass
    for element in parser.elements[1:]:
        wraps = element.mass >= HALF * total if element.holds_main else element.prose and element.tag not in EDGES and element.mass >= WHOLE * total
        element.dropped = element.parent.dropped or (element.furniture == 1 and not (total and wraps))
        element.main = not element.dropped and (element.main or element.parent.main)
    return [line for line in parser.lines if not line.hidden and not line.element.dropped]


def smoothed(values: list[float]) -> list[float]:
    reach = int(3 * SIGMA)
    kernel = [exp(-(i * i) / (2 * SIGMA * SIGMA)) for i in range(-reach, reach + 1)]
    out = []
    for i in range(len(values)):
        low, high = max(0, i - reach), min(len(values), i + reach + 1)
        weights = kernel[low - i + reach : high - i + reach]
        out.append(sum(w * v for w, v in zip(weights, values[low:high])) / sum(weights))
    return out


def threshold(values: list[float]) -> float:
    """Midway between the means of the two clusters that it makes."""
    at = sum(values) / len(values)
    for _ in range(50):
        low, high = [v for v in values if v < at], [v for v in values if v >= at]
        if not low or not high:  # all are alike
            return min(values)
        new = (sum(low) / len(low) + sum(high) / len(high)) / 2
        if abs(new - at) < 1e-9:
            break
        at = new
    return at


def main_text(html: str | None) -> str:
    """The main text of one page."""
    if not html:
        return ""
    lines = lines_of(html)
    if not lines:
        return ""
    ratios = smoothed([log(1 + (len(line.text) - line.linked) / (1 + line.tags)) for line in lines])
    edge = threshold(ratios)
    content = [line for line, r in zip(lines, ratios) if r >= edge and not line.menu]
    inside = sum(len(line.text) for line in lines if line.element.main and not line.menu)
    outside = [line for line in content if not line.element.main]
    if inside and sum(len(line.text) for line in outside) <= (1 - OUTSIDE) / OUTSIDE * inside:
        kept = [line.element.main for line in lines]
    elif content:
        regions, alone = regions_of(outside)
        within: dict[int, bool] = {}
        kept = [line.element.main or ((not regions or in_any(line.element, regions, within) or id(line) in alone) and (line.prose or not line.menu)) for line in lines]
    else:
        return ""
    for i in range(len(lines) - 2, -1, -1):  # headings directly before what is kept
        if kept[i + 1] and not kept[i] and lines[i].element.tag in HEADINGS:
            kept[i] = True
    return " ".join(line.text for line, k in zip(lines, kept) if k)


def in_any(element: Element, regions: set[int], known: dict[int, bool]) -> bool:
    """Whether an element is one of the regions (by id()), or in one."""
    path = []
    for e in element.ancestors():
        if id(e) in known or id(e) in regions:
            found = known.get(id(e), True)
            break
        path.append(id(e))
    else:
        found = False
    known.update((x, found) for x in path)
    return found


def lifted(region: Element) -> Element:
    """The table, list or quotation around a region, or the region."""
    whole = region
    for element in region.ancestors():
        if element.tag in WHOLES:
            whole = element
    return whole


def regions_of(content: list[Line]) -> tuple[set[int], set[int]]:
    """Elements that hold the content lines, and the lines beside those elements (both by id()); no element if none holds most of the content."""
    regions: set[int] = set()
    alone: set[int] = set()
    own: dict[int, tuple[Element, list[Line]]] = {}
    for line in content:
        own.setdefault(id(line.element), (line.element, []))[1].append(line)
    groups = [(list(own.values()), 0)]  # elements with their lines, and how deep the elements are that hold a region already
    while groups:
        group, depth = groups.pop()
        held: dict[int, list] = {}
        total = 0
        for element, lines in group:
            size = sum(len(line.text) for line in lines)
            total += size
            for e in element.ancestors():
                if e.depth <= depth:
                    break
                held.setdefault(id(e), [e, 0])[1] += size
        region = max((e for e, size in held.values() if size >= SHARE * total), key=lambda e: e.depth, default=None)
        if region is None:
            return set(), set()
        region = lifted(region)
        regions.add(id(region))
        path = {id(e) for e in region.ancestors()}
        left: dict[int, tuple[Element, list]] = {}
        for element, lines in group:
            top = None
            for e in element.ancestors():
                if id(e) in path:
                    if id(e) != id(region):
                        if top is None:
                            alone.update(map(id, lines))
                        else:
                            left.setdefault(id(top), (top, []))[1].append((element, lines))
                    break
                top = e
        groups += [(lines, top.depth - 1) for top, lines in left.values()]
    return regions, alone


def extracted(pages: DataFrame, html: str = "html", carry: list[str] | None = None) -> DataFrame:
    """pages with text; carry: the columns to keep, if not all."""
    carry = pages.columns if carry is None else carry
    plain, names = numbered(pages)
    at = names[pages.columns.index(html)]
    kept = [names[pages.columns.index(c)] for c in carry]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, at):
                texts = pa.array(map(main_text, part.column(at).to_pylist()), pa.string())
                yield pa.RecordBatch.from_arrays([*map(part.column, kept), texts], names=[*kept, "text"])

    return renamed(in_batches(plain, run, plain.select(kept).schema.add("text", "string")), carry, 1)


def page_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    found = extracted(pages.select("page_id", "url", "html"), carry=["page_id", "url"])
    return found.withColumn("n_chars", F.length("text").cast("long"))

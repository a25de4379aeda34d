"""Operator 3, HTML extraction: parser events, text-to-tag ratio, Gaussian smoothing, threshold clustering.

A page is streamed through the standard library's event parser.  Events fill
lines: a line is the text between two block boundaries, with the number of
tags met in it and the chain of open containers.  Lines inside boilerplate
elements (navigation, header, footer, aside, form, script, style) never count.
Class and id words (adverts, notices, comments) are evidence: such an element
does not count either, unless it holds the article or most of the page's
clustered text (``released``).  The text-to-tag ratio of the other lines is
smoothed over the page with a Gaussian; lines above the threshold form the
content clusters.  A page's content is the smallest container that holds all of
the clustered text, or its articles (else ``main``) if one of them holds more
than half of it: all lines, short ones included.  A container that is not an
article or ``main`` may hold menus and page ends, which go (``boilerplate``):
unclustered lines of several links with no other text, runs of such lines, and
copyright lines behind all other text.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import text_or_empty

# Element names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("""address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure
    footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead
    title tr ul""".split())
SKIPPED = frozenset("""script style noscript template head title nav footer aside form button select textarea input label iframe object
    svg canvas audio video dialog menu""".split())
CLOSES_P = BLOCK - {"body", "html", "title", "li", "td", "th", "tr", "dd", "dt", "tbody", "thead", "tfoot", "caption"}
SECTION = frozenset("article main body section div td blockquote".split())
ONE_OPEN = {"li": {"ul", "ol", "menu"}, "dd": {"dl"}, "dt": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"},
            "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog alertdialog menu menubar".split())
NOISE = re.compile(r"""(?:^|[\s_-])(?:ads?|adverts?|advert(?:isement|ising)|sponsor(?:ed)?|promo(?:tion)?s?|banner|cookies?|consent|gdpr|
    notice|notification|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|paywall|sidebar|side-?bar|widget|
    nav|navbar|navigation|menu|breadcrumbs?|pagination|pager|footer|header|masthead|comments?|commentlist|disqus|replies|reply|responses|discussion|
    related|recommend(?:ed|ations)?|share|sharing|social|toolbar|skip-?link|hidden)(?:$|[\s_-])""", re.I | re.X)
# an article element of these classes is a comment or a teaser
ASIDE_ARTICLE = re.compile(r"(?:^|[\s_-])(?:ads?|adverts?|advert(?:isement|ising)|sponsor(?:ed)?|promo(?:tion)?s?|comments?|replies|reply|responses|discussion|related|"
                           r"recommend(?:ed|ations)?|teasers?)(?:$|[\s_-])", re.I)
COPYRIGHT = re.compile(r"(?:©|\(c\)|copyright\b|all rights reserved\b)", re.I)
MODIFIED = re.compile(r"(?:^|[_-])(?:has|no|with|without)[_-].*", re.I | re.S)  # has-sidebar, no-comments: what the element is not
HIDDEN = re.compile(r"display\s*:\s*none", re.I)
SIGMA = 1.0  # of the smoothing, in lines


@dataclass(slots=True)
class Line:
    text: list[str] = field(default_factory=list)
    tags: int = 0
    linked: int = 0  # characters inside links
    links: int = 0
    holder: int = -1  # number of the innermost open section container
    mark: int = -1  # number of the innermost open element with boilerplate classes


@dataclass(slots=True)
class Mark:
    """An element with a boilerplate word in its class or id, and what it holds."""
    outer: int  # the mark around it, or -1
    listing: bool  # the word is one of comments, teasers or adverts
    main: bool = False
    article: bool = False
    h1: bool = False


class LineParser(HTMLParser):
    """Lines of a page, from start, end and data events."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool, int, int]] = []  # name, boilerplate, and the innermost container and mark (or -1) from here on
        self.count: Counter[str] = Counter()  # open elements by name
        self.noise = 0  # open boilerplate elements
        self.lines: list[Line] = []
        self.line = Line()
        self.kinds: list[str] = []  # name of each container
        self.outer: list[int] = []  # the container around each container, or -1
        self.marks: list[Mark] = []

    def place(self) -> tuple[int, int]:
        """Innermost open container and mark."""
        return self.open[-1][2:] if self.open else (-1, -1)

    def end_line(self) -> None:
        if self.line.text:
            self.line.holder, self.line.mark = self.place()
            self.lines.append(self.line)
            self.line = Line()

    def pop(self) -> None:
        name, noise, _, _ = self.open[-1]
        if name in BLOCK:
            self.end_line()
        self.open.pop()
        self.count[name] -= 1
        self.noise -= noise

    def close_to(self, name: str, stop: frozenset[str] | set[str]) -> None:
        if not self.count[name]:
            return
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == name:
                while len(self.open) > i:
                    self.pop()
                return
            if self.open[i][0] in stop:
                return

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.line.tags += 1
        if tag in CLOSES_P:
            self.close_to("p", SECTION | {"li", "td", "th", "table"})
        if tag in ONE_OPEN:
            for other in (("td", "th") if tag in ("td", "th") else ("dd", "dt") if tag in ("dd", "dt") else (tag,)):
                self.close_to(other, ONE_OPEN[tag])
        if tag in BLOCK:
            self.end_line()
        if tag == "br" and not self.noise and self.line.text:
            self.line.text.append(" ")
        if tag in VOID:
            return
        noise, mark = tag in SKIPPED, None
        holder, marked = self.place()
        if attrs and tag != "a" and not noise:
            a = dict(attrs)
            noise, mark = self.invisible(a), self.marked(tag, a, marked)
        if tag == "header" and not noise:  # an article's own header holds its title
            noise = not self.in_article()
        if mark is None and not noise and tag in ("article", "main", "h1"):
            m = marked
            while m >= 0 and not getattr(self.marks[m], tag):  # marks around one that has it have it too
                setattr(self.marks[m], tag, True)
                m = self.marks[m].outer
        if tag in SECTION:
            self.kinds.append(tag)
            self.outer.append(holder)
            holder = len(self.kinds) - 1
        if mark is not None:
            self.marks.append(mark)
            marked = len(self.marks) - 1
        self.line.links += tag == "a"
        self.open.append((tag, noise, holder, marked))
        self.count[tag] += 1
        self.noise += noise

    def in_article(self) -> bool:
        return self.count["article"] + self.count["main"] > 0

    @staticmethod
    def invisible(a: dict[str, str | None]) -> bool:
        """Whether an element's attributes give it a boilerplate role or hide it."""
        return ((a.get("role") or "").lower() in ROLES or "hidden" in a or (a.get("aria-hidden") or "").lower() == "true"
                or bool(HIDDEN.search(a.get("style") or "")))

    def marked(self, tag: str, a: dict[str, str | None], outer: int) -> Mark | None:
        """The mark of an element whose class or id holds a boilerplate word, modifiers left out."""
        names = f"{a.get('class') or ''} {a.get('id') or ''}"
        if tag in ("html", "body", "main") or not (ASIDE_ARTICLE if tag == "article" else NOISE).search(names):
            return None
        names = " ".join(MODIFIED.sub("", name) for name in names.split())
        listing = bool(ASIDE_ARTICLE.search(names))
        found = {w.strip(" _-").lower() for w in NOISE.findall(names)}
        if (tag == "article" or not found) and not listing or found == {"header"} and self.in_article():
            return None
        return Mark(outer, listing)

    def updatepos(self, i: int, j: int) -> int:
        return j  # line numbers are not needed

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.line.tags += 1
        self.close_to(tag, frozenset() if tag in BLOCK or tag in SKIPPED else BLOCK)

    def handle_data(self, data: str) -> None:
        if not self.noise:
            if self.line.text or not data.isspace():
                self.line.text.append(data)
                if self.count["a"]:
                    self.line.linked += len("".join(data.split()))


def smooth(ratio: list[float], sigma: float = SIGMA) -> list[float]:
    """Gaussian smoothing over neighbouring lines, weights renormalised at the ends."""
    reach = max(1, math.ceil(2 * sigma))
    kernel = [math.exp(-(d * d) / (2 * sigma * sigma)) for d in range(reach + 1)]
    out = []
    for i in range(len(ratio)):
        lo, hi = max(0, i - reach), min(len(ratio), i + reach + 1)
        weights = [kernel[abs(i - j)] for j in range(lo, hi)]
        out.append(sum(w * r for w, r in zip(weights, ratio[lo:hi], strict=True)) / sum(weights))
    return out


def clusters(texts: list[str], lines: list[Line]) -> list[bool]:
    """Whether each line's smoothed text-to-tag ratio is above the threshold."""
    ratio = smooth([len(t) / max(1, n.tags) for t, n in zip(texts, lines, strict=True)])
    mean = sum(ratio) / len(ratio)
    threshold = min(mean, math.sqrt(sum((r - mean) ** 2 for r in ratio) / len(ratio)) or mean)
    return [r >= threshold for r in ratio]


def inside(outer: list[int], chosen: set[int]) -> list[bool]:
    """Whether each element is one of ``chosen`` or inside one; an element's number is above its outer one's."""
    out: list[bool] = []
    for n, o in enumerate(outer):
        out.append(n in chosen or o >= 0 and out[o])
    return out


def sum_up(held: list[int], outer: list[int]) -> None:
    """Add what each element holds to those around it."""
    for n in range(len(held) - 1, -1, -1):
        if outer[n] >= 0:
            held[outer[n]] += held[n]


def boilerplate(texts: list[str], lines: list[Line], clustered: list[bool]) -> list[bool]:
    """Lines of the chosen container, not an article or ``main``, that are a menu or the end of the page.

    A line is linked if all of it is links.  Unclustered linked lines go if they
    hold several links or stand next to another linked line; a single linked
    line in the text stays.  Copyright lines go if only such lines and menus
    follow.  Lines that would leave nothing else all stay.
    """
    linked = [n.links > 0 and n.linked >= len("".join(t.split())) for t, n in zip(texts, lines, strict=True)]
    near = lambda i: i > 0 and linked[i - 1] or i + 1 < len(linked) and linked[i + 1]
    out = [linked[i] and not clustered[i] and (lines[i].links > 1 or near(i)) for i in range(len(lines))]
    for i in range(len(lines) - 1, -1, -1):
        if not out[i]:
            if not COPYRIGHT.match(texts[i]):
                break
            out[i] = True
    return [False] * len(out) if all(out) else out


def released(parser: LineParser, texts: list[str], lines: list[Line]) -> set[int]:
    """Marked elements that count nevertheless.

    Those that hold ``main``, or an unmarked ``article`` (if their word is one of
    comments, teasers or adverts, only with most of the clustered text), or
    most of the clustered text and the page's title or all of that text; with
    most of it alone, if no word of comments and no article or ``main`` is
    elsewhere: a long discussion beside the article stays out.
    """
    held = [0] * len(parser.marks)
    total, elsewhere = 0, False
    named = inside(parser.outer, {n for n, kind in enumerate(parser.kinds) if kind in ("article", "main")})
    for text, line, hit in zip(texts, lines, clusters(texts, lines), strict=True):
        if hit:
            total += len(text)
            if line.mark >= 0:
                held[line.mark] += len(text)
            elsewhere |= line.mark < 0 <= line.holder and named[line.holder]
    sum_up(held, [mark.outer for mark in parser.marks])
    out = set()
    for m, mark in enumerate(parser.marks):
        most = 2 * held[m] > total
        if mark.main or mark.article and (most or not mark.listing) or most and (mark.h1 or held[m] == total or not (mark.listing or elsewhere)):
            out.add(m)
    return out


def extract_text(html: str | None) -> str:
    """Main text of a page: its blocks in page order, joined by two newlines; empty if there is none."""
    parser = LineParser()
    parser.feed(html or "")
    parser.close()
    parser.end_line()
    texts, lines = [], []
    for line in parser.lines:
        text = " ".join("".join(line.text).split())
        if text:
            texts.append(text)
            lines.append(line)
    if lines and parser.marks:
        counted = released(parser, texts, lines)
        dropped = inside([mark.outer for mark in parser.marks], set(range(len(parser.marks))) - counted)
        keep = [line.mark < 0 or not dropped[line.mark] for line in lines]
        texts, lines = [t for t, k in zip(texts, keep, strict=True) if k], [n for n, k in zip(lines, keep, strict=True) if k]
    if not lines:
        return ""
    clustered = clusters(texts, lines)
    held = [0] * len(parser.kinds)
    total = 0
    for text, line, hit in zip(texts, lines, clustered, strict=True):
        if hit:
            total += len(text)
            if line.holder >= 0:
                held[line.holder] += len(text)
    sum_up(held, parser.outer)
    chosen: set[int] = set()
    for kind in ("article", "main"):
        named = [n for n, size in enumerate(held) if size and parser.kinds[n] == kind]
        if not chosen and any(2 * held[n] > total for n in named):
            chosen = set(named)  # with the other articles that hold clustered text
    marked_up = bool(chosen)
    if not chosen:
        # the smallest container with all of the clustered text, whole; the page itself if no container has it
        chosen = {max((n for n, size in enumerate(held) if size == total), default=-1)}
    within = inside(parser.outer, chosen)
    kept = [i for i, line in enumerate(lines) if -1 in chosen or line.holder >= 0 and within[line.holder]]
    ends = [False] * len(kept) if marked_up else boilerplate([texts[i] for i in kept], [lines[i] for i in kept], [clustered[i] for i in kept])
    return "\n\n".join(texts[i] for i, end in zip(kept, ends, strict=True) if not end)


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per input row: id, url, text, n_chars.

    Null and empty pages have an empty text.  Rows are independent, so
    repeated rows give repeated results; an empty table gives an empty result;
    other columns are not read.  Only one pass and no shuffle.
    """
    src = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), text_or_empty(html_col).alias("html"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = [extract_text(h) for h in b["html"]]
            yield pd.DataFrame({"id": b["id"], "url": b["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    types = {f.name: f.dataType.simpleString() for f in src.schema.fields}
    return src.mapInPandas(run, f"id {types['id']}, url {types['url']}, text string, n_chars long")


def op3_html(pages: DataFrame) -> DataFrame:
    return extract_pages(pages).withColumnRenamed("id", "page_id")

"""Main text of web pages from tag ratios.

The standard library's parser turns a page into events, and these into lines: the text of one block each, with the
number of tags met since the last. The ratio of text to tags is smoothed over neighbouring lines with a Gaussian and
weighed: lines in <article> and <main> count double, lines in elements whose name or class tells that they aren't the
article (menus, adverts, comments and the like) a small part, so that they pass only where their ratios are far above the
page's best region. The header of an article is part of it; its footer and its warnings count half. The page's regions (articles,
sections, divisions and cells of two lines or more, and each such element) fall into two clusters: content are those whose
mean ratio is above a threshold, a share of the standard deviation over all lines. All lines of a content region are taken,
short ones too. A page of nothing but such elements has no content.

Only what holds no readable text of the page (scripts, styles, forms and their controls, embedded media, the head) is
left out before ratios are looked at. An element that only its class, id or role tells to be no content weighs as any
other if it holds most of the page's text.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slabs, table

#: Standard deviation of the Gaussian in lines, and the threshold in standard deviations of the smoothed ratios.
SIGMA, THRESHOLD = 1.0, 0.5
#: What the ratio of a line counts in <article> or <main>; what it counts of that in elements that aren't the article, and
#: in those of an article that may be.
WEIGHT, FOREIGN, DOUBTFUL = 2.0, 0.02, 0.5

# Elements of HTML by what they mean for extraction.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
NEVER = frozenset(
    "button canvas datalist form head iframe input map meter noscript object option optgroup progress script select style svg template textarea title video audio math".split()
)
AROUND = frozenset("aside dialog footer header menu nav search".split())
REGIONS = frozenset("article main section div td body".split())
#: Words in the class, id or role of an element that isn't the article.
MARKS = frozenset(
    "ad ads adbox adsense adslot advert advertisement adverts advertising alert banner breadcrumb breadcrumbs byline-share comment comments commentlist complementary contentinfo "
    "consent cookie cookies copyright disclaimer disqus dropdown footer gdpr header hidden login masthead menu modal nav navbar navigation newsletter notice notices notification "
    "overlay pager pagination popup promo promoted promotion recommended related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe "
    "subscription teaser toolbar tracking warning widget".split()
)
#: Of these, what an article may have of its own.
DOUBT = frozenset("alert copyright disclaimer footer header warning".split())
#: First parts of class names that speak of a page with or without such elements.
UNMARKED = frozenset("content has is layout main no not page post with without".split())
_CLOSES_P = BLOCKS - {"body", "html", "caption", "tbody", "td", "tfoot", "th", "thead", "tr"}
_OWN = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "option": {"option"}}
_FENCE = frozenset("article aside body div dl footer form header html main nav ol section table ul".split())


def hidden(attributes: list[tuple[str, str | None]]) -> bool:
    return any(name == "hidden" or (name == "aria-hidden" and value == "true") for name, value in attributes)


def marks(attributes: list[tuple[str, str | None]]) -> set[str]:
    """The words of MARKS in the class, id and role."""
    found = set()
    for name, value in attributes:
        if value and name in ("class", "id", "role"):
            for word in value.lower().split():
                parts = re.split(r"[-_:\d]+", word)
                found |= MARKS & {word}
                if parts[0] not in UNMARKED:
                    found |= MARKS.intersection(parts)
    return found


class Lines(HTMLParser):
    """The lines of a page: text, tags since the last line, region and weight; text in elements that are never content is left out."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool, int]] = []
        self.count: dict[str, int] = {}
        self.never = 0
        # the open regions, whether each is in an article; the region around each
        self.regions: list[tuple[int, bool]] = [(0, False)]
        self.outer, self.whole = [0], [True]
        # elements that aren't the article by number: the one around each, their characters of text, whether their name says so, what they count; 0 is the page
        self.mark, self.around, self.size, self.sure, self.share = 0, [0], [0], [False], [1.0]
        self.tags = 0
        self.parts: list[tuple[str, int]] = []
        self.lines: list[tuple[list[tuple[str, int]], int, int, bool]] = []

    def end_line(self) -> None:
        if any(not text.isspace() for text, _ in self.parts):
            self.lines.append((self.parts, self.tags, *self.regions[-1]))
            self.parts, self.tags = [], 0
        else:
            self.parts.clear()

    def push(self, tag: str, never: bool, share: float = 1.0) -> None:
        self.open.append((tag, never, self.mark))
        self.count[tag] = self.count.get(tag, 0) + 1
        self.never += never
        if share < 1:
            self.around.append(self.mark)
            self.size.append(0)
            self.sure.append(tag in AROUND)
            self.share.append(share)
            self.mark = len(self.size) - 1
        if tag in REGIONS:
            number, article = self.regions[-1]
            if not article or tag == "article":
                self.outer.append(number)
                self.whole.append(tag == "article")
                number, article = len(self.outer) - 1, article or tag in ("article", "main")
            self.regions.append((number, article))

    def shares(self, tag: str, attributes: list[tuple[str, str | None]]) -> float:
        """What lines in the element count by its name, class, id and role."""
        found = marks(attributes) | AROUND & {tag}
        within = self.regions[-1][1]
        if not found or within and found == {"header"}:
            return 1.0
        return DOUBTFUL if within and found <= DOUBT else FOREIGN

    def pop(self) -> str:
        tag, never, self.mark = self.open.pop()
        self.count[tag] -= 1
        self.never -= never
        if tag in REGIONS:
            self.regions.pop()
        return tag

    def close_within(self, tags: set[str]) -> None:
        """Ends an open element of tags that its successor ends without a tag, with all in it."""
        if any(self.count.get(t) for t in tags):
            for i in range(len(self.open) - 1, -1, -1):
                if self.open[i][0] in tags:
                    while len(self.open) > i:
                        self.pop()
                    return
                if self.open[i][0] in _FENCE:
                    return

    def handle_starttag(self, tag: str, attributes: list[tuple[str, str | None]]) -> None:
        self.tags += not self.never
        if tag in BLOCKS:
            self.end_line()
            if tag in _CLOSES_P:
                self.close_within({"p"})
            if tag in _OWN:
                self.close_within(_OWN[tag])
        elif tag == "br":
            self.parts.append((" ", self.mark))
        if tag in ("body", "html") and self.count.get(tag):
            return
        if tag == "body":
            while self.count.get("head"):
                self.pop()
        if tag not in VOID:
            page = tag in ("html", "body")
            never = tag in NEVER or (not page and hidden(attributes))
            self.push(tag, never, 1.0 if page or never or self.never else self.shares(tag, attributes))

    def handle_startendtag(self, tag: str, attributes: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attributes)
        if tag not in VOID and tag not in BLOCKS:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.tags += not self.never
        if tag in BLOCKS:
            self.end_line()
        if self.count.get(tag):
            while self.pop() != tag:
                pass

    def handle_data(self, data: str) -> None:
        if not self.never:
            self.parts.append((data, self.mark))
            self.size[self.mark] += len(data.strip())

    def of(self, html: str) -> list[tuple[str, int, tuple[int, int], float]]:
        """(text, tags, region, weight) of each line. A line's inline parts that aren't the article are a line of their own."""
        self.feed(html)
        self.close()
        self.end_line()
        for i in range(len(self.size) - 1, 0, -1):
            self.size[self.around[i]] += self.size[i]
        # the outermost such element of those that count least
        foreign, counts = [0], [1.0]
        for i in range(1, len(self.size)):
            outer = foreign[self.around[i]]
            own = (self.sure[i] or 2 * self.size[i] <= self.size[0]) and self.share[i] < counts[outer]
            foreign.append(i if own else outer)
            counts.append(self.share[i])
        # a region of one line, such as a cell or an item, is part of the one around it
        held = [0] * len(self.outer)
        for _, _, region, _ in self.lines:
            held[region] += 1
        final = list(range(len(held)))
        for i in range(len(held) - 1, 0, -1):
            if held[i] < 2 and not self.whole[i]:
                final[i] = self.outer[i]
                held[self.outer[i]] += held[i]
        for i in range(1, len(held)):
            final[i] = final[final[i]] if final[i] != i else i
        out = []
        for parts, tags, region, article in self.lines:
            for mark in dict.fromkeys(foreign[m] for _, m in parts):
                if text := " ".join("".join(part for part, m in parts if foreign[m] == mark).split()):
                    out.append((text, tags, (mark, final[region]), counts[mark] * (WEIGHT if article else 1.0)))
        return out


def smoothed(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """The ratios under a Gaussian of three standard deviations to either side, cut off at the ends of the page."""
    reach = math.ceil(3 * sigma)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    weights = np.convolve(np.ones(len(ratios)), kernel)[reach : reach + len(ratios)]
    return np.convolve(ratios, kernel)[reach : reach + len(ratios)] / weights


def main_text(html: str) -> str:
    """The content blocks of a page, two line feeds between them; empty if it has none."""
    lines = Lines().of(html)
    if not lines:
        return ""
    ratios = smoothed(np.array([len(text) / max(1, tags) for text, tags, _, _ in lines])) * np.array([weight for *_, weight in lines])
    number = {region: i for i, region in enumerate(dict.fromkeys(region for _, _, region, _ in lines))}
    of = np.array([number[region] for _, _, region, _ in lines])
    mean = np.bincount(of, ratios) / np.bincount(of)
    own = np.array([not mark for mark, _ in number])
    if not own.any():
        return ""
    # the best region without such a name is content wherever the threshold lies, and what the others are held against
    best = mean[own].max()
    content = mean > min(THRESHOLD * ratios.std(), best * (1 - 1e-9))
    content &= own | (mean > THRESHOLD * best)
    return "\n\n".join(text for (text, *_), r in zip(lines, of) if content[r])


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) for each row.

    Null and empty pages, and pages without content, have the empty text. Very long pages are parsed whole, one at a
    time. Regions with equal ratios fall on the same side. Rows that repeat keep a row each, rows without an id or
    address as well; other columns of pages, whatever their names, are not looked at. An empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (ids, urls), pages in slabs(batches, ["page_id", "url", "html"], "html"):
            texts = [main_text(p.decode()) for p in pages]
            columns = [pa.array(ids, pa.int64()), pa.array(urls, pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))

"""Main text of web pages: parser events to lines, text-to-tag ratios, Gaussian smoothing, a threshold, content regions."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickweave.llm.common import slices

#: lines over so many standard deviations of the smoothed ratio are content
THRESHOLD = 0.5
#: width of the smoothing, in lines
SIGMA = 1.0
#: a part of the page that holds so much of the content's characters stands for all of it
MOST_OF = 0.9
#: characters given to the parser at a time
PIECE = 1 << 20

# fixed values: elements of HTML by what they mean for the text
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset(
    "applet audio button canvas datalist embed head iframe map math noscript object option script select style svg template textarea title video".split()
)
FRAME = frozenset("aside dialog footer form menu nav search".split())
CONTENT = frozenset("article main".split())
ENDED_BY = {
    "p": BLOCKS, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr", "tbody", "tfoot"},
    "th": {"td", "th", "tr", "tbody", "tfoot"}, "option": {"option"}, "head": {"body"},
}
LIST_OF = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "p": set()}

# fixed values: words of class, id and role that mark what isn't the article
ADVERT_WORDS = frozenset("ad ads adsense advert adverts advertisement advertising adbox adslot banner promo promoted promotion sponsor sponsored sponsors".split())
FRAME_WORDS = frozenset(
    "breadcrumb breadcrumbs alert complementary consent contentinfo cookie cookies copyright disclaimer footer gdpr header hidden legal login masthead "
    "menu modal nav navbar navigation newsletter notice notices notification overlay pager pagination popup privacy recommended related search share "
    "sharing sidebar signup skip social subscribe tags toolbar topbar widget widgets".split()
)
READER_WORDS = frozenset("comment commentlist comments disqus discussion reply replies respond".split())
#: parts of names that say nothing by themselves, beside one that does
NEUTRAL_WORDS = frozenset("area bar block box btn button buttons container group icons inner item items line link links list main module outer post posts row section thread unit wrap wrapper".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


def _says(names: list[str], words: frozenset[str]) -> bool:
    """Whether a whole name says it: all its parts are such words or neutral, and one is such a word."""
    parts = [set(re.findall(r"[a-z0-9]+", n)) for n in names]
    return any(p & words and p <= words | NEUTRAL_WORDS for p in parts)


def _marked(tag: str, attrs: list[tuple[str, str | None]], inside: bool) -> str:
    """Why an element isn't part of the article: its kind, or nothing. `inside`: it lies in an article.

    Outside, any part of a class, id or role counts. Inside, where a section may be about searches or shares, only whole names
    do; headings are never judged by their names, nor sections and paragraphs by their ids.
    """
    if tag in ("html", "body", "main"):
        return ""
    named = {k: v or "" for k, v in attrs}
    if "hidden" in named or named.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", named.get("style", "")):
        return "frame"
    if inside:
        if tag in HEADINGS:
            return ""
        names = f"{named.get('class', '')} {named.get('role', '')}".lower().split()
        own = named.get("id", "").lower().split()
        if tag in ("section", "p"):  # a section's id may be its topic, unless that is what readers say
            own = [x for x in own if _says([x], READER_WORDS - {"discussion"})]
        names += own
        says = lambda words: _says(names, words)
    else:
        found = set(re.findall(r"[a-z0-9]+", " ".join(named.get(k, "") for k in ("class", "id", "role")).lower()))
        says = lambda words: bool(found & words)
    if says(READER_WORDS):
        return "reader"
    if says(ADVERT_WORDS):
        return "advert"
    if tag == "article":
        return ""
    if tag in FRAME or tag == "header" and not inside:
        return "frame"
    return "frame" if says(FRAME_WORDS - {"header"} if inside else FRAME_WORDS) else ""


class Lines(HTMLParser):
    """Collects one line for each stretch of text between block borders: its text, tags, element, and whether it may be content."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parents, self.content_root = [-1], [-1]
        self.stack: list[tuple[str, int, str, bool]] = [("", 0, "", False)]  # tag, element, mark, unseen
        self.open: dict[str, int] = {}
        self.lines: list[tuple[str, int, int, bool]] = []
        self.parts: list[str] = []
        self.tags = 0

    def _flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text or self.tags:
            _, element, mark, _ = self.stack[-1]
            self.lines.append((text, self.tags, element, not mark))
        self.parts, self.tags = [], 0

    def handle_starttag(self, tag, attrs):
        block = tag in BLOCKS
        if block:
            self._flush()
            while len(self.stack) > 1 and tag in ENDED_BY.get(self.stack[-1][0], ()):
                self._pop()
            ended = {"p"} | ({tag} | ({"dt", "dd"} if tag in ("dt", "dd") else {"td", "th"} if tag in ("td", "th") else set()) if tag in LIST_OF else set())
            self._close_open(ended, LIST_OF.get(tag, set()))
        self.tags += 1
        if tag == "br" or tag == "img":
            self.parts.append(" ")
        if tag in VOID:
            return
        _, element, mark, unseen = self.stack[-1]
        inside = self.content_root[element] >= 0
        own = _marked(tag, attrs, inside) if block or attrs else ""
        if tag in CONTENT and not own and mark == "advert":
            mark = ""  # an advert that was never closed
        mark = mark or own
        if block:
            self.parents.append(element)
            root = self.content_root[element]
            self.content_root.append(len(self.parents) - 1 if tag in CONTENT and root < 0 and not mark else root)
            element = len(self.parents) - 1
        self.stack.append((tag, element, mark, unseen or tag in UNSEEN))
        self.open[tag] = self.open.get(tag, 0) + 1

    def _pop(self) -> None:
        tag = self.stack.pop()[0]
        self.open[tag] -= 1

    def _close_open(self, tags: set[str], borders: set[str]) -> None:
        """Close an element that a new block ends, if it is open above the nearest border."""
        if not any(self.open.get(t) for t in tags):
            return
        for k in range(len(self.stack) - 1, 0, -1):
            tag = self.stack[k][0]
            if tag in tags:
                while len(self.stack) > k:
                    self._pop()
                return
            if tag in borders or tag in BLOCKS and tag not in ("p",) and not borders:
                return

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in BLOCKS:
            self._flush()
        if self.open.get(tag):
            while self.stack[-1][0] != tag:
                self._pop()
            self._pop()
        self.tags += 1

    def handle_data(self, data):
        if not self.stack[-1][3]:
            self.parts.append(data)

    def close(self):
        if re.match(r"<[a-zA-Z/!?]", self.rawdata):  # a tag that the page's end cuts off
            self.rawdata = ""
        super().close()
        self._flush()


def smooth(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    reach = max(1, int(np.ceil(3 * sigma)))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return np.convolve(ratios, kernel / kernel.sum())[reach : reach + len(ratios)]


def main_text(html: str) -> str:
    """Blocks of the article, one line each."""
    parser = Lines()
    for at in range(0, len(html), PIECE):
        parser.feed(html[at : at + PIECE])
    parser.close()
    lines = parser.lines
    ratios = np.array([len(text) / max(1, tags) if may else 0.0 for text, tags, _, may in lines])
    if not ratios.any():
        return ""
    level = smooth(ratios)
    element = np.array([e for _, _, e, _ in lines])
    may = np.array([m and bool(t) for t, _, _, m in lines])
    content = may & (level >= THRESHOLD * level.std())
    if not content.any():
        content = may & (level >= level[may].max())
    roots = np.array(parser.content_root)[element]
    inside = content & (roots >= 0)
    # an article element is the article if it holds most of the content, not if it is one teaser of many
    if inside.any() and 2 * ratios[inside].sum() >= ratios[content].sum():
        chosen = may & np.isin(roots, np.unique(roots[inside]))
    else:
        may, content = may & (roots < 0), content & ~inside
        chosen = may & _within(element, _narrowest(parser.parents, element[content], ratios[content]), parser.parents)
    return "\n".join(lines[i][0] for i in np.flatnonzero(chosen).tolist())


def _narrowest(parents: list[int], elements: np.ndarray, weights: np.ndarray) -> int:
    """The deepest element that still holds nearly all content."""
    mass = np.zeros(len(parents))
    np.add.at(mass, elements, weights)
    heaviest = [(-1, 0.0)] * len(parents)
    for k in range(len(parents) - 1, 0, -1):  # children come after their parents
        mass[parents[k]] += mass[k]
        if mass[k] > heaviest[parents[k]][1]:
            heaviest[parents[k]] = (k, mass[k])
    at = 0
    while heaviest[at][1] >= MOST_OF * mass[0]:
        at = heaviest[at][0]
    # a single block isn't a part of the page: its neighbours belong to it
    return parents[at] if at and not np.any(np.array(parents) == at) else at


def _within(elements: np.ndarray, root: int, parents: list[int]) -> np.ndarray:
    inside = np.zeros(len(parents), dtype=bool)
    inside[root] = True
    for k in range(root + 1, len(parents)):
        inside[k] = inside[parents[k]]
    return inside[elements]


def extract_text(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text of every page; nothing is shuffled.

    Content lines are chosen by their smoothed text-to-tag ratio. The article is what lies in the `article` or `main` elements that
    hold most of their weight, or, on pages without, in the narrowest part that holds nearly all of it; menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and readers'
    comments are left out wherever they are. Null and empty html, and pages without text: empty text. Null and repeated keys:
    each row on its own. Broken markup: what the parser makes of it. Empty table: no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 8 << 20):
            texts = [main_text(x) for x in batch.column("html").to_pylist()]
            yield pa.record_batch({"page_id": batch.column("page_id"), "url": batch.column("url"), "text": pa.array(texts, type=pa.string())})

    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html).cast("string"), F.lit("")).alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string")

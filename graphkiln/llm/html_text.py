"""Main text of web pages by text-to-tag ratio.

Parser events of the standard library's HTMLParser are turned into lines (one per block element) with their text and the
number of tags. Each line's ratio of text to tags is smoothed by a Gaussian and the lines are clustered by a threshold
into content and rest. The content region is the page element that holds the content lines: the ``article`` and ``main``
elements that do, if they have at least half of them together, or else the smallest element that encloses nearly all of
them. The region's lines are returned in page order, short ones included, but for lines outside the content clusters that are
nearly all links (lists of links, between or inside articles; headings stay), and for elements that are never main text
(menus, page headers, footers, sidebars, notices, adverts, forms, reader comments), which are known by tag, role, class or
id. A class or id names such a part if one of its tokens consists of words for it and neutral words only (``related-posts``,
not ``related-work``); it doesn't hide an element that holds most of the content lines and of the prose (reader comments: all prose).

Defined results: null or empty html gives an empty text; white space (any that ``str.split`` knows) inside a block becomes
one space; blocks are joined by one newline; unclosed and misnested tags are tolerated; extra columns pass through, those named
like results are replaced; repeated rows are treated alike; an empty table gives no rows. Pages are independent: no shuffle.
A line knows its element and an element its parent, so time and memory grow in proportion to the page, however deep its nesting.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from graphkiln.functions.ship import ship
from graphkiln.llm.common import free_name

SIGMA = 1.0
#: Share of the content lines' text that the region must hold.
ENCLOSED = 0.95
#: Share of it that articles must hold together to be the region.
MARKED = 0.5
#: Share of a line that is links from which it is no prose.
LINKS = 0.8

#: Elements by their part in a page.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody tfoot thead tr ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("head script style noscript template iframe object svg math canvas audio video select option button textarea datalist title".split())
ASIDE = frozenset("nav aside footer form menu dialog search".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar".split())
MAIN = frozenset(("article", "main"))
#: Words in classes and ids for what is never main text; the first ones among them for reader comments.
COMMENTS = frozenset("comment comments commentlist commenting respond disqus replies".split())
ALWAYS = COMMENTS | frozenset("ad ads adv advert adverts advertisement advertisements advertising advertorial adsense sponsor sponsors sponsored sponsorship promo promos promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar cookie cookies consent gdpr notice notices notification alert banner popup modal overlay newsletter subscribe subscription signup login share sharing social discussion related recommended footer".split())
UNLESS_ARTICLE = frozenset("header masthead topbar toolbar widget widgets meta tags pagination pager".split())
#: Words that leave the meaning of the others in a name as it is.
NEUTRAL = frozenset("a app area article articles bar body block blocks bottom box boxes btn button buttons card cards col column container content count div entry foot form global group head heading holder icon icons id inner item items js label layout left link links list lists main message module more news outer page pages panel part post posts primary reader readers region right row secondary section sections site slot small sticky stories story sub text thread title toggle top ui unit user users view wrap wrapper zone".split())
#: How an element is hidden.
SHOWN, BY_NAME, ALWAYS_HIDDEN = 0, 1, 2

_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_UNSEEN = re.compile(r"(?i)display\s*:\s*none|visibility\s*:\s*hidden")
_BREAKS = frozenset(("p", *"address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol pre section table ul".split()))
#: A start tag here closes an open element of the same group, across open paragraphs only.
_SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "option": ("option",)}


def _names(attrs: dict[str, str | None], words: frozenset[str]) -> bool:
    """Whether a token of the class or id consists of ``words`` and neutral words, with one of the first."""
    for token in f"{attrs.get('class') or ''} {attrs.get('id') or ''}".split():
        found = [w.lower() for w in _WORD.findall(token)]
        if any(w in words for w in found) and all(w in words or w in NEUTRAL for w in found):
            return True
    return False


class Lines(HTMLParser):
    """One line per block: its text, number of tags, whether nearly all of it is links, and its element; the elements' tree.

    Element 0 is the page. The lists over elements hold their parents, tags and marks; a parent comes before its children.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.texts: list[str] = []
        self.counts: list[int] = []
        self.links: list[bool] = []
        self.of: list[int] = []
        self.parent, self.tag, self.hidden = [0], [""], [False]
        #: Hidden by class or id; so for reader comments; article or main; inside one.
        self.named, self.comments, self.main, self.inside = [False], [False], [False], [False]
        #: Open elements as (tag, number), 0 for those inside a line; how many of each tag.
        self.open: list[tuple[str, int]] = []
        self.many: Counter[str] = Counter()
        self.at, self.tags, self.text, self.in_link, self.linked = 0, 0, [], False, 0

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            self.texts.append(text)
            self.counts.append(self.tags)
            self.links.append(self.linked >= LINKS * len(text))
            self.of.append(self.at)
            self.tags = 0
        self.text, self.linked = [], 0

    def hides(self, tag: str, attrs: dict[str, str | None]) -> int:
        if tag in SILENT or tag in ASIDE:
            return ALWAYS_HIDDEN
        if tag == "header":
            return SHOWN if self.inside[self.at] else ALWAYS_HIDDEN
        if "hidden" in attrs or (attrs.get("role") or "").lower() in ROLES or _UNSEEN.search(attrs.get("style") or ""):
            return ALWAYS_HIDDEN
        if tag in ("html", "body", "main"):
            return SHOWN
        return BY_NAME if _names(attrs, ALWAYS) or (not self.inside[self.at] and _names(attrs, UNLESS_ARTICLE)) else SHOWN

    def pop(self) -> None:
        tag, number = self.open.pop()
        self.many[tag] -= 1
        if number:
            self.at = self.parent[number]

    def push(self, tag: str, number: int) -> None:
        self.open.append((tag, number))
        self.many[tag] += 1
        if number:
            self.at = number

    def close_to(self, k: int) -> None:
        self.flush()
        while len(self.open) > k:
            self.pop()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag == "a":
            self.in_link = True
        elif tag in ("br", "td", "th"):
            self.text.append(" ")
        elif tag == "hr":
            self.flush()
        if tag in VOID:
            return
        found = dict(attrs)
        hides = self.hides(tag, found)
        if tag not in BLOCKS:
            if hides:  # text of its own inside a block, which goes on after it
                self.push(tag, 0)
            return
        while self.open and self.open[-1][0] not in BLOCKS and self.open[-1][0] not in SILENT:
            self.pop()
        if tag in _BREAKS and self.open and self.open[-1][0] == "p":
            self.close_to(len(self.open) - 1)
        elif tag in _SIBLINGS:
            for k in range(len(self.open) - 1, max(-1, len(self.open) - 3), -1):
                if self.open[k][0] in _SIBLINGS[tag]:
                    self.close_to(k)
                    break
                if self.open[k][0] != "p":
                    break
        self.flush()
        above, number = self.at, len(self.parent)
        hidden = self.hidden[above] or hides == ALWAYS_HIDDEN
        main = (tag in MAIN or found.get("role") == "main") and not hidden
        self.parent.append(above)
        self.tag.append(tag)
        self.hidden.append(hidden)
        self.named.append(hides == BY_NAME)
        self.comments.append(hides == BY_NAME and _names(found, COMMENTS))
        self.main.append(main)
        self.inside.append(self.inside[above] or main)
        self.push(tag, number)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag in ("br", "hr"):
            self.text.append(" ") if tag == "br" else self.flush()

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag == "a":
            self.in_link = False
        if tag in BLOCKS:
            self.flush()
        if self.many[tag] > 0:
            while self.open[-1][0] != tag:
                self.pop()
            self.pop()

    def handle_data(self, data: str) -> None:
        if not self.open or self.open[-1][0] in BLOCKS:
            self.text.append(data)
            self.linked += len(data) * self.in_link


def smooth(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    reach = max(1, round(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    padded = np.pad(ratios, reach, mode="edge")
    return np.convolve(padded, kernel / kernel.sum(), mode="valid")


def threshold(values: np.ndarray) -> float:
    """Between the means of the lower and the upper cluster, found by alternation from the overall mean."""
    cut = float(values.mean())
    for _ in range(100):
        low, high = values[values < cut], values[values >= cut]
        if not len(low) or not len(high):
            break
        new = (float(low.mean()) + float(high.mean())) / 2
        if abs(new - cut) < 1e-9:
            break
        cut = new
    return cut


def _held(parser: Lines, weights: list[int]) -> list[int]:
    """For each element the weight of the lines in it."""
    held = [0] * len(parser.parent)
    for n, w in zip(parser.of, weights, strict=True):
        held[n] += w
    for n in range(len(held) - 1, 0, -1):
        held[parser.parent[n]] += held[n]
    return held


def _within(parser: Lines, marks: list[bool]) -> list[bool]:
    """For each element whether it or one around it is marked."""
    found = list(marks)
    for n in range(1, len(found)):
        found[n] = found[n] or found[parser.parent[n]]
    return found


def shown(parser: Lines, content: np.ndarray) -> list[bool]:
    """For each line whether it may be main text: not below an element hidden by name, unless that holds the page's text."""
    ok = [not parser.hidden[n] for n in parser.of]
    dense = _held(parser, [len(t) if o and c else 0 for t, o, c in zip(parser.texts, ok, content, strict=True)])
    prose = _held(parser, [len(t) if o and not x else 0 for t, o, x in zip(parser.texts, ok, parser.links, strict=True)])

    def most(n: int) -> bool:
        return prose[n] == prose[0] if parser.comments[n] else 2 * prose[n] > prose[0] and 2 * dense[n] > dense[0]

    away = _within(parser, [named and not most(n) for n, named in enumerate(parser.named)])
    return [o and not away[n] for o, n in zip(ok, parser.of, strict=True)]


def _articles(parser: Lines, held: list[int], seen: list[bool]) -> list[bool] | None:
    """Marks of the articles that are the region; None if they hold too little of the content lines."""
    outer = [0] * len(parser.parent)
    inner: dict[int, int] = {}
    for n in range(1, len(outer)):
        outer[n] = outer[parser.parent[n]] or (n if parser.main[n] and held[n] else 0)
        if parser.main[n] and held[n] and held[n] == held[outer[n]]:  # the outermost, or the innermost of those that hold as much
            inner[outer[n]] = n
    if not inner or sum(held[n] for n in inner) < MARKED * held[0]:
        return None
    marks = [False] * len(outer)
    for n in inner.values():
        marks[n] = True
    bare = [0] * len(outer)  # articles beside them that have no content line but prose are parts of the text too
    for n in range(1, len(outer)):
        bare[n] = bare[parser.parent[n]] or (n if parser.main[n] and not held[n] else 0)
    for n, ok, link in zip(parser.of, seen, parser.links, strict=True):
        if ok and not link and bare[n]:
            marks[bare[n]] = True
    return marks


def blocks(html: str | None) -> list[str]:
    """The blocks of a page's main text."""
    parser = Lines()
    parser.feed(html or "")
    parser.close()
    parser.flush()
    if all(parser.hidden[n] for n in parser.of):
        return []
    smoothed = smooth(np.array([len(t) / max(1, k) for t, k in zip(parser.texts, parser.counts, strict=True)]))
    content = smoothed >= threshold(smoothed)
    seen = shown(parser, content)
    weights = [len(t) if ok and c else 0 for t, ok, c in zip(parser.texts, seen, content, strict=True)]
    if not any(weights):
        weights = [len(t) if ok else 0 for t, ok in zip(parser.texts, seen, strict=True)]
    held = _held(parser, weights)
    marks = _articles(parser, held, seen)
    if marks is None:
        around = max(n for n, w in enumerate(held) if w >= ENCLOSED * held[0])
        marks = [n == around for n in range(len(held))] if held[0] else [True] * len(held)
    region = _within(parser, marks)
    prose = [c or not link or parser.tag[n] in HEADINGS for c, link, n in zip(content, parser.links, parser.of, strict=True)]
    return [t for t, ok, p, n in zip(parser.texts, seen, prose, parser.of, strict=True) if ok and p and region[n]]


def extract(pages: DataFrame, html: str = "html", text: str = "text") -> DataFrame:
    """``pages`` plus ``text``, ``n_chars`` and ``n_blocks`` (columns of these names are replaced)."""
    ship(pages.sparkSession)
    add = {text: T.StringType(), "n_chars": T.LongType(), "n_blocks": T.LongType()}
    kept = [c for c in pages.columns if c not in add]
    given = free_name(pages, "_input")
    df = pages.select(*[f"`{c}`" for c in kept], pages[f"`{html}`"].alias(given))
    schema = T.StructType([*(f for f in df.schema.fields if f.name != given), *(T.StructField(c, t) for c, t in add.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [blocks(value.as_py()) for value in batch.column(given)]
            texts = ["\n".join(x) for x in found]
            made = [pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64()), pa.array(map(len, found), pa.int64())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *made], names=[*kept, *add])

    return df.mapInArrow(run, schema)

"""Main text of web pages by line-block distribution.

Markup is stripped into lines, one for each block of the page, and a line's
length is that of its text outside links.  Lines of one container, of nested
containers, and of neighbours of one kind (same tag and class) follow each
other; between other containers are empty lines, except after a heading, which
belongs to what follows.  Lengths are summed over a sliding window of lines:
where the sum surges a region begins, where it dives to zero it ends.  Regions
whose sum reaches ``SURGE`` are kept, or if there is none the one with the most
text.

Marks of the page are evidence, and the distribution decides about them:

* an element that by name, role or class is a menu, header, footer, sidebar,
  notice, advert, form or comment is left out.  A form, a role, a class or an
  element that is never closed is not believed if it holds most of the page's
  text (a form round the whole page, a wrong class) and with it the page's
  articles, if it marks any;
* if ``article`` or ``main`` hold at least ``TRUST`` of the text in surging
  regions, only lines in them count, and as the edges are known, regions in
  them need no surge but must not be links alone.

Cases: null or empty html, or a page without text, gives an empty text;
broken markup (unclosed elements, a cut page, ``<`` in text) never fails;
repeated rows are extracted each for itself; other columns are ignored; pages
of any length are read whole, in time that follows their length.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import small_batches, table

WINDOW = 3
SURGE = 80
TRUST = 0.3

_RAW = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<(script|style|noscript|template|svg|iframe|textarea|select|title|canvas|audio|video)\b[^>]*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*>",
    re.S | re.I,
)
_OPENER = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_STOP = re.compile(r"[\"'>]")
_ATTR = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_KEYS = frozenset("class id role style hidden aria-hidden".split())
_PART = re.compile(r"[a-z]+")
_CLASS = re.compile(r"\bclass\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
_CONTAINERS = frozenset("article aside div footer form header main nav section td th".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_BLOCKS = _CONTAINERS | _HEADINGS | frozenset(
    "address blockquote body caption center dd details dialog dir dl dt fieldset figcaption figure head hgroup hr html legend li menu ol option p pre summary table tbody tfoot thead tr ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_SKIP = frozenset("nav header footer aside form menu dialog button head fieldset".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: What an element's class or id calls what is no article text.
_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promos promotion banner menu menus nav navbar navigation sidebar sidenav rail footer header masthead breadcrumb breadcrumbs cookie cookies consent gdpr notice notices popup modal overlay comment comments disqus replies reply respond discussion share sharing social related recommended newsletter subscribe subscription signup login search pagination pager toolbar widget widgets copyright disclaimer hidden".split()
)
#: Words that say nothing beside such a name.
_PLAIN = frozenset("the site page main top bottom left right global primary secondary inner outer wrap wrapper container box block unit slot area bar list section panel holder frame content contents item group row col column links link buttons form text message".split())
#: What has a header of its own.
_OWN = frozenset("entry post article story content news blog".split())
_COMMENT = frozenset("comment comments disqus replies reply".split())
_OPEN = frozenset({"article", "main"})


def _tags(page: str) -> Iterator[tuple[int, int, bool, str, str]]:
    """(start, end, closing, name, attributes) of every tag; a quoted ``>`` ends none."""
    at, missing = 0, set()
    while m := _OPENER.search(page, at):
        i = m.end()
        while True:
            stop = _STOP.search(page, i)
            if stop is None or stop[0] == ">":
                break
            i = stop.end()
            # a quote opens a value only after =, and only if it is closed somewhere
            if stop[0] not in missing and page[max(m.end(), stop.start() - 32) : stop.start()].rstrip().endswith("="):
                end = page.find(stop[0], i)
                if end < 0:
                    missing.add(stop[0])
                else:
                    i = end + 1
        last = len(page) if stop is None else stop.start()
        at = min(last + 1, len(page))
        yield m.start(), at, bool(m[1]), m[2].lower(), page[m.end() : last]


def _named(token: str, in_main: bool) -> bool:
    """Whether a class or id names something unwanted, by all its words or its last one beside plain words."""
    parts = _PART.findall(token)
    names = [p for p in parts if p in _NAMES]
    if not names:
        return False
    if names == ["header"] and (in_main or _OWN & set(parts)):
        return False
    return all(p in _NAMES or p in _PLAIN or p in _OWN or len(p) == 1 for p in parts)


def _unwanted(name: str, attrs: str, in_main: bool) -> bool:
    if name in _SKIP and not (name == "header" and in_main):
        return True
    if not attrs or name in ("html", "body"):
        return False
    for m in _ATTR.finditer(attrs):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key not in _KEYS:
            continue
        if key in ("class", "id"):
            if any(set(_PART.findall(t)) & _COMMENT if name in _OPEN else _named(t, in_main) for t in value.split()):
                return True
        elif key == "role":
            if value in _ROLES:
                return True
        elif key == "style":
            if "display:none" in value.replace(" ", ""):
                return True
        elif key == "hidden":
            return True
        elif value == "true":
            return True
    return False


@dataclass
class Line:
    """A block's text, its characters outside links, whether it stands in an article, and empty lines before it."""

    text: str
    size: int
    inside: bool
    gap: int


def _ends(tags: list[tuple[int, int, bool, str, str]]) -> list[tuple[int, bool]]:
    """For each opening tag the tag that ends its element, and whether that closes it; (-1, False) without one.

    A paragraph ends before the next block at the latest.
    """
    out, opened = [(-1, False)] * len(tags), {}
    paragraph = -1
    for k, (_, _, closing, name, _) in enumerate(tags):
        if paragraph >= 0 and name in _BLOCKS:
            out[paragraph] = (k, closing and name == "p")
            paragraph = -1
        if name == "p":
            paragraph = -1 if closing else k
        elif closing:
            if opened.get(name):
                out[opened[name].pop()] = (k, True)
        elif name not in _VOID:
            opened.setdefault(name, []).append(k)
    return out


def lines(page: str) -> list[Line]:
    """Blocks of a page without what its marks leave out."""
    page = _RAW.sub("", page)
    tags = list(_tags(page))
    ends = _ends(tags)
    # text up to each tag, to weigh elements by
    texts, marks, at = [0], [0], 0
    for start, end, closing, name, _ in tags:
        texts.append(texts[-1] + len(page[at:start].strip()))
        marks.append(marks[-1] + (name in _OPEN and not closing))
        at = end
    total = texts[-1] + len(page[at:].strip())

    out: list[Line] = []
    part: list[str] = []
    stack: list[tuple[int, str, str]] = [(0, "", "")]  # open containers: number, tag, kind
    closed: set[int] = set()
    number = main = links = linked = 0
    last, heading, head = (0, "", ""), False, False

    def close() -> None:
        nonlocal last, heading, linked
        text = " ".join(_html.unescape("".join(part)).split())
        part.clear()
        if text:
            own = stack[-1]
            apart = out and not heading and own[0] != last[0] and last[0] in closed and own[0] > last[0] and own[1:] != last[1:]
            out.append(Line(text, max(0, len(text) - linked), main > 0, WINDOW if apart else 0))
            last, heading = own, head
        linked = 0

    k = at = 0
    while k < len(tags):
        start, end, closing, name, attrs = tags[k]
        if start > at:
            piece = page[at:start]
            part.append(piece)
            if links:
                linked += len(piece.strip())
        at = end
        if name in _BLOCKS:
            close()
            head = name in _HEADINGS and not closing
        elif name == "br":
            part.append(" ")
        elif name == "a":
            links = max(0, links + (-1 if closing else 1))
        if not closing and name not in _VOID and not attrs.endswith("/") and _unwanted(name, attrs, main > 0):
            until, closes = ends[k]
            if until < 0:  # never closed: up to the next article, or all that is left
                until = next((i for i in range(k + 1, len(tags)) if not tags[i][2] and tags[i][3] in _OPEN), len(tags))
            inside = (texts[until + 1] if until < len(tags) else total) - texts[k + 1]
            certain = closes and name in _SKIP and name not in ("form", "fieldset")
            if certain or 2 * inside <= total or marks[-1] > 0 == marks[until] - marks[k + 1]:
                at = len(page) if until == len(tags) else tags[until][1] if closes else tags[until][0]
                k = until + closes
                continue
        if name in _CONTAINERS:
            if not closing:
                number += 1
                stack.append((number, name, m[0] if (m := _CLASS.search(attrs)) else ""))
            elif any(x[1] == name for x in stack[-64:]):
                while stack[-1][1] != name:
                    closed.add(stack.pop()[0])
                closed.add(stack.pop()[0])
        if name in _OPEN:
            main = max(0, main + (-1 if closing else 1))
        k += 1
    part.append(page[at:])
    close()
    return out


def regions(lengths: list[int], window: int = WINDOW, surge: int = SURGE) -> list[tuple[int, int]]:
    """Ranges of lines between a surge of the window sums and the next dive to zero.

    All runs of positive sums are candidates; those whose sum reaches ``surge``
    count, or else the one with the most text.
    """
    sums = [sum(lengths[i : i + window]) for i in range(len(lengths))]
    runs, i = [], 0
    while i < len(sums):
        if sums[i] == 0:
            i += 1
            continue
        j = i
        while j < len(sums) and sums[j] > 0:
            j += 1
        runs.append((i, j))
        i = j
    surging = [r for r in runs if max(sums[r[0] : r[1]]) >= surge]
    return surging or sorted(runs, key=lambda r: (-sum(lengths[r[0] : r[1]]), r[0]))[:1]


def extract(page: str | None) -> str:
    """Main text of one page."""
    if not page:
        return ""
    found = lines(page)
    rows: list[int] = []  # the line at each place of the distribution, -1 for empty ones
    for i, line in enumerate(found):
        rows += [*[-1] * line.gap, i]

    def kept(sizes: list[int], surge: int) -> list[int]:
        """Lines of the regions; text in links counts as little as may be, and regions of links alone are none."""
        found = [[rows[p] for p in range(a, b) if rows[p] >= 0] for a, b in regions([max(1, sizes[r]) if r >= 0 and sizes[r] >= 0 else 0 for r in rows], surge=surge)]
        return [i for region in found if any(sizes[i] > 0 for i in region) for i in region if sizes[i] >= 0]

    sizes = [line.size for line in found]
    some = kept(sizes, SURGE)
    text = sum(sizes[i] for i in some)
    inside = [line.size if line.inside else -1 for line in found]
    if any(line.inside for line in found) and sum(max(0, x) for x in inside) >= TRUST * text:
        some = kept(inside, 1)
    return "\n".join(found[i].text for i in some)


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of ``pages``; a map without exchange."""
    small_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, max(1, b.num_rows), 256):
                s = b.slice(k, 256)
                texts = [extract(x) for x in s.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [s.column("page_id"), s.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())],
                    names=["page_id", "url", "text", "n_chars"],
                )

    kinds = dict(pages.dtypes)
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")


def op10_line_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))

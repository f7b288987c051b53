"""Main text of a web page by line-block distribution.

Markup is stripped into lines, one for each block of text. A line's length counts its
characters outside links; lines of elements that never hold the article (menus, headers,
footers, sidebars, notices, adverts, forms, comments, scripts and styles) are left out. Over
the lengths slide windows of ``WINDOW`` lines. A surge is where a window's sum reaches
``SURGE``, a dive where the windows run into zero or the lines into a gap; the text from the
surge's first line to the dive stays whole. A gap is a left-out element, unless the text goes
on in the same container behind it: an advert inside an article parts nothing.

Tags are weights. Where the fullest window inside declared articles, ``ARTICLE_WEIGHT``
times, is at least that outside, the declaration holds: any text in it surges and the rest
is a gap, so that short articles and short paragraphs stay. Where the text outside is fuller,
as with a story beside teaser cards, the declared articles are left out instead. If no
window surges, the fullest run is taken.

Defined cases: null, empty and markup-free pages (text without tags is one article);
unclosed and misnested tags end where their parent ends; an unterminated tag or comment
at the end holds no text; repeated rows each get their row; an empty table gives none.
Pages are read whole, in one pass, with a few numbers for each line and element, however
deep they nest. Columns that have an output's name are replaced.
"""

from __future__ import annotations

import html
import re
from collections import Counter, deque
from collections.abc import Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from pulsewide.llm.batches import add_columns

WINDOW = 3
SURGE = 80
ARTICLE_WEIGHT = 4

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*?)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.S)
_SPACE = re.compile(r"\s+")

# Elements that break lines, that hold no article, whose content is raw, and that have no end.
_BLOCKS = frozenset((
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section "
    "summary table tbody td tfoot th thead title tr ul").split())
_APART = frozenset((
    "head title nav menu aside footer form button select option textarea input label fieldset dialog noscript template iframe "
    "object embed canvas svg math audio video map applet noframes search script style").split())
_RAW = frozenset("script style textarea title noscript template iframe svg noframes xmp".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_ARTICLE = frozenset(("article", "main"))
_HEADINGS = frozenset(("h1", "h2", "h3"))
_CONTAINERS = frozenset("article aside blockquote body center div figure footer form header main section td th".split())
#: What a class or id names: its last word, or the one before words of layout.
_MARKS = frozenset((
    "ad ads advert adverts advertisement advertisements advertising adsense adbox sponsor sponsored promo promos promotion promotions "
    "banner banners sidebar sidebars side widget widgets aside rail nav navbar navigation menu menus breadcrumb breadcrumbs toolbar topbar "
    "pagination pager footer footers foot masthead comment comments disqus respond replies reply reaction reactions discussion cookie "
    "cookies consent gdpr notice notices notification alert alerts popup popups modal overlay newsletter subscribe subscription signup "
    "login share sharing social related recommended recommendations copyright legal skip").split())
_LAYOUT = frozenset((
    "area articles bar block body bottom box button buttons cell column container content form group holder icons inner item items left link "
    "links list main outer panel posts region right row section slot stories text top unit wrap wrapper zone").split())
_NEGATIONS = frozenset("has is no non with without".split())
_HEADER = frozenset(("header", "headers"))
_HIDDEN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)\b", re.I)
_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar alert dialog alertdialog toolbar".split())


def _named(name: str) -> str:
    """The word that says what a class or id is for; empty where it says what is not there."""
    words = [w for w in re.split(r"[\s_-]+", name.lower()) if w]
    while len(words) > 1 and (words[-1] in _LAYOUT or words[-1].isdigit()):
        words.pop()
    return words[-1] if words and words[0] not in _NEGATIONS else ""


def _apart(tag: str, attributes: str, inside: bool) -> tuple[bool, bool]:
    """Whether an element never holds the article's text, and whether its class or id says so."""
    if tag in _APART or tag == "header" and not inside:
        return True, False
    if tag in ("html", "body") or not attributes:
        return False, False
    marked = False
    for m in _ATTRIBUTE.finditer(attributes):
        value = next((g for g in m.groups()[1:] if g is not None), "")
        name = m[1].lower()
        if name == "hidden" or name == "role" and value.lower() in _ROLES or name == "style" and _HIDDEN.search(value):
            return True, False
        if name in ("class", "id") and tag != "main":
            for c in value.split():
                word = c.lower() if tag in _ARTICLE else _named(c)
                marked |= word in _MARKS or not inside and word in _HEADER
    return False, marked


#: Elements that an opening block of the same kind closes, and how far it looks for them.
_ENDED_BY = {
    "li": frozenset(("li",)), "p": frozenset(), "dt": frozenset(("dt", "dd")), "dd": frozenset(("dt", "dd")),
    "tr": frozenset(("tr", "td", "th")), "td": frozenset(("td", "th")), "th": frozenset(("td", "th")), "option": frozenset(("option",)),
}
_LISTS = frozenset("ul ol dl table tbody thead tfoot article main section div body".split())


class _Line(NamedTuple):
    text: str
    plain: int  # characters outside links
    article: bool
    apart: bool
    mark: int  # number of the innermost marked element around, 0 for none
    home: int  # number of the innermost container


class _Page:
    """Lines of a page, and the parents of its marked elements and containers by number."""

    def __init__(self) -> None:
        self.lines: list[_Line] = []
        self.marks, self.homes = [0], [0]
        self._parts: list[str] = []
        self._plain = 0

    def add(self, text: str, linked: bool) -> None:
        self._parts.append(text)
        if not linked:
            self._plain += len(text)

    def end(self, article: bool, apart: bool, mark: int, home: int) -> None:
        if self._parts:
            text = _SPACE.sub(" ", "".join(self._parts)).strip()
            if text:
                self.lines.append(_Line(text, min(self._plain, len(text)), article, apart, mark, home))
            self._parts.clear()
            self._plain = 0


def _strip(page: str) -> _Page:
    lines = _Page()
    stack: list[tuple[str, bool, bool, bool]] = []  # tag, apart, article, marked
    open_: Counter[str] = Counter()
    apart = article = links = headings = mark = home = at = 0

    def pop() -> None:
        nonlocal apart, article, links, headings, mark, home
        tag, a, b, marked = stack.pop()
        if marked:
            mark = lines.marks[mark]
        if tag in _CONTAINERS:
            home = lines.homes[home]
        open_[tag] -= 1
        apart -= a
        article -= b
        links -= tag == "a"
        headings -= tag in _HEADINGS

    for m in _tags(page):
        if m.start() > at:
            if apart == 0 or page[at : m.start()].strip():
                lines.add(html.unescape(page[at : m.start()]), links > 0 and not headings)
        at = m.end()
        if m[1] is not None:
            lines.add(m[1], links > 0 and not headings)
            continue
        if m[3] is None:
            continue
        closing, tag = m[2] == "/", m[3].lower()
        if tag == "br":
            lines.add(" ", links > 0 and not headings)
            continue
        if tag in _BLOCKS or tag in _APART:
            lines.end(article > 0, apart > 0, mark, home)
        if tag in _VOID:
            continue
        if closing:
            if open_[tag]:
                while stack[-1][0] != tag:
                    pop()
                pop()
            continue
        if tag in _BLOCKS and stack and stack[-1][0] == "p":
            pop()
        ended = _ENDED_BY.get(tag)
        if ended:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in ended:
                    while len(stack) > k:
                        pop()
                    break
                if stack[k][0] in _LISTS:
                    break
        if m[4].endswith("/") and tag not in _BLOCKS:
            continue
        inside = article > 0
        is_apart, is_marked = _apart(tag, m[4], inside)
        is_article = tag in _ARTICLE and not is_apart
        stack.append((tag, is_apart, is_article, is_marked))
        if is_marked:
            lines.marks.append(mark)
            mark = len(lines.marks) - 1
        if tag in _CONTAINERS:
            lines.homes.append(home)
            home = len(lines.homes) - 1
        open_[tag] += 1
        apart += is_apart
        article += is_article
        links += tag == "a"
        headings += tag in _HEADINGS
    if at < len(page):
        lines.add(html.unescape(page[at:]), links > 0 and not headings)
    lines.end(article > 0, apart > 0, mark, home)
    return lines


def _tags(page: str):
    """Tags in order; the content of raw elements is skipped to their end tag."""
    at, n = 0, len(page)
    endless: set[str] = set()  # raw elements without an end tag from here on
    while at < n:
        m = _TAG.search(page, at)
        if m is None:
            return
        yield m
        at = m.end()
        tag = (m[3] or "").lower()
        if tag in _RAW and m[2] != "/" and not (m[4] or "").endswith("/"):
            end = None if tag in endless else re.compile(rf"</{tag}\b", re.I).search(page, at)
            if end is None:
                endless.add(tag)
            stop = end.start() if end else n
            if tag not in ("noscript", "template", "svg") or end:
                yield _Skip(at, stop)
                at = stop


class _Skip:
    """A stretch of raw content, in the form of a match that adds nothing."""

    def __init__(self, start: int, stop: int):
        self._start, self._stop = start, stop

    def start(self) -> int:
        return self._start

    def end(self) -> int:
        return self._stop

    def __getitem__(self, group: int) -> None:
        return None


def _fullest(lines: list[_Line]) -> int:
    """The largest sum of ``WINDOW`` lines in a row that are not apart."""
    best, near = 0, deque(maxlen=WINDOW)
    for line in lines:
        near.append(0 if line.apart else line.plain)
        best = max(best, sum(near))
    return best


def _unmarked(page: _Page) -> list[_Line]:
    """Lines with those of marked elements apart, but for the elements around the page's
    fullest window, if they hold an article, or their window alone surges, or there is no
    other text, and no article is declared elsewhere."""
    lines = page.lines
    free = {0}
    if any(x.mark for x in lines) and not any(x.article and not x.apart and not x.mark for x in lines):
        groups: dict[tuple[bool, int], list[_Line]] = {}
        for x in lines:
            if not x.apart:
                groups.setdefault((x.article, x.mark), []).append(x)
        fullest = {key: _fullest(group) for key, group in groups.items()}
        outside = max((n for (_, mark), n in fullest.items() if not mark), default=0)
        (article, mark), total = max(fullest.items(), key=lambda f: f[1], default=((False, 0), 0))
        if total > outside and (article or outside < SURGE <= total or not outside):
            while mark:
                free.add(mark)
                mark = page.marks[mark]
    return [x if x.mark in free else x._replace(apart=True) for x in lines]


def _runs(lines: list[_Line], homes: list[int]) -> list[list[int]]:
    """Stretches of lines between gaps. Text goes on behind a left-out element in the same
    container, or in one beside it inside a common one."""
    runs: list[list[int]] = []
    last, gap = None, False
    for i, line in enumerate(lines):
        if line.apart:
            gap = True
            continue
        a, b = (0, 0) if last is None else (lines[last].home, line.home)
        around = homes[a] if homes[a] == homes[b] and homes[homes[a]] else 0  # the page's own body is none
        if last is None or gap and a != b and not around:
            runs.append([])
        runs[-1].append(i)
        last, gap = i, False
    return runs


def _stretches(lengths: list[int], surge: int) -> list[tuple[int, int]]:
    """From each surge's first line to the last line before its dive."""
    n, found, k = len(lengths), [], 0
    sums = [sum(lengths[max(0, i - WINDOW + 1) : i + 1]) for i in range(n)]
    start = 0  # lines before it belong to the stretch before
    while k < n:
        if sums[k] < surge:
            k += 1
            continue
        first = next(i for i in range(max(start, k - WINDOW + 1), k + 1) if lengths[i])
        while first > start and lengths[first - 1]:
            first -= 1
        while k < n and sums[k]:
            k += 1
        last = k - 1
        while not lengths[last]:
            last -= 1
        found.append((first, last))
        start = last + 1
    return found


def main_text(page: str | None) -> str:
    """The article of a page, its blocks joined by newlines."""
    stripped = _strip(page or "")
    lines = _unmarked(stripped)
    inside = _fullest([x._replace(plain=len(x.text)) for x in lines if x.article])
    declared = inside > 0 and ARTICLE_WEIGHT * inside >= _fullest([x for x in lines if not x.article])
    if declared:
        lines = [x._replace(plain=len(x.text), apart=x.apart or not x.article) for x in lines]
    else:
        lines = [x._replace(apart=x.apart or x.article) for x in lines]
    kept: list[int] = []
    fullest: tuple[int, list[int]] = (0, [])
    for run in _runs(lines, stripped.homes):
        lengths = [lines[i].plain for i in run]
        if sum(lengths) > fullest[0]:
            fullest = (sum(lengths), run)
        for first, last in _stretches(lengths, 1 if declared else SURGE):
            kept.extend(run[first : last + 1])
    if not kept:
        kept = [i for i in fullest[1] if lines[i].plain]
    return "\n".join(lines[i].text for i in kept)


_OUT = T.StructType([T.StructField("main_text", T.StringType()), T.StructField("n_main_chars", T.LongType())])


def extract_main_text(pages: DataFrame, *, page: str = "html", carry: Sequence[str] | None = None) -> DataFrame:
    """Pages with ``main_text`` and ``n_main_chars`` (its code points)."""

    def start():
        def work(columns):
            texts = [main_text(p) for p in columns[0].to_pylist()]
            return [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]

        return work

    return add_columns(pages, [page], _OUT, start, carry)

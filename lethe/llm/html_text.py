"""Main text of web pages by line-block distribution.

Markup is stripped into lines, one for each block element, and lines of menus, page headers, footers,
sidebars, notices, adverts, forms, scripts, styles and reader comments become blank.  Text lengths,
without link text, are summed over sliding windows of ``WIDTH`` lines.  A window at or over
``SURGE`` characters that begins with text is a surge point, the next blank window or the end is its
dive point; the text between them is kept.  Where no window is that large, the largest is one.

Article and main elements with text are ranges: where a page has any, the windows run over each of
them by itself, and nothing else is kept.  The mark weighs as much as ``SURGE``: any window that
begins with text is a surge point there, and unwanted elements leave no blanks, so that short
headings stay and only lines of links are cut, at the start and wherever they fill a window.

Menus, page headers and the like are known by tag, role, or a whole class or id of such words.  A form
or an element known by its class or id alone is kept if it is or holds the largest article or main
element, or holds most of the page's text and an article or main element where the page has one.

Null and empty pages give an empty text; broken markup is read as far as it goes: an unclosed
comment or script ends with the page.  Every page is judged alone, in time linear in its length.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTH, SURGE = 3, 80

_TOKEN = (
    r"""<!--(?:.*?-->|.*)"""
    r"""|<(?P<raw>script|style|noscript|template|textarea|title|svg|iframe|canvas|object|math|select)(?=[\s/>])(?:[^>]*/>|.*?</(?P=raw)\s*>|.*)"""
    r"""|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]{0,60})(?P<attrs>ATTRS)>"""
    r"""|<[!?/][^>]*>"""
)
#: Tags end at the first ">" outside quotes; LOOSE has those whose quotes never leave one outside.
TOKEN = re.compile(_TOKEN.replace("ATTRS", r"""(?:[^>"']|"[^"]*"|'[^']*')*+"""), re.S | re.I)
LOOSE = re.compile(_TOKEN.replace("ATTRS", "[^>]*"), re.S | re.I)
#: What still matters where no ">" follows.
TAIL = re.compile(_TOKEN[: _TOKEN.index("|<(?P<end>")] + "|(?P<end>(?!))(?P<tag>)(?P<attrs>)", re.S | re.I)
MARK = re.compile("""["'>]""")
BLOCK = frozenset("address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html legend li link main menu meta nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROP = frozenset("head nav footer aside form button menu dialog fieldset label datalist audio video map".split())
MAIN = frozenset(("article", "main"))
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
NAMES = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
UNWANTED = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription paywall "
    "sidebar sidenav nav navbar navigation menu breadcrumb breadcrumbs footer masthead topbar toolbar comment comments commentlist disqus respond replies reply discussion related recommended recommendations readmore share sharing "
    "social widget pagination pager login signin signup search copyright legal disclaimer skip hidden".split()
)
#: Words that go with those in one token, as in "site-footer" or "comments-area".
AFFIXES = frozenset("a the site page global main primary secondary tertiary top bottom left right upper lower inner outer sticky fixed mobile desktop area bar block box btn button buttons container form group header icon icons inline item items link links list message module panel post posts row section slot text title unit wrap wrapper js".split())
HARD, SOFT = 1, 2
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
SPACE = re.compile(r"\s+")


def _named(value: str) -> bool:
    """Whether a class or id has a whole token of UNWANTED words, with AFFIXES at most."""
    for token in value.split():
        parts = [x for x in re.split("[_-]+", token) if x]
        if not UNWANTED.isdisjoint(parts) and all(x in UNWANTED or x in AFFIXES or x.isdigit() for x in parts):
            return True
    return False


def _unwanted(tag: str, attrs: str, inside_main: bool) -> int:
    """HARD for elements to drop, SOFT for those that may turn out to hold the main text, 0 for others."""
    if tag in DROP or tag == "header" and not inside_main:
        return SOFT if tag in ("form", "fieldset") else HARD
    if not attrs or tag in ("html", "body", "main"):
        return 0
    kind = 0
    for name, *values in NAMES.findall(attrs):
        name, value = name.lower(), "".join(values).lower()
        if name in ("class", "id") and _named(value):
            kind = SOFT
        if name == "role" and value in ROLES or name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            return HARD
    return kind


def _closing(page: str) -> tuple[list[int], list[bool]]:
    """Where quotes and ">" are, and whether a ">" outside quotes follows for a tag that comes to each of them outside quotes."""
    marks = [m.start() for m in MARK.finditer(page)]
    ends = [False] * len(marks)
    later: dict[str, int] = {}
    for i in range(len(marks) - 1, -1, -1):
        c = page[marks[i]]
        if c == ">":
            ends[i] = True
        else:
            after = later.get(c, len(marks)) + 1
            ends[i] = after < len(marks) and ends[after]
            later[c] = i
    return marks, ends


def _tokens(page: str) -> Iterator[re.Match]:
    """Matches of TOKEN, and of LOOSE for tags whose quotes leave no ">" outside; that is looked up once one was met, so time stays linear."""
    marks, last = None, page.rfind(">")
    at = page.find("<")
    while 0 <= at < last:
        if marks is None:
            m = TOKEN.match(page, at)
            if not m and page[at + 1 : at + 3].lstrip("/")[:1].isalpha():
                marks, ends = _closing(page)
        if marks is not None:
            m = ends[bisect_left(marks, at)] and TOKEN.match(page, at) or LOOSE.match(page, at)
        if m:
            yield m
        at = page.find("<", m.end() if m else at + 1)
    if at >= 0 and (m := TAIL.search(page, at)):
        yield m


def lines(page: str) -> list[tuple[str, int, int]]:
    """Text, length without links, and number of its article or main element (0: none) of each line; blank where unwanted."""
    out, spared = _scan(page, frozenset())
    return _scan(page, spared)[0] if spared else out


def _spared(soft: list[tuple[int, int, int]], mains: list[tuple[int, int, int]], total: int) -> frozenset[int]:
    """Starts of the SOFT elements that are or hold the largest article or main element, or hold most of the text and such an element, if there is any."""
    mains = [x for x in mains if x[2]]
    if not mains:
        return frozenset(a for a, _, n in soft if 2 * n > total)
    best = max(mains, key=lambda x: (x[2], x[0]))
    starts = sorted(a for a, _, _ in mains)
    holds = lambda a, b: (i := bisect_left(starts, a)) < len(starts) and starts[i] < b
    return frozenset(a for a, b, n in soft if a <= best[0] and best[1] <= b or 2 * n > total and holds(a, b))


def _scan(page: str, spared: frozenset[int]) -> tuple[list[tuple[str, int, int]], frozenset[int]]:
    """The lines with ``spared`` elements kept, and the starts of those to spare."""
    out: list[tuple[str, int, int]] = []
    stack: list[tuple[str, int, int, int]] = []
    spans: dict[bool, list[tuple[int, int, int]]] = {False: [], True: []}
    hard = seen = 0
    opened: Counter[str] = Counter()
    drop = mains = links = found = at = 0
    current_main = 0
    text: list[str] = []
    linked = 0

    def end_line() -> None:
        nonlocal text, linked
        joined = SPACE.sub(" ", html.unescape("".join(text))).strip()
        if joined:
            out.append((joined, max(0, len(joined) - linked), current_main))
        text, linked = [], 0

    def close(tag: str, dropped: int, start: int, before: int) -> None:
        if dropped == SOFT:
            spans[False].append((start, at, seen - before))
        if tag in MAIN and not hard:
            spans[True].append((start, at, seen - before))

    def pop() -> None:
        nonlocal drop, hard, mains, links, current_main
        tag, dropped, start, before = stack.pop()
        close(tag, dropped, start, before)
        hard -= dropped == HARD
        opened[tag] -= 1
        if dropped:
            drop -= 1
            if not drop:
                out.extend([("", 0, current_main)] * WIDTH)
        if tag in MAIN and not dropped:
            mains -= 1
            if not mains:
                current_main = 0
        links -= tag == "a"

    def add(piece: str) -> None:
        nonlocal linked, seen
        if not hard:
            seen += len(piece.strip())
        if piece and not drop:
            text.append(piece)
            if links:
                linked += len(piece.strip())

    for m in _tokens(page):
        add(page[at : m.start()])
        at = m.end()
        tag = (m["tag"] or "").lower()
        if not tag:
            continue
        if tag in BLOCK:
            end_line()
        if m["end"]:
            if opened[tag]:
                while stack[-1][0] != tag:
                    pop()
                pop()
            continue
        if tag in VOID:
            continue
        closing = CLOSES.get(tag, set()) | ({"p"} if tag in BLOCK else set())
        while stack and stack[-1][0] in closing:
            pop()
        if tag in BLOCK and any(x[0] == "p" for x in stack[-3:]) and tag != "br":
            while stack[-1][0] != "p":
                pop()
            pop()
        attrs = m["attrs"] or ""
        if attrs.endswith("/") and tag not in BLOCK:
            continue
        dropped = _unwanted(tag, attrs, bool(mains))
        if dropped == SOFT and m.start() in spared:
            dropped = 0
        hard += dropped == HARD
        if dropped:
            if not drop:
                out.extend([("", 0, current_main)] * WIDTH)
            drop += 1
        if tag in MAIN and not dropped:
            if not mains and not drop:
                found += 1
                current_main = found
            mains += 1
        links += tag == "a"
        stack.append((tag, dropped, m.start(), seen))
        opened[tag] += 1
    add(page[at:])
    end_line()
    at = len(page)
    for x in reversed(stack):
        close(*x)
    return out, _spared(spans[False], spans[True], seen)


def _ranges(found: list[tuple[str, int, int]]) -> tuple[list[list[tuple[str, int]]], bool]:
    """Text and length of the lines of each article or main element with text, and true; else of the page, blanks included."""
    parts: dict[int, list[tuple[str, int]]] = {}
    for t, n, part in found:
        if part and t:
            parts.setdefault(part, []).append((t, n))
    marked = [rows for rows in parts.values() if any(n for _, n in rows)]
    return marked or [[(t, n) for t, n, _ in found]], bool(marked)


def main_text(page: str | None) -> str:
    """The kept lines, joined by one space."""
    keep = []
    ranges, marked = _ranges(lines(page or ""))
    for rows in ranges:
        sums = [sum(n for _, n in rows[i : i + WIDTH]) for i in range(len(rows))]
        surge, inside = 1 if marked else min(SURGE, max(sums, default=0)), False
        for (t, n), total in zip(rows, sums):
            inside = total > 0 and (inside or n > 0 and total >= surge)
            if inside and t:
                keep.append(t)
    return " ".join(keep)


def extract(df: DataFrame, *, page: str = "html", keys: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``keys``, text and n_chars (code points) for every page."""
    source = df.select(*(F.col(k) for k in keys), F.col(page).alias("__page"))
    schema = df.select(*keys).schema.add("text", "string").add("n_chars", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p.as_py()) for p in batch.column(len(keys))]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(keys))), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], [*keys, "text", "n_chars"])

    return source.mapInArrow(run, schema)

r"""Main text of web pages by line-block distribution.

Markup is stripped to lines, one per block element (br counts as white space).  Each line has a weight, its text
length without that of links.  A line of an article weighs half as much again; on a page whose articles hold half of the weight or more, other
lines weigh a quarter.  Between the lines stand blank rows, two for each container (div, section and the like) that begins or ends there.
Weights are summed over sliding windows of WINDOW rows.  Text begins at a surge point, where the sum reaches the threshold, and
reaches, both ways, to where the sum dives to nothing.  What lies between two such points and has no surge goes, whatever it is called.

A first search finds the body: the article lines, or else the container whose own lines weigh most in the heaviest stretch.  Containers
within the body leave no blank rows, so that the body is searched as one run, and a heading is joined to what follows it.  Lists of links in a
run (WINDOW lines or more) weigh nothing and are taken out.

What a class or id seems to call an advert, notice, comment or the like is searched by itself, at a tenth of its weight: the name
only makes the search stricter, a long text stays.  Elements that are never article text by their nature (menus, headers, footers, sidebars, forms, hidden
ones, and ARIA roles of these) are left out before the search.  Where a page has nothing else, names are passed over.

Null, empty and markup-only pages give an empty text; very long pages are read whole; repeated rows give repeated rows, an empty table none.  Character references are decoded as HTML5
does; white space within a block becomes one space, blocks are joined by \n.  Broken markup never raises, and an unclosed element never ends the
page, but for script, style, textarea and title, as in HTML.  Other columns stay as they are; one named like the result is replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape
from itertools import accumulate
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

WINDOW = 3
#: weight that WINDOW rows must hold; less on a page whose heaviest window holds less than twice that
THRESHOLD = 100
#: blank rows where a container begins or ends
BLANKS = 2
#: what a character counts: in an article, beside one, in what is called an advert or the like
MARKED, BESIDE, NAMED = 1.5, 0.25, 0.1

# Element names and words of class, id or role attributes.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template svg math iframe object textarea select title canvas audio video".split())
_TO_THE_END = frozenset("script style textarea title".split())
_HOLDS = frozenset("html body div section article main td th nav header footer aside form fieldset dialog menu".split())
_CHROME = frozenset("nav header footer aside form menu dialog button head".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
_CLOSES_P = _BLOCK - {"option", "optgroup", "html", "body", "head", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"}
_WORDS = frozenset(
    """ad ads adv advert adverts advertisement advertising adsense adslot adbox banner banners sponsor sponsored sponsors promo promos promotion
    nav navbar navigation menu menus submenu topbar toolbar breadcrumb breadcrumbs pager pagination sidebar sidebars rail masthead header footer
    foot copyright legal cookie cookies consent gdpr notice notices notification alert popup modal overlay lightbox newsletter subscribe subscription signup login
    search searchbox share sharing social socials related recommended recommendations trending popular widget widgets comment comments
    commentlist discussion disqus replies respond skip tags tagcloud hidden""".split()
)
#: words that say nothing about what an element holds; a name with any other word besides (legal-analysis) is not taken for chrome
_PLAIN = frozenset("a b box list block container wrapper wrap inner outer item items section area slot unit bar top bottom left right page site post article content main global sticky form link links text title thread reader user js x m s l".split())
#: words that may well name a part of an article
_MILD = frozenset("legal related notice notices search tags foot header alert comment skip discussion popular".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
_SAFE = frozenset("html body main article h1 h2 h3 h4 h5 h6".split())
_CONTENT = frozenset("article content story entry post".split())
_STATES = frozenset("has with no without is show hide hides".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)>", re.S)
_ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_SPLIT = re.compile(r"[^a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


def _attributes(attrs: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(attrs)} if attrs else {}


def _is_chrome(name: str, got: dict[str, str], in_article: bool) -> bool:
    """Whether an element is never article text, by its nature or because it is hidden."""
    if name in _CHROME:
        return not (name == "header" and in_article)
    if name in _SAFE or not got:
        return False
    if "hidden" in got or got.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", got.get("style", ""), re.I):
        return True
    return got.get("role", "").lower() in _ROLES


def _names(got: dict[str, str]):
    """The words of each class and of the id."""
    for key in ("class", "id"):
        for name in unescape(got.get(key, "")).split():
            yield [w for w in _SPLIT.split(_CAMEL.sub("-", name).lower()) if w]


def _is_named(name: str, got: dict[str, str], in_article: bool) -> bool:
    """Whether class or id seem to call an element an advert, notice, comment or the like."""
    if name in _SAFE or name not in _BLOCK:
        return False
    for words in _names(got):
        if words and words[0] not in _STATES and not _WORDS.isdisjoint(words) and _WORDS | _PLAIN >= set(words):
            if not (in_article and _MILD.issuperset(_WORDS.intersection(words))):
                return True
    return False


def _is_content(got: dict[str, str]) -> bool:
    """Whether class or id call the element the content; itemprop and the like are left out."""
    return any(not _CONTENT.isdisjoint(words) for words in _names(got))


class Line(NamedTuple):
    text: str
    linked: int  # characters in links
    level: int  # 2 within an article or an element called so, 1 within main, else 0
    chrome: bool  # within an element that is never article text
    named: int  # the number of the outermost element that is called an advert or the like; 0 for none
    holder: int  # the number of the container that holds it
    edges: int  # containers that begin or end between the line before and this one
    heading: bool

    @property
    def weight(self) -> int:
        return 0 if self.chrome else len(self.text) - self.linked


def lines_of(html: str, by_name: bool = True) -> tuple[list[Line], list[int]]:
    """Each block with text, in page order, and the container around each container."""
    out: list[Line] = []
    stack: list[tuple[str, bool, int, int, int]] = []  # name, chrome, mark, named, number
    text: list[str] = []
    linked = links = chrome = articles = mains = edges = elements = 0
    named: list[int] = []
    holders, parents = [0], [0]
    unclosed: set[str] = set()

    def end_line():
        nonlocal text, linked, edges
        line = " ".join(unescape("".join(text)).split()) if text else ""
        if line:
            level = 2 if articles else 1 if mains else 0
            out.append(Line(line, min(linked, len(line)), level, chrome > 0, named[0] if named else 0, holders[-1], edges, any(x[0] in _HEADINGS for x in stack)))
            edges = 0
        text, linked = [], 0

    def pop_to(depth: int):
        nonlocal chrome, links, articles, mains, edges
        while len(stack) > depth:
            name, was, mark, call, number = stack[-1]
            if name in _BLOCK:
                end_line()
            stack.pop()
            chrome -= was
            links -= name == "a"
            articles -= mark == 2
            mains -= mark == 1
            if call:
                named.pop()
            if number:
                holders.pop()
                edges += 1

    def add(s: str):
        nonlocal linked
        if s:
            text.append(s)
            if links:
                linked += len(s)

    at, n = 0, len(html)
    while at < n:
        lt = html.find("<", at)
        if lt < 0:
            add(html[at:])
            break
        add(html[at:lt])
        m = _TOKEN.match(html, lt)
        if not m:
            if re.match(r"</?[A-Za-z!?]", html[lt : lt + 3]):
                break  # the page ends within a tag
            add("<")
            at = lt + 1
            continue
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        if m[1] or m[4]:
            if name == "p" and not any(x[0] == "p" for x in stack):
                end_line()
                continue
            for d in range(len(stack) - 1, -1, -1):
                if stack[d][0] == name:
                    pop_to(d)
                    break
                if name not in _BLOCK and stack[d][0] in _BLOCK:
                    break  # an inline end tag doesn't close blocks
            continue
        if name == "br":
            add(" ")
            continue
        attrs = m[3] or m[6] or ""
        if name in _RAW:
            if name not in unclosed and (not attrs.rstrip().endswith("/") or name in _TO_THE_END):
                close = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(html, at)
                if close:
                    at = close.end()
                elif name in _TO_THE_END:
                    at = n
                else:
                    unclosed.add(name)  # what follows is text like any other
            continue
        if name in _CLOSES_P:
            for d in range(len(stack) - 1, -1, -1):
                if stack[d][0] == "p":
                    pop_to(d)
                    break
                if stack[d][0] in _BLOCK:
                    break
        for again, within in (("li", ("ul", "ol", "menu", "dir")), ("td", ("tr", "table")), ("th", ("tr", "table")), ("tr", ("table",)), ("dt", ("dl",)), ("dd", ("dl",)), ("option", ())):
            if name == again or {name, again} in ({"td", "th"}, {"dt", "dd"}):
                for d in range(len(stack) - 1, -1, -1):
                    if stack[d][0] == again:
                        pop_to(d)
                        break
                    if stack[d][0] in within:
                        break
        if name in _BLOCK:
            end_line()
        if name in _VOID:
            continue
        got = _attributes(attrs)
        was = _is_chrome(name, got, articles > 0)
        call = bool(by_name and not was and got and _is_named(name, got, articles > 0))
        mark = 0
        if not was and not call:
            mark = 2 if name == "article" or name in ("div", "section", "td") and got and _is_content(got) else 1 if name == "main" or got.get("role", "").lower() == "main" else 0
        number = 0
        if name in _HOLDS:
            number = len(parents)
            parents.append(holders[-1])
            holders.append(number)
            edges += 1
        if was and name not in _BLOCK:  # a hidden span or the like goes by itself
            skip = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(html, at)
            if skip and name not in unclosed:
                at = skip.end()
                continue
            unclosed.add(name)
            was = False
        elements += 1
        if call:
            named.append(elements)
        stack.append((name, was, mark, call, number))
        chrome += was
        links += name == "a"
        articles += mark == 2
        mains += mark == 1
    pop_to(0)
    end_line()
    alone = Counter(x.holder for x in out)
    return [x._replace(holder=parents[x.holder]) if alone[x.holder] == 1 else x for x in out], parents  # a div around one line is a line


def surges(weights: list[float], threshold: float) -> list[tuple[int, int]]:
    """[surge, dive) of each stretch of rows that lie in a window of WINDOW rows whose sum reaches the threshold."""
    total = [0, *accumulate(weights)]
    n, out, begin, end = len(weights), [], None, 0
    for i in range(n):
        if total[min(i + WINDOW, n)] - total[i] >= threshold:
            if begin is None or i > end:
                if begin is not None:
                    out.append((begin, end))
                begin = i
            end = min(i + WINDOW, n)
    if begin is not None:
        out.append((begin, end))
    return out


def _text_runs(rows: list[tuple[int, float]], threshold: float) -> list[list[int]]:
    """The lines of each run of rows (line or -1, weight) from one dive to nothing to the next, if a surge lies in it."""
    weights = [w for _, w in rows]
    up, out, part, k = surges(weights, threshold), [], [], 0
    blank = surged = 0
    for i, (line, w) in enumerate([*rows, *[(-1, 0.0)] * WINDOW]):
        blank = 0 if w > 0 else blank + 1
        while k < len(up) and up[k][1] <= i:
            k += 1
        surged = surged or (k < len(up) and up[k][0] <= i and w > 0)
        if line >= 0:
            part.append((line, w))
        if blank >= WINDOW:
            if surged:
                # rows without weight at either end are past the dive
                while part and part[0][1] <= 0:
                    part.pop(0)
                while part and part[-1][1] <= 0:
                    part.pop()
                out.append([x for x, _ in part])
            part, surged = [], False
    return out


def _heaviest(rows: list[tuple[int, float]]) -> float:
    total = [0, *accumulate(w for _, w in rows)]
    return max((total[min(i + WINDOW, len(rows))] - total[i] for i in range(len(rows))), default=0)


def _within(holder: int, root: int, parents: list[int]) -> bool:
    while holder > root:  # containers are numbered as they begin
        holder = parents[holder]
    return holder == root


def _rows(main: list[int], lines: list[Line], weights: list[float], body: list[bool]) -> list[tuple[int, float]]:
    """The lines with blank rows where containers begin or end outside the body."""
    rows: list[tuple[int, float]] = []
    edges, at, before = 0, 0, None
    for i in main:
        while at <= i:  # edges of lines that were left out count as well
            edges += lines[at].edges
            at += 1
        if before is not None and not lines[before].heading and not (body[before] and body[i]):
            rows += [(-1, 0.0)] * min(BLANKS * edges, 2 * WINDOW)
        rows.append((i, weights[i]))
        edges, before = 0, i
    return rows


def kept_lines(lines: list[Line], parents: list[int]) -> list[int]:
    """The numbers of the lines that are main text."""
    main, links = [], []
    for i, x in enumerate(lines):
        if x.chrome or x.named:
            continue
        links = [*links, i] if x.weight <= 0 else []
        main.append(i)
        if len(links) == WINDOW:
            main = main[:-WINDOW]
        elif len(links) > WINDOW:
            main.pop()
    whole = sum(lines[i].weight for i in main)
    level = next((v for v in (2, 1) if 2 * sum(lines[i].weight for i in main if lines[i].level >= v) >= max(1, whole)), 0)
    share = lambda x: MARKED if level and x.level >= level else BESIDE if level else 1
    weights = [x.weight * share(x) for x in lines]

    nowhere = [False] * len(lines)
    rows = _rows(main, lines, weights, nowhere)
    least = min(THRESHOLD, _heaviest(rows) / 2)
    if level == 2:
        body = [x.level == 2 for x in lines]
    else:
        found = _text_runs(rows, least) if least > 0 else []
        held: Counter = Counter()
        best = max(found, key=lambda part: sum(weights[i] for i in part), default=[])
        for i in best if len(best) > 1 else []:  # a line alone says nothing of what is around it
            held[lines[i].holder] += weights[i]
        root = max(held, key=lambda h: (held[h], -h), default=0)
        body = [_within(x.holder, root, parents) for x in lines] if held else nowhere
    rows = _rows(main, lines, weights, body)
    least = min(THRESHOLD, _heaviest(rows) / 2)
    kept = [i for part in (_text_runs(rows, least) if least > 0 else []) for i in part]

    called: dict[int, list[tuple[int, float]]] = {}
    for i, x in enumerate(lines):
        if x.named and not x.chrome:
            called.setdefault(x.named, []).append((i, NAMED * x.weight))
    return sorted([*kept, *(i for own in called.values() for part in _text_runs(own, THRESHOLD) for i in part)])


def main_text(html: str | None) -> str:
    lines, parents = lines_of(html or "")
    kept = kept_lines(lines, parents)
    if not kept and any(x.named for x in lines):
        lines, parents = lines_of(html or "", by_name=False)
        kept = kept_lines(lines, parents)
    return "\n".join(lines[i].text for i in kept)


def extract(pages: DataFrame, html_col: str = "html", text_col: str = "text") -> DataFrame:
    """pages with the main text of each as text_col, in place of the html."""
    rest = [c for c in pages.columns if c not in (html_col, text_col)]
    packed = pages.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row"), F.col(f"`{html_col}`").alias("html"))

    def rows(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([main_text(h.as_py()) for h in batch.column(1)], pa.string())], ["row", "text"])

    done = packed.mapInArrow(rows, f"row {packed.schema['row'].dataType.simpleString()}, text string")
    return done.select(*[F.col(f"row.`{c}`").alias(c) for c in rest], F.col("text").alias(text_col))

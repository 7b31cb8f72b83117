"""HTML into Markdown: a small tree of what the page says, rendered with ATX headings and - bullets."""

from __future__ import annotations

import re
from html.parser import HTMLParser

from pyspark.sql import DataFrame, functions as F

from docloom.functions.rows import per_row

# Elements that never carry content, void elements, those that part blocks.
DROPPED = frozenset("script style noscript nav header footer aside form head template svg".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article blockquote body dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 hr html li main ol p pre section summary table tbody td tfoot th thead tr ul".split())


class Node:
    __slots__ = ("name", "attrs", "children")

    def __init__(self, name: str, attrs: dict[str, str] | None = None):
        self.name, self.attrs, self.children = name, attrs or {}, []

    def text(self) -> str:
        return "".join(c if isinstance(c, str) else c.text() for c in self.children)

    def find(self, *names: str):
        for c in self.children:
            if isinstance(c, Node):
                if c.name in names:
                    yield c
                yield from c.find(*names)


class _Tree(HTMLParser):
    """Implied ends of p, li, td and the like; end tags without start are passed over."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("root")
        self.open = [self.root]

    def _close(self, names, stop=()):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].name in names:
                del self.open[i:]
                return
            if self.open[i].name in stop:
                return

    def handle_starttag(self, tag, attrs):
        if tag in BLOCK:
            self._close({"p"}, BLOCK - {"p"})
        if tag == "li":
            self._close({"li"}, {"ul", "ol"})
        elif tag in ("td", "th"):
            self._close({"td", "th"}, {"tr", "table"})
        elif tag == "tr":
            self._close({"tr"}, {"table"})
        elif tag in ("dt", "dd"):
            self._close({"dt", "dd"}, {"dl"})
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.open[-1].children.append(Node(tag, {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag):
        self._close({tag}, () if tag in BLOCK else BLOCK)

    def handle_data(self, data):
        self.open[-1].children.append(data)


def tree(html: str) -> Node:
    t = _Tree()
    t.feed(html)
    t.close()
    return t.root


def table_rows(node: Node) -> list[list[str]]:
    return [[" ".join(c.text().split()) for c in r.children if isinstance(c, Node) and c.name in ("td", "th")] for r in node.find("tr")]


def _inline(node, out: list[str]) -> None:
    for c in node.children:
        if isinstance(c, str):
            out.append(re.sub(r"\s+", " ", c))
            continue
        if c.name in DROPPED:
            continue
        inner: list[str] = []
        _inline(c, inner)
        s = "".join(inner)
        bare = s.strip()
        if c.name == "br":
            out.append("\n")
        elif c.name in ("b", "strong") and bare and not any(True for _ in c.find(*BLOCK)):
            out.append(f"**{bare}**" + " " * s.endswith(" "))
        elif c.name in ("i", "em") and bare:
            out.append(f"_{bare}_" + " " * s.endswith(" "))
        elif c.name == "code" and bare:
            out.append(f"`{bare}`")
        elif c.name == "a" and c.attrs.get("href") and bare:
            out.append(f"[{bare}]({c.attrs['href']})")
        elif c.name == "img":
            out.append(f"![{c.attrs.get('alt', '')}]({c.attrs.get('src', '')})" if c.attrs.get("src") else "")
        else:
            out.append(s)


def _flow(text: str) -> str:
    return "\n".join(re.sub(r"[ \t]+", " ", x).strip() for x in text.split("\n")).strip()


def _blocks(node: Node, depth: int = 0) -> list[str]:
    out: list[str] = []
    run = Node("run")

    def flush():
        parts: list[str] = []
        _inline(run, parts)
        s = _flow("".join(parts))
        if s:
            out.append(s)
        run.children = []

    for c in node.children:
        if isinstance(c, str):
            run.children.append(c)
            continue
        if c.name in DROPPED:
            continue
        if c.name not in BLOCK and not any(True for _ in c.find(*BLOCK)):
            run.children.append(c)
            continue
        flush()
        if re.fullmatch("h[1-6]", c.name):
            parts: list[str] = []
            _inline(c, parts)
            s = " ".join("".join(parts).split())
            if s:
                out.append("#" * int(c.name[1]) + " " + s)
        elif c.name == "pre":
            out.append("```\n" + c.text().strip("\n") + "\n```")
        elif c.name in ("ul", "ol"):
            items, n = [], 0
            for li in c.children:
                if isinstance(li, Node) and li.name not in DROPPED:
                    n += 1
                    body = "\n".join(_blocks(li, depth + 1)).replace("\n", "\n  ")
                    if body.strip():
                        items.append((f"{n}. " if c.name == "ol" else "- ") + body)
            if items:
                out.append("\n".join(items))
        elif c.name == "table":
            md = markdown_table(table_rows(c))
            if md:
                out.append(md)
        elif c.name == "blockquote":
            out.append("\n".join(("> " + x).rstrip() for x in "\n\n".join(_blocks(c, depth)).split("\n")))
        elif c.name == "hr":
            out.append("---")
        else:
            out += _blocks(c, depth)
    flush()
    return [x for x in out if x.strip()]


def markdown_table(rows: list[list[str]]) -> str:
    width = max((len(r) for r in rows), default=0)
    if not width:
        return ""
    clean = lambda s: re.sub(r"\r?\n", " ", s.replace("|", "\\|")).strip()
    lines = ["| " + " | ".join([clean(x) for x in r] + [""] * (width - len(r))) + " |" for r in rows]
    if len(lines) > 1:
        lines.insert(1, "| " + " | ".join(["---"] * width) + " |")
    return "\n".join(lines)


def to_markdown(html: str) -> str:
    return re.sub(r"\n{3,}", "\n\n", "\n\n".join(_blocks(tree(html)))).strip()


def plain_text(html: str) -> str:
    """The content's text without markup, white space collapsed."""

    def walk(n: Node):
        for c in n.children:
            if isinstance(c, str):
                yield c
            elif c.name not in DROPPED:
                if c.name in BLOCK or c.name == "br":
                    yield " "
                yield from walk(c)
                if c.name in BLOCK:
                    yield " "

    return " ".join("".join(walk(tree(html))).split())


def convert(pages: DataFrame, html_col: str = "html", out_col: str = "markdown", text_only: bool = False) -> DataFrame:
    """pages with the Markdown of each; null stays null."""

    def one(h: str | None) -> str | None:
        return None if h is None else (plain_text(h) if text_only else to_markdown(h))

    return pages.withColumn(out_col, per_row(one, "string", F.col(html_col)))

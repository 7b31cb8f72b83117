"""PDF text layers: positioned runs per page, from plain or Flate streams, object streams and fonts with a ToUnicode map.

Pages come in the order of the page tree.  A stream that can't be inflated, or that inflates to more than
STREAM_BYTES, is an error of the file: nothing is cut or passed over silently.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

_OBJ = re.compile(rb"(\d+)\s+\d+\s+obj\b(.*?)\bendobj", re.S)
_STREAM = re.compile(rb"(.*?)\bstream\r?\n(.*?)\r?\n?endstream", re.S)
_TOKEN = re.compile(rb"\((?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|/[^\s/\[\]()<>]+|[+-]?(?:\d+\.?\d*|\.\d+)|[A-Za-z'\"*]+", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
STREAM_BYTES = 256 << 20
#: items that are handed on together; a batch of files has many times more
ITEMS_AT_ONCE = 4096
SCHEMA = "page int, item_no int, text string, x double, y double, width double, height double"


def _string(tok: bytes) -> bytes:
    if tok[:1] == b"<":
        h = re.sub(rb"\s", b"", tok[1:-1])
        raw = bytes.fromhex((h + b"0" * (len(h) % 2)).decode())
    else:
        raw = re.sub(rb"\\([0-7]{1,3}|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() else _ESCAPES.get(m[1], m[1]), tok[1:-1], flags=re.S)
    return raw


def _plain(raw: bytes) -> str:
    return raw.decode("utf-16-be", "replace")[1:] if raw[:2] == b"\xfe\xff" else raw.decode("cp1252", "replace")


class PdfError(ValueError):
    pass


def _stream(body: bytes) -> bytes | None:
    """The bytes of an object's stream, inflated; None if it has none."""
    m = _STREAM.search(body)
    if not m:
        return None
    if b"FlateDecode" not in m[1]:
        if b"/Filter" in m[1]:
            raise PdfError("a stream has a filter other than Flate")
        return m[2]
    inflate = zlib.decompressobj()
    try:
        data = inflate.decompress(m[2], STREAM_BYTES)
    except zlib.error as e:
        raise PdfError(f"a stream can't be inflated: {e}") from e
    if inflate.unconsumed_tail:
        raise PdfError("a stream inflates to more than the limit")
    return data


def _objects(data: bytes) -> dict[int, bytes]:
    """Objects by number, those within object streams too."""
    out = {int(n): body for n, body in _OBJ.findall(data)}
    for body in [b for b in out.values() if re.search(rb"/Type\s*/ObjStm", b)]:
        inner, first = _stream(body), re.search(rb"/First\s+(\d+)", body)
        if inner is None or not first:
            continue
        head = [int(x) for x in inner[: int(first[1])].split()]
        starts = [int(first[1]) + x for x in head[1::2]]
        for n, a, b in zip(head[::2], starts, [*starts[1:], len(inner)]):
            out.setdefault(n, inner[a:b])
    return out


def _pages(objects: dict[int, bytes]) -> list[bytes]:
    """Pages in the order of the page tree; in object order if there is none."""
    loose = [body for _, body in sorted(objects.items()) if re.search(rb"/Type\s*/Page(?![a-zA-Z])", body)]
    root = next((m[1] for b in objects.values() if re.search(rb"/Type\s*/Catalog", b) and (m := re.search(rb"/Pages\s+(\d+)\s+\d+\s+R", b))), None)
    out, todo, seen = [], [int(root)] if root else [], set()
    while todo:
        n = todo.pop()
        body = objects.get(n, b"")
        kids = re.search(rb"/Kids\s*\[([^\]]*)\]", body)
        if n in seen:
            continue
        seen.add(n)
        if kids:
            todo += [int(k) for k in re.findall(rb"(\d+)\s+\d+\s+R", kids[1])][::-1]
        elif body:
            out.append(body)
    return out or loose


def _unicode_map(cmap: bytes) -> dict[bytes, str]:
    """Character codes and the text they stand for."""
    text = lambda h: bytes.fromhex(h.decode()).decode("utf-16-be", "replace")
    out: dict[bytes, str] = {}
    for part in re.findall(rb"beginbfchar(.*?)endbfchar", cmap, re.S):
        for code, to in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]*)>", part):
            out[bytes.fromhex(code.decode())] = text(to)
    for part in re.findall(rb"beginbfrange(.*?)endbfrange", cmap, re.S):
        for low, high, to, many in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*(?:<([0-9A-Fa-f]+)>|\[([^\]]*)\])", part):
            a, b, size = int(low, 16), int(high, 16), len(low) // 2
            each = re.findall(rb"<([0-9A-Fa-f]+)>", many)
            for i in range(min(b - a, 0xFFFF) + 1):
                to_text = (text(each[i]) if i < len(each) else "") if many else text(to)[:-1] + chr(ord(text(to)[-1]) + i)
                out[(a + i).to_bytes(size, "big")] = to_text
    return out


def _fonts(page: bytes, objects: dict[int, bytes]) -> dict[str, dict[bytes, str]]:
    """ToUnicode maps of a page's fonts, by the names that its content uses."""
    def follow(body: bytes, key: bytes) -> bytes:
        m = re.search(key + rb"\s*(?:(\d+)\s+\d+\s+R|(<<.*))", body, re.S)
        return b"" if not m else objects.get(int(m[1]), b"") if m[1] else m[2]

    out = {}
    for name, ref in re.findall(rb"/([^\s/<>\[\]()]+)\s+(\d+)\s+\d+\s+R", follow(follow(page, rb"/Resources") or page, rb"/Font(?![a-zA-Z])")):
        m = re.search(rb"/ToUnicode\s+(\d+)\s+\d+\s+R", objects.get(int(ref), b""))
        if m and (cmap := _stream(objects.get(int(m[1]), b""))):
            out["/" + name.decode("latin-1")] = _unicode_map(cmap)
    return out


def _decoded(raw: bytes, known: dict[bytes, str]) -> str:
    sizes, out, i = sorted({len(k) for k in known}, reverse=True), [], 0
    while i < len(raw):
        size = next((n for n in sizes if raw[i : i + n] in known), 0)
        out.append(known[raw[i : i + size]] if size else "" if sizes[0] > 1 else raw[i : i + 1].decode("cp1252", "replace"))
        i += size or sizes[0]
    return "".join(out)


def runs(content: bytes, fonts: dict[str, dict[bytes, str]] | None = None) -> Iterator[tuple[str, float, float, float, float]]:
    """(text, x, y, width, height) of a content stream's text operators; widths are estimated."""
    args: list = []
    known: dict[bytes, str] = {}
    tm = lm = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
    size, leading, stack = 10.0, 0.0, None

    def moved(dx, dy):
        a, b, c, d, e, f = lm
        return (a, b, c, d, a * dx + c * dy + e, b * dx + d * dy + f)

    for m in _TOKEN.finditer(content):
        t = m[0]
        if t == b"[":
            stack = []
        elif t == b"]":
            args.append(stack or [])
            stack = None
        elif t[:1] in b"(<":
            (args if stack is None else stack).append(_string(t))
        elif re.fullmatch(rb"[+-]?(?:\d+\.?\d*|\.\d+)", t):
            (args if stack is None else stack).append(float(t))
        elif t[:1] == b"/":
            args.append(t.decode("latin-1"))
        else:
            op = t.decode("latin-1")
            try:
                if op == "BT":
                    tm = lm = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
                elif op == "Tf":
                    size = float(args[-1])
                    known = (fonts or {}).get(args[-2] if len(args) > 1 else "", {})
                elif op == "TL":
                    leading = float(args[-1])
                elif op == "Tm":
                    tm = lm = tuple(float(a) for a in args[-6:])
                elif op in ("Td", "TD"):
                    if op == "TD":
                        leading = -args[-1]
                    tm = lm = moved(args[-2], args[-1])
                elif op == "T*":
                    tm = lm = moved(0, -leading)
                elif op in ("Tj", "TJ", "'", '"'):
                    if op in "'\"":
                        tm = lm = moved(0, -leading)
                    parts = args[-1] if isinstance(args[-1], list) else [args[-1]]
                    text = "".join((_decoded(p, known) if known else _plain(p)) if isinstance(p, bytes) else " " if p < -180 else "" for p in parts)
                    height = abs(tm[3] * size) or 10.0
                    width = 0.5 * abs(tm[0] * size) * len(text)
                    yield text, tm[4], tm[5], width, height
                    tm = (*tm[:4], tm[4] + width, tm[5])
            except (IndexError, TypeError, ValueError):
                pass
            args = []


def items(data: bytes) -> Iterator[tuple[int, int, str, float, float, float, float]]:
    """Rows of SCHEMA, pages from 1 in the order of the page tree."""
    objects = _objects(data)
    for number, page in enumerate(_pages(objects), 1):
        refs = re.search(rb"/Contents\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", page)
        fonts = _fonts(page, objects)
        parts = [_stream(objects.get(int(ref), b"")) for ref in re.findall(rb"(\d+)\s+\d+\s+R", refs[1])] if refs else []
        for k, run in enumerate(runs(b"\n".join(p for p in parts if p), fonts)):
            yield number, k, *run


def read_items(files: DataFrame, id_col: str = "path", content_col: str = "content") -> DataFrame:
    """page_items of each file: id, page, item_no, text, x, y, width, height; of a broken file one row without a page, its error."""

    def of(key, content) -> list[tuple]:
        try:
            return [(key, *r, None) for r in items(bytes(content))]
        except (PdfError, ValueError, IndexError) as e:
            return [(key, None, None, None, None, None, None, None, str(e))]

    def frame(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=[id_col, "page", "item_no", "text", "x", "y", "width", "height", "error"])
        return out.astype({"page": "Int32", "item_no": "Int32"})

    def run(frames):
        for f in frames:
            rows: list[tuple] = []
            for i, c in zip(f[id_col], f[content_col], strict=True):
                rows += of(i, c)
                if len(rows) >= ITEMS_AT_ONCE:
                    yield frame(rows)
                    rows = []
            yield frame(rows)

    return files.select(id_col, content_col).mapInPandas(run, f"{id_col} {files.schema[id_col].dataType.simpleString()}, {SCHEMA}, error string")

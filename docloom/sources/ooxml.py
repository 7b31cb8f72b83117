"""DOCX, XLSX and PPTX, read with the standard library; containers that would unpack too far are refused."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark.sql import DataFrame, functions as F

from docloom.functions import constants as C
from docloom.sources.html import markdown_table


class OfficeError(ValueError):
    pass


def _name(e) -> str:
    return e.tag.rpartition("}")[2]


def _attr(e, name: str) -> str | None:
    return next((v for k, v in e.attrib.items() if k.rpartition("}")[2] == name), None)


def open_container(data: bytes) -> dict[str, bytes]:
    """Members by path.  Declared and real sizes are held to the limits."""
    try:
        z = zipfile.ZipFile(io.BytesIO(data))
    except zipfile.BadZipFile as e:
        raise OfficeError("not an OOXML container; legacy files must be saved as docx, xlsx or pptx first") from e
    total, out = 0, {}
    if any(i.file_size > C.ENTRY_BYTES for i in z.infolist()) or sum(i.file_size for i in z.infolist()) > C.ARCHIVE_BYTES:
        raise OfficeError("the container unpacks to more than the limit")
    for info in z.infolist():
        if info.filename.endswith((".xml", ".rels")):
            with z.open(info) as f:
                body = f.read(C.ENTRY_BYTES + 1)
            total += len(body)
            if len(body) > C.ENTRY_BYTES or total > C.ARCHIVE_BYTES:
                raise OfficeError("the container unpacks to more than the limit")
            out[info.filename] = body
    return out


def subtype(members) -> str | None:
    """docx, xlsx or pptx by the members' paths, whatever the file is called."""
    for path, kind in (("word/document.xml", "docx"), ("xl/workbook.xml", "xlsx"), ("ppt/presentation.xml", "pptx")):
        if path in members:
            return kind
    return None


def _xml(members: dict[str, bytes], path: str):
    return ElementTree.fromstring(members[path]) if path in members else None


def relations(members: dict[str, bytes], path: str) -> dict[str, tuple[str, str]]:
    """id -> (target path, type) of a part's relationships."""
    folder, _, file = path.rpartition("/")
    root = _xml(members, f"{folder}/_rels/{file}.rels")
    out = {}
    for r in root if root is not None else ():
        target = r.get("Target", "")
        out[r.get("Id", "")] = (target.lstrip("/") if target.startswith("/") else posixpath.normpath(f"{folder}/{target}"), r.get("Type", ""))
    return out


def text_of(e, tag: str = "t") -> str:
    return "".join(x.text or "" for x in e.iter() if _name(x) == tag)


# --- xlsx -------------------------------------------------------------------------------------
def column_index(ref: str) -> int:
    n = 0
    for c in re.match("[A-Za-z]*", ref)[0].upper():
        n = n * 26 + ord(c) - 64
    return n - 1


def xlsx_cells(data: bytes | dict[str, bytes]) -> Iterator[tuple[int, str, int, int, str]]:
    """(sheet number, sheet, row, column, value), rows and columns from 0."""
    m = data if isinstance(data, dict) else open_container(data)
    root = _xml(m, "xl/sharedStrings.xml")
    shared = [text_of(si) for si in root if _name(si) == "si"] if root is not None else []
    rels = relations(m, "xl/workbook.xml")
    book = _xml(m, "xl/workbook.xml")
    sheets = [e for e in (book.iter() if book is not None else ()) if _name(e) == "sheet"]
    for n, s in enumerate(sheets):
        rid = next((v for k, v in s.attrib.items() if k.endswith("}id")), "")
        part = rels.get(rid, (f"xl/worksheets/sheet{n + 1}.xml", ""))[0]
        sheet = _xml(m, part)
        if sheet is None:
            continue
        name, any_cell = s.get("name") or f"Sheet{n + 1}", False
        r = -1
        for row in (e for e in sheet.iter() if _name(e) == "row"):
            r = int(row.get("r")) - 1 if (row.get("r") or "").isdigit() else r + 1
            c = -1
            for cell in (e for e in row if _name(e) == "c"):
                c = column_index(cell.get("r")) if cell.get("r") else c + 1
                kind, v = cell.get("t"), next((x.text or "" for x in cell if _name(x) == "v"), "")
                if kind == "s":
                    v = shared[int(v)] if v.isdigit() and int(v) < len(shared) else ""
                elif kind == "inlineStr":
                    v = text_of(cell)
                elif kind == "b":
                    v = "TRUE" if v == "1" else "FALSE"
                any_cell = True
                yield n, name, r, c, v
        if not any_cell:
            yield n, name, -1, -1, ""


def xlsx_to_markdown(data: bytes | dict[str, bytes]) -> str:
    by: dict[int, tuple[str, dict[tuple[int, int], str]]] = {}
    for n, name, r, c, v in xlsx_cells(data):
        grid = by.setdefault(n, (name, {}))[1]
        if v != "":
            grid[r, c] = v
    out = []
    for _, (name, grid) in sorted(by.items()):
        if not grid:
            out.append(f"## {name}\n\n_(empty sheet)_")
            continue
        wide = max(c for _, c in grid) + 1
        rows = [[grid.get((r, c), "") for c in range(wide)] for r in range(max(r for r, _ in grid) + 1)]
        out.append(f"## {name}\n\n{markdown_table(rows)}")
    return "\n\n".join(out)


# --- pptx -------------------------------------------------------------------------------------
def pptx_slides(data: bytes | dict[str, bytes]) -> Iterator[tuple[int, str]]:
    """(number, Markdown) of each slide, in the order of the files' numbers; notes by relationship."""
    m = data if isinstance(data, dict) else open_container(data)
    paths = sorted((p for p in m if re.fullmatch(r"ppt/slides/slide\d+\.xml", p)), key=lambda p: int(re.search(r"\d+", p)[0]))
    for n, path in enumerate(paths, 1):
        parts: list[str] = []

        def walk(e, parts=parts):
            for c in e:
                if _name(c) == "graphicFrame":
                    rows = [[" ".join(text_of(tc).split()) for tc in tr if _name(tc) == "tc"] for tr in c.iter() if _name(tr) == "tr"]
                    parts.append(markdown_table(rows))
                elif _name(c) == "p":
                    parts.append(text_of(c).strip())
                else:
                    walk(c)

        walk(_xml(m, path))
        for target, kind in relations(m, path).values():
            if kind.endswith("/notesSlide") and target in m:
                said = [text_of(p).strip() for p in _xml(m, target).iter() if _name(p) == "p"]
                said = [s for s in said if s and s != str(n)]
                if said:
                    parts.append("\n".join(f"> {s}" for s in said))
        body = "\n\n".join(p for p in parts if p)
        yield n, f"## Slide {n}\n\n{body or '_(empty slide)_'}"


def pptx_to_markdown(data: bytes | dict[str, bytes]) -> str:
    return "\n\n".join(md for _, md in pptx_slides(data))


# --- docx -------------------------------------------------------------------------------------
def docx_to_markdown(data: bytes | dict[str, bytes]) -> str:
    m = data if isinstance(data, dict) else open_container(data)
    body = next((e for e in _xml(m, "word/document.xml") if _name(e) == "body"), None)
    rels, out = relations(m, "word/document.xml"), []

    def run_text(p) -> str:
        parts = []
        for c in p:
            if _name(c) == "hyperlink":
                target = rels.get(_attr(c, "id") or "", ("", ""))[0]
                parts.append(f"[{run_text(c)}]({target.removeprefix('word/')})" if target else run_text(c))
            elif _name(c) == "r":
                s = "".join((x.text or "") if _name(x) == "t" else "\t" if _name(x) == "tab" else "\n" if _name(x) == "br" else "" for x in c)
                on = lambda tag, c=c: any(_name(x) == tag and _attr(x, "val") not in ("0", "false", "none") for pr in c if _name(pr) == "rPr" for x in pr)
                if s.strip() and on("b"):
                    s = f"**{s.strip()}**" + " " * s.endswith(" ")
                elif s.strip() and on("i"):
                    s = f"_{s.strip()}_" + " " * s.endswith(" ")
                parts.append(s)
            elif _name(c) in ("ins", "smartTag", "sdt", "sdtContent"):
                parts.append(run_text(c))
        return "".join(parts)

    def block(e):
        if _name(e) == "p":
            style, listed, level = "", False, 0
            for pr in (x for x in e if _name(x) == "pPr"):
                for x in pr:
                    if _name(x) == "pStyle":
                        style = _attr(x, "val") or ""
                    if _name(x) == "numPr":
                        listed = True
                        level = next((int(_attr(y, "val") or 0) for y in x if _name(y) == "ilvl"), 0)
            text = run_text(e).strip()
            if not text:
                return
            h = re.fullmatch(r"(?i)heading\s?([1-6])", style)
            if h or style.lower() == "title":
                out.append("#" * (int(h[1]) if h else 1) + " " + text.replace("**", ""))
            elif listed:
                item = "  " * level + "- " + text
                if out and re.match(r"\s*- ", out[-1]):
                    out[-1] += "\n" + item
                else:
                    out.append(item)
            else:
                out.append(text)
        elif _name(e) == "tbl":
            rows = [[" ".join(" ".join(run_text(p) for p in tc.iter() if _name(p) == "p").split()) for tc in tr if _name(tc) == "tc"] for tr in e if _name(tr) == "tr"]
            out.append(markdown_table(rows))
        else:
            for c in e:
                block(c)

    for e in body if body is not None else ():
        block(e)
    return "\n\n".join(x for x in out if x)


def to_markdown(data: bytes) -> str:
    if data[:8].hex() == "d0cf11e0a1b11ae1":
        raise OfficeError("a legacy Office file: save it as docx, xlsx or pptx")
    m = open_container(data)
    kind = subtype(m)
    if kind is None:
        raise OfficeError("the container is no docx, xlsx or pptx")
    return {"docx": docx_to_markdown, "xlsx": xlsx_to_markdown, "pptx": pptx_to_markdown}[kind](m)


ERRORS = (OfficeError, ElementTree.ParseError, KeyError, RuntimeError, zipfile.BadZipFile)


def convert(files: DataFrame, content_col: str = "content") -> DataFrame:
    """files with result: struct(ok, markdown, error); a bad file is a row with its error, not a failed job."""

    @F.pandas_udf("ok boolean, markdown string, error string")
    def run(col):
        import pandas as pd

        def one(b):
            try:
                return True, to_markdown(bytes(b)), None
            except ERRORS as e:
                return False, None, str(e)

        return pd.DataFrame([one(b) for b in col], columns=["ok", "markdown", "error"])

    return files.withColumn("result", run(F.col(content_col)))

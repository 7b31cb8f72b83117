"""CSV with any of four delimiters, and JSON, into Markdown, one document per row."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, functions as F

from docloom.sources.html import markdown_table

DELIMITERS = (",", "\t", ";", "|")


def split_line(line: str, delimiter: str) -> list[str]:
    """Fields of a record; quotes protect delimiters and line ends, two of them are one."""
    out, field, quoted, i = [], [], False, 0
    while i < len(line):
        c = line[i]
        if quoted:
            if c == '"' and line[i + 1 : i + 2] == '"':
                field.append('"')
                i += 1
            elif c == '"':
                quoted = False
            else:
                field.append(c)
        elif c == '"':
            quoted = True
        elif c == delimiter:
            out.append("".join(field))
            field = []
        else:
            field.append(c)
        i += 1
    return [*out, "".join(field)]


def detect(rows: list[str]) -> str:
    best, score = ",", 0
    for d in DELIMITERS:
        widths = [len(split_line(r, d)) for r in rows[:10]]
        if widths and widths[0] >= 2 and widths.count(widths[0]) * widths[0] > score:
            best, score = d, widths.count(widths[0]) * widths[0]
    return best


def records(text: str) -> list[str]:
    """Physical lines joined until quotes are even; blank records are left out."""
    out, held = [], ""
    for line in text.replace("\r\n", "\n").replace("\r", "\n").split("\n"):
        held = f"{held}\n{line}" if held else line
        if held.count('"') % 2 == 0:
            if held.strip():
                out.append(held)
            held = ""
    return out + [held] * bool(held.strip())


def csv_rows(text: str) -> list[list[str]]:
    rows = records(text)
    d = detect(rows)
    return [[f.strip() for f in split_line(r, d)] for r in rows]


def csv_to_markdown(text: str) -> str:
    return markdown_table(csv_rows(text))


def _scalar(v) -> str:
    if v is None:
        return ""
    if isinstance(v, bool):
        return "true" if v else "false"
    return str(int(v)) if isinstance(v, float) and v.is_integer() and abs(v) < 1e15 else str(v)


def json_to_markdown(text: str) -> str:
    """A table for an array of flat objects, fenced JSON otherwise, the trimmed input if it is no JSON."""
    try:
        data = json.loads(text)
    except ValueError:
        return text.strip()
    if isinstance(data, list) and data and all(isinstance(r, dict) and not any(isinstance(v, (dict, list)) for v in r.values()) for r in data):
        keys = list(dict.fromkeys(k for r in data for k in r))
        return markdown_table([keys, *[[_scalar(r.get(k)) for k in keys] for r in data]])
    return "```json\n" + json.dumps(data, indent=2, ensure_ascii=False) + "\n```"


def convert(docs: DataFrame, kind: str, text_col: str = "text", out_col: str = "markdown") -> DataFrame:
    run_one = {"csv": csv_to_markdown, "json": json_to_markdown}[kind]

    @F.pandas_udf("string")
    def run(col):
        return col.map(lambda t: None if t is None else run_one(t))

    return docs.withColumn(out_col, run(F.col(text_col)))

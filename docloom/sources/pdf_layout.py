"""Page geometry: positioned runs into rows, cells, tables with spanning headers and indents, and prose."""

from __future__ import annotations

import re
from statistics import median

from pyspark.sql import Column, DataFrame, Window, functions as F

from docloom.functions import constants as C
from docloom.functions.rows import per_row
from docloom.sources.html import markdown_table

# Tolerances in points, or as a share of the font height.
ROW_TOLERANCE, CELL_GAP, SPACE_SHARE, SPACE_LEAST = 0.6, 5.0, 0.2, 0.5
TABLE_CELLS, TABLE_ROWS, INDENT_SLACK = 3, 2, 2.0
EMPTY_CHARS, EMPTY_CHARS_PER_PAGE = 20, 10
_NUMBERS = re.compile(r"(?:^|\s)\(?\d[\d,.]*\)?%?(?=\s|$)")


def group_rows(runs: list[dict]) -> list[list[dict]]:
    """Rows of runs, from the top; a run joins a row while near the row's first run."""
    runs = [r for r in runs if r["text"].strip()]
    if not runs:
        return []
    tolerance = max(1.0, ROW_TOLERANCE * median(r["height"] for r in runs))
    rows: list[list[dict]] = []
    for r in sorted(runs, key=lambda r: -r["y"]):
        if rows and abs(rows[-1][0]["y"] - r["y"]) <= tolerance:
            rows[-1].append(r)
        else:
            rows.append([r])
    return [sorted(row, key=lambda r: r["x"]) for row in rows]


def cells(row: list[dict]) -> list[dict]:
    """Runs that nearly touch are one cell; a gap of a fifth of the font height is a space."""
    out: list[dict] = []
    for r in row:
        end = r["x"] + r["width"]
        if out and r["x"] - out[-1]["end"] < CELL_GAP:
            last = out[-1]
            gap = r["x"] - last["end"]
            space = gap >= max(SPACE_LEAST, SPACE_SHARE * r["height"]) and not last["text"].endswith(" ") and not r["text"].startswith(" ")
            last["text"] += " " * space + r["text"]
            last["end"] = max(last["end"], end)
        else:
            out.append({"text": r["text"], "x": r["x"], "end": end})
    return [{**c, "text": c["text"].strip()} for c in out]


def corridors(rows: list[list[dict]]) -> list[float]:
    """Middles of the vertical gaps that no cell of the rows crosses."""
    spans = sorted((c["x"], c["end"]) for row in rows for c in row)
    out, reach = [], None
    for a, b in spans:
        if reach is not None and a - reach >= CELL_GAP:
            out.append((a + reach) / 2)
        reach = b if reach is None else max(reach, b)
    return out


def column_of(c: dict, bounds: list[float]) -> int:
    return sum((c["x"] + c["end"]) / 2 > b for b in bounds)


def segment(rows: list[list[dict]]) -> list[tuple[str, list[list[dict]]]]:
    """Runs of rows as (table or prose, rows)."""
    out: list[tuple[str, list]] = []
    for row in rows:
        kind = "table" if len(row) >= TABLE_CELLS else "prose"
        if out and out[-1][0] == kind:
            out[-1][1].append(row)
        else:
            out.append((kind, [row]))
    merged: list[tuple[str, list]] = []
    for kind, part in out:
        kind = kind if kind == "prose" or len(part) >= TABLE_ROWS else "prose"
        if merged and merged[-1][0] == kind == "prose":
            merged[-1][1].extend(part)
        else:
            merged.append((kind, part))
    return merged


def spans_over(row: list[dict], table: list[list[dict]], bounds: list[float]) -> bool:
    """Whether a prose row above a table is a header that spans its columns."""
    left, right = min(c["x"] for r in table for c in r), max(c["end"] for r in table for c in r)
    return 2 <= len(row) <= max(2, len(bounds)) and row[0]["x"] >= left - CELL_GAP and row[-1]["end"] <= right + CELL_GAP


def fold_header(labels: list[dict], names: list[str], bounds: list[float]) -> list[str]:
    """Column names prefixed with the label over them: from where the one before ended to its own right edge."""
    out, first = list(names), 1
    for label in labels:
        end = sum(label["end"] > b for b in bounds)  # the column its right edge lies in
        for k in range(first, end + 1):
            out[k] = f"{label['text']} {names[k]}" if names[k] else names[k]
        first = max(first, end + 1)
    return out


def qualify(rows: list[list[dict]], grid: list[list[str]], bounds: list[float]) -> None:
    """A row's first cell, in whatever column, gets the path of the labels further left above it."""
    above: list[tuple[float, str]] = []
    for row, line in zip(rows, grid, strict=True):
        k = column_of(row[0], bounds) if row else 0
        if not row or not line[k]:
            continue
        x = row[0]["x"]
        while above and above[-1][0] >= x - INDENT_SLACK:
            above.pop()
        if above:
            line[k] = f"{above[-1][1]} › {line[k]}"
        above.append((x, line[k]))


def render_table(rows: list[list[dict]], header: list[dict] | None = None) -> str | None:
    bounds = corridors(rows)
    if not bounds:
        return None
    grid = []
    for row in rows:
        line = [""] * (len(bounds) + 1)
        for c in row:
            k = column_of(c, bounds)
            line[k] = f"{line[k]} {c['text']}".strip()
        grid.append(line)
    qualify(rows[1:], grid[1:], bounds)
    if header:
        grid[0] = fold_header(header, grid[0], bounds)
    used = [k for k in range(len(bounds) + 1) if any(line[k] for line in grid)]
    return markdown_table([[line[k] for k in used] for line in grid])


def _flattened(line: str) -> bool:
    return "|" not in line and len(_NUMBERS.findall(line)) >= C.TABLE_ROW_NUMERIC_CLUSTERS


def render_prose(rows: list[list[dict]]) -> str:
    """Wrapped lines are joined, words cut at a line's end too; ends of sentences, bullets and numbers stay apart."""
    out: list[str] = []
    for row in rows:
        line = " ".join(c["text"] for c in row).strip()
        if not line:
            continue
        joins = out and not re.search(r"[.!?:;]$", out[-1]) and not re.match(r"(?:[-*•–]|\d+[.)])\s", line) and not _flattened(line) and not _flattened(out[-1])
        if joins and re.search(r"[a-zà-ÿ]-$", out[-1]) and re.match(r"[a-zà-ÿ]", line):
            out[-1] = out[-1][:-1] + line
        elif joins:
            out[-1] += " " + line
        else:
            out.append(line)
    return "\n".join(out)


def page_markdown(runs: list[dict]) -> str:
    parts = segment([cells(r) for r in group_rows(runs)])
    out: list[str] = []
    for i, (kind, rows) in enumerate(parts):
        if kind == "prose":
            if i + 1 < len(parts) and rows and parts[i + 1][0] == "table" and spans_over(rows[-1], parts[i + 1][1], corridors(parts[i + 1][1])):
                rows = rows[:-1]
            out.append(render_prose(rows))
            continue
        header = parts[i - 1][1][-1] if i and spans_over(parts[i - 1][1][-1], rows, corridors(rows)) else None
        out.append(render_table(rows, header) or render_prose(rows))
    return "\n\n".join(x for x in out if x)


def layout(page_items: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """doc, page, markdown: one page per group, which is what bounds a group.  A page is a row of runs, so that Python sees batches of pages."""
    number = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))).alias(c)
    run = F.struct(F.col("item_no").isNull().alias("last"), "item_no", "text", *map(number, ("x", "y", "width", "height")))
    pages = page_items.groupBy(id_col, F.col("page").cast("int").alias("page")).agg(F.array_sort(F.collect_list(run)).alias("runs"))
    return pages.select(id_col, "page", per_row(page_markdown, "string", F.col("runs")).alias("markdown"))


def join_pages(pages: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """doc, markdown, n_pages, and whether it is empty: fewer characters than a text layer would have."""
    parts = F.filter(F.array_sort(F.collect_list(F.struct("page", "markdown"))), lambda p: F.trim(p["markdown"]) != "")
    g = pages.groupBy(id_col).agg(F.array_join(F.transform(parts, lambda p: p["markdown"]), "\n\n").alias("markdown"), F.count("*").alias("n_pages"))
    return g.withColumn("empty", F.length(F.regexp_replace("markdown", r"\s", "")) < F.greatest(F.lit(EMPTY_CHARS), EMPTY_CHARS_PER_PAGE * F.col("n_pages")))


def page_corridors(spans: DataFrame, *keys: str) -> DataFrame:
    """keys, boundary: the same gaps as a window: an interval begins where no earlier one reaches."""
    by = Window.partitionBy(*keys).orderBy("x", "end").rowsBetween(Window.unboundedPreceding, -1)
    x = spans.withColumn("reach", F.max("end").over(by))
    return x.filter(F.col("x") - F.col("reach") >= CELL_GAP).select(*keys, ((F.col("x") + F.col("reach")) / 2).alias("boundary"))


def column_number(middle: Column, bounds: Column) -> Column:
    """Range lookup: the number of boundaries left of a cell's middle."""
    return F.size(F.filter(bounds, lambda b: middle > b))

"""Grids into Markdown tables; delimiters, flat JSON and cell references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from docloom.functions import text as T

DELIMITERS = [",", "\t", ";", "|"]


def cell(c: Column) -> Column:
    return T.js_trim(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"\|", r"\\|"), r"\r?\n", " "))


def to_markdown(rows: Column) -> Column:
    """A Markdown table from array<array<string>>; short rows are padded, a rule follows the first of several."""
    width = F.array_max(F.transform(rows, lambda r: F.size(r)))
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.concat(F.transform(r, cell), F.array_repeat(F.lit(""), F.greatest(F.lit(0), width - F.size(r)))), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))
    lines = F.transform(rows, line)
    out = F.concat(F.slice(lines, 1, 1), F.when(F.size(rows) > 1, F.array(rule)).otherwise(F.array().cast("array<string>")), F.slice(lines, 2, F.greatest(F.lit(1), F.size(rows))))
    return F.when((F.size(rows) > 0) & (width > 0), F.array_join(out, "\n")).otherwise(F.lit(""))


def detect_delimiter(c: Column | str) -> Column:
    """Of , tab ; | the one with the best score over the first ten rows: rows as wide as the first, times width."""
    rows = F.slice(F.filter(F.split(T.col(c), r"\r?\n"), lambda x: T.js_trim(x) != ""), 1, 10)

    def scored(rank: int, d: str) -> Column:
        widths = F.transform(rows, lambda r: F.size(F.split(r, r"\|" if d == "|" else d)))
        first = F.try_element_at(widths, F.lit(1))
        score = F.when(first >= 2, F.size(F.filter(widths, lambda w: w == first)) * first).otherwise(0)
        return F.struct(score.alias("score"), F.lit(-rank).alias("rank"), F.lit(d).alias("d"))

    return F.array_max(F.array(*[scored(i, d) for i, d in enumerate(DELIMITERS)]))["d"]


def column_index(ref: Column | str) -> Column:
    """Zero-based column of a cell reference such as AA1."""
    letters = F.regexp_extract(F.upper(T.col(ref)), r"\A([A-Z]+)", 1)
    digits = F.filter(F.split(letters, ""), lambda x: x != "")
    return F.aggregate(digits, F.lit(0), lambda a, x: a * 26 + F.ascii(x) - 64) - 1


def flat_objects(json: Column | str) -> Column:
    """array<map<string,string>> of a JSON array of objects without nested values, else null."""
    t = T.js_trim(json)
    rows = F.from_json(t, "array<map<string,string>>")
    nested = F.exists(rows, lambda m: F.exists(F.map_values(m), lambda v: F.coalesce(v.rlike(r"\A\s*[\[{]"), F.lit(False))))
    return F.when(t.startswith("[") & F.try_parse_json(t).isNotNull() & (F.size(rows) > 0) & ~nested, rows)


def json_table(json: Column | str) -> Column:
    """A Markdown table of flat objects, columns in order of first sight; null for other JSON."""
    rows = flat_objects(json)
    keys = F.array_distinct(F.flatten(F.transform(rows, F.map_keys)))
    grid = F.concat(F.array(keys), F.transform(rows, lambda m: F.transform(keys, lambda k: F.coalesce(m[k], F.lit("")))))
    return F.when(rows.isNotNull(), to_markdown(grid))


def render_cells(cells: DataFrame, *keys: str) -> DataFrame:
    """A Markdown table per group of cells(keys, row, col, value): sparse cells are placed, trailing empty rows go."""
    full = cells.filter("value is not null and value <> ''").groupBy(*keys).agg(F.max("row").alias("last"), F.max("col").alias("wide"), F.collect_list(F.struct("row", "col", "value")).alias("cells"))
    at = F.map_from_entries(F.transform("cells", lambda c: F.struct(c["row"] * 100000 + c["col"], c["value"])))
    x = full.withColumn("at", at)
    grid = F.transform(F.sequence(F.lit(0), F.col("last")), lambda r: F.transform(F.sequence(F.lit(0), F.col("wide")), lambda c: F.coalesce(F.col("at")[r * 100000 + c], F.lit(""))))
    return x.select(*keys, to_markdown(grid).alias("markdown"))

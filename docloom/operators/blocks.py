"""Markdown into sections and back: one exchange on the document id, everything else in windows on it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from docloom.functions import constants as C, text as T


def lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, source_id, line_no, line of each \\n-separated line."""
    return docs.select(F.col(id_col).alias("doc_id"), T.source_id(text_col).alias("source_id"), F.posexplode(F.split(F.coalesce(text_col, F.lit("")), "\n")).alias("line_no", "line"))


def sections(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokens: Callable[[Column], Column] = T.approx_tokens, volatility_col: str | None = None) -> DataFrame:
    """A row per block of the Markdown in text_col, with its span (half-open, UTF-16 units) in that text.

    Blank lines part blocks, a heading line is a block of its own, and a fenced block runs to its closing
    fence whatever stands between.
    """
    by = Window.partitionBy("doc_id").orderBy("line_no")
    so_far, before = by.rowsBetween(Window.unboundedPreceding, 0), by.rowsBetween(Window.unboundedPreceding, -1)
    x = lines(docs, id_col, text_col)
    fence = F.col("line").rlike(rf"\A{T.WS}*```").cast("int")
    x = x.withColumns({"start": F.coalesce(F.sum(T.utf16_length("line") + 1).over(before), F.lit(0)), "fenced": F.sum(fence).over(so_far) % 2 == 1})
    x = x.withColumn("blank", ~F.col("fenced") & (T.js_trim("line") == "")).withColumn("head", ~F.col("fenced") & F.col("line").rlike(rf"\A{T.WS}*#{{1,6}}{T.WS}"))
    # a block is known by the cuts up to it: blank lines, headings and the lines behind these
    x = x.withColumn("block", F.sum((F.col("blank") | F.col("head")).cast("int")).over(so_far) + F.coalesce(F.sum(F.col("head").cast("int")).over(before), F.lit(0))).filter(~F.col("blank"))
    parts = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    b = x.groupBy("doc_id", "block").agg(F.first("source_id").alias("source_id"), F.min("start").alias("at"), F.array_join(F.transform(parts, lambda p: p["line"]), "\n").alias("raw"))
    b = b.withColumn("markdown", T.js_trim("raw")).filter("markdown <> ''").withColumn("at", F.col("at") + F.length("raw") - F.length(T.js_trim_start("raw")))
    b = b.withColumn("idx", F.row_number().over(Window.partitionBy("doc_id").orderBy("at")) - 1)
    level = F.length(F.regexp_extract("markdown", rf"\A(#{{1,6}}){T.WS}", 1))
    first = F.col("markdown")
    kind = (
        F.when(level > 0, "heading").when(first.startswith("|"), "table").when(first.startswith("```"), "code").when(first.startswith(">"), "blockquote")
        .when(first.rlike(rf"\A(?:[-*+]|\d+\.){T.WS}"), "list").when(first.startswith("!["), "figure").otherwise("paragraph")
    )
    b = b.withColumns({"kind": kind, "level": F.when(level > 0, level), "tokens": tokens(F.col("markdown"))})
    return b.select(
        "doc_id", "idx", F.concat(F.lit("s"), F.col("idx")).alias("section_id"), "kind", "level", "markdown", "tokens", F.lit("stable").alias("volatility"),
        F.struct("source_id", F.col("at").cast("int").alias("start"), (F.col("at") + T.utf16_length("markdown")).cast("int").alias("end"), F.lit(None).cast("int").alias("page")).alias("src"),
        F.lit(False).alias("compressed"),
    )


def titles(secs: DataFrame) -> DataFrame:
    """doc_id, title: the text of the first level-1 heading, null without one."""
    name = F.when((F.col("kind") == "heading") & (F.col("level") == 1), T.js_trim(F.regexp_replace("markdown", rf"\A#{T.WS}*", "")))
    return secs.groupBy("doc_id").agg(F.min_by(name, F.when(name.isNotNull(), F.col("idx"))).alias("title"))


def render(secs: DataFrame, order: str = "idx") -> DataFrame:
    """doc_id, markdown: the sections joined by a blank line."""
    parts = F.array_sort(F.collect_list(F.struct(order, "markdown")))
    return secs.groupBy("doc_id").agg(F.array_join(F.transform(parts, lambda p: p["markdown"]), "\n\n").alias("markdown"))


def format_anchor(source: Column | str, start: Column | str, end: Column | str) -> Column:
    return F.format_string(f"<!-- {C.MARKER}:src=%s#%s-%s -->", T.col(source), T.col(start).cast("string"), T.col(end).cast("string"))


def parse_anchors(c: Column | str) -> Column:
    """All anchors in a text, as array<struct<source_id,start,end>>."""
    every = F.regexp_extract_all(T.col(c), F.lit(rf"({C.MARKER}:src=[0-9a-f]{{16}}#\d+-\d+)"), F.lit(1))
    part = lambda a, i: F.regexp_extract(a, r"src=([0-9a-f]{16})#(\d+)-(\d+)", i)
    return F.transform(every, lambda a: F.named_struct(F.lit("source_id"), part(a, 1), F.lit("start"), part(a, 2).cast("int"), F.lit("end"), part(a, 3).cast("int")))

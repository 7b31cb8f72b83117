"""An index of a document: sections that are cheaper as a stub are named, previewed and anchored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from docloom.functions import constants as C, text as T
from docloom.operators import blocks

PREAMBLE = f"<!-- {C.MARKER}:index v1 -->"
NOTICE = "INDEX, not content. A line with `-` stands for a section: hand its anchor to\nretrieve to read it. Fetch only what the task needs; quote retrieved text,\nnever a preview."


def preview(md: Column | str, limit: int = C.PREVIEW_CHARS) -> Column:
    flat = T.collapse(F.regexp_replace(F.regexp_replace(T.col(md), r"(?s)```.*?```", " "), r"[#>*_`|-]", " "))
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(F.regexp_replace(F.left(flat, F.lit(limit)), rf"{T.WS}+\z", ""), F.lit("…")))


def stubs(secs: DataFrame, limit: int = C.PREVIEW_CHARS, verbatim: tuple[str, ...] = C.VERBATIM) -> DataFrame:
    """secs with stub, stub_tokens and shown: `stub`, `verbatim` or `unanchored`."""
    anchor = blocks.format_anchor("src.source_id", "src.start", "src.end")
    stub = F.concat(F.lit("- "), "kind", F.lit(" · "), F.col("tokens").cast("string"), F.lit(' tokens · "'), preview("markdown", limit), F.lit('" '), anchor)
    x = secs.withColumn("stub", F.when(~F.col("kind").isin(*verbatim) & F.col("src").isNotNull(), stub)).withColumn("stub_tokens", T.approx_tokens("stub"))
    shown = F.when(F.col("kind").isin(*verbatim), "verbatim").when(F.col("src").isNull(), "unanchored").when(F.col("stub_tokens") >= F.col("tokens"), "verbatim").otherwise("stub")
    return x.withColumn("shown", shown)


def outline(secs: DataFrame, limit: int = C.PREVIEW_CHARS, verbatim: tuple[str, ...] = C.VERBATIM) -> DataFrame:
    """The index of each document, what it costs and what it holds."""
    x = stubs(secs, limit, verbatim).withColumn("line", F.when(F.col("shown") == "stub", F.col("stub")).otherwise(F.col("markdown")))
    name = F.when((F.col("kind") == "heading") & (F.col("level") == 1), T.js_trim(F.regexp_replace("markdown", rf"\A#{T.WS}*", "")))
    count = lambda *kinds: F.sum(F.col("shown").isin(*kinds).cast("int")).cast("bigint")
    parts = F.array_sort(F.collect_list(F.struct("idx", "line")))
    g = x.groupBy("doc_id").agg(
        F.min_by(name, F.when(name.isNotNull(), F.col("idx"))).alias("title"), F.array_join(F.transform(parts, lambda p: p["line"]), "\n\n").alias("body"),
        F.sum("tokens").cast("bigint").alias("full_tokens"), count("stub").alias("stubbed"), count("verbatim", "unanchored").alias("verbatim"), count("unanchored").alias("unanchored"),
    )
    head = F.concat_ws("\n", F.lit(PREAMBLE), F.concat(F.lit("# "), F.col("title")), F.lit(""), F.lit(NOTICE), F.lit(""))
    g = g.withColumn("markdown", F.concat(head, F.lit("\n"), F.col("body"), F.lit("\n"))).withColumn("index_tokens", T.approx_tokens("markdown").cast("bigint"))
    return g.drop("body").withColumn("worthwhile", F.col("index_tokens") < F.col("full_tokens"))

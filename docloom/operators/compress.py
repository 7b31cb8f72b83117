"""Compression to a token budget, cache layout and savings, for all documents at once.

Every step is a window on the document, so after parsing no further exchange is needed.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from docloom.functions import constants as C, text as T
from docloom.operators import blocks, clean
from docloom.sources import external


def extractive_summary(text: Column | str, target: Column | str, parity: bool = True) -> Column:
    """Leading sentences while they fit the target, one at least; ` […]` where something is left out.

    With parity, sentences end at every . ! or ? and what stands before an unspaced one is lost, as the
    published behaviour has it; without, they end where white space follows and no character is lost.
    """
    if parity:
        # the third form takes at once what no sentence can begin in; it is left out
        found = lambda flat: F.regexp_extract_all(flat, F.lit(r"([^.!?]++[.!?]++(?:\s|$)|[^.!?]++$|[^.!?]*+[.!?]++)"), F.lit(0))
        whole = lambda p: F.filter(p, lambda s, i: ~s.rlike(r"\A[.!?]") & (~s.rlike(r"[.!?]\z") | (i == F.size(p) - 1)))
        cut = lambda flat: T.let(found(flat), whole)
    else:
        cut = lambda flat: F.transform(F.split(flat, r"(?<=[.!?])\s"), lambda s: F.concat(s, F.lit(" ")))
    limit = T.col(target).cast("int") * 4
    start = F.struct(F.lit(0).alias("used"), F.lit(0).alias("n"), F.lit(False).alias("full"))

    def step(a, size):
        full = a["full"] | ((a["n"] > 0) & (a["used"] + size > limit))
        return F.struct((a["used"] + F.when(full, 0).otherwise(size)).alias("used"), (a["n"] + F.when(full, 0).otherwise(1)).alias("n"), full.alias("full"))

    def lead(parts: Column) -> Column:
        own = F.when(F.size(parts) == 0, F.array(T.col(text))).otherwise(parts)
        return T.js_trim(F.array_join(F.slice(own, 1, F.aggregate(F.transform(own, T.utf16_length), start, step, lambda a: a["n"])), ""))

    # each step is bound to a name, so that nothing is evaluated twice
    return T.let(cut(T.collapse(text)), lambda parts: T.let(lead(parts), lambda out: F.when(F.length(out) < F.length(T.js_trim(text)), F.concat(out, F.lit(" […]"))).otherwise(out)))


def middle(secs: DataFrame, budget: Column | int, head: Column | None = None, tail: Column | None = None, min_section: int = C.MIN_SECTION_TOKENS) -> DataFrame:
    """secs with part (head, middle or tail), candidate, shrink and target of each section."""
    budget = F.lit(budget) if isinstance(budget, int) else budget
    head = head if head is not None else F.least(F.floor(budget * C.HEAD_SHARE), F.lit(C.HEAD_MAX))
    tail = tail if tail is not None else F.least(F.floor(budget * C.TAIL_SHARE), F.lit(C.TAIL_MAX))
    doc = Window.partitionBy("doc_id")
    upto = doc.orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    onward = doc.orderBy("idx").rowsBetween(0, Window.unboundedFollowing)
    x = secs.withColumns({"budget": budget, "total": F.sum("tokens").over(doc)})
    x = x.withColumns({"in_head": F.sum("tokens").over(upto) <= head, "in_tail": F.sum("tokens").over(onward) <= tail})
    x = x.withColumn("part", F.when(F.col("in_head"), "head").when(F.col("in_tail"), "tail").otherwise("middle")).drop("in_head", "in_tail")
    x = x.withColumn("candidate", (F.col("part") == "middle") & F.col("kind").isin(*C.SUMMARIZABLE) & (F.col("tokens") >= min_section))
    x = x.withColumn("candidate_tokens", F.sum(F.when(F.col("candidate"), F.col("tokens")).otherwise(0)).over(doc))
    room = (F.col("budget") - (F.col("total") - F.col("candidate_tokens"))) / F.greatest(F.col("candidate_tokens"), F.lit(1))
    x = x.withColumn("shrink", F.least(F.lit(C.MAX_SHRINK), F.greatest(F.lit(0.0), room)))
    anchor = F.when(F.col("src").isNotNull(), blocks.format_anchor("src.source_id", "src.start", "src.end"))
    x = x.withColumn("anchor", anchor)
    return x.withColumn("target", F.greatest(F.lit(C.MIN_TARGET), F.floor(F.col("tokens") * F.col("shrink")).cast("int") - F.coalesce(T.approx_tokens("anchor") + 1, F.lit(0))))


def summarise(secs: DataFrame, budget: Column | int, summary: Callable[[Column, Column], Column] = extractive_summary, model: Callable[[dict], dict] | None = None, **options) -> DataFrame:
    """secs with the largest middle sections summarised, one by one until the document fits its budget.

    A model, if given, is asked for the summaries of all candidates; where it fails `summary` stands in.
    """
    x = middle(secs, budget, **options)
    needed, lead = F.col("candidate") & (F.col("total") > F.col("budget")), summary(F.col("markdown"), F.col("target"))
    if model is not None:
        asked = external.model_summaries(x.filter(needed).select("doc_id", "idx", "markdown", "target"), model)
        x = x.join(asked.select("doc_id", "idx", "summary"), ["doc_id", "idx"], "left")
        lead = F.coalesce("summary", lead)
    short = F.when(needed, F.concat_ws("\n", lead, F.col("anchor")))
    x = x.withColumn("short", short).withColumn("short_tokens", T.approx_tokens("short"))
    x = x.withColumn("saving", F.when(F.col("candidate"), F.greatest(F.lit(0), F.col("tokens") - F.coalesce("short_tokens", "tokens"))).otherwise(0))
    order = Window.partitionBy("doc_id").orderBy(F.desc("candidate"), F.desc("tokens"), "idx").rowsBetween(Window.unboundedPreceding, -1)
    done = F.coalesce(F.sum("saving").over(order), F.lit(0))
    use = F.col("candidate") & (F.col("total") - done > F.col("budget")) & (F.col("short_tokens") < F.col("tokens"))
    x = x.withColumn("use", F.coalesce(use, F.lit(False)))
    x = x.withColumns({"markdown": F.when(F.col("use"), F.col("short")).otherwise(F.col("markdown")), "tokens": F.when(F.col("use"), F.col("short_tokens")).otherwise(F.col("tokens")), "compressed": F.col("use") | F.col("compressed")})
    return x.select(*secs.columns)


def layout(secs: DataFrame, as_of: datetime | None = None, explicit: bool = True) -> DataFrame:
    """Stable sections first, a breakpoint marker after them, the generation stamp (if as_of is given) last."""
    rank = F.when(F.col("volatility") == "stable", 0).otherwise(2)
    x = secs.withColumn("rank", rank)
    docs = secs.groupBy("doc_id").agg(F.first(F.col("src.source_id"), ignorenulls=True).alias("sid"))

    def marker(name: str, text: Column, volatility: str, at: int) -> DataFrame:
        return docs.select(
            "doc_id", F.lit(0).alias("idx"), F.lit(name).alias("section_id"), F.lit("metadata").alias("kind"), F.lit(None).cast("int").alias("level"), text.alias("markdown"), T.approx_tokens(text).alias("tokens"),
            F.lit(volatility).alias("volatility"), F.lit(None).cast(secs.schema["src"].dataType).alias("src"), F.lit(False).alias("compressed"), F.lit(at).alias("rank"),
        )

    if explicit:
        x = x.unionByName(marker("cache-breakpoint", F.lit(f"<!-- {C.MARKER}:cache-breakpoint -->"), "stable", 1))
    if as_of is not None:
        x = x.unionByName(marker("generation-stamp", F.concat(F.lit(f"<!-- {C.MARKER}:generated {as_of.isoformat()}Z source="), F.col("sid"), F.lit(" -->")), "volatile", 3))
    return x.withColumn("idx", F.row_number().over(Window.partitionBy("doc_id").orderBy("rank", "idx")) - 1).drop("rank")


def stable_prefix(secs: DataFrame) -> DataFrame:
    """doc_id, tokens, prefix_tokens: the tokens before the first volatile section."""
    so_far = Window.partitionBy("doc_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    x = secs.withColumn("volatile", F.max((F.col("volatility") != "stable").cast("int")).over(so_far))
    return x.groupBy("doc_id").agg(F.sum("tokens").cast("bigint").alias("tokens"), F.sum(F.when(F.col("volatile") == 0, F.col("tokens")).otherwise(0)).cast("bigint").alias("prefix_tokens"))


def profiles(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(C.CACHE_PROFILES, "provider string, min_prefix_tokens int, breakpoint_style string, max_breakpoints int, read_factor double, write_premium double")


def amortised(first: Column | str, later: Column | str, calls: Column | int) -> Column:
    """Tokens per call over so many calls."""
    return T.half_up((T.col(first) + (calls - 1) * T.col(later)) / calls)


def savings(spark: SparkSession, prefixes: DataFrame, raw: DataFrame, calls: int = 10) -> DataFrame:
    """A row per document and provider; raw has doc_id and raw_tokens.  The four profiles are a constant table."""
    x = prefixes.join(raw, "doc_id").crossJoin(F.broadcast(profiles(spark)))
    x = x.withColumn("volatile_tokens", F.col("tokens") - F.col("prefix_tokens")).withColumn("cache_eligible", F.col("prefix_tokens") >= F.col("min_prefix_tokens"))
    cost = lambda factor: F.when(F.col("cache_eligible"), T.half_up(F.col("prefix_tokens") * factor + F.col("volatile_tokens"))).otherwise(F.col("tokens"))
    x = x.withColumns({"first_call": cost(1 + F.col("write_premium")), "next_call": cost(F.col("read_factor"))})
    x = x.withColumn("amortized", amortised("first_call", "next_call", calls))
    pct = F.when(F.col("raw_tokens") > 0, T.half_up((1 - F.col("next_call") / F.col("raw_tokens")) * 1000) / 10).otherwise(F.lit(0.0))
    ratio = F.when(F.col("raw_tokens") > 0, F.col("tokens") / F.col("raw_tokens")).otherwise(F.lit(1.0))
    return x.select("doc_id", "provider", "raw_tokens", F.col("tokens").alias("compressed_tokens"), "prefix_tokens", "volatile_tokens", "cache_eligible", "first_call", "next_call", "amortized", ratio.alias("ratio"), pct.alias("saved_pct"))


def _marker_tokens(as_of: datetime | None, explicit: bool) -> int:
    stamp = f"<!-- {C.MARKER}:generated {as_of.isoformat()}Z source={'0' * 16} -->" if as_of is not None else ""
    return -(-len(f"<!-- {C.MARKER}:cache-breakpoint -->") // 4) * explicit + -(-len(stamp) // 4)


def ledger(marked: DataFrame, short: DataFrame, raw: DataFrame, marker_tokens: int) -> DataFrame:
    """doc_id, ord, phase, tokens: what each phase leaves, from the marked sections and the summarised ones, each read once."""
    kept = F.col("removed_by").isNull()
    one = marked.groupBy("doc_id").agg(F.sum("tokens").cast("bigint").alias("structure"), F.sum(F.when(kept, F.col("tokens"))).cast("bigint").alias("strip"))
    two = short.groupBy("doc_id").agg(F.sum("tokens").cast("bigint").alias("summarize")).join(raw, "doc_id")
    laid = F.when(F.col("summarize") + marker_tokens < F.col("raw_tokens"), F.col("summarize") + marker_tokens).otherwise(F.col("summarize"))
    wide = one.join(two.select("doc_id", "summarize", laid.alias("layout")), "doc_id", "left")
    names = ["structure", "strip", "summarize", "layout"]
    return wide.select("doc_id", F.explode(F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(n).alias("phase"), F.col(n).alias("tokens")) for i, n in enumerate(names)])).alias("x")).select("doc_id", "x.*").filter("tokens is not null")


def compress(spark: SparkSession, docs: DataFrame, budget: int, provider: str = "anthropic", as_of: datetime | None = None, id_col: str = "doc_id", text_col: str = "text", **options) -> dict[str, DataFrame]:
    """The four phases.  Frames: sections, markdown, phases (long), savings (of the provider), warnings."""
    if budget <= 0:
        raise ValueError("the budget must be positive")
    style = {p[0]: p[2] for p in C.CACHE_PROFILES}[provider]
    parsed = blocks.sections(docs, id_col, text_col)
    marked = clean.strip(parsed)
    stripped = clean.kept(marked)
    short = summarise(stripped, budget, **options)
    laid = layout(short, as_of, style == "explicit")
    raw = docs.select(F.col(id_col).alias("doc_id"), T.approx_tokens(F.coalesce(text_col, F.lit(""))).cast("bigint").alias("raw_tokens"))
    sums = laid.groupBy("doc_id").agg(F.sum("tokens").alias("laid")).join(raw, "doc_id").select("doc_id", (F.col("laid") < F.col("raw_tokens")).alias("helps"))
    final = laid.join(sums, "doc_id").filter("helps or kind <> 'metadata'").drop("helps")
    phases = ledger(marked, short, raw, _marker_tokens(as_of, style == "explicit"))
    over = short.groupBy("doc_id").agg(F.sum("tokens").alias("t")).filter(F.col("t") > budget).select("doc_id", F.lit("budget-exceeded").alias("code"))
    skipped = sums.filter("not helps").select("doc_id", F.lit("layout-skipped").alias("code"))
    saved = savings(spark, stable_prefix(final), raw).filter(F.col("provider") == provider)
    return {"sections": final, "markdown": blocks.render(final), "phases": phases, "savings": saved, "warnings": over.unionByName(skipped)}

"""Token reports, tallies, ledgers, facts and scores."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from docloom.functions import text as T
from docloom.operators import blocks


def token_report(secs: DataFrame, raw: DataFrame, budget: int | None = None, with_sections: bool = False) -> DataFrame:
    """Input and output tokens of each document, their ratio and whether they fit; raw has doc_id and input_tokens."""
    sums = [F.sum("tokens").cast("bigint").alias("output_tokens"), F.count("*").alias("n_sections")]
    if with_sections:
        sums.append(F.array_sort(F.collect_list(F.struct("idx", "section_id", "tokens"))).alias("sections"))
    x = secs.groupBy("doc_id").agg(*sums).join(raw, "doc_id", "right")
    x = x.withColumns({"output_tokens": F.coalesce("output_tokens", F.lit(0)), "n_sections": F.coalesce("n_sections", F.lit(0))})
    x = x.withColumn("ratio", F.when(F.col("input_tokens") > 0, F.col("output_tokens") / F.col("input_tokens")).otherwise(F.lit(1.0)))
    return x.withColumn("within_budget", F.col("output_tokens") <= budget) if budget is not None else x


def baseline(kind: Column | str, text: Column | str, engine_output: Column | str, from_file: bool = False) -> Column:
    """The text that savings are measured against: a text input itself, of a file only HTML, CSV and JSON, else the output."""
    own = ("html", "csv", "json") if from_file else ("prompt", "email", "html", "csv", "json")
    return F.when(T.col(kind).isin(*own), T.col(text)).otherwise(T.col(engine_output))


def batch_tally(results: DataFrame) -> DataFrame:
    """One row from rows of (ok, in_tokens, out_tokens)."""
    x = results.agg(
        F.count("*").alias("n_files"), F.count_if("ok").alias("n_ok"), F.count_if(~F.col("ok")).alias("n_failed"),
        F.coalesce(F.sum(F.when(F.col("ok"), F.col("in_tokens"))), F.lit(0)).cast("bigint").alias("in_tokens"), F.coalesce(F.sum(F.when(F.col("ok"), F.col("out_tokens"))), F.lit(0)).cast("bigint").alias("out_tokens"),
    )
    return x.withColumn("pct", F.when(F.col("in_tokens") > 0, T.half_up(F.col("out_tokens") / F.col("in_tokens") * 100)).otherwise(F.lit(0)))


def ledger_totals(ledger: DataFrame, *keys: str) -> DataFrame:
    return ledger.groupBy(*keys).agg(F.sum("prompt_tokens").cast("bigint").alias("prompt_tokens"), F.sum("completion_tokens").cast("bigint").alias("completion_tokens"), F.sum(F.coalesce("cost_usd", F.lit(0.0))).alias("cost_usd"))


# What counts as a fact that must survive.
FACTS = {
    "currency": r"([$€£]\s?\d[\d,]*(?:\.\d+)?[kKmMbB]?)",
    "percent": r"(\d+(?:\.\d+)?%)",
    "date": r"(\d{4}-\d{2}-\d{2})",
    "ticket": r"([A-Z]{2,}-\d{3,})",
    "number": r"(\d{1,3}(?:,\d{3})+)",
    "version": r"(\d+\.\d+\.\d+)",
}


def facts(c: Column | str) -> Column:
    return F.array_distinct(F.flatten(F.array(*[F.regexp_extract_all(T.col(c), F.lit(p), F.lit(1)) for p in FACTS.values()])))


def fact_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.explode(facts(text_col)).alias("fact"))


def fact_survival(originals: DataFrame, outputs: DataFrame) -> DataFrame:
    """doc_id, fact, fate: `present` in the output, `recoverable` from a span an anchor of it names, or `lost`.

    originals: doc_id, text; outputs: doc_id, markdown.  Anchors resolve within the document itself.
    """
    x = originals.join(outputs, "doc_id")
    spans = F.transform(blocks.parse_anchors("markdown"), lambda a: T.utf16_span("text", a["start"], a["end"]))
    x = x.select("doc_id", facts("text").alias("facts"), "markdown", spans.alias("spans"))
    x = x.select("doc_id", F.explode(F.arrays_zip("facts", _fates(F.col("facts"), F.col("markdown"), F.col("spans")).alias("fates"))).alias("x"))
    return x.select("doc_id", F.col("x.facts").alias("fact"), F.col("x.fates").alias("fate"))


def _fates(own: Column, markdown: Column, spans: Column) -> Column:
    """The fate of each of a document's facts: its output is read once for all of them, its spans once for those it lacks."""

    def held(wanted: set[str], texts: list[str]) -> set[str]:
        import ahocorasick

        if not wanted:
            return set()
        automaton = ahocorasick.Automaton()
        for fact in wanted:
            automaton.add_word(fact, fact)
        automaton.make_automaton()
        return {fact for text in texts for _, fact in automaton.iter(text)}

    @F.pandas_udf("array<string>")
    def run(many: pd.Series, outputs: pd.Series, cuts: pd.Series) -> pd.Series:
        out = []
        for own_, text, parts in zip(many, outputs, cuts):
            wanted = set(own_)
            there = held(wanted, [text or ""])
            behind = held(wanted - there, [p for p in (parts if parts is not None else []) if p])
            out.append(["present" if f in there else "recoverable" if f in behind else "lost" for f in own_])
        return pd.Series(out)

    return run(own, markdown, spans)


def eval_score(pairs: DataFrame, original: str = "text", output: str = "cleaned") -> DataFrame:
    """pairs with score: 0.6 facts kept, 0.2 size saved, 0.2 structure."""
    kept = lambda own: F.size(F.filter(own, lambda f: F.contains(F.col(output), f)))
    # a text is searched for its facts once, not anew for their number
    fact = T.let(facts(original), lambda own: F.when(F.size(own) > 0, kept(own) / F.size(own)).otherwise(F.lit(1.0)))
    size = F.when(F.length(original) > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.length(output) / F.length(original)))).otherwise(F.lit(0.0))
    shaped = F.col(output).rlike(r"(?m)^(?:#{1,6}\s|[-*+]\s|\|)").cast("double")
    return pairs.withColumns({"fact_score": fact, "size_score": size, "structure_score": shaped}).withColumn("score", 0.6 * F.col("fact_score") + 0.2 * F.col("size_score") + 0.2 * F.col("structure_score"))


def output_names(files: DataFrame, name_col: str = "file", order_col: str = "seq") -> DataFrame:
    """files with out_name: later ones of a base name, case apart, get -2, -3, ...

    A number that some input's own name already ends with is passed over.
    """
    base = F.regexp_replace(F.regexp_extract(F.col(name_col), r"([^/\\]*)\z", 1), r"\.[^.]*\z", "")
    x = files.withColumn("base", base).withColumn("nth", F.row_number().over(Window.partitionBy(F.lower(base)).orderBy(order_col)))
    # the k-th free number is k + 1 and one more for each taken number u, the r-th of its stem, with u - r - 1 < k: a count of what stands before k
    own = F.regexp_extract(F.lower("base"), r"\A(.*)-(\d{1,9})\z", 1), F.regexp_extract(F.lower("base"), r"\A(.*)-(\d{1,9})\z", 2).try_cast("int")
    taken = x.select(own[0].alias("stem"), own[1].alias("u")).filter("u >= 2").distinct()
    taken = taken.withColumn("at", F.col("u") - F.row_number().over(Window.partitionBy("stem").orderBy("u")) - 1)
    wanted = x.filter("nth > 1").select(F.lower("base").alias("stem"), (F.col("nth") - 1).alias("at"), F.lit(0).alias("used"))
    both = wanted.unionByName(taken.select("stem", "at", F.lit(1).alias("used")))
    before = Window.partitionBy("stem").orderBy("at", "used").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    free = both.withColumn("passed", F.sum("used").over(before)).filter("used = 0").select("stem", (F.col("at") + 1).alias("nth"), (F.col("at") + 1 + F.col("passed")).alias("number"))
    x = x.withColumn("stem", F.lower("base")).join(free, ["stem", "nth"], "left")
    name = F.when(F.col("nth") == 1, F.col("base")).otherwise(F.concat("base", F.lit("-"), F.col("number").cast("string")))
    return x.withColumn("out_name", F.concat(name, F.lit(".md"))).select(*files.columns, "out_name")

"""Boilerplate, repeated sections and headings left without content."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window, functions as F

from docloom.functions import constants as C, text as T

# What the rules match, by rule.
SIGN_OFF = r"(?im)^\s*sent from my [a-z0-9 ]+$"
LEGAL = "(?i)" + T.word(r"this (?:e-?mail|message) (?:and any attachments )?(?:is|are) confidential|intended solely for the (?:addressee|recipient)|if you (?:have )?received this (?:e-?mail|message) in error")
NEWSLETTER = "(?i)" + T.word(r"unsubscribe|manage (?:your )?preferences|view (?:this email )?in (?:your )?browser|in your inbox|sign up free|accept all cookies|we use cookies")
QUOTED_MAIL = r"(?im)^\s*>?\s*-{2,}\s*Original Message\s*-{2,}|^\s*>?\s*(?:From|Sent|Subject|To):\s"
COPYRIGHT = r"(?i)\A\s*(?:©|\(c\)\s*\d{4}|copyright\s+\d{4})"
AD_FIGURE = r"(?i)!\[(?:advertisement|ad(?![A-Za-z0-9_])|banner|sponsor)[^\]]*\]"
BARE_LINK = r"\A\s*[-*+]\s*\[[^\]]{1,80}\]\([^)]+\)\s*\z"


def is_link_list(md: Column | str) -> Column:
    items = F.filter(F.split(T.col(md), r"\r?\n"), lambda x: T.js_trim(x) != "")
    return (F.size(items) >= 2) & F.forall(items, lambda x: x.rlike(BARE_LINK))


def boilerplate_rule(kind: Column | str = "kind", md: Column | str = "markdown", low: Column | str | None = None) -> Column:
    """The name of the rule that a section falls under, or null.  low: md in lower case, where it is at hand; patterns are then tried only where their words are."""
    kind, md = T.col(kind), T.col(md)
    says = lambda *words: F.lit(True) if low is None else _has(T.col(low), *words)
    return (
        F.when(kind.isin(*C.VERBATIM), F.lit(None)).when(says("sent from my") & md.rlike(SIGN_OFF), "sign-off").when(says("confidential", "intended solely for the", "in error") & md.rlike(LEGAL), "legal-footer")
        .when((kind == "paragraph") & (F.length(md) < C.CHROME_CHARS) & md.rlike(NEWSLETTER), "newsletter")
        .when((kind == "paragraph") & (F.length(md) < C.COPYRIGHT_CHARS) & md.rlike(COPYRIGHT), "copyright")
        .when((kind == "list") & is_link_list(md), "link-list").when((kind == "figure") & md.rlike(AD_FIGURE), "ad-figure")
        .when((kind == "blockquote") & md.rlike(QUOTED_MAIL), "quoted-mail")
    )


#: whether dedupe_key leaves anything; where white space is but for these and for U+00A0 (patterns of one range are fast)
HAS_KEY, UNEVEN = T.NOT_WS.replace("[^", "[^*_`~"), r"[^ -\x{167F}]"


def _has(low: Column, *words: str) -> Column:
    return reduce(or_, [F.contains(low, F.lit(w)) for w in words])


def dedupe_key(low: Column | str) -> Column:
    """What sections are compared by, of their Markdown in lower case: no marks, white space collapsed.  Most have nothing to change."""
    low = T.col(low)
    changed = _has(low, "  ", "*", "_", "`", "~", "\u00a0") | low.rlike(UNEVEN)
    return F.when(changed, T.collapse(F.regexp_replace(low, "[*_`~]", ""))).otherwise(F.trim(low))


def strip(secs: DataFrame) -> DataFrame:
    """secs with removed_by: a boilerplate rule, `duplicate`, `orphan-heading` or null for what stays."""
    x = secs.withColumn("low", F.lower("markdown"))
    x = x.withColumn("removed_by", boilerplate_rule(low="low"))
    x = x.withColumn("key", F.when(F.col("removed_by").isNull() & F.col("kind").isin(*C.REPEATABLE) & F.col("low").rlike(HAS_KEY), F.xxhash64(dedupe_key("low"))))
    # rows without a key are numbered by their own index: each is its first
    same = Window.partitionBy("doc_id", "key", F.when(F.col("key").isNull(), F.col("idx"))).orderBy("idx")
    x = x.withColumn("removed_by", F.coalesce("removed_by", F.when(F.row_number().over(same) > 1, "duplicate")))
    live, heading = F.col("removed_by").isNull(), F.col("kind") == "heading"
    doc, content = Window.partitionBy("doc_id").orderBy("idx"), F.sum((live & ~heading).cast("int"))
    x = x.withColumns({"run": content.over(doc.rowsBetween(Window.unboundedPreceding, 0)), "runs": content.over(doc.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
    later = Window.partitionBy("doc_id", "run").orderBy("idx").rowsBetween(1, Window.unboundedFollowing)
    shallower = F.min(F.when(live & heading, F.col("level"))).over(later)
    orphan = live & heading & (F.coalesce(shallower <= F.col("level"), F.lit(False)) | ((F.col("run") == F.col("runs")) & (F.col("level") > 1)))
    return x.withColumn("removed_by", F.coalesce("removed_by", F.when(orphan, "orphan-heading"))).drop("low", "key", "run", "runs")


def _report() -> list[Column]:
    gone = F.col("removed_by").isNotNull()
    return [F.sum(gone.cast("int")).cast("bigint").alias("removed_sections"), F.sum(F.when(gone, F.col("tokens")).otherwise(0)).cast("bigint").alias("removed_tokens"), F.sum(F.when(gone, 0).otherwise(F.col("tokens"))).cast("bigint").alias("kept_tokens")]


def strip_report(marked: DataFrame) -> DataFrame:
    """Removed sections and tokens of each document."""
    return marked.groupBy("doc_id").agg(*_report())


def rendered(marked: DataFrame) -> DataFrame:
    """The report of each document with its markdown, made of what stays; the sections are read once for both."""
    stays = F.array_sort(F.collect_list(F.when(F.col("removed_by").isNull(), F.struct("idx", "markdown"))))
    return marked.groupBy("doc_id").agg(F.array_join(F.transform(stays, lambda p: p["markdown"]), "\n\n").alias("markdown"), *_report())


def kept(marked: DataFrame) -> DataFrame:
    """What stays, numbered anew."""
    by = Window.partitionBy("doc_id").orderBy("idx")
    return marked.filter("removed_by is null").drop("removed_by").withColumn("idx", F.row_number().over(by) - 1)


def content_removed(removed: Column | str, before: Column | str) -> Column:
    """Whether a removal is large enough to be disclosed."""
    return (T.col(removed) >= C.REMOVAL_TOKENS) & (T.col(removed) >= C.REMOVAL_SHARE * T.col(before))

"""Registered queries for the operators of this library, each with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from docloom.functions import constants as C, text as T
from docloom.functions.rows import dealt
from docloom.functions.scratch import shared_dir
from docloom.operators import blocks, clean, compress, digest, outline, prompts, report, sniff, store, tables
from docloom.sources import delimited, html, pdf_layout

QUERIES: dict = {}
ORACLES: dict = {}
BUDGET = 200


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# --- inputs ------------------------------------------------------------------------------------
def threads(spark: SparkSession, d: str) -> DataFrame:
    """A Markdown thread per conversation; every fourth turn of every third one has chrome or nothing in it."""
    c = table(spark, d, "conversations").withColumn("text", F.coalesce("text", F.lit("")))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda t: F.concat(F.lit("## "), t["role"], F.lit("\n\n"), t["text"]))
    return c.groupBy(F.col("conv_id").alias("doc_id")).agg(F.concat(F.lit("# Conversation "), F.first("conv_id").cast("string"), F.lit("\n\n"), F.array_join(parts, "\n\n")).alias("text"))


CHROME = [
    "We use cookies to improve this site.", "(c) 2024 Example", "Sent from my phone", "- [Home](/)\n- [News](/news)", "![advertisement](a.png)", "> From: someone\n> Sent: today",
    "This message is confidential.", "### Empty heading", "A plain paragraph that repeats.\n\nA  plain *paragraph* that repeats.", "Copyright 2024",
]


def chrome_threads(spark: SparkSession, d: str) -> DataFrame:
    pick = F.element_at(F.array(*[F.lit(c) for c in CHROME]), (F.col("doc_id") % len(CHROME) + 1).cast("int"))
    return threads(spark, d).withColumn("text", F.concat("text", F.lit("\n\n"), pick, F.lit("\n\n## Last\n\n"), F.when(F.col("doc_id") % 2 == 0, F.lit("End.")).otherwise(F.lit(""))))


def paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.regexp_replace(F.coalesce("text", F.lit("")), "\n", "\n\n").alias("text"))


THREADS = """t AS (SELECT conv_id AS doc_id, '# Conversation ' || conv_id || chr(10) || chr(10) || string_agg('## ' || role || chr(10) || chr(10) || coalesce(text, ''), chr(10) || chr(10) ORDER BY turn, role, text) AS text
  FROM conversations GROUP BY conv_id)"""
_CHROME_LIST = "[" + ", ".join("'" + c.replace("'", "''").replace("\n", "'||chr(10)||'") + "'" for c in CHROME) + "]"
CHROMED = THREADS + f""", tc AS (SELECT doc_id, text || chr(10) || chr(10) || ({_CHROME_LIST})[CAST(doc_id % {len(CHROME)} AS INT) + 1] || chr(10) || chr(10) || '## Last' || chr(10) || chr(10) || CASE WHEN doc_id % 2 = 0 THEN 'End.' ELSE '' END AS text FROM t)"""
PARAGRAPHS = "p AS (SELECT doc_id, replace(coalesce(text, ''), chr(10), chr(10) || chr(10)) AS text FROM documents)"


def sections_sql(source: str) -> str:
    """CTEs up to s(doc_id, idx, kind, level, markdown, tokens, sid, st, en) over a table (doc_id, text)."""
    trim = r"regexp_replace(regexp_replace({}, '^\s+', ''), '\s+$', '')"
    return rf"""l0 AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM {source}),
l1 AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS st,
  sum(CASE WHEN regexp_matches(line, '^\s*```') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) % 2 = 1 AS fenced FROM l0),
l2 AS (SELECT *, NOT fenced AND regexp_matches(line, '^\s*$') AS blank, NOT fenced AND regexp_matches(line, '^\s*#{{1,6}}\s') AS head FROM l1),
l3 AS (SELECT *, CASE WHEN blank OR head OR coalesce(lag(head) OVER (PARTITION BY doc_id ORDER BY i), false) THEN 1 ELSE 0 END AS cut FROM l2),
l4 AS (SELECT *, sum(cut) OVER (PARTITION BY doc_id ORDER BY i) AS block FROM l3),
b0 AS (SELECT doc_id, block, any_value(text) AS text, min(st) AS a, max(st + length(line)) AS z FROM l4 WHERE NOT blank GROUP BY doc_id, block),
b1 AS (SELECT doc_id, substring(text, CAST(a + 1 AS BIGINT), CAST(z - a AS BIGINT)) AS raw, a, text FROM b0),
b2 AS (SELECT doc_id, a + length(raw) - length(regexp_replace(raw, '^\s+', '')) AS st, {trim.format('raw')} AS markdown, substring(sha256(text), 1, 16) AS sid FROM b1),
b3 AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY st) - 1 AS idx, length(regexp_extract(markdown, '^(#{{1,6}})\s', 1)) AS lv FROM b2 WHERE markdown <> ''),
s AS (SELECT doc_id, idx, CASE WHEN lv > 0 THEN 'heading' WHEN starts_with(markdown, '|') THEN 'table' WHEN starts_with(markdown, '```') THEN 'code' WHEN starts_with(markdown, '>') THEN 'blockquote'
  WHEN regexp_matches(markdown, '^([-*+]|\d+\.)\s') THEN 'list' WHEN starts_with(markdown, '![') THEN 'figure' ELSE 'paragraph' END AS kind, CASE WHEN lv > 0 THEN lv END AS level,
  markdown, CAST(ceil(length(markdown) / 4.0) AS INT) AS tokens, sid, CAST(st AS INT) AS st, CAST(st + length(markdown) AS INT) AS en FROM b3)"""


STRIP = r"""m0 AS (SELECT *, CASE WHEN kind IN ('heading', 'table', 'code') THEN NULL WHEN regexp_matches(markdown, '(?im)^\s*sent from my [a-z0-9 ]+$') THEN 'sign-off'
  WHEN regexp_matches(markdown, '(?i)\b(this (e-?mail|message) (and any attachments )?(is|are) confidential|intended solely for the (addressee|recipient)|if you (have )?received this (e-?mail|message) in error)\b') THEN 'legal-footer'
  WHEN kind = 'paragraph' AND length(markdown) < 300 AND regexp_matches(markdown, '(?i)\b(unsubscribe|manage (your )?preferences|view (this email )?in (your )?browser|in your inbox|sign up free|accept all cookies|we use cookies)\b') THEN 'newsletter'
  WHEN kind = 'paragraph' AND length(markdown) < 200 AND regexp_matches(markdown, '(?i)^\s*(©|\(c\)\s*\d{4}|copyright\s+\d{4})') THEN 'copyright'
  WHEN kind = 'list' AND len(string_split(markdown, chr(10))) >= 2 AND len(list_filter(string_split(markdown, chr(10)), lambda x: NOT regexp_matches(x, '^\s*[-*+]\s*\[[^\]]{1,80}\]\([^)]+\)\s*$') AND trim(x) <> '')) = 0 THEN 'link-list'
  WHEN kind = 'figure' AND regexp_matches(markdown, '(?i)!\[(advertisement|ad\b|banner|sponsor)[^\]]*\]') THEN 'ad-figure'
  WHEN kind = 'blockquote' AND regexp_matches(markdown, '(?im)^\s*>?\s*-{2,}\s*Original Message\s*-{2,}|^\s*>?\s*(From|Sent|Subject|To):\s') THEN 'quoted-mail' END AS rule FROM s),
m1 AS (SELECT *, CASE WHEN rule IS NULL AND kind IN ('paragraph', 'list', 'blockquote') THEN nullif(trim(regexp_replace(regexp_replace(lower(markdown), '[*_`~]', '', 'g'), '\s+', ' ', 'g')), '') END AS key FROM m0),
m2 AS (SELECT *, CASE WHEN rule IS NOT NULL THEN rule WHEN key IS NOT NULL AND row_number() OVER (PARTITION BY doc_id, key ORDER BY idx) > 1 THEN 'duplicate' END AS gone FROM m1),
m3 AS (SELECT *, sum(CASE WHEN gone IS NULL AND kind <> 'heading' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY idx) AS run FROM m2),
m4 AS (SELECT *, max(run) OVER (PARTITION BY doc_id) AS runs, min(CASE WHEN gone IS NULL AND kind = 'heading' THEN level END) OVER (PARTITION BY doc_id, run ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM m3),
m AS (SELECT *, CASE WHEN gone IS NOT NULL THEN gone WHEN kind = 'heading' AND (coalesce(nxt <= level, false) OR (run = runs AND level > 1)) THEN 'orphan-heading' END AS removed_by FROM m4),
k AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY idx) - 1 AS idx, kind, level, markdown, tokens, sid, st, en FROM m WHERE removed_by IS NULL)"""

SUMMARY = r"""list_reduce(list_transform(list_concat([''], sents), lambda x: {'s': x, 'stop': false}), lambda a, x: CASE WHEN a.stop OR (length(a.s) > 0 AND ceil(length(a.s || x.s) / 4.0) > target) THEN {'s': a.s, 'stop': true} ELSE {'s': a.s || x.s, 'stop': false} END).s"""

MIDDLE = f"""w0 AS (SELECT *, sum(tokens) OVER (PARTITION BY doc_id) AS total, sum(tokens) OVER (PARTITION BY doc_id ORDER BY idx) AS upto, sum(tokens) OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS onward FROM k),
w1 AS (SELECT *, CASE WHEN upto <= {int(BUDGET * C.HEAD_SHARE)} THEN 'head' WHEN onward <= {int(BUDGET * C.TAIL_SHARE)} THEN 'tail' ELSE 'middle' END AS part FROM w0),
w2 AS (SELECT *, part = 'middle' AND kind IN ('paragraph', 'list', 'blockquote', 'figure') AND tokens >= 24 AS candidate FROM w1),
w3 AS (SELECT *, sum(CASE WHEN candidate THEN tokens ELSE 0 END) OVER (PARTITION BY doc_id) AS ct FROM w2),
w4 AS (SELECT *, least(0.5, greatest(0.0, ({BUDGET} - (total - ct))::DOUBLE / greatest(ct, 1)::DOUBLE)) AS shrink, '<!-- {C.MARKER}:src=' || sid || '#' || st || '-' || en || ' -->' AS anchor FROM w3),
w5 AS (SELECT *, greatest(10, CAST(floor(tokens * shrink) AS INT) - (CAST(ceil(length(anchor) / 4.0) AS INT) + 1)) AS target, trim(regexp_replace(markdown, '\\s+', ' ', 'g')) AS flat FROM w4),
w6 AS (SELECT *, regexp_extract_all(flat, '[^.!?]+[.!?]+(?:\\s|$)|[^.!?]+$') AS found FROM w5),
w7 AS (SELECT *, CASE WHEN len(found) = 0 THEN [markdown] ELSE found END AS sents FROM w6),
w8 AS (SELECT *, trim({SUMMARY}) AS lead FROM w7),
w9 AS (SELECT *, CASE WHEN candidate AND total > {BUDGET} THEN (CASE WHEN length(lead) < length(markdown) THEN lead || ' […]' ELSE lead END) || chr(10) || anchor END AS short FROM w8),
x0 AS (SELECT *, CAST(ceil(length(short) / 4.0) AS INT) AS short_tokens FROM w9),
x1 AS (SELECT *, coalesce(sum(CASE WHEN candidate THEN greatest(0, tokens - coalesce(short_tokens, tokens)) ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY candidate DESC, tokens DESC, idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done FROM x0),
x AS (SELECT doc_id, idx, kind, CASE WHEN use THEN short ELSE markdown END AS markdown, CASE WHEN use THEN short_tokens ELSE tokens END AS tokens, use AS compressed
  FROM (SELECT *, coalesce(candidate AND total - done > {BUDGET} AND short_tokens < tokens, false) AS use FROM x1))"""

T_SECTIONS = f"WITH {THREADS}, {sections_sql('t')}"
P_SECTIONS = f"WITH {PARAGRAPHS}, {sections_sql('p')}"
C_SECTIONS = f"WITH {CHROMED}, {sections_sql('tc')}"
T_KEPT = f"{T_SECTIONS}, {STRIP}"
C_KEPT = f"{C_SECTIONS}, {STRIP}"
T_MIDDLE = f"{T_KEPT}, {MIDDLE}"


def t_sections(spark, d):
    return blocks.sections(threads(spark, d))


def t_kept(spark, d):
    return clean.kept(clean.strip(t_sections(spark, d)))


def raw_tokens(docs: DataFrame, name: str = "raw_tokens") -> DataFrame:
    return docs.select("doc_id", T.approx_tokens("text").cast("bigint").alias(name))


# --- tokens and identity ---------------------------------------------------------------------------
@query("SELECT source, count(*) AS n_docs, CAST(sum(ceil(length(coalesce(text, '')) / 4.0)) AS BIGINT) AS tokens FROM documents GROUP BY source")
def token_count_by_source(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n_docs"), F.sum(T.approx_tokens(F.coalesce("text", F.lit("")))).cast("bigint").alias("tokens"))


@query("SELECT source, lang, CAST(grouping(source) * 2 + grouping(lang) AS INT) AS grp, count(*) AS n_docs, CAST(sum(ceil(length(coalesce(text, '')) / 4.0)) AS BIGINT) AS tokens FROM documents GROUP BY ROLLUP (source, lang)")
def token_rollup_source_lang(spark, d):
    x = table(spark, d, "documents").rollup("source", "lang").agg(F.grouping_id().cast("int").alias("grp"), F.count("*").alias("n_docs"), F.sum(T.approx_tokens(F.coalesce("text", F.lit("")))).cast("bigint").alias("tokens"))
    return x.select("source", "lang", "grp", "n_docs", "tokens")


@query("SELECT doc_id, substring(sha256(coalesce(text, '')), 1, 16) AS source_id, CAST(length(coalesce(text, '')) AS INT) AS chars FROM documents")
def source_id(spark, d):
    return table(spark, d, "documents").select("doc_id", T.source_id(F.coalesce("text", F.lit(""))).alias("source_id"), T.utf16_length(F.coalesce("text", F.lit(""))).alias("chars"))


@query("SELECT substring(sha256(text), 1, 16) AS source_id, count(*) AS n, min(doc_id) AS first_doc FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def duplicate_originals(spark, d):
    return table(spark, d, "documents").filter("text is not null").groupBy(T.source_id("text").alias("source_id")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")).filter("n > 1")


@query("SELECT DISTINCT substring(sha256(text), 1, 16) AS source_id, text FROM documents WHERE text IS NOT NULL AND substring(sha256(text), 1, 16) NOT IN (SELECT substring(sha256(text), 1, 16) FROM documents WHERE doc_id % 3 = 0 AND text IS NOT NULL)")
def originals_put(spark, d):
    docs = table(spark, d, "documents")
    return store.absent(store.originals(docs), store.originals(docs.filter("doc_id % 3 = 0"))).select("source_id", "text")


# --- sniff and route ---------------------------------------------------------------------------------
_EVERY = "e AS (SELECT 'd' || doc_id AS input_id, coalesce(text, '') AS text FROM documents UNION ALL SELECT 'p' || page_id, coalesce(html, '') FROM pages UNION ALL SELECT 'c' || conv_id || '-' || turn, coalesce(text, '') FROM conversations UNION ALL SELECT 'm' || c_custkey, 'From: ' || c_name || chr(10) || 'Subject: order' || chr(10) || chr(10) || 'Hello' FROM customer UNION ALL SELECT 'j' || event_id, props FROM events)"
_PROBE = r"""rows_ AS (SELECT *, list_filter(string_split_regex(text, '\r?\n'), lambda x: NOT regexp_matches(x, '^\s*$')) AS r, len(string_split_regex(text, '\r?\n')) AS n FROM e),
pr AS (SELECT input_id, text, length(text) AS chars, n AS lines, CASE WHEN len(r) > 0 THEN len(list_filter(r, lambda x: regexp_matches(x, '</?[a-zA-Z][^>]*>')))::DOUBLE / len(r) ELSE 0.0 END AS markup_ratio,
  len(regexp_extract_all(text, '(?m)^(From|To|Cc|Subject|Sent|Date|Reply-To):\s')) >= 2 AS email,
  len(r) >= 2 AND list_min(list_transform(r, lambda x: len(string_split(x, ',')))) = list_max(list_transform(r, lambda x: len(string_split(x, ',')))) AND list_min(list_transform(r, lambda x: len(string_split(x, ',')))) >= 3 AS csv FROM rows_),
kd AS (SELECT *, CASE WHEN regexp_matches(text, '(?i)^\s*(<!DOCTYPE|<html)') OR markup_ratio > 0.2 THEN 'html' WHEN csv THEN 'csv' WHEN (starts_with(trim(text), '{') OR starts_with(trim(text), '[')) AND json_valid(trim(text)) THEN 'json' WHEN email THEN 'email' ELSE 'prompt' END AS kind FROM pr)"""


def every_input(spark, d):
    t = lambda c: F.coalesce(c, F.lit(""))
    parts = [
        table(spark, d, "documents").select(F.concat(F.lit("d"), "doc_id").alias("input_id"), t("text").alias("text")),
        table(spark, d, "pages").select(F.concat(F.lit("p"), "page_id").alias("input_id"), t("html").alias("text")),
        table(spark, d, "conversations").select(F.concat(F.lit("c"), "conv_id", F.lit("-"), "turn").alias("input_id"), t("text").alias("text")),
        table(spark, d, "customer").select(F.concat(F.lit("m"), "c_custkey").alias("input_id"), F.concat(F.lit("From: "), "c_name", F.lit("\nSubject: order\n\nHello")).alias("text")),
        table(spark, d, "events").select(F.concat(F.lit("j"), "event_id").alias("input_id"), F.col("props").alias("text")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(f"WITH {_EVERY}, {_PROBE} SELECT substring(input_id, 1, 1) AS origin, kind, count(*) AS n, CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM kd GROUP BY 1, 2")
def sniff_kinds(spark, d):
    return sniff.sniff(every_input(spark, d)).groupBy(F.substring("input_id", 1, 1).alias("origin"), "kind").agg(F.count("*").alias("n"), F.sum("bytes").cast("bigint").alias("bytes"))


@query(f"WITH {_EVERY}, {_PROBE} SELECT input_id, CAST(chars AS INT) AS chars, CAST(lines AS INT) AS lines, round(markup_ratio, 9) AS markup_ratio, email AS looks_like_email, coalesce(csv, false) AS looks_like_csv FROM pr")
def text_probe(spark, d):
    return sniff.sniff(every_input(spark, d)).select("input_id", "probe.chars", "probe.lines", F.round("probe.markup_ratio", 9).alias("markup_ratio"), "probe.looks_like_email", "probe.looks_like_csv")


@query(f"WITH {_EVERY}, {_PROBE} SELECT kind, CASE kind WHEN 'prompt' THEN 'text/plain' WHEN 'email' THEN 'message/rfc822' WHEN 'html' THEN 'text/html' WHEN 'csv' THEN 'text/csv' ELSE 'application/json' END AS mime, count(*) AS n FROM kd GROUP BY 1, 2")
def mime_lookup(spark, d):
    return sniff.sniff(every_input(spark, d)).groupBy("kind", "mime").agg(F.count("*").alias("n"))


_ROUTE = "CASE WHEN k IN ('prompt','email') THEN 'prompt-optimizer' WHEN k IN ('csv','json','html') THEN 'native' WHEN k = 'office' THEN CASE WHEN f = 'high' THEN 'docling' ELSE 'native' END WHEN k = 'pdf' THEN CASE WHEN f = 'fast' THEN 'native' WHEN f = 'high' OR o OR s THEN 'docling' ELSE 'native' END ELSE 'docling' END"
_KINDS = ["prompt", "email", "html", "csv", "json", "office", "pdf", "image", "unknown"]


@query(f"""SELECT k AS kind, f AS fidelity, o AS ocr_asked, s AS scanned, {_ROUTE} AS engine, CASE WHEN k = 'image' THEN true WHEN k = 'pdf' AND f <> 'fast' THEN (o OR (f = 'auto' AND s)) ELSE false END AS ocr,
  CAST(CASE WHEN k = 'pdf' AND f = 'auto' AND NOT o AND NOT s THEN 2 ELSE 0 END AS INT) AS n_checks
  FROM unnest({_KINDS}) a(k), unnest(['fast','auto','high']) b(f), unnest([true,false]) c(o), unnest([true,false]) e(s)""")
def route_decisions(spark, d):
    x = spark.createDataFrame([(k, f, o, s) for k in _KINDS for f in ("fast", "auto", "high") for o in (True, False) for s in (True, False)], "kind string, fidelity string, ocr_asked boolean, scanned boolean")
    x = x.withColumn("r", sniff.route("kind", F.col("fidelity"), F.col("ocr_asked"), F.col("scanned")))
    return x.select("kind", "fidelity", "ocr_asked", "scanned", "r.engine", "r.ocr", F.size("r.post_checks").alias("n_checks"))


@query(r"SELECT doc_id, length(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'))) / 3.0 < 200 AS low_yield FROM documents")
def low_yield(spark, d):
    return table(spark, d, "documents").select("doc_id", sniff.low_yield(F.coalesce("text", F.lit("")), 3).alias("low_yield"))


_FLAT = r"len(regexp_extract_all(regexp_replace(x, '\s', '  ', 'g'), '(?:^|\s)\(?\d[\d,.]*\)?%?(?:\s|$)'))"


@query(rf"""WITH r AS (SELECT l_orderkey AS doc_id, string_agg(l_linenumber || ' ' || CAST(l_quantity AS INT) || ' ' || CAST(round(l_extendedprice) AS BIGINT) || CASE WHEN l_linenumber % 2 = 0 THEN ' | x' ELSE '' END, chr(10) ORDER BY l_linenumber, l_quantity, l_extendedprice) AS md FROM lineitem GROUP BY 1)
SELECT doc_id, CAST(len(list_filter(string_split(md, chr(10)), lambda x: NOT contains(x, '|') AND {_FLAT} >= 3)) AS INT) AS rows_, len(list_filter(string_split(md, chr(10)), lambda x: NOT contains(x, '|') AND {_FLAT} >= 3)) >= 2 AS degraded FROM r""")
def flattened_rows(spark, d):
    line = F.concat_ws(" ", F.col("l_linenumber").cast("string"), F.col("l_quantity").cast("int").cast("string"), F.round("l_extendedprice").cast("bigint").cast("string"))
    line = F.concat(line, F.when(F.col("l_linenumber") % 2 == 0, F.lit(" | x")).otherwise(F.lit("")))
    x = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.struct("l_linenumber", "l_quantity", "l_extendedprice", line.alias("line")).alias("l"))
    x = x.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("l")), lambda p: p["line"]), "\n").alias("md"))
    x = x.withColumn("e", sniff.escalation(F.array(F.lit("table-degradation")), "md"))
    return x.select("doc_id", sniff.flattened_rows("md").alias("rows_"), F.col("e.escalate").alias("degraded"))


# --- sections ---------------------------------------------------------------------------------------
@query(f"WITH {THREADS} SELECT doc_id, text AS markdown, CAST(length(text) AS INT) AS chars FROM t")
def thread_assembly(spark, d):
    return threads(spark, d).select("doc_id", F.col("text").alias("markdown"), F.length("text").alias("chars"))


@query(f"{T_SECTIONS} SELECT doc_id, CAST(idx AS INT) AS idx, 's' || idx AS section_id, kind, CAST(level AS INT) AS level, markdown, tokens, st AS start_, en AS end_ FROM s")
def parse_sections(spark, d):
    return t_sections(spark, d).select("doc_id", "idx", "section_id", "kind", "level", "markdown", "tokens", F.col("src.start").alias("start_"), F.col("src.end").alias("end_"))


@query(f"{C_SECTIONS} SELECT kind, CAST(level AS INT) AS level, count(*) AS n, CAST(sum(tokens) AS BIGINT) AS tokens FROM s GROUP BY 1, 2")
def section_kinds(spark, d):
    return blocks.sections(chrome_threads(spark, d)).groupBy("kind", "level").agg(F.count("*").alias("n"), F.sum("tokens").cast("bigint").alias("tokens"))


@query(f"{T_SECTIONS} SELECT doc_id, trim(substring(arg_min(markdown, idx) FILTER (WHERE kind = 'heading' AND level = 1), 2)) AS title FROM s GROUP BY doc_id")
def titles(spark, d):
    return blocks.titles(t_sections(spark, d))


@query(f"{T_SECTIONS} SELECT s.doc_id, count(*) AS n, CAST(sum(CASE WHEN substring(t.text, s.st + 1, s.en - s.st) = s.markdown THEN 1 ELSE 0 END) AS BIGINT) AS exact FROM s JOIN t USING (doc_id) GROUP BY 1")
def span_roundtrip(spark, d):
    docs = threads(spark, d)
    x = blocks.sections(docs).join(docs, "doc_id")
    same = F.substring(F.col("text"), F.col("src.start") + 1, F.col("src.end") - F.col("src.start")) == F.col("markdown")
    return x.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(same.cast("int")).cast("bigint").alias("exact"))


_ANCHOR = f"'<!-- {C.MARKER}:src=' || sid || '#' || st || '-' || en || ' -->'"


@query(f"{T_SECTIONS} SELECT doc_id, CAST(idx AS INT) AS idx, {_ANCHOR} AS anchor FROM s")
def anchors_format(spark, d):
    return t_sections(spark, d).select("doc_id", "idx", blocks.format_anchor("src.source_id", "src.start", "src.end").alias("anchor"))


@query(f"{T_SECTIONS} SELECT DISTINCT sid AS source_id, st AS start, en AS end FROM s")
def anchors_parse(spark, d):
    x = t_sections(spark, d).groupBy("doc_id").agg(F.concat_ws("\n", F.collect_list(blocks.format_anchor("src.source_id", "src.start", "src.end"))).alias("text"))
    return x.select(F.explode(blocks.parse_anchors("text")).alias("a")).select("a.*").distinct()


@query(f"{T_SECTIONS} SELECT DISTINCT sid AS source_id, st AS start, en AS end, markdown AS span FROM s")
def retrieve_span(spark, d):
    """Out of a store that has been written to twice; the second time it has all of them."""
    docs, path = threads(spark, d), shared_dir(spark)
    store.put(spark, path, docs.filter("doc_id % 2 = 0"))
    store.put(spark, path, docs)
    anchors = blocks.sections(docs).select("src.source_id", "src.start", "src.end").distinct()
    return store.spans(anchors, store.load(spark, path))


@query("""SELECT substring(source_id, 1, 2) AS prefix, CAST(CASE WHEN doc_id % 3 = 0 THEN 0 ELSE 1 END AS INT) AS writer, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM (SELECT substring(sha256(text), 1, 16) AS source_id, text, min(doc_id % 3) * 1 AS doc_id FROM documents WHERE text IS NOT NULL GROUP BY 1, 2) GROUP BY 1, 2""")
def originals_store(spark, d):
    """Per prefix of the ids, what each of two writers has put into one store: every text once."""
    docs, path = table(spark, d, "documents"), shared_dir(spark)
    store.put(spark, path, docs.filter("doc_id % 3 = 0"), label="0")
    store.put(spark, path, docs, label="1")
    return store.load(spark, path).groupBy("prefix", F.col("label").cast("int").alias("writer")).agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


# --- cleaning -----------------------------------------------------------------------------------------
@query(f"{C_KEPT} SELECT doc_id, CAST(idx AS INT) AS idx, kind, rule FROM m WHERE rule IS NOT NULL")
def boilerplate_rules(spark, d):
    return blocks.sections(chrome_threads(spark, d)).withColumn("rule", clean.boilerplate_rule()).filter("rule is not null").select("doc_id", "idx", "kind", "rule")


@query(f"{P_SECTIONS}, {STRIP} SELECT doc_id, CAST(idx AS INT) AS idx, markdown FROM m WHERE removed_by = 'duplicate'")
def section_dedupe(spark, d):
    return clean.strip(blocks.sections(paragraphs(spark, d))).filter("removed_by = 'duplicate'").select("doc_id", "idx", "markdown")


@query(f"{C_KEPT} SELECT doc_id, CAST(idx AS INT) AS idx, CAST(level AS INT) AS level, markdown FROM m WHERE removed_by = 'orphan-heading'")
def orphan_headings(spark, d):
    return clean.strip(blocks.sections(chrome_threads(spark, d))).filter("removed_by = 'orphan-heading'").select("doc_id", "idx", "level", "markdown")


@query(f"{C_KEPT} SELECT doc_id, CAST(sum(CASE WHEN removed_by IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS removed_sections, CAST(sum(CASE WHEN removed_by IS NOT NULL THEN tokens ELSE 0 END) AS BIGINT) AS removed_tokens, CAST(sum(CASE WHEN removed_by IS NULL THEN tokens ELSE 0 END) AS BIGINT) AS kept_tokens FROM m GROUP BY 1")
def strip_report(spark, d):
    return clean.strip_report(clean.strip(blocks.sections(chrome_threads(spark, d))))


@query(r"""WITH x AS (SELECT doc_id, 'Basically, ' || coalesce(text, '') || ' honestly!! did i mention this? yeah' AS text FROM documents)
SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?i)\bdid i (mention|say)\b[^.?!]*[?]\s*(yeah|yes|yep)?[,.]?\s*', '', 'g'),
 '(?i)\b(like i said|as i said|one more thing[:,]?|just to (be clear|clarify)[:,]?|to be honest|honestly|basically|oh and|you know|i mean|kind of|sort of)[,]?\s*', '', 'g'), '!!+', '!', 'g'), '\?\?+', '?', 'g')) AS cleaned FROM x""")
def filler_scrub(spark, d):
    x = table(spark, d, "documents").select("doc_id", F.concat(F.lit("Basically, "), F.coalesce("text", F.lit("")), F.lit(" honestly!! did i mention this? yeah")).alias("text"))
    return x.select("doc_id", prompts.scrub("text").alias("cleaned"))


TOKENS = "CAST(ceil((length({0}) + len(regexp_extract_all({0}, '[\\x{{10000}}-\\x{{10FFFF}}]'))) / 4.0) AS INT)"
_FILLER = {
    r"(?i)\bdid i (mention|say)\b[^.?!]*[?]\s*(yeah|yes|yep)?[,.]?\s*": "''",
    r"(?i)\b(like i said|as i said|one more thing[:,]?|just to (be clear|clarify)[:,]?|to be honest|honestly|basically|oh and|you know|i mean|kind of|sort of)[,]?\s*": "''",
    "!!+": "'!'",
    r"\?\?+": "'?'",
}
_SCRUBBED = "r"
for _pattern, _by in _FILLER.items():
    _SCRUBBED = f"regexp_replace({_SCRUBBED}, '{_pattern}', {_by}, 'g')"
def _js_trim(sql: str) -> str:
    return rf"regexp_replace({sql}, '^{T.WS}+|{T.WS}+$', '', 'g')"


_TIDY = _js_trim(r"regexp_replace(regexp_replace(array_to_string(kept, ' '), '(?i)^\s*((ok(ay)?|so|well|um+|uh+|alright)[,.]?\s+)+', ''), '(?i)\b(thanks|thank you|cheers|regards)[!.]*\s*$', '')")
_TIDY = _js_trim(rf"regexp_replace({_TIDY}, '[ \t]{{2,}}', ' ', 'g')")
_KEY, _KEPT_KEY = "split_part(x[1], chr(1), 1)", "split_part(z, chr(1), 1)"




@query(rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), p AS (SELECT doc_id, unnest(regexp_split_to_array(text, '\n{{2,}}')) AS p, generate_subscripts(regexp_split_to_array(text, '\n{{2,}}'), 1) AS i FROM d),
s AS (SELECT doc_id, i, list_filter(list_transform(string_split(regexp_replace(p, '([.!?]){T.WS}+', '\1' || chr(1), 'g'), chr(1)), lambda r: {_js_trim(_SCRUBBED)}), lambda x: x <> '' AND NOT regexp_matches(x, '(?i)^(thanks|thank you|cheers|regards|pls|please)[!.]*$')) AS s FROM p),
e AS (SELECT doc_id, i, list_filter(list_transform(s, lambda x: [trim(regexp_replace(lower(x), '[^a-z0-9]+', ' ', 'g')) || chr(1) || x]), lambda x: x[1][1] <> chr(1)) AS e FROM s),
k AS (SELECT doc_id, i, CASE WHEN len(e) > 0 THEN list_transform(list_reduce(list_concat([CAST([] AS VARCHAR[])], e), lambda a, x: CASE WHEN len(list_filter(a, lambda z: {_KEPT_KEY} = {_KEY})) > 0
  OR len(list_filter(a[-200:], lambda z: contains({_KEPT_KEY}, {_KEY}) OR contains({_KEY}, {_KEPT_KEY}))) > 0 THEN a ELSE list_concat(a, x) END), lambda z: split_part(z, chr(1), 2)) ELSE [] END AS kept FROM e),
c AS (SELECT doc_id, string_agg(t, chr(10) || chr(10) ORDER BY i) FILTER (WHERE t <> '') AS t FROM (SELECT doc_id, i, {_TIDY} AS t FROM k) GROUP BY 1)
SELECT doc_id, sha256(CASE WHEN {TOKENS.format("coalesce(t, '')")} < {TOKENS.format("text")} THEN coalesce(t, '') ELSE text END) AS cleaned_sha256, {TOKENS.format("text")} AS before, least({TOKENS.format("text")}, {TOKENS.format("coalesce(t, '')")}) AS after, CAST({TOKENS.format("text")} - least({TOKENS.format("text")}, {TOKENS.format("coalesce(t, '')")}) AS BIGINT) AS removed_tokens FROM d LEFT JOIN c USING (doc_id)""")
def filler_dedupe(spark, d):
    x = prompts.strip_filler(table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    return x.select("doc_id", F.sha2("cleaned", 256).alias("cleaned_sha256"), T.approx_tokens("text").alias("before"), T.approx_tokens("cleaned").alias("after"), "removed_tokens")


_PROMPT = "pr AS (SELECT p_partkey AS doc_id, 'i need a report for ' || p_name || '. it must include ' || p_brand || '. also make sure size ' || p_size || ' is handled. and python 3.11 please. yeah, ' || p_type || ' matters most to the team in the north, whose numbers came late in every month of that year and who were told twice about the layout of the old sheet.' AS text FROM part)"


def part_prompts(spark, d):
    return dealt(table(spark, d, "part"), "p_partkey").select(
        F.col("p_partkey").alias("doc_id"),
        F.concat(F.lit("i need a report for "), "p_name", F.lit(". it must include "), "p_brand", F.lit(". also make sure size "), F.col("p_size").cast("string"), F.lit(" is handled. and python 3.11 please. yeah, "), "p_type", F.lit(" matters most to the team in the north, whose numbers came late in every month of that year and who were told twice about the layout of the old sheet.")).alias("text"),
    )


@query(f"""WITH {_PROMPT} SELECT p.doc_id, true AS structured, '## Goal' || chr(10) || chr(10) || 'i need a report for ' || p_name || chr(10) || chr(10) || '## Requirements' || chr(10) || chr(10) || '- it must include ' || p_brand || chr(10) || '- make sure size ' || p_size || ' is handled'
  || chr(10) || chr(10) || '## Constraints' || chr(10) || chr(10) || '- python 3.11 please' || chr(10) || chr(10) || '## Notes' || chr(10) || chr(10) || '- ' || p_type || ' matters most to the team in the north, whose numbers came late in every month of that year and who were told twice about the layout of the old sheet' AS markdown FROM pr p JOIN part ON p_partkey = p.doc_id
  WHERE ceil(length('## Goal....i need a report for ' || p_name || '..## Requirements..- it must include ' || p_brand || '.- make sure size ' || p_size || ' is handled..## Constraints..- python 3.11 please..## Notes..- ' || p_type || ' matters most to the team in the north, whose numbers came late in every month of that year and who were told twice about the layout of the old sheet') / 4.0) <= 1.25 * ceil(length(text) / 4.0)""")
def prompt_structure(spark, d):
    x = prompts.structure(part_prompts(spark, d), "text", "markdown").filter("structured")
    return x.select("doc_id", "structured", "markdown")


@query(f"WITH {_PROMPT}, b AS (SELECT doc_id, unnest(['i need a report for ' || p_name, 'it must include ' || p_brand, 'make sure size ' || p_size || ' is handled', 'python 3.11 please', p_type || ' matters most to the team in the north, whose numbers came late in every month of that year and who were told twice about the layout of the old sheet']) AS bullet FROM pr JOIN part ON p_partkey = doc_id) SELECT doc_id, bullet FROM b")
def bullets(spark, d):
    return part_prompts(spark, d).select("doc_id", F.explode(F.transform(prompts.sentences("text"), prompts.to_bullet)).alias("bullet"))


# --- compression ---------------------------------------------------------------------------------------
@query(f"{T_MIDDLE} SELECT doc_id, CAST(idx AS INT) AS idx, part, candidate, round(shrink, 9) AS shrink, CAST(target AS INT) AS target FROM w5")
def middle_partition(spark, d):
    return compress.middle(t_kept(spark, d), BUDGET).select("doc_id", "idx", "part", "candidate", F.round("shrink", 9).alias("shrink"), "target")


@query(f"{T_MIDDLE} SELECT doc_id, CAST(idx AS INT) AS idx, tokens, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY tokens DESC, idx) AS INT) AS rank_ FROM w2 WHERE candidate")
def candidates_ranked(spark, d):
    by = Window.partitionBy("doc_id").orderBy(F.desc("tokens"), "idx")
    return compress.middle(t_kept(spark, d), BUDGET).filter("candidate").select("doc_id", "idx", "tokens", F.row_number().over(by).alias("rank_"))


@query(rf"""WITH {PARAGRAPHS}, q AS (SELECT doc_id, text AS markdown, 40 AS target, trim(regexp_replace(text, '\s+', ' ', 'g')) AS flat FROM p),
q1 AS (SELECT *, regexp_extract_all(flat, '[^.!?]+[.!?]+(?:\s|$)|[^.!?]+$') AS found FROM q), q2 AS (SELECT *, CASE WHEN len(found) = 0 THEN [markdown] ELSE found END AS sents FROM q1),
q3 AS (SELECT *, regexp_replace(regexp_replace({SUMMARY}, '^\s+', ''), '\s+$', '') AS lead FROM q2)
SELECT doc_id, CASE WHEN length(lead) < length(regexp_replace(regexp_replace(markdown, '^\s+', ''), '\s+$', '')) THEN lead || ' […]' ELSE lead END AS summary FROM q3""")
def extractive_summary(spark, d):
    return paragraphs(spark, d).select("doc_id", compress.extractive_summary("text", F.lit(40)).alias("summary"))


@query(f"{T_MIDDLE} SELECT doc_id, count(*) AS n_sections, CAST(sum(CASE WHEN compressed THEN 1 ELSE 0 END) AS BIGINT) AS n_compressed, CAST(sum(tokens) AS BIGINT) AS tokens, sum(tokens) > {BUDGET} AS over_budget, sha256(string_agg(markdown, chr(10) || chr(10) ORDER BY idx)) AS digest FROM x GROUP BY 1")
def compress_report(spark, d):
    x = compress.summarise(t_kept(spark, d), BUDGET)
    parts = F.transform(F.array_sort(F.collect_list(F.struct("idx", "markdown"))), lambda p: p["markdown"])
    return x.groupBy("doc_id").agg(
        F.count("*").alias("n_sections"), F.sum(F.col("compressed").cast("int")).cast("bigint").alias("n_compressed"), F.sum("tokens").cast("bigint").alias("tokens"), (F.sum("tokens") > BUDGET).alias("over_budget"), F.sha2(F.array_join(parts, "\n\n").cast("binary"), 256).alias("digest")
    )


@query(f"""{T_MIDDLE}, a AS (SELECT doc_id, 0 AS ord, 'structure' AS phase, sum(tokens) AS tokens FROM s GROUP BY 1 UNION ALL SELECT doc_id, 1, 'strip', sum(tokens) FROM k GROUP BY 1 UNION ALL SELECT doc_id, 2, 'summarize', sum(tokens) FROM x GROUP BY 1
  UNION ALL SELECT doc_id, 3, 'layout', CASE WHEN sum(tokens) + {-(-len(f'<!-- {C.MARKER}:cache-breakpoint -->') // 4)} < any_value(raw) THEN sum(tokens) + {-(-len(f'<!-- {C.MARKER}:cache-breakpoint -->') // 4)} ELSE sum(tokens) END FROM x JOIN (SELECT doc_id, ceil(length(text) / 4.0) AS raw FROM t) USING (doc_id) GROUP BY 1)
SELECT doc_id, CAST(ord AS INT) AS ord, phase, CAST(tokens AS BIGINT) AS tokens FROM a""")
def phase_ledger(spark, d):
    return compress.compress(spark, threads(spark, d), BUDGET)["phases"]


_SAVED = """SELECT doc_id, provider, raw, tk, prefix, elig, CASE WHEN elig THEN floor(prefix * (1 + wp) + (tk - prefix) + 0.5) ELSE tk END AS f, CASE WHEN elig THEN floor(prefix * rf + (tk - prefix) + 0.5) ELSE tk END AS n
 FROM (SELECT *, prefix >= 1024 AS elig FROM (SELECT doc_id, sum(tokens) AS tk, sum(tokens) AS prefix FROM k GROUP BY 1) JOIN (SELECT doc_id, ceil(length(text) / 4.0) AS raw FROM t) USING (doc_id), (VALUES ('anthropic', 0.1::DOUBLE, 0.25::DOUBLE), ('openai', 0.5::DOUBLE, 0::DOUBLE), ('gemini', 0.25::DOUBLE, 0::DOUBLE), ('kimi', 0.1::DOUBLE, 0::DOUBLE)) v(provider, rf, wp))"""


@query(f"{T_KEPT} SELECT doc_id, provider, CAST(raw AS BIGINT) AS raw_tokens, CAST(tk AS BIGINT) AS compressed_tokens, elig AS cache_eligible, CAST(f AS BIGINT) AS first_call, CAST(n AS BIGINT) AS next_call, CAST(floor((f + 9 * n) / 10.0 + 0.5) AS BIGINT) AS amortized, floor((1 - n / raw) * 1000 + 0.5)::DOUBLE / 10 AS saved_pct FROM ({_SAVED})")
def savings_by_provider(spark, d):
    x = compress.savings(spark, compress.stable_prefix(t_kept(spark, d)), raw_tokens(threads(spark, d)))
    return x.select("doc_id", "provider", "raw_tokens", "compressed_tokens", "cache_eligible", "first_call", "next_call", "amortized", "saved_pct")


@query(f"{T_KEPT} SELECT provider, CAST(calls AS INT) AS calls, CAST(sum(floor((f + (calls - 1) * n) / calls::DOUBLE + 0.5)) AS BIGINT) AS amortized FROM ({_SAVED}), unnest([1, 10, 100]) c(calls) GROUP BY 1, 2")
def amortized_n(spark, d):
    x = compress.savings(spark, compress.stable_prefix(t_kept(spark, d)), raw_tokens(threads(spark, d))).withColumn("calls", F.explode(F.array(*[F.lit(n) for n in (1, 10, 100)])))
    return x.groupBy("provider", "calls").agg(F.sum(compress.amortised("first_call", "next_call", F.col("calls"))).cast("bigint").alias("amortized"))


@query(f"{T_KEPT} SELECT doc_id, 's' || idx AS section_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY kind <> 'heading', idx) - 1 AS INT) AS idx FROM k")
def cache_order(spark, d):
    """Headings as the stable part, the rest as volatile: a caller's own volatility."""
    x = t_kept(spark, d).withColumn("section_id", F.concat(F.lit("s"), "idx")).withColumn("volatility", F.when(F.col("kind") == "heading", "stable").otherwise("volatile"))
    return compress.layout(x, explicit=False).select("doc_id", "section_id", "idx")


_STUB = rf"""o0 AS (SELECT *, trim(regexp_replace(regexp_replace(regexp_replace(markdown, '(?s)```.*?```', ' ', 'g'), '[#>*_`|-]', ' ', 'g'), '\s+', ' ', 'g')) AS flat FROM k),
o1 AS (SELECT *, CASE WHEN kind NOT IN ('heading', 'table', 'code') THEN '- ' || kind || ' · ' || tokens || ' tokens · "' || CASE WHEN length(flat) <= 72 THEN flat ELSE rtrim(left(flat, 72)) || '…' END || '" ' || {_ANCHOR} END AS stub FROM o0),
o AS (SELECT *, CASE WHEN stub IS NULL THEN 'verbatim' WHEN ceil(length(stub) / 4.0) >= tokens THEN 'verbatim' ELSE 'stub' END AS shown FROM o1)"""


@query(f"{T_KEPT}, {_STUB} SELECT doc_id, CAST(idx AS INT) AS idx, stub, shown FROM o")
def outline_stubs(spark, d):
    return outline.stubs(t_kept(spark, d)).select("doc_id", "idx", "stub", "shown")


_HEAD = outline.PREAMBLE
_NOTICE_SQL = "'" + outline.NOTICE.replace("\n", "' || chr(10) || '") + "'"


@query(f"""{T_KEPT}, {_STUB}, g AS (SELECT doc_id, any_value(CASE WHEN kind = 'heading' AND level = 1 THEN trim(substring(markdown, 2)) END) FILTER (WHERE kind = 'heading' AND level = 1) AS title, string_agg(CASE WHEN shown = 'stub' THEN stub ELSE markdown END, chr(10) || chr(10) ORDER BY idx) AS body,
 sum(tokens) AS full_tokens, sum(CASE WHEN shown = 'stub' THEN 1 ELSE 0 END) AS stubbed, sum(CASE WHEN shown <> 'stub' THEN 1 ELSE 0 END) AS verbatim FROM o GROUP BY 1),
g1 AS (SELECT *, '{_HEAD}' || chr(10) || CASE WHEN title IS NOT NULL THEN '# ' || title || chr(10) ELSE '' END || chr(10) || {_NOTICE_SQL} || chr(10) || chr(10) || body || chr(10) AS markdown FROM g)
SELECT doc_id, title, CAST(ceil(length(markdown) / 4.0) AS BIGINT) AS index_tokens, CAST(full_tokens AS BIGINT) AS full_tokens, CAST(stubbed AS BIGINT) AS stubbed, CAST(verbatim AS BIGINT) AS verbatim, ceil(length(markdown) / 4.0) < full_tokens AS worthwhile FROM g1""")
def outline_report(spark, d):
    return outline.outline(t_kept(spark, d)).select("doc_id", "title", "index_tokens", "full_tokens", "stubbed", "verbatim", "worthwhile")


@query(f"{T_SECTIONS} SELECT doc_id, CAST(any_value(ceil(length(t.text) / 4.0)) AS BIGINT) AS input_tokens, CAST(sum(tokens) AS BIGINT) AS output_tokens, count(*) AS n_sections, round(sum(tokens) / any_value(ceil(length(t.text) / 4.0)), 9) AS ratio, sum(tokens) <= 500 AS within_budget FROM s JOIN t USING (doc_id) GROUP BY 1")
def token_report_budget(spark, d):
    docs = threads(spark, d)
    x = report.token_report(blocks.sections(docs), raw_tokens(docs, "input_tokens"), 500)
    return x.select("doc_id", "input_tokens", "output_tokens", "n_sections", F.round("ratio", 9).alias("ratio"), "within_budget")


# --- converters -------------------------------------------------------------------------------------------
# the given pages: a menu, an advert, an article of a heading and paragraphs (the first one bold up to a line break) and a footer, with references for marks
_DECODED = "p"
for _mark, _is in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#x27;", "''"), ("&amp;", "&")):
    _DECODED = f"regexp_replace({_DECODED}, '{_mark}?', '{_is}', 'g')"  # a heading may be cut within a reference


def _page(bold: str, heading: str, between: str) -> str:
    return rf"""bo AS (SELECT page_id, html, regexp_replace(regexp_extract(html, '<body>(.*)', 1, 's'), '<nav>.*?</nav>|<footer>.*?</footer>|<!--.*?-->|</body>|</html>', '', 'gs') AS x FROM pages),
ma AS (SELECT page_id, html, regexp_split_to_array(replace(regexp_replace(x, '<b>\s*(.*?)\s*<br>', '{bold}\1{bold}', 'gs'), '<h1>', chr(1) || '{heading}'), '</?(?:div class="ad"|div|article|p)>|</h1>|' || chr(1)) AS parts FROM bo),
pc AS (SELECT page_id, html, list_filter(list_transform(parts, lambda p: trim(regexp_replace({_DECODED}, '\s+', ' ', 'g'))), lambda p: p NOT IN ('', '#', '****')) AS parts FROM ma),
pa AS (SELECT page_id, html, array_to_string(parts, {between}) AS text FROM pc)"""


@query(f"WITH {_page('**', '# ', 'chr(10) || chr(10)')} SELECT page_id, text AS markdown, {TOKENS.format('html')} AS raw_tokens, {TOKENS.format('text')} AS tokens FROM pa")
def html_to_markdown(spark, d):
    x = html.convert(table(spark, d, "pages").select("page_id", "html"))
    return x.select("page_id", "markdown", T.approx_tokens("html").alias("raw_tokens"), T.approx_tokens("markdown").alias("tokens"))


@query(f"WITH {_page('', '', chr(39) + ' ' + chr(39))} SELECT page_id, CAST(length(text) AS INT) AS chars, {TOKENS.format('text')} AS tokens FROM pa")
def html_text_tokens(spark, d):
    return html.convert(table(spark, d, "pages").select("page_id", "html"), text_only=True).select("page_id", F.length("markdown").alias("chars"), T.approx_tokens("markdown").alias("tokens"))


_CSV = "cs AS (SELECT n_regionkey AS k, 'key' || sep || 'name' || sep || 'region' || chr(10) || string_agg(n_nationkey || sep || n_name || sep || n_regionkey, chr(10) ORDER BY n_nationkey) AS text, sep FROM (SELECT *, [',', ';', '|', chr(9), ','][n_regionkey + 1] AS sep FROM nation) GROUP BY n_regionkey, sep)"


def nation_csv(spark, d):
    n = table(spark, d, "nation").withColumn("sep", F.element_at(F.array(*[F.lit(s) for s in (",", ";", "|", "\t", ",")]), F.col("n_regionkey") + 1))
    n = n.withColumn("line", F.concat(F.col("n_nationkey").cast("string"), "sep", "n_name", "sep", F.col("n_regionkey").cast("string")))
    x = n.groupBy(F.col("n_regionkey").alias("k"), "sep").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "line"))), lambda p: p["line"]), "\n").alias("b"))
    return x.select("k", "sep", F.concat(F.lit("key"), "sep", F.lit("name"), "sep", F.lit("region\n"), "b").alias("text"))


@query(f"WITH {_CSV} SELECT k, sep AS delimiter FROM cs")
def csv_delimiter(spark, d):
    return nation_csv(spark, d).select("k", tables.detect_delimiter("text").alias("delimiter"))


@query("SELECT n_regionkey AS k, '| key | name | region |' || chr(10) || '| --- | --- | --- |' || chr(10) || string_agg('| ' || n_nationkey || ' | ' || n_name || ' | ' || n_regionkey || ' |', chr(10) ORDER BY n_nationkey) AS markdown FROM nation GROUP BY 1")
def csv_table(spark, d):
    return delimited.convert(nation_csv(spark, d), "csv").select("k", "markdown")


@query("SELECT n_regionkey AS k, '| k | name |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || n_nationkey || ' | ' || n_name || ' |', chr(10) ORDER BY n_nationkey) AS markdown FROM nation GROUP BY 1")
def json_table(spark, d):
    n = table(spark, d, "nation").groupBy(F.col("n_regionkey").alias("k")).agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda p: F.struct(p["n_nationkey"].alias("k"), p["n_name"].alias("name")))).alias("json"))
    return n.select("k", tables.json_table("json").alias("markdown"))


@query("SELECT 'region' AS name, '| r_regionkey | r_name |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || r_regionkey || ' | ' || r_name || '\\| |', chr(10) ORDER BY r_regionkey) AS markdown FROM region")
def markdown_table(spark, d):
    r = table(spark, d, "region").agg(F.array_sort(F.collect_list(F.struct("r_regionkey", "r_name"))).alias("r"))
    rows = F.concat(F.array(F.array(F.lit("r_regionkey"), F.lit("r_name"))), F.transform("r", lambda x: F.array(x["r_regionkey"].cast("string"), F.concat(x["r_name"], F.lit("|")))))
    return r.select(F.lit("region").alias("name"), tables.to_markdown(rows).alias("markdown"))


@query("SELECT 1 AS k, 'region' AS sheet, '| 0 | ' || 'AFRICA' || ' |' AS probe WHERE false UNION ALL SELECT n_regionkey, 'nation', string_agg(n_name, ',' ORDER BY n_nationkey) FROM nation GROUP BY 1")
def sheet_cells(spark, d):
    n = table(spark, d, "nation").withColumn("row", F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey")) - 1)
    cells = n.select(F.col("n_regionkey").alias("k"), "row", F.lit(1).alias("col"), F.col("n_name").alias("value"))
    md = tables.render_cells(cells, "k")
    names = F.regexp_extract_all("markdown", F.lit(r"\|  \| ([^|]+) \|"), F.lit(1))
    return md.select("k", F.lit("nation").alias("sheet"), F.array_join(names, ",").alias("probe"))


@query("SELECT p_partkey, CAST((p_partkey % 26) * 26 + p_size % 26 + 26 AS INT) AS idx FROM part")
def column_index(spark, d):
    p = table(spark, d, "part")
    ref = F.concat(F.char((F.col("p_partkey") % 26 + 65).cast("int")), F.char((F.col("p_size") % 26 + 65).cast("int")), F.col("p_size").cast("string"))
    return p.select("p_partkey", tables.column_index(ref).alias("idx"))


def page_items(spark, d):
    """part laid out as tables: twenty to a page, key, name and a right-aligned number."""
    n = table(spark, d, "part").select(F.floor(F.col("p_partkey") / 20).alias("doc_id"), F.col("p_partkey").alias("key"), F.col("p_name").alias("name"))
    n = n.withColumn("row", F.row_number().over(Window.partitionBy("doc_id").orderBy("key")))
    y = (F.lit(700) - 14 * F.col("row")).cast("double")
    num = (F.col("key") * 137 + 5).cast("string")
    cells = F.array(
        F.struct(F.col("key").cast("string").alias("text"), F.lit(50.0).alias("x"), F.lit(12.0).alias("width")),
        F.struct(F.col("name").alias("text"), F.lit(100.0).alias("x"), (F.length("name") * 5.0).cast("double").alias("width")),
        F.struct(num.alias("text"), (F.lit(400) - F.length(num) * 5.0).cast("double").alias("x"), (F.length(num) * 5.0).cast("double").alias("width")),
    )
    x = n.select("doc_id", F.lit(1).alias("page"), F.col("row"), y.alias("y"), F.posexplode(cells).alias("k", "c"))
    return x.select("doc_id", "page", (F.col("row") * 10 + F.col("k")).cast("int").alias("item_no"), "c.text", "c.x", "y", "c.width", F.lit(10.0).alias("height"))


_ITEMS = """pg AS (SELECT p_partkey // 20 AS doc_id, p_partkey AS key, p_name AS name FROM part), it AS (SELECT doc_id, 50.0::DOUBLE AS x, 62.0::DOUBLE AS e FROM pg UNION ALL SELECT doc_id, 100.0, 100.0 + 5.0 * length(name) FROM pg UNION ALL SELECT doc_id, 400.0 - 5.0 * length(CAST(key * 137 + 5 AS VARCHAR)), 400.0 FROM pg),
co AS (SELECT doc_id, (x + r) / 2 AS boundary FROM (SELECT *, max(e) OVER (PARTITION BY doc_id ORDER BY x, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM it) WHERE x - r >= 5)"""


@query(f"WITH {_ITEMS} SELECT doc_id, boundary::DOUBLE AS boundary FROM co")
def pdf_corridors(spark, d):
    return pdf_layout.page_corridors(page_items(spark, d).withColumn("end", F.col("x") + F.col("width")), "doc_id")


@query(f"WITH {_ITEMS}, bs AS (SELECT doc_id, list(boundary) AS b FROM co GROUP BY 1) SELECT doc_id, CAST(len(list_filter(b, lambda z: (x + e) / 2 > z)) AS INT) AS col, count(*) AS n FROM it JOIN bs USING (doc_id) GROUP BY 1, 2")
def pdf_columns(spark, d):
    items = page_items(spark, d).withColumn("end", F.col("x") + F.col("width"))
    bounds = pdf_layout.page_corridors(items, "doc_id").groupBy("doc_id").agg(F.sort_array(F.collect_list("boundary")).alias("b"))
    x = items.join(bounds, "doc_id")
    return x.groupBy("doc_id", pdf_layout.column_number((F.col("x") + F.col("end")) / 2, F.col("b")).alias("col")).agg(F.count("*").alias("n"))


@query(f"WITH {_ITEMS} SELECT doc_id, CAST(1 AS INT) AS page, string_agg(CASE WHEN rn = 2 THEN '| --- | --- | --- |' || chr(10) ELSE '' END || '| ' || key || ' | ' || name || ' | ' || (key * 137 + 5) || ' |', chr(10) ORDER BY key) AS markdown FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY key) AS rn FROM pg) GROUP BY 1")
def layout_markdown(spark, d):
    return pdf_layout.layout(page_items(spark, d))


# --- facts, scores, digests, guards ----------------------------------------------------------------------------
_FACT_RE = [p.replace("'", "''") for p in report.FACTS.values()]
_FACTS = "list_distinct(list_concat(" + ", ".join(f"regexp_extract_all(text, '{p}')" for p in _FACT_RE) + "))"
_ORDERED = "ot AS (SELECT o_orderkey AS doc_id, 'Order ORD-' || (1000 + o_orderkey) || ' of ' || strftime(o_orderdate, '%Y-%m-%d') || ' costs $' || CAST(floor(o_totalprice) AS BIGINT) || ' at 7.5%.' AS text FROM orders)"


def order_texts(spark, d):
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("doc_id"),
        F.concat(F.lit("Order ORD-"), (F.col("o_orderkey") + 1000).cast("string"), F.lit(" of "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" costs $"), F.floor("o_totalprice").cast("bigint").cast("string"), F.lit(" at 7.5%.")).alias("text"),
    )


@query(f"WITH {_ORDERED} SELECT doc_id, unnest({_FACTS}) AS fact FROM ot")
def facts(spark, d):
    return report.fact_rows(order_texts(spark, d))


def order_letters(spark, d):
    """A letter per fifty orders, five to a paragraph: enough to be compressed."""
    x = order_texts(spark, d).groupBy(F.floor(F.col("doc_id") / 50).alias("k"), F.floor(F.col("doc_id") / 5).alias("p")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "text"))), lambda o: o["text"]), " ").alias("para"))
    x = x.groupBy("k").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "para"))), lambda o: o["para"]), "\n\n").alias("body"))
    return x.select(F.col("k").alias("doc_id"), F.concat(F.lit("# Orders since ORD-"), (F.col("k") * 50 + 1000).cast("string"), F.lit("\n\n"), "body", F.lit("\n\nCopyright 2024 REF-"), (F.col("k") + 1000).cast("string")).alias("text"))


def compressed_letters(spark, d):
    docs = order_letters(spark, d)
    return docs, blocks.render(compress.summarise(clean.kept(clean.strip(blocks.sections(docs))), BUDGET))


_LETTERS = f"""{_ORDERED}, op AS (SELECT doc_id // 50 AS k, doc_id // 5 AS p, string_agg(text, ' ' ORDER BY doc_id) AS para FROM ot GROUP BY 1, 2),
ol AS (SELECT k AS doc_id, '# Orders since ORD-' || (k * 50 + 1000) || chr(10) || chr(10) || string_agg(para, chr(10) || chr(10) ORDER BY p) || chr(10) || chr(10) || 'Copyright 2024 REF-' || (k + 1000) AS text FROM op GROUP BY k), {sections_sql('ol')}, {STRIP}, {MIDDLE},
md AS (SELECT doc_id, string_agg(markdown, chr(10) || chr(10) ORDER BY idx) AS md FROM x GROUP BY 1)"""


@query(f"""WITH {_LETTERS}, f AS (SELECT doc_id, unnest({_FACTS}) AS fact FROM ol), sp AS (SELECT x.doc_id, list(substring(ol.text, k.st + 1, k.en - k.st)) AS spans FROM x JOIN k USING (doc_id, idx) JOIN ol USING (doc_id) WHERE x.compressed GROUP BY 1)
SELECT CASE WHEN contains(md, fact) THEN 'present' WHEN len(list_filter(coalesce(spans, []), lambda s: contains(s, fact))) > 0 THEN 'recoverable' ELSE 'lost' END AS fate, count(*) AS n FROM f JOIN md USING (doc_id) LEFT JOIN sp USING (doc_id) GROUP BY 1""")
def fact_survival(spark, d):
    """What becomes of the facts of letters that are compressed to a budget: what isn't in the text is behind its anchors."""
    return report.fact_survival(*compressed_letters(spark, d)).groupBy("fate").agg(F.count("*").alias("n"))


@query(rf"""WITH {_LETTERS}, e AS (SELECT doc_id, text, md AS cleaned, {_FACTS} AS f FROM ol JOIN md USING (doc_id))
SELECT doc_id, round(0.6 * (CASE WHEN len(f) > 0 THEN len(list_filter(f, lambda z: contains(cleaned, z)))::DOUBLE / len(f) ELSE 1 END) + 0.2 * greatest(0, least(1, 1 - length(cleaned)::DOUBLE / length(text))) + 0.2 * (CASE WHEN regexp_matches(cleaned, '(?m)^(#{{1,6}}\s|[-*+]\s|\|)') THEN 1 ELSE 0 END), 9)::DOUBLE AS score FROM e""")
def eval_score(spark, d):
    docs, md = compressed_letters(spark, d)
    return report.eval_score(docs.join(md, "doc_id"), "text", "markdown").select("doc_id", F.round("score", 9).alias("score"))


@query("SELECT day, CAST(rank_ AS INT) AS rank_, event_id, points FROM (SELECT strftime(ts, '%Y-%m-%d') AS day, event_id, value AS points, row_number() OVER (PARTITION BY strftime(ts, '%Y-%m-%d') ORDER BY value DESC, event_id) AS rank_ FROM events WHERE event_type IS NOT NULL AND event_type <> '') WHERE rank_ <= 10")
def digest_daily_top10(spark, d):
    x = digest.top_stories(table(spark, d, "events"), 10, "ts", "value", "event_type", "event_id")
    return x.select("day", F.col("rank").alias("rank_"), "event_id", F.col("value").alias("points"))


@query("SELECT strftime(ts, '%Y-%m-%d') AS date, CAST(epoch(date_trunc('day', ts)) AS BIGINT) AS start_epoch, CAST(epoch(date_trunc('day', ts)) AS BIGINT) + 86400 AS end_epoch, count(*) AS n, round(sum(value), 4) AS points FROM events GROUP BY 1, 2, 3")
def digest_day_windows(spark, d):
    x = table(spark, d, "events").withColumn("w", digest.day_window("ts"))
    return x.groupBy("w.date", "w.start_epoch", "w.end_epoch").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("points")).select("date", "start_epoch", "end_epoch", "n", "points")


_STORY = "event_type || ' (' || event_id || ')'"


@query(f"""WITH e AS (SELECT strftime(ts, '%Y-%m-%d') AS day, event_id, event_type, value, row_number() OVER (PARTITION BY strftime(ts, '%Y-%m-%d') ORDER BY value DESC, event_id) AS r FROM events WHERE event_type <> '' AND ts IS NOT NULL),
h AS (SELECT day, dense_rank() OVER (ORDER BY day) AS d FROM (SELECT DISTINCT strftime(ts, '%Y-%m-%d') AS day FROM events WHERE ts IS NOT NULL))
SELECT day, d IN (2, 5) AS backfilled, count(*) AS n_items, '# Digest ' || day || chr(10) || chr(10) || '## ' || CASE WHEN d IN (2, 5) THEN 'Top stories of the day' ELSE 'Front page' END || chr(10) || chr(10) || string_agg(r || '. ' || {_STORY}, chr(10) ORDER BY r)
 || CASE WHEN d IN (2, 5) THEN chr(10) || chr(10) || '> Backfilled after the fact: the items timestamped inside that UTC day, not the page as it appeared.' ELSE '' END AS markdown FROM e JOIN h USING (day) WHERE r <= 10 GROUP BY day, d""")
def digest_backfill(spark, d):
    """The archive after its second day was never run, its fifth lost half its items to lateness, and both were backfilled; twice, which changes nothing."""
    events, root = table(spark, d, "events"), shared_dir(spark)
    columns = {"points": "value", "title": "event_type", "key": "event_id"}
    days = [r.day for r in events.filter("ts is not null").select(F.date_format("ts", "yyyy-MM-dd").alias("day")).distinct().orderBy("day").collect()]
    day, at = F.date_format("ts", "yyyy-MM-dd"), dict(enumerate(days, 1))
    held, half = F.coalesce(day == F.lit(at.get(2)), F.lit(False)), F.coalesce((day == F.lit(at.get(5))) & (F.col("event_id") % 2 == 0), F.lit(False))
    digest.take(spark, events.filter(~held & ~half), f"{root}/archive", f"{root}/late", **columns)
    digest.take(spark, events.filter(half), f"{root}/archive", f"{root}/late", **columns)
    for _ in range(2):
        digest.backfill(spark, events.filter(~half), f"{root}/archive", days[0], days[-1], days[-1], spark.read.parquet(f"{root}/late"), **columns)
    return digest.archive(spark, f"{root}/archive").select("day", "backfilled", "n_items", "markdown")


@query("SELECT CAST(user_id AS VARCHAR) AS caller, time_bucket(INTERVAL '1 minute', ts) AS window_start, count(*) AS calls, greatest(0, count(*) - 1) AS over FROM events WHERE user_id IS NOT NULL GROUP BY 1, 2")
def rate_window(spark, d):
    return digest.rate_windows(table(spark, d, "events"), "user_id", "ts", 1)


@query("""WITH c AS (SELECT coalesce(CAST(user_id AS VARCHAR), 'unknown') AS caller, time_bucket(INTERVAL '1 hour', ts) AS w, count(*) AS calls, min(ts) AS begun FROM events WHERE ts IS NOT NULL GROUP BY 1, 2),
k AS (SELECT CASE WHEN row_number() OVER (PARTITION BY w ORDER BY begun, caller) > 10 THEN 'overflow' ELSE caller END AS caller, w, calls FROM c)
SELECT caller, w AS window_start, CAST(sum(calls) AS BIGINT) AS calls, CAST(greatest(0, sum(calls) - 2) AS BIGINT) AS over FROM k GROUP BY 1, 2""")
def rate_overflow(spark, d):
    """Of each hour's callers the first ten have an entry, all others share one; callers without a name are one."""
    return digest.rate_windows(table(spark, d, "events").filter("ts is not null"), "user_id", "ts", 2, "1 hour", 10)


@query("SELECT count(*) AS n_files, CAST(sum(CASE WHEN ok THEN 1 ELSE 0 END) AS BIGINT) AS n_ok, CAST(sum(CASE WHEN ok THEN 0 ELSE 1 END) AS BIGINT) AS n_failed, CAST(sum(CASE WHEN ok THEN i END) AS BIGINT) AS in_tokens, CAST(sum(CASE WHEN ok THEN o END) AS BIGINT) AS out_tokens, CAST(floor(sum(CASE WHEN ok THEN o END) / sum(CASE WHEN ok THEN i END) * 100 + 0.5) AS BIGINT) AS pct FROM (SELECT length(text) > 100 AS ok, ceil(length(text) / 4.0) AS i, ceil(length(text) / 8.0) AS o FROM documents)")
def batch_tally(spark, d):
    x = table(spark, d, "documents").select((F.length("text") > 100).alias("ok"), T.approx_tokens("text").alias("in_tokens"), F.ceil(F.length("text") / 8).alias("out_tokens"))
    return report.batch_tally(x)


@query("SELECT doc_id, CASE WHEN n = 1 THEN b ELSE b || '-' || n END || '.md' AS out_name FROM (SELECT doc_id, b, row_number() OVER (PARTITION BY lower(b) ORDER BY doc_id) AS n FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN upper(source) ELSE source END AS b FROM documents))")
def batch_output_names(spark, d):
    name = F.concat(F.lit("in/"), F.when(F.col("doc_id") % 2 == 0, F.upper("source")).otherwise(F.col("source")), F.lit(".txt"))
    return report.output_names(table(spark, d, "documents").select("doc_id", name.alias("file")), "file", "doc_id").select("doc_id", "out_name")


@query("SELECT source, CAST(sum(n_words) AS BIGINT) AS prompt_tokens, CAST(sum(n_chars) AS BIGINT) AS completion_tokens, CAST(sum(cost) AS BIGINT) AS cost FROM (SELECT source, CAST(ceil(length(text) / 4.0) AS BIGINT) AS n_words, n_chars, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE doc_id END AS cost FROM documents) GROUP BY 1")
def ledger_totals(spark, d):
    x = table(spark, d, "documents").select("source", T.approx_tokens("text").alias("prompt_tokens"), F.col("n_chars").alias("completion_tokens"), F.when(F.col("doc_id") % 3 != 0, F.col("doc_id").cast("double")).alias("cost_usd"))
    return report.ledger_totals(x, "source").select("source", "prompt_tokens", "completion_tokens", F.col("cost_usd").cast("bigint").alias("cost"))


@query(r"SELECT doc_id, left(regexp_replace(coalesce(text, ''), '\b\d{1,3}(\.\d{1,3}){3}(:\d+)?\b', '[host]', 'g'), 400) AS safe FROM documents")
def sanitize(spark, d):
    return table(spark, d, "documents").select("doc_id", digest.sanitise(F.coalesce("text", F.lit(""))).alias("safe"))


@query("SELECT doc_id, CASE WHEN text IS NULL OR trim(text) = '' THEN 'empty' WHEN length(text) > 1000000 THEN 'too-many-chars' END AS reject FROM (SELECT doc_id, CASE WHEN doc_id % 50 = 0 THEN '  ' WHEN doc_id % 50 = 1 THEN repeat('x', 1000001) ELSE text END AS text FROM documents)")
def guard_rejects(spark, d):
    t = F.when(F.col("doc_id") % 50 == 0, F.lit("  ")).when(F.col("doc_id") % 50 == 1, F.repeat(F.lit("x"), 1000001)).otherwise(F.col("text"))
    return digest.rejects(table(spark, d, "documents").withColumn("text", t)).select("doc_id", "reject")


from docloom.plans import conversions  # noqa: E402, F401  its queries are registered here

"""Queries over conversion: documents of every kind, built from the tables, through the readers and the engine.

Ten parts make a document; what each must become is built by SQL from the same rows.
"""

from __future__ import annotations

import io
import zipfile
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from docloom.functions import constants as C, text as T
from docloom.functions.rows import SLICE
from docloom.operators import blocks, digest, prompts, report, store, tables
from docloom.plans.catalogue import dealt, query, table
from docloom.plans.engine import Engine
from docloom.sources import delimited, html, pdf, pdf_layout

GROUP = 10
NL = "' || chr(10) || '"
_G = f"g AS (SELECT p_partkey // {GROUP} AS k, p_partkey AS key, p_name AS name, p_size AS size FROM part)"


def groups(spark: SparkSession, d: str) -> DataFrame:
    """k, n and r: the parts of each group, in order."""
    p = table(spark, d, "part").select(F.floor(F.col("p_partkey") / GROUP).alias("k"), F.struct(F.col("p_partkey").alias("key"), F.col("p_name").alias("name"), F.col("p_size").alias("size")).alias("r"))
    return dealt(p, "k").groupBy("k").agg(F.array_sort(F.collect_list("r")).alias("r")).withColumn("n", F.size("r"))


def each(f) -> Column:
    return F.array_join(F.transform("r", f), "")


def joined(parts: list) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _s(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


# --- HTML ---------------------------------------------------------------------------------------
def html_pages(spark, d):
    items, rows = each(lambda x: F.concat(F.lit("<li>"), x["name"])), each(lambda x: F.concat(F.lit("<tr><td>"), _s(x["key"]), F.lit("</td><td>"), _s(x["size"]), F.lit("</td></tr>")))
    page = joined(
        ["<html><head><title>t</title><script>var x = '<p>no</p>';</script></head><body><nav><a href='/'>Home</a></nav><h1>Parts ", _s("k"), "</h1><p>A list of <b>", _s("n"), "</b> parts &amp; more, see <a href='/p/", _s("k"), "'>here</a>.<p>Unclosed  <i>one</i>.<ul>", items,
         "</ul><table><tr><th>key</th><th>size|unit</th></tr>", rows, "</table><form>f</form><aside>x</aside><blockquote><p>Said.</p></blockquote><footer>foot</footer></body></html>"]
    )
    return groups(spark, d).select("k", page.alias("text"))


HTML_MD = f"'# Parts ' || k || '{NL * 2}A list of **' || count(*) || '** parts & more, see [here](/p/' || k || ').{NL * 2}Unclosed _one_.{NL * 2}' || string_agg('- ' || name, chr(10) ORDER BY key) || '{NL * 2}| key | size\\| unit |{NL}| --- | --- |{NL}' || string_agg('| ' || key || ' | ' || size || ' |', chr(10) ORDER BY key) || '{NL * 2}> Said.'".replace("\\| unit", "\\|unit")


@query(f"WITH {_G} SELECT k, {HTML_MD} AS markdown FROM g GROUP BY k")
def html_articles(spark, d):
    return html.convert(html_pages(spark, d), "text").select("k", "markdown")


# --- CSV and JSON ---------------------------------------------------------------------------------
_SEPS = [",", ";", "|", "\t"]


def csv_texts(spark, d):
    sep = F.element_at(F.array(*[F.lit(s) for s in _SEPS]), (F.col("k") % 4 + 1).cast("int"))
    x = groups(spark, d).withColumn("sep", sep)
    rows = each(lambda r: F.concat(_s(r["key"]), F.col("sep"), F.lit('"'), r["name"], F.col("sep"), F.lit('x"'), F.col("sep"), F.lit(' "say ""hi""\nthere" \r\n')))
    return x.select("k", F.concat(F.lit("key"), "sep", F.lit("name"), "sep", F.lit("note\r\n\r\n"), rows).alias("text"))


CSV_MD = f"'| key | name | note |{NL}| --- | --- | --- |{NL}' || string_agg('| ' || key || ' | ' || name || ['\\,', ';', '\\|', chr(9)][k % 4 + 1] || 'x | say \"hi\" there |', chr(10) ORDER BY key)".replace("'\\,'", "','")


@query(f"WITH {_G} SELECT k, {CSV_MD} AS markdown FROM g GROUP BY k")
def csv_quoted(spark, d):
    return delimited.convert(csv_texts(spark, d), "csv").select("k", "markdown")


def json_texts(spark, d):
    flat = F.concat(F.lit("["), F.array_join(F.transform("r", lambda r: F.concat(F.lit('{"key": '), _s(r["key"]), F.when(r["key"] % 2 == 0, F.lit("")).otherwise(F.concat(F.lit(', "name": "'), r["name"], F.lit('"'))), F.lit(', "size": '), F.when(r["size"] % 3 == 0, F.lit("null")).otherwise(F.concat(_s(r["size"]), F.lit(".50"))), F.lit("}"))), ", "), F.lit("]"))
    nested = F.concat(F.lit('{"k": '), _s("k"), F.lit(', "names": ['), F.array_join(F.transform("r", lambda r: F.concat(F.lit('"'), r["name"], F.lit('"'))), ","), F.lit("]}"))
    broken = F.concat(F.lit("  {broken "), _s("k"), F.lit("\n"))
    return groups(spark, d).select("k", F.when(F.col("k") % 3 == 0, flat).when(F.col("k") % 3 == 1, nested).otherwise(broken).alias("text"))


JSON_MD = f"""CASE k % 3 WHEN 0 THEN '| key | size | name |{NL}| --- | --- | --- |{NL}' || string_agg('| ' || key || ' | ' || CASE WHEN size % 3 = 0 THEN '' ELSE size || '.5' END || ' | ' || CASE WHEN key % 2 = 0 THEN '' ELSE name END || ' |', chr(10) ORDER BY key)
  WHEN 1 THEN '```json{NL}{{{NL}  "k": ' || k || ',{NL}  "names": [{NL}' || string_agg('    "' || name || '"', ',' || chr(10) ORDER BY key) || '{NL}  ]{NL}}}{NL}```' ELSE '{{broken ' || k END"""


@query(f"WITH {_G} SELECT k, {JSON_MD} AS markdown FROM g GROUP BY k")
def json_documents(spark, d):
    return delimited.convert(json_texts(spark, d), "json").select("k", "markdown")


@query("SELECT event_id, event_id % 4 = 0 AS flat, CASE WHEN event_id % 4 = 0 THEN CAST(json_extract(props, '$.k') AS VARCHAR) END AS k FROM events")
def json_flat(spark, d):
    text = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("["), "props", F.lit("]"))).when(F.col("event_id") % 4 == 1, F.concat(F.lit('[{"a": '), "props", F.lit("}]"))).when(F.col("event_id") % 4 == 2, F.col("props")).otherwise(F.lit("[broken"))
    x = table(spark, d, "events").select("event_id", tables.flat_objects(text).alias("rows"))
    return x.select("event_id", F.col("rows").isNotNull().alias("flat"), F.col("rows")[0]["k"].alias("k"))


# --- office and PDF files ------------------------------------------------------------------------------
_REL = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def _zip(members: dict[str, str]) -> bytes:
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in members.items():
            z.writestr(name, body)
    return b.getvalue()


def docx_file(k: int, rows: list[dict]) -> bytes:
    p = lambda text, pr="": f"<p><pPr>{pr}</pPr><r><t>{text}</t></r></p>"
    body = p(f"Parts {k}", '<pStyle val="Heading1"/>') + "<p><r><rPr><b/></rPr><t>Bold</t></r><r><t> text and </t></r><r><rPr><i/></rPr><t>more</t></r></p>"
    body += "".join(p(r["name"], f'<numPr><ilvl val="{i % 2}"/></numPr>') for i, r in enumerate(rows))
    body += "<tbl><tr><tc><p><r><t>key</t></r></p></tc><tc><p><r><t>size</t></r></p></tc></tr>" + "".join(f"<tr><tc><p><r><t>{r['key']}</t></r></p></tc><tc><p><r><t>{r['size']}</t></r></p></tc></tr>" for r in rows) + "</tbl>"
    return _zip({"word/document.xml": f"<document><body>{body}</body></document>"})


def xlsx_file(k: int, rows: list[dict]) -> bytes:
    cells = "".join(f'<row r="{2 * i + 2}"><c r="A{2 * i + 2}"><v>{r["key"]}</v></c><c r="B{2 * i + 2}" t="s"><v>{i + 1}</v></c><c r="D{2 * i + 2}" t="b"><v>{r["size"] % 2}</v></c></row>' for i, r in enumerate(rows))
    return _zip(
        {
            "xl/workbook.xml": f'<workbook {_REL}><sheets><sheet name="Data {k}" r:id="rId7"/><sheet name="Empty" r:id="rId8"/></sheets></workbook>',
            "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="rId7" Target="worksheets/other.xml" Type="t"/><Relationship Id="rId8" Target="/xl/worksheets/e.xml" Type="t"/></Relationships>',
            "xl/sharedStrings.xml": "<sst><si><t>na</t><t>me</t></si>" + "".join(f"<si><r><t>{r['name']}</t></r></si>" for r in rows) + "</sst>",
            "xl/worksheets/other.xml": f'<worksheet><sheetData><row r="1"><c r="A1" t="inlineStr"><is><t>key</t></is></c><c r="B1" t="s"><v>0</v></c><c r="D1" t="inlineStr"><is><t>odd|even</t></is></c></row>{cells}<row r="99"><c r="A99"/></row></sheetData></worksheet>',
            "xl/worksheets/e.xml": "<worksheet><sheetData/></worksheet>",
        }
    )


def pptx_file(k: int, rows: list[dict]) -> bytes:
    slide = lambda t, body: f"<sld><spTree><sp><txBody><p><r><t>{t}</t></r></p></txBody></sp>{body}</spTree></sld>"
    grid = "<graphicFrame><tbl>" + "".join(f"<tr><tc><t>{r['key']}</t></tc><tc><t>{r['name']}</t></tc></tr>" for r in rows) + "</tbl></graphicFrame>"
    return _zip(
        {
            "ppt/presentation.xml": "<p/>", "ppt/slides/slide10.xml": slide(f"Last of {k}", ""), "ppt/slides/slide2.xml": slide(f"Parts {k}", grid), "ppt/slides/slide3.xml": "<sld/>",
            "ppt/slides/_rels/slide2.xml.rels": '<Relationships><Relationship Id="a" Target="../notesSlides/n9.xml" Type="x/notesSlide"/></Relationships>', "ppt/notesSlides/n9.xml": "<n><p><t>a note</t></p><p><t>1</t></p></n>",
        }
    )


def pdf_file(k: int, rows: list[dict]) -> bytes:
    """Two pages, deflated for odd k: a sentence and a table with right-aligned numbers; wrapped prose with a word cut in two."""
    at = lambda x, y, s: f"1 0 0 1 {x} {y} Tm ({s}) Tj\n"
    lines = [("key", "name", "size")] + [(str(r["key"]), r["name"], str(r["size"])) for r in rows]
    one = "BT /F1 10 Tf\n" + at(50, 760, f"Parts of group {k}.") + "".join(at(50, 730 - 14 * i, a) + at(150, 730 - 14 * i, b) + at(400 - 5 * len(c), 730 - 14 * i, c) for i, (a, b, c) in enumerate(lines)) + "ET"
    two = "BT /F1 10 Tf\n" + at(50, 760, f"The first line of {k} goes on") + at(50, 746, "to the second, an exam-") + at(50, 732, "ple of wrapped text.") + at(50, 704, "- a bullet") + "ET"
    out = b"%PDF-1.4\n1 0 obj << /Type /Font /BaseFont /F1 >> endobj\n"
    for n, body in enumerate((one, two)):
        data = zlib.compress(body.encode()) if k % 2 else body.encode()
        out += b"%d 0 obj << /Type /Page /Contents %d 0 R >> endobj\n" % (10 + n, 20 + n) + b"%d 0 obj << /Length %d%s >> stream\n" % (20 + n, len(data), b" /Filter /FlateDecode" if k % 2 else b"") + data + b"\nendstream endobj\n"
    return out


def thin_pdf(k: int, rows: list[dict]) -> bytes:
    """A page with hardly any text: the fast path's output is too little."""
    body = f"BT /F1 10 Tf 1 0 0 1 50 700 Tm (No. {k}) Tj ET".encode()
    return b"%PDF-1.4\n1 0 obj << /Type /Font /BaseFont /F1 >> endobj\n10 0 obj << /Type /Page /Contents 20 0 R >> endobj\n20 0 obj << /Length " + str(len(body)).encode() + b" >> stream\n" + body + b"\nendstream endobj\n"


_MAKE = {"thin": thin_pdf, "png": lambda k, rows: b"\x89PNG\r\n\x1a\n" + str(k).encode(), "docx": docx_file, "xlsx": xlsx_file, "pptx": pptx_file, "doc": lambda k, rows: b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1old", "pdf": pdf_file}
_OFFICE = ["docx", "xlsx", "pptx", "doc"]


def made_files(spark, d, forms: list[str]) -> DataFrame:
    """path and content: the form of a group's file goes by its number."""

    def make(frames):
        for f in (g.iloc[i : i + SLICE] for g in frames for i in range(0, len(g), SLICE)):
            names = [f"in/{forms[k % len(forms)]}/g{k}.{forms[k % len(forms)]}" for k in f["k"]]
            yield pd.DataFrame({"path": names, "content": [_MAKE[forms[k % len(forms)]](int(k), [dict(key=x["key"], name=x["name"], size=x["size"]) for x in r]) for k, r in zip(f["k"], f["r"])]})

    return groups(spark, d).select("k", "r").mapInPandas(make, "path string, content binary")


_DOCX_MD = f"'# Parts ' || k || '{NL * 2}**Bold** text and _more_{NL * 2}' || string_agg(CASE WHEN key % 2 = 0 THEN '- ' ELSE '  - ' END || name, chr(10) ORDER BY key) || '{NL * 2}| key | size |{NL}| --- | --- |{NL}' || string_agg('| ' || key || ' | ' || size || ' |', chr(10) ORDER BY key)"
_XLSX_MD = f"'## Data ' || k || '{NL * 2}| key | name |  | odd\\|even |{NL}| --- | --- | --- | --- |{NL}' || string_agg('| ' || key || ' | ' || name || ' |  | ' || CASE WHEN size % 2 = 1 THEN 'TRUE' ELSE 'FALSE' END || ' |', '{NL}|  |  |  |  |{NL}' ORDER BY key) || '{NL * 2}## Empty{NL * 2}_(empty sheet)_'"
_PPTX_MD = f"'## Slide 1{NL * 2}Parts ' || k || '{NL * 2}' || min('| ' || key || ' | ' || name || ' |') FILTER (WHERE i = 1) || '{NL}| --- | --- |' || coalesce(chr(10) || string_agg('| ' || key || ' | ' || name || ' |', chr(10) ORDER BY key) FILTER (WHERE i > 1), '') || '{NL * 2}> a note{NL * 2}## Slide 2{NL * 2}_(empty slide)_{NL * 2}## Slide 3{NL * 2}Last of ' || k"
_PDF_MD = f"'Parts of group ' || k || '.{NL * 2}| key | name | size |{NL}| --- | --- | --- |{NL}' || string_agg('| ' || key || ' | ' || name || ' | ' || size || ' |', chr(10) ORDER BY key) || '{NL * 2}The first line of ' || k || ' goes on to the second, an example of wrapped text.{NL}- a bullet'"
_GI = f"{_G}, gi AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY key) AS i FROM g)"


@query(f"""WITH {_GI} SELECT 'in/' || e || '/g' || k || '.' || e AS path, 'office' AS kind, 'native' AS engine, e <> 'doc' AS ok, CASE e WHEN 'docx' THEN docx WHEN 'xlsx' THEN xlsx WHEN 'pptx' THEN pptx END AS markdown, e = 'doc' AS refused
FROM (SELECT k, ['docx', 'xlsx', 'pptx', 'doc'][k % 4 + 1] AS e, {_DOCX_MD} AS docx, {_XLSX_MD} AS xlsx, {_PPTX_MD} AS pptx FROM gi GROUP BY k)""")
def office_files(spark, d):
    x = Engine(spark).convert_files(made_files(spark, d, _OFFICE))
    return x.select("path", "kind", "engine", "ok", "markdown", F.col("error").contains("legacy").alias("refused")).fillna(False, ["refused"])


@query(f"WITH {_GI} SELECT 'in/pdf/g' || k || '.pdf' AS path, 'pdf' AS kind, 'native' AS engine, true AS ok, {_PDF_MD} AS markdown FROM gi GROUP BY k")
def pdf_files(spark, d):
    return Engine(spark).convert_files(made_files(spark, d, ["pdf"])).select("path", "kind", "engine", "ok", "markdown")


_ESCALATED = ["pdf", "thin", "png", "doc"]


@query(rf"""WITH {_GI}, f AS (SELECT k, 'in/' || e || '/g' || k || '.' || e AS path, e, CASE e WHEN 'pdf' THEN md WHEN 'thin' THEN 'No. ' || k END AS md FROM (SELECT k, ['pdf', 'thin', 'png', 'doc'][k % 4 + 1] AS e, {_PDF_MD} AS md FROM gi GROUP BY k)),
q AS (SELECT *, k % 3 <> 0 AND (e = 'png' OR e IN ('pdf', 'thin') AND length(regexp_replace(md, '\s+', ' ', 'g')) / CASE e WHEN 'pdf' THEN 2.0 ELSE 1.0 END < {C.MIN_YIELD_CHARS_PER_PAGE}) AS again FROM f)
SELECT path, CASE e WHEN 'png' THEN 'image' WHEN 'doc' THEN 'office' ELSE 'pdf' END AS kind, CASE WHEN again OR e = 'png' THEN 'docling' ELSE 'native' END AS engine, e <> 'doc' AND (e <> 'png' OR again) AS ok, CASE WHEN again THEN 'read: ' || path ELSE md END AS markdown FROM q""")
def files_escalated(spark, d):
    """Pages with little text and images go to a slower engine, which fails on every third; what the fast one had stays then."""

    def slow(row: dict) -> str:
        if int(row["path"].split("/g")[1].split(".")[0]) % 3 == 0:
            raise OSError("not today")
        return f"read: {row['path']}"

    return Engine(spark, ocr=slow).convert_files(made_files(spark, d, _ESCALATED)).select("path", "kind", "engine", "ok", "markdown")


@query(f"WITH {_G} SELECT 'in/pdf/g' || k || '.pdf' AS path, CAST(n AS INT) AS page, CASE n WHEN 1 THEN count(*) * 3 + 4 ELSE 4 END AS n_items FROM g, (VALUES (1), (2)) v(n) GROUP BY k, n")
def pdf_items(spark, d):
    return pdf.read_items(made_files(spark, d, ["pdf"])).groupBy("path", "page").agg(F.count("*").alias("n_items"))


@query(f"""WITH {_GI} SELECT count(*) AS n_files, CAST(sum(CASE WHEN e <> 'doc' THEN 1 ELSE 0 END) AS BIGINT) AS n_ok, CAST(sum(CASE WHEN e = 'doc' THEN 1 ELSE 0 END) AS BIGINT) AS n_failed, CAST(sum(CASE e WHEN 'docx' THEN ceil(length(docx) / 4.0) WHEN 'xlsx' THEN ceil(length(xlsx) / 4.0) WHEN 'pptx' THEN ceil(length(pptx) / 4.0) END) AS BIGINT) AS out_tokens
FROM (SELECT k, ['docx', 'xlsx', 'pptx', 'doc'][k % 4 + 1] AS e, {_DOCX_MD} AS docx, {_XLSX_MD} AS xlsx, {_PPTX_MD} AS pptx FROM gi GROUP BY k)""")
def batch_files(spark, d):
    return Engine(spark).batch(made_files(spark, d, _OFFICE))[1].select("n_files", "n_ok", "n_failed", "out_tokens")


# --- page geometry: spanning headers, indents ---------------------------------------------------------------
def indented_items(spark, d):
    """A page per group: two labels over two columns each, and names of which every third is a parent of the ones after it."""
    cell = lambda text, x, y: F.struct(text.alias("text"), F.lit(float(x)).alias("x") if not isinstance(x, Column) else x.alias("x"), y.alias("y"), (F.length(text) * 5.0).alias("width"))
    top = F.array(cell(F.lit("First columns"), 250, F.lit(760.0)), cell(F.lit("Second half"), 450, F.lit(760.0)), *[cell(F.lit(t), x, F.lit(746.0)) for t, x in (("Item", 50), ("a", 250), ("b", 300), ("c", 450), ("d", 500))])
    rows = F.flatten(F.transform("r", lambda r, i: F.array(cell(r["name"], F.when(i % 3 == 0, 50.0).otherwise(60.0), (732.0 - 14.0 * i)), cell(_s(r["key"] % 10), 250, 732.0 - 14.0 * i), cell(F.lit("1"), 300, 732.0 - 14.0 * i), cell(_s(r["size"] % 10), 450, 732.0 - 14.0 * i), cell(F.lit("2"), 500, 732.0 - 14.0 * i))))
    x = groups(spark, d).select(F.col("k").alias("doc_id"), F.posexplode(F.concat(top, rows)).alias("item_no", "c"))
    return x.select("doc_id", F.lit(1).alias("page"), "item_no", "c.text", "c.x", "c.y", "c.width", F.lit(10.0).alias("height"))


@query(f"""WITH {_GI}, p AS (SELECT *, max(CASE WHEN (i - 1) % 3 = 0 THEN i END) OVER (PARTITION BY k ORDER BY i) AS up FROM gi), q AS (SELECT p.k, p.i, CASE WHEN p.up = p.i THEN p.name ELSE u.name || ' › ' || p.name END AS label, p.key, p.size FROM p JOIN gi u ON u.k = p.k AND u.i = p.up)
SELECT k AS doc_id, CAST(1 AS INT) AS page, '| Item | First columns a | First columns b | Second half c | Second half d |{NL}| --- | --- | --- | --- | --- |{NL}' || string_agg('| ' || label || ' | ' || key % 10 || ' | 1 | ' || size % 10 || ' | 2 |', chr(10) ORDER BY i) AS markdown FROM q GROUP BY k""")
def layout_hierarchy(spark, d):
    return pdf_layout.layout(indented_items(spark, d))


# --- prompts ---------------------------------------------------------------------------------------------
@query("""SELECT p_partkey AS doc_id, 'We need ' || p_name || ' for the shop. It has size ' || p_size || ' and more. Send it by noon.' || chr(10) || chr(10) || 'The brand is ' || p_brand || '.' AS cleaned FROM part""")
def filler_paragraphs(spark, d):
    """Greetings, hedges, repeats in other words' case, sentences within others, and thanks; all of it goes."""
    t = joined(["ok so, We need ", F.col("p_name"), " for the shop. honestly, we need ", F.upper("p_name"), " for the shop! It has size ", _s("p_size"), " and more. size ", _s("p_size"), ". did i mention it? Send it by noon. thanks!!\n\n\nThe brand is ", F.col("p_brand"), ". You know, the brand is ", F.col("p_brand"), ". Thanks"])
    return prompts.strip_filler(dealt(table(spark, d, "part"), "p_partkey").select(F.col("p_partkey").alias("doc_id"), t.alias("text"))).select("doc_id", "cleaned")


# --- the engine ----------------------------------------------------------------------------------------------
def mixed_texts(spark, d):
    named = lambda x, p: x.select(F.concat(F.lit(p), _s("k")).alias("doc_id"), "text")
    mail = dealt(table(spark, d, "customer"), "c_custkey").select(F.concat(F.lit("mail-"), _s("c_custkey")).alias("doc_id"), F.concat(F.lit("From: "), "c_name", F.lit("\nSubject: order\n\n\nHello "), "c_name").alias("text"))
    notes = groups(spark, d).select("k", joined(["# Parts ", _s("k"), "\n\n", each(lambda r: F.concat(r["name"], F.lit(" is a part that we have. Order it by number "), _s(r["key"]), F.lit(".\n\n"))), "Copyright 2024 us\n\n## Empty\n"]).alias("text"))
    return named(html_pages(spark, d), "html-").unionByName(named(plain_csv(spark, d), "csv-")).unionByName(named(json_texts(spark, d).filter("k % 3 < 2"), "json-")).unionByName(mail).unionByName(named(notes, "note-"))


def plain_csv(spark, d):
    rows = each(lambda r: F.concat(F.lit("\n"), _s(r["key"]), F.lit(","), r["name"], F.lit(","), _s(r["size"])))
    return groups(spark, d).select("k", F.concat(F.lit("key,name,size"), rows).alias("text"))


PLAIN_MD = f"'| key | name | size |{NL}| --- | --- | --- |{NL}' || string_agg('| ' || key || ' | ' || name || ' | ' || size || ' |', chr(10) ORDER BY key)"
_MIXED = f"""{_G}, o AS (SELECT 'html-' || k AS doc_id, 'html' AS kind, 'native' AS engine, {HTML_MD} AS md FROM g GROUP BY k UNION ALL SELECT 'csv-' || k, 'csv', 'native', {PLAIN_MD} FROM g GROUP BY k UNION ALL SELECT 'json-' || k, 'json', 'native', {JSON_MD} FROM g WHERE k % 3 < 2 GROUP BY k
 UNION ALL SELECT 'mail-' || c_custkey, 'email', 'prompt-optimizer', 'From: ' || c_name || '{NL}Subject: order{NL * 2}Hello ' || c_name FROM customer
 UNION ALL SELECT 'note-' || k, 'prompt', 'prompt-optimizer', '# Parts ' || k || '{NL * 2}' || string_agg(name || ' is a part that we have. Order it by number ' || key || '.', chr(10) || chr(10) ORDER BY key) FROM g GROUP BY k)"""


@query(f"WITH {_MIXED} SELECT doc_id, kind, engine, md AS markdown, CAST(list_sum(list_transform(string_split(md, chr(10) || chr(10)), lambda x: ceil(length(x) / 4.0))) AS BIGINT) AS output_tokens, kind IN ('prompt', 'email') AS no_model FROM o")
def convert_texts(spark, d):
    x = Engine(spark).convert_texts(mixed_texts(spark, d), structure=False)
    return x.select("doc_id", "kind", "engine", "markdown", "output_tokens", F.array_contains("warnings", "no-language-model").alias("no_model"))


@query(f"WITH {_MIXED}, r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY doc_id) AS i FROM o) SELECT kind, count(*) AS n, CAST(sum(length(md)) AS BIGINT) AS chars FROM r GROUP BY 1")
def convert_by_kind(spark, d):
    x = Engine(spark).convert_texts(mixed_texts(spark, d), structure=False)
    return x.groupBy("kind").agg(F.count("*").alias("n"), F.sum(F.length("markdown")).cast("bigint").alias("chars"))


# --- characters beyond the basic plane --------------------------------------------------------------------
def _astral(c: Column) -> Column:
    return F.regexp_replace(c, "a", "😀")


_U16 = "(length({0}) + len(regexp_extract_all({0}, '[\\x{{10000}}-\\x{{10FFFF}}]')))"


@query(f"SELECT doc_id, CAST(ceil({_U16.format('t')} / 4.0) AS INT) AS tokens, CAST({_U16.format('t')} AS INT) AS units FROM (SELECT doc_id, replace(coalesce(text, ''), 'a', '😀') AS t FROM documents)")
def utf16_tokens(spark, d):
    x = table(spark, d, "documents").select("doc_id", _astral(F.coalesce("text", F.lit(""))).alias("t"))
    return x.select("doc_id", T.approx_tokens("t").alias("tokens"), T.utf16_length("t").alias("units"))


@query(f"""WITH t AS (SELECT doc_id, unnest(string_split(replace(coalesce(text, ''), 'a', '😀'), chr(10))) AS line, generate_subscripts(string_split(replace(coalesce(text, ''), 'a', '😀'), chr(10)), 1) AS i FROM documents),
u AS (SELECT *, {_U16.format('line')} AS n FROM t), s AS (SELECT *, coalesce(sum(n + 2) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS st FROM u),
f AS (SELECT doc_id, st + length(line) - length(ltrim(line)) AS st, trim(line) AS line FROM s WHERE trim(line) <> '')
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY st) - 1 AS INT) AS idx, CAST(st AS INT) AS start_, CAST(st + {_U16.format('line')} AS INT) AS end_, line AS span FROM f""")
def utf16_spans(spark, d):
    """Spans count UTF-16 units, and give the section's text back from the stored original."""
    docs = table(spark, d, "documents").select("doc_id", _astral(F.regexp_replace(F.coalesce("text", F.lit("")), "\n", "\n\n")).alias("text"))
    secs = blocks.sections(docs).select("doc_id", "idx", "src.source_id", "src.start", "src.end")
    return store.spans(secs, store.originals(docs)).select("doc_id", "idx", F.col("start").alias("start_"), F.col("end").alias("end_"), "span")


# --- digests ----------------------------------------------------------------------------------------------
_SUMMARY = "'<p>Event <b>' || event_type || '</b></p>' || repeat('word  ', CAST(event_id % 60 AS INT))"
_FLAT = "trim(regexp_replace(regexp_replace({}, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'))"


def feed_items(spark, d):
    e = table(spark, d, "events").filter("event_type is not null")
    url = F.when(F.col("event_id") % 7 != 0, F.concat(F.lit("http://x/"), _s("event_id")))
    return e.select(F.date_format("ts", "yyyy-MM-dd").alias("day"), F.col("event_id").alias("seq"), F.when(F.col("event_id") % 5 != 0, F.concat("event_type", F.lit(" "), _s("event_id"))).otherwise(F.lit("")).alias("title"), url.alias("url"), F.concat(F.lit("<p>Event <b>"), "event_type", F.lit("</b></p>"), F.repeat(F.lit("word  "), (F.col("event_id") % 60).cast("int"))).alias("summary"))


@query(f"""WITH i AS (SELECT strftime(ts, '%Y-%m-%d') AS day, event_id, event_type || ' ' || event_id AS title, {_FLAT.format(_SUMMARY)} AS flat, row_number() OVER (PARTITION BY strftime(ts, '%Y-%m-%d') ORDER BY event_id) AS r FROM events WHERE event_type IS NOT NULL AND event_id % 7 <> 0 AND event_id % 5 <> 0)
SELECT day, event_id AS seq, CAST(r AS INT) AS rank_, title, CASE WHEN length(flat) <= 180 THEN flat ELSE rtrim(left(flat, 180)) || '…' END AS summary FROM i WHERE r <= 5""")
def digest_articles(spark, d):
    return digest.articles(feed_items(spark, d)).select("day", "seq", F.col("rank").alias("rank_"), "title", "summary")


@query(f"""WITH i AS (SELECT strftime(ts, '%Y-%m-%d') AS day, event_id, event_type, {_FLAT.format(_SUMMARY)} AS flat FROM events WHERE event_type IS NOT NULL), n AS (SELECT day, string_agg('Event ' || event_type, ' / ' ORDER BY event_id) AS news FROM (SELECT *, row_number() OVER (PARTITION BY day ORDER BY event_id) AS r FROM i) WHERE r <= 5 GROUP BY 1),
f AS (SELECT day, arg_min(event_type, event_id) AS title, arg_max(flat || ' ' || flat, event_id) AS x FROM i GROUP BY 1)
SELECT day, title AS featured_title, CASE WHEN length(trim(x)) <= 420 THEN trim(x) ELSE rtrim(left(trim(x), 420)) || '…' END AS featured_extract, news FROM f JOIN n USING (day)""")
def digest_featured(spark, d):
    e = table(spark, d, "events").filter("event_type is not null").select(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_id", "event_type")
    x = F.concat(F.lit("<p>Event <b>"), "event_type", F.lit("</b></p>"), F.repeat(F.lit("word  "), (F.col("event_id") % 60).cast("int")))
    feed = e.groupBy("day").agg(F.struct(F.min_by("event_type", "event_id").alias("title"), F.max_by(F.concat(x, F.lit(" "), x), "event_id").alias("extract")).alias("tfa"), F.transform(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))), lambda p: F.struct(F.concat(F.lit("<i>Event</i> "), p["event_type"]).alias("story"))).alias("news"))
    return digest.featured(feed).select("day", "featured_title", "featured_extract", F.array_join("news", " / ").alias("news"))


@query("""WITH s AS (SELECT strftime(ts, '%Y-%m-%d') AS day, event_type AS source, count(*) AS n, CAST(floor(epoch(min(ts))) AS BIGINT) % 3 <> 0 AS ok FROM events WHERE event_type IS NOT NULL GROUP BY 1, 2)
SELECT day, count(*) FILTER (WHERE ok) AS n_ok, CAST(coalesce(sum(n) FILTER (WHERE ok), 0) AS BIGINT) AS raw_tokens, coalesce(string_agg(source, ',' ORDER BY source) FILTER (WHERE NOT ok), '') AS failed,
 CASE WHEN count(*) FILTER (WHERE ok) > 0 THEN '# Digest ' || day || chr(10) || chr(10) || string_agg('## ' || source || chr(10) || chr(10) || n || ' events' || chr(10) || chr(10) || 'Source: ' || source, chr(10) || chr(10) ORDER BY source) FILTER (WHERE ok) END AS markdown FROM s GROUP BY day""")
def digest_brief(spark, d):
    e = table(spark, d, "events").filter("event_type is not null").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), F.col("event_type").alias("source")).agg(F.count("*").alias("raw_tokens"), (F.unix_seconds(F.min("ts").cast("timestamp")) % 3 != 0).alias("ok"))
    x = digest.brief(e.select("day", F.col("source").alias("ord"), F.col("source").alias("heading"), F.concat(_s("raw_tokens"), F.lit(" events")).alias("body"), "source", "raw_tokens", "ok"))
    return x.select("day", "n_ok", "raw_tokens", F.array_join("failed_sources", ",").alias("failed"), "markdown")


@query("SELECT DISTINCT strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders WHERE o_orderdate <= TIMESTAMP '1998-06-30' AND o_orderkey % 2 = 0")
def digest_archive(spark, d):
    day = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.lit("1998-02-31"))
    return digest.archive_index(table(spark, d, "orders").select(day.alias("day")).distinct(), "1998-06-30")


# --- baselines ---------------------------------------------------------------------------------------------
@query(f"WITH {_G}, m AS (SELECT k, {HTML_MD} AS md FROM g GROUP BY k) SELECT k, CAST(ceil(length(md) / 4.0) AS INT) AS from_output FROM m")
def baseline_tokens(spark, d):
    x = html.convert(html_pages(spark, d), "text")
    return x.select("k", T.approx_tokens(report.baseline(F.lit("office"), "text", "markdown")).alias("from_output"))




from docloom.plans import surfaces  # noqa: E402, F401  whichever of the three is imported first, as in a worker

"""Converters: HTML, CSV, JSON, office containers, PDF text layers and page geometry."""

import io
import json
import zipfile

import pytest

from docloom.functions import constants as C
from docloom.sources import delimited, external, feeds, files, html, ooxml, pdf, pdf_layout


def test_html_blocks_links_lists_and_tables():
    page = "<html><head><title>t</title><script>x</script></head><body><nav>menu</nav><h2>Head</h2><p>One <b>bold</b> and <a href='/x'>link</a>.<ul><li>a<li>b<ol><li>c</ol></ul><table><tr><th>k</th><th>v|w</th></tr><tr><td>1</td></tr></table><pre>code\n  x</pre><blockquote><p>said</p></blockquote><footer>f</footer>"
    md = html.to_markdown(page)
    assert md == "## Head\n\nOne **bold** and [link](/x).\n\n- a\n- b\n  1. c\n\n| k | v\\|w |\n| --- | --- |\n| 1 |  |\n\n```\ncode\n  x\n```\n\n> said"
    assert "menu" not in html.plain_text(page) and "said" in html.plain_text(page)


def test_html_unclosed_paragraphs():
    assert html.to_markdown("<p><b>Title.<br><p>One.</p><p>Two &amp; three") .split("\n\n")[-2:] == ["One.", "Two & three"]


@pytest.mark.parametrize("page", ["", "<", "</p>", "<table></table>", "<ul></ul>", "<p>"])
def test_html_without_content(page):
    assert html.to_markdown(page) in ("", "<")


def test_csv_quotes_delimiters_and_line_ends():
    assert delimited.csv_rows('a,b,c\n1,"x, ""y""\nz",3\n') == [["a", "b", "c"], ["1", 'x, "y"\nz', "3"]]
    assert delimited.csv_to_markdown("a\tb\n1\t2") == "| a | b |\n| --- | --- |\n| 1 | 2 |"
    assert delimited.detect(["a;b;c", "1;2;3"]) == ";" and delimited.detect(["plain"]) == ","
    assert delimited.csv_rows('x;said "hi" there') == [["x", "said hi there"]]


def test_json_tables_and_fences():
    assert delimited.json_to_markdown('[{"a": 1, "b": null}, {"c": true, "a": 1.50}]') == "| a | b | c |\n| --- | --- | --- |\n| 1 |  |  |\n| 1.5 |  | true |"
    assert delimited.json_to_markdown('{"a": [1]}') == '```json\n{\n  "a": [\n    1\n  ]\n}\n```'
    assert delimited.json_to_markdown(" {broken ") == "{broken"


def container(**members):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in members.items():
            z.writestr(name.replace("__", "/"), body)
    return b.getvalue()


R = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
XLSX = {
    "xl/workbook.xml": f'<workbook {R}><sheets><sheet name="Data" r:id="rId7"/><sheet name="Empty" r:id="rId8"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="rId7" Target="worksheets/other.xml" Type="t"/><Relationship Id="rId8" Target="/xl/worksheets/e.xml" Type="t"/></Relationships>',
    "xl/sharedStrings.xml": "<sst><si><t>na</t><t>me</t></si><si><r><t>x|y</t></r></si></sst>",
    "xl/worksheets/other.xml": '<worksheet><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>in</t></is></c></row><row r="3"><c r="B3" t="b"><v>1</v></c><c r="C3"><v>4.5</v></c></row><row r="9"><c r="A9"/></row></sheetData></worksheet>',
    "xl/worksheets/e.xml": "<worksheet><sheetData/></worksheet>",
}


def test_xlsx_cells_strings_gaps_and_empty_sheets():
    md = ooxml.to_markdown(container(**{k.replace("/", "__"): v for k, v in XLSX.items()}))
    assert md == "## Data\n\n| name |  | in |\n| --- | --- | --- |\n|  |  |  |\n|  | TRUE | 4.5 |\n\n## Empty\n\n_(empty sheet)_"
    assert [ooxml.column_index(r) for r in ("A1", "Z2", "AA1", "BC12")] == [0, 25, 26, 54]


def test_pptx_order_tables_and_notes():
    slide = lambda t: f"<sld><spTree><sp><txBody><p><r><t>{t}</t></r></p></txBody></sp><graphicFrame><tbl><tr><tc><t>k</t></tc><tc><t>v</t></tc></tr></tbl></graphicFrame></spTree></sld>"
    m = {"ppt/presentation.xml": "<p/>", "ppt/slides/slide10.xml": slide("ten"), "ppt/slides/slide2.xml": slide("two"), "ppt/slides/_rels/slide2.xml.rels": '<Relationships><Relationship Id="a" Target="../notesSlides/n9.xml" Type="x/notesSlide"/></Relationships>', "ppt/notesSlides/n9.xml": "<n><p><t>note</t></p><p><t>1</t></p></n>"}
    md = ooxml.to_markdown(container(**{k.replace("/", "__"): v for k, v in m.items()}))
    assert md == "## Slide 1\n\ntwo\n\n| k | v |\n\n> note\n\n## Slide 2\n\nten\n\n| k | v |"


def test_docx_headings_lists_tables_and_runs():
    body = '<document><body><p><pPr><pStyle val="Heading2"/></pPr><r><t>Head</t></r></p><p><r><rPr><b/></rPr><t>Bold</t></r><r><t> text</t></r></p><p><pPr><numPr><ilvl val="0"/></numPr></pPr><r><t>one</t></r></p><p><pPr><numPr><ilvl val="1"/></numPr></pPr><r><t>two</t></r></p><tbl><tr><tc><p><r><t>a</t></r></p></tc><tc><p><r><t>b</t></r></p></tc></tr></tbl></body></document>'
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("word/document.xml", body)
    assert ooxml.to_markdown(b.getvalue()) == "## Head\n\n**Bold** text\n\n- one\n  - two\n\n| a | b |"


def test_office_refusals(monkeypatch):
    for data in (b"plain", b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1rest"):
        with pytest.raises(ooxml.OfficeError):
            ooxml.to_markdown(data)
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("other/x.xml", "<a/>")
    with pytest.raises(ooxml.OfficeError):
        ooxml.to_markdown(b.getvalue())
    monkeypatch.setattr(C, "ENTRY_BYTES", 100)
    with zipfile.ZipFile(b, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", "<a>" + "x" * 1000 + "</a>")
    with pytest.raises(ooxml.OfficeError):
        ooxml.to_markdown(b.getvalue())


def run(text, x, y, width=None, height=10.0):
    return {"text": text, "x": float(x), "y": float(y), "width": float(width if width is not None else 5 * len(text)), "height": height}


def test_layout_table_with_right_aligned_numbers():
    rows = [("Region", 50, "Q1", 260, "Q2", 360), ("North", 50, "1,200", 245, "9", 365), ("South", 50, "7", 265, "4,812", 345)]
    runs = [r for i, (a, ax, b, bx, c, cx) in enumerate(rows) for r in (run(a, ax, 700 - 14 * i), run(b, bx, 700 - 14 * i), run(c, cx, 700 - 14 * i))]
    assert pdf_layout.page_markdown(runs) == "| Region | Q1 | Q2 |\n| --- | --- | --- |\n| North | 1,200 | 9 |\n| South | 7 | 4,812 |"


def test_layout_spanning_header_and_indents():
    runs = [run("2024", 210, 728, 60), run("2025", 410, 728, 60)]
    for i, (a, x, vals) in enumerate([("Item", 50, ("A", "B", "C", "D")), ("Sales", 50, ("1", "2", "3", "4")), ("Shoes", 60, ("5", "6", "7", "8"))]):
        runs += [run(a, x, 714 - 14 * i), *[run(v, 200 + 100 * k if k < 2 else 200 + 100 * k, 714 - 14 * i, 5) for k, v in enumerate(vals)]]
    md = pdf_layout.page_markdown(runs).split("\n")
    assert md[0] == "| Item | 2024 A | 2024 B | 2025 C | 2025 D |"
    assert md[-1] == "| Sales › Shoes | 5 | 6 | 7 | 8 |"


def test_layout_prose_joins_lines_and_split_runs():
    runs = [run("A sen", 50, 700, 25), run("tence that goes on and is hyphen-", 75.2, 700), run("ated at the end.", 50, 686), run("- bullet", 50, 672), run("New 1 2 3", 50, 658)]
    assert pdf_layout.page_markdown(runs) == "A sentence that goes on and is hyphenated at the end.\n- bullet\nNew 1 2 3"
    assert pdf_layout.page_markdown([run("  ", 1, 1)]) == ""


def pdf_bytes(content, extra=b""):
    return b"%PDF-1.4\n1 0 obj << /Type /Page /Contents 2 0 R >> endobj\n2 0 obj << /Length 1 " + extra + b">> stream\n" + content + b"\nendstream endobj\n3 0 obj << /Type /Font /BaseFont /Helv >> endobj"


def test_pdf_runs_plain_and_deflated():
    import zlib

    content = b"BT /F1 10 Tf 1 0 0 1 50 700 Tm (Hello \\(x\\)) Tj 0 -14 Td [(Wor) -20 (ld) -300 (again)] TJ ET"
    for data in (pdf_bytes(content), pdf_bytes(zlib.compress(content), b"/Filter /FlateDecode ")):
        got = list(pdf.items(data))
        assert [(p, k, t, x, y) for p, k, t, x, y, _, _ in got] == [(1, 0, "Hello (x)", 50.0, 700.0), (1, 1, "World again", 50.0, 686.0)]
    assert list(pdf.items(b"no pdf")) == []


def test_gateway_retries_then_next_model():
    calls, waits = [], []

    def call(model, request):
        calls.append(model)
        if model == "a" or len(calls) < 5:
            raise external.Retryable("429")
        return {"content": [{"text": "x"}, "y"], "prompt_tokens": 3}

    got = external.complete({}, ["a", "b"], call, sleep=waits.append)
    assert got["text"] == "xy" and got["model"] == "b" and calls == ["a"] * 3 + ["b"] * 2 and waits == [0.25, 0.5, 0.25]
    with pytest.raises(RuntimeError):
        external.complete({}, ["a"], call, sleep=waits.append)


def test_services_missing_or_failing_are_rows(spark):
    df = spark.createDataFrame([(1, "ok"), (2, "bad")], "id long, text string")
    assert all(r.error and r.markdown is None for r in external.map_service(df, None).collect())

    def call(row):
        if row["text"] == "bad":
            raise ValueError("no")
        return row["text"].upper()

    assert [(r.markdown, r.error) for r in external.map_service(df, call).orderBy("id").collect()] == [("OK", None), (None, "ValueError: no")]
    assert [(r.first_page, r.last_page) for r in external.page_ranges(spark.createDataFrame([(1, 250)], "doc_id long, page_count int")).collect()] == [(1, 100), (101, 200), (201, 250)]


def test_feed_source_isolates_failures(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"hits": [{"title": "x"}, {"title": "y"}]}))
    feeds.register(spark)
    rows = spark.read.format("json_feed").option("urls", f"file://{tmp_path}/a.json,file://{tmp_path}/none.json").option("list", "hits").load().collect()
    assert sorted(json.loads(r.item)["title"] for r in rows if r.item) == ["x", "y"] and sum(r.error is not None for r in rows) == 1


def test_a_feed_is_asked_for_the_pushed_days_alone(spark, tmp_path):
    for day in range(1, 6):
        (tmp_path / f"2024-01-0{day}.json").write_text(json.dumps({"hits": [{"d": day}] * day}))
    feeds.register(spark)
    feed = spark.read.format("json_feed").option("urls", f"file://{tmp_path}/{{day}}.json,file://{tmp_path}/whole.json").option("list", "hits").option("first", "2024-01-01").option("last", "2024-01-09").load()
    asked = lambda df: sorted({(r.url or "").rpartition("/")[2] for r in df.collect()})
    assert asked(feed) == sorted([f"2024-01-0{d}.json" for d in range(1, 10)] + ["whole.json"])
    some = feed.filter("day >= '2024-01-02' and day < '2024-01-04'")
    assert asked(some) == ["2024-01-02.json", "2024-01-03.json"] and some.count() == 5
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "BatchScan json_feed" in plan and "2024-01-02" not in plan  # the source has taken the bounds: none is left to filter by
    assert some.rdd.getNumPartitions() == 2
    assert asked(feed.filter("day in ('2024-01-05', '2024-02-01')")) == ["2024-01-05.json"] and feed.filter("day = '2025-01-01'").count() == 0
    assert feeds._address("x?from={start}&to={end}", "2024-01-02") == "x?from=1704153600&to=1704240000"


def test_a_stream_of_feeds_goes_on_from_its_offset(spark, tmp_path):
    for day in range(1, 8):
        (tmp_path / f"2024-01-0{day}.json").write_text(json.dumps([{"d": day}]))
    feeds.register(spark)

    def run(until):
        x = spark.readStream.format("json_feed").option("urls", f"file://{tmp_path}/{{day}}.json").option("first", "2024-01-01").option("until", until).load()
        q = x.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out"))
        q.awaitTermination(120)
        assert q.exception() is None
        return sorted(r.day for r in spark.read.schema("url string, seq int, item string, error string, day string").parquet(str(tmp_path / "out")).collect()), q.lastProgress

    assert run("2024-01-03")[0] == ["2024-01-01", "2024-01-02"]
    (tmp_path / "2024-01-01.json").unlink()  # a day that is done is not asked for again
    days, progress = run("2024-01-06")
    assert days == [f"2024-01-0{d}" for d in range(1, 6)] and '2024-01-06' in str(progress["sources"][0]["endOffset"])
    assert run("2024-01-06")[0] == days


def test_files_in_and_out(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("hello\nthere")
    assert files.text_files(spark, f"{tmp_path}/in").first().text == "hello\nthere"
    assert files.from_files(spark, f"{tmp_path}/in", "*.txt").count() == 1
    with pytest.raises(FileNotFoundError):
        files.from_files(spark, f"{tmp_path}/in", "*.nope")
    files.write_markdown(spark.createDataFrame([("a.md", "# A")], "out_name string, markdown string"), f"file://{tmp_path}/out")
    assert (tmp_path / "out/a.md").read_text() == "# A"


def test_pdf_page_tree_object_streams_and_unicode_maps():
    import zlib

    cmap = b"1 beginbfchar <01> <0041> endbfchar 1 beginbfrange <02> <04> <00620063> endbfrange 1 beginbfrange <05> <06> [<00E9> <D83DDE00>] endbfrange"
    inner = [(7, b"<< /Type /Page /Contents 21 0 R /Resources << /Font << /F1 30 0 R >> >> >>"), (8, b"<< /Type /Page /Contents 20 0 R >>")]
    head = b" ".join(b"%d %d" % (n, sum(len(b) + 1 for _, b in inner[:i])) for i, (n, _) in enumerate(inner)) + b" "
    packed = zlib.compress(head + b" ".join(b for _, b in inner))
    obj = lambda n, body: b"%d 0 obj %s endobj\n" % (n, body)
    stream = lambda body, more=b"": b"<< /Length %d %s>> stream\n%s\nendstream" % (len(body), more, body)
    data = b"%PDF-1.5\n" + obj(1, b"<< /Type /Catalog /Pages 2 0 R >>") + obj(2, b"<< /Type /Pages /Kids [8 0 R 3 0 R] >>") + obj(3, b"<< /Type /Pages /Kids [7 0 R] >>")
    data += obj(5, b"<< /Type /ObjStm /N 2 /First %d /Filter /FlateDecode >> stream\n%s\nendstream" % (len(head), packed)) + obj(20, stream(b"BT /F9 10 Tf 50 700 Td (first) Tj ET")) + obj(21, stream(b"BT /F1 10 Tf 50 700 Td <0102040506> Tj ET")) + obj(30, b"<< /Type /Font /ToUnicode 31 0 R >>") + obj(31, stream(zlib.compress(cmap), b"/Filter /FlateDecode "))
    assert [(p, t) for p, _, t, *_ in pdf.items(data)] == [(1, "first"), (2, "Abcbeé😀")]


def test_pdf_errors_are_values(spark):
    broken = b"%PDF-1.4\n1 0 obj << /Type /Page /Contents 2 0 R >> endobj\n2 0 obj << /Filter /FlateDecode >> stream\nnot deflated\nendstream endobj\n"
    with pytest.raises(pdf.PdfError):
        list(pdf.items(broken))
    files_ = spark.createDataFrame([("a.pdf", bytearray(broken)), ("b.pdf", bytearray(broken.replace(b"/Filter /FlateDecode", b"").replace(b"not deflated", b"BT (fine) Tj ET")))], "path string, content binary")
    got = {r.path: (r.page, r.text, r.error is None) for r in pdf.read_items(files_).collect()}
    assert got == {"a.pdf": (None, None, False), "b.pdf": (1, "fine", True)}


WORKER = "import sys, json, time\nfor line in sys.stdin:\n    r = json.loads(line)\n    if r['text'] == 'die': sys.exit(1)\n    if r['text'] == 'slow': time.sleep(30)\n    print(json.dumps({'id': r['id'], 'ok': r['text'] != 'bad', 'markdown': r['text'].upper(), 'error': 'refused'}), flush=True)\n"


def test_a_line_worker_starts_again(tmp_path):
    import sys

    (tmp_path / "worker.py").write_text(WORKER)
    work = external.LineWorker([sys.executable, str(tmp_path / "worker.py")], timeout=2)
    assert work({"text": "one"}) == "ONE"
    for text, said in (("bad", "refused"), ("die", "ended"), ("slow", "ended")):
        with pytest.raises(RuntimeError, match=said):
            work({"text": text})
    assert work({"text": "two", "content": b"\x00"}) == "TWO"
    work.close()


def test_model_requests_and_answers():
    code = external.prompt_request("fix the bug in this function", "prompt", 100)
    assert code["max_tokens"] == 120 and "software" in code["messages"][0]["content"] and code["temperature"] == 0
    assert "thread" in external.prompt_request("x", "email")["messages"][0]["content"] and external.prompt_request("a poem", "prompt")["messages"][0]["content"] == external.RULES
    assert external.prompt_request("x", "prompt", rules="own")["messages"][0]["content"] == "own" and external.summary_request("t", 10)["max_tokens"] == 64
    ask = external.prompt_optimizer(lambda r: {"content": [{"text": " fine "}], "finish_reason": "stop"})
    assert ask({"text": "x", "kind": None}) == "fine"
    for bad in ({"content": " "}, {"content": "cut", "finish_reason": "length"}):
        with pytest.raises(RuntimeError):
            external.whole_answer(bad)


def test_model_summaries_fail_as_rows(spark):
    rows = spark.createDataFrame([(1, "text", 20), (2, "cut", 20)], "id int, markdown string, target int")
    call = lambda r: {"content": "short", "finish_reason": "length" if r["messages"][1]["content"] == "cut" else "stop"}
    assert [(r.id, r.summary, r.error is None) for r in external.model_summaries(rows, call).orderBy("id").collect()] == [(1, "short", True), (2, None, False)]


# --- table functions ------------------------------------------------------------------------------------------------
def test_table_functions_from_sql(spark):
    from docloom.functions import tables

    tables.register(spark)
    spark.createDataFrame([(1, "a,b\n1,2\n3\n", "x"), (2, None, "y"), (3, "", "z")], "id int, text string, tag string").createOrReplaceTempView("csvs")
    rows = spark.sql("SELECT * FROM csv_table(TABLE(csvs) PARTITION BY id)")
    assert rows.columns == ["id", "tag", "row", "col", "name", "value"]
    cells = [(0, 0, "a", "a"), (0, 1, "b", "b"), (1, 0, "a", "1"), (1, 1, "b", "2"), (2, 0, "a", "3")]
    assert sorted(tuple(r) for r in rows.collect()) == [(1, "x", *c) for c in cells]
    assert sorted(tuple(r) for r in spark.sql("SELECT c.* FROM csvs, LATERAL csv_cells(text) c").collect()) == cells
    with pytest.raises(Exception, match="would stand twice"):
        spark.sql("SELECT * FROM csv_table(TABLE(SELECT id AS row, text FROM csvs))").collect()
    with pytest.raises(Exception, match="a column text"):
        spark.sql("SELECT * FROM csv_table(TABLE(SELECT id FROM csvs))").collect()
    data = pdf_bytes(b"BT /F1 10 Tf 1 0 0 1 50 700 Tm (Hello) Tj ET")
    spark.createDataFrame([("a", bytearray(data)), ("b", bytearray(b"%PDF-1.4 broken")), ("c", None)], "path string, content binary").createOrReplaceTempView("pdfs")
    got = spark.sql("SELECT path, r.page, r.text, r.error IS NULL AS ok FROM pdfs, LATERAL pdf_runs(content) r").collect()
    assert ("a", 1, "Hello", True) in [tuple(r) for r in got] and all(r.path != "c" for r in got)


# --- the file sink -----------------------------------------------------------------------------------------------------
def tree(path):
    return {str(p.relative_to(path)): p.read_text() for p in sorted(path.rglob("*")) if p.is_file()} if path.exists() else None


def sunk(spark, rows, path, mode="append", suffixes="markdown=.md,report=.report.json"):
    from docloom.sources import sink

    sink.register(spark)
    df = spark.createDataFrame(rows, "out_name string, markdown string, report string").repartition(3)
    df.write.format("file_per_row").option("suffixes", suffixes).mode(mode).save(str(path))


def test_files_are_there_all_at_once(spark, tmp_path):
    import json

    out = tmp_path / "out"
    sunk(spark, [("a", "A é", "{}"), ("b/c", "B", None), ("d", None, "{}")], out)
    got = tree(out)
    assert json.loads(got.pop("_manifest.json")) == {"files": 4, "bytes": 9, "tasks": 3}
    assert got == {"a.md": "A é", "a.report.json": "{}", "b/c.md": "B", "d.report.json": "{}"}
    with pytest.raises(Exception, match="FileExistsError"):
        sunk(spark, [("x", "X", None)], out)
    sunk(spark, [("x", "X", None)], out, "overwrite")
    assert sorted(tree(out)) == ["_manifest.json", "x.md"]
    sunk(spark, [], tmp_path / "none")
    assert json.loads((tmp_path / "none/_manifest.json").read_text())["files"] == 0
    assert sorted(p.name for p in tmp_path.iterdir()) == ["none", "out"]


@pytest.mark.parametrize("bad", ["../up", "/top", "a//b", None, "_manifest", "a"])
def test_a_failed_task_leaves_no_file(spark, tmp_path, bad):
    """Names that lead elsewhere, and one name twice in a task, fail the job; nothing of the other rows is left, nor is what stood there changed."""
    sunk(spark, [("old", "O", None)], tmp_path / "out")
    from docloom.sources import sink

    sink.register(spark)
    df = spark.createDataFrame([("a", "A"), (bad, "B")], "out_name string, markdown string").coalesce(1)
    with pytest.raises(Exception, match="ValueError"):
        df.write.format("file_per_row").mode("overwrite").save(str(tmp_path / "out"))
    assert sorted(tree(tmp_path / "out")) == ["_manifest.json", "old.md"] and [p.name for p in tmp_path.iterdir()] == ["out"]

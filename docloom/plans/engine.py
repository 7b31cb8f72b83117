"""The engine's surface: convert, compress, outline, retrieve, optimise, batch and capabilities over DataFrames."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from docloom.functions import constants as C, text as T
from docloom.functions.rows import dealt, per_row
from docloom.functions.scratch import Scratch
from docloom.operators import blocks, clean, compress as squeeze, outline as index, prompts, report, sniff, store
from docloom.sources import delimited, external, html, ooxml, pdf, pdf_layout


_CONVERTERS = {"html": html.to_markdown, "csv": delimited.csv_to_markdown, "json": delimited.json_to_markdown}


def _convert(job: str | None, text: str | None) -> tuple[str | None, str | None]:
    if text is None or job is None:
        return None, None
    try:
        return _CONVERTERS[job](text), None
    except Exception as e:  # noqa: BLE001  a text that can't be converted takes the text path
        return None, f"{type(e).__name__}: {e}"


def _converted(job: Column, text: Column) -> Column:
    """struct(markdown, error) of each text, by its kind."""

    return per_row(lambda j, t: dict(zip(("markdown", "error"), _convert(j, t))), "struct<markdown:string,error:string>", job, text)


_ITEMS = "page int, item_no int, text string, x double, y double, width double, height double"


def _open(job: str | None, content: bytes | None) -> tuple[str | None, str | None, list[dict] | None]:
    """(markdown, error, items) of an office file or a PDF; what can't be opened is an error, not a failed job."""
    if job is None or content is None:
        return None, None, None
    try:
        if job == "pdf":
            names = [c.split()[0] for c in _ITEMS.split(", ")]
            return None, None, [dict(zip(names, r)) for r in pdf.items(bytes(content))]
        return ooxml.to_markdown(bytes(content)), None, None
    except (*ooxml.ERRORS, pdf.PdfError, ValueError, IndexError) as e:
        return None, str(e), None


def _opened(job: Column, content: Column) -> Column:
    """struct(markdown, error, items) of each file, by its kind."""

    made = f"struct<markdown:string,error:string,items:array<struct<{_ITEMS.replace(' ', ':').replace(',:', ',')}>>>"
    return per_row(lambda j, c: dict(zip(("markdown", "error", "items"), _open(j, c))), made, job, content)


@dataclass
class Engine:
    """Services are optional callables; `originals` is the path of the store of original texts."""

    spark: SparkSession
    originals: str | None = None
    ocr: Callable[[dict], str] | None = None
    language_model: Callable[[dict], str] | None = None
    summaries: Callable[[dict], dict] | None = None
    extended: Callable[[dict], str] | None = None
    as_of: datetime | None = None
    services: dict = field(default_factory=dict)

    # --- convert --------------------------------------------------------------------------
    def convert_texts(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", filename_col: str | None = None, budget: int | None = None, structure: bool = True) -> DataFrame:
        """doc_id, kind, engine, markdown, input_tokens, output_tokens, warnings for texts of any kind.

        The input is read once: sniffed, converted (HTML, CSV and JSON in one Python pass by kind, other kinds' texts don't reach
        it), and written; sections and the result are made from what was written.  A text that its converter
        fails on takes the text path, with a warning.
        """
        x = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *([F.col(filename_col).alias("filename")] if filename_col else []))
        x = sniff.sniff(x, "text", filename_col and "filename").withColumn("engine", sniff.route("kind")["engine"])
        # headings and fences mark Markdown, which is not taken for a request
        request = (F.col("kind") == "prompt") & ~F.col("text").rlike(r"(?m)^(?:#{1,6}\s|```)")
        job = F.when(F.col("kind").isin("html", "csv", "json"), F.col("kind"))
        x = x.withColumns({"made": _converted(job, F.when(job.isNotNull(), F.col("text"))), "cleaned": F.when(request, prompts.cleaned_prompt("text"))})
        failed = F.col("made.error").isNotNull()
        shorter = F.when(T.approx_tokens("cleaned") < T.approx_tokens("text"), F.col("cleaned"))
        x = x.withColumns({"engine": F.when(failed, "prompt-optimizer").otherwise(F.col("engine")), "converted": F.coalesce("made.markdown", shorter, "text"), "failed": failed})
        if structure:
            laid = prompts.structure(x.withColumn("request", request), "converted", "laid").drop("structured")
            x = laid.withColumn("converted", F.when(F.col("request"), F.col("laid")).otherwise(F.col("converted"))).drop("laid", "request")
        x = x.withColumns({"row": F.monotonically_increasing_id(), "input_tokens": T.approx_tokens("text").cast("bigint")})
        x = Scratch(self.spark).cut(x.select("row", "doc_id", "kind", "engine", "failed", "converted", "input_tokens"), "converted")
        md = clean.rendered(clean.strip(blocks.sections(dealt(x, "row"), "row", "converted"))).withColumnRenamed("doc_id", "row")
        out = x.drop("converted").join(md, "row", "left")
        out = out.withColumns({"markdown": F.coalesce("markdown", F.lit("")), "output_tokens": F.coalesce("kept_tokens", F.lit(0))})
        grew = F.when((F.col("output_tokens") > F.col("input_tokens")) & F.col("kind").isin("html", "csv", "json"), "grew")
        removed = F.when(clean.content_removed(F.coalesce("removed_tokens", F.lit(0)), F.coalesce("removed_tokens", F.lit(0)) + F.col("output_tokens")), "content-removed")
        text_path = F.when(F.col("kind").isin("prompt", "email") | F.col("failed"), "no-language-model")
        out = out.withColumn("warnings", F.array_compact(F.array(F.when(F.col("failed"), "engine-error"), grew, removed, text_path)))
        out = out.select("row", "doc_id", "kind", "engine", "markdown", "input_tokens", "output_tokens", "warnings")
        if budget is None:
            return out.drop("row")
        short = self.compress(out.select(F.col("row").alias("doc_id"), F.col("markdown").alias("text")), budget)["markdown"].select(F.col("doc_id").alias("row"), F.col("markdown").alias("short"))
        out = out.join(short, "row", "left").drop("row")
        less = (F.col("output_tokens") > budget) & (T.approx_tokens("short") < F.col("output_tokens"))
        return out.withColumns({"markdown": F.when(less, F.col("short")).otherwise(F.col("markdown")), "output_tokens": F.when(less, T.approx_tokens("short").cast("bigint")).otherwise(F.col("output_tokens"))}).drop("short")

    def convert_files(self, files: DataFrame, fidelity: str = "auto", ocr: bool = False) -> DataFrame:
        """path, kind, engine, ok, markdown, error of binary files; errors are values.

        The input is read once: sniffed, its containers opened in one Python pass by kind, and written, without the bytes unless an
        OCR engine will want them.  Pages, texts and results are made from what was written.
        """
        return self._converted_files(files, fidelity, ocr).drop("own")

    def _converted_files(self, files: DataFrame, fidelity: str = "auto", ocr: bool = False) -> DataFrame:
        """The files converted, with their own text where they are text."""
        x = sniff.sniff_bytes(files).withColumn("decision", sniff.route("kind", fidelity, F.lit(ocr), F.col("pdf.looks_scanned"))).withColumn("engine", F.col("decision.engine"))
        native = F.col("engine") == "native"
        job = F.when(F.col("kind").isin("office", "pdf") & native, F.col("kind"))
        wanted = (F.col("engine") == "docling") | (F.col("kind") == "pdf")
        x = x.withColumns({"file": F.monotonically_increasing_id(), "opened": _opened(job, F.when(job.isNotNull(), F.col("content")))})
        x = x.select(
            "file", "path", "kind", "engine", "filename", "text", F.col("opened.markdown").alias("office"), F.col("opened.error").alias("broken"), F.col("opened.items").alias("items"),
            F.col("pdf.page_count").alias("page_count"), F.col("decision.post_checks").alias("post_checks"), *([F.when(wanted, F.col("content")).alias("content")] if self.ocr is not None else []),
        )
        x = Scratch(self.spark).cut(x, "opened")

        textual = F.col("text").isNotNull() & F.col("kind").isin("prompt", "email", "html", "csv", "json")
        texts = self.convert_texts(x.filter(textual).select("file", "text", "filename"), "file", "text", "filename", structure=False)
        texts = texts.select(F.col("doc_id").alias("file"), F.col("kind").alias("text_kind"), F.col("engine").alias("text_engine"), F.col("markdown").alias("text_markdown"))
        runs = x.filter("items is not null").select("file", F.inline("items"))
        pages = pdf_layout.join_pages(pdf_layout.layout(runs, "file"), "file").select("file", F.col("markdown").alias("pages"))

        is_text, is_pdf = F.col("text_kind").isNotNull(), (F.col("kind") == "pdf") & native
        x = x.drop("items").withColumnRenamed("text", "own").join(texts, "file", "left").join(pages, "file", "left")
        x = x.withColumn("markdown", F.when(is_text, F.col("text_markdown")).when(is_pdf, F.coalesce("pages", F.lit(""))).otherwise(F.col("office")))
        x = x.withColumns({
            "ok": F.when(is_pdf, F.col("markdown") != "").otherwise(F.col("markdown").isNotNull()),
            "error": F.when(is_pdf & (F.col("markdown") == ""), F.coalesce("broken", F.lit("no text layer: OCR is needed"))).when(~is_pdf & native & ~is_text, F.col("broken")),
            "slow": (F.col("engine") == "docling") | (is_pdf & F.coalesce(sniff.escalation(F.col("post_checks"), "markdown", F.col("page_count"))["escalate"], F.lit(False))),
            "kind": F.coalesce("text_kind", "kind"), "engine": F.coalesce("text_engine", "engine"),
        })
        # the slow engine's output replaces the fast one's where it has any
        if self.ocr is None:
            x = x.withColumns({"better": F.lit(None).cast("string"), "refused": F.when(F.col("engine") == "docling", "the layout engine is not configured")})
        else:
            ask = external.map_service(x.filter("slow").select("file", "path", "kind", "engine", "content"), self.ocr, "better", "OCR")
            x = x.join(ask.select("file", "better", F.col("error").alias("refused")), "file", "left")
        asked = F.col("engine") == "docling"
        return x.select(
            "path", "kind", F.when(F.col("better").isNotNull(), "docling").otherwise(F.col("engine")).alias("engine"),
            F.when(asked, F.col("refused").isNull()).when(F.col("better").isNotNull(), F.col("better") != "").otherwise(F.col("ok")).alias("ok"),
            F.coalesce("better", "markdown").alias("markdown"), F.when(asked, F.col("refused")).when(F.coalesce(F.col("better") != "", F.lit(False)), F.lit(None)).otherwise(F.col("error")).alias("error"), "own",
        )

    # --- compress, outline, retrieve -----------------------------------------------------------
    def compress(self, docs: DataFrame, budget: int, provider: str = "anthropic", **options) -> dict[str, DataFrame]:
        if self.originals:  # nothing is touched before the original is stored
            store.put(self.spark, self.originals, docs, "text", "compress", self.as_of)
        if self.summaries is not None:
            options.setdefault("model", self.summaries)
        return squeeze.compress(self.spark, docs, budget, provider, self.as_of, **options)

    def outline(self, docs: DataFrame) -> DataFrame:
        if self.originals:
            store.put(self.spark, self.originals, docs, "text", "outline", self.as_of)
        return index.outline(clean.kept(clean.strip(blocks.sections(docs))))

    def retrieve(self, anchors: DataFrame, text_col: str = "text") -> DataFrame:
        """Each anchor in the texts, with the verbatim span of the stored original."""
        found = anchors.select(F.explode(blocks.parse_anchors(text_col)).alias("a")).select("a.*").distinct()
        return store.spans(found, store.load(self.spark, self.originals))

    def optimise(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        x = prompts.strip_filler(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
        x = prompts.structure(x, "cleaned", "cleaned2").withColumn("cleaned", F.col("cleaned2")).drop("cleaned2")
        return external.optimise_prompt(x, self.language_model)

    def batch(self, files: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(results with out_name, the tally)."""
        done = self._converted_files(files)
        markdown = F.coalesce("markdown", F.lit(""))
        done = done.withColumns({"in_tokens": T.approx_tokens(F.coalesce(report.baseline("kind", "own", markdown, from_file=True), F.lit(""))).cast("bigint"), "out_tokens": T.approx_tokens(markdown).cast("bigint")})
        done = report.output_names(done.drop("own"), "path", "path")
        return done, report.batch_tally(done)

    def capabilities(self) -> DataFrame:
        rows = [("native", "ok", ""), ("ocr", "ok" if self.ocr else "missing", "hand over a callable"), ("language-model", "ok" if self.language_model else "optional", "the deterministic path is taken without"), ("extended-formats", "ok" if self.extended else "optional", ""), ("originals", "ok" if self.originals else "optional", "retrieval needs a path")]
        return self.spark.createDataFrame(rows, "name string, status string, note string")


LIMITS = {"chars": C.MAX_CHARS, "bytes": C.MAX_BYTES}

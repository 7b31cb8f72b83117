"""What an input is: probes of texts and bytes, the kind they give, the route the kind takes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from docloom.functions import constants as C, text as T

TAG = r"</?[a-zA-Z][^>]*>"
MAIL_HEADER = r"(?m)^(?:From|To|Cc|Subject|Sent|Date|Reply-To):\s"


def extension(filename: Column | str) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(T.col(filename), F.lit("")), r"[^/\\.][^/\\]*\.([^./\\]+)\z", 1))


def basename(filename: Column | str) -> Column:
    return F.regexp_extract(T.col(filename), r"([^/\\]*)\z", 1)


def probe_text(c: Column | str = "text") -> Column:
    """Lines are cut once and each is looked at once: whether it holds a tag, and how many commas."""
    c = T.col(c)
    filled = F.filter(F.split(c, "\n"), lambda x: x.rlike(T.NOT_WS))
    seen = F.transform(filled, lambda x: F.struct(x.rlike(TAG).alias("tag"), (F.length(x) - F.length(F.replace(x, F.lit(","), F.lit("")))).alias("commas")))

    def probe(rows: Column) -> Column:
        commas = F.transform(rows, lambda x: x["commas"])
        csv = (F.size(rows) >= 2) & F.coalesce((rows[0]["commas"] >= 2) & (F.array_min(commas) == F.array_max(commas)), F.lit(False))
        return F.struct(
            T.utf16_length(c).alias("chars"), (F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit(""))) + 1).alias("lines"),
            F.when(F.size(rows) > 0, F.size(F.filter(rows, lambda x: x["tag"])) / F.size(rows)).otherwise(F.lit(0.0)).alias("markup_ratio"),
            (F.regexp_count(c, F.lit(MAIL_HEADER)) >= 2).alias("looks_like_email"), csv.alias("looks_like_csv"),
        )

    return T.let(seen, probe)


def probe_pdf(content: Column | str = "content") -> Column:
    raw = F.decode(T.col(content), "ISO-8859-1")
    count = lambda p: F.regexp_count(raw, F.lit(p))
    fonts, images = F.greatest(count(r"/Type\s*/Font(?![a-zA-Z])"), count(r"/BaseFont\s*/")), count(r"/Subtype\s*/Image(?![a-zA-Z])")
    return F.struct(
        F.greatest(F.lit(1), count(r"/Type\s*/Page(?![a-zA-Z])")).alias("page_count"), fonts.alias("font_objects"), images.alias("image_objects"),
        count(T.word("Tj") + "|" + T.word("TJ")).alias("text_operators"), ((fonts == 0) & (images > 0)).alias("looks_scanned"),
    )


def is_json(c: Column | str) -> Column:
    """Only what begins as an object or an array is parsed."""
    return F.when(T.col(c).rlike(rf"\A{T.WS}*[\[{{]"), F.try_parse_json(T.js_trim(c)).isNotNull()).otherwise(F.lit(False))


def classify_text(c: Column | str, probe: Column, ext: Column) -> Column:
    c = T.col(c)
    return (
        F.when(ext.isin("html", "htm") | c.rlike(r"(?i)\A\s*(?:<!DOCTYPE|<html)") | (probe["markup_ratio"] > C.MARKUP_RATIO), "html").when((ext == "csv") | probe["looks_like_csv"], "csv")
        .when((ext == "json") | is_json(c), "json").when((ext == "eml") | probe["looks_like_email"], "email").otherwise("prompt")
    )


def mime(kind: Column | str) -> Column:
    return F.create_map(*[F.lit(x) for kv in C.MIME.items() for x in kv])[T.col(kind)]


def sniff(inputs: DataFrame, text_col: str = "text", filename_col: str | None = None) -> DataFrame:
    """inputs with kind, mime, bytes and the text probe."""
    name = T.col(filename_col) if filename_col else F.lit(None).cast("string")
    x = inputs.withColumn("probe", probe_text(F.coalesce(F.col(text_col), F.lit(""))))
    x = x.withColumn("kind", classify_text(F.coalesce(F.col(text_col), F.lit("")), F.col("probe"), extension(name)))
    return x.withColumns({"mime": mime("kind"), "bytes": F.octet_length(F.coalesce(F.col(text_col), F.lit(""))).cast("bigint")})


def sniff_bytes(files: DataFrame, content_col: str = "content", filename_col: str = "path") -> DataFrame:
    """files with kind, mime, bytes, text (where it is text), and the probes of pdf and text files."""
    head, ext = F.hex(F.substring(F.col(content_col), 1, 8)), extension(filename_col)
    x = files.withColumn("text", F.try_validate_utf8(F.col(content_col).cast("string")))
    x = x.withColumn("text", F.when(~F.col("text").rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f]"), F.col("text")))
    x = x.withColumn("probe", F.when(F.col("text").isNotNull(), probe_text("text")))
    binary = (
        F.when(head.startswith("25504446"), "pdf").when(head.startswith("504B") & (ext.isin(*C.OFFICE_EXTENSIONS) | (ext == "")), "office")
        .when(head.startswith("D0CF11E0A1B11AE1") & (ext.isin(*C.OFFICE_EXTENSIONS) | (ext == "")), "office")
        .when(ext.isin(*C.IMAGE_EXTENSIONS) | head.startswith("89504E47") | head.startswith("FFD8"), "image")
    )
    x = x.withColumn("kind", F.coalesce(binary, F.when(F.col("text").isNotNull(), classify_text("text", F.col("probe"), ext)), F.lit("unknown")))
    x = x.withColumn("pdf", F.when(F.col("kind") == "pdf", probe_pdf(content_col)))
    return x.withColumns({"mime": mime("kind"), "bytes": F.length(content_col).cast("bigint"), "filename": basename(filename_col)})


def route(kind: Column | str = "kind", fidelity: Column | str | None = None, ocr: Column | None = None, scanned: Column | None = None) -> Column:
    """engine, ocr, reason and armed post-checks for an input kind."""
    kind = T.col(kind)
    fidelity = F.lit(fidelity or "auto") if not isinstance(fidelity, Column) else fidelity
    ocr = F.coalesce(ocr, F.lit(False)) if ocr is not None else F.lit(False)
    scanned = F.coalesce(scanned, F.lit(False)) if scanned is not None else F.lit(False)

    def to(engine: str, use_ocr, reason: str, checks=()) -> Column:
        use_ocr = use_ocr if isinstance(use_ocr, Column) else F.lit(use_ocr)
        checks = F.array(*[F.lit(c) for c in checks]) if checks else F.array().cast("array<string>")
        return F.struct(F.lit(engine).alias("engine"), use_ocr.alias("ocr"), F.lit(reason).alias("reason"), checks.alias("post_checks"))

    pdf = kind == "pdf"
    return (
        F.when(kind.isin("prompt", "email"), to("prompt-optimizer", False, "plain text takes the text path"))
        .when(kind.isin("csv", "json", "html"), to("native", False, "converted in process"))
        .when((kind == "office") & (fidelity == "high"), to("docling", False, "high fidelity asked for"))
        .when(kind == "office", to("native", False, "office containers carry their structure"))
        .when(kind == "image", to("docling", True, "an image needs OCR"))
        .when(pdf & (fidelity == "fast"), to("native", False, "fast path asked for, escalation off"))
        .when(pdf & (fidelity == "high"), to("docling", ocr, "high fidelity asked for"))
        .when(pdf & ocr, to("docling", True, "OCR asked for"))
        .when(pdf & scanned, to("docling", True, "images without fonts: a scan"))
        .when(pdf, to("native", False, "text layer; the output is checked", ("low-yield", "table-degradation")))
        .otherwise(to("docling", False, "unknown input"))
    )


def low_yield(markdown: Column | str, pages: Column | int = 1) -> Column:
    pages = F.lit(pages) if isinstance(pages, int) else pages
    return F.length(T.collapse(markdown)) / pages < C.MIN_YIELD_CHARS_PER_PAGE


def flattened_row(line: Column) -> Column:
    """A line without pipes that holds three numbers or more among blanks."""
    return ~F.contains(line, F.lit("|")) & (F.regexp_count(line, F.lit(r"(?:^|\s)\(?\d[\d,.]*\)?%?(?=\s|\z)")) >= C.TABLE_ROW_NUMERIC_CLUSTERS)


def flattened_rows(markdown: Column | str) -> Column:
    return F.size(F.filter(F.split(T.col(markdown), r"\r?\n"), flattened_row))


def escalation(checks: Column, markdown: Column | str, pages: Column | int = 1) -> Column:
    """escalate, failed_checks and ocr for a fast-path output."""
    failed = F.array_compact(
        F.array(
            F.when(F.array_contains(checks, "low-yield") & low_yield(markdown, pages), "low-yield"),
            F.when(F.array_contains(checks, "table-degradation") & (flattened_rows(markdown) >= C.TABLE_DEGRADATION_MIN_ROWS), "table-degradation"),
        )
    )
    return F.struct((F.size(failed) > 0).alias("escalate"), failed.alias("failed_checks"), F.array_contains(failed, "low-yield").alias("ocr"))

"""Where inputs come from and results go to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from docloom.operators import sniff


def from_texts(spark: SparkSession, texts: list[tuple[str, str | None]]) -> DataFrame:
    """input_id, text, filename from (text, filename) pairs."""
    return spark.createDataFrame([(f"t{i}", t, n) for i, (t, n) in enumerate(texts)], "input_id string, text string, filename string")


def from_buffers(spark: SparkSession, buffers: list[tuple[bytes, str | None]]) -> DataFrame:
    return spark.createDataFrame([(f"b{i}", bytearray(b), n) for i, (b, n) in enumerate(buffers)], "input_id string, content binary, path string")


def from_files(spark: SparkSession, path: str, glob: str | None = None, recursive: bool = True) -> DataFrame:
    """path, modificationTime, length, content of the files; no match is an error."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    df = (r.option("pathGlobFilter", glob) if glob else r).load(path)
    if df.select("path").limit(1).count() == 0:
        raise FileNotFoundError(f"no file matches {path}{' with ' + glob if glob else ''}")
    return df


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """path, text: one row per file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def corpus(spark: SparkSession, root: str) -> DataFrame:
    """Cases of a fixture tree: case, meta (the case.json as text) and the input's path and content."""
    every = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).withColumn("case", F.regexp_extract("path", r"([^/]+)/[^/]+\z", 1)).withColumn("name", sniff.basename("path"))
    meta = every.filter("name = 'case.json'").select("case", F.col("content").cast("string").alias("meta"))
    return every.filter("name like 'input.%'").select("case", "path", "content").join(meta, "case")


def write_markdown(results: DataFrame, root: str, name_col: str = "out_name", text_col: str = "markdown") -> None:
    """A file per row under root, on any file system that pyarrow opens; root is a URI.

    Files are written whole under a name of the attempt's own and moved into place, so a repeated task does no harm.
    """

    def put(rows):
        import uuid

        from pyarrow.fs import FileSystem

        fs, top = FileSystem.from_uri(root)
        fs.create_dir(top, recursive=True)
        for r in rows:
            temp = f"{top}/.{uuid.uuid4().hex}"
            with fs.open_output_stream(temp) as f:
                f.write((r[text_col] or "").encode())
            fs.move(temp, f"{top}/{r[name_col]}")

    results.select(name_col, text_col).foreachPartition(put)


def write_reports(reports: DataFrame, path: str, form: str = "json") -> None:
    reports.write.mode("overwrite").format(form).save(path)


def missing_days(days: DataFrame, cache: DataFrame) -> DataFrame:
    """Days that a digest cache partitioned by day has not."""
    return days.join(cache.select("day").distinct(), "day", "left_anti")

"""Table functions for SQL: cells of delimited texts, text runs of PDFs.

    SELECT d.id, c.* FROM docs d, LATERAL csv_cells(d.text) c
    SELECT * FROM csv_table(TABLE(docs) PARTITION BY id)          -- the columns of docs without text, then row, col, name, value
    SELECT f.path, r.* FROM files f, LATERAL pdf_runs(f.content) r

A null or empty text has no cells; a PDF that can't be opened is one row with its error.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession, types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from docloom.sources import delimited, pdf

_CELL = T.StructType().add("row", T.IntegerType()).add("col", T.IntegerType()).add("name", T.StringType()).add("value", T.StringType())


def _cells(text: str | None) -> Iterator[tuple[int, int, str | None, str]]:
    """row (0 is the header), col, the column's name and the value."""
    rows = delimited.csv_rows(text or "")
    for i, row in enumerate(rows):
        for k, value in enumerate(row):
            yield i, k, rows[0][k] if k < len(rows[0]) else None, value


@udtf(returnType="row int, col int, name string, value string")
class CsvCells:
    def eval(self, text: str) -> Iterator[tuple]:
        yield from _cells(text)


@udtf
class CsvTable:
    """Takes any table with a column `text` and carries its other columns."""

    @staticmethod
    def analyze(table: AnalyzeArgument) -> AnalyzeResult:
        if not table.isTable or "text" not in table.dataType.names:
            raise ValueError("csv_table takes a table with a column text")
        kept = [f for f in table.dataType.fields if f.name != "text"]
        if clash := {f.name for f in kept} & set(_CELL.names):
            raise ValueError(f"columns named {', '.join(sorted(clash))} would stand twice")
        return AnalyzeResult(schema=T.StructType([*kept, *_CELL.fields]))

    def eval(self, row: Row) -> Iterator[tuple]:
        carried = tuple(v for k, v in row.asDict(recursive=False).items() if k != "text")
        for cell in _cells(row["text"]):
            yield *carried, *cell


@udtf(returnType="page int, item_no int, text string, x double, y double, width double, height double, error string")
class PdfRuns:
    def eval(self, content: bytes) -> Iterator[tuple]:
        if content is None:
            return
        try:
            for run in pdf.items(bytes(content)):
                yield *run, None
        except (pdf.PdfError, ValueError, IndexError) as e:
            yield None, None, None, None, None, None, None, str(e)


def register(spark: SparkSession) -> None:
    """Names them in the session."""
    for name, function in (("csv_cells", CsvCells), ("csv_table", CsvTable), ("pdf_runs", PdfRuns)):
        spark.udtf.register(name, function)

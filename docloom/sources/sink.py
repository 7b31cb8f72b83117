"""A Python data source that writes a file per value, all of a job's or none.

    results.write.format("file_per_row").option("name", "out_name").option("suffixes", "markdown=.md,report=.report.json").save(root)

Each row gives a file per listed column that isn't null, named by the row's name and the column's suffix; a name may hold folders.  Tasks write
below a folder beside the target that readers don't see.  When all have ended, what they wrote is counted into a manifest, `_manifest.json`, and the folder is
moved to the target in one step; a job that fails leaves nothing.  Attempts of one task write the same names, the last one
stays whole.  The target must not exist, or is replaced in mode overwrite.  Names that lead out of the target, null names and two
rows of one name are errors.  Paths are URIs of any file system that pyarrow opens, whose folders move in one step.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage


@dataclass
class Written(WriterCommitMessage):
    files: int
    size: int


class FilePerRow(DataSource):
    @classmethod
    def name(cls) -> str:
        return "file_per_row"

    def schema(self) -> str:
        raise NotImplementedError("files are read by binaryFile, text or their manifest")

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options, schema, overwrite)


def _fs(uri: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def file_name(name: str | None, suffix: str) -> str:
    """The name below the target; an error for one that leads elsewhere."""
    parts = (name or "").split("/")
    if not name or name.startswith("_") or any(p in ("", ".", "..") or "\\" in p or "\0" in p for p in parts):
        raise ValueError(f"{name!r} is no name of a file below the target")
    return f"{name}{suffix}"


class _Writer(DataSourceWriter):
    def __init__(self, options, schema, overwrite: bool):
        self.root, self.overwrite = options["path"].rstrip("/"), overwrite
        self.name = options.get("name", "out_name")
        self.suffixes = [tuple(x.split("=", 1)) for x in options.get("suffixes", "markdown=.md").split(",")]
        absent = {self.name, *(c for c, _ in self.suffixes)} - set(schema.names)
        if absent:
            raise ValueError(f"no column {', '.join(sorted(absent))}")
        head, _, last = self.root.rpartition("/")
        self.pending = f"{head}/.{last}-{uuid.uuid4().hex}"
        fs, top = _fs(self.root)
        if not overwrite and fs.get_file_info(top).type.name != "NotFound":
            raise FileExistsError(self.root)

    def write(self, iterator: Iterator) -> Written:
        fs, top = _fs(self.pending)
        files = size = 0
        made, folders = set(), set()
        for row in iterator:
            for column, suffix in self.suffixes:
                if row[column] is None:
                    continue
                name = file_name(row[self.name], suffix)
                if name in made:
                    raise ValueError(f"two rows are named {name}")
                made.add(name)
                folder = f"{top}/{name}".rpartition("/")[0]
                if folder not in folders:
                    fs.create_dir(folder, recursive=True)
                    folders.add(folder)
                data = row[column].encode() if isinstance(row[column], str) else bytes(row[column])
                part = f"{top}/{name.rpartition('/')[0]}/.{uuid.uuid4().hex}"
                with fs.open_output_stream(part) as f:
                    f.write(data)
                fs.move(part, f"{top}/{name}")  # whole or not at all
                files, size = files + 1, size + len(data)
        return Written(files, size)

    def commit(self, messages: list[Written | None]) -> None:
        fs, top = _fs(self.pending)
        _, target = _fs(self.root)
        fs.create_dir(top, recursive=True)
        done = [m for m in messages if m is not None]
        with fs.open_output_stream(f"{top}/_manifest.json") as f:
            f.write(json.dumps({"files": sum(m.files for m in done), "bytes": sum(m.size for m in done), "tasks": len(done)}).encode())
        old = f"{top}-old"
        if self.overwrite and fs.get_file_info(target).type.name != "NotFound":
            fs.move(target, old)
        fs.move(top, target)
        if fs.get_file_info(old).type.name != "NotFound":
            fs.delete_dir(old)

    def abort(self, messages: list[Written | None]) -> None:
        fs, top = _fs(self.pending)
        if fs.get_file_info(top).type.name != "NotFound":
            fs.delete_dir(top)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FilePerRow)

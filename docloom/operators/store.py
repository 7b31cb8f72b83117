"""Content-addressed originals: insert if absent, read back by id or by anchor.

The store is a table partitioned by the first two digits of the id and by epoch.  Within a prefix, epochs are put there one after
another: a writer reads which ids a prefix has, writes those it lacks beside the table, and moves them into place as the prefix's next epoch.  Moving
fails if another writer has made that epoch; the writer then compares with it and tries the one after, for that prefix alone.  So
each id is there once, and reading needs no deduplication.  The file system must move directories atomically (HDFS and local ones do).

Rows are sorted by id within a prefix, so that Parquet's statistics leave few pages for an id.  Looking up ids prunes prefixes, joins with
anchors do so dynamically.
"""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, functions as F

from docloom.functions import text as T

SOURCE_ID = r"\A[0-9a-f]{16}\z"
PREFIX = 2
_SCHEMA = "source_id string, text string, label string, created_at timestamp, prefix string, epoch int"


def originals(docs: DataFrame, text_col: str = "text", label: str | None = None, as_of: datetime | None = None) -> DataFrame:
    """source_id, text, label, created_at: a row per distinct text."""
    x = docs.filter(F.col(text_col).isNotNull()).select(T.source_id(text_col).alias("source_id"), F.col(text_col).alias("text"))
    x = x.groupBy("source_id").agg(F.first("text").alias("text"))
    return x.select("source_id", "text", F.lit(label).cast("string").alias("label"), F.lit(as_of).cast("timestamp").alias("created_at"))


def absent(new: DataFrame, existing: DataFrame) -> DataFrame:
    return new.join(existing.select("source_id"), "source_id", "left_anti")


def put(spark: SparkSession, path: str, docs: DataFrame, text_col: str = "text", label: str | None = None, as_of: datetime | None = None, tries: int = 100) -> None:
    """Adds the originals that the store at path has not, whoever else is writing."""
    pending = f"{path.rstrip('/')}/_pending/{uuid.uuid4().hex}"
    try:
        originals(docs, text_col, label, as_of).write.parquet(f"{pending}/new")
        new = spark.read.parquet(f"{pending}/new").withColumn("prefix", F.left("source_id", F.lit(PREFIX)))
        left = sorted(r.prefix for r in new.select("prefix").distinct().collect())  # 256 at most
        for n in range(tries):
            epochs = _epochs(spark, path)  # before the ids are read: what comes later makes the move fail
            lacking = absent(new.filter(F.col("prefix").isin(left)), load(spark, path).filter(F.col("prefix").isin(left)))
            lacking = lacking.hint("rebalance", "prefix").sortWithinPartitions("prefix", "source_id")
            lacking.write.partitionBy("prefix").parquet(f"{pending}/{n}")
            made = _children(spark, f"{pending}/{n}", "prefix=")
            move = lambda p, n=n, epochs=epochs: _publish(spark, f"{pending}/{n}/prefix={p}", f"{path}/prefix={p}/epoch={epochs.get(p, -1) + 1}")
            with ThreadPoolExecutor(8) as pool:
                left = [p for p, moved in zip(made, pool.map(move, made), strict=True) if not moved]
            if not left:
                return
        raise RuntimeError(f"{len(left)} prefixes of {path} were never free")
    finally:
        _fs(spark, path)[0].delete(_fs(spark, pending)[1], True)


def load(spark: SparkSession, path: str) -> DataFrame:
    """The originals, each once."""
    if not _children(spark, path, "prefix="):
        return spark.createDataFrame([], _SCHEMA)
    return spark.read.schema(_SCHEMA).parquet(path)


def get(spark: SparkSession, path: str, ids: list[str]) -> DataFrame:
    """The originals with these ids; what is no id finds nothing.  Only the prefixes of these ids are read."""
    return load(spark, path).filter(F.col("prefix").isin(sorted({str(i)[:PREFIX] for i in ids})) & F.col("source_id").rlike(SOURCE_ID) & F.col("source_id").isin(ids))


def spans(anchors: DataFrame, stored: DataFrame) -> DataFrame:
    """anchors(source_id, start, end) with the verbatim text of each, null where the span or the id is none.

    Originals are met first by those anchors whose id is one, so that the anchors prune the prefixes that are read.
    """
    valid = (F.col("start") >= 0) & (F.col("end") >= F.col("start"))
    wanted = anchors.select("source_id", "start", "end").filter(F.col("source_id").rlike(SOURCE_ID) & valid).distinct()
    keys = ["source_id"]
    if "prefix" in stored.columns:
        wanted, keys = wanted.withColumn("prefix", F.left("source_id", F.lit(PREFIX))), ["prefix", "source_id"]
    found = stored.select("text", *keys).join(wanted, keys).select("source_id", "start", "end", T.utf16_span("text", "start", "end").alias("span"))
    return anchors.join(found, ["source_id", "start", "end"], "left").select(*anchors.columns, "span")


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _children(spark: SparkSession, path: str, start: str) -> list[str]:
    """What follows `start` in the names of the folders under path."""
    fs, p = _fs(spark, path)
    names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(n[len(start) :] for n in names if n.startswith(start))


def _epochs(spark: SparkSession, path: str) -> dict[str, int]:
    """The last epoch of each prefix that has one."""
    fs, p = _fs(spark, f"{path}/prefix=*/epoch=*")
    out: dict[str, int] = {}
    for s in fs.globStatus(p) or []:
        prefix, epoch = s.getPath().getParent().getName()[len("prefix=") :], int(s.getPath().getName()[len("epoch=") :])
        out[prefix] = max(epoch, out.get(prefix, -1))
    return out


def _publish(spark: SparkSession, made: str, place: str) -> bool:
    """Moves a folder to its place, at once and only if nothing is there."""
    jvm = spark._jvm
    fs, target = _fs(spark, place)
    source = _fs(spark, made)[1]
    fs.mkdirs(target.getParent())
    try:
        if fs.getScheme() == "file":  # there Hadoop's rename first looks, then moves
            how = spark.sparkContext._gateway.new_array(jvm.java.nio.file.CopyOption, 1)
            how[0] = jvm.java.nio.file.StandardCopyOption.ATOMIC_MOVE
            jvm.java.nio.file.Files.move(jvm.java.io.File(source.toUri().getPath()).toPath(), jvm.java.io.File(target.toUri().getPath()).toPath(), how)
        else:
            how = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
            how[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration()).rename(source, target, how)
    except Py4JJavaError:
        if fs.exists(target):
            return False
        raise
    return True

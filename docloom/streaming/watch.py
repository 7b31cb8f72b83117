"""Streams: watched folders, originals once each, daily and per-caller windows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from docloom.functions import text as T

FILES = "path string, modificationTime timestamp, length long, content binary"


def watch(spark: SparkSession, path: str, glob: str | None = None, max_files: int = 1000) -> DataFrame:
    """A stream of the files that appear under path."""
    r = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", max_files)
    return (r.option("pathGlobFilter", glob) if glob else r).load(path)


@contextmanager
def small_files(spark: SparkSession) -> Iterator[None]:
    """Within it, Spark lists a batch's files in as many tasks as there are cores, not in a task each, and reads hundreds of small ones in a task."""
    own = {"spark.sql.sources.parallelPartitionDiscovery.parallelism": str(spark.sparkContext.defaultParallelism), "spark.sql.files.openCostInBytes": "64k"}
    before = {k: spark.conf.get(k) for k in own}
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def latest(batch: DataFrame) -> DataFrame:
    """The last state of each path in a micro-batch: what a debounce lets through."""
    by = Window.partitionBy("path").orderBy(F.desc("modificationTime"))
    return batch.withColumn("__n", F.row_number().over(by)).filter("__n = 1").drop("__n")


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Debounce(StatefulProcessor):
    """Passes a path on when nothing was heard of it for a while, with its latest state.

    Each event moves the path's timer; what is kept of it is its latest time and length.  A path that is passed on is
    forgotten, and so is one whose timer was lost, `ttl_ms` after its last event.
    """

    def __init__(self, quiet_ms: int, ttl_ms: int):
        self.quiet_ms, self.ttl_ms = quiet_ms, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "modificationTime timestamp, length long, events long", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        best = self.last.get() if self.last.exists() else None
        count = best[2] if best else 0
        for part in rows:
            count += len(part)
            x = part.sort_values(["modificationTime", "length"]).iloc[-1]
            if best is None or (x["modificationTime"], x["length"]) >= (pd.Timestamp(best[0]), best[1]):
                best = (x["modificationTime"].to_pydatetime(), int(x["length"]), count)
        self.last.update((best[0], best[1], count))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.quiet_ms)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.last.exists():
            at, length, count = self.last.get()
            self.last.clear()
            yield pd.DataFrame({"path": [key[0]], "modificationTime": [pd.Timestamp(at)], "length": [length], "events": [count]})
        else:
            yield pd.DataFrame()

    def close(self) -> None:
        pass


def debounced(events: DataFrame, quiet_ms: int = 200, ttl_ms: int = 3_600_000) -> DataFrame:
    """From a stream of (path, modificationTime, length) those paths that were quiet for quiet_ms, across micro-batches: path, modificationTime, length, events.

    Events without path or time are left out.  The state needs RocksDB: set spark.sql.streaming.stateStore.providerClass to ROCKSDB; the
    query needs a trigger that goes on (processingTime), since a path is passed on in a later batch than its last event.
    """
    x = events.filter("path is not null and modificationTime is not null").select("path", "modificationTime", F.coalesce(F.col("length").cast("long"), F.lit(0).cast("long")).alias("length"))
    return x.groupBy("path").transformWithStateInPandas(Debounce(quiet_ms, ttl_ms), "path string, modificationTime timestamp, length long, events long", "Append", "ProcessingTime")


def convert_stream(files: DataFrame, convert: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, interval: str | None = None):
    """Runs convert on each micro-batch's latest files and appends to out; a repeated batch overwrites its own part.

    A batch's files are dealt over all cores: by their size alone, small ones would be a task or two.
    """

    def batch(df: DataFrame, epoch: int) -> None:
        dealt = df.repartition(df.sparkSession.sparkContext.defaultParallelism, "path")
        convert(latest(dealt)).write.mode("overwrite").parquet(f"{out}/batch={epoch}")

    w = files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (w.trigger(processingTime=interval) if interval else w.trigger(availableNow=True)).start()


def originals_once(stream: DataFrame, text_col: str = "text", ts: str = "ts", within: str = "1 day") -> DataFrame:
    """Each text once within a watermark."""
    return stream.withColumn("source_id", T.source_id(text_col)).withWatermark(ts, within).dropDuplicatesWithinWatermark(["source_id"])


def daily_counts(stream: DataFrame, ts: str = "ts", late: str = "1 day", value: str = "value") -> DataFrame:
    """Items and points per UTC day, late ones taken until the watermark."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, "1 day").alias("day")).agg(F.count("*").alias("n"), F.sum(value).alias("points"))

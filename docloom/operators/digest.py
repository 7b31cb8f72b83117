"""Daily digests: feeds into a ranked brief per UTC day; and the guards in front of a service."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from docloom.functions import constants as C, text as T


def day_window(ts: Column | str) -> Column:
    """The half-open UTC day: date, start and end, in epoch seconds and as ISO text."""
    start = F.date_trunc("day", T.col(ts))
    iso = lambda t: F.concat(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))
    end = start + F.expr("interval 1 day")
    return F.struct(F.date_format(start, "yyyy-MM-dd").alias("date"), F.unix_seconds(start).alias("start_epoch"), F.unix_seconds(end).alias("end_epoch"), iso(start).alias("start_iso"), iso(end).alias("end_iso"))


def top_stories(items: DataFrame, n: int = 10, ts: str = "ts", points: str = "points", title: str = "title", key: str = "id") -> DataFrame:
    """The n titled items with most points of each UTC day, ranked."""
    x = items.filter(F.col(title).isNotNull() & (F.col(title) != "")).withColumn("day", F.date_format(ts, "yyyy-MM-dd"))
    by = Window.partitionBy("day").orderBy(F.desc(points), key)
    return x.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= n)


def strip_html(c: Column | str) -> Column:
    return T.collapse(F.regexp_replace(T.col(c), "<[^>]*>", " "))


def clip(c: Column | str, limit: int) -> Column:
    """The text, cut to `limit` UTF-16 units and an ellipsis where it is longer; half a character is left out."""
    cut = lambda x: F.concat(F.regexp_replace(F.regexp_replace(T.utf16_span(x, F.lit(0), F.lit(limit)), "\\x{FFFD}\\z", ""), rf"{T.WS}+\z", ""), F.lit("…"))
    return T.let(T.col(c), lambda x: F.when(T.utf16_length(x) <= limit, x).otherwise(cut(x)))


def articles(items: DataFrame, n: int = 5, summary_chars: int = 180) -> DataFrame:
    """The first n items of a feed (by seq) that have title and url, summaries clipped."""
    x = items.filter("title is not null and url is not null and title <> '' and url <> ''")
    x = x.withColumn("rank", F.row_number().over(Window.partitionBy("day").orderBy("seq"))).filter(F.col("rank") <= n)
    return x.withColumn("summary", clip(strip_html(F.coalesce("summary", F.lit(""))), summary_chars))


def featured(feed: DataFrame, n: int = 5, extract_chars: int = 420) -> DataFrame:
    """day, featured_title, featured_extract, news (first n stories) from rows of (day, tfa struct, news array)."""
    return feed.select(
        "day", F.col("tfa.title").alias("featured_title"), clip(strip_html(F.coalesce("tfa.extract", F.lit(""))), extract_chars).alias("featured_extract"),
        F.transform(F.slice(F.coalesce("news", F.array()), 1, n), lambda x: strip_html(x["story"])).alias("news"),
    )


def brief(parts: DataFrame) -> DataFrame:
    """A digest per day from rows of (day, ord, heading, body, source, raw_tokens, ok).

    Sources that failed are named and left out; a day on which all failed has markdown null.
    """
    line = F.when(F.col("ok"), F.concat(F.lit("## "), "heading", F.lit("\n\n"), "body", F.lit("\n\nSource: "), "source"))
    g = parts.groupBy("day").agg(
        F.array_sort(F.collect_list(F.struct("ord", line.alias("text")))).alias("p"), F.array_sort(F.collect_set(F.when(~F.col("ok"), F.col("source")))).alias("failed_sources"),
        F.sum(F.when(F.col("ok"), F.col("raw_tokens")).otherwise(0)).cast("bigint").alias("raw_tokens"), F.count_if("ok").alias("n_ok"),
    )
    body = F.array_join(F.array_compact(F.transform("p", lambda x: x["text"])), "\n\n")
    g = g.withColumn("markdown", F.when(F.col("n_ok") > 0, F.concat(F.lit("# Digest "), "day", F.lit("\n\n"), body)))
    return g.drop("p").withColumn("digest_tokens", T.approx_tokens("markdown").cast("bigint"))


def archive_index(digests: DataFrame, today: str) -> DataFrame:
    """Valid past days, latest first."""
    ok = digests.withColumn("d", F.try_to_date("day", "yyyy-MM-dd")).filter(F.col("d").isNotNull() & (F.col("d") <= F.to_date(F.lit(today))))
    return ok.drop("d").orderBy(F.desc("day"))


# --- the archive: a partition per UTC day ---------------------------------------------------------
_PAGE = "markdown string, n_items long, tokens long, backfilled boolean, day string"
_NOTE = "\n\n> Backfilled after the fact: the items timestamped inside that UTC day, not the page as it appeared."


def archive(spark: SparkSession, path: str) -> DataFrame:
    """The archived pages, one per day; none where nothing is archived yet."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], _PAGE)
    return spark.read.schema(_PAGE).parquet(path)


def pages(items: DataFrame, backfilled: bool, n: int = 10, ts: str = "ts", points: str = "points", title: str = "title", key: str = "id") -> DataFrame:
    """A page for each UTC day that items fall into: its best stories, and whether it was made after the fact."""
    best = top_stories(items.filter(F.col(ts).isNotNull()), n, ts, points, title, key)
    line = F.concat(F.col("rank").cast("string"), F.lit(". "), F.col(title), F.lit(" ("), F.col(key).cast("string"), F.lit(")"))
    g = best.groupBy("day").agg(F.count("*").alias("n_items"), F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("lines"))
    heading = "Top stories of the day" if backfilled else "Front page"
    md = F.concat(F.lit("# Digest "), "day", F.lit(f"\n\n## {heading}\n\n"), F.array_join(F.transform("lines", lambda x: x["line"]), "\n"), F.lit(_NOTE if backfilled else ""))
    g = g.withColumn("markdown", md)
    return g.select("markdown", "n_items", T.approx_tokens("markdown").cast("bigint").alias("tokens"), F.lit(backfilled).alias("backfilled"), "day")


def publish(made: DataFrame, path: str) -> None:
    """Puts pages into the archive; a day that is there already is replaced, other days aren't touched."""
    made.repartition("day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def calendar(spark: SparkSession, first: str, last: str, today: str) -> DataFrame:
    """The days from first to last; a day that isn't one, or lies ahead of today, is an error."""
    a, b, now = (date.fromisoformat(x) for x in (first, last, today))
    if a > b or b > now:
        raise ValueError(f"{first} to {last} is no range of days up to {today}")
    return spark.sql(f"SELECT date_format(d, 'yyyy-MM-dd') AS day FROM (SELECT explode(sequence(DATE'{a}', DATE'{b}')) AS d)")


def _on(items: DataFrame, days: DataFrame, how: str, ts: str) -> DataFrame:
    """The items that fall on those days, or on none of them."""
    return items.withColumn("__day", F.date_format(ts, "yyyy-MM-dd")).join(days.select(F.col("day").alias("__day")), "__day", how).drop("__day")


def take(spark: SparkSession, items: DataFrame, path: str, late_path: str, **columns) -> None:
    """A day's run: items of days without a page make one; those of archived days are late and go to a table beside."""
    known = archive(spark, path).select("day")
    late = _on(items, known, "left_semi", columns.get("ts", "ts"))
    fresh = pages(_on(items, known, "left_anti", columns.get("ts", "ts")), False, **columns)
    late.write.mode("append").parquet(late_path)
    publish(fresh, path)


def backfill(spark: SparkSession, items: DataFrame, path: str, first: str, last: str, today: str, late: DataFrame | None = None, **columns) -> DataFrame:
    """Makes the pages of the days from first to last that have none, and those again that late items fall on, marked as backfilled.

    Gives the days.  Only their partitions are written; a second run finds none without a page, and makes the same pages of
    the days with late items.  A day without items stays without a page.
    """
    ts, spine = columns.get("ts", "ts"), calendar(spark, first, last, today)
    days = spine.join(archive(spark, path).select("day"), "day", "left_anti")
    if late is not None:
        on = late.select(F.date_format(ts, "yyyy-MM-dd").alias("day")).distinct().join(spine, "day", "left_semi")
        days = days.unionByName(on).distinct()
        items = items.unionByName(late.select(*items.columns)).dropDuplicates()
    # a few days are a small side; items of other days are passed over in the scan where it is partitioned by day
    days = spark.createDataFrame(days.collect(), "day string")  # one row per day of the range
    made = pages(_on(items, days, "left_semi", ts), True, **columns)
    publish(made, path)
    return days


def sanitise(c: Column | str) -> Column:
    """Messages without paths and addresses, 400 characters at most."""
    x = F.regexp_replace(T.col(c), r"[A-Za-z]:\\[^\s'\"]+", "[path]")
    x = F.regexp_replace(x, r"(?<![A-Za-z0-9_.:/])/(?:[A-Za-z0-9_.\-]+/)+[A-Za-z0-9_.\-]*", "[path]")
    x = F.regexp_replace(x, r"\b\d{1,3}(?:\.\d{1,3}){3}(?::\d+)?\b", "[host]")
    return F.left(x, F.lit(400))


def rejects(inputs: DataFrame, text_col: str = "text") -> DataFrame:
    """inputs with reject: `empty`, `too-many-chars`, `too-many-bytes` or null."""
    t = F.col(text_col)
    return inputs.withColumn("reject", F.when(t.isNull() | (T.js_trim(t) == ""), "empty").when(T.utf16_length(t) > C.MAX_CHARS, "too-many-chars").when(F.octet_length(t) > C.MAX_BYTES, "too-many-bytes"))


def rate_windows(calls: DataFrame, caller: str, ts: str = "ts", limit: int = 10, window: str = C.RATE_WINDOW, max_callers: int = C.RATE_CALLERS) -> DataFrame:
    """Calls per caller and fixed window, and how many went over the limit; unknown callers share one entry,
    and so do, as `overflow`, those that come first after max_callers others in the window."""
    x = calls.groupBy(F.coalesce(F.col(caller).cast("string"), F.lit("unknown")).alias("caller"), F.window(ts, window).alias("w")).agg(F.count("*").alias("calls"), F.min(ts).alias("begun"))
    # a window may hold any number of callers: the first of each part, then the last of the first of all
    part = x.withColumn("part", F.pmod(F.xxhash64("caller"), F.lit(64)))
    first = part.withColumn("n", F.row_number().over(Window.partitionBy("w", "part").orderBy("begun", "caller"))).filter(F.col("n") <= max_callers)
    last = first.withColumn("n", F.row_number().over(Window.partitionBy("w").orderBy("begun", "caller"))).filter(F.col("n") == max_callers)
    x = x.join(last.select("w", F.struct("begun", "caller").alias("last")), "w", "left")
    late = F.coalesce(F.struct("begun", "caller") > F.col("last"), F.lit(False))
    x = x.withColumn("caller", F.when(late, "overflow").otherwise(F.col("caller"))).groupBy("caller", "w").agg(F.sum("calls").cast("bigint").alias("calls"))
    return x.select("caller", F.col("w.start").alias("window_start"), "calls", F.greatest(F.lit(0), F.col("calls") - limit).cast("bigint").alias("over"))

"""Queries over the library's edges: files written and read back, feeds, fixture trees, streams, warnings and prompts."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions import tables, text as T
from docloom.functions.scratch import shared_dir
from docloom.operators import sniff
from docloom.plans.catalogue import _PROMPT, ORACLES, part_prompts, query, table
from docloom.plans.conversions import GROUP, NL, _G, _s, each, groups, joined
from docloom.plans.engine import Engine
from docloom.sources import feeds, files, sink
from docloom.streaming import watch


# --- files ------------------------------------------------------------------------------------------
def _notes(spark, d):
    return groups(spark, d).select("k", F.concat(F.when(F.col("k") % 3 == 0, "deep/er/").otherwise(""), F.lit("n"), _s("k")).alias("out_name"), joined(["# Parts ", _s("k"), "\n\n", each(lambda r: F.concat(F.lit("- "), r["name"], F.lit("\n")))]).alias("markdown"), F.when(F.col("k") % 2 == 0, F.to_json(F.struct("k", "n"))).alias("report"))


@query(f"""WITH {_G}, n AS (SELECT k, CASE WHEN k % 3 = 0 THEN 'deep/er/' ELSE '' END || 'n' || k AS name, '# Parts ' || k || '{NL * 2}' || string_agg('- ' || name || chr(10), '' ORDER BY key) AS markdown, CASE WHEN k % 2 = 0 THEN '{{"k":' || k || ',"n":' || count(*) || '}}' END AS report FROM g GROUP BY k)
SELECT name || '.md' AS file, markdown AS text, CAST(strlen(markdown) AS BIGINT) AS length FROM n UNION ALL SELECT name || '.report.json', report, CAST(strlen(report) AS BIGINT) FROM n WHERE report IS NOT NULL""")
def files_written(spark, d):
    """A note and, for some, a report per group, by one write; read back by pattern, also from folders below."""
    root = shared_dir(spark)
    sink.register(spark)
    _notes(spark, d).write.format("file_per_row").option("suffixes", "markdown=.md,report=.report.json").mode("append").save(root)
    name = F.regexp_replace("path", r"\A.*/docloom-[0-9a-f]+/", "")
    both = files.from_files(spark, root, "*.md").unionByName(files.from_files(spark, root, "*.report.json"))
    return both.select(name.alias("file"), F.col("content").cast("string").alias("text"), "length")


@query(f"""WITH {_G} SELECT 'c' || k AS case_, 'input.csv' AS input, '{{"expect":' || count(*) || '}}' AS meta, 'key,name{NL}' || string_agg(key || ',' || name, chr(10) ORDER BY key) AS text FROM g GROUP BY k""")
def fixture_tree(spark, d):
    """A folder per case, with its case.json and its input."""
    root = shared_dir(spark)
    sink.register(spark)
    rows = F.concat(F.lit("key,name\n"), F.array_join(F.transform("r", lambda r: F.concat(_s(r["key"]), F.lit(","), r["name"])), "\n"))
    x = groups(spark, d).select(F.concat(F.lit("c"), _s("k"), F.lit("/input")).alias("input"), rows.alias("csv"), F.concat(F.lit("c"), _s("k"), F.lit("/case")).alias("case"), F.to_json(F.struct(F.col("n").alias("expect"))).alias("json"))
    every = x.select(F.explode(F.array(F.struct(F.col("input").alias("out_name"), "csv", F.lit(None).cast("string").alias("json")), F.struct(F.col("case").alias("out_name"), F.lit(None).cast("string").alias("csv"), "json"))).alias("f")).select("f.*")
    every.write.format("file_per_row").option("suffixes", "csv=.csv,json=.json").mode("append").save(root)
    return files.corpus(spark, root).select(F.col("case").alias("case_"), sniff.basename("path").alias("input"), "meta", F.col("content").cast("string").alias("text"))


# --- table functions -----------------------------------------------------------------------------------
@query(f"""WITH {_G}, c AS (SELECT k, key, row_number() OVER (PARTITION BY k ORDER BY key) AS i, name, size FROM g)
SELECT k, CAST(i AS INT) AS row_, x.col, x.name, x.value FROM c, LATERAL (SELECT 0 AS col, 'key' AS name, CAST(key AS VARCHAR) AS value UNION ALL SELECT 1, 'the name', name || ';"x"' UNION ALL SELECT 2, 'size', CAST(size AS VARCHAR)) x""")
def cells_by_table_function(spark, d):
    """Cells of quoted CSV by a polymorphic table function, partitioned by document; a lateral join gives the same."""
    quoted = F.concat(F.lit("key;the name;size\n"), F.array_join(F.transform("r", lambda r: F.concat(_s(r["key"]), F.lit(';"'), r["name"], F.lit(';""x""";'), _s(r["size"]))), "\n"))
    tables.register(spark)
    groups(spark, d).select("k", quoted.alias("text")).createOrReplaceTempView("csv_documents")
    whole = spark.sql("SELECT k, row, col, name, value FROM csv_table(TABLE(csv_documents) PARTITION BY k) WHERE row > 0")
    lateral = spark.sql("SELECT k, c.row, c.col, c.name, c.value FROM csv_documents, LATERAL csv_cells(text) c WHERE c.row > 0")
    return whole.intersectAll(lateral).withColumnRenamed("row", "row_")


# --- feeds --------------------------------------------------------------------------------------------
def feed_files(spark, d, root: str) -> None:
    """A file of each day's events at root."""
    sink.register(spark)
    e = table(spark, d, "events").filter("ts is not null").select(F.date_format("ts", "yyyy-MM-dd").alias("day"), F.struct("event_id", "event_type").alias("e"))
    e = e.groupBy("day").agg(F.to_json(F.struct(F.struct(F.array_sort(F.collect_list("e")).alias("hits")).alias("data"))).alias("json"))
    e.write.format("file_per_row").option("name", "day").option("suffixes", "json=.json").mode("append").save(root)


@query("""SELECT strftime(ts, '%Y-%m-%d') AS day, row_number() OVER (PARTITION BY strftime(ts, '%Y-%m-%d') ORDER BY event_id) - 1 AS seq, event_id, event_type, false AS failed FROM events WHERE ts IS NOT NULL
UNION ALL SELECT 'none', -1, -1, '', true""")
def feed_items(spark, d):
    """A feed file per day, read by the data source beside one that isn't there: its error is a row."""
    root = shared_dir(spark)
    feed_files(spark, d, root)
    feeds.register(spark)
    urls = [r.path for r in files.from_files(spark, root, "*.json").filter("path not like '%/_manifest.json'").select("path").collect()]  # a URL per day
    got = spark.read.format("json_feed").option("urls", ",".join([*urls, f"{root}/none.json"])).option("list", "data.hits").load()
    item = F.from_json("item", "event_id bigint, event_type string")
    return got.select(F.regexp_extract("url", r"([^/]+)\.json\z", 1).alias("day"), F.coalesce(F.col("seq").cast("bigint"), F.lit(-1)).alias("seq"), F.coalesce(item["event_id"], F.lit(-1)).alias("event_id"), F.coalesce(item["event_type"], F.lit("")).alias("event_type"), F.col("error").isNotNull().alias("failed"))


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS total FROM events WHERE strftime(ts, '%Y-%m-%d') BETWEEN '2024-01-03' AND '2024-01-12' GROUP BY 1")
def feed_days(spark, d):
    """A feed addressed by day: of a month of days those are asked for that the query's bounds leave."""
    root = shared_dir(spark)
    feed_files(spark, d, root)
    feeds.register(spark)
    got = spark.read.format("json_feed").option("urls", f"{root}/{{day}}.json").option("list", "data.hits").option("first", "2024-01-01").option("last", "2024-01-31").load()
    got = got.filter("day between '2024-01-03' and '2024-01-12'").withColumn("event", F.from_json("item", "event_id bigint"))
    return got.groupBy("day").agg(F.count("*").alias("n"), F.sum("event.event_id").alias("total"))


# --- streams ------------------------------------------------------------------------------------------
def _streamed(spark, d, name: str, parts: int):
    """A table as a stream: written in parts, a part per micro-batch.  A part is as many files as there are tasks for it."""
    path = shared_dir(spark)
    whole = table(spark, d, name)
    files = -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // parts)
    whole.repartition(parts * files).write.parquet(path)
    return spark.readStream.schema(whole.schema).option("maxFilesPerTrigger", files).parquet(path)


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS total FROM events WHERE ts IS NOT NULL GROUP BY 1")
def stream_daily(spark, d):
    """Items per UTC day, counted over four micro-batches."""
    out = f"stream_daily_{abs(hash(d))}"
    q = watch.daily_counts(_streamed(spark, d, "events", 4).withColumn("ts", F.col("ts").cast("timestamp")), "ts", "3650 days", "event_id").writeStream.format("memory").queryName(out).outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(out).select(F.date_format("day.start", "yyyy-MM-dd").alias("day"), "n", F.col("points").cast("bigint").alias("total"))


@query("SELECT DISTINCT substring(sha256(text), 1, 16) AS source_id, CAST(length(text) AS BIGINT) AS chars FROM documents WHERE text IS NOT NULL")
def stream_originals(spark, d):
    """Each text of a stream of documents once, appended to a table."""
    root = shared_dir(spark)
    x = _streamed(spark, d, "documents", 3).filter("text is not null").withColumn("ts", F.lit("2024-01-01").cast("timestamp"))
    q = watch.originals_once(x).select("source_id", F.length("text").cast("bigint").alias("chars")).writeStream.format("parquet").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start(f"{root}/out")
    q.awaitTermination()
    return spark.read.schema("source_id string, chars bigint").parquet(f"{root}/out")


@query(f"""WITH {_G} SELECT 'n' || k || '.csv' AS file, '| key | size |{NL}| --- | --- |{NL}' || string_agg('| ' || key || ' | ' || size || ' |', chr(10) ORDER BY key) AS markdown FROM g GROUP BY k""")
def stream_converted(spark, d):
    """A folder of CSV files, watched: converted in micro-batches of files, as far as there are any."""
    root = shared_dir(spark)
    sink.register(spark)
    rows = F.concat(F.lit("key,size\n"), F.array_join(F.transform("r", lambda r: F.concat(_s(r["key"]), F.lit(","), _s(r["size"]))), "\n"), F.lit("\n"))
    groups(spark, d).select(F.concat(F.lit("n"), _s("k")).alias("out_name"), rows.alias("csv")).write.format("file_per_row").option("suffixes", "csv=.csv").mode("append").save(f"{root}/in")
    with watch.small_files(spark):
        watch.convert_stream(watch.watch(spark, f"{root}/in", "*.csv", 10_000), Engine(spark).convert_files, f"{root}/out", f"{root}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{root}/out").select(sniff.basename("path").alias("file"), "markdown")


# --- disclosure, digits, prompts ------------------------------------------------------------------------
@query(f"""WITH {_G} SELECT 'csv-' || k AS doc_id, 'grew' AS warning FROM g GROUP BY k
UNION ALL SELECT 'note-' || k, 'content-removed' FROM g GROUP BY k HAVING k % 2 = 0 AND 2 * ceil((string_agg(name || ' is a part that we have under the number ' || key || ' in the store.', ' ')).length() / 4.0) >= 200 UNION ALL SELECT 'note-' || k, 'no-language-model' FROM g GROUP BY k""")
def warnings_disclosed(spark, d):
    """Small tables whose Markdown is longer, and notes of which every second one says all it has three times."""
    csv = groups(spark, d).select(F.concat(F.lit("csv-"), _s("k")).alias("doc_id"), F.lit("a,b\n1,2\n").alias("text"), F.lit("x.csv").alias("name"))
    body = F.array_join(F.transform("r", lambda r: F.concat(r["name"], F.lit(" is a part that we have under the number "), _s(r["key"]), F.lit(" in the store."))), " ")
    note = groups(spark, d).select(F.concat(F.lit("note-"), _s("k")).alias("doc_id"), F.concat(F.lit("# Parts\n\n"), F.when(F.col("k") % 2 == 0, F.concat_ws("\n\n", body, body, body)).otherwise(body)).alias("text"), F.lit("x.md").alias("name"))
    got = Engine(spark).convert_texts(csv.unionByName(note), filename_col="name", structure=False)
    return got.select("doc_id", F.explode("warnings").alias("warning"))


@query("SELECT doc_id, format('{:,}', n_chars * 1000) AS digits FROM documents WHERE n_chars IS NOT NULL")
def digits_grouped(spark, d):
    return table(spark, d, "documents").filter("n_chars is not null").select("doc_id", T.group_digits(F.col("n_chars") * 1000).alias("digits"))


_BY_MODEL = "doc_id % 2 = 0 AND doc_id % 6 <> 0"


@query(f"""WITH {_PROMPT}, st AS ({ORACLES["prompt_structure"]})
SELECT doc_id, sha256(CASE WHEN {_BY_MODEL} THEN 'do: ' || doc_id ELSE coalesce(markdown, text) END) AS optimized_sha256, NOT ({_BY_MODEL}) AS fell_back FROM pr LEFT JOIN st USING (doc_id)""")
def prompts_optimised(spark, d):
    """A model for every second prompt, which fails on some: the deterministic text stays there, with the reason."""

    def model(row: dict) -> str:
        if row["doc_id"] % 6 == 0:
            raise OSError("busy")
        return f"do: {row['doc_id']}" if row["doc_id"] % 2 == 0 else " "

    x = Engine(spark, language_model=model).optimise(part_prompts(spark, d))
    return x.select("doc_id", F.sha2("optimized", 256).alias("optimized_sha256"), F.col("warning").isNotNull().alias("fell_back"))

"""What a query does once per row, per task or per file, as its tables grow."""

import random
import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from docloom.functions import rows
from docloom.functions.scratch import shared_dir
from docloom.operators import blocks, clean, prompts, report
from docloom.plans import catalogue, conversions, surfaces
from docloom.plans.engine import Engine
from docloom.sources import html, pdf, pdf_layout
from docloom.streaming import watch

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_prompt_is_laid_out_once(spark):
    rows = spark.createDataFrame([(0, "do this. it must work. use python."), (1, None), (2, "")], "doc_id long, text string")
    x = prompts.structure(rows, "text", "laid").filter("structured or doc_id >= 0")
    assert plan(x).count("## Notes") == 1
    assert [(r.laid, r.structured) for r in x.orderBy("doc_id").collect()][1:] == [(None, False), ("", False)]


def test_only_sentences_with_digits_are_searched_for_constraints(spark):
    r = random.Random(11)
    parts = ["python", "Node", "go", ".net", "x.NET", "version ", "Version", " v", " ", "3", "3.11", "1.2.3", "only", " or later", "or newer", "_", "a", "٣", "\n", "didn't", "Did I mention", "did i say", "undid i say", "_did i say", " ", "?", " yes, "]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 7))) for _ in range(4000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert ", [0-9]) AND RLIKE(" in plan(prompts.structure(df, "t", "laid"))
    x = df.select("t", prompts.is_constraint(F.col("t")).alias("is"), F.regexp_replace("t", prompts.META_QUESTION, "").alias("left"))
    meta = re.compile(r"(?i)(?<![A-Za-z0-9_])did i (?:mention|say)(?![A-Za-z0-9_])[^.?!]*[?]\s*(?:yeah|yes|yep)?[,.]?\s*", re.ASCII)
    constraint = re.compile(prompts.CONSTRAINT, re.ASCII)
    got = x.collect()
    assert {bool(v["is"]) for v in got} == {True, False} and any(v.left != v.t for v in got)
    for v in got:
        assert (v["is"], v.left) == (bool(constraint.search(v.t)), meta.sub("", v.t)), repr(v.t)


def test_prompts_are_dealt_over_all_tasks(spark):
    assert catalogue.part_prompts(spark, SF).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_filler_and_groups_are_dealt_over_all_tasks(spark):
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert conversions.filler_paragraphs(spark, SF).rdd.getNumPartitions() == n
    assert conversions.groups(spark, SF).rdd.getNumPartitions() == n


def test_results_of_a_batch_are_made_in_slices():
    batch = pa.array(range(1000))
    parts = list(rows._sliced(iter([batch, (batch, batch)]), lambda *x: sum(x), pa.int64()))
    assert max(map(len, parts)) == rows.SLICE and [v for p in parts for v in p.to_pylist()] == [*range(1000), *range(0, 2000, 2)]


def test_slices_of_long_rows_are_shorter():
    texts = ["x" * 100_000, None, "", "y" * 3_000_000] * 100
    parts = list(rows._sliced(iter([pa.array(texts), (pa.array(texts), pa.array(texts))]), lambda *x: x[0], pa.string()))
    assert [v for p in parts for v in p.to_pylist()] == texts * 2
    assert max(p.nbytes for p in parts if len(p) > 1) <= 1 << 20


def test_texts_are_converted_in_slices(spark):
    pages = spark.createDataFrame([(i, None if i == 7 else f"<p>{i}</p>") for i in range(300)], "k long, html string").coalesce(1)
    x = html.convert(pages)
    assert "ArrowEvalPython" in plan(x) and "pandas" not in plan(x).lower()
    assert [r.markdown for r in x.orderBy("k").collect()] == [None if i == 7 else str(i) for i in range(300)]


def test_items_of_a_batch_of_files_come_in_parts(spark):
    class Files:
        schema = spark.range(0).selectExpr("cast(id as string) as path").schema
        select = lambda self, *_: self
        mapInPandas = lambda self, run, _: run  # noqa: E731, N815

    file = conversions.pdf_file(1, [dict(key=i, name="a", size=i) for i in range(10)])
    n = len(list(pdf.items(file)))
    parts = list(pdf.read_items(Files())(iter([pd.DataFrame({"path": [str(i) for i in range(500)], "content": [file] * 500})])))
    assert sum(map(len, parts)) == 500 * n and max(map(len, parts)) < 4096 + n


def test_pages_reach_python_as_rows_not_as_groups(spark):
    items = spark.createDataFrame([("a", 1, 1, "two", 60.0, 700.0, 20.0, 10.0), ("a", 1, 0, "one", 10.0, 700.0, 20.0, 10.0), ("b", 2, 0, "x", 1.0, 1.0, 1.0, None)], "doc_id string, page int, item_no int, text string, x double, y double, width double, height double")
    x = pdf_layout.layout(items)
    assert "FlatMapGroups" not in plan(x)
    assert [tuple(r) for r in x.orderBy("doc_id").collect()] == [("a", 1, "one two"), ("b", 2, "x")]


def test_a_streamed_table_is_written_by_all_tasks(spark, monkeypatch):
    path = []
    monkeypatch.setattr(surfaces, "shared_dir", lambda s: path.append(shared_dir(s)) or path[0])
    surfaces._streamed(spark, SF, "documents", 3)
    assert len(spark.read.parquet(path[0]).inputFiles()) > 3


def test_a_stream_s_files_are_dealt_over_all_cores(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(20):
        (tmp_path / "in" / f"{i}.csv").write_text(f"a\n{i}\n")
    seen, key = [], "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(key)

    def convert(files):
        seen.append((files.rdd.getNumPartitions(), spark.conf.get(key)))
        return files.select("path")

    n = spark.sparkContext.defaultParallelism
    with watch.small_files(spark):
        watch.convert_stream(watch.watch(spark, str(tmp_path / "in")), convert, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert seen == [(n, str(n))] and spark.conf.get(key) == before
    assert spark.read.parquet(str(tmp_path / "out")).count() == 20


def test_sections_of_converted_texts_are_made_once(spark):
    docs = spark.createDataFrame([(1, "# A\n\none\n\none\n\n## B\n"), (2, ""), (3, None)], "doc_id long, text string")
    x = Engine(spark).convert_texts(docs, structure=False)
    assert plan(x).count("posexplode") == 1
    assert [(r.markdown, r.output_tokens) for r in x.orderBy("doc_id").collect()] == [("# A\n\none", 2), ("", 0), ("", 0)]


def test_a_section_s_key_is_made_once(spark):
    x = clean.strip(blocks.sections(spark.createDataFrame([(1, "a")], "doc_id long, text string")))
    assert plan(x).count("lower(") == 1 and plan(x).count("Window [lag(") == 0


def test_keys_of_sections_have_no_marks_and_white_space_collapsed(spark):
    r, odd = random.Random(5), "\t    　﻿"
    texts = ["".join(r.choice("aBÉß世😀.*_`~  " + odd) for _ in range(r.randint(0, 8))) for _ in range(3000)] + ["", "  ", "a b", "*", "\u0085x"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").selectExpr("t", "lower(t) low").select("t", clean.dedupe_key("low").alias("k"), F.col("low").rlike(clean.HAS_KEY).alias("has")).collect()
    for x in got:
        key = re.sub(f"[ {odd}]+", " ", re.sub("[*_`~]", "", x.t.lower())).strip(" ")
        assert (x.k, x.has) == (key, key != ""), repr(x.t)


def test_a_text_is_searched_for_its_facts_once(spark):
    rows = [(0, "ORD-1234 of 2024-01-02 costs $5", "- ORD-1234"), (1, "none", "none"), (2, "", ""), (3, None, "x"), (4, "7.5% 7.5%", None)]
    x = report.eval_score(spark.createDataFrame(rows, "doc_id long, text string, cleaned string"))
    assert plan(x.select("doc_id", "score")).count("regexp_extract_all") == len(report.FACTS)
    assert [r.fact_score for r in x.orderBy("doc_id").collect()] == [1 / 3, 1.0, 1.0, 1.0, 0.0]

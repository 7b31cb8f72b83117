"""A corpus pipeline of five of the llm operators: each stage works on what the one before kept.

Stages take (spark, docs, sf_dir); all but the last return the columns of documents, whatever further ones docs has, the last one
the documents' tokens.  Rows travel as a struct beside what an operator reads, so that no column can clash with an operator's own.  Rows of one
doc_id and one text are one document, which takes its other columns from one of them, the same at every run; different texts under one doc_id all stay
if their group's doc_id does.  A row without doc_id can't be told apart from others without, so line dedup and near-duplicate removal let it
pass.  Empty tables give empty results; texts of any length are read whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from docloom.llm import bpe, decontaminate, jaccard_join, line_dedup, quality
from docloom.llm._scratch import Scratch
from docloom.llm.queries import tokenizer_file

_HAS_WORD = r"[^\x20\x09-\x0D]"


_READ = ("doc_id", "text")


def _packed(docs: DataFrame) -> DataFrame:
    """What an operator reads, and all other columns as one."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in _READ]
    return docs.select(*_READ, (F.struct(*others) if others else F.lit(None)).alias("other_columns"))


def _unpacked(packed: DataFrame, docs: DataFrame, **put: Column) -> DataFrame:
    """The columns of docs again, with those in put replaced."""
    return packed.select(*[put.get(c, F.col(c if c in _READ else f"other_columns.`{c}`")).alias(c) for c in docs.columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the risk-controlled cutoffs reject go, null and empty texts among them; a value equal to a cutoff passes, repeated rows go or stay together."""
    return quality.kept_documents(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeated runs of lines go; so do documents of which no word is left.  Equal runs are ordered by doc_id and line; null texts pass."""
    out = line_dedup.remove_repeated_lines(spark, _packed(docs))
    out = out.filter((F.col("n_removed_lines") == 0) | F.col("text").rlike(_HAS_WORD))
    return _unpacked(out, docs, n_chars=F.length("text").cast("long"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents (5-word shingles, similarity 0.8 or more) the one with the smallest doc_id stays, once; rows without words or doc_id pass."""
    groups = jaccard_join.link_components(spark, docs, words=5, percent=80)
    stay = groups.filter((F.col("doc_id") == F.col("component_id")) | (F.col("n_shingles") == 0)).select("doc_id").distinct()
    named = _packed(docs).join(stay, "doc_id", "left_semi")
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    one = named.groupBy("doc_id", digest.alias("digest")).agg(F.min_by(F.struct("text", "other_columns"), F.to_json(F.struct("other_columns"))).alias("kept"))
    return _unpacked(one.select("doc_id", "kept.*"), docs).unionByName(docs.filter("doc_id is null"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go; null texts and items hold none."""
    hit = decontaminate.scan_documents(spark, _packed(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _unpacked(hit.filter("hit.n_hit = 0"), docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with the digest of what they decode to; a null text has none."""
    return bpe.token_digests(docs.select("doc_id", "lang", "source", "text"), tokenizer_file(), with_ids=True)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", drop_repeated_lines),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("bpe", tokenise),
]

#: the stages fit cutoffs, follow links and tokenise: no SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written and read again by the next one."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

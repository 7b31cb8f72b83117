"""The registered queries of this subpackage: each applies an operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bpe, decontaminate, exact_dedup, html_text, jaccard_join, licenses, line_dedup, merkle, oracles, phrases, quality, secrets, substring_dedup, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_text.extract(pages).withColumn("n_chars", F.length("text").cast("long"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark, _table(spark, sf_dir, "pages"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(spark, _table(spark, sf_dir, "documents").select("doc_id", "source", "text"), vocabulary_files()).filter("is_secret")


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.recognise(_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.verdicts(spark, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_passages(spark, _table(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.remove_repeated_lines(spark, _table(spark, sf_dir, "documents"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(spark, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def tokenizer_file() -> str:
    """The tokenizer's path is a parameter of the operator; queries take the installed public one."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def vocabulary_files() -> tuple[str, ...]:
    """The vocabularies, a parameter as well, whose words are op2's dictionary: an English one and one of many languages."""
    import public_tokenizers

    return tuple(public_tokenizers.path(f"{name}.tiktoken") for name in ("byte_bpe_50k", "byte_bpe_multi_50k"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_digests(_table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_file())


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.link_components(spark, _table(spark, sf_dir, "documents"))


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(spark, _table(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.tamper_report(spark, _table(spark, sf_dir, "documents"))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicates(spark, _table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "pipeline": pipeline,
    "op3_substring_dedup": op3_substring_dedup,
    "op1_html_text": op1_html_text,
    "op10_warc": op10_warc,
    "op2_secrets": op2_secrets,
    "op6_licenses": op6_licenses,
    "op9_quality": op9_quality,
    "op4_decontaminate": op4_decontaminate,
    "op7_bpe": op7_bpe,
    "op5_line_dedup": op5_line_dedup,
    "op8_jaccard_join": op8_jaccard_join,
    "op11_phrases": op11_phrases,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_exact_dedup": op13_exact_dedup,
}
ORACLES: dict[str, str] = {
    "op4_decontaminate": oracles.DECONTAMINATE,
    "op5_line_dedup": oracles.LINES,
    "op6_licenses": oracles.LICENSES,
    "op8_jaccard_join": oracles.JACCARD,
    "op9_quality": oracles.QUALITY,
    "op10_warc": oracles.WARC,
    "op11_phrases": oracles.PHRASES,
    "op12_merkle_manifest": oracles.MERKLE,
    "op13_exact_dedup": oracles.COPIES,
}

"""Queries opN_<name> over the driver's tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from dittograph.llm import context_mixing, decontaminate, jaccard_join, licenses, line_crf, packing, piece_codec, quality_rules, transcripts, warc
from dittograph.storage import fresh

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.write(_table(spark, sf_dir, "pages"), fresh(spark, "warc"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.write(_table(spark, sf_dir, "documents"), fresh(spark, "packed"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_mixing.score(_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "bytes", "bits", "bits_per_byte")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judged(_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "keep", "reason")


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op7_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcripts.parsed_by_others(_table(spark, sf_dir, "conversations"))


def op8_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.encode(_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_ids", "ids", "exact")


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.ngram_jaccard_groups(_table(spark, sf_dir, "documents"))


def op10_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = line_crf.train(docs, _table(spark, sf_dir, "labels"))
    found = line_crf.scored(docs, model)
    return found.select("doc_id", "quality", "lines", "bad_lines", (found["quality"] >= line_crf.THRESHOLD).alias("keep"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_warc, op2_packing, op3_decontaminate, op4_context_mixing, op5_quality_rules, op6_licenses, op7_transcripts, op8_piece_codec, op9_ngram_jaccard, op10_line_crf)}


def oracle_sql() -> dict[str, str]:
    return {"op3_decontaminate": decontaminate.SQL, "op5_quality_rules": quality_rules.SQL, "op6_licenses": licenses.sql()}

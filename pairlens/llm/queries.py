"""The queries of the operators, run over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from pairlens.llm import bpe, secret_scan, warc
from pairlens.llm.collocations import collocations
from pairlens.llm.decontam import decontamination_report
from pairlens.llm.exact import exact_groups
from pairlens.llm.filter_audit import audit_filters
from pairlens.llm.language import identify
from pairlens.llm.licenses import scan_licenses
from pairlens.llm.minhash import near_groups
from pairlens.llm.ngram_join import join_documents
from pairlens.llm.sharding import shard_rows
from pairlens.llm.suffix import cut_repeats, repeat_report
from pairlens.staging import new_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer(spark: SparkSession, name: str) -> bpe.Tokenizer:
    return bpe.Tokenizer(spark, public_tokenizers.path(name), public_tokenizers.PATTERN)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer = _tokenizer(spark, "byte_bpe_multi_50k.tiktoken")
    return bpe.digests(bpe.round_trip(_table(spark, sf_dir, "documents"), tokenizer))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.archive_pages(_table(spark, sf_dir, "pages"), new_path(spark, "warc"))
    return records.drop("payload")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_rows(_table(spark, sf_dir, "documents"), shards=8).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(_table(spark, sf_dir, "documents"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer = _tokenizer(spark, "byte_bpe_50k.tiktoken")
    return secret_scan.span_report(secret_scan.scan_secrets(_table(spark, sf_dir, "documents"), tokenizer))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = lambda c: F.array_join(c, ",").alias(c)
    return scan_licenses(_table(spark, sf_dir, "documents")).select(
        "doc_id", "canonical_sha256", joined("whole"), joined("notices"), "n_lines")


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(_table(spark, sf_dir, "documents"), words=2).select(
        "doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(_table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = decontamination_report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return report.select("doc_id", "n_words", "n_hit", "n_items",
                         F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeat_report(cut_repeats(_table(spark, sf_dir, "documents")))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_filters(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(_table(spark, sf_dir, "documents"))


def op13_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_documents(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_warc": op2_warc,
    "op3_sharding": op3_sharding,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_secret_scan": op5_secret_scan,
    "op6_license_scan": op6_license_scan,
    "op7_minhash": op7_minhash,
    "op8_language": op8_language,
    "op9_decontamination": op9_decontamination,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_filter_audit": op11_filter_audit,
    "op12_collocations": op12_collocations,
    "op13_ngram_join": op13_ngram_join,
}

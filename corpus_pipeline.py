"""A training corpus from raw documents, stage by stage; each stage reads what the one before it wrote."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from pairlens.llm import bpe
from pairlens.llm.decontam import drop_contaminated
from pairlens.llm.exact import drop_exact
from pairlens.llm.language import drop_unidentified
from pairlens.llm.minhash import drop_near
from pairlens.staging import new_path


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no language that can be told go: those without a letter, and those the network is too unsure of.

    How sure it has to be is calibrated on the labelled rows. The others carry `lang_pred` and `lang_score`.
    """
    return drop_unidentified(docs, names=("lang_pred", "lang_score"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, white space aside, the one with the smallest doc_id stays."""
    return drop_exact(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts linked by 80 % of their five-word shingles, the one with the smallest doc_id stays."""
    return drop_near(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten words in a row of a benchmark item, or all of a shorter one, go."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed token ids of every text, and the digest of the bytes they decode to."""
    tokenizer = bpe.Tokenizer(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    coded = bpe.round_trip(docs, tokenizer)
    return bpe.digests(coded, "ids")


STAGES = [
    ("language", identify_language),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontaminate),
    ("bpe", encode),
]

#: SQL can express neither the language network nor the encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that all stages keep, with their tokens.

    Null and empty texts go with the first stage. Null ids are the last of theirs to be kept, rows that repeat id and
    text become one. An empty table gives no rows; columns beside those of documents go up to the last stage, not through it.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

"""Reading and writing pair tables, feature tables, predictions and word vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from pairlens.sources.quoted import quoted_records

PAIR_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("id1", T.LongType()), T.StructField("id2", T.LongType()),
    T.StructField("question1", T.StringType()), T.StructField("question2", T.StringType()),
    T.StructField("is_duplicate", T.IntegerType()),
])
UNLABELLED_SCHEMA = T.StructType(PAIR_SCHEMA.fields[:-1])


def fill_text(pairs: DataFrame) -> DataFrame:
    """Missing texts become one space, in labelled and unlabelled pairs alike."""
    return pairs.na.fill(" ", ["question1", "question2"])


def _one_line(text: Column) -> Column:
    """Backslashes, newlines and returns written with a backslash."""
    return F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r"))


def _as_written(text: Column) -> Column:
    lines = lambda part: F.replace(F.replace(part, F.lit("\\n"), F.lit("\n")), F.lit("\\r"), F.lit("\r"))
    return F.array_join(F.transform(F.split(text, r"\\\\"), lines), "\\")


def read_pairs_csv(spark: SparkSession, path: str, labelled: bool = True, multi_line: bool = False) -> DataFrame:
    """A headerless CSV of pairs; quotes are doubled inside quoted fields. A malformed row is an error.

    By default every record is one line, as `write_pairs_csv` writes it. Files of other origin, in
    which texts may span lines and a backslash is nothing special, are read with `multi_line`; records are
    then found by `quoted_records`. Large files are split either way.
    """
    schema = PAIR_SCHEMA if labelled else UNLABELLED_SCHEMA
    if multi_line:
        records = quoted_records(spark, path).select(F.regexp_replace("record", r"\r$", "").alias("record")).filter("record <> ''")
        parsed = F.from_csv("record", schema.simpleString()[len("struct<"):-1].replace(":", " "),
                            {"quote": '"', "escape": '"', "multiLine": "true", "mode": "FAILFAST"})
        pairs = records.select(parsed.alias("r")).select("r.*")
    else:
        pairs = spark.read.csv(path, schema=schema, quote='"', escape='"', mode="FAILFAST", lineSep="\n").withColumns(
            {c: _as_written(F.col(c)) for c in ("question1", "question2")})
    pairs = fill_text(pairs)
    return pairs if labelled else pairs.withColumn("is_duplicate", F.lit(None).cast("int"))


def write_pairs_csv(pairs: DataFrame, path: str, labelled: bool = True) -> None:
    """One line a record; newlines inside texts are written with a backslash."""
    columns = (PAIR_SCHEMA if labelled else UNLABELLED_SCHEMA).fieldNames()
    lines = pairs.withColumns({c: _one_line(F.col(c)) for c in ("question1", "question2")})
    lines.select(columns).write.csv(path, quote='"', escape='"', quoteAll=True,
                                    ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def union_corpus(train: DataFrame, test: DataFrame) -> DataFrame:
    """Labelled and unlabelled pairs in one table with a `split` column."""
    return (train.withColumn("split", F.lit("train"))
            .unionByName(test.withColumn("split", F.lit("test")), allowMissingColumns=True))


def load_pairs(spark: SparkSession, train_path: str, test_path: str, multi_line: bool = False) -> DataFrame:
    return union_corpus(read_pairs_csv(spark, train_path, multi_line=multi_line),
                        read_pairs_csv(spark, test_path, labelled=False, multi_line=multi_line))


def read_feature_table(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    table = spark.read.parquet(path)
    return table.select(*columns) if columns else table


def write_feature_table(features: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Parquet by default; CSV with a header on request."""
    if fmt == "csv":
        features.write.csv(path, header=True)
    else:
        features.write.format(fmt).save(path)


def write_predictions(scores: DataFrame, path: str, score: str = "score") -> None:
    """A submission: `Id,Score` with a header, one row per pair."""
    scores.select(F.col("id").alias("Id"), F.col(score).alias("Score")).write.csv(path, header=True)


def write_members(scores: DataFrame, path: str) -> None:
    """The score of every member of an ensemble, next to the id that later joins rely on."""
    scores.write.csv(path, header=True)


def read_word_vectors_text(spark: SparkSession, path: str) -> DataFrame:
    """One word per line, its numbers after it, separated by single spaces."""
    parts = F.split("value", " ")
    numbers = F.slice(parts, F.lit(2), F.size(parts) - 1).cast("array<float>").cast("array<double>")
    return spark.read.text(path).select(parts[0].alias("word"), numbers.alias("vec"))


def write_word_vectors_text(vectors: DataFrame, path: str) -> None:
    numbers = F.array_join(F.col("vec").cast("array<float>").cast("array<string>"), " ")
    vectors.select(F.concat_ws(" ", "word", numbers).alias("value")).write.text(path)

"""Pairs, word vectors and dictionaries that Spark derives from the given tables.

See FIXTURES.md. Whole texts and whole tables are used; groups of equal texts and
of shared lines are linked to their first document, so their pairs grow with the
group and not with its square.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pairlens.functions import text as T
from pairlens.operators import corpus
from pairlens.operators.skew import lookup, lookup_salted
from pairlens.staging import settings, stage, staged_once

#: Shorter lines are too common to say that documents belong together.
LINE_LENGTH = 40
STEPS = (1, 7)
ID_BASE = 1 << 31
#: Ids of a block of documents, as a power of two, and bytes of text a task puts into pairs.
BLOCK_BITS = 8
BYTES_OF_A_TASK = 4 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit(" ")).alias("text"))


def _link_to_first(rows: DataFrame, name: str) -> DataFrame:
    """`(id1, id2)` from the first document of every group to each other document of it."""
    groups = stage(rows.groupBy("key").agg(F.min("doc_id").alias("id1"), F.count("*").alias("n"))
                   .filter(F.col("n") > 1), name)
    return (lookup(rows, groups, "key", "n").filter(F.col("doc_id") > F.col("id1"))
            .select("id1", F.col("doc_id").alias("id2")))


def pair_ids(docs: DataFrame, line_length: int = LINE_LENGTH) -> DataFrame:
    """Pairs of FIXTURES.md; `line_length` is the least length of a line that links documents (1: every line)."""
    steps = F.explode(F.array(*[F.col("doc_id") + s for s in STEPS]))
    neighbours = docs.select(F.col("doc_id").alias("id1"), steps.alias("id2")).join(
        docs.select(F.col("doc_id").alias("id2")), "id2", "left_semi").select("id1", "id2")
    equal = _link_to_first(docs.select("doc_id", F.md5("text").alias("key")), "equal-texts")
    lines = (docs.select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
             .select("doc_id", F.trim("line").alias("line"))
             .filter(F.length("line") >= line_length)
             .select("doc_id", F.md5("line").alias("key")).distinct())
    return neighbours.union(equal).union(_link_to_first(lines, "shared-lines")).distinct()


def _as_often(ids: DataFrame, docs: DataFrame, hot_keys: int = 1_000) -> DataFrame:
    """The pairs `(id1, id2)`, repeated for first documents whose id comes several times and that lead many pairs.

    Ids are meant to be unique. Where one comes c times, its pairs come c times for that alone, and c times more where they are
    over 1 / `hot_keys` of all: what the join of hot first documents always made of them, and later tables count on.
    """
    degrees = ids.groupBy("id1").agg(F.count("*").alias("n"))
    held = docs.groupBy(F.col("doc_id").alias("id1")).agg(F.count("*").alias("c")).join(degrees, "id1")
    bound = held.agg((F.sum(F.col("n") * F.col("c")) / F.lit(hot_keys)).alias("bound")).scalar()
    again = held.filter((F.col("c") > 1) & (F.col("n") > bound)).select("id1", "c")
    times = F.sequence(F.lit(1).cast("bigint"), F.coalesce("c", F.lit(1).cast("bigint")))
    return stage(ids.join(again, "id1", "left").select("id1", "id2", F.explode(times).alias("_time")).drop("_time"), "pair-rows")


def build_pairs(docs: DataFrame, block_bits: int = BLOCK_BITS, bytes_of_a_task: int = BYTES_OF_A_TASK) -> DataFrame:
    """The pair table of FIXTURES.md, from `(doc_id, text)`, staged.

    Documents lie in blocks of near ids, and a pair in the block of its second one. A block gets the texts of its
    own documents, and once each those of first documents from elsewhere, however many of its pairs they lead. So whole
    texts move once or twice, not once a pair, and pairs that share a text lie together. A second document is in at
    most one pair per line of its own, so no block is hot.
    """
    ids = _as_often(stage(pair_ids(docs), "pair-ids"), docs)
    block = lambda c: F.shiftright(c, block_bits)
    own = docs.select(block("doc_id").alias("block"), F.col("doc_id").alias("id"), "text")
    elsewhere = stage(ids.select("id1", block("id2").alias("block")).filter(
        block("id1") != F.col("block")).distinct(), "first-documents")
    # A first document may lead a third of all pairs, and is then needed in every block.
    needed = elsewhere.groupBy("id1").agg(F.count("*").alias("n"))
    first = docs.select(F.col("doc_id").alias("id1"), "text").join(needed, "id1")
    sent = lookup_salted(elsewhere, first, "id1", "n", spread=F.col("block"), hot_keys=1_000).select(
        "block", F.col("id1").alias("id"), "text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tasks = size // bytes_of_a_task + 1
    texts = own.unionByName(sent).repartition(tasks, "block")
    words = F.array_distinct(T.split_words(F.lower(F.col("text"))))
    # Both sides read the same texts, which are shuffled once. A second document is found in its own block alone: no text is sent to that.
    side = lambda n: texts.select("block", F.col("id").alias(f"id{n}"), F.col("text").alias(f"question{n}"), words.alias(f"set{n}"))
    known = (ids.withColumn("block", block("id2")).repartition(tasks, "block")
             .join(side(1), ["block", "id1"]).join(side(2), ["block", "id2"]))
    common = F.size(F.array_intersect("set1", "set2"))
    overlap = F.try_divide(common, F.size("set1") + F.size("set2") - common)
    fits = F.col("id1").between(0, ID_BASE - 1) & F.col("id2").between(0, ID_BASE - 1)
    pair_id = F.when(fits, F.col("id1") * F.lit(ID_BASE) + F.col("id2")).otherwise(
        F.raise_error(F.lit("a document id does not fit into 31 bits")).cast("bigint"))
    rows = (known.select(pair_id.alias("id"), "id1", "id2", "question1", "question2",
                         F.coalesce(overlap >= 0.5, F.lit(False)).cast("int").alias("is_duplicate"))
            .withColumn("split", F.when(F.substring(F.md5(F.concat(F.lit("fx"), F.col("id").cast("string"))), 1, 2)
                                        < "1a", "test").otherwise("train")))
    # Both joins by block and id stay where the texts were placed by block alone.
    with settings(docs.sparkSession, {"spark.sql.requireAllClusterKeysForCoPartition": "false"}):
        return stage(rows, "pairs", codec="zstd")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staged_once(spark, f"{sf_dir}/pairs", lambda: build_pairs(documents(spark, sf_dir)), staged=True)


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`distinct_texts` of the pairs, which words are counted from and looked up for."""
    return staged_once(spark, f"{sf_dir}/texts", lambda: corpus.distinct_texts(pairs(spark, sf_dir)), staged=True)


def clean_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staged_once(spark, f"{sf_dir}/clean-counts", lambda: corpus.token_counts(texts(spark, sf_dir)))


def word_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The word of frequency rank r gets embedding r - 1, stretched so that lengths differ."""
    def build():
        ranked = corpus.vocab_index(clean_counts(spark, sf_dir))
        source = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(
            (F.col("vec_id") + 1).alias("idx"), F.col("embedding").cast("array<double>").alias("e"))
        stretch = 1.0 + 0.25 * (F.col("idx") % 5)
        return ranked.join(source, "idx").select("word", F.transform("e", lambda x: x * stretch).alias("vec"))
    return staged_once(spark, f"{sf_dir}/word-vectors", build)


def run_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staged_once(spark, f"{sf_dir}/run-counts", lambda: corpus.token_counts(texts(spark, sf_dir), T.word_runs))


def lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third word by frequency is a noun."""
    tag = F.when(F.col("idx") % 3 == 0, "NN").otherwise("XX")
    return staged_once(spark, f"{sf_dir}/lexicon", lambda: corpus.vocab_index(
        run_counts(spark, sf_dir)).select("word", tag.alias("tag")))


def norm_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of five and more letters that end in s, without it."""
    return clean_counts(spark, sf_dir).filter(
        (F.length("word") >= 5) & F.col("word").endswith("s")).select(
        "word", F.expr("left(word, length(word) - 1)").alias("norm"))

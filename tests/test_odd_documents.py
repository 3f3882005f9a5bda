"""Queries over documents that the given tables do not hold."""

from pyspark.sql import functions as F

from checks.spark_queries import QUERIES
from pairlens.functions import text as T
from pairlens.operators import corpus, fuzzy, nouns, vectors as V
from pairlens.sources import derived
from pairlens.staging import stage
from tests.conftest import by_id


def test_lengths_of_empty_texts_divide_to_zero(spark, tmp_path):
    texts = ["abcd", "", "abcdef", "abcdefgh", "x" * 11]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.id >> 31, r.id & (1 << 31) - 1): r.value for r in QUERIES["finite_or_zero"](spark, str(tmp_path)).collect()}
    assert got == {(0, 1): 0.0, (1, 2): 0.0, (2, 3): 0.75, (3, 4): 0.0}


def test_words_are_counted_from_stored_texts_as_from_cells(spark, pairs):
    doubled = stage(pairs.unionByName(pairs.withColumn("id", F.col("id") + 100)), "doubled-pairs")
    texts, cells = corpus.distinct_texts(doubled), corpus.question_cells(doubled)
    for tokens in (T.clean_tokens, T.word_runs):
        want = {r.word: r.cnt for r in corpus.token_counts(cells, tokens).collect()}
        assert want and {r.word: r.cnt for r in corpus.token_counts(texts, tokens).collect()} == want
    assert sorted(corpus.tfidf_fit(texts).collect()) == sorted(corpus.tfidf_fit(cells).collect())


def test_texts_at_hand_give_the_same_features(spark, pairs):
    texts, counts = corpus.distinct_texts(pairs), stage(corpus.token_counts(corpus.question_cells(pairs), T.word_runs), "run-counts")
    lexicon = counts.select("word", F.when(F.col("cnt") > 1, "NN").otherwise("XX").alias("tag"))
    vectors = stage(counts.select("word", F.array(F.col("cnt").cast("double"), F.length("word").cast("double")).alias("vec")), "vectors")
    for build in (lambda **k: nouns.noun_match(pairs, lexicon, counts, **k), lambda **k: V.sentence_vectors(pairs, vectors, counts, **k),
                  lambda **k: V.relaxed_wmd(pairs, vectors, counts, **k), lambda **k: fuzzy.fuzz_ratios(pairs, **k)):
        assert by_id(build(texts=texts)) == by_id(build())


def test_a_first_document_from_another_block_and_a_repeated_one(spark):
    """Texts of both sides are read from one shuffle: a text sent to a block is no second document there."""
    line = "a line that is certainly longer than forty characters"
    rows = [(0, f"{line}\nfirst"), (1, "next"), (300, f"{line}\nfar"), (301, "next to far"), (600, f"{line}\nfarther"), (600, "again"), (None, line)]
    docs = stage(spark.createDataFrame(rows, "doc_id long, text string"), "far-docs")
    got = sorted((r.id1, r.id2, r.question1, r.question2) for r in derived.build_pairs(docs).collect())
    text = {i: t for i, t in rows[:5]}
    assert got == sorted([(0, 1, text[0], "next"), (0, 300, text[0], text[300]), (300, 301, text[300], "next to far"),
                          (0, 600, text[0], text[600]), (0, 600, text[0], "again")])

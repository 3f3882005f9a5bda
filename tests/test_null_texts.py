"""Operators on tables a user passes, in which a text may be NULL: every id comes back, with what a space gives."""

import pytest
from pyspark.sql import functions as F

from pairlens.functions import text as T
from pairlens.operators import corpus, fuzzy, nouns, vectors
from pairlens.sources.pairs import fill_text

ROWS = [(1, "red apple pie", "red apple"), (2, None, "red pie"), (3, "green apple", None), (4, None, None), (5, "", "pie")]


def _tfidf(pairs):
    cells = corpus.question_cells(pairs)
    texts = corpus.distinct_texts(pairs)
    return corpus.tfidf_features(pairs, texts, corpus.tfidf_weights(texts, corpus.tfidf_fit(cells), cells.count()))


def _counts(pairs, tokens):
    return corpus.token_counts(corpus.question_cells(pairs), tokens)


def _vectors(spark):
    return spark.createDataFrame([("red", [1.0, 0.0]), ("apple", [0.0, 1.0]), ("pie", [1.0, 1.0])], "word string, vec array<double>")


def _lexicon(spark):
    return spark.createDataFrame([("apple", "NN"), ("pie", "NN"), ("red", "JJ")], "word string, tag string")


OPERATORS = {
    "tfidf_features": lambda s, p: _tfidf(p),
    "texts_to_sequences": lambda s, p: corpus.texts_to_sequences(p, corpus.vocab_index(_counts(p, T.sequence_tokens))),
    "question_nouns": lambda s, p: nouns.question_nouns(p, _lexicon(s), _counts(p, T.word_runs)),
    "sentence_vectors": lambda s, p: vectors.sentence_vectors(p, _vectors(s), _counts(p, T.alpha_words)),
    "word_centroid_distance": lambda s, p: vectors.word_centroid_distance(p, _vectors(s), _counts(p, T.plain_words)),
    "levenshtein_ratio": lambda s, p: fuzzy.levenshtein_ratio(p),
    "fuzz_ratios": lambda s, p: fuzzy.fuzz_ratios(p),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_every_id_comes_back(spark, name):
    pairs = spark.createDataFrame(ROWS, "id long, question1 string, question2 string").withColumn("split", F.lit("train"))
    got = OPERATORS[name](spark, pairs).collect()
    assert sorted(r.id for r in got) == [1, 2, 3, 4, 5]
    assert {r.id: r for r in got} == {r.id: r for r in OPERATORS[name](spark, fill_text(pairs)).collect()}


def test_mapped_words_come_back_for_every_id(spark):
    from pairlens.operators.nouns import map_tokens
    rows = [(1, ["cats", "x"], ["x"]), (2, ["cats", "x"], []), (3, None, ["a|b", "cats", "cats"]), (4, ["x"], ["cats", "x"]), (4, ["x"], ["cats", "x"])]
    tokens = spark.createDataFrame(rows, "id long, words1 array<string>, words2 array<string>")
    words = lambda *values: spark.createDataFrame(values, "word string, norm string")
    counts = spark.createDataFrame([("cats", 5), ("x", 5)], "word string, cnt long")
    for hot_keys in (1, 10_000):
        got = sorted((r.id, r.words1, r.words2) for r in map_tokens(tokens, words(("cats", "cat")), counts, hot_keys).collect())
        assert got == [(1, ["cat", "x"], ["x"]), (2, ["cat", "x"], []), (3, [], ["a|b", "cat", "cat"]),
                       (4, ["x"], ["cat", "x"]), (4, ["x"], ["cat", "x"])]

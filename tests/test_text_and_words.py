import pytest
from pyspark.sql import functions as F

from pairlens.functions import text as T
from pairlens.operators import assemble, corpus, nouns, words
from pairlens.staging import stage
from tests.conftest import by_id


def show(pairs, build):
    return {r["id"]: (r["a"], r["b"]) for r in pairs.select(
        "id", build(F.col("question1")).alias("a"), build(F.col("question2")).alias("b")).collect()}


def test_clean_text_removes_stop_words_before_punctuation(pairs):
    got = show(pairs, T.clean_text)
    assert got[1] == ("learn spark ", "best way learn spark ")
    assert got[4] == ("", "it ")
    assert got[2][0] == "why "
    assert got[6] == ("visit usa", "visit uk")            # "now" is a stop word, and nothing follows
    assert got[7] == (" ber  cole", " cole  ber")


def test_contractions_are_live_only_when_they_go_first(pairs):
    keep = {"remove_stopwords": False}
    assert show(pairs, lambda t: T.clean_text(t, **keep))[5][0] == "what s new  can t wait"
    assert show(pairs, lambda t: T.clean_text(t, legacy=False, **keep))[5] == (
        "what is new  cannot  wait", "i am sure they will  show")


def test_synonyms_need_spaces_on_both_sides(spark):
    df = spark.createDataFrame([(1, "in usa now", "usa now")], "id int, question1 string, question2 string")
    assert show(df, T.synonym_rewrites)[1] == ("in america now", "usa now")


def test_tokenisers(pairs):
    assert show(pairs, T.clean_tokens)[4] == ([], ["it"])
    assert show(pairs, T.alpha_words)[5] == (["new", "wait"], ["sure", "show"])
    assert show(pairs, T.term_tokens)[5][0] == ["what", "new", "can", "wait"]
    assert show(pairs, T.sequence_tokens)[5][0] == ["what's", "new", "can't", "wait"]
    assert show(pairs, T.alpha_words)[7] == (["über", "école"], ["école", "über"])
    assert show(pairs, T.plain_words)[8] == (["data"] * 3, ["data", "lake"])
    assert show(pairs, T.tfidf_terms)[8] == (["data", "data", "data", "data data", "data data"], ["data", "lake", "data lake"])
    assert show(pairs, T.tfidf_terms)[3][0] == []


def test_word_set_features(pairs):
    got = by_id(words.word_set_features(words.clean_pairs(pairs)))
    assert got[1]["common_words"] == 2 and got[1]["total_unique_words"] == 4
    assert got[1]["wc_ratio"] == 0.5 and got[1]["same_start"] == 0
    assert got[2]["char_diff"] == 0 and got[2]["char_ratio"] == 1.0 and got[2]["same_start"] == 1
    # one empty side: NULL only when it is the second one
    assert got[4]["wc_ratio"] == 0.0 and got[4]["same_start"] is None
    assert got[3]["wc_ratio"] == 0.0
    # repeats count for wc_diff, not for the distinct form
    assert got[8]["wc_diff"] == 1 and got[8]["wc_diff_unique"] == 1
    assert got[10]["total_unique_words"] == 45


def test_ratio_is_null_when_the_second_side_is_empty(spark):
    df = spark.createDataFrame([(1, "data", "the")], "id long, question1 string, question2 string")
    row = words.word_set_features(words.clean_pairs(df)).first()
    assert row["wc_ratio"] is None and row["char_ratio"] is None and row["same_start"] is None
    assert assemble.fill_zero(words.word_set_features(words.clean_pairs(df))).first()["wc_ratio"] == 0.0


def test_surface_features(pairs):
    got = by_id(words.surface_features(pairs))
    assert got[1]["caps_count_q1"] == 3 and got[7]["caps_count_q1"] == 6 and got[7]["diff_caps"] == 6
    assert got[1]["q1_how"] == 1 and got[1]["q2_what"] == 1 and got[1]["how_both"] == 0
    assert got[5]["q2_how"] == 1  # inside "show"
    assert got[2]["why_both"] == 1


def word_share(pairs, spark, **options):
    counts = corpus.token_counts(corpus.question_cells(pairs))
    return by_id(words.word_match_share(words.clean_pairs(pairs), corpus.word_weights(counts), **options))


@pytest.mark.parametrize("hot_keys", [10_000, 3])
def test_word_match_share_with_and_without_cold_words(pairs, spark, hot_keys):
    got = word_share(pairs, spark, hot_keys=hot_keys)
    assert got[2]["tfidf_wm"] == 1.0                      # "why" in both, counted twice
    assert got[4]["tfidf_wm"] == 0                        # an empty side
    assert got[11]["tfidf_wm"] == 0.0                     # nothing shared
    learn, spark_, best = 1 / 10002, 1 / 10002, 0.0       # single words weigh nothing
    assert got[1]["tfidf_wm"] == pytest.approx(2 * (learn + spark_) / (2 * (learn + spark_) + best))
    assert got[9]["tfidf_wm"] is None                     # only weightless words: 0 / 0


def test_word_weights(spark):
    counts = spark.createDataFrame([("a", 1), ("b", 2)], "word string, cnt long")
    assert {r.word: r.weight for r in corpus.word_weights(counts).collect()} == {"a": 0.0, "b": 1 / 10002}


@pytest.mark.parametrize("hot_keys", [10_000, 3])
def test_tfidf_features(spark, hot_keys):
    import math
    df = spark.createDataFrame([(1, "red fish", "red"), (2, "blue", "")], "id long, question1 string, question2 string")
    frequencies = corpus.tfidf_fit(corpus.question_cells(df))
    texts = corpus.distinct_texts(df)
    got = by_id(corpus.tfidf_features(df, texts, corpus.tfidf_weights(texts, frequencies, 4, hot_keys=hot_keys)))
    red, rare = math.log(5 / 3) + 1, math.log(5 / 2) + 1
    assert got[1]["z_tfidf_len1"] == 3 and got[1]["z_tfidf_sum2"] == 1.0
    assert got[1]["z_tfidf_sum1"] == pytest.approx((red + 2 * rare) / math.sqrt(red ** 2 + 2 * rare ** 2))
    assert got[1]["z_tfidf_mean1"] == pytest.approx(got[1]["z_tfidf_sum1"] / 3)
    assert got[2]["z_tfidf_sum2"] == 0.0 and got[2]["z_tfidf_len2"] == 0


@pytest.mark.parametrize("hot_keys", [10_000, 3])
def test_sequences_and_padding(pairs, hot_keys):
    counts = corpus.token_counts(corpus.question_cells(pairs), T.sequence_tokens)
    vocabulary = corpus.vocab_index(counts)
    ranked = vocabulary.orderBy("idx").collect()
    assert [r.idx for r in ranked] == list(range(1, len(ranked) + 1))
    assert ranked == sorted(ranked, key=lambda r: (-r.cnt, r.word))
    index = {r.word: r.idx for r in ranked}
    seq = corpus.texts_to_sequences(pairs, vocabulary, hot_keys=hot_keys)
    padded = by_id(seq.select("id", "seq1", corpus.pad_sequence(F.col("seq1")).alias("p1"),
                              corpus.pad_sequence(F.col("seq2")).alias("p2")))
    assert padded[8]["seq1"] == [index["data"]] * 3
    assert padded[8]["p1"] == [0] * 37 + [index["data"]] * 3
    assert padded[10]["p1"] == [index[f"w{i}"] for i in range(5, 45)]
    assert padded[3]["p1"] == [0] * 40
    for cap in (index["data"], index["data"] + 1):
        capped = by_id(corpus.texts_to_sequences(pairs, vocabulary, cap=cap))
        assert capped[8]["seq1"] == ([] if cap == index["data"] else [index["data"]] * 3)


@pytest.mark.parametrize("hot_keys", [10_000, 2])
def test_nouns_and_mapping(spark, hot_keys):
    df = spark.createDataFrame([(1, "cats see cats", "no cats here dogs"), (2, "run", "cats")],
                               "id long, question1 string, question2 string")
    lexicon = spark.createDataFrame([("cats", "NNS"), ("dogs", "NN"), ("run", "VB")], "word string, tag string")
    counts = corpus.token_counts(corpus.question_cells(df), T.word_runs)
    got = by_id(nouns.question_nouns(df, lexicon, counts, hot_keys=hot_keys))
    assert got[1]["nouns1"] == ["cats", "cats"] and got[1]["nouns2"] == ["cats", "dogs"] and got[2]["nouns1"] == []
    assert {r.id: r.noun_match for r in nouns.noun_match(df, lexicon, counts).collect()} == {1: 2, 2: 0}
    tokens = df.select("id", T.word_runs(F.col("question1")).alias("words1"), T.word_runs(F.col("question2")).alias("words2"))
    norms = spark.createDataFrame([("cats", "cat")], "word string, norm string")
    mapped = by_id(nouns.map_tokens(tokens, norms, counts, hot_keys=hot_keys))
    assert mapped[1]["words1"] == ["cat", "see", "cat"] and mapped[1]["words2"] == ["no", "cat", "here", "dogs"]


def test_word_set_features_make_each_list_distinct_once(spark):
    df = spark.createDataFrame([(1, ["a", "the", "a"], ["the", "b"]), (2, None, []), (3, ["the"], ["the"])], "id long, words1 array<string>, words2 array<string>")
    found = words.word_set_features(df, ["the"])
    assert found._jdf.queryExecution().optimizedPlan().toString().count("array_distinct(") == 2
    got = by_id(found)
    assert got[1]["total_unq_words_stop"] == 2 and got[1]["total_unique_words"] == 3 and got[3]["total_unq_words_stop"] == 0


def test_nouns_of_pairs_move_with_their_texts_and_not_word_by_word(spark):
    """An id that comes twice has the nouns of both its rows; a lexicon word that comes twice counts twice."""
    rows = [(1, "cats cats dogs", "dogs"), (1, "cats dogs", "cats birds"), (2, "birds", "birds birds"), (3, None, "cats"), (None, "cats", "cats")]
    df = stage(spark.createDataFrame(rows, "id long, question1 string, question2 string"), "noun-pairs")
    lexicon = spark.createDataFrame([("cats", "NN"), ("dogs", "NNS"), ("dogs", "NN"), ("birds", "XX")], "word string, tag string")
    counts = corpus.token_counts(corpus.question_cells(df), T.word_runs)
    for block_bytes in (1, 16 << 20):
        matched = nouns.noun_match(df, lexicon, counts, block_bytes=block_bytes)
        assert sorted(((r.id or 0), r.noun_match) for r in matched.collect()) == [(0, 0), (1, 7), (1, 7), (2, 0), (3, 0)]
        # No row of id and noun is made or grouped: blocks of pairs meet lists of nouns.
        plan = matched._jdf.queryExecution().optimizedPlan().toString()
        assert "FlatMapCoGroupsInArrow" in plan and "nouns1" not in plan

"""One query per operator, over the derived pairs of a data folder.

Counts leave as bigint and floats rounded to six places, so that they compare
with SQL; ratios of two counts are exact on both sides and stay as they are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import DoubleType, IntegerType

from pairlens.functions import text as T
from pairlens.operators import assemble as A, corpus as G, fuzzy as Z, graph as N, models as M, nouns as P
from pairlens.operators import vectors as V, words as W
from pairlens.plans.features import feature_table as build_feature_table
from pairlens.sources import derived as D, pairs as S
from pairlens.staging import new_path, stage, staged_once

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
RATIOS = ("wc_ratio", "wc_ratio_unique", "wc_ratio_unique_stop", "char_ratio")


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def out(df: DataFrame, places: int = 6, exact: tuple[str, ...] = RATIOS) -> DataFrame:
    def shape(field):
        c = F.col(field.name)
        if isinstance(field.dataType, IntegerType):
            c = c.cast("bigint")
        elif isinstance(field.dataType, DoubleType) and field.name not in exact:
            c = F.round(c, places) + F.lit(0.0)
        return c.alias(field.name)
    return df.select([shape(f) for f in df.schema.fields])


def per_text(name: str, build: Callable) -> None:
    """A query that shows a text or token expression for both questions, arrays joined by `|`."""
    def run(spark, sf_dir):
        exprs = [build(F.col(f"question{n}")) for n in (1, 2)]
        return D.pairs(spark, sf_dir).select("id", *[e.alias(f"out{n}") for n, e in enumerate(exprs, 1)])
    run.__name__ = name
    query(run)


def joined(tokens: Callable) -> Callable:
    return lambda text: F.array_join(tokens(text), "|")


per_text("clean_text", T.clean_text)
per_text("clean_text_contractions_first", lambda t: T.clean_text(t, legacy=False))
per_text("clean_text_with_stop_words", lambda t: T.clean_text(t, remove_stopwords=False))
per_text("clean_tokens", joined(T.clean_tokens))
per_text("stop_filter", joined(T.plain_words))
per_text("contraction_rewrites", lambda t: T.contraction_rewrites(F.lower(t)))
per_text("synonym_rewrites", lambda t: T.synonym_rewrites(F.lower(t)))
per_text("alpha_words", joined(T.alpha_words))
per_text("term_tokens", joined(T.term_tokens))
per_text("sequence_tokens", joined(T.sequence_tokens))
per_text("bigrams", joined(T.tfidf_terms))
per_text("token_sort_key", lambda t: Z.token_sort_key(Z.normalise(t)))


# Tables several queries share -----------------------------------------------------------------

def _cells(spark, sf_dir):
    return G.question_cells(D.pairs(spark, sf_dir))


def _shared(spark, sf_dir, name, build):
    return staged_once(spark, f"{sf_dir}/{name}", build)


def _texts(spark, sf_dir):
    return D.texts(spark, sf_dir)


def _clean(spark, sf_dir):
    """Cleaned words of every pair, stored: cleaning whole texts costs far more than reading their words again."""
    return staged_once(spark, f"{sf_dir}/clean-pairs", lambda: stage(W.clean_pairs(D.pairs(spark, sf_dir)), "clean-pairs", codec="zstd"), staged=True)


def _weights(spark, sf_dir):
    return _shared(spark, sf_dir, "weights", lambda: G.word_weights(D.clean_counts(spark, sf_dir)))


def _frequencies(spark, sf_dir):
    return _shared(spark, sf_dir, "term-frequencies", lambda: G.tfidf_fit(_texts(spark, sf_dir)))


def _tfidf(spark, sf_dir):
    return G.tfidf_weights(_texts(spark, sf_dir), _frequencies(spark, sf_dir), 2 * D.pairs(spark, sf_dir).count())


def _counts(spark, sf_dir, name, tokens):
    return _shared(spark, sf_dir, f"{name}-counts", lambda: G.token_counts(_texts(spark, sf_dir), tokens))


def _vocabulary(spark, sf_dir):
    return _shared(spark, sf_dir, "sequence-vocabulary",
                   lambda: G.vocab_index(_counts(spark, sf_dir, "sequence", T.sequence_tokens)))


def _multi(spark, sf_dir):
    return _shared(spark, sf_dir, "multi-edges", lambda: N.multi_edges(D.pairs(spark, sf_dir)))


def _nodes(spark, sf_dir):
    return _shared(spark, sf_dir, "nodes", lambda: N.graph_nodes(_multi(spark, sf_dir)))


def _ranks(spark, sf_dir):
    return _shared(spark, sf_dir, "ranks", lambda: N.pagerank(_multi(spark, sf_dir), _nodes(spark, sf_dir)))


def _sentence_vectors(spark, sf_dir):
    return _shared(spark, sf_dir, "sentence-vectors", lambda: V.sentence_vectors(
        D.pairs(spark, sf_dir), D.word_vectors(spark, sf_dir), _counts(spark, sf_dir, "alpha", T.alpha_words), texts=_texts(spark, sf_dir)))


def _features(spark, sf_dir):
    return _shared(spark, sf_dir, "features", lambda: build_feature_table(
        D.pairs(spark, sf_dir), D.word_vectors(spark, sf_dir), D.lexicon(spark, sf_dir)))


def _scores(spark, sf_dir):
    """Nine scores and a second one per pair, from the lengths of its texts; some are missing."""
    n1, n2 = F.length("question1"), F.length("question2")
    folds = [((n1 * i + n2) % 101 / F.lit(101.0)).alias(f"fold{i}") for i in range(1, 10)]
    second = F.when(n1 % 5 != 0, n2 % 97 / F.lit(97.0)).alias("score")
    return D.pairs(spark, sf_dir).select("id", "is_duplicate", *folds, second)


# Sources and sinks ----------------------------------------------------------------------------

@query
def read_pairs_csv(spark, sf_dir):
    pairs = D.pairs(spark, sf_dir)
    train, test = new_path(spark, "train-csv"), new_path(spark, "test-csv")
    S.write_pairs_csv(pairs.filter("split = 'train'"), train)
    S.write_pairs_csv(pairs.filter("split = 'test'"), test, labelled=False)
    return out(S.load_pairs(spark, train, test).select(
        "id", "id1", "id2", F.md5("question1").alias("q1_md5"), F.md5("question2").alias("q2_md5"),
        "is_duplicate", "split"))


@query
def feature_table_round_trip(spark, sf_dir):
    path = new_path(spark, "feature-table")
    S.write_feature_table(W.surface_features(D.pairs(spark, sf_dir)), path)
    return out(S.read_feature_table(spark, path, "id", "caps_count_q1", "q1_how"))


@query
def feature_table_csv(spark, sf_dir):
    path = new_path(spark, "feature-table-csv")
    S.write_feature_table(W.surface_features(D.pairs(spark, sf_dir)).select("id", "diff_caps", "why_both"), path, "csv")
    return spark.read.csv(path, header=True, schema="id bigint, diff_caps bigint, why_both bigint")


@query
def write_predictions(spark, sf_dir):
    path = new_path(spark, "submission")
    S.write_predictions(_scores(spark, sf_dir), path, "fold1")
    return out(spark.read.csv(path, header=True, schema="Id bigint, Score double"))


@query
def write_members(spark, sf_dir):
    path = new_path(spark, "members")
    folds = [f"fold{i}" for i in range(1, 10)]
    S.write_members(_scores(spark, sf_dir).select("id", *folds), path)
    return out(spark.read.csv(path, header=True, schema="id bigint, " + ", ".join(f"{f} double" for f in folds)))


@query
def read_word_vectors_text(spark, sf_dir):
    path = new_path(spark, "vectors-text")
    S.write_word_vectors_text(D.word_vectors(spark, sf_dir), path)
    return out(S.read_word_vectors_text(spark, path).select("word", F.posexplode("vec").alias("pos", "x")))


# Characters and words -------------------------------------------------------------------------

@query
def surface_features(spark, sf_dir):
    return out(W.surface_features(D.pairs(spark, sf_dir)))


@query
def word_set_features(spark, sf_dir):
    return out(W.word_set_features(W.clean_pairs(D.pairs(spark, sf_dir))))


@query
def fill_zero(spark, sf_dir):
    features = W.word_set_features(W.clean_pairs(D.pairs(spark, sf_dir)))
    return out(A.fill_zero(features.select("id", "wc_ratio", "same_start", "char_ratio")))


@query
def word_match_share(spark, sf_dir):
    return out(W.word_match_share(_clean(spark, sf_dir), _weights(spark, sf_dir)))


@query
def map_tokens(spark, sf_dir):
    mapped = P.map_tokens(W.clean_pairs(D.pairs(spark, sf_dir)), D.norm_dictionary(spark, sf_dir),
                          D.clean_counts(spark, sf_dir))
    return mapped.select("id", F.array_join("words1", "|").alias("out1"), F.array_join("words2", "|").alias("out2"))


# Corpus ---------------------------------------------------------------------------------------

@query
def corpus_word_counts(spark, sf_dir):
    return G.token_counts(_cells(spark, sf_dir))


@query
def word_weights(spark, sf_dir):
    return out(G.word_weights(G.token_counts(_cells(spark, sf_dir))), places=12)


@query
def word_weights_train_only(spark, sf_dir):
    cells = G.question_cells(D.pairs(spark, sf_dir), fit_on="train")
    return out(G.word_weights(G.token_counts(cells)), places=12)


@query
def tfidf_fit(spark, sf_dir):
    return G.tfidf_fit(_cells(spark, sf_dir))


@query
def tfidf_transform(spark, sf_dir):
    per_text = G.tfidf_transform(_tfidf(spark, sf_dir)).groupBy("key").agg(
        F.count("*").alias("terms"), F.sum("weight").alias("total"), F.max("weight").alias("largest"),
        F.min("weight").alias("smallest"), F.sum(F.col("weight") * F.col("weight")).alias("square"))
    cells = _cells(spark, sf_dir).select("id", "side", F.md5("text").alias("key"))
    return out(cells.join(per_text, "key").drop("key"))


@query
def tfidf_features(spark, sf_dir):
    return out(G.tfidf_features(D.pairs(spark, sf_dir), _texts(spark, sf_dir), _tfidf(spark, sf_dir)))


@query
def vocab_index(spark, sf_dir):
    return G.vocab_index(_counts(spark, sf_dir, "sequence", T.sequence_tokens))


@query
def texts_to_sequences(spark, sf_dir):
    seq = G.texts_to_sequences(D.pairs(spark, sf_dir), _vocabulary(spark, sf_dir), texts=_texts(spark, sf_dir))
    show = lambda c: F.array_join(F.col(c).cast("array<string>"), " ")
    return seq.select("id", show("seq1").alias("out1"), show("seq2").alias("out2"))


@query
def pad_sequences(spark, sf_dir):
    seq = G.texts_to_sequences(D.pairs(spark, sf_dir), _vocabulary(spark, sf_dir), texts=_texts(spark, sf_dir))
    show = lambda c: F.array_join(G.pad_sequence(F.col(c)).cast("array<string>"), " ")
    return seq.select("id", show("seq1").alias("out1"), show("seq2").alias("out2"))


# Graph ----------------------------------------------------------------------------------------

@query
def pair_edges(spark, sf_dir):
    return N.pair_edges(N.multi_edges(D.pairs(spark, sf_dir)))


@query
def multi_edges(spark, sf_dir):
    return N.multi_edges(D.pairs(spark, sf_dir))


@query
def neighbour_counts(spark, sf_dir):
    return N.neighbour_counts(D.pairs(spark, sf_dir), _nodes(spark, sf_dir))


@query
def common_neighbours(spark, sf_dir):
    overlaps = _shared(spark, sf_dir, "overlaps",
                       lambda: N.edge_overlaps(_multi(spark, sf_dir), _nodes(spark, sf_dir)))
    return N.common_neighbours(D.pairs(spark, sf_dir), overlaps)


@query
def pagerank(spark, sf_dir):
    return out(N.pagerank(_multi(spark, sf_dir), _nodes(spark, sf_dir)), places=10)


@query
def rank_features(spark, sf_dir):
    return out(N.rank_features(D.pairs(spark, sf_dir), _nodes(spark, sf_dir), _ranks(spark, sf_dir)), places=10)


# Vectors --------------------------------------------------------------------------------------

@query
def sentence_vectors(spark, sf_dir):
    vectors = V.sentence_vectors(D.pairs(spark, sf_dir), D.word_vectors(spark, sf_dir),
                                 _counts(spark, sf_dir, "alpha", T.alpha_words), texts=_texts(spark, sf_dir))
    both = F.arrays_zip(F.col("vec1").alias("x"), F.col("vec2").alias("y"))
    return out(vectors.select("id", F.posexplode(both).alias("pos", "v")).select("id", "pos", "v.x", "v.y"),
               places=V.VECTOR_PLACES)


@query
def vector_distances(spark, sf_dir):
    return out(V.vector_distances(_sentence_vectors(spark, sf_dir)))


@query
def relaxed_wmd(spark, sf_dir):
    return out(V.relaxed_wmd(D.pairs(spark, sf_dir), D.word_vectors(spark, sf_dir),
                             _counts(spark, sf_dir, "plain", T.plain_words), texts=_texts(spark, sf_dir)))


@query
def unit_vectors(spark, sf_dir):
    return out(V.unit_vectors(D.word_vectors(spark, sf_dir)).select("word", F.posexplode("vec").alias("pos", "x")))


@query
def word_centroid_distance(spark, sf_dir):
    return out(V.word_centroid_distance(D.pairs(spark, sf_dir), D.word_vectors(spark, sf_dir),
                                        _counts(spark, sf_dir, "plain", T.plain_words), texts=_texts(spark, sf_dir)))


@query
def embedding_table(spark, sf_dir):
    table = V.embedding_table(_vocabulary(spark, sf_dir), D.word_vectors(spark, sf_dir))
    total = F.when(~F.col("is_oov"), F.aggregate("vec", F.lit(0.0), lambda s, x: s + x))
    return out(table.select("idx", "word", "is_oov", F.size("vec").alias("width"), total.alias("vec_sum")))


@query
def embedding_coverage(spark, sf_dir):
    return V.embedding_coverage(V.embedding_table(_vocabulary(spark, sf_dir), D.word_vectors(spark, sf_dir)))


# Fuzzy ----------------------------------------------------------------------------------------

@query
def fuzz_ratios(spark, sf_dir):
    return out(Z.fuzz_ratios(D.pairs(spark, sf_dir)))


@query
def token_set_key(spark, sf_dir):
    normal = D.pairs(spark, sf_dir).select("id", *[Z.normalise(F.col(f"question{n}")).alias(f"n{n}") for n in (1, 2)])
    return normal.select("id", *[c.alias(n) for n, c in Z.token_set_key(F.col("n1"), F.col("n2")).items()])


@query
def levenshtein_ratio(spark, sf_dir):
    return out(Z.levenshtein_ratio(D.pairs(spark, sf_dir)))


# Nouns ----------------------------------------------------------------------------------------

@query
def question_nouns(spark, sf_dir):
    nouns = P.question_nouns(D.pairs(spark, sf_dir), D.lexicon(spark, sf_dir), D.run_counts(spark, sf_dir), texts=_texts(spark, sf_dir))
    return nouns.select("id", F.array_join("nouns1", "|").alias("out1"), F.array_join("nouns2", "|").alias("out2"))


@query
def noun_match(spark, sf_dir):
    return P.noun_match(D.pairs(spark, sf_dir), D.lexicon(spark, sf_dir), D.run_counts(spark, sf_dir), texts=_texts(spark, sf_dir))


# Assembly -------------------------------------------------------------------------------------

@query
def union_corpus(spark, sf_dir):
    pairs = D.pairs(spark, sf_dir)
    train, test = pairs.filter("split = 'train'"), pairs.filter("split = 'test'")
    both = S.union_corpus(train.drop("split"), test.drop("split", "is_duplicate"))
    return both.groupBy("split").agg(F.count("*").alias("pairs"), F.sum("is_duplicate").alias("duplicates"))


@query
def assemble_features(spark, sf_dir):
    pairs = D.pairs(spark, sf_dir)
    table = A.assemble(
        pairs.select("id", "is_duplicate", "split"), W.surface_features(pairs),
        W.word_set_features(_clean(spark, sf_dir)), W.word_match_share(_clean(spark, sf_dir), _weights(spark, sf_dir)),
        N.neighbour_counts(pairs, _nodes(spark, sf_dir)), V.vector_distances(_sentence_vectors(spark, sf_dir)))
    return out(A.finite_or_zero(table))


@query
def feature_table(spark, sf_dir):
    return out(_features(spark, sf_dir).drop("question1", "question2"))


@query
def finite_or_zero(spark, sf_dir):
    n1, n2 = F.length("question1"), F.length("question2")
    odd = (F.when(n1 % 7 == 0, F.lit(float("inf"))).when(n1 % 7 == 1, F.lit(float("-inf")))
           .when(n1 % 7 == 2, F.lit(float("nan"))).when(n1 % 7 != 3, F.try_divide(n1, n2)))
    return out(A.finite_or_zero(D.pairs(spark, sf_dir).select("id", odd.alias("value"))))


@query
def standard_scale(spark, sf_dir):
    features = W.surface_features(D.pairs(spark, sf_dir)).select("id", "caps_count_q1", "diff_caps", "why_both")
    lengths = features.withColumn("constant", F.lit(3.0))
    return out(A.standard_scale(lengths, ["caps_count_q1", "diff_caps", "why_both", "constant"]))


@query
def null_audit(spark, sf_dir):
    features = W.word_set_features(W.clean_pairs(D.pairs(spark, sf_dir)))
    return out(A.null_audit(features, ["wc_diff", "wc_ratio", "wc_ratio_unique_stop", "same_start", "char_ratio"]))


@query
def holdout_split(spark, sf_dir):
    return A.holdout_split(D.pairs(spark, sf_dir).select("id"))


@query
def symmetric_augment(spark, sf_dir):
    rows = A.symmetric_augment(D.pairs(spark, sf_dir).select("id", "question1", "question2", "is_duplicate"))
    return out(rows.select("id", "is_swapped", F.md5("question1").alias("q1_md5"), F.md5("question2").alias("q2_md5"),
                           "is_duplicate", "weight"))


# Models and blending --------------------------------------------------------------------------

def _train_and_all(spark, sf_dir):
    table = A.finite_or_zero(_features(spark, sf_dir)).drop("question1", "question2")
    return table.filter("split = 'train'"), table


@query
def random_forest(spark, sf_dir):
    train, every = _train_and_all(spark, sf_dir)
    return out(M.random_forest(train, every, list(A.FEATURES)))


@query
def gbt_ensemble(spark, sf_dir):
    train, every = _train_and_all(spark, sf_dir)
    return out(M.gbt_ensemble(train, every, list(A.FEATURES)))


@query
def embedding_pair_classifier(spark, sf_dir):
    _, every = _train_and_all(spark, sf_dir)
    scaled = A.standard_scale(every, list(A.FEATURES)).join(_sentence_vectors(spark, sf_dir), "id")
    return out(M.embedding_pair_classifier(scaled.filter("split = 'train'"), scaled, list(A.FEATURES)))


@query
def log_loss(spark, sf_dir):
    return out(M.log_loss(_scores(spark, sf_dir), score="fold1"))


@query
def accuracy(spark, sf_dir):
    return out(M.accuracy(_scores(spark, sf_dir), score="fold1"))


@query
def blend(spark, sf_dir):
    scores = _scores(spark, sf_dir)
    second = scores.select("id", M.predict_average(F.col("score"), F.col("score")).alias("score"))
    return out(M.blend_members(scores.drop("score", "is_duplicate"), second))


@query
def blend_best_confidence(spark, sf_dir):
    cols = [F.col(f"fold{i}") for i in range(1, 10)] + [F.col("score")] * 2
    return out(_scores(spark, sf_dir).select("id", M.blend_best_confidence(cols).alias("score")))

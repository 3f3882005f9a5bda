"""The whole feature table, from pairs and word tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from pairlens.functions import text as T
from pairlens.operators import corpus, fuzzy, graph, nouns, vectors, words
from pairlens.operators.assemble import FEATURES, assemble
from pairlens.staging import stage


def feature_table(pairs: DataFrame, word_vectors: DataFrame, lexicon: DataFrame, fit_on: str = "all") -> DataFrame:
    """Ids, texts, label, split and the 66 features, one row per pair.

    `pairs` should be a stored table: every group scans only the columns it needs.
    Corpus tables and cleaned words are staged because several steps read them.
    """
    cells = corpus.question_cells(pairs, fit_on)
    texts = corpus.distinct_texts(pairs)
    counted = texts if fit_on == "all" else cells
    counts: Callable = lambda tokens, name: stage(corpus.token_counts(counted, tokens), name)

    tokens = stage(words.clean_pairs(pairs), "clean-pairs", codec="zstd")
    weights = stage(corpus.word_weights(corpus.token_counts(counted)), "word-weights")
    frequencies = stage(corpus.tfidf_fit(counted), "term-frequencies")
    tfidf = corpus.tfidf_weights(texts, frequencies, cells.count())

    multi = stage(graph.multi_edges(pairs), "multi-edges")
    nodes = stage(graph.graph_nodes(multi), "nodes")
    ranked = stage(nodes.join(graph.pagerank(multi, nodes), "node"), "ranked-nodes")
    node_features = graph.attach_nodes(pairs, ranked, {"degree": ("q1_freq", "q2_freq"), "rank": ("q1_pr", "q2_pr")})
    overlaps = stage(graph.edge_overlaps(multi, nodes), "overlaps")

    sentence = vectors.sentence_vectors(pairs, word_vectors, counts(T.alpha_words, "alpha-counts"), texts=texts)
    groups = [
        node_features, graph.common_neighbours(pairs, overlaps),
        words.surface_features(pairs), words.word_set_features(tokens), words.word_match_share(tokens, weights),
        nouns.noun_match(pairs, lexicon, counts(T.word_runs, "run-counts"), texts=texts),
        corpus.tfidf_features(pairs, texts, tfidf), fuzzy.fuzz_ratios(pairs, texts=texts),
        vectors.relaxed_wmd(pairs, word_vectors, counts(T.plain_words, "plain-counts"), texts=texts),
        vectors.vector_distances(sentence),
    ]
    base = pairs.select("id", "id1", "id2", "question1", "question2", "is_duplicate", "split")
    return assemble(base, *groups).select(*base.columns, *FEATURES)

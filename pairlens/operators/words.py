"""Word-set features over a table `(id, words1, words2)`."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, functions as F

from pairlens.functions import chars, text, words as W
from pairlens.functions.stops import ENGLISH_STOPS
from pairlens.operators.skew import HOT_KEYS, lookup
from pairlens.staging import stage


def clean_pairs(pairs: DataFrame, *keep: str, **options) -> DataFrame:
    """Both texts of every pair as cleaned token arrays."""
    return pairs.select("id", *keep,
                        text.clean_tokens(F.col("question1"), **options).alias("words1"),
                        text.clean_tokens(F.col("question2"), **options).alias("words2"))


def surface_features(pairs: DataFrame) -> DataFrame:
    """Capitals and interrogatives: one narrow pass over the raw texts."""
    q1, q2 = F.col("question1"), F.col("question2")
    columns = chars.caps_features(q1, q2) | chars.interrogative_features(q1, q2)
    return pairs.select("id", *[c.alias(n) for n, c in columns.items()])


def word_set_features(tokens: DataFrame, stops: Iterable[str] = ENGLISH_STOPS) -> DataFrame:
    """The thirteen features that need one row only; no shuffle."""
    stops = list(stops)
    sets = tokens.select("id", "words1", "words2", F.array_distinct("words1").alias("set1"), F.array_distinct("words2").alias("set2"))
    sets = sets.select("*", *[text.stop_filter(F.col(f"set{n}"), stops).alias(f"rest{n}") for n in (1, 2)])
    a, b, sa, sb, ra, rb = (F.col(c) for c in ("words1", "words2", "set1", "set2", "rest1", "rest2"))
    return sets.select(
        "id",
        W.wc_diff(a, b).alias("wc_diff"), W.wc_ratio(a, b).alias("wc_ratio"),
        W.wc_diff(sa, sb).alias("wc_diff_unique"), W.wc_ratio(sa, sb).alias("wc_ratio_unique"),
        W.wc_diff(ra, rb).alias("wc_diff_unq_stop"), W.wc_ratio(ra, rb).alias("wc_ratio_unique_stop"),
        W.same_start(a, b).alias("same_start"), W.char_diff(a, b).alias("char_diff"),
        W.char_diff(ra, rb).alias("char_diff_unq_stop"),
        W.common_words(sa, sb).alias("common_words"), W.total_unique_words(sa, sb).alias("total_unique_words"),
        W.total_unique_words(ra, rb).alias("total_unq_words_stop"), W.char_ratio(a, b).alias("char_ratio"))


def word_match_share(tokens: DataFrame, weights: DataFrame, stops: Iterable[str] = ENGLISH_STOPS,
                     hot_keys: int = HOT_KEYS) -> DataFrame:
    """Share of the pair's word weight that both texts hold, with and without stop words.

    `weights` is `(word, cnt, weight)`. Shared words count twice and others once, so the whole weight is the sum of what
    either side's distinct words weigh. That is summed once per distinct list of words, however many pairs hold it;
    by pair only shared words are looked up, and of these only rare ones move.
    """
    stops = list(stops)
    table = stage(weights.select("word", "cnt", "weight"), "share-weights")
    w, keep = F.col("weight"), ~F.col("word").isin(stops)
    sums = lambda rows, by: lookup(rows, table, "word", "cnt", hot_keys=hot_keys).groupBy(by).agg(
        F.sum(w).alias("s"), F.sum(F.when(keep, w)).alias("s_stop"))

    known = tokens.filter(F.col("words1").isNotNull() & F.col("words2").isNotNull())
    spelled = lambda n: F.to_json(F.array_distinct(f"words{n}"))
    lists = stage(known.select(F.explode(F.array(spelled(1), spelled(2))).alias("words")).groupBy("words").agg(
        F.count("*").alias("mentions")).select(F.md5("words").alias("key"), "words", "mentions"), "word-lists", codec="zstd")
    word = F.explode(F.from_json("words", "array<string>")).alias("word")
    per_list = stage(lists.select("key", "mentions").join(sums(lists.select("key", word), "key"), "key", "left"), "list-weights")

    rows = stage(tokens.select(
        "id", *[F.md5(spelled(n)).alias(f"k{n}") for n in (1, 2)], F.array_intersect("words1", "words2").alias("both"),
        ((F.size("words1") == 0) | (F.size("words2") == 0)).alias("empty"),
        ((F.size(W.without_stops(F.col("words1"), stops)) == 0)
         | (F.size(W.without_stops(F.col("words2"), stops)) == 0)).alias("empty_stop")), "shared-words", codec="zstd")
    shared = sums(rows.select("id", F.explode("both").alias("word")), "id")
    sides = rows.filter(F.col("both").isNotNull()).select("id", "k1", "k2")
    for n in (1, 2):
        side = per_list.select(F.col("key").alias(f"k{n}"), "mentions", F.col("s").alias(f"s{n}"), F.col("s_stop").alias(f"s{n}_stop"))
        sides = lookup(sides, side, f"k{n}", "mentions", hot_keys=hot_keys)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    whole = sides.groupBy("id").agg(F.sum(zero("s1") + zero("s2")).alias("den"), F.sum(zero("s1_stop") + zero("s2_stop")).alias("den_stop"))
    share = lambda end: F.try_divide(2.0 * zero(f"s{end}"), F.col(f"den{end}"))
    return rows.select("id", "empty", "empty_stop").join(whole, "id", "left").join(shared, "id", "left").select(
        "id",
        F.when(F.col("empty"), 0.0).otherwise(share("")).alias("tfidf_wm"),
        F.when(F.col("empty_stop"), 0.0).otherwise(share("_stop")).alias("tfidf_wm_stops"))

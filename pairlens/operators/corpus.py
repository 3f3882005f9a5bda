"""Statistics of the whole corpus: word weights, TF-IDF, vocabulary and sequences."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, Window

from pairlens.functions import text as T
from pairlens.functions.stops import ENGLISH_STOPS
from pairlens.operators import blocks, terms
from pairlens.operators.skew import HOT_KEYS, lookup, lookup_salted
from pairlens.sources.pairs import fill_text
from pairlens.staging import stage

SEQUENCE_LENGTH = 40


def question_cells(pairs: DataFrame, fit_on: str = "all") -> DataFrame:
    """Every question cell as one row `(id, side, text)`; repeats count."""
    if fit_on == "train":
        pairs = pairs.filter(F.col("split") == "train")
    elif fit_on != "all":
        raise ValueError("fit_on is 'all' or 'train'")
    side = lambda n: F.struct(F.lit(n).alias("side"), F.col(f"question{n}").alias("text"))
    return pairs.select("id", F.explode(F.array(side(1), side(2))).alias("cell")).select("id", "cell.side", "cell.text")


def distinct_texts(pairs: DataFrame) -> DataFrame:
    """Every text of the pairs once: `(key, text, mentions, part)`, written out. The key is the MD5 of the text, a missing one being a space.

    Texts of one `part` lie together.
    """
    cells = distinct_cells(question_cells(fill_text(pairs).select("id", "question1", "question2")))
    return stage(cells.select(F.md5("text").alias("key"), "text", "mentions", F.spark_partition_id().alias("part")), "texts", codec="zstd")


def _text_keys(pairs: DataFrame) -> DataFrame:
    return fill_text(pairs).select("id", F.md5("question1").alias("k1"), F.md5("question2").alias("k2"))


def attach_texts(pairs: DataFrame, per_text: DataFrame, columns: dict[str, tuple[str, str]], hot_keys: int = HOT_KEYS) -> DataFrame:
    """Columns of `per_text(key, mentions, ...)` for both texts: `{column: (name for q1, name for q2)}`.

    Every text of `distinct_texts` has a row, so every id comes back. Columns that may be wide belong in `attach_wide`.
    """
    rows = _text_keys(pairs)
    for i in (0, 1):
        table = per_text.select(F.col("key").alias(f"k{i + 1}"), F.col("mentions").alias("_freq"),
                                *[F.col(c).alias(names[i]) for c, names in columns.items()])
        rows = lookup(rows, table, f"k{i + 1}", "_freq", hot_keys=hot_keys)
    return rows.drop("k1", "k2")


def attach_wide(pairs: DataFrame, per_text: DataFrame, column: str, names: tuple[str, str], hot_keys: int = HOT_KEYS) -> DataFrame:
    """The same for one column whose values grow with the text; hot texts are dealt over salts, never broadcast."""
    rows = _text_keys(pairs)
    for i, name in enumerate(names, 1):
        table = per_text.select(F.col("key").alias(f"k{i}"), F.col("mentions").alias("_freq"), F.col(column).alias(name))
        rows = lookup_salted(rows, table, f"k{i}", "_freq", spread=F.col("id"), hot_keys=hot_keys)
    return rows.drop("k1", "k2")


def distinct_cells(cells: DataFrame) -> DataFrame:
    """Every text once, with the number of cells that hold it: `(text, mentions)`; `distinct_texts` of the same pairs has them already."""
    if "mentions" in cells.columns:
        return cells.select("text", "mentions")
    return cells.groupBy("text").agg(F.count("*").alias("mentions"))


def token_counts(cells: DataFrame, tokens: Callable[[Column], Column] = T.clean_tokens) -> DataFrame:
    """Occurrences of every word in all cells, or in `distinct_texts`; a text is taken apart once, however many cells hold it."""
    return (distinct_cells(cells).select("mentions", F.explode(tokens(F.col("text"))).alias("word"))
            .groupBy("word").agg(F.sum("mentions").alias("cnt")))


def word_weights(counts: DataFrame, eps: float = 10_000.0, min_count: float = 2.0) -> DataFrame:
    weight = F.when(F.col("cnt") < min_count, 0.0).otherwise(1.0 / (F.col("cnt") + F.lit(eps)))
    return counts.select("word", "cnt", weight.alias("weight"))


def term_words(text: Column, stops: Iterable[str] = ENGLISH_STOPS) -> Column:
    """The words whose runs of one and two are the terms, `text.tfidf_terms`."""
    return T.stop_filter(T.term_tokens(text), stops)


def tfidf_fit(cells: DataFrame, stops: Iterable[str] = ENGLISH_STOPS, block_bytes: int = blocks.BYTES_OF_A_BLOCK,
              share_bytes: int = terms.BYTES_OF_A_SHARE) -> DataFrame:
    """Document frequency of every 1- and 2-gram; a document is a question cell. `cells` may be `distinct_texts`."""
    words = stage(distinct_cells(cells).select("mentions", blocks.packed(term_words(F.col("text"), stops)).alias("words")), "term-words", codec="zstd")
    return terms.document_frequencies(words, block_bytes, share_bytes)


def tfidf_weights(texts: DataFrame, frequencies: DataFrame, n_documents: int, stops: Iterable[str] = ENGLISH_STOPS,
                  hot_keys: int = HOT_KEYS, block_bytes: int = blocks.BYTES_OF_A_BLOCK, share_bytes: int = terms.BYTES_OF_A_SHARE) -> DataFrame:
    """Raw tf-idf of the texts of `distinct_texts`, before the norm: `(key, terms, tf, w)`, three lists of one length a text.

    Terms meet their frequencies by blocks of texts; `hot_keys` is without effect, as no term is hot there.
    """
    words = blocks.text_words(texts, lambda t: term_words(t, stops), block_bytes)
    return terms.weighted(words, frequencies, n_documents, share_bytes)


def _sum(weights: Column, of: Callable[[Column], Column] = lambda x: x) -> Column:
    return F.aggregate(weights, F.lit(0.0), lambda s, x: s + of(x))


def tfidf_transform(weights: DataFrame) -> DataFrame:
    """Unit-length rows: `(key, term, weight)`."""
    norm = weights.select("key", "terms", "w", F.sqrt(_sum(F.col("w"), lambda x: x * x)).alias("norm"))
    return norm.select("key", "norm", F.inline(F.arrays_zip(F.col("terms").alias("term"), F.col("w").alias("w")))).select(
        "key", "term", (F.col("w") / F.col("norm")).alias("weight"))


def tfidf_features(pairs: DataFrame, texts: DataFrame, weights: DataFrame, hot_keys: int = HOT_KEYS) -> DataFrame:
    """Sum, mean and number of the normalised weights of both texts, 0 for empty texts.

    Three numbers per distinct text, which the pairs look up.
    """
    sums = weights.select("key", _sum(F.col("w")).alias("s"), _sum(F.col("w"), lambda x: x * x).alias("ss"), F.size("w").cast("bigint").alias("n"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    total = F.try_divide("s", F.sqrt("ss"))
    per_text = stage(texts.select("key", "mentions").join(sums, "key", "left").select(
        "key", "mentions", zero(total).alias("sum"), zero(F.try_divide(total, F.col("n"))).alias("mean"),
        F.coalesce("n", F.lit(0).cast("bigint")).alias("len")), "tfidf-texts")
    named = attach_texts(pairs, per_text, {c: (f"z_tfidf_{c}1", f"z_tfidf_{c}2") for c in ("sum", "mean", "len")}, hot_keys)
    return named.select("id", *[f"z_tfidf_{c}{i}" for c in ("sum", "mean", "len") for i in (1, 2)])


def vocab_index(counts: DataFrame) -> DataFrame:
    """Words numbered from 1 by frequency, ties by word: `(word, cnt, idx)`.

    A global sort, written out so that its partitions are fixed, then one count
    per partition gives every row its offset. No task sees the whole vocabulary.
    """
    placed = stage(
        counts.orderBy(F.desc("cnt"), F.asc("word"))
        .select("word", "cnt", F.spark_partition_id().alias("part"),
                F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("pos")), "vocabulary")
    # One row per partition of the sort, however large the vocabulary is.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (placed.groupBy("part").agg(F.count("*").alias("n"))
               .select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")))
    return (placed.join(F.broadcast(offsets), "part")
            .select("word", "cnt", (F.col("offset") + F.col("pos") + 1).alias("idx")))


def _sequences(words: pa.Table, table: pa.Table) -> pa.Table:
    """The numbers of each text's words in order; a word with several numbers gives them all, ascending."""
    names, rows, starts = blocks.by_word(table.sort_by("idx"))
    numbers = table.sort_by("idx")["idx"].combine_chunks().to_numpy(zero_copy_only=False)[rows]
    code, ends = blocks.codes(words["words"], names)
    known = np.flatnonzero(code >= 0)
    text = np.searchsorted(ends, known, side="right")
    lengths = np.bincount(text, weights=np.diff(starts)[code[known]], minlength=len(ends)).astype(np.int64)
    seq = blocks.ragged(pa.array(numbers[blocks.expanded(code[known], starts)], pa.int64()), lengths)
    return pa.table({"key": words["key"], "mentions": words["mentions"], "seq": seq})


def texts_to_sequences(pairs: DataFrame, vocabulary: DataFrame, cap: int | None = None,
                       hot_keys: int = HOT_KEYS, block_bytes: int = blocks.BYTES_OF_A_BLOCK, texts: DataFrame | None = None) -> DataFrame:
    """Both texts as arrays of word numbers; unknown words are dropped, and numbers from `cap` on if one is given.

    `texts` is `distinct_texts(pairs)` where that is at hand.
    """
    known = vocabulary if cap is None else vocabulary.filter(F.col("idx") < cap)
    words = blocks.text_words(texts or distinct_texts(pairs), T.sequence_tokens, block_bytes)
    per_text = stage(blocks.meet(words, known.select("word", "idx"), _sequences, "key string, mentions long, seq array<bigint>"), "sequences")
    return attach_wide(pairs, per_text, "seq", ("seq1", "seq2"), hot_keys)


def pad_sequence(sequence: Column, length: int = SEQUENCE_LENGTH) -> Column:
    """The last `length` numbers, zeros on the left."""
    n = F.size(sequence)
    tail = F.slice(sequence, -F.greatest(F.lit(1), F.least(F.lit(length), n)), F.lit(length))
    return F.concat(F.array_repeat(F.lit(0).cast("bigint"), F.greatest(F.lit(0), F.lit(length) - n)), tail)

"""Cleaning and tokenising, as Column expressions over whole texts."""

from __future__ import annotations

from collections.abc import Iterable
from string import ascii_letters, digits

from pyspark.sql import Column, functions as F

from pairlens.functions.stops import ENGLISH_STOPS

# White space as Python's str.split sees it; \s alone is ASCII in Java.
SPACE = r"[\s\p{Z}\x{0B}\x{1C}-\x{1F}\x{85}]+"

# Spelled out, Java looks characters up in a bit set; as ranges it is seven times slower.
NOT_ALNUM = f"[^{ascii_letters}{digits}]"

# Java's \w is ASCII only, hence the explicit classes.
WORD_CHAR = r"[\p{L}\p{N}_]"

# The contraction rewrites, in the order they are applied.
CONTRACTIONS = (
    ("what's", "what is"),
    ("'s", " "),
    ("'ve", " have "),
    ("can't", "cannot "),
    ("n't", " not "),
    ("i'm", "i am"),
    ("'re", " are "),
    ("'d", " would "),
    ("'ll", " will "),
    ("e-mail", "email"),
)

# The synonym rewrites; they need a space on both sides.
SYNONYMS = ((" usa ", " america "), (" uk ", " england "))

# The characters the sequence tokeniser turns into spaces.
SEQUENCE_FILTERS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~\t\n"


def split_words(text: Column) -> Column:
    """Non-empty runs between white space."""
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def stop_filter(words: Column, stops: Iterable[str] = ENGLISH_STOPS) -> Column:
    """Words outside the stop list; repeats are kept."""
    stops = list(stops)
    return F.filter(words, lambda w: ~w.isin(stops))


def _rewrite(text: Column, rules: Iterable[tuple[str, str]]) -> Column:
    for old, new in rules:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def contraction_rewrites(text: Column) -> Column:
    return _rewrite(text, CONTRACTIONS)


def synonym_rewrites(text: Column) -> Column:
    return _rewrite(text, SYNONYMS)


def clean_text(text: Column, remove_stopwords: bool = True, legacy: bool = True,
               stops: Iterable[str] = ENGLISH_STOPS) -> Column:
    """Lower-case, drop stop words, keep ASCII alphanumerics, apply the rewrites.

    With `legacy` the punctuation goes first, as it always did, so that no
    contraction is left to rewrite; without it the contractions go first.
    """
    words = split_words(F.lower(text))
    if remove_stopwords:
        words = stop_filter(words, stops)
    joined = F.array_join(words, " ")
    if not legacy:
        joined = contraction_rewrites(joined)
    return synonym_rewrites(F.regexp_replace(joined, NOT_ALNUM, " "))


def clean_tokens(text: Column, **options) -> Column:
    return F.filter(F.split(clean_text(text, **options), " "), lambda w: w != "")


def word_runs(text: Column) -> Column:
    """Lower-case words with inner hyphens and apostrophes."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"{WORD_CHAR}+(?:[-']{WORD_CHAR}+)*"), F.lit(0))


def alpha_words(text: Column, stops: Iterable[str] = ENGLISH_STOPS) -> Column:
    """Word runs that are no stop words and hold letters only."""
    return F.filter(stop_filter(word_runs(text), stops), lambda w: w.rlike(r"^\p{L}+$"))


def term_tokens(text: Column) -> Column:
    """Lower-case runs of two or more word characters."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"{WORD_CHAR}{{2,}}"), F.lit(0))


def sequence_tokens(text: Column) -> Column:
    """Lower-case words between spaces and punctuation; apostrophes are kept."""
    blank = " " * len(SEQUENCE_FILTERS)
    return F.filter(F.split(F.translate(F.lower(text), SEQUENCE_FILTERS, blank), " "), lambda w: w != "")


def plain_words(text: Column, stops: Iterable[str] = ENGLISH_STOPS) -> Column:
    """Lower-case words between white space, without stop words."""
    return stop_filter(split_words(F.lower(text)), stops)


def bigrams(words: Column) -> Column:
    """The words, followed by each pair of neighbours."""
    shifted = F.slice(words, F.lit(2), F.greatest(F.size(words), F.lit(1)))
    pairs = F.zip_with(words, shifted, lambda a, b: F.concat(a, F.lit(" "), b))
    return F.concat(words, F.array_compact(pairs))


def tfidf_terms(text: Column, stops: Iterable[str] = ENGLISH_STOPS) -> Column:
    return bigrams(stop_filter(term_tokens(text), stops))

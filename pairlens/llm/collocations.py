"""Collocations of two to four words, from counts of the longest windows alone.

A text falls into pieces and these into words. Every word leads one window: itself and the three words after it
in its piece, padded where the piece ends. Only these padded longest windows are counted; a phrase of fewer words is a
prefix of windows, and ROLLUP over the lead columns sums every shorter prefix, so no phrase length is exploded by itself.

* Counting (`_packed_windows`). A task counts a buffer of windows with sorted arrays, and hands on one row per first word with
  all its windows, so that what is shuffled is a fraction of a row a window.
* Padding the rare (`_padded`). Where all windows of a first word meet, those too rare to be candidates are cut back to their
  longest frequent prefix. Every occurrence is still in exactly one row, so all sums are those of the whole table, and
  the rows that ROLLUP expands are about as many as there are frequent phrases.
* Hot words. Fewer than HOT_WORDS words can each make up more than 1 / HOT_WORDS of all words; these are known to all
  tasks. The windows of such a word are dealt over buckets by the second word, and by the second and third if both
  first words are hot. No sum is taken for final that such a bucket holds only in part.

Scores are quotients of counts in decimals of 38 digits, floored, and compared as integers.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from pairlens.staging import stage

# The limits of the contract.
LONGEST = 4
MIN_COUNT = 30
COVERED_PERCENT = 80
TOP = 2000
SCALE = 2_000_000
HOT_WORDS = 10_000
#: Windows a task counts at a time.
BUFFER = 1 << 20
#: Parts in which the first rows of a language are looked for.
SALTS = 64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PIECE_ENDS = ".,;:!?\n\x0b\x0c\r"
WORDS_OF = [f"w{i + 1}" for i in range(LONGEST)]
_TABLE = bytes.maketrans((UPPER + PIECE_ENDS + "\t").encode(), (LOWER + "\n" * len(PIECE_ENDS) + " ").encode())


def texts_by_part(docs: DataFrame, text_col: str = "text", part_col: str = "lang") -> DataFrame:
    return docs.select(F.coalesce(F.col(part_col), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def hot_words(texts: DataFrame, hot: int = HOT_WORDS) -> dict[bytes, int]:
    """Words, over all languages, that make up more than 1 / `hot` of all, and over how many buckets each is dealt."""
    words = texts.select(F.explode(F.split("text", "[ \t.,;:!?\n-\r]+")).alias("word")).filter("word <> ''")
    # Lower-cased are the distinct words, not the texts.
    spelled = words.groupBy("word").agg(F.count("*").alias("n")).select(F.translate("word", UPPER, LOWER).alias("word"), "n")
    counts = stage(spelled.groupBy("word").agg(F.sum("n").alias("n")), "word-counts")
    bound = (counts.agg(F.sum("n")).first()[0] or 0) / hot
    return {r.word.encode(): int(r.n // bound) + 1 for r in counts.filter(F.col("n") > bound).collect()}  # under `hot` rows


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


class _Windows:
    """Windows of one language in a task, counted when `rows` is called."""

    def __init__(self, hot: dict[bytes, int]):
        self.hot, self.names, self.parts, self.n = hot, {b"\n": 0}, [], 0

    def add(self, text: bytes) -> None:
        names = self.names
        for word in (words := [w for w in text.translate(_TABLE).replace(b"\n", b" \n ").split(b" ") if w]):
            if word not in names:
                names[word] = len(names)
        if words:
            # A piece ends with its text.
            self.parts.append(np.fromiter(map(names.__getitem__, words), np.int64, len(words)))
            self.parts.append(np.zeros(1, np.int64))
            self.n += len(words)

    def rows(self, lang: str) -> pa.RecordBatch | None:
        """`h, lang, word, tails`: a line `w2 w3 w4 n` for each distinct window of the word in a bucket."""
        if not self.parts:
            return None
        ids = np.concatenate(self.parts + [np.zeros(LONGEST, np.int64)])
        leads = [ids[:-LONGEST]]
        for i in range(1, LONGEST):
            leads.append(np.where(leads[-1] == 0, 0, ids[i:len(ids) - LONGEST + i]))
        real = leads[0] != 0
        if not real.any():
            return None
        leads = [x[real] for x in leads]
        words = list(self.names)
        buckets = np.array([self.hot.get(w, 0) for w in words], np.int64)
        hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))
        w1, w2, w3, w4 = leads
        both = (buckets[w1] > 0) & (buckets[w2] > 0)
        spread = _mixed(hashes[w2] + np.where(both, _mixed(hashes[w3]), np.uint64(0)))
        bucket = (spread % np.maximum(buckets[w1], 1).astype(np.uint64)).astype(np.int64)
        place, rest = w1 * (buckets.max() + 1) + bucket, w2 * len(words) + w3
        order = np.lexsort((w4, rest, place))
        place, rest, w4 = place[order], rest[order], w4[order]
        first = np.concatenate([[True], (place[1:] != place[:-1]) | (rest[1:] != rest[:-1]) | (w4[1:] != w4[:-1])])
        at = np.flatnonzero(first)
        count = np.diff(np.append(at, len(place)))
        place, order = place[at], order[at]
        spelled = pa.array([b"", *words[1:]], pa.binary())
        lines = pc.binary_join_element_wise(*[spelled.take(pa.array(x[order])) for x in (w2, w3, leads[3])],
                                            pa.array(count).cast(pa.string()).cast(pa.binary()), pa.scalar(b" "))
        starts = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        tails = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(starts, len(place)), pa.int32()), lines), pa.scalar(b"\n"))
        heads = w1[order[starts]]
        seed = np.uint64(xxhash.xxh3_64_intdigest(lang.encode()))
        h = _mixed(_mixed(hashes[heads] + seed) + bucket[order[starts]].astype(np.uint64)).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(h), pa.array([lang] * len(heads)), spelled.take(pa.array(heads)), tails],
                                          ["h", "lang", "word", "tails"])


def _packed_windows(batches: Iterator[pa.RecordBatch], hot: dict[bytes, int], buffer: int) -> Iterator[pa.RecordBatch]:
    held: dict[str, _Windows] = defaultdict(lambda: _Windows(hot))
    n = 0

    def emptied() -> Iterator[pa.RecordBatch]:
        for lang, windows in held.items():
            made = windows.rows(lang)
            for at in range(0, made.num_rows if made else 0, 10_000):
                yield made.slice(at, 10_000)
        held.clear()

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            windows = held[lang]
            before = windows.n
            windows.add(text.as_py().encode())
            n += windows.n - before
            if n >= buffer:
                yield from emptied()
                n = 0
    yield from emptied()


def _cut_back(word: bytes, tails: list[bytes], hot: dict[bytes, int], least: int) -> dict[tuple[bytes, ...], int]:
    """Occurrences by longest prefix that may be frequent, of all windows of a word that are in one bucket."""
    lines = b"\n".join(tails).split(b"\n")
    hot1 = word in hot
    if not hot1 and len(lines) < least:
        total = sum(int(line[line.rindex(b" "):]) for line in lines)
        if total < least:
            return {(b"",) * LONGEST: total}
    counts: dict[bytes, int] = defaultdict(int)
    for line in lines:
        rest, _, n = line.rpartition(b" ")
        counts[rest] += int(n)
    twos, threes = defaultdict(int), defaultdict(int)
    windows = [(*rest.split(b" "), n) for rest, n in counts.items()]
    for w2, w3, _, n in windows:
        twos[w2] += n
        threes[w2, w3] += n
    out: dict[tuple[bytes, ...], int] = defaultdict(int)
    for w2, w3, w4, n in windows:
        if w4 and n >= least:
            key = (word, w2, w3, w4)
        elif w3 and threes[w2, w3] >= least:
            key = (word, w2, w3, b"")
        elif w2 and (twos[w2] >= least or hot1 and w2 in hot):
            key = (word, w2, b"", b"")
        else:
            key = (word, b"", b"", b"")
        out[key] += n
    return out


def _padded(batches: Iterator[pa.RecordBatch], hot: dict[bytes, int], least: int) -> Iterator[pa.RecordBatch]:
    """`(h, lang, word, tails)` sorted by `h` to `(lang, w1, w2, w3, w4, n)`, padded by empty words."""
    group: dict[tuple[str, bytes], list[bytes]] = defaultdict(list)
    rows: dict[tuple, int] = defaultdict(int)
    last = None

    def close() -> None:
        for (lang, word), tails in group.items():
            for key, n in _cut_back(word, tails, hot, least).items():
                rows[(lang, *key)] += n
        group.clear()

    def made() -> pa.RecordBatch:
        columns = list(zip(*rows)) if rows else [()] * (LONGEST + 1)
        out = [pa.array(columns[0], pa.string()), *[pa.array(c, pa.binary()).cast(pa.string()) for c in columns[1:]],
               pa.array(rows.values(), pa.int64())]
        rows.clear()
        return pa.RecordBatch.from_arrays(out, ["lang", *WORDS_OF, "n"])

    for batch in batches:
        for h, lang, word, tails in zip(*[c.to_pylist() for c in batch.columns]):
            if h != last:
                close()
                last = h
                if len(rows) > 50_000:
                    yield made()
            group[lang, word].append(tails)
    close()
    yield made()


def longest_windows(texts: DataFrame, least: int = MIN_COUNT, hot: int = HOT_WORDS, buffer: int = BUFFER) -> DataFrame:
    """`(lang, w1, w2, w3, w4, n)`: every word of `texts(lang, text)` leads one window; the sums of prefixes of `least` and more are whole."""
    known = hot_words(texts, hot)
    packed = texts.mapInArrow(lambda batches: _packed_windows(batches, known, buffer), "h long, lang string, word binary, tails binary")
    return packed.repartition("h").sortWithinPartitions("h").mapInArrow(
        lambda batches: _padded(batches, known, least), f"lang string, {', '.join(f'{w} string' for w in WORDS_OF)}, n long")


def phrase_counts(windows: DataFrame, least: int = MIN_COUNT) -> tuple[DataFrame, DataFrame]:
    """Phrases `(lang, size, words, phrase, f)` of one to four words and `least` or more occurrences; totals `(lang, n)`."""
    sums = stage(windows.rollup("lang", *WORDS_OF).agg(F.sum("n").alias("f"), F.grouping_id().alias("gid")), "prefix-sums")
    size = LONGEST - F.bit_count("gid")
    words = F.slice(F.array(*WORDS_OF), F.lit(1), size)
    real = (size > 0) & F.col("lang").isNotNull()
    phrases = sums.filter(real & (F.col("f") >= least)).select("lang", size.alias("size"), words.alias("words"), "f").filter(
        F.element_at("words", -1) != "").select("lang", "size", "words", F.array_join("words", " ").alias("phrase"), "f")
    totals = sums.filter((size == 0) & F.col("lang").isNotNull()).select("lang", F.col("f").alias("n"))
    return stage(phrases, "phrases"), totals


def _cuts(words: Column) -> Column:
    """The phrase after each number of first words, up to the longest."""
    return F.array(*[F.struct(F.lit(k).alias("k"), F.array_join(F.slice(words, F.lit(1), F.lit(k)), " ").alias("first"),
                              F.array_join(F.slice(words, F.lit(k + 1), F.lit(LONGEST)), " ").alias("rest")) for k in range(1, LONGEST)])


def scored(phrases: DataFrame) -> DataFrame:
    """`lang, size, words, phrase, a, l, r, score` of every phrase of two and more words, by its lowest-scoring cut."""
    candidates = phrases.filter("size >= 2").withColumnRenamed("f", "a")
    cut = F.explode(F.filter(_cuts(F.col("words")), lambda c: c.k < F.col("size"))).alias("cut")
    part = lambda name: phrases.select("lang", F.col("phrase").alias(name), F.col("f").alias(f"f_{name}"))
    cuts = (candidates.select("lang", "size", "words", "phrase", "a", cut).select("lang", "size", "words", "phrase", "a", "cut.*")
            .join(part("first"), ["lang", "first"]).join(part("rest"), ["lang", "rest"]))
    score = F.expr(f"CAST(a AS DECIMAL(20,0)) * CAST({SCALE} AS DECIMAL(7,0)) div CAST(f_first + f_rest AS DECIMAL(20,0))")
    lowest = F.min(F.struct(score.alias("score"), F.col("k"), F.col("f_first").alias("l"), F.col("f_rest").alias("r"))).alias("best")
    return cuts.groupBy("lang", "phrase").agg(F.first("size").alias("size"), F.first("words").alias("words"), F.first("a").alias("a"), lowest).select(
        "lang", "size", "words", "phrase", "a", "best.l", "best.r", "best.score")


def without_covered(candidates: DataFrame, percent: int = COVERED_PERCENT) -> DataFrame:
    """The candidates that no longer one holds `percent` % of; dropped ones cover others all the same."""
    # A span that is the whole phrase, or runs beyond it, is not inside.
    inside = F.array(*[
        F.when((F.col("size") > length) & (F.col("size") >= at + length), F.array_join(F.slice("words", F.lit(at + 1), F.lit(length)), " "))
        for length in range(2, LONGEST) for at in range(LONGEST - length + 1)])
    longer = candidates.filter("size > 2").select("lang", F.explode(F.filter(inside, lambda p: p.isNotNull())).alias("phrase"), F.col("a").alias("held"))
    most = longer.groupBy("lang", "phrase").agg(F.max("held").alias("held"))
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    covered = F.coalesce(100 * wide("held") >= percent * wide("a"), F.lit(False))
    return candidates.join(most, ["lang", "phrase"], "left").filter(~covered).drop("held")


def top_phrases(candidates: DataFrame, top: int = TOP, salts: int = SALTS) -> DataFrame:
    """The first `top` of each language; parts of a language first, so that no task sorts a whole one."""
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    salt = F.pmod(F.xxhash64("phrase"), F.lit(salts))
    near = candidates.withColumn("salt", salt).withColumn("place", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order)))
    return near.filter(F.col("place") <= top).drop("salt", "place").withColumn(
        "rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)


def collocations(docs: DataFrame, text_col: str = "text", part_col: str = "lang", least: int = MIN_COUNT, top: int = TOP,
                 hot: int = HOT_WORDS, buffer: int = BUFFER) -> DataFrame:
    """The first `top` phrases of each language: `lang, rank, phrase, a, l, r, n, score`.

    Null languages are `und`, null texts empty; texts without words count nothing, and a language without candidates
    has no rows. Every row counts, copies and repeated ids too. Ties in score and count are in byte order of
    the phrase, and no two rows of a language have one phrase. No rows in, no rows out. Other columns are not read.
    """
    phrases, totals = phrase_counts(longest_windows(texts_by_part(docs, text_col, part_col), least, hot, buffer), least)
    candidates = stage(scored(phrases), "collocations")
    return top_phrases(without_covered(candidates), top).join(totals, "lang").select(
        "lang", "rank", "phrase", "a", "l", "r", "n", "score")

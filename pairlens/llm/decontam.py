"""Benchmark decontamination by winnowing.

Texts become words; every run of GRAM words has a hash. Of the hashes in each window of
SPAN words the least is the window's fingerprint, so equal windows have equal fingerprints
and neighbouring windows mostly share one. Runs of windows with one fingerprint are joined
with the fingerprints of the items; where they meet, the words themselves are compared,
window by window. No shared span of SPAN words or more is missed, and none is made up.

An item of fewer words is one window of its own length. There is no room for a choice in
it: all runs of that many words are its candidates. Only lengths that occur are looked for.

Columns only: no Python runs on the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pairlens.llm.common import BROADCAST_ROWS, broadcast_if_small, free_name, let, small
from pairlens.staging import stage

SPAN = 10
GRAM = 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Digits, letters a to z and everything beyond ASCII make words; null has none."""
    text = F.coalesce(text, F.lit(""))
    ascii_only = F.octet_length(text) == F.char_length(text)
    lowered = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.regexp_extract_all(lowered, F.lit(WORD), F.lit(0))


def _numbers(count: Column) -> Column:
    """0 to count - 1; empty if count is 0 or less."""
    return F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))


def _hash(values: Column, start: Column, length: int) -> Column:
    return F.xxhash64(F.lit(length), *[F.get(values, start + i) for i in range(length)])


def _candidates(words: Column, span: int, gram: int) -> Column:
    """`(h, first, last)`: windows first to last, by their first words, have the fingerprint h.

    With `gram` = `span` every window is its own fingerprint.
    """
    def runs(prints: Column) -> Column:
        changes = F.filter(_numbers(F.size(prints)),
                           lambda i: (i == 0) | (F.get(prints, i) != F.get(prints, i - 1)))
        return let(changes, lambda at: F.transform(at, lambda first, k: F.struct(
            F.get(prints, first).alias("h"), first.alias("first"),
            (F.coalesce(F.get(at, k + 1), F.size(prints)) - 1).alias("last"))))

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    grams = let(hashes, lambda hs: F.transform(_numbers(F.size(hs) - (gram - 1)), lambda i: _hash(hs, i, gram)))
    if gram == span:
        return let(grams, runs)
    least = lambda gs: F.transform(_numbers(F.size(gs) - (span - gram)),
                                   lambda i: F.least(*[F.get(gs, i + k) for k in range(span - gram + 1)]))
    return let(let(grams, least), runs)


def _plans(lengths: list[int], span: int, gram: int) -> list[tuple[int, int]]:
    return [(span, gram)] + [(n, n) for n in lengths]


def _window(words: Column, start: Column, length: Column) -> Column:
    return F.array_join(F.slice(words, start + 1, length), " ")


def item_windows(items: DataFrame, span: int, id_col: str, text_col: str) -> DataFrame:
    """Distinct `(item_id, h, len, window)` of the items, staged."""
    worded = items.select(F.col(id_col).cast("string").alias("item_id"), words_of(F.col(text_col)).alias("words"))
    sized = stage(worded.filter(F.size("words") > 0), "item-words")
    lengths = [r[0] for r in sized.filter(F.size("words") < span).select(F.size("words")).distinct().collect()]
    parts = []
    for length, gram in _plans(sorted(lengths), span, GRAM):
        fits = F.size("words") == length if length < span else F.size("words") >= span
        found = sized.filter(fits).select("item_id", "words", F.explode(_candidates(F.col("words"), length, gram)).alias("c"))
        starts = found.select("item_id", "words", "c.h", F.explode(F.sequence("c.first", "c.last")).alias("at"))
        parts.append(starts.select("item_id", "h", F.lit(length).alias("len"),
                                   _window(F.col("words"), F.col("at"), F.lit(length)).alias("window")))
    every = parts[0]
    for more in parts[1:]:
        every = every.unionByName(more)
    return stage(every.distinct(), "item-windows")


def named_windows(windows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each window once, `(h, len, window, names)`, and the items that `names` stands for, `(names, item_ids)`; staged.

    Windows of the same items share their names, so a passage that many items hold lists them once. Null ids are left out.
    """
    listed = windows.groupBy("h", "len", "window").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"))
    named = stage(listed.withColumn("names", F.sha2(F.to_json("item_ids"), 256)), "named-windows")
    return named.select("h", "len", "window", "names"), stage(named.select("names", "item_ids").dropDuplicates(["names"]), "item-names")


def _all_candidates(words: Column, lengths: list[int], span: int) -> Column:
    """`(h, first, last, len)` for windows of `span` words and of each of the shorter lengths."""
    with_length = lambda c, n: F.struct(c.h.alias("h"), c.first.alias("first"), c.last.alias("last"), F.lit(n).alias("len"))
    # `(lambda n: ...)(n)` binds the length of this turn.
    return F.concat(*[F.transform(_candidates(words, n, gram), (lambda n: lambda c: with_length(c, n))(n))
                      for n, gram in _plans(sorted(lengths), span, GRAM)])


def _met(docs: DataFrame, prints: DataFrame, lengths: list[int], span: int, rows: int) -> tuple[DataFrame, DataFrame]:
    """Of `docs(rid, doc_id, text)`: `(rid, doc_id, n_words)`, and candidates that have a fingerprint of `prints(h)`, with their
    words: `(rid, h, first, last, len, words)`.

    Fingerprints that can be broadcast meet the documents as these are read. More of them meet narrow rows, without words,
    and only texts in which something was met are moved, once each, for the words to be cut from them.
    """
    cut = F.slice("words", F.col("first") + 1, F.col("last") - F.col("first") + F.col("len")).alias("words")
    if small(prints, rows):
        nothing = F.struct(F.lit(None).cast("bigint").alias("h"), F.lit(0).alias("first"), F.lit(-1).alias("last"), F.lit(0).alias("len"))
        # One entry of each document has no hash and carries its number of words past the join.
        read = docs.select("rid", "doc_id", let(words_of(F.col("text")), lambda w: F.struct(
            w.alias("words"), F.concat(F.array(nothing), _all_candidates(w, lengths, span)).alias("candidates"))).alias("t"))
        spread = read.select("rid", "doc_id", "t.words", F.explode("t.candidates").alias("c")).select(
            "rid", "doc_id", "words", "c.h", "c.first", "c.last", "c.len")
        met = spread.join(F.broadcast(prints.withColumn("known", F.lit(True))), "h", "left").filter(F.col("h").isNull() | F.col("known"))
        found = stage(met.select("rid", "doc_id", "h", "first", "last", "len", F.when(F.col("h").isNull(), F.size("words")).alias("n_words"),
                                 F.when(F.col("h").isNotNull(), cut).alias("words")), "candidates")
        return (found.filter("h IS NULL").select("rid", "doc_id", "n_words"),
                found.filter("h IS NOT NULL").select("rid", "h", "first", "last", "len", "words"))
    worded = stage(docs.select("rid", "doc_id", words_of(F.col("text")).alias("words")), "document-words")
    narrow = worded.select("rid", F.explode(_all_candidates(F.col("words"), lengths, span)).alias("c")).select("rid", "c.*")
    met = stage(narrow.join(prints, "h", "left_semi"), "candidates")
    texts = worded.select("rid", "words").join(broadcast_if_small(met.select("rid").distinct(), rows), "rid", "left_semi")
    return (worded.select("rid", "doc_id", F.size("words").alias("n_words")),
            met.join(texts, "rid").select("rid", "h", "first", "last", "len", cut))


def contamination(docs: DataFrame, items: DataFrame, span: int = SPAN, id_col: str = "doc_id", text_col: str = "text",
                  item_id_col: str = "item_id", item_text_col: str = "text",
                  broadcast_rows: int = BROADCAST_ROWS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Word counts `(rid, doc_id, n_words)` of all rows, hits `(rid, start, len, names)`, one for each window of a document
    that items hold, and the items that `names` stands for, `(names, item_ids)`.

    A row of `docs` is a document, also if its id is null or repeated. Null and empty texts
    have no words and hit nothing. Items without words are passed over; rows that repeat an
    item change nothing; an item with a null id hits but cannot be named. Other columns are
    not read. `broadcast_rows` bounds the rows of a table that is broadcast; the result does not depend on it.
    """
    windows = item_windows(items, span, item_id_col, item_text_col)
    lengths = [r[0] for r in windows.filter(F.col("len") < span).select("len").distinct().collect()]  # under `span` of them
    named, names = named_windows(windows)
    numbered = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    counts, found = _met(numbered, named.select("h").distinct(), lengths, span, broadcast_rows)
    starts = found.select("rid", "h", "first", "len", "words",
                          F.explode(F.sequence(F.lit(0), F.col("last") - F.col("first"))).alias("at"))
    texts = starts.select("rid", "h", (F.col("first") + F.col("at")).alias("start"), "len",
                          _window(F.col("words"), F.col("at"), F.col("len")).alias("window"))
    hits = texts.join(broadcast_if_small(named, broadcast_rows), ["h", "len", "window"]).select("rid", "start", "len", "names")
    return counts, stage(hits, "hits"), names


def covered(intervals: Column) -> Column:
    """Number of positions in a sorted array of `(start, end)`, ends exclusive."""
    state = F.struct(F.lit(0).alias("upto"), F.lit(0).alias("n"))
    step = lambda s, i: F.struct(F.greatest(s.upto, i.end).alias("upto"),
                                 (s.n + F.greatest(F.lit(0), i.end - F.greatest(s.upto, i.start))).alias("n"))
    return F.aggregate(intervals, state, step, lambda s: s.n)


def decontamination_report(docs: DataFrame, items: DataFrame, **columns: str) -> DataFrame:
    """One row per row of `docs`: `doc_id, n_words, n_hit, n_items, items, contaminated`.

    Nulls, repeated rows and empty tables count as in `contamination`; without items nothing is hit.
    """
    counts, hits, names = contamination(docs, items, **columns)
    interval = F.struct(F.col("start"), (F.col("start") + F.col("len")).alias("end"))
    by_doc = hits.groupBy("rid").agg(F.sort_array(F.collect_set(interval)).alias("intervals"))
    # A list of names may be long, so their ids are counted and not the lists.
    listed = names.agg(F.sum(F.size("item_ids"))).first()[0] or 0
    held = hits.select("rid", "names").distinct().join(
        F.broadcast(names) if listed <= columns.get("broadcast_rows", BROADCAST_ROWS) else names, "names")
    items_of = held.groupBy("rid").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("items"))
    joined = counts.join(by_doc, "rid", "left").join(items_of, "rid", "left")
    n_hit = F.coalesce(covered(F.col("intervals")), F.lit(0)).cast("long")
    items_ = F.coalesce("items", F.array().cast("array<string>"))
    return joined.select("doc_id", F.col("n_words").cast("long").alias("n_words"), n_hit.alias("n_hit"),
                         F.size(items_).cast("long").alias("n_items"), items_.alias("items"), (n_hit > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, items: DataFrame, **columns: str) -> DataFrame:
    """The rows of `docs` that share no window with an item, with all their columns.

    Contaminated documents are told apart by the text they hold, so equal rows go together, and whatever their
    ids are. Rows with null or empty texts stay, and all rows do if no item has words. No rows in, no rows out.
    """
    text = docs[columns.get("text_col", "text")]
    key = free_name(docs, "_text_key")
    distinct = docs.select(F.sha2(F.coalesce(text, F.lit("")), 256).alias("doc_id"), text.alias("text"))
    counts, hits, _ = contamination(distinct, items, id_col="doc_id", text_col="text",
                                    **{k: v for k, v in columns.items() if k.startswith("item")})
    bad = stage(counts.join(hits.select("rid").distinct(), "rid", "left_semi").select(F.col("doc_id").alias(key)).distinct(),
                "contaminated")
    keyed = docs.withColumn(key, F.sha2(F.coalesce(text, F.lit("")), 256))
    return keyed.join(broadcast_if_small(bad), key, "left_anti").drop(key)

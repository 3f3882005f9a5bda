"""How document filters interact, over every order in which they can be applied.

Five filters give each document a mask of five bits. What an order of the filters does to a document follows
from its mask alone, so documents are counted by cell (part, mask, good, toxic): at most 128 cells a part, however
many documents there are. Each cell then folds its mask along every order of an array of all 120 orders, which
travels with the plan: `transform` walks the orders, `aggregate` folds one, and each step becomes a struct
weighted with the cell's documents. The 600 structs of a part's cells are merged by elementwise sums, and the
Shapley sums of a filter are folded from the merged array.

Filter E looks at the whole table: it fails each document whose text a smaller doc_id has. Texts are told apart by
SHA-256. Rows are counted by (text, cell, doc_id), then by (text, cell), before the groups of a text meet, so a text
with many copies is a few rows wherever it is summed.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, functions as F

# The filters in the order of their mask bits, and their limits.
LETTERS = "ABCDE"
MIN_WORDS = 100
DISTINCT_PERCENT = 80
CAPITAL_PERCENT = 10
SIGNS = "[#$%&*|]"
ORDERS = ["".join(order) for order in permutations(LETTERS)]
MEASURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
_STEP = "struct<letter:string," + ",".join(f"{m}:bigint" for m in MEASURES) + ">"


def own_failures(text: Column) -> Column:
    """Bits A to D of the mask, which a text decides on its own; `text` is not null."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    # One array of one array: the words are split once, however often they are referred to.
    bits = lambda w: (F.when(F.size(w) < MIN_WORDS, 1).otherwise(0)
                      + F.when(100 * F.size(F.array_distinct(w)) < DISTINCT_PERCENT * F.size(w), 2).otherwise(0))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return (F.transform(F.array(words), bits)[0]
            + F.when(F.lit(100).cast("long") * capitals > F.lit(CAPITAL_PERCENT).cast("long") * F.length(text), 4).otherwise(0)
            + F.when(text.rlike(SIGNS), 8).otherwise(0))


def document_masks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """One row per row of `docs`: `doc_id, part, digest, own`, where `own` has bits A to D. Null texts are empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(part_col), F.lit("")).alias("part"),
                       F.unhex(F.sha2(text, 256)).alias("digest"), own_failures(text).alias("own"))


def mask_cells(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """`(part, mask, good, toxic, n)`: documents by cell, bit E included.

    Rows of `labels` that repeat a doc_id count once: a document is good if any of its rows says quality 1, and
    toxic if any says toxic 1. Rows with a null id are documents that no label names and that no id is smaller than.
    """
    known = labels.select(F.col("doc_id").alias("label_id"), F.col("quality").eqNullSafe(1).alias("good"),
                          F.col("toxic").eqNullSafe(1).alias("toxic")).filter(F.col("label_id").isNotNull())
    known = known.groupBy("label_id").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic"))
    # Counted by id before the join, so that rows without an id are few when they meet in it.
    rows = masks.groupBy("doc_id", "digest", "part", "own").agg(F.count("*").alias("n"))
    marked = rows.join(known, F.col("doc_id") == F.col("label_id"), "left").select(
        "digest", "part", "own", "doc_id", "n", F.coalesce("good", F.lit(False)).alias("good"),
        F.coalesce("toxic", F.lit(False)).alias("toxic"))
    # Of a cell of one text: all rows, the least id, and how many rows have it. All copies of a text share `own`.
    cell = marked.groupBy("digest", "part", "own", "good", "toxic").agg(
        F.sum("n").alias("n"), F.min("doc_id").alias("first"), F.min_by("n", "doc_id").alias("at_first"),
        F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("unnamed"))
    # A text has at most four cells a part here.
    firsts = cell.groupBy("digest").agg(F.min("first").alias("least"), F.collect_list(F.struct(
        "part", "own", "good", "toxic", "n", "first", "at_first", "unnamed")).alias("cells"))
    at_least = lambda c, least: F.when(c.first == least, c.at_first).otherwise(0) + c.unnamed
    spread = firsts.select("least", F.explode("cells").alias("c")).select("c.*", at_least(F.col("c"), F.col("least")).alias("fresh"))
    both = F.explode(F.array(F.struct(F.col("own").alias("mask"), F.col("fresh").alias("n")),
                             F.struct((F.col("own") + 16).alias("mask"), (F.col("n") - F.col("fresh")).alias("n"))))
    return (spread.select("part", "good", "toxic", both.alias("m")).groupBy("part", "m.mask", "good", "toxic")
            .agg(F.sum("m.n").alias("n")).filter("n > 0"))


def _folded(order: Column, mask: Column, n: Column, good: Column, toxic: Column) -> Column:
    """The five steps of one order for the documents of a cell."""
    letters = F.split(order, "")
    bit = lambda letter: F.element_at(F.create_map(*[F.lit(x) for i, l in enumerate(LETTERS) for x in (l, 1 << i)]), letter)
    none = F.lit(0).cast("long")

    def step(state: Column, letter: Column) -> Column:
        fails = mask.bitwiseAND(bit(letter)) != 0
        removed = fails & ~state.gone
        when = lambda condition: F.when(condition, n).otherwise(none)
        made = F.struct(letter.alias("letter"), when(~state.gone & ~fails).alias("kept"), when(removed).alias("removed"),
                        when(fails & state.gone).alias("redundant"), when(mask == bit(letter)).alias("unique_fails"),
                        when(removed & good).alias("good_lost"), when(removed & toxic).alias("toxic_lost"))
        return F.struct((state.gone | fails).alias("gone"), F.concat(state.steps, F.array(made)).alias("steps"))

    start = F.struct(F.lit(False).alias("gone"), F.array().cast(f"array<{_STEP}>").alias("steps"))
    return F.aggregate(F.slice(letters, 1, len(LETTERS)), start, step, lambda s: s.steps)


def order_effects(cells: DataFrame) -> DataFrame:
    """`part, filter_order, step` and the measures, for every order and step of every part of `cells`."""
    orders = F.array(*[F.lit(o) for o in ORDERS])
    folds = cells.select("part", F.flatten(F.transform(orders, lambda o: _folded(
        o, F.col("mask"), F.col("n"), F.col("good"), F.col("toxic")))).alias("steps"))
    # A part has at most 128 cells of 600 structs, whatever the table holds.
    add = lambda a, b: F.struct(b.letter.alias("letter"), *[(a[m] + b[m]).alias(m) for m in MEASURES])
    zero = F.transform(F.sequence(F.lit(1), F.lit(len(ORDERS) * len(LETTERS))), lambda i: F.struct(
        F.lit("").alias("letter"), *[F.lit(0).cast("long").alias(m) for m in MEASURES]))
    merged = folds.groupBy("part").agg(F.collect_list("steps").alias("all")).select(
        "part", F.aggregate("all", zero, lambda acc, steps: F.zip_with(acc, steps, add)).alias("steps"))
    shapley = lambda letter: F.aggregate(F.filter("steps", lambda s: s.letter == letter), F.lit(0).cast("long"),
                                         lambda acc, s: acc + s.removed)
    summed = merged.select("part", "steps", F.map_from_arrays(
        F.array(*[F.lit(l) for l in LETTERS]), F.array(*[shapley(l) for l in LETTERS])).alias("shapley"))
    at = summed.select("part", "shapley", F.posexplode("steps").alias("pos", "s"))
    order = F.element_at(orders, F.floor(F.col("pos") / len(LETTERS)).cast("int") + 1)
    return at.select("part", order.alias("filter_order"), (F.col("pos") % len(LETTERS) + 1).cast("int").alias("step"),
                     *[f"s.{m}" for m in MEASURES], F.element_at("shapley", F.col("s.letter")).alias("shapley"))


def audit_filters(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  part_col: str = "lang") -> DataFrame:
    """What each filter removes at each step of each order: 600 rows per part, `part, filter_order, step`, the
    measures and `shapley`, all counts of documents of the part.

    Null and empty texts are empty texts: they fail A only, and E behind the smallest id among them. A null part is
    the empty string. Rows that repeat an id and a text are documents of their own, none of which is behind the
    other; rows with a null id are behind none. Labels of unknown documents change nothing; repeated ones count once.
    No rows in, no rows out. Other columns are not read.
    """
    return order_effects(mask_cells(document_masks(docs, id_col, text_col, part_col), labels))

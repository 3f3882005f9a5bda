"""Fuzzy similarity of whole texts, scored once per distinct pair of texts.

Normalising, token sorting and token sets are Columns; Arrow UDFs do only what
no built-in can: the longest common subsequence and long edit distances. Every distinct text
is normalised once, and tasks are ranges of the running cost of all distinct pairs.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from pairlens.functions.semilocal import window_lengths
from pairlens.functions.text import SPACE
from pairlens.operators.corpus import attach_texts, distinct_texts
from pairlens.operators.skew import HOT_KEYS, lookup, lookup_salted
from pairlens.staging import stage

# Weights and length limits of the weighted ratio.
TOKEN_WEIGHT, PARTIAL_WEIGHT, FAR_PARTIAL_WEIGHT = 0.95, 0.90, 0.60
PARTIAL_FROM, FAR_FROM = 1.5, 8.0
#: Cost a task is given to score, about a nanosecond a unit, and the most tasks there are.
COST_OF_A_TASK = 2_000_000_000
MOST_TASKS = 100_000
#: Steps over a text cost as much as this many characters of the other text.
STEP = 5_000
#: Measured costs, in steps of `lcs_length` over a short text: a cell of one pass over all windows, and what a character more costs a step.
PASS_COST, WINDOW_COST = 0.0015, 0.0002
#: Characters from which the places in a text are looked up by array, and steps between two cuts to its length.
LONG_TEXT, UNMASKED_STEPS = 1_000, 512
#: Pairs whose costs are added up side by side.
BUCKET_PAIRS = 100_000


def normalise(text: Column) -> Column:
    """Drop Latin-1 accents and signs, other non-word characters to spaces, lower-case, trim."""
    kept = F.regexp_replace(text, r"[\x{80}-\x{FF}]+", "")
    return F.trim(F.lower(F.regexp_replace(kept, r"[^\p{L}\p{N}_]", " ")))


def _words(normalised: Column) -> Column:
    return F.filter(F.split(normalised, SPACE), lambda w: w != "")


def token_sort_key(normalised: Column) -> Column:
    return F.array_join(F.array_sort(_words(normalised)), " ")


def token_set_parts(n1: Column, n2: Column) -> dict[str, Column]:
    """The sorted common words, and the sorted rest of each side."""
    a, b = F.array_distinct(_words(n1)), F.array_distinct(_words(n2))
    text = lambda words: F.array_join(F.array_sort(words), " ")
    return {"common": text(F.array_intersect(a, b)), "rest1": text(F.array_except(a, b)),
            "rest2": text(F.array_except(b, a))}


def token_set_key(n1: Column, n2: Column) -> dict[str, Column]:
    """(common, common + rest of q1, common + rest of q2)."""
    parts = token_set_parts(n1, n2)
    glue = lambda rest: F.trim(F.concat(parts["common"], F.lit(" "), rest))
    return {"key0": parts["common"], "key1": glue(parts["rest1"]), "key2": glue(parts["rest2"])}


def _places(s: str) -> dict[str, int]:
    """For every character of `s` the number whose bits are its places."""
    if len(s) >= LONG_TEXT:
        codes = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32)
        return {c: int.from_bytes(np.packbits(codes == ord(c), bitorder="little").tobytes(), "little") for c in set(s)}
    where: dict[str, int] = {}
    for i, c in enumerate(s):
        where[c] = where.get(c, 0) | 1 << i
    return where


def lcs_length(s: str, t: str) -> int:
    """Longest common subsequence, one machine word of `s` at a time (Hyyrö 2004)."""
    if len(s) < len(t):
        s, t = t, s
    full = (1 << len(s)) - 1
    row, places = full, _places(s).get
    # Nothing above `full` reaches a bit below it, so what is carried there may stay for some steps.
    for at in range(0, len(t), UNMASKED_STEPS):
        for c in t[at:at + UNMASKED_STEPS]:
            hit = row & places(c, 0)
            row = row + hit | row ^ hit
        row &= full
    return len(s) - row.bit_count()


def edit_distance(s: str, t: str) -> int:
    """Insertions, deletions and substitutions, a whole column of the table at a time (Myers 1999, Hyyrö 2003).

    The distance is that of the last column's top, the length of `t`, and the steps down from there.
    """
    if len(s) < len(t):
        s, t = t, s
    if not t:
        return len(s)
    # Carries and shifts reach one and two bits above `full`, where they meet nothing below them.
    full, above, far = ((1 << len(s) + more) - 1 for more in (0, 1, 2))
    up, down, places = full, 0, _places(s).get
    for c in t:
        equal = places(c, 0)
        diagonal = (((equal & up) + up) ^ up) | equal | down
        right_up = (down | (above ^ (diagonal | up))) << 1 | 1
        right_down = (up & diagonal) << 1
        down = right_up & diagonal
        up = (right_down | (far ^ (right_up | diagonal))) & full
    return len(t) + up.bit_count() - (down & full).bit_count()


def best_window(s: str, t: str, floor: int = 0) -> int:
    """The best LCS of the shorter text with any window of its length in the longer, at least `floor`.

    One step of the window changes its LCS by at most one, so after a window that is k short of the best so far the next
    k windows cannot beat it. That is quick where the floor is high. Once the windows looked at have cost what one
    pass over all the others would, that pass is made; so neither costs more than twice the cheaper of both.
    """
    if len(s) > len(t):
        s, t = t, s
    m, best, i, spent = len(s), floor, 0, 0.0
    while i <= len(t) - m and best < m:
        if spent > (m + len(t) - i) * (m + STEP) * PASS_COST:
            return max(best, int(window_lengths(s, t[i:], m).max()))
        here = lcs_length(s, t[i:i + m])
        spent += m * (1.0 + m * WINDOW_COST)
        best = max(best, here)
        i += best - here + 1
    return best


def _percent(share: float) -> int:
    return int(round(100 * share))


def plain_ratio(s: str, t: str) -> int:
    if not s or not t:
        return 0
    return _percent(2.0 * lcs_length(s, t) / (len(s) + len(t)))


def partial_ratio(s: str, t: str, beat: float = 0.0) -> int:
    """Score of the best window; 0 when it cannot exceed `beat`."""
    if not s or not t:
        return 0
    short = min(len(s), len(t))
    needed = math.floor(beat) + 1
    floor = max(0, math.ceil((needed - 0.5) * short / 100) - 2)
    if floor >= short:
        return 0
    found = best_window(s, t, floor)
    return _percent(found / short) if found > floor else 0


def weighted_ratio(s: str, t: str, sorted1: str, sorted2: str, common: str, rest1: str, rest2: str,
                   base: int) -> int:
    """The best of the plain, partial, token-sort and token-set scores, each with its weight."""
    gap = max(len(s), len(t)) / min(len(s), len(t))
    if gap < PARTIAL_FROM:
        by_order = plain_ratio(sorted1, sorted2)
        # A common prefix is matched whole, so only the rests are compared.
        prefix = len(common) + 1 if common else 0
        n1 = prefix + len(rest1) if rest1 else len(common)
        n2 = prefix + len(rest2) if rest2 else len(common)
        if common and not (rest1 and rest2):
            by_set = 100
        else:
            pairs = [(prefix + lcs_length(rest1, rest2), n1, n2)]
            if common:
                pairs += [(len(common), len(common), n1), (len(common), len(common), n2)]
            by_set = max(_percent(2.0 * m / (a + b)) for m, a, b in pairs)
        return int(round(max(base, by_order * TOKEN_WEIGHT, by_set * TOKEN_WEIGHT)))
    weight = FAR_PARTIAL_WEIGHT if gap > FAR_FROM else PARTIAL_WEIGHT
    best = float(base)
    # One common word makes the common part a window of either side.
    by_set = 100 if common else partial_ratio(rest1, rest2, best / (TOKEN_WEIGHT * weight))
    best = max(best, by_set * TOKEN_WEIGHT * weight)
    best = max(best, partial_ratio(s, t, best / weight) * weight)
    best = max(best, partial_ratio(sorted1, sorted2, best / (TOKEN_WEIGHT * weight)) * TOKEN_WEIGHT * weight)
    return int(round(best))


@F.pandas_udf(StructType([StructField("fuzz_qratio", IntegerType()), StructField("fuzz_WRatio", IntegerType())]))
def _fuzz(n1: pd.Series, n2: pd.Series, s1: pd.Series, s2: pd.Series,
          common: pd.Series, rest1: pd.Series, rest2: pd.Series) -> pd.DataFrame:
    out = []
    for row in zip(n1, n2, s1, s2, common, rest1, rest2):
        base = plain_ratio(row[0], row[1])
        out.append((base, weighted_ratio(*row, base)))
    return pd.DataFrame(out, columns=["fuzz_qratio", "fuzz_WRatio"], dtype="int32")


def dealt_by_cost(rows: DataFrame, cost: Column, order: list[str], name: str, cost_of_a_task: int = COST_OF_A_TASK,
                  most_tasks: int = MOST_TASKS, bucket_rows: int = BUCKET_PAIRS) -> tuple[DataFrame, int]:
    """`rows` with the `task` each is dealt to, and the number of tasks.

    Rows lie one after the other on a line, each as long as it costs, and a task is a stretch of the line: none costs more than
    its share and one row. The line is laid in buckets: the cost of each is summed, the sums are added up (a
    row a bucket), and the rows of a bucket start where the buckets before it end.
    """
    costed = rows.withColumn("cost", cost.cast("decimal(38,0)"))
    n, total = costed.agg(F.count("*"), F.sum("cost")).first()
    share = max(cost_of_a_task, -(-int(total or 0) // most_tasks))
    bucketed = costed.withColumn("bucket", F.pmod(F.xxhash64(*order), F.lit(max(1, n // bucket_rows))).cast("int"))
    before = lambda window: F.coalesce(F.sum("cost").over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("decimal(38,0)")
    sums = bucketed.groupBy("bucket").agg(F.sum("cost").cast("decimal(38,0)").alias("cost")).select(
        "bucket", before(Window.orderBy("bucket")).alias("base"))
    begin = F.col("base") + before(Window.partitionBy("bucket").orderBy(*order))
    task = F.floor(begin / F.lit(share).cast("decimal(20,0)")).cast("int")
    return stage(bucketed.join(sums, "bucket").withColumn("task", task).drop("bucket", "base", "cost"), name), int(total or 0) // share + 1


def _scored_once(pairs: DataFrame, normal: Callable[[Column], Column], scores: Column, answer: Callable[[Column], dict[str, Column]],
                 name: str, hot_keys: int, texts: DataFrame | None = None) -> DataFrame:
    """Score the distinct pairs `(t1, t2)` of normalised texts and bring the scores back to every id.

    `answer` gives the scores of pairs that need no scoring, by whether they are equal and not empty.
    """
    texts = stage((texts or distinct_texts(pairs)).select("key", "mentions", normal(F.col("text")).alias("text")).select(
        "key", "mentions", "text", F.md5("text").alias("name"), F.length("text").alias("len")), f"{name}-texts", codec="zstd")
    rows = stage(attach_texts(pairs, texts, {"name": ("n1", "n2"), "len": ("l1", "l2")}, hot_keys), f"{name}-keys")
    trivial = (F.col("n1") == F.col("n2")) | (F.col("l1") == 0) | (F.col("l2") == 0)
    hard = rows.filter(~trivial)
    distinct = stage(hard.groupBy("n1", "n2").agg(F.any_value("l1").alias("l1"), F.any_value("l2").alias("l2"), F.count("*").alias("copies")),
                     f"{name}-pairs")
    cost = (F.col("l1").cast("long") + F.col("l2")) * (F.least("l1", "l2") + STEP)
    dealt, tasks = dealt_by_cost(distinct, cost, ["n1", "n2"], f"{name}-tasks")
    # A text is brought to each pair that it is in; how many those are is known, so that hot ones can be salted.
    for side, other in (("1", "n2"), ("2", "n1")):
        uses = distinct.groupBy(f"n{side}").agg(F.count("*").alias("uses")).withColumnRenamed(f"n{side}", "name")
        table = texts.groupBy("name").agg(F.any_value("text").alias(f"t{side}")).join(uses, "name").withColumnRenamed("name", f"n{side}")
        dealt = lookup_salted(dealt, stage(table, f"{name}-side{side}"), f"n{side}", "uses", spread=F.col(other), hot_keys=hot_keys)
    scored = stage(dealt.repartitionById(tasks, "task").select("n1", "n2", "copies", scores.alias("s")).select("n1", "n2", "copies", "s.*"), name)
    found = lookup(hard.select("id", "n1", "n2"), scored, ["n1", "n2"], "copies", hot_keys=hot_keys).drop("n1", "n2")
    same = (F.col("n1") == F.col("n2")) & (F.col("l1") > 0)
    return found.unionByName(rows.filter(trivial).select("id", *[c.alias(n) for n, c in answer(same).items()]))


def fuzz_ratios(pairs: DataFrame, hot_keys: int = HOT_KEYS, texts: DataFrame | None = None) -> DataFrame:
    """`(id, fuzz_qratio, fuzz_WRatio)` in 0..100; a text that normalises to nothing scores 0. `texts` is `distinct_texts(pairs)` where that is at hand."""
    n1, n2 = F.col("t1"), F.col("t2")
    parts = token_set_parts(n1, n2)
    scores = _fuzz(n1, n2, token_sort_key(n1), token_sort_key(n2), parts["common"], parts["rest1"], parts["rest2"])
    equal = lambda same: F.when(same, 100).otherwise(0)
    return _scored_once(pairs, normalise, scores, lambda same: {"fuzz_qratio": equal(same), "fuzz_WRatio": equal(same)}, "fuzz", hot_keys, texts)


@F.pandas_udf(IntegerType())
def _long_edits(t1: pd.Series, t2: pd.Series) -> pd.Series:
    return pd.Series([None if a is None else edit_distance(a, b) for a, b in zip(t1, t2)], dtype="Int32")


def levenshtein_ratio(pairs: DataFrame, normal: Callable[[Column], Column] = normalise, long_from: int = 128,
                      hot_keys: int = HOT_KEYS) -> DataFrame:
    """`(id, ratio)`: 1 - edits / longer length of the normalised texts; 0 when both are empty or missing.

    Short texts use the built-in distance, whose time is the product of the two
    lengths; long ones the bit-parallel form, which takes a 64th of that.
    """
    t1, t2 = F.col("t1"), F.col("t2")
    longest = F.greatest(F.length(t1), F.length(t2))
    when = lambda condition: [F.when(condition, t) for t in (t1, t2)]
    edits = F.coalesce(F.levenshtein(*when(longest < long_from)), _long_edits(*when(longest >= long_from)))
    scores = F.struct((1.0 - edits / longest).alias("ratio"))
    return _scored_once(pairs, normal, scores, lambda same: {"ratio": F.when(same, 1.0).otherwise(0.0)}, "levenshtein", hot_keys)

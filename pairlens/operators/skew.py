"""Joins of many rows to a table with one row per key, safe under hot keys.

`freq` is a column of the table that says how many of the joined rows carry the
key. Fewer than `hot_keys` keys can each hold more than 1/hot_keys of the total,
so the set of hot keys is bounded whatever the size or shape of the data; that
bound is what makes broadcasting it safe.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

HOT_KEYS = 10_000


def _hot_bound(table: DataFrame, freq: str, hot_keys: int) -> Column:
    total = table.agg((F.sum(freq) / F.lit(hot_keys)).alias("bound"))
    return total.scalar()


def lookup(rows: DataFrame, table: DataFrame, keys: str | list[str], freq: str, *, how: str = "inner",
           hot_keys: int = HOT_KEYS, shrink: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Attach the table's narrow columns to the rows.

    Rows with a hot key meet a broadcast of the hot part and are not shuffled;
    in word data they are most rows. The rest go through an ordinary equi-join,
    in which no key is hot any more. A table of at most `hot_keys` rows is hot as
    a whole. The table is read several times, so pass one that is staged.

    `shrink` is a grouping that keeps the keys. It runs once hot and other rows are
    apart, so that each row is grouped once, and before either meets the payload.
    """
    keys = [keys] if isinstance(keys, str) else keys
    # Spark 4.1 may take the union below for one laid out by id and then fail when it
    # re-plans one branch ("Can't zip RDDs with unequal numbers of partitions").
    rows.sparkSession.conf.set("spark.sql.unionOutputPartitioning", "false")
    if table.limit(hot_keys + 1).count() <= hot_keys:
        return (shrink(rows) if shrink else rows).join(F.broadcast(table.drop(freq)), keys, how)
    bound = _hot_bound(table, freq, hot_keys)
    payload = [c for c in table.columns if c != freq]
    hot = F.broadcast(table.filter(F.col(freq) > bound).select(payload))
    cold = table.filter(F.col(freq) <= bound).select(payload)
    near, far = rows, rows.join(hot, keys, "left_anti")
    if shrink:
        near, far = shrink(rows.join(hot, keys, "left_semi")), shrink(far)
    return near.join(hot, keys, "inner").unionByName(far.join(cold, keys, how))


def lookup_salted(rows: DataFrame, table: DataFrame, key: str, freq: str, *, spread: Column,
                  how: str = "inner", hot_keys: int = HOT_KEYS) -> DataFrame:
    """The same for wide payloads, which are never broadcast.

    Only the hot keys and their salt counts are broadcast. A hot key's rows are
    spread over its salts by `spread`, a stable value of the row, and its table
    row is repeated once per salt: at most `hot_keys` extra copies in all.
    """
    bound = _hot_bound(table, freq, hot_keys)
    share = F.ceil(F.col(freq) / bound).cast("int")
    hot = table.filter(F.col(freq) > bound).select(key, share.alias("_salts")).distinct()
    left = (rows.join(F.broadcast(hot), key, "left")
            .withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(spread), F.col("_salts")).cast("int"), F.lit(0)))
            .drop("_salts"))
    right = (table.withColumn("_salts", F.greatest(F.lit(1), F.when(F.col(freq) > bound, share)))
             .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)))
             .drop("_salts", freq))
    return left.join(right, [key, "_salt"], how).drop("_salt")


def with_frequency(table: DataFrame, counts: DataFrame, key: str = "word") -> DataFrame:
    """Keep the keys the corpus holds and add how often, as `cnt`; one row per key on both sides."""
    return table.join(counts.select(key, "cnt"), key)

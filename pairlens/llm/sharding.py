"""A reproducible shuffle into shards, computed row by row.

Rows are numbered 0 to n-1 by id, and a Feistel network permutes the numbers. It works on
2^b numbers, b the least even number of bits that holds n; a number that lands at n or above
walks on along its cycle until it is below n, which keeps the mapping one-to-one. Number p
goes to shard p mod s, slot p div s, so shard sizes differ by one at most and anyone who knows
n and the key can compute where a row is, or which row is at a place, without the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from pairlens.staging import stage

ROUNDS = 6
#: A step leaves a number outside with chance 3/4 at most; that many steps leave one of 10^12 rows
#: outside with chance below 10^-19. The query fails rather than place a row wrongly.
WALKS = 256


def half_bits(n: int) -> int:
    return max(1, (max(n - 1, 1).bit_length() + 1) // 2)


def feistel(number: Column, n: int, key: int, inverse: bool = False) -> Column:
    """One pass of the network over 2 * half_bits(n) bits."""
    half = half_bits(n)
    mask = F.lit((1 << half) - 1).cast("long")
    mix = lambda value, i: F.xxhash64(value, i, F.lit(key).cast("long")).bitwiseAND(mask)
    start = F.struct(F.shiftright(number, half).alias("l"), number.bitwiseAND(mask).alias("r"))
    rounds = [F.lit(i) for i in (range(ROUNDS - 1, -1, -1) if inverse else range(ROUNDS))]
    if inverse:
        step = lambda s, i: F.struct(s.r.bitwiseXOR(mix(s.l, i)).alias("l"), s.l.alias("r"))
    else:
        step = lambda s, i: F.struct(s.r.alias("l"), s.l.bitwiseXOR(mix(s.r, i)).alias("r"))
    return F.aggregate(F.array(*rounds), start, step, lambda s: F.shiftleft(s.l, half).bitwiseOR(s.r))


def permuted(number: Column, n: int, key: int = 0, inverse: bool = False) -> Column:
    """The place of `number` in a permutation of 0 to n-1; with `inverse`, the number at a place."""
    limit = F.lit(n).cast("long")
    walk = F.aggregate(F.sequence(F.lit(1), F.lit(WALKS)), feistel(number.cast("long"), n, key, inverse),
                       lambda p, _: F.when(p < limit, p).otherwise(feistel(p, n, key, inverse)))
    return F.transform(F.array(walk), lambda p: F.when(p < limit, p).otherwise(
        F.raise_error(F.lit("a cycle walk was cut off")).cast("long")))[0]


def row_numbers(rows: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """`rows` with `row_number` from 0 in the given order, and their count; no task sees all rows.

    Rows equal in `order` must be equal altogether: they are told apart by where they are read,
    which also lets any number of them be spread over tasks.
    """
    tie = F.monotonically_increasing_id()
    placed = stage(
        rows.withColumn("_tie", tie).orderBy(*order, "_tie").drop("_tie").select(
            "*", F.spark_partition_id().alias("_part"),
            F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_pos")), "numbered")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy("_part").agg(F.count("*").alias("_n"))  # a row per task of the sort
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_from"))
    numbered = placed.join(F.broadcast(offsets), "_part").withColumn("row_number", F.col("_from") + F.col("_pos"))
    return numbered.drop("_part", "_pos", "_from"), placed.count()


def shard_rows(docs: DataFrame, shards: int = 8, key: int = 0, id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: `doc_id, size, text_crc32, row_number, shard, slot`.

    `size` is the text's bytes plus 1 and `text_crc32` the checksum of its bytes; null text
    counts as empty in both. Rows are numbered by id, nulls first, then by text; rows equal
    in both are interchangeable. No rows in, no rows out. Other columns are not read.
    """
    data = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    thin = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(data) + 1).cast("long").alias("size"),
                       F.crc32(data).alias("text_crc32"), F.xxhash64(data).alias("_text"))
    rows, n = row_numbers(thin, ["doc_id", "_text", "text_crc32", "size"])
    placed = rows.withColumn("place", permuted(F.col("row_number"), n, key))
    return placed.select("doc_id", "size", "text_crc32", "row_number",
                         F.pmod(F.col("place"), F.lit(shards)).cast("int").alias("shard"),
                         F.floor(F.col("place") / shards).cast("long").alias("slot"))


def row_at(shard: Column, slot: Column, n: int, shards: int = 8, key: int = 0) -> Column:
    """The row number held at a place, computed without the table."""
    return permuted(slot.cast("long") * shards + shard, n, key, inverse=True)

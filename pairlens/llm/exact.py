"""Exact duplicates by deterministic block naming.

The normalised text is cut into blocks of a fixed number of bytes. The distinct
blocks are sorted and numbered, which names every block by an integer; then adjacent
names are paired, the distinct pairs are sorted and numbered, and so on until each
document has one name. Two documents get the same (level, name) exactly if their
normalised texts are equal: a name stands for one content, nothing is left to a hash.

Blocks travel once, when they are made distinct. Everywhere else a block goes by a
128-bit key, and that no two blocks share a key is checked on the distinct blocks
(another seed is taken if any do). After the first level rows hold numbers only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pairlens.llm.common import select_rows
from pairlens.staging import stage

BLOCK_BYTES = 4096


def normalised(text: Column) -> Column:
    """Each run of space, tab, newline, vertical tab, form feed or return becomes one space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _blocks(text: Column, block_bytes: int) -> Column:
    """Blocks of the bytes; an empty text is one empty block."""
    data = text.cast("binary")
    last = F.floor(F.greatest(F.octet_length(text) - 1, F.lit(0)) / block_bytes).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(data, i * block_bytes + 1, F.lit(block_bytes)))


def _key(block: Column, seed: int) -> Column:
    return F.struct(F.xxhash64(F.lit(seed), block).alias("a"), F.xxhash64(F.lit(~seed), block).alias("b"))


def _named(keys: DataFrame, level: int) -> DataFrame:
    """Distinct pairs (a, b) numbered in sorted order. Written out, so the numbers stay as they are."""
    return stage(keys.orderBy("a", "b").select("a", "b", F.monotonically_increasing_id().alias("name")),
                 f"names-{level}")


def identities(texts: DataFrame, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, DataFrame]:
    """For `texts(doc_id, norm)`: the rows `(rid, doc_id, text_sha256)` and `(rid, level, name)` of each."""
    seed = 0
    while True:
        blocks = texts.select(F.explode(_blocks(F.col("norm"), block_bytes)).alias("block"))
        distinct = blocks.select(_key(F.col("block"), seed).alias("k"), "block").distinct()
        first = stage(distinct.groupBy("k.a", "k.b").agg(F.count("*").alias("contents")), "block-keys")
        if first.filter("contents > 1").isEmpty():
            break
        seed += 1
    rows = stage(texts.select(
        F.monotonically_increasing_id().alias("rid"), "doc_id", F.sha2("norm", 256).alias("text_sha256"),
        F.transform(_blocks(F.col("norm"), block_bytes), lambda b: _key(b, seed)).alias("ks")), "block-rows")

    longest = rows.agg(F.max(F.size("ks"))).first()[0] or 1
    parts = rows.select("rid", F.size("ks").alias("n"), F.posexplode("ks").alias("pos", "k")).select(
        "rid", "n", "pos", "k.a", "k.b")
    names, level, finished = _named(first.select("a", "b"), 0), 0, []
    while True:
        named = stage(parts.join(names, ["a", "b"]).select("rid", "n", "pos", "name"), f"named-{level}")
        finished.append(named.filter("n = 1").select("rid", F.lit(level).alias("level"), "name"))
        if longest <= 1:
            break
        longest, level = (longest + 1) // 2, level + 1
        side = lambda odd: F.max(F.when(F.col("pos") % 2 == odd, F.col("name")))
        # A last name without a partner is paired with -1, which names nothing.
        parts = stage(named.filter("n > 1").groupBy("rid", F.floor(F.col("pos") / 2).cast("int").alias("pos")).agg(
            F.max(F.ceil(F.col("n") / 2).cast("int")).alias("n"), side(0).alias("a"),
            F.coalesce(side(1), F.lit(-1)).alias("b")), f"pairs-{level}")
        names = _named(parts.select("a", "b").distinct(), level)
    done = finished[0]
    for more in finished[1:]:
        done = done.unionByName(more)
    return rows.select("rid", "doc_id", "text_sha256"), done


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of `docs`: `doc_id, keep_id, group_size, kept, text_sha256`.

    Null text is empty text, and empty texts are equal to each other. Of equal texts the
    row with the smallest id is kept; null ids come last, and of rows with the same id and
    text exactly one is kept. No rows in, no rows out. Other columns are not read.
    """
    texts = docs.select(F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).alias("norm"))
    rows, identity = identities(texts, block_bytes)
    named = stage(rows.join(identity, "rid"), "identities")
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("rid"))
    groups = stage(named.groupBy("level", "name").agg(
        F.min(order).alias("first"), F.count("*").alias("group_size")).select(
        "level", "name", "group_size", F.col("first.doc_id").alias("keep_id"), F.col("first.rid").alias("keep_rid")),
        "equal-texts")
    return named.join(groups, ["level", "name"]).select(
        "doc_id", "keep_id", "group_size", (F.col("rid") == F.col("keep_rid")).alias("kept"), "text_sha256")


def drop_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows `exact_groups` keeps, with all their columns; a row that is there twice stays once."""
    groups = stage(exact_groups(docs, id_col, text_col), "exact-groups")
    # Rows of one id and one text are in one group: their number is that of rows to choose from.
    times = groups.groupBy("doc_id", "text_sha256").agg(
        F.count("*").alias("times"), F.max("kept").alias("kept")).filter("kept")
    return select_rows(docs, times, [F.col(id_col), F.sha2(normalised(F.col(text_col)), 256)], ["doc_id", "text_sha256"])

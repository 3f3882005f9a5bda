"""Texts that meet a table by their words, a block of texts at a time.

A block is some megabytes of distinct texts. It asks for each of its words once, however often its texts repeat it, so
that wide values (vectors) travel once per block and word instead of once per occurrence, and no word is hot.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from pairlens.sources.pairs import fill_text
from pairlens.staging import stage

#: Bytes of text of a block. Larger ones ask for fewer words, smaller ones need less memory of a task.
BYTES_OF_A_BLOCK = 16 << 20
#: What parts the words of a text; no tokeniser leaves one inside a word.
SEPARATOR = "\n"
#: What a text counts for beside its bytes, so that a block has no millions of short ones.
BYTES_OF_A_ROW = 256


def packed(words: Column) -> Column:
    """The words as one string, null if there are none."""
    return F.when(F.size(words) > 0, F.array_join(words, SEPARATOR))


def unpacked(words: Column) -> Column:
    return F.split(words, SEPARATOR)


def row_blocks(rows: DataFrame, size: Column, block_bytes: int) -> Column:
    """The block of each of the stored `rows(key, part, ...)`: a run of parts if they are small, else a share of one part."""
    row = rows.agg(F.sum(size + F.lit(BYTES_OF_A_ROW)).alias("size"), (F.max("part") + 1).alias("parts")).first()
    size, parts = row["size"] or 0, row["parts"] or 1
    run, shares = max(1, parts * block_bytes // max(1, size)), max(1, -(-size // (parts * block_bytes)))
    return F.floor(F.col("part") / run) * shares + F.pmod(F.xxhash64("key"), F.lit(shares))


def pair_blocks(pairs: DataFrame, texts: DataFrame, block_bytes: int) -> DataFrame:
    """`(block, id, k1, k2)`, once for each id: the keys of its texts in `distinct_texts`, lists since an id may come again.

    A block is a run of pairs as they are stored, of as many pairs as have `block_bytes` of distinct text on the average.
    """
    size = texts.agg(F.sum(F.octet_length("text") + F.lit(BYTES_OF_A_ROW)).alias("size"), F.sum("mentions").alias("cells")).first()
    run = max(1, (size["cells"] or 0) * block_bytes // (2 * max(1, size["size"] or 0)))
    filled = fill_text(pairs).select("id", *[F.md5(f"question{n}").alias(f"k{n}") for n in (1, 2)], F.monotonically_increasing_id().alias("place"))
    block = F.shiftleft(F.shiftright("place", 33), 33) + F.floor(F.col("place").bitwiseAND(F.lit((1 << 33) - 1)) / run)
    return filled.groupBy("id").agg(F.min("place").alias("place"), F.collect_list("k1").alias("k1"), F.collect_list("k2").alias("k2")).select(
        block.alias("block"), "id", "k1", "k2")


def text_words(texts: DataFrame, tokens: Callable[[Column], Column], block_bytes: int = BYTES_OF_A_BLOCK) -> DataFrame:
    """`(block, key, mentions, words)` of `distinct_texts`, staged; `words` is packed."""
    block = row_blocks(texts, F.octet_length("text"), block_bytes)
    return stage(texts.select(block.alias("block"), "key", "mentions", packed(tokens(F.col("text"))).alias("words")),
                 "text-words", codec="zstd")


def asked(words: DataFrame, table: DataFrame) -> DataFrame:
    """The rows of `table` by `word`, once for each block, `at`, that holds the word."""
    return words.select(F.col("block").alias("at"), F.explode(unpacked(F.col("words"))).alias("word")).distinct().join(table, "word")


def meet(words: DataFrame, table: DataFrame, shape: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """`shape` of each block: its rows of `words`, and the rows of `table` whose `word` one of them holds."""
    return words.groupBy("block").cogroup(asked(words, table).groupBy("at")).applyInArrow(shape, schema)


def codes(words: pa.ChunkedArray, names: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The words of all texts in order: their places in `names` (-1 if absent), and where each text ends."""
    lists = pc.split_pattern(pc.fill_null(words, "").combine_chunks(), SEPARATOR)
    known = pc.fill_null(pc.index_in(lists.flatten(), value_set=names), -1)
    # A text without words was packed as null; what stands for it is no word.
    none = pc.is_null(words).combine_chunks().to_numpy(zero_copy_only=False)
    ends = lists.offsets.to_numpy()
    code = known.to_numpy(zero_copy_only=False).astype(np.int64)
    code[(ends[:-1] - ends[0])[none]] = -1
    return code, ends[1:] - ends[0]


def by_word(table: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words of a table, its row numbers in their order, and where the rows of each word begin (and the last ends)."""
    coded = table["word"].combine_chunks().dictionary_encode()
    of = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    starts = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(coded.dictionary)))])
    return coded.dictionary, np.argsort(of, kind="stable"), starts


def expanded(code: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Places, in the rows ordered by word, of all rows of each word of `code`, in its order."""
    n = starts[code + 1] - starts[code]
    before = np.cumsum(n) - n
    return np.repeat(starts[code] - before, n) + np.arange(n.sum())


def matrix(vectors: pa.ChunkedArray, rows: np.ndarray) -> np.ndarray:
    """Rows of an array column as a matrix; all must be there and as wide."""
    if not len(rows):
        return np.zeros((0, 0))
    whole = vectors.combine_chunks()
    widths = pc.list_value_length(whole)
    if widths.null_count or len(pc.unique(widths)) > 1:
        raise ValueError("a word vector is missing or of another width")
    return np.reshape(whole.flatten().to_numpy(zero_copy_only=False), (len(whole), -1))[rows]


def ragged(values: pa.Array, lengths: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), values)

"""Small helpers the operators share."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

#: Rows of a table that may be broadcast; counted before it is, larger tables are shuffled.
BROADCAST_ROWS = 100_000


def free_name(df: DataFrame, name: str) -> str:
    """`name`, lengthened until no column of `df` is called so in either case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def let(value: Column, use) -> Column:
    """`use(value)` with the value computed once per row, however often `use` refers to it."""
    return F.transform(F.array(value), use)[0]


def pieces(batches: Iterator[pd.Series], rows: int = 256) -> Iterator[pd.Series]:
    """The same rows in smaller parts, so that what a function makes of whole texts is handed on early."""
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.iloc[at:at + rows]


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    return df.limit(rows + 1).count() <= rows


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    return F.broadcast(df) if small(df, rows) else df


def select_rows(docs: DataFrame, chosen: DataFrame, docs_key: list[Column], names: list[str]) -> DataFrame:
    """The rows of `docs` whose key is in `chosen(*names, times)`, once each.

    `chosen` has a key once; `times` says how many rows of `docs` carry it. Only rows
    that are there more than once are grouped, so other texts move once at most.
    """
    columns = docs.columns
    keys = [free_name(docs, f"_key{i}") for i in range(len(names))]
    times = free_name(docs, "_times")
    keyed = docs.select("*", *[c.alias(k) for c, k in zip(docs_key, keys)])
    right = chosen.select(*[F.col(n).alias(f"{k}_r") for n, k in zip(names, keys)], F.col("times").alias(times))
    match = [F.col(k).eqNullSafe(F.col(f"{k}_r")) for k in keys]
    found = keyed.join(right, match, "inner").drop(*[f"{k}_r" for k in keys])
    once = found.filter(F.col(times) == 1).select(*columns)
    again = found.filter(F.col(times) > 1).dropDuplicates(keys).select(*columns)
    return once.unionByName(again)

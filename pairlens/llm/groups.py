"""Rows that arrive sorted, handed on group by group; and components of a graph."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pairlens.staging import stage


def consecutive(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Tables of consecutive rows that are equal in the first `keys` columns, which are integers without nulls."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(i).to_numpy() for i in range(keys)]
        change = np.zeros(batch.num_rows - 1, bool)
        for c in columns:
            change |= c[1:] != c[:-1]
        starts = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        for a, b in zip(starts, starts[1:]):
            key = tuple(c[a] for c in columns)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def components(edges: DataFrame) -> DataFrame:
    """`(node, label)` of every end of `edges(a, b)`, the label being the least node that can be reached.

    A round gives each node the least label around it and then the label of its label, so
    paths shrink by more than half; labels are written out after every round.
    """
    both = stage(edges.select(F.explode(F.array(
        F.struct(F.col("a").alias("node"), F.col("b").alias("other")),
        F.struct(F.col("b").alias("node"), F.col("a").alias("other")))).alias("e")).select("e.*").distinct(), "graph")
    labels = stage(both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("label")), "labels-0")
    turn = 0
    while True:
        turn += 1
        near = both.join(labels.select(F.col("node").alias("other"), "label"), "other").groupBy("node").agg(F.min("label").alias("near"))
        lower = stage(labels.join(near, "node").select("node", "label", F.least("label", "near").alias("new")), f"labels-{turn}-near")
        jump = lower.select(F.col("node").alias("new"), F.col("new").alias("next"))
        moved = stage(lower.join(jump, "new", "left").select(
            "node", F.least("new", F.coalesce("next", "new")).alias("label"),
            (F.least("new", F.coalesce("next", "new")) != F.col("label")).alias("moved")), f"labels-{turn}")
        labels = moved.select("node", "label")
        if moved.filter("moved").isEmpty():
            return labels

"""Records of a CSV whose quoted fields span lines, found in parallel splits of a file.

Whether a line begins inside quotes depends on all text before it. A split cannot know that, but it can say what
follows from either answer: read from inside or from outside quotes, where does it end? Those two answers are the
split's transition. Transitions combine (that of two splits is the second's after the first's), so a running
combination over the splits of a file, in file order, tells each split how it begins. Then every split cuts its own
lines into records. The lines before its first record end belong to a record that began in an earlier split, and those
after its last one to a record that goes on; only these parts are brought together.

Quotes count where CSV has them count: a quote opens a field only at the field's start, and inside a quoted
field a doubled quote is a quote.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from pairlens.staging import stage

OUTSIDE, INSIDE = 0, 1
#: Lines a task hands on at a time.
ROWS = 1000


def line_end(line: str, state: int, separator: str = ",") -> int:
    """Whether the line ends INSIDE a quoted field or OUTSIDE, given how it begins; a line begins outside at a field's start."""
    at, n = 0, len(line)
    while True:
        if state == INSIDE:
            at = line.find('"', at)
            if at < 0:
                return INSIDE
            if line.startswith('""', at):
                at += 2
                continue
            at, state = at + 1, OUTSIDE
        elif at < n and line[at] == '"':
            at, state = at + 1, INSIDE
            continue
        # Up to the next field; quotes in between are characters like others.
        at = line.find(separator, at)
        if at < 0:
            return OUTSIDE
        at += 1


def _transitions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines `(file, begin, value)` of one or more splits, in order, to `(file, begin, after_outside, after_inside)`."""
    seen: dict[tuple[str, int], list[int]] = {}
    for batch in batches:
        for file, begin, value in zip(*[c.to_pylist() for c in batch.columns]):
            state = seen.setdefault((file, begin), [OUTSIDE, INSIDE])
            if state[0] == state[1]:
                state[0] = state[1] = line_end(value, state[0])
            else:
                state[0], state[1] = line_end(value, state[0]), line_end(value, state[1])
    if seen:
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in seen]), pa.array([k[1] for k in seen], pa.int64()),
             pa.array([s[0] for s in seen.values()], pa.int32()), pa.array([s[1] for s in seen.values()], pa.int32())],
            ["file", "begin", "after_outside", "after_inside"])


def _cut(batches: Iterator[pa.RecordBatch], starts: dict[tuple[str, int], int]) -> Iterator[pa.RecordBatch]:
    """Lines to `(file, begin, kind, text)`: whole records, and the open parts at either end of a split.

    Kinds: `record`; `head`, the end of an earlier split's record; `tail`, the beginning of a record that goes on;
    `middle`, a split without a record's end.
    """
    rows: list[tuple[str, int, str, str]] = []
    key, state, began, lines = None, OUTSIDE, OUTSIDE, []

    def closed() -> None:
        if lines:
            whole_is_open = began == INSIDE
            rows.append((*key, "middle" if whole_is_open else "tail", "\n".join(lines)))

    def made() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(
            (pa.string(), pa.int64(), pa.string(), pa.string()))], ["file", "begin", "kind", "text"])
        rows.clear()
        return out

    for batch in batches:
        for file, begin, value in zip(*[c.to_pylist() for c in batch.columns]):
            if (file, begin) != key:
                closed()
                key, lines = (file, begin), []
                state = began = starts[key]
            lines.append(value)
            state = line_end(value, state)
            if state == OUTSIDE:
                rows.append((file, begin, "head" if began == INSIDE else "record", "\n".join(lines)))
                lines, began = [], OUTSIDE
            if len(rows) >= ROWS:
                yield made()
    closed()
    yield made()


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """`(file, begin, value)`: every line with the split that reads it; lines of a split keep their order."""
    return spark.read.text(path, lineSep="\n").select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("begin"), "value")


def split_starts(transitions: DataFrame) -> DataFrame:
    """`(file, begin, start)`: how each split of `(file, begin, after_outside, after_inside)` begins.

    A split either sends both states to one, or leaves them as they are, or exchanges them. So a split begins as the last
    one before it that sends both to one says, turned around once for every exchange since.
    """
    order = Window.partitionBy("file").orderBy("begin")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    turns = F.when((F.col("after_outside") == INSIDE) & (F.col("after_inside") == OUTSIDE), 1).otherwise(0)
    fixed = F.col("after_outside") == F.col("after_inside")
    counted = transitions.withColumn("turns", F.sum(turns).over(order))
    last = F.last(F.when(fixed, F.struct(F.col("after_outside").alias("state"), F.col("turns").alias("turns"))), ignorenulls=True).over(before)
    so_far = F.coalesce(F.sum(turns).over(before), F.lit(0))
    placed = counted.select("file", "begin", last.alias("last"), so_far.alias("so_far"))
    start = (F.coalesce(F.col("last.state"), F.lit(OUTSIDE)) + F.col("so_far") - F.coalesce(F.col("last.turns"), F.lit(0))) % 2
    return placed.select("file", "begin", start.cast("int").alias("start"))


def quoted_records(spark: SparkSession, path: str) -> DataFrame:
    """`(record)`: the records of headerless CSV files, each with the line breaks inside its quotes; in no given order.

    Large files are read by many tasks. What comes to the driver is a number for each split. A record that spans splits is
    joined from its parts; a last record whose quotes never close is handed on as it is. Empty lines between
    records are records of their own.
    """
    lines = _lines(spark, path)
    transitions = stage(lines.mapInArrow(_transitions, "file string, begin long, after_outside int, after_inside int"), "splits")
    starts = {(r.file, r.begin): r.start for r in split_starts(transitions).collect()}
    parts = stage(lines.mapInArrow(lambda batches: _cut(batches, starts), "file string, begin long, kind string, text string"), "cut-records")
    # A split has one head or middle at most and one tail, so what is gathered is what open records are made of.
    open_ = parts.filter("kind <> 'record'")
    opened = F.sum(F.when(F.col("kind") == "tail", 1).otherwise(0)).over(
        Window.partitionBy("file").orderBy("begin", F.col("kind") == "tail"))
    joined = open_.withColumn("number", opened).groupBy("file", "number").agg(
        F.sort_array(F.collect_list(F.struct("begin", "text"))).alias("parts")).select(
        F.array_join(F.transform("parts", lambda p: p.text), "\n").alias("record"))
    return parts.filter("kind = 'record'").select(F.col("text").alias("record")).unionByName(joined)

"""Near duplicates by an inverted join of signature coordinates.

A document is the set of its distinct runs of `words` words. A coordinate of its signature is made
of the least values of two hash functions over that set, so that two sets of Jaccard similarity s
agree in a coordinate with probability s^2: often if they are alike, hardly ever if they only
share frequent words. Of COORDINATES coordinates, pairs that are linked (similarity of 80 % or
more) agree in MATCHES or more but for a chance below 10^-7. For another similarity both numbers
follow from that chance (`plan`).

* Documents with one set are one class; only classes are compared.
* A class is posted under each of its (coordinate, value) pairs. Pairs no other class has are
  dropped. Prefix: of the rest, ordered from rare to frequent, all but the last MATCHES - 1 are
  kept; two classes that agree in MATCHES coordinates meet in a kept list. Classes left with
  nothing are never looked at again.
* Lists are merged by their hub, the class of the list that comes first in a fixed random order:
  all members of the lists of a hub make up one group, each class once, so that frequent lists
  of the same classes cost what one of them costs.
* In a group collisions are counted coordinate by coordinate. Skip: classes already
  connected are not compared again, nor sets whose sizes alone rule a link out. Pairs with
  MATCHES collisions are confirmed on their full sets. Only links that connect something new
  leave the task, so a group gives fewer rows than it has classes.

Every pair of a list is in the group of its hub, so no link between two components is missed. A
group of more than GROUP_CLASSES classes or GROUP_BYTES is split into blocks, and every two blocks
meet in a task of their own.

Shingles are compared by 64-bit hashes of their words.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from pairlens.llm.common import select_rows, small
from pairlens.llm.groups import components, consecutive
from pairlens.staging import stage

WORDS = 5
PERCENT = 80
COORDINATES = 64
MATCHES = 20
#: Chance that a pair at the limit of similarity is missed, and the most coordinates spent on keeping it so low.
MISS = 1e-7
MOST_COORDINATES = 1024
GROUP_CLASSES = 4096
GROUP_BYTES = 64 << 20
MEMO_WORDS = 200_000
#: Keys of 8 bytes that are broadcast, so that only texts of groups move; with more of them all texts do, once.
PLACED_KEYS = 500_000
SKETCH = "rid long, row_key long, n_shingles long, class binary, tokens array<long>"


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def shingle_set(data: bytes, words: int, memo: dict) -> np.ndarray:
    """Sorted hashes of the distinct runs of `words` words; of all words if there are fewer; none without words.

    A to Z are lower-cased, and space, tab, newline, vertical tab, form feed and return part words.
    """
    w = data.lower().split()
    if not w:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(memo.__getitem__, w), np.uint64, len(w))
    k = min(words, len(w))
    n = len(w) - k + 1
    out = np.full(n, k, np.uint64)
    for i in range(k):
        out = _mixed(out + hashes[i:i + n])
    return np.unique(out)


def miss_chance(percent: int, coordinates: int, matches: int) -> float:
    """Chance that two sets of this similarity agree in fewer than `matches` coordinates."""
    p = (percent / 100) ** 2
    return sum(comb(coordinates, k) * p ** k * (1 - p) ** (coordinates - k) for k in range(matches))


def plan(percent: int) -> tuple[int, int]:
    """`(coordinates, matches)` that miss a pair at `percent` with a chance below MISS; the most matches of the fewest coordinates."""
    if not 0 < percent <= 100:
        raise ValueError("percent is above 0 and at most 100")
    coordinates = COORDINATES
    while miss_chance(percent, coordinates, 1) >= MISS:
        coordinates *= 2
        if coordinates > MOST_COORDINATES:
            raise ValueError(f"pairs of {percent} % would be missed with a chance above {MISS} by {MOST_COORDINATES} coordinates")
    matches = 1
    while matches < coordinates and miss_chance(percent, coordinates, matches + 1) < MISS:
        matches += 1
    return coordinates, matches


def _multipliers(coordinates: int = COORDINATES) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 1 << 63, (2, 2 * coordinates), dtype=np.uint64)
    return a * np.uint64(2) + np.uint64(1), b


def signature(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The coordinates, 32 bits each; blocks of shingles bound the memory."""
    low = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 1024):
        low = np.minimum(low, (shingles[at:at + 1024, None] * a + b).min(axis=0))
    return _mixed(low[::2] + _mixed(low[1::2])) >> np.uint64(32)


def _row_key(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.col(id_col), F.col(text_col))


def _sketched(docs: DataFrame, words: int, coordinates: int = COORDINATES) -> DataFrame:
    """`docs(rid, row_key, data)` as SKETCH."""
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, (a, b) = _WordHashes(), _multipliers(coordinates)
        lane = np.arange(coordinates, dtype=np.uint64) << np.uint64(32)
        for batch in batches:
            *ids, data = batch.columns
            sets = (shingle_set(text.as_py() or b"", words, memo) for text in data)
            rows = [(len(s), xxhash.xxh3_128_digest(s.tobytes()), (lane | signature(s, a, b)).view(np.int64) if len(s) else None)
                    for s in sets]
            sizes, names, tokens = zip(*rows) if rows else ((),) * 3
            yield pa.RecordBatch.from_arrays(
                [*ids, pa.array(sizes, pa.int64()), pa.array(names, pa.binary()), pa.array(tokens, pa.list_(pa.int64()))],
                ["rid", "row_key", "n_shingles", "class", "tokens"])

    return docs.mapInArrow(sketch, SKETCH)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    squeeze = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        keys, data = batch.columns
        yield pa.RecordBatch.from_arrays([keys, pa.array([squeeze.compress(d.as_py() or b"") for d in data], pa.binary())],
                                         ["row_key", "packed"])


def prefix_postings(classes: DataFrame, matches: int = MATCHES) -> DataFrame:
    """`(token, rep)` for the kept coordinates of each class of `classes(rep, tokens)`, staged."""
    tokens = classes.select("rep", F.explode("tokens").alias("token"))
    shared = stage(tokens.groupBy("token").agg(F.count("*").alias("n")).filter("n > 1"), "shared-coordinates")
    held = tokens.join(shared, "token").groupBy("rep").agg(
        F.sort_array(F.collect_list(F.struct("n", "token"))).alias("held"))
    keep = F.size("held") - (matches - 1)
    return stage(held.filter(keep > 0).select("rep", F.explode(F.slice("held", F.lit(1), keep)).alias("h"))
                 .select("h.token", "rep"), "postings")


def hub_members(postings: DataFrame) -> DataFrame:
    """Distinct `(hub, rep)`: the members of all lists that share a hub, the hub itself included; staged."""
    order = F.struct(F.xxhash64("rep").alias("place"), F.col("rep"))
    lists = stage(postings.groupBy("token").agg(F.min(order).alias("first"), F.count("*").alias("n")).filter("n > 1")
                  .select("token", F.col("first.rep").alias("hub")), "hubs")
    return stage(postings.join(lists, "token").select("hub", "rep").distinct(), "hub-members")


def group_links(sets: list[np.ndarray], collide: np.ndarray, matches: int, percent: int) -> Iterator[tuple[int, int]]:
    """Links that connect the sets, each between two that were not connected before.

    `collide` has a signature a row. All pairs of unconnected sets are looked at.
    """
    n = len(sets)
    _, codes = np.unique(np.concatenate(sets), return_inverse=True)
    size = np.array([len(s) for s in sets])
    parts = np.split(codes, size.cumsum()[:-1])
    mine = np.zeros(codes.max() + 1, bool)
    label = np.arange(n)
    for x in range(n - 1):
        later = np.flatnonzero(label[x + 1:] != label[x]) + x + 1
        later = later[100 * np.minimum(size[later], size[x]) >= percent * np.maximum(size[later], size[x])]
        later = later[(collide[later] == collide[x]).sum(axis=1) >= matches]
        if not len(later):
            continue
        mine[parts[x]] = True
        starts = np.concatenate([[0], size[later].cumsum()[:-1]])
        common = np.add.reduceat(mine[np.concatenate([parts[y] for y in later])], starts, dtype=np.int64)
        mine[parts[x]] = False
        for y in later[100 * common >= percent * (size[later] + size[x] - common)]:
            if label[y] != label[x]:
                label[label == label[y]] = label[x]
                yield x, int(y)


def _links(batches: Iterator[pa.RecordBatch], words: int, matches: int, percent: int,
           coordinates: int = COORDINATES) -> Iterator[pa.RecordBatch]:
    memo, (a, b), unpack = _WordHashes(), _multipliers(coordinates), zstandard.ZstdDecompressor()
    for group in consecutive(batches, 3):
        if group.num_rows < 2:
            continue
        reps = group.column("rep").to_pylist()
        sets = [shingle_set(unpack.decompress(p.as_py()), words, memo) for p in group.column("packed")]
        found = list(group_links(sets, np.stack([signature(s, a, b) for s in sets]), matches, percent))
        yield pa.RecordBatch.from_arrays([pa.array([reps[x] for x, _ in found], pa.int64()),
                                          pa.array([reps[y] for _, y in found], pa.int64())], ["a", "b"])


def class_links(members: DataFrame, classes: DataFrame, texts: DataFrame, words: int, matches: int = MATCHES,
                percent: int = PERCENT, group_classes: int = GROUP_CLASSES, group_bytes: int = GROUP_BYTES,
                coordinates: int = COORDINATES) -> DataFrame:
    """Confirmed links `(a, b)` that connect the classes of each group of `members(hub, rep)`.

    `classes` is `(rep, row_key, n_shingles)`, `texts` `(row_key, data)`. Texts travel compressed, to
    their groups only, and sets are made from them where they meet.
    """
    known = members.join(classes, "rep")
    blocks = F.greatest(F.ceil(F.count("*") / group_classes), F.ceil(F.sum("n_shingles") * 8 / group_bytes)).cast("int")
    sizes = stage(known.groupBy("hub").agg(blocks.alias("blocks")), "hub-sizes")
    split = known.join(sizes, "hub").select(
        "hub", "rep", "row_key", "blocks", F.pmod(F.xxhash64("rep", F.lit(1)), F.col("blocks")).cast("int").alias("block"))
    # A class of block b is in the tasks (b, j) and (j, b) of its hub for every block j.
    pair = lambda b: lambda j: F.struct(F.least(b, j).alias("i"), F.greatest(b, j).alias("j"))
    placed = stage(split.select("hub", "rep", "row_key", F.explode(F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1), pair(F.col("block")))).alias("p")).select("hub", "p.i", "p.j", "rep", "row_key"), "placed")
    keys = placed.select("row_key").distinct()
    if small(keys, PLACED_KEYS):  # texts without a group stay where they are read
        texts = texts.join(F.broadcast(keys), "row_key", "left_semi")
    packed = texts.mapInArrow(_pack, "row_key long, packed binary").dropDuplicates(["row_key"])
    full = placed.join(packed, "row_key").select("hub", "i", "j", F.xxhash64("rep").alias("place"), "rep", "packed")
    sorted_ = full.repartition("hub", "i", "j").sortWithinPartitions("hub", "i", "j", "place")
    return stage(sorted_.mapInArrow(lambda batches: _links(batches, words, matches, percent, coordinates), "a long, b long"), "links")


def near_groups(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id",
                text_col: str = "text", group_classes: int = GROUP_CLASSES) -> DataFrame:
    """One row per row of `docs`: `rid, row_key, doc_id, n_shingles, class, component_id, component_rid`.

    Rows are linked if 100 * |common shingles| >= percent * |all shingles|, and a component is
    what links reach. `component_id` is its least doc_id, null ids last, `component_rid` a row
    that has it. Rows with equal sets are linked. Null and empty texts have no shingles and
    are alone, each row for itself. Rows that repeat an id are rows of their own. `row_key`
    names id and text. Other columns are not read. A `percent` so low that a pair at it would
    be missed with a chance of MISS or more is an error.
    """
    coordinates, matches = plan(percent)
    keyed = docs.select(F.monotonically_increasing_id().alias("rid"), _row_key(id_col, text_col).alias("row_key"),
                        F.col(text_col).cast("binary").alias("data"), F.col(id_col).alias("doc_id"))
    # The id goes round the sketching by way of the row key, so that it may be of any type.
    sketches = stage(_sketched(keyed.select("rid", "row_key", "data"), words, coordinates), "sketches")
    some = sketches.filter("n_shingles > 0")
    classes = stage(some.groupBy("class").agg(F.min(F.struct("rid", "row_key", "n_shingles")).alias("first"), F.min_by("tokens", "rid").alias("tokens"))
                    .select("class", F.col("first.rid").alias("rep"), "first.row_key", "first.n_shingles", "tokens"), "classes")
    members = hub_members(prefix_postings(classes, matches))
    links = class_links(members, classes.select("rep", "row_key", "n_shingles"), keyed.select("row_key", "data"), words,
                        matches, percent, group_classes, coordinates=coordinates)
    labels = components(links)
    named = classes.select("class", "rep").join(labels.select(F.col("node").alias("rep"), "label"), "rep", "left").select(
        "class", F.coalesce("label", "rep").alias("label"))
    rows = sketches.select("rid", "row_key", "n_shingles", "class").join(stage(named, "class-labels"), "class", "left")
    ids = docs.select(_row_key(id_col, text_col).alias("row_key"), F.col(id_col).alias("doc_id")).distinct()
    placed = stage(rows.join(ids, "row_key").select(
        "rid", "row_key", "doc_id", "n_shingles", "class", F.when(F.col("n_shingles") > 0, F.col("label")).otherwise(F.col("rid")).alias("label"),
        (F.col("n_shingles") > 0).alias("some")), "labelled")
    first = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("rid")))
    heads = stage(placed.groupBy("some", "label").agg(first.alias("first")).select(
        "some", "label", F.col("first.doc_id").alias("component_id"), F.col("first.rid").alias("component_rid")), "components")
    return placed.join(heads, ["some", "label"]).select(
        "rid", "row_key", "doc_id", "n_shingles", "class", "component_id", "component_rid")


def drop_near(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id",
              text_col: str = "text") -> DataFrame:
    """One row of each component, that of the least id, with all its columns.

    Null ids come last, and of rows with the same id and text one stays. Rows without words are linked with
    nothing: each of them stays, but of those that repeat id and text one. No rows in, no rows out.
    """
    groups = stage(near_groups(docs, words, percent, id_col, text_col), "near-groups")
    times = groups.groupBy("row_key").agg(
        F.count("*").alias("times"), F.max(F.col("rid") == F.col("component_rid")).alias("kept")).filter("kept")
    return select_rows(docs, times, [_row_key(id_col, text_col)], ["row_key"])

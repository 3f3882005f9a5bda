"""Similar documents by a set join on word n-grams, vertically partitioned.

A document is the set of its distinct runs of `words` words; documents with one set are one class, and only
classes are compared. The n-grams have one global order: frequent ones last, and by a hash among themselves. That order
is cut into fragments, overlaps are counted in each fragment by itself, and summed for each pair.

* The first fragment of a set is its prefix: n - ceil(percent * n / 100) + 1 n-grams. Two sets as similar as `percent`
  share one of the n-grams of their prefixes in any global order. Classes are posted under these.
* Frequent n-grams. One on more than FREQUENT postings, and on more than a HOT_GRAMS-th of all, goes behind all others, and
  prefixes that held it are drawn anew: a passage that many documents share leaves their prefixes unless it is
  nearly all they hold. Any set of frequent n-grams makes an order, so no pair is missed, whichever they are.
* Groups. The lists are merged by their hub, the first class of a list in a fixed order. A group of more than
  GROUP_CLASSES classes or GROUP_BYTES is cut into blocks, and every two blocks are a task.
* Partial overlaps of the prefixes are counted first, for all pairs of a task at once, from prefixes alone. With all that
  is left of both sets behind its prefix, a pair of texts that share a passage cannot reach the limit any more.
* Only for classes that still have a pair do texts travel. The rest of the order is cut into FRAGMENTS by ranges of the
  hash; each adds its partial overlaps to the sums of the pairs, and after each, classes are let go whose pairs cannot
  reach the limit. Only n-grams that two classes hold are laid out.
* Of the pairs that reach the limit, those that connect something new leave the task: fewer than classes.

N-grams are compared by 63-bit hashes of their words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F, types as T

from pairlens.llm.common import broadcast_if_small
from pairlens.llm.groups import components, consecutive
from pairlens.llm.minhash import _WordHashes, shingle_set
from pairlens.staging import stage

WORDS = 5
PERCENT = 80
#: Postings beyond which an n-gram counts as frequent, the share of all beyond which it is known to all tasks (fewer
#: than HOT_GRAMS can have it).
FREQUENT = 64
HOT_GRAMS = 100_000
LATE = np.uint64(1 << 63)
FRAGMENTS = 8
#: N-grams kept behind a prefix, as a share of it, and at least: they move up where frequent ones leave it.
SPARE, LEAST_SPARE = 0.25, 4
#: Places of a prefix that travel with it, to tell how far it reaches.
MARKS = 16
GROUP_CLASSES = 1024
GROUP_BYTES = 8 << 20
#: N-grams of a fragment that are laid out at a time.
COLUMNS = 2048
#: Rows a task turns into sets at a time.
ROWS = 500


def prefix_length(n: int, percent: int) -> int:
    """How many n-grams of a set of `n`, in any global order, hold one of every set that is as similar."""
    return n - (percent * n + 99) // 100 + 1 if n else 0


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def gram_set(text: bytes, words: int, memo: dict) -> np.ndarray:
    """The n-grams of a text in order of their hashes, each once; the top bit is free to mark frequent ones."""
    grams = shingle_set(text, words, memo) >> np.uint64(1)
    return grams[np.concatenate([[True], grams[1:] != grams[:-1]])] if len(grams) else grams


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are in the sorted array `known`."""
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def prefix_of(grams: np.ndarray, frequent: np.ndarray, percent: int) -> np.ndarray:
    """The first n-grams of a set in the global order, in that order; `frequent` is sorted."""
    late = _among(grams, frequent)
    ordered = np.concatenate([grams[~late], grams[late] | LATE]) if late.any() else grams
    return ordered[:prefix_length(len(grams), percent)].copy()  # a view would hold the whole set


def redrawn_prefix(prefix: np.ndarray, spare: np.ndarray, frequent: np.ndarray) -> np.ndarray | None:
    """The prefix with the frequent n-grams last, from itself and the n-grams that follow it; None if these are too few."""
    late = _among(prefix, frequent)
    if not late.any():
        return prefix
    kept = np.concatenate([prefix[~late], spare[~_among(spare, frequent)]])
    return kept[:len(prefix)] if len(kept) >= len(prefix) else None


def _sets(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """`docs(rid, doc_id, data)` with the size and a digest of the set, its prefix in order of the hashes, the n-grams that
    follow it (`spare`), and the text packed."""
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, squeeze, none = _WordHashes(), zstandard.ZstdCompressor(level=1), np.empty(0, np.uint64)
        for batch in _parts(batches):
            rid, doc_id, data = batch.columns
            rows = []
            for value in data:
                text = value.as_py() or b""
                grams = gram_set(text, words, memo)
                prefix = prefix_of(grams, none, percent)
                spare = grams[len(prefix):len(prefix) + max(LEAST_SPARE, int(SPARE * len(prefix)))].copy()
                rows.append((len(grams), xxhash.xxh3_128_digest(grams.tobytes()), prefix.view(np.int64), spare.view(np.int64),
                             squeeze.compress(text)))
            sizes, names, prefixes, spares, packed = zip(*rows) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays(
                [rid, doc_id, pa.array(sizes, pa.int64()), pa.array(names, pa.binary()), pa.array(prefixes, pa.list_(pa.int64())),
                 pa.array(spares, pa.list_(pa.int64())), pa.array(packed, pa.binary())],
                ["rid", "doc_id", "n_shingles", "class", "prefix", "spare", "packed"])

    schema = T.StructType([*docs.select("rid", "doc_id").schema.fields, T.StructField("n_shingles", T.LongType()),
                           T.StructField("class", T.BinaryType()), T.StructField("prefix", T.ArrayType(T.LongType())),
                           T.StructField("spare", T.ArrayType(T.LongType())), T.StructField("packed", T.BinaryType())])
    return docs.mapInArrow(build, schema)


def _redrawn(batches: Iterator[pa.RecordBatch], frequent: np.ndarray, words: int, percent: int) -> Iterator[pa.RecordBatch]:
    """`(rep, prefix, spare, packed)` to `(rep, prefix)`; a text is taken apart only where the spare n-grams do not do."""
    memo, reader = _WordHashes(), zstandard.ZstdDecompressor()
    for batch in _parts(batches):
        reps, prefixes, spares, packed = batch.columns
        out = []
        for old, spare, text in zip(prefixes, spares, packed):
            prefix = redrawn_prefix(*(a.values.to_numpy().view(np.uint64) for a in (old, spare)), frequent)
            if prefix is None:
                prefix = prefix_of(gram_set(reader.decompress(text.as_py()), words, memo), frequent, percent)
            out.append(prefix.view(np.int64))
        yield pa.RecordBatch.from_arrays([reps, pa.array(out, pa.list_(pa.int64()))], ["rep", "prefix"])


def ordered_prefixes(classes: DataFrame, words: int = WORDS, percent: int = PERCENT, frequent: int = FREQUENT) -> tuple[DataFrame, DataFrame]:
    """Prefixes `(rep, prefix)` of `classes(rep, prefix, spare, packed)` in an order with the frequent n-grams last, and their
    postings `(token, rep)` without lists of one."""
    post = lambda prefixes: prefixes.select(F.explode("prefix").alias("token"), "rep")
    lists = lambda postings, name: stage(postings.groupBy("token").agg(F.count("*").alias("n")).filter("n > 1"), name)
    prefixes = classes.select("rep", "prefix")
    shared = lists(post(prefixes), "shared-grams")
    bound = max(frequent, (shared.agg(F.sum("n")).first()[0] or 0) / HOT_GRAMS)
    hot = shared.filter(F.col("n") > bound).select("token").toPandas()["token"].to_numpy(np.int64).view(np.uint64)  # under HOT_GRAMS
    hot = np.sort(hot)
    if len(hot):
        prefixes = stage(classes.select("rep", "prefix", "spare", "packed").mapInArrow(
            lambda batches: _redrawn(batches, hot, words, percent), "rep long, prefix array<long>"), "prefixes")
        shared = lists(post(prefixes), "shared-grams-again")
    return prefixes, stage(post(prefixes).join(shared.select("token"), "token").select("token", "rep"), "gram-postings")


def hub_groups(postings: DataFrame) -> DataFrame:
    """Distinct `(hub, rep)`: the classes of all lists that share a hub, itself included; staged."""
    order = F.struct(F.xxhash64("rep").alias("place"), F.col("rep"))
    hubs = stage(postings.groupBy("token").agg(F.min(order).alias("first")).select("token", F.col("first.rep").alias("hub")), "gram-hubs")
    return stage(postings.join(hubs, "token").select("hub", "rep").distinct(), "gram-groups")


def _shared(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """`(value, owner, number)` of all n-grams that two of the sets hold, in order of the values."""
    values, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    if not len(values):
        return values, owner, np.empty(0, np.int64)
    name = np.concatenate([[0], np.cumsum(values[1:] != values[:-1])])
    met = np.bincount(name)[name] > 1
    return values[met], owner[met], np.unique(name[met], return_inverse=True)[1]


def _partial(owner: np.ndarray, name: np.ndarray, rows: np.ndarray, cols: np.ndarray, n_sets: int) -> np.ndarray:
    """How many of the n-grams `name`, held by `owner` and ascending, each set of `rows` has in common with each of `cols`."""
    sums = np.zeros((len(rows), len(cols)), np.float32)
    place_l, place_r = np.full(n_sets, -1), np.full(n_sets, -1)
    place_l[rows], place_r[cols] = np.arange(len(rows)), np.arange(len(cols))
    at = 0
    while at < len(name):
        end = np.searchsorted(name, name[at] + COLUMNS)
        width = name[end - 1] - name[at] + 1
        x, y = np.zeros((len(rows), width), np.float32), np.zeros((len(cols), width), np.float32)
        for matrix, place in ((x, place_l[owner[at:end]]), (y, place_r[owner[at:end]])):
            matrix[place[place >= 0], name[at:end][place >= 0] - name[at]] = 1
        sums += x @ y.T
        at = end
    return sums


def _reaches(overlap: np.ndarray, sizes_l: np.ndarray, sizes_r: np.ndarray, percent: int) -> np.ndarray:
    """100 * overlap >= percent * union, for all pairs."""
    return (100 + percent) * overlap.astype(np.int64) >= percent * (sizes_l[:, None] + sizes_r[None, :])


def prefix_survivors(shared: list[np.ndarray], marks: np.ndarray, sizes: np.ndarray, left: np.ndarray, right: np.ndarray,
                     percent: int) -> np.ndarray:
    """Which pairs can reach the limit by the overlap of their prefixes and all that is left behind the shorter reach of both.

    `shared` are the n-grams of each prefix that some other prefix holds. Mark k of MARKS, from 1, is the n-gram of the
    prefix at place ceil(k * length / MARKS), so the last mark is its end.
    """
    _, owner, name = _shared(shared)
    common = _partial(owner, name, left, right, len(shared))
    lengths = np.array([prefix_length(int(n), percent) for n in sizes])

    def left_of(own: np.ndarray, other: np.ndarray) -> np.ndarray:
        """What a set has left behind the last n-gram of another's prefix, or behind its own: an upper bound."""
        passed = np.zeros((len(own), len(other)), np.int64)
        for k in range(MARKS):
            passed += marks[own, k][:, None] <= marks[other, -1][None, :]
        return sizes[own][:, None] - -(-passed * lengths[own][:, None] // MARKS)

    # Up to the earlier of both last n-grams, all that the sets have in common is in both prefixes.
    rest = np.minimum(left_of(left, right), left_of(right, left).T)
    return _reaches(common + rest, sizes[left], sizes[right], percent) & (left[:, None] != right[None, :]) & (common > 0)


def fragment_sums(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, percent: int,
                  fragments: int = FRAGMENTS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows and columns still held, as positions in `left` and `right`, and their overlaps, summed over fragments.

    `left` and `right` number the sets that are compared. Pairs that were let go cannot reach the limit.
    """
    sizes = np.array([len(s) for s in sets])
    values, owner, name = _shared(sets)
    ends = np.searchsorted((values >> np.uint64(31)).astype(np.int64) * fragments >> 32, np.arange(fragments + 1))
    # What is left of a set behind each fragment, n-grams held by no other set aside.
    rest = np.zeros((fragments + 1, len(sets)), np.int64)
    for f in range(fragments - 1, -1, -1):
        rest[f] = rest[f + 1] + np.bincount(owner[ends[f]:ends[f + 1]], minlength=len(sets))
    rows, cols, sums = np.arange(len(left)), np.arange(len(right)), np.zeros((len(left), len(right)), np.float32)
    for f in range(fragments + 1):
        most = sums + np.minimum(rest[f][left[rows]][:, None], rest[f][right[cols]][None, :])
        alive = _reaches(most, sizes[left[rows]], sizes[right[cols]], percent) & (left[rows][:, None] != right[cols][None, :])
        a, b = alive.any(axis=1), alive.any(axis=0)
        rows, cols, sums = rows[a], cols[b], sums[np.ix_(a, b)]
        if f == fragments or not len(rows):
            return rows, cols, sums
        sums += _partial(owner[ends[f]:ends[f + 1]], name[ends[f]:ends[f + 1]], left[rows], right[cols], len(sets))


def spanning_links(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, percent: int) -> Iterator[tuple[int, int]]:
    """Links between a set of `left` and one of `right`, each between two that were not connected before."""
    rows, cols, sums = fragment_sums(sets, left, right, percent)
    sizes = np.array([len(s) for s in sets])
    linked = _reaches(sums, sizes[left[rows]], sizes[right[cols]], percent)
    label = np.arange(len(sets))
    for i, x in enumerate(left[rows]):
        for y in right[cols[linked[i]]]:
            if label[y] != label[x]:
                label[label == label[y]] = label[x]
                yield int(x), int(y)


def _still_paired(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Of `(hub, i, j, block, rep, n_shingles, marks, shared)`, the places of classes that have a pair whose prefixes allow a link."""
    for group in consecutive(batches, 3):
        block, i, j = (group.column(c).to_numpy() for c in ("block", "i", "j"))
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        if not len(left) or not len(right):
            continue
        shared = [p.values.to_numpy().view(np.uint64) for p in group.column("shared")]
        marks = np.stack([m.values.to_numpy().view(np.uint64) for m in group.column("marks")])
        alive = prefix_survivors(shared, marks, group.column("n_shingles").to_numpy(), left, right, percent)
        kept = np.union1d(left[alive.any(axis=1)], right[alive.any(axis=0)])
        if len(kept):
            yield from group.select(["hub", "i", "j", "block", "rep"]).take(pa.array(kept)).combine_chunks().to_batches()


def _links(batches: Iterator[pa.RecordBatch], words: int, percent: int) -> Iterator[pa.RecordBatch]:
    memo, reader = _WordHashes(), zstandard.ZstdDecompressor()
    for group in consecutive(batches, 3):
        block, i, j = (group.column(c).to_numpy() for c in ("block", "i", "j"))
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        if not len(left) or not len(right):
            continue
        reps = group.column("rep").to_pylist()
        sets = [gram_set(reader.decompress(p.as_py()), words, memo) for p in group.column("packed")]
        found = list(spanning_links(sets, left, right, percent))
        yield pa.RecordBatch.from_arrays([pa.array([reps[x] for x, _ in found], pa.int64()),
                                          pa.array([reps[y] for _, y in found], pa.int64())], ["a", "b"])


def class_links(groups: DataFrame, prefixes: DataFrame, postings: DataFrame, classes: DataFrame, words: int = WORDS,
                percent: int = PERCENT, group_classes: int = GROUP_CLASSES, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """Links `(a, b)` that connect the classes of each of `groups(hub, rep)`.

    `prefixes` is `(rep, prefix)`, `postings` `(token, rep)`, `classes` `(rep, n_shingles, packed)`. Of the n-grams only those
    travel that several prefixes hold, of the texts only those whose prefixes overlap enough.
    """
    known = groups.join(classes.select("rep", "n_shingles"), "rep")
    place = lambda k: F.ceil(F.lit(k) * F.size("prefix") / MARKS).cast("int")
    ends = prefixes.select("rep", F.array(*[F.element_at("prefix", place(k + 1)) for k in range(MARKS)]).alias("marks"))
    held = postings.groupBy("rep").agg(F.collect_list("token").alias("shared"))  # no longer than the prefix
    blocks = F.greatest(F.ceil(F.count("*") / group_classes), F.ceil(F.sum("n_shingles") * 8 / group_bytes)).cast("int")
    sizes = stage(known.groupBy("hub").agg(blocks.alias("blocks"), F.count("*").alias("n")).filter("n > 1"), "group-blocks")
    split = known.join(sizes, "hub").select("hub", "rep", "n_shingles", "blocks",
                                            F.pmod(F.xxhash64("rep", F.lit(1)), F.col("blocks")).cast("int").alias("block"))
    # A class of block b is in the tasks (b, j) and (j, b) of its hub for every block j.
    pair = lambda b: lambda j: F.struct(F.least(b, j).alias("i"), F.greatest(b, j).alias("j"))
    placed = split.select("hub", "rep", "n_shingles", "block", F.explode(F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1), pair(F.col("block")))).alias("p")).join(ends, "rep").join(held, "rep").select(
        "hub", "p.i", "p.j", "block", "rep", "n_shingles", "marks", "shared")
    dealt = lambda rows: rows.repartition("hub", "i", "j").sortWithinPartitions("hub", "i", "j", "rep")
    left = stage(dealt(placed).mapInArrow(lambda batches: _still_paired(batches, percent), "hub long, i int, j int, block int, rep long"), "group-places")
    texts = classes.select("rep", "packed").join(broadcast_if_small(left.select("rep").distinct()), "rep", "left_semi")
    full = left.join(texts, "rep").select("hub", "i", "j", "block", "rep", "packed")
    return stage(dealt(full).mapInArrow(lambda batches: _links(batches, words, percent), "a long, b long"), "gram-links")


def join_documents(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text",
                   frequent: int = FREQUENT, group_classes: int = GROUP_CLASSES) -> DataFrame:
    """One row per row of `docs`: `doc_id, n_shingles, component_id`.

    Rows are linked if 100 * |common n-grams| >= percent * |all n-grams|, and a component is what links reach.
    `component_id` is its least doc_id, null ids last. Rows with equal sets are linked. Null texts, empty ones
    and texts without words have no n-grams and are alone, each row for itself. Rows that repeat an id are rows of
    their own. No rows in, no rows out. Other columns are not read.
    """
    if not 0 < percent <= 100:
        raise ValueError("percent is above 0 and at most 100")
    rows = stage(_sets(docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("doc_id"),
                                   F.col(text_col).cast("binary").alias("data")), words, percent), "gram-sets")
    known = stage(rows.filter("n_shingles > 0").groupBy("class").agg(F.min("rid").alias("rep")), "gram-classes")
    # The other rows of a class are looked for, not its first: they are fewer.
    again = stage(rows.filter("n_shingles > 0").select("rid", "class").join(known, "class").filter("rid <> rep").select("rid"), "gram-copies")
    classes = rows.filter("n_shingles > 0").join(broadcast_if_small(again), "rid", "left_anti").withColumnRenamed("rid", "rep")
    prefixes, postings = ordered_prefixes(classes, words, percent, frequent)
    links = class_links(hub_groups(postings), prefixes, postings, classes, words, percent, group_classes)
    labels = components(links)
    named = known.join(labels.select(F.col("node").alias("rep"), "label"), "rep", "left").select(
        "class", F.coalesce("label", "rep").alias("label"))
    some = F.col("n_shingles") > 0
    placed = stage(rows.select("rid", "doc_id", "n_shingles", "class").join(stage(named, "gram-labels"), "class", "left").select(
        "rid", "doc_id", "n_shingles", F.when(some, F.col("label")).otherwise(F.col("rid")).alias("label"), some.alias("some")), "gram-rows")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), F.col("doc_id")))
    heads = placed.groupBy("some", "label").agg(first.alias("first")).select("some", "label", F.col("first.doc_id").alias("component_id"))
    return placed.join(heads, ["some", "label"]).select("doc_id", "n_shingles", "component_id")

"""Byte-level BPE as a monoid: encodings of halves are joined at their seam.

The encoding of a piece of text is built up a tree. A leaf of a few bytes is merged
directly; a node joins the encodings of its halves. Joining looks at the seam only: if the
last token on the left and the first on the right would stand side by side unmerged, the
encodings are put one after the other. Otherwise a window of tokens around the seam is
encoded anew from its bytes, and grows on each side until the token outside and the token
inside stand side by side unmerged. Then nothing outside can change:

    In a vocabulary where the last merge that makes a token is of two tokens of lower rank,
    merges happen in the order of rank. A sequence of tokens is then the encoding of its bytes
    exactly if every two neighbours are the encoding of theirs, because the first merge across
    a border would also happen with the two neighbours alone.

`ByteBPE.ordered` checks that condition for every token. Without it, pieces are merged directly.
Joining is associative, so texts are encoded in any grouping with the same result.

Pieces no longer than a leaf are nearly all there are. They are merged many at a time: those of
one length are the rows of a matrix, and every step merges the pair of lowest rank in every row.
"""

from __future__ import annotations

import base64
import heapq
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import BinaryType

from pairlens.llm.common import pieces

LEAF_BYTES = 16
#: Bytes of pieces and ids that a generation of a Python worker's memory holds; there are two generations.
MEMO_BYTES = 16 << 20
#: What an entry takes beside its text and ids, about.
ENTRY_BYTES = 160
#: Neighbours whose standing is remembered.
MEMO_PAIRS = 200_000
#: Bytes of text whose pieces are looked up together.
GROUP_BYTES = 1 << 20
NEVER = 1 << 62
#: White space as the tokenizer's regular expressions have it (fixed values).
WHITE = r"\t-\r \x85\xa0  -     　"


def read_ranks(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def parse_ranks(lines: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines.splitlines())}


def splitter(pattern: str) -> regex.Pattern:
    """The pattern with white space spelled out, inside and outside of classes."""
    inside = regex.sub(r"\[[^\]]*\]", lambda m: m[0].replace(r"\s", WHITE), pattern)
    return regex.compile(inside.replace(r"\s", f"[{WHITE}]").replace(r"\S", f"[^{WHITE}]"))


class ByteBPE:
    def __init__(self, ranks: dict[bytes, int], leaf: int = LEAF_BYTES):
        self.ranks, self.leaf = ranks, leaf
        self.token = {rank: token for token, rank in ranks.items()}
        self._apart: dict[tuple[int, int], bool] = {}

    def merge(self, data: bytes) -> list[int]:
        """Merge the pair of lowest rank, the leftmost of them, until none is left."""
        if len(data) > 64:
            return self._merge_long(data)
        rank, parts = self.ranks.get, [data[i:i + 1] for i in range(len(data))]
        found = [rank(a + b, NEVER) for a, b in zip(parts, parts[1:])]
        while found and (best := min(found)) != NEVER:
            at = found.index(best)
            parts[at] += parts.pop(at + 1)
            del found[at]
            if at:
                found[at - 1] = rank(parts[at - 1] + parts[at], NEVER)
            if at < len(found):
                found[at] = rank(parts[at] + parts[at + 1], NEVER)
        return [self.ranks[p] for p in parts]

    def _merge_long(self, data: bytes) -> list[int]:
        """The same with a heap of pairs and a linked list of parts."""
        ranks, n = self.ranks, len(data)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank_at = lambda i: ranks.get(data[i:after[after[i]]]) if i >= 0 and after[i] < n else None
        heap = [(r, i, after[after[i]]) for i in range(n - 1) if (r := rank_at(i)) is not None]
        heapq.heapify(heap)
        alive = bytearray(b"\1") * n
        while heap:
            _, i, end = heapq.heappop(heap)
            if not alive[i] or after[i] >= n or after[after[i]] != end:
                continue  # one of the two has been merged with another since
            alive[after[i]] = 0
            after[i] = end
            if end < n:
                before[end] = i
            for j in (before[i], i):
                if (r := rank_at(j)) is not None:
                    heapq.heappush(heap, (r, j, after[after[j]]))
        out, i = [], 0
        while i < n:
            out.append(ranks[data[i:after[i]]])
            i = after[i]
        return out

    def ordered(self) -> bool:
        """Whether every token that merging can make is last merged from two of lower rank."""
        for token, rank in self.ranks.items():
            if len(token) > 1 and self.merge(token) == [rank]:
                without = self._without(token)
                if len(without) != 2 or max(without) >= rank:
                    return False
        return True

    def _without(self, token: bytes) -> list[int]:
        """The encoding of a token's bytes just before its last merge."""
        ranks, parts = self.ranks, [token[i:i + 1] for i in range(len(token))]
        while len(parts) > 2:
            pairs = [(r, i) for i in range(len(parts) - 1) if (r := ranks.get(parts[i] + parts[i + 1])) is not None]
            _, at = min(pairs)
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def apart(self, left: int, right: int) -> bool:
        """Whether two tokens side by side are the encoding of their bytes."""
        key = (left, right)
        if key not in self._apart:
            if len(self._apart) > MEMO_PAIRS:
                self._apart.clear()
            self._apart[key] = self.merge(self.token[left] + self.token[right]) == [left, right]
        return self._apart[key]

    def join(self, left: list[int], right: list[int]) -> list[int]:
        if not left or not right or self.apart(left[-1], right[0]):
            return left + right
        a = b = 1
        while True:
            inner = self.merge(b"".join(map(self.token.__getitem__, left[-a:] + right[:b])))
            still_left = a >= len(left) or self.apart(left[-a - 1], inner[0])
            still_right = b >= len(right) or self.apart(inner[-1], right[b])
            if still_left and still_right:
                return left[:-a] + inner + right[b:]
            a, b = a if still_left else 2 * a, b if still_right else 2 * b

    def tree(self, data: bytes) -> list[int]:
        if len(data) <= self.leaf:
            return self.merge(data)
        middle = len(data) // 2
        return self.join(self.tree(data[:middle]), self.tree(data[middle:]))

    def encode_piece(self, data: bytes) -> list[int]:
        """A piece that is a token as a whole is that token."""
        rank = self.ranks.get(data)
        return self.tree(data) if rank is None else [rank]


class PairRanks:
    """The rank that two neighbouring tokens merge to, for arrays of them."""

    NONE = np.iinfo(np.int64).max

    def __init__(self, ranks: dict[bytes, int]):
        self._base, get = max(ranks.values(), default=0) + 1, ranks.get
        pairs = {left * self._base + right: rank for token, rank in ranks.items() for i in range(1, len(token))
                 if (left := get(token[:i])) is not None and (right := get(token[i:])) is not None}
        keys = np.fromiter(pairs, np.int64, len(pairs))
        order = keys.argsort()
        self._keys = np.append(keys[order], self.NONE)
        self._ranks = np.append(np.fromiter(pairs.values(), np.int64, len(pairs))[order], self.NONE)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self._base + right
        at = np.searchsorted(self._keys, key)
        return np.where(self._keys[at] == key, self._ranks[at], self.NONE)


def _without_column(rows: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Every row without its element number `at`."""
    keep = np.ones(rows.shape, bool)
    keep[np.arange(len(rows)), at] = False
    return rows[keep].reshape(len(rows), rows.shape[1] - 1)


def merge_rows(ids: np.ndarray, pair_ranks: PairRanks) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """`ByteBPE.merge` of every row of a matrix of token ids: `(row numbers, their tokens)`, by the number of tokens.

    A step merges one pair in every row that is not done, so all rows at work have equally many tokens.
    """
    number, found = np.arange(len(ids)), pair_ranks(ids[:, :-1], ids[:, 1:])
    while len(ids) and ids.shape[1] > 1:
        at = found.argmin(1)
        best = found[np.arange(len(ids)), at]
        if (done := best == pair_ranks.NONE).any():
            yield number[done], ids[done]
            number, ids, found, at, best = (a[~done] for a in (number, ids, found, at, best))
        ids[np.arange(len(ids)), at] = best
        ids, found = _without_column(ids, at + 1), _without_column(found, at)
        before, after = np.flatnonzero(at > 0), np.flatnonzero(at < ids.shape[1] - 1)
        found[before, at[before] - 1] = pair_ranks(ids[before, at[before] - 1], ids[before, at[before]])
        found[after, at[after]] = pair_ranks(ids[after, at[after]], ids[after, at[after] + 1])
    if len(ids):
        yield number, ids


class _Packed(dict):
    """Piece of text to its ids as little-endian unsigned 32-bit integers.

    Remembered in two generations: when the younger has reached its size it becomes the older, and what was in the
    older and not met since is forgotten. It outlives tasks, as Python workers do.
    """

    def __init__(self, bpe: ByteBPE):
        super().__init__()
        self.bpe, self.older, self.held = bpe, {}, 0
        self._pair_ranks = PairRanks(bpe.ranks)
        self._byte_ids = np.array([bpe.ranks.get(bytes([b]), -1) for b in range(256)], np.int64)
        # Without the condition on ranks, and where a byte is no token, pieces are merged one by one.
        self._rows = bpe.leaf if bpe.leaf < 1 << 16 and (self._byte_ids >= 0).all() else 0

    def _keep(self, piece: str, packed: bytes) -> bytes:
        self.held += len(piece) + len(packed) + ENTRY_BYTES
        self[piece] = packed
        return packed

    def _turn(self) -> None:
        if self.held > MEMO_BYTES:
            self.older = dict(self)
            self.clear()
            self.held = 0

    def _one(self, data: bytes) -> bytes:
        ids = self.bpe.encode_piece(data)
        return struct.pack(f"<{len(ids)}I", *ids)

    def __missing__(self, piece: str) -> bytes:
        self._turn()
        packed = self.older.get(piece)
        return self._keep(piece, self._one(piece.encode("utf-8", "surrogateescape")) if packed is None else packed)

    def learn(self, pieces_: set[str]) -> None:
        """Hold the ids of all these pieces until the next call."""
        self._turn()
        by_length: dict[int, list[str]] = {}
        for piece in pieces_.difference(self):
            if (packed := self.older.get(piece)) is None:
                data = piece.encode("utf-8", "surrogateescape")
                if len(data) <= self._rows and data not in self.bpe.ranks:
                    by_length.setdefault(len(data), []).append(piece)
                    continue
                packed = self._one(data)
            self._keep(piece, packed)
        for length, group in by_length.items():
            data = "".join(group).encode("utf-8", "surrogateescape")
            rows = self._byte_ids[np.frombuffer(data, np.uint8).reshape(-1, length)]
            for numbers, ids in merge_rows(rows, self._pair_ranks):
                packed, size = ids.astype("<u4").tobytes(), 4 * ids.shape[1]
                for k, number in enumerate(numbers.tolist()):
                    self._keep(group[number], packed[k * size:(k + 1) * size])

    def encode_all(self, texts: Iterable[bytes], split) -> Iterator[bytes]:
        """The packed ids of texts, a group of them at a time."""
        for group in grouped(texts):
            pieces_ = [split(t.decode("utf-8", "surrogateescape")) for t in group]
            self.learn(set().union(*pieces_))
            for found in pieces_:
                yield b"".join(map(self.__getitem__, found))


def grouped(texts: Iterable[bytes], size: int = GROUP_BYTES) -> Iterator[list[bytes]]:
    """Neighbouring texts in groups that reach `size` bytes with their last one at most."""
    group, held = [], 0
    for text in texts:
        group.append(text)
        held += len(text)
        if held >= size:
            yield group
            group, held = [], 0
    if group:
        yield group


_workers: dict[tuple, _Packed] = {}


def worker(lines: bytes, leaf: int) -> _Packed:
    key = (hash(lines), len(lines), leaf)
    if key not in _workers:
        _workers[key] = _Packed(ByteBPE(parse_ranks(lines), leaf))
    return _workers[key]


def decoded_bytes(packed: bytes, token: dict[int, bytes]) -> bytes:
    """The tokens of packed ids one after the other; joining is associative, so any grouping gives the same."""
    return b"".join(map(token.__getitem__, memoryview(packed).cast("I"))) if packed else b""


class Tokenizer:
    """A vocabulary of ranks and a splitting pattern, shipped to the tasks once.

    The rank file's size bounds what is broadcast; it does not grow with the data.
    """

    def __init__(self, spark: SparkSession, ranks_path: str, pattern: str, leaf: int = LEAF_BYTES):
        lines = read_ranks(ranks_path)
        whole = not ByteBPE(parse_ranks(lines)).ordered()
        self._lines, self._pattern = spark.sparkContext.broadcast(lines), pattern
        self._leaf = 1 << 62 if whole else leaf

    @property
    def parts(self) -> tuple:
        """What a task needs to tokenise: the broadcast ranks, the pattern, the leaf size."""
        return self._lines, self._pattern, self._leaf

    def encode(self, text: Column) -> Column:
        """The ids of a text as binary, four little-endian bytes each; null and empty text give none."""
        lines, pattern, leaf = self.parts

        def encoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            packed, split = worker(lines.value, leaf), splitter(pattern).findall
            for texts in pieces(batches):
                yield pd.Series(list(packed.encode_all(texts, split)), dtype=object)

        encoded.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
        return F.pandas_udf(encoded, BinaryType())(F.coalesce(text, F.lit("")).cast("binary"))

    def encode_and_decode(self, text: Column) -> Column:
        """`(ids, decoded)` in one pass: the ids as `encode` gives them, and what `decode` makes of them."""
        lines, pattern, leaf = self.parts

        def coded(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            packed, split = worker(lines.value, leaf), splitter(pattern).findall
            for texts in pieces(batches):
                ids = list(packed.encode_all(texts, split))
                yield pd.DataFrame({"ids": ids, "decoded": [decoded_bytes(i, packed.bpe.token) for i in ids]}, dtype=object)

        coded.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
        return F.pandas_udf(coded, "ids binary, decoded binary")(F.coalesce(text, F.lit("")).cast("binary"))

    def decode(self, ids: Column) -> Column:
        """The bytes of packed ids; null stays null."""
        lines, _, leaf = self.parts

        def decoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            token = worker(lines.value, leaf).bpe.token
            for rows in pieces(batches):
                yield pd.Series([None if r is None else decoded_bytes(r, token) for r in rows], dtype=object)

        decoded.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
        return F.pandas_udf(decoded, BinaryType())(ids)


def unpack(ids: Column) -> Column:
    """Packed ids as an array of integers."""
    # Bytes are turned round in hexadecimal: reverse() would take them for characters.
    digits = lambda i: F.hex(F.substring(ids, i * 4 + 1, F.lit(4)))
    turned = lambda h: F.concat(*[F.substring(h, k, 2) for k in (7, 5, 3, 1)])
    at = lambda i: F.conv(turned(digits(i)), 16, 10).cast("int")
    n = F.floor(F.octet_length(ids) / 4).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), at)).otherwise(F.array().cast("array<int>"))


def round_trip(docs: DataFrame, tokenizer: Tokenizer, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`doc_id, ids, decoded` of every row: packed ids, and the bytes decoded from them.

    Null text is empty: no ids. Repeated rows give repeated rows, an empty table an empty
    one. Other columns are not read.
    """
    coded = docs.select(F.col(id_col).alias("doc_id"), tokenizer.encode_and_decode(F.col(text_col)).alias("c"))
    return coded.select("doc_id", "c.ids", "c.decoded")


def digests(coded: DataFrame, *more: str) -> DataFrame:
    """Token counts and digests of `round_trip`, and the columns of it named in `more`."""
    return coded.select("doc_id", *more, F.floor(F.octet_length("ids") / 4).alias("n_tokens"),
                        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))

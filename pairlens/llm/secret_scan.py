"""Secrets in texts: three fixed forms, and random strings that a vocabulary cannot shorten.

A byte-pair vocabulary spends few tokens on anything like language and many on random
strings. A run of word characters whose characters-per-token ratio is low is therefore
reported, unless it is a digest or an identifier of a known form.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from pairlens.llm.bpe import Tokenizer, splitter, worker
from pairlens.llm.common import pieces

SPANS = "array<struct<kind:string,start:int,end:int>>"
KINDS = ("assign", "access", "hex", "random")
BASE_KINDS = KINDS[:3]

# The fixed forms (fixed values): the pattern, and the group and number of characters it must have.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
FORMS = (("assign", ASSIGN, 2, 8), ("access", ACCESS, 0, 16), ("hex", HEX, 0, 32))
KEYWORDS = (b"passw", b"secret", b"token", b"api")
_HEX_RUN = b"h" * 32
_AS_HEX = bytes(ord("h") if chr(c) in "0123456789abcdef" else 0 for c in range(256))

#: Candidates of the ratio test: whole runs of at least as many characters, which is what a ratio needs to tell anything.
MIN_CHARS = 16
WORD = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{%d,}" % MIN_CHARS)
MAX_RATIO = 2.0
# Known digests and identifiers (fixed values): hexadecimal digests by their lengths, optionally named; UUIDs;
# and words and numbers, alone or parted by separators, such as numbered names, paths and dates.
DIGEST = re.compile(r"(?:(?:md5|sha1|sha224|sha256|sha384|sha512)[-=])?"
                    r"(?:[0-9A-Fa-f]{32}|[0-9A-Fa-f]{40}|[0-9A-Fa-f]{56}|[0-9A-Fa-f]{64}|[0-9A-Fa-f]{96}|[0-9A-Fa-f]{128})")
UUID = re.compile(r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
NUMBERED = re.compile(r"[0-9+/_=-]*|(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]+)(?:[+/_=-]+(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]+))*")


def known(string: str) -> bool:
    return any(form.fullmatch(string) for form in (DIGEST, UUID, NUMBERED))


def base_spans(data: bytes) -> list[tuple[str, int, int]]:
    """The fixed forms in a text, in code points; a form is only looked for where a part of it occurs."""
    low = data.lower()
    here = (any(k in low for k in KEYWORDS), b"AKIA" in data, _HEX_RUN in data.translate(_AS_HEX))
    if not any(here):
        return []
    text = data.decode("utf-8", "surrogateescape")
    return [(kind, *m.span()) for present, (kind, form, group, least) in zip(here, FORMS) if present
            for m in form.finditer(text) if len(m[group]) >= least]


def random_spans(text: str, tokens_of, taken: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Runs of few characters a token that are no known digest or identifier and overlap no other span."""
    found = [m.span() for m in WORD.finditer(text) if not known(m[0]) and len(m[0]) < MAX_RATIO * tokens_of(m[0])]
    if not found:
        return []
    others = sorted((start, end) for _, start, end in taken)
    starts, reach = [s for s, _ in others], [0, *accumulate((e for _, e in others), max)]
    return [("random", start, end) for start, end in found if reach[bisect_left(starts, end)] <= start]


def secret_spans(text: Column, tokenizer: Tokenizer) -> Column:
    """Spans `(kind, start, end)` in code points, end exclusive, by start and then kind; empty for null and empty text."""
    lines, pattern, leaf = tokenizer.parts

    def spans(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        packed, split = worker(lines.value, leaf), splitter(pattern).findall
        tokens_of = lambda s: sum(len(packed[p]) for p in split(s)) / 4
        for texts in pieces(batches):
            rows = []
            for data in texts:
                base = base_spans(data)
                every = base + random_spans(data.decode("utf-8", "surrogateescape"), tokens_of, base)
                every.sort(key=lambda s: (s[1], KINDS.index(s[0])))
                rows.append([{"kind": k, "start": s, "end": e} for k, s, e in every])
            yield pd.Series(rows, dtype=object)

    spans.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(spans, SPANS)(F.coalesce(text, F.lit("")).cast("binary"))


def scan_secrets(docs: DataFrame, tokenizer: Tokenizer, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`doc_id, spans` of every row. Repeated rows give repeated rows; other columns are not read."""
    return docs.select(F.col(id_col).alias("doc_id"), secret_spans(F.col(text_col), tokenizer).alias("spans"))


def span_report(found: DataFrame) -> DataFrame:
    """Counts of the fixed forms, a digest of their spans, and all spans written out."""
    written = lambda spans: F.array_join(F.transform(
        spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")
    of = lambda *kinds: F.filter("spans", lambda s: s.kind.isin(*kinds))
    count = lambda kind: F.size(of(kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in BASE_KINDS], F.sha2(written(of(*BASE_KINDS)), 256).alias("base_sha256"),
                        written(F.col("spans")).alias("spans"))

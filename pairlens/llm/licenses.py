"""Licences by canonical digest.

A text is brought to a canonical form that ignores what may differ between copies of one
licence: case, punctuation, white space, lines that name a copyright holder, and spellings
held to be equal. The SHA-256 of the form is looked up among those of known licence texts.
Whole documents are looked up, and each of their lines, which is how notices appear.

Which lines name a holder depends on where lines are broken. A text is therefore looked up, and known,
in two forms: without these lines, and whole. A copy whose lines are broken elsewhere, or that is one
line, has the whole form of its model; a copy with a holder of its own has the other one.

Columns only: no Python runs on the rows.
"""

from __future__ import annotations

import pkgutil

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pairlens.llm.common import broadcast_if_small

# The start of a line that names a holder, after lower-casing (fixed values): a mark and a year or two marks, or the formula alone.
YEAR = r"[<\[{(]?([12][0-9]{3}|year|yyyy|19yy|20yy)"
HOLDER = (r"[ \t#*/;-]*(copyright[ \t:]*(\(c\)|©|" + YEAR + r")|(\(c\)|©)[ \t]*(copyright|" + YEAR + r")"
          r"|all rights reserved[ \t.]*(\n|$))")
# What shows that such a line goes on with the terms (fixed values).
TERMS = "permission|permitted|redistribution|licensed"
# Spellings held to be equal, after lower-casing (fixed values): pattern, replacement. None depends on a line's end.
SPELLINGS = (
    (r"licen[cs]e", "license"),
    (r"sub-\s*license", "sublicense"),
    (r"non-\s*commercial", "noncommercial"),
    (r"copyright([ \t\n\x01]*)(\(c\)|©)", "copyright\\1"),
    (r"\(c\)|©", "copyright"),
    (r"http:", "https:"),
    (r"&", " and "),
    (r"\bv([0-9])", "version \\1"),
)
#: Stands before a line that names a holder; taken out of texts first.
MARK = "\x01"

# Notices of one line and the licence each names (fixed values).
NOTICES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\");"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
)

# Whole licence texts (fixed values).
TEXTS = (
    ("MIT", """MIT License

Copyright (c) <year> <copyright holders>

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
"""),
    ("ISC", """ISC License

Copyright (c) <year> <owner>

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.
"""),
    ("Zlib", """zlib License

Copyright (c) <year> <copyright holders>

This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution.
"""),
)


# Longer texts, in `license_texts`, as their authors publish them.
FILES = ("Apache-2.0", "MPL-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0")

BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
"""
BSD_CLAUSES = (
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
)
BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
"""


def whole_texts() -> list[tuple[str, str]]:
    """TEXTS, FILES, and BSD with two and three clauses, with and without a title, numbered or not."""
    read = lambda name: pkgutil.get_data("pairlens.llm", f"license_texts/{name}.txt").decode()
    bsd = [(f"BSD-{n}-Clause", "\n".join([*title, BSD_HEAD, *[f"{mark(i)} {c}\n" for i, c in enumerate(BSD_CLAUSES[:n], 1)], BSD_END]))
           for n in (2, 3) for title in ([f"BSD {n}-Clause License\n"], []) for mark in (lambda i: f"{i}.", lambda i: "*")]
    return [*TEXTS, *((name, read(name)) for name in FILES), *bsd]


def canonical_lines(text: Column) -> Column:
    """The canonical lines of a text that have anything left, in order, those that name a holder behind a `MARK`; none for null."""
    form = F.translate(F.lower(F.coalesce(text, F.lit(""))), MARK, " ")
    form = F.regexp_replace(form, f"(^|\n)({HOLDER})", f"$1{MARK}$2")
    for pattern, replacement in SPELLINGS:
        form = F.regexp_replace(form, pattern, replacement.replace("\\1", "$1"))
    form = F.regexp_replace(form, r"[\x00\x02-\x09\x0B-\x2F\x3A-\x60\x7B-\x7F]+", " ")
    trimmed = F.transform(F.split(form, "\n"), lambda line: F.regexp_replace(F.trim(line), f"^{MARK} ", MARK))
    unmarked = F.transform(trimmed, lambda line: F.when(line.startswith(MARK) & line.rlike(TERMS), F.substr(line, F.lit(2))).otherwise(line))
    return F.filter(unmarked, lambda line: (line != "") & (line != MARK))


def without_holders(lines: Column) -> Column:
    return F.filter(lines, lambda line: ~line.startswith(MARK))


def with_holders(lines: Column) -> Column:
    return F.transform(lines, lambda line: F.ltrim(line, F.lit(MARK)))


def digest_of(lines: Column) -> Column:
    return F.sha2(F.array_join(lines, " "), 256)


def known_licenses(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([*NOTICES, *whole_texts()], "license_id string, text string")


def registry(licenses: DataFrame) -> DataFrame:
    """Distinct `(digest, license_id)` of both forms of the texts; a form with nothing left is no licence."""
    lines = licenses.select("license_id", canonical_lines(F.col("text")).alias("lines"))
    forms = lines.select("license_id", F.explode(F.array(without_holders(F.col("lines")), with_holders(F.col("lines")))).alias("lines"))
    return forms.filter(F.size("lines") > 0).select(digest_of(F.col("lines")).alias("digest"), "license_id").distinct()


def scan_licenses(docs: DataFrame, licenses: DataFrame | None = None, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: `doc_id, canonical_sha256, whole, notices, n_lines`.

    `canonical_sha256` is of the form without lines that name a holder. `whole` lists the licences the
    document is a copy of in either form, `notices` those its lines name, and `n_lines` counts such lines.
    Null texts and texts with nothing left have the digest of the empty text and no licence. Ids that
    repeat are rows of their own; other columns are not read.
    """
    known = broadcast_if_small(registry(known_licenses(docs.sparkSession) if licenses is None else licenses))
    marked = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("doc_id"),
                         canonical_lines(F.col(text_col)).alias("marked"))
    forms = marked.select("rid", "doc_id", without_holders(F.col("marked")).alias("lines"), "marked")
    # The whole form is a unit of its own only where a line names a holder.
    named = F.size("lines") < F.size("marked")
    unit = lambda kind, digest: F.struct(F.lit(kind).alias("kind"), digest.alias("digest"))
    units = F.concat(F.array(unit("form", digest_of(F.col("lines")))),
                     F.when(named, F.array(unit("whole", digest_of(with_holders(F.col("marked")))))).otherwise(
                         F.array().cast("array<struct<kind:string,digest:string>>")),
                     F.transform("lines", lambda line: unit("line", F.sha2(line, 256))))
    spread = forms.select("rid", "doc_id", F.explode(units).alias("u")).select("rid", "doc_id", "u.kind", "u.digest")
    met = spread.join(known, "digest", "left").filter((F.col("kind") == "form") | F.col("license_id").isNotNull())
    named_by = lambda line: F.sort_array(F.collect_set(F.when((F.col("kind") == "line") == line, F.col("license_id"))))
    return met.groupBy("rid").agg(
        F.first("doc_id").alias("doc_id"), F.max(F.when(F.col("kind") == "form", F.col("digest"))).alias("canonical_sha256"),
        named_by(False).alias("whole"), named_by(True).alias("notices"),
        F.count(F.when(F.col("kind") == "line", 1)).alias("n_lines")).drop("rid")

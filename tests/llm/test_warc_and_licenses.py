import gzip
import hashlib
import re
import textwrap
from collections import Counter

import duckdb
import pyarrow as pa
from pyspark.sql import functions as F

from pairlens.llm import licenses, warc
from pairlens.llm.oracle import ORACLE
from pairlens.staging import new_path

PAGE = "<html>" + "payload " * 30 + "</html>"
PAGES = [(4, "u", PAGE, "f"), (2, "u", PAGE, "f"), (9, "u", PAGE, "f"), (1, "u", "short", "f"), (3, "u", "short", "f"), (5, "u", None, "f"),
         (6, "u", "", "f"), (7, "u", "Ü\r\n\r\nWARC/1.1\r\n" + "é" * 200, "f"), (8, "u", "x" * 300_000, "f"), (None, "u", PAGE, "f"),
         (2, "u", PAGE, "f")]
SCHEMA = "page_id long, url string, html string, file string"


def test_archives_give_back_what_was_written(spark):
    path = new_path(spark, "test-warc")
    rows = warc.archive_pages(spark.createDataFrame(PAGES, SCHEMA).repartition(3), path).collect()
    want = Counter()
    for i, _, html, _ in PAGES:
        data = (html or "").encode()
        revisit = html == PAGE and i != 2
        want[i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", 2 if revisit else None] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows) == want
    assert Counter(bytes(r.payload) for r in rows if r.record_type == "response") == Counter(
        (h or "").encode() for i, _, h, _ in PAGES if h != PAGE or i == 2)
    index = spark.read.parquet(f"{path}/index").collect()
    files = {r.path.split("/file=")[1].split("/")[0]: bytes(r.content) for r in spark.read.format("binaryFile").option(
        "pathGlobFilter", "part-*").load(f"{path}/archives").collect()}
    assert len(index) == len(PAGES)
    for r in index:  # every record is a gzip file of its own
        record = gzip.decompress(files[r.file][r.offset:r.offset + r.length])
        assert record.startswith(b"WARC/1.1\r\n") and record.endswith(b"\r\n\r\n")
        head = dict(line.split(": ", 1) for line in record.split(b"\r\n\r\n")[0].decode().split("\r\n")[1:])
        assert re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ", head["WARC-Date"]) and head["WARC-Target-URI"] == "u"
        assert head["Content-Type"] and ("WARC-Profile" in head) == (head["WARC-Type"] == "revisit") == ("WARC-Refers-To" in head)
    for name, data in files.items():  # and the members fill the archive
        assert sum(r.length for r in index if r.file == name) == len(data)


def test_no_pages(spark):
    assert warc.archive_pages(spark.createDataFrame([], SCHEMA), new_path(spark, "test-warc")).count() == 0


def test_streams_in_pieces_and_long_records():
    records = [b"WARC/1.1\r\nContent-Length: %d\r\n\r\n" % n + b"z" * n + b"\r\n\r\n" for n in (0, 5, 70_000, 17 << 20)]
    assert list(warc.records_of(gzip.compress(b"".join(records)), piece=777)) == records
    members = [warc.member_of(r) for r in records]
    assert all(m[-1] == 0 for m in members) and list(warc.records_of(b"".join(members))) == records


def test_licenses(spark, edge, nothing):
    mit = dict(licenses.TEXTS)["MIT"]
    texts = [mit, mit.upper().replace("\n\n", "\n  \n"), mit.replace("(c) <year> <copyright holders>", "2020 Some Body"),
             mit.replace("License", "Licence"), mit + " more", "words\n* released under the MIT licence!\nwords",
             "Licensed under CC BY-NC 4.0.", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan_licenses(docs).collect()}
    assert [got[i].whole for i in range(9)] == [["MIT"]] * 4 + [[], [], ["CC-BY-NC-4.0"], [], []]
    assert got[5].notices == ["MIT"] and got[5].n_lines == 1 and got[6].notices == ["CC-BY-NC-4.0"]
    assert got[7].canonical_sha256 == got[8].canonical_sha256 == hashlib.sha256(b"").hexdigest()
    assert licenses.scan_licenses(edge).count() == edge.count() and licenses.scan_licenses(nothing).count() == 0
    own = spark.createDataFrame([("X", "one two three four"), ("none", "?!")], "license_id string, text string")
    assert licenses.scan_licenses(edge, own).filter(F.size("whole") > 0).count() == 4


def test_common_whole_texts_are_known(spark):
    texts = licenses.whole_texts()
    assert {n for n, _ in texts} >= {"Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "MPL-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0"}
    docs = spark.createDataFrame([(i, "  " + t.upper()) for i, (_, t) in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.whole for r in licenses.scan_licenses(docs).collect()}
    assert [got[i] for i in range(len(texts))] == [[n] for n, _ in texts]


def test_known_texts_are_found_however_their_lines_are_broken(spark):
    texts, rows = licenses.whole_texts(), []
    for name, text in texts:
        paragraphs = re.split(r"\n\s*\n", text)
        rows.append((name, " ".join(text.split())))
        rows += [(name, "\n\n".join(textwrap.fill(" ".join(p.split()), width) for p in paragraphs)) for width in (40, 60, 80, 100)]
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: r.whole for r in licenses.scan_licenses(docs).collect()}
    assert [got[i] for i in range(len(rows))] == [[name] for name, _ in rows]


def test_lines_that_name_a_holder(spark):
    lines = ["Copyright (c) 2020 Some Body", " * © 2021 Some Body", "(C) 2019, Some Body", "Copyright 1999 Some Body", "All rights reserved.",
             "copyright notice, this list of conditions", "(c) You must retain", "Copyright (c) 2020 X. Permission is hereby granted",
             "all rights reserved by others", "\x01 a line"]
    docs = spark.createDataFrame([(i, "head\n" + t + "\nend") for i, t in enumerate(lines)], "doc_id long, text string")
    forms = docs.select("doc_id", licenses.canonical_lines(F.col("text")).alias("l"))
    got = {r.doc_id: r.l for r in forms.select("doc_id", licenses.without_holders(F.col("l")).alias("l")).collect()}
    assert [len(got[i]) for i in range(len(lines))] == [2] * 5 + [3] * 5
    own = "Redistribution and use in source"
    bsd = dict(licenses.whole_texts())["BSD-3-Clause"].replace(own, f"Copyright (c) 2020, Some Body\nAll rights reserved.\n\n{own}")
    docs = spark.createDataFrame([(0, bsd), (1, bsd.replace("list of", "list\nof"))], "doc_id long, text string")
    assert [r.whole for r in licenses.scan_licenses(docs).collect()] == [["BSD-3-Clause"]] * 2


def test_the_sql_has_the_same_law(spark):
    texts = [t for _, t in licenses.whole_texts()]
    texts += [textwrap.fill(t, 60, replace_whitespace=False) for t in texts] + [t.replace("<year>", "2020").replace("\n\n", "\r\n \r\n") for t in texts]
    texts += ["Copyright\n(c) 2020\n\x01x\nAll rights reserved.\nÄ © 1 v2.0 sub-\nlicence", "* Released under the MIT licence!\n(c) 2020 A", "", None]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    joined = lambda c: F.array_join(c, ",").alias(c)
    got = licenses.scan_licenses(docs).select("doc_id", "canonical_sha256", joined("whole"), joined("notices"), "n_lines").collect()
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": [i for i, _ in rows], "text": [t for _, t in rows]}))
    assert sorted(map(tuple, got)) == sorted(con.execute(ORACLE["op6_license_scan"]).fetchall())

"""WARC archives: written as one gzip stream a file, then rewritten record by record with an index.

`write_archives` lets Spark's text writer stream the records of a partition into one gzip
stream, each record ended by the blank lines the format asks for: a file that can only be
read from its start. `normalise` inflates such a stream once and rewrites every record as a
gzip member of its own, with a table of where each member lies. `read_archives` cuts
members out of the rewritten files by that table.

Everything is written by Spark's own writers, so files go wherever Spark can write, tasks
that are lost or run twice leave no trace, and no task reads or writes a local path.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pairlens.llm.common import broadcast_if_small
from pairlens.staging import discard, new_path, stage

END = "\r\n\r\n"
#: Payload bytes from which equal payloads are written once.
REVISIT_BYTES = 100
#: Records of a file at most; a task holds one compressed file in memory.
RECORDS_A_FILE = 4000
BATCH_BYTES = 4 << 20
ARCHIVES = "file string, archive binary, offsets array<long>"
RECORDS = ("page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, "
           "payload binary")


#: What says that a revisit has the payload of the record it refers to (a fixed value of the format).
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _urn(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), page_id.cast("string"), F.lit(">"))


def plan_records(pages: DataFrame, id_col: str = "page_id", html_col: str = "html",
                 url_col: str = "url") -> DataFrame:
    """`page_id, uri, payload, digest, payload_bytes, refers_to` of every row; `refers_to` is null for responses.

    `uri` is the url without control characters and spaces; null where that is empty or there is no such column.
    """
    url = F.col(url_col).cast("string") if url_col in pages.columns else F.lit(None).cast("string")
    uri = F.nullif(F.regexp_replace(url, r"[\x00-\x20\x7F]+", ""), F.lit(""))
    payload = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).alias("page_id"), uri.alias("uri"), payload.alias("payload"), F.sha2(payload, 256).alias("digest"),
                        F.octet_length(payload).cast("long").alias("payload_bytes"))
    long_ = F.col("payload_bytes") >= REVISIT_BYTES
    first = stage(rows.filter(long_).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
                  .filter("n > 1").select("digest", "first"), "payloads")
    met = rows.join(broadcast_if_small(first), "digest", "left")
    return met.select("page_id", "uri", "payload", "digest", "payload_bytes",
                      F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))


def _record() -> Column:
    """A record without its end: headers, a blank line, the block."""
    revisit = F.col("refers_to").isNotNull()
    block = F.when(revisit, F.lit("")).otherwise(F.col("payload"))
    record = F.coalesce(_urn(F.col("page_id")), F.lit("<urn:page:>"))
    # The pages do not say when they were fetched: the date is that of writing.
    now = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    header = [F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
              F.concat(F.lit("WARC-Record-ID: "), record),
              F.concat(F.lit("WARC-Date: "), now),
              F.concat(F.lit("WARC-Target-URI: "), F.coalesce("uri", F.translate(record, "<>", ""))),
              F.lit("Content-Type: text/html; charset=utf-8"),
              F.when(revisit, F.lit(f"WARC-Profile: {SAME_PAYLOAD}")),
              F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("digest")),
              F.concat(F.lit("X-Payload-Length: "), F.col("payload_bytes").cast("string")),
              F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), _urn(F.col("refers_to")))),
              F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))]
    return F.concat(F.concat_ws("\r\n", *header), F.lit(END), block)


def write_archives(records: DataFrame, path: str, per_file: int = RECORDS_A_FILE) -> None:
    """One gzip stream a file, of `per_file` records at most; files follow the partitions of `records`."""
    (records.select(_record().alias("value")).write.option("lineSep", END).option("compression", "gzip")
     .option("maxRecordsPerFile", per_file).text(path))


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, v in (line.split(":", 1) for line in lines)}


def _whole(held: bytearray) -> Iterator[bytes]:
    """Take the complete records off the front of `held`."""
    done = 0
    while (head := held.find(b"\r\n\r\n", done)) >= 0:
        end = head + 4 + int(_fields(bytes(held[done:head]))["content-length"]) + 4
        if end > len(held):
            break
        yield bytes(held[done:end])
        done = end
    del held[:done]


def records_of(data: bytes, piece: int = 1 << 16, most: int = 1 << 22) -> Iterator[bytes]:
    """The records of a gzip stream, inflated once from front to end; several members are read as one stream."""
    inflate, held = zlib.decompressobj(31), bytearray()
    for at in range(0, len(data), piece):
        chunk = data[at:at + piece]
        while chunk:
            held += inflate.decompress(chunk, most)
            yield from _whole(held)
            if inflate.eof:
                chunk, inflate = inflate.unused_data, zlib.decompressobj(31)
            else:
                chunk = inflate.unconsumed_tail
    held += inflate.flush()
    yield from _whole(held)
    if held:
        raise ValueError(f"{len(held)} bytes after the last record")


def member_of(record: bytes) -> bytes:
    """A gzip member that ends in a zero byte, as the length field of anything below 16 MiB does.

    A longer record is followed by an empty member, whose length field is zero.
    """
    deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
    member = deflate.compress(record) + deflate.flush()
    return member + zlib.compressobj(6, zlib.DEFLATED, 31).flush() if member[-1] else member


def _rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for streams in batches:
        for file, content in zip(*(c.to_pylist() for c in streams.columns)):
            archive, offsets = bytearray(), []
            for record in records_of(content):
                offsets.append(len(archive))
                archive += member_of(record)
            if offsets:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([file]), pa.array([bytes(archive)], pa.binary()), pa.array([offsets], pa.list_(pa.int64()))],
                    ["file", "archive", "offsets"])


def normalise(spark: SparkSession, source: str, path: str) -> DataFrame:
    """Rewrite the archives in `source` to `path/archives`, one for one; the index is in `path/index`.

    The index `(file, ordinal, offset, length)` says where each record's member lies in the
    archive `file=...`. The text writer ends a row with a zero byte, which is what the last
    member ends in, so an archive is written as a row without its last byte.
    """
    streams = spark.read.format("binaryFile").load(source).select(
        F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    between = new_path(spark, "warc-archives")
    streams.mapInArrow(_rewrite, ARCHIVES).write.parquet(between)
    archives = spark.read.schema(ARCHIVES).parquet(between)
    body = F.substring(F.col("archive"), F.lit(1), F.octet_length("archive") - 1).cast("string")
    archives.select("file", body.alias("value")).write.partitionBy("file").option("lineSep", "\0").text(f"{path}/archives")
    end = F.coalesce(F.get("offsets", F.col("ordinal") + 1), F.col("size"))
    archives.select("file", "offsets", F.octet_length("archive").cast("long").alias("size"), F.posexplode("offsets").alias("ordinal", "offset")).select(
        "file", "ordinal", "offset", (end - F.col("offset")).alias("length")).write.parquet(f"{path}/index")
    discard(spark, between)  # archives and index are complete
    return spark.read.schema("file string, ordinal int, offset long, length long").parquet(f"{path}/index")


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    page = lambda urn: int(urn[10:-1]) if urn and len(urn) > 11 else None
    for content, places in ((c.as_py(), p) for batch in batches for c, p in zip(batch.column(0), batch.column(1))):
        rows, held = [], 0
        for place in places.as_py():
            (record,) = records_of(content[place["offset"]:place["offset"] + place["length"]])
            head, _, rest = record.partition(b"\r\n\r\n")
            fields, payload = _fields(head), rest[:-4]
            digest, size = fields["warc-payload-digest"].removeprefix("sha256:"), int(fields["x-payload-length"])
            if fields["warc-type"] == "response" and (len(payload), hashlib.sha256(payload).hexdigest()) != (size, digest):
                raise ValueError(f"{fields['warc-record-id']}: the payload differs from its digest")
            rows.append((page(fields["warc-record-id"]), size, digest, fields["warc-type"],
                         page(fields.get("warc-refers-to")), payload if fields["warc-type"] == "response" else None))
            held += len(payload)
            if held > BATCH_BYTES:
                yield _record_batch(rows)
                rows, held = [], 0
        yield _record_batch(rows)


def _record_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(),
             "refers_to": pa.int64(), "payload": pa.binary()}
    columns = list(zip(*rows)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.values())], list(kinds))


def read_archives(spark: SparkSession, path: str, index: DataFrame) -> DataFrame:
    """The records of a normalised folder by its index, payloads checked against their digests.

    `payload` is null for revisits; `payload_bytes` and `payload_digest` are of the full payload.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/archives").select(
        F.regexp_extract("path", "/file=([^/]+)/", 1).alias("file"), "content")
    # One row a file, so that a file's content meets its places once.
    places = index.groupBy("file").agg(F.collect_list(F.struct("offset", "length")).alias("places"))
    return files.join(places.hint("merge"), "file").select("content", "places").mapInArrow(_parse, RECORDS)


def archive_pages(pages: DataFrame, path: str, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Write `pages` as archives under `path`, normalise them, and read them back.

    Null html is an empty payload. Of equal payloads of at least 100 bytes the smallest
    page_id is a response and the others revisit it; rows that repeat that page_id are
    responses too. Shorter payloads are all responses. A null page_id makes a record
    without a number, which refers like any other but is only referred to by none. An empty
    table gives no records. Other columns are not read.
    """
    spark = pages.sparkSession
    streams = new_path(spark, "warc-streams")
    write_archives(plan_records(pages, id_col, html_col), streams)
    index = normalise(spark, streams, path)
    discard(spark, streams)  # the normalised archives take their place
    return read_archives(spark, path, index)

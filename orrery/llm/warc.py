"""WARC archives as a chunked record table.

An archive is a table of rows (archive, record_id, chunk_no, chunks, data, running): the data of a record's rows in order
of chunk_no are its bytes, so no row and no buffer holds more than a chunk of a payload. `running` is the SHA-1 of the
payload up to and with the chunk, carried forward chunk by chunk on writing and checked likewise on reading. A payload is
cut into chunk rows before it leaves the JVM; the writer and the reader hold one chunk of a record at a time.

Which record is the response of a group of equal payloads is found on (page_id, digest) rows alone.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import kept, partitions, with_heavy, written

CHUNK = 1 << 18
ROWS = 64  # chunk rows in memory at once
MOST_BROADCAST = 200_000  # revisits known on every executor
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
ARCHIVE = "archive int, record_id string, chunk_no int, chunks int, data binary, running binary"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, chunks int"
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_of_hex(digest: Column) -> Column:
    """A SHA-1 in hex digits -> in upper-case base32; five hex digits are four base32 digits."""
    out = []
    for i in range(8):
        part = F.conv(F.substring(digest, 1 + 5 * i, 5), 16, 10).cast("int")
        out += [F.substr(F.lit(_ALPHABET), F.shiftright(part, shift).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for shift in (15, 10, 5, 0)]
    return F.concat(*out)


def _header(kind: str, record: str, page: int | None, url: str | None, digest: str, size: int, refers: int | None) -> bytes:
    body = len(HTTP) + (size if kind == "response" else 0)
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    lines += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"X-Payload-Length: {size}"]
    if page is not None:
        lines.append(f"X-Page-Id: {page}")
    if refers is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page-Id: {refers}"]
    lines.append(f"Content-Length: {body}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + HTTP


def read_record(chunks: Iterator[tuple[int, int, bytes, bytes]], record: str) -> tuple:
    """Fold a record's chunks, checking lengths and digests; holds one chunk at a time."""
    sha, fields, seen, body, state = hashlib.sha1(), {}, 0, 0, None
    for no, total, data, running in chunks:
        if no != seen:
            raise ValueError(f"{record}: chunk {seen} is missing")
        seen += 1
        view = memoryview(data)
        if no == 0:
            end = data.index(b"\r\n\r\n") + 4
            lines = data[:end].decode().split("\r\n")
            if not lines[0].startswith("WARC/"):
                raise ValueError(f"{record}: no WARC header")
            fields = dict(x.split(": ", 1) for x in lines[1:] if x)
            if fields["WARC-Record-ID"] != f"<{record}>":
                raise ValueError(f"{record}: wrong record id")
            view = view[end:]
            body += len(HTTP)
            if bytes(view[: len(HTTP)]) != HTTP:
                raise ValueError(f"{record}: no HTTP header")
            view = view[len(HTTP) :]
        if no == total - 1:
            if bytes(view[-4:]) != b"\r\n\r\n":
                raise ValueError(f"{record}: no end")
            view = view[:-4]
        sha.update(view)
        body += len(view)
        if sha.digest() != running:
            raise ValueError(f"{record}: chunk {no} does not match its digest")
        state = total
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if seen != state or body != int(fields["Content-Length"]):
        raise ValueError(f"{record}: wrong length")
    if kind == "response" and base64.b32encode(sha.digest()).decode() != digest:
        raise ValueError(f"{record}: wrong digest")
    page, refers = fields.get("X-Page-Id"), fields.get("X-Refers-To-Page-Id")
    return (page and int(page), fields.get("WARC-Target-URI"), int(fields["X-Payload-Length"]), digest, kind, refers and int(refers), record, state)


def write_archive(pages: DataFrame, min_revisit_bytes: int = 0, chunk: int = CHUNK) -> DataFrame:
    """The chunk table of a WARC record per row of pages (page_id, url, html), written to the shared folder.

    The payload is html in UTF-8; null is empty. Of equal payloads of at least `min_revisit_bytes` the record with the
    largest page_id is the response and the others revisit it; smaller ones are all responses. Repeated rows of that page
    are responses too. A row with a null page_id revisits the largest page_id of its payload, or is a response if there
    is none. A null url is left out. Other columns are not read; an empty table gives an empty archive.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").alias("url"), F.coalesce(F.encode(F.col("html"), "UTF-8"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("size", F.octet_length("payload").cast("long"))
    small = kept(rows.select("page_id", "digest", "size"))
    heads = small.where(F.col("size") >= min_revisit_bytes).groupBy("digest").agg(F.max("page_id").alias("head"), F.count("*").alias("n"))
    named = with_heavy(small, heads, "digest", "n")
    refers = kept(named.where("head is not null and (page_id is null or page_id <> head)").select(F.col("page_id").alias("p"), F.col("digest").alias("d"), "head").distinct())
    side = F.broadcast(refers) if refers.count() <= MOST_BROADCAST else refers  # else payloads travel once
    joined = rows.join(side, F.col("page_id").eqNullSafe(F.col("p")) & (F.col("digest") == F.col("d")), "left")
    chunks = F.when(F.col("head").isNotNull(), 1).otherwise(F.greatest(F.lit(1), F.ceil(F.col("size") / chunk))).cast("int")
    cut = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda k: F.struct(k.alias("no"), F.when(F.col("head").isNull(), F.substring(F.col("payload"), k * chunk + 1, F.lit(chunk))).alias("data")))
    cut = joined.withColumn("chunks", chunks).select("page_id", "url", "digest", "size", "head", "chunks", F.explode(cut).alias("c")).select("page_id", "url", "digest", "size", "head", "chunks", "c.no", "c.data")

    def write(batches):
        task, count, record, sha = TaskContext.get().partitionId(), 0, "", None
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                out: list[tuple] = []
                for page, url, digest, size, head, chunks, no, data in zip(*(c.to_pylist() for c in batch.slice(lo, ROWS).columns)):
                    kind = "response" if head is None else "revisit"
                    if no == 0:
                        record, sha = uuid.uuid5(uuid.NAMESPACE_URL, f"record:{page}:{task}:{count}").urn, hashlib.sha1()
                        count += 1
                    data = data or b""
                    sha.update(data)
                    start = b"" if no else _header(kind, record, page, url, base64.b32encode(bytes.fromhex(digest)).decode(), size, head)
                    out.append((task, record, no, chunks, start + data + (b"\r\n\r\n" if no == chunks - 1 else b""), sha.digest()))
                yield _rows(out)

    return written(cut.mapInArrow(write, ARCHIVE))


def _rows(out: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
    names = ("archive", "record_id", "chunk_no", "chunks", "data", "running")
    return pa.record_batch({n: pa.array(c, k) for n, k, c in zip(names, kinds, zip(*out))})


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (record_id, chunk_no) -> records; a record may span batches."""
    from itertools import groupby

    def rows():
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                some = batch.slice(lo, ROWS)
                yield from zip(*(some.column(c).to_pylist() for c in ("record_id", "chunk_no", "chunks", "data", "running")))

    out = []
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int32())
    names = ("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", "chunks")
    flush = lambda: pa.record_batch({n: pa.array(c, k) for n, k, c in zip(names, kinds, zip(*out))})
    for record, group in groupby(rows(), key=lambda r: r[0]):
        out.append(read_record((r[1:] for r in group), record))
        if len(out) == 5000:
            yield flush()
            out = []
    if out:
        yield flush()


def read_archive(archive: DataFrame) -> DataFrame:
    """Records of a chunk table, every chunk checked. Records of one chunk are read where they lie; the chunks of the
    others meet by record and are folded in order, one in memory at a time."""
    one = archive.where("chunks = 1").mapInArrow(_read, RECORD)
    more = archive.where("chunks > 1").repartition(partitions(archive.sparkSession), "record_id").sortWithinPartitions("record_id", "chunk_no")
    return one.unionByName(more.mapInArrow(_read, RECORD))

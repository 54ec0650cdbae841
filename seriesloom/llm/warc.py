"""WARC archives: one gzip member per record, and a reader that splits files at any byte."""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_streams, partitions

MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1."
#: Payloads below this many bytes are never stored as revisits.
LEAST_REVISIT = 100
FILE_BYTES = 1 << 30
SPLIT_BYTES = 8 << 20
#: Bytes of a member that the check of its header inflates at most.
PEEK = 4096
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string"


def with_revisits(pages: DataFrame) -> DataFrame:
    """page_id, url, html (null: empty), digest, refers_to (null on responses).

    Of equal payloads of at least LEAST_REVISIT bytes the smallest page_id is the response. Only digests and ids are grouped,
    combined on the map side; the join keeps pages on the left, where a hot digest can be split. Rows that repeat the smallest
    page_id are responses too; a null page_id is a revisit only where its group has an id.
    """
    body = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", body.alias("html"), F.sha2(body, 256).alias("digest"))
    narrow = pages.select(F.col("page_id").cast("long").alias("page_id"), F.sha2(body, 256).alias("digest"), F.octet_length(body).alias("size")).filter(F.col("size") >= LEAST_REVISIT)
    firsts = narrow.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest", "first")
    refers = F.when(F.col("page_id").eqNullSafe(F.col("first")), None).otherwise(F.col("first"))
    return rows.join(firsts, "digest", "left").select("page_id", "url", "html", "digest", refers.alias("refers_to"))


def urn(page_id: int | None) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str, level: int) -> bytes:
    kind = "response" if refers_to is None else "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {urn(page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub("[\x00-\x20%\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    lines.append(f"WARC-Payload-Digest: sha256:{digest}")
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {urn(refers_to)}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    pack = zlib.compressobj(level, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()


def write_warc(rows: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z", level: int = 3) -> DataFrame:
    """Write what ``with_revisits`` gives, and return path, size and records of each file.

    Tasks write to the shared folder under names of their own; only files that a finished task reports count, so what a
    lost or repeated task leaves behind is never read. Materialise the result before reading.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        out, done, size, n, path = None, [], 0, 0, ""
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    path, size, n = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(f"{base}/{path}", compression=None)
                page_id, url, html, digest, refers_to = row
                size += out.write(record(page_id, url, html.encode(), digest, refers_to, date, level))
                n += 1
                if size >= FILE_BYTES:
                    out.close()
                    done, out = [*done, (f"{folder}/{path}", size, n)], None
        if out is not None:
            out.close()
            done.append((f"{folder}/{path}", size, n))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), (pa.string(), pa.int64(), pa.int64()))], names=["path", "size", "records"])

    return map_streams(rows.select("page_id", "url", "html", "digest", "refers_to"), run, "path string, size long, records long")


def parse(data: bytes, check: bool = True) -> tuple:
    """page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    named = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(named["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(re.search(rb"Content-Length: ([0-9]+)", http)[1])
    digest = named["WARC-Payload-Digest"].removeprefix("sha256:")
    kind, ids = named["WARC-Type"], []
    for field in ("WARC-Record-ID", "WARC-Refers-To"):
        number = named.get(field, urn(None))[len("<urn:x-page:") : -1]
        ids.append(int(number) if number else None)
    if kind == "response":
        found = hashlib.sha256(payload).hexdigest()
        if check and (found != digest or len(payload) != length):
            raise ValueError(f"record {named['WARC-Record-ID']} is damaged")
        digest = found
    url = named.get("WARC-Target-URI")
    if url is not None:
        url = re.sub("%([0-9A-F]{2})", lambda m: chr(int(m[1], 16)), url)
    return ids[0], url, kind, ids[1], length, digest, payload


class ByteRange:
    """Reads of a file at any place, a block at a time."""

    def __init__(self, file, size: int, block: int = 1 << 18):
        self.file, self.size, self.block = file, size, block

    def at(self, place: int, n: int | None = None) -> bytes:
        n = min(n or self.block, self.size - place)
        if n <= 0:
            return b""
        self.file.seek(place)
        return self.file.read(n)


def is_member(source: ByteRange, place: int) -> bool:
    """Whether a gzip member with a WARC header starts here: its first bytes must inflate to one."""
    try:
        return zlib.decompressobj(31).decompress(source.at(place, PEEK), 16).startswith(VERSION)
    except zlib.error:
        return False


def inflate(source: ByteRange, place: int, window: bytes = b"") -> tuple[bytes, int]:
    """A member's content and the place behind it; ``window`` has the file's bytes from ``place`` as far as they are at hand."""
    unpack, out = zlib.decompressobj(31), []
    data = window or source.at(place)
    while data:
        out.append(unpack.decompress(data))
        place += len(data)
        if unpack.eof:
            return b"".join(out), place - len(unpack.unused_data)
        data = source.at(place)
    raise ValueError("a record ends with its file")


def records_of(source: ByteRange, start: int, end: int) -> Iterator[tuple]:
    """Records whose first byte lies in [start, end): find the first true member, then go from end to start of the next."""
    held = source.at(start, end - start + len(MAGIC) - 1)
    at, known = 0, False
    while at < end - start:
        if not known or held[at : at + len(MAGIC)] != MAGIC:
            at, known = held.find(MAGIC, at), False
            if at < 0 or at >= end - start:
                return
            if not is_member(source, start + at):
                at += 1
                continue
        data, after = inflate(source, start + at, held[at : at + source.block])
        yield parse(data)
        at, known = after - start, True


def read_warc(files: DataFrame, split_bytes: int = SPLIT_BYTES, payload: bool = True) -> DataFrame:
    """The records of ``files`` (path, size), see RECORD, and their payload if wanted (null on revisits).

    Files are cut at every ``split_bytes``, wherever that falls; each range is a task's unit of work, so a file needs no index.
    An empty payload has 0 bytes; an absent url or id is null; an empty list of files gives no rows.
    """
    cuts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(split_bytes).cast("long")))
    ranges = files.filter("size > 0").select("path", "size", cuts.alias("start")).withColumn("end", F.least(F.col("start") + split_bytes, "size"))
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
    names = [*(x.split()[0] for x in RECORD.split(", ")), "payload"]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        cols = [pa.array(c, t) for c, t in zip(zip(*rows), kinds)]
        return pa.RecordBatch.from_arrays(cols[: 6 + payload], names=names[: 6 + payload])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for path, total, start, end in zip(*(c.to_pylist() for c in batch.columns)):
                store, name = fs.FileSystem.from_uri(path)
                with store.open_input_file(name) as file:
                    for row in records_of(ByteRange(file, total), start, end):
                        held.append(row if row[2] == "response" else (*row[:6], None))
                        size += row[4] if payload else 1
                        if len(held) >= 2000 or size > 16 << 20:
                            yield batch_of(held)
                            held, size = [], 0
        if held:
            yield batch_of(held)

    spread = ranges.repartition(partitions(files.sparkSession), "path", "start")
    return map_streams(spread, run, RECORD + ", payload binary" * payload)

"""WARC archives: a writer of one gzip member per record, and a splittable reader.

Writing: each record is a gzip member whose last byte is 0, the top byte of a size
below 16 MiB (a longer record gets an empty member behind it). Spark's text writer
puts the members in files, that 0 byte being its line separator, so any store that
Spark writes to will do and its committer deals with retries.

Reading: a task scans a byte range of a file for the gzip magic, takes a place as a
member only if what it decodes to begins as a WARC header, and owns the records
that start inside its range, reading beyond the end for the last of them.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphmill.llm.common import lean, small_batches

MAGIC = b"\x1f\x8b\x08"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SPLIT_BYTES = 16 << 20
PIECE, FEED = 1 << 20, 1 << 14
#: An empty gzip member.
EMPTY_MEMBER = bytes.fromhex("1f8b08000000000000ff03000000000000000000")


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def member(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """The gzip member of a response record, or of a revisit if refers_to is given."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    name = lambda i: f"<urn:page:{'null' if i is None else i}>"
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=''.join(map(chr, range(33, 127))))}")
    head.append(f"WARC-Payload-Digest: sha1:{payload_digest(payload)}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: {name(refers_to)}", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
    packed = deflate.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + deflate.flush()
    return packed if packed[-1] == 0 else packed + EMPTY_MEMBER


def with_first(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, payload (html in UTF-8; null: empty), refers_to: the smallest page_id of an equal payload, null where it is the own."""
    plain = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    keyed = plain.withColumn("same", F.sha2("html", 256))
    first = keyed.groupBy("same").agg(F.min("page_id").alias("first"))
    refers = F.when((F.col("page_id") != F.col("first")) & (F.octet_length("html") >= least_bytes), F.col("first"))
    return keyed.join(first, "same").select("page_id", "url", F.col("html").cast("binary").alias("payload"), refers.alias("refers_to"))


def write(pages: DataFrame, path: str, least_bytes: int = 0, date: str = "2000-01-01T00:00:00Z") -> None:
    """Write pages (page_id, url, html) as archives in the folder `path`.

    Of records with equal payloads of at least least_bytes the one with the
    smallest page_id is a response, the others are revisits of it; rows that
    repeat that smallest page_id are all responses, and so is a row whose page_id
    is null. A null html is an empty payload, a null url leaves out the target;
    other columns are ignored. No rows: no files.
    """
    small_batches(pages.sparkSession, 500)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = (member(i.as_py(), u.as_py(), p.as_py(), r.as_py(), date)[:-1] for i, u, p, r in zip(*batch.columns, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], names=["member"])

    members = with_first(pages, least_bytes).mapInArrow(lean(run), "member binary")
    members.select(F.col("member").cast("string").alias("value")).write.option("lineSep", "\0").option("compression", "none").text(path)


class _File:
    """Random reads of a file through two cached pieces."""

    def __init__(self, path: str) -> None:
        from pyarrow import fs

        store, inner = fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", path))
        self.file = store.open_input_file(inner)
        self.size = self.file.size()
        self.pieces: dict[int, bytes] = {}

    def at(self, place: int) -> memoryview:
        """What the piece that holds `place` has from there on; empty at the end."""
        k = place // PIECE
        if k not in self.pieces:
            if len(self.pieces) > 1:
                self.pieces.pop(min(self.pieces))
            self.pieces[k] = self.file.read_at(min(PIECE, max(0, self.size - k * PIECE)), k * PIECE) if k * PIECE < self.size else b""
        return memoryview(self.pieces[k])[place - k * PIECE :]

    def find(self, place: int, end: int) -> int:
        """The first place of the magic in [place, end), or -1."""
        while place < end:
            piece = self.at(place)
            if not piece:
                return -1
            if piece[:3] == MAGIC:
                return place
            here = bytes(piece) + bytes(self.at(place + len(piece))[:2])
            found = here.find(MAGIC)
            if found >= 0:
                return place + found if place + found < end else -1
            place += len(piece)
        return -1

    def decode(self, place: int) -> tuple[bytes, int] | None:
        """(content, length) of the member at `place`; None if there is none, or it isn't a WARC record. An empty member has no content."""
        inflate = zlib.decompressobj(31)
        out: list[bytes] = []
        at, start, seen = place, b"", 0
        while not inflate.eof:
            piece = self.at(at)[:FEED]
            if not piece:
                return None
            try:
                got = inflate.decompress(piece)
            except zlib.error:
                return None
            at += len(piece) - len(inflate.unused_data)
            out.append(got)
            if seen < 5:
                start = (start + got)[:5]
                seen = len(start)
                if start != b"WARC/"[:seen]:
                    return None
        return b"".join(out), at - place


_HEADER = re.compile(rb"([A-Za-z-]+):[ \t]*(.*)")
RECORDS = "record_id string, record_type string, target_uri string, payload_bytes long, payload_digest string, declared_digest string, refers_to string"


def records(path: str, start: int, end: int) -> Iterator[dict]:
    """The records that begin in [start, end) of the file."""
    file, place = _File(path), start
    while 0 <= (place := file.find(place, end)):
        got = file.decode(place)
        if got is None:
            place += 1
            continue
        content, length = got
        place += length
        if not content:
            continue
        head, _, rest = content.partition(b"\r\n\r\n")
        fields = {m[1].lower(): m[2].strip() for m in map(_HEADER.match, head.split(b"\r\n")[1:]) if m}
        block = rest[: int(fields.get(b"content-length", len(rest)))]
        http, payload = {}, block
        if fields.get(b"content-type", b"").startswith(b"application/http"):
            top, _, payload = block.partition(b"\r\n\r\n")
            http = {m[1].lower(): m[2].strip() for m in map(_HEADER.match, top.split(b"\r\n")[1:]) if m}
        said = lambda k: fields[k].decode("utf-8", "replace") if k in fields else None
        kind = said(b"warc-type")
        declared = (said(b"warc-payload-digest") or "").removeprefix("sha1:") or None
        full = kind != "revisit"
        yield {
            "record_id": said(b"warc-record-id"),
            "record_type": kind,
            "target_uri": said(b"warc-target-uri"),
            "payload_bytes": len(payload) if full else int(http.get(b"content-length", 0)),
            "payload_digest": payload_digest(payload) if full else declared,
            "declared_digest": declared,
            "refers_to": said(b"warc-refers-to"),
            "payload": payload if full else None,
        }


def read(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES, payload: bool = True) -> DataFrame:
    """A row per record of all archives under `path`; payload=False leaves out the column payload.

    payload_bytes and payload_digest are of the full payload; a revisit has them
    from its own headers and a null payload. Files are opened through Arrow's file
    systems (local, HDFS, S3, GCS). Plain gzip members that hold no record are
    passed over. No files: no rows.
    """
    small_batches(spark, 500)
    schema = RECORDS + ", payload binary" * payload
    columns = [c.split()[0] for c in schema.split(", ")]
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length").where("length > 0")
    starts = files.select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(split_bytes).cast("long"))).alias("start"))
    ranges = starts.select("path", "start", F.least(F.col("start") + split_bytes, F.col("length")).alias("end"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                held, size = [], 0
                for record in records(row["path"], row["start"], row["end"]):
                    held.append({c: record[c] for c in columns})
                    size += len(record["payload"] or b"") * payload + 500
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pylist(held, arrow)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, arrow)

    arrow = pa.schema([(c, pa.int64() if c == "payload_bytes" else pa.binary() if c == "payload" else pa.string()) for c in columns])
    return ranges.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))).mapInArrow(lean(run), schema)

"""WARC archives: one gzip member a record, written in parallel and read back sequentially.

Writing. Records whose payloads are equal share one response, that with the largest id; the others are revisit records that
refer to it. Only (hash, id) pairs are grouped for this, hot payloads being summed before the shuffle; the repeated payloads
come back to the rows by a broadcast if there are at most BROADCAST_ROWS of them, else by a join salted on both sides. Each
task then writes files of about ROLL octets to the shared folder under names of its own attempt, and returns their names; only
files in that written list count, so what a lost or repeated attempt leaves is never read.

Reading. A task reads one file from its start: it decompresses member by member as octets arrive, frames the block by
Content-Length, and checks block and payload digests on the way, so a record of any size needs little memory unless its
payload is asked for. A revisit has no payload; its HTTP header keeps the payload's length and its WARC header the digest.

Defined results: null texts are empty payloads; records with a null id are responses, or revisits of the largest id with that
payload; rows that repeat the largest id are all responses; an empty table gives no archives and no records; null urls have no
target; line breaks and spaces in urls are percent-encoded; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, shared_folder

BROADCAST_ROWS = 100_000
SALTS = 16
#: Octets after which a task starts a new file.
ROLL = 64 << 20
CHUNK = 1 << 16
DATE = "2026-01-01T00:00:00Z"
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(payload: bytes, record_id: object, url: str | None, refers_to: object, is_revisit: bool) -> bytes:
    """A WARC record as a gzip member."""
    own = digest(payload)
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if not is_revisit:
        block += payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if is_revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if record_id is None else record_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + "".join(c if " " < c != "\x7f" else f"%{ord(c):02X}" for c in url))
    lines += [f"WARC-Payload-Digest: sha1:{own}", f"WARC-Block-Digest: sha1:{digest(block)}"]
    if is_revisit:
        lines += [f"WARC-Profile: {IDENTICAL}", f"WARC-Refers-To: <urn:page:{'' if refers_to is None else refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


@dataclass
class _Record:
    """A record as its octets arrive: header, block, then the two line ends."""

    keep: bool
    head: bytearray = field(default_factory=bytearray)
    fields: dict[str, str] | None = None
    left: int = 0
    http: bytearray | None = field(default_factory=bytearray)
    http_fields: dict[str, str] = field(default_factory=dict)
    tail: bytearray = field(default_factory=bytearray)
    payload: bytearray = field(default_factory=bytearray)
    payload_bytes: int = 0

    def __post_init__(self) -> None:
        self.block_sum, self.payload_sum = hashlib.sha1(), hashlib.sha1()

    @staticmethod
    def _fields(head: bytes) -> dict[str, str]:
        pairs = (x.partition(b":") for x in head.split(b"\r\n")[1:])
        return {k.decode("latin-1").strip().lower(): v.decode("utf-8", "surrogatepass").strip() for k, _, v in pairs}

    def feed(self, data: bytes) -> None:
        if self.fields is None:
            self.head += data
            if (end := self.head.find(b"\r\n\r\n")) < 0:
                return
            if not self.head.startswith(b"WARC/"):
                raise ValueError("a member doesn't start with a WARC version")
            self.fields, data = self._fields(bytes(self.head[:end])), bytes(self.head[end + 4 :])
            self.left = int(self.fields["content-length"])
        block, data = data[: self.left], data[self.left :]
        self.left -= len(block)
        self.block_sum.update(block)
        self.tail += data
        if self.http is not None:
            self.http += block
            if (end := self.http.find(b"\r\n\r\n")) < 0:
                return
            self.http_fields, block, self.http = self._fields(bytes(self.http[:end])), bytes(self.http[end + 4 :]), None
        self.payload_sum.update(block)
        self.payload_bytes += len(block)
        if self.keep:
            self.payload += block

    def done(self) -> dict:
        if self.fields is None or self.left or self.tail != b"\r\n\r\n":
            raise ValueError("a record ends before its Content-Length says, or runs on")
        kind = self.fields["warc-type"]
        named = self.fields.get("warc-payload-digest", "").removeprefix("sha1:")
        b32 = lambda h: base64.b32encode(h.digest()).decode()
        own = named if kind == "revisit" else b32(self.payload_sum)  # a revisit has no payload of its own
        good = self.fields.get("warc-block-digest") == f"sha1:{b32(self.block_sum)}" and named == own
        urn = lambda k: self.fields.get(k, "").removeprefix("<urn:page:").removesuffix(">") or None
        return {
            "record_id": urn("warc-record-id"), "url": self.fields.get("warc-target-uri"), "record_type": kind, "payload_digest": own, "refers_to": urn("warc-refers-to"), "verified": good,
            "payload_bytes": int(self.http_fields["content-length"]) if kind == "revisit" else self.payload_bytes, "payload": bytes(self.payload) if self.keep and kind == "response" else None,
        }


def read_records(stream: BinaryIO, keep: bool = False) -> Iterator[dict]:
    """Every record of an archive in order; keep: with the payloads of responses. Raises on truncation."""
    data = stream.read(CHUNK)
    while data:
        z, found = zlib.decompressobj(31), _Record(keep)
        while not z.eof:
            if not data and not (data := stream.read(CHUNK)):
                raise EOFError("an archive ends inside a member")
            found.feed(z.decompress(data, 1 << 20))
            data = z.unused_data if z.eof else z.unconsumed_tail
        yield found.done()
        data = data or stream.read(CHUNK)


def _with_roles(pages: DataFrame, least: int) -> DataFrame:
    """id, url, html and last: the id of the response with that payload, null where the payload is unique or under `least` octets."""
    pages = pages.withColumn("key", F.unhex(F.sha2(F.col("html").cast("binary"), 256)))
    counts = pages.filter(F.octet_length("html") >= least).groupBy("key").agg(F.count("*").alias("n"), F.max("id").alias("last"))
    repeated = materialize(counts.filter("n > 1").select("key", "last"), "warc-repeated")
    if repeated.count() <= BROADCAST_ROWS:
        out = pages.join(F.broadcast(repeated), "key", "left")
    else:
        salted = repeated.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        out = pages.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).join(salted, ["key", "salt"], "left")
    return out.select("id", "url", "html", "last")


def write_archives(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0) -> DataFrame:
    """Write a record for each row and return the list of archives: path, records, octets. Equal payloads of `least` octets or more are revisits."""
    folder = f"{folder or shared_folder(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    rows = _with_roles(pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html")), least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        out, path, n, octets = None, "", 0, 0

        def closed() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_pydict({"path": [path], "records": [n], "octets": [octets]})

        for b in batches:
            for i, url, html, last in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if out is None:
                    store.create_dir(root, recursive=True)
                    path, n, octets = f"{root}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(path, compression=None)
                member = record(html.encode("utf-8", "surrogatepass"), i, url, last, last is not None and i != last)
                out.write(member)
                n, octets = n + 1, octets + len(member)
                if octets >= ROLL:
                    yield closed()
                    out = None
        if out is not None:
            yield closed()

    return materialize(rows.mapInArrow(run, "path string, records bigint, octets bigint").withColumn("folder", F.lit(folder)), "warc-list")


def read_archives(archives: DataFrame, payloads: bool = False, strict: bool = True) -> DataFrame:
    """A row for each record of the listed archives, one file at a time; payload_digest is that of the octets read. strict: a record whose digests don't hold is an error. record_id, url, record_type, payload_digest, refers_to, verified, payload_bytes, payload (null unless asked for)."""
    n = max(1, archives.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for b in batches:
            for path, folder in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                store, _ = fs.FileSystem.from_uri(folder)
                rows, size = [], 0
                with store.open_input_stream(path, compression=None) as stream:
                    for r in read_records(stream, payloads):
                        if strict and not r["verified"]:
                            raise ValueError(f"the digests of record {r['record_id']} in {path} don't hold")
                        rows.append(r)
                        size += 200 + len(r["payload"] or b"")
                        if size >= 4 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema)

    schema = pa.schema([("record_id", pa.string()), ("url", pa.string()), ("record_type", pa.string()), ("payload_digest", pa.string()), ("refers_to", pa.string()), ("verified", pa.bool_()), ("payload_bytes", pa.int64()), ("payload", pa.binary())])
    return archives.select("path", "folder").repartition(n).mapInArrow(run, "record_id string, url string, record_type string, payload_digest string, refers_to string, verified boolean, payload_bytes bigint, payload binary")

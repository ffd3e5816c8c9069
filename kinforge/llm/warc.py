"""WARC archives: one gzip member per record, written and read in sequence.

The writer gives each task archives of its own, named by the attempt, so that a repeated task never
touches another one's file; a manifest names those of the attempts that counted. The reader inflates
members step by step, frames records by their content length and verifies block and payload digests.

Defined results: a null html is an empty payload; payloads under ``MIN_REVISIT`` bytes are always
responses; of equal payloads the one with the smallest page_id is the response (rows that repeat that
page_id, and rows without a page_id, are responses as well); a null url becomes a urn of the page; an
empty table gives no archive and no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinforge.llm._store import fresh_path, written

MIN_REVISIT = 100
#: Compressed bytes after which a task begins another archive.
ARCHIVE_BYTES = 256 << 20
READ_BYTES = 1 << 18
_DATE = "2020-01-01T00:00:00Z"
_PAGE = "urn:x-page:"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class WarcError(ValueError):
    """An archive whose framing or digests are wrong."""


@dataclass
class Record:
    headers: dict[str, str]
    block: bytes
    http: dict[str, str] = field(default_factory=dict)
    payload: bytes = b""

    @property
    def type(self) -> str:
        return self.headers["warc-type"]


def record_bytes(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    """A record as one gzip member."""
    lines = [("WARC-Type", kind), *headers, ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines) + "\r\n"
    z = zlib.compressobj(4, zlib.DEFLATED, 31)
    return z.compress(head.encode() + block + b"\r\n\r\n") + z.flush()


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response with the payload, or a revisit with the HTTP header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    headers = [
        ("WARC-Record-ID", f"<{_PAGE}{'' if page_id is None else page_id}>"),
        ("WARC-Date", _DATE),
        ("WARC-Target-URI", f"{_PAGE}{page_id}" if url is None else quote(url, safe="!#$%&'()*+,/:;=?@[]~")),
        ("Content-Type", "application/http;msgtype=response"),
        ("WARC-Payload-Digest", f"sha256:{hashlib.sha256(payload).hexdigest()}"),
    ]
    if refers_to is None:
        return record_bytes("response", headers, http + payload)
    return record_bytes("revisit", [*headers, ("WARC-Profile", _PROFILE), ("WARC-Refers-To", f"<{_PAGE}{refers_to}>")], http)


def _headers(raw: bytes) -> dict[str, str]:
    out = {}
    for line in raw.decode("utf-8").split("\r\n")[1:]:
        name, sep, value = line.partition(":")
        if not sep:
            raise WarcError(f"not a header: {line[:80]!r}")
        out[name.strip().lower()] = value.strip()
    return out


class _Member:
    """The inflated bytes of one gzip member, read step by step."""

    def __init__(self, stream, left: bytes):
        self.stream, self.z, self.buffer, self.raw = stream, zlib.decompressobj(31), bytearray(), left

    def more(self) -> bool:
        if self.z.eof:
            return False
        if not self.raw and not self.z.unconsumed_tail:
            self.raw = self.stream.read(READ_BYTES)
            if not self.raw:
                raise WarcError("the archive ends inside a record")
        self.buffer += self.z.decompress(self.z.unconsumed_tail + self.raw, READ_BYTES)
        self.raw = b""
        return True

    def until(self, mark: bytes) -> bytes:
        at = 0
        while (k := self.buffer.find(mark, at)) < 0:
            at = max(0, len(self.buffer) - len(mark))
            if not self.more():
                raise WarcError("no end of the header")
        out = bytes(self.buffer[:k])
        del self.buffer[: k + len(mark)]
        return out

    def exactly(self, n: int) -> bytes:
        while len(self.buffer) < n:
            if not self.more():
                raise WarcError("the record is shorter than its content length")
        out = bytes(self.buffer[:n])
        del self.buffer[:n]
        return out


def read_records(stream) -> Iterator[Record]:
    """The records of an open archive, in order, each verified."""
    left = b""
    while True:
        left = left or stream.read(READ_BYTES)
        if not left:
            return
        m = _Member(stream, left)
        try:
            head = m.until(b"\r\n\r\n")
            if not head.startswith(b"WARC/1."):
                raise WarcError("not a WARC record")
            r = Record(_headers(head), b"")
            r.block = m.exactly(int(r.headers["content-length"]))
            if m.exactly(4) != b"\r\n\r\n":
                raise WarcError("the record does not end where its content length says")
            while m.more():
                pass
        except zlib.error as e:
            raise WarcError(f"broken gzip member: {e}") from None
        if m.buffer:
            raise WarcError("more than one record in a member")
        left = m.z.unused_data
        want = r.headers.get("warc-block-digest", "")
        if want and want != f"sha256:{hashlib.sha256(r.block).hexdigest()}":
            raise WarcError(f"block digest of {r.headers.get('warc-record-id')} differs")
        if r.headers.get("content-type", "").startswith("application/http"):
            http, sep, r.payload = r.block.partition(b"\r\n\r\n")
            r.http = _headers(http)
            if r.type == "response" and r.headers.get("warc-payload-digest") != f"sha256:{hashlib.sha256(r.payload).hexdigest()}":
                raise WarcError(f"payload digest of {r.headers.get('warc-record-id')} differs")
        yield r


def _page_of(urn: str | None) -> int | None:
    number = (urn or "").strip("<>").removeprefix(_PAGE)
    return int(number) if number else None


def with_revisits(pages: DataFrame) -> DataFrame:
    """page_id, url, html and refers_to: the page of which a row is a revisit, else null."""
    base = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("digest", F.sha2(F.col("html").cast("binary"), 256))
    first = base.filter(F.octet_length("html") >= MIN_REVISIT).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").select("digest", "first")
    return base.join(first, "digest", "left").select("page_id", "url", "html", F.when(F.col("page_id") != F.col("first"), F.col("first")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Writes page_id, url, html, refers_to into archives under ``folder``; path and records of each."""

    def run(batches):
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        task = TaskContext.get()
        made, out, n = [], None, 0

        def close() -> None:
            if out is not None:
                out.close()
                made.append((path, n))

        for b in batches:
            for page_id, url, html, ref in zip(*(b[c] for c in ("page_id", "url", "html", "refers_to"))):
                if out is None or out.tell() >= ARCHIVE_BYTES:
                    close()
                    path, n = f"{base}/pages-{task.partitionId():05d}-{task.taskAttemptId()}-{len(made)}.warc.gz", 0
                    out = fs.open_output_stream(path, compression=None)
                    out.write(record_bytes("warcinfo", [("WARC-Record-ID", f"<urn:x-archive:{task.partitionId()}-{len(made)}>"), ("WARC-Date", _DATE), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))
                out.write(page_record(page_id.as_py(), url.as_py(), html.as_py().encode("utf-8"), ref.as_py()))
                n += 1
        close()
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in made], pa.string()), pa.array([k for _, k in made], pa.int64())], ["path", "records"])

    return pages.select("page_id", "url", "html", "refers_to").mapInArrow(run, "path string, records long")


def read_archives(manifest: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """Every page record of the archives in ``manifest``: page_id, url, record_type, refers_to, payload_bytes, payload_digest and, if wanted, payload."""
    columns = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string" + (", payload binary" if payloads else "")
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), *([("payload", pa.binary())] if payloads else [])])

    def run(batches):
        fs, _ = pafs.FileSystem.from_uri(folder)
        rows, size = [], 0
        for b in batches:
            for path, count in zip(b["path"].to_pylist(), b["records"].to_pylist()):
                n = 0
                with fs.open_input_stream(path, compression=None) as stream:
                    for r in read_records(stream):
                        if r.type not in ("response", "revisit"):
                            continue
                        n += 1
                        h = r.headers
                        rows.append((_page_of(h["warc-record-id"]), h["warc-target-uri"], r.type, _page_of(h.get("warc-refers-to")), int(r.http["content-length"]), h["warc-payload-digest"].removeprefix("sha256:"), r.payload)[: len(schema)])
                        size += len(r.payload) if payloads else 0
                        if size > 4 << 20 or len(rows) >= 2000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)
                            rows, size = [], 0
                if n != count:
                    raise WarcError(f"{path} has {n} page records, its manifest says {count}")
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)

    return manifest.mapInArrow(run, columns)


def round_trip(pages: DataFrame, payloads: bool = True) -> DataFrame:
    """Pages (page_id, url, html) written to archives in the shared folder and read back."""
    spark = pages.sparkSession
    folder = fresh_path(spark, "warc")
    manifest = written(write_archives(with_revisits(pages), folder), "warc-manifest")
    files = manifest.count()
    return read_archives(manifest.repartition(max(1, min(files, 20_000))), folder, payloads)

"""WARC archives: a writer, and a sequential reader that holds one block at a time.

Each record is a gzip member of its own.  The reader inflates incrementally,
takes headers up to the empty line, frames the block by Content-Length, hashes
the payload as it passes and compares it with WARC-Payload-Digest.

Pages whose payloads are equal and of at least `min_bytes` bytes are stored
once: the largest id is the response, the others are revisit records that
refer to it.  Archives are rolled at ARCHIVE_BYTES, written under a name of the
attempt's own in the shared folder, and listed in a manifest; only listed files
are read, so what a lost or speculative attempt left behind does no harm.  The
folder is reached through pyarrow's file systems (file, hdfs, s3, gs).

Defined cases: null html is an empty payload; a null url is written as
`urn:x-unknown`; line ends in a url are percent-encoded; a null id is written
without number and read back as null, and is always a response; rows that
repeat the largest id of equal payloads are all responses; an empty table
writes nothing and gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from weftgraph.llm.shared import cut, lean, only, scratch_path

ARCHIVE_BYTES = 64 << 20
CHUNK = 1 << 16
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record(page: str, url: str | None, payload: bytes, refers_to: str | None, date: str, level: int = 6) -> bytes:
    """One record as a gzip member."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    url = (url or "urn:x-unknown").replace("\r", "%0D").replace("\n", "%0A")
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if refers_to is not None else 'response'}", f"WARC-Record-ID: <urn:x-page:{page}>", f"WARC-Date: {date}", f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha1:{digest}"]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:x-page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode()) + z.compress(block) + z.compress(b"\r\n\r\n") + z.flush()


class Reader:
    """Records of one archive, in order, from a stream of bytes."""

    def __init__(self, stream):
        self.stream, self.raw, self.plain, self.z = stream, b"", bytearray(), None

    def _more(self) -> bool:
        """Inflate some more of the current member; False at its end."""
        while True:
            if self.z.eof:
                return False
            if not self.raw:
                self.raw = self.stream.read(CHUNK)
                if not self.raw:
                    raise EOFError("archive ends inside a record")
            out = self.z.decompress(self.raw)
            self.raw = self.z.unused_data
            if out:
                self.plain += out
                return True

    def _until(self, mark: bytes) -> bytes:
        while (at := self.plain.find(mark)) < 0:
            if not self._more():
                raise ValueError("a record's headers don't end")
        got = bytes(self.plain[:at])
        del self.plain[: at + len(mark)]
        return got

    def _take(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.plain and not self._more():
                raise ValueError("a record is shorter than its Content-Length")
            part = bytes(self.plain[:n])
            del self.plain[: len(part)]
            n -= len(part)
            yield part

    def __iter__(self) -> Iterator[dict]:
        while True:
            if not self.raw:
                self.raw = self.stream.read(CHUNK)
            if not self.raw:
                return
            self.z, self.plain = zlib.decompressobj(31), bytearray()
            lines = self._until(b"\r\n\r\n").decode().split("\r\n")
            if not lines[0].startswith("WARC/"):
                raise ValueError("not a WARC record")
            head = dict(x.split(": ", 1) for x in lines[1:])
            kind, left = head["WARC-Type"], int(head["Content-Length"])
            http = self._until(b"\r\n\r\n")
            fields = {k.lower(): v for k, v in (x.split(": ", 1) for x in http.decode().split("\r\n")[1:])}
            left -= len(http) + 4
            sha, n = hashlib.sha1(), 0
            for part in self._take(left):
                sha.update(part)
                n += len(part)
            if b"".join(self._take(4)) != b"\r\n\r\n" or self.plain or self._more():
                raise ValueError("a member holds more or less than one record")
            told = base64.b32decode(head["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
            if kind == "response" and (sha.hexdigest() != told or n != int(fields["content-length"])):
                raise ValueError(f"payload of {head['WARC-Record-ID']} doesn't match its digest")
            refers = head.get("WARC-Refers-To")
            yield {"page_id": _page(head["WARC-Record-ID"]), "url": head["WARC-Target-URI"], "payload_bytes": int(fields["content-length"]), "payload_digest": told, "record_type": kind, "refers_to": _page(refers) if refers else None}


def _page(urn: str) -> str | None:
    return urn.removeprefix("<urn:x-page:").removesuffix(">") or None


def write_archives(pages: DataFrame, folder: str, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 1000, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write pages to archives in folder; the manifest: path, records, bytes.

    The digests are joined on their own; html moves once, to meet the id that
    its payload refers to.  A payload that very many pages share is a key that
    adaptive execution may split, since the other side has one row for it.
    """
    rows = pages.select(F.col(id_col).cast("string").alias("page"), F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    digest = F.when(F.octet_length("html") >= min_bytes, F.sha1(F.col("html").cast("binary")))
    heads = rows.select("id", digest.alias("digest")).where("digest IS NOT NULL").groupBy("digest").agg(F.max("id").alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    heads = cut(heads, "payloads")
    linked = rows.withColumn("digest", digest).join(heads, "digest", "left")
    refers = F.when(F.col("id") != F.col("head"), F.col("head").cast("string"))
    linked = linked.select("page", "url", "html", refers.alias("refers"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = fs.FileSystem.from_uri(folder)
        system.create_dir(base, recursive=True)
        out, name, size, count = None, "", 0, 0

        def done():
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([count], pa.int64()), pa.array([size], pa.int64())], names=["path", "records", "bytes"])

        for batch in batches:
            for page, url, html, to in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    name = f"{folder}/{uuid.uuid4().hex}.warc.gz"
                    out, size, count = system.open_output_stream(f"{base}/{name.rsplit('/', 1)[1]}", compression=None), 0, 0
                data = record(page or "", url, html.encode(), to, date)
                out.write(data)
                size, count = size + len(data), count + 1
                if size >= ARCHIVE_BYTES:
                    yield done()
                    out = None
        if out is not None:
            yield done()

    return cut(linked.mapInArrow(lean(run), "path string, records long, bytes long"), "manifest")


def read_archives(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """One row per record: page_id (string), url, payload_bytes, payload_digest, record_type, refers_to."""
    files = manifest.count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.string()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string())])
        for batch in batches:
            for path in batch.column(0).to_pylist():
                system, at = fs.FileSystem.from_uri(path)
                with system.open_input_stream(at, compression=None) as stream:
                    rows = []
                    for r in Reader(stream):
                        rows.append(r)
                        if len(rows) >= 5000:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows = []
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, schema)

    return manifest.select("path").repartition(max(1, files)).mapInArrow(lean(run), "page_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string")


def round_trip(pages: DataFrame, folder: str | None = None, *, id_col: str = "page_id", **options) -> DataFrame:
    """Write pages, read the archives back: page_id, payload_bytes, payload_digest, record_type, refers_to, url."""
    spark = pages.sparkSession
    kind = only(pages, id_col).schema[0].dataType
    manifest = write_archives(pages, folder or scratch_path(spark, "warc"), id_col=id_col, **options)
    got = read_archives(spark, manifest)
    return got.select(F.col("page_id").cast(kind), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind), "url")

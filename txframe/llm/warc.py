"""WARC archives: one gzip member for each record, written by tasks and read sequentially.

The reader inflates piece by piece, takes the header up to the blank line, frames the block by
its Content-Length and checks the block's and the payload's SHA-1 against the header's digests.
It never holds more than one piece of an archive besides the payload, and that only if asked.

Of records with equal payloads of at least 1000 bytes the one with the largest page_id is the
response and the others are revisits without a payload. Nulls and odd input: a null html is an
empty payload; null urls and page_ids are written without their header and read back as null; a
page whose id is null revisits like any other, and where all ids of a payload are null all are
responses; rows that repeat the largest page_id are responses too; an empty table gives no
archive. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from contextlib import ExitStack
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_batches, hot_join, shared_dir, staged
from .files import opened, written_whole

LEAST_REVISIT = 1000
PIECE = 1 << 18
#: Repeated payloads whose digests are broadcast; rows and bytes of a batch for the writer.
BROADCAST_PAYLOADS = 200_000
BATCH = (1_000, 4 << 20)
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_SCHEMA = "archive string, offset long, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


class WarcError(ValueError):
    """An archive that breaks off, or whose contents do not fit their headers."""


@dataclass
class Record:
    offset: int
    headers: dict[str, str]
    payload_bytes: int = 0
    payload_sha1: str = ""
    payload: bytes | None = field(default=None, repr=False)


def digest(sha1: bytes) -> str:
    return "sha1:" + base64.b32encode(sha1).decode()


def _header_safe(value: str) -> str:
    return value.replace("\r", "%0D").replace("\n", "%0A")


def encode_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, level: int = 6) -> bytes:
    """One record as a gzip member of its own; a revisit keeps the payload's digest and length only."""
    kind = "response" if refers_to is None else "revisit"
    block = HTTP_HEAD + (payload if refers_to is None else b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"Content-Length: {len(block)}", "Content-Type: application/http; msgtype=response", f"WARC-Block-Digest: {digest(hashlib.sha1(block).digest())}", f"WARC-Payload-Digest: {digest(hashlib.sha1(payload).digest())}"]
    if page_id is not None:
        head.append(f"WARC-Record-ID: <urn:page:{page_id}>")
    if url is not None:
        head.append(f"WARC-Target-URI: {_header_safe(url)}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Payload-Length: {len(payload)}"]
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


class _Counted:
    """A stream that cannot tell its place, with the bytes taken from it so far."""

    def __init__(self, source):
        self.source, self.taken = source, 0

    def read(self, n: int) -> bytes:
        piece = self.source.read(n)
        self.taken += len(piece)
        return piece


class _Member:
    """The inflated bytes of one gzip member, asked for piece by piece."""

    def __init__(self, source, rest: bytes):
        self.source, self.rest, self.out, self.z = source, rest, b"", zlib.decompressobj(31)

    def more(self) -> bool:
        while not self.z.eof:
            raw = self.z.unconsumed_tail or self.rest or self.source.read(PIECE)
            self.rest = b""
            if not raw:
                raise WarcError("the archive breaks off inside a record")
            made = self.z.decompress(raw, PIECE)
            if made:
                self.out += made
                return True
        return False

    def until(self, mark: bytes) -> bytes:
        while (at := self.out.find(mark)) < 0:
            if not self.more():
                raise WarcError("a record without the end of its header")
        found, self.out = self.out[:at], self.out[at + len(mark) :]
        return found

    def pieces(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.out and not self.more():
                raise WarcError("a block shorter than its Content-Length")
            piece, self.out = self.out[:n], self.out[n:]
            n -= len(piece)
            yield piece


def read_archive(source, keep_payload: bool = False) -> Iterator[Record]:
    """The records of an open archive, in order, framed and verified."""
    source, rest = _Counted(source), b""
    while True:
        rest = rest or source.read(PIECE)
        if not rest:
            return
        began = source.taken - len(rest)
        member = _Member(source, rest)
        lines = member.until(b"\r\n\r\n").decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise WarcError(f"no WARC record at {began}")
        headers = dict(line.split(": ", 1) for line in lines[1:])
        block, body, kept, http, size = hashlib.sha1(), hashlib.sha1(), [], b"", 0
        in_body = False
        for piece in member.pieces(int(headers["Content-Length"])):
            block.update(piece)
            if not in_body:
                http += piece
                if (end := http.find(b"\r\n\r\n")) < 0:
                    continue
                piece, in_body = http[end + 4 :], True
            body.update(piece)
            size += len(piece)
            if keep_payload:
                kept.append(piece)
        if digest(block.digest()) != headers["WARC-Block-Digest"]:
            raise WarcError(f"the block's digest is wrong at {began}")
        record = Record(began, headers, size, body.hexdigest(), b"".join(kept) if keep_payload else None)
        if headers["WARC-Type"] == "revisit":
            record.payload_bytes = int(headers["WARC-Payload-Length"])
            record.payload_sha1 = base64.b32decode(headers["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
        elif digest(body.digest()) != headers["WARC-Payload-Digest"]:
            raise WarcError(f"the payload's digest is wrong at {began}")
        while member.more():
            pass
        if member.out != b"\r\n\r\n":
            raise WarcError(f"a block longer than its Content-Length at {began}")
        yield record
        rest = member.z.unused_data


def _page(value: str | None) -> int | None:
    return int(value.removeprefix("<urn:page:").removesuffix(">")) if value else None


def _writer(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uri, n = f"{folder}/pages-{TaskContext.get().partitionId():06d}.warc.gz", 0
        with ExitStack() as stack:
            out = None
            for batch in batches:
                columns = [batch.column(c) for c in ("page_id", "url", "html", "refers_to")]
                for i in range(len(batch)):
                    page_id, url, html, refers_to = (c[i].as_py() for c in columns)
                    out = out or stack.enter_context(written_whole(uri))
                    out.write(encode_record(page_id, url, (html or "").encode(), refers_to))
                    n += 1
        if n:
            yield pa.RecordBatch.from_pydict({"archive": [uri], "records": pa.array([n], pa.int64())})

    return run


def repeated_payloads(pages: DataFrame, least: int) -> DataFrame:
    """Digest and largest page_id of each payload of at least ``least`` bytes that several rows hold; no payload is shuffled."""
    sized = pages.select("page_id", F.coalesce("html", F.lit("")).cast("binary").alias("body")).filter(F.octet_length("body") >= least)
    held = sized.select("page_id", F.unhex(F.sha1("body")).alias("digest")).groupBy("digest").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    return staged(held.filter("n > 1 AND first IS NOT NULL").select("digest", "first"))


def write_archives(pages: DataFrame, folder: str, least: int = LEAST_REVISIT, most: int = BROADCAST_PAYLOADS) -> DataFrame:
    """Writes ``pages`` (page_id, url, html), one archive for each task with rows; gives (archive, records).

    Up to ``most`` repeated payloads are looked up by a broadcast of their digests, so that pages are
    written where they are read. With more of them the pages are shuffled by digest, save those of
    hot payloads, which stay where they are.
    """
    firsts = repeated_payloads(pages, least)
    body = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", "html", F.when(F.octet_length(body) >= least, F.unhex(F.sha1(body))).alias("digest"))
    linked = rows.join(F.broadcast(firsts), "digest", "left") if firsts.count() <= most else hot_join(rows, firsts, ["digest"], "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to")
    with arrow_batches(pages.sparkSession, *BATCH):
        return staged(linked.select("page_id", "url", "html", refers).mapInArrow(_writer(folder), "archive string, records long"))


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in RECORD_SCHEMA.split(", ")]
    types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)

    rows: list[tuple] = []
    for batch in batches:
        for uri in batch.column("archive").to_pylist():
            fs, path = opened(uri)
            with fs.open_input_stream(path, compression=None) as source:
                for r in read_archive(source):
                    h = r.headers
                    rows.append((uri, r.offset, _page(h.get("WARC-Record-ID")), h.get("WARC-Target-URI"), r.payload_bytes, r.payload_sha1, h["WARC-Type"], _page(h.get("WARC-Refers-To"))))
                    if len(rows) >= 5000:
                        yield batch_of(rows)
                        rows.clear()
    yield batch_of(rows)


def read_archives(archives: DataFrame) -> DataFrame:
    """A row for each record of the archives named in ``archives``."""
    spark = archives.sparkSession
    named = staged(archives.select("archive"))
    parts = min(max(1, named.count()), 4 * spark.sparkContext.defaultParallelism)
    if named.count() > parts:  # many archives: as many tasks as there are partitions elsewhere
        parts = max(parts, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    return named.repartition(parts).mapInArrow(_reader, RECORD_SCHEMA)


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    archives = write_archives(pages, shared_dir(spark))
    return read_archives(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")

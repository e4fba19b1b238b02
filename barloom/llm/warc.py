"""WARC archives compressed record by record with a Zstandard dictionary of their own.

An archive starts with a skippable frame (magic 0x184D2A5D) that holds the dictionary built from its records, in the
standard dictionary format; archives too small to build one from have no such frame.  Every record is then a frame of its own, so that one can be read without those before it.  Of records with
equal payloads of at least ``MIN_REVISIT`` bytes the one with the smallest page_id is stored as ``response`` and the
others as ``revisit`` records without payload.

Archives are rows (archive, content) of a table in the shared folder: Spark's committer writes them, so a lost
executor leaves no half file; ``export`` turns them into ``.warc.zst`` files.

Defined results: a null html is an empty payload; a null url gives no target header; line breaks in a url are
percent-encoded; repeated rows of the smallest page_id are all responses; an empty table gives no archive;
extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.scratch import stash

MIN_REVISIT, DICT_BYTES, SAMPLE_BYTES, ARCHIVE_BYTES, LEVEL = 100, 32 << 10, 2 << 20, 16 << 20, 3
SKIPPABLE, MAGIC, DATE, URN = 0x184D2A5D, bytes.fromhex("37a430ec"), "2024-01-01T00:00:00Z", "urn:barloom:page:"
ARCHIVES = "archive string, n_records long, content binary"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; a revisit if ``refers_to`` is given."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    target = [] if url is None else [f"WARC-Target-URI: {url}".replace("\r", "%0D").replace("\n", "%0A")]
    revisit = [] if refers_to is None else [f"WARC-Refers-To: <{URN}{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{URN}{page_id}>", f"WARC-Date: {DATE}", *target, *revisit,
        f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def dictionary(records: list[bytes]) -> bytes | None:
    """A dictionary in the standard format from pieces spread evenly over all bytes of the archive; None if it is too small for one."""
    size = sum(map(len, records))
    piece = max(64, min(4096, size // 64))
    step = max(piece, size * piece // SAMPLE_BYTES)
    samples, at = [], 0  # at: where the next piece begins, from this record's start
    for r in records:
        while at < len(r):
            samples.append(r[at : at + piece])
            at += step
        at -= len(r)
    try:
        own = zstandard.train_dictionary(min(DICT_BYTES, max(256, size // 8)), samples, k=256, d=8).as_bytes()
    except zstandard.ZstdError:
        return None
    return own if own[:4] == MAGIC else None


def write_archive(records: list[bytes]) -> bytes:
    """The archive's bytes; without a leading frame where there is no dictionary, as for a few short records."""
    own, out = dictionary(records), io.BytesIO()
    if own:
        out.write(struct.pack("<II", SKIPPABLE, len(own)) + own)
    compress = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(own, dict_type=zstandard.DICT_TYPE_FULLDICT) if own else None).compress
    for r in records:
        out.write(compress(r))
    return out.getvalue()


def read_archive(content: bytes) -> Iterator[bytes]:
    magic, n = struct.unpack_from("<II", content)
    view, at, own = memoryview(content), 0, None
    if magic == SKIPPABLE:
        at = 8 + n
        own = zstandard.ZstdCompressionDict(content[8:at], dict_type=zstandard.DICT_TYPE_FULLDICT)
    reader = zstandard.ZstdDecompressor(dict_data=own)
    while at < len(content):
        frame, parts = reader.decompressobj(), []
        while not frame.eof:
            chunk = view[at : at + 16384]
            if not len(chunk):
                raise ValueError("the archive ends inside a record")
            parts.append(frame.decompress(chunk))
            at += len(chunk)
        at -= len(frame.unused_data)
        yield b"".join(parts)


def parse(raw: bytes) -> dict:
    """Header fields (lower case), payload and record type."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    fields = {k.lower(): v for k, v in fields.items()}
    n = int(fields["content-length"])
    block = rest[:n]
    if len(block) != n or rest[n:] != b"\r\n\r\n":
        raise ValueError("a record's length doesn't match its header")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(next(x for x in http.decode().split("\r\n") if x.lower().startswith("content-length: "))[16:])
    return {"fields": fields, "payload": payload, "size": size, "type": fields["warc-type"]}


def _write(prefix: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, held, size = TaskContext.get().partitionId(), 0, [], 0

        def flush() -> pa.RecordBatch:
            nonlocal number, held, size
            name = f"{prefix}-{part:05d}-{number:05d}.warc.zst"
            out = pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(held)], pa.int64()), pa.array([write_archive(held)], pa.binary())], names=["archive", "n_records", "content"])
            number, held, size = number + 1, [], 0
            return out

        for batch in batches:
            for page, url, html, digest, first in zip(*(batch.column(c) for c in range(5)), strict=True):
                page, first = page.as_py(), first.as_py()
                payload = (html.as_py() or "").encode()
                held.append(record(page, url.as_py(), payload, digest.as_py(), len(payload), first if first != page else None))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield flush()
        if held:
            yield flush()

    return run


def archive(pages: DataFrame, prefix: str = "pages") -> DataFrame:
    """Write ``pages`` (page_id, url, html) as archives; the stashed table of them."""
    body = F.coalesce(F.col("html"), F.lit(""))
    seen = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").alias("url"), body.alias("html"), F.sha2(body, 256).alias("digest"))
    equal = pages.where(F.octet_length("html") >= MIN_REVISIT).select(F.col("page_id").cast("long").alias("page_id"), F.sha2("html", 256).alias("d"))
    first = equal.groupBy("d").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    roles = seen.join(stash(first, "warc-equal"), F.col("digest") == F.col("d"), "left")
    return stash(roles.select("page_id", "url", "html", "digest", "first").mapInArrow(_write(prefix), ARCHIVES), "warc")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def number(urn: str) -> int | None:
        tail = urn.strip("<>").removeprefix(URN)
        return None if tail == "None" else int(tail)

    for batch in batches:
        for content in batch.column("content"):
            rows = []
            for raw in read_archive(content.as_py()):
                r = parse(raw)
                fields, told = r["fields"], r["fields"]["warc-payload-digest"].removeprefix("sha256:")
                if r["type"] == "response":
                    found = hashlib.sha256(r["payload"]).hexdigest()
                    if found != told or len(r["payload"]) != r["size"]:
                        raise ValueError(f"payload of {fields['warc-record-id']} doesn't match its digest")
                refers = number(fields["warc-refers-to"]) if "warc-refers-to" in fields else None
                rows.append((number(fields["warc-record-id"]), r["size"], told, r["type"], refers))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def read_back(archives: DataFrame) -> DataFrame:
    """One row per record: page_id, payload_bytes, payload_digest, record_type, refers_to; digests are verified."""
    return archives.select("content").mapInArrow(_read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def export(archives: DataFrame, folder: str) -> DataFrame:
    """Save archives as files in ``folder`` (a path or URI that executors can write to); (archive, bytes) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        for batch in batches:
            for name, content in zip(batch.column("archive").to_pylist(), batch.column("content").to_pylist(), strict=True):
                held = f"{base}/.{name}.{uuid.uuid4().hex}"  # a lost task leaves no half file under the archive's name
                with store.open_output_stream(held, compression=None) as f:
                    f.write(content)
                store.move(held, f"{base}/{name}")
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(content)], pa.int64())], names=["archive", "bytes"])

    return archives.select("archive", "content").mapInArrow(run, "archive string, bytes long")

"""WARC archives whose records are Zstandard frames with a dictionary of their own archive.

An archive starts with a skippable frame that holds the dictionary; each record
follows as one frame.  A reader needs nothing but the file.
"""

from __future__ import annotations

import hashlib
import os
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .workspace import lookup

# The skippable frame kind that announces a dictionary, and the revisit profile.
DICTIONARY_FRAME = 0x184D2A5D
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Bytes of the first records of an archive from which its dictionary is built.
SAMPLE_BYTES = 4 << 20
DICTIONARY_BYTES = 64 << 10
#: Smallest payload for which a later copy is written as a revisit.
REVISIT_FROM = 1000


def build_dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary; too few or too plain samples give the samples' own bytes, none give none."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[:DICTIONARY_BYTES]


def format_record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC/1.1 record: a response with the payload, or a revisit without it."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}"]
    lines.append(f"WARC-Record-ID: <urn:page:{page_id}>" if page_id is not None else f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>")
    if url:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    lines += ["WARC-Date: 2024-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}"]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {REVISIT_PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """Fields of a record; a response's payload is measured and digested anew."""
    head, rest = raw.split(b"\r\n\r\n", 1)
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, payload = block.split(b"\r\n\r\n", 1)
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    n_bytes = int(http.decode().rsplit("Content-Length: ", 1)[1])
    if kind == "response" and (len(payload) != n_bytes or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError("payload and digest of a record differ")
    number = lambda name: int(fields[name][len("<urn:page:") : -1]) if fields.get(name, "").startswith("<urn:page:") else None
    return {"page_id": number("WARC-Record-ID"), "url": fields.get("WARC-Target-URI"), "payload_bytes": n_bytes, "payload_digest": digest, "record_type": kind, "refers_to": number("WARC-Refers-To")}


class ArchiveWriter:
    """Holds the first records until the dictionary's sample is full, then streams."""

    def __init__(self, out):
        self.out, self.waiting, self.size, self.press = out, [], 0, None
        self.records = self.written = 0

    def add(self, record: bytes) -> None:
        self.records += 1
        if self.press is not None:
            self._put(self.press.compress(record))
            return
        self.waiting.append(record)
        self.size += len(record)
        if self.size >= SAMPLE_BYTES:
            self._start()

    def _start(self) -> None:
        raw = build_dictionary(self.waiting)
        self._put(struct.pack("<II", DICTIONARY_FRAME, len(raw)) + raw)
        made = zstandard.ZstdCompressionDict(raw) if raw else None
        self.press = zstandard.ZstdCompressor(level=3, dict_data=made, write_checksum=True, write_content_size=True)
        for r in self.waiting:
            self._put(self.press.compress(r))
        self.waiting = []

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.written += len(data)

    def close(self) -> None:
        if self.press is None:
            self._start()


def read_archive(source) -> Iterator[bytes]:
    """The records of an archive, one frame at a time, in bounded memory."""
    magic, size = struct.unpack("<II", source.read(8))
    if magic != DICTIONARY_FRAME:
        raise ValueError("no leading dictionary frame")
    raw = source.read(size)
    unpress = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw) if raw else None)
    left = b""
    while True:
        frame = unpress.decompressobj()
        parts = []
        while not frame.eof:
            data = left or source.read(1 << 20)
            left = b""
            if not data:
                if parts:
                    raise ValueError("archive ends inside a record")
                return
            parts.append(frame.decompress(data))
        left = frame.unused_data
        yield b"".join(parts)


def plan_records(pages: DataFrame, total: int, revisit_from: int = REVISIT_FROM) -> DataFrame:
    """Add payload_bytes, payload_digest and refers_to (null for responses) to pages.

    Null html is an empty payload.  Of equal payloads of ``revisit_from`` bytes or
    more the largest page_id is the response; copies with a null page_id revisit it.
    """
    drop = ("payload_bytes", "payload_digest", "refers_to")
    rows = pages.select(*[c for c in pages.columns if c not in drop])
    body = F.coalesce(F.col("html"), F.lit(""))
    rows = rows.withColumn("payload_bytes", F.octet_length(body).cast("long")).withColumn("payload_digest", F.sha1(body.cast("binary")))
    large = rows.filter(F.col("payload_bytes") >= revisit_from)
    best = large.groupBy(F.col("payload_digest").alias("__d")).agg(F.max("page_id").alias("__best"), F.count(F.lit(1)).alias("__n")).filter("__n > 1")
    rows = rows.withColumn("__d", F.when(F.col("payload_bytes") >= revisit_from, F.col("payload_digest")))
    rows = lookup(rows, best, "__d", "__n", total, "page_id")
    refers = F.when(F.col("page_id").isNull() | (F.col("page_id") != F.col("__best")), F.col("__best"))
    return rows.withColumn("refers_to", refers).drop("__d", "__best")


def write_archives(planned: DataFrame, folder: str) -> DataFrame:
    """Write one archive per task into ``folder`` (shared by all executors); one row per archive.

    A task writes under a name of its own and renames at its end, so that a task
    that is run again leaves no half archive among those returned.
    """

    def run(batches):
        name = f"part-{uuid.uuid4().hex}.warc.zst"
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        part, final = f"{base}/.{name}.part", f"{base}/{name}"
        with store.open_output_stream(part, compression=None) as out:
            writer = ArchiveWriter(out)
            for batch in batches:
                for at in range(batch.num_rows):
                    row = {c: batch.column(c)[at].as_py() for c in ("page_id", "url", "html", "payload_digest", "refers_to")}
                    writer.add(format_record(row["page_id"], row["url"], (row["html"] or "").encode(), row["payload_digest"], row["refers_to"]))
            writer.close()
        if not writer.records:
            store.delete_file(part)
            return
        store.move(part, final)
        yield pa.RecordBatch.from_pydict({"archive": [os.path.join(folder, name)], "records": [writer.records], "bytes": [writer.written]})

    return planned.select("page_id", "url", "html", "payload_digest", "refers_to").mapInArrow(run, "archive string, records long, bytes long")


def read_archives(archives: DataFrame) -> DataFrame:
    """The records of archives (column ``archive``) as page_id, url, payload_bytes, payload_digest, record_type, refers_to."""
    kinds = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])

    def run(batches):
        for batch in batches:
            for uri in batch.column("archive").to_pylist():
                store, path = fs.FileSystem.from_uri(uri)
                with store.open_input_stream(path, compression=None) as source:
                    rows = []
                    for raw in read_archive(source):
                        rows.append(parse_record(raw))
                        if len(rows) == 5000:
                            yield pa.RecordBatch.from_pylist(rows, schema=kinds)
                            rows = []
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, schema=kinds)

    return archives.select("archive").mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive_round_trip(spark: SparkSession, pages: DataFrame, space) -> DataFrame:
    """Plan, write and read back; archives stay in the workspace ``space``."""
    folder = space.path("archives")
    listing = space.table(write_archives(plan_records(pages, pages.count()), folder), "listing")
    return read_archives(listing.repartition(max(1, listing.count()), "archive"))

"""WARC archives whose records are compressed one by one with a shared dictionary.

Each task writes its rows as ``.warc.zst`` files: a leading skippable frame holds
a Zstandard dictionary trained on records of that file (or made of their bytes,
where they are too few or too short to train on), then a ``warcinfo`` record and one frame per page follow, so a reader can seek to any record.  Equal
payloads of at least ``min_revisit_bytes`` are stored once: the one with the
smallest key is a ``response``, the others are ``revisit`` records.

Which row is the first of its payload is found from digests and keys alone; page
texts move once, by (key, digest), so a payload that a third of the pages share
is no hot spot.  Files get a name from their partition and are renamed into place
when complete, so repeated task attempts leave one copy.

Defined results: a null payload is an empty one; a null url becomes a ``urn:``;
rows with a null key are ``response`` records with a null key and never the first
of a payload; repeated rows (equal key and payload) get one record each, of the
same type; an empty table gives no archive and an empty result; columns other
than key, url and payload are dropped.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ensure_checkpoint_dir

#: Fixed by the format: magic of the skippable frame that carries a dictionary, and of a raw dictionary.
DICTIONARY_FRAME = 0x184D2A5D
RAW_DICTIONARY = b"\x37\xa4\x30\xec"

DICTIONARY_BYTES = 32 << 10
#: Records that a dictionary is trained on: so many bytes from the start of a file, at most so much of each.
TRAINING_BYTES = 1 << 20
TRAINING_RECORD_BYTES = 16 << 10
#: A file is closed beyond this size.
FILE_BYTES = 32 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_uri(key: str | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{key}/{digest}')}>"


def _clean(url: str) -> str:
    return "".join(c if " " < c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def build_record(key: str | None, url: str | None, payload: bytes, digest: str, refers_to: str | None, date: str) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_uri(key, digest)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {_clean(url) if url else f'urn:page:{key}'}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if key is not None:
        lines.append(f"X-Page-Key: {key}")
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_uri(refers_to, digest)}", f"X-Refers-To-Key: {refers_to}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def info_record(date: str) -> bytes:
    body = b"software: glyphmill\r\nformat: WARC File Format 1.1\r\n"
    head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, date)}>\r\nWARC-Date: {date}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(body)}\r\n\r\n"
    return head.encode() + body + b"\r\n\r\n"


class ArchiveWriter:
    """Collects records for one file; the dictionary comes from the first of them."""

    def __init__(self, level: int = 3):
        self._level = level
        self._waiting: list[bytes] = []
        self._waiting_bytes = 0
        self._compressor: zstandard.ZstdCompressor | None = None
        self._parts: list[bytes] = []
        self.size = 0

    def _put(self, part: bytes) -> None:
        self._parts.append(part)
        self.size += len(part)

    def _begin(self) -> None:
        samples = [r[:TRAINING_RECORD_BYTES] for r in self._waiting]
        try:
            dictionary = zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=512, d=8)
            raw = dictionary.as_bytes()
        except zstandard.ZstdError:
            # Too few or too short records to train on: their own bytes are the dictionary,
            # compressed in the file, as they have no magic of their own.
            content = b"".join(samples)[:DICTIONARY_BYTES]
            dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            raw = zstandard.ZstdCompressor().compress(content)
        self._put(struct.pack("<II", DICTIONARY_FRAME, len(raw)) + raw)
        self._compressor = zstandard.ZstdCompressor(level=self._level, dict_data=dictionary, write_checksum=True)
        waiting, self._waiting = self._waiting, []
        for r in waiting:
            self._put(self._compressor.compress(r))

    def add(self, record: bytes) -> None:
        if self._compressor is None:
            self._waiting.append(record)
            self._waiting_bytes += len(record)
            if self._waiting_bytes >= TRAINING_BYTES:
                self._begin()
        else:
            self._put(self._compressor.compress(record))

    def finish(self) -> bytes:
        if self._compressor is None:
            self._begin()
        return b"".join(self._parts)


def iter_records(archive: bytes) -> Iterator[bytes]:
    """Uncompressed records of an archive, one frame at a time."""
    view, at, dictionary = memoryview(archive), 0, None
    if len(view) >= 8:
        magic, size = struct.unpack_from("<II", view)
        if magic == DICTIONARY_FRAME:
            raw = bytes(view[8 : 8 + size])
            if not raw.startswith(RAW_DICTIONARY):
                raw = zstandard.ZstdDecompressor().decompress(raw)
            dictionary = zstandard.ZstdCompressionDict(raw)
            at = 8 + size
    reader = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
    while at < len(view):
        # A window of the archive that is sure to hold the frame: whole rest, without copying.
        one = reader.decompressobj()
        chunks, step = [], 1 << 16
        while not one.eof:
            if at >= len(view):
                raise ValueError("archive ends inside a frame")
            piece = view[at : at + step]
            chunks.append(one.decompress(piece))
            at += len(piece)
        at -= len(one.unused_data)
        yield b"".join(chunks)


def parse_record(record: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    return fields, rest[: int(fields["Content-Length"])]


def with_first_of_payload(pages: DataFrame, key: str, url: str, payload: str, min_revisit_bytes: int) -> DataFrame:
    """(k, u, p, digest, refers_to): refers_to is null for responses; keys as text."""
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("u"), F.coalesce(F.col(payload), F.lit("")).alias("p")).withColumn("digest", F.sha2(F.col("p").cast("binary"), 256))
    ids = rows.where((F.octet_length("p") >= min_revisit_bytes) & F.col("key").isNotNull()).select("key", "digest")
    first = ids.groupBy("digest").agg(F.min("key").alias("first"), F.max("key").alias("last")).where("first < last").select("digest", "first")
    # Joined on the reversed digest: both sides are then dealt out for the join, so adaptive
    # execution can split a digest that many rows share.
    first = first.select(F.reverse("digest").alias("back"), "first")
    later = ids.withColumn("back", F.reverse("digest")).join(first, "back").where(F.col("key") > F.col("first")).drop("back").distinct()
    return rows.join(later, ["key", "digest"], "left").select(F.col("key").cast("string").alias("k"), "u", F.col("p").cast("binary").alias("p"), "digest", F.col("first").cast("string").alias("refers_to"))


def write_archives(pages: DataFrame, target: str, key: str = "page_id", url: str = "url", payload: str = "html", min_revisit_bytes: int = 100, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write every row of ``pages`` below the folder ``target``, an address all executors share.

    Returns (path, n_records, n_bytes), a row for each file; nothing is written
    before an action runs on it.
    """

    def run(batches):
        from pyarrow import fs

        # One store handle a task; the address decides which.
        store, root = fs.FileSystem.from_uri(target)
        task = TaskContext.get()
        number = 0

        def close(writer: ArchiveWriter, records: int):
            nonlocal number
            data = writer.finish()
            path = f"{root}/part-{task.partitionId():06d}-{number:04d}.warc.zst"
            draft = f"{root}/.draft-{task.taskAttemptId()}-{number:04d}"
            store.create_dir(root, recursive=True)
            with store.open_output_stream(draft) as out:
                out.write(data)
            store.move(draft, path)
            number += 1
            return pa.RecordBatch.from_pylist([{"path": path, "n_records": records, "n_bytes": len(data)}], schema=out_schema)

        out_schema = pa.schema([("path", pa.string()), ("n_records", pa.int64()), ("n_bytes", pa.int64())])
        writer, records = None, 0
        for batch in batches:
            for i in range(batch.num_rows):
                k, u, p, digest, refers_to = (batch.column(c)[i].as_py() for c in range(5))
                if writer is None:
                    writer, records = ArchiveWriter(), 0
                    writer.add(info_record(date))
                writer.add(build_record(k, u, p, digest, refers_to, date))
                records += 1
                if writer.size >= FILE_BYTES:
                    yield close(writer, records)
                    writer = None
        if writer is not None:
            yield close(writer, records)

    rows = with_first_of_payload(pages, key, url, payload, min_revisit_bytes)
    return rows.mapInArrow(run, "path string, n_records bigint, n_bytes bigint")


RECORD_SCHEMA = "record_type string, key string, url string, payload_bytes bigint, payload_digest string, refers_to string, payload binary"


def read_archives(spark: SparkSession, source: str, with_payload: bool = False) -> DataFrame:
    """Page records of all archives below ``source``; payload digests are verified."""

    def run(batches):
        schema = pa.schema([("record_type", pa.string()), ("key", pa.string()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.string()), ("payload", pa.binary())])
        for batch in batches:
            for i in range(batch.num_rows):
                rows, size = [], 0
                for record in iter_records(batch.column(0)[i].as_py()):
                    fields, block = parse_record(record)
                    if fields["WARC-Type"] == "warcinfo":
                        continue
                    http, _, body = block.partition(b"\r\n\r\n")
                    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
                    length = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
                    if fields["WARC-Type"] == "response" and (len(body) != length or hashlib.sha256(body).hexdigest() != digest):
                        raise ValueError(f"payload of {fields['WARC-Record-ID']} does not match its digest")
                    rows.append((fields["WARC-Type"], fields.get("X-Page-Key"), fields["WARC-Target-URI"], length, digest, fields.get("X-Refers-To-Key"), body if with_payload and fields["WARC-Type"] == "response" else None))
                    size += len(body) * with_payload
                    if len(rows) >= 5000 or size > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(source).select("content")
    return files.mapInArrow(run, RECORD_SCHEMA)


def archive_and_read(pages: DataFrame, key: str = "page_id", **options) -> DataFrame:
    """Write ``pages`` to a new folder beside the checkpoints and read the archives back."""
    spark = pages.sparkSession
    target = f"{ensure_checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"
    if "://" not in target:
        target = target.replace("file:", "", 1) if target.startswith("file:") else target
        target = f"file://{target}"
    written = write_archives(pages, target, key=key, **options).agg(F.count("*").alias("n")).first()["n"]
    kind = pages.schema[key].dataType.simpleString()
    records = read_archives(spark, target) if written else spark.createDataFrame([], RECORD_SCHEMA)
    return records.select(F.col("key").cast(kind).alias(key), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))

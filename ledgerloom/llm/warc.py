"""WARC archives in seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each with a few records, ended by a seek
table in a skippable frame (the seekable format: sizes of each frame, their number, a flag byte
and a magic number). An index row maps a record's identifier to its bundle, frame, offset and
length inside that frame, so one record is read by decompressing one frame.

Records with the same payload: the one with the smallest page_id is a `response`, the others
are `revisit` records that refer to it. Payload digests are grouped before pages are shuffled;
the pages of a hot group are dealt out by a salt.

Files are named by task attempt, and the index, kept in the shared folder, names those of the
attempts that counted: a lost executor or a second attempt leaves a stray file at worst.

Defined results: a null html is an empty payload; a null url leaves WARC-Target-URI out; a
null page_id is the identifier `null`, and is smallest only where no other is; rows that repeat
a page_id and payload are archived each, with the type of the first; an empty table gives no
files and no rows. White space of a url is percent-encoded.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from ledgerloom.llm._shared import durable, shared_path

# Fixed values of the seekable format and of WARC/1.1.
SKIPPABLE = 0x184D2A5E
SEEKABLE = 0x8F92EAB1
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

INDEX = pa.schema([("record_id", pa.string()), ("bundle", pa.string()), ("frame", pa.int32()), ("frame_at", pa.int64()), ("frame_bytes", pa.int64()), ("at", pa.int64()), ("bytes", pa.int64())])
RECORD = pa.schema([("record_id", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("url", pa.string()), ("payload", pa.binary())])


@dataclass(frozen=True)
class Archive:
    """folder: where the bundles are. index: a row for each record (see INDEX)."""

    folder: str
    index: DataFrame


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A WARC record; a revisit has no block, and its headers give the length of the payload it stands for."""
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'null' if page_id is None else page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        f"WARC-Payload-Length: {len(payload)}",
    ]
    if url is not None:
        lines.append("WARC-Target-URI: " + "".join(c if c > " " else f"%{ord(c):02X}" for c in url))
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {REVISIT_PROFILE}"]
    block = payload if refers_to is None else b""
    head = "\r\n".join([*lines, "Content-Type: text/html", f"Content-Length: {len(block)}"])
    return head.encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """The header fields and the block of each record in data."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        version, *fields = data[at:end].decode().split("\r\n")
        if version != "WARC/1.1":
            raise ValueError(f"no WARC record at byte {at}")
        head = dict(x.split(": ", 1) for x in fields)
        at = end + 4 + int(head["Content-Length"]) + 4
        yield head, data[end + 4 : at - 4]


def frames(bundle: bytes) -> list[tuple[int, int, int]]:
    """(offset, compressed bytes, bytes) of the frames, from the seek table in the bundle's footer."""
    n, flags, magic = struct.unpack("<IBI", bundle[-9:])
    if magic != SEEKABLE or flags:
        raise ValueError("the bundle has no seek table")
    table, at, out = bundle[-9 - 8 * n : -9], 0, []
    for packed, plain in struct.iter_unpack("<II", table):
        out.append((at, packed, plain))
        at += packed
    if struct.unpack("<II", bundle[at : at + 8]) != (SKIPPABLE, 8 * n + 9):
        raise ValueError("the seek table doesn't fit its bundle")
    return out


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


class BundleWriter:
    """Gathers records into frames and frames into one bundle."""

    def __init__(self, frame_bytes: int, level: int):
        self.frame_bytes, self.packer = frame_bytes, zstandard.ZstdCompressor(level=level)
        self.out, self.sizes, self.open, self.open_bytes, self.entries = bytearray(), [], [], 0, []

    def add(self, record_id: str, data: bytes) -> None:
        self.entries.append([record_id, len(self.sizes), self.open_bytes, len(data)])
        self.open.append(data)
        self.open_bytes += len(data)
        if self.open_bytes >= self.frame_bytes:
            self.end_frame()

    def end_frame(self) -> None:
        if self.open:
            packed = self.packer.compress(b"".join(self.open))
            self.out += packed
            self.sizes.append((len(packed), self.open_bytes))
            self.open, self.open_bytes = [], 0

    def close(self) -> tuple[bytes, list[tuple]]:
        """The bundle, and an index entry (see INDEX, without the bundle's name) for each record."""
        self.end_frame()
        starts = [0]
        for packed, _ in self.sizes:
            starts.append(starts[-1] + packed)
        table = b"".join(struct.pack("<II", *x) for x in self.sizes)
        self.out += struct.pack("<II", SKIPPABLE, len(table) + 9) + table + struct.pack("<IBI", len(self.sizes), 0, SEEKABLE)
        return bytes(self.out), [(i, f, starts[f], self.sizes[f][0], at, n) for i, f, at, n in self.entries]


def with_types(pages: DataFrame, least_bytes: int = 0, salts: int = 32) -> DataFrame:
    """pages (page_id, url, html) with `refers_to`: the first page of an equal payload, null for the first itself."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    keyed = pages.select("page_id", "url", payload.alias("html"), F.sha1(payload.cast("binary")).alias("_digest"))
    shared = keyed.filter(F.octet_length("html") >= least_bytes).groupBy("_digest").agg(F.min("page_id").alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    dealt = shared.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    joined = keyed.withColumn("_salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(salts)).cast("int")).join(dealt, ["_digest", "_salt"], "left")
    return joined.select("page_id", "url", F.col("html").cast("binary").alias("payload"), F.when(~F.col("page_id").eqNullSafe(F.col("_first")), F.col("_first")).alias("refers_to"))


def write_archive(pages: DataFrame, folder: str | None = None, *, least_bytes: int = 0, frame_bytes: int = 1 << 18, bundle_bytes: int = 1 << 25, level: int = 3) -> Archive:
    """Archive pages (page_id, url, html) into folder, a URI that executors can write to (default: in the shared folder)."""
    folder = folder or shared_path(pages.sparkSession, "warc")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)

        def stored(bundle: BundleWriter) -> pa.RecordBatch:
            data, entries = bundle.close()
            name = f"{uuid.uuid4().hex}.warc.zst"
            with store.open_output_stream(f"{root}/{name}", compression=None) as out:
                out.write(data)
            return _batch([(e[0], name, *e[1:]) for e in entries], INDEX)

        bundle, held = BundleWriter(frame_bytes, level), 0
        for batch in batches:
            for page_id, url, payload, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = record(page_id, url, payload, refers_to)
                bundle.add(f"urn:page:{'null' if page_id is None else page_id}", data)
                held += len(data)
                if held >= bundle_bytes:
                    yield stored(bundle)
                    bundle, held = BundleWriter(frame_bytes, level), 0
        if bundle.entries:
            yield stored(bundle)

    typed = with_types(pages, least_bytes)
    return Archive(folder, durable(typed.mapInArrow(write, from_arrow_schema(INDEX))))


def _row(head: dict[str, str], block: bytes) -> tuple:
    number = lambda x: None if x is None or x.endswith(":null>") else int(x[:-1].rpartition(":")[2])
    own, kind, sha1 = head["WARC-Record-ID"], head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response" and digest(block) != sha1:
        raise ValueError(f"{own}: the payload doesn't have the digest of its record")
    n = len(block) if kind == "response" else int(head["WARC-Payload-Length"])
    return own[1:-1], number(own), kind, number(head.get("WARC-Refers-To")), sha1, n, head.get("WARC-Target-URI"), block


def read_archive(spark: SparkSession, archive: Archive) -> DataFrame:
    """Every record (see RECORD) of the index, found by its offsets: each frame is sought and read by itself, and its records are cut out of it."""
    folder = archive.folder

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        unpacker, file, name, place, data = zstandard.ZstdDecompressor(), None, None, None, b""
        for batch in batches:
            out, held = [], 0
            for record_id, bundle, _, frame_at, frame_bytes, at, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bundle != name:
                    if file is not None:
                        file.close()
                    file, name, place = store.open_input_file(f"{root}/{bundle}"), bundle, None
                if frame_at != place:
                    file.seek(frame_at)
                    data, place = unpacker.decompress(file.read(frame_bytes)), frame_at
                ((head, block),) = parse(data[at : at + size])
                if head["WARC-Record-ID"] != f"<{record_id}>":
                    raise ValueError(f"{record_id} isn't where the index has it in {bundle}")
                out.append(_row(head, block))
                held += size
                if held >= 1 << 22:
                    yield _batch(out, RECORD)
                    out, held = [], 0
            yield _batch(out, RECORD)
        if file is not None:
            file.close()

    index = archive.index.select(*INDEX.names)
    return index.repartition("bundle", "frame").sortWithinPartitions("bundle", "frame", "at").mapInArrow(read, from_arrow_schema(RECORD))


def read_record(folder: str, bundle: str, frame_at: int, frame_bytes: int, at: int, size: int) -> tuple[dict[str, str], bytes]:
    """One record by its index row, reading one frame of its bundle."""
    store, root = fs.FileSystem.from_uri(folder)
    with store.open_input_file(f"{root}/{bundle}") as file:
        file.seek(frame_at)
        data = zstandard.ZstdDecompressor().decompress(file.read(frame_bytes))
    return next(parse(data[at : at + size]))

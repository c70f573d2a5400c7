"""Operator 8: pages as WARC records in seekable Zstandard bundles.

A bundle is what one task writes: records in the order of its rows, grouped into frames that close once they
hold FRAME_BYTES of records. Every frame is a Zstandard frame of its own. After the last one comes a seek table
in a skippable frame, in the public seekable format: compressed and plain size of each frame, the number of
frames, the magic number 0x8F92EAB1. A record is found by its bundle, its frame, and its offset within the
frame; one frame is read and decompressed for it. Ordinary zstd tools read a bundle from front to end.

Rows with the same contents give as many records, with the same record id. Null page ids stay null; a null url
has no WARC-Target-URI; a null payload is an empty block with the header X-Payload: null, so it differs from an
empty one when read back. A record larger than a frame has a frame to itself. Columns other than the three are
left out. A line's end within a url would end its header, so CR and LF are written, and read back, as %0D and %0A.
An empty table gives no bundle.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

FRAME_BYTES = 256 << 10
LEVEL = 3
DATE = "2026-01-01T00:00:00Z"
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
SCHEMA = "bundle int, frame int, data binary, plain_bytes long, page_ids array<long>, record_ids array<string>, offsets array<long>, lengths array<long>"


def record(page_id: int | None, url: str | None, payload: str | None) -> tuple[str, bytes]:
    """The id and the bytes of a resource record."""
    block = (payload or "").encode()
    digest = hashlib.sha1(block).hexdigest()
    name = f"{page_id}\n{url}\n{payload is None}\n{digest}"
    ident = f"urn:uuid:{uuid.UUID(bytes=hashlib.sha1(name.encode()).digest()[:16], version=5)}"
    lines = ["WARC/1.1", "WARC-Type: resource", f"WARC-Record-ID: <{ident}>", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if payload is None:
        lines.append("X-Payload: null")
    lines += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(block)}"]
    return ident, "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Headers, block and end of the record that begins at `at`."""
    head = data.index(b"\r\n\r\n", at)
    lines = data[at:head].decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record begins here")
    headers = dict(line.split(": ", 1) for line in lines[1:])
    begin = head + 4
    end = begin + int(headers["Content-Length"])
    return headers, data[begin:end], end + 4


def seek_table(sizes: list[tuple[int, int]]) -> bytes:
    entries = b"".join(struct.pack("<II", *x) for x in sizes)
    body = entries + struct.pack("<IBI", len(sizes), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def read_seek_table(file) -> list[tuple[int, int, int]]:
    """(start, compressed size, plain size) of each frame of an open bundle; only its footer is read."""
    file.seek(-9, 2)
    count, flags, magic = struct.unpack("<IBI", file.read(9))
    if magic != SEEKABLE:
        raise ValueError("no seek table at the end")
    entry = 12 if flags & 128 else 8
    file.seek(-9 - entry * count, 2)
    rows, start = [], 0
    for _ in range(count):
        packed, plain = struct.unpack("<II", file.read(entry)[:8])
        rows.append((start, packed, plain))
        start += packed
    return rows


def read_record(file, frame: int, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    """One record of an open bundle, by one frame's bytes."""
    import zstandard

    start, packed, _ = read_seek_table(file)[frame]
    file.seek(start)
    data = zstandard.ZstdDecompressor().decompress(file.read(packed))
    headers, block, _ = parse_record(data[offset : offset + length])
    return headers, block


def bundle_frames(pages: DataFrame, page_id: str = "page_id", url: str = "url", payload: str = "html", frame_bytes: int = FRAME_BYTES, level: int = LEVEL) -> DataFrame:
    """A row for each frame, and one for each bundle's seek table; `data` in order of frame is the bundle."""
    common.ship(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        packer = zstandard.ZstdCompressor(level=level, write_checksum=True)
        bundle, sizes = TaskContext.get().partitionId(), []
        schema = pa.schema([("bundle", pa.int32()), ("frame", pa.int32()), ("data", pa.binary()), ("plain_bytes", pa.int64()), ("page_ids", pa.list_(pa.int64())), ("record_ids", pa.list_(pa.string())), ("offsets", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64()))])

        def row(frame: int, data: bytes, plain: int, *lists: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x], t.type) for x, t in zip((bundle, frame, data, plain, *lists), schema)], schema=schema)

        def close() -> pa.RecordBatch:
            plain = b"".join(parts)
            data = packer.compress(plain)
            sizes.append((len(data), len(plain)))
            return row(len(sizes) - 1, data, len(plain), *kept)

        parts: list[bytes] = []
        kept: tuple[list, ...] = ([], [], [], [])
        held = 0
        for batch in common.text_slices(batches, "payload"):
            for p, u, h in zip(*(c.to_pylist() for c in batch.columns)):
                ident, data = record(p, u, h)
                if parts and held + len(data) > frame_bytes:
                    yield close()
                    parts, kept, held = [], ([], [], [], []), 0
                for x, to in zip((p, ident, held, len(data)), kept):
                    to.append(x)
                parts.append(data)
                held += len(data)
        if parts:
            yield close()
        if sizes:
            table = seek_table(sizes)
            yield row(len(sizes), table, 0, [], [], [], [])

    rows = pages.select(F.col(f"`{page_id}`").cast("long").alias("page_id"), F.col(f"`{url}`").cast("string").alias("url"), F.col(f"`{payload}`").cast("string").alias("payload"))
    return rows.mapInArrow(run, SCHEMA)


def index(frames: DataFrame) -> DataFrame:
    """(record_id, page_id, bundle, frame, offset, length) of every record of bundle_frames()."""
    each = F.explode(F.arrays_zip("record_ids", "page_ids", "offsets", "lengths")).alias("r")
    rows = frames.select("bundle", "frame", each)
    return rows.select(F.col("r.record_ids").alias("record_id"), F.col("r.page_ids").alias("page_id"), "bundle", "frame", F.col("r.offsets").alias("offset"), F.col("r.lengths").alias("length"))


def write_bundles(frames: DataFrame, folder: str) -> None:
    """Write bundle-N.warc.zst files, one task for each bundle; a task that runs again replaces its file whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        at, root = fs.FileSystem.from_uri(folder)
        at.create_dir(root)
        open_at, out = None, None
        for batch in batches:
            for bundle, data in zip(*(c.to_pylist() for c in batch.columns)):
                if bundle != open_at:
                    if out is not None:
                        out.close()
                    open_at, out = bundle, at.open_output_stream(f"{root}/bundle-{bundle:06d}.warc.zst", compression=None)
                out.write(data)
        if out is not None:
            out.close()
        yield from ()

    rows = frames.repartition(F.col("bundle")).sortWithinPartitions("bundle", "frame").select("bundle", "data")
    rows.mapInArrow(run, "done int").count()


def read_frames(frames: DataFrame) -> DataFrame:
    """(page_id, url, html) of every record, read back from the frames."""
    common.ship(frames.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        for batch in batches:
            for packed in batch.column(0).to_pylist():
                data, at = zstandard.ZstdDecompressor().decompress(packed), 0
                rows: list[tuple] = []
                while at < len(data):
                    headers, block, at = parse_record(data, at)
                    ident = headers.get("X-Page-ID")
                    rows.append((int(ident) if ident is not None else None, headers.get("WARC-Target-URI"), None if headers.get("X-Payload") == "null" else block.decode()))
                columns = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.string()))], names=["page_id", "url", "html"])

    return frames.where("size(page_ids) > 0").select("data").mapInArrow(run, "page_id long, url string, html string")


def query(spark, sf_dir: str) -> DataFrame:
    """All pages' bundles: a row for each frame with the ids of its records, and each bundle's seek table."""
    return bundle_frames(common.table(spark, sf_dir, "pages"))

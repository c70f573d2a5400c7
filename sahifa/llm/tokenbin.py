"""Operator 3: token ids in a binary form, each document compressed by itself with one shared dictionary.

A document's ids are serialised as little-endian unsigned integers of two bytes (four, if the vocabulary has
more than 65,536 ids). The Zstandard dictionary is trained on the serialised arrays of all documents, by
levels: every SLICE_BYTES of them train a small dictionary where they lie, and the small ones train those of the
next level, at most FAN_IN at a time, until one is left. Small ones may be as large as the last, so that it is
trained on pieces of all of them however few they are; what fits into it whole is taken as it is. Each document is then a frame of its own, so that a
short one is read without its neighbours, and has a place in the offset index: the shard (what one task wrote),
its offset and its length there. Every row carries the SHA-256 of the dictionary, which decompression checks.

The ids are operator 5's. Null text has null ids and a null frame of length 0; empty text has a frame of no ids.
Rows with the same doc_id are rows of their own, null doc_ids stay. An empty table has an empty dictionary: frames
then need none. Columns other than the two that are named aren't read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .bpe import VOCABULARY, encoder, read_ranks

DICTIONARY_BYTES, PART_BYTES = 64 << 10, 64 << 10
#: Samples too few to train on are cut into pieces of this size, dictionaries always.
PIECE = 1024
SLICE_BYTES = 8 << 20
FAN_IN = 256
LEVEL = 3


def width(vocabulary: str = VOCABULARY) -> str:
    return "<u2" if max(read_ranks(vocabulary).values()) < 1 << 16 else "<u4"


def pieces(samples: list[bytes]) -> list[bytes]:
    return [s[i : i + PIECE] for s in samples for i in range(0, len(s), PIECE)]


def train(samples: list[bytes], most: int) -> bytes:
    """A dictionary of at most `most` bytes; the samples themselves, where they all fit into it."""
    import zstandard

    samples = [s for s in samples if s]
    if sum(map(len, samples)) <= most:
        return b"".join(samples)
    try:
        # By default the last quarter of the samples would only be tested on.
        return zstandard.train_dictionary(most, samples if len(samples) > 10 else pieces(samples), k=256, d=8, split_point=1.0).as_bytes()
    except zstandard.ZstdError:
        # Zstandard can't train on them: stretches from all over the samples.
        data, n = b"".join(samples), max(1, most // 256)
        return b"".join(data[(at := i * len(data) // n & ~3) : at + most // n] for i in range(n))


def serialised(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, ids, n_tokens): each document's ids as bytes."""
    common.ship(docs.sparkSession)
    kind = width(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, item = encoder(vocabulary), np.dtype(kind).itemsize
        for batch in common.text_slices(batches, "text"):
            texts = batch.column(1)
            ids, ends = enc.encode_all(texts.to_pylist())
            null = np.asarray(texts.is_null())
            at = pa.py_buffer((ends * item).astype(np.int32).tobytes())
            valid = pa.py_buffer(np.packbits(~null, bitorder="little").tobytes())
            data = pa.Array.from_buffers(pa.binary(), len(texts), [valid, at, pa.py_buffer(ids.astype(kind).tobytes())])
            yield pa.RecordBatch.from_arrays([batch.column(0), data, pa.array(np.diff(ends), pa.int64(), mask=null)], names=["doc_id", "ids", "n_tokens"])

    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids binary, n_tokens long")


def dictionary(rows: DataFrame, scratch: common.Scratch, most: int = DICTIONARY_BYTES, part: int = PART_BYTES, slice_bytes: int = SLICE_BYTES, fan_in: int = FAN_IN) -> bytes:
    """The dictionary of all rows' ids."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, n = [], 0, TaskContext.get().partitionId() << 32
        for batch in batches:
            for x in batch.column(0).to_pylist():
                if x:
                    held.append(x)
                    size += len(x)
                if size >= slice_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([train(held, part)])], names=["n", "d"])
                    held, size, n = [], 0, n + 1
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([train(held, part)])], names=["n", "d"])

    def merge(key, t):
        return pa.table({"n": pa.array([key[0].as_py()], pa.int64()), "d": [train(pieces(t.sort_by("n").column("d").to_pylist()), part)]})

    found = scratch.write(rows.select("ids").mapInArrow(first, "n long, d binary"), "dictionary0")
    level, count = 0, found.count()
    while count > fan_in:
        groups = -(-count // fan_in)
        level += 1
        found = scratch.write(found.groupBy(F.pmod(F.xxhash64("n"), F.lit(groups)).alias("g")).applyInArrow(merge, "n long, d binary"), f"dictionary{level}")
        count = found.count()
    parts = [bytes(r.d) for r in found.orderBy("n").collect()]
    scratch.drop(*[f"dictionary{i}" for i in range(level + 1)])
    return train(pieces(parts), most) if len(parts) > 1 else b"".join(parts)


def digest(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def _dictionary(data: bytes):
    import zstandard

    return zstandard.ZstdCompressionDict(data) if data else None


def compress(rows: DataFrame, data: bytes, level: int = LEVEL) -> DataFrame:
    """rows(doc_id, ids, n_tokens) as (doc_id, shard, offset, length, n_tokens, dict_hash, frame)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        packer = zstandard.ZstdCompressor(level=level, dict_data=_dictionary(data), write_dict_id=False)
        shard, at, name = TaskContext.get().partitionId(), 0, digest(data)
        for batch in batches:
            frames = [None if x is None else packer.compress(x) for x in batch.column(1).to_pylist()]
            size = np.array([len(x or b"") for x in frames], np.int64)
            offset = at + np.cumsum(size) - size
            at += int(size.sum())
            n = len(frames)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(n, shard, np.int32)), pa.array(offset), pa.array(size), batch.column(2), pa.array([name] * n), pa.array(frames, pa.binary())], names=["doc_id", "shard", "offset", "length", "n_tokens", "dict_hash", "frame"])

    return rows.select("doc_id", "ids", "n_tokens").mapInArrow(run, "doc_id long, shard int, offset long, length long, n_tokens long, dict_hash string, frame binary")


def decompress(frame: bytes | None, dict_hash: str, data: bytes, kind: str = "<u2") -> np.ndarray | None:
    """The ids of a frame."""
    import zstandard

    if digest(data) != dict_hash:
        raise ValueError("the frame was made with another dictionary")
    if frame is None:
        return None
    return np.frombuffer(zstandard.ZstdDecompressor(dict_data=_dictionary(data)).decompress(frame), kind)


def write_shards(rows: DataFrame, folder: str) -> DataFrame:
    """Write shard-N.ids files of the frames; gives the offset index, the rows without their frames."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        at, root = fs.FileSystem.from_uri(folder)
        at.create_dir(root)
        open_at, out = None, None
        for batch in batches:
            for shard, frame in zip(*(c.to_pylist() for c in batch.columns)):
                if shard != open_at:
                    if out is not None:
                        out.close()
                    open_at, out = shard, at.open_output_stream(f"{root}/shard-{shard:06d}.ids", compression=None)
                out.write(frame)
        if out is not None:
            out.close()
        yield from ()

    held = rows.where("frame is not null and shard >= 0")
    held.repartition(F.col("shard")).sortWithinPartitions("shard", "offset").select("shard", "frame").mapInArrow(run, "done int").count()
    return rows.drop("frame")


def query(spark, sf_dir: str) -> DataFrame:
    """Every document's frame with its place; the row of shard -1 holds the dictionary."""
    scratch = common.Scratch(spark, "tokenbin")
    rows = scratch.write(serialised(common.table(spark, sf_dir, "documents")), "ids")
    data = dictionary(rows, scratch)
    own = spark.createDataFrame([(None, -1, 0, len(data), None, digest(data), bytearray(data))], "doc_id long, shard int, offset long, length long, n_tokens long, dict_hash string, frame binary")
    return compress(rows, data).union(own)

"""What the two vector operators share: clean vectors, and index shards kept as files in the shared folder."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def clean(rows: DataFrame, ident: str, vector: str) -> DataFrame:
    """(id, v): one vector for each id, all of one length.

    Rows with a null id or vector, an empty vector, or a component that is null, NaN or infinite are left out. Of
    an id with several vectors the least counts. The length is the commonest one (of those the greatest); vectors
    of other lengths can't be compared and are left out.
    """
    common.ship(rows.sparkSession)
    v = F.col(f"`{vector}`").cast("array<float>")
    rows = rows.select(F.col(f"`{ident}`").cast("long").alias("id"), v.alias("v"))
    rows = rows.where(F.col("id").isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    length = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    rows = rows.where(F.size("v") == (length["n"] if length else -1))
    return rows.groupBy("id").agg(F.min("v").alias("v"))


def matrix(lists: pa.Array) -> np.ndarray:
    """An Arrow column of float lists of one length, as a matrix."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float32)
    return flat.reshape(len(lists), -1) if len(lists) else np.zeros((0, 0), np.float32)


def shards_of(count: int, most: int) -> int:
    return max(1, -(-count // most))


def pack(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def build_shards(rows: DataFrame, shards: int, build, scratch: common.Scratch, name: str) -> str:
    """Write build(ids, vectors) -> bytes for each shard of rows(id, v) as a table; gives its path."""

    def run(key, t):
        t = t.sort_by("id")
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "data": pa.array([build(t.column("id").to_numpy(), matrix(t.column("v")))], pa.binary())})

    made = rows.groupBy(F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard")).applyInArrow(run, "shard int, data binary")
    scratch.write(made, name)
    return scratch.path(name)


def build_boxes(rows: DataFrame, build, scratch: common.Scratch, name: str) -> str:
    """Write build(ids, vectors) -> bytes, low, high for each shard of rows(id, v, shard); gives the table's path."""

    def run(key, t):
        t = t.sort_by("id")
        data, low, high = build(t.column("id").to_numpy(), matrix(t.column("v")))
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "low": pa.array([low.tolist()], pa.list_(pa.float32())), "high": pa.array([high.tolist()], pa.list_(pa.float32())), "data": pa.array([data], pa.binary())})

    made = rows.select("id", "v", "shard").groupBy("shard").applyInArrow(run, "shard int, low array<float>, high array<float>, data binary")
    scratch.write(made, name)
    return scratch.path(name)


def _folder(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _files(path: str) -> tuple[object, list[str]]:
    from pyarrow import fs

    at, root = _folder(path)
    return at, sorted(x.path for x in at.get_file_info(fs.FileSelector(root)) if x.path.endswith(".parquet"))


def read_boxes(path: str) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
    """Of build_boxes' shards: their numbers, files, and boxes; their vectors aren't read."""
    import pyarrow.parquet as pq

    at, files = _files(path)
    held = [(pq.read_table(f, filesystem=at, columns=["shard", "low", "high"]), f) for f in files]
    low, high = (np.concatenate([matrix(t.column(c)) for t, _ in held if len(t)]) for c in ("low", "high"))
    return np.concatenate([t.column("shard").to_numpy() for t, _ in held if len(t)]), [f for t, f in held for _ in range(len(t))], low, high


def read_shard(path: str, file: str, shard: int) -> dict[str, np.ndarray]:
    """The arrays of one of build_boxes' shards."""
    import pyarrow.dataset as ds

    at, _ = _folder(path)
    t = ds.dataset(file, filesystem=at, format="parquet").to_table(columns=["data"], filter=ds.field("shard") == shard)
    return dict(np.load(io.BytesIO(t.column(0)[0].as_py())))


def blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors of Arrow batches (id, v), at least `most` at a time but for the last."""
    held, n = [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, most):
            held.append(batch.slice(at, most))
            n += held[-1].num_rows
            if n >= most:
                yield np.concatenate([b.column(0).to_numpy() for b in held]), np.concatenate([matrix(b.column(1)) for b in held])
                held, n = [], 0
    if n:
        yield np.concatenate([b.column(0).to_numpy() for b in held]), np.concatenate([matrix(b.column(1)) for b in held])


def read_shards(path: str) -> Iterator[dict[str, np.ndarray]]:
    """The arrays of each shard, one after another, in a fixed order."""
    import pyarrow.dataset as ds

    at, files = _files(path)
    for file in files:
        for batch in ds.dataset(file, filesystem=at, format="parquet").to_batches(columns=["data"], batch_size=1):
            for data in batch.column(0):
                yield dict(np.load(io.BytesIO(data.as_py())))

"""What the operators share: table access, the shared scratch folder, and hashing on numpy arrays."""

from __future__ import annotations

import atexit
import os
import uuid
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parents[2])

#: A task takes about this many bytes of text at a time, so that its memory doesn't follow the batch size.
SLICE_BYTES = 2 << 20

#: Keys of 8 bytes are sent to every executor up to this number (about 64 MB); beyond it, tables are joined by shuffles.
SENT_KEYS = 4_000_000


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package from the folder it was imported from."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, env.get("PYTHONPATH", "")]))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table, in as many partitions as there are cores at least: a small one may be one file that can't be split."""
    ship(spark)
    scan = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return scan if scan._jdf.queryExecution().toRdd().getNumPartitions() >= cores else scan.repartition(cores)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir.

    Where that isn't set, a local session (tests) gets a folder of its own; a cluster gets an error,
    since a machine-local folder would lose data there.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        at = "file://" + tempfile.mkdtemp(prefix="sahifa-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(conf).delete(p, True)


_made: list[tuple[SparkSession, str]] = []


@atexit.register
def _leave_nothing() -> None:
    """Results are read from written tables, so what an operator can't delete itself goes when the driver ends."""
    for spark, path in _made:
        try:
            if spark.sparkContext._jsc is not None and not spark.sparkContext._jsc.sc().isStopped():
                delete(spark, path)
        except Exception:  # noqa: BLE001 - the session is gone
            return


class Scratch:
    """Written tables in the shared folder; they cut lineage and survive lost executors."""

    def __init__(self, spark: SparkSession, what: str):
        self.spark, self.at = spark, f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex[:12]}"
        _made.append((spark, self.at))

    def path(self, name: str) -> str:
        return f"{self.at}/{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Write df, free the shuffles that made it, and read it back."""
        df.write.parquet(self.path(name))
        schema = df.schema
        del df
        self.free()
        return self.spark.read.schema(schema).parquet(self.path(name))

    def free(self) -> None:
        """Shuffle files go when the driver's JVM collects what refers to them."""
        import gc

        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def drop(self, *names: str) -> None:
        for name in names:
            delete(self.spark, self.path(name))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def without(df: DataFrame, *names: str) -> DataFrame:
    """df without columns that an operator is about to add under these names (any case)."""
    low = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in low])


def fresh(df: DataFrame, *names: str) -> list[str]:
    """These names, each with as many underscores before it as make it one that df doesn't have (in any case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit words."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    return x


def powers(base: int, n: int) -> np.ndarray:
    """base ** i modulo 2**64 for i < n."""
    out = np.empty(max(n, 1), np.uint64)
    out[0] = 1
    done, step = 1, base & (2**64 - 1)
    while done < n:
        take = min(done, n - done)
        out[done : done + take] = out[:take] * np.uint64(step)
        done += take
        step = step * step % 2**64 if take == done - take else step
    return out[:n]


BASE = 0x9E3779B97F4A7C15 | 1
BASE_INVERSE = pow(BASE, -1, 2**64)
_POWERS: dict[int, np.ndarray] = {}


def kept_powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        have = _POWERS[base] = powers(base, size)
    return have[:n]


def forgetting(run):
    """run(batches), and then the kept powers are gone: a worker goes on to other work, and memory is its executor's."""

    def whole(batches):
        try:
            yield from run(batches)
        finally:
            _POWERS.clear()

    return whole


_BYTE = mix64(np.arange(1, 257, dtype=np.uint64))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_bounds(raw: np.ndarray, breaks: np.ndarray, between: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes that aren't between words; no run goes across one of breaks."""
    solid = np.empty(len(raw) + 2, bool)
    solid[0] = solid[-1] = False
    np.logical_not(between[raw], out=solid[1:-1])
    change = solid[1:] != solid[:-1]
    starts, ends = np.flatnonzero(change & solid[1:]), np.flatnonzero(change & solid[:-1])
    inner = breaks[(breaks > 0) & (breaks < len(raw))]
    if len(inner):
        inner = np.unique(inner)
        inner = inner[solid[inner] & solid[inner + 1]]
        if len(inner):
            starts, ends = np.sort(np.concatenate([starts, inner])), np.sort(np.concatenate([ends, inner]))
    return starts, ends


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, from prefix polynomial hashes over the bytes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * kept_powers(BASE, len(raw)), out=sums[1:])
    return mix64((sums[ends] - sums[starts]) * kept_powers(BASE_INVERSE, len(raw) + 1)[starts])


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """The hash of the n words from each position on, from prefix polynomial hashes over the words."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * kept_powers(BASE, len(words)), out=sums[1:])
    at = kept_powers(BASE_INVERSE, len(words) + 1)[: len(words) - n + 1]
    return mix64((sums[n:] - sums[:-n]) * at)


def text_slices(batches, column: str, most: int = SLICE_BYTES):
    """Slices of the Arrow batches whose text has about most bytes at most, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        offsets = string_offsets(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1
            to = min(max(to, at + 1), batch.num_rows)
            yield batch.slice(at, to - at)
            at = to


def string_offsets(array) -> np.ndarray:
    """Byte offsets of an Arrow string array, with its slice taken into account."""
    import pyarrow as pa

    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    kind = np.int64 if wide else np.int32
    buffer = array.buffers()[1]
    if buffer is None:
        return np.zeros(len(array) + 1, np.int64)
    return np.frombuffer(buffer, kind)[array.offset : array.offset + len(array) + 1].astype(np.int64)


def string_bytes(array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow string array, and each row's start in them with the end; nulls are empty."""
    offsets = string_offsets(array)
    data = array.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    if array.null_count:
        size = np.diff(offsets)
        size[np.asarray(array.is_null())] = 0
        if size.sum() != offsets[-1] - offsets[0]:
            array = array.fill_null("")
            return string_bytes(array)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]

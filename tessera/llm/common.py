"""Shared pieces: table access, shared-folder tables, vectorised tokens, stable hashes, group streaming."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word in the contracts: a run of anything but space and \t..\r.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df``, read from files, dealt over all cores if it is small and has fewer files than there are cores: work on a text
    costs more than moving it. Rows and results are the same; their order is not."""
    n = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(n) if size < n * (128 << 20) and len(df.inputFiles()) < n else df


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; only where that is unset, and in a local session, one of
    our own."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        at = spark.sparkContext.getCheckpointDir()
    if not at and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not at:
        at = tempfile.mkdtemp(prefix="tessera-")
        spark.sparkContext.setCheckpointDir(at)
    return at


def materialise(df: DataFrame) -> DataFrame:
    """Cuts lineage: writes ``df`` as Parquet into the shared folder and reads it back. Removed when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001  the session is gone already; the folder's owner cleans up
        pass


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bounded_broadcast(df: DataFrame, max_rows: int) -> DataFrame:
    """A broadcast hint only after counting: beyond ``max_rows`` the join shuffles. ``df`` should be materialised."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def let(value, of):
    """``of(value)`` for a column, the value worked out once however often ``of`` uses it."""
    return F.element_at(F.transform(F.array(value), of), 1)


def unused(name: str, columns: list[str]) -> str:
    """``name``, made longer until no column has it."""
    while name.lower() in {c.lower() for c in columns}:
        name += "_"
    return name


def ascii_lower(col):
    """Lower-cases A-Z and nothing else."""
    return F.translate(col, UPPER, LOWER)


def fold(doc_id, of: int):
    """crc32(doc_id as text) mod ``of``; a null doc_id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % of


def crc(doc_id) -> int:
    return zlib.crc32(b"" if doc_id is None else str(int(doc_id)).encode())


# --- numpy / Arrow side ---------------------------------------------------------------------------------------------

_M1, _M2, _G = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    with np.errstate(over="ignore"):
        x = x + _G
        x = (x ^ (x >> np.uint64(30))) * _M1
        x = (x ^ (x >> np.uint64(27))) * _M2
        return x ^ (x >> np.uint64(31))


def slices(batches: Iterator[pa.RecordBatch], column: int, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of about ``most`` bytes of a text column, so that a task's memory follows that."""
    for b in batches:
        rows = max(1, b.num_rows // max(1, -(-b.column(column).nbytes // most)))
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)
    release()


def release() -> None:
    """Gives freed memory back to the system: a Python worker outlives its task and would sit on it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # not glibc
        pass


def word_hashes(words: pa.Array) -> np.ndarray:
    """Stable 64-bit hashes of an Arrow string array."""
    if not len(words):
        return np.empty(0, np.uint64)
    return pd.util.hash_array(words.to_numpy(zero_copy_only=False).astype(object), categorize=False)


class Words:
    """The words of a batch of texts: ``ids`` into ``vocab`` (Arrow strings), text i at ``starts[i]:starts[i + 1]``."""

    def __init__(self, texts, lower: bool = True):
        texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
        if texts.offset:  # string kernels misread some sliced arrays
            texts = texts.take(pa.array(np.arange(len(texts))))
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if lower:
            texts = pc.ascii_lower(texts)
        lists = pc.ascii_split_whitespace(texts)
        flat, offsets = lists.flatten(), lists.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
        offsets = offsets - offsets[0]
        keep = pc.greater(pc.binary_length(flat), 0)
        kept = np.concatenate([[0], np.cumsum(keep.to_numpy(zero_copy_only=False))])
        self.starts = kept[offsets]
        enc = pc.dictionary_encode(flat.filter(keep))
        self.ids, self.vocab = enc.indices.to_numpy(zero_copy_only=False), enc.dictionary

    def hashes(self) -> np.ndarray:
        h = word_hashes(self.vocab)
        return h[self.ids] if len(h) else np.empty(0, np.uint64)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as byte planes, compressed; a sorted unsigned array should come as differences."""
    parts = []
    for a in arrays:
        a = np.ascontiguousarray(a)
        if a.dtype.kind == "i":
            top = int(a.max(initial=0))
            a = a.astype(np.uint8 if top < 256 else np.uint16 if top < 65536 else np.uint32 if top < 1 << 32 else np.uint64)
        raw = a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes()
        parts.append(np.array([len(a), a.dtype.itemsize], np.int64).tobytes() + raw)
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unpack(blob: bytes) -> list[np.ndarray]:
    """What was packed, as unsigned arrays."""
    raw, out, at = zstandard.ZstdDecompressor().decompress(blob), [], 0
    while at < len(raw):
        n, size = np.frombuffer(raw, np.int64, 2, at)
        planes = np.frombuffer(raw, np.uint8, n * size, at + 16).reshape(size, n)
        out.append(np.ascontiguousarray(planes.T).view(f"u{size}").reshape(n))
        at += 16 + n * size
    return out


def steps(sorted_hashes: np.ndarray) -> np.ndarray:
    """Differences, the first from 0; ``sums`` takes them back."""
    return np.diff(sorted_hashes, prepend=np.uint64(0))


def sums(steps: np.ndarray) -> np.ndarray:
    return np.cumsum(steps, dtype=np.uint64)


def groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Whole groups from batches sorted by ``keys``; holds one group at a time."""
    held: list[pd.DataFrame] = []
    last = None
    for b in batches:
        if not len(b):
            continue
        k = b[keys].to_numpy()
        cuts = [0, *(np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1), len(b)]
        for i, j in zip(cuts, cuts[1:], strict=False):
            key = tuple(k[i])
            if last is not None and key != last:
                yield pd.concat(held, ignore_index=True)
                held = []
            held.append(b.iloc[i:j])
            last = key
    if held:
        yield pd.concat(held, ignore_index=True)

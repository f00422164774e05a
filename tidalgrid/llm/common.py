"""Shared helpers of the training-data operators: session settings, shared folders, array arithmetic over Arrow texts."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that one call of the array code handles; bounds a worker's memory.
BLOCK_BYTES = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where it is unset, a new local folder on a
    local master, and an error on a cluster, whose executors wouldn't see it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="tidalgrid-")
        spark.conf.set("spark.checkpoint.dir", base)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder name below the shared one."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


@contextmanager
def setting(spark: SparkSession, name: str, value: str):
    """A session setting for the jobs that run inside; the old value returns."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Cut lineage: write ``df`` to the shared folder and read it back. The write's shuffle files go with it; ``discard``
    removes the folder when no plan reads it any more, else it stays until ``spark.checkpoint.dir`` is cleared."""
    spark = df.sparkSession
    path = scratch(spark, label)
    with setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(df: DataFrame) -> None:
    """Removes the folder of a ``materialize`` result."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._scratch)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Gives back what earlier steps left on the driver: plans that Python still refers to, the broadcasts and shuffles that go
    with them, and free memory."""
    gc.collect()
    spark._jvm.System.gc()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not the GNU C library
        pass


def small_batches(spark: SparkSession, rows: int = 256) -> None:
    """Few rows per Arrow batch, so that long texts don't fill a worker. Plans run after their operator has returned, so the
    setting stays; it is only ever lowered."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


def plain_unions(spark: SparkSession) -> None:
    """Unions don't keep their inputs' partitioning: adaptive execution may split a skewed join below one side, and then
    the sides' partitions no longer pair up. Set for the session, as plans run later."""
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")


def splitmix(x: np.ndarray) -> np.ndarray:
    """Mix 64-bit values (public finaliser constants)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


_BYTE = splitmix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_ODD = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes of the words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after A-Z are lower-cased.
_WORD = np.ones(256, bool)
_WORD[:0x30] = _WORD[0x3A:0x61] = _WORD[0x7B:0x80] = False
#: Bytes of words that only blanks, tabs and line ends part.
UNSPACED = np.ones(256, bool)
UNSPACED[0x20] = UNSPACED[0x09:0x0E] = False
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd base and of its inverse modulo 2^64, ``n`` each."""
    if len(_powers[0]) < n:
        m = max(n, BLOCK_BYTES + 64)
        with np.errstate(over="ignore"):
            _powers[:] = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(m - 1, b)]).astype(np.uint64)) for b in (_ODD, _INV)]
    return _powers[0][:n], _powers[1][:n]


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """Prefix sums of values times powers; with ``span_hash`` any substring's hash costs one subtraction and one product."""
    with np.errstate(over="ignore"):
        out = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * powers(len(values))[0], out=out[1:])
        return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return splitmix((prefix[end] - prefix[start]) * powers(len(prefix))[1][start] + (end - start).astype(np.uint64))


def gram_hash(prefix: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all windows of ``k`` values."""
    n = len(prefix) - k
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        return splitmix((prefix[k:] - prefix[:n]) * powers(len(prefix))[1][:n] + np.uint64(k))


def byte_values(buf: np.ndarray) -> np.ndarray:
    return _BYTE[buf]


def sliding_min(h: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each window of ``w`` values, by doubling."""
    size = 1
    while size < w:
        step = min(size, w - size)
        h = np.minimum(h[:-step], h[step:])
        size += step
    return h


def winnow(h: np.ndarray, w: int) -> np.ndarray:
    """Positions of the minimum of each window of ``w`` hashes, rightmost on ties; all windows of a shorter input are one.

    A hash's upper 48 bits decide, so the choice depends on what stands in the window only.
    """
    n = len(h)
    if n == 0:
        return np.zeros(0, np.int64)
    w = min(w, n)
    low, span, found = np.uint64(0xFFFF), 60_000, []
    for at in range(0, n - w + 1, span):
        part = h[at : at + span + w - 1]
        key = (part & ~low) | (low - np.arange(len(part), dtype=np.uint64))
        got = (low - (sliding_min(key, w) & low)).astype(np.int64) + at
        found.append(got[np.concatenate([[True], got[1:] != got[:-1]])])
    out = np.concatenate(found)
    return out if len(found) == 1 else out[np.concatenate([[True], out[1:] != out[:-1]])]


def text_blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets of the rows in them) for runs of rows of about ``limit`` bytes; null is empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        hi = min(hi, len(column))
        yield lo, hi, buf[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


class Words:
    """The words of a block of texts: byte spans, hashes, and for each text its range of words. ``letters`` tells which bytes,
    A-Z lower-cased, are in words."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, letters: np.ndarray = _WORD):
        low = _LOWER[buf]
        is_word = np.zeros(len(low) + 2, bool)
        is_word[1:-1] = letters[low]
        body, inner = is_word[1:-1], offsets[(offsets > 0) & (offsets < len(low))]
        first = body & ~is_word[:-2]
        last = body & ~is_word[2:]
        first[inner] = body[inner]
        last[inner - 1] = body[inner - 1]
        self.low, self.start, self.end = low, np.flatnonzero(first), np.flatnonzero(last) + 1
        self.hash = span_hash(prefix_hash(_BYTE[low]), self.start, self.end)
        self.text_start = np.searchsorted(self.start, offsets[:-1])
        self.text_end = np.searchsorted(self.start, offsets[1:])

    def text(self, i: int) -> bytes:
        return self.low[self.start[i] : self.end[i]].tobytes()

    def span(self, i: int, n: int) -> bytes:
        """Words i to i + n, joined by blanks."""
        return b" ".join(self.text(j) for j in range(i, i + n))


def word_grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of ``k`` consecutive word hashes."""
    return gram_hash(prefix_hash(hashes), k)

"""Helpers that several corpus operators share: word hashing on
Arrow buffers, blobs that travel through a shuffle, and connected components.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import written

#: Words are maximal runs of anything but these six ASCII characters.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
WORD_SPACES = b"\x09\x0a\x0b\x0c\x0d\x20"

#: Bytes of text that one vectorised step looks at (a longer document is one step).
STEP_BYTES = 1 << 20

U64 = np.uint64


# ---------------------------------------------------------------- memory of Python workers
_remembered: list = []


def remembered(f: Callable) -> Callable:
    """A loader whose results a Python worker keeps from task to task, until another operator needs the memory."""
    kept = functools.lru_cache(2)(f)
    _remembered.append(kept)
    return kept


def release(keep: Callable | None = None) -> None:
    """Drops what other operators remember and gives freed memory back to the machine: Python workers live on, and
    executors hold several beside a large heap.  keep: the loader whose results are still needed."""
    for kept in _remembered:
        if kept is not keep:
            kept.cache_clear()
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


try:
    _libc = ctypes.CDLL("libc.so.6")
except OSError:  # another C library
    _libc = None


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# ---------------------------------------------------------------- words as numbers
_rng = np.random.default_rng(20240229)
_BYTE = (_rng.integers(0, 1 << 63, 256, dtype=np.uint64) << U64(1)) | U64(1)
_OTHER_BYTE = (_rng.integers(0, 1 << 63, 256, dtype=np.uint64) << U64(1)) | U64(1)
_STEP = U64(0x9E3779B97F4A7C15)
_STEP_INV = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[list(WORD_SPACES)] = True
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) >= n:
        return _powers
    made = []
    for base in (_STEP, _STEP_INV):
        t = np.full(n, base, np.uint64)
        t[0] = 1
        made.append(np.cumprod(t, dtype=np.uint64))
    if n <= 4 * STEP_BYTES:
        _powers = (made[0], made[1])
    return made[0], made[1]


def mix64(h: np.ndarray) -> np.ndarray:
    """A finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> U64(33))
    h *= U64(0xFF51AFD7ED558CCD)
    h ^= h >> U64(33)
    h *= U64(0xC4CEB9FE1A85EC53)
    h ^= h >> U64(33)
    return h


def text_buffers(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array without copying; a null counts as an empty text."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.null_count:
        arr = arr.fill_null("")
    if not len(arr):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(arr.type)
    _, offsets, data = arr.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


def steps(data: np.ndarray, off: np.ndarray, limit: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges [a, b) of about ``limit`` bytes of text, one row at least."""
    a, n = 0, len(off) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + limit, "right")) - 1)
        yield a, b
        a = b


def word_spans(data: np.ndarray, off: np.ndarray, cut: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): byte spans of the words; row i has words first[i] to first[i + 1].

    cut: bytes at which another word begins, though no space stands before them.
    """
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    solid = ~_SPACE[data]
    begin, end = solid.copy(), solid.copy()
    border = ~solid if cut is None else ~solid | cut
    begin[1:] &= ~solid[:-1] if cut is None else ~solid[:-1] | cut[1:]
    end[:-1] &= border[1:]
    full = off[1:] > off[:-1]
    a, b = off[:-1][full], off[1:][full] - 1
    begin[a], end[b] = solid[a], solid[b]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, off)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, second: bool = False) -> np.ndarray:
    """A 64-bit hash of each byte span, from prefix sums of a polynomial over random byte values; second: one independent of the first."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_OTHER_BYTE if second else _BYTE)[data] * up[: len(data)], out=sums[1:])
    return mix64((sums[ends] - sums[starts]) * down[starts])


def window_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n consecutive entries of ``words`` (over row borders too; callers mask those)."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    m = len(words) - n + 1
    h = words[:m].copy()
    for k in range(1, n):
        h *= _STEP
        h += words[k : k + m]
    return mix64(h)


# ---------------------------------------------------------------- components
def components(edges: DataFrame, what: str = "components") -> DataFrame:
    """(node, component): the smallest node that links reach, for every node of ``edges`` (a, b).

    Alternating large-star and small-star steps, until every node points to a root and to nothing else.  A node has smaller
    neighbours only as the larger end u of a link, so the least neighbour of each such node is a grouped minimum, and a root, to which a whole
    component may point, is never grouped by: it meets those minima in a join of two written tables, whose
    hot key adaptive execution splits.  Nothing is gathered on the driver.
    """
    e = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), what)
    while True:
        least = written(e.groupBy(F.col("u").alias("x")).agg(F.min("v").alias("m"), F.count("*").alias("n")), what)
        large = written(e.join(least, e["v"] == least["x"], "left").select("u", F.coalesce("m", "v").alias("v"), F.col("m").isNotNull().alias("moved")), what)
        if large.where("moved").isEmpty() and least.where("n > 1").isEmpty():
            break
        down = written(large.groupBy(F.col("u").alias("x")).agg(F.min("v").alias("m")), what)
        small = large.join(down, large["u"] == down["x"]).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = written(down.select(F.col("x").alias("u"), F.col("m").alias("v")).unionAll(small).distinct(), what)
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(roots)


# ---------------------------------------------------------------- counts by block
def summed_blocks(counts: DataFrame, groups: int = 64) -> DataFrame:
    """(block, n, counts): sums of the packed arrays ``counts`` (block int, n long, counts binary), one row per block.

    Two rounds, of the tasks that share a remainder and of those sums; each adds up one array after the other as they come,
    so a task holds two arrays, however many tasks counted.
    """
    n = min(partitions(counts.sparkSession), 64)

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total, rows = None, None, 0

        def out() -> pa.RecordBatch:
            return pa.record_batch([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([rows], pa.int64()), pa.array([pack_arrays(total)], pa.binary())], ["block", "part", "n", "counts"])

        for batch in batches:
            for block, part, k, blob in zip(*(batch.column(c).to_pylist() for c in range(3)), batch.column(3), strict=True):
                own = unpack_arrays(blob.as_py())[0]
                if key == (block, part):
                    total, rows = total + own, rows + k
                    continue
                if key is not None:
                    yield out()
                key, total, rows = (block, part), own, k
        if key is not None:
            yield out()

    schema = "block int, part int, n long, counts binary"
    some = counts.select("block", F.pmod(F.spark_partition_id(), F.lit(groups)).alias("part"), "n", "counts")
    for _ in range(2):
        some = some.repartition(n, "block", "part").sortWithinPartitions("block", "part").mapInArrow(added, schema).withColumn("part", F.lit(0))
    return some.drop("part")


# ---------------------------------------------------------------- blobs
_CODEC = pa.Codec("zstd", 3)


def pack_arrays(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed value."""
    head = np.array([len(arrays), *(x for a in arrays for x in (np.dtype(a.dtype).num, len(a)))], np.int64)
    raw = head.tobytes() + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)
    return len(raw).to_bytes(8, "little") + _CODEC.compress(raw, asbytes=True)


_BY_NUM = {np.dtype(t).num: np.dtype(t) for t in (np.uint8, np.uint16, np.uint32, np.uint64, np.int32, np.int64, np.float32, np.float64)}


def unpack_arrays(blob: bytes) -> list[np.ndarray]:
    raw = _CODEC.decompress(blob[8:], int.from_bytes(blob[:8], "little"), asbytes=True)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    head = np.frombuffer(raw, np.int64, 2 * n, 8)
    at, out = 8 + 16 * n, []
    for k in range(n):
        kind = _BY_NUM[int(head[2 * k])]
        out.append(np.frombuffer(raw, kind, int(head[2 * k + 1]), at))
        at += int(head[2 * k + 1]) * kind.itemsize
    return out


def pack_rows(batch: pa.RecordBatch) -> bytes:
    """Arrow rows as one compressed value."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpack_rows(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(pa.py_buffer(blob)).read_all()


def runs_of(*sorted_keys: np.ndarray) -> np.ndarray:
    """Starts of the runs of entries equal in all keys."""
    if not len(sorted_keys[0]):
        return np.zeros(0, np.int64)
    new = np.ones(len(sorted_keys[0]), bool)
    new[1:] = False
    for key in sorted_keys:
        new[1:] |= key[1:] != key[:-1]
    return np.flatnonzero(new)

"""Small helpers of the operators: reading tables, written intermediate tables, hashes over byte buffers."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from sparkwarden.session import discard, stored  # noqa: F401  # written tables of the operators


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frugal(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """The same function of batches; at its end the worker, which waits for further tasks, gives back the memory that it has freed."""

    def released(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
            if trim is not None:
                trim(0)

    return released


def strings(column: pa.Array) -> list[str]:
    """Texts of an Arrow column; null becomes empty."""
    return [x or "" for x in column.to_pylist()]


def chunks(lengths: np.ndarray, limit: int):
    """Ranges of consecutive rows of at most ``limit`` bytes together, or of one longer row."""
    start, total = 0, 0
    for i, n in enumerate(lengths):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += int(n)
    if start < len(lengths):
        yield start, len(lengths)


def texts_of(column: pa.Array, limit: int = 1 << 20):
    """(first row, texts) of a string column in portions of about ``limit`` bytes; null becomes empty."""
    for lo, hi in chunks(pc.fill_null(pc.binary_length(column), 0).to_numpy(), limit):
        yield lo, strings(column.slice(lo, hi - lo))


def byte_rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column in one array, and the n + 1 row boundaries in it (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    n = len(column)
    bounds = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8) if n else np.zeros(1, np.int64)
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[bounds[0] : bounds[-1]], bounds - bounds[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; wraps on purpose."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def whole_groups(batches, key: str):
    """Regroups Arrow batches that are sorted by ``key``: yields (table, starts), where the table holds whole groups only.

    ``starts`` are the first rows of the groups and the table's end. What is kept between batches is one group.
    """
    kept: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        keys = b.column(b.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        if kept:
            last = kept[-1].column(kept[-1].schema.get_field_index(key))[-1].as_py()
            if last != keys[0]:
                yield _grouped(kept, key)
                kept = []
        if not len(cuts):
            kept.append(b)
            continue
        yield _grouped([*kept, b.slice(0, cuts[-1])], key)
        kept = [b.slice(cuts[-1])]
    if kept:
        yield _grouped(kept, key)


def _grouped(batches: list[pa.RecordBatch], key: str):
    whole = pa.Table.from_batches(batches).combine_chunks()
    keys = whole.column(key).to_numpy()
    return whole, np.r_[0, np.flatnonzero(keys[1:] != keys[:-1]) + 1, len(keys)]


def matrix(column: pa.ChunkedArray | pa.Array, kind=np.float32) -> np.ndarray:
    """Rows of a binary column, all of one length, as a matrix."""
    data, bounds = byte_rows(column)
    return data.reshape(len(bounds) - 1, -1).view(kind) if len(bounds) > 1 else np.zeros((0, 0), kind)


class Forest:
    """Union-find over the numbers below n; the root is the smallest member."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)
        return i != j

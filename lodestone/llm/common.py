"""Shared parts: scratch tables, per-process stores, Arrow text access and hashing."""

from __future__ import annotations

import ctypes
import gc
import sys
import types
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import drop_path, scratch_path, shared_dir, written

__all__ = ["drop_path", "scratch_path", "shared_dir", "written"]

U64 = np.uint64


def lean(run: Callable) -> Callable:
    """run, for mapInArrow, giving memory that it has freed back to the system at the task's end: workers go on to other stages."""

    def trimmed(batches):
        import pyarrow as pa

        pa.set_memory_pool(pa.system_memory_pool())
        try:
            yield from run(batches)
        finally:
            trim()

    return trimmed


def lean_group(run: Callable, after: int = 32_000_000) -> Callable:
    """The same for applyInArrow, each time so many bytes have come."""

    def trimmed(table):
        out = run(table)
        store = worker_store()
        store["come"] = store.get("come", 0) + table.nbytes
        if store["come"] > after:
            store["come"] = 0
            trim()
        return out

    return trimmed


def trim() -> None:
    gc.collect()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


#: A key with this share of the rows, or more, is hot; so there are 1 / HOT_SHARE hot keys at most.
HOT_SHARE, LEAST_HOT = 1e-3, 5_000


def join_counted(rows: DataFrame, keyed: DataFrame, on: list[str], n: str = "n", total: int | None = None) -> DataFrame:
    """rows joined with keyed, which has one row for each key and in n the count of rows (or more) that the key has.

    Hot keys go to the rows by broadcast: as each has HOT_SHARE of all rows, they are 1 / HOT_SHARE at most. The others
    meet in a shuffle, where no key has more than that share. total: the sum of n, if it is known. Both tables are read
    twice, so they should be tables that were written.
    """
    if total is None:
        total = keyed.agg(F.sum(n)).first()[0] or 0
    cut = max(LEAST_HOT, int(total * HOT_SHARE))
    hot = keyed.filter(F.col(n) >= cut)
    if hot.isEmpty():
        return rows.join(keyed, on)
    cold = rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(keyed.filter(F.col(n) < cut), on)
    return rows.join(F.broadcast(hot), on).select(*cold.columns).union(cold)


def worker_store() -> dict:
    """A dict that lives as long as the Python process, so that reused workers keep their caches."""
    module = sys.modules.get("_lodestone_worker_store")
    if module is None:
        module = sys.modules["_lodestone_worker_store"] = types.ModuleType("_lodestone_worker_store")
    return module.__dict__


def only(key, make: Callable):
    """What make() gives, kept in this process for the key; anything kept for another key goes, so that stages do not add up."""
    store = worker_store()
    held = store.get("only")
    if held is None or held[0] != key:
        store.clear()
        store["only"] = held = key, make()
    return held[1]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit integers (xor-shift and multiply, two rounds)."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an Arrow string column as one array, and the n+1 offsets of its rows. Nulls are empty."""
    import pyarrow as pa

    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def byte_batches(batches, column: str, limit: int = 1_000_000):
    """Arrow batches cut so that each holds about limit bytes of the text column at most (or one row)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = batch.column(batch.schema.get_field_index(column))
        _, offsets = text_bytes(sizes)
        start = 0
        while start < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
            end = min(max(end, start + 1), batch.num_rows)
            yield batch.slice(start, end - start)
            start = end


#: Bytes that separate words: white space of ASCII. Upper-case ASCII letters become lower-case ones.
def _fold_table() -> np.ndarray:
    fold = np.arange(256, dtype=np.uint8)
    fold[65:91] += 32
    return fold


FOLD = _fold_table()
SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def _powers(n: int) -> np.ndarray:
    store = worker_store()
    have = store.get("powers")
    if have is None or len(have) < n:
        base = U64(0x9E3779B97F4A7C15 | 1)
        have = np.full(max(n, 1 << 20), base, dtype=U64)
        have[0] = U64(1)
        have = np.multiply.accumulate(have)
        store["powers"] = have
    return have[:n]


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every white-space separated, ASCII-lower-cased word; and the n+1 offsets of the rows' words.

    A word's hash is its polynomial over bytes modulo 2**64, taken from prefix sums, then mixed.
    """
    n = len(data)
    if not n:
        return np.zeros(0, U64), np.zeros(len(offsets), np.int64)
    inside = ~SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    bounds = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < n)]
    first[bounds] = inside[bounds]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[bounds - 1] = inside[bounds - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    powers = _powers(n + 1)
    prefix = np.zeros(n + 1, U64)
    np.cumsum((FOLD[data].astype(U64) + U64(1)) * powers[:n], out=prefix[1:])
    # comparing at a common power instead of dividing: multiply up to the power n
    value = (prefix[ends] - prefix[starts]) * powers[n - starts]
    # the power n differs between batches; undo it with the inverse of base**n
    inverse = U64(pow(int(powers[n]), -1, 1 << 64))
    return mix64(value * inverse + (ends - starts).astype(U64)), np.searchsorted(starts, offsets)


def shingle_hashes(words: np.ndarray, bounds: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of k words in a row, and the n+1 offsets of the rows' shingles.

    A row of 1 to k-1 words has one shingle, of all its words; a row of none has none.
    """
    counts = np.diff(bounds)
    n = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
    out_bounds = np.zeros(len(bounds), np.int64)
    np.cumsum(n, out=out_bounds[1:])
    total = int(out_bounds[-1])
    if not total:
        return np.zeros(0, U64), out_bounds
    row = np.repeat(np.arange(len(counts)), n)
    start = np.arange(total) - out_bounds[row] + bounds[row]
    padded = np.concatenate([words, np.zeros(k, U64)])
    length = np.minimum(counts, k)[row]
    out = np.zeros(total, U64)
    for i in range(k):
        part = padded[start + i] if not (length <= i).any() else np.where(length > i, padded[start + i], U64(0))
        out = (out ^ part) * U64(0xFF51AFD7ED558CCD | 1)
        out ^= out >> U64(29)
    return mix64(out), out_bounds

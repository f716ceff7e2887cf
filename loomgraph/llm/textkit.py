"""Vectorised word and shingle fingerprints over the buffers of Arrow string columns.

A batch is handled in chunks of half a MB, so memory follows the chunk (or the
longest single text), never the batch or the partition.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
CHUNK = 500_000
_R = 0x9E3779B97F4A7C55  # odd, so it has an inverse modulo 2**64
_RINV = pow(_R, -1, 1 << 64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, *range(9, 14)]] = True

_tables: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "r" not in _tables or len(_tables["r"]) < n:
        n = max(n, CHUNK)
        with np.errstate(over="ignore"):
            for name, base in (("r", _R), ("i", _RINV)):
                t = np.full(n, base, dtype=U)
                t[0] = 1
                _tables[name] = np.cumprod(t, dtype=U)
    return _tables["r"], _tables["i"]


def mix(h: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
        return h ^ (h >> U(31))


def text_chunks(column: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, row offsets) of consecutive rows with about ``size`` bytes; null is empty."""
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        column, kind = column.cast(pa.string()), np.int32
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + n + 1].astype(np.int64)
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    if column.null_count:  # null rows may cover bytes; give them none
        lens = np.diff(offs)
        lens[~np.asarray(column.is_valid())] = 0
        buf = np.concatenate([buf[a : a + k] for a, k in zip(offs[:-1], lens)] or [np.zeros(0, np.uint8)])
        offs = np.concatenate([[0], np.cumsum(lens)])
    at = 0
    while at < n:
        to = int(np.searchsorted(offs, offs[at] + size, side="right")) - 1
        to = min(max(to, at + 1), n)
        yield at, buf[offs[at] : offs[to]], offs[at : to + 1] - offs[at]
        at = to


def word_hashes(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, byte where it starts, first word of each row and the total)."""
    n = len(buf)
    if not n:
        return np.zeros(0, U), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    space = SPACE[buf]
    begin = np.empty(n, dtype=bool)
    begin[0] = True
    begin[1:] = space[:-1]
    begin[offs[:-1][offs[:-1] < n]] = True
    begin &= ~space
    starts = np.flatnonzero(begin)
    first = np.searchsorted(starts, offs)
    if not len(starts):
        return np.zeros(0, U), starts, first
    r, inv = _powers(n + 1)
    with np.errstate(over="ignore"):
        v = (LOWER[buf].astype(U) + U(1)) * r[:n]
        v[space] = 0
        h = np.add.reduceat(v, starts) * inv[starts]
    return mix(h), starts, first


def shingle_hashes(words: np.ndarray, first: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, fingerprints of its ``k``-word shingles in text order).

    A row of fewer than ``k`` words has one: of its whole sequence. A row
    without words has none.
    """
    total = len(words)
    muls = mix(np.arange(1, k + 1, dtype=U) * U(0x9E3779B97F4A7C15)) | U(1)
    with np.errstate(over="ignore"):
        if total >= k:
            h = words[: total - k + 1] * muls[0]
            for j in range(1, k):
                h = h + words[j : total - k + 1 + j] * muls[j]
            h = mix(h)
        for row in range(len(first) - 1):
            a, b = int(first[row]), int(first[row + 1])
            if b - a >= k:
                yield row, h[a : b - k + 1]
            elif b > a:
                m = b - a
                yield row, mix(np.array([(words[a:b] * muls[:m]).sum(dtype=U) + U(m) * U(0xD6E8FEB86659FD93)], dtype=U))
            else:
                yield row, np.zeros(0, U)


def signed(a: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's long."""
    return a.view(np.int64)


def binaries(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, type=pa.binary())


def give_back() -> None:
    """Return freed memory to the system: Python workers outlive their task, and wait beside those of other stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def lean(f: Callable) -> Callable:
    """``f`` of batches, with its memory given back when the task ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(batches)
        finally:
            give_back()

    return run

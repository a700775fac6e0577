"""Vectorised text primitives that run inside Arrow batches.

Everything here works on the UTF-8 bytes of many texts at once (numpy on the Arrow buffers), so a task
never loops over words in Python.  Hashes are deterministic and the same on every executor.
"""

from __future__ import annotations

import ctypes
import functools
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once: bounds the memory of a task (about 60 bytes of scratch per text byte).
CHUNK_BYTES = 1 << 19
#: Words longer than this are hashed by blake2b instead of the vectorised hash.
LONG_WORD = 4096

_U = np.uint64
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def bounded(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same function of Arrow batches; at the end of a partition freed memory goes back to the system, as Python workers live on."""

    @functools.wraps(run)
    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
        if trim:
            trim(0)

    return held


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every output bit depends on every input bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _stream(seed: int, n: int) -> np.ndarray:
    return mix((np.arange(1, n + 1, dtype=np.uint64) + _U(seed * 7919)) * _U(0x9E3779B97F4A7C15))


_BYTES = {s: _stream(s, 256) for s in (1, 2)}
_PLACES: dict[int, np.ndarray] = {}


def places(seed: int, n: int) -> np.ndarray:
    """Random odd multipliers by position; grown when a longer string comes."""
    have = _PLACES.get(seed)
    if have is None or len(have) < n:
        have = _PLACES[seed] = _stream(seed + 100, max(n, 2 * LONG_WORD)) | _U(1)
    return have


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive rows with about `limit` bytes; a longer text comes alone."""
    raw, at = utf8(column)
    lo, n = 0, len(at) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, "right")) - 1)
        yield lo, hi, raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


def words(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of all rows, and the offsets of each row's words; white space is ASCII only."""
    solid = ~SPACE[raw]
    edge = np.zeros(len(raw) + 1, dtype=bool)
    edge[at] = True
    before = np.empty_like(solid)
    if len(raw):
        before[0] = False
        before[1:] = solid[:-1]
    starts = np.flatnonzero(solid & (~before | edge[:-1]))
    after = np.empty_like(solid)
    if len(raw):
        after[-1] = False
        after[:-1] = solid[1:]
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, at)


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 1) -> np.ndarray:
    """A 64-bit hash of each of the disjoint, increasing byte spans."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    size = ends - starts
    first = np.cumsum(size) - size
    total = int(first[-1] + size[-1])
    place = np.arange(total) - np.repeat(first, size)
    values = _BYTES[seed][raw[place + np.repeat(starts, size)]]
    values *= places(seed, int(size.max()))[place]
    full = size > 0
    out = np.zeros(len(starts), np.uint64)
    out[full] = np.add.reduceat(values, first[full])
    return mix(out + size.astype(np.uint64) * _U(0xD6E8FEB86659FD93))


def digest(data: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little")


_POWERS: dict[int, np.ndarray] = {}
#: Odd bases of the two rolling hashes, with their inverses modulo 2**64.
BASES = {1: 0x9E3779B97F4A7C15, 2: 0xC2B2AE3D27D4EB4F}


def powers(seed: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get(seed)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        pair = []
        for base in (BASES[seed], pow(BASES[seed], -1, 1 << 64)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            pair.append(np.multiply.accumulate(x))
        have = _POWERS[seed] = tuple(pair)
    return have


def windows(symbols: np.ndarray, width: int, seed: int = 1) -> np.ndarray:
    """Hashes of all runs of `width` consecutive symbols (of the whole array; the caller drops those across rows)."""
    n = len(symbols) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    power, inverse = powers(seed, len(symbols) + 1)
    sums = np.zeros(len(symbols) + 1, np.uint64)
    np.cumsum(symbols * power[: len(symbols)], out=sums[1:])
    return mix((sums[width:] - sums[:n]) * inverse[:n])

"""Blocked Bloom filters: all probes of a key lie in one block of BLOCK_BITS bits, so a filter can be merged, sent or joined block by block."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_BITS, PROBES = 1 << 16, 4
#: Keys that a block is meant for; bytes of a filter that may be sent to every executor.
BLOCK_KEYS, MOST_BYTES = 1 << 13, 1 << 26
_U = np.uint64


def block_of(h: np.ndarray, blocks: int) -> np.ndarray:
    """Block of each key: the high half of its first hash, scaled."""
    return (((h >> _U(32)) * _U(blocks)) >> _U(32)).astype(np.int64)


def probes(h: np.ndarray) -> np.ndarray:
    """Bits of each key inside its block: the four quarters of its second hash."""
    return np.ascontiguousarray(h).view(np.uint16).reshape(-1, PROBES)


def held(data: np.ndarray, at: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether all probes are set in the blocks that begin at byte `at`."""
    bits = probes(h)
    return ((data[at[:, None] + (bits >> 3)] >> (7 - (bits & 7)).astype(np.uint8)) & 1).all(axis=1)


def test(filter_: tuple[bytes, bytes], block: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Indices of the keys that a packed filter holds."""
    places, data = np.frombuffer(filter_[0], np.int32), np.frombuffer(filter_[1], np.uint8)
    place = places[block].astype(np.int64)
    maybe = np.flatnonzero(place >= 0)
    return maybe[held(data, place[maybe] * (BLOCK_BITS // 8), h[maybe])] if len(maybe) else maybe


def fits(merged: DataFrame, blocks: int, most_bytes: int) -> bool:
    """Whether a filter (block, bits: its blocks that hold a key) is small enough for `packed`."""
    return merged.count() * (BLOCK_BITS // 8) + 4 * blocks <= most_bytes


def packed(merged: DataFrame, blocks: int) -> tuple[bytes, bytes]:
    """Place of each block (-1: no key) and the blocks one after another; ask `fits` first."""
    rows = merged.collect()
    places = np.full(blocks, -1, np.int32)
    places[[r["block"] for r in rows]] = np.arange(len(rows))
    return places.tobytes(), b"".join(bytes(r["bits"]) for r in rows)


def _filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by block."""
    block, bits = None, np.zeros(BLOCK_BITS, bool)

    def close() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([np.packbits(bits).tobytes()], pa.binary())], ["block", "bits"])

    for batch in batches:
        of, h = batch.column("block").to_numpy(), batch.column("h").to_numpy().view(np.uint64)
        edges = np.flatnonzero(np.r_[True, of[1:] != of[:-1], True]) if len(of) else np.zeros(1, int)
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if of[a] != block:
                if block is not None:
                    yield close()
                block = int(of[a])
                bits[:] = False
            bits[probes(h[a:b]).ravel()] = True
    if block is not None:
        yield close()


def filter_of(keys: DataFrame, blocks: int) -> DataFrame:
    """block, bits of a filter over the distinct keys (h1: block, h2: probes, both long)."""
    block = F.shiftrightunsigned(F.shiftrightunsigned("h1", 32) * F.lit(blocks).cast("long"), 32)
    return keys.select(block.alias("block"), F.col("h2").alias("h")).repartition("block").sortWithinPartitions("block").mapInArrow(_filled, "block long, bits binary")

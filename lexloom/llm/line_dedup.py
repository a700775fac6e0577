"""Removal of lines that repeat across documents.

Two Bloom filters are filled over all lines: one with the keys seen, one with the keys seen again.  The filters are cut into
blocks of BLOCK_BITS bits, all probes of a key lie in one block, and there is a block for each BLOCK_KEYS lines counted, so
the filters stay as sharp at any size.  Tasks send the probes of their distinct keys; where a block is merged, a key whose
probes are all set already counts as seen again.  If the merged "again" blocks take MOST_BYTES or less together, they go to
every executor and each line is tested where it stands; beyond that the hashes of the lines go to the blocks.  Only keys that
the filter holds are shuffled, as 128-bit hashes with their documents, to be confirmed exactly and to find the smallest
document of each.

Null or empty text: one empty line.  A null id never matches and keeps its lines; repeated rows with one id count as one document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm import bloom
from lexloom.llm import textblocks as tb
from lexloom.llm.bloom import BLOCK_BITS, BLOCK_KEYS, MOST_BYTES, PROBES
from lexloom.llm.shared import fresh, join_small, pick, settle

#: Distinct keys of a task that are sent together.
SENT_KEYS = 1 << 18
MIN_KEY_CHARS = 10
_U = np.uint64


class _Lines:
    """Lines of a chunk of documents and the hashed keys of those that can repeat."""

    def __init__(self, raw: np.ndarray, at: np.ndarray, least: int):
        row_of_start = np.arange(len(at) - 1)
        breaks = np.flatnonzero(raw == 10)
        self.starts = np.sort(np.r_[at[:-1], breaks + 1], kind="stable")
        per_row = np.searchsorted(breaks, at[1:]) - np.searchsorted(breaks, at[:-1]) + 1
        self.row = np.repeat(row_of_start, per_row)
        self.offsets = np.r_[0, np.cumsum(per_row)]
        # a start belongs to the row it was made for: within one row starts are in order, rows follow one another
        last = np.r_[self.row[1:] != self.row[:-1], True]
        self.ends = np.where(last, at[self.row + 1], np.r_[self.starts[1:], 0] - 1)
        low = tb.LOWER[raw]
        solid = np.flatnonzero(~tb.SPACE[raw])
        i, j = np.searchsorted(solid, self.starts), np.searchsorted(solid, self.ends)
        some = j > i
        pad = np.r_[solid, 0]
        key_start, key_end = np.where(some, pad[np.minimum(i, len(solid))], self.starts), np.where(some, pad[np.maximum(j - 1, 0)] + 1, self.starts)
        points = np.r_[0, np.cumsum((raw & 0xC0) != 0x80)]
        self.line = np.flatnonzero(some & (points[key_end] - points[key_start] >= least))
        a, b = key_start[self.line], key_end[self.line]
        self.h1, self.h2 = tb.span_hashes(low, a, b, 1), tb.span_hashes(low, a, b, 2)


def _distinct(ids: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    return np.unique(np.rec.fromarrays([h1, h2, ids]))


def _cells(data: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Consecutive counts[i] rows of data as one binary value each."""
    edges = np.r_[0, np.cumsum(counts)] * data.dtype.itemsize * (data.shape[1] if data.ndim > 1 else 1)
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(edges.astype(np.int32).tobytes()), pa.py_buffer(np.ascontiguousarray(data).tobytes())])


def _fill(blocks: int, least: int):
    """block, once, again: probes of the distinct keys of a task, and of those that it has seen in two documents."""

    def sent(parts: list[np.ndarray]) -> pa.RecordBatch:
        own = np.unique(np.concatenate(parts))  # by key, then document
        head = np.flatnonzero(np.r_[True, (own["f0"][1:] != own["f0"][:-1]) | (own["f1"][1:] != own["f1"][:-1])])
        several = np.diff(np.r_[head, len(own)]) > 1
        block, probes = bloom.block_of(own["f0"][head], blocks), bloom.probes(own["f1"][head])  # keys are sorted by first hash, so by block
        found, start = np.unique(block, return_index=True)
        counts, more = np.diff(np.r_[start, len(block)]), np.add.reduceat(several, start)
        return pa.RecordBatch.from_arrays([pa.array(found), _cells(probes, counts), _cells(probes[several], more)], ["block", "once", "again"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[np.ndarray] = []
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for lo, _, raw, at in tb.chunks(batch.column("text")):
                x = _Lines(raw, at, least)
                if len(x.line):
                    parts.append(_distinct(ids[lo + x.row[x.line]], x.h1, x.h2))
                if sum(map(len, parts)) >= SENT_KEYS:
                    yield sent(parts)
                    parts = []
        if parts:
            yield sent(parts)

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by block: one pair of blocks is held at a time."""
    block, once, again = None, np.zeros(BLOCK_BITS, bool), np.zeros(BLOCK_BITS, bool)
    out: list[tuple[int, bytes]] = []

    def rows() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.int64()), pa.array([a for _, a in out], pa.binary())], ["block", "bits"])

    for batch in batches:
        for k, o, a in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
            if k != block:
                if again.any():
                    out.append((block, np.packbits(again).tobytes()))
                block = k
                once[:] = again[:] = False
            o, a = np.frombuffer(o.as_buffer(), np.uint16).reshape(-1, PROBES), np.frombuffer(a.as_buffer(), np.uint16)
            again[o[once[o].all(axis=1)].ravel()] = True
            once[o.ravel()] = True
            again[a] = True
        if len(out) >= 64:
            yield rows()
            out = []
    if again.any():
        out.append((block, np.packbits(again).tobytes()))
    if out:
        yield rows()


_SUSPECT = "doc_id long, h1 long, h2 long"


def _suspect(again, blocks: int, least: int):
    """Lines whose keys the filter (broadcast) holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for lo, _, raw, at in tb.chunks(batch.column("text")):
                x = _Lines(raw, at, least)
                hit = bloom.test(again.value, bloom.block_of(x.h1, blocks), x.h2)
                if len(hit):
                    own = _distinct(ids[lo + x.row[x.line[hit]]], x.h1[hit], x.h2[hit])
                    yield pa.RecordBatch.from_arrays([pa.array(own.f2), pa.array(own.f0.view(np.int64)), pa.array(own.f1.view(np.int64))], ["doc_id", "h1", "h2"])

    return run


def _keyed(blocks: int, least: int):
    """block, keys: document and hashes of the lines of a chunk, for a filter too large to be sent to every executor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for lo, _, raw, at in tb.chunks(batch.column("text")):
                x = _Lines(raw, at, least)
                if len(x.line):
                    own = _distinct(ids[lo + x.row[x.line]], x.h1, x.h2)
                    found, start = np.unique(bloom.block_of(own.f0, blocks), return_index=True)
                    rows = np.stack([own.f2, own.f0.view(np.int64), own.f1.view(np.int64)], axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(found), _cells(rows, np.diff(np.r_[start, len(own)]))], ["block", "keys"])

    return run


def _tested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for keys, again in zip(batch.column("keys"), batch.column("bits"), strict=True):
            rows = np.frombuffer(keys.as_buffer(), np.int64).reshape(-1, 3)
            held = rows[bloom.held(np.frombuffer(again.as_buffer(), np.uint8), np.zeros(len(rows), np.int64), rows[:, 2])]
            if len(held):
                yield pa.RecordBatch.from_arrays([pa.array(held[:, k]) for k in range(3)], ["doc_id", "h1", "h2"])


def _drop(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            late = batch.column("late")
            for lo, hi, raw, at in tb.chunks(batch.column("text")):
                x = _Lines(raw, at, least)
                gone = np.zeros(len(x.starts), bool)
                cut = np.searchsorted(x.row[x.line], np.arange(hi - lo + 1))
                text, kept, counts = raw.tobytes(), [], []
                for k in range(hi - lo):
                    if late[lo + k].is_valid and cut[k + 1] > cut[k]:
                        pairs = late[lo + k].values
                        known = set(zip(pairs.field(0).to_numpy().view(np.uint64).tolist(), pairs.field(1).to_numpy().view(np.uint64).tolist(), strict=True))
                        for i in range(cut[k], cut[k + 1]):
                            gone[x.line[i]] = (int(x.h1[i]), int(x.h2[i])) in known
                    a, b = x.offsets[k], x.offsets[k + 1]
                    stay = a + np.flatnonzero(~gone[a:b])
                    whole = len(stay) == b - a
                    kept.append(text[at[k] : at[k + 1]] if whole else b"\n".join([text[s:e] for s, e in zip(x.starts[stay].tolist(), x.ends[stay].tolist(), strict=True)]))
                    counts.append((int(b - a), int(b - a - len(stay))))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(lo, hi - lo),
                        pa.array([n for n, _ in counts], pa.int64()),
                        pa.array([n for _, n in counts], pa.int64()),
                        pa.array(kept, pa.binary()).cast(pa.string()),
                        pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()),
                    ],
                    ["doc_id", "n_lines", "n_dropped", "kept", "kept_sha256"],
                )

    return run


def repeated_lines(documents: DataFrame, least: int = MIN_KEY_CHARS, block_keys: int = BLOCK_KEYS, most_bytes: int = MOST_BYTES) -> DataFrame:
    """doc_id, late: the key hashes that a smaller document holds, of each document that has some."""
    spark = documents.sparkSession
    docs = pick(documents, "doc_id", "text").where("doc_id IS NOT NULL AND text IS NOT NULL").withColumn("doc_id", F.col("doc_id").cast("long"))
    lines = docs.agg(F.sum(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1)).first()[0] or 0
    blocks = lines // block_keys + 1
    filled = docs.mapInArrow(tb.bounded(_fill(blocks, least)), "block long, once binary, again binary")
    merged = settle(filled.repartition("block").sortWithinPartitions("block").mapInArrow(tb.bounded(_merge), "block long, bits binary"), "again-filter")
    if bloom.fits(merged, blocks, most_bytes):
        again = spark.sparkContext.broadcast(bloom.packed(merged, blocks))
        tested = docs.mapInArrow(tb.bounded(_suspect(again, blocks, least)), _SUSPECT)
    else:
        tested = docs.mapInArrow(tb.bounded(_keyed(blocks, least)), "block long, keys binary").join(merged, "block").mapInArrow(tb.bounded(_tested), _SUSPECT)
    suspects = settle(tested, "suspect-lines")
    first = settle(suspects.groupBy("h1", "h2").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").drop("b"), "first-lines")
    late = join_small(suspects, first, ["h1", "h2"], "inner").where("doc_id > a").groupBy("doc_id").agg(F.collect_set(F.struct("h1", "h2")).alias("late"))
    return settle(late, "late-lines")


def remove_repeated_lines(documents: DataFrame, least: int = MIN_KEY_CHARS, block_keys: int = BLOCK_KEYS, most_bytes: int = MOST_BYTES) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept (lines left, joined by \\n), kept_sha256 of every document."""
    docs = pick(documents, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    late = repeated_lines(documents, least, block_keys, most_bytes)
    return docs.join(late, "doc_id", "left").mapInArrow(tb.bounded(_drop(least)), "doc_id long, n_lines long, n_dropped long, kept string, kept_sha256 string")


def _replace(least: int, late: str):
    drop = _drop(least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked = pa.RecordBatch.from_arrays([pa.nulls(batch.num_rows, pa.int64()), batch.column("text"), batch.column(late)], ["doc_id", "text", "late"])
            kept = pa.concat_arrays([x.column("kept") for x in drop(iter([asked]))]) if batch.num_rows else batch.column("text")
            null = batch.column("text").is_null()
            text = pc.if_else(null, pa.nulls(batch.num_rows, pa.string()), kept.cast(pa.string()))
            names = [n for n in batch.schema.names if n != late]
            yield pa.RecordBatch.from_arrays([text if n == "text" else batch.column(n) for n in names], names)

    return run


def with_lines_removed(documents: DataFrame, least: int = MIN_KEY_CHARS) -> DataFrame:
    """The rows with the repeated lines taken out of their text and n_chars (where there is one) set anew; no row is dropped."""
    name = fresh(documents, "late")
    late = repeated_lines(documents, least).select("doc_id", F.col("late").alias(name))
    clean = documents.join(late, "doc_id", "left").select(*documents.columns, name).mapInArrow(tb.bounded(_replace(least, name)), documents.schema)
    return clean.withColumn("n_chars", F.length("text").cast(documents.schema["n_chars"].dataType)) if "n_chars" in documents.columns else clean

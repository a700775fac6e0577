"""Whitening of embeddings by a bit-sliced scatter matrix.

Components become integers, x = floor(scale * c) + OFFSET.  The fit list holds each distinct vector once.  A task shifts each
dimension by its least value, packs every bit plane of every dimension across its rows into 64-bit words and counts the ones
of the AND of each two planes; a count weighs 2^(sum of the planes' places).  Counts are summed by Spark, so cross-products,
sums and the covariance's numerators n * sum(x_i * x_j) - S_i * S_j are exact integers at any size; only then are they
divided by n^2 and given to `eigh`.

What reaches the driver depends on the dimension alone (a number for each pair of dimensions and weight), never on the rows.
TILE dimensions are counted in one pass, which bounds a task's memory at TILE * dimension * weights counts.

Vectors that are null or hold null or non-finite entries are dropped; a null id stays, and repeated rows have a result each
time.  Vectors of the most frequent length take part (the longer one of two equally frequent), others are dropped; empty
vectors have no component.  Components whose eigenvalue is not above rounding (copies of one vector, fewer vectors than
dimensions) can't be scaled to variance 1 and have no rows, so an empty table, or one of a single distinct vector, gives no
rows.  Entries are kept inside the range of a long before OFFSET is added; `deviation` stops at the end of that range.
Columns beside vec_id and embedding are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.shared import pick, settle

OFFSET = 1_000_000
COMPONENTS = 16
#: Rows sliced together (a multiple of 64) and dimensions counted against all others in one pass.
BLOCK_ROWS, TILE = 8192, 256
_LONG = (1 << 63) - 1


def integers(vectors: DataFrame, scale: float = 64.0) -> DataFrame:
    """vec_id, x (array of long) of the rows whose vector has finite entries only."""
    v = pick(vectors, "vec_id", "embedding").where("embedding IS NOT NULL")
    v = v.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda c: c.cast("double")).alias("e"))
    v = v.where(F.forall("e", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))))
    most, least = F.lit(_LONG - OFFSET), F.lit(-_LONG)
    inside = lambda c: F.when(c >= 2.0**62, most).when(c <= -(2.0**62), least).otherwise(F.floor(c)) + OFFSET
    return v.select("vec_id", F.transform("e", lambda c: inside(c * scale)).alias("x"))


def usual_length(rows: DataFrame) -> int:
    found = rows.groupBy(F.size("x").alias("size")).count().orderBy(F.col("count").desc(), F.col("size").desc()).first()
    return found["size"] if found else 0


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), width)


def _ranges(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Least and largest value of each dimension, and the rows, of a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, low, high = 0, np.full(width, _LONG), np.full(width, -_LONG - 1)
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column("x"), width)
                n, low, high = n + len(x), np.minimum(low, x.min(axis=0)), np.maximum(high, x.max(axis=0))
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array(low), pa.array(high), pa.array([n] * width, pa.int64())], ["i", "low", "high", "n"])

    return run


def bit_planes(x: np.ndarray, low: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The planes of all dimensions (rows packed into 64-bit words, padded by zeros), the dimension and the place of each; sorted by dimension."""
    shifted = np.zeros((-(-len(x) // 64) * 64, x.shape[1]), np.uint64)
    shifted[: len(x)] = x.view(np.uint64) - low.view(np.uint64)  # modulo 2^64, so right for any two longs
    dims, places, planes = [], [], []
    for b in range(int(bits.max(initial=0))):
        some = np.flatnonzero(bits > b)
        ones = ((shifted[:, some] >> np.uint64(b)) & np.uint64(1)).astype(bool)
        planes.append(np.ascontiguousarray(np.packbits(ones, axis=0).T).view(np.uint64))
        dims.append(some)
        places.append(np.full(len(some), b))
    if not planes:
        return np.zeros((0, len(shifted) // 64), np.uint64), np.zeros(0, int), np.zeros(0, int)
    dim, place = np.concatenate(dims), np.concatenate(places)
    order = np.lexsort((place, dim))
    return np.concatenate(planes)[order], dim[order], place[order]


def _scatter(low: np.ndarray, bits: np.ndarray, first: int, end: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """i, j, weight, ones: how often both planes of two dimensions (first <= i < end, i <= j) are set, by the sum of their places; j = -1: how often a plane of i is."""
    width = len(low)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = max(1, 2 * int(bits.max(initial=0)) - 1)
        ones = np.zeros((end - first, width, weights), np.int64)
        alone = np.zeros((end - first, weights), np.int64)
        for batch in batches:
            whole = _matrix(batch.column("x"), width)
            for at in range(0, len(whole), BLOCK_ROWS):
                planes, dim, place = bit_planes(whole[at : at + BLOCK_ROWS], low, bits)
                for p in np.flatnonzero((dim >= first) & (dim < end)).tolist():
                    i, here = dim[p] - first, int(np.searchsorted(dim, dim[p]))
                    ones[i, dim[here:], place[p] + place[here:]] += np.bitwise_count(planes[p] & planes[here:]).sum(axis=1, dtype=np.int64)
                    alone[i, place[p]] += int(np.bitwise_count(planes[p]).sum(dtype=np.int64))
        i, j, w = np.nonzero(ones)
        a, b = np.nonzero(alone)
        columns = [np.r_[i, a] + first, np.r_[j, np.full(len(a), -1)], np.r_[w, b]]
        yield pa.RecordBatch.from_arrays([*[pa.array(c.astype(np.int32)) for c in columns], pa.array(np.r_[ones[i, j, w], alone[a, b]])], ["i", "j", "weight", "ones"])

    return run


@dataclass
class Whitener:
    n: int  # rows of the fit list
    low: np.ndarray  # least value of each dimension (long)
    above: list[int]  # sum of x - low of each dimension, exact
    size: np.ndarray  # bits of the largest x - low of each dimension
    values: np.ndarray  # eigenvalues kept, falling
    vectors: np.ndarray  # their unit vectors, a column each
    trace: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exact: long where all values and the sum of their squares fit, else Python integers."""
        y = x.view(np.uint64) - self.low.view(np.uint64)
        widest = self.n << int(self.size.max(initial=0))
        if len(self.low) * widest * widest <= _LONG:
            return self.n * y.astype(np.int64) - np.array(self.above, np.int64)
        return y.astype(object) * self.n - np.array(self.above, object)

    def project(self, centred: np.ndarray) -> np.ndarray:
        """Coordinates of variance 1 over the fit list, a column for each component."""
        away = (centred / self.n).astype(float)
        return away @ self.vectors / np.sqrt(self.values)


def fit(distinct: DataFrame, width: int, components: int = COMPONENTS) -> Whitener | None:
    """distinct: x, each vector once, all of one length; None where no component has a positive variance."""
    ranges = distinct.mapInArrow(_ranges(width), "i int, low long, high long, n long").groupBy("i").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n")).orderBy("i").collect()
    if not ranges:
        return None
    n, low = ranges[0]["n"], np.array([r["low"] for r in ranges], np.int64)
    bits = np.array([(r["high"] - r["low"]).bit_length() for r in ranges])
    product = [[0] * width for _ in range(width)]
    above = [0] * width
    for first in range(0, width, TILE):
        counted = distinct.mapInArrow(_scatter(low, bits, first, min(first + TILE, width)), "i int, j int, weight int, ones long")
        for r in counted.groupBy("i", "j", "weight").agg(F.sum("ones").alias("ones")).toArrow().to_batches():  # a row for each two dimensions and weight
            for i, j, weight, ones in zip(*[c.to_pylist() for c in r.columns], strict=True):
                if j < 0:
                    above[i] += ones << weight
                else:
                    product[i][j] += ones << weight
    covariance = np.zeros((width, width))
    for i in range(width):
        for j in range(i, width):
            covariance[i, j] = covariance[j, i] = (n * product[i][j] - above[i] * above[j]) / (n * n)
    values, vectors = np.linalg.eigh(covariance)
    order = np.argsort(-values, kind="stable")[:components]
    order = order[values[order] > max(values.max(initial=0), 0) * width * 8 * np.finfo(float).eps]
    if not len(order):
        return None
    return Whitener(n, low, above, bits, values[order], vectors[:, order], float(np.trace(covariance)))


def _moments(w: Whitener, width: int, centre: np.ndarray | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sums of the whitened coordinates of a partition (centre: None), or of the products of each two less their centre."""
    k = len(w.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k if centre is None else (k, k))
        for batch in batches:
            if batch.num_rows:
                z = w.project(w.centred(_matrix(batch.column("x"), width)))
                total += z.sum(axis=0) if centre is None else (z - centre).T @ (z - centre)
        yield pa.RecordBatch.from_arrays([pa.array(range(total.size), pa.int32()), pa.array(total.ravel())], ["place", "value"])

    return run


def identity_error(distinct: DataFrame, w: Whitener, width: int) -> float:
    """Largest absolute entry of the whitened fit list's covariance minus the identity."""

    def summed(centre: np.ndarray | None) -> np.ndarray:
        rows = distinct.mapInArrow(_moments(w, width, centre), "place int, value double").groupBy("place").agg(F.sum("value").alias("value")).orderBy("place")
        return np.array([r["value"] for r in rows.collect()])  # one number for each (pair of) component(s)

    k = len(w.values)
    covariance = summed(summed(None) / w.n).reshape(k, k) / w.n
    return float(np.abs(covariance - np.eye(k)).max())


def _apply(w: Whitener, width: int, error: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    k = len(w.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                rows = part.num_rows
                away = w.centred(_matrix(part.column("x"), width))
                far = np.minimum((away**2).sum(axis=1), _LONG).astype(np.int64)
                cells = [
                    part.column("vec_id").take(pa.array(np.repeat(np.arange(rows), k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                    pa.array(np.full(rows * k, w.n)),
                    pa.array(np.repeat(far, k)),
                    pa.array(w.project(away).ravel()),
                    pa.array(np.tile(w.values / w.trace, rows)),
                    pa.array(np.full(rows * k, error)),
                ]
                yield pa.RecordBatch.from_arrays(cells, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return run


def whiten(vectors: DataFrame, components: int = COMPONENTS, scale: float = 64.0) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error for every row and component."""
    shape = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = integers(vectors, scale)
    width = usual_length(rows)
    rows = rows.where(F.size("x") == width)
    distinct = settle(rows.select("x").distinct(), "distinct-vectors")
    w = fit(distinct, width, components) if width else None
    if w is None:
        return vectors.sparkSession.createDataFrame([], shape)
    return rows.mapInArrow(_apply(w, width, identity_error(distinct, w, width)), shape)

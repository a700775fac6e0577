"""Exact top-k search by inner product with pivot-table elimination.

Vectors become integers (floor of `scale` times each component).  A table holds the distance of every candidate to each
pivot, computed once.  For a query the triangle inequality gives a lower bound of the distance to a candidate from every
pivot; the largest one bounds the inner product from above, (|q|^2 + |x|^2 - d^2) / 2.  Candidates are evaluated in the
order of their bounds until the k-th score found is above the next bound, so the answer is exact.

Pivots are rows of a bounded sample (SAMPLE rows by hash), each the farthest from those chosen before; they only steer the
order.  Candidates and their table stay where they are, in blocks.  The queries go to them in turns: a turn is at most
TURN_BYTES of query vectors, broadcast; a task keeps the k best of each query over all its blocks, and those of all tasks
are merged.  The driver holds the sizes of the query blocks (a number for each BLOCK_BYTES) and one turn.

Vectors that are null or hold null or non-finite components take no part, nor does a null id; vectors of different length
don't meet.  Ties go to the smaller id; a query's own id is left out.  A repeated row is a candidate once for each time and
asks once; queries of one id with different vectors share the id's k places.  Components and scores are exact over the whole
range of a long and stop at its ends.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexloom.llm.shared import pick, scratch_path, settle

PIVOTS, SAMPLE = 64, 1024
#: Rows and bytes of a block of vectors, bytes of the queries of one turn, candidates evaluated at once.
BLOCK_ROWS, BLOCK_BYTES, TURN_BYTES, CHUNK = 2048, 1 << 20, 1 << 24, 512
_LONG = (1 << 63) - 1
FOUND = "query_id long, vec_id long, score long"


def usable(vectors: DataFrame, scale: float = 64.0) -> DataFrame:
    """vec_id, v (array of long): rows with an id and only finite components."""
    x = pick(vectors, "vec_id", "embedding").where("vec_id IS NOT NULL AND embedding IS NOT NULL")
    v = F.transform("embedding", lambda c: c.cast("double"))
    x = x.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("e"))
    x = x.where(F.forall("e", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))))
    return x.select("vec_id", F.transform("e", lambda c: F.floor(c * scale)).alias("v"))


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of one length."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distance of each row to each pivot, pivot by pivot, as float32."""
    x = x.astype(float)
    return np.stack([np.sqrt(((x - p) ** 2).sum(axis=1)) for p in pivots]).astype(np.float32) if len(pivots) else np.zeros((0, len(x)), np.float32)


def _pack(pivots: np.ndarray | None):
    """Blocks of vectors of one length: a key of its own, bytes, ids, values and, for candidates, the pivot table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        number = 0

        def close(dim: int, most: int) -> pa.RecordBatch:
            nonlocal number
            ids, x = np.concatenate([i for i, _ in held[dim]]), np.concatenate([p for _, p in held[dim]])
            held[dim] = [(ids[most:], x[most:])] if len(ids) > most else []
            ids, x, number = ids[:most], x[:most], number + 1
            table = distances(x, pivots) if pivots is not None and pivots.shape[1] == dim else np.zeros((0, len(ids)), np.float32)
            # ids may be repeated, also in other blocks: the partition and the number of the block are part of its key
            said = f"{TaskContext.get().partitionId()} {number} {dim} ".encode() + ids.tobytes() + x.tobytes()
            key = int.from_bytes(hashlib.blake2b(said, digest_size=8).digest(), "little", signed=True)
            cells = [[dim], [key], [8 * (len(ids) + x.size)], [ids.tobytes()], [x.tobytes()], [table.tobytes()]]
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, kinds, strict=True)], ["dim", "block", "size", "ids", "x", "table"])

        for batch in batches:
            ids, v = batch.column("vec_id").to_numpy(), batch.column("v")
            size = np.diff(v.offsets.to_numpy())
            for dim in np.unique(size).tolist():
                at = np.flatnonzero(size == dim)
                held.setdefault(dim, []).append((ids[at], _matrix(v.take(pa.array(at))) if dim else np.zeros((len(at), 0), np.int64)))
                most = max(1, min(BLOCK_ROWS, BLOCK_BYTES // max(8 * dim, 1)))
                while sum(len(i) for i, _ in held[dim]) >= most:
                    yield close(dim, most)
        for dim in list(held):
            while held[dim]:
                yield close(dim, BLOCK_ROWS)

    return run


_SHAPE = "dim int, block long, size long, ids binary, x binary, table binary"


def farthest_first(sample: np.ndarray, n: int) -> np.ndarray:
    """Up to n different rows, each the farthest from those before it."""
    if not len(sample):
        return sample
    chosen, away = [0], ((sample - sample[0]) ** 2).sum(axis=1)
    while len(chosen) < n and away.max() > 0:
        chosen.append(int(away.argmax()))
        away = np.minimum(away, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
    return sample[chosen]


def upper_bounds(to_pivots: np.ndarray, norm_q: float, norms: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Largest possible inner product of one query with each candidate, from the pivot that tells most; rounding errors are allowed for."""
    top = (norm_q + norms) * (0.5 + 1e-9)
    if not len(table):
        return top + 1e-6
    apart = np.abs(table - to_pivots[:, None])
    apart = apart.max(axis=0).astype(float) - 1e-6 * (np.sqrt(norm_q) + np.sqrt(norms) + float(to_pivots.max()))
    return top - np.maximum(apart, 0) ** 2 / 2 + 1e-6


class Best:
    """The k best (id, score) of one query so far."""

    def __init__(self, k: int):
        self.k, self.ids, self.scores = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def least(self) -> float:
        return float(self.scores[-1]) if len(self.scores) == self.k else -np.inf

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        if len(self.scores) == self.k:
            good = scores >= self.scores[-1]
            ids, scores = ids[good], scores[good]
        ids, scores = np.r_[self.ids, ids], np.r_[self.scores, scores]
        top = np.lexsort((ids, -scores))[: self.k]
        self.ids, self.scores = ids[top], scores[top]


def products(x: np.ndarray, q: np.ndarray, small: bool) -> np.ndarray:
    """Inner products as long: in floating point where all sums stay under 2^53, else by exact integers."""
    if small:
        return (x.astype(float, copy=False) @ q.astype(float)).astype(np.int64)
    return np.array([min(max(sum(int(a) * int(b) for a, b in zip(row, q, strict=True)), -_LONG), _LONG) for row in x], np.int64)


def meet(best: Best, q: np.ndarray, q_id: int, ids: np.ndarray, x: np.ndarray, bound: np.ndarray, small: bool) -> int:
    """Evaluate one block's candidates in the order of their bounds until none left can be among the best; returns how many were."""
    left = np.flatnonzero((bound >= best.least()) & (ids != q_id))
    left = left[np.argsort(-bound[left])]
    done = 0
    while done < len(left) and bound[left[done]] >= best.least():
        part = left[done : done + CHUNK]
        best.add(ids[part], products(x[part], q, small))
        done += len(part)
    return done


def _search(k: int, pivots: np.ndarray, asked):
    """asked: broadcast list of (dim, ids, values) of the blocks of queries of this turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = []
        for dim, ids, x in asked.value:
            q = np.frombuffer(x, np.int64).reshape(-1, dim) if dim else np.zeros((len(ids) // 8, 0), np.int64)
            turn.append((dim, np.frombuffer(ids, np.int64), q, (q.astype(float) ** 2).sum(axis=1), distances(q, pivots).T if pivots.shape[1] == dim else np.zeros((len(q), 0), np.float32), [Best(k) for _ in range(len(q))]))
        for batch in batches:
            for row in batch.to_pylist():
                ids = np.frombuffer(row["ids"], np.int64)
                x = np.frombuffer(row["x"], np.int64).reshape(len(ids), row["dim"])
                table = np.frombuffer(row["table"], np.float32).reshape(-1, len(ids))
                norms = (x.astype(float) ** 2).sum(axis=1)
                widest = float(norms.max())
                for dim, q_ids, q, norms_q, to, best in turn:
                    if dim == row["dim"]:
                        for i in range(len(q_ids)):
                            small = widest * norms_q[i] < 2.0**104
                            values = x if not small else _as_float(row, x)
                            meet(best[i], q[i], int(q_ids[i]), ids, values, upper_bounds(to[i], norms_q[i], norms, table), small)
        for _, q_ids, _, _, _, best in turn:
            ids = np.concatenate([np.full(len(b.ids), i) for i, b in zip(q_ids, best, strict=True)])
            if len(ids):
                yield pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int64)), pa.array(np.concatenate([b.ids for b in best])), pa.array(np.concatenate([b.scores for b in best]))], ["query_id", "vec_id", "score"])

    return run


def _as_float(row: dict, x: np.ndarray) -> np.ndarray:
    """The block as float64, made once."""
    if "float" not in row:
        row["float"] = x.astype(float)
    return row["float"]


def _turns(sizes: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """First and last key of consecutive blocks of queries with at most TURN_BYTES together (one block at least)."""
    first = last = None
    total = 0
    for key, size in sorted(sizes):
        if first is not None and total + size > TURN_BYTES:
            yield first, last
            first, total = None, 0
        first, last, total = key if first is None else first, key, total + size
    if first is not None:
        yield first, last


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, scale: float = 64.0) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k largest inner products of each query with the other rows."""
    spark = vectors.sparkSession
    base = usable(vectors, scale)
    drawn = [r["v"] for r in base.select("v", F.xxhash64("vec_id", F.lit(3)).alias("h")).orderBy("h").limit(SAMPLE).collect()]  # SAMPLE rows at most
    dims = [len(v) for v in drawn]
    dim = max(set(dims), key=dims.count) if dims else 0
    sample = [v for v in drawn if len(v) == dim]
    pivots = farthest_first(np.array(sample, float).reshape(len(sample), dim), PIVOTS)
    blocks = settle(base.mapInArrow(_pack(pivots), _SHAPE), "candidate-blocks")
    asked = settle(usable(queries, scale).distinct().mapInArrow(_pack(None), _SHAPE), "query-blocks")
    path = scratch_path(spark, "turns")
    spark.createDataFrame([], FOUND).write.parquet(path)
    for first, last in _turns([(r["block"], r["size"]) for r in asked.select("block", "size").collect()]):
        held = asked.where(F.col("block").between(first, last)).select("dim", "ids", "x").collect()  # TURN_BYTES at most
        turn = spark.sparkContext.broadcast([(r["dim"], bytes(r["ids"]), bytes(r["x"])) for r in held])
        blocks.mapInArrow(_search(k, pivots, turn), FOUND).write.mode("append").parquet(path)
        turn.destroy()
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    found = spark.read.schema(FOUND).parquet(path).withColumn("rank", F.row_number().over(order))
    return found.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

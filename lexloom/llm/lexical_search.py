"""Ranked lexical search over a length-stratified index.

A document's normaliser m = 100 - 25 + (25 * n * N) div L depends on its length n alone, so an occurrence count tf has one
impact in all documents of equal m: (10^9 * tf) div (1000 * tf + 12 * m).  The index groups documents by m.  A stratum holds,
term by term, runs of postings of equal tf, largest tf first; an impact is computed once for each run.

Building: one pass counts N and L, a second one packs the documents of each partition, in buffers of BUFFER_BYTES of text,
into strata.  The index is divided by documents, so no posting is shuffled, a term of every document is spread over all
tasks, and copies of one length are spread as the documents are.

Searching: items come in broadcast turns of at most TURN_CELLS (items x terms).  A first pass sums the document frequencies
of a turn's terms.  In the second one the largest tf of each term bounds what a stratum can give to an item; each item visits
its strata in the order of their bounds, in rounds of doubling size, until the next bound is under its k-th best score.
Bounds are exact, ties are visited.  A task keeps k documents an item; those of all tasks are merged.

Terms are told apart by 64-bit hashes.  A null text has no term; documents without terms, and rows without an id, take no part
(documents without id aren't counted in N, L or df either).  A repeated document row is a document of its own; a repeated item
row is asked once, and texts that share an item_id are ranked each on their own.  Long texts are read whole.  Empty tables
give no rows.  Columns beside the id and the text are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexloom.llm import textblocks as tb
from lexloom.llm.shared import pick, scratch_path, settle
from lexloom.llm.topk_search import Best

#: Text packed together by a task; items x distinct terms of one turn of queries.
BUFFER_BYTES, TURN_CELLS = 1 << 24, 1 << 22
INDEX = "m long, docs binary, terms binary, runs_at binary, tf binary, posts_at binary, posts binary"
FOUND = "item long, item_id long, doc_id long, score long"
_U = np.uint64
#: A-Z lower-cased; what is no part of a term becomes a space.
_TERM = np.full(256, 32, np.uint8)
_TERM[np.r_[48:58, 97:123, 128:256]] = np.r_[48:58, 97:123, 128:256]
_TERM[65:91] = np.arange(97, 123)


def terms_of(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the terms of all texts, one text after another, and the offsets of each text's terms."""
    low = _TERM[raw]
    starts, ends, offsets = tb.words(low, at)
    key = tb.span_hashes(low, starts, ends)
    for i in np.flatnonzero(ends - starts > tb.LONG_WORD):
        key[i] = tb.digest(low[starts[i] : ends[i]].tobytes())
    return key, offsets


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with a term, and terms, of a partition."""
    n = total = 0
    for batch in batches:
        for _, _, raw, at in tb.chunks(batch.column("text")):
            count = np.diff(tb.words(_TERM[raw], at)[2])
            n, total = n + int((count > 0).sum()), total + int(count.sum())
    yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total])], ["n", "total"])


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal keys, and the end."""
    if not len(keys[0]):
        return np.zeros(1, np.int64)
    new = np.zeros(len(keys[0]), bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.r_[np.flatnonzero(new), len(new)]


def pack(m: np.ndarray, ids: np.ndarray, doc: np.ndarray, term: np.ndarray, tf: np.ndarray) -> pa.RecordBatch:
    """The strata of a buffer: m and id of each document; document, term and tf of each posting."""
    by_m = np.argsort(m, kind="stable")
    rank = np.empty(len(m), np.int64)
    rank[by_m] = np.arange(len(m))
    doc = rank[doc]
    stratum_at = _runs(m[by_m])
    stratum = np.repeat(np.arange(len(stratum_at) - 1), np.diff(stratum_at))[doc]
    order = np.lexsort((doc, -tf, term, stratum))
    stratum, doc, term, tf = stratum[order], doc[order], term[order], tf[order]
    cut = np.searchsorted(stratum, np.arange(len(stratum_at)))
    rows = []
    for s, (a, b) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)):
        first = stratum_at[s]
        posts_at = _runs(term[a:b], tf[a:b])
        heads = a + posts_at[:-1]
        runs_at = _runs(term[heads])
        rows.append(
            (int(m[by_m[first]]), ids[by_m[first : stratum_at[s + 1]]].tobytes(), term[heads[runs_at[:-1]]].tobytes(), runs_at.astype(np.uint32).tobytes(),
             tf[heads].astype(np.uint32).tobytes(), posts_at.astype(np.uint32).tobytes(), (doc[a:b] - first).astype(np.uint32).tobytes())
        )
    kinds = [pa.int64()] + [pa.binary()] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], [c.split()[0] for c in INDEX.split(", ")])


def _strata(n_docs: int, n_terms: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = docs = 0

        def close() -> pa.RecordBatch:
            return pack(*[np.concatenate(c) for c in zip(*held, strict=True)])

        for batch in batches:
            for lo, hi, raw, at in tb.chunks(batch.column("text")):
                key, offsets = terms_of(raw, at)
                count = np.diff(offsets)
                some = np.flatnonzero(count)
                if not len(some):
                    continue
                doc = np.repeat(np.arange(len(some)), count[some])
                order = np.lexsort((key, doc))
                doc, key = doc[order], key[order]
                heads = _runs(doc, key)
                m = np.array([75 + (25 * n * n_docs) // n_terms for n in count[some].tolist()], np.int64)
                ids = batch.column("doc_id").slice(lo, hi - lo).to_numpy()[some]
                held.append((m, ids, doc[heads[:-1]] + docs, key[heads[:-1]], np.diff(heads)))
                size, docs = size + len(raw), docs + len(some)
                if size >= BUFFER_BYTES:
                    yield close()
                    held, size, docs = [], 0, 0
        if held:
            yield close()

    return run


@dataclass
class Index:
    strata: DataFrame  # INDEX, a row for each normaliser of a buffer
    n_docs: int
    n_terms: int


def build_index(documents: DataFrame) -> Index:
    docs = pick(documents, "doc_id", "text").where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    counted = docs.mapInArrow(tb.bounded(_sizes), "n long, total long").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).first()
    n, total = counted["n"] or 0, counted["total"] or 0
    return Index(settle(docs.mapInArrow(tb.bounded(_strata(n, max(total, 1))), INDEX), "lexical-index"), n, total)


class Stratum:
    """One row of the index, read in place."""

    def __init__(self, row: dict):
        self.m = row["m"]
        self.terms = np.frombuffer(row["terms"], np.uint64)
        self.runs_at, self.tf, self.posts_at = (np.frombuffer(row[c], np.uint32) for c in ("runs_at", "tf", "posts_at"))
        if "docs" in row:
            self.docs, self.posts = np.frombuffer(row["docs"], np.int64), np.frombuffer(row["posts"], np.uint32)

    def find(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indices of the asked terms (sorted) that the stratum has, and their places in it."""
        place = np.minimum(np.searchsorted(self.terms, asked), len(self.terms) - 1)
        have = np.flatnonzero(self.terms[place] == asked)
        return have, place[have]

    def impact(self, tf: np.ndarray) -> np.ndarray:
        tf = tf.astype(np.int64)
        return (1_000_000_000 * tf) // (1000 * tf + 12 * self.m)


def _frequencies(asked: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = asked.value
        df = np.zeros(len(terms), np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                s = Stratum(row)
                have, place = s.find(terms)
                df[have] += s.posts_at[s.runs_at[place + 1]].astype(np.int64) - s.posts_at[s.runs_at[place]]
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(df[some])], ["term", "df"])

    return run


@dataclass
class Turn:
    """Queries that are answered together."""

    item: np.ndarray  # number of each item over all turns
    item_id: np.ndarray
    terms: np.ndarray  # sorted hashes
    times: np.ndarray  # (items, terms): occurrences in the item
    weight: np.ndarray  # of each term


def visits(turn: Turn, strata: list[Stratum], best: list[Best]) -> int:
    """Bring the best documents of each item up to date with these strata; returns the number of visits (item, stratum)."""
    bounds = np.zeros((len(turn.item), len(strata)))
    found = []
    for k, s in enumerate(strata):
        have, place = s.find(turn.terms)
        found.append((have, place))
        bounds[:, k] = turn.times[:, have] @ (turn.weight[have] * s.impact(s.tf[s.runs_at[place]])).astype(float)
    bounds *= 1 + 1e-9  # sums of that size may be rounded
    order = np.argsort(-bounds, axis=1, kind="stable")
    exact = float((turn.times @ turn.weight.astype(float)).max(initial=0)) * 1e6 < 2.0**53
    times = turn.times if exact else turn.times.astype(np.int64)
    live, at, step, done = np.arange(len(turn.item)), 0, 1, 0
    while len(live) and at < len(strata):
        asked: dict[int, list[int]] = {}
        for i in live.tolist():
            for k in order[i, at : at + step].tolist():
                if bounds[i, k] > 0 and bounds[i, k] >= best[i].least():
                    asked.setdefault(k, []).append(i)
        for k, items in asked.items():
            s, (have, place) = strata[k], found[k]
            first, last = s.runs_at[place].astype(np.int64), s.runs_at[place + 1].astype(np.int64)
            size = last - first
            run = np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())
            value = np.repeat(turn.weight[have], size) * s.impact(s.tf[run])  # one impact a run
            count = s.posts_at[run + 1].astype(np.int64) - s.posts_at[run]
            post = np.repeat(s.posts_at[run].astype(np.int64) - np.cumsum(count) + count, count) + np.arange(count.sum())
            table = np.zeros((len(have), len(s.docs)), times.dtype)
            table[np.repeat(np.repeat(np.arange(len(have)), size), count), s.posts[post]] = np.repeat(value, count)
            scores = (times[np.ix_(items, have)] @ table).astype(np.int64)
            for i, row in zip(items, scores, strict=True):
                good = np.flatnonzero(row > 0)
                best[i].add(s.docs[good], row[good])
            done += len(items)
        at, step = at + step, 2 * step
        live = np.array([i for i in live.tolist() if at < len(strata) and bounds[i, order[i, at]] > 0 and bounds[i, order[i, at]] >= best[i].least()], int)
    return done


def _search(asked: Broadcast, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = asked.value
        best = [Best(k) for _ in turn.item]
        for batch in batches:
            visits(turn, [Stratum(r) for r in batch.to_pylist()], best)
        of = np.repeat(np.arange(len(best)), [len(b.ids) for b in best])
        if len(of):
            yield pa.RecordBatch.from_arrays([pa.array(turn.item[of]), pa.array(turn.item_id[of]), pa.array(np.concatenate([b.ids for b in best])), pa.array(np.concatenate([b.scores for b in best]))], ["item", "item_id", "doc_id", "score"])

    return run


def _turns(items: DataFrame) -> Iterator[list[tuple[int, int, np.ndarray, np.ndarray]]]:
    """Consecutive items (number, id, distinct terms, occurrences) with at most TURN_CELLS together (one item at least)."""
    held, width = [], 0
    for number, row in enumerate(items.toLocalIterator()):
        key, _ = terms_of(*tb.utf8(pa.array([row["text"]], pa.string())))
        terms, times = np.unique(key, return_counts=True)
        if held and (len(held) + 1) * (width + len(terms)) > TURN_CELLS:
            yield held
            held, width = [], 0
        held.append((number, row["item_id"], terms, times))
        width += len(terms)
    if held:
        yield held


def search(index: Index, items: DataFrame, k: int = 20) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the k best documents of each item with a score above 0."""
    spark = items.sparkSession
    asked = pick(items, "item_id", "text").where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct().orderBy("item_id", "text")
    path = scratch_path(spark, "lexical-turns")
    spark.createDataFrame([], FOUND).write.parquet(path)
    for held in _turns(asked):
        terms = np.unique(np.concatenate([t for _, _, t, _ in held]))
        if not len(terms):
            continue
        keys = spark.sparkContext.broadcast(terms)
        df = np.zeros(len(terms), np.int64)
        counted = index.strata.select("m", "terms", "runs_at", "tf", "posts_at").mapInArrow(_frequencies(keys), "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
        for r in counted.collect():  # the terms of one turn at most
            df[r["term"]] = r["df"]
        times = np.zeros((len(held), len(terms)))
        for row, (_, _, t, n) in enumerate(held):
            times[row, np.searchsorted(terms, t)] = n
        weight = np.array([math.floor(1000 * math.log((2 * index.n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
        turn = spark.sparkContext.broadcast(Turn(np.array([h[0] for h in held]), np.array([h[1] for h in held]), terms, times, weight))
        index.strata.mapInArrow(_search(turn, k), FOUND).write.mode("append").parquet(path)
        turn.destroy()
        keys.destroy()
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), "doc_id")
    found = spark.read.schema(FOUND).parquet(path).withColumn("rank", F.row_number().over(order))
    return found.where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")

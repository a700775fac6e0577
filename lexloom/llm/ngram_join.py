"""Near-duplicate groups: Jaccard join of word shingles by vertical partitioning.

The order of all shingle hashes is cut into fragments.  What a pair or a document has in one fragment is counted there
and the partial counts are summed.

1. Documents with one shingle set are one node (128-bit set hash); nodes, not copies, go on.
2. In each fragment it is counted which shingles more than one node holds.  A link needs 75 % of a node's shingles
   in another node, so a node with fewer held elsewhere is out: most documents end here.  Blocks of nodes send each
   distinct hash once, so a very common shingle costs one entry a block.
3. For the rest the shingles are ordered by document frequency; two linked nodes share one of their first
   `n - ceil(0.75 n) + 1`.  Each such shingle compares its nodes with one lead; verified links make components.
4. Nodes of different components that share one of these shingles are compared too (parity signatures rule out pairs
   whose difference is surely too large; large groups are dealt out as pairs of bounded blocks).  Pairs within one
   component need no test, so a large group of copies is never expanded.

Overlaps are counted exactly, fragment by fragment.  Null or blank text: no shingles, linked with nothing.  A null id is
linked with nothing and its component is null.  Repeated rows with one id are compared one by one and share the id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.llm import textblocks as tb
from lexloom.llm.shared import join_small, pick, settle

WORDS, PERCENT = 5, 75
#: Shingles of one block of nodes; shingles of one fragment (sets the number of fragments); fragments of one overlap count.
BLOCK_SHINGLES, FRAGMENT_SHINGLES, LEAST_FRAGMENTS, PARTS = 1 << 19, 1 << 20, 64, 8
#: Nodes of one side of a block pair in step 4.
GROUP_BLOCK = 4096
_U = np.uint64


def shingle_sets(raw: np.ndarray, at: np.ndarray, k: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of all rows one after another, their offsets)."""
    low = tb.LOWER[raw]
    starts, ends, offsets = tb.words(low, at)
    symbols = tb.span_hashes(low, starts, ends)
    for i in np.flatnonzero(ends - starts > tb.LONG_WORD):
        symbols[i] = tb.digest(low[starts[i] : ends[i]].tobytes())
    count = np.diff(offsets)
    row = np.repeat(np.arange(len(count)), count)
    whole = tb.windows(symbols, k)
    inside = np.flatnonzero(row[: len(whole)] == row[k - 1 : k - 1 + len(whole)]) if len(whole) else np.zeros(0, int)
    rows, hashes = [row[inside]], [whole[inside]]
    for size in range(1, k):  # shorter texts: the whole sequence
        few = np.flatnonzero(count == size)
        if len(few):
            rows.append(few)
            hashes.append(tb.mix(tb.windows(symbols, size)[offsets[few]] + _U(size)))
    r, h = np.concatenate(rows), np.concatenate(hashes)
    order = np.lexsort((h, r))
    r, h = r[order], h[order]
    new = np.r_[True, (r[1:] != r[:-1]) | (h[1:] != h[:-1])] if len(r) else np.zeros(0, bool)
    return h[new], np.searchsorted(r[new], np.arange(len(count) + 1))


def _node(hashes: np.ndarray) -> bytes | None:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest() if len(hashes) else None


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, raw, at in tb.chunks(batch.column("text")):
                h, cut = shingle_sets(raw, at, k)
                nodes = [_node(h[cut[i] : cut[i + 1]]) for i in range(hi - lo)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(lo, hi - lo), pa.array(np.diff(cut), pa.int64()), pa.array(nodes, pa.binary())], ["doc_id", "n_shingles", "node"]
                )

    return run


def _own(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[bytes, np.ndarray]]:
    """(node, sorted hashes) of the rows whose set is the node that their id stands for (told by its first eight bytes)."""
    for batch in batches:
        asked = batch.column("asked").to_numpy()
        for lo, hi, raw, at in tb.chunks(batch.column("text")):
            h, cut = shingle_sets(raw, at, k)
            for i in range(hi - lo):
                node = _node(h[cut[i] : cut[i + 1]])
                if node is not None and int.from_bytes(node[:8], "big", signed=True) == asked[lo + i]:
                    yield node, h[cut[i] : cut[i + 1]]


def _cut(k: int, fragments: int):
    """Blocks of nodes, cut into fragments.  Payload of a fragment: counts by node, then 6 bytes for each hash that one node of the block holds, then for each that several hold."""

    def block(nodes: list[bytes], sets: list[np.ndarray]) -> Iterator[tuple[int, int, int, bytes]]:
        size = np.array([len(x) for x in sets], np.uint32)
        h, of = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
        order = np.argsort(h, kind="stable")
        h, of = h[order], of[order]
        new = np.r_[True, h[1:] != h[:-1]]
        group = np.cumsum(new) - 1
        several = np.bincount(group) > 1
        held = np.bincount(of[several[group]], minlength=len(sets)).astype(np.uint32)
        first = np.flatnonzero(new)
        h, of = h[first], of[first]
        part = (((h >> _U(32)) * _U(fragments)) >> _U(32)).astype(np.int64)  # by the high half: fragments are ranges of the order
        ident = int.from_bytes(hashlib.blake2b(b"".join(nodes), digest_size=8).digest(), "little", signed=True)
        yield int(ident % fragments), ident, 0, np.uint32(len(nodes)).tobytes() + b"".join(nodes) + size.tobytes() + held.tobytes()
        order = np.lexsort((of, several, part))
        h, of, several, part = h[order], of[order], several[order], part[order]
        low = h.view(np.uint8).reshape(-1, 8)[:, :6]
        edges = np.searchsorted(part, np.arange(fragments + 1))
        for f in range(fragments):
            a, b = edges[f], edges[f + 1]
            if a < b:
                single = ~several[a:b]
                counts = np.bincount(of[a:b][single], minlength=len(nodes)).astype(np.uint32)
                yield f, ident, 1, np.array([len(nodes)], np.uint32).tobytes() + counts.tobytes() + low[a:b].tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple[int, int, int, bytes]]:
            nodes, sets, n = [], [], 0
            for node, h in _own(batches, k):
                nodes.append(node)
                sets.append(h)
                n += len(h)
                if n >= BLOCK_SHINGLES:
                    yield from block(nodes, sets)
                    nodes, sets, n = [], [], 0
            if nodes:
                yield from block(nodes, sets)

        yield from _rows(rows(), ["part", "block", "kind", "payload"], [pa.int32(), pa.int64(), pa.int32(), pa.binary()])

    return run


def _rows(rows: Iterator[tuple], names: list[str], kinds: list[pa.DataType], most: int = 64) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= most:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kinds, strict=True)], names)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kinds, strict=True)], names)


def _count_fragment(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by part: for each block of the part, how many hashes of each node another node holds too."""

    def close(held: list[tuple[int, np.ndarray, np.ndarray]]) -> Iterator[tuple[int, int, bytes]]:
        if not held:
            return
        every = np.concatenate([h for _, _, h in held])
        _, back, times = np.unique(every, return_inverse=True, return_counts=True)
        again = times[back] > 1
        at = 0
        for block, counts, h in held:
            mine = again[at : at + int(counts.sum())]  # singles stand first, ordered by node
            at += len(h)
            sums = np.r_[0, np.cumsum(mine)]
            edge = np.r_[0, np.cumsum(counts)]
            yield block, 1, (sums[edge[1:]] - sums[edge[:-1]]).astype(np.uint32).tobytes()

    def rows() -> Iterator[tuple[int, int, bytes]]:
        part, held = None, []
        for batch in batches:
            for p, block, kind, data in zip(*(batch.column(i) for i in range(4)), strict=True):
                data = data.as_buffer()
                if kind.as_py() == 0:
                    yield block.as_py(), 0, bytes(data)
                    continue
                if p.as_py() != part:
                    yield from close(held)
                    part, held = p.as_py(), []
                n = int(np.frombuffer(data, np.uint32, 1)[0])
                counts = np.frombuffer(data, np.uint32, n, 4)
                six = np.frombuffer(data, np.uint8, offset=4 + 4 * n).reshape(-1, 6)
                h = np.zeros((len(six), 8), np.uint8)
                h[:, :6] = six
                held.append((block.as_py(), counts, h.view(np.uint64).ravel()))
        yield from close(held)

    yield from _rows(rows(), ["block", "kind", "payload"], [pa.int64(), pa.int32(), pa.binary()])


def _survive(percent: int):
    """Rows come sorted by block, the header first: the nodes that can have a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(head: bytes | None, held: np.ndarray | None) -> Iterator[tuple[bytes]]:
            if head is not None:
                n = int(np.frombuffer(head, np.uint32, 1)[0])
                size = np.frombuffer(head, np.uint32, n, 4 + 16 * n).astype(np.int64)
                for i in np.flatnonzero(100 * held >= percent * size):
                    yield (head[4 + 16 * i : 20 + 16 * i],)

        def rows() -> Iterator[tuple[bytes]]:
            head = held = None
            for batch in batches:
                for kind, data in zip(batch.column("kind"), batch.column("payload"), strict=True):
                    data = data.as_py()
                    if kind.as_py() == 0:
                        yield from close(head, held)
                        head, n = data, int(np.frombuffer(data, np.uint32, 1)[0])
                        held = np.frombuffer(data, np.uint32, n, 4 + 20 * n).astype(np.int64)
                    else:
                        held = held + np.frombuffer(data, np.uint32)
            yield from close(head, held)

        yield from _rows(rows(), ["node"], [pa.binary()], 4096)

    return run


def _expand(k: int):
    """node, n, parity signature, hashes cut into PARTS ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            limits = (np.arange(1, PARTS, dtype=np.uint64) * _U((1 << 64) // PARTS)).astype(np.uint64)
            for node, h in _own(batches, k):
                bits = 256
                while bits < 4 * len(h):
                    bits *= 2
                parity = (np.bincount((h & _U(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)
                cut = np.r_[0, np.searchsorted(h, limits), len(h)]
                yield node, len(h), np.packbits(parity).tobytes(), [h[cut[i] : cut[i + 1]].view(np.int64) for i in range(PARTS)]

        yield from _rows(rows(), ["node", "n", "parity", "parts"], [pa.binary(), pa.int32(), pa.binary(), pa.list_(pa.list_(pa.int64()))])

    return run


def _folded(rows: list[bytes], size: int) -> np.ndarray:
    """Parity signatures XOR-folded to `size` bytes."""
    out = np.zeros((len(rows), size), np.uint8)
    for i, x in enumerate(rows):
        out[i] = np.bitwise_xor.reduce(np.frombuffer(x, np.uint8).reshape(-1, size), axis=0)
    return out.view(np.uint64)


def _cross(percent: int):
    """Rows come sorted by (h, b1, b2): pairs of nodes of different components that can be linked by size and signature."""

    def pairs(group: list[tuple]) -> Iterator[tuple[bytes, bytes]]:
        group = sorted(group, key=lambda x: (x[3], x[1]))
        comp = np.array([x[2] for x in group])
        size = np.array([x[3] for x in group], np.int64)
        same = np.array([x[5] for x in group])
        one_block = group[0][6] == group[0][7]
        ends = np.searchsorted(size, size * 100 // percent, "right")
        i = 0
        while i < len(group):
            j = i + 1  # rows with one signature length go together
            while j < len(group) and len(group[j][4]) == len(group[i][4]):
                j += 1
            width = len(group[i][4])
            reach = int(ends[i:j].max())
            signs = _folded([x[4] for x in group[i:reach]], width)
            for a in range(i, j):
                b = np.arange(a + 1, ends[a])
                b = b[(comp[b] != comp[a]) & (one_block | (same[b] != same[a]))]
                if len(b):
                    apart = np.bitwise_count(signs[b - i] ^ signs[a - i]).sum(axis=1)
                    for c in b[apart * (100 + percent) <= (100 - percent) * (size[b] + size[a])]:
                        yield tuple(sorted((group[a][1], group[c][1])))
            i = j

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple[bytes, bytes]]:
            key, group, done = None, [], set()
            for batch in batches:
                for row in zip(*(batch.column(c).to_pylist() for c in ("h", "node", "comp", "n", "parity", "mine", "b1", "b2")), strict=True):
                    if (row[0], row[6], row[7]) != key:
                        for p in pairs(group) if group else ():
                            if p not in done:
                                if len(done) >= 1 << 17:
                                    done.clear()  # only spares repetition; distinct() follows
                                done.add(p)
                                yield p
                        key, group = (row[0], row[6], row[7]), []
                    group.append(row)
            for p in pairs(group) if group else ():
                if p not in done:
                    yield p

        yield from _rows(rows(), ["a", "b"], [pa.binary(), pa.binary()], 4096)

    return run


def _size_ok(a: str, b: str, percent: int) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def _verified(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are linked: overlaps counted in each fragment and summed."""
    parts = nodes.select("node", "n", F.posexplode("parts").alias("v", "part"))
    left = pairs.join(parts.select(F.col("node").alias("a"), F.col("n").alias("na"), "v", F.col("part").alias("pa")), "a")
    right = parts.select(F.col("node").alias("b"), F.col("n").alias("nb"), "v", F.col("part").alias("pb"))
    counted = left.join(right, ["b", "v"]).groupBy("a", "b", "na", "nb").agg(F.sum(F.size(F.array_intersect("pa", "pb"))).alias("both"))
    return counted.where(f"100 * both >= {percent} * (na + nb - both)").select("a", "b")


def components(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """node, comp (smallest id of its component) of all nodes with an edge; ids: node, rep.  Labels spread along edges and jump along labels."""
    both = settle(edges.union(edges.select("b", "a")).toDF("node", "other").distinct(), "edges")
    labels = settle(both.select("node").distinct().join(ids, "node").select("node", "rep", F.col("rep").alias("comp")), "labels")
    while True:
        best = both.join(labels.select(F.col("node").alias("other"), "comp"), "other").groupBy("node").agg(F.min("comp").alias("best"))
        near = settle(labels.join(best, "node").select("node", "rep", F.col("comp").alias("old"), F.least("comp", "best").alias("comp")), "labels")
        jump = near.groupBy(F.col("rep").alias("comp")).agg(F.min("comp").alias("far"))
        new = settle(near.join(jump, "comp", "left").select("node", "rep", "old", F.least("comp", F.coalesce("far", "comp")).alias("comp")), "labels")
        labels = new.drop("old")
        if new.where("comp < old").isEmpty():
            return labels.select("node", "comp")


def near_duplicate_components(documents: DataFrame, k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable by links, itself included) of every document."""
    docs = pick(documents, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    sets = settle(docs.mapInArrow(tb.bounded(_sets(k)), "doc_id long, n_shingles long, node binary"), "sets")
    ids = settle(sets.where("node IS NOT NULL AND doc_id IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("rep")), "nodes")
    total = sets.agg(F.sum("n_shingles")).first()[0] or 0
    fragments = max(LEAST_FRAGMENTS, total // FRAGMENT_SHINGLES)
    texts = docs.where("doc_id IS NOT NULL AND text IS NOT NULL")

    def of(nodes: DataFrame) -> DataFrame:
        head = F.conv(F.hex(F.substring("node", 1, 8)), 16, -10).cast("long")
        return join_small(texts, nodes.select(F.col("rep").alias("doc_id"), head.alias("asked")).distinct(), ["doc_id"], "inner")

    cut = of(ids).mapInArrow(tb.bounded(_cut(k, fragments)), "part int, block long, kind int, payload binary")
    counted = cut.repartition("part").sortWithinPartitions("part", "kind", "block").mapInArrow(tb.bounded(_count_fragment), "block long, kind int, payload binary")
    able = settle(counted.repartition("block").sortWithinPartitions("block", "kind").mapInArrow(tb.bounded(_survive(percent)), "node binary").distinct(), "able")
    nodes = settle(of(able.join(ids, "node")).mapInArrow(tb.bounded(_expand(k)), "node binary, n int, parity binary, parts array<array<bigint>>").dropDuplicates(["node"]), "able-sets")

    held = nodes.select("node", "n", F.explode(F.flatten("parts")).alias("h"))
    often = settle(held.groupBy("h").agg(F.count("*").alias("df")).where("df > 1"), "frequencies")
    ranked = held.join(often, "h").groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("df", "h"))).alias("held"))
    least = F.ceil(F.col("n") * percent / 100).cast("int")
    ranked = ranked.where(F.size("held") >= least).select("node", "n", (F.col("n") - F.size("held")).alias("alone"), F.explode(F.slice("held", F.lit(1), F.size("held") - least + 1)).alias("x"))
    first = settle(ranked.select("node", "n", "alone", F.col("x.h").alias("h")), "prefixes")

    lead = settle(first.groupBy("h").agg(F.min(F.struct("alone", "node", "n")).alias("l"), F.count("*").alias("c")).where("c > 1").select("h", F.col("l.node").alias("lead"), F.col("l.n").alias("ln")), "leads")
    starred = first.join(lead, "h").where((F.col("node") != F.col("lead")) & _size_ok("n", "ln", percent))
    tried = settle(starred.select(F.least("node", "lead").alias("a"), F.greatest("node", "lead").alias("b")).distinct(), "lead-pairs")
    links = settle(_verified(tried, nodes, percent), "links")
    comps = components(links, ids)

    placed = settle(first.select("h", "node", "n").join(ids, "node").join(comps, "node", "left").select("h", "node", "n", F.coalesce("comp", "rep").alias("comp")), "placed")
    mixed = settle(placed.groupBy("h").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count("*").alias("c")).where("x < y").select("h", F.ceil(F.col("c") / GROUP_BLOCK).cast("int").alias("blocks")), "mixed")
    rows = placed.join(mixed, "h").join(nodes.select("node", "parity"), "node").withColumn("mine", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    rows = rows.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"b1": F.least("mine", "o"), "b2": F.greatest("mine", "o")})
    dealt = rows.select("h", "node", "comp", "n", "parity", "mine", "b1", "b2").repartition("h", "b1", "b2").sortWithinPartitions("h", "b1", "b2")
    more = dealt.mapInArrow(tb.bounded(_cross(percent)), "a binary, b binary").distinct().join(tried, ["a", "b"], "left_anti")
    links = links.union(settle(_verified(settle(more, "cross-pairs"), nodes, percent), "cross-links"))
    comps = components(links, ids)

    named = settle(ids.join(comps, "node", "left").select("node", F.coalesce("comp", "rep").alias("comp")), "components")
    return sets.join(named, "node", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("comp", "doc_id")).alias("component_id"))

"""SentencePiece encoding and decoding with N-best segmentation.

The vocabulary file is given by path and read once by each Python worker.  A text gets the usual dummy space in front and
spaces stand for U+2581.  No piece has a space after another character, so the lattice of a text falls apart into units
(spaces and the word after them, or a line break); each distinct unit of a chunk is solved once.

* Forward: Viterbi over the piece lattice of all units at once (numpy), giving the best score of every prefix and the
  loss of the second best segmentation.  Pieces score as in the vocabulary file; a character without a piece is one step
  of score UNKNOWN and is written as byte pieces, as is a literal U+2581, so every text decodes to itself.
* Backward: A* from the end of a unit.  The forward scores are exact heuristics, so segmentations come out best first.
  The N best of a text change at most N - 1 units, those of smallest loss, so only these are searched; their losses are
  merged best first, and each choice gives the ids of a whole text: those of the chosen units, the best ids elsewhere.

Null text: null tokens, scores and segmentations.  Empty text: no token, one segmentation of score 0.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm import textblocks as tb
from lexloom.llm.shared import pick

MODEL = "piece_bpe_32k.model"
N_BEST = 4
#: Units with more bytes are solved one by one.
LONG_UNIT = 48
#: Bytes of text encoded together: its distinct units are solved once.
ENCODE_BYTES = 1 << 20
_U = np.uint64
_NONE = np.int64(-(1 << 60))
_BASE = _U(0x9E3779B97F4A7C15)


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Pieces:
    """Pieces of a vocabulary file as bytes (a space for U+2581), with a table of all their prefixes."""

    _held: dict[str, Pieces] = {}

    @classmethod
    def load(cls, path: str) -> Pieces:
        if path not in cls._held:
            cls._held[path] = cls(path)
        return cls._held[path]

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.vocab_size()
        self.text: list[bytes] = [b""] * n
        self.byte_id = np.zeros(256, np.int32)
        self.piece: dict[bytes, tuple[int, int]] = {}
        for i in range(n):
            if model.is_byte(i):
                value = int(model.id_to_piece(i)[3:-1], 16)
                self.text[i], self.byte_id[value] = bytes([value]), i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                data = model.id_to_piece(i).replace("▁", " ").encode()
                self.text[i] = data
                self.piece[data] = (i, int(model.get_score(i)))
        self.unknown = min(s for _, s in self.piece.values() if s > -1_000_000) - 10
        self.longest = max(map(len, self.piece))
        prefixes = {p[:k] for p in self.piece for k in range(1, len(p) + 1)}
        self.table_bits = 19
        self.slot_hash = np.zeros(1 << self.table_bits, np.uint64)
        self.slot_id = np.full(1 << self.table_bits, -1, np.int32)
        self.probes = 1
        for p in sorted(prefixes):
            h = self._hash(p)
            at, k = int(self._slot(np.array([h], np.uint64))[0]), 1
            while self.slot_hash[at]:
                at, k = (at + 1) % (1 << self.table_bits), k + 1
            self.slot_hash[at], self.slot_id[at] = h, self.piece[p][0] if p in self.piece else -1
            self.probes = max(self.probes, k)
        self.score = np.array([self.piece[t][1] if t in self.piece and self.piece[t][0] == i else 0 for i, t in enumerate(self.text)], np.int64)
        self.size = np.array([len(t) for t in self.text], np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(self.text), np.uint8)

    @staticmethod
    def _hash(data: bytes) -> int:
        h = 0
        for b in data:
            h = (h * int(_BASE) + b + 1) & ((1 << 64) - 1)
        return h or 1

    def _slot(self, h: np.ndarray) -> np.ndarray:
        return (((h ^ (h >> _U(29))) * _U(0xD6E8FEB86659FD93)) >> _U(64 - self.table_bits)).astype(np.int64)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(is a prefix of a piece, id of the piece or -1)."""
        at = self._slot(h)
        known, ident = self.slot_hash[at] == h, self.slot_id[at]
        for k in range(1, self.probes):
            open_ = np.flatnonzero(~known & (self.slot_hash[at] != 0))
            if not len(open_):
                break
            near = (at[open_] + k) & ((1 << self.table_bits) - 1)
            hit = self.slot_hash[near] == h[open_]
            known[open_[hit]], ident[open_[hit]] = True, self.slot_id[near[hit]]
        return known, np.where(known, ident, -1)

    def forward(self, unit: bytes) -> tuple[list[int], list[list[tuple[int, int, int]]]]:
        """Best score of each prefix, and the lattice: for each end (start, score, id; -1: bytes of one character)."""
        n = len(unit)
        best, into = [0] + [int(_NONE)] * n, [[] for _ in range(n + 1)]
        for i in range(n):
            if unit[i] & 0xC0 == 0x80:
                continue
            char = i + 1
            while char < n and unit[char] & 0xC0 == 0x80:
                char += 1
            if unit[i:char] not in self.piece:
                into[char].append((i, self.unknown, -1))
            for j in range(i + 1, min(n, i + self.longest) + 1):
                found = self.piece.get(unit[i:j])
                if found:
                    into[j].append((i, found[1], found[0]))
            for j in range(i + 1, min(n, i + max(self.longest, char - i)) + 1):
                if into[j] and into[j][-1][0] == i and best[i] + into[j][-1][1] > best[j]:
                    best[j] = best[i] + into[j][-1][1]
        return best, into

    def n_best(self, unit: bytes, n: int) -> list[tuple[int, tuple[int, ...]]]:
        """The n best (score, ids) by A* from the end; of equal ones the one nearer to the start goes on first.  A step knows the step behind it, so nothing is copied."""
        best, into = self.forward(unit)
        steps: list[tuple[int, int, int, int]] = []  # (step behind it or -1, start, end, id)
        heap, out = [(-best[-1], len(unit), -1, 0)], []
        while heap and len(out) < n:
            _, at, last, done = heapq.heappop(heap)
            if at == 0:
                ids: list[int] = []
                while last >= 0:
                    last, start, end, ident = steps[last]
                    ids += [ident] if ident >= 0 else [int(self.byte_id[b]) for b in unit[start:end]]
                out.append((done, tuple(ids)))
                continue
            for start, score, ident in into[at]:
                if best[start] > int(_NONE):
                    steps.append((last, start, at, ident))
                    heapq.heappush(heap, (-(best[start] + score + done), start, len(steps) - 1, done + score))
        return out

    def solve(self, units: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Forward pass over many units (rows of padded bytes): score, loss of the second best, ids one after another, ids of each unit."""
        n, width = units.shape
        inside = np.arange(width) < size[:, None]
        lead = ((units & 0xC0) != 0x80) & inside
        row, start = np.nonzero(lead)
        h = np.zeros(len(row), np.uint64)
        edges = []  # (row, start, bytes, id)
        own = np.zeros((n, width), np.int8)  # bytes of the character at a start that is no piece
        own[:, : width - 1] = 1 + ((units[:, 1:] & 0xC0) == 0x80)
        own[:, width - 1] = 1
        for k in (1, 2):
            if width > k + 1:
                own[:, : width - k - 1] += (own[:, : width - k - 1] == k + 1) & ((units[:, k + 1 :] & 0xC0) == 0x80)
        char = own[row, start].astype(np.int64)
        bare = np.ones(len(row), bool)
        origin = np.arange(len(row))
        for k in range(1, self.longest + 1):
            fits = start[origin] + k <= size[row[origin]]
            origin, h = origin[fits], h[fits]
            h = h * _BASE + units[row[origin], start[origin] + k - 1].astype(np.uint64) + _U(1)
            known, found = self.find(h)
            piece = origin[found >= 0]
            edges.append((row[piece], start[piece], np.full(len(piece), k), found[found >= 0]))
            bare[piece[char[piece] == k]] = False
            origin, h = origin[known], h[known]
            if not len(origin):
                break
        edges.append((row[bare], start[bare], char[bare], np.full(int(bare.sum()), -1)))
        rows, starts, lengths, ids = (np.concatenate(x).astype(np.int64) for x in zip(*edges, strict=True))
        gain = np.where(ids >= 0, self.score[ids], self.unknown)
        turn = (starts + lengths) * 64 + 63 - lengths  # by end; the longest last piece comes first and wins a tie
        order = np.argsort(turn, kind="stable")
        cuts = np.flatnonzero(np.r_[True, np.diff(turn[order]) != 0, True]) if len(order) else np.zeros(1, int)
        one = np.full((n, width + 1), _NONE, np.int64)
        two = np.full((n, width + 1), _NONE, np.int64)
        back = np.zeros((n, width + 1), np.int32)
        one[:, 0] = 0
        for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            e = order[x:y]
            r, begin, end = rows[e], starts[e[0]], starts[e[0]] + lengths[e[0]]
            a, b = one[r, begin] + gain[e], two[r, begin] + gain[e]
            had = one[r, end]
            better = a > had
            two[r, end] = np.where(better, np.maximum(had, b), np.maximum(two[r, end], a))
            one[r, end] = np.where(better, a, had)
            back[r, end] = np.where(better, e, back[r, end])
        at = np.arange(n)
        total, second = one[at, size], two[at, size]
        loss = np.where(second > _NONE // 2, total - second, np.iinfo(np.int64).max)
        found_rows, places, tokens = [], [], []
        pos, live = size.copy(), np.flatnonzero(size > 0)
        while len(live):
            e = back[live, pos[live]]
            begin, got = starts[e], ids[e]
            known = got >= 0
            found_rows.append(live[known]), places.append(begin[known]), tokens.append(got[known])
            for j in range(int(lengths[e[~known]].max()) if (~known).any() else 0):
                part = ~known & (lengths[e] > j)
                found_rows.append(live[part]), places.append(begin[part] + j), tokens.append(self.byte_id[units[live[part], begin[part] + j]])
            pos[live] = begin
            live = live[begin > 0]
        rows_, places_, tokens_ = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (found_rows, places, tokens))
        order = np.lexsort((places_, rows_))
        return total, loss, tokens_[order].astype(np.int32), np.bincount(rows_, minlength=n)

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of a sequence of ids, the dummy space included."""
        size = self.size[ids]
        total = int(size.sum())
        place = np.arange(total) - np.repeat(np.cumsum(size) - size, size) + np.repeat(self.first[ids], size)
        return self.bytes[place]


def _best_sums(losses: list[list[int]], n: int) -> list[tuple[int, tuple[int, ...]]]:
    """The n smallest sums of one loss of each list (each sorted, from 0), and the place taken in each list."""
    heap, seen, out = [(0, (0,) * len(losses))], {(0,) * len(losses)}, []
    while heap and len(out) < n:
        total, at = heapq.heappop(heap)
        out.append((total, at))
        for i, k in enumerate(at):
            if k + 1 < len(losses[i]):
                new = (*at[:i], k + 1, *at[i + 1 :])
                if new not in seen:
                    seen.add(new)
                    heapq.heappush(heap, (total + losses[i][k + 1] - losses[i][k], new))
    return out


def _spaced(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes with a dummy space before each text that isn't empty."""
    size = np.diff(at)
    new = np.r_[0, np.cumsum(size + (size > 0))]
    out = np.full(int(new[-1]), 32, np.uint8)
    out[np.arange(len(raw)) + np.repeat(new[:-1] + 1 - at[:-1], size)] = raw
    return out, new


def encode_chunk(pieces: Pieces, raw: np.ndarray, at: np.ndarray, n_best: int) -> tuple[np.ndarray, np.ndarray, list[list[int]]]:
    """Ids of all texts one after another, their offsets, and the n best scores of each text."""
    return segment_chunk(pieces, raw, at, n_best)[:3]


def segment_chunk(pieces: Pieces, raw: np.ndarray, at: np.ndarray, n_best: int) -> tuple[np.ndarray, np.ndarray, list[list[int]], np.ndarray, np.ndarray]:
    """What encode_chunk returns, then the ids of all n best segmentations, text by text and best first, and the offsets of each segmentation."""
    data, edge = _spaced(raw, at)
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int32), np.zeros(len(at), np.int64), [[0] for _ in range(len(at) - 1)], np.zeros(0, np.int32), np.zeros(len(at), np.int64)
    mark = np.zeros(n + 1, bool)
    mark[edge] = True
    space, line = data == 32, data == 10
    literal = np.zeros(n, bool)  # a literal U+2581 must not be read as a space: it is a unit of its own
    three = np.flatnonzero((data[:-2] == 0xE2) & (data[1:-1] == 0x96) & (data[2:] == 0x81)) if n > 2 else np.zeros(0, int)
    literal[three] = True
    begins = mark[:n] | line | literal
    begins[1:] |= (space[1:] & ~space[:-1]) | line[:-1]
    after = three + 3
    begins[after[after < n]] = True
    start = np.flatnonzero(begins)
    end = np.r_[start[1:], n]
    size = end - start
    key = tb.span_hashes(data, start, end)
    _, first, of = np.unique(key, return_index=True, return_inverse=True)
    u_start, u_size = start[first], size[first]
    count, score, loss = np.zeros(len(first), np.int64), np.zeros(len(first), np.int64), np.zeros(len(first), np.int64)
    groups: list[tuple[np.ndarray, np.ndarray]] = []
    low = 0
    for high in (6, 9, 12, 16, 24, LONG_UNIT):
        mine = np.flatnonzero((u_size > low) & (u_size <= high))
        low = high
        for lo in range(0, len(mine), 20_000):
            part = mine[lo : lo + 20_000]
            place = u_start[part][:, None] + np.arange(high)
            block = np.where(np.arange(high) < u_size[part][:, None], data[np.minimum(place, n - 1)], 0).astype(np.uint8)
            score[part], loss[part], ids, count[part] = pieces.solve(block, u_size[part])
            groups.append((part, ids))
    long_ids = {}
    for i in np.flatnonzero(u_size > LONG_UNIT):
        unit = data[u_start[i] : u_start[i] + u_size[i]].tobytes()
        found = pieces.n_best(unit, 2)
        score[i], loss[i] = found[0][0], found[0][0] - found[1][0] if len(found) > 1 else np.iinfo(np.int64).max
        long_ids[i], count[i] = np.array(found[0][1], np.int32), len(found[0][1])
    offset = np.r_[0, np.cumsum(count)]
    flat = np.zeros(int(offset[-1]), np.int32)
    for part, ids in groups:
        c = count[part]
        flat[np.arange(len(ids)) - np.repeat(np.cumsum(c) - c, c) + np.repeat(offset[part], c)] = ids
    for i, ids in long_ids.items():
        flat[offset[i] : offset[i + 1]] = ids
    c = count[of]
    whole = flat[np.arange(int(c.sum())) - np.repeat(np.cumsum(c) - c, c) + np.repeat(offset[of], c)]
    unit_edge = np.searchsorted(start, edge)
    token_at = np.r_[0, np.cumsum(c)]
    ends = token_at[unit_edge]
    sums = np.r_[0, np.cumsum(score[of])]
    losses = loss[of]
    lists: dict[int, tuple[list[int], list[np.ndarray]]] = {}
    scores: list[list[int]] = []
    parts, sizes = [], []
    for k in range(len(at) - 1):
        a, b = unit_edge[k], unit_edge[k + 1]
        top = int(sums[b] - sums[a])
        mine = losses[a:b]
        few = np.sort(np.argpartition(mine, n_best - 2)[: n_best - 1]) if 1 < n_best <= len(mine) else np.arange(len(mine))
        options, places = [], []
        for x in few:
            u = int(of[a + x])
            if mine[x] < np.iinfo(np.int64).max:
                if u not in lists:
                    found = pieces.n_best(data[u_start[u] : u_start[u] + u_size[u]].tobytes(), n_best)
                    own = tuple(flat[offset[u] : offset[u + 1]].tolist())  # of equal scores the forward pass may have taken another
                    rest = [(s, i) for s, i in found if i != own][: n_best - 1]
                    lists[u] = [0, *(found[0][0] - s for s, _ in rest)], [np.array(i, np.int32) for _, i in [(0, own), *rest]]
                options.append(lists[u])
                places.append(int(a + x))
        best = _best_sums([x for x, _ in options], n_best)
        scores.append([top - x for x, _ in best])
        for _, chosen in best:
            done, length = int(ends[k]), int(ends[k + 1] - ends[k])
            for place, (_, ids), choice in zip(places, options, chosen, strict=True):
                if choice:
                    parts += [whole[done : token_at[place]], ids[choice]]
                    done = int(token_at[place + 1])
                    length += len(ids[choice]) - len(ids[0])
            parts.append(whole[done : ends[k + 1]])
            sizes.append(length)
    return whole, ends, scores, np.concatenate(parts), np.r_[0, np.cumsum(np.array(sizes, np.int64))]


def _encode(path: str, n_best: int, with_ids: bool, chunk_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces.load(path)
        for batch in batches:
            null = batch.column("text").is_null().to_numpy(zero_copy_only=False)
            for lo, hi, raw, at in tb.chunks(batch.column("text"), chunk_bytes):
                ids, cut, scores, every, every_cut = segment_chunk(pieces, raw, at, n_best)
                back = pieces.decode(ids)
                size = pieces.size[ids]
                spaced = np.r_[0, np.cumsum(size)][cut]
                original, decoded = raw.tobytes(), back.tobytes()
                texts = [decoded[spaced[k] + 1 : spaced[k + 1]] if spaced[k + 1] > spaced[k] else b"" for k in range(hi - lo)]
                gone = null[lo:hi]
                columns = [
                    batch.column("doc_id").slice(lo, hi - lo),
                    pa.array(np.diff(cut), pa.int64(), mask=gone),
                    pa.array([None if g else hashlib.sha256(ids[cut[k] : cut[k + 1]].astype("<i4").tobytes()).hexdigest() for k, g in enumerate(gone)], pa.string()),
                    pa.array([None if g else s for s, g in zip(scores, gone, strict=True)], pa.list_(pa.int64())),
                    pa.array([None if g else hashlib.sha256(t).hexdigest() for t, g in zip(texts, gone, strict=True)], pa.string()),
                    pa.array([None if g else t == original[at[k] : at[k + 1]] for k, (t, g) in enumerate(zip(texts, gone, strict=True))], pa.bool_()),
                ]
                names = ["doc_id", "n_tokens", "ids_sha256", "scores", "decoded_sha256", "round_trip"]
                if with_ids:
                    columns += [pa.array([None if g else ids[cut[k] : cut[k + 1]] for k, g in enumerate(gone)], pa.list_(pa.int32())), pa.array([None if g else t.decode() for t, g in zip(texts, gone, strict=True)], pa.string())]
                    each = pa.ListArray.from_arrays(pa.array(every_cut, pa.int32()), pa.array(every, pa.int32()))
                    columns.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, scores)]), pa.int32()), each, mask=pa.array(gone)))
                    names += ["ids", "decoded", "segmentations"]
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def encode(documents: DataFrame, path: str | None = None, n_best: int = N_BEST, with_ids: bool = True, chunk_bytes: int = ENCODE_BYTES) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, scores (of the n best segmentations), decoded_sha256, round_trip; with_ids: ids, decoded text and segmentations (ids of each of the n best, in the order of scores).

    Smaller chunks take less memory and more time; the result is the same.
    """
    docs = pick(documents, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    schema = "doc_id long, n_tokens long, ids_sha256 string, scores array<bigint>, decoded_sha256 string, round_trip boolean"
    return docs.mapInArrow(tb.bounded(_encode(path or model_path(), n_best, with_ids, chunk_bytes)), schema + (", ids array<int>, decoded string, segmentations array<array<int>>" if with_ids else ""))


def _decode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces.load(path)
        for batch in batches:
            texts = [None if not x.is_valid else pieces.decode(np.array(x.as_py(), np.int64)).tobytes()[1:].decode("utf-8", "replace") for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return run


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and the text that its ids stand for."""
    return pick(encoded, "doc_id", "ids").mapInArrow(tb.bounded(_decode(path or model_path())), "doc_id long, text string")

"""Removal of long passages that repeat across documents, found by recompression.

Every text becomes a string of word symbols.  Recompression renames it: first maximal runs of one symbol, then pairs of
neighbours, a pair being joined when a bit of its first symbol says "left" and a bit of its second says "right".  Names are
hashes of what they stand for, so equal passages get equal symbols except near their ends.

1. In each text symbols are grown to GROWN_WORDS words.  For each the words on which its existence depends are tracked (its
   context): wherever the same words stand, the same symbol stands.  The passes then go on without a bound until each text is
   one symbol, its largest, named by the runs and pairs that it is made of.  Symbols (and, for the few windows of `width`
   words that hold no context, the window itself) are grouped over all documents, and with them the largest symbols: a text
   whose largest symbol a smaller document has too is covered by it.  Of the other texts a window
   is left only if all its symbols are shared; the words of such windows are the regions in which repeats can be, and from
   here on only regions move.
2. Rounds of recompression rename the regions, each to symbols about four times as long (ROUND_WORDS).  After each round the
   names are grouped over all documents in a table of symbols: what one document alone holds is no symbol of the next round.
   A symbol carries a second hash of the words that it expands to, which is compared along with its name.  All windows inside
   a symbol of at least `width` words that a smaller document has too are repeated: its words go.
3. The windows that lie in no such symbol (across their borders, or in passages too short for one) are compared exactly, and
   the smallest document of each is found.  A Bloom filter of the repeated ones (sent to every executor while it is small)
   keeps the others where they are.  A window in a larger document loses its words.

Words are told apart by 64-bit hashes, symbols of regions by 128 bits, windows by 96 bits and largest symbols by 126 bits (two
names, mixed anew at each run and pair, so that no structure of a text cancels out) made of these; the symbols of step 1, which
delete nothing by themselves, by 63.  Null or empty text: no words, nothing removed.  A null id never matches and is returned unchanged.  Repeated rows with one id count as one document; each row is
cleaned by itself.  Texts of any length are worked on whole; their regions travel as rows of REGION_WORDS words at most.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm import bloom
from lexloom.llm import textblocks as tb
from lexloom.llm.shared import pick, settle

#: A symbol of so many words is joined no further in the texts, and in the rounds over the regions; passes of joining in each.
GROWN_WORDS, ROUND_WORDS, ROUNDS = 12, (24, 96, 384, 1536), 8
REGION_WORDS = 1 << 16
_FAR = 1 << 40
_U = np.uint64


def recompress(symbols: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Final symbols of the concatenated documents with start and end of the words each depends on, a second name of each, and its document."""
    n = len(symbols)
    head = np.flatnonzero(np.r_[True, (symbols[1:] != symbols[:-1]) | (row[1:] != row[:-1])]) if n else np.zeros(0, int)
    count = np.diff(np.r_[head, n])
    names, of, start, end = symbols[head], row[head], head, head + count
    twins = tb.mix(names ^ _U(0x5DEECE66D))
    names, twins = _run_names(names, twins, count)
    follows = np.r_[of[1:] == of[:-1], False] if len(of) else np.zeros(0, bool)
    low = np.where(np.r_[False, follows[:-1]], start - 1, -_FAR)  # a run is known once both neighbours differ
    high = np.where(follows, end + 1, _FAR)
    for turn in range(ROUNDS):
        if len(names) < 2:
            break
        follows = np.r_[of[1:] == of[:-1], False]
        free = end - start < GROWN_WORDS
        left = _bits(names, turn)
        first = follows & free & left & np.r_[free[1:] & ~left[1:], False]
        second = np.r_[False, first[:-1]]
        alone = free & ~first & ~second
        after, before = np.where(follows, np.r_[high[1:], _FAR], _FAR), np.where(np.r_[False, follows[:-1]], np.r_[-_FAR, low[:-1]], -_FAR)
        new_high = np.where(alone & left, np.maximum(high, after), high)
        new_low = np.where(alone & ~left, np.minimum(low, before), low)
        i = np.flatnonzero(first)
        new_low[i], new_high[i] = np.minimum(low[i], low[i + 1]), np.maximum(high[i], high[i + 1])
        end = end.copy()
        end[i] = end[i + 1]
        names, twins = _pair_names(names, twins, i)
        names, twins, of, start, end, low, high = names[~second], twins[~second], of[~second], start[~second], end[~second], new_low[~second], new_high[~second]
    return names, low, high, twins, of


def _bits(names: np.ndarray, turn: int) -> np.ndarray:
    """Whether a symbol is a left one in this pass."""
    return (tb.mix(names + _U(turn * 0x1234567 + 1)) & _U(1)).astype(bool)


def _run_names(names: np.ndarray, twins: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    times = count.astype(np.uint64)
    return np.where(count > 1, tb.mix(names + times * _U(0x9E3779B97F4A7C15)), names), np.where(count > 1, tb.mix(twins + times * _U(0xD6E8FEB86659FD93)), twins)


def _pair_names(names: np.ndarray, twins: np.ndarray, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names after the symbols at `i` are joined with those that follow them."""
    names, twins = names.copy(), twins.copy()
    names[i], twins[i] = tb.mix(names[i] * _U(3) + tb.mix(names[i + 1] + _U(77))), tb.mix(twins[i] * _U(5) + tb.mix(twins[i + 1] + _U(99)))
    return names, twins


def tops(names: np.ndarray, twins: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, name and second name of the one symbol that each document ends as: the passes go on without a bound on length."""
    turn = ROUNDS
    while True:
        head = np.flatnonzero(np.r_[True, (names[1:] != names[:-1]) | (of[1:] != of[:-1])]) if len(of) else np.zeros(0, int)
        names, twins = _run_names(names[head], twins[head], np.diff(np.r_[head, len(of)]))
        of = of[head]
        follows = np.r_[of[1:] == of[:-1], False] if len(of) else np.zeros(0, bool)
        if not follows.any():
            return of, names, twins
        left = _bits(names, turn)
        first = follows & left & np.r_[~left[1:], False]
        names, twins = _pair_names(names, twins, np.flatnonzero(first))
        stay = ~np.r_[False, first[:-1]]
        names, twins, of = names[stay], twins[stay], of[stay]
        turn += 1


class _Parsed:
    """The words of a chunk of documents, their windows and the keys that each window holds."""

    def __init__(self, raw: np.ndarray, at: np.ndarray, width: int):
        self.raw, self.width = raw, width
        self.starts, self.ends, self.offsets = tb.words(raw, at)
        size = self.ends - self.starts
        self.symbols = tb.span_hashes(raw, self.starts, self.ends)
        for i in np.flatnonzero(size > tb.LONG_WORD):
            self.symbols[i] = tb.digest(raw[self.starts[i] : self.ends[i]].tobytes())
        n = len(self.symbols)
        self.row = np.repeat(np.arange(len(at) - 1), np.diff(self.offsets))
        self.parsed = recompress(self.symbols, self.row)
        self.real = np.zeros(n, bool)  # a window starts here
        if n >= width:
            self.real[: n - width + 1] = self.row[: n - width + 1] == self.row[width - 1 :]

    def keys(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Key, and the first and last start of the windows that hold it."""
        n, width = len(self.symbols), self.width
        names, low, high = self.parsed[:3]
        fits = high - low <= width
        names, low, high = names[fits], low[fits], high[fits]
        first, last = np.maximum(high - width, 0), low
        steps = np.bincount(first, minlength=n + 2)[: n + 2] - np.bincount(last + 1, minlength=n + 2)[: n + 2]
        bare = np.flatnonzero(self.real & (np.cumsum(steps)[:n] == 0))
        whole = tb.windows(self.symbols, width)[bare] ^ _U(0xA5A5A5A5A5A5A5A5) if len(bare) else np.zeros(0, np.uint64)
        # a key outside every real window (short documents) can reveal nothing
        seen = np.r_[0, np.cumsum(self.real)]
        useful = seen[np.minimum(last + 1, n)] > seen[np.minimum(first, n)]
        return np.r_[names[useful], whole] & ~_U(1), np.r_[first[useful], bare], np.r_[last[useful], bare]

    def largest(self) -> np.ndarray:
        """Both names of the symbol that each text ends as (odd, unlike the other keys); 0 for a text without a window."""
        names, _, _, twins, of = self.parsed
        size = np.diff(self.offsets)
        on = size[of] >= self.width
        row, name, twin = tops(names[on], twins[on], of[on])
        out = np.zeros((2, len(size)), np.uint64)
        out[:, row] = np.stack([name, twin]) | _U(1)
        return out


class Level:
    """Symbols of many regions one after another: name, hash of the words they stand for, region, first word and end."""

    def __init__(self, names: np.ndarray, said: np.ndarray, of: np.ndarray, start: np.ndarray, end: np.ndarray):
        self.names, self.said, self.of, self.start, self.end = names, said, of, start, end

    def _next(self) -> np.ndarray:
        """Whether the next symbol follows at once in the same region."""
        return np.r_[(self.of[1:] == self.of[:-1]) & (self.start[1:] == self.end[:-1]), False] if len(self.of) else np.zeros(0, bool)

    def runs(self) -> Level:
        """Maximal runs of one symbol get one name."""
        follows = self._next()
        same = np.r_[False, follows[:-1] & (self.names[1:] == self.names[:-1])] if len(follows) else follows
        head = np.flatnonzero(~same)
        count = np.diff(np.r_[head, len(self.names)])
        last = head + count - 1
        names, said = self.names[head].copy(), self.said[head].copy()
        long_ = np.flatnonzero(count > 1)
        names[long_] = tb.mix(names[long_] + count[long_].astype(np.uint64) * _U(0x9E3779B97F4A7C15))
        more, size = count[long_] - 1, (self.end - self.start)[head[long_]]
        power = tb.powers(2, int(size.max(initial=0)) + 1)[0][size] if len(long_) else np.zeros(0, np.uint64)
        unit = said[long_].copy()
        while len(long_) and more.any():
            on = more > 0
            said[long_[on]] = said[long_[on]] * power[on] + unit[on]
            more = more - on
        return Level(names, said, self.of[head], self.start[head], self.end[last])

    def pairs(self, words: int, turn: int) -> Level:
        """One pass: neighbours under `words` words are joined where their bits say left and right."""
        free = self.end - self.start < words
        left = (tb.mix(self.names + _U(turn * 0x1234567 + 1)) & _U(1)).astype(bool)
        first = self._next() & free & left & np.r_[free[1:] & ~left[1:], False] if len(free) else free
        i = np.flatnonzero(first)
        names, said, end = self.names.copy(), self.said.copy(), self.end.copy()
        names[i] = tb.mix(names[i] * _U(3) + tb.mix(names[i + 1] + _U(77)))
        size = self.end[i + 1] - self.start[i + 1]
        said[i] = said[i] * tb.powers(2, int(size.max(initial=0)) + 1)[0][size] + self.said[i + 1]
        end[i] = self.end[i + 1]
        stay = np.ones(len(names), bool)
        stay[i + 1] = False
        return Level(names[stay], said[stay], self.of[stay], self.start[stay], end[stay])

    def grown(self, words: int, turn: int) -> Level:
        level = self.runs()
        for k in range(ROUNDS):
            level = level.pairs(words, turn * ROUNDS + k)
        return level


def _flat(ids: np.ndarray, *columns: np.ndarray) -> pa.RecordBatch:
    names = ["doc_id", "h1", "h2"]
    return pa.RecordBatch.from_arrays([pa.array(ids), *[pa.array(c.view(np.int64)) for c in columns]], names[: 1 + len(columns)])


def _reveal(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for lo, _, raw, at in tb.chunks(batch.column("text")):
                doc = _Parsed(raw, at, width)
                key, _, last = doc.keys()
                whole = doc.largest()
                own = np.flatnonzero(whole[0])
                if len(key):
                    both = np.unique(np.rec.fromarrays([np.r_[key, whole[0, own], whole[1, own]], np.r_[doc.row[last], own, own]]))
                    yield _flat(ids[lo + both.f1], both.f0)

    return run


_REGION = "doc_id long, text_key long, first int, words array<bigint>, covered int"


def _regions(width: int):
    """Runs of words that lie in windows all of whose keys are shared; of a text that a smaller document has as a whole the number of words (`covered`)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = batch.column("doc_id").to_numpy(), batch.column("text_key").to_numpy()
            shared, copies = batch.column("shared"), batch.column("copies")
            for lo, hi, raw, at in tb.chunks(batch.column("text")):
                doc = _Parsed(raw, at, width)
                key, first, last = doc.keys()
                whole = doc.largest().view(np.int64)
                copied = np.array([len(copies[lo + k]) > 0 and bool(np.isin(whole[:, k], copies[lo + k].values.to_numpy(zero_copy_only=False)).all()) for k in range(hi - lo)], bool)
                k = np.flatnonzero(copied)
                if len(k):
                    yield pa.RecordBatch.from_arrays([pa.array(ids[lo + k]), pa.array(keys[lo + k]), pa.array(np.zeros(len(k), np.int32)), pa.nulls(len(k), pa.list_(pa.int64())), pa.array(np.diff(doc.offsets)[k].astype(np.int32))], ["doc_id", "text_key", "first", "words", "covered"])
                if not len(key):
                    continue
                row = doc.row[last]
                ok = np.zeros(len(key), bool)
                order = np.argsort(row, kind="stable")
                cut = np.searchsorted(row[order], np.arange(hi - lo + 1))
                for k in range(hi - lo):
                    mine = order[cut[k] : cut[k + 1]]
                    if len(mine) and not copied[k]:
                        ok[mine] = np.isin(key[mine], shared[lo + k].values.to_numpy(zero_copy_only=False).view(np.uint64))
                n = len(doc.symbols)
                good = np.bincount(first[ok], minlength=n + 2)[: n + 2] - np.bincount(last[ok] + 1, minlength=n + 2)[: n + 2]
                bad = np.bincount(first[~ok], minlength=n + 2)[: n + 2] - np.bincount(last[~ok] + 1, minlength=n + 2)[: n + 2]
                at_ = np.flatnonzero(doc.real & (np.cumsum(good)[:n] > 0) & (np.cumsum(bad)[:n] == 0))
                if not len(at_):
                    continue
                new = np.r_[True, (at_[1:] >= at_[:-1] + width) | (doc.row[at_[1:]] != doc.row[at_[:-1]])]
                start, end = at_[new], at_[np.r_[new[1:], True]] + width
                rows = []
                for a, b in zip(start.tolist(), end.tolist(), strict=True):  # parts of a long region share the words of one window
                    rows += [(c, min(b, c + REGION_WORDS)) for c in range(a, max(b - width, a) + 1, REGION_WORDS - width + 1)]
                a, b = np.array(rows).T
                of = doc.row[a]
                place = np.arange(int((b - a).sum())) - np.repeat(np.cumsum(b - a) - (b - a), b - a) + np.repeat(a, b - a)
                words = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(b - a)], pa.int32()), pa.array(doc.symbols[place].view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(ids[lo + of]), pa.array(keys[lo + of]), pa.array((a - doc.offsets[of]).astype(np.int32)), words, pa.nulls(len(a), pa.int32())], ["doc_id", "text_key", "first", "words", "covered"])

    return run


_LEVEL = "doc_id long, text_key long, names array<bigint>, said array<bigint>, starts array<int>, ends array<int>"


def _lists(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values))


def _grow(words: int, turn: int):
    """One round over regions (turn 0: their words) or over the symbols of the round before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = batch.column("names" if turn else "words")
            offsets = given.offsets.to_numpy() - given.offsets[0].as_py()
            of = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
            names = given.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            if turn:
                said = batch.column("said").flatten().to_numpy(zero_copy_only=False).view(np.uint64)
                start, end = (batch.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("starts", "ends"))
            else:
                said = tb.mix(names ^ _U(0x5DEECE66D))
                start = np.arange(len(names)) - offsets[of] + batch.column("first").to_numpy()[of]
                end = start + 1
            level = Level(names, said, of, start, end).grown(words, turn)
            cut = np.searchsorted(level.of, np.arange(batch.num_rows + 1))
            columns = [_lists(level.names.view(np.int64), cut), _lists(level.said.view(np.int64), cut), _lists(level.start.astype(np.int32), cut), _lists(level.end.astype(np.int32), cut)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), *columns], ["doc_id", "text_key", "names", "said", "starts", "ends"])

    return run


def covered(regions: DataFrame, width: int) -> DataFrame:
    """doc_id, text_key, start, end: symbols of at least `width` words that a smaller document holds too, found round by round."""
    ids = ["doc_id", "text_key"]
    level, found = regions, None
    for turn, words in enumerate(ROUND_WORDS):
        level = settle(level.mapInArrow(tb.bounded(_grow(words, turn)), _LEVEL), f"round-{turn}")
        each = level.select(*ids, F.explode(F.arrays_zip("names", "said", "starts", "ends")).alias("s")).select(*ids, "s.names", "s.said", "s.starts", "s.ends")
        symbols = settle(each.groupBy("names", "said").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").drop("most"), f"symbols-{turn}")
        held = settle(each.join(symbols, ["names", "said"]), f"held-{turn}")
        own = held.where((F.col("least") < F.col("doc_id")) & (F.col("ends") - F.col("starts") >= width)).select(*ids, F.col("starts").alias("start"), F.col("ends").alias("end"))
        found = own if found is None else found.unionByName(own)
        if turn + 1 < len(ROUND_WORDS):
            s = F.sort_array(F.collect_set(F.struct("starts", "ends", "names", "said")))
            level = held.groupBy(*ids).agg(s.alias("s")).select(*ids, *[F.col(f"s.{c}").alias(c) for c in ("names", "said", "starts", "ends")])
    return found


_WINDOW = "doc_id long, text_key long, start int, h1 long, h2 int"


def _windows(width: int, repeated=None, blocks: int = 0):  # noqa: ANN001
    """Hashes of the windows of a region that lie in none of the given spans; with a filter (broadcast) only of those that it holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys, firsts = (batch.column(c).to_numpy() for c in ("doc_id", "text_key", "first"))
            for i, (words, spans) in enumerate(zip(batch.column("words"), batch.column("spans"), strict=True)):
                symbols = words.values.to_numpy(zero_copy_only=False).view(np.uint64)
                open_ = np.ones(len(symbols) - width + 1, bool)
                if spans.is_valid:
                    a, b = (spans.values.field(c).to_numpy() - firsts[i] for c in ("start", "end"))
                    for x, y in zip(np.maximum(a, 0).tolist(), (b - width + 1).tolist(), strict=True):
                        if y > x:
                            open_[x:y] = False
                one = tb.windows(symbols, width, 1)
                at = np.flatnonzero(open_)
                if repeated is not None and len(at):
                    at = at[bloom.test(repeated.value, bloom.block_of(one[at], blocks), tb.mix(one[at]))]
                if len(at):
                    two = tb.windows(tb.mix(symbols ^ _U(0x5DEECE66D)), width, 2)[at]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), ids[i])), pa.array(np.full(len(at), keys[i])), pa.array((at + firsts[i]).astype(np.int32)), pa.array(one[at].view(np.int64)), pa.array((two >> _U(32)).astype(np.uint32).view(np.int32))], ["doc_id", "text_key", "start", "h1", "h2"])

    return run


def _second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """h1 and its second hash for the filter."""
    for batch in batches:
        h = batch.column("h1").to_numpy().view(np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column("h1"), pa.array(tb.mix(h).view(np.int64))], ["h1", "h2"])


def repeated_windows(regions: DataFrame, symbols: DataFrame, width: int, most_bytes: int = bloom.MOST_BYTES) -> DataFrame:
    """doc_id, text_key, start, end: windows in none of the spans of `symbols` that a smaller document has too."""
    open_ = settle(regions.join(_by_text(symbols), ["doc_id", "text_key"], "left"), "open-regions")
    each = open_.mapInArrow(tb.bounded(_windows(width)), _WINDOW)
    first = settle(each.groupBy("h1", "h2").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").drop("b"), "first-windows")
    blocks = first.count() // bloom.BLOCK_KEYS + 1
    merged = settle(bloom.filter_of(first.select("h1").distinct().mapInArrow(_second, "h1 long, h2 long"), blocks), "repeated-filter")
    if bloom.fits(merged, blocks, most_bytes):
        each = open_.mapInArrow(tb.bounded(_windows(width, regions.sparkSession.sparkContext.broadcast(bloom.packed(merged, blocks)), blocks)), _WINDOW)
    return each.join(first, ["h1", "h2"]).where("doc_id > a").select("doc_id", "text_key", "start", (F.col("start") + width).alias("end"))


def _clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans = batch.column("spans")
        for lo, hi, raw, at in tb.chunks(batch.column("text")):
            starts, ends, offsets = tb.words(raw, at)
            removed = np.zeros(len(starts) + 1, np.int64)
            for k in range(hi - lo):
                if spans[lo + k].is_valid:
                    a, b = (spans[lo + k].values.field(c).to_numpy() + offsets[k] for c in ("start", "end"))
                    np.add.at(removed, a, 1)
                    np.add.at(removed, b, -1)
            gone_word = np.cumsum(removed)[: len(starts)] > 0
            text = raw.tobytes()
            kept, counts = [], []
            for k in range(hi - lo):
                a, b = offsets[k], offsets[k + 1]
                stay = a + np.flatnonzero(~gone_word[a:b])
                kept.append(b" ".join([text[s:e] for s, e in zip(starts[stay].tolist(), ends[stay].tolist(), strict=True)]))
                counts.append((int(b - a), int(b - a - len(stay))))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").slice(lo, hi - lo),
                    pa.array([x for x, _ in counts], pa.int64()),
                    pa.array([x for _, x in counts], pa.int64()),
                    pa.array(kept, pa.binary()).cast(pa.string()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()),
                ],
                ["doc_id", "n_words", "n_removed", "kept", "kept_sha256"],
            )


def _by_text(spans: DataFrame) -> DataFrame:
    return spans.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("start", "end")).alias("spans"))


def remove_repeated_passages(documents: DataFrame, width: int = 50) -> DataFrame:
    """doc_id, n_words, n_removed, kept (words left, joined by one space), kept_sha256 of every document."""
    docs = pick(documents, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("text_key", F.xxhash64("text"))
    known = docs.where("doc_id IS NOT NULL AND text IS NOT NULL")
    keys = settle(known.select("doc_id", "text").mapInArrow(tb.bounded(_reveal(width)), "doc_id long, h1 long"), "symbols")
    common = settle(keys.groupBy("h1").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").drop("b"), "shared-symbols")
    late = F.when((F.col("h1").bitwiseAND(1) == 1) & (F.col("a") < F.col("doc_id")), F.col("h1"))
    shared = settle(keys.join(common, "h1").groupBy("doc_id").agg(F.collect_set("h1").alias("shared"), F.collect_set(late).alias("copies")), "symbols-by-document")
    found = settle(known.join(shared, "doc_id").mapInArrow(tb.bounded(_regions(width)), _REGION), "regions")
    regions = found.where("words IS NOT NULL").drop("covered")
    whole = found.where("covered IS NOT NULL").select("doc_id", "text_key", F.lit(0).alias("start"), F.col("covered").alias("end"))
    symbols = settle(covered(regions, width).unionByName(whole), "repeated-symbols")
    gone = settle(_by_text(symbols.unionByName(repeated_windows(regions, symbols, width))), "repeated-spans")
    return docs.join(gone, ["doc_id", "text_key"], "left").mapInArrow(tb.bounded(_clean), "doc_id long, n_words long, n_removed long, kept string, kept_sha256 string")

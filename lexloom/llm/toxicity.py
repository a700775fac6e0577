"""Toxicity by a subsequence string kernel, Nyström landmarks and a support vector machine.

A text is read as sentences of symbols: letters and digits in lower case, one boundary symbol for white space; other marks
are left out, so `id-iot` reads as `idiot`.  The kernel counts common subsequences of LENGTH symbols, gaps allowed: each
occurrence inside SPAN symbols weighs GAP to the number of symbols it skips, so a spaced word or one with inserted
characters still shares most subsequences with the plain one.  An instance is a segment of a sentence, WIDTH consecutive
starts of subsequences.  The decisions of a text's TOP most suspicious segments, none within WIDTH starts of another, give
its score by a logistic curve: one strong insult is enough, so are several that could each be a chance resemblance.

Learning: labels are of whole texts, so not all segments of a toxic text are toxic.  Those around its runs of symbols that
few clean texts have (log odds over the sample) are taken, SEGMENTS of a text, again with an inserted symbol, and half of
them spaced; clean texts give segments at random.  LANDMARKS segments are chosen, each the farthest in the kernel from those
before it; a segment's kernel values with them, times the inverse root of their own kernel matrix, are its Nyström
features, on which a linear machine with squared hinge loss is fitted.  ROUNDS times the machine scores all sentences of the
clean texts, and their most suspicious segments join the clean ones.  The curve is fitted on the sample's texts, toxic ones also as if their
strongest segment were their only one (with weight ALONE).

Predicting: the decision is a sum over landmarks, each a sum over hashed subsequences, so the weights of all landmarks fold
into one weight for each of 2^BITS subsequence buckets.  That is the same value, and a text takes time in proportion to its
length.  Long texts are read whole, piece by piece (PIECE characters, cut at white space, overlapping).

The sample has at most SAMPLE_TOXIC and SAMPLE_CLEAN texts of at most SAMPLE_CHARS characters, drawn by a hash of doc_id.
Null and empty texts, and texts without letters or digits, have the score of no evidence.  A doc_id with both labels is not
learned from; null ids and labels are neither.  Without texts of both labels every score is the sample's share of toxic texts
(0 for none).  Repeated rows are scored each time; columns beside those named are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.llm import textblocks as tb
from lexloom.llm.shared import pick

SAMPLE_TOXIC, SAMPLE_CLEAN, SAMPLE_CHARS = 800, 1600, 10_000
LENGTH, SPAN, GAP, WIDTH, BITS = 5, 8, 0.7, 6, 18
LANDMARKS, ROUNDS, SEGMENTS, COST, TOP, ALONE = 384, 3, 3, 10.0, 3, 0.2
PAD = max(WIDTH, SPAN)  # zeros between two sentences: no subsequence or segment reaches over them
PIECE, OVERLAP, CHUNK_BYTES, BLOCK = 1 << 18, 64, 1 << 18, 1 << 15
_U = np.uint64
_EDGE = 1  # the boundary symbol; 0 is padding between sentences
_ODD = np.array([(0x9E3779B97F4A7C15 * (2 * k + 3) ** 5) & ((1 << 64) - 1) for k in range(LENGTH)], _U) | _U(1)


@cache
def _kinds() -> np.ndarray:
    """Of each code point: 1 letter or digit, 2 white space, 3 end mark, 0 else."""
    kind = np.array([1 if c.isalnum() else 2 if c.isspace() else 0 for c in map(chr, range(0x110000))], np.uint8)
    kind[[ord(c) for c in ".!?…。！？"]] = 3
    return kind


def symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all texts (each sentence between two boundaries, PAD zeros between sentences) and the offset of each text's."""
    low = [t.lower() for t in texts]
    code = np.frombuffer(("\n" + "\n".join(low) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = _kinds()[code]
    ends = (code == 10) | ((kind == 3) & np.r_[kind[1:] == 2, True])
    held = np.flatnonzero((kind == 1) | (kind == 2) | ends)
    solid, ends = kind[held] == 1, ends[held]
    first = np.flatnonzero(solid | np.r_[True, solid[:-1]])  # one item for each run of separators
    ends = np.maximum.reduceat(ends, first)
    solid = solid[first]
    size = np.where(solid, 1, np.where(ends, PAD + 2, 1))
    at = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint32)
    out[at] = np.where(solid, code[held[first]] + 2, _EDGE)
    out[(at + size)[~solid & ends] - 1] = _EDGE
    # a text's symbols begin at the separator before it
    begin = np.cumsum([1, *[len(t) + 1 for t in low]])[:-1] - 1
    return out, at[np.searchsorted(held[first], begin, "right") - 1]


def _spread(x: np.ndarray, m: int, found: Callable[[int, np.ndarray], None]) -> None:
    """Call found(skipped, bucket) for every choice of places: bucket of the subsequence from each of the first m starts (last axis)."""
    part = [x * c for c in _ODD]
    _longer(part, m, 1, 0, part[0][..., :m], found)


def _longer(part: list[np.ndarray], m: int, k: int, last: int, h: np.ndarray, found: Callable[[int, np.ndarray], None]) -> None:
    """h: hash of the first k symbols, the last of them at place `last`."""
    for at in range(last + 1, SPAN - (LENGTH - 1 - k)):
        here = h + part[k][..., at : at + m]
        if k == LENGTH - 1:
            found(at + 1 - LENGTH, (here >> _U(64 - BITS)).view(np.int64))
        else:
            _longer(part, m, k + 1, at, here, found)


def evidence(sym: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Sum of the weights of the subsequences of the segment from each start; 0 between sentences.  Scratch is that of a block."""
    value = np.zeros(len(sym), np.float32)
    for a in range(0, len(sym), BLOCK):
        m = min(BLOCK, len(sym) - a)
        x = np.zeros(m + WIDTH + SPAN - 1, _U)
        part = sym[a : a + len(x)]
        x[: len(part)] = part
        starts = m + WIDTH
        sums = np.zeros((SPAN - LENGTH + 1, starts), np.float32)
        _spread(x, starts, lambda skipped, bucket, sums=sums: np.add(sums[skipped], table.take(bucket, mode="clip"), out=sums[skipped]))
        total = np.zeros(starts + 1)
        for skipped in range(len(sums)):
            reach = LENGTH - 1 + skipped
            total[1:] += GAP**skipped * sums[skipped] * (x[reach : reach + starts] > 0)
        total[1:] *= x[:starts] > 0
        np.cumsum(total, out=total)
        value[a : a + m] = (total[WIDTH : WIDTH + m] - total[:m]) * (x[:m] > 0)
    return value


def segment_features(segments: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and weights of the subsequences of segments (rows of WIDTH + SPAN - 1 symbols)."""
    x = segments.astype(_U)
    ways = math.comb(SPAN - 1, LENGTH - 1)
    buckets, weights = np.empty((len(x), ways * WIDTH), np.int32), np.empty((len(x), ways * WIDTH), np.float32)
    at = iter(range(0, ways * WIDTH, WIDTH))

    def found(skipped: int, bucket: np.ndarray) -> None:
        reach, here = LENGTH - 1 + skipped, next(at)
        buckets[:, here : here + WIDTH] = bucket
        weights[:, here : here + WIDTH] = GAP**skipped * ((x[:, reach : reach + WIDTH] > 0) & (x[:, :WIDTH] > 0))

    _spread(x, WIDTH, found)
    return buckets, weights


def kernel(features: tuple[np.ndarray, np.ndarray], landmark: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Kernel values of all segments with one."""
    dense = np.zeros(1 << BITS, np.float32)
    np.add.at(dense, landmark[0], landmark[1])
    out = np.empty(len(features[0]))
    for k in range(0, len(out), 1024):
        out[k : k + 1024] = np.einsum("ij,ij->i", dense.take(features[0][k : k + 1024]), features[1][k : k + 1024])
    return out


def _landmarks(features: tuple[np.ndarray, np.ndarray], norms: np.ndarray, n: int) -> list[int]:
    """Up to n segments, each the farthest from those chosen before it (cosine of the kernel)."""
    if not len(norms) or norms.max() <= 0:
        return []
    chosen, near = [int(norms.argmax())], np.where(norms > 0, -1.0, np.inf)
    while True:
        last = chosen[-1]
        near = np.maximum(near, kernel(features, (features[0][last], features[1][last])) / np.maximum(norms * norms[last], 1e-12))
        nxt = int(near.argmin())
        if len(chosen) == n or near[nxt] > 0.98:
            return chosen
        chosen.append(nxt)


def squared_hinge(x: np.ndarray, y: np.ndarray, cost: float) -> np.ndarray:
    """Weights (the last one is the bias) that minimise |w|^2 / 2 + cost * sum of max(0, 1 - y f)^2, by Newton steps."""
    ridge = np.eye(x.shape[1] + 1)
    ridge[-1, -1] = 1e-6
    w = np.zeros(len(ridge))
    blocks = [slice(k, k + 2048) for k in range(0, len(x), 2048)]
    lost = lambda w: np.maximum(0, 1 - y * (x @ w[:-1].astype(x.dtype) + w[-1]))
    loss = lambda w: w @ ridge @ w / 2 + cost * (lost(w) ** 2).sum()
    for _ in range(30):
        inside = lost(w) > 0
        curve, pull = ridge.copy(), np.zeros(len(w))
        for k in blocks:
            part = np.c_[x[k][inside[k]].astype(float), np.ones(inside[k].sum())]
            curve += 2 * cost * part.T @ part
            pull += 2 * cost * part.T @ y[k][inside[k]]
        step = np.linalg.solve(curve, pull) - w
        scale, now = 1.0, loss(w)
        while scale > 1e-4 and loss(w + scale * step) > now:
            scale /= 2
        w = w + scale * step
        if np.abs(scale * step).max() < 1e-5:
            break
    return w


def top_segments(value: np.ndarray, at: np.ndarray, least: float) -> np.ndarray:
    """The TOP largest values of each text that are the largest within WIDTH places on either side (the first of equal ones); `least` where there are fewer above it."""
    edge = np.full(WIDTH, -np.inf)
    padded = np.r_[edge, value, edge]
    before, after = np.full(len(value), -np.inf), np.full(len(value), -np.inf)
    for k in range(1, WIDTH + 1):
        np.maximum(before, padded[WIDTH - k : WIDTH - k + len(value)], out=before)
        np.maximum(after, padded[WIDTH + k : WIDTH + k + len(value)], out=after)
    peak = np.flatnonzero((value > least) & (value > before) & (value >= after))
    text = np.searchsorted(at, peak, "right") - 1
    order = np.lexsort((-value[peak], text))
    peak, text = peak[order], text[order]
    rank = np.arange(len(peak)) - np.searchsorted(text, text)
    out = np.full((len(at), TOP), least)
    some = rank < TOP
    out[text[some], rank[some]] = value[peak[some]]
    return out


@dataclass
class Model:
    table: np.ndarray | None  # weight of each bucket; None: too little was learned from
    bias: float
    curve: np.ndarray | None = None  # weights of the decisions of a text's top segments, and a constant

    def decisions(self, sym: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Decisions of the top segments of each text, inside [-2, 4]."""
        return np.clip(top_segments(evidence(sym, self.table), at, -2.0 - self.bias) + self.bias, -2, 4)

    def scores(self, texts: list[str]) -> np.ndarray:
        if self.table is None or not texts:
            return np.full(len(texts), self.bias)
        return self.curved(self.decisions(*symbols(texts)))

    def curved(self, decisions: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(decisions @ self.curve[:-1] + self.curve[-1], -500, 500)))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weights, a constant at the end, by Newton steps on the penalised likelihood."""
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (weight * (y - p)) - ridge * w)
        w = w + step * min(1.0, 2.0 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-6:
            break
    return w


def _segments(sym: np.ndarray, at: np.ndarray) -> np.ndarray:
    padded = np.r_[sym, np.zeros(WIDTH + SPAN, sym.dtype)]
    out = padded[at[:, None] + np.arange(WIDTH + SPAN - 1)]
    # nothing behind the end of the sentence
    return np.where(np.minimum.accumulate(out > 0, axis=1), out, 0)


def _sentences(sym: np.ndarray, begin: int, end: int) -> np.ndarray:
    """Starts of the sentences of a text."""
    return begin + np.flatnonzero((sym[begin:end] > 0) & np.r_[True, sym[begin : end - 1] == 0])


def _telling_runs(sym: np.ndarray, texts: list[tuple[int, int]], toxic: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Starts of runs of LENGTH symbols in toxic texts that few clean texts have: up to SEGMENTS of each toxic text, by chance, and the most telling one at least."""

    def runs(a: int, b: int) -> np.ndarray:
        x = np.r_[sym[a : b + LENGTH - 1], np.zeros(max(0, b + LENGTH - 1 - len(sym)), sym.dtype)].astype(_U)
        return sum(x[k : k + b - a] * _ODD[k] for k in range(LENGTH))

    kinds = {t: np.unique(np.concatenate([np.unique(runs(a, b)) for (a, b), y in zip(texts, toxic, strict=True) if y == t]), return_counts=True) for t in (True, False)}
    names, count = kinds[True]
    other = np.minimum(np.searchsorted(kinds[False][0], names), len(kinds[False][0]) - 1)
    clean = np.where(kinds[False][0][other] == names, kinds[False][1][other], 0)
    odds = np.log((count + 0.5) / (clean + 0.5) * ((~toxic).sum() + 1) / (toxic.sum() + 1)) * np.sqrt(count)
    usual = 2 * np.log(2 + toxic.sum())
    out: list[int] = []
    for (a, b), y in zip(texts, toxic, strict=True):
        if y:
            value = odds[np.searchsorted(names, runs(a, b))]
            found = _peaks(value, max(usual, 0.3 * float(value.max()))) or [int(value.argmax())]
            out += [a + p for p in rng.permutation(found)[:SEGMENTS].tolist()]
    return np.array(out)


def _peaks(value: np.ndarray, least: float) -> list[int]:
    """Places with a value above `least` that is the largest within WIDTH places on either side (the first of equal ones)."""
    out: list[int] = []
    for p in np.flatnonzero(value > least).tolist():
        if out and p - out[-1] < WIDTH:
            if value[p] > value[out[-1]]:
                out[-1] = p
        else:
            out.append(p)
    return out


def _disturbed(segments: np.ndarray, rng: np.random.Generator, spaced: bool) -> np.ndarray:
    """Copies with a symbol of the segments put in at one place, or with boundaries between the symbols of a run."""
    out = np.zeros_like(segments)
    letters = segments[segments > _EDGE]
    for i, row in enumerate(segments):
        if spaced:
            at = int(rng.integers(1, 4))
            new = np.r_[row[:at], np.c_[row[at:], np.full(len(row) - at, _EDGE, row.dtype)].ravel()]
        else:
            at = int(rng.integers(2, WIDTH - 2))
            new = np.r_[row[:at], rng.choice(letters), row[at:]]
        out[i] = new[: len(row)]
    return np.where(np.minimum.accumulate(out > 0, axis=1), out, 0)


def _norms(features: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Root of each segment's kernel with itself."""
    out = []
    for k in range(0, len(features[0]), 1024):
        bucket, weight = features[0][k : k + 1024], features[1][k : k + 1024]
        order = np.argsort(bucket, axis=1)
        bucket, weight = np.take_along_axis(bucket, order, 1), np.take_along_axis(weight, order, 1)
        new = np.c_[np.ones(len(bucket), bool), bucket[:, 1:] != bucket[:, :-1]].ravel()
        sums = np.add.reduceat(weight.ravel().astype(float), np.flatnonzero(new))
        out.append(np.bincount(np.repeat(np.arange(len(bucket)), bucket.shape[1])[new], sums**2, len(bucket)))
    return np.sqrt(np.concatenate(out))


def _nystroem_machine(features: tuple[np.ndarray, np.ndarray], label: np.ndarray, norms: np.ndarray, chosen: np.ndarray) -> Model:
    """Squared-hinge machine on the Nyström features of the chosen landmarks, folded into bucket weights."""
    values = np.empty((len(label), len(chosen)), np.float32)
    for j, c in enumerate(chosen.tolist()):
        values[:, j] = kernel(features, (features[0][c], features[1][c])) / norms[c]
    own = values[chosen] / norms[chosen][:, None]
    e, v = np.linalg.eigh((own + own.T) / 2)
    some = e > 1e-6 * e.max()
    root = v[:, some] / np.sqrt(e[some])
    w = squared_hinge(values @ root.astype(np.float32), label, COST)
    table = np.zeros(1 << BITS, np.float64)
    for a, c in zip(root @ w[:-1], chosen, strict=True):
        np.add.at(table, features[0][c], a / norms[c] * features[1][c])
    return Model(table.astype(np.float32), float(w[-1]))


def fit(texts: list[str], toxic: list[bool]) -> Model:
    y = np.array(toxic, bool)
    if not y.any() or y.all():
        return Model(None, float(y.mean()) if len(y) else 0.0)
    rng = np.random.default_rng(11)
    parts = [symbols(texts[k : k + 100]) for k in range(0, len(texts), 100)]
    sizes = np.cumsum([0] + [len(p) for p, _ in parts])
    sym, at = np.concatenate([p for p, _ in parts]), np.concatenate([o + size for (_, o), size in zip(parts, sizes[:-1], strict=True)])
    spans = list(zip(at.tolist(), [*at[1:].tolist(), len(sym)], strict=True))
    start = lambda p: p - int(np.argmin(np.r_[sym[max(p - 2, 0) : p][::-1] > _EDGE, False]))  # noqa: E731  (two symbols earlier, inside the word)
    good = np.array([start(p) for p in _telling_runs(sym, spans, y, rng)])
    bad = np.concatenate([rng.choice(np.r_[a, a + np.flatnonzero(sym[a:b])], SEGMENTS) for (a, b), t in zip(spans, y, strict=True) if not t])
    mined = np.zeros(0, np.int64)
    positive = _segments(sym, good)
    positive = np.concatenate([positive, _disturbed(positive, rng, False), _disturbed(positive[::2], rng, True)])
    for _ in range(ROUNDS):
        segments = np.concatenate([positive, _segments(sym, np.r_[mined, bad])])
        features = segment_features(segments)
        norms = _norms(features)
        kind = np.repeat([0, 1, 2], [len(positive), len(mined), len(bad)])
        chosen = np.concatenate([np.flatnonzero(kind == k)[_landmarks((features[0][kind == k], features[1][kind == k]), norms[kind == k], n)] for k, n in ((0, LANDMARKS // 2), (1, LANDMARKS // 4), (2, LANDMARKS // 4)) if (norms[kind == k] > 0).any()] or [np.zeros(0, int)])
        if not len(chosen):
            return Model(None, float(y.mean()))
        model = _nystroem_machine(features, np.where(kind == 0, 1.0, -1.0), norms, chosen)
        value = evidence(sym, model.table)
        worst = []
        for (a, b), t in zip(spans, y, strict=True):
            if not t:
                peaks = [a + p for p in _peaks(value[a:b], -model.bias - 0.5)]
                worst += sorted(peaks, key=lambda p: -value[p])[:SEGMENTS]
        mined = np.unique(np.r_[mined, worst].astype(np.int64))
    found = np.concatenate([model.decisions(*p) for p in parts])
    alone = found[y]
    alone[:, 1:] = np.median(found[~y][:, 1:], axis=0)  # the same toxic texts with their strongest segment only
    model.curve = logistic(np.concatenate([found, alone]), np.r_[y, np.ones(len(alone))], np.r_[np.ones(len(y)), np.full(len(alone), ALONE)])
    return model


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(5)) == 0, F.lit(False))


def train(documents: DataFrame, labels: DataFrame, toxic_docs: int = SAMPLE_TOXIC, clean_docs: int = SAMPLE_CLEAN, chars: int = SAMPLE_CHARS) -> Model:
    """Fit on a sample of the labelled rows that are not held out.  Texts stay where they are: ids are drawn first."""
    known = pick(labels, "doc_id", "toxic").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IN (0, 1)")
    known = known.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most")).where("toxic = most").drop("most")
    docs = pick(documents, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.length("text") <= chars)
    texts, marks = [], []
    for toxic, n in ((1, toxic_docs), (0, clean_docs)):
        drawn = known.where(F.col("toxic") == toxic).orderBy(F.xxhash64("doc_id"), "doc_id").select("doc_id").limit(2 * n)  # some have long texts or none
        order = [F.xxhash64("doc_id"), F.col("doc_id"), F.xxhash64("text")]
        found = [r["text"] for r in docs.join(F.broadcast(drawn), "doc_id").orderBy(*order).limit(n).collect()]  # n texts of `chars` characters at most
        texts += found
        marks += [bool(toxic)] * len(found)
    return fit(texts, marks)


def _pieces(text: str) -> list[str]:
    """The whole text in overlapping pieces cut at white space."""
    out, a = [], 0
    while len(text) - a > PIECE:
        cut = max(text.rfind(" ", a + PIECE // 2, a + PIECE), text.rfind("\n", a + PIECE // 2, a + PIECE))
        cut = cut if cut > 0 else a + PIECE
        out.append(text[a:cut])
        near = max(text.rfind(" ", cut - 2 * OVERLAP, cut - OVERLAP), text.rfind("\n", cut - 2 * OVERLAP, cut - OVERLAP))
        a = near if near > 0 else cut - OVERLAP
    return [*out, text[a:]]


def _predict(model: Model) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column("text")
            for lo, hi, raw, _ in tb.chunks(text, CHUNK_BYTES):
                some = [t or "" for t in text.slice(lo, hi - lo).to_pylist()]
                score = model.scores(some) if len(raw) <= 4 * PIECE else np.array([max(float(model.scores([p])[0]) for p in _pieces(t)) for t in some])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(lo, hi - lo), batch.column("held_out").slice(lo, hi - lo), pa.array(score), pa.array((score >= 0.5).astype(np.int32))],
                    ["doc_id", "held_out", "score", "predicted"],
                )

    return run


def toxicity(documents: DataFrame, labels: DataFrame | None = None, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; labels (doc_id, toxic) are needed where no model is given."""
    model = model or train(documents, labels)
    docs = pick(documents, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long")).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return docs.mapInArrow(tb.bounded(_predict(model)), "doc_id long, held_out boolean, score double, predicted int")

"""Language identification by a linear-chain conditional random field over the words of a text.

Every word has hashed features: itself (lexicon), its first and last four bytes (affixes) and its byte bigrams and
trigrams with word ends.  Feature weights and label transitions are learned together by gradient steps on the
likelihood, with forward-backward sums.  A text is labelled word by word (so code-switched text is seen as such); the
language of the text is the label with the largest mean posterior over its words with letters, which is the score.

Chains are cut into segments: the products of the segments' transfer matrices are chained first and the segments are
then filled in all at once, which is exact and needs few numpy steps even for very long texts.

The model is fitted on a bounded sample: at most SAMPLE_DOCS labelled texts of a language, drawn by a hash of doc_id from
those of at most SAMPLE_CHARS characters.  Null text or text without a letter: `und`, score 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.llm import textblocks as tb
from lexloom.llm.shared import fresh, pick

SAMPLE_DOCS, SAMPLE_CHARS = 150, 20_000
BUCKETS, SEGMENT, STEPS, RATE, DECAY = 1 << 16, 64, 12, 0.5, 1e-4
#: Bytes of text labelled together; a word's features take some 80 bytes for each of its own.
PREDICT_BYTES = 3 << 17
_U = np.uint64


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray  # (BUCKETS, labels)
    moves: np.ndarray  # (labels, labels), log scale


@dataclass
class _Words:
    """Distinct words of a chunk with their features, and the words of each text as indices into them."""

    of: np.ndarray
    offsets: np.ndarray
    letters: np.ndarray  # of each distinct word: it has a letter
    single: list[np.ndarray]  # one bucket a word: lexicon, first bytes, last bytes
    grams: np.ndarray  # buckets of n-grams, word after word
    cuts: np.ndarray

    def scores(self, weights: np.ndarray) -> np.ndarray:
        out = sum(weights[b] for b in self.single)
        return out + np.add.reduceat(weights[self.grams], self.cuts, axis=0) if len(self.cuts) else out

    def gradient(self, delta: np.ndarray) -> np.ndarray:
        """delta: (distinct words, labels); summed into the buckets."""
        word = np.repeat(np.arange(len(self.cuts)), np.diff(np.r_[self.cuts, len(self.grams)]))
        out = np.empty((BUCKETS, delta.shape[1]))
        for k in range(delta.shape[1]):
            out[:, k] = np.bincount(self.grams, delta[word, k], BUCKETS) + sum(np.bincount(b, delta[:, k], BUCKETS) for b in self.single)
        return out


def _bucket(x: np.ndarray, kind: int) -> np.ndarray:
    return (tb.mix(x.astype(np.uint64) * _U(8) + _U(kind)) & _U(BUCKETS - 1)).astype(np.int64)


def word_features(raw: np.ndarray, at: np.ndarray) -> _Words:
    low = tb.LOWER[raw]
    starts, ends, offsets = tb.words(low, at)
    key = tb.span_hashes(low, starts, ends)
    for i in np.flatnonzero(ends - starts > tb.LONG_WORD):
        key[i] = tb.digest(low[starts[i] : ends[i]].tobytes())
    names, first, of = np.unique(key, return_index=True, return_inverse=True)
    start, size = starts[first], (ends - starts)[first]
    n = len(first)
    if n == 0:
        return _Words(of, offsets, np.zeros(0, bool), [np.zeros(0, np.int64)] * 3, np.zeros(0, np.int64), np.zeros(0, np.int64))
    # words one after another, a space before each and one behind the last
    cuts = np.r_[0, np.cumsum(size[:-1] + 1)]
    flat = np.full(int(size.sum()) + n + 2, 32, np.uint8)
    flat[np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(cuts + 1, size)] = low[np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(start, size)]
    x = flat.astype(np.uint64)
    m = int(size.sum()) + n
    two = _bucket(x[:m] | (x[1 : m + 1] << _U(8)), 1)
    three = _bucket(np.where(x[1 : m + 1] == 32, x[:m], x[:m] | (x[1 : m + 1] << _U(8)) | (x[2 : m + 2] << _U(16))), 2)
    grams = np.stack([two, three], axis=1).ravel()
    ends4 = cuts + 1 + size
    take = lambda begin: sum(x[np.clip(begin + j, 0, len(x) - 1)] << _U(8 * j) for j in range(4))
    letter = ((flat >= 97) & (flat <= 122)) | (flat >= 128)
    has = np.add.reduceat(letter[:m].astype(np.int64), cuts) > 0
    return _Words(of, offsets, has, [_bucket(names, 3), _bucket(take(cuts + 1) + size.astype(np.uint64) * 0, 4), _bucket(take(ends4 - np.minimum(size, 4)), 5)], grams, 2 * cuts)


def forward_backward(emit: np.ndarray, offsets: np.ndarray, moves: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Posteriors of the labels of all words (emit: log scores, texts one after another), and the expected moves."""
    n, k = emit.shape
    count = np.diff(offsets)
    blocks = -(-count // SEGMENT)
    head = np.r_[0, np.cumsum(blocks)]
    seg_text = np.repeat(np.arange(len(count)), blocks)
    order = np.arange(len(seg_text)) - head[seg_text]
    place = offsets[seg_text][:, None] + order[:, None] * SEGMENT + np.arange(SEGMENT)
    live = place < offsets[seg_text + 1][:, None]
    p = np.where(live[:, :, None], np.exp(emit - emit.max(axis=1, keepdims=True))[np.minimum(place, max(n - 1, 0))], 1.0)
    a = np.exp(moves)
    eye = np.eye(k)
    whole = np.broadcast_to(eye, (len(seg_text), k, k)).copy()
    for t in range(SEGMENT):
        step = whole @ (a * p[:, t, None, :])
        whole = np.where(live[:, t, None, None], step / step.max(axis=(1, 2), keepdims=True), whole)
    ahead, behind = np.ones((len(seg_text), k)), np.ones((len(seg_text), k))
    now = np.ones((len(count), k))
    for j in range(int(blocks.max()) if len(blocks) else 0):
        some = np.flatnonzero(blocks > j)
        s = head[some] + j
        ahead[s] = now[some]
        new = np.einsum("ni,nij->nj", now[some], whole[s])
        now[some] = new / new.sum(axis=1, keepdims=True)
    now = np.ones((len(count), k))
    for j in range(int(blocks.max()) - 1 if len(blocks) else -1, -1, -1):
        some = np.flatnonzero(blocks > j)
        s = head[some] + j
        behind[s] = now[some]
        new = np.einsum("nij,nj->ni", whole[s], now[some])
        now[some] = new / new.sum(axis=1, keepdims=True)
    alpha = np.empty_like(p)
    x = ahead
    for t in range(SEGMENT):
        new = (x @ a) * p[:, t]
        x = np.where(live[:, t, None], new / new.sum(axis=1, keepdims=True), x)
        alpha[:, t] = x
    y = behind
    moved = np.zeros((k, k)) if pairs else None
    gamma = np.empty_like(p)
    for t in range(SEGMENT - 1, -1, -1):
        g = alpha[:, t] * y
        gamma[:, t] = g / g.sum(axis=1, keepdims=True)
        back = p[:, t] * y
        if pairs:
            before = alpha[:, t - 1] if t else ahead
            both = before[:, :, None] * a * back[:, None, :]
            both /= both.sum(axis=(1, 2), keepdims=True)
            real = live[:, t] & ((order > 0) | (t > 0))
            moved += both[real].sum(axis=0)
        y = np.where(live[:, t, None], back @ a.T, y)
        y /= y.sum(axis=1, keepdims=True)
    out = np.empty((n, k))
    out[place[live]] = gamma[live]
    return out, moved


def fit(texts: list[str], languages: list[str]) -> Model:
    labels = sorted(set(languages))
    k = len(labels)
    model = Model(labels, np.zeros((BUCKETS, k)), np.zeros((k, k)))
    raw, at = tb.utf8(pa.array(texts, pa.string()))
    w = word_features(raw, at)
    if k < 2 or not len(w.of):
        return model
    count = np.diff(w.offsets)
    gold = np.repeat([labels.index(x) for x in languages], count)
    target = np.zeros((len(w.letters), k))
    np.add.at(target, (w.of, gold), 1)
    kept = np.diag(np.bincount(gold, minlength=k) - np.bincount([labels.index(x) for x, c in zip(languages, count, strict=True) if c], minlength=k)).astype(float)
    seen, seen_moves = np.full((BUCKETS, k), 1e-6), np.full((k, k), 1e-6)
    for _ in range(STEPS):
        posterior, moved = forward_backward(w.scores(model.weights)[w.of], w.offsets, model.moves, pairs=True)
        delta = target - np.stack([np.bincount(w.of, posterior[:, j], len(w.letters)) for j in range(k)], axis=1)
        grad = w.gradient(delta) / len(w.of) - DECAY * model.weights
        seen += grad**2
        model.weights += RATE * grad / np.sqrt(seen)
        grad = (kept - moved) / len(w.of) - DECAY * model.moves
        seen_moves += grad**2
        model.moves += RATE * grad / np.sqrt(seen_moves)
    return model


def _predict(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(model.labels)
        for batch in batches:
            lettered = batch.column("lettered").to_numpy(zero_copy_only=False)
            for lo, hi, raw, at in tb.chunks(batch.column("text"), PREDICT_BYTES):
                w = word_features(raw, at)
                names, scores, words = ["und"] * (hi - lo), [0.0] * (hi - lo), [[0] * k] * (hi - lo)
                if k and len(w.of):
                    posterior, _ = forward_backward(w.scores(model.weights)[w.of], w.offsets, model.moves)
                    posterior *= w.letters[w.of][:, None]
                    sums = np.r_[np.zeros((1, k)), np.cumsum(posterior, axis=0)]
                    sums = sums[w.offsets[1:]] - sums[w.offsets[:-1]]
                    best = np.eye(k, dtype=np.int64)[posterior.argmax(axis=1)] * w.letters[w.of][:, None]
                    counts = np.r_[np.zeros((1, k), np.int64), np.cumsum(best, axis=0)]
                    counts = counts[w.offsets[1:]] - counts[w.offsets[:-1]]
                    total = sums.sum(axis=1)
                    for i in np.flatnonzero(total > 0):
                        if lettered[lo + i]:
                            j = int(sums[i].argmax())
                            names[i], scores[i], words[i] = model.labels[j], float(min(1.0, sums[i, j] / total[i])), counts[i].tolist()
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(lo, hi - lo), batch.column("held_out").slice(lo, hi - lo), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(words, pa.list_(pa.int64()))],
                    ["doc_id", "held_out", "lang_pred", "score", "words_by_label"],
                )

    return run


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) == 2, F.lit(False))


def train(labelled: DataFrame, docs_per_language: int = SAMPLE_DOCS, chars: int = SAMPLE_CHARS) -> Model:
    """Fit on the sample; labelled: doc_id, text, lang, none null."""
    rows = labelled.where(F.length("text") <= chars)
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row a language
    share = F.lit(0.0)
    for lang, n in counts.items():
        share = F.when(F.col("lang") == lang, min(1.0, 1.3 * docs_per_language / n)).otherwise(share)
    drawn = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(7)), F.lit(1 << 20))
    sample = rows.withColumn("drawn", drawn).where(F.col("drawn") < share * (1 << 20)).select("drawn", "doc_id", "lang", "text")
    sample = sample.orderBy("drawn", "doc_id", "text").limit(2 * docs_per_language * len(counts)).collect()  # bounded also where one id has many rows
    used: dict[str, int] = {}
    texts, languages = [], []
    for r in sample:
        if used.get(r["lang"], 0) < docs_per_language:
            used[r["lang"]] = used.get(r["lang"], 0) + 1
            texts.append(r["text"])
            languages.append(r["lang"])
    return fit(texts, languages)


def identify(documents: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, words_by_label (words of each label in the model's order) of every document."""
    docs = pick(documents, "doc_id", "text", "lang").withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("held_out", held_out(F.col("doc_id")))
    if model is None:
        model = train(docs.where("doc_id IS NOT NULL AND text IS NOT NULL AND lang IS NOT NULL AND NOT held_out"))
    asked = docs.select("doc_id", "held_out", "text", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("lettered"))
    return asked.mapInArrow(tb.bounded(_predict(model)), "doc_id long, held_out boolean, lang_pred string, score double, words_by_label array<bigint>")


def _keep(model: Model, least: float, lettered: str):
    predict = _predict(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked = pa.RecordBatch.from_arrays(
                [pa.array(range(batch.num_rows), pa.int64()), pa.array([False] * batch.num_rows), batch.column("text"), batch.column(lettered)], ["doc_id", "held_out", "text", "lettered"]
            )
            good = np.concatenate([np.zeros(0, bool)] + [(np.array(b.column("lang_pred").to_pylist(), object) != "und") & (b.column("score").to_numpy() >= least) for b in predict(iter([asked]))])
            yield batch.drop_columns([lettered]).filter(pa.array(good.astype(bool)))

    return run


def keep_identified(documents: DataFrame, least: float = 0.4) -> DataFrame:
    """The rows whose language is found with a score of `least` or more, all columns as they are; no row is moved."""
    known = pick(documents, "doc_id", "text", "lang").withColumn("doc_id", F.col("doc_id").cast("long"))
    model = train(known.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id"))))
    name = fresh(documents, "lettered")
    return documents.withColumn(name, F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))).mapInArrow(tb.bounded(_keep(model, least, name)), documents.schema)

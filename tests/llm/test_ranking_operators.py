"""Toxicity, lexical search and whitening against brute force."""

import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexloom.llm import lexical_search, toxicity, whitening

DOCS = "doc_id long, text string, tf string"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def _terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def _ranked(docs, items, k):
    split = [(i, _terms(t)) for i, t in docs if i is not None]
    split = [(i, ts) for i, ts in split if ts]
    n, total = len(split), sum(len(ts) for _, ts in split)
    out = []
    for item, text in set(items):
        if item is None:
            continue
        scored = []
        for i, ts in split:
            m = 100 - 25 + (25 * len(ts) * n) // total
            score = 0
            for t in _terms(text):
                df, tf = sum(t in other for _, other in split), ts.count(t)
                score += math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1))) * ((10**9 * tf) // (1000 * tf + 12 * m))
            if score > 0:
                scored.append((-score, i))
        out += [(item, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scored)[:k])]
    return sorted(out)


@pytest.mark.parametrize(("buffer", "cells"), [(1 << 24, 1 << 22), (200, 60)])
def test_lexical_search_against_brute_force(spark, monkeypatch, buffer, cells):
    monkeypatch.setattr(lexical_search, "BUFFER_BYTES", buffer)
    monkeypatch.setattr(lexical_search, "TURN_CELLS", cells)
    rng = random.Random(7)
    words = ["alpha", "Beta", "gamma", "été", "ÉTÉ", "x", "naïve-ly", "9", "x9", "東京"]
    docs = [(i, " ".join(rng.choices(words, weights=range(1, 11), k=rng.choice([1, 3, 3, 9, 40])))) for i in range(70)]
    docs += [(70 + i, "beta gamma gamma") for i in range(9)] + [(7, "beta beta"), (7, "beta beta"), (90, None), (91, ""), (92, " .,- "), (None, "beta beta beta"), (93, "long " * 9000 + "beta")]
    docs += [(94, "w" * 5000 + " gamma")]
    items = [(1, "Beta, beta gamma"), (2, "été x9"), (3, "unseen words"), (4, None), (5, ""), (None, "beta"), (6, "w" * 5000), (1, "Beta, beta gamma"), (7, " ".join(words))]
    frame = spark.createDataFrame([(i, t, "clash") for i, t in docs], DOCS).repartition(3)
    asked = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, rank int")
    for k in (4, 200):
        got = lexical_search.search(lexical_search.build_index(frame), asked, k).collect()
        assert sorted(map(tuple, got)) == _ranked(docs, items, k)
    empty = lexical_search.build_index(frame.limit(0))
    assert lexical_search.search(empty, asked).collect() == [] and lexical_search.search(empty, asked.limit(0)).collect() == []


def test_texts_of_one_item_id_are_ranked_on_their_own(spark):
    docs = spark.createDataFrame([(i, t, "") for i, t in enumerate(["a b", "b c", "c c d", "e"])], DOCS)
    items = spark.createDataFrame([(1, "a"), (1, "c"), (1, "c")], "item_id long, text string")
    got = sorted((r["rank"], r["doc_id"]) for r in lexical_search.search(lexical_search.build_index(docs), items).collect())
    assert got == [(1, 0), (1, 2), (2, 1)]


def test_strata_are_left_out_by_their_bounds():
    docs = [(75 + i, i, 1, 1) for i in range(64)] + [(75, 100 + i, 1, 9) for i in range(30)]
    m, ids, term, tf = (np.array(c) for c in zip(*docs, strict=True))
    batch = lexical_search.pack(m, ids, np.arange(len(m)), term.astype(np.uint64), tf)
    strata = [lexical_search.Stratum(r) for r in batch.to_pylist()]
    best = [lexical_search.Best(20)]
    turn = lexical_search.Turn(np.array([0]), np.array([5]), np.array([1], np.uint64), np.array([[1.0]]), np.array([300]))
    assert len(strata) == 64 and lexical_search.visits(turn, strata, best) == 1
    assert best[0].ids.tolist() == list(range(100, 120))


def _whitened(rows):
    x = {i: [math.floor(64 * float(np.float64(c))) + 10**6 for c in v] for i, v in rows}
    fit = [list(v) for v in sorted({tuple(v) for v in x.values()})]
    n, s = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    centred = [[n * a - b for a, b in zip(v, s, strict=True)] for v in fit]
    cov = np.array([[sum(r[i] * r[j] for r in centred) / n**3 for j in range(len(s))] for i in range(len(s))])
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1][:16], u[:, ::-1][:, :16]
    return {i: (n, sum((n * a - b) ** 2 for a, b in zip(v, s, strict=True)), [float(sum((n * a - b) / n * u[d, c] for d, (a, b) in enumerate(zip(v, s, strict=True))) / math.sqrt(e[c])) for c in range(len(e))]) for i, v in x.items()}, e / np.trace(cov)


@pytest.mark.parametrize(("block", "tile", "width"), [(8192, 256, 5), (64, 2, 5), (128, 7, 20)])
def test_whitening_against_brute_force(spark, monkeypatch, block, tile, width):
    monkeypatch.setattr(whitening, "BLOCK_ROWS", block)
    monkeypatch.setattr(whitening, "TILE", tile)
    rng = np.random.default_rng(3)
    scale = np.array([0.3, 1.0, 200.0, 0.05, 900.0] + [0.5] * (width - 5))
    rows = [(i, (rng.normal(size=width) * scale).tolist()) for i in range(150)]
    rows += [(200 + i, rows[3][1]) for i in range(40)]
    bad = [(300, None), (301, [None] + [0.1] * (width - 1)), (302, [float("nan")] * width), (303, [float("inf")] + [0.0] * (width - 1)), (304, [1.0]), (305, [])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows + bad], "vec_id long, embedding array<double>, n int").repartition(5)
    want, explained = _whitened(rows)
    got = whitening.whiten(df).collect()
    assert len(got) == len(rows) * min(16, width) and {r["vec_id"] for r in got} == set(want)
    sign = {}
    for r in sorted(got, key=lambda r: (-abs(r["whitened"]), r["vec_id"])):
        n, far, z = want[r["vec_id"]]
        c = r["component"] - 1
        flip = sign.setdefault(c, 1 if r["whitened"] * z[c] > 0 else -1)
        assert (r["n"], r["deviation"]) == (n, far) and abs(r["whitened"] * flip - z[c]) < 1e-6
        assert abs(r["explained"] / explained[c] - 1) < 1e-6 and r["identity_error"] < 1e-6


def test_whitening_of_degenerate_tables(spark):
    frame = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert whitening.whiten(frame([])).collect() == []
    assert whitening.whiten(frame([(1, [0.5, 0.5]), (2, [0.5, 0.5])])).collect() == []
    assert whitening.whiten(frame([(1, []), (2, [])])).collect() == []
    line = whitening.whiten(frame([(None, [0.0, 1.0]), (2, [1.0, 1.0]), (2, [1.0, 1.0])])).collect()
    assert sorted((r["vec_id"] or 0, r["component"], abs(round(r["whitened"], 9)), round(r["explained"], 9)) for r in line) == [(0, 1, 1.0, 1.0), (2, 1, 1.0, 1.0), (2, 1, 1.0, 1.0)]
    huge = whitening.whiten(frame([(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [0.25, 5.0])])).collect()
    assert {r["vec_id"] for r in huge} == {1, 2, 3} and all(np.isfinite(r["whitened"]) and r["deviation"] >= 0 for r in huge)


def test_bit_planes_count_exactly():
    rng = np.random.default_rng(1)
    x = rng.integers(-(1 << 62), 1 << 62, size=(130, 3))
    low = x.min(axis=0)
    bits = np.array([int(a).bit_length() for a in (x.max(axis=0).astype(object) - low.astype(object))])
    planes, dim, place = whitening.bit_planes(x, low, bits)
    y = x.astype(object) - low.astype(object)
    for i, j in itertools.product(range(3), repeat=2):
        total = sum(int(np.bitwise_count(planes[p] & planes[q]).sum()) << int(place[p] + place[q]) for p in np.flatnonzero(dim == i) for q in np.flatnonzero(dim == j))
        assert total == int((y[:, i] * y[:, j]).sum())


def test_subsequence_kernel_against_enumeration():
    texts = ["an idxiot. of th id-iot\nend", "", "the moron", "i d i o t", "ÉTÉ"]
    sym, at = toxicity.symbols(texts)
    pad = "~" * toxicity.PAD
    assert len(at) == len(texts) and "".join("_" if c == 1 else "~" if c == 0 else chr(c - 2) for c in sym[at[0] : at[1]]) == f"_{pad}_an_idxiot_{pad}_of_th_idiot_{pad}_end"
    segments = toxicity._segments(sym, np.arange(len(sym)))
    f = toxicity.segment_features(segments)

    def spectrum(row):
        out = {}
        for places in itertools.combinations(range(len(row)), toxicity.LENGTH):
            if places[0] < toxicity.WIDTH and places[-1] - places[0] < toxicity.SPAN and all(row[p] for p in places):
                key = tuple(row[p] for p in places)
                out[key] = out.get(key, 0) + toxicity.GAP ** (places[-1] - places[0] + 1 - toxicity.LENGTH)
        return out

    spectra = [spectrum(r) for r in segments.tolist()]
    for z in (4, 20, 40):
        want = [sum(w * spectra[z].get(k, 0) for k, w in s.items()) for s in spectra]
        assert np.allclose(toxicity.kernel(f, (f[0][z], f[1][z])), want, rtol=1e-4)
    assert np.allclose(toxicity._norms(f) ** 2, [sum(w * w for w in s.values()) for s in spectra], rtol=1e-4)
    table = np.random.default_rng(2).normal(size=1 << toxicity.BITS).astype(np.float32)
    assert np.allclose(toxicity.evidence(sym, table), (table[f[0]] * f[1]).sum(axis=1), atol=1e-3)


def test_folded_weights_equal_the_machine_on_landmarks():
    rng = np.random.default_rng(5)
    sym, _ = toxicity.symbols([" ".join("".join(rng.choice(list("abcdeg"), 5)) for _ in range(60))])
    segments = toxicity._segments(sym, np.arange(0, len(sym), 3))
    f = toxicity.segment_features(segments)
    norms = toxicity._norms(f)
    label = np.where(rng.random(len(norms)) < 0.5, 1.0, -1.0)
    some = np.flatnonzero(norms > 0)
    f, norms, label, segments = (f[0][some], f[1][some]), norms[some], label[some], segments[some]
    chosen = np.array(toxicity._landmarks(f, norms, 9))
    model = toxicity._nystroem_machine(f, label, norms, chosen)
    values = np.stack([toxicity.kernel(f, (f[0][c], f[1][c])) / norms[c] for c in chosen], axis=1)
    e, v = np.linalg.eigh(values[chosen] / norms[chosen][:, None])
    root = v[:, e > 1e-6 * e.max()] / np.sqrt(e[e > 1e-6 * e.max()])
    w = toxicity.squared_hinge(values @ root, label, toxicity.COST)
    assert np.allclose((model.table[f[0]] * f[1]).sum(axis=1) + model.bias, values @ root @ w[:-1] + w[-1], atol=1e-2)


@pytest.fixture(scope="module")
def labelled():
    rng = random.Random(9)
    parts = ["er", "th", "an", "ing", "or", "ed", "st", "on", "ly", "ne", "bo", "mi"]
    word = lambda: "".join(rng.choices(parts, k=rng.randint(1, 4)))
    bad = ["grumbok", "vexling", "slatch"]
    rows = []
    for i in range(700):
        ws = [word() for _ in range(rng.randint(5, 90))]
        toxic = i % 4 == 0
        for _ in range(2 if toxic else 0):
            ws.insert(rng.randrange(len(ws)), rng.choice(bad))
        rows.append((i, " ".join(w + ("." if rng.random() < 0.1 else "") for w in ws), int(toxic)))
    return rows, word, bad


def test_toxicity_on_held_out_and_disturbed_texts(spark, labelled):
    rows, word, bad = labelled
    docs = spark.createDataFrame([(i, t, 5) for i, t, _ in rows] + [(9000, None, 0), (9001, "", 0), (9002, "...!", 0), (None, "a grumbok slatch", 0), (9003, "er th " * 120_000 + "grumbok vexling" + " an" * 40, 0), (9004, "x" * 600_000, 0)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(i, y, 1) for i, _, y in rows] + [(1, 1, 0), (2, None, 0), (None, 1, 0), (77777, 1, 0)], "doc_id long, toxic int, quality int")
    got = {r["doc_id"]: r for r in toxicity.toxicity(docs.repartition(3), labels).collect()}
    out = [(i, y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, _, _ in rows) and len(out) > 100
    assert sum(got[i]["predicted"] == y for i, y in out) / len(out) > 0.97
    assert all((r["score"] >= 0.5) == (r["predicted"] == 1) and 0 <= r["score"] <= 1 for r in got.values())
    assert got[9000]["score"] == got[9001]["score"] == got[9002]["score"] < 0.5 and got[9003]["predicted"] == 1 and got[9004]["predicted"] == 0
    assert got[None]["held_out"] is False and got[None]["predicted"] == 1
    learned = [(t, y) for i, t, y in rows if zlib.crc32(str(i).encode()) % 5]
    model = toxicity.fit([t for t, _ in learned], [bool(y) for _, y in learned])
    change = {"spaced": " ".join, "dots": ".".join, "hyphen": lambda w: w[:3] + "-" + w[3:], "inserted": lambda w: w[:3] + "x" + w[3:], "capitals": str.upper}
    for name, f in change.items():
        texts = [" ".join([word() for _ in range(9)] + [f(b), word(), f(bad[0]), word(), word()]) for b in bad for _ in range(8)]
        assert (model.scores(texts) >= 0.5).mean() > 0.8, name


def test_toxicity_without_both_labels(spark):
    docs = spark.createDataFrame([(1, "some text"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0)], "doc_id long, toxic int")
    assert [r["score"] for r in toxicity.toxicity(docs, labels).collect()] == [0.0, 0.0]
    assert [r["score"] for r in toxicity.toxicity(docs, labels.limit(0)).collect()] == [0.0, 0.0]
    assert toxicity.toxicity(docs.limit(0), labels).collect() == []

import base64
import hashlib
import itertools
import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexloom.llm import sentencepiece_codec as codec
from lexloom.llm import textblocks as tb
from lexloom.llm import topk_search, warc
from lexloom.llm.chat_format import BUDGET, digests, format_conversations, read_back
from lexloom.llm.html_extract import COPY, common_lines, main_text


def test_top_k_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk_search, "BLOCK_ROWS", 7)
    monkeypatch.setattr(topk_search, "TURN_BYTES", 1000)
    monkeypatch.setattr(topk_search, "CHUNK", 8)
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(120)] + [(200 + i, [0.5] * 6) for i in range(40)]
    rows += [(300, None), (301, [0.1, None, 0.2, 0.3, 0.4, 0.5]), (302, [float("nan")] * 6), (303, [float("inf")] * 6), (None, [1.0] * 6), (304, [1.0, 2.0]), (305, [1.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("v", F.lit("clash"))
    ints = {i: np.floor(64 * np.array(v)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(np.array(v, float)).all()}
    for k in (5, 500):
        want = []
        for q in (i for i in ints if i % 4 == 0):
            others = sorted((-int(ints[q] @ v), i) for i, v in ints.items() if i != q and len(v) == len(ints[q]))[:k]
            want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(others)]
        got = topk_search.top_k(df.repartition(3), df.where("vec_id % 4 = 0"), k).collect()
        assert sorted(map(tuple, got)) == sorted(want)
    assert topk_search.top_k(df.limit(0), df.limit(0)).collect() == []


def test_top_k_with_repeated_rows_in_several_blocks(spark):
    rng = np.random.default_rng(5)
    vectors = {i: rng.normal(size=4).tolist() for i in range(20)}
    frame = lambda ids, n: spark.createDataFrame(spark.sparkContext.parallelize([(i, vectors[i]) for i in ids], n), "vec_id long, embedding array<double>")
    ints = {i: np.floor(64 * np.array(v)) for i, v in vectors.items()}
    want = []
    for q in (0, 4, 8, 12, 16):
        others = sorted((-int(ints[q] @ v), i) for i, v in ints.items() if i != q for _ in range(1 + (i < 3)))[:5]
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(others)]
    got = topk_search.top_k(frame([*range(20), 0, 1, 2], 3), frame([0, 4, 8, 0, 12, 16], 2), 5).collect()
    assert sorted(map(tuple, got)) == want


def test_top_k_of_large_components(spark):
    rows = [(20, [1e8, 2.0]), (1, [1.0, 1.0]), (2, [3e12, -7.0]), (3, [-3e12, 5.0]), (40, [1e9, 1e9]), (4, [1e300, 0.0]), (5, [0.25, -0.5])]
    ints = {i: [int(min(max(int(np.floor(64 * c)), -(1 << 63)), (1 << 63) - 1)) for c in v] for i, v in rows}
    score = lambda a, b: min(max(sum(x * y for x, y in zip(ints[a], ints[b], strict=True)), -((1 << 63) - 1)), (1 << 63) - 1)
    want = []
    for q in (20, 40):
        for r, (s, i) in enumerate(sorted((-score(q, i), i) for i in ints if i != q)):
            want.append((q, r + 1, i, -s))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, topk_search.top_k(df, df.where("vec_id % 20 = 0"), 20).collect())) == sorted(want)


def test_warc(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "CHUNK_CHARS", 5)
    monkeypatch.setattr(warc, "FILE_RECORDS", 3)
    long_ = "".join(chr(97 + i % 26) for i in range(31))
    rows = [(11, "r", long_), (11, "r", long_), (11, "s", "other" + long_), (None, "t", long_), (None, "t", long_), (12, "q", "é" * 23 + "x"), (1, "http://a/x", "short"), (2, "http://a/y", "é" * 23), (3, "u", "a\r\n\r\nWARC/1.1\r\n\r\nb"), (4, None, None), (5, "", ""), (6, "v", "é" * 23), (7, "w\r\nx", "é" * 23), (None, "n", "short"), (1, "again", "short"), (8, "z", "\n" * 12)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("chunk", F.lit("clash")).withColumn("digest", F.lit(1))
    warc.write_archives(warc.plan_records(df), f"{tmp_path}/w")
    got = warc.summarise(warc.read_archives(spark, f"{tmp_path}/w")).collect()
    best = {}
    for i, _, h in rows:
        if i is not None:
            best[h or ""] = max(best.get(h or "", i), i)
    want = []
    for i, _, h in rows:
        data = (h or "").encode()
        again = i is not None and best[h or ""] > i
        want.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", best[h or ""] if again else None))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    warc.write_archives(warc.plan_records(df.limit(0)), f"{tmp_path}/e")
    assert warc.summarise(warc.read_archives(spark, f"{tmp_path}/e")).collect() == []


def test_warc_least_bytes(spark):
    df = spark.createDataFrame([(1, "", "ab"), (2, "", "ab"), (3, "", "abcdef"), (4, "", "abcdef")], "page_id long, url string, html string")
    assert {(r["page_id"], r["record_type"]) for r in warc.plan_records(df, 3).collect()} == {(1, "response"), (2, "response"), (3, "revisit"), (4, "response")}


def test_html(spark):
    page = '<html><head><title>t</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><a href="/">Home</a></nav><div class="ad">buy</div><article><header><h1>Head &amp; line</h1></header><p>One   two<br>three<p>four<ul><li>a<li>b</ul><aside>side</aside><form>f</form><div class="comments">c</div></article><section id="comments">d</section><footer>&copy; x</footer></body></html>'
    bare = "<body><div>Site name</div><p>{}</p><div>All rights reserved</div></body>"
    rows = [(1, "http://h/a/1", page), (2, "http://g/1", bare.format("first text")), (3, "http://g/2", bare.format("second text")), (4, "http://g/3", bare.format("third")), (5, None, bare.format("alone")), (6, "http://e/", None), (7, "http://e/x", ""), (8, "http://h/a/2", page), (9, "http://t/1", "<article>cut &amp")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("key", F.lit("clash")).withColumn("lines", F.lit(1))
    got = {r["page_id"]: r["text"] for r in main_text(df.repartition(3)).collect()}
    article = "Head & line\nOne two\nthree\nfour\na\nb"
    assert got == {1: article, 2: "first text", 3: "second text", 4: "third", 5: "Site name\nalone\nAll rights reserved", 6: "", 7: "", 8: article, 9: "cut &"}
    assert main_text(df.limit(0)).collect() == []


def test_common_lines():
    rng = random.Random(2)
    for _ in range(200):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(8))] for _ in range(2))
        got = common_lines(a, b)
        longest = max((k for k in range(len(a) + 1) for s in itertools.combinations(a, k) if any(list(s) == [b[j] for j in t] for t in itertools.combinations(range(len(b)), k))), default=0)
        assert len(got) == longest and got == sorted(set(got))


def test_common_lines_of_long_pages():
    began = time.perf_counter()
    assert len(common_lines([1, 2] * 3000, [2, 1] * 3000)) == 5999
    assert common_lines(list(range(20_000)), list(range(10_000, 30_000))) == list(range(10_000, 20_000))
    assert time.perf_counter() - began < 20


def test_main_text_against_brute_force(spark):
    """Pages as lists of (mark, line), written as html; partners and longest common subsequences by plain search."""
    rng = random.Random(8)
    wrap = {0: "<nav>{}</nav>", 1: "<div>{}</div>", 2: "<article>{}</article>"}
    pages = []
    for i in range(60):
        blocks = [(rng.choice((0, 1, 1, 1)), f"template {rng.randrange(4)}") for _ in range(rng.randrange(4))] + [(1, f"line {rng.randrange(40)}") for _ in range(rng.randrange(5))]
        if i % 4 == 0:
            blocks.insert(rng.randrange(len(blocks) + 1), (2, rng.choice(("short", "a long article that says more than all else on this page, by far and away, so the rest goes"))))
        if i % 7 == 3:
            blocks = list(pages[-1][3])
        host = f"h{rng.randrange(3)}" if i % 9 else None
        pages.append((i, host, f"/p{rng.randrange(1000):04d}/{i:02d}", blocks))

    def lcs(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for x in range(len(a)):
            for y in range(len(b)):
                t[x + 1][y + 1] = t[x][y] + 1 if a[x] == b[y] else max(t[x][y + 1], t[x + 1][y])
        return t[-1][-1]

    undecided = {i: [t for m, t in b if m == 1] for i, _, _, b in pages}
    order = {h: sorted((path, i) for i, host, path, _ in pages if host == h) for h in ("h0", "h1", "h2")}
    got = {r["page_id"]: r["text"] for r in main_text(spark.createDataFrame([(i, f"http://{h}{path}" if h else None, "<body>" + "".join(wrap[m].format(t) for m, t in b) + "</body>") for i, h, path, b in pages], "page_id long, url string, html string").repartition(5)).collect()}
    decided = 0
    for i, host, path, blocks in pages:
        near = []
        if host:
            at = order[host].index((path, i))
            near = [order[host][k][1] for k in (at - 1, at + 1) if 0 <= k < len(order[host])]
        mine, shared = undecided[i], 0
        for j in near:
            if undecided[j]:
                shared = lcs(mine, undecided[j])
                if shared < COPY * len(mine):
                    break
                shared = 0
        main = [t for m, t in blocks if m == 2]
        text = got[i].split("\n") if got[i] else []
        if main and sum(map(len, main)) >= sum(map(len, text)) - sum(map(len, main)) and text == main:
            continue
        decided += shared > 0
        assert len(text) == len(main) + len(mine) - shared
        left = iter(t for m, t in blocks if m)
        assert all(t in left for t in text)  # in page order
    assert decided > 5


@pytest.fixture(scope="module")
def pieces():
    return codec.Pieces.load(codec.model_path())


def segmentations(pieces, unit):
    if not unit:
        return [(0, ())]
    out, end = [], 1
    while end < len(unit) and unit[end] & 0xC0 == 0x80:
        end += 1
    steps = [(unit[:j], *pieces.piece[unit[:j]]) for j in range(1, len(unit) + 1) if unit[:j] in pieces.piece]
    for piece, ident, score in steps:
        out += [(score + s, (ident, *ids)) for s, ids in segmentations(pieces, unit[len(piece) :])]
    if unit[:end] not in pieces.piece:
        out += [(pieces.unknown + s, (*(int(pieces.byte_id[b]) for b in unit[:end]), *ids)) for s, ids in segmentations(pieces, unit[end:])]
    return out


@pytest.mark.parametrize("text", ["hello", "the cat", "a\nb", "éè", "🎉 ok", " x", "aaaa", "日本x"])
def test_n_best_against_all_segmentations(pieces, text):
    raw, at = tb.utf8(pa.array([text]))
    ids, _, scores = codec.encode_chunk(pieces, raw, at, 4)
    every = sorted(segmentations(pieces, (" " + text).encode()), key=lambda x: -x[0])
    assert scores[0] == [s for s, _ in every[:4]]
    assert (scores[0][0], tuple(ids.tolist())) in every


def test_all_n_best_segmentations_come_back(spark, pieces, tmp_path):
    from lexloom.llm.queries import QUERIES

    texts = ["hello", "the cat sat", "a\nb", "éè", "🎉 ok", "aaaa", "日本x", "aa aa bb aa", "", None, "x" * 60 + " y"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    for r in QUERIES["op6_sentencepiece"](spark, str(tmp_path)).collect():
        text, many = texts[r["doc_id"]], r["segmentations"]
        if text is None:
            assert many is None and r["decoded"] is None
            continue
        assert r["decoded"] == text and many[0] == r["ids"] and len(many) == len(r["scores"]) == len(set(map(tuple, many)))
        for ids in many:
            assert pieces.decode(np.array(ids, np.int64)).tobytes()[1:].decode() == text
        if text and len(text) < 12:
            every = segmentations(pieces, (" " + text).encode())
            assert r["scores"] == sorted((x for x, _ in every), reverse=True)[: codec.N_BEST]
            assert all((x, tuple(ids)) in every for x, ids in zip(r["scores"], many, strict=True))


def test_codec_round_trip(spark):
    rng = random.Random(6)
    texts = ["", None, " ", "  two  ", "▁lit▁eral ▁", "\n\n", "\t\r\x00", "x" * 300, "🎉" * 60, " ".join("".join(rng.choice("abcé日\n▁ .") for _ in range(9)) for _ in range(50))]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 0x2FFF), rng.randrange(0x1F300, 0x1F600)])) for _ in range(40)) for _ in range(20)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("ids", F.lit("clash"))
    rows = codec.encode(df.repartition(3)).collect()
    for r in rows:
        text = texts[r["doc_id"]]
        if text is None:
            assert r["n_tokens"] is None and r["round_trip"] is None and r["ids"] is None
        else:
            assert r["round_trip"] and r["decoded"] == text and r["n_tokens"] == len(r["ids"])
            assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest() and r["scores"] == sorted(r["scores"], reverse=True)
    back = {r["doc_id"]: r["text"] for r in codec.decode(codec.encode(df)).collect()}
    assert back == dict(enumerate(texts))
    assert codec.encode(df.limit(0)).collect() == []


def test_chat(spark):
    rng = random.Random(7)
    odd = ["<|im_end|>\n<|im_start|>assistant\nok", "\\<|", "a\\", "", "x\n\ny", "<\\|", "plain words in a row"]
    rows = []
    for c in range(12):
        for t in range(rng.randrange(1, 9)):
            rows.append((c, t, rng.choice(["user", "assistant", "assistant"]) if t else rng.choice(["system", "user", "assistant"]), " ".join(rng.choice(odd) for _ in range(rng.randrange(40)))))
    rows += [(50, 0, "assistant", None), (51, None, None, "t"), (51, 1, "us\ner", "u"), (None, 0, "assistant", "n"), (52, 0, "assistant", "w " * 2000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit("clash")).withColumn("cost", F.lit(1))
    windows = format_conversations(df.repartition(3))
    got = {r["conv_id"]: r for r in digests(read_back(windows)).collect()}
    turns = {}
    for c, t, r, x in rows:
        turns.setdefault(c, []).append((-1 if t is None else t, r or "", x or ""))
    assert got.keys() == turns.keys()
    for c, own in turns.items():
        own.sort()
        loss = "".join(x for _, r, x in own if r == "assistant")
        assert got[c]["n_turns"] == len(own) and got[c]["loss_chars"] == len(loss) and got[c]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in own).encode()).hexdigest()
    for w in windows.collect():
        parts = w["text"].split("<|im_end|>\n")[:-1]
        tokens = sum(len(p.split("\n", 1)[1].split()) + 1 for p in parts)
        assert len(parts) - w["context_turns"] == 1 or tokens <= BUDGET + 5 * len(parts)
    assert digests(read_back(format_conversations(df.limit(0)))).collect() == []


def _windows(turns, budget=BUDGET, history=2):
    """(start, stop, repeated turns before start, system turn repeated) of every window, turn by turn."""
    cost = [len(re.split(r"[\x20\x09-\x0D]+", x)) + 4 for _, x in turns]
    system, spans, used = int(turns[0][0] == "system"), [[0, 0, 0, 0]], 0
    for i, c in enumerate(cost):
        if i > system and used + c > budget:
            h = max(h for h in range(history + 1) if i - h >= system and sum(cost[i - h : i]) * 4 <= budget)
            spans.append([i, i, h, system])
            used = (cost[0] if system else 0) + sum(cost[i - h : i])
        used += c
        spans[-1][1] = i + 1
    return spans


def test_chat_windows_of_long_conversations(spark):
    rng = random.Random(11)
    rows = [(c, t, rng.choice(["user", "assistant"]) if t else first, " ".join(["<|w\\"] * rng.choice([0, 1, 3, 9, 40, 70, 300])))
            for c, first, n in ((1, "system", 300), (2, "user", 300), (None, "assistant", 9000), (3, "system", 1), (4, "system", 2)) for t in range(n)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    began = time.perf_counter()
    got = {}
    for w in sorted(format_conversations(df).collect(), key=lambda w: w["window"]):
        got.setdefault(w["conv_id"], []).append(w)
    assert time.perf_counter() - began < 60
    written = lambda r, x: f"<|im_start|>{r}\n" + x.replace("\\", "\\\\").replace("<|", "<\\|")
    for c in (1, 2, None, 3, 4):
        turns = [(r, x) for k, _, r, x in rows if k == c]
        spans = _windows(turns)
        assert [w["window"] for w in got[c]] == list(range(len(spans)))
        for w, (start, stop, h, s) in zip(got[c], spans):
            shown = turns[:s] + turns[start - h : stop]
            assert w["text"] == "".join(written(*t) + "<|im_end|>\n" for t in shown) and w["context_turns"] == s + h
            assert ["".join(w["text"][x["start"] : x["start"] + x["length"]]) for x in w["loss"]] == [written(r, x)[len(f"<|im_start|>{r}\n") :] for r, x in turns[start:stop] if r == "assistant"]


def test_very_long_unit(spark, pieces):
    began = time.perf_counter()
    for unit in (b"a" * 20_000, b" " + b"abcdefgh" * 2500):
        found = pieces.n_best(unit, 4)
        assert len(found) == 4 and [s for s, _ in found] == sorted((s for s, _ in found), reverse=True)
        assert all(pieces.decode(np.array(ids, np.int64)).tobytes() == unit for _, ids in found)
    assert time.perf_counter() - began < 30

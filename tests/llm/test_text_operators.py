"""Small tables with nulls, empty and repeated rows and clashing columns against plain models."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexloom.llm import line_dedup, ngram_join, substring_dedup
from lexloom.llm.decontaminate import contamination
from lexloom.llm.language_id import fit, forward_backward, identify, keep_identified
from lexloom.llm.line_dedup import remove_repeated_lines, with_lines_removed
from lexloom.llm.ngram_join import near_duplicate_components
from lexloom.llm.substring_dedup import remove_repeated_passages

SCHEMA = "doc_id long, text string, lang string, h1 string, late string, key string, node string, n_chars long"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", "x", "y", "z", "n", len(t or "")) for i, t in rows], SCHEMA)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def some_texts(seed, n=40):
    rng = random.Random(seed)
    vocabulary = [f"w{i}é" for i in range(300)]
    passage = [rng.choice(vocabulary) for _ in range(30)]
    rows = []
    for i in range(n):
        w = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 60))]
        if i % 3 == 0:
            w[3:3] = passage[rng.randrange(8) :]
        if i % 7 == 0:
            w = w + ["der"] * rng.randrange(30) + ["a", "b"] * rng.randrange(15)
        rows.append((i, " ".join(w)))
    return rows + [(n, rows[3][1]), (n + 1, rows[0][1]), (n + 2, None), (n + 3, ""), (n + 4, "\n \t"), (None, rows[0][1]), (5, rows[5][1])]


@pytest.mark.parametrize(("seed", "region"), [(1, 1 << 16), (2, 20)])
def test_passages_against_brute_force(spark, monkeypatch, seed, region):
    monkeypatch.setattr(substring_dedup, "REGION_WORDS", region)
    monkeypatch.setattr(substring_dedup, "ROUND_WORDS", (8, 16, 32))
    rows, width = some_texts(seed), 8
    long_ = " ".join(f"l{k * k % 97}" for k in range(400))
    rows += [(60, long_), (61, "start " + long_ + " end"), (61, long_ + " other row"), (62, " ".join(long_.split()[100:300]))]
    first = {}
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - width + 1):
            if i is not None:
                g = tuple(w[k : k + width])
                first[g] = min(first.get(g, i), i)
    expected = []
    for i, t in rows:
        w = words(t)
        gone = {k + j for k in range(len(w) - width + 1) for j in range(width) if i is not None and first[tuple(w[k : k + width])] < i}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        expected.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    got = remove_repeated_passages(documents(spark, rows).repartition(3), width).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=str) == sorted(expected, key=str)
    assert remove_repeated_passages(documents(spark, []), width).collect() == []


def test_symbols_of_long_repeats_span_windows(spark):
    """A long passage in three documents is found as symbols of 50 words and more, not only by its windows."""
    rng = random.Random(4)
    passage = [f"p{rng.randrange(5000)}" for _ in range(3000)]
    rows = [(i, " ".join([f"o{i}x{k}" for k in range(40)] + passage[: 3000 - i] + [f"e{i}x{k}" for k in range(40)])) for i in range(3)]
    seen = {}
    settle = substring_dedup.settle

    def kept(df, name):
        seen[name] = settle(df, name)
        return seen[name]

    substring_dedup.settle = kept
    try:
        got = {r["doc_id"]: r["n_removed"] for r in remove_repeated_passages(documents(spark, rows)).collect()}
    finally:
        substring_dedup.settle = settle
    assert got == {0: 0, 1: 2999, 2: 2998}
    longest = seen["repeated-symbols"].selectExpr("max(end - start) AS n", "sum(end - start) AS all").first()
    assert longest["n"] > 300 and 0 < longest["all"]


def test_lines_against_brute_force(spark):
    rng = random.Random(3)
    lines = [f"  Common LINE number {i} \t" for i in range(6)] + ["short", "", "ÄÖ line with umlauts", "x" * 9, "x" * 10]
    rows = [(i, "\n".join(rng.choice(lines) if rng.random() < 0.6 else f"own line {rng.random()}" for _ in range(rng.randrange(8)))) for i in range(30)]
    rows += [(30, None), (31, ""), (32, rows[3][1]), (3, rows[3][1]), (None, rows[3][1]), (33, "common line number 1"), (34, "a\n")]
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(lower)
    first = {}
    for i, t in rows:
        if i is not None and t is not None:
            for x in t.split("\n"):
                first[key(x)] = min(first.get(key(x), i), i)
    expected = []
    for i, t in rows:
        all_ = (t or "").split("\n")
        kept = [x for x in all_ if i is None or len(key(x)) < 10 or first[key(x)] == i]
        expected.append((i, len(all_), len(all_) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    for keys, most in ((8192, 1 << 26), (1, 1 << 26), (3, 0)):  # one block; many; a filter that isn't sent to the executors
        got = remove_repeated_lines(documents(spark, rows).repartition(4), block_keys=keys, most_bytes=most).select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()
        assert sorted(map(tuple, got), key=str) == sorted(expected, key=str)
    clean = with_lines_removed(documents(spark, rows))
    assert clean.columns == documents(spark, []).columns and clean.count() == len(rows)
    assert clean.where("n_chars <> length(text)").isEmpty() and clean.where("doc_id = 30").first()["text"] is None
    assert remove_repeated_lines(documents(spark, [])).collect() == []


def shingles(text, k=5):
    w = words((text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())


@pytest.mark.parametrize("block", [4096, 2])
def test_near_duplicates_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "GROUP_BLOCK", block)
    monkeypatch.setattr(ngram_join, "LEAST_FRAGMENTS", 3)
    monkeypatch.setattr(ngram_join, "BLOCK_SHINGLES", 100)
    rng = random.Random(5)
    rows, base = [], [f"t{rng.randrange(500)}" for _ in range(60)]
    for i in range(60):
        w = list(base) if i % 2 else [f"t{rng.randrange(500)}" for _ in range(rng.randrange(0, 50))]
        for _ in range(rng.randrange(4)):
            if w:
                w[rng.randrange(len(w))] = f"e{rng.randrange(50)}"
        rows.append((i, " ".join(w)))
    rows += [(60, rows[1][1].upper()), (61, None), (62, ""), (63, "a b"), (64, "A  b"), (65, "a b c"), (None, "a b"), (1, rows[1][1]), (66, rows[0][1] + " " + rows[2][1])]
    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            if x and y and 100 * len(x & y) >= 75 * len(x | y) and find(i) != find(j):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    expected = [(i, len(shingles(t)), None if i is None else find(i)) for i, t in rows]
    got = near_duplicate_components(documents(spark, rows).repartition(3)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(expected, key=str)
    assert near_duplicate_components(documents(spark, [])).collect() == []


def test_contamination(spark):
    items = spark.createDataFrame([(1, "A train leaves Paris at 9 and needs 120 minutes to reach Lyon. When does the train arrive?"), (2, "two words"), (3, None), (4, ""), (5, "the second item speaks of apples and pears on the wooden table")], "item_id long, text string").withColumn("w", F.lit("clash"))
    rows = [
        (1, "intro text here. A train leaves Paris at 9 and needs 120 minutes to reach Lyon. When does the train arrive? more text"),
        (2, "x. A train leaves Madrid at 7 and needs 45 hours to reach Vigo. When does the train arrive?"),
        (3, "only two  words,  in here"),
        (4, None),
        (5, ""),
        (6, "a clean document about trains that leave at 9 and apples"),
        (7, "THE second item, speaks of apples and pears: on the wooden table"),
        (None, "the second item speaks of apples and pears on the wooden table"),
        (7, "repeated row"),
    ]
    got = {(r["doc_id"], r["contaminated"], tuple(r["items"])) for r in contamination(documents(spark, rows), items).collect()}
    assert got == {(1, True, (1,)), (2, True, (1,)), (3, True, (2,)), (4, False, ()), (5, False, ()), (6, False, ()), (7, True, (5,)), (None, False, ())}
    twice = spark.createDataFrame([(1, "if Tom has 5 apples and gives 5 apples away then Tom has no apples at all")], "item_id long, text string")
    odd = documents(spark, [(1, "if Tom has 5 apples and gives 6 apples away then Tom has no apples at all"), (2, "if Tom has 8 apples and gives 8 apples away then Tom has no apples at all")])
    assert {(r["doc_id"], r["contaminated"]) for r in contamination(odd, twice, width=12).collect()} == {(1, False), (2, True)}
    assert contamination(documents(spark, []), items).collect() == []
    assert {r["contaminated"] for r in contamination(documents(spark, rows), items.limit(0)).collect()} == {False}


def test_contamination_of_split_and_slot_heavy_copies(spark):
    body = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(38)]
    named = [*body[:19], "Anna", *body[19:]]
    often = " ".join(f"{a} {b} {c} Paris" for a, b, c in zip(body[::3], body[1::3], body[2::3], strict=False))
    lists, title = "Add 17, 24, 36, 58, 91 and 105.", "Which Town Of Old France Was Named After Its Third Queen?"
    items = spark.createDataFrame([(1, " ".join(body)), (2, " ".join(named).replace("worda", "termb")), (3, lists), (4, title), (5, often.replace("word", "note"))], "item_id long, text string")
    second = " ".join(named).replace("worda", "termb")
    rows = [
        (1, " ".join([*body[:19], "inserted", *body[19:]])),
        (2, second.replace("Anna", "Maria Luisa")),
        (3, f"Some text. {lists} More text."),
        (4, f"And so: {title} Who knows."),
        (5, often.replace("word", "note").replace("Paris", "New York")),
        (6, " ".join([*body[19:], "swapped", *body[:19]])),  # out of order
        (7, "Add 5 and 7. Add 1, 2 and 3."),
        (8, "Which Road Did Tom Take?"),
        (9, " ".join(body[:19])),
        (10, " ".join([*body[:15], "one", *body[15:30], "two", "three", *body[30:]])),
    ]
    got = {r["doc_id"]: r["items"] for r in contamination(documents(spark, rows).repartition(3), items).collect()}
    assert got == {1: [1], 2: [2], 3: [3], 4: [4], 5: [5], 6: [], 7: [], 8: [], 9: [], 10: [1]}


def test_forward_backward():
    import itertools

    import numpy as np

    rng = np.random.default_rng(0)
    offsets, emit, moves = np.array([0, 3, 3, 5]), rng.normal(size=(5, 2)), rng.normal(size=(2, 2))
    got, pairs = forward_backward(emit, offsets, moves, pairs=True)
    want, want_pairs = np.zeros((5, 2)), np.zeros((2, 2))
    for a, b in ((0, 3), (3, 5)):
        total, sums, moved = 0, np.zeros((b - a, 2)), np.zeros((2, 2))
        for y in itertools.product(range(2), repeat=b - a):
            w = np.exp(sum(emit[a + i, y[i]] for i in range(b - a)) + sum(moves[y[i], y[i + 1]] for i in range(b - a - 1))) * np.exp(moves[:, y[0]]).sum()
            total += w
            for i in range(b - a):
                sums[i, y[i]] += w
            for i in range(b - a - 1):
                moved[y[i], y[i + 1]] += w
        want[a:b] = sums / total
        want_pairs += moved / total
    assert np.allclose(got, want) and np.allclose(pairs, want_pairs)


def test_language(spark):
    rng = random.Random(1)
    vocabulary = {"aa": ["thing", "ther", "tion", "with"], "bb": ["schön", "ung", "keit", "der"]}
    rows = [(i, " ".join(rng.choice(vocabulary["aa" if i % 2 else "bb"]) + rng.choice(["", "s", "en"]) for _ in range(20)), "aa" if i % 2 else "bb") for i in range(80)]
    rows += [(80, None, "aa"), (81, "", None), (82, "123 ++ 4", "bb"), (None, rows[1][1], "aa"), (83, rows[1][1] + " " + rows[0][1] + " 77", None), (1, rows[1][1], "aa")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("held_out", F.lit("clash")).withColumn("lettered", F.lit(1))
    got = identify(docs).collect()
    assert len(got) == len(rows)
    truth = {i: x for i, _, x in rows if i is not None and i < 80}
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert held and all(r["lang_pred"] == truth[r["doc_id"]] for r in held)
    by = {r["doc_id"]: r for r in got}
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 for i in (80, 81, 82))
    assert by[83]["words_by_label"] == [20, 20]  # code-switched text, word by word
    kept = keep_identified(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in got if r["lang_pred"] != "und" and r["score"] >= 0.4}
    assert identify(docs.limit(0)).collect() == [] and fit([], []).labels == []


def test_bloom_filters_hold_what_two_tasks_saw(spark):
    rows = [(i, f"the very same line\nown {i} line of text") for i in range(8)]
    late = line_dedup.repeated_lines(documents(spark, rows).repartition(8)).collect()
    assert {r["doc_id"] for r in late} == set(range(1, 8))
    groups = defaultdict(set)
    for r in late:
        groups[tuple(tuple(x) for x in r["late"])].add(r["doc_id"])
    assert len(groups) == 1


def test_substring_dedup_of_structured_texts(spark):
    """Texts that share no window but on which polynomial hashes modulo 2^64 agree."""
    bits = [bin(i).count("1") % 2 for i in range(2048)]
    text = lambda flip: " ".join(f"{'ab'[b ^ flip]}q f{i}" for i, b in enumerate(bits))
    rows = [(0, text(0)), (1, text(1)), (2, text(1)), (3, " ".join("ab"[b] for b in bits)), (4, " ".join("ab"[1 - b] for b in bits))]
    got = {r["doc_id"]: r["n_removed"] for r in remove_repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    seen, want = set(), {}
    for i, t in rows:
        ws = t.split(" ")
        windows = [" ".join(ws[k : k + 50]) for k in range(len(ws) - 49)]
        gone = {p for k, w in enumerate(windows) if w in seen for p in range(k, k + 50)}
        want[i] = len(gone)
        seen |= set(windows)
    assert got == want and want[1] == 0 and want[2] == 4096


def test_every_text_ends_as_one_symbol():
    """The passes end for runs, alternations and long texts alike; equal texts, and only they, end as the same symbol."""
    rng = np.random.default_rng(7)
    texts = [rng.integers(0, 3, n) for n in rng.integers(1, 900, 150)] + [np.zeros(n, int) for n in (1, 2, 50, 51, 20_000)]
    texts += [np.tile([1, 2], n) for n in (1, 25, 26, 9000)] + [rng.integers(0, 1 << 40, 5000), np.array([bin(i).count("1") % 2 for i in range(4096)])]
    texts += [1 - texts[-1]] + [t.copy() for t in texts[::3]]
    rng.shuffle(order := np.arange(len(texts)))
    texts = [texts[i] for i in order]
    names, _, _, twins, of = substring_dedup.recompress(np.concatenate(texts).astype(np.uint64), np.repeat(np.arange(len(texts)), [len(t) for t in texts]))
    row, name, twin = substring_dedup.tops(names, twins, of)
    assert row.tolist() == list(range(len(texts)))
    different = len({t.tobytes() for t in texts})
    assert len(set(zip(name.tolist(), twin.tolist(), strict=True))) == len(set(name.tolist())) == different < len(texts)


def test_contamination_of_a_repetitive_text(spark):
    docs = spark.createDataFrame([(1, "la " * 20_000), (2, "la lo " * 6000), (3, "la " * 9 + "lo")], "doc_id long, text string")
    items = spark.createDataFrame([(5, "la " * 200), (6, "la lo " * 60)], "item_id long, text string")
    got = {r["doc_id"]: r["items"] for r in contamination(docs, items).collect()}
    assert got == {1: [5], 2: [6], 3: []}


#: Sentences of four languages with slots: n a number, u a number with a unit, p a name.
TEMPLATES = [
    ("A train leaves {p} at {n} and needs {u} to reach {q}. When does the train from {p} arrive there?", ("minutes", "hours")),
    ("{n} farmers share {u} of milk. How much of it does each one get if {p} takes a third of all before the others come?", ("liters", "gallons")),
    ("Every week {p} saves {u} and gives {n} of them to {q}. After how many weeks can the new bicycle be bought?", ("dollars", "euros")),
    ("Un train quitte {p} à {n} et met {u} pour arriver à {q}. À quelle distance se trouvent alors les deux villes?", ("heures", "kilomètres")),
    ("Le jardin de {p} mesure {u} de long, et {q} plante {n} arbres de chaque côté. Combien en faut-il pour la rue?", ("mètres", "mètres")),
    ("Un tren sale de {p} a las {n} y tarda {u} en llegar a {q}. ¿Qué distancia hay entre las dos ciudades del norte?", ("horas", "minutos")),
    ("El padre de {p} tiene {u} y su hija {n} menos, mientras que {q} acaba de cumplir la mitad. ¿Cuántos tienen los tres juntos?", ("años", "meses")),
    ("Ein Zug verlässt {p} um {n} und braucht {u} bis nach {q}. Wie schnell fährt der Zug im Mittel auf dieser langen Strecke?", ("Stunden", "Minuten")),
    ("In der Klasse von {p} sind {n} Kinder, die zusammen {u} gelaufen sind, davon {q} allein den dritten Teil. Wie weit kam jedes?", ("Kilometer", "Meilen")),
]


def test_contamination_recall_of_changed_questions(spark):
    """Numbers, units and names of each question are changed throughout: at least 0.9 are found; values that don't stand for one another are no copy."""
    rng, names = random.Random(3), ["Paris", "Anna", "Tom", "Lyon", "Maria", "Berlin", "Juan", "Otto", "Vigo", "Claire"]
    fill = lambda text, units, k: (lambda p, q: text.format(p=p, q=q, n=rng.randrange(2, 90), u=f"{rng.randrange(100, 900)} {units[k]}"))(*rng.sample(names, 2))
    items = [(i, fill(t, u, 0)) for i, (t, u) in enumerate(TEMPLATES)]
    rows = [(100 * i + j, f"some words before it, then: {fill(t, u, j % 2)} And words that follow, among them {j}.") for i, (t, u) in enumerate(TEMPLATES) for j in range(20)]
    mixed = [(5000 + i, t.replace("{p}", "{q}", 1).format(p="Rome", q="Oslo", n=7, u=f"8 {u[0]}").replace("Rome", "Oslo")) for i, (t, u) in enumerate(TEMPLATES[:1])]  # two names become one
    got = {r["doc_id"]: list(r["items"]) for r in contamination(documents(spark, rows + mixed), spark.createDataFrame(items, "item_id long, text string")).collect()}
    found = sum(got[d] == [d // 100] for d, _ in rows)
    assert found >= 0.9 * len(rows), (found, len(rows), [x for d, x in rows if got[d] != [d // 100]][:5])
    assert all(set(got[d]) <= {d // 100} for d, _ in rows) and got[5000] == []

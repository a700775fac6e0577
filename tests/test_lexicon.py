import os

from pyspark.sql import functions as F

from lexloom.functions.forms import is_regular, moved_grades, plural_of, plural_stems, serialise, slot_forms, slot_label
from lexloom.functions.pos import normal_pos, pos_label, valid_pos
from lexloom.functions.text import display, meaning_key, qualified, repair_lines, segments, split_outside_brackets
from lexloom.operators import lexicon, roots, senses, views
from lexloom.operators.fragments import fragment_rows, meaning_items, unique_fragments
from lexloom.operators.quality import check_files, check_manifest, shard
from lexloom.sources.packs import read_pack, write_manifest, write_shards

ENTRY = '<div class="entry"><span class="pos">verb</span><ol><li class="sense"><deft><chn>行走</chn></deft></li></ol><table class="verb_forms_table"><tr form="past"><td><span class="vf_prefix">past</span> walked</td></tr></table></div>'


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def entries(spark, rows):
    return spark.createDataFrame([(w, p, e, i) for i, (w, p, e) in enumerate(rows)], "word string, pos string, exchange string, ord long")


def test_text(spark):
    assert one(spark, display(F.lit("（a），　b;c "))) == "(a), b；c"
    assert one(spark, meaning_key(F.lit("走(慢) ，路"))) == "走路"
    assert one(spark, split_outside_brackets(F.lit("a(b,c),d；e"))) == ["a(b,c)", "d", "e"]
    assert one(spark, qualified(F.lit("走"), F.lit("口语"))) == "(口语)走"
    assert one(spark, repair_lines(F.lit("long-\nword ,x\n\n y ( z"))) == "longword,x y (z"
    assert one(spark, segments(F.lit("One. Two. " + "x" * 30), 12)) == ["One. Two.", "x" * 12, "x" * 12, "x" * 6]


def test_pos(spark):
    assert one(spark, normal_pos(F.lit("noun, verb"))) == "n+v"
    assert one(spark, normal_pos(F.lit("modal verb"))) == "modal"
    assert one(spark, normal_pos(F.lit("???"))) is None
    assert one(spark, pos_label(F.lit("n+v"))) == "n. / v."
    assert one(spark, valid_pos(F.lit("n+xx"))) is False


def test_forms(spark):
    pairs = slot_forms(F.lit("p:(formal) went, gone/3:goes/p:went"))
    assert one(spark, serialise(pairs)) == "3:goes/p:went/p:gone"
    moved = moved_grades(slot_forms(F.lit("s:bigger/s:biggest/s:bigs")), F.lit("adj:100"), F.lit("big"))
    assert one(spark, serialise(moved)) == "s:bigs/c:bigger/sup:biggest"
    for word, plural in {"child": "children", "box": "boxes", "baby": "babies", "cliff": "clifves", "wife": "wives", "potato": "potatoes", "cat": "cats"}.items():
        assert one(spark, plural_of(F.lit(word))) == plural
    for base, form, slot, ok in [("run", "running", "i", True), ("go", "went", "p", False), ("happy", "happier", "c", True), ("love", "loved", "d", True), ("wolf", "wolves", "s", True)]:
        assert one(spark, is_regular(F.lit(base), F.lit(form), F.lit(slot))) is ok
    assert one(spark, slot_label(F.lit("v:100"), F.lit("s"))) == "第三人称单数"
    assert one(spark, plural_stems(F.lit("babies"))) == ["babie", "babi", "baby"]


def test_links(spark):
    link = lexicon.LINK
    raw = spark.createDataFrame([(0, "walk", "body"), (1, "walked", link + "walk"), (2, "w3", link + "walked"), (3, "a", link + "b"), (4, "b", link + "a"), (5, "c", link + "c"), (6, "d", link + "none"), (7, "w4", link + "w3"), (8, "w5", link + "w4"), (9, "walk", link + "x")], "ord long, key string, body string")
    assert {tuple(r) for r in lexicon.resolve_links(raw).collect()} == {("walked", "walk"), ("w3", "walk"), ("w4", "walk"), ("w5", "walk")}
    assert lexicon.build_lookup(raw).where("key = 'walk'").first()["body"] == "body"
    circle = lambda n, name: [(f"{name}{i}", f"{name}{(i + 1) % n}") for i in range(n)]
    pairs = [*circle(3, "x"), *circle(5, "y"), *circle(6, "z"), ("in", "tail"), ("tail", "y2"), *[(f"c{i}", f"c{i + 1}") for i in range(9)]]
    lookup = spark.createDataFrame([(k, link + t, True) for k, t in pairs] + [("c9", "end", False)], "key string, body string, is_link boolean")
    assert {tuple(r) for r in lexicon.resolve_chains(lookup).collect()} == {(f"c{i}", "c9") for i in range(9)}


def test_stripped_parents(spark):
    words = spark.createDataFrame([("walkings",), ("walking",), ("cats",), ("dog",)], "word string")
    got = lexicon.stripped_parents(words, spark.createDataFrame([("walking",), ("walk",), ("cat",)], "key string"))
    assert {tuple(r) for r in got.collect()} == {("walkings", "walking"), ("walking", "walk"), ("cats", "cat")}


def test_relations(spark):
    rows = lexicon.inflection_rows(entries(spark, [("leaf", "n:100", "s:leaves"), ("leave", "v:86/n:14", "3:leaves"), ("script", "n:83/v:17", "3:scripts")]))
    parents = {(r["form"], r["base"], r["label"]) for r in lexicon.parents_of(rows).collect()}
    assert {("leaves", "leaf", "复数"), ("leaves", "leave", "第三人称单数"), ("scripts", "script", "复数")} <= parents
    assert ("leaves", "leave", "复数") not in parents
    edges = {(r["owner"], r["label"], r["target"], r["source"]) for r in lexicon.edges_of(rows).collect()}
    assert ("leave", "复数", "leaves", "derived") in edges
    ent = entries(spark, [("go", "v:100", "3:goes/p:went/d:gone/i:going"), ("went", "v:100", ""), ("gone", "adj:100", "")])
    rows = lexicon.inflection_rows(ent)
    accepted = lexicon.accepted_parents(ent, lexicon.parents_of(rows))
    assert {(r["form"], r["base"]) for r in accepted.collect()} == {("went", "go"), ("gone", "go")}
    assert {(r["owner"], r["target"]) for r in lexicon.forward_edges(ent, accepted).collect()} == {("went", "gone"), ("went", "going"), ("gone", "going")}
    assert {r["form"] for r in lexicon.missing_targets(lexicon.edges_of(rows), ent).collect()} == {"goes", "going"}


def test_order_does_not_matter(spark):
    ent = entries(spark, [(f"w{i}", "n:100", f"s:x{i % 3}") for i in range(30)])
    one_way = sorted(map(tuple, lexicon.parents_of(lexicon.inflection_rows(ent.repartition(1))).collect()))
    assert one_way == sorted(map(tuple, lexicon.parents_of(lexicon.inflection_rows(ent.orderBy(F.rand(1)).repartition(7))).collect()))


def test_markup(spark):
    lookup = spark.createDataFrame([("walk", ENTRY, 0), ("none", None, 1)], "key string, body string, ord long")
    r = senses.normalise_entries(lookup).collect()
    assert [(x["word"], x["translation"], x["pos"], x["exchange"]) for x in r] == [("walk", "v. 行走", "v:100", "p:walked")]
    more = '<div class="entry"><span class="pos">noun</span><span class="phons_br"><a class="sound" href="sound://w.mp3"></a><span class="phon">/w/</span></span><li class="sense" cefr="b1"><span class="labels"><span class="lb">old-fashioned</span></span><span class="grammar">[countable]</span><deft><chn>甲，乙</chn></deft></li><div class="idioms"><div class="idm-g"><span class="idm">a|b</span></div></div><div class="wordfamily">Word Family <span class="p"><b class="wfw">walker</b><i class="wfp">noun</i></span></div></div>'
    other = '<div class="entry"><span class="pos">verb</span><div class="xrefs" xt="ptof"><span class="xh">see</span></div></div>'
    got = {x["word"]: x for x in senses.normalise_entries(spark.createDataFrame([("a", more, 0), ("b", other, 1)], "key string, body string, ord long")).collect()}
    assert got["a"]["translation"] == "n. 甲,乙 [老式用法]" and got["a"]["phonetic"] == "w" and [tuple(f) for f in got["a"]["family"]] == [("walker", "noun")]
    assert got["b"]["translation"] == "v. see 的过去式"
    wide = senses.wide_rows(spark.createDataFrame([("a", more, 0)], "key string, body string, ord long")).first()
    assert (wide["tag"], wide["oxford"], wide["audio"], wide["idioms"]) == ("b1", 0, "w.mp3", "a | b")


def test_fragments(spark):
    got = one(spark, unique_fragments(F.lit("走,走(路),跑(一二三四五六七八)；跳")))
    assert [x["text"] for x in got] == ["走", "跑", "跳"]
    kind = "array<struct<text:string,qualifier:string,countability:string>>"
    df = spark.createDataFrame([([("a", "", "countable"), ("b,c", "", None), ("a,d", "口", "both")],), ([("x,y", "q", None)],)], f"records {kind}")
    rows = [[tuple(i) for i in r["items"]] for r in meaning_items(df, "records").collect()]
    assert rows == [[("a,b", "countable"), ("c", None), ("(口)d", "both")], [("(q)x,y", None)]]


def test_roots(spark):
    df = spark.createDataFrame([("adult", [("adul-", ""), ("-t", "")], "adul + t"), ("act", [("act", "做")], "act")], "word string, roots array<struct<root:string,meaning:string>>, breakdown string")
    got = {r["word"]: r["breakdown"] for r in roots.refine(df).collect()}
    assert got["act"] == "act" and got["adult"].startswith("ad-（加强）")
    m = roots.match_components(spark.createDataFrame([("port-",), ("portable",), ("po",), ("water",)], "component string"), spark.createDataFrame([("port", "carry", 1), ("por", "p", 0)], "root string, meaning string, ord int"))
    assert {r["component"]: r["meaning"] for r in m.collect()} == {"port-": "carry", "portable": "p", "po": "", "water": ""}


def test_views(spark):
    assert one(spark, views.route(F.lit("a b"), F.lit("en"))) == "text"
    q = spark.createDataFrame([(1, "Walk"), (2, "zz")], "query_id long, text string")
    got = views.lookup(q, spark.createDataFrame([("walk", "m")], "word string, meaning string"), spark.createDataFrame([("zz", "s"), ("walk", "t")], "word string, meaning string"))
    assert {tuple(r) for r in got.collect()} == {(1, "walk", "primary", "m"), (2, "zz", "secondary", "s")}
    assert [tuple(x) for x in one(spark, views.parse_parts(F.lit("n. a\nb")))] == [("n.", "a"), ("释义", "b")]


def test_packs(spark, tmp_path):
    df = spark.createDataFrame([("walk", "", "走", "v", ""), ("#x", "", "y", "", "")], "word string, phonetic string, translation string, pos string, exchange string")
    write_shards(df, f"{tmp_path}/shards", "letter")
    m = write_manifest(spark, f"{tmp_path}/manifest", f"{tmp_path}/shards", "ecd", {"entryCount": 2, "danglingNavigableTargets": 0})
    assert all(r["ok"] for r in check_manifest(m, "ecd").collect())
    assert not all(r["ok"] for r in check_manifest(m, "other").collect())
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{tmp_path}/shards")
    assert all(r["exists"] and r["size_ok"] and r["sha_ok"] for r in check_files(m, listing).collect())
    assert {r["word"] for r in read_pack(spark, str(tmp_path), "ecd").where("shard = 'w'").collect()} == {"walk"}
    assert read_pack(spark, f"{tmp_path}/nowhere", "ecd").isEmpty()
    assert [one(spark, shard(F.lit(w))) for w in ("walk", "#t", "ς", "")] == ["w", "#", "σ", "_"]


def test_final_entries(spark):
    from lexloom.operators.relate import dangling, final_entries

    rows = [("walk", "v:67/n:33", "v. 行走\nn. 步行", "3:walks/p:walked/d:walked/i:walking"), ("go", "v:100", "v. 去", "p:went/d:gone"), ("went", "v:100", "v. x", ""), ("leaf", "n:100", "n. 叶", "s:leaves"), ("leave", "v:86/n:14", "v. 离开\nn. 假", "3:leaves"), ("found", "v:100", "v. 建立", ""), ("find", "v:100", "v. 找", "p:found")]
    entries_ = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "word string, pos string, translation string, exchange string, ord long")
    links = spark.createDataFrame([("walking", "walk", 0), ("Walked", "walk", 1), ("leaves", "leaf", 2), ("wlk", "walk", 3), ("none", "nowhere", 4), ("go", "walk", 5)], "word string, target string, ord long")
    got = {r["word"]: r for r in final_entries(entries_.repartition(3), links).collect()}
    assert dangling(final_entries(entries_, links)).isEmpty()
    walk = [(r["type"], r["label"], r["target"]) for r in got["walk"]["relations"]]
    assert walk[:4] == [("inflection", "第三人称单数", "walks"), ("inflection", "过去式", "walked"), ("inflection", "过去分词", "walked"), ("inflection", "现在分词", "walking")]
    assert got["walking"]["entry_kind"] == "inflection" and got["walking"]["translation"] == "v. 行走" and got["walking"]["exchange"] == "i:walking"
    assert got["Walked"]["pos"] == "v:67" and [(r["label"], r["primary"]) for r in got["Walked"]["relations"]] == [("过去式", True), ("过去分词", None)]
    assert {(r["target"], r["label"]) for r in got["leaves"]["relations"]} == {("leaf", "复数"), ("leave", "第三人称单数")} and got["leaves"]["display_word"] == "leaf"
    assert got["wlk"]["entry_kind"] == "alias" and got["wlk"]["relations"] == [] and got["wlk"]["linked_word"] == "walk"
    assert got["went"]["relations"][0]["type"] == "origin" and got["went"]["relations"][1]["target"] == "gone"
    assert [(r["type"], r["target"]) for r in got["found"]["relations"]] == [("xref", "find")]
    assert got["gone"]["entry_kind"] == "inflection" and got["gone"]["linked_word"] == "go" and "none" not in got


def test_results(spark):
    from lexloom.functions.forms import moved_grades_at_lookup
    from lexloom.operators import etymology, results

    answers = spark.createDataFrame([(1, '{"ec":{"word":[{"ukphone":"/wɔːk/","trs":[{"pos":"v.","tran":"走"},{"tr":[{"l":{"i":["步","行"]}}]}]}]}}'), (2, '{"ee":{"word":{"phone":"x","trs":[{"pos":"n.","tr":[{"tran":"a walk"}]}]}}}'), (3, "{}"), (4, None)], "query_id long, body string")
    rows = [tuple(r) for r in results.provider_rows(answers).orderBy("query_id", "i").collect()]
    assert rows == [(1, "wɔːk", "v.", "走", 0), (1, "wɔːk", "释义", "步行", 1), (2, "x", "n.", "a walk", 0)]
    assert one(spark, results.without_variants(F.array(*map(F.lit, ["travelled", "Traveled", "labelling"])))) == ["Traveled", "labelling"]
    assert one(spark, results.language_code(F.lit("zh-Hant"))) == "zh-CHS"
    assert one(spark, serialise(moved_grades_at_lookup(slot_forms(F.lit("s:bigger/s:biggest/s:bigs")), F.lit("adj:100")))) == "s:bigs/c:bigger/sup:biggest"
    assert [tuple(x) for x in one(spark, etymology.quoted_glosses(F.lit('from L. portare "carry", see "x", port "gate"')))] == [("portare", "carry"), ("port", "gate")]
    assert one(spark, etymology.described_meaning(F.lit("= short, 表示“短，缩短”"))) == "短，缩短"
    kind = "array<struct<type:string,target:string,label:string,direction:string>>"
    asked = spark.createDataFrame([(1, "inflection", "", [("origin", "leave", "第三人称单数", "outgoing"), ("origin", "leaf", "复数", "outgoing")])], f"query_id long, entry_kind string, translation string, relations {kind}")
    sources = spark.createDataFrame([("leaf", [("n.", "叶", "countable"), ("n.", "水", "uncountable"), ("v.", "翻", None)]), ("leave", [("v.", "离开", None)])], "word string, details array<struct<pos:string,text:string,countability:string>>")
    got = [(r["part"], r["meanings"]) for r in results.grouped_source_parts(asked, sources).orderBy("i").collect()]
    assert got == [("[leaf 的复数]", ["叶"]), ("[leave 的第三人称单数]", ["离开"])]


def test_cleared_stages(spark, monkeypatch):
    from lexloom.operators import stages

    held = stages.settle(spark.range(3), "some")
    kept = held.inputFiles()[0].replace("file:", "")
    root = stages.shared_root(spark)
    monkeypatch.setattr(stages, "shared_root", lambda spark: root + "/other")  # tables of other tests stay
    path = stages.settle(spark.range(2), "none").inputFiles()[0].replace("file:", "")
    stages.clear_stages(spark)
    assert not os.path.exists(path) and os.path.exists(kept)


def test_fragment_rows_equal_the_array_form(spark):
    import random

    from lexloom.operators.fragments import fragment_rows

    rng = random.Random(3)
    bits = ["走", "跑步", "(路)", "（一二三四五六七八）", "（一二三四五六七）", ",", "，", ";", "；", " ", "(", ")", "a", ",走", "（x,y）", "［z］"]
    lines = [(i, i % 3, "".join(rng.choices(bits, k=rng.randint(0, 14)))) for i in range(400)] + [(900, 0, None), (901, 0, "走,走（一二三四五六七八）"), (902, 0, "走（一二三四五六七八）"), (903, 0, "（一二三四五六七八）走,跑")]
    df = spark.createDataFrame(lines, "a int, b int, line string").repartition(3)
    want = {(r["a"], x["key"], x["text"]) for r in df.select("a", unique_fragments(F.col("line")).alias("f")).collect() for x in r["f"] or []}
    rows = fragment_rows(df, ["a", "b"], "line").collect()
    assert {(r["a"], r["key"], r["text"]) for r in rows} == want and len(rows) == len(want)
    assert [r["text"] for r in rows if r["a"] == 901] == ["走"] and [r["text"] for r in rows if r["a"] == 902] == ["走"]
    plan = fragment_rows(df, ["a", "b"], "line").groupBy("a", "b").agg(F.count("*"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(a") == 1


def test_fragment_rows_reads_each_line_once(spark):
    lines = ["a(b,c),d；e)f;;g（h，i), a", "x (一二三四五六七八),x;　y\t z ", "(((,),)),q,", "", "p，(q", "😀(,)😀,k"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, line string")
    rows = fragment_rows(df, ["i"], "line")
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("aggregate(") == 1 and plan.count("posexplode") == 1
    told = {r["i"]: [tuple(f) for f in r["f"]] for r in df.select("i", unique_fragments(F.col("line")).alias("f")).collect()}
    got = {i: [] for i in told}
    for r in sorted(rows.collect(), key=lambda r: (r["i"], r["place"])):
        got[r["i"]].append((r["text"], r["key"]))
    assert got == told and got[0] == [("a(b,c)", "a"), ("d", "d"), ("e)f", "e)f"), ("g(h,i)", "g")] and got[5] == [("😀(,)😀", "😀😀"), ("k", "k")]

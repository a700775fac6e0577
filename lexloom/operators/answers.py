"""What a lookup shows: relations whose targets exist, word forms of a view, its word family, its roots line, the whole result.

An entry row is (word, ord, entry_kind, pos, translation, exchange, display_word, linked_word, phonetic, phonetic_us,
verb_forms, phrasal_verbs, family, relations); every function takes the columns it names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions.fixed import LABEL_POS, SLOT_LABELS
from lexloom.functions.forms import moved_grades_at_lookup
from lexloom.functions.pos import family_pos, literal_map
from lexloom.functions.text import let, squeeze
from lexloom.operators import results
from lexloom.operators.views import LABEL_ORDER, distinct_by, expands_origins, parse_parts

# Plurals that an entry's own forms lack, labels of the verb table.
EXTRA_PLURALS = {"score": ["scores"]}
VERB_LABELS = {"thirdps": "第三人称单数", "past": "过去式", "pastpart": "过去分词", "ptpp": "过去分词", "prespart": "现在分词"}
# Fixed values of the roots line: summaries, whole lines, components, and what a component is shown as.
SUMMARIES = {
    "editorial": "编辑的；社论的",
    "apparent": "显而易见的",
    "provocative": "挑衅的；刺激的",
    "remittance": "汇款；汇款额",
    "admittance": "准许进入；入场",
    "arbitral": "仲裁的；裁决的",
    "adjudge": "判决；裁定",
    "coalescence": "合并；结合",
    "effervescent": "冒泡的；充满活力的",
}
LINES = {
    "effervescent": "ef-（出来，向外） + ferv-（=boil，沸腾） + -esce（=grow up，成长） + -ent（形容词后缀） → 冒泡的；充满活力的",
    "apparent": "ap（表加强） + par（=come in sight，看见） + -ent（形容词后缀） → 显而易见的",
    "coalescence": "co（一起） + al（生长） + -esce（=grow up，成长） + -ence（名词后缀） → 合并；结合",
    "arbitral": "arbitr-（判断） + -al（形容词后缀） → 仲裁的；裁决的",
    "adjudge": "ad（表加强） + judg-（判断） → 判决；裁定",
    "editorial": "editor（编辑） + -ial（形容词后缀） → 编辑的；社论的",
    "provocative": "pro（向前） + voc（=call，叫喊） + -ative（形容词后缀） → 挑衅的；刺激的",
    "remittance": "re（回；再） + mit（=send，送；释放） + -ance（名词后缀） → 汇款；汇款额",
    "admittance": "ad（表加强） + mit（=send，送；释放） + -ance（名词后缀） → 准许进入；入场",
}
COMPONENTS = {
    "editorial": ["editor", "ial"],
    "apparent": ["ap", "par", "ent"],
    "provocative": ["pro", "voc", "ative"],
    "remittance": ["re", "mit", "ance"],
    "admittance": ["ad", "mit", "ance"],
    "arbitral": ["arbitr", "al"],
    "adjudge": ["ad", "judg", "e"],
    "coalescence": ["co", "al", "esce", "nce"],
    "effervescent": ["ef", "ferv", "esce", "ent"],
}
SHOWN = {
    "ap": ("ap", "表加强"),
    "ad": ("ad", "表加强"),
    "re": ("re", "回；再"),
    "pro": ("pro", "向前"),
    "arbitr": ("arbitr-", "判断"),
    "arbit": ("arbit-", "判断"),
    "judg": ("judg-", "判断"),
    "judic": ("judic-", "判断"),
    "mit": ("mit", "=send，送；释放"),
    "editor": ("editor", "编辑"),
    "voc": ("voc", "=call，叫喊"),
    "ative": ("-ative", "形容词后缀"),
    "ial": ("-ial", "形容词后缀"),
    "par": ("par", "=come in sight，看见"),
    "pear": ("pear", "=come in sight，看见"),
    "co": ("co", "一起"),
    "al": ("al", "一起"),
    "esce": ("-esce", "=grow up，成长"),
    "esc": ("-esce", "=grow up，成长"),
    "ef": ("ef-", "出来，向外"),
    "ferv": ("ferv-", "=boil，沸腾"),
    "ent": ("-ent", "形容词后缀"),
    "nce": ("-ence", "名词后缀"),
    "ance": ("-ance", "名词后缀"),
    "e": ("e", "无实义"),
}
ITEM = "array<struct<word:string,label:string,pos_scope:array<string>>>"


def with_known_relations(entries: DataFrame) -> DataFrame:
    """The entries with only those relations that are navigable and whose target is an entry; order kept.  entries: word, relations and any more."""
    known = entries.select(F.lower("word").alias("__key")).distinct()
    each = entries.select(F.lower("word").alias("__word"), F.posexplode("relations").alias("__i", "__r")).where("__r.navigable").withColumn("__key", F.lower("__r.target"))
    kept = each.join(known, "__key", "left_semi").groupBy("__word").agg(F.transform(F.sort_array(F.collect_list(F.struct("__i", "__r"))), lambda x: x["__r"]).alias("__kept"))
    kind = entries.schema["relations"].dataType.simpleString()
    out = entries.join(kept, F.lower("word") == F.col("__word"), "left")
    return out.withColumn("relations", F.coalesce("__kept", F.array().cast(kind))).select(*entries.columns)


def _items(edges: Column) -> Column:
    scope = lambda r: F.coalesce(r["pos_scope"], F.element_at(literal_map(LABEL_POS), r["label"]), F.array().cast("array<string>"))
    return F.transform(edges, lambda r: F.struct(r["target"].alias("word"), r["label"].alias("label"), scope(r).alias("pos_scope")))


def _edges(relations: Column, kind: str) -> Column:
    return F.filter(F.coalesce(relations, F.array()), lambda r: (r["type"] == kind) & (r["direction"] == "outgoing"))


def child_items(relations: Column) -> Column:
    """Outgoing inflections that are shown among the word forms."""
    return _items(F.filter(_edges(relations, "inflection"), lambda r: r["display"] == "exchange"))


def xref_items(relations: Column) -> Column:
    return _items(_edges(relations, "xref"))


def origin_items(word: Column, relations: Column) -> Column:
    """Origins, cross-references with an inflection label, and bases of extra plurals; each word and label once."""
    forms = {f: base for base, plurals in EXTRA_PLURALS.items() for f in plurals}
    origins = _edges(relations, "origin")
    base = F.element_at(literal_map(forms), F.lower(word))
    extra = F.when(base.isNotNull() & ~F.exists(origins, lambda r: r["label"] == "复数"), F.array(F.struct(base.alias("word"), F.lit("复数").alias("label"), F.array(F.lit("n")).alias("pos_scope"))))
    told = F.filter(xref_items(relations), lambda r: r["label"].isin(*LABEL_POS))
    return distinct_by(F.concat(_items(origins), told, F.coalesce(extra, F.array().cast(ITEM))), lambda r: F.concat(r["word"], F.lit(":"), r["label"]))


def lookup_slots(exchange: Column) -> Column:
    """(slot, form) of an exchange string as it is, distinct; items without a slot or a form are skipped."""
    items = F.filter(F.split(F.coalesce(exchange, F.lit("")), "/"), lambda x: x.rlike(r"^[^:]+:\s*\S"))
    return F.array_distinct(F.transform(items, lambda x: F.struct(F.substring_index(x, ":", 1).alias("slot"), F.trim(F.regexp_replace(x, "^[^:]*:", "")).alias("form"))))


def clean_verb_form(word: Column) -> Column:
    """Without a bracketed note in front."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(word, F.lit("")), r"^\([^)]*\)\s*", ""), r"^（[^）]*）\s*", ""))


PAIRS = "array<struct<label:string,word:string>>"


def _pair(label: Column, word: Column) -> Column:
    return F.struct(label.alias("label"), word.alias("word"))


def word_forms(query_word: Column, is_fallback: Column, back: Column, entry: Column, children: Column) -> Column:
    """array of (name, words): the forms of a view in display order, merged from all its sources.

    back: struct (word, label) or null; children: array of (word, label); entry: struct of word, entry_kind, pos, exchange,
    verb_forms (array of form, word) and relations.  A fallback shows its way back only.
    """
    shown = let(origin_items(entry["word"], entry["relations"]), lambda origins: _shown_forms(query_word, back, entry, children, origins))
    alone = F.when(back.isNotNull(), F.array(F.struct(back["label"].alias("name"), F.array(back["word"]).alias("words"))))
    return F.when(is_fallback, F.coalesce(alone, F.array())).otherwise(shown)


def _shown_forms(query_word: Column, back: Column, entry: Column, children: Column, origins: Column) -> Column:
    none = F.array().cast(PAIRS)
    with_origin = F.size(origins) > 0
    home = F.when(back.isNotNull(), F.array(_pair(back["label"], back["word"]))).otherwise(none)
    own = lambda w: F.lower(w) == query_word
    below = F.transform(F.filter(F.coalesce(children, F.array()), lambda c: (F.coalesce(c["word"], F.lit("")) != "") & (F.coalesce(c["label"], F.lit("")) != "") & ~(with_origin & own(c["word"]))), lambda c: _pair(c["label"], c["word"]))
    skipped = lambda w: (with_origin & own(w)) | F.coalesce(F.lower(w) == F.lower(back["word"]), F.lit(False))
    verbs = F.transform(F.coalesce(entry["verb_forms"], F.array()), lambda v: _pair(F.element_at(literal_map(VERB_LABELS), v["form"]), clean_verb_form(v["word"])))
    verbs = F.when(entry["entry_kind"] == "standalone", F.filter(verbs, lambda v: v["label"].isNotNull() & (v["word"] != "") & ~skipped(v["word"]))).otherwise(none)
    extra = F.coalesce(F.element_at(literal_map(EXTRA_PLURALS), F.lower(entry["word"])), F.array().cast("array<string>"))

    def with_extra(slots: Column) -> Column:
        plurals = F.filter(slots, lambda p: p["slot"] == "s")
        lone = (F.size(plurals) == 1) & (F.lower(F.get(plurals, F.lit(0))["form"]) == F.lower(entry["word"]))
        return F.when(lone, F.concat(slots, F.transform(extra, lambda w: F.struct(F.lit("s").alias("slot"), w.alias("form"))))).otherwise(slots)

    slots = let(let(lookup_slots(entry["exchange"]), lambda x: moved_grades_at_lookup(x, entry["pos"])), with_extra)
    named = F.transform(slots, lambda p: _pair(F.element_at(literal_map(SLOT_LABELS), p["slot"]), p["form"]))
    named = F.filter(named, lambda p: p["label"].isNotNull() & ~skipped(p["word"]))
    xref = F.exists(xref_items(entry["relations"]), lambda r: r["label"].isin(*LABEL_POS))
    roots = F.when(expands_origins(entry["entry_kind"], origins, xref), F.transform(origins, lambda o: _pair(F.lit("原形"), o["word"]))).otherwise(none)
    every = distinct_by(F.concat(home, below, verbs, named, roots), lambda p: F.concat(p["label"], F.lit(":"), F.lower(p["word"])))

    def rows(items: Column) -> Column:
        one = lambda label: F.struct(label.alias("name"), results.without_variants(F.transform(F.filter(items, lambda p: p["label"] == label), lambda p: p["word"])).alias("words"))
        named_ = F.filter(F.transform(F.array(*map(F.lit, LABEL_ORDER)), one), lambda x: F.size(x["words"]) > 0)
        return F.filter(named_, lambda x: ~((entry["entry_kind"] == "inflection") & F.forall(x["words"], own)))

    ends = F.transform(xref_items(entry["relations"]), lambda r: F.struct(F.lit("原形").alias("name"), F.array(r["word"]).alias("words")))
    return F.array_distinct(F.concat(let(every, rows), ends))


def families(entries: DataFrame) -> DataFrame:
    """word, family (array of word, pos, relation): an entry's own family, else that of the first entry of its shard (first letter) that holds it; without the word itself.

    entries: word, ord, family (array of word, pos, relation).
    """
    shard = lambda c: F.substring(F.lower(c), 1, 1)
    held = entries.where(F.size("family") > 0).select(shard(F.col("word")).alias("shard"), "ord", "family", F.explode(F.array_distinct(F.transform("family", lambda m: F.lower(m["word"])))).alias("key"))
    first = held.withColumn("rn", F.row_number().over(Window.partitionBy("shard", "key").orderBy("ord"))).where("rn = 1").select("shard", "key", F.col("family").alias("given"))
    df = entries.select("word", "family", F.lower("word").alias("key"), shard(F.col("word")).alias("shard")).join(first, ["shard", "key"], "left")
    chosen = F.when(F.size("family") > 0, F.col("family")).otherwise(F.coalesce("given", F.array()))
    shown = F.filter(chosen, lambda m: (F.coalesce(m["word"], F.lit("")) != "") & (F.lower(m["word"]) != F.col("key")))
    relation = lambda m: F.coalesce(F.nullif(m["relation"], F.lit("")), F.lit("词族"))
    return df.select("word", F.transform(shown, lambda m: F.struct(m["word"].alias("word"), family_pos(m["pos"]).alias("pos"), relation(m).alias("relation"))).alias("family"))


def roots_lookup(words: DataFrame, main: DataFrame, supplement: DataFrame) -> DataFrame:
    """word, breakdown: of the main pack if it has one, else of the supplement.  words: word; packs: word, breakdown."""
    told = lambda df, name: df.where("breakdown <> ''").select(F.lower("word").alias("key"), F.col("breakdown").alias(name))
    df = words.select("word", F.lower("word").alias("key")).join(told(main, "first"), "key", "left").join(told(supplement, "second"), "key", "left")
    return df.select("word", F.coalesce("first", "second").alias("breakdown"))


def short_summary(word: Column, parts: Column, translation: Column) -> Column:
    """The fixed summary, else the first meaning of the parts (array of pos, meanings), else the first line that isn't blank; else empty."""
    lines = F.filter(F.split(F.coalesce(translation, F.lit("")), "\n"), lambda x: x.rlike(r"\S"))
    first = F.nullif(F.get(F.get(parts, F.lit(0))["meanings"], F.lit(0)), F.lit(""))
    return F.coalesce(F.element_at(literal_map(SUMMARIES), F.lower(word)), squeeze(first), squeeze(F.get(lines, F.lit(0))), F.lit(""))


def roots_line(word: Column, breakdown: Column, summary: Column) -> Column:
    """(name, value) or null: the fixed line, else the fixed components with their meanings, else the breakdown with the summary, else the summary."""
    low, line = F.lower(word), lambda name, value: F.struct(F.lit(name).alias("name"), value.alias("value"))
    tokens = F.element_at(literal_map(COMPONENTS), low)
    shown = {k: f"{a}（{b}）" if b else a for k, (a, b) in SHOWN.items()}
    bare = lambda t: F.regexp_replace(F.lower(t), "^-+|-+$", "")
    told = F.array_join(F.transform(tokens, lambda t: F.coalesce(F.element_at(literal_map(shown), bare(t)), t)), " + ")
    has, said = F.coalesce(breakdown, F.lit("")) != "", F.coalesce(summary, F.lit("")) != ""
    return (
        F.when(~has & ~said, None)
        .when(low.isin(*LINES), line("词根词缀", F.element_at(literal_map(LINES), low)))
        .when(tokens.isNotNull() & said, line("词根词缀", F.concat(told, F.lit(" → "), summary)))
        .when(has, line("词根拆解", F.when(said, F.concat(breakdown, F.lit(" → "), summary)).otherwise(breakdown)))
        .otherwise(line("词根拆解", summary))
    )


def has_visible_parts(parts: Column) -> Column:
    """A part of speech or a meaning that isn't blank.  parts: array of (part, means)."""
    return F.exists(parts, lambda p: (F.trim(p["part"]) != "") | F.exists(p["means"], lambda m: F.trim(m) != ""))


ENTRY = ["word", "entry_kind", "pos", "translation", "exchange", "phonetic", "phonetic_us", "verb_forms", "phrasal_verbs", "relations"]


def views_of(queries: DataFrame, entries: DataFrame) -> DataFrame:
    """query_id, query_word, exact, entry (structs), is_fallback, back, children.  An entry is shown under its display word unless its origins are expanded."""
    rows = with_known_relations(entries)
    whole = lambda name, key: rows.select(F.lower("word").alias(key), F.struct(*ENTRY, "display_word", "linked_word").alias(name))
    q = queries.select("query_id", F.lower(F.trim("text")).alias("query_word"))
    df = q.join(whole("exact", "query_word"), "query_word")
    df = df.withColumn("wanted", F.lower(F.coalesce("exact.display_word", "exact.linked_word", "exact.word"))).join(whole("shown", "wanted"), "wanted", "left")
    exact = F.col("exact")
    xref = F.exists(xref_items(exact["relations"]), lambda r: r["label"].isin(*LABEL_POS))
    stays = expands_origins(exact["entry_kind"], origin_items(exact["word"], exact["relations"]), xref)
    df = df.withColumn("entry", F.when(stays, exact).otherwise(F.coalesce("shown", exact)))
    df = df.withColumn("is_fallback", F.lower("entry.word") != F.lower("exact.word"))
    origins = _edges(exact["relations"], "origin")
    first = F.coalesce(F.get(F.filter(origins, lambda r: F.coalesce(r["primary"], F.lit(False))), F.lit(0)), F.get(origins, F.lit(0)))
    df = df.withColumn("back", F.when(first.isNotNull(), F.struct(first["target"].alias("word"), first["label"].alias("label"))))
    both = distinct_by(F.concat(child_items(exact["relations"]), child_items(F.col("entry.relations"))), lambda r: F.concat(r["word"], F.lit(":"), r["label"]))
    return df.select("query_id", "query_word", "exact", "entry", "is_fallback", "back", F.when(F.col("is_fallback"), F.array().cast(ITEM)).otherwise(both).alias("children"))


def primary_results(queries: DataFrame, entries: DataFrame) -> DataFrame:
    """query_id, word, phonetics, parts (part, means), exchanges (name, words), related (word, pos): the full result of every query that has an entry."""
    views = views_of(queries, entries)
    entry = F.col("entry")
    xref = F.exists(xref_items(entry["relations"]), lambda r: r["label"].isin(*LABEL_POS))
    expanded = expands_origins(entry["entry_kind"], origin_items(entry["word"], entry["relations"]), xref)
    views = views.withColumn("expanded", expanded)
    kind = "array<struct<type:string,target:string,label:string,direction:string>>"
    asked = views.where("expanded").select("query_id", entry["entry_kind"].alias("entry_kind"), entry["translation"].alias("translation"), F.transform(origin_items(entry["word"], entry["relations"]), lambda o: F.struct(F.lit("origin").alias("type"), o["word"].alias("target"), o["label"].alias("label"), F.lit("outgoing").alias("direction"))).cast(kind).alias("relations"))
    details = F.transform(parse_parts(F.col("translation")), lambda p: F.struct(p["pos"].alias("pos"), p["meaning"].alias("text"), F.lit(None).cast("string").alias("countability")))
    grouped = results.grouped_source_parts(asked, entries.select("word", details.alias("details")))
    grouped = grouped.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "part", "meanings"))), lambda x: F.struct(x["part"].alias("part"), x["meanings"].alias("means"))).alias("grouped"))
    parts = parse_parts(entry["translation"])
    scopes = F.array_distinct(F.flatten(F.transform(origin_items(F.col("exact.word"), F.col("exact.relations")), lambda o: o["pos_scope"])))
    plain = F.transform(F.when(F.col("is_fallback"), results.scoped_parts(parts, scopes)).otherwise(parts), lambda p: F.struct(p["pos"].alias("part"), F.array(p["meaning"]).alias("means")))
    shown = F.when(F.col("expanded"), F.coalesce("grouped", F.array())).otherwise(plain)
    gap = F.array(F.struct(F.lit(" ").alias("part"), F.array(F.lit("")).alias("means")))
    phrases = F.transform(results.phrase_parts(entry["phrasal_verbs"]), lambda p: F.struct(p["pos"].alias("part"), p["meanings"].alias("means")))
    some = ~F.col("is_fallback") & (entry["entry_kind"] == "standalone") & (F.size(phrases) > 0)
    with_phrases = F.when(F.coalesce(some, F.lit(False)), F.concat(shown, F.when(has_visible_parts(shown), gap).otherwise(F.slice(gap, 1, 0)), phrases)).otherwise(shown)
    sound = lambda name, c: F.struct(F.lit(name).alias("type"), c.alias("value"))
    phonetics = F.filter(F.array(sound("uk", entry["phonetic"]), sound("us", entry["phonetic_us"])), lambda p: F.coalesce(p["value"], F.lit("")) != "")
    forms = word_forms(F.col("query_word"), F.col("is_fallback"), F.col("back"), entry, F.col("children"))
    own = families(entries).select(F.lower("word").alias("key"), "family")
    df = views.join(grouped, "query_id", "left").join(own, F.lower("entry.word") == F.col("key"), "left")
    related = F.transform("family", lambda m: F.struct(m["word"].alias("word"), m["pos"].alias("pos")))
    return df.select("query_id", F.col("query_word").alias("word"), phonetics.alias("phonetics"), with_phrases.alias("parts"), forms.alias("exchanges"), related.alias("related"))

"""Final entries: standalone entries with their relations, entries for links, and entries for inflections that had none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions.fixed import PLURAL, PROTECTED, SLOT_LABELS
from lexloom.functions.forms import serialise, slot_forms, surface_plurals
from lexloom.functions.pos import allowed_pos, has_pos, literal_map, pos_scope
from lexloom.operators import lexicon
from lexloom.operators.stages import settle

EDGE = "struct<type:string,target:string,label:string,direction:string,navigable:boolean,display:string,source:string,pos_scope:array<string>,primary:boolean>"
OWN = ["pos", "translation", "exchange"]
#: What an entry may have beside these; the build carries along those that the given entries have.
WIDE = ["phonetic", "phonetic_us", "parts", "details", "verb_forms", "family", "phrasal_verbs"]
RELATED = ["entry_kind", "display_word", "linked_word", "relations"]
ROOT_LABEL = "原形"


def edge(kind: str, target: Column, label: Column, display: str = "exchange", source: Column | None = None, primary: Column | None = None) -> Column:
    """A relation; `primary` is null unless true."""
    told = F.lit("derived") if source is None else source
    first = F.lit(None).cast("boolean") if primary is None else F.when(primary, F.lit(True))
    return F.struct(
        F.lit(kind).alias("type"), target.alias("target"), label.alias("label"), F.lit("outgoing").alias("direction"), F.lit(True).alias("navigable"), F.lit(display).alias("display"), told.alias("source"), pos_scope(label).alias("pos_scope"), first.alias("primary")
    )


def carried(entries: DataFrame) -> list[str]:
    return [*OWN, *[c for c in WIDE if c in entries.columns]]


def narrowed(labels: Column, entry: dict[str, Column]) -> dict[str, Column]:
    """The entry's columns with only what the comma-joined labels allow; unknown labels change nothing.

    A line of the translation is judged by its first part of speech; lines without one go.  Parts and details go by their own
    part of speech, those left without meanings too, and details lose entries without text.  Sound, verb forms, family and
    phrasal verbs stay as they are.
    """
    allowed = allowed_pos(labels)
    known = F.size(allowed) > 0
    slots = F.transform(F.split(labels, ","), lambda x: F.element_at(literal_map({v: k for k, v in SLOT_LABELS.items()}), x))
    pos, translation, exchange = (entry[c] for c in OWN)
    cut = {
        "pos": F.array_join(F.filter(F.split(pos, "/"), lambda p: F.array_contains(allowed, F.substring_index(p, ":", 1))), "/"),
        "translation": F.array_join(F.filter(F.split(translation, "\n"), lambda x: F.array_contains(allowed, F.regexp_extract(x, r"^([a-z]+)\.\s*.+$", 1))), "\n"),
        "exchange": F.when(F.exists(slots, lambda s: s.isNull()), exchange).otherwise(serialise(F.filter(slot_forms(exchange), lambda p: F.array_contains(slots, p["slot"])))),
    }
    of = lambda p: F.array_contains(allowed, F.regexp_replace(F.coalesce(p["pos"], F.lit("")), r"\.+$", ""))
    if "parts" in entry:
        cut["parts"] = F.filter(entry["parts"], lambda p: of(p) & (F.size(p["meanings"]) > 0))
    if "details" in entry:
        told = F.filter(entry["details"], lambda p: of(p) & (F.size(p["details"]) > 0))
        cut["details"] = F.transform(told, lambda p: F.struct(p["pos"].alias("pos"), F.filter(p["details"], lambda d: F.coalesce(d["text"], F.lit("")) != "").alias("details")))
    return {name: F.when(known, cut[name]).otherwise(column) if name in cut else column for name, column in entry.items()}


def _without_phrases(columns: dict[str, Column]) -> dict[str, Column]:
    """An inflection carries no phrasal verbs (an alias does)."""
    return {name: F.slice(c, 1, 0) if name == "phrasal_verbs" else c for name, c in columns.items()}


def _words(entries: DataFrame, key: str, name: str) -> DataFrame:
    return entries.select(F.lower("word").alias(key), F.col("word").alias(name))


def standalone_relations(entries: DataFrame, edges: DataFrame, parents: DataFrame) -> DataFrame:
    """owner, relations in order: the origin if there is one parent and it is accepted; own inflections; forward links; an origin for each of several parents; cross-references of protected words."""
    accepted = settle(lexicon.accepted_parents(entries, parents), "accepted")
    ranked = lexicon.ranked_parents(parents).join(_words(entries, "base", "base_word"), "base")
    lone = ranked.where("n = 1").join(accepted.select("form", "base"), ["form", "base"], "left_semi")
    number = lambda x: F.lit(x).cast("long")
    place = lambda a, b=None, c=None, d=None: F.array(number(a), *[number(0) if x is None else x.cast("long") for x in (b, c, d)]).alias("place")
    first = lone.select(F.col("form").alias("owner"), place(0), edge("origin", F.col("base_word"), F.col("label"), primary=F.lit(True)).alias("edge"))
    own = edges.select("owner", place(1, F.col("phase"), F.col("ord"), F.col("seq")), edge("inflection", F.col("target"), F.col("label"), source=F.col("source")).alias("edge"))
    ahead = lexicon.forward_edges(entries, accepted).select("owner", place(2, F.col("seq")), edge("inflection", F.col("target"), F.col("label")).alias("edge"))
    several = ranked.where("n > 1").select(F.col("form").alias("owner"), place(3, F.col("place")), edge("origin", F.col("base_word"), F.col("label"), primary=F.col("primary")).alias("edge"))
    fixed = entries.sparkSession.createDataFrame([(w, b, x) for w, (b, x) in PROTECTED.items()], "owner string, base string, said string")
    told = fixed.select("owner", place(4), edge("xref", F.col("base"), F.col("said"), "reference", F.lit("protected")).alias("edge"))
    every = first.unionByName(own).unionByName(ahead).unionByName(several).unionByName(told)
    once = every.groupBy("owner", "edge").agg(F.min("place").alias("place"))
    return once.groupBy("owner").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "edge"))), lambda x: x["edge"]).alias("relations"))


def link_entries(links: DataFrame, entries: DataFrame, parents: DataFrame) -> DataFrame:
    """An entry for each resolved link whose word has none and whose target has one: an inflection of its parents, or an alias.  links: word, target (the first of equal lower-case words by `ord`)."""
    wide = carried(entries)
    known = entries.select(F.lower("word").alias("key"), F.struct("word", *wide).alias("target_entry"))
    first = links.groupBy(F.lower("word").alias("form")).agg(F.min_by(F.struct("word", "target"), "ord").alias("l"))
    first = first.join(known.select(F.col("key").alias("form")), "form", "left_anti").select("form", "l.word", F.lower("l.target").alias("key")).join(known, "key")
    named = lexicon.ranked_parents(parents).join(_words(entries, "base", "base_word"), "base", "left").withColumns({"own": F.col("base_word").isNotNull(), "shown": F.coalesce("base_word", "base")})
    listed = lexicon.listed_parents(named.select("form", "place", F.struct(F.col("shown").alias("word"), "own").alias("base"), "label")).withColumnRenamed("label", "labels")
    df = first.join(listed, "form", "left").withColumn("parents", F.coalesce("parents", F.array().cast("array<struct<place:int,base:struct<word:string,own:boolean>,label:string>>")))
    alone = df.where(F.size("parents") == 0).select(F.col("form").alias("word"))
    stems = lexicon.plural_parents(alone, entries).join(known.select(F.col("key").alias("parent"), F.col("target_entry").alias("plural_of")), "parent").select(F.col("word").alias("form"), "plural_of")
    df = df.join(stems, "form", "left")
    blocked = F.array_contains(surface_plurals(slot_forms(F.col("target_entry.exchange")), F.col("target_entry.pos"))["blocked"], F.col("form"))
    df = df.withColumn("blocked", F.coalesce(blocked, F.lit(False))).withColumn("count", F.size("parents"))
    head = F.when(F.col("count") > 0, F.col("parents")[0])
    parent = F.when(~F.col("blocked"), F.coalesce(head["base"]["word"], F.col("plural_of.word")))
    surface = (F.col("form") == F.concat(F.lower("target_entry.word"), F.lit("s"))) & ~has_pos(F.col("target_entry.pos"), "n", "v")
    shown = F.when(F.col("blocked"), F.col("word")).when(parent.isNull() & surface, F.col("word")).when(head.isNotNull() & head["base"]["own"], head["base"]["word"]).otherwise(F.coalesce("plural_of.word", "target_entry.word"))
    labels = F.when(F.col("count") > 1, F.col("labels")).otherwise(F.coalesce(head["label"], F.lit(PLURAL)))
    df = df.withColumns({"parent": parent, "shown": shown}).withColumn("label", F.when(F.col("parent").isNotNull(), labels)).withColumn("source", F.coalesce("plural_of", "target_entry"))
    each = F.transform("parents", lambda p: edge("origin", p["base"]["word"], p["label"], primary=p["place"] == 1))
    one = F.array(edge("origin", F.col("parent"), F.coalesce("label", F.lit(ROOT_LABEL)), primary=F.lit(True)))
    relations = F.when(F.col("count") > 1, each).when(F.col("parent").isNotNull(), one).otherwise(F.slice(one, 1, 0))
    cut = narrowed(F.coalesce("label", F.lit("")), {c: F.col("source")[c] for c in wide})
    bare = _without_phrases(cut)
    shown_columns = [F.when(F.col("parent").isNotNull(), bare[n]).otherwise(c).alias(n) if n == "phrasal_verbs" else c.alias(n) for n, c in cut.items()]
    return df.select("word", *shown_columns, F.when(F.col("parent").isNotNull(), "inflection").otherwise("alias").alias("entry_kind"), F.col("shown").alias("display_word"), F.col("target_entry.word").alias("linked_word"), relations.alias("relations"))


def materialised(standalone: DataFrame, known: DataFrame) -> DataFrame:
    """An inflection entry, cut from its owner, for each outgoing inflection without an entry; the first owner (by `ord`) wins."""
    wide = carried(standalone)
    each = standalone.select("ord", "word", *wide, F.posexplode("relations").alias("i", "r")).where("r.type = 'inflection' AND r.direction = 'outgoing'")
    each = each.withColumn("form", F.lower("r.target")).join(known.select(F.lower("word").alias("form")).distinct(), "form", "left_anti")
    first = each.groupBy("form").agg(F.min_by(F.struct("word", *wide, "r.target", "r.label"), F.struct("ord", "i")).alias("o")).select("o.*")
    cut = _without_phrases(narrowed(F.col("label"), {c: F.col(c) for c in wide}))
    origin = F.array(edge("origin", F.col("word"), F.col("label"), primary=F.lit(True)))
    return first.select(F.col("target").alias("word"), *[c.alias(n) for n, c in cut.items()], F.lit("inflection").alias("entry_kind"), F.col("word").alias("display_word"), F.col("word").alias("linked_word"), origin.alias("relations"))


def materialised_minimal(entries: DataFrame) -> DataFrame:
    """The least entry for each outgoing inflection of a standalone entry without an entry: its parent's sound and parts of speech, `X 的label` and the way back.  The first owner (by `ord`) wins."""
    known = entries.select(F.lower("word").alias("form")).distinct()
    each = entries.where("entry_kind = 'standalone'").select("ord", "word", "pos", "phonetic", "phonetic_us", F.posexplode("relations").alias("i", "r")).where("r.type = 'inflection' AND r.direction = 'outgoing'")
    each = each.withColumn("form", F.lower("r.target")).join(known, "form", "left_anti")
    first = each.groupBy("form").agg(F.min_by(F.struct("word", "pos", "phonetic", "phonetic_us", "r.target", "r.label"), F.struct("ord", "i")).alias("o")).select("o.*")
    empty = F.lit("")
    told = F.concat("word", F.lit(" 的"), F.coalesce("label", empty))
    return first.select(F.col("target").alias("word"), F.lit("inflection").alias("entry_kind"), F.coalesce("phonetic", empty).alias("phonetic"), F.coalesce("phonetic_us", empty).alias("phonetic_us"), told.alias("translation"), "pos", empty.alias("exchange"), F.col("word").alias("linked_word"), F.array(edge("origin", F.col("word"), F.lit(ROOT_LABEL), primary=F.lit(True))).alias("relations"))


def final_entries(entries: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """All entries with kind, display word and relations.  entries: word, pos, translation, exchange, ord and any of WIDE; links: word, target, ord."""
    wide = carried(entries)
    rows = settle(lexicon.inflection_rows(entries), "inflections")
    edges, parents = lexicon.edges_of(rows), settle(lexicon.parents_of(rows), "parents")
    told = standalone_relations(entries, edges, parents)
    none = F.array().cast(f"array<{EDGE}>")
    own = entries.join(told, F.lower("word") == F.col("owner"), "left").select("ord", "word", *wide, F.lit("standalone").alias("entry_kind"), F.col("word").alias("display_word"), F.lit(None).cast("string").alias("linked_word"), F.coalesce("relations", none).alias("relations"))
    own = settle(own, "standalone")
    columns = ["word", *wide, *RELATED]
    known, out = own.select("word"), own.select(*columns)
    if links is not None:
        linked = settle(link_entries(links, entries, parents), "link-entries")
        known, out = known.unionByName(linked.select("word")), out.unionByName(linked.select(*columns))
    return out.unionByName(materialised(own, known).select(*columns))


def dangling(entries: DataFrame) -> DataFrame:
    """word, target: navigable relations that lead to no entry."""
    known = entries.select(F.lower("word").alias("k")).distinct()
    return entries.select("word", F.explode("relations").alias("r")).where("r.navigable").select("word", F.col("r.target").alias("target"), F.lower("r.target").alias("k")).join(known, "k", "left_anti").drop("k")


def no_links(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "word string, target string, ord long")

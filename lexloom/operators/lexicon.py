"""Building the lexicon: lookup table, link resolution, inflection relations, derived entries.

Tables
    raw      ord, key, body              body is markup or `@@@LINK=target`
    lookup   key, body, ord, is_link
    entries  word, pos, exchange, ord    one row a lower-case word
    edges    owner, type, label, target, source, pos_scope, ord, seq
    parents  form, base, label, ord, seq

Every first-wins or last-wins rule has an explicit order column, so a result never depends on partitions.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions.fixed import IRREGULAR_COMPARATIVES, IRREGULAR_PLURALS, IRREGULAR_SUPERLATIVES, PLURAL, PROTECTED, SLOT_FAMILY, SLOTS
from lexloom.functions.forms import forms_of, is_regular, plural_of, plural_stems, slot_forms, slot_label, surface_plurals
from lexloom.functions.pos import has_pos, pos_scope
from lexloom.operators.stages import settle

LINK = "@@@LINK="


def is_link(body: Column) -> Column:
    return body.startswith(LINK)


def link_target(body: Column) -> Column:
    return F.trim(F.regexp_replace(body, f"^{LINK}", ""))


def _bodies(raw: DataFrame) -> DataFrame:
    """key, own, link: the first body that is no link and the last link, with their ord."""
    link = is_link(F.col("body"))
    return raw.groupBy("key").agg(
        F.min_by(F.when(~link, F.struct("body", "ord")), F.when(~link, F.col("ord"))).alias("own"),
        F.max_by(F.when(link, F.struct("body", "ord")), F.when(link, F.col("ord"))).alias("link"),
    )


def _chosen(bodies: DataFrame) -> DataFrame:
    chosen = F.coalesce("own", "link")
    return bodies.select("key", chosen["body"].alias("body"), chosen["ord"].alias("ord"), F.col("own").isNull().alias("is_link"))


def build_lookup(raw: DataFrame) -> DataFrame:
    """One body a key: the first that is no link, else the last link."""
    return _chosen(_bodies(raw))


def alias_targets(raw: DataFrame) -> DataFrame:
    """key, target: the target of the last link row of each key."""
    return raw.where(is_link(F.col("body"))).groupBy("key").agg(F.max_by(link_target(F.col("body")), "ord").alias("target"))


def resolve_chains(lookup: DataFrame) -> DataFrame:
    """key, target: the entry at the end of a chain of links; chains that end nowhere or lead into a circle are dropped.

    Pointers double each round: after round n every open key points 2^n links ahead.  On a chain with an end some key comes
    to its end in every round, so once the open keys get no fewer only those of circles are left.
    """
    own = lookup.where(~F.col("is_link")).select(F.col("key").alias("end"))
    hops = lookup.where("is_link").select("key", link_target(F.col("body")).alias("target"))
    hops = settle(hops.join(own, hops["target"] == own["end"], "left").select("key", "target", F.col("end").isNotNull().alias("ended")), "links")
    open_ = hops.where("NOT ended").count()
    while open_:
        ahead = hops.select(F.col("key").alias("mid"), F.col("target").alias("next"), F.col("ended").alias("over"))
        moved = hops.where("NOT ended").join(ahead, F.col("target") == F.col("mid")).select("key", F.col("next").alias("target"), F.col("over").alias("ended"))
        hops = settle(hops.where("ended").unionByName(moved), "links")
        left = hops.where("NOT ended").count()
        if left == open_:
            break
        open_ = left
    return hops.where("ended").select("key", "target")


def resolve_links(raw: DataFrame) -> DataFrame:
    """word, target: chains resolved; a key's last link, if it leads straight to an entry, comes before the chain's end."""
    bodies = settle(_bodies(raw), "lookup")
    lookup = _chosen(bodies)
    own = lookup.where(~F.col("is_link")).select(F.col("key").alias("target"))
    direct = bodies.where("link IS NOT NULL").select("key", link_target(F.col("link.body")).alias("target")).where("key <> target").join(own, "target", "left_semi")
    chain_ends = resolve_chains(lookup)
    both = chain_ends.join(direct.withColumnRenamed("target", "direct"), "key", "full_outer")
    return both.select(F.col("key").alias("word"), F.coalesce("direct", "target").alias("target"))


def _exploded(entries: DataFrame) -> DataFrame:
    """base, pos, ord, pairs, slot, form, seq (place in display order)."""
    order = F.create_map(*chain.from_iterable((F.lit(s), F.lit(i)) for i, s in enumerate(SLOTS)))
    df = entries.select(F.lower("word").alias("base"), "pos", "ord", slot_forms(F.col("exchange")).alias("pairs"))
    df = df.withColumn("surface", surface_plurals(F.col("pairs"), F.col("pos")))
    df = df.select("base", "pos", "ord", "pairs", "surface", F.posexplode("pairs").alias("i", "p"))
    slot = F.col("p.slot")
    return df.select("base", "pos", "ord", "pairs", "surface", slot.alias("slot"), F.col("p.form").alias("form"), (F.element_at(order, slot) * 1000 + F.col("i")).alias("seq")).where(F.col("seq").isNotNull())


def inflection_rows(entries: DataFrame) -> DataFrame:
    """base, form, label, source, phase, ord, seq: all inflections told by an entry or derived from it, in order of creation.

    phase 1: exchange slots and, for nouns with an unchanged plural, regular third-person forms as plurals; phase 2: plurals
    inferred for nouns that tell none (where the entries have `details`, not for those whose noun senses are all uncountable).
    """
    each = settle(_exploded(entries), "forms")
    free = ~F.array_contains("surface.blocked", F.lower("form"))
    told = each.where(free & ((F.col("slot") != "s") | F.col("surface.allowed")))
    told = told.select("base", "form", slot_label(F.col("pos"), F.col("slot")).alias("label"), F.lit("exchange").alias("source"), F.lit(1).alias("phase"), "ord", "seq").where("label IS NOT NULL")
    unchanged = F.exists(forms_of(F.col("pairs"), "s"), lambda f: F.lower(f) == F.col("base"))
    third = each.where((F.col("slot") == "3") & free & has_pos(F.col("pos"), "n") & unchanged & ~F.col("base").isin(*IRREGULAR_PLURALS))
    third = third.where((F.lower("form") != F.col("base")) & is_regular(F.col("base"), F.lower("form"), F.lit("s")))
    third = third.select("base", "form", F.lit(PLURAL).alias("label"), F.lit("derived").alias("source"), F.lit(1).alias("phase"), "ord", (F.col("seq") + 100_000).alias("seq"))
    pairs = slot_forms(F.col("exchange"))
    silent = entries.where(has_pos(F.col("pos"), "n") & (F.size(forms_of(pairs, "s")) == 0))
    if "details" in entries.columns:
        senses = F.flatten(F.transform(F.filter(F.coalesce("details", F.array()), lambda p: p["pos"] == "n."), lambda p: p["details"]))
        silent = silent.where(~F.coalesce((F.size(senses) > 0) & F.forall(senses, lambda d: F.coalesce(d["countability"], F.lit("")) == "uncountable"), F.lit(False)))
    guessed = silent.select(F.lower("word").alias("base"), plural_of(F.col("word")).alias("form"), F.lit(PLURAL).alias("label"), F.lit("derived").alias("source"), F.lit(2).alias("phase"), "ord", F.lit(0).alias("seq"))
    return told.unionByName(third).unionByName(guessed.where("form IS NOT NULL AND form <> base"))


def blocked_forms(entries: DataFrame) -> DataFrame:
    """base, forms: lower-case forms in slot s that are no plurals, in order, of the entries that have some."""
    pairs = slot_forms(F.col("exchange"))
    each = entries.select(F.lower("word").alias("base"), F.explode(surface_plurals(pairs, F.col("pos"))["blocked"]).alias("form"))
    return each.groupBy("base").agg(F.sort_array(F.collect_set("form")).alias("forms"))


def edges_of(rows: DataFrame) -> DataFrame:
    """One edge for each (owner, label, target); a later equal edge takes the place of an earlier one."""
    kept = rows.groupBy("base", "label", "form").agg(F.max(F.struct("phase", "ord", "seq", "source")).alias("last"))
    return kept.select(F.col("base").alias("owner"), F.lit("inflection").alias("type"), "label", F.col("form").alias("target"), "last.source", pos_scope(F.col("label")).alias("pos_scope"), "last.phase", "last.ord", "last.seq")


def parents_of(rows: DataFrame) -> DataFrame:
    """form, base, label: told parents always; a derived one only if no earlier row has its form and label."""
    own = rows.where(F.lower("form") != F.col("base")).withColumn("form", F.lower("form"))
    first = Window.partitionBy("form", "label").orderBy("phase", "ord", "seq")
    kept = own.withColumn("rn", F.row_number().over(first)).where("source = 'exchange' OR rn = 1")
    return kept.groupBy("form", "base", "label").agg(F.min(F.struct("phase", "ord", "seq")).alias("o")).select("form", "base", "label", "o.phase", "o.ord", "o.seq")


def ranked_parents(parents: DataFrame) -> DataFrame:
    """With `place` (from 1), `primary` and `n` (parents of the form)."""
    w = Window.partitionBy("form").orderBy("phase", "ord", "seq")
    return parents.withColumns({"place": F.row_number().over(w), "n": F.count("*").over(Window.partitionBy("form"))}).withColumn("primary", F.col("place") == 1)


def listed_parents(ranked: DataFrame) -> DataFrame:
    """form, parents (array of place, base, label in order), label (theirs, comma-joined) of every form.  ranked: form, base, label, place."""
    listed = ranked.groupBy("form").agg(F.sort_array(F.collect_list(F.struct("place", "base", "label"))).alias("parents"))
    return listed.withColumn("label", F.array_join("parents.label", ","))


def accepted_parents(entries: DataFrame, parents: DataFrame) -> DataFrame:
    """form, base, label, slot: first parents whose form is an irregular form of an entry and no protected homograph."""
    first = ranked_parents(parents).where("primary").select("form", "base", "label")
    words = entries.select(F.lower("word").alias("form"))
    each = _exploded(entries).groupBy("base", F.lower("form").alias("form")).agg(F.min_by("slot", "seq").alias("slot"))
    found = first.join(words, "form", "left_semi").join(each, ["base", "form"])
    return found.where(~F.col("form").isin(*PROTECTED) & ~is_regular(F.col("base"), F.col("form"), F.col("slot"))).select("form", "base", "label", "slot")


def forward_edges(entries: DataFrame, accepted: DataFrame) -> DataFrame:
    """owner, target, label: from an irregular form to the later slots of the same family of its base."""
    order = F.create_map(*chain.from_iterable((F.lit(s), F.lit(i)) for i, s in enumerate(SLOTS)))
    family = F.create_map(*chain.from_iterable((F.lit(s), F.lit(f)) for s, f in SLOT_FAMILY.items()))
    each = _exploded(entries).select("base", "pos", F.col("slot").alias("to_slot"), F.col("form").alias("target"), "seq")
    both = _exploded(entries).where(F.col("slot").isin("p", "d")).groupBy("base", F.lower("form").alias("form")).agg(F.count_distinct("slot").alias("kinds")).where("kinds = 2")
    start = accepted.join(both, ["base", "form"], "left_anti").unionByName(accepted.join(both, ["base", "form"], "left_semi").where(~F.col("slot").isin("p", "d")))
    met = start.drop("label").join(each, "base").where((F.element_at(order, F.col("to_slot")) > F.element_at(order, F.col("slot"))) & (F.element_at(family, F.col("to_slot")) == F.element_at(family, F.col("slot"))))
    odd = [*IRREGULAR_COMPARATIVES, *IRREGULAR_SUPERLATIVES]
    linked = ~F.col("slot").isin("c", "sup") | (F.col("form").isin(*odd) == F.lower("target").isin(*odd))
    met = met.where((F.lower("target") != F.col("form")) & linked)
    return met.select(F.col("form").alias("owner"), "target", slot_label(F.col("pos"), F.col("to_slot")).alias("label"), "seq").where("label IS NOT NULL")


def plural_parents(words: DataFrame, nouns: DataFrame) -> DataFrame:
    """word, parent: the first of the word's stems that is a noun entry.  words: word; nouns: word, pos."""
    each = words.select("word", F.posexplode(plural_stems(F.col("word"))).alias("i", "stem"))
    known = nouns.where(has_pos(F.col("pos"), "n")).select(F.lower("word").alias("stem")).distinct()
    return each.join(known, "stem").groupBy("word").agg(F.min_by("stem", "i").alias("parent"))


def missing_targets(edges: DataFrame, entries: DataFrame) -> DataFrame:
    """form, owner, label: edge targets without an entry, each with its first edge."""
    known = entries.select(F.lower("word").alias("form")).distinct()
    wanted = edges.withColumn("form", F.lower("target")).join(known, "form", "left_anti")
    return wanted.groupBy("form").agg(F.min_by(F.struct("owner", "label"), F.struct("ord", "phase", "seq", "target")).alias("o")).select("form", "o.owner", "o.label")


def propagate_families(entries: DataFrame) -> DataFrame:
    """The entries; a word without a family takes that of the first owner (by `ord`) that lists it.  entries: word, ord, family (array of structs with `word`) and any more."""
    owners = entries.where("size(family) > 0").select(F.col("family").alias("__given"), F.col("ord").alias("__ord"), F.explode("family.word").alias("__member"))
    first = owners.groupBy(F.lower("__member").alias("__k")).agg(F.min_by("__given", "__ord").alias("__given"))
    family = F.when(F.size("family") > 0, F.col("family")).otherwise(F.coalesce("__given", "family"))
    return entries.join(first, F.lower("word") == F.col("__k"), "left").withColumn("family", family).select(*entries.columns)


def stripped_parents(words: DataFrame, keys: DataFrame) -> DataFrame:
    """word, parent: the word without the s of -ings, without -ing or without -s, the first that is a key.  words: word; keys: key."""
    cut = lambda n: F.substring(F.col("word"), F.lit(1), F.length("word") - n)
    tries = F.array_compact(F.array(*[F.when(F.col("word").endswith(end), cut(n)) for end, n in (("ings", 1), ("ing", 3), ("s", 1))]))
    each = words.select("word", F.posexplode(tries).alias("i", "key"))
    return each.join(keys.select("key").distinct(), "key").groupBy("word").agg(F.min_by("key", "i").alias("parent"))

"""The whole build as one graph of stage tables: raw rows, lookup table, normalised entries, relations, final entries.

Every stage is settled, so a stage that two later ones read is computed once and a lost executor repeats none before it.
Nothing is collected; keys meet in joins only, so a build grows with its rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.operators import lexicon, relate, senses
from lexloom.operators.stages import settle

PHRASES = "array<struct<name:string,translation:string>>"


def normalised(lookup: DataFrame, entry_class: str = "entry") -> DataFrame:
    """Entries of the lookup table's bodies with all their columns: families handed on, phrasal verbs with their translations.  Keys without meanings, or with a null body, have none."""
    rows = settle(senses.normalise_entries(lookup.where("NOT is_link").select("key", "body", "ord"), entry_class), "normalised")
    phrases = senses.phrasal_verbs(rows.select("word", "phrasal_names", "translation"))
    known = rows.drop("phrasal_names").join(phrases, "word", "left").withColumn("phrasal_verbs", F.coalesce("phrasal_verbs", F.array().cast(PHRASES)))
    kin = F.transform("family", lambda m: F.struct(m["word"].alias("word"), m["pos"].alias("pos"), F.lit("").alias("relation")))  # the markup names no relation
    return settle(lexicon.propagate_families(known.withColumn("family", kin)), "entries")


def build(raw: DataFrame, entry_class: str = "entry") -> DataFrame:
    """Final entries (word, relate.OWN, relate.WIDE, relate.RELATED) of raw rows (ord, key, body)."""
    lookup = settle(lexicon.build_lookup(raw), "lookup")
    links = settle(lexicon.resolve_links(raw).join(lookup.select(F.col("key").alias("word"), "ord"), "word"), "resolved")
    return relate.final_entries(normalised(lookup, entry_class), links)

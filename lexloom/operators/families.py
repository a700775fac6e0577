"""Word families by affix.  Families are kept as memberships (word, stem): pairs inside a family are never written out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.operators.stages import settle

# Derivational affixes.
SUFFIXES = [
    "ness", "nesses", "ment", "ments", "tion", "tions", "sion", "sions", "ity", "ities", "er", "ers", "or", "ors", "ist", "ists",
    "ism", "isms", "ful", "less", "ous", "ious", "ive", "able", "ible", "al", "ic", "ly", "y", "ize", "ise", "en",
    "ify", "th", "dom", "ship", "hood", "age",
]
PREFIXES = [
    "un", "re", "dis", "over", "under", "mis", "out", "pre", "post",
]
MORE_PREFIXES = [
    "un", "re", "dis", "over", "under", "mis", "out", "pre", "post", "de", "in", "im", "il", "ir", "non", "anti",
    "counter", "sub", "super", "inter", "trans", "pro", "con",
]
MORE_SUFFIXES = [
    "tion", "tions", "sion", "sions", "ment", "ments", "ness", "nesses", "ity", "ities", "er", "ers", "or", "ors", "ist", "ists",
    "ism", "isms", "age", "dom", "ship", "hood", "th", "ive", "ous", "ious", "ful", "less", "able", "ible", "al", "ic",
    "y", "ly", "en", "ize", "ise", "ify",
]


def stems(word: Column) -> Column:
    """Stems left by taking off one known suffix or prefix, if more than two letters remain."""
    w = F.lower(word)
    cut_end = lambda s: F.when(w.endswith(s) & (F.length(w) > len(s) + 2), F.substring(w, F.lit(1), F.length(w) - len(s)))
    cut_head = lambda p: F.when(w.startswith(p) & (F.length(w) > len(p) + 2), F.substring(w, F.lit(len(p) + 1), F.length(w)))
    return F.array_distinct(F.array_compact(F.array(*map(cut_end, SUFFIXES), *map(cut_head, PREFIXES))))


def root_of(word: Column) -> Column:
    """One root: longest prefix off, then longest suffix, then spelling put right."""
    w = F.lower(word)
    heads = "|".join(sorted(MORE_PREFIXES, key=len, reverse=True))
    tails = "|".join(sorted(MORE_SUFFIXES, key=len, reverse=True))
    rest = F.regexp_replace(w, rf"^(?:{heads})(?=.{{3,}}$)", "")
    rest = F.regexp_replace(rest, rf"(?<=^.{{3,200}}?)(?:{tails})$", "")
    return F.when(rest.endswith("id"), F.regexp_replace(rest, "id$", "is")).when(rest.endswith("ed"), F.regexp_replace(rest, "ed$", "e")).when(rest.endswith("ing"), F.regexp_replace(rest, "ing$", "e")).otherwise(rest)


def primary_pos(summary: Column) -> Column:
    """The first part of speech of n:50/v:50."""
    return F.substring_index(F.coalesce(summary, F.lit("")), ":", 1)


def stem_groups(words: DataFrame) -> DataFrame:
    """stem, n, first: stems of at least two words."""
    each = words.select("word", F.explode(stems(F.col("word"))).alias("stem"))
    return each.groupBy("stem").agg(F.count_distinct("word").alias("n"), F.min("word").alias("first")).where("n > 1")


def family_members(words: DataFrame) -> DataFrame:
    """word, stem, n: membership in the stem groups."""
    each = words.select("word", F.explode(stems(F.col("word"))).alias("stem")).distinct()
    return each.join(stem_groups(words), "stem").select("word", "stem", "n")


def root_groups(words: DataFrame) -> DataFrame:
    """root, n, first: roots of at least two words."""
    return words.select("word", root_of(F.col("word")).alias("root")).groupBy("root").agg(F.count_distinct("word").alias("n"), F.min("word").alias("first")).where("n > 1")


def family_edges(words: DataFrame, existing: DataFrame) -> DataFrame:
    """owner, target: each word with the first word of its stem group, unless that edge is there (a star spans the family; all pairs follow from membership)."""
    words = settle(words.select("word"), "family-words")
    star = family_members(words).join(stem_groups(words).select("stem", "first"), "stem").where("word <> first").select(F.col("first").alias("owner"), F.col("word").alias("target")).distinct()
    return star.join(existing.select("owner", "target"), ["owner", "target"], "left_anti")


def reverse_family(queries: DataFrame, families: DataFrame) -> DataFrame:
    """word, owner: the first entry of the same first letter whose family holds the word.  families: owner, ord, member."""
    met = queries.select("word", F.substring(F.lower("word"), 1, 1).alias("shard")).join(families.select(F.col("member").alias("word"), "owner", "ord", F.substring(F.lower("owner"), 1, 1).alias("shard")), ["word", "shard"])
    return met.where("owner <> word").groupBy("word").agg(F.min_by("owner", F.struct("ord", "owner")).alias("owner"))


def ranked(rows: DataFrame, key: str, *order: str) -> DataFrame:
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy(key).orderBy(*order)))

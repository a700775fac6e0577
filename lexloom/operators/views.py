"""Answering batches of lookups: provider cascade, entry views, origins, morphology and result rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions.pos import literal_map
from lexloom.functions.text import let

# Display order of morphology labels and the priority of parts of speech.
LABEL_ORDER = ["原形", "复数", "第三人称单数", "过去式", "过去分词", "现在分词", "比较级", "最高级"]
POS_PRIORITY = {"n": 0, "v": 1, "adj": 2, "adv": 3}


def is_word(text: Column) -> Column:
    return F.coalesce(F.trim(text).rlike("^[a-zA-Z-]+$"), F.lit(False))


def route(text: Column, lang: Column) -> Column:
    """`word` (looked up), `text` (translated as a whole) or `empty`."""
    return F.when(F.trim(F.coalesce(text, F.lit(""))) == "", "empty").when(is_word(text) & lang.isin("en", "auto"), "word").otherwise("text")


def lookup(queries: DataFrame, primary: DataFrame, secondary: DataFrame) -> DataFrame:
    """query_id, word, provider (primary, secondary, unresolved), meaning.  queries: query_id, text; packs: word, meaning (one row a lower-case word)."""
    q = queries.select("query_id", F.lower(F.trim("text")).alias("word"))
    one = primary.select(F.lower("word").alias("word"), F.col("meaning").alias("m1"))
    two = secondary.select(F.lower("word").alias("word"), F.col("meaning").alias("m2"))
    df = q.join(one, "word", "left").join(two, "word", "left")
    provider = F.when(F.col("m1").isNotNull(), "primary").when(F.col("m2").isNotNull(), "secondary").otherwise("unresolved")
    return df.select("query_id", "word", provider.alias("provider"), F.coalesce("m1", "m2").alias("meaning"))


def back_relation(relations: Column) -> Column:
    """The first primary outgoing origin, else the first outgoing origin."""
    origins = F.filter(relations, lambda r: (r["type"] == "origin") & (r["direction"] == "outgoing"))
    first = F.filter(origins, lambda r: F.coalesce(r["primary"], F.lit(False)))
    return F.when(F.size(first) > 0, first[0]).when(F.size(origins) > 0, origins[0])


def distinct_by(items: Column, key) -> Column:
    """Order kept, the first of each key."""
    first = lambda xs: let(F.transform(xs, key), lambda keys: F.filter(xs, lambda x, i: F.array_position(keys, F.get(keys, i)) == i + 1))
    return let(items, first)


def children(relations: Column) -> Column:
    """Visible outgoing inflections, each word and label once."""
    shown = F.filter(relations, lambda r: (r["type"] == "inflection") & (r["direction"] == "outgoing") & (r["display"] != "hidden"))
    return distinct_by(shown, lambda r: F.concat(r["target"], F.lit(":"), r["label"]))


def expands_origins(entry_kind: Column, origins: Column, inflection_xref: Column) -> Column:
    """More than one distinct label and scope, or a standalone entry with a cross-reference that is an inflection."""
    kinds = F.array_distinct(F.transform(origins, lambda r: F.concat_ws("|", r["label"], F.array_join(F.coalesce(r["pos_scope"], F.array().cast("array<string>")), ","))))
    return (F.size(kinds) > 1) | ((entry_kind == "standalone") & inflection_xref)


def entry_views(queries: DataFrame, entries: DataFrame) -> DataFrame:
    """query_id, query_word, display_word, exact and shown entry, is_fallback, back, children.  entries: word, entry_kind, display_word, linked_word, meaning, relations."""
    q = queries.select("query_id", F.lower(F.trim("text")).alias("query_word"))
    exact = entries.select(F.lower("word").alias("query_word"), F.struct("word", "entry_kind", "meaning", "relations", "display_word", "linked_word").alias("exact"))
    df = q.join(exact, "query_word")
    wanted = F.lower(F.coalesce("exact.display_word", "exact.linked_word", "exact.word"))
    shown = entries.select(F.lower("word").alias("wanted"), F.struct("word", "entry_kind", "meaning").alias("shown"))
    df = df.withColumn("wanted", wanted).join(shown, "wanted", "left")
    origins = F.filter("exact.relations", lambda r: (r["type"] == "origin") & (r["direction"] == "outgoing"))
    xref = F.exists("exact.relations", lambda r: (r["type"] == "xref") & r["label"].isin(*LABEL_ORDER))
    own = F.struct(F.col("exact.word").alias("word"), F.col("exact.entry_kind").alias("entry_kind"), F.col("exact.meaning").alias("meaning"))
    stays = expands_origins(F.col("exact.entry_kind"), origins, xref)
    entry = F.when(stays, own).otherwise(F.coalesce("shown", own))
    return df.select("query_id", "query_word", entry["word"].alias("display_word"), entry["meaning"].alias("meaning"), (F.lower(entry["word"]) != F.col("query_word")).alias("is_fallback"), back_relation(F.col("exact.relations"))["target"].alias("back"), F.transform(children(F.col("exact.relations")), lambda r: F.struct(r["target"].alias("word"), r["label"].alias("label"))).alias("children"))


def label_rank(label: Column) -> Column:
    at = F.array_position(F.array(*map(F.lit, LABEL_ORDER)), label)
    return F.when(at > 0, at).otherwise(len(LABEL_ORDER) + 1)


def morphology(rows: DataFrame) -> DataFrame:
    """query_id, label, words: distinct words of each label in order of source, labels in display order.  rows: query_id, label, word, at."""
    first = rows.groupBy("query_id", "label", F.lower("word").alias("k")).agg(F.min(F.struct("at", "word")).alias("w"))
    return first.groupBy("query_id", "label").agg(F.sort_array(F.collect_list("w")).alias("ws")).select("query_id", "label", label_rank(F.col("label")).cast("int").alias("rank"), F.col("ws.word").alias("words"))


def merge_parts(parts: DataFrame) -> DataFrame:
    """query_id, pos, meanings: parts of one part of speech joined, distinct meanings in order of first sight.  parts: query_id, pos, meaning, at."""
    shown = F.when(F.coalesce(F.trim("pos"), F.lit("")) == "", "释义").otherwise(F.col("pos"))
    first = parts.withColumn("pos", shown).groupBy("query_id", "pos", "meaning").agg(F.min("at").alias("at"))
    return first.groupBy("query_id", "pos").agg(F.min("at").alias("at"), F.sort_array(F.collect_list(F.struct("at", "meaning"))).alias("m")).select("query_id", "pos", "at", F.col("m.meaning").alias("meanings"))


def pos_rank(pos: Column) -> Column:
    return F.coalesce(F.element_at(literal_map(POS_PRIORITY), pos), F.lit(len(POS_PRIORITY)))


def parse_parts(text: Column) -> Column:
    """Lines `n. meaning` of a translation as array of (pos, meaning); a line without a part of speech counts as 释义."""
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    told = r"^([a-z]+\.(?: */ *[a-z]+\.)*)\s*(.+)$"
    return F.transform(lines, lambda x: F.when(x.rlike(told), F.struct(F.regexp_extract(x, told, 1).alias("pos"), F.regexp_extract(x, told, 2).alias("meaning"))).otherwise(F.struct(F.lit("释义").alias("pos"), x.alias("meaning"))))


def share_by_pos(rows: DataFrame, key: str, pos: str, order: str) -> DataFrame:
    """key, pos summary like n:50/v:50: share of each part of speech in per cent, half to even, in order of first sight."""
    each = rows.groupBy(key, pos).agg(F.count("*").alias("n"), F.min(order).alias("o"))
    total = each.groupBy(key).agg(F.sum("n").alias("total"), F.sort_array(F.collect_list(F.struct("o", F.col(pos).alias("p"), "n"))).alias("x"))
    return total.select(key, F.array_join(F.transform("x", lambda x: F.concat(x["p"], F.lit(":"), F.bround(x["n"] * F.lit(100.0) / F.col("total")).cast("int").cast("string"))), "/").alias("pos"))


def reassemble(pieces: DataFrame, expected: DataFrame) -> DataFrame:
    """text_id, text: the pieces in order; a text with a missing or failed piece is left out.  pieces: text_id, i, text, ok; expected: text_id, n."""
    df = pieces.groupBy("text_id").agg(F.bool_and("ok").alias("ok"), F.count("*").alias("have"), F.sort_array(F.collect_list(F.struct("i", "text"))).alias("x"))
    return df.join(expected, "text_id").where("ok AND have = n").select("text_id", F.array_join("x.text", "\n").alias("text"))

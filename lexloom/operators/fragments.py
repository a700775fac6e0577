"""Meaning fragments and meaning items of one part of speech."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions.text import bracket_han, display, displayed_pieces, let, meaning_key, qualified, shown_key, split_outside_brackets, without_brackets, without_long_brackets

MOST_HAN = 7


def unique_fragments(text: Column) -> Column:
    """Array of (text, key): the first fragment of each non-empty key.

    A key met more than once loses its brackets if any bracket under it has more than seven Han characters; a single
    fragment loses only such brackets (and stays whole if nothing else is left).
    """
    pieces = F.transform(split_outside_brackets(text), display)
    long_ = lambda p: F.coalesce(F.array_max(bracket_han(p)), F.lit(0)) > MOST_HAN
    keyed = F.filter(F.transform(pieces, lambda p: F.struct(p.alias("text"), meaning_key(p).alias("key"), long_(p).alias("long"))), lambda x: x["key"] != "")

    def shown(own: Column, several: Column) -> Column:
        some = without_long_brackets(own)
        return F.when(several, F.trim(without_brackets(own))).otherwise(F.when(some == "", own).otherwise(some))

    def merged(items: Column) -> Column:
        def first(keys: Column, key: Column) -> Column:
            own = F.element_at(items, F.array_position(keys, key).cast("int"))["text"]
            told = F.when(F.exists(items, lambda x: x["long"] & (x["key"] == key)), shown(own, F.size(F.filter(keys, lambda k: k == key)) > 1)).otherwise(own)
            return F.struct(told.alias("text"), meaning_key(told).alias("key"))

        return let(F.transform(items, lambda x: x["key"]), lambda keys: F.transform(F.array_distinct(keys), lambda key: first(keys, key)))

    return let(keyed, merged)


def fragment_rows(lines: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, place, text, key: what unique_fragments gives, a row each; `place` is that of the piece among all pieces of its line.

    For tables of lines: pieces are exploded once and aggregated by (line, key), so a line costs time in proportion to its
    pieces.  Both `keys` have to tell the lines apart; null or empty lines have no row.  Rows move once, by `keys`.
    """
    both = F.transform(displayed_pieces(F.col(text)), lambda p: F.struct(p.alias("text"), shown_key(without_brackets(p)).alias("key")))
    # outer, and keys beside their texts: what is exploded would be computed again to see whether it is empty, and a key to be compared
    pieces = lines.select(*keys, F.posexplode_outer(both).alias("place", "p")).select(*keys, "place", "p.text", "p.key")
    keyed = pieces.where("key <> ''").withColumn("long", F.col("text").rlike("[（(]") & (F.coalesce(F.array_max(bracket_han(F.col("text"))), F.lit(0)) > MOST_HAN))
    first = keyed.repartition(*keys).groupBy(*keys, "key").agg(F.min("place").alias("place"), F.min_by("text", "place").alias("text"), F.count("*").alias("n"), F.max("long").alias("long"))
    some = without_long_brackets(F.col("text"))
    shown = F.when(F.col("n") > 1, F.trim(without_brackets(F.col("text")))).when(some == "", F.col("text")).otherwise(some)
    told = first.withColumn("text", F.when(F.col("long"), shown).otherwise(F.col("text")))
    return told.select(*keys, "place", "text", F.when(F.col("long"), meaning_key(F.col("text"))).otherwise(F.col("key")).alias("key"))


def one_value(values: Column) -> Column:
    """The only distinct non-null value, else null."""
    distinct = F.array_distinct(F.array_compact(values))
    return F.when(F.size(distinct) == 1, distinct[0])


def meaning_items(df: DataFrame, records: str, out: str = "items") -> DataFrame:
    """records: array of (text, qualifier, countability) in sense order -> `out`: array of (text, countability).

    A single record is shown whole.  Otherwise the first record's first two fragments are the primary item, filled up from
    later records; every later record then adds its first fragment not used yet (one that says more than 存在 if qualified).
    Steps are columns of their own, so that none is evaluated again inside a lambda.
    """
    item = lambda text, count: F.struct(text.alias("text"), count.alias("countability"))
    none = F.array().cast("array<struct<text:string,countability:string>>")
    flat = lambda r: F.transform(r["fragments"], lambda f: F.struct(f["text"].alias("text"), f["key"].alias("key"), r["countability"].alias("countability")))
    df = df.withColumn("__each", F.transform(records, lambda r: F.struct(r["qualifier"].alias("qualifier"), r["countability"].alias("countability"), unique_fragments(r["text"]).alias("fragments"))))
    df = df.withColumns({"__head": F.slice(F.col("__each")[0]["fragments"], 1, 2), "__later": F.slice("__each", F.lit(2), F.greatest(F.size("__each") - 1, F.lit(0)))})
    df = df.withColumn("__keys", F.transform("__head", lambda f: f["key"]))
    df = df.withColumn("__spare", F.filter(F.flatten(F.transform("__later", flat)), lambda f: ~F.array_contains(F.col("__keys"), f["key"])))
    short = (F.size("__head") > 0) & (F.size("__head") < 2)
    df = df.withColumn("__extra", F.when(short, F.slice("__spare", 1, 1)).otherwise(F.slice("__spare", 1, 0)))
    texts = F.concat(F.transform("__head", lambda f: f["text"]), F.transform("__extra", lambda f: f["text"]))
    counts = F.concat(F.array(F.col("__each")[0]["countability"]), F.transform("__extra", lambda f: f["countability"]))
    df = df.withColumn("__first", F.when(F.size("__head") > 0, F.array(item(qualified(F.array_join(texts, ","), F.col("__each")[0]["qualifier"]), one_value(counts)))).otherwise(none))
    start = F.struct(F.concat("__keys", F.transform("__extra", lambda f: f["key"])).alias("used"), none.alias("out"))

    def choose(s: Column, r: Column) -> Column:
        left = F.filter(r["fragments"], lambda f: ~F.array_contains(s["used"], f["key"]))
        telling = F.filter(left, lambda f: f["key"] != "存在")
        plain = F.coalesce(r["qualifier"], F.lit("")) == ""
        return F.coalesce(F.when(~plain, F.try_element_at(telling, F.lit(1))), F.try_element_at(left, F.lit(1)))

    def step(s: Column, r: Column) -> Column:
        picked = F.transform(F.array(choose(s, r)), lambda c: F.when(c.isNotNull(), F.struct(F.concat(s["used"], F.array(c["key"])).alias("used"), F.concat(s["out"], F.array(item(qualified(c["text"], r["qualifier"]), r["countability"]))).alias("out"))).otherwise(s))
        return picked[0]

    rest = F.aggregate("__later", start, step, lambda s: s["out"])
    only = F.array(item(qualified(F.col(records)[0]["text"], F.col(records)[0]["qualifier"]), F.col(records)[0]["countability"]))
    df = df.withColumn(out, F.when(F.size(records) == 1, only).otherwise(F.concat("__first", rest)))
    return df.drop("__each", "__head", "__later", "__keys", "__spare", "__extra", "__first")

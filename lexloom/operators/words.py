"""The word list of a document table: the lexicon that the queries on plain texts are about."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: More than an array has places.
PLACES = 10_000_000_000


def word_list(documents: DataFrame, lang: str = "en") -> DataFrame:
    """word, doc_id, pos (first place of the word), n (occurrences) of the lower-case [a-z]+ words of texts in `lang`."""
    tokens = documents.where(F.col("lang") == lang).select("doc_id", F.posexplode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), 0)).alias("pos", "word"))
    # a place is one number: the least of structs would sort all tokens before they are counted
    place = F.col("doc_id").cast("decimal(19,0)") * F.lit(PLACES).cast("decimal(11,0)") + F.col("pos")
    first = tokens.groupBy("word").agg(F.min(place).alias("at"), F.count("*").alias("n")).withColumn("doc_id", F.floor(F.col("at") / F.lit(PLACES).cast("decimal(11,0)")).cast("long"))
    return first.select("word", "doc_id", (F.col("at") - F.col("doc_id").cast("decimal(19,0)") * F.lit(PLACES).cast("decimal(11,0)")).cast("int").alias("pos"), "n")


def first_wins(entries: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row for each lower-case key: the first by `order`."""
    columns = [c for c in entries.columns if c not in order]
    best = entries.groupBy(F.lower(key).alias("__k")).agg(F.min(F.struct(*order, *columns)).alias("r"))
    return best.select(*[F.col(f"r.{c}").alias(c) for c in entries.columns])

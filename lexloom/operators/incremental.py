"""Keeping final entries up to date: only what a change can reach is built again.

A state is a folder of three tables by hash of a word: `entries` (by word), `forms` (the inflection rows, by form) and `final`
(by word).  A change of a word can alter the final entries of the word, of its forms before and after, and, as an irregular
form leads on to the later forms of its base, of all forms of these forms' bases.  Those are built again from the entries
that they depend on, and only the folders that hold them are written.

Entries without links are kept this way; a word that is in `changed` twice or null is not allowed, a removed word that isn't
there changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.operators import lexicon
from lexloom.operators.layout import places_of, read_parts, replace_rows, write_parts
from lexloom.operators.relate import final_entries
from lexloom.operators.stages import settle

PARTS = 64


def _rows(entries: DataFrame) -> DataFrame:
    return lexicon.inflection_rows(entries).withColumn("key", F.lower("form"))


def start(entries: DataFrame, root: str, parts: int = PARTS) -> None:
    """Write the state of all entries."""
    write_parts(entries, f"{root}/entries", "word", parts)
    kept = entries.sparkSession.read.parquet(f"{root}/entries").drop("part")
    write_parts(_rows(kept), f"{root}/forms", "key", parts)
    write_parts(final_entries(kept), f"{root}/final", "word", parts)


def _among(spark: SparkSession, path: str, keys: DataFrame, column: str, parts: int) -> DataFrame:
    """Rows of a table by `column` whose column (in lower case) is among the keys; other folders aren't read."""
    rows = read_parts(spark, path, places_of(keys, "key", parts)).drop("part")
    return rows.join(keys.withColumnRenamed("key", "__key"), F.lower(column) == F.col("__key"), "left_semi")


def update(changed: DataFrame, removed: DataFrame, root: str, parts: int = PARTS) -> dict[str, list[int]]:
    """Bring the state up to date; changed: rows of `entries` that are new or take a word's place, removed: word.  Returns the folders written of each table."""
    spark = changed.sparkSession
    words = settle(changed.select(F.lower("word").alias("key")).unionByName(removed.select(F.lower("word").alias("key"))).distinct(), "changed-words")
    before = settle(_rows(_among(spark, f"{root}/entries", words, "word", parts)), "forms-before")
    after = settle(_rows(changed), "forms-after")
    written = {"entries": replace_rows(f"{root}/entries", changed.withColumn("key", F.lower("word")).drop("key"), words.withColumnRenamed("key", "word"), "word", ["word"], parts)}
    written["forms"] = replace_rows(f"{root}/forms", after, before.select("key", "base"), "key", ["key", "base"], parts)

    def grown(keys: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        """The keys with the bases that have them as forms, and all forms of these bases."""
        bases = _among(spark, f"{root}/forms", keys, "form", parts).select(F.col("base").alias("key"))
        both = settle(keys.unionByName(bases).distinct(), f"{name}-bases")
        forms = _rows(_among(spark, f"{root}/entries", both, "word", parts)).select("key")
        return both, settle(both.unionByName(forms).distinct(), f"{name}-forms")

    first = settle(words.unionByName(before.select("key")).unionByName(after.select("key")).distinct(), "reached")
    _, reached = grown(first, "reached")
    _, near = grown(reached, "near")
    needed, _ = grown(near, "needed")
    built = final_entries(_among(spark, f"{root}/entries", needed, "word", parts))
    again = built.join(reached, F.lower("word") == F.col("key"), "left_semi")
    old = read_parts(spark, f"{root}/final", places_of(reached, "key", parts)).select("word").join(reached, F.lower("word") == F.col("key"), "left_semi")
    written["final"] = replace_rows(f"{root}/final", settle(again, "built-again"), settle(old, "replaced"), "word", ["word"], parts)
    return written


def final(spark: SparkSession, root: str) -> DataFrame:
    return read_parts(spark, f"{root}/final").drop("part")

"""Laid-out stages, partial updates and lookups that read only what was asked for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.operators import incremental
from lexloom.operators.layout import keyed, lay_out
from lexloom.operators.stages import scratch_path, settle
from lexloom.plans.build_queries import ROWS, derived_entries, lex
from lexloom.plans.registry import LEX, query, table


@query(
    f"""WITH {ROWS}, m AS (SELECT form, arg_min(base, (ord, phase, seq)) AS owner, arg_min(label, (ord, phase, seq)) AS label FROM (SELECT base, label, form, max(phase) AS phase, arg_max(ord, phase) AS ord, arg_max(seq, phase) AS seq FROM rows_ GROUP BY ALL)
WHERE form NOT IN (SELECT word FROM lex) GROUP BY form)
SELECT word, 'standalone' AS entry_kind, NULL AS linked_word, pos, '' AS label FROM ent UNION ALL
SELECT form, 'inflection', ent.word, CASE label WHEN '复数' THEN list_filter(string_split(ent.pos, '/'), lambda p: p LIKE 'n:%')[1] WHEN '比较级' THEN 'adj:50' WHEN '最高级' THEN 'adj:50' ELSE list_filter(string_split(ent.pos, '/'), lambda p: p LIKE 'v:%')[1] END, label FROM m JOIN ent ON ent.word = m.owner"""
)
def incremental_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Final entries after a partial update: before it every fifth word told nothing, every eleventh was missing, and some words in -zz were there that go."""
    entries = derived_entries(spark, sf_dir).withColumn("translation", F.lit("n. a\nv. b\nadj. c")).select("word", "pos", "translation", "exchange", "ord")
    counted = entries.join(lex(spark, sf_dir).select("word", "n"), "word")
    silent, missing = F.col("n") % 5 == 2, F.col("n") % 11 == 1
    old = counted.where(~missing).select("word", F.when(silent, "v:100").otherwise(F.col("pos")).alias("pos"), "translation", F.when(silent, "").otherwise(F.col("exchange")).alias("exchange"), "ord")
    extra = counted.where("n % 13 = 0").select(F.concat("word", F.lit("zz")).alias("word"), F.lit("n:100").alias("pos"), "translation", F.concat(F.lit("s:"), "word", F.lit("s")).alias("exchange"), F.lit(0).cast("long").alias("ord"))
    root = scratch_path(spark, "lexicon-state")
    incremental.start(old.unionByName(extra), root, parts=16)
    incremental.update(settle(counted.where(silent | missing).drop("n"), "changed"), settle(extra.select("word"), "removed"), root, parts=16)
    label = F.coalesce(F.get(F.col("relations"), F.lit(0))["label"], F.lit(""))
    done = incremental.final(spark, root)
    return done.select("word", "entry_kind", "linked_word", "pos", F.when(F.col("entry_kind") == "inflection", label).otherwise("").alias("label"))


@query(
    rf"""WITH {LEX}, q AS (SELECT conv_id, turn, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM conversations WHERE text IS NOT NULL)
SELECT conv_id, turn, count(*) AS n_words, count(lex.word) AS n_known, coalesce(sum(lex.n), 0)::BIGINT AS n_seen FROM q LEFT JOIN lex ON lex.word = q.word GROUP BY conv_id, turn"""
)
def laid_out_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of all turns looked up in a lexicon bucketed by word: only the words asked for move."""
    words = lay_out(keyed(lex(spark, sf_dir)).select("key", "n"), "lexicon")
    asked = table(spark, sf_dir, "conversations").where("text IS NOT NULL").select("conv_id", "turn", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), 0)).alias("key"))
    met = asked.groupBy("conv_id", "turn", "key").agg(F.count("*").alias("times")).join(words.withColumn("known", F.lit(1)), "key", "left")
    return met.groupBy("conv_id", "turn").agg(F.sum("times").alias("n_words"), F.sum(F.when(F.col("known") == 1, F.col("times")).otherwise(0)).alias("n_known"), F.sum(F.coalesce("n", F.lit(0)) * F.col("times")).alias("n_seen"))

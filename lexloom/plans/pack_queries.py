"""Packs written to the shared folder and read back: shards, objects, manifests, checks, stages, sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.operators import quality, stages
from lexloom.plans.build_queries import lex
from lexloom.plans.registry import LEX, query, table
from lexloom.sources import packs

FIVE = "struct<word:string,phonetic:string,translation:string,pos:string,exchange:string>"


def flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five fields of the words; a few words begin with a sign or a capital."""
    w, n = F.col("word"), F.col("n")
    word = F.when(n % 7 == 0, F.concat(F.lit("#"), w)).when(n % 5 == 0, F.initcap(w)).otherwise(w)
    return lex(spark, sf_dir).select(word.alias("word"), F.when(n % 2 == 0, F.concat(F.lit("/"), w, F.lit("/"))).alias("phonetic"), F.concat(F.lit("t\n\"q\" "), n.cast("string")).alias("translation"), F.lit("n").alias("pos"), F.lit("").alias("exchange"))


FLAT = LEX + ", f AS (SELECT n, word AS w, CASE WHEN n % 7 = 0 THEN '#' || word WHEN n % 5 = 0 THEN upper(left(word, 1)) || substr(word, 2) ELSE word END AS word FROM lex)"


@query(f"WITH {FLAT} SELECT left(word, 1) AS shard, lower(word) AS key, word, CASE WHEN n % 2 = 0 THEN '/' || w || '/' END AS phonetic, 't' || chr(10) || '\"q\" ' || n AS translation FROM f")
def pack_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words as JSON objects by first character, read back whole."""
    path = stages.scratch_path(spark, "objects")
    packs.write_shard_objects(flat(spark, sf_dir), path)
    return packs.read_shard_objects(spark, path, FIVE).select("shard", "key", "word", "entry.phonetic", "entry.translation")


@query(f"WITH {FLAT} SELECT CASE WHEN n % 7 = 0 THEN '_' ELSE lower(left(word, 1)) END AS shard, word, 't' || chr(10) || '\"q\" ' || n AS translation FROM f UNION ALL SELECT 'none', 'secondary', '0'")
def pack_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pack of rows with its manifest, and a pack that isn't there (no rows)."""
    path = stages.scratch_path(spark, "rows")
    rows = flat(spark, sf_dir).unionByName(flat(spark, sf_dir).select(F.lit("").alias("word"), *packs.FIELDS[1:]))  # rows without a word aren't written
    packs.write_shards(rows, f"{path}/main/shards", "letter")
    packs.write_manifest(spark, f"{path}/main/manifest", f"{path}/main/shards", "words", {"entryCount": rows.where("word <> ''").count(), "danglingNavigableTargets": 0})
    have = packs.lookup_packs(spark, path, {"main": "words", "secondary": "words"})
    told = have["secondary"].agg(F.count("*").alias("n")).select(F.lit("none").alias("shard"), F.lit("secondary").alias("word"), F.col("n").cast("string").alias("translation"))
    return have["main"].select("shard", "word", "translation").unionByName(told)


def _shard_of(name: Column) -> Column:
    return F.regexp_extract(name, "^(.*?)-part", 1)


@query(
    f"""WITH {FLAT} SELECT unnest(['strings', 'type', 'date', 'counts', 'files', 'names', 'dangling', 'wrong type', 'missing file', 'wrong size', 'wrong digest', 'good files']) AS rule,
unnest([1, 1, 1, 1, 1, 1, 1, 0, 1, 1, 1, (SELECT count(DISTINCT CASE WHEN n % 7 = 0 THEN '_' ELSE lower(left(word, 1)) END) FROM f) - 3]) AS n"""
)
def pack_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules of a manifest, and its files after one declaration in each of three shards was given another name, another size or another digest: a shard is good if all its files are, however many it has."""
    path = stages.scratch_path(spark, "checks")
    packs.write_shards(flat(spark, sf_dir).coalesce(1), f"{path}/shards", "letter")
    manifest = packs.write_manifest(spark, f"{path}/manifest", f"{path}/shards", "words", {"entryCount": 1, "danglingNavigableTargets": 0})
    ok = quality.check_manifest(manifest, "words").select("rule", F.col("ok").cast("long").alias("n"))
    wrong = quality.check_manifest(manifest, "other").where("rule = 'type'").select(F.lit("wrong type").alias("rule"), F.col("ok").cast("long").alias("n"))
    named = manifest.select(F.explode("files.name").alias("name")).groupBy(_shard_of(F.col("name")).alias("shard")).agg(F.min("name").alias("name"))
    gone, cut, other = [r["name"] for r in named.orderBy("shard").limit(3).collect()]
    spoilt = manifest.withColumn("files", F.transform("files", lambda f: F.struct(F.when(f["name"] == gone, F.concat(_shard_of(f["name"]), F.lit("-part-gone.json"))).otherwise(f["name"]).alias("name"), F.when(f["name"] == other, "0").otherwise(f["sha256"]).alias("sha256"), F.when(f["name"] == cut, F.lit(1)).otherwise(f["size"]).alias("size"))))
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").load(f"{path}/shards")
    files = quality.check_files(spoilt, listing)
    by_shard = files.groupBy(_shard_of(F.col("name")).alias("shard")).agg(F.count_if(~F.col("exists")).alias("gone"), F.count_if(F.col("exists") & ~F.col("size_ok")).alias("cut"), F.count_if(F.col("exists") & ~F.col("sha_ok")).alias("other"), F.bool_and(F.col("exists") & F.col("size_ok") & F.col("sha_ok")).alias("good"))
    told = by_shard.agg(F.sum("gone").alias("missing file"), F.sum("cut").alias("wrong size"), F.sum("other").alias("wrong digest"), F.count_if("good").alias("good files"))
    rows = told.select(F.explode(F.array(*[F.struct(F.lit(c).alias("rule"), F.col(f"`{c}`").alias("n")) for c in told.columns])).alias("r")).select("r.*")
    return ok.unionByName(wrong).unionByName(rows)


@query(f"WITH {LEX} SELECT word AS key, CASE WHEN n % 3 = 0 THEN -n ELSE n END AS n, word = 'the' AS asked FROM lex UNION ALL SELECT word || '+', 0, false FROM lex WHERE n % 3 = 0")
def stage_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stage table, an upsert of old and new keys (the last by `ord` wins), and a point lookup."""
    root = stages.scratch_path(spark, "stage")
    words = lex(spark, sf_dir).select(F.col("word").alias("key"), "n", F.lit(0).alias("ord"))
    stages.write_stage(words, root, "words")
    some = words.where("n % 3 = 0")
    new = some.select("key", F.lit(-1).cast("long").alias("n"), F.lit(0).alias("ord")).unionByName(some.select("key", (-F.col("n")).alias("n"), F.lit(1).alias("ord"))).unionByName(some.select(F.concat("key", F.lit("+")).alias("key"), F.lit(0).cast("long").alias("n"), F.lit(0).alias("ord")))
    stages.upsert_stage(spark, new, root, "words", "key", 0)
    stage = stages.read_stage(spark, root, "words", 1)
    there = stages.stage_has(stage, "key", "the")
    return stage.select("key", "n", (F.lit(there) & (F.col("key") == "the")).alias("asked"))


@query("SELECT c_custkey AS ord, c_custkey::VARCHAR AS key, c_name AS body FROM customer UNION ALL SELECT (SELECT count(*) FROM customer) + o_orderkey_rank, key, body FROM (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS o_orderkey_rank, 'o' || o_orderkey AS key, o_orderstatus AS body FROM orders)")
def raw_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw entries of several CSV files without an order column, numbered by file and place."""
    path = stages.scratch_path(spark, "raw")
    none = F.lit(None).cast("string").alias("ord")
    one = table(spark, sf_dir, "customer").orderBy("c_custkey").select(none, F.col("c_custkey").cast("string").alias("key"), F.col("c_name").alias("body"))
    two = table(spark, sf_dir, "orders").repartitionByRange("o_orderkey").sortWithinPartitions("o_orderkey").select(none, F.concat(F.lit("o"), "o_orderkey").alias("key"), F.col("o_orderstatus").alias("body"))
    one.coalesce(1).write.csv(f"{path}/a")
    two.write.csv(f"{path}/b")
    return packs.read_raw_entries(spark, f"{path}/*", "csv")


@query(
    f"""WITH {LEX} SELECT 'lexicon' AS source, word, 't' || n AS value FROM lex WHERE n % 4 = 1 UNION ALL SELECT 'morphemes', word, CASE WHEN n % 2 = 0 THEN 'second' ELSE 'first' END FROM lex WHERE n % 3 <> 0 UNION ALL SELECT 'glossary', word, '' FROM lex WHERE length(word) = 3 AND word < 'm'"""
)
def source_readers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A CSV dictionary, morpheme chunks of which the last file wins (one is malformed), and a root glossary with a list of allowed keys."""
    path = stages.scratch_path(spark, "sources")
    words = stages.settle(lex(spark, sf_dir).select("word", "n"), "source-words")
    text = F.when(F.col("n") % 4 == 0, " ").when(F.col("n") % 4 == 1, F.concat(F.lit("t"), "n"))
    words.where("n % 4 < 3").select(F.upper("word").alias("word"), F.lit("p").alias("phonetic"), text.alias("translation"), F.lit("n").alias("tag"), F.lit("").alias("exchange")).write.csv(f"{path}/csv", header=True, escape='"')
    lexicon = packs.read_lexicon(spark, csv=f"{path}/csv")
    piece = F.array(F.struct(F.col("word").alias("piece"), F.lit("g").alias("gloss")))
    chunk = lambda df, origin: df.groupBy(F.pmod(F.xxhash64("word"), F.lit(16)).alias("k")).agg(F.map_from_entries(F.collect_list(F.struct("word", F.struct(F.when(F.col("n") % 3 == 1, piece).alias("morphemes"), F.lit(origin).alias("etymologyOrigin"))))).alias("entries")).select("entries")
    used = words.where("n % 3 <> 0")
    chunk(used, "first").write.json(f"{path}/morphemes/a")
    chunk(used.where("n % 2 = 0"), "second").write.json(f"{path}/morphemes/b")
    spark.createDataFrame([("{not json",)], "value string").write.text(f"{path}/morphemes/c")
    spark.createDataFrame([('{"entries": {"zzz": {"morphemes": [], "etymologyOrigin": ""}}}',)], "value string").write.text(f"{path}/morphemes/d")
    morphemes = packs.read_morphemes(spark, f"{path}/morphemes/*", multi_line=False)
    allowed = [r["word"] for r in words.where("length(word) = 3 AND word < 'm'").collect()]  # words of three letters: 26^3 at most
    words.where("length(word) = 3").select(F.concat(F.lit(" "), "word", F.lit(" ")).alias("﻿词根词缀")).unionByName(spark.createDataFrame([("nan",), ("",)], "`﻿词根词缀` string")).write.csv(f"{path}/glossary", header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    glossary = packs.read_root_glossary(spark, f"{path}/glossary", allowed=allowed)
    row = lambda source, df, word, value: df.select(F.lit(source).alias("source"), F.col(word).alias("word"), value.alias("value"))
    return row("lexicon", lexicon, "word", F.col("translation")).unionByName(row("morphemes", morphemes, "word", F.col("origin"))).unionByName(row("glossary", glossary, "root", F.lit("")))

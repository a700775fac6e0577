"""Data-quality rules: each gives violating rows; the suite gives one row a rule."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions.fixed import SLOTS

KINDS = ["standalone", "inflection", "alias"]


def shard(word: Column, rule: str = "first_char") -> Column:
    """first_char: as it is (final sigma folded, empty is _); letter: lower-cased letter or _; letter_as_is: letter or _."""
    first = F.substring(F.coalesce(word, F.lit("")), 1, 1)
    if rule == "first_char":
        return F.when(first == "", "_").otherwise(F.translate(first, "ς", "σ"))
    own = F.lower(first) if rule == "letter" else first
    return F.when(first.rlike(r"^\p{L}$"), own).otherwise("_")


def shard_counts(words: DataFrame, rule: str = "letter") -> DataFrame:
    return words.groupBy(shard(F.col("word"), rule).alias("shard")).agg(F.count("*").alias("n"))


def duplicate_keys(words: DataFrame) -> DataFrame:
    return words.groupBy(F.lower("word").alias("key")).agg(F.count("*").alias("n")).where("n > 1")


def sample_per_shard(words: DataFrame, k: int = 5) -> DataFrame:
    """k words a shard, drawn by MD5 of the word."""
    w = Window.partitionBy("shard").orderBy(F.md5(F.col("word").cast("binary")), "word")
    return words.select("word", shard(F.col("word"), "letter").alias("shard")).withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k).select("word", "shard")


def coverage(wanted: DataFrame, entries: DataFrame) -> DataFrame:
    """found, missing, total of an external word list.  wanted, entries: word."""
    known = entries.select(F.lower("word").alias("k")).distinct().withColumn("hit", F.lit(True))
    df = wanted.select(F.lower("word").alias("k")).join(known, "k", "left")
    return df.agg(F.count_if("hit").alias("found"), F.count_if(F.col("hit").isNull()).alias("missing"), F.count("*").alias("total"))


def exchange_ok(exchange: Column) -> Column:
    """Every item is slot:form of a known slot; empty is fine."""
    items = F.filter(F.split(F.coalesce(exchange, F.lit("")), "/"), lambda x: x != "")
    return F.forall(items, lambda x: F.substring_index(x, ":", 1).isin(*SLOTS) & x.rlike("^[^:]+:.+"))


def build_metrics(entries: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: entries, verb-like entries without forms, derived edges, edges whose target is no entry.  entries: word, pos, exchange; edges: target, source."""
    facts = entries.agg(F.count("*").alias("entry_count"), F.count_if(F.coalesce("pos", F.lit("")).contains("v") & (F.coalesce("exchange", F.lit("")) == "")).alias("verb_form_missing"))
    known = entries.select(F.lower("word").alias("k")).distinct().withColumn("hit", F.lit(True))
    told = edges.select(F.lower("target").alias("k"), "source").join(known, "k", "left").agg(F.count_if(F.col("source") == "derived").alias("derived_edges"), F.count_if(F.col("hit").isNull()).alias("dangling_targets"))
    return facts.crossJoin(told)  # one row each


def rules() -> dict[str, Column]:
    """What is wrong with a row of a flat word table (word, pos, exchange), by rule."""
    word, pos = F.col("word"), F.coalesce("pos", F.lit(""))
    return {
        "word_not_empty": F.coalesce(F.trim(word), F.lit("")) == "",
        "key_is_lower": word != F.lower(word),
        "pos_not_blank": F.trim(pos) == "",
        "pos_format": ~pos.rlike(r"^[a-z+]+:\d+(?:/[a-z+]+:\d+)*$"),
        "exchange_format": ~exchange_ok(F.col("exchange")),
        "letters_only": ~word.rlike("^[a-z' -]+$"),
    }


def suite(entries: DataFrame) -> DataFrame:
    """rule, violations: all rules counted in one pass; a rule that can't be told counts as broken."""
    counted = entries.agg(*[F.count_if(F.coalesce(test, F.lit(True))).alias(name) for name, test in rules().items()])
    return counted.select(F.explode(F.array(*[F.struct(F.lit(name).alias("rule"), F.col(name).alias("violations")) for name in rules()])).alias("r")).select("r.*")


def file_name(path: Column) -> Column:
    """Name of a shard file, told apart by its shard: `w-part-0.json` of `shard=w/part-0.json`."""
    return F.concat(F.regexp_replace(F.regexp_extract(path, "shard=([^/]*)/[^/]*$", 1), "$", "-"), F.element_at(F.split(path, "/"), -1))


#: Counts of a manifest that have to be there and not negative.
QUALITY_FIELDS = ["danglingNavigableTargets", "syntheticRelationCount", "wordFamilyMissingCount", "verbFormMissingCount"]


def check_manifest(manifest: DataFrame, pack_type: str, keys: Sequence[str] = (), subdir: str = "shards") -> DataFrame:
    """keys, rule, ok for each manifest (`keys` tell several apart): required strings, type, date, positive counts, files; layout and all quality counts where it has them."""
    text = lambda c: F.coalesce(F.trim(F.col(c)) != "", F.lit(False))
    tests = {
        "strings": text("schemaVersion") & text("dataVersion") & text("pipelineVersion"),
        "type": F.col("packType") == pack_type,
        "date": F.try_to_timestamp("generatedAt").isNotNull(),
        "counts": (F.col("entryCount") > 0) & (F.col("shardCount") > 0),
        "files": F.size("files") == F.col("shardCount"),
        "names": F.forall("files", lambda f: f["name"].rlike(r"^[^/\\]+\.json$")) & (F.size(F.array_distinct(F.transform("files", lambda f: f["name"]))) == F.size("files")),
        "dangling": F.col("danglingNavigableTargets") == 0,
    }
    if "layout" in manifest.columns:
        tests["layout"] = (F.col("layout.shardSubdir") == subdir) & (F.col("layout.shardExtension") == ".json")
    if set(QUALITY_FIELDS) <= set(manifest.columns):
        tests["metrics"] = F.forall(F.array(*QUALITY_FIELDS), lambda n: F.coalesce(n >= 0, F.lit(False)))
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), F.coalesce(v, F.lit(False)).alias("ok")) for k, v in tests.items()])).alias("r")
    return manifest.select(*keys, each).select(*keys, "r.*")


def check_files(manifest: DataFrame, listing: DataFrame) -> DataFrame:
    """name, exists, size_ok, sha_ok of each declared file.  listing: path, content (binaryFile)."""
    declared = manifest.select(F.explode("files").alias("f")).select("f.*")
    have = listing.select(file_name(F.col("path")).alias("name"), F.length("content").alias("have_size"), F.sha2("content", 256).alias("have_sha"))
    df = declared.join(have, "name", "left")
    return df.select("name", F.col("have_size").isNotNull().alias("exists"), F.coalesce(F.col("have_size") == F.col("size"), F.lit(False)).alias("size_ok"), F.coalesce(F.col("have_sha") == F.col("sha256"), F.lit(False)).alias("sha_ok"))

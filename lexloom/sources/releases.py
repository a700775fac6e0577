"""Releasing packs: shards written, measured and refused in one job; order across files; lookups that open only asked shards; rejects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from lexloom.operators.quality import shard
from lexloom.operators.stages import settle
from lexloom.sources import packs


class Refused(ValueError):
    """A gate was not passed; `metrics` are those seen while writing."""

    def __init__(self, failed: list[str], metrics: dict):
        super().__init__(f"refused: {', '.join(failed)}")
        self.failed, self.metrics = failed, metrics


def remove(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def release(rows: DataFrame, root: str, pack_type: str, metrics: dict[str, Column], most: dict[str, int], rule: str = "first_char") -> DataFrame:
    """Write the pack's shards and its manifest; returns the manifest.

    metrics: aggregates over the rows, observed while they are written, so no other pass reads them.  A metric that is null or
    negative, or above its value in `most`, refuses the release: the shards go, no manifest is put in place and Refused is
    raised.  `entryCount` is always measured.  Rows without a word are not written and not measured.
    """
    spark = rows.sparkSession
    seen = Observation()
    # observed behind the exchange, as the ranges of the exchange are found by a run of its own
    measured = packs.sharded(rows, rule).observe(seen, F.count(F.lit(1)).alias("entryCount"), *[c.alias(n) for n, c in metrics.items()])
    measured.write.mode("overwrite").option("maxRecordsPerFile", packs.FILE_ROWS).partitionBy("shard").json(f"{root}/shards")
    told = dict(seen.get)
    failed = [n for n, v in told.items() if v is None or v < 0 or v > most.get(n, v)]
    if failed:
        remove(spark, f"{root}/shards")
        raise Refused(failed, told)
    return packs.write_manifest(spark, f"{root}/manifest", f"{root}/shards", pack_type, told)


def misplaced(spark: SparkSession, shards: str, key: str = "word") -> DataFrame:
    """file, key, before: rows of shard files whose key is below that of the row before them; the first row of a file is held against the last one of the shard's file before it (by name)."""
    rows = spark.read.json(shards).select(F.col("shard").cast("string").alias("shard"), F.col(key).alias("key"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("m"))
    own = rows.withColumn("before", F.lag("key").over(Window.partitionBy("file").orderBy("block", "m")))  # a file has packs.FILE_ROWS rows at most
    ends = rows.groupBy("shard", "file").agg(F.min_by("key", F.struct("block", "m")).alias("first"), F.max_by("key", F.struct("block", "m")).alias("last"))
    handed = ends.withColumn("before", F.lag("last").over(Window.partitionBy("shard").orderBy("file")))  # a row a file
    found = own.where("key < before").select("file", "key", "before")
    return found.unionByName(handed.where("first < before").select("file", F.col("first").alias("key"), "before"))


#: Shard names (first characters) that a lookup may name to the reader; beyond it packs are read whole.
ASKED_SHARDS = 10_000


def only_asked(pack: DataFrame, asked: DataFrame) -> DataFrame:
    """The pack's rows of the shards that are asked for (asked: shard): their names go to the reader, so other folders are not opened."""
    names = [r["shard"] for r in asked.select("shard").distinct().limit(ASKED_SHARDS + 1).collect()]
    return pack if len(names) > ASKED_SHARDS else pack.where(F.col("shard").isin(names))


def lookup_in_packs(queries: DataFrame, have: dict[str, DataFrame], rule: str = "first_char") -> DataFrame:
    """query_id, word, pack, translation: each query's word in the first pack (in the order of `have`) that holds it; pack is null for none.

    queries: query_id, text.  A pack holds a word once in any case (the first one by spelling counts).  A shard is that of the
    word as it is written, so a word in other case is looked for in both of its shards.
    """
    q = queries.select("query_id", F.trim("text").alias("said"), F.lower(F.trim("text")).alias("word"))
    asked = q.select(F.explode(F.array_distinct(F.array(shard(F.col("word"), rule), shard(F.initcap("word"), rule), shard(F.col("said"), rule)))).alias("shard"))
    asked = settle(asked.distinct(), "asked-shards")
    found = None
    for place, (name, pack) in enumerate(have.items()):
        rows = only_asked(pack, asked).select(F.lower("word").alias("word"), F.col("word").alias("spelt"), "translation")
        rows = rows.groupBy("word").agg(F.min_by("translation", "spelt").alias("translation")).select("word", F.struct(F.lit(place).alias("place"), F.lit(name).alias("pack"), "translation").alias("x"))
        found = rows if found is None else found.unionByName(rows)
    first = found.groupBy("word").agg(F.min("x").alias("x"))
    return q.join(first, "word", "left").select("query_id", "word", "x.pack", "x.translation")


def read_morphemes_with_rejects(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(word, morphemes, origin as packs.read_morphemes has them of chunks with a line each; file, line, reason of the chunks and words that are left out)."""
    chunks = spark.read.schema(f"{packs.MORPHEMES}, broken string").option("columnNameOfCorruptRecord", "broken").json(path).select("*", "_metadata.file_path")
    each = chunks.where("broken IS NULL AND entries IS NOT NULL").select("file_path", F.explode("entries").alias("word", "e"))
    says = (F.size("e.morphemes") > 0) | (F.coalesce("e.etymologyOrigin", F.lit("")) != "")
    last = Window.partitionBy("word").orderBy(F.col("file_path").desc())
    kept = each.where(says).withColumn("rn", F.row_number().over(last)).where("rn = 1").select("word", F.col("e.morphemes").alias("morphemes"), F.col("e.etymologyOrigin").alias("origin"))
    reason = F.when(F.col("broken").isNotNull(), "malformed").when(F.col("entries").isNull(), "no entries")
    bad = chunks.select(F.col("file_path").alias("file"), F.col("broken").alias("line"), reason.alias("reason")).where("reason IS NOT NULL")
    empty = each.where(~F.coalesce(says, F.lit(False))).select(F.col("file_path").alias("file"), F.col("word").alias("line"), F.lit("nothing told").alias("reason"))
    return kept, bad.unionByName(empty)

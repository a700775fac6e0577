"""Stage tables with a layout.

`lay_out` writes a table bucketed and sorted by a key: joins on that key don't move it, and a read of few keys opens only
their buckets.  `write_parts` keeps a table in folders by a hash of a key, so that `replace_rows` rewrites the folders that
hold a changed key and leaves the files of all others alone.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.operators.stages import scratch_path, settle

PART = "part"


def keyed(df: DataFrame, word: str = "word") -> DataFrame:
    """With `key`, the word in lower case, by which lexicon tables meet."""
    return df.withColumn("key", F.lower(word))


def lay_out(df: DataFrame, name: str, key: str = "key", buckets: int | None = None) -> DataFrame:
    """Write df in `buckets` buckets (the session's shuffle partitions by default) sorted by key, and read it as a table that remembers so."""
    spark = df.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    said = f"{name}_{uuid.uuid4().hex}"
    writer = df.repartition(n, key).write.format("parquet").bucketBy(n, key).sortBy(key)
    writer.option("path", scratch_path(spark, name)).option("compression", "zstd").saveAsTable(said)
    return spark.table(said)


def part_of(key: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(F.lower(key)), F.lit(parts)).cast("int")


def write_parts(df: DataFrame, path: str, key: str, parts: int) -> None:
    placed = df.withColumn(PART, part_of(F.col(key), parts))
    placed.repartition(parts, PART).write.partitionBy(PART).option("compression", "zstd").parquet(path)


def read_parts(spark: SparkSession, path: str, places: list[int] | None = None) -> DataFrame:
    """The rows of the table, only of these folders if they are given."""
    df = spark.read.parquet(path)
    return df if places is None else df.where(F.col(PART).isin(places))


def places_of(keys: DataFrame, key: str, parts: int) -> list[int]:
    """Folders that hold the keys: `parts` numbers at most."""
    return sorted(r[0] for r in keys.select(part_of(F.col(key), parts)).distinct().collect())


def replace_rows(path: str, new: DataFrame, gone: DataFrame, key: str, on: list[str], parts: int) -> list[int]:
    """Take out the rows that `gone` names (by the columns `on`, `key` among them) and put in `new`; returns the folders rewritten.

    Merged rows are settled before a folder is overwritten, so tasks that are repeated don't read what they replace.
    """
    spark = new.sparkSession
    places = places_of(gone.select(key).unionByName(new.select(key)), key, parts)
    old = read_parts(spark, path, places)
    kept = old.join(gone.select(*on).distinct(), on, "left_anti").select(*old.columns)
    merged = settle(kept.unionByName(new.withColumn(PART, part_of(F.col(key), parts)).select(*old.columns)), "merged")
    merged.repartition(parts, PART).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy(PART).parquet(path)
    filled = {r[0] for r in merged.select(PART).distinct().collect()}
    for place in places:
        if place not in filled:  # an overwrite leaves folders alone that get no row
            folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{PART}={place}")
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    return places

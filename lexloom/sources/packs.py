"""Readers of raw entries, dictionaries, root sources and packs; shard and manifest writers."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexloom.functions.text import squeeze
from lexloom.operators.quality import file_name, shard

FIELDS = ["word", "phonetic", "translation", "pos", "exchange"]
EMPTY = "word string, phonetic string, translation string, pos string, exchange string"


def read_raw_entries(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    """ord, key, body.  A source without `ord` is numbered by file name and place in the file, however Spark packs the files."""
    df = spark.read.format(kind).load(path) if kind == "parquet" else spark.read.schema("ord long, key string, body string").format(kind).load(path)
    if "ord" in df.columns and (kind == "parquet" or not df.where("ord IS NOT NULL").isEmpty()):
        return df.select("ord", "key", "body")
    placed = df.select("key", "body", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("m"))
    blocks = placed.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("m").alias("first")).collect()  # a row for each part of a file that one task reads
    starts, total = [], 0
    for r in sorted(blocks, key=lambda r: (r["file"], r["block"])):
        starts.append((r["file"], r["block"], total - r["first"]))
        total += r["n"]
    shift = F.broadcast(spark.createDataFrame(starts, "file string, block long, shift long"))
    return placed.join(shift, ["file", "block"]).select((F.col("m") + F.col("shift")).alias("ord"), "key", "body")


def read_lexicon_table(df: DataFrame) -> DataFrame:
    """The five fields of rows with a translation; nulls become empty.  Filter and columns reach the source."""
    return df.where("translation IS NOT NULL AND translation <> ''").select(*FIELDS).na.fill("").withColumn("word", F.lower("word"))


def read_lexicon_csv(spark: SparkSession, path: str) -> DataFrame:
    """Header CSV (word, phonetic, translation, tag, exchange); blank translations are skipped, tag is the part of speech."""
    df = spark.read.csv(path, header=True, multiLine=True, escape='"')
    df = df.where(F.trim(F.coalesce("translation", F.lit(""))) != "")
    return df.select(F.lower("word").alias("word"), "phonetic", "translation", F.col("tag").alias("pos"), "exchange").na.fill("")


def read_lexicon(spark: SparkSession, table: DataFrame | None = None, csv: str | None = None) -> DataFrame:
    """The relational source if there is one, else the CSV."""
    if table is not None:
        return read_lexicon_table(table)
    if csv is not None:
        return read_lexicon_csv(spark, csv)
    raise ValueError("neither a table nor a CSV is given")


MORPHEMES = "entries map<string, struct<morphemes: array<struct<piece: string, gloss: string>>, etymologyOrigin: string>>"


def read_morphemes(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """word, morphemes, origin of JSON chunks (a file each, or a line each without multi_line); malformed ones are skipped, the last file (by name) wins."""
    df = spark.read.schema(MORPHEMES).option("multiLine", multi_line).option("mode", "PERMISSIVE").json(path).select("*", "_metadata.file_path")
    df = df.where("entries IS NOT NULL").select("file_path", F.explode("entries").alias("word", "e"))
    df = df.where((F.size("e.morphemes") > 0) | (F.coalesce("e.etymologyOrigin", F.lit("")) != ""))
    w = Window.partitionBy("word").orderBy(F.col("file_path").desc())
    return df.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("word", F.col("e.morphemes").alias("morphemes"), F.col("e.etymologyOrigin").alias("origin"))


def read_map_shards(spark: SparkSession, path: str, value: str) -> DataFrame:
    """word, entry of files that hold one object each; manifests are left out, the first file (by name) wins."""
    df = spark.read.text(path, wholetext=True).select("value", "_metadata.file_path").where(~F.col("file_path").endswith("manifest.json"))
    df = df.select("file_path", F.explode(F.from_json("value", f"map<string, {value}>")).alias("word", "entry"))
    return df.groupBy("word").agg(F.min_by("entry", "file_path").alias("entry"))


def read_root_glossary(spark: SparkSession, path: str, column: str = "词根词缀", allowed: list[str] | None = None) -> DataFrame:
    """root of a CSV (a byte-order mark in the header is dropped); empty and `nan` keys are skipped, and those not in the list of allowed ones if there is one."""
    df = spark.read.csv(path, header=True)
    df = df.toDF(*[c.lstrip("﻿") for c in df.columns])
    df = df.select(squeeze(F.col(column)).alias("root")).where("root IS NOT NULL AND root <> '' AND lower(root) <> 'nan'").distinct()
    return df if allowed is None else df.where(F.col("root").isin(*allowed))


#: Rows of one shard file at most.
FILE_ROWS = 100_000


def sharded(df: DataFrame, rule: str) -> DataFrame:
    """With the shard, ranges of (shard, word) together and in order: a large shard is spread over tasks."""
    return df.where("word <> ''").withColumn("shard", shard(F.col("word"), rule)).repartitionByRange("shard", "word").sortWithinPartitions("shard", "word")


def write_shards(df: DataFrame, path: str, rule: str = "first_char") -> None:
    """Rows with a word, in order, as JSON lines under shard=...; a rule of quality.shard chooses the shard.  Nothing is written of an empty table."""
    if not df.isEmpty():
        sharded(df, rule).write.mode("overwrite").option("maxRecordsPerFile", FILE_ROWS).partitionBy("shard").json(path)


def _objects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of one JSON object for each run of rows with a shard; a new one begins after FILE_ROWS rows."""
    last, n, number = None, 0, 0
    for batch in batches:
        lines: list[tuple[str, int, str]] = []
        for name, word, entry in zip(batch.column("shard").to_pylist(), batch.column("word").to_pylist(), batch.column("entry").to_pylist(), strict=True):
            if name != last or n == FILE_ROWS:
                if last is not None:
                    lines.append((last, number, "}"))
                last, n, number = name, 0, number + 1
                lines.append((name, number, "{"))
            lines.append((name, number, f"{',' if n else ''}{json.dumps(word, ensure_ascii=False)}:{entry}"))
            n += 1
        yield _lines(lines)
    if last is not None:
        yield _lines([(last, number, "}")])


def _lines(rows: list[tuple[str, int, str]]) -> pa.RecordBatch:
    names, numbers, lines = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(numbers, pa.int32()), pa.array(lines, pa.string())], ["shard", "part", "value"])


def write_shard_objects(df: DataFrame, path: str, rule: str = "first_char") -> None:
    """Files that hold one JSON object each, {word: entry, ...} in order of words, under shard=.../part=...; an entry is the row without nulls.  Nothing is written of an empty table."""
    if df.isEmpty():
        return
    rows = sharded(df, rule).select("shard", "word", F.to_json(F.struct(*df.columns)).alias("entry"))
    rows.mapInArrow(_objects, "shard string, part int, value string").write.mode("overwrite").partitionBy("shard", "part").text(path)


def read_shard_objects(spark: SparkSession, path: str, value: str) -> DataFrame:
    """shard, key (word in lower case), word, entry of the files that write_shard_objects has written; a filter on the shard prunes folders."""
    df = spark.read.text(path, wholetext=True).select("shard", F.explode(F.from_json("value", f"map<string, {value}>")).alias("word", "entry"))
    return df.select(F.col("shard").cast("string").alias("shard"), F.lower("word").alias("key"), "word", "entry")


def write_manifest(spark: SparkSession, path: str, shards: str, pack_type: str, metrics: dict[str, int], version: str = "1") -> DataFrame:
    """One JSON row with counts and name, size and SHA-256 of every shard file under `shards`."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").load(shards)
    listed = files.select(F.struct(file_name(F.col("path")).alias("name"), F.sha2("content", 256).alias("sha256"), F.length("content").cast("long").alias("size")).alias("f"))
    df = listed.agg(F.sort_array(F.collect_list("f")).alias("files"), F.count("*").cast("int").alias("shardCount"))
    df = df.select(F.lit(version).alias("schemaVersion"), F.lit(version).alias("dataVersion"), F.lit(version).alias("pipelineVersion"), F.lit(pack_type).alias("packType"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("generatedAt"), "shardCount", *[F.lit(v).alias(k) for k, v in metrics.items()], "files")
    df.coalesce(1).write.mode("overwrite").json(path)
    return spark.read.json(path)


def read_pack_rows(spark: SparkSession, shards: str, schema: str = EMPTY) -> DataFrame:
    """The rows of shard files; `shard` comes from the folders."""
    return spark.read.schema(f"{schema}, shard string").json(shards)


def lookup_packs(spark: SparkSession, root: str, kinds: dict[str, str]) -> dict[str, DataFrame]:
    """The packs of a folder by name: a missing one is an empty table.  kinds: folder -> type, such as main, secondary, supplement."""
    return {name: read_pack(spark, f"{root}/{name}", kind) for name, kind in kinds.items()}


def read_pack(spark: SparkSession, path: str, pack_type: str, schema: str = EMPTY) -> DataFrame:
    """Rows of a pack under `path` (shards/, manifest/) if its manifest is there and of the type; else no rows.  A filter on `shard` prunes folders."""
    try:
        told = spark.read.json(f"{path}/manifest").where(F.col("packType") == pack_type)
        if not told.isEmpty():
            return read_pack_rows(spark, f"{path}/shards", schema)
    except AnalysisException:
        pass
    return spark.createDataFrame([], f"{schema}, shard string")

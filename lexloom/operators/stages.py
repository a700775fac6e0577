"""Stage tables: versioned Parquet folders under one root, read back with pushed-down predicates."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


_LOCAL: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir, the folder all executors share; a temporary one only in local mode."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = _LOCAL.setdefault(spark.sparkContext.applicationId, "") or tempfile.mkdtemp(prefix="spark-")
        _LOCAL[spark.sparkContext.applicationId] = where
    return where.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder for a table of this application."""
    return f"{shared_root(spark)}/lexloom/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write a stage to the shared folder and read it again: computed once, a lost executor costs no recomputation, and the lineage of loops is cut."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, key: str) -> DataFrame:
    """The rows by key, in as many tasks as a shuffle has: a source of one file, or one row group, is read by one task.

    For rows that cost more to work on than to move: their number is told, or small ones would be put together again.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def clear_stages(spark: SparkSession) -> None:
    """Delete all tables that this application has settled.  For the end of a job: results that were not written anywhere else are gone."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_root(spark)}/lexloom/{spark.sparkContext.applicationId}")
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def write_stage(df: DataFrame, root: str, name: str, version: int = 0) -> None:
    df.write.mode("overwrite").parquet(f"{root}/{name}/v={version}")


def read_stage(spark: SparkSession, root: str, name: str, version: int = 0) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}/v={version}")


def upsert_stage(spark: SparkSession, new: DataFrame, root: str, name: str, key: str, version: int) -> None:
    """The rows of `version` with those of `new` in their place, written as the next version; the last of equal keys in `new` (by `ord`) wins."""
    old = read_stage(spark, root, name, version).withColumn("__new", F.lit(0))
    both = old.unionByName(new.withColumn("__new", F.lit(1)))
    order = [F.col("__new").desc(), *([F.col("ord").desc()] if "ord" in new.columns else [])]
    kept = both.withColumn("__rn", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("__rn = 1").drop("__rn", "__new")
    write_stage(kept, root, name, version + 1)


def stage_has(stage: DataFrame, key: str, value: str) -> bool:
    return not stage.where(F.col(key) == value).isEmpty()

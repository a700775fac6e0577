"""Spark helpers of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.operators.stages import scratch_path, settle  # noqa: F401  (used by the operators of this package)

#: Rows of a side that may be broadcast; a side is counted before it is (ids and fixed-width keys, 64 bytes a row at most: 64 MB).
BROADCAST_ROWS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns, so that extra columns can't clash with the operator's own."""
    return df.select(*[F.col(f"`{c}`") for c in columns])


def fresh(df: DataFrame, name: str) -> str:
    """The name, with underscores before it as long as df has such a column."""
    while name in df.columns:
        name = f"_{name}"
    return name


def small_enough(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    return df.limit(rows + 1).count() <= rows


def join_small(left: DataFrame, right: DataFrame, on: list[str], how: str, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast the right side if its counted rows are within the bound; else an ordinary join."""
    return left.join(F.broadcast(right) if small_enough(right, rows) else right, on, how)

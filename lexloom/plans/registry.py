"""Queries over the given tables, and the SQL that says what each returns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The word list of the English documents in SQL: lex(word, o, n), o = doc_id * 10^7 + place.
LEX = r"""tok AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS pos FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]+') AS w FROM documents WHERE lang = 'en')),
lex AS (SELECT word, min(doc_id * 10000000 + pos) AS o, count(*) AS n FROM tok GROUP BY word)"""

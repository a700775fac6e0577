"""The training-corpus pipeline: five stages, each on all that its predecessor kept.

language_id     documents without a language (no letter, null text) or with a score under 0.4 go
line_dedup      lines that a document of smaller id holds are taken out; documents of which no text is left go
ngram_join      of each group of near duplicates (five words, Jaccard 0.75) the document of smallest id stays
decontaminate   documents that hold a benchmark item go
sentencepiece   doc_id, n_tokens, scores and ids of the best segmentations, decoded text, and digests of ids and decoded text

The stages but the last return the columns of `documents`.  SQL can't express the first and the last; tests/llm checks the
stages against brute force.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm.decontaminate import contamination
from lexloom.llm.language_id import keep_identified
from lexloom.llm.line_dedup import with_lines_removed
from lexloom.llm.ngram_join import near_duplicate_components
from lexloom.llm.sentencepiece_codec import encode
from lexloom.llm.shared import join_small, settle, table

ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_identified(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return with_lines_removed(docs).where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    groups = near_duplicate_components(docs).where("component_id <> doc_id").select("doc_id").distinct()
    return join_small(docs, settle(groups, "near-duplicates"), ["doc_id"], "left_anti").select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = contamination(docs, table(spark, sf_dir, "benchmark")).where("contaminated").select("doc_id").distinct()
    return join_small(docs, settle(found, "contaminated-ids"), ["doc_id"], "left_anti").select(*docs.columns)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return encode(docs, chunk_bytes=1 << 19)  # half the usual: what four stages have left in the executors' memory adds up


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("ngram_join", ngram_join),
    ("decontaminate", decontaminate),
    ("sentencepiece", sentencepiece),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

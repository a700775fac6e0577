"""Queries against their SQL on inputs that the given tables of the smallest size don't hold."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from lexloom.functions.forms import moved_grades, serialise, slot_forms
from lexloom.operators import etymology, lexicon, senses
from lexloom.operators.lexicon import LINK
from lexloom.operators.stages import settle
from lexloom.operators.words import word_list
from lexloom.plans import build_queries
from lexloom.sources import packs
from lexloom.sources.markup import shred

from tests.test_entry import DATA, plain


def agrees(spark, name, where):
    db = duckdb.connect()
    for f in os.listdir(where):
        db.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{where}/{f}')")
    told = db.execute(entry.oracle_sql()[name])
    names = [c[0] for c in told.description]
    df = entry.queries()[name](spark, str(where))
    got = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)
    assert got == sorted((tuple(map(plain, r)) for r in told.fetchall()), key=repr)
    return got


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the given tables are not here")
def test_pack_checks_with_several_files_a_shard(spark, monkeypatch):
    monkeypatch.setattr(packs, "FILE_ROWS", 5)
    agrees(spark, "pack_checks", DATA)


def test_primary_result_of_a_fallback_whose_shown_entry_expands(spark, tmp_path):
    """`ares` is shown as `are`, which a cross-reference to the entry `areer` expands: its own parts, whatever the plural's scope."""
    duckdb.connect().execute(f"COPY (SELECT 1::BIGINT AS doc_id, 'are are ares areer' AS text, 'en' AS lang) TO '{tmp_path}/documents.parquet' (FORMAT parquet)")
    got = agrees(spark, "primary_result", tmp_path)
    assert any("释义:plain" in str(r) for r in got if "ares" in r)


def test_markup_of_one_partition_is_shredded_by_several_tasks(spark, monkeypatch):
    plans = []

    def recorded(df, body):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return shred(df, body)

    monkeypatch.setattr(senses, "shred", recorded)
    lookup = spark.createDataFrame([("a", '<div class="entry"></div>', 1)], "key string, body string, ord long").coalesce(1)
    senses.normalise_entries(lookup)
    senses.wide_rows(lookup)
    assert len(plans) == 2 and all("RepartitionByExpression [key" in p for p in plans)


def test_serialise_computes_its_pairs_once(spark):
    df = spark.createDataFrame([("s:as/p:aed", "adj:100", "a")], "x string, pos string, word string")
    plan = df.select(serialise(moved_grades(slot_forms(df["x"]), df["pos"], df["word"])).alias("y"))._jdf.queryExecution().analyzed().toString().replace(" ", "")
    assert plan.count("filter(split(") == 1


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the given tables are not here")
def test_plural_predicate_asks_each_word_once(spark):
    """A condition on words is not pushed below the counting, to every occurrence of a word."""
    agrees(spark, "plural_predicate", DATA)
    plan = entry.queries()["plural_predicate"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan and "documents" not in plan


def test_words_are_counted_without_a_sort(spark):
    docs = spark.createDataFrame([(-3, "b a b", "en"), (-2, "a c", "en"), (9_000_000_000, "d", "en"), (1, "e", "de")], "doc_id long, text string, lang string")
    words = word_list(docs)
    assert "SortAggregate" not in words._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r) for r in words.collect()} == {("a", -3, 1, 2), ("b", -3, 0, 2), ("c", -2, 1, 1), ("d", 9_000_000_000, 0, 1)}


def test_links_group_their_source_once(spark, monkeypatch):
    """The lookup and the last links come from one reading; a key with a body of its own may have a link beside it."""
    raw = spark.createDataFrame([(0, "a", "own"), (1, "a", LINK + "b"), (2, "b", "own"), (3, "c", LINK + "a"), (4, "d", LINK + "c")], "ord long, key string, body string")
    seen = []
    monkeypatch.setattr(lexicon, "settle", lambda df, name: seen.append(name) or settle(df, name))
    links = lexicon.resolve_links(raw)
    assert "LogicalRDD" not in links._jdf.queryExecution().optimizedPlan().toString() and seen.count("lookup") == 1
    assert {tuple(r) for r in links.collect()} == {("a", "b"), ("c", "a"), ("d", "a")}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the given tables are not here")
@pytest.mark.parametrize("name", ["entry_kinds", "materialised_entries", "link_chains"])
def test_words_of_a_build_are_counted_once(spark, monkeypatch, name):
    counted = []
    monkeypatch.setattr(build_queries, "lex", lambda *a, inner=build_queries.lex: counted.append(a) or inner(*a))
    agrees(spark, name, DATA)
    assert len(counted) == 1


def test_customers_of_one_row_group_are_worked_on_by_several_tasks(spark, tmp_path, monkeypatch):
    """root_shapes, provider_answers and tree_roots: a condition on what is made of the customers is not asked in the one task that reads them."""
    duckdb.connect().execute(f"COPY (SELECT range AS c_custkey FROM range(120)) TO '{tmp_path}/customer.parquet' (FORMAT parquet)")
    for name in ("root_shapes", "provider_answers"):
        agrees(spark, name, tmp_path)
        assert entry.queries()[name](spark, str(tmp_path)).rdd.getNumPartitions() > 1
    seen = []
    monkeypatch.setattr(etymology, "shred", lambda df, body: seen.append(df.rdd.getNumPartitions()) or shred(df, body))
    agrees(spark, "tree_roots", tmp_path)
    assert seen == [int(spark.conf.get("spark.sql.shuffle.partitions"))]

"""The registered queries against their SQL on the smallest given tables, and the entry module without the training-data folders."""

import importlib
import math
import os
import sys

import duckdb
import pytest

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUICK = ["lexicon_words", "lookup_dedupe", "alias_targets", "first_wins_dedupe", "exchange_parse", "plural_infer", "plural_slots", "root_longest", "source_merge", "component_display", "lookup_cascade", "query_routes", "merge_parts", "pos_share", "text_repair", "punctuation", "text_segments", "segment_reassembly", "shard_counts", "list_coverage", "json_flatten", "html_nodes", "language_codes", "link_circles", "meaning_fragments", "meaning_items", "sense_entries", "wide_entries", "word_families", "roots_lines", "entry_rules", "schema_contract", "golden_rows", "tree_roots", "section_roots", "pack_objects", "pack_checks", "stage_upsert", "raw_entries", "source_readers", "provider_answers", "spelling_variants", "root_shapes", "node_meanings", "refined_roots", "source_senses", "manifest_rules", "followup_senses"]


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the given tables are not here")
@pytest.mark.parametrize("name", QUICK)
def test_query_against_sql(spark, name):
    import __spark_entry__ as entry

    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    told = db.sql(entry.oracle_sql()[name])
    df = entry.queries()[name](spark, DATA)
    assert sorted(df.columns) == sorted(told.columns)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    at = [told.columns.index(c) for c in columns]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in told.fetchall()), key=repr)


def test_names():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_without_the_training_data_folders(monkeypatch):
    class Gone:
        def find_spec(self, name, path=None, target=None):
            if name == "corpus_pipeline" or name.startswith("lexloom.llm"):
                raise ModuleNotFoundError(f"No module named {name!r}", name=name)

    for name in [n for n in sys.modules if n.startswith(("lexloom", "corpus_pipeline", "__spark_entry__"))]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setattr(sys, "meta_path", [Gone(), *sys.meta_path])
    entry = importlib.import_module("__spark_entry__")
    assert "inflection_edges" in entry.queries() and not any(n.startswith("op") or n == "pipeline" for n in entry.queries())

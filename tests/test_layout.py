"""Layouts: joins without an exchange, bucket and shard pruning, partial updates equal to a rebuild."""

import random
from pathlib import Path

from pyspark.sql import functions as F

from lexloom.operators import incremental
from lexloom.operators.layout import keyed, lay_out
from lexloom.operators.relate import final_entries
from lexloom.operators.stages import scratch_path

ENTRY = "word string, pos string, translation string, exchange string, ord long"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_laid_out_tables_join_in_place(spark):
    entries = lay_out(keyed(spark.createDataFrame([(f"Word{i}", i) for i in range(300)], "word string, n long")), "entries", buckets=8)
    other = lay_out(spark.createDataFrame([(f"word{i}", -i) for i in range(0, 300, 3)], "key string, m long"), "others", buckets=8)
    met = entries.hint("merge").join(other, "key")
    assert "Exchange" not in _plan(met) and met.count() == 100
    asked = spark.createDataFrame([("word7",), ("word9",), ("none",)], "key string")
    one = entries.hint("merge").join(asked, "key")
    assert _plan(one).count("Exchange hashpartitioning") == 1 and one.count() == 2
    few = entries.where("key = 'word9'").hint("merge").join(other, "key")
    formatted = few._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert formatted.count("SelectedBucketsCount: 1 out of 8") == 2 and few.count() == 1


def _entry(rng, i):
    pos = rng.choice(["n:100", "v:100", "n:60/v:40", "adj:100", "adj:50/n:50"])
    slots = [f"{s}:{rng.choice('abcdefgh')}{rng.choice(['', 's', 'ed', 'er', 'ent'])}" for s in rng.choices(["s", "3", "p", "d", "i", "c", "sup"], k=rng.randint(0, 4))]
    return (i, pos, f"n. {i}\nv. {rng.randint(0, 9)}", "/".join(slots), rng.randint(0, 10**6))


def test_partial_updates_equal_a_rebuild(spark):
    rng = random.Random(8)
    names = [a + b for a in "abcdefgh" for b in ["", "s", "ed", "er", "ent", "x"]]
    have = {n: _entry(rng, n) for n in names if rng.random() < 0.6}
    root = scratch_path(spark, "state")
    incremental.start(spark.createDataFrame(list(have.values()), ENTRY), root, parts=16)
    shown = lambda df: sorted(map(str, df.select(*sorted(df.columns)).collect()))
    for _ in range(3):
        files = {str(p): p.stat().st_mtime_ns for p in Path(root).rglob("*.parquet")}
        changed = [_entry(rng, n) for n in rng.sample(names, 2)]
        removed = [n for n in rng.sample(names, 2) if n not in {c[0] for c in changed}]
        written = incremental.update(spark.createDataFrame(changed, ENTRY), spark.createDataFrame([(r,) for r in removed], "word string"), root, parts=16)
        for n in removed:
            have.pop(n, None)
        have.update({c[0]: c for c in changed})
        want = final_entries(spark.createDataFrame(list(have.values()), ENTRY))
        assert shown(incremental.final(spark, root)) == shown(want)
        for path, at in files.items():
            table, part = Path(path).parts[-3], int(Path(path).parts[-2].removeprefix("part="))
            if part not in written[table]:
                assert Path(path).stat().st_mtime_ns == at
    assert len(written["entries"]) <= 4


def test_pack_lookups_open_asked_shards_only(spark):
    from lexloom.sources import packs, releases

    root = scratch_path(spark, "packs")
    rows = spark.createDataFrame([(f"{c}{i}", "", f"t{i}", "", "") for c in "abcdefgh" for i in range(5)], packs.EMPTY)
    releases.release(rows, f"{root}/main", "words", {}, {})
    pack = packs.lookup_packs(spark, root, {"main": "words"})
    asked = spark.createDataFrame([(1, "a1"), (2, " C3 "), (3, "zz"), (4, None), (5, "")], "query_id long, text string")
    df = releases.lookup_in_packs(asked, pack)
    got = {r["query_id"]: (r["pack"], r["translation"]) for r in df.collect()}
    assert got == {1: ("main", "t1"), 2: ("main", "t3"), 3: (None, None), 4: (None, None), 5: (None, None)}
    plan = releases.only_asked(pack["main"], asked.select(F.lower(F.substring(F.trim("text"), 1, 1)).alias("shard")))
    assert "PartitionFilters: [shard" in _plan(plan) and sorted({r["word"][0] for r in plan.collect()}) == ["a", "c"]


def test_refused_release_leaves_nothing(spark):
    import pytest

    from lexloom.sources import packs, releases

    root = scratch_path(spark, "refused")
    rows = spark.createDataFrame([("a", "", "t", "", ""), ("b", "", "t", "", ""), ("", "", "t", "", "")], packs.EMPTY)
    with pytest.raises(releases.Refused) as refused:
        releases.release(rows, root, "words", {"bad": F.count_if(F.col("word") == "b")}, {"bad": 0})
    assert refused.value.failed == ["bad"] and refused.value.metrics == {"entryCount": 2, "bad": 1}
    assert not list(Path(root).rglob("*.json")) and packs.read_pack(spark, root, "words").isEmpty()
    told = releases.release(rows.limit(0), root, "words", {}, {}).first()
    assert told["entryCount"] == 0

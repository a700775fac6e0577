"""Invariants over rows made of the word list, a part of which breaks each rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.operators import invariants, lexicon, quality, relate
from lexloom.operators.stages import settle
from lexloom.plans.answer_queries import lexicon as answer_entries
from lexloom.plans.build_queries import lex
from lexloom.plans.registry import LEX, query


def broken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries that break rules by s = 7 * length + occurrences."""
    w, s = F.col("word"), F.col("s")
    df = lex(spark, sf_dir).select("word", (F.length("word") * 7 + F.col("n")).alias("s"))
    edge = lambda kind, target, source, display: F.array(F.struct(F.lit(kind).alias("type"), target.alias("target"), F.lit("outgoing").alias("direction"), F.lit(True).alias("navigable"), F.lit(display).alias("display"), F.lit(source).alias("source")))
    relations = F.when(s % 37 == 0, edge("strange", w, "derived", "exchange")).when(s % 4 == 1, edge("origin", F.expr("left(word, length(word) - 1)"), "exchange", "exchange")).when(s % 4 == 2, edge("xref", F.concat(w, F.lit("zz")), "derived", "reference")).when(s % 4 == 3, edge("lexical_origin", w, "word_family", "reference")).otherwise(F.slice(edge("x", w, "x", "x"), 1, 0))
    return df.select(
        F.when(s % 17 == 0, F.concat(F.lit("x"), w)).otherwise(w).alias("key"), F.when(s % 41 == 0, "z").otherwise(F.substring(w, 1, 1)).alias("shard"), F.when(s % 19 == 0, " ").otherwise(w).alias("word"),
        F.when(s % 31 == 0, "other").when(s % 5 == 0, "inflection").when(s % 5 == 1, "alias").otherwise("standalone").alias("entry_kind"),
        F.when(s % 8 == 0, " ").when(s % 8 == 1, "N:50").when(s % 8 == 2, None).otherwise("n+v:50/adj.").alias("pos"), F.when(s % 6 == 0, " ").otherwise("t").alias("translation"),
        F.when(s % 9 == 0, "p:x/bad").when(s % 9 == 1, "").otherwise("s:x/p:y").alias("exchange"), F.when(s % 3 == 1, w).when(s % 3 == 2, F.concat(w, F.lit("zz"))).alias("linked_word"), relations.alias("relations"),
    )


BROKEN = (
    LEX
    + """, b0 AS (SELECT word AS w, length(word) * 7 + n AS s FROM lex), b AS (SELECT *, CASE WHEN s % 17 = 0 THEN 'x' || w ELSE w END AS key, CASE WHEN s % 31 = 0 THEN 'other' WHEN s % 5 = 0 THEN 'inflection' WHEN s % 5 = 1 THEN 'alias' ELSE 'standalone' END AS kind,
  CASE WHEN s % 37 = 0 THEN 'strange' WHEN s % 4 = 1 THEN 'origin' WHEN s % 4 = 2 THEN 'xref' WHEN s % 4 = 3 THEN 'lexical_origin' END AS t, CASE WHEN s % 37 = 0 THEN w WHEN s % 4 = 1 THEN left(w, -1) WHEN s % 4 = 2 THEN w || 'zz' WHEN s % 4 = 3 THEN w END AS target FROM b0),
bad AS (SELECT 'alias_has_link' AS rule, key FROM b WHERE kind = 'alias' AND s % 3 = 0 UNION ALL SELECT 'alias_relations', key FROM b WHERE kind = 'alias' AND t <> 'lexical_origin' UNION ALL SELECT 'exchange_format', key FROM b WHERE s % 9 = 0
  UNION ALL SELECT 'inflection_has_origin', key FROM b WHERE kind = 'inflection' AND coalesce(t, '') <> 'origin' UNION ALL SELECT 'key_is_word', key FROM b WHERE s % 17 = 0 OR s % 19 = 0 UNION ALL SELECT 'kind_known', key FROM b WHERE kind = 'other'
  UNION ALL SELECT 'pos_format', key FROM b WHERE s % 8 < 2 UNION ALL SELECT 'pos_not_blank', key FROM b WHERE s % 8 = 0 UNION ALL SELECT 'relation_values', key FROM b WHERE t = 'strange'
  UNION ALL SELECT 'shard_is_first_letter', key FROM b WHERE left(key, 1) <> CASE WHEN s % 41 = 0 THEN 'z' ELSE left(w, 1) END UNION ALL SELECT 'standalone_has_text', key FROM b WHERE kind = 'standalone' AND s % 6 = 0 AND s % 3 = 0 UNION ALL SELECT 'word_not_empty', key FROM b WHERE s % 19 = 0
  UNION ALL SELECT 'alias_link_exists', key FROM b WHERE kind = 'alias' AND s % 3 > 0 AND CASE s % 3 WHEN 1 THEN w ELSE w || 'zz' END NOT IN (SELECT key FROM b) UNION ALL SELECT 'targets_exist', key FROM b WHERE target NOT IN (SELECT key FROM b)),
names AS (SELECT unnest(['alias_has_link', 'alias_relations', 'exchange_format', 'inflection_has_origin', 'key_is_word', 'kind_known', 'pos_format', 'pos_not_blank', 'relation_values', 'shard_is_first_letter', 'standalone_has_text', 'word_not_empty', 'alias_link_exists', 'targets_exist']) AS rule)"""
)


@query(f"WITH {BROKEN} SELECT rule, count(key) AS violations, coalesce(array_to_string(list_sort(list(key) FILTER (key IS NOT NULL))[1:10], ','), '') AS first FROM names LEFT JOIN bad USING (rule) GROUP BY rule")
def entry_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Violations of every rule with the first ten keys."""
    return invariants.report(settle(broken(spark, sf_dir), "broken-entries")).select("rule", "violations", F.array_join("first", ",").alias("first"))


@query(f"WITH {BROKEN}, pick AS (SELECT key, left(key, 1) AS shard FROM b QUALIFY row_number() OVER (PARTITION BY left(key, 1) ORDER BY md5(key), key) <= 5) SELECT rule, count(*) AS violations FROM bad JOIN pick USING (key) WHERE rule NOT IN ('alias_link_exists', 'targets_exist') GROUP BY rule")
def sampled_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules on single rows over five entries a shard, drawn by hash."""
    entries = settle(broken(spark, sf_dir), "broken-entries")
    drawn = quality.sample_per_shard(entries.select(F.col("key").alias("word"))).select(F.col("word").alias("key"))
    found = invariants.violations(entries.join(drawn, "key", "left_semi")).where(~F.col("rule").isin("alias_link_exists", "targets_exist"))
    return found.groupBy("rule").agg(F.count("*").alias("violations"))


@query(f"WITH {BROKEN}, e AS (SELECT CASE WHEN s % 19 = 0 THEN ' ' ELSE w END AS word, target FROM b) SELECT word, target FROM e WHERE target IS NOT NULL AND target NOT IN (SELECT word FROM e)")
def dangling_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Navigable relations of the broken entries that lead to no entry."""
    return relate.dangling(settle(broken(spark, sf_dir), "broken-entries").select("word", "relations"))


@query(
    f"""WITH {BROKEN}, e AS (SELECT CASE WHEN s % 19 = 0 THEN ' ' ELSE w END AS word, CASE WHEN s % 8 = 0 THEN ' ' WHEN s % 8 = 1 THEN 'N:50' WHEN s % 8 > 2 THEN 'n+v:50/adj.' END AS pos, s FROM b)
SELECT rule, n AS violations FROM (SELECT 'word_not_empty' AS rule, count(*) FILTER (trim(word) = '') AS n FROM e UNION ALL SELECT 'key_is_lower', count(*) FILTER (word <> lower(word)) FROM e UNION ALL SELECT 'pos_not_blank', count(*) FILTER (trim(coalesce(pos, '')) = '') FROM e
UNION ALL SELECT 'pos_format', count(*) FILTER (NOT regexp_full_match(coalesce(pos, ''), '[a-z+]+:\\d+(/[a-z+]+:\\d+)*')) FROM e UNION ALL SELECT 'exchange_format', count(*) FILTER (s % 9 = 0) FROM e UNION ALL SELECT 'letters_only', count(*) FILTER (NOT regexp_full_match(word, '[a-z'' -]+')) FROM e)"""
)
def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules of a flat word table over the broken entries."""
    return quality.suite(broken(spark, sf_dir).select("word", "pos", "exchange"))


def _json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries as JSON; by t = occurrences some have unknown fields, lack fields or have malformed ones."""
    t, w = F.col("n"), F.col("word")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    some = lambda k, good, bad: F.when(t % k == 0, bad).otherwise(good)
    body = text(
        "{", some(7, text('"word":"', w, '",'), ""), some(11, '"entry_kind":"alias"', '"entry_kind":5'), some(5, "", ',"odd":1'), some(13, ',"pos":"n"', ',"pos":["n"]'), some(3, ',"exchange":"s:x"', ',"exchange":["s:x"]'), some(17, ',"parent_relation":null', ',"parent_relation":""'),
        some(4, ',"translation_parts":[{"pos":"n","meanings":[]}]', ',"translation_parts":[{"pos":"n","meanings":[]},{"pos":1,"meanings":[]}]'), some(6, ',"translation_detail_parts":[{"pos":"n","details":[{"text":"a"}]}]', ',"translation_detail_parts":[{"pos":"n","details":[{"text":"a"},{"text":2}]}]'),
        some(9, ',"phrasal_verbs":[{"name":"a","translation":"b"}]', ',"phrasal_verbs":[{"name":"a"}]'), some(10, ',"relations":[{"target":"x","type":"xref","navigable":true}]', ',"relations":[{"target":"x","type":"other","navigable":true}]'), "}",
    )
    return lex(spark, sf_dir).select(w.alias("key"), F.regexp_replace(body, r"^\{,", "{").alias("body"))


@query(
    f"""WITH {LEX}, r AS (SELECT word AS key, unnest([CASE WHEN n % 5 = 0 THEN 'known_fields' END, CASE WHEN n % 7 = 0 THEN 'required_fields' END, CASE WHEN n % 11 = 0 OR n % 13 = 0 OR n % 17 = 0 THEN 'field_types' END, CASE WHEN n % 4 = 0 THEN 'parts' END,
CASE WHEN n % 6 = 0 THEN 'detail_parts' END, CASE WHEN n % 9 = 0 THEN 'phrases' END, CASE WHEN n % 10 = 0 THEN 'relations' END]) AS rule FROM lex) SELECT rule, key FROM r WHERE rule IS NOT NULL"""
)
def schema_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON entries that break the contract."""
    return invariants.contract(_json(spark, sf_dir))


METRICS = f"""{LEX}, e AS (SELECT l.word, l.n, b.word IS NOT NULL AS infl FROM lex l LEFT JOIN lex b ON l.word = b.word || 's'),
tg AS (SELECT word || 's' AS t FROM e UNION ALL SELECT word || 'ed' FROM e UNION ALL SELECT word || 'ly' FROM e UNION ALL SELECT word || 'er' FROM e WHERE n % 2 = 0 UNION ALL SELECT left(word, -2) FROM e WHERE word LIKE '%ed' UNION ALL SELECT left(word, -1) FROM e WHERE infl),
m AS (SELECT count(*) AS entry_count, count(*) FILTER (NOT infl) AS standalone, count(*) FILTER (infl) AS inflection, 0::BIGINT AS alias, 3 * count(*) AS derived_relations, count(*) FILTER (NOT infl AND length(word) <> 5) AS family_missing,
  count(*) FILTER (NOT infl AND n % 3 <> 1 AND n % 4 = 0) AS verb_form_missing, array_to_string(list_sort(list(DISTINCT left(word, 1))), ',') AS shards, (SELECT count(*) FROM tg WHERE t NOT IN (SELECT word FROM lex)) AS dangling_targets, count(DISTINCT left(word, 1))::INT AS shard_count FROM e)"""


def _measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = answer_entries(spark, sf_dir).withColumn("relations", F.transform("relations", lambda r: F.struct(r["type"].alias("type"), r["target"].alias("target"), r["navigable"].alias("navigable"), F.when(r["type"] == "inflection", "derived").otherwise("exchange").alias("source"))))
    return entries.join(lex(spark, sf_dir).select("word", "n"), "word").withColumn("verb_forms", F.when(F.col("n") % 4 != 0, F.col("verb_forms")))


@query(f"WITH {METRICS} SELECT * FROM m")
def entry_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The build's metrics over entries with relations."""
    return invariants.metrics(settle(_measured(spark, sf_dir), "measured")).withColumn("shards", F.array_join("shards", ","))


@query(f"WITH {METRICS} SELECT unnest(['dangling', 'entries', 'standalone', 'shards']) AS rule, unnest([dangling_targets = 0, entry_count > 0, standalone > 0, shard_count > 0]) AS ok FROM m")
def build_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gate of a build on those metrics: entries with dangling targets don't pass."""
    return invariants.gate(invariants.metrics(settle(_measured(spark, sf_dir), "measured")))


@query(f"WITH {METRICS} SELECT k AS entry_kind, n, n > lo AND n < hi AS ok FROM (SELECT unnest(['standalone', 'inflection', 'alias']) AS k, unnest([standalone, inflection, alias]) AS n, unnest([100, 0, 0]) AS lo, unnest([1000000000, 100, 10]) AS hi FROM m)")
def kind_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of entries by kind against bounds."""
    return invariants.kind_ranges(answer_entries(spark, sf_dir), {"standalone": (100, 10**9), "inflection": (0, 100), "alias": (0, 10)})


@query(
    f"""WITH {LEX}, e AS (SELECT l.word, l.n, b.word IS NOT NULL AS infl FROM lex l LEFT JOIN lex b ON l.word = b.word || 's')
SELECT word, 'origin' AS type, left(word, -1) AS target, infl AS ok FROM e WHERE word LIKE '%s' UNION ALL SELECT word || 'q', 'xref', word, false FROM e WHERE word || 'q' NOT IN (SELECT word FROM lex) UNION ALL SELECT word, 'xref', word || 'er', n % 2 = 0 AND NOT infl FROM e WHERE word LIKE '%e'"""
)
def golden_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected kinds and relations, some of them wrong and some of words that aren't there."""
    words = lex(spark, sf_dir).select("word")
    one = words.where("word LIKE '%s'").select("word", F.lit("inflection").alias("entry_kind"), F.lit("origin").alias("type"), F.expr("left(word, length(word) - 1)").alias("target"))
    two = words.select(F.concat("word", F.lit("q")).alias("word"), F.lit("standalone").alias("entry_kind"), F.lit("xref").alias("type"), F.col("word").alias("target")).join(words, "word", "left_anti")
    three = words.where("word LIKE '%e'").select("word", F.lit("standalone").alias("entry_kind"), F.lit("xref").alias("type"), F.concat("word", F.lit("er")).alias("target"))
    return invariants.golden(answer_entries(spark, sf_dir), one.unionByName(two).unionByName(three))


@query(f"WITH {LEX} SELECT word AS base, word || ' up' AS phrase, n % 5 = 0 AS on_base, CASE WHEN word || 's' IN (SELECT word FROM lex) THEN 0 ELSE 1 END + CASE WHEN n % 5 = 0 THEN 1 ELSE 0 END AS on_others FROM lex")
def phrases_on_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrasal verbs expected on a base and not on its plural; the base itself is asked among the others too."""
    expected = lex(spark, sf_dir).select(F.col("word").alias("base"), F.concat("word", F.lit(" up")).alias("phrase"), F.array(F.concat("word", F.lit("s")), "word").alias("others"))
    return invariants.phrase_only_on_base(answer_entries(spark, sf_dir).select("word", "phrasal_verbs"), expected)


@query(f"WITH {LEX} SELECT word AS base, array_to_string(list_sort((CASE WHEN n % 3 = 1 THEN [word || 'er'] ELSE [] END) || (CASE WHEN word = 'les' THEN ['less'] ELSE [] END)), ',') AS forms FROM lex WHERE n % 3 = 1 OR word = 'les'")
def blocked_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forms in slot s that are no plurals, by base (less is always a comparative)."""
    return lexicon.blocked_forms(answer_entries(spark, sf_dir).select("word", "pos", "exchange")).select("base", F.array_join("forms", ",").alias("forms"))


@query(
    f"""WITH {LEX}, e AS (SELECT l.word, l.o, b.word IS NOT NULL AS infl FROM lex l LEFT JOIN lex b ON l.word = b.word || 's'),
t AS (SELECT word || x AS form, word, o, i, lb FROM e, (VALUES ('s', 2, '复数'), ('ed', 3, '过去式'), ('ly', 4, '原形')) AS v(x, i, lb) WHERE NOT infl)
SELECT form AS word, arg_min(word, (o, i)) AS linked_word, arg_min(word, (o, i)) || ' 的' || arg_min(lb, (o, i)) AS translation, arg_min(left(word, 2), (o, i)) AS phonetic_us FROM t WHERE form NOT IN (SELECT word FROM lex) GROUP BY form"""
)
def minimal_inflections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least entries for inflection targets that have none."""
    return relate.materialised_minimal(answer_entries(spark, sf_dir)).select("word", "linked_word", "translation", "phonetic_us")


@query(f"WITH {LEX} SELECT word FROM lex WHERE n % 3 = 0 AND n % 2 = 0")
def plural_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nouns without a plural of their own for which one is inferred: not if all noun senses are uncountable."""
    kind = F.when(F.col("n") % 2 == 1, "uncountable").otherwise("both")
    details = F.array(F.struct(F.lit("n.").alias("pos"), F.array(F.struct(F.lit("t").alias("text"), F.lit("uncountable").alias("countability")), F.struct(F.lit("u").alias("text"), kind.alias("countability"))).alias("details")))
    words = lex(spark, sf_dir).where("n % 3 = 0 OR n % 3 = 1")
    entries = words.select("word", F.lit("n:100").alias("pos"), F.when(F.col("n") % 3 == 1, F.concat(F.lit("s:"), "word", F.lit("s"))).otherwise("").alias("exchange"), (F.col("doc_id") * 10_000_000 + F.col("pos")).alias("ord"), details.alias("details"))
    entries = settle(entries, "nouns")  # read several times; what is asked of a word would be asked of each of its occurrences otherwise
    return lexicon.inflection_rows(entries).where("phase = 2").select(F.col("base").alias("word"))

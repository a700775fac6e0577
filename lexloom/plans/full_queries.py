"""From markup to lookups: raw rows written from the customers, the whole build over them, and what lookups show."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.operators import answers
from lexloom.operators.build import build
from lexloom.operators.lexicon import LINK
from lexloom.operators.stages import settle
from lexloom.plans.build_queries import PLURAL_SQL
from lexloom.plans.registry import query, table
from lexloom.plans.sense_queries import KEPT, MEANINGS, OLD, bodies


def raw_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ord, key, body: the sense queries' bodies; members of their families (fam…); words with a noun and a verb entry (m…); links: past forms, aliases (x…), links to aliases (y…), and to nothing (q…)."""
    k = F.col("c_custkey")
    df = table(spark, sf_dir, "customer").select(k.alias("k"), F.translate(k.cast("string"), "0123456789", "abcdefghij").alias("z"))
    k, z = F.col("k"), F.col("z")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    entry = lambda pos, meaning, more="": text(f'<div class="entry"><span class="pos">{pos}</span><ol><li class="sense"><deft><chn>{meaning}', z, "</chn></deft></li></ol>", more, "</div>")
    forms = text('<table class="verb_forms_table"><tr form="past"><td>m', z, "ed</td></tr></table>")
    row = lambda test, add, key, body: df.where(test).select((k + add).alias("ord"), text(*key).alias("key"), body.alias("body"))
    made = bodies(spark, sf_dir).select("ord", "key", "body")
    made = made.unionByName(row((k % 36 == 0) & (k % 13 != 0), 10_000_000, ("fam", z), entry("noun", "族")))
    made = made.unionByName(row(k % 7 == 3, 20_000_000, ("m", z), F.concat(entry("noun", "名"), entry("verb", "动", forms))))
    link = lambda test, add, key, target: row(test, add, (key, z) if isinstance(key, str) else key, text(LINK, *target))
    made = made.unionByName(link(k % 12 == 1, 30_000_000, ("w", z, "ed"), ("w", z)))
    made = made.unionByName(link(k % 5 == 2, 40_000_000, "x", ("w", z))).unionByName(link(k % 10 == 2, 50_000_000, "y", ("x", z)))
    return made.unionByName(link(k % 50 == 0, 60_000_000, "q", ("nowhere", z)))


def _told(column: str, *fields: str) -> Column:
    return F.array_join(F.transform(column, lambda x: F.concat_ws(":", *[F.coalesce(x[f].cast("string"), F.lit("")) for f in fields])), "|")


FULL = f"""{KEPT}, e AS (SELECT *, CASE k % 4 WHEN 0 THEN 'n' WHEN 1 THEN 'v' WHEN 2 THEN 'adj' ELSE 'n+v' END AS p, CASE k % 4 WHEN 0 THEN 'n.' WHEN 1 THEN 'v.' WHEN 2 THEN 'adj.' ELSE 'n. / v.' END AS l, {MEANINGS} AS m,
  CASE WHEN k % 11 = 0 AND k % 3 = 1 THEN '习语:' WHEN k % 11 = 0 THEN 'base' || z || ' 的过去式:' ELSE '甲' || z || ',乙' || {OLD} || ':' || CASE k % 5 WHEN 0 THEN 'countable' WHEN 1 THEN 'uncountable' WHEN 2 THEN 'both' ELSE '' END || CASE WHEN k % 2 = 0 THEN ',(口)丙' || z || '的:' ELSE '' END END AS d FROM c WHERE k % 13 <> 0),
w AS (SELECT k AS ord, k, z, 'w' || z AS word, CASE WHEN k % 3 <> 0 THEN 'b' || z ELSE '' END AS phonetic, 'n' || z AS phonetic_us, p || ':100' AS pos, l || ' ' || array_to_string(m, '；') AS translation, l || ':' || array_to_string(m, '；') AS parts, l || ':' || d AS details,
  CASE k % 4 WHEN 1 THEN '3:w' || z || 's/p:w' || z || 'ed' WHEN 0 THEN 's:w' || z || 'es' WHEN 2 THEN 's:more x/c:w' || z || 'er' ELSE '' END AS exchange,
  CASE WHEN k % 4 = 1 THEN 'past:过去式:he / it:w' || z || 'ed:p' || z || '|thirdps:第三人称单数::w' || z || 's:|thirdps:第三人称单数::w' || z || 'ing:' ELSE '' END AS verb_forms,
  CASE k % 18 WHEN 0 THEN 'fam' || z || ':noun|fam' || z || 'ly:adverb' WHEN 6 THEN 'lk' || z || ':adjective|lm' || z || ':verb' WHEN 12 THEN 'fa' || z || ':noun|fb' || z || ':verb' ELSE '' END AS family,
  CASE WHEN k % 10 = 5 THEN coalesce((SELECT 'w' || e.z1 || ':' || n.l || ' ' || array_to_string(n.m, '；') FROM e n WHERE n.k = e.k + 1), '') ELSE '' END AS phrasal_verbs FROM e),
fam AS (SELECT k + 10000000 AS ord, k, z, 'fam' || z AS word, '' AS phonetic, '' AS phonetic_us, 'n:100' AS pos, 'n. 族' || z AS translation, 'n.:族' || z AS parts, 'n.:族' || z || ':' AS details, '' AS exchange, '' AS verb_forms, 'fam' || z || ':noun|fam' || z || 'ly:adverb' AS family, '' AS phrasal_verbs FROM c WHERE k % 36 = 0 AND k % 13 <> 0),
mm AS (SELECT k + 20000000 AS ord, k, z, 'm' || z AS word, '' AS phonetic, '' AS phonetic_us, 'n:50/v:50' AS pos, 'n. 名' || z || chr(10) || 'v. 动' || z AS translation, 'n.:名' || z || '|v.:动' || z AS parts, 'n.:名' || z || ':|v.:动' || z || ':' AS details, 'p:m' || z || 'ed' AS exchange, 'past:过去式::m' || z || 'ed:' AS verb_forms, '' AS family, '' AS phrasal_verbs FROM c WHERE k % 7 = 3),
own AS (SELECT * FROM w UNION ALL SELECT * FROM fam UNION ALL SELECT * FROM mm),
edge AS (SELECT word, 1 AS i, CASE k % 4 WHEN 1 THEN '第三人称单数' WHEN 0 THEN '复数' ELSE '比较级' END AS label, word || CASE k % 4 WHEN 1 THEN 's' WHEN 0 THEN 'es' ELSE 'er' END AS form, 'exchange' AS source FROM w WHERE k % 4 < 3
  UNION ALL SELECT word, 2, '过去式', word || 'ed', 'exchange' FROM w WHERE k % 4 = 1 UNION ALL SELECT word, 1, '过去式', word || 'ed', 'exchange' FROM mm
  UNION ALL SELECT w, 2, '复数', {PLURAL_SQL}, 'derived' FROM (SELECT word AS w FROM mm UNION ALL SELECT word FROM fam)),
rel AS (SELECT word, string_agg('inflection:' || label || ':' || form || ':' || source || ':', '|' ORDER BY i) AS relations FROM edge GROUP BY word),
x AS (SELECT 'x' || z AS word, 'w' || z AS linked FROM c WHERE k % 5 = 2 UNION ALL SELECT 'y' || z, 'w' || z FROM c WHERE k % 10 = 2),
made AS (SELECT own.*, label, form FROM edge JOIN own USING (word) WHERE form NOT IN (SELECT word FROM own)),
part AS (SELECT *, CASE label WHEN '复数' THEN 1 ELSE 2 END AS h, word LIKE 'm%' AS two FROM made),
final AS (SELECT own.word, phonetic, phonetic_us, pos, translation, parts, details, exchange, verb_forms, family, phrasal_verbs, 'standalone' AS entry_kind, own.word AS display_word, NULL AS linked_word, coalesce(relations, '') AS relations FROM own LEFT JOIN rel USING (word)
UNION ALL SELECT x.word, phonetic, phonetic_us, pos, translation, parts, details, exchange, verb_forms, family, phrasal_verbs, 'alias', linked, linked, '' FROM x JOIN own ON own.word = linked
UNION ALL SELECT form, phonetic, phonetic_us, CASE WHEN two THEN string_split(pos, '/')[h] ELSE pos END, CASE WHEN two THEN string_split(translation, chr(10))[h] ELSE translation END, CASE WHEN two THEN string_split(parts, '|')[h] ELSE parts END, CASE WHEN two THEN string_split(details, '|')[h] ELSE details END,
  array_to_string(list_filter(string_split(exchange, '/'), lambda y: y LIKE CASE label WHEN '复数' THEN 's' WHEN '过去式' THEN 'p' WHEN '比较级' THEN 'c' ELSE '3' END || ':%'), '/'), verb_forms, family, '', 'inflection', word, word, 'origin:' || label || ':' || word || ':derived:true' FROM part)"""


@query(f"WITH {FULL} SELECT * FROM final")
def full_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every column of every final entry, relations in order, from markup and links."""
    df = build(raw_rows(spark, sf_dir))
    parts = F.array_join(F.transform("parts", lambda p: F.concat(p["pos"], F.lit(":"), F.array_join(p["meanings"], "；"))), "|")
    details = F.array_join(F.transform("details", lambda p: F.concat(p["pos"], F.lit(":"), F.array_join(F.transform(p["details"], lambda d: F.concat(d["text"], F.lit(":"), F.coalesce(d["countability"], F.lit("")))), ","))), "|")
    return df.select(
        "word", "phonetic", "phonetic_us", "pos", "translation", parts.alias("parts"), details.alias("details"), "exchange", _told("verb_forms", "form", "label", "subject", "word", "phonetic").alias("verb_forms"), _told("family", "word", "pos").alias("family"),
        _told("phrasal_verbs", "name", "translation").alias("phrasal_verbs"), "entry_kind", "display_word", "linked_word", _told("relations", "type", "label", "target", "source", "primary").alias("relations"),
    )


RESULT = f"""{FULL},
sound AS (SELECT *, array_to_string(list_filter(['uk:' || phonetic, 'us:' || phonetic_us], lambda y: length(y) > 3), '|') AS phonetics, array_to_string(list_filter(string_split(family, '|'), lambda y: NOT starts_with(y, word || ':')), '|') AS related FROM own),
told AS (SELECT word, string_agg(label || ':' || forms, '|' ORDER BY list_position(['复数', '第三人称单数', '过去式', '比较级'], label)) AS exchanges FROM (
  SELECT word, label, string_agg(form, ',' ORDER BY i) AS forms FROM (SELECT word, label, form, i FROM edge UNION ALL SELECT word, '第三人称单数', word || 'ing', 9 FROM w WHERE k % 4 = 1 UNION ALL SELECT word, '复数', 'more x', 0 FROM w WHERE k % 4 = 2) GROUP BY word, label) GROUP BY word),
result AS (SELECT sound.word, phonetics, parts || CASE WHEN phrasal_verbs = '' THEN '' ELSE '| :|' || phrasal_verbs END AS parts, coalesce(exchanges, '') AS exchanges, related FROM sound LEFT JOIN told USING (word)
UNION ALL SELECT part.form, phonetics, CASE WHEN two THEN string_split(sound.parts, '|')[h] ELSE sound.parts END, label || ':' || sound.word, related FROM part JOIN sound USING (word)
UNION ALL SELECT x.word, phonetics, parts, '', related FROM x JOIN sound ON sound.word = linked)"""


@query(f"WITH {RESULT} SELECT * FROM result")
def full_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a lookup of each final entry's word shows, from markup to result."""
    entries = settle(build(raw_rows(spark, sf_dir)), "final-entries").withColumn("ord", F.xxhash64("word"))
    df = answers.primary_results(entries.select(F.col("ord").alias("query_id"), F.col("word").alias("text")), entries)
    listed = lambda c, a, b: F.array_join(F.transform(c, lambda x: F.concat(x[a], F.lit(":"), F.array_join(x[b], ","))), "|")
    return df.select("word", _told("phonetics", "type", "value").alias("phonetics"), listed("parts", "part", "means").alias("parts"), listed("exchanges", "name", "words").alias("exchanges"), F.coalesce(_told("related", "word", "pos"), F.lit("")).alias("related"))

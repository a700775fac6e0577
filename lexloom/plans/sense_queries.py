"""Dictionary markup written from the customers and read again by the sense extractors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.operators import senses
from lexloom.operators.stages import settle
from lexloom.plans.registry import query, table

POS_NAMES = ["Noun", "verb", "adjective", "noun, verb"]
GRAMMAR = ["[countable]", "[uncountable]", "[countable, uncountable]", "", "[usually singular]"]


def bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key, body, ord: an entry a customer; what it has depends on its number k, its words are spelt with z, the number in letters."""
    k = F.col("c_custkey")
    df = table(spark, sf_dir, "customer").select(k.alias("k"), F.translate(k.cast("string"), "0123456789", "abcdefghij").alias("z"))
    k, z = F.col("k"), F.col("z")
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    some = lambda test, *parts: F.when(test, text(*parts)).otherwise("")
    family = (
        F.when(k % 18 == 0, text('<div class="wordfamily">Word Family <span class="p"><b class="wfw">fam', z, '</b> <i class="wfp">n.</i></span><span class="p"><b class="wfw">fam', z, 'ly</b> <i class="wfp" wfp="adverb">x</i></span></div>'))
        .when(k % 18 == 6, text('<div unbox="wordfamily">WORD FAMILY <b class="xh">lk', z, '</b> <i>adj.</i> <u><a href="entry://x">lm', z, '</a> verb</u></div>'))
        .when(k % 18 == 12, text("<p>Word family: fa", z, " noun (≠ zz verb), fb", z, " v word noun fa", z, " noun</p>"))
        .otherwise("")
    )
    first = text(
        '<li class="sense" cefr="a1">', some(k % 7 == 0, '<span class="labels"><span class="lb">old-fashioned</span></span>'), '<span class="grammar">', pick(GRAMMAR, k), "</span> <deft><chn>甲", z, "，乙</chn></deft><span class=\"def\">first  def ", z, "</span></li>",
    )
    second = some(k % 2 == 0, '<li class="sense" cefr="b2"><span class="dis-g"><chn>口</chn></span><deft><chn>丙', z, '的</chn></deft><span class="def">second</span></li>')
    none = k % 11 == 0
    body = text(
        '<div class="entry"><span class="pos">', F.when(k % 13 == 0, "???").otherwise(pick(POS_NAMES, k)), "</span>",
        some(k % 3 != 0, '<div class="phons_br"><span class="phon">/b', z, '/</span><a class="sound" href="sound://a', z, '.mp3"></a></div>'), '<div class="phons_n_am"><span class="phon">/n', z, "/</span></div>",
        F.when(none, text('<div class="xrefs" xt="ptof"><span class="xh">base', z, "</span></div>")).otherwise(text("<ol>", first, second, "</ol>")),
        some(k % 3 == 1, '<div class="idioms"><div class="idm-g"><span class="idm">go|on ', z, '</span><ol><li class="sense"><deft><chn>习语</chn></deft></li></ol></div></div>'),
        some(k % 4 == 1, '<table class="verb_forms_table"><tr form="past"><td><span class="vf_prefix">he / it</span> w', z, 'ed</td><td><span class="phon">/p', z, '/</span></td></tr><tr form="thirdps"><td>w', z, 's</td></tr><tr form="thirdps"><td>w', z, "ing</td></tr><tr form=\"thirdps\"><td>w", z, "s</td></tr></table>"),
        some(k % 4 == 0, '<div class="inflections">plural <span class="inflected_form">w', z, "es</span></div>"), some(k % 4 == 2, '<div class="inflections"><span class="inflected_form">w', z, 'er</span><span class="inflected_form">more x</span></div>'),
        some(k % 5 == 0, '<span class="ox3ksym_b1"></span>'), some(k % 10 == 5, '<div class="phrasal_verb_links"><ul class="pvrefs"><li><a class="xh">w', F.translate((k + 1).cast("string"), "0123456789", "abcdefghij"), '</a></li><li><a class="xh">no where</a></li></ul></div>'),
        family, "</div>",
    )
    return df.select(F.concat(F.lit("w"), z).alias("key"), body.alias("body"), k.alias("ord"))


Z = "translate(c_custkey::VARCHAR, '0123456789', 'abcdefghij')"
KEPT = f"c AS (SELECT c_custkey AS k, {Z} AS z, translate((c_custkey + 1)::VARCHAR, '0123456789', 'abcdefghij') AS z1 FROM customer)"
OLD = "CASE WHEN k % 7 = 0 THEN ' [老式用法]' ELSE '' END"
#: Entries with nothing but an idiom's sense show that one, entries without any sense their cross-reference.
MEANINGS = f"""CASE WHEN k % 11 = 0 AND k % 3 = 1 THEN [CASE WHEN k % 4 = 2 THEN '习语的' ELSE '习语' END] WHEN k % 11 = 0 THEN ['base' || z || ' 的过去式'] ELSE [CASE WHEN k % 4 = 2 THEN '甲' || z || ',乙' || {OLD} || '的' ELSE '甲' || z || ',乙' || {OLD} END] || CASE WHEN k % 2 = 0 THEN ['(口)丙' || z || '的'] ELSE [] END END"""


@query(
    f"""WITH {KEPT}, e AS (SELECT *, CASE k % 4 WHEN 0 THEN 'n' WHEN 1 THEN 'v' WHEN 2 THEN 'adj' ELSE 'n+v' END AS p, CASE k % 4 WHEN 0 THEN 'n.' WHEN 1 THEN 'v.' WHEN 2 THEN 'adj.' ELSE 'n. / v.' END AS l, {MEANINGS} AS m FROM c WHERE k % 13 <> 0)
SELECT 'w' || z AS word, CASE WHEN k % 3 <> 0 THEN 'b' || z ELSE '' END AS phonetic, 'n' || z AS phonetic_us, l || ' ' || array_to_string(m, '；') AS translation, p || ':100' AS pos,
  CASE k % 4 WHEN 1 THEN '3:w' || z || 's/p:w' || z || 'ed' WHEN 0 THEN 's:w' || z || 'es' WHEN 2 THEN 's:more x/c:w' || z || 'er' ELSE '' END AS exchange,
  CASE WHEN k % 4 = 1 THEN 'past:过去式:he / it:w' || z || 'ed:p' || z || '|thirdps:第三人称单数::w' || z || 's:|thirdps:第三人称单数::w' || z || 'ing:' ELSE '' END AS verb_forms,
  CASE k % 18 WHEN 0 THEN 'fam' || z || ':noun|fam' || z || 'ly:adverb' WHEN 6 THEN 'lk' || z || ':adjective|lm' || z || ':verb' WHEN 12 THEN 'fa' || z || ':noun|fb' || z || ':verb' ELSE '' END AS family,
  l || '=' || array_to_string(list_transform(CASE WHEN k % 11 = 0 AND k % 3 = 1 THEN ['习语/'] WHEN k % 11 = 0 THEN ['base' || z || ' 的过去式/'] ELSE ['甲' || z || ',乙' || {OLD} || '/' || CASE k % 5 WHEN 0 THEN 'countable' WHEN 1 THEN 'uncountable' WHEN 2 THEN 'both' ELSE '' END] || CASE WHEN k % 2 = 0 THEN ['(口)丙' || z || '的/'] ELSE [] END END, lambda x: x), ',') AS details FROM e"""
)
def sense_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries with translation, part of speech, exchange, verb forms, family and details."""
    df = senses.normalise_entries(bodies(spark, sf_dir))
    joined = lambda c, *fields: F.array_join(F.transform(c, lambda x: F.concat_ws(":", *[F.coalesce(x[f], F.lit("")) for f in fields])), "|")
    details = F.array_join(F.transform("details", lambda p: F.concat(p["pos"], F.lit("="), F.array_join(F.transform(p["details"], lambda d: F.concat(d["text"], F.lit("/"), F.coalesce(d["countability"], F.lit("")))), ","))), "|")
    return df.select("word", "phonetic", "phonetic_us", "translation", "pos", "exchange", joined("verb_forms", "form", "label", "subject", "word", "phonetic").alias("verb_forms"), joined("family", "word", "pos").alias("family"), details.alias("details"))


@query(
    f"""WITH {KEPT}, t AS (SELECT 'w' || z AS w, CASE k % 4 WHEN 0 THEN 'n.' WHEN 1 THEN 'v.' WHEN 2 THEN 'adj.' ELSE 'n. / v.' END || ' ' || array_to_string({MEANINGS}, '；') AS t FROM c WHERE k % 13 <> 0)
SELECT 'w' || z AS word, 'w' || z1 || '=' || t.t AS phrasal_verbs FROM c JOIN t ON t.w = 'w' || z1 WHERE k % 13 <> 0 AND k % 10 = 5"""
)
def sense_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrasal verbs whose own entries have a translation."""
    entries = settle(senses.normalise_entries(bodies(spark, sf_dir)).select("word", "phrasal_names", "translation"), "sense-entries")
    df = senses.phrasal_verbs(entries)
    return df.select("word", F.array_join(F.transform("phrasal_verbs", lambda p: F.concat(p["name"], F.lit("="), p["translation"])), "|").alias("phrasal_verbs"))


@query(
    f"""WITH {KEPT}, e AS (SELECT *, CASE k % 4 WHEN 0 THEN 'n' WHEN 1 THEN 'v' WHEN 2 THEN 'adj' ELSE 'n+v' END AS p, CASE WHEN (k + 1) % 11 = 0 THEN CASE WHEN (k + 1) % 3 = 1 THEN ' 习语' ELSE '' END ELSE ' 甲' || z1 || ',乙' END AS pm,
  'w' || z1 IN (SELECT 'w' || z FROM c) AS has FROM c WHERE k % 13 <> 0 AND k % 11 <> 0),
x AS (SELECT *, CASE k % 4 WHEN 1 THEN 'p:w' || z || 'ed/3:w' || z || 's/3:w' || z || 's' WHEN 0 THEN 's:w' || z || 'es' WHEN 2 THEN 's:w' || z || 'er/s:more x' ELSE '' END AS ex, CASE WHEN k % 10 = 5 THEN ['w' || z1 || CASE WHEN has THEN pm ELSE '' END, 'no where'] ELSE [] END AS ph FROM e)
SELECT 'w' || z AS word, 'w' || z AS sw, CASE WHEN k % 3 <> 0 THEN 'b' || z ELSE 'n' || z END AS phonetic, CASE WHEN k % 4 = 3 THEN '' ELSE p || '. first def ' || z || CASE WHEN k % 2 = 0 THEN ', second' ELSE '' END END AS definition,
  array_to_string((CASE WHEN k % 4 = 3 THEN [] ELSE [p || '. 甲' || z || CASE WHEN k % 2 = 0 THEN '，丙' || z || '的' ELSE '' END] END) || (CASE k % 4 WHEN 1 THEN ['词形变化：', '第三人称单数：w' || z || 's', '过去式：w' || z || 'ed'] WHEN 0 THEN ['词形变化：', '复数形式：w' || z || 'es'] WHEN 2 THEN ['词形变化：', '复数形式：more x'] ELSE [] END)
    || (CASE WHEN len(ph) > 0 THEN ['Phrasal Verbs：'] || list_transform(ph, lambda y: translate(y, ',', '，')) ELSE [] END), chr(10)) AS translation,
  p || ':100' AS pos, 0 AS collins, (k % 5 = 0)::INT AS oxford, CASE WHEN k % 2 = 0 THEN 'a1,b2' ELSE 'a1' END AS tag, NULL::INT AS bnc, NULL::INT AS frq, ex AS exchange, array_to_string(ph, chr(10)) AS detail, CASE WHEN k % 3 <> 0 THEN 'a' || z || '.mp3' ELSE '' END AS audio,
  CASE WHEN k % 3 = 1 THEN 'go | on ' || z ELSE '' END AS idioms FROM x"""
)
def wide_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The old wide rows of the same bodies."""
    return senses.wide_rows(bodies(spark, sf_dir))

"""Rules that ordinary words rarely meet, each reached by a part of the customers: provider answers, spelling pairs, meanings of roots, coarse roots, plural sources, manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.operators import etymology, fragments, quality, results, roots
from lexloom.plans.registry import query
from lexloom.plans.root_queries import C, numbered, text


def by_rest(k: Column, choices: list[Column]) -> Column:
    """The choice that the rest of k names."""
    out = choices[-1]
    for i, c in enumerate(choices[:-1]):
        out = F.when(k % len(choices) == i, c).otherwise(out)
    return out


ANSWERS = [
    '{"ec":{"word":[{"ukphone":"/u@/","usphone":"[s@]","prototype":"p@","wfs":[{"wf":{"name":" 复数","value":"@s "}},{"wf":{"name":"","value":"x"}},{"wf":{"name":"y"}}],"trs":[{"pos":"n.","tran":" t@ "},{"pos":"n.","tran":"t@"},{"tr":[{"l":{"i":["a","b@"]}}]}]},{"trs":[{"pos":"v.","tran":"second"}]}]}}',
    '{"ec":{"word":[]},"ce":{"word":{"phone":"/q@/","trs":[{"pos":"adj.","tran":"c@","tr":[{"l":{"i":["d@"]}}]},{"pos":"n.","tran":"e@"},{"pos":" adj. ","tran":"f@"}]}},"ee":{"word":{"phone":"other","trs":[{"pos":"n.","tr":[{"tran":"other"}]}]}}}',
    '{"ec":{"word":{"usspeech":"/s@/","ukspeech":"k","trs":[{"pos":"n.","tran":"  "}]}},"ee":{"word":{"trs":[{"pos":"n.","tr":[{"tran":"gloss @"},{"tran":""}]},{"tr":[{"tran":"bare @"}]}]}}}',
    '{"ec":{"word":[]},"note":"@"}',
    '{"ec":{"word":{"ukspeech":"k@","trs":[{"pos":"int.","tr":[{"l":{"i":"[医] h@"}}]}]}},"ee":{"word":{"phone":"[y@]"}}}',
    '{"ec":{"word":[{"phone":"","ukspeech":"k@","trs":[{"pos":"v.","tran":"m@"}]}]}}',
]


@query(
    f"""WITH {C} SELECT k AS query_id,
  CASE k % 6 WHEN 0 THEN 'uk=u' || z || ' us=s' || z WHEN 1 THEN 'uk=q' || z WHEN 2 THEN 'us=/s' || z || '/' WHEN 4 THEN 'uk=y' || z ELSE 'uk=k' || z END AS phonetics,
  CASE k % 6 WHEN 0 THEN 'n.:t' || z || ' 释义:ab' || z WHEN 1 THEN 'adj.:c' || z || '/d' || z || '/f' || z || ' n.:e' || z WHEN 2 THEN 'n.:gloss ' || z || ' 释义:bare ' || z WHEN 4 THEN 'int.:[医] h' || z ELSE 'v.:m' || z END AS parts,
  CASE WHEN k % 6 = 0 THEN '复数=' || z || 's 原形=p' || z ELSE '' END AS exchanges FROM c WHERE k % 6 <> 3"""
)
def provider_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored answers as result rows: first of several words, object or list, the other direction, the monolingual part, what is heard in its order."""
    c = numbered(spark, sf_dir)
    body = F.replace(by_rest(F.col("k"), [F.lit(a) for a in ANSWERS]), F.lit("@"), F.col("z"))
    df = results.provider_results(c.select(F.col("k").alias("query_id"), body.alias("body")))
    pairs = lambda column, a, b: F.array_join(F.transform(column, lambda x: F.concat(x[a], F.lit("="), x[b])), " ")
    parts = F.array_join(F.transform("parts", lambda x: F.concat(x["part"], F.lit(":"), F.array_join(x["meanings"], "/"))), " ")
    return df.select("query_id", pairs("phonetics", "type", "value").alias("phonetics"), parts.alias("parts"), pairs("exchanges", "name", "word").alias("exchanges"))


@query(f"WITH {C} SELECT k, CASE k % 4 WHEN 0 THEN 'canceled|' || z WHEN 1 THEN ' Travelled|' || z WHEN 2 THEN z || '|TRAVELED ' ELSE 'traveled|traveling' END AS words FROM c")
def spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of two spellings of a form one is hidden, if both are there."""
    k, z = F.col("k"), F.col("z")
    lists = [F.array(F.lit("cancelled"), F.lit("canceled"), z), F.array(F.lit(" Travelled"), z), F.array(F.lit("travelled "), z, F.lit("TRAVELED "), F.lit("Travelled")), F.array(F.lit("traveled"), F.lit("traveling"))]
    return numbered(spark, sf_dir).select("k", F.array_join(results.without_variants(by_rest(k, lists)), "|").alias("words"))


SHAPES = [
    "词根 r@ = to grow, 表示“成长”", "后缀 -r@, -s@ 表示形容词，“…的”", "前缀 r@- = up, “向上”", "词根 r@ = grow up 成长，长大起来",
    "词根 r@ = boil", "词根 r@", "前缀 r@- 表示“从，离开…，向外” 词根 s@ ＝ carry。", "词根 r@ 表示“一二三四五六”",
]


@query(
    f"""WITH {C} SELECT k, 'r' || z AS root, CASE k % 8 WHEN 0 THEN '= to grow，成长' WHEN 1 THEN '形容词' WHEN 2 THEN '= up, “，向上' WHEN 3 THEN '= grow up，成长' WHEN 4 THEN '= boil' WHEN 6 THEN '向外' ELSE '一二三四五六' END AS meaning FROM c WHERE k % 8 <> 5
UNION ALL SELECT k, 's' || z, CASE k % 8 WHEN 1 THEN '形容词' ELSE '= carry' END FROM c WHERE k % 8 IN (1, 6)"""
)
def root_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every shape of a root's definition: quoted, named before a quotation, quoted after a comma, behind the English, English alone, none, several in a text."""
    told = F.replace(by_rest(F.col("k"), [F.lit(s) for s in SHAPES]), F.lit("@"), F.col("z"))
    return etymology.root_definitions(numbered(spark, sf_dir).select("k", told.alias("root_text"))).select("k", "root", "meaning")


DESCRIBED = [
    "[['= back, 表示“后面@”']]", "表动词，“做，造成”等。", "= x, 一二三四五六七八九，十一二三四五六七八", "表示“一二三四五六七八九十一二三四五六七八”",
    "表示“(from) abc 来自, from @”", "plain words @", "表示“abc”", "表n, @人等。",
]


@query(
    f"""WITH {C} SELECT k, CASE k % 8 WHEN 0 THEN '后面' || z WHEN 1 THEN '做，造成' WHEN 2 THEN '一二三四五六七八九，十一二三四五六七八' WHEN 3 THEN '一二三四五六七八九十一二三四五六七八' WHEN 4 THEN '(from) abc 来自, from ' || z WHEN 5 THEN '' WHEN 6 THEN 'abc' ELSE z || '人' END AS meaning,
  CASE k % 8 WHEN 0 THEN '后面' || z WHEN 1 THEN '做，造成' WHEN 2 THEN '一二三四五六七八九' WHEN 3 THEN '一二三四五六七八九十一二三四五' WHEN 4 THEN '来自' WHEN 5 THEN '' WHEN 6 THEN 'abc' ELSE '人' END AS short FROM c"""
)
def node_meanings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Meanings of mind map nodes by each pattern, and as they are shortened: brackets, English before and after, a cut at a comma, a hard cut, nothing left."""
    told = F.replace(by_rest(F.col("k"), [F.lit(s) for s in DESCRIBED]), F.lit("@"), F.col("z"))
    df = numbered(spark, sf_dir).select("k", etymology.described_meaning(told).alias("meaning"))
    return df.select("k", "meaning", roots.shorten(F.col("meaning")).alias("short"))


@query(
    f"""WITH {C} SELECT 'w' || z AS word, CASE k % 5 WHEN 0 THEN 'ad-（加强） + ol（生长，al- 变体） + -ent' WHEN 1 THEN 'ad-（加强） + ol（生长，al- 变体） + x' || z || '（g）' WHEN 3 THEN 're-（again） + ad-（加强） + ol（生长，al- 变体） + -esc（起始态）' ELSE 'old' || z END AS breakdown,
  CASE k % 5 WHEN 0 THEN 3 WHEN 1 THEN 3 WHEN 2 THEN 2 WHEN 3 THEN 4 ELSE 0 END AS n FROM c"""
)
def refined_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coarse roots in parts: affixes and unknown roots stay, roots without a name go, entries without a known root or without any stay as they are."""
    k, z = F.col("k"), F.col("z")
    pair = lambda root, meaning: F.struct((F.lit(root) if isinstance(root, str) else root).alias("root"), F.lit(meaning).alias("meaning"))
    lists = [F.array(pair("adul", "grown"), pair("-ent", "")), F.array(pair("adul", "grown"), pair("", "lost"), pair(text("x", z), " g ")), F.array(pair("", "kept"), pair(text("x", z), "h")), F.array(pair("re-", "again"), pair("adolesc", None))]
    given = by_rest(k, [*lists, F.slice(lists[0], 1, 0)])
    df = roots.refine(numbered(spark, sf_dir).select(text("w", z).alias("word"), given.alias("roots"), text("old", z).alias("breakdown")))
    return df.select("word", "breakdown", F.size("roots").alias("n"))


@query(
    f"""WITH {C} SELECT k AS query_id, 'n.' AS part, 'own ' || z AS meanings FROM c WHERE k % 2 = 0
UNION ALL SELECT k, '[B' || z || CASE WHEN k % 3 = 2 THEN ' 的过去式]' ELSE ' 的复数]' END, CASE WHEN k % 3 = 2 THEN 't3' WHEN k % 2 = 0 THEN 't1/t2/t4' ELSE 't1/t4' END FROM c"""
)
def source_senses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Senses of a form's source: those that its label allows, and no uncountable one for a plural that isn't a word of its own."""
    c = numbered(spark, sf_dir)
    k, z = F.col("k"), F.col("z")
    relation = lambda label, direction: F.struct(F.lit("origin").alias("type"), F.lit(direction).alias("direction"), text("B", z).alias("target"), label.alias("label"))
    label = F.when(k % 3 == 2, "过去式").otherwise("复数")
    asked = c.select(k.alias("query_id"), F.when(k % 2 == 0, "standalone").otherwise("inflection").alias("entry_kind"), text("n. own ", z).alias("translation"), F.array(relation(label, "outgoing"), relation(label, "outgoing"), relation(F.lit("最高级"), "incoming")).alias("relations"))
    detail = lambda pos, told, count: F.struct(F.lit(pos).alias("pos"), F.lit(told).alias("text"), F.lit(count).cast("string").alias("countability"))
    entries = c.select(text("b", z).alias("word"), F.array(detail("n.", "t1", "countable"), detail("n.", "t2", "uncountable"), detail("v.", "t3", None), detail("n.", "t4", "both"), detail("n.", "t1", None)).alias("details"))
    return results.grouped_source_parts(asked, entries).select("query_id", "part", F.array_join("meanings", "/").alias("meanings"))


#: Rules of a manifest in the order in which the customers break them (those of rest 0 break none).
BROKEN = ["strings", "type", "date", "counts", "counts", "files", "names", "names", "names", "dangling", "metrics", "metrics", "layout", "layout"]


@query(f"WITH {C} SELECT k, CASE WHEN k % 15 > 0 THEN {BROKEN!r}[k % 15] ELSE '' END AS broken FROM c")
def manifest_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules that each of many manifests breaks: one fault in each, all kinds of faults."""
    r = F.col("k") % (len(BROKEN) + 1)
    spoilt = lambda rest, bad, good: F.when(r == rest, F.lit(bad)).otherwise(F.lit(good))
    file = lambda name: F.struct(name.alias("name"))
    second = F.when(r == 7, "a/b.json").when(r == 8, "b.txt").when(r == 9, "a.json").otherwise("b.json")
    manifests = numbered(spark, sf_dir).select(
        "k", F.lit("1").alias("schemaVersion"), spoilt(1, "", "2").alias("dataVersion"), F.lit("3").alias("pipelineVersion"), spoilt(2, "other", "words").alias("packType"), spoilt(3, "soon", "2020-01-02T03:04:05Z").alias("generatedAt"),
        spoilt(4, 0, 9).alias("entryCount"), F.when(r == 5, -2).when(r == 6, 3).otherwise(2).alias("shardCount"), F.array(file(F.lit("a.json")), file(second)).alias("files"),
        spoilt(10, 1, 0).alias("danglingNavigableTargets"), spoilt(11, -1, 4).alias("syntheticRelationCount"), F.lit(0).alias("wordFamilyMissingCount"), F.when(r != 12, 5).alias("verbFormMissingCount"),
        F.struct(spoilt(13, "other", "shards").alias("shardSubdir"), spoilt(14, ".txt", ".json").alias("shardExtension")).alias("layout"),
    )
    rules = quality.check_manifest(manifests, "words", ["k"]).where("NOT ok OR rule = 'type'")
    # a shard count of -2 is no count of files either: the first rule broken counts
    return rules.groupBy("k").agg(F.coalesce(F.min(F.when(~F.col("ok"), F.col("rule"))), F.lit("")).alias("broken"))


@query(f"WITH {C} SELECT k, '甲' || z || ',乙/ ' || CASE k % 3 WHEN 0 THEN '(口)丙' || z WHEN 1 THEN '存在' ELSE '(口)存在' END || '/countable' AS items FROM c")
def followup_senses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a later sense adds: with a qualifier a fragment that says more than 存在, if it has one."""
    k, z = F.col("k"), F.col("z")
    record = lambda told, qualifier, count: F.struct(told.alias("text"), qualifier.alias("qualifier"), F.lit(count).cast("string").alias("countability"))
    later = F.when(k % 3 == 2, "存在").otherwise(text("存在,丙", z))
    records = F.array(record(text("甲", z, ",乙"), F.lit(""), None), record(later, F.when(k % 3 == 1, "").otherwise("口"), "countable"))
    df = fragments.meaning_items(numbered(spark, sf_dir).select("k", records.alias("records")), "records")
    return df.select("k", F.array_join(F.transform("items", lambda x: F.concat(x["text"], F.lit("/"), F.coalesce(x["countability"], F.lit("")))), " ").alias("items"))

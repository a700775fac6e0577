"""Packs released, refused, checked for order, looked up by shard; sources with rejects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.operators import quality, relate
from lexloom.operators.lexicon import stripped_parents
from lexloom.operators.stages import scratch_path, settle
from lexloom.plans.build_queries import lex
from lexloom.plans.pack_queries import FLAT, flat
from lexloom.plans.registry import LEX, query, table
from lexloom.sources import packs, releases

METRICS = {"signed": "count_if(startswith(word, '#'))", "soundless": "count_if(phonetic IS NULL)", "danglingNavigableTargets": "sum(CASE WHEN word = '' THEN 1 ELSE 0 END)"}


@query(
    f"""WITH {FLAT}, t AS (SELECT count(*) AS n, count(*) FILTER (n % 7 = 0) AS s, count(*) FILTER (n % 2 = 1) AS q FROM f)
SELECT 'released' AS pack, n AS "entryCount", s AS signed, q AS soundless, 0 AS "danglingNavigableTargets", '' AS failed, n AS n_rows FROM t UNION ALL SELECT 'refused', n, s, q, 0, 'signed', 0 FROM t UNION ALL SELECT 'negative', n, -n, q, 0, 'signed', 0 FROM t"""
)
def released_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pack that passes its gates, one with more signed words than allowed, and one with a negative metric: metrics seen, the gates that failed, rows to be read after it."""
    rows, out = settle(flat(spark, sf_dir), "release-rows"), None
    plain = {c: F.expr(said) for c, said in METRICS.items()}
    negative = {**plain, "signed": -F.count(F.lit(1))}
    for name, metrics, most in (("released", plain, {"danglingNavigableTargets": 0}), ("refused", plain, {"signed": 0}), ("negative", negative, {})):
        root, failed = scratch_path(spark, name), ""
        try:
            told = releases.release(rows, root, "words", metrics, most).select("entryCount", *METRICS).first().asDict()
        except releases.Refused as refused:
            told, failed = refused.metrics, ",".join(refused.failed)
        read = packs.read_pack(spark, root, "words").agg(F.count("*").alias("n_rows"))
        one = read.select(F.lit(name).alias("pack"), *[F.lit(told[c]).cast("long").alias(c) for c in ("entryCount", *METRICS)], F.lit(failed).alias("failed"), "n_rows")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"WITH {LEX}, a AS (SELECT word FROM lex WHERE word LIKE 'a%'), z AS (SELECT max(word) AS last FROM a) SELECT word AS key, 'zz' AS before, 'in a file' AS place FROM (SELECT min(word) AS word FROM lex WHERE word LIKE 'b%') WHERE word IS NOT NULL UNION ALL SELECT 'a', last, 'between files' FROM z WHERE last > 'a'")
def misplaced_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard files of the words in order, and two that are not: a row before the words in b that is above them all, and a second file of the words in a that begins again with `a`."""
    root, words = scratch_path(spark, "order"), lex(spark, sf_dir).select("word")
    packs.write_shards(words, f"{root}/good", "letter")
    some = lambda test, first: words.where(test).unionByName(spark.createDataFrame([(first,)] if first else [], "word string")).select("word", (F.col("word") != (first or "")).alias("late"))
    file = lambda df, at: df.coalesce(1).sortWithinPartitions("late", "word").select("word").write.json(f"{root}/{at}")
    file(some("word LIKE 'b%'", "zz"), "spoilt/shard=b/part=0")
    file(some("word LIKE 'a%'", None), "spoilt/shard=a/part=0")
    file(some("false", "a"), "spoilt/shard=a/part=1")
    place = F.when(F.col("file").contains("shard=a"), "between files").otherwise("in a file")
    return releases.misplaced(spark, f"{root}/spoilt").select("key", "before", place.alias("place")).unionByName(releases.misplaced(spark, f"{root}/good").select("key", "before", F.lit("untouched").alias("place")))


@query(
    rf"""WITH {LEX}, p AS (SELECT word, CASE WHEN n % 3 = 0 THEN 'main' WHEN n % 3 = 1 THEN 'supplement' END AS pack, n FROM lex),
q AS (SELECT conv_id * 1000 + turn AS query_id, lower(w) AS word FROM (SELECT conv_id, turn, regexp_extract(text, '[A-Za-z]+', 0) AS w FROM conversations WHERE text IS NOT NULL) WHERE w <> '')
SELECT query_id, q.word, pack, CASE pack WHEN 'main' THEN 'm' || n WHEN 'supplement' THEN 's' || n END AS translation FROM q LEFT JOIN p ON p.word = q.word AND pack IS NOT NULL"""
)
def pack_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first words of all turns looked up in two packs on disk and one that isn't there; a supplement word that the main pack has too is answered by the main pack."""
    root, words = scratch_path(spark, "packs"), settle(lex(spark, sf_dir).select("word", "n"), "pack-words")
    n = F.col("n")
    fields = lambda said: [F.lit("").alias("phonetic"), said.alias("translation"), F.lit("").alias("pos"), F.lit("").alias("exchange")]
    releases.release(words.where(n % 3 == 0).select(F.when(n % 2 == 0, F.initcap("word")).otherwise(F.col("word")).alias("word"), *fields(F.concat(F.lit("m"), "n"))), f"{root}/main", "words", {}, {})
    releases.release(words.where(n % 3 < 2).select("word", *fields(F.concat(F.lit("s"), "n"))), f"{root}/supplement", "words", {}, {})
    have = packs.lookup_packs(spark, root, {"main": "words", "secondary": "words", "supplement": "words"})
    first = F.regexp_extract("text", "[A-Za-z]+", 0)
    asked = table(spark, sf_dir, "conversations").where("text IS NOT NULL").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), first.alias("text")).where("text <> ''")
    return releases.lookup_in_packs(asked, have)


@query(f"""WITH {LEX} SELECT 'kept' AS reason, count(*) AS n FROM lex WHERE n % 3 <> 0 UNION ALL SELECT 'malformed', count(*) FROM lex WHERE n % 3 = 0 AND n % 2 = 0 UNION ALL SELECT 'no entries', count(*) FROM lex WHERE n % 3 = 0 AND n % 2 = 1 UNION ALL SELECT 'nothing told', count(*) FROM lex WHERE n % 5 = 0""")
def rejected_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Morpheme chunks, a line each: what is kept, cut-off lines, lines without entries, words about which a chunk tells nothing."""
    path, n, quoted = scratch_path(spark, "chunks"), F.col("n"), lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    words = settle(lex(spark, sf_dir).select("word", "n"), "chunk-words")
    good = F.concat(F.lit('{"entries": {'), quoted(F.col("word")), F.lit(': {"morphemes": [], "etymologyOrigin": "x"}}}'))
    line = F.when(n % 3 != 0, good).when(n % 2 == 0, F.expr("left(word, 1)")).otherwise(F.lit('{"other": 1}'))
    line = F.when((n % 3 == 0) & (n % 2 == 0), F.concat(F.lit('{"entries": {'), quoted(F.col("word")), F.lit(": "))).otherwise(line)
    empty = words.where(n % 5 == 0).select(F.concat(F.lit('{"entries": {'), quoted(F.concat(F.lit("-"), "word")), F.lit(': {"morphemes": []}}}')).alias("value"))
    words.select(line.alias("value")).unionByName(empty).write.text(path)
    kept, bad = releases.read_morphemes_with_rejects(spark, path)
    rows = kept.select(F.lit("kept").alias("reason")).unionByName(bad.select("reason"))
    kinds = spark.createDataFrame([("kept",), ("malformed",), ("no entries",), ("nothing told",)], "reason string")
    return kinds.join(rows.groupBy("reason").agg(F.count("*").alias("n")), "reason", "left").select("reason", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


@query(
    rf"""WITH {LEX}, d AS (SELECT word, n, CASE n % 4 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 't' || n END AS t, CASE WHEN n % 5 = 0 THEN '#' || word WHEN n % 7 = 0 THEN 'É' || word ELSE word END AS w FROM lex)
SELECT 'rows' AS source, CASE WHEN n % 5 = 0 THEN '_' WHEN n % 7 = 0 THEN 'é' ELSE left(w, 1) END AS shard, lower(w) AS word, t AS value FROM d WHERE t <> '' UNION ALL SELECT 'objects', '', lower(w), t FROM d WHERE t <> ''"""
)
def dictionary_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A relational dictionary of which rows without a translation are skipped, written as shards by letter as it is, and as objects that are read back as maps."""
    n, word = F.col("n"), F.col("word")
    text = F.when(n % 4 == 1, "").when(n % 4 > 1, F.concat(F.lit("t"), "n"))
    given = lex(spark, sf_dir).select(F.when(n % 5 == 0, F.concat(F.lit("#"), word)).when(n % 7 == 0, F.concat(F.lit("É"), word)).otherwise(word).alias("word"), F.lit(None).cast("string").alias("phonetic"), text.alias("translation"), F.lit("n").alias("pos"), F.lit("").alias("exchange"), F.lit(1).alias("extra"))
    rows, root = settle(packs.read_lexicon(spark, table=given), "dictionary"), scratch_path(spark, "dictionary")
    packs.write_shards(rows, f"{root}/rows", "letter_as_is")
    packs.write_shard_objects(rows, f"{root}/objects", "letter_as_is")
    back = packs.read_pack_rows(spark, f"{root}/rows").select(F.lit("rows").alias("source"), "shard", "word", F.col("translation").alias("value"))
    maps = packs.read_map_shards(spark, f"{root}/objects", "struct<word:string,translation:string>").select(F.lit("objects").alias("source"), F.lit("").alias("shard"), "word", F.col("entry.translation").alias("value"))
    return back.unionByName(maps)


@query(f"WITH {LEX}, f AS (SELECT word FROM lex UNION ALL SELECT upper(word) FROM lex WHERE n % 3 = 0 UNION ALL SELECT word FROM lex WHERE n % 6 = 0) SELECT word AS key, CASE WHEN n % 6 = 0 THEN 3 ELSE 2 END AS n FROM lex WHERE n % 3 = 0")
def duplicate_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys met more than once, in any case."""
    words = lex(spark, sf_dir).select("word", "n")
    each = words.select("word").unionByName(words.where("n % 3 = 0").select(F.upper("word").alias("word"))).unionByName(words.where("n % 6 = 0").select("word"))
    return quality.duplicate_keys(each)


@query(
    f"""WITH {LEX}, b AS (SELECT word AS b, o FROM lex WHERE length(word) BETWEEN 4 AND 6 AND word NOT LIKE '%q%')
SELECT b AS word, 'standalone' AS entry_kind, 'inflection:过去式:' || b || 'qo:exchange:|inflection:过去分词:' || b || 'qa:exchange:|inflection:现在分词:' || b || 'qing:exchange:' AS relations FROM b
UNION ALL SELECT b || 'qo', 'standalone', 'origin:过去式:' || b || ':derived:true|inflection:过去分词:' || b || 'qa:derived:|inflection:现在分词:' || b || 'qing:derived:' FROM b
UNION ALL SELECT b || 'qa', 'standalone', 'origin:过去分词:' || b || ':derived:true|inflection:现在分词:' || b || 'qing:derived:' FROM b
UNION ALL SELECT b || 'qing', 'inflection', 'origin:现在分词:' || b || ':derived:true' FROM b"""
)
def irregular_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verbs with irregular past forms that are entries themselves: these take the verb as their origin and lead on to its later forms, in order."""
    base = lex(spark, sf_dir).where("length(word) BETWEEN 4 AND 6 AND word NOT LIKE '%q%'").select("word", (F.col("doc_id") * 10_000_000 + F.col("pos")).alias("ord"))
    told = F.concat(F.lit("p:"), "word", F.lit("qo/d:"), "word", F.lit("qa/i:"), "word", F.lit("qing"))
    one = lambda word, exchange, later: base.select(word.alias("word"), F.lit("v:100").alias("pos"), F.lit("v. a").alias("translation"), exchange.alias("exchange"), (F.col("ord") + later).alias("ord"))
    entries = one(F.col("word"), told, 0).unionByName(one(F.concat("word", F.lit("qo")), F.lit(""), 10**12)).unionByName(one(F.concat("word", F.lit("qa")), F.lit(""), 2 * 10**12))
    df = relate.final_entries(settle(entries, "irregular"))
    shown = F.array_join(F.transform("relations", lambda r: F.concat_ws(":", r["type"], r["label"], r["target"], r["source"], F.coalesce(r["primary"].cast("string"), F.lit("")))), "|")
    return df.select("word", "entry_kind", shown.alias("relations"))


@query(
    f"""WITH {LEX}, c AS (SELECT word, CASE WHEN word LIKE '%ings' THEN [left(word, -1), left(word, -1)] WHEN word LIKE '%ing' THEN [left(word, -3)] WHEN word LIKE '%s' THEN [left(word, -1)] ELSE [] END AS t FROM lex)
SELECT c.word, coalesce(a.word, b.word) AS parent FROM c LEFT JOIN lex a ON a.word = t[1] LEFT JOIN lex b ON b.word = t[2] WHERE coalesce(a.word, b.word) IS NOT NULL"""
)
def stripped_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words in -s and -ing whose rest is a word of the list."""
    words = settle(lex(spark, sf_dir).select("word"), "stripped")
    return stripped_parents(words, words.select(F.col("word").alias("key")))

"""Lookups answered in full over a lexicon made of the word list."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.operators import answers
from lexloom.operators.stages import settle
from lexloom.plans.build_queries import lex
from lexloom.plans.registry import LEX, query

EDGE = "struct<type:string,target:string,label:string,direction:string,navigable:boolean,display:string,pos_scope:array<string>,primary:boolean>"


def lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of the word list with relations of every kind, some of them to words that are none."""
    words = settle(lex(spark, sf_dir).select("word", "n", (F.col("doc_id") * 10_000_000 + F.col("pos")).alias("ord")), "answer-words")
    bases = words.select(F.concat("word", F.lit("s")).alias("word"), F.col("word").alias("base"))
    df = words.join(bases, "word", "left")
    none = F.lit(None)

    def edge(kind, target, label, primary=none, display="exchange", navigable=True):  # noqa: ANN001
        return F.struct(F.lit(kind).alias("type"), target.alias("target"), F.lit(label).alias("label"), F.lit("outgoing").alias("direction"), F.lit(navigable).alias("navigable"), F.lit(display).alias("display"), none.cast("array<string>").alias("pos_scope"), primary.cast("boolean").alias("primary"))

    w = F.col("word")
    cut = lambda k: F.substring(w, F.lit(1), F.length(w) - k)
    edges = [
        F.when(w.endswith("ed"), edge("origin", cut(2), "过去式")),
        F.when(F.col("base").isNotNull(), edge("origin", F.col("base"), "复数", F.lit(True))),
        edge("inflection", F.concat(w, F.lit("s")), "复数"),
        edge("inflection", F.concat(w, F.lit("ed")), "过去式"),
        edge("inflection", F.concat(w, F.lit("ly")), "原形", display="hidden"),
        F.when(F.col("n") % 2 == 0, edge("xref", F.concat(w, F.lit("er")), "比较级", display="reference")),
        edge("xref", F.concat(w, F.lit("y")), "see", navigable=False),
    ]
    kind = F.when(F.col("base").isNotNull(), "inflection").otherwise("standalone")
    family = F.array(*[F.struct(F.concat(F.substring(w, 1, 4), F.lit(e)).alias("word"), F.lit(p).alias("pos"), F.lit(r).alias("relation")) for e, p, r in (("", "n", ""), ("s", "Verb", "kin"), ("ed", "adj", None))])
    phrases = F.array(F.struct(F.concat(w, F.lit(" up")).alias("name"), F.lit("phrv. go\nplain").alias("translation")))
    forms = F.array(*[F.struct(F.lit(f).alias("form"), F.concat(F.lit(a), w, F.lit(b)).alias("word")) for f, a, b in (("past", "(esp) ", "ed"), ("prespart", "", "ing"), ("odd", "", "x"))])
    return df.select(
        "word", "ord", kind.alias("entry_kind"), F.when(F.col("n") % 3 == 1, "adj:50/n:50").otherwise("n:60/v:40").alias("pos"), F.concat(F.lit("n. a"), F.col("n").cast("string"), F.lit("\nv. b\n\nplain")).alias("translation"),
        F.concat(F.lit("s:"), w, F.lit("s/p:"), w, F.lit("ed/s:"), w, F.lit("er/q:x/i:")).alias("exchange"), F.coalesce("base", "word").alias("display_word"), none.cast("string").alias("linked_word"),
        F.when(F.col("n") % 2 == 1, F.substring(w, 1, 3)).alias("phonetic"), F.substring(w, 1, 2).alias("phonetic_us"), forms.alias("verb_forms"),
        F.when(F.col("n") % 5 == 0, phrases).otherwise(F.slice(phrases, 1, 0)).alias("phrasal_verbs"), F.when(F.length(w) == 5, family).otherwise(F.slice(family, 1, 0)).alias("family"),
        F.array_compact(F.array(*edges)).cast(f"array<{EDGE}>").alias("relations"),
    )


#: e: entries; org: existing origins of each word in order (i), with label and scope; vw: how each word is shown.
VIEWS = (
    LEX
    + """, e AS (SELECT l.word, l.n, l.o, b.word AS base FROM lex l LEFT JOIN lex b ON l.word = b.word || 's'),
org AS (SELECT w, i, t, label FROM (SELECT word AS w, 1 AS i, left(word, -2) AS t, '过去式' AS label FROM e WHERE word LIKE '%ed' UNION ALL SELECT word, 2, base, '复数' FROM e WHERE base IS NOT NULL UNION ALL SELECT word, 3, word || 'er', '比较级' FROM e WHERE n % 2 = 0) WHERE t IN (SELECT word FROM lex)),
oc AS (SELECT w, count(DISTINCT label) AS kinds, bool_or(i = 3) AS x, arg_min(t, CASE i WHEN 2 THEN 0 ELSE i END) FILTER (i < 3) AS bt, arg_min(label, CASE i WHEN 2 THEN 0 ELSE i END) FILTER (i < 3) AS bl FROM org GROUP BY w),
vw AS (SELECT e.*, coalesce(kinds, 0) > 0 AS has, coalesce(kinds > 1 OR (base IS NULL AND x), false) AS ex, bt, bl, coalesce(x, false) AS x FROM e LEFT JOIN oc ON oc.w = e.word),
view_ AS (SELECT word AS w, n, o, base, has, ex, bt, bl, x, CASE WHEN ex THEN word ELSE coalesce(base, word) END AS shown FROM vw)"""
)

RESULT_SQL = f"""WITH {VIEWS},
raw AS (SELECT w, bl AS label, bt AS word, 0 AS p FROM view_ WHERE shown = w AND bt IS NOT NULL
  UNION ALL SELECT w, '复数', w || 's', 10 FROM view_ WHERE shown = w AND w || 's' IN (SELECT word FROM lex) UNION ALL SELECT w, '过去式', w || 'ed', 11 FROM view_ WHERE shown = w AND w || 'ed' IN (SELECT word FROM lex)
  UNION ALL SELECT w, '过去式', w || 'ed', 20 FROM view_ WHERE shown = w AND base IS NULL UNION ALL SELECT w, '现在分词', w || 'ing', 21 FROM view_ WHERE shown = w AND base IS NULL
  UNION ALL SELECT w, '复数', w || 's', 30 FROM view_ WHERE shown = w UNION ALL SELECT w, '过去式', w || 'ed', 31 FROM view_ WHERE shown = w
  UNION ALL SELECT w, CASE WHEN n % 3 = 1 THEN '比较级' ELSE '复数' END, w || 'er', 32 FROM view_ WHERE shown = w
  UNION ALL SELECT w, '原形', t, 40 + i FROM view_ JOIN org USING (w) WHERE shown = w AND ex),
form AS (SELECT w, label, word, min(p) AS p FROM raw GROUP BY ALL),
rows_ AS (SELECT w, list_position(['原形', '复数', '第三人称单数', '过去式', '过去分词', '现在分词', '比较级', '最高级'], label) AS r, label || ':' || string_agg(word, ',' ORDER BY p) AS t FROM form GROUP BY w, label
  UNION ALL SELECT w, 9, '原形:' || w || 'er' FROM view_ WHERE shown = w AND x UNION ALL SELECT w, 1, bl || ':' || bt FROM view_ WHERE shown <> w),
told AS (SELECT w, t, min(r) AS r FROM rows_ GROUP BY w, t), exch AS (SELECT w, string_agg(t, '|' ORDER BY r) AS exchanges FROM told GROUP BY w),
own AS (SELECT w, 0 AS g, i, m.p || ':' || m.t AS t FROM (SELECT w, n, unnest([{{p: 'n.', t: 'a' || n}}, {{p: 'v.', t: 'b'}}, {{p: '释义', t: 'plain'}}]) AS m, unnest([1, 2, 3]) AS i FROM view_ WHERE shown = w AND NOT (ex AND base IS NOT NULL))
  UNION ALL SELECT v.w, 0, 1, 'n.:a' || s.n FROM view_ v JOIN view_ s ON s.w = v.shown WHERE v.shown <> v.w AND NOT s.ex
  UNION ALL SELECT w, 0, i, m.p || ':' || m.t FROM (SELECT v.w, unnest([{{p: 'n.', t: 'a' || s.n}}, {{p: 'v.', t: 'b'}}, {{p: '释义', t: 'plain'}}]) AS m, unnest([1, 2, 3]) AS i FROM view_ v JOIN view_ s ON s.w = v.shown WHERE v.shown <> v.w AND s.ex AND s.base IS NULL)
  UNION ALL SELECT v.w, 1, CASE label WHEN '复数' THEN 0 ELSE 1 END, '[' || t || ' 的' || label || ']:' || CASE label WHEN '复数' THEN 'a' || lex.n ELSE 'b' END FROM view_ v JOIN view_ s ON s.w = v.shown JOIN org ON org.w = s.w JOIN lex ON lex.word = t WHERE s.ex AND i < 3
  UNION ALL SELECT w, 2, 1, ' :' FROM view_ WHERE shown = w AND base IS NULL AND n % 5 = 0 UNION ALL SELECT w, 2, 2, w || ' up:v. go,plain' FROM view_ WHERE shown = w AND base IS NULL AND n % 5 = 0),
part AS (SELECT w, string_agg(t, '|' ORDER BY g, i) AS parts FROM own GROUP BY w),
fam AS (SELECT word AS ow, o, unnest([left(word, 4), left(word, 4) || 's', left(word, 4) || 'ed']) AS m FROM lex WHERE length(word) = 5),
near AS (SELECT q.word, arg_min(left(ow, 4), fam.o) AS four FROM lex q JOIN fam ON fam.m = q.word AND left(ow, 1) = left(q.word, 1) GROUP BY q.word),
rel AS (SELECT lex.word, CASE WHEN length(lex.word) = 5 THEN left(lex.word, 4) ELSE four END AS four FROM lex LEFT JOIN near ON near.word = lex.word)
SELECT v.w AS word, CASE WHEN s.n % 2 = 1 THEN 'uk:' || left(s.word, 3) || '|' ELSE '' END || 'us:' || left(s.word, 2) AS phonetics, coalesce(parts, '') AS parts, coalesce(exchanges, '') AS exchanges,
  coalesce(array_to_string(list_transform(list_filter([{{w: four, p: 'noun'}}, {{w: four || 's', p: 'verb'}}, {{w: four || 'ed', p: 'adjective'}}], lambda y: y.w <> v.shown), lambda y: y.w || ':' || y.p), '|'), '') AS related
FROM view_ v JOIN lex s ON s.word = v.shown LEFT JOIN part ON part.w = v.w LEFT JOIN exch ON exch.w = v.w LEFT JOIN rel ON rel.word = v.shown"""


@query(RESULT_SQL)
def primary_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The full result of a lookup of every word."""
    entries = settle(lexicon(spark, sf_dir), "answer-entries")
    df = answers.primary_results(entries.select(F.col("ord").alias("query_id"), F.col("word").alias("text")), entries)
    two = lambda c, a, b: F.array_join(F.transform(c, lambda x: F.concat(x[a], F.lit(":"), F.array_join(x[b], ",") if b in ("means", "words") else x[b])), "|")
    return df.select("word", two("phonetics", "type", "value").alias("phonetics"), two("parts", "part", "means").alias("parts"), two("exchanges", "name", "words").alias("exchanges"), F.coalesce(two("related", "word", "pos"), F.lit("")).alias("related"))


FAMILY_SQL = f"""WITH {LEX}, fam AS (SELECT word AS ow, o, unnest([left(word, 4), left(word, 4) || 's', left(word, 4) || 'ed']) AS m FROM lex WHERE length(word) = 5),
near AS (SELECT q.word, arg_min(left(ow, 4), fam.o) AS four FROM lex q JOIN fam ON fam.m = q.word AND left(ow, 1) = left(q.word, 1) GROUP BY q.word)
SELECT lex.word, coalesce(array_to_string(list_transform(list_filter([{{w: f, t: ':noun:词族'}}, {{w: f || 's', t: ':verb:kin'}}, {{w: f || 'ed', t: ':adjective:词族'}}], lambda y: y.w <> lex.word), lambda y: y.w || y.t), '|'), '') AS family
FROM (SELECT lex.word, CASE WHEN length(lex.word) = 5 THEN left(lex.word, 4) ELSE four END AS f FROM lex LEFT JOIN near ON near.word = lex.word) lex"""


@query(FAMILY_SQL)
def word_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Own families, and those found in another entry of the shard."""
    df = answers.families(lexicon(spark, sf_dir).select("word", "ord", "family"))
    return df.select("word", F.array_join(F.transform("family", lambda m: F.concat(m["word"], F.lit(":"), m["pos"], F.lit(":"), m["relation"])), "|").alias("family"))


def _roots_sql() -> str:
    pairs = lambda d: "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in d.items()) + "}"
    shown = {k: f"{a}（{b}）" for k, (a, b) in answers.SHOWN.items()}
    lines = {k: " + ".join(shown.get(t, t) for t in v) for k, v in answers.COMPONENTS.items()}
    fixed = ", ".join(f"('{w}')" for w in answers.LINES)
    return f"""WITH {LEX}, w AS (SELECT word, n FROM lex UNION ALL SELECT word, length(word) FROM (VALUES {fixed}) AS t(word) WHERE word NOT IN (SELECT word FROM lex)),
s AS (SELECT word, n, CASE WHEN n % 2 = 0 THEN 'm' || n WHEN n % 3 = 0 THEN 's' || n END AS b, coalesce(({pairs(answers.SUMMARIES)})[word], CASE n % 4 WHEN 0 THEN '' WHEN 1 THEN 'x y' ELSE 'line two' END) AS y FROM w)
SELECT word, coalesce(b, '') AS breakdown, y AS summary, CASE WHEN b IS NULL AND y = '' THEN NULL WHEN ({pairs(answers.LINES)})[word] IS NOT NULL THEN '词根词缀=' || ({pairs(answers.LINES)})[word]
  WHEN ({pairs(lines)})[word] IS NOT NULL AND y <> '' THEN '词根词缀=' || ({pairs(lines)})[word] || ' → ' || y WHEN b IS NOT NULL THEN '词根拆解=' || b || CASE WHEN y <> '' THEN ' → ' || y ELSE '' END ELSE '词根拆解=' || y END AS line FROM s"""


@query(_roots_sql())
def roots_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roots lines of the words and of those with fixed lines, breakdowns from two packs."""
    words = lex(spark, sf_dir).select("word", "n")
    fixed = spark.createDataFrame([(w, len(w)) for w in answers.LINES], "word string, n long").join(words, "word", "left_anti")
    words = settle(words.unionByName(fixed), "roots-words")
    main = words.select("word", F.when(F.col("n") % 2 == 0, F.concat(F.lit("m"), "n")).otherwise("").alias("breakdown"))
    more = words.where("n % 3 = 0 OR n % 2 = 0").select("word", F.concat(F.lit("s"), "n").alias("breakdown"))
    df = answers.roots_lookup(words, main, more).join(words, "word")
    parts = F.array(F.struct(F.lit("n.").alias("pos"), F.array(F.when(F.col("n") % 4 == 1, " x  y ").otherwise("")).alias("meanings")))
    text = F.when(F.col("n") % 4 == 0, "\n ").otherwise(" \n line   two \nthree")
    df = df.withColumn("summary", answers.short_summary(F.col("word"), parts, F.when(F.col("n") % 4 != 1, text)))
    line = answers.roots_line(F.col("word"), F.col("breakdown"), F.col("summary"))
    return df.select("word", F.coalesce("breakdown", F.lit("")).alias("breakdown"), "summary", F.concat(line["name"], F.lit("="), line["value"]).alias("line"))

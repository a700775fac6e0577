"""Lexicon build: lookup table, links, inflections, relations."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions.forms import forms_of, is_regular, moved_grades, plural_of, serialise, slot_forms
from lexloom.operators import lexicon
from lexloom.operators.stages import settle
from lexloom.operators.words import first_wins, word_list
from lexloom.plans.registry import LEX, query, table

SUFFIXES = [("3", "s"), ("p", "ed"), ("d", "ed"), ("i", "ing"), ("s", "s"), ("c", "er"), ("sup", "est")]


def lex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_list(table(spark, sf_dir, "documents"))


def listed_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settle(lex(spark, sf_dir).select("word", (F.col("doc_id") * 10_000_000 + F.col("pos")).alias("ord"), "n"), "words")


def derived_entries(spark: SparkSession, sf_dir: str, words: DataFrame | None = None) -> DataFrame:
    """Entries made of the word list: part of speech by frequency, forms that are in the list themselves."""
    words = listed_words(spark, sf_dir) if words is None else words
    wanted = words.select(F.col("word").alias("base"), F.posexplode(F.array(*[F.struct(F.lit(s).alias("slot"), F.concat("word", F.lit(e)).alias("form")) for s, e in SUFFIXES])).alias("i", "x"))
    known = wanted.select("base", "i", "x.slot", "x.form").join(words.select(F.col("word").alias("form")), "form")
    forms = known.groupBy("base").agg(F.sort_array(F.collect_list(F.struct("i", F.concat("slot", F.lit(":"), "form").alias("t")))).alias("f"))
    pos = F.when(F.col("n") % 3 == 0, "n:60/v:40").when(F.col("n") % 3 == 1, "adj:50/n:50").otherwise("v:100")
    entries = words.join(forms, words["word"] == forms["base"], "left").select("word", pos.alias("pos"), F.coalesce(F.array_join("f.t", "/"), F.lit("")).alias("exchange"), "ord")
    return settle(entries, "entries")  # a stage table of the build: read many times


ENTRIES = (
    LEX
    + """,
want AS (SELECT word AS base, o, i, slot, word || e AS form FROM lex, (VALUES """
    + ", ".join(f"({i}, '{s}', '{e}')" for i, (s, e) in enumerate(SUFFIXES))
    + """) AS t(i, slot, e)),
known AS (SELECT want.* FROM want JOIN lex ON lex.word = want.form),
ent AS (SELECT word, CASE n % 3 WHEN 0 THEN 'n:60/v:40' WHEN 1 THEN 'adj:50/n:50' ELSE 'v:100' END AS pos, n % 3 AS k, o AS ord FROM lex),
pairs AS (SELECT known.base, known.i, known.slot, known.form, ent.k, ent.ord FROM known JOIN ent ON ent.word = known.base)"""
)


@query(f"WITH {LEX} SELECT word, o // 10000000 AS doc_id, (o % 10000000)::INT AS pos, n FROM lex")
def lexicon_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lex(spark, sf_dir)


ANCHORS = r"""a AS (SELECT page_id * 1000 + i AS ord, lower(l[i + 1]) AS key, CASE WHEN (page_id * 1000 + i) % 2 = 1 THEN '@@@LINK=' || url ELSE url END AS body
FROM (SELECT page_id, url, l, unnest(range(len(l))) AS i FROM (SELECT page_id, url, regexp_extract_all(html, '<a href="/([^"]*)">', 1) AS l FROM pages)))"""


def anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = table(spark, sf_dir, "pages").select("page_id", "url", F.posexplode(F.regexp_extract_all("html", F.lit('<a href="/([^"]*)">'), 1)).alias("i", "key"))
    ord_ = F.col("page_id") * 1000 + F.col("i")
    return links.select(ord_.alias("ord"), F.lower("key").alias("key"), F.when(ord_ % 2 == 1, F.concat(F.lit(lexicon.LINK), "url")).otherwise(F.col("url")).alias("body"))


@query(
    f"""WITH {ANCHORS} SELECT key, coalesce(arg_min(body, ord) FILTER (NOT starts_with(body, '@@@')), arg_max(body, ord) FILTER (starts_with(body, '@@@'))) AS body,
coalesce(min(ord) FILTER (NOT starts_with(body, '@@@')), max(ord) FILTER (starts_with(body, '@@@'))) AS ord, count(*) FILTER (NOT starts_with(body, '@@@')) = 0 AS is_link FROM a GROUP BY key"""
)
def lookup_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon.build_lookup(anchors(spark, sf_dir))


@query(f"""WITH {ANCHORS} SELECT key, arg_max(substr(body, 9), ord) FILTER (starts_with(body, '@@@')) AS target FROM a GROUP BY key HAVING count(*) FILTER (starts_with(body, '@@@')) > 0""")
def alias_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon.alias_targets(anchors(spark, sf_dir))


@query(
    f"""WITH RECURSIVE {LEX}, one AS (SELECT word, left(word, -1) AS t FROM lex WHERE n = 1 AND length(word) > 1),
r AS (SELECT word, t FROM one UNION SELECT r.word, one.t FROM r JOIN one ON one.word = r.t)
SELECT r.word, r.t AS target FROM r JOIN lex ON lex.word = r.t WHERE NOT (lex.n = 1 AND length(lex.word) > 1)"""
)
def link_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words met once link to themselves without the last letter; the others are entries."""
    words = lex(spark, sf_dir)
    link = (F.col("n") == 1) & (F.length("word") > 1)
    body = F.when(link, F.concat(F.lit(lexicon.LINK), F.expr("left(word, length(word) - 1)"))).otherwise("own")
    return lexicon.resolve_links(words.select((F.col("doc_id") * 10_000_000 + F.col("pos")).alias("ord"), F.col("word").alias("key"), body.alias("body")))


@query(
    """WITH RECURSIVE c AS (SELECT c_custkey AS k, CASE c_custkey % 16 WHEN 3 THEN c_custkey - 2 WHEN 8 THEN c_custkey - 4 WHEN 14 THEN c_custkey - 5 ELSE c_custkey + 1 END AS t, c_custkey % 16 = 0 AS own FROM customer),
r AS (SELECT k, t FROM c WHERE NOT own UNION SELECT r.k, c.t FROM r JOIN c ON c.k = r.t WHERE NOT c.own)
SELECT r.k::VARCHAR AS word, r.t::VARCHAR AS target FROM r JOIN c ON c.k = r.t WHERE c.own"""
)
def link_circles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as links in blocks of sixteen: circles of three, five and six with a way in, and one chain to an entry; the last one may end nowhere."""
    k = F.col("c_custkey")
    target = F.when(k % 16 == 3, k - 2).when(k % 16 == 8, k - 4).when(k % 16 == 14, k - 5).otherwise(k + 1)
    body = F.when(k % 16 == 0, "own").otherwise(F.concat(F.lit(lexicon.LINK), target.cast("string")))
    return lexicon.resolve_links(table(spark, sf_dir, "customer").select(k.alias("ord"), k.cast("string").alias("key"), body.alias("body")))


@query(
    r"""WITH t AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS pos FROM (SELECT doc_id, regexp_extract_all(text, '[A-Za-z]+') AS w FROM documents WHERE lang = 'en'))
SELECT word, doc_id, pos::INT AS pos FROM t QUALIFY row_number() OVER (PARTITION BY lower(word) ORDER BY doc_id, pos) = 1"""
)
def first_wins_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("lang = 'en'")
    tokens = docs.select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), 0)).alias("pos", "word"))
    return first_wins(tokens.select("word", "doc_id", "pos"), "word", ["doc_id", "pos"])


PLURAL_SQL = r"""CASE WHEN w IN ('child','man','woman','foot','tooth','mouse','goose','ox','person','cactus','focus','fungus','nucleus','syllabus','analysis','crisis','phenomenon','criterion','datum')
THEN {'child':'children','man':'men','woman':'women','foot':'feet','tooth':'teeth','mouse':'mice','goose':'geese','ox':'oxen','person':'people','cactus':'cacti','focus':'foci','fungus':'fungi','nucleus':'nuclei','syllabus':'syllabi','analysis':'analyses','crisis':'crises','phenomenon':'phenomena','criterion':'criteria','datum':'data'}[w]
WHEN regexp_matches(w, '(s|x|z|ch|sh)$') THEN w || 'es' WHEN regexp_matches(w, '[^aeiou]y$') THEN left(w, -1) || 'ies' WHEN regexp_matches(w, '.f$') THEN left(w, -1) || 'ves'
WHEN regexp_matches(w, '.fe$') THEN left(w, -2) || 'ves' WHEN regexp_matches(w, '[^aeiou]o$') THEN w || 'es' ELSE w || 's' END""".replace("{'child'", "MAP {'child'")


@query(f"WITH {LEX} SELECT word, {re.sub(r"\bw\b", "word", PLURAL_SQL)} AS plural FROM lex")
def plural_infer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lex(spark, sf_dir).select("word", plural_of(F.col("word")).alias("plural"))


DOUBLED = "regexp_matches(b, '[^aeiouy][aeiou][^aeiou]$') AND f = b || right(b, 1) || '{e}'"


def _regular_sql() -> str:
    grade = lambda e: f"f = b || '{e}' OR (b LIKE '%e' AND f = b || '{e[1:]}') OR ({DOUBLED.format(e=e)}) OR (b LIKE '%y' AND f = left(b, -1) || 'i{e}')"
    return f"""f = b OR CASE slot WHEN 's' THEN f IN (b || 's', b || 'es') OR (b LIKE '%f' AND f = left(b, -1) || 'ves') OR (b LIKE '%fe' AND f = left(b, -2) || 'ves') OR (b LIKE '%y' AND f = left(b, -1) || 'ies')
WHEN '3' THEN f IN (b || 's', b || 'es') WHEN 'i' THEN f = b || 'ing' OR (b LIKE '%e' AND f = left(b, -1) || 'ing') OR ({DOUBLED.format(e="ing")}) WHEN 'c' THEN {grade("er")} WHEN 'sup' THEN {grade("est")} ELSE {grade("ed")} END"""


@query(
    f"""WITH {LEX}, stem AS (SELECT word AS f, unnest(range(1, 4)) AS k FROM lex), p AS (SELECT DISTINCT lex.word AS b, f FROM stem JOIN lex ON lex.word = left(f, -k::INT)),
x AS (SELECT b, f, unnest(['3', 'p', 'd', 'i', 's', 'c', 'sup']) AS slot FROM p) SELECT b AS base, f AS form, slot, ({_regular_sql()}) AS regular FROM x"""
)
def regular_inflection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the list and the list's words with up to three letters more, for every slot."""
    words = lex(spark, sf_dir).select("word")
    stems = words.select(F.col("word").alias("form"), F.explode(F.array(*[F.expr(f"left(word, length(word) - {k})") for k in (1, 2, 3)])).alias("base"))
    pairs = stems.join(words.select(F.col("word").alias("base")), "base").distinct()
    each = pairs.select("base", "form", F.explode(F.array(*map(F.lit, ["3", "p", "d", "i", "s", "c", "sup"]))).alias("slot"))
    return each.select("base", "form", "slot", is_regular(F.col("base"), F.col("form"), F.col("slot")).alias("regular"))


@query(
    """WITH i AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, slot || ':' || v) AS rn FROM (SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'A' THEN 's' WHEN 'N' THEN '3' ELSE 'p' END AS slot, '(x) ' || l_linestatus || ' ,' || l_linestatus || (floor(l_quantity)::INT % 3) AS v FROM lineitem)),
f AS (SELECT l_orderkey, slot, rn * 10 + j AS o, trim(string_split(substr(v, 5), ',')[j]) AS form FROM i, (SELECT unnest([1, 2]) AS j)),
d AS (SELECT l_orderkey, slot, form, min(o) AS o FROM f GROUP BY ALL),
s AS (SELECT l_orderkey, string_agg(slot || ':' || form, '/' ORDER BY CASE slot WHEN '3' THEN 0 WHEN 'p' THEN 1 ELSE 2 END, o) AS exchange, count(*) AS n FROM d GROUP BY 1) SELECT l_orderkey, exchange, n::INT AS n_forms FROM s"""
)
def exchange_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exchange strings written from line items, parsed and written again in slot order."""
    slot = F.when(F.col("l_returnflag") == "A", "s").when(F.col("l_returnflag") == "N", "3").otherwise("p")
    text = F.concat(slot, F.lit(":(x) "), "l_linestatus", F.lit(" ,"), "l_linestatus", (F.col("l_quantity").cast("int") % 3).cast("string"))
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", text.alias("t")))).alias("x"))
    pairs = slot_forms(F.array_join("x.t", "/"))
    return rows.select("l_orderkey", serialise(pairs).alias("exchange"), F.size(pairs).alias("n_forms"))


GRADED = "(b = '' OR f = b || '{e}' OR (b LIKE '%e' AND f = b || '{t}') OR (b LIKE '%y' AND f = left(b, -1) || 'i{e}') OR (" + DOUBLED + "))"


@query(
    f"""WITH {LEX}, e AS (SELECT word AS b, n % 2 = 0 AS g, unnest(['better', word || 'er', word || 's', word || 'est', left(word, -1) || 'est']) AS f, unnest(range(5)) AS i FROM lex),
m AS (SELECT b, i, f, CASE WHEN f IN ('more', 'less', 'better', 'worse', 'farther', 'further') THEN 'c' WHEN f IN ('most', 'least', 'best', 'worst', 'farthest', 'furthest') THEN 'sup' WHEN g AND f LIKE '%er' AND {GRADED.format(e="er", t="r")} THEN 'c' WHEN g AND f LIKE '%est' AND {GRADED.format(e="est", t="st")} THEN 'sup' ELSE 's' END AS slot FROM e),
u AS (SELECT b, slot, f, min(i) AS i FROM m GROUP BY ALL)
SELECT b AS word, string_agg(slot || ':' || f, '/' ORDER BY CASE slot WHEN 's' THEN 0 WHEN 'c' THEN 1 ELSE 2 END, i) AS exchange FROM u GROUP BY b"""
)
def slot_migration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comparatives and superlatives leave slot s if the word has the part of speech for it."""
    words = lex(spark, sf_dir)
    text = F.concat(F.lit("s:better/s:"), "word", F.lit("er/s:"), "word", F.lit("s/s:"), "word", F.lit("est/s:"), F.expr("left(word, length(word) - 1)"), F.lit("est"))
    pos = F.when(F.col("n") % 2 == 0, "adj:50/n:50").otherwise("n:100")
    return words.select("word", serialise(moved_grades(slot_forms(text), pos, F.col("word"))).alias("exchange"))


LABEL = """CASE slot WHEN 's' THEN CASE WHEN k < 2 THEN '复数' ELSE '第三人称单数' END WHEN 'c' THEN CASE WHEN k = 1 THEN '比较级' END WHEN 'sup' THEN CASE WHEN k = 1 THEN '最高级' END
WHEN '3' THEN CASE WHEN k <> 1 THEN '第三人称单数' END WHEN 'p' THEN CASE WHEN k <> 1 THEN '过去式' END WHEN 'd' THEN CASE WHEN k <> 1 THEN '过去分词' END ELSE CASE WHEN k <> 1 THEN '现在分词' END END"""
#: In these entries slot s holds word + s only, which also is the third person: nothing in it is blocked for nouns, all of it for verbs only.
ROWS = (
    ENTRIES
    + f""",
told AS (SELECT base, form, {LABEL} AS label, 'exchange' AS source, 1 AS phase, ord, i AS seq FROM pairs WHERE NOT (slot = 's' AND k = 2) AND NOT (slot = '3' AND k = 2)),
guess AS (SELECT word AS base, {re.sub(r"\bw\b", "word", PLURAL_SQL)} AS form, '复数' AS label, 'derived' AS source, 2 AS phase, ord, 0 AS seq
  FROM ent WHERE k < 2 AND word NOT IN (SELECT base FROM pairs WHERE slot = 's')),
rows_ AS (SELECT * FROM told WHERE label IS NOT NULL UNION ALL SELECT * FROM guess WHERE form <> base)"""
)


@query(f"WITH {ROWS} SELECT base AS owner, label, form AS target, arg_max(source, phase) AS source FROM rows_ GROUP BY base, label, form")
def inflection_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon.edges_of(lexicon.inflection_rows(derived_entries(spark, sf_dir))).select("owner", "label", "target", "source")


PARENTS = (
    ROWS
    + """, own AS (SELECT *, row_number() OVER (PARTITION BY form, label ORDER BY phase, ord, seq) AS rn FROM rows_ WHERE form <> base),
par AS (SELECT form, base, label, min(phase * 1000000000000000 + ord * 10 + seq) AS o FROM own WHERE source = 'exchange' OR rn = 1 GROUP BY form, base, label),
ranked AS (SELECT *, row_number() OVER (PARTITION BY form ORDER BY o) AS place, count(*) OVER (PARTITION BY form) AS n FROM par)"""
)


@query(f"WITH {PARENTS} SELECT form, base, label, place::INT AS place, n, place = 1 AS \"primary\" FROM ranked")
def occupied_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    parents = lexicon.parents_of(lexicon.inflection_rows(derived_entries(spark, sf_dir)))
    return lexicon.ranked_parents(parents).select("form", "base", "label", "place", "n", "primary")


@query(f"WITH {PARENTS} SELECT form, string_agg(label, ',' ORDER BY place) AS label, arg_min(base, place) AS display_word, count(*) AS n FROM ranked GROUP BY form")
def parent_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = lexicon.listed_parents(lexicon.ranked_parents(lexicon.parents_of(lexicon.inflection_rows(derived_entries(spark, sf_dir)))))
    return listed.select("form", "label", F.col("parents")[0]["base"].alias("display_word"), F.size("parents").cast("long").alias("n"))


@query(
    f"""WITH {ROWS} SELECT form, arg_min(base, (ord, phase, seq)) AS owner, arg_min(label, (ord, phase, seq)) AS label FROM (SELECT base, label, form, max(phase) AS phase, arg_max(ord, phase) AS ord, arg_max(seq, phase) AS seq FROM rows_ GROUP BY ALL)
WHERE form NOT IN (SELECT word FROM lex) GROUP BY form"""
)
def missing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = derived_entries(spark, sf_dir)
    return lexicon.missing_targets(lexicon.edges_of(lexicon.inflection_rows(entries)), entries)


@query(
    f"""WITH {LEX}, c AS (SELECT word, unnest(CASE WHEN word LIKE '%ies' THEN [left(word, -1), left(word, -2), left(word, -3) || 'y'] WHEN word LIKE '%es' THEN [left(word, -1), left(word, -2)] ELSE [left(word, -1)] END) AS stem,
unnest(range(CASE WHEN word LIKE '%ies' THEN 3 WHEN word LIKE '%es' THEN 2 ELSE 1 END)) AS i FROM lex WHERE word LIKE '%s' AND word NOT LIKE '%ss')
SELECT c.word, arg_min(stem, i) AS parent FROM c JOIN lex ON lex.word = stem AND lex.n % 3 < 2 GROUP BY c.word"""
)
def plural_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = derived_entries(spark, sf_dir)
    return lexicon.plural_parents(entries.select("word"), entries)


@query(
    f"""WITH {PARENTS}, first AS (SELECT form, base, label FROM ranked WHERE place = 1 AND form IN (SELECT word FROM lex) AND form NOT IN ('found', 'left', 'ground', 'saw', 'bound', 'rose', 'sprung')),
slot AS (SELECT base, form, arg_min(slot, i) AS slot FROM pairs GROUP BY ALL)
SELECT first.form, first.base, label, slot FROM first JOIN slot ON slot.base = first.base AND slot.form = first.form WHERE NOT (SELECT {_regular_sql().replace('slot', 's').replace('CASE s', 'CASE s')} FROM (SELECT first.base AS b, first.form AS f, slot.slot AS s))"""
)
def irregular_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = derived_entries(spark, sf_dir)
    return lexicon.accepted_parents(entries, lexicon.parents_of(lexicon.inflection_rows(entries)))


@query(
    f"""WITH {ENTRIES}, o AS (SELECT * FROM (VALUES ('3', 0, 'v'), ('p', 1, 'v'), ('d', 2, 'v'), ('i', 3, 'v'), ('s', 4, 'n'), ('c', 5, 'g'), ('sup', 6, 'g')) AS t(slot, r, fam))
SELECT a.form AS owner, b.form AS target, b.label FROM (SELECT base, form, arg_min(slot, i) AS slot FROM pairs GROUP BY ALL) a JOIN o x ON x.slot = a.slot JOIN (SELECT *, {LABEL} AS label FROM pairs) b ON b.base = a.base JOIN o y ON y.slot = b.slot AND y.r > x.r AND y.fam = x.fam
WHERE b.form <> a.form AND b.label IS NOT NULL AND NOT (a.slot IN ('p', 'd') AND a.form = a.base || 'ed')"""
)
def forward_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forward links of all forms, regular ones too (the build asks for them for irregular forms only)."""
    entries = derived_entries(spark, sf_dir)
    each = lexicon._exploded(entries).groupBy("base", F.col("form").alias("form")).agg(F.min_by("slot", "seq").alias("slot")).withColumn("label", F.lit(""))
    return lexicon.forward_edges(entries, each).select("owner", "target", "label")


@query(f"WITH {ENTRIES} SELECT base AS word, string_agg(form, ',' ORDER BY i) AS plurals FROM pairs WHERE slot = 's' GROUP BY base")
def plural_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    forms = forms_of(slot_forms(F.col("exchange")), "s")
    return derived_entries(spark, sf_dir).select("word", F.array_join(forms, ",").alias("plurals")).where("plurals <> ''")


def final_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole build; a third kind of words (their number of occurrences divides by five) has a link from the word with an x."""
    from lexloom.operators.relate import final_entries as build

    words = listed_words(spark, sf_dir)  # counted once: the entries and the links, which are read several times, are made of them
    entries = derived_entries(spark, sf_dir, words).withColumn("translation", F.concat(F.lit("n. a\nv. b\nadj. "), "word"))
    links = words.where("n % 5 = 0").select(F.concat("word", F.lit("x")).alias("word"), F.col("word").alias("target"), "ord")
    return build(entries, links)


@query(
    f"""WITH {ROWS}, l AS (SELECT word || 'x' AS word FROM lex WHERE n % 5 = 0 AND word || 'x' NOT IN (SELECT word FROM lex)),
m AS (SELECT DISTINCT form FROM rows_ WHERE form NOT IN (SELECT word FROM lex) AND form NOT IN (SELECT word FROM l))
SELECT 'standalone' AS entry_kind, (SELECT count(*) FROM lex) AS n UNION ALL SELECT 'alias', (SELECT count(*) FROM l) UNION ALL SELECT 'inflection', (SELECT count(*) FROM m)"""
)
def entry_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return final_entries(spark, sf_dir).groupBy("entry_kind").agg(F.count("*").alias("n"))


@query(
    f"""WITH {ROWS}, m AS (SELECT form, arg_min(base, (ord, phase, seq)) AS owner, arg_min(label, (ord, phase, seq)) AS label FROM (SELECT base, label, form, max(phase) AS phase, arg_max(ord, phase) AS ord, arg_max(seq, phase) AS seq FROM rows_ GROUP BY ALL)
WHERE form NOT IN (SELECT word FROM lex) AND form NOT IN (SELECT word || 'x' FROM lex WHERE n % 5 = 0) GROUP BY form)
SELECT form AS word, ent.word AS linked_word, label, CASE label WHEN '复数' THEN list_filter(string_split(ent.pos, '/'), lambda p: p LIKE 'n:%')[1] WHEN '比较级' THEN 'adj:50' WHEN '最高级' THEN 'adj:50' ELSE list_filter(string_split(ent.pos, '/'), lambda p: p LIKE 'v:%')[1] END AS pos,
CASE label WHEN '复数' THEN 'n. a' WHEN '比较级' THEN 'adj. ' || ent.word WHEN '最高级' THEN 'adj. ' || ent.word ELSE 'v. b' END AS translation FROM m JOIN ent ON ent.word = m.owner"""
)
def materialised_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = final_entries(spark, sf_dir).where("entry_kind = 'inflection'")
    return made.select("word", "linked_word", F.col("relations")[0]["label"].alias("label"), "pos", "translation")

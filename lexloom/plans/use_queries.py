"""Roots, families, lookups, texts and quality over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions.text import han_punctuation, repair_lines, segments
from lexloom.operators import families, fragments, quality, roots, views
from lexloom.operators.lexicon import edges_of, inflection_rows
from lexloom.plans.build_queries import ROWS, derived_entries, lex
from lexloom.plans.registry import LEX, query, table


def ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lex(spark, sf_dir).select("word", (F.col("doc_id") * 10_000_000 + F.col("pos")).alias("ord"), "n")


def listed(words: list[str]) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


@query(
    f"""WITH {LEX}, root AS (SELECT word AS root, 'm' || n AS meaning, o AS ord FROM lex WHERE length(word) BETWEEN 3 AND 5 AND n > 1),
c AS (SELECT word AS component FROM lex WHERE length(word) >= 2 AND word NOT IN {listed(roots.STOP_WORDS)}),
m AS (SELECT component, meaning, CASE WHEN root = component THEN 0 ELSE 2 END AS rank, ord FROM c JOIN root ON root = component OR (length(component) > 4 AND starts_with(component, root))),
b AS (SELECT component, arg_min(meaning, (rank, ord)) AS meaning FROM m GROUP BY 1)
SELECT word AS component, coalesce(meaning, '') AS meaning FROM lex LEFT JOIN b ON b.component = lex.word"""
)
def prefix_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = ordered(spark, sf_dir)
    root_map = words.where("length(word) BETWEEN 3 AND 5 AND n > 1").select(F.col("word").alias("root"), F.concat(F.lit("m"), "n").alias("meaning"), "ord")
    return roots.match_components(words.select(F.col("word").alias("component")), root_map)


@query(f"WITH {LEX} SELECT left(word, 3) AS root, arg_max(word, (length(word), -o)) AS meaning FROM lex GROUP BY 1")
def root_longest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roots.longest_meaning(ordered(spark, sf_dir).select(F.expr("left(word, 3)").alias("root"), F.col("word").alias("meaning"), "ord"))


@query(
    f"""WITH {LEX}, a AS (SELECT word, 'a' || n AS r FROM lex WHERE n % 2 = 0), b AS (SELECT word, 'b' || n AS r FROM lex WHERE n % 3 = 0)
SELECT coalesce(a.word, b.word) AS word, coalesce(a.r, b.r) AS roots, CASE WHEN a.word IS NULL THEN 'second' ELSE 'first' END AS source FROM a FULL JOIN b ON a.word = b.word"""
)
def source_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = ordered(spark, sf_dir)
    return roots.merge_sources(words.where("n % 2 = 0").select("word", F.concat(F.lit("a"), "n").alias("roots")), words.where("n % 3 = 0").select("word", F.concat(F.lit("b"), "n").alias("roots")))


def _decompose_sql() -> str:
    rows = [(k, i, p) for k, v in roots.COMPOUNDS.items() for i, p in enumerate(v)]
    rows += [(k, 0, (k, v)) for k, v in roots.PREFIXES.items() if k not in roots.COMPOUNDS]
    rows += [(k, 0, (k, v)) for k, v in roots.SUFFIXES.items() if k not in roots.COMPOUNDS and k not in roots.PREFIXES]
    values = ", ".join(f"('{k}', {i}, '{p[0]}', '{p[1]}')" for k, i, p in rows)
    return f"""WITH {LEX}, kb AS (SELECT * FROM (VALUES {values}) AS t(clean, i, part, meaning)),
c AS (SELECT word, unnest([left(word, 2) || '-', left(word, 3) || '-', '-' || right(word, 3), '-' || right(word, 4)]) AS component FROM lex WHERE length(word) > 4),
u AS (SELECT DISTINCT word, component, trim(component, '-') AS clean FROM c)
SELECT word, component, coalesce(i, 0)::INT AS i, coalesce(part, component) AS part, CASE WHEN {" OR ".join(f"(u.clean = '{k}' AND word IN {listed(v)})" for k, v in roots.INTO_WORDS.items())} THEN '进入' ELSE coalesce(meaning, '') END AS meaning FROM u LEFT JOIN kb ON kb.clean = u.clean"""


def _components(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = F.array(*[F.expr(e) for e in ("left(word, 2) || '-'", "left(word, 3) || '-'", "'-' || right(word, 3)", "'-' || right(word, 4)")])
    return lex(spark, sf_dir).where("length(word) > 4").select("word", F.explode(ends).alias("component")).distinct()


@query(_decompose_sql())
def decompose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roots.decompose(_components(spark, sf_dir))


@query(
    f"""WITH {LEX}, c AS (SELECT DISTINCT word, unnest([left(word, 2), '-' || right(word, 4), right(word, 3)]) AS component FROM lex WHERE length(word) > 4)
SELECT word, component, CASE WHEN starts_with(component, '-') OR trim(component, '-') IN {listed(list(roots.SUFFIXES))} THEN '-' || trim(component, '-') WHEN trim(component, '-') IN {listed(list(roots.PREFIXES))} THEN trim(component, '-') || '-' ELSE trim(component, '-') END AS shown FROM c"""
)
def component_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = F.explode(F.array(F.expr("left(word, 2)"), F.expr("'-' || right(word, 4)"), F.expr("right(word, 3)"))).alias("component")
    df = lex(spark, sf_dir).where("length(word) > 4").select("word", parts).distinct()
    return df.select("word", "component", roots.shown_component(F.col("component"), F.col("component")).alias("shown"))


STEMS = (
    LEX
    + f""", st AS (SELECT DISTINCT word, left(word, -length(s)) AS stem FROM lex, (SELECT unnest({families.SUFFIXES}) AS s) WHERE ends_with(word, s) AND length(word) > length(s) + 2
UNION SELECT DISTINCT word, substr(word, length(p) + 1) FROM lex, (SELECT unnest({families.PREFIXES}) AS p) WHERE starts_with(word, p) AND length(word) > length(p) + 2),
g AS (SELECT stem, count(*) AS n, min(word) AS first FROM st GROUP BY stem HAVING count(*) > 1)"""
)


@query(f"WITH {STEMS} SELECT word, st.stem, n FROM st JOIN g ON g.stem = st.stem")
def stem_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    return families.family_members(lex(spark, sf_dir))


@query(f"WITH {STEMS} SELECT DISTINCT first AS owner, word AS target FROM st JOIN g ON g.stem = st.stem WHERE word <> first AND NOT (first LIKE 'a%' AND length(word) % 2 = 0)")
def family_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Star edges of the stem families, without those that are there already (owners in a with targets of even length)."""
    words = lex(spark, sf_dir)
    there = families.family_edges(words, words.select(F.col("word").alias("owner"), F.col("word").alias("target")))
    return families.family_edges(words, there.where("owner LIKE 'a%' AND length(target) % 2 = 0"))


def _root_sql() -> str:
    heads = "|".join(sorted(families.MORE_PREFIXES, key=len, reverse=True))
    tails = sorted(families.MORE_SUFFIXES, key=len, reverse=True)
    cut = "CASE " + " ".join(f"WHEN ends_with(r, '{t}') AND length(r) > {len(t) + 2} THEN left(r, -{len(t)})" for t in tails) + " ELSE r END"
    head = "CASE " + " ".join(f"WHEN starts_with(word, '{p}') AND length(word) > {len(p) + 2} THEN substr(word, {len(p) + 1})" for p in heads.split("|")) + " ELSE word END"
    return f"""WITH {LEX}, a AS (SELECT word, {head} AS r FROM lex), b AS (SELECT word, {cut} AS r FROM a),
c AS (SELECT word, CASE WHEN r LIKE '%id' THEN left(r, -2) || 'is' WHEN r LIKE '%ed' THEN left(r, -2) || 'e' WHEN r LIKE '%ing' THEN left(r, -3) || 'e' ELSE r END AS root FROM b)
SELECT root, count(DISTINCT word) AS n, min(word) AS first FROM c GROUP BY root HAVING count(DISTINCT word) > 1"""


@query(_root_sql())
def root_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    return families.root_groups(lex(spark, sf_dir))


@query(f"WITH {STEMS} SELECT q.word, arg_min(f.first, (l.o, f.first)) AS owner FROM lex q JOIN (SELECT word, first FROM st JOIN g ON g.stem = st.stem) f ON f.word = q.word JOIN lex l ON l.word = f.first WHERE left(q.word, 1) = left(f.first, 1) AND f.first <> q.word GROUP BY q.word")
def family_reverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = ordered(spark, sf_dir)
    held = families.family_members(words).join(families.stem_groups(words).select("stem", "first"), "stem").select(F.col("first").alias("owner"), F.col("word").alias("member"))
    return families.reverse_family(words.select("word"), held.join(words.select(F.col("word").alias("owner"), "ord"), "owner"))


TALK = r"q AS (SELECT DISTINCT conv_id * 100000000 + turn * 1000000 + i AS query_id, w[i + 1] AS text FROM (SELECT conv_id, turn, w, unnest(range(len(w))) AS i FROM (SELECT conv_id, turn, string_split(text, ' ') AS w FROM conversations)))"


def talk(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", " ")).alias("i", "text"))
    return words.select((F.col("conv_id") * 100_000_000 + F.col("turn") * 1_000_000 + F.col("i")).alias("query_id"), "text").distinct()


@query(
    f"""WITH {LEX}, {TALK} SELECT query_id, lower(trim(text)) AS word, CASE WHEN lex.n % 2 = 0 THEN 'primary' WHEN lex.n % 3 = 0 THEN 'secondary' ELSE 'unresolved' END AS provider,
CASE WHEN lex.n % 2 = 0 THEN 'p' || lex.n WHEN lex.n % 3 = 0 THEN 's' || lex.n END AS meaning FROM q LEFT JOIN lex ON lex.word = lower(trim(text)) WHERE regexp_matches(trim(text), '^[a-zA-Z-]+$')"""
)
def lookup_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = lex(spark, sf_dir)
    asked = talk(spark, sf_dir).where(views.is_word(F.col("text")))
    return views.lookup(asked, words.where("n % 2 = 0").select("word", F.concat(F.lit("p"), "n").alias("meaning")), words.where("n % 3 = 0").select("word", F.concat(F.lit("s"), "n").alias("meaning")))


@query(
    f"""WITH {TALK} SELECT CASE WHEN trim(coalesce(text, '')) = '' THEN 'empty' WHEN regexp_matches(trim(text), '^[a-zA-Z-]+$') THEN 'word' ELSE 'text' END AS route, count(*) AS n FROM q GROUP BY 1"""
)
def query_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return talk(spark, sf_dir).groupBy(views.route(F.col("text"), F.lit("en")).alias("route")).agg(F.count("*").alias("n"))


@query(
    f"""WITH {ROWS}, org AS (SELECT form, arg_min(base, (phase, ord, seq)) AS base FROM rows_ WHERE form <> base GROUP BY form)
SELECT word AS query_word, coalesce(org.base, word) AS display_word, 'm' || coalesce(b.n, l.n) AS meaning, org.base IS NOT NULL AS is_fallback, org.base AS back FROM lex l LEFT JOIN org ON org.form = l.word LEFT JOIN lex b ON b.word = org.base"""
    .replace("SELECT word AS query_word, coalesce(org.base, word)", "SELECT l.word AS query_word, coalesce(org.base, l.word)")
)
def entry_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = ordered(spark, sf_dir)
    rows = inflection_rows(derived_entries(spark, sf_dir)).where("form <> base")
    first = rows.groupBy("form").agg(F.min_by("base", F.struct("phase", "ord", "seq")).alias("base"))
    origin = F.struct(F.lit("origin").alias("type"), F.col("base").alias("target"), F.lit("原形").alias("label"), F.lit("outgoing").alias("direction"), F.lit("exchange").alias("display"), F.lit(True).alias("primary"), F.lit(None).cast("array<string>").alias("pos_scope"))
    df = words.join(first, words["word"] == first["form"], "left")
    relations = F.when(F.col("base").isNotNull(), F.array(origin)).otherwise(F.slice(F.array(origin), 1, 0))
    entries = df.select("word", F.when(F.col("base").isNull(), "standalone").otherwise("inflection").alias("entry_kind"), F.coalesce("base", "word").alias("display_word"), F.lit(None).cast("string").alias("linked_word"), F.concat(F.lit("m"), "n").alias("meaning"), relations.alias("relations"))
    return views.entry_views(words.select(F.col("ord").alias("query_id"), F.col("word").alias("text")), entries).select("query_word", "display_word", "meaning", "is_fallback", "back")


@query(
    """WITH e AS (SELECT user_id AS query_id, event_type AS pos, 'v' || floor(value)::BIGINT AS meaning, event_id AS o FROM events), f AS (SELECT query_id, pos, meaning, min(o) AS o FROM e GROUP BY ALL)
SELECT query_id, pos, min(o) AS "at", list(meaning ORDER BY o, meaning) AS meanings FROM f GROUP BY query_id, pos"""
)
def merge_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return views.merge_parts(events.select(F.col("user_id").alias("query_id"), F.col("event_type").alias("pos"), F.concat(F.lit("v"), F.floor("value").cast("string")).alias("meaning"), F.col("event_id").alias("at")))


@query(
    """WITH e AS (SELECT l_orderkey, l_returnflag AS pos, count(*) AS n, min(l_linenumber * 10 + ascii(l_returnflag) % 10) AS o FROM lineitem GROUP BY ALL), t AS (SELECT l_orderkey, sum(n) AS t FROM e GROUP BY 1)
SELECT e.l_orderkey, string_agg(pos || ':' || round_even(100.0 * n / t, 0)::INT, '/' ORDER BY o, pos) AS pos FROM e JOIN t ON t.l_orderkey = e.l_orderkey GROUP BY e.l_orderkey"""
)
def pos_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_returnflag").alias("p"), (F.col("l_linenumber") * 10 + F.ascii("l_returnflag") % 10).alias("o"))
    return views.share_by_pos(rows, "l_orderkey", "p", "o")


REPAIR = r"""regexp_replace(regexp_replace(regexp_replace(array_to_string(list_filter(list_transform(string_split(regexp_replace(text, '([A-Za-z])-\s*\n\s*([A-Za-z])', '\1\2', 'g'), chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13))), lambda x: x <> ''), ' '), '\s+([,.;:!?])', '\1', 'g'), '([(\["])\s+', '\1', 'g'), '\s{2,}', ' ', 'g')"""


@query(f"SELECT doc_id, md5(trim({REPAIR})) AS repaired FROM documents WHERE text IS NOT NULL")
def text_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.md5(repair_lines(F.col("text")).cast("binary")).alias("repaired"))


@query(
    r"""SELECT conv_id, turn, trim(regexp_replace(regexp_replace(regexp_replace(translate(replace(regexp_replace(replace(text, '''', '’'), '(\w)"', '\1""', 'g'), '"', '""'), '!?,.;:()', '！？，。；：（）'), '\s+([，。！？；：）])', '\1', 'g'), '（\s+', '（', 'g'), '\s{2,}', ' ', 'g')) AS text FROM conversations"""
)
def punctuation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", han_punctuation(F.col("text")).alias("text"))


@query(
    r"""WITH RECURSIVE t AS (SELECT conv_id, turn, trim(text, ' ' || chr(10) || chr(9) || chr(13)) AS s FROM conversations),
r AS (SELECT conv_id, turn, 0 AS i, '' AS piece, s AS rest FROM t
UNION ALL SELECT conv_id, turn, i + 1, trim(left(rest, c), ' ' || chr(10)), trim(substr(rest, c + 1), ' ' || chr(10)) FROM (SELECT *, CASE WHEN length(rest) <= 200 THEN length(rest) ELSE coalesce(nullif(list_max(list_filter(range(2, 201), lambda p:
  substr(rest, p, 1) IN ('。', '？', '！', '；', chr(10)) OR (p < 200 AND substr(rest, p, 2) IN ('. ', '? ', '! ', '; ')))), 0), 200) END AS c FROM r WHERE rest <> ''))
SELECT conv_id, turn, i::INT AS i, piece FROM r WHERE i > 0 AND piece <> ''"""
)
def text_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns cut into pieces of at most 200 characters."""
    pieces = F.posexplode(segments(F.col("text"), 200)).alias("i", "piece")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", pieces).withColumn("i", F.col("i") + 1)


@query(
    """WITH l AS (SELECT conv_id AS text_id, count(*) AS n, bool_and((conv_id * 31 + turn) % 23 <> 4) AND count(*) FILTER (text IS NULL) = 0 AS ok, string_agg(text, chr(10) ORDER BY turn, text) FILTER (length(text) % 29 <> 0) AS text, count(*) FILTER (length(text) % 29 <> 0) AS have FROM conversations GROUP BY conv_id)
SELECT text_id, text FROM l WHERE ok AND have = n"""
)
def segment_reassembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as pieces of a conversation; one in 23 failed, and pieces whose length divides by 29 are missing."""
    turns = table(spark, sf_dir, "conversations")
    pieces = turns.where("length(text) % 29 <> 0").select(F.col("conv_id").alias("text_id"), F.col("turn").alias("i"), "text", ((F.col("conv_id") * 31 + F.col("turn")) % 23 != 4).alias("ok"))
    return views.reassemble(pieces, turns.groupBy(F.col("conv_id").alias("text_id")).agg(F.count("*").alias("n")))


def fragments_sql(source: str, keys: str) -> str:
    """CTEs that cut the texts `line` of source (told apart by `keys`) into unique fragments: frag(keys, key, x, j), x as shown.

    The bracket depth before a character is the running sum of +1 and -1, held at 0: sum - least(0, running minimum).
    """
    return rf"""chr_ AS (SELECT {keys}, unnest(range(1, length(line) + 1)) AS p, unnest(string_split(line, '')) AS c FROM {source} WHERE regexp_matches(line, '[()（）]')),
dep AS (SELECT *, sum(CASE WHEN c IN ('(', '（') THEN 1 WHEN c IN (')', '）') THEN -1 ELSE 0 END) OVER (PARTITION BY {keys} ORDER BY p) AS s FROM chr_),
cut AS (SELECT {keys}, p, c, s - least(0, min(s) OVER (PARTITION BY {keys} ORDER BY p)) AS d FROM dep),
num AS (SELECT {keys}, p, c, coalesce(sum(CASE WHEN d = 0 AND c IN (',', ';', '，', '；') THEN 1 ELSE 0 END) OVER (PARTITION BY {keys} ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS j, d FROM cut),
walk AS (SELECT {keys}, j::BIGINT AS j, string_agg(c, '' ORDER BY p) FILTER (NOT (d = 0 AND c IN (',', ';', '，', '；'))) AS x FROM num GROUP BY {keys}, j),
piece AS (SELECT {keys}, unnest(string_split_regex(line, '[,;，；]')) AS x, unnest(range(len(string_split_regex(line, '[,;，；]')))) AS j FROM {source} WHERE NOT regexp_matches(line, '[()（）]')
  UNION ALL SELECT {keys}, x, j FROM walk),
shown AS (SELECT {keys}, j, trim(regexp_replace(translate(x, '［］【】｛｝（），;', '[][]{{}}(),；'), '\s+', ' ', 'g')) AS x FROM piece WHERE x IS NOT NULL AND trim(x) <> ''),
keyed AS (SELECT {keys}, j, x, regexp_replace(trim(regexp_replace(regexp_replace(x, '[（(].*?[）)]', '', 'g'), '\s+', ' ', 'g')), '[，,；;、\s]+', '', 'g') AS key,
  coalesce(list_max(list_transform(regexp_extract_all(x, '[（(](.*?)[）)]', 1), lambda y: length(regexp_replace(y, '[^一-鿿]', '', 'g')))), 0) > 7 AS long FROM shown WHERE x <> ''),
uni AS (SELECT {keys}, key, min(j) AS j, arg_min(x, j) AS x, count(*) AS n, bool_or(long) AS long FROM keyed WHERE key <> '' GROUP BY {keys}, key),
frag AS (SELECT {keys}, key, j, CASE WHEN NOT long THEN x WHEN n > 1 THEN trim(regexp_replace(x, '[（(].*?[）)]', '', 'g')) ELSE coalesce(nullif(
  list_reduce(list_prepend(x, list_filter(regexp_extract_all(x, '[（(][^）)]*[）)]'), lambda y: length(regexp_replace(y, '[^一-鿿]', '', 'g')) > 7)), lambda t, y: replace(t, y, '')), ''), x) END AS x FROM uni)"""


HAN_NOTES = ("（一二三四五六七）", "（一二三四五六七八）")


@query(
    f"""WITH l AS (SELECT doc_id, i, CASE WHEN i % 3 = 1 THEN replace(replace(line, 'th', '(th'), 'er', 'er)') WHEN i % 5 = 2 THEN replace(line, ',', '{HAN_NOTES[1]},') || ',走' || '{HAN_NOTES[1]}' WHEN i % 5 = 3 THEN line || '，' || replace(line, ',', '{HAN_NOTES[0]},')
  WHEN i % 5 = 4 THEN line || ';' || line || '{HAN_NOTES[1]}' ELSE line END AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents WHERE text IS NOT NULL)),
{fragments_sql("l", "doc_id, i")}
SELECT doc_id, i::INT AS i, count(*)::INT AS n, md5(string_agg(x, '|' ORDER BY j)) AS fragments FROM frag GROUP BY doc_id, i"""
)
def meaning_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fragments of all lines of the documents; pieces are bracketed, unbalanced and nested as they come, noted with seven or eight Han characters, or met twice, with and without a note."""
    lines = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    short, long_ = map(F.lit, HAN_NOTES)
    line, noted = F.col("line"), lambda note: F.replace("line", F.lit(","), F.concat(note, F.lit(",")))
    marked = F.replace(F.replace("line", F.lit("th"), F.lit("(th")), F.lit("er"), F.lit("er)"))
    made = F.when(F.col("i") % 3 == 1, marked).when(F.col("i") % 5 == 2, F.concat(noted(long_), F.lit(",走"), long_)).when(F.col("i") % 5 == 3, F.concat(line, F.lit("，"), noted(short))).when(F.col("i") % 5 == 4, F.concat(line, F.lit(";"), line, long_)).otherwise(line)
    rows = fragments.fragment_rows(lines.select("doc_id", "i", made.alias("line")), ["doc_id", "i"], "line")
    told = F.transform(F.sort_array(F.collect_list(F.struct("place", "text"))), lambda x: x["text"])
    df = rows.groupBy("doc_id", "i").agg(told.alias("f"))
    return df.select("doc_id", "i", F.size("f").alias("n"), F.md5(F.array_join("f", "|").cast("binary")).alias("fragments"))


@query(
    rf"""WITH RECURSIVE r AS (SELECT conv_id, turn, list_filter(string_split_regex(text, '[.\n]+'), lambda s: trim(s) <> '') AS ss FROM conversations WHERE text IS NOT NULL),
l AS (SELECT conv_id, turn, unnest(ss) AS line, unnest(range(1, len(ss) + 1)) AS k FROM r),
q AS (SELECT conv_id, turn, k, line, CASE WHEN k % 3 = 2 THEN '口' ELSE '' END AS q, CASE k % 4 WHEN 0 THEN NULL WHEN 1 THEN 'countable' ELSE 'both' END AS c FROM l),
{fragments_sql("l", "conv_id, turn, k")},
rec AS (SELECT conv_id, turn, k, any_value(q) AS q, any_value(c) AS c, coalesce(list(struct_pack(t := x, key := key) ORDER BY j) FILTER (key IS NOT NULL), []) AS f FROM q LEFT JOIN frag USING (conv_id, turn, k) GROUP BY conv_id, turn, k),
n AS (SELECT conv_id, turn, count(*) AS n FROM q GROUP BY ALL),
head AS (SELECT conv_id, turn, q, c, f[1:2] AS h FROM rec WHERE k = 1),
spare AS (SELECT conv_id, turn, arg_min(t, (k, p)) AS t, arg_min(key, (k, p)) AS key, arg_min(coalesce(c, ''), (k, p)) AS c FROM (SELECT conv_id, turn, k, c, unnest(f).t AS t, unnest(f).key AS key, unnest(range(len(f))) AS p FROM rec WHERE k > 1) x
  WHERE NOT EXISTS (SELECT 1 FROM head WHERE head.conv_id = x.conv_id AND head.turn = x.turn AND len(h) > 0 AND h[1].key = x.key) GROUP BY conv_id, turn),
first AS (SELECT head.conv_id, head.turn, q, head.c, h, len(h) = 1 AND spare.key IS NOT NULL AS more, spare.t, spare.key, nullif(spare.c, '') AS sc FROM head LEFT JOIN spare USING (conv_id, turn)),
start AS (SELECT conv_id, turn, list_transform(h, lambda y: y.key) || CASE WHEN more THEN [key] ELSE [] END AS used,
  CASE WHEN len(h) = 0 THEN [] ELSE [struct_pack(t := array_to_string(list_transform(h, lambda y: y.t) || CASE WHEN more THEN [t] ELSE [] END, ','), q := q,
    c := CASE WHEN NOT more OR sc IS NULL THEN c WHEN c IS NULL OR c = sc THEN sc END)] END AS out FROM first),
go AS (SELECT conv_id, turn, 1 AS k, used, out FROM start
  UNION ALL SELECT go.conv_id, go.turn, rec.k::INT, CASE WHEN p IS NULL THEN used ELSE used || [p.key] END, CASE WHEN p IS NULL THEN out ELSE out || [struct_pack(t := p.t, q := rec.q, c := rec.c)] END
  FROM go JOIN (SELECT * FROM rec) rec ON rec.conv_id = go.conv_id AND rec.turn = go.turn AND rec.k = go.k + 1, LATERAL (SELECT list_filter(rec.f, lambda y: NOT list_contains(go.used, y.key))[1] AS p))
SELECT go.conv_id, go.turn, len(items)::INT AS n, md5(array_to_string(list_transform(items, lambda y: y.t || '/' || coalesce(y.c, '')), '；')) AS meaning FROM
  (SELECT go.conv_id, go.turn, list_transform(CASE WHEN n.n = 1 THEN [struct_pack(t := q.line, q := q.q, c := q.c)] ELSE out END, lambda y: struct_pack(c := y.c, t := CASE WHEN y.q = '' OR starts_with(trim(y.t), '(') THEN '' ELSE '(' || y.q || ')' END || trim(regexp_replace(translate(y.t, '［］【】｛｝（），;', '[][]{{}}(),；'), '\s+', ' ', 'g')))) AS items
   FROM go JOIN n ON n.conv_id = go.conv_id AND n.turn = go.turn AND n.n = go.k JOIN q ON q.conv_id = go.conv_id AND q.turn = go.turn AND q.k = 1) go"""
)
def meaning_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of a turn as senses of one entry, with qualifiers and countability by their place."""
    turns = table(spark, sf_dir, "conversations").where("text IS NOT NULL")
    senses = F.filter(F.split("text", r"[.\n]+"), lambda s: F.trim(s) != "")
    kind = lambda i: F.when((i + 1) % 4 == 1, "countable").when((i + 1) % 4 == 0, None).otherwise("both")
    records = F.transform(senses, lambda s, i: F.struct(s.alias("text"), F.when((i + 1) % 3 == 2, "口").otherwise("").alias("qualifier"), kind(i).alias("countability")))
    df = fragments.meaning_items(turns.withColumn("records", records).where(F.size("records") > 0), "records")
    told = F.transform("items", lambda x: F.concat(x["text"], F.lit("/"), F.coalesce(x["countability"], F.lit(""))))
    return df.select("conv_id", "turn", F.size("items").alias("n"), F.md5(F.array_join(told, "；").cast("binary")).alias("meaning"))


@query(f"WITH {LEX} SELECT left(word, 1) AS shard, count(*) AS n FROM lex GROUP BY 1")
def shard_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.shard_counts(lex(spark, sf_dir))


@query(f"WITH {LEX} SELECT word, left(word, 1) AS shard FROM lex QUALIFY row_number() OVER (PARTITION BY left(word, 1) ORDER BY md5(word), word) <= 5")
def sample_per_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.sample_per_shard(lex(spark, sf_dir))


@query(
    f"""WITH {ROWS}, e AS (SELECT base, label, form, arg_max(source, phase) AS source FROM rows_ GROUP BY base, label, form)
SELECT (SELECT count(*) FROM lex) AS entry_count, (SELECT count(*) FROM ent WHERE pos LIKE '%v%' AND word NOT IN (SELECT base FROM pairs)) AS verb_form_missing,
(SELECT count(*) FROM e WHERE source = 'derived') AS derived_edges, (SELECT count(*) FROM e WHERE form NOT IN (SELECT word FROM lex)) AS dangling_targets"""
)
def build_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = derived_entries(spark, sf_dir)
    return quality.build_metrics(entries, edges_of(inflection_rows(entries)))


@query(f"WITH {LEX}, w AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '[A-Za-z]+'))) AS k FROM benchmark) SELECT count(lex.word) AS found, count(*) - count(lex.word) AS missing, count(*) AS total FROM w LEFT JOIN lex ON lex.word = w.k")
def list_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the benchmark items in the lexicon."""
    wanted = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), 0)).alias("word")).select(F.lower("word").alias("word")).distinct()
    return quality.coverage(wanted, lex(spark, sf_dir))


@query(
    r"""SELECT event_type, k, count(*) AS n, min(v) AS least, max(v) AS most FROM (SELECT event_type, k, json_extract_string(props, '$."' || k || '"') AS v FROM (SELECT event_type, props, unnest(json_keys(props)) AS k FROM events)) GROUP BY event_type, k"""
)
def json_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys and values of the events' JSON properties."""
    each = table(spark, sf_dir, "events").select("event_type", F.explode(F.from_json("props", "map<string, string>")).alias("k", "v"))
    return each.groupBy("event_type", "k").agg(F.count("*").alias("n"), F.min("v").alias("least"), F.max("v").alias("most"))


@query(
    r"""SELECT page_id, len(regexp_extract_all(html, '<a href=')) AS n_links, len(regexp_extract_all(html, '<p>')) AS n_paragraphs, trim(regexp_replace(regexp_extract(html, '<li><a href="[^"]*">([^<]*)</a>', 1), '\s+', ' ', 'g')) AS first_link FROM pages"""
)
def html_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and paragraphs of the shredded pages."""
    from lexloom.sources.markup import first_text, inside, shred, with_tag

    pages = shred(table(spark, sf_dir, "pages").select("page_id", "html"), "html")
    nodes = F.col("nodes")
    return pages.select("page_id", F.size(with_tag(nodes, "a")).cast("long").alias("n_links"), F.size(with_tag(nodes, "p")).cast("long").alias("n_paragraphs"), first_text(inside(with_tag(nodes, "a"), with_tag(nodes, "li"))).alias("first_link"))


@query(
    f"""WITH {LEX}, e AS (SELECT word, '[/' || left(word, 3) || '/]' AS ph, CASE WHEN n % 4 = 0 THEN '' ELSE 'n. ' || word || chr(10) || ' plain ' END AS t FROM lex)
SELECT word, left(word, 3) AS phonetic, CASE WHEN t = '' THEN 'n.:' || word || '|v.:' || word ELSE 'n.:' || word || '|释义:plain' END AS parts, '过去式:' || word || 'ed' AS exchanges FROM e"""
)
def secondary_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result rows of a secondary dictionary made of the word list."""
    from lexloom.operators.results import secondary_results

    words = lex(spark, sf_dir)
    text = F.when(F.col("n") % 4 == 0, "").otherwise(F.concat(F.lit("n. "), "word", F.lit("\n plain ")))
    entries = words.select("word", F.concat(F.lit("[/"), F.expr("left(word, 3)"), F.lit("/]")).alias("phonetic"), text.alias("translation"), F.lit("n v").alias("pos"), F.concat(F.lit("p:"), "word", F.lit("ed/zz:x/q")).alias("exchange"))
    joined = lambda c, a, b: F.array_join(F.transform(c, lambda x: F.concat(x[a], F.lit(":"), x[b])), "|")
    return secondary_results(entries).select("word", "phonetic", joined("parts", "part", "meaning").alias("parts"), joined("exchanges", "name", "word").alias("exchanges"))


@query(
    """SELECT lang, CASE WHEN lang IN ('de', 'en', 'es', 'fr') THEN lang ELSE 'auto' END AS code, count(*) AS n FROM documents GROUP BY ALL"""
)
def language_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexloom.operators.results import language_code

    return table(spark, sf_dir, "documents").groupBy("lang", language_code(F.col("lang")).alias("code")).agg(F.count("*").alias("n"))


@query(f"WITH {LEX} SELECT word AS root, '= to ' || word || '，' || '成长' AS meaning FROM lex WHERE length(word) BETWEEN 1 AND 20")
def root_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Definitions written from the word list and read again."""
    from lexloom.operators.etymology import root_definitions as read

    words = lex(spark, sf_dir)
    return read(words.select(F.concat(F.lit("词根 -"), "word", F.lit("- = to "), "word", F.lit(", 表示“成长，长大起来”")).alias("root_text"))).select("root", "meaning")

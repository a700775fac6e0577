"""Etymology pages, morphemes, mind maps and sections written from the customers and read again by the root builders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.operators import etymology
from lexloom.operators.stages import settle, spread
from lexloom.plans.registry import query, table

LETTERS = ("0123456789", "abcdefghij")
C = "c AS (SELECT c_custkey AS k, translate(c_custkey::VARCHAR, '0123456789', 'abcdefghij') AS z FROM customer)"


def numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k and z, the number in letters; a stage table, as conditions on what is made of them would be asked before the rows are spread."""
    keys = settle(spread(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey"), "customers")
    return keys.select(F.col("c_custkey").alias("k"), F.translate(F.col("c_custkey").cast("string"), *LETTERS).alias("z"))


def text(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


@query(
    f"""WITH {C}, rm AS (SELECT 'r' || z AS root, 'm' || z AS meaning, k AS o FROM c WHERE k % 4 = 0),
hit AS (SELECT c.k, coalesce(max(meaning) FILTER (root = 'r' || z), arg_min(meaning, o) FILTER (length(z) > 3)) AS m FROM c JOIN rm ON starts_with('r' || z, root) GROUP BY c.k)
SELECT 'w' || z AS word, CASE WHEN k % 4 <> 0 AND k % 2 = 1 THEN 'ef-（' || CASE WHEN k % 3 = 0 THEN '= out，出来' ELSE 'EF' END || '） + -esce（grow） + -ent（E）' ELSE 'r' || z || coalesce('（' || m || '）', '') || ' + -ent（E）' END AS breakdown FROM c LEFT JOIN hit USING (k)"""
)
def tree_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roots of etymology trees: the second level where the first has one root without a meaning; a word's own section comes before the map."""
    c = numbered(spark, sf_dir)
    k, z = F.col("k"), F.col("z")
    finer = F.when(k % 2 == 1, text('<div class="treePart etymology_2"><span class="rootWord">ef-</span><span class="rootWord">w', z, '</span><span class="affixWord">-esce</span></div>')).otherwise("")
    section = F.when(k % 3 == 0, '<div class="wordSection"><span class="title">词根词缀</span><div class="sectionCont">词根 ef- = out, 表示“出来，向外”</div></div>').otherwise("")
    tree = text('<div class="wordSection etymologyTree"><div class="treePart etymology_0"><span class="rootWord"> W', z, ' </span></div><div class="treePart etymology_1"><span class="rootWord">r', z, '</span><span class="affixWord">-ent</span></div>', finer, "</div>")
    other = text('<div class="etymology"><div class="wordSection etymologyTree"><div class="treePart etymology_0"><span class="rootWord">w', z, '</span></div><div class="treePart etymology_1"><span class="rootWord">later</span></div></div></div>')
    pages = c.select(k.alias("page"), text('<div class="etymology">', tree, section, "</div>", other, '<div class="etymology">no tree</div>').alias("html"))
    fixed = spark.createDataFrame([("ef-", "EF", -3), ("esce", "grow", -2), ("ent", "E", -1)], "root string, meaning string, ord long")
    roots = c.where("k % 4 = 0").select(text("r", z).alias("root"), text("m", z).alias("meaning"), k.cast("long").alias("ord")).unionByName(fixed)
    return etymology.word_roots(pages, roots).select("word", "breakdown")


@query(
    f"""WITH {C} SELECT 'w' || z AS word, CASE WHEN k % 2 = 0 THEN 'o' || z END AS etymology, CASE WHEN k % 5 > 0 THEN 'ad-（加强） + ol（生长，al- 变体） + -ent（形容词后缀） + x' || z || CASE WHEN k % 3 = 0 THEN '' ELSE '（g）' END END AS breakdown FROM c WHERE k % 2 = 0 OR k % 5 > 0"""
)
def morpheme_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roots of morphemes: a known compound in parts, a known suffix, a piece with a gloss."""
    c = numbered(spark, sf_dir)
    k, z = F.col("k"), F.col("z")
    part = lambda piece, gloss: F.struct(piece.alias("piece"), gloss.alias("gloss"))
    pieces = F.array(part(F.lit(" adul"), F.lit("")), part(F.lit("-ent"), F.lit(None).cast("string")), part(F.lit(" "), F.lit("lost")), part(text("x", z), F.when(k % 3 != 0, " g ")))
    rows = c.select(text("w", z).alias("word"), F.when(k % 5 > 0, pieces).otherwise(F.slice(pieces, 1, 0)).alias("morphemes"), F.when(k % 2 == 0, text("o", z)).otherwise("").alias("origin"))
    return etymology.from_morphemes(rows).select("word", "etymology", "breakdown")


@query(f"WITH {C} SELECT 'w' || z AS word, CASE WHEN k % 2 = 0 THEN 'ef（出来）' ELSE 'ef' END || ' + in（不） + ' || 'a-' || left(z, 1) AS breakdown FROM c WHERE k % 7 > 0")
def mindmap_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roots of mind maps, read out of their pages."""
    c = numbered(spark, sf_dir)
    k, z = F.col("k"), F.col("z")
    said = F.when(k % 2 == 0, "[['= out, 表示“出来”']]").otherwise("short")
    node = lambda i, topic, describe: text('{"id":"', str(i), '","parentid":"root","topic":"', topic, '","describe":"', describe, '"}')
    nodes = text('[{"id":"root","topic":"w', z, '"},', node(1, F.lit("ef-"), said), ",", node(2, F.lit(" in- "), F.lit("")), ",", node(3, F.lit("quite a long topic"), F.lit("d")), ",", node(4, text("a-", F.substring(z, 1, 1)), F.lit("")), "]")
    html = F.when(k % 7 > 0, text("<script>var mind = ", nodes, ";</script>")).otherwise("<p>[] {}</p>")
    return etymology.from_mindmap(etymology.read_mindmap(c.select(text(" W", z).alias("word"), html.alias("html")))).select("word", "breakdown")


@query(
    f"""WITH {C}, s AS (SELECT *, 'from L. portare "carry" and O.Fr. x' || z || ' "gate" ' AS e FROM c)
SELECT 'w' || z || CASE WHEN k % 6 = 1 THEN 'ance' ELSE '' END AS word, CASE WHEN k % 2 = 1 THEN e || '(re+fract+ant -> x)' ELSE trim(e) END AS etymology,
  CASE WHEN k % 2 = 1 THEN 're（回；再） + frac（破，打碎） + t（过去分词后缀） + ' || CASE WHEN k % 6 = 1 THEN '-ance' ELSE 'ant' END || '（形容词后缀） -> x' ELSE 'portare（carry） + x' || z || '（gate）' END AS breakdown FROM s"""
)
def section_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roots of etymology texts: of a bracketed sum with an arrow, else of quoted glosses."""
    c = numbered(spark, sf_dir)
    k, z = F.col("k"), F.col("z")
    told = text('<h1>词源：</h1><p>from L. portare <b>"carry"</b> and O.Fr. x', z, ' "gate" ', F.when(k % 2 == 1, "(re+fract+ant -&gt; x)").otherwise(""), "</p> 词根记忆 more (a+b)")
    pages = c.select(text("w", z, F.when(k % 6 == 1, "ance").otherwise("")).alias("word"), F.replace(told, F.lit("-&gt;"), F.lit("->")).alias("html"))
    return etymology.from_sections(etymology.read_etymology(pages)).select("word", "etymology", "breakdown")

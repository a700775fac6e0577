"""Root texts: glossary definitions, node descriptions and quoted glosses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions.text import let
from lexloom.operators import roots
from lexloom.operators.stages import settle, spread
from lexloom.sources.markup import below, first_text, inside, shred, with_class, with_tag

HAN = "[一-鿿]"
QUOTES = '["“”]'
# Words that are no root before a quoted gloss.
SKIPPED = ["see", "also", "related", "nom", "gen", "pp", "prp", "v", "n", "adj", "adv"]


def _found(text: Column, pattern: str) -> Column:
    return F.nullif(F.trim(F.regexp_extract(text, pattern, 1)), F.lit(""))


def root_definitions(df: DataFrame, text: str = "root_text") -> DataFrame:
    """The columns of df and root, meaning: each part after 词根, 前缀 or 后缀 gives a meaning to the roots before `=` or 表示.

    The Chinese meaning is what 表示 quotes, else what it names, else what is quoted after a comma, else what follows the
    English after `=`; of several, the shortest with two characters or more counts if it is longer than four.
    """
    parts = F.filter(F.transform(F.split(text, r"(?U)(?:词根|前缀|后缀)\s+"), lambda p: F.trim(p)), lambda p: p != "")
    df = df.select("*", F.posexplode(parts).alias("__n", "__p"))
    p = F.col("__p")
    after = F.regexp_replace(F.trim(F.regexp_extract(p, r"[=＝]\s*(.+?)(?:\s*表示|\s*$)", 1)), "[，,。.]+$", "")
    english = F.nullif(F.regexp_replace(F.trim(F.regexp_replace(after, f"{HAN}.*$", "")), "[，,]+$", ""), F.lit(""))
    quoted = F.coalesce(_found(p, f"表示{QUOTES}([^\"“”]+)"), _found(p, f"表示({HAN}[^\"“”，,]*)[，,]\\s*{QUOTES}"), _found(p, f"[，,]\\s*{QUOTES}([^\"“”]+)"))
    df = df.withColumns({"__english": english, "__quoted": quoted})
    behind = F.when(F.col("__english").isNotNull(), F.substring(p, F.instr(p, F.col("__english")) + F.length("__english"), F.length(p)))
    chinese = F.coalesce("__quoted", F.nullif(F.regexp_replace(F.regexp_extract(behind, rf"({HAN}\S*)", 1), "[，,。.]+$", ""), F.lit("")))
    df = df.withColumn("__chinese", chinese)
    pieces = F.filter(F.transform(F.split("__chinese", "[，,]"), lambda x: F.trim(x)), lambda x: x != "")
    best = F.array_min(F.transform(F.filter(pieces, lambda x: F.length(x) >= 2), lambda x: F.struct(F.length(x).alias("n"), F.array_position(pieces, x).alias("i"), x.alias("x"))))["x"]
    short = F.when((F.length("__chinese") > 4) & (F.size(pieces) > 1), F.coalesce(best, F.col("__chinese"))).otherwise(F.col("__chinese"))
    meaning = F.when(F.col("__english").isNotNull() & short.isNotNull(), F.concat(F.lit("= "), "__english", F.lit("，"), short)).when(short.isNotNull(), short).when(F.col("__english").isNotNull(), F.concat(F.lit("= "), "__english"))
    names = F.transform(F.split(F.regexp_replace(p, "(?s)(?:[=＝]|表示).*$", ""), "[,，]"), lambda r: F.lower(F.regexp_replace(F.regexp_replace(r, "[^a-zA-Z-]", ""), "^-+|-+$", "")))
    names = F.filter(names, lambda r: (F.length(r) >= 1) & (F.length(r) <= 20))
    keep = [c for c in df.columns if not c.startswith("__")]
    return df.withColumn("meaning", meaning).where("meaning IS NOT NULL").select(*keep, F.explode(names).alias("root"), "meaning")


def described_meaning(text: Column) -> Column:
    """Meaning of a node description: quoted after 表示, named after 表..., or Chinese after the last comma; empty if none."""
    d = F.trim(F.regexp_replace(text, r"^\[\['(.*?)'\]\]$", "$1"))
    named = F.regexp_replace(F.trim(F.regexp_extract(d, r"表(?:[a-z]+|[^\s,，]+)[，,]\s*(.+?)(?:[。.]|$)", 1)), "等+$", "")
    named = F.coalesce(_found(named, f"^{QUOTES}([^\"“”]+){QUOTES}"), F.nullif(F.regexp_replace(named, f"^{QUOTES}+|{QUOTES}+$", ""), F.lit("")))
    last = F.regexp_replace(F.trim(F.regexp_extract(d, r"[，,]\s*(.{2,})$", 1)), "[。.]+$", "")
    return F.coalesce(_found(d, f"表示{QUOTES}([^\"“”]+)"), named, F.when(last.rlike(HAN), last), F.lit(""))


def quoted_glosses(text: Column) -> Column:
    """Array of (root, meaning): words followed by a quoted gloss, without abbreviations and references."""
    pattern = r'(?:from\s+)?(?:L\.\s*|O\.Fr\.\s*|M\.Fr\.\s*)?(\w[\w-]*)\s*"([^"]+)"'
    pairs = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), 1).alias("root"), F.regexp_extract_all(text, F.lit(pattern), 2).alias("meaning"))
    return F.filter(pairs, lambda x: ~F.lower(x["root"]).isin(*SKIPPED))


def is_root_component(word: Column, topic: Column) -> Column:
    """A child node of a mind map is a component: it has a hyphen at an end, short parts, or is shorter than the word."""
    t = F.trim(topic)
    return (t != "") & (t.rlike("^-|-$") | (t.contains("-") & F.forall(F.split(t, "-"), lambda x: F.length(x) <= 4)) | (F.length(t) < F.length(word)))


def etymology_sections(html: Column) -> Column:
    """(etymology, breakdown) of a page: text between 词源 and 词根记忆 or the end, and the first bracketed sum in it."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(html, "<[^>]+>", " "), r"(?U)\s+", " "))
    section = F.trim(F.regexp_extract(plain, r"词源[:：]?\s*(.*?)(?=词根记忆|$)", 1))
    return F.struct(section.alias("etymology"), F.trim(F.regexp_extract(section, r"[（(]([^）)]*\+[^）)]*)[）)]", 1)).alias("breakdown"))


def read_mindmap(pages: DataFrame) -> DataFrame:
    """word, nodes (array of topic, describe): child nodes of mind maps that are root components.  pages: word, html (a JSON array of nodes in it); words of more than 60 characters are skipped."""
    kind = "array<struct<id:string,parentid:string,topic:string,describe:string>>"
    found = F.from_json(F.regexp_extract("html", r"(?s)(\[\s*\{.*?\}\s*\])", 1), kind)
    df = pages.where(F.length(F.trim("word")).between(1, 60)).select(F.lower(F.trim("word")).alias("word"), F.coalesce(found, F.array().cast(kind)).alias("all"))
    own = F.filter("all", lambda n: n["parentid"].isNotNull() & is_root_component(F.col("word"), F.coalesce(n["topic"], F.lit(""))))
    return df.select("word", F.transform(own, lambda n: F.struct(F.trim(n["topic"]).alias("topic"), F.trim(F.coalesce(n["describe"], F.lit(""))).alias("describe"))).alias("nodes")).where(F.size("nodes") > 0)


def read_etymology(pages: DataFrame) -> DataFrame:
    """word, etymology, breakdown: the sections of etymology pages.  pages: word, html."""
    return pages.select(F.lower(F.trim("word")).alias("word"), etymology_sections(F.col("html")).alias("s")).select("word", "s.*").where("etymology <> '' OR breakdown <> ''")


def tree_components(pages: DataFrame) -> DataFrame:
    """word, level1, level2 (arrays of components), own (text of the page's root section): one row an etymology block with a tree, in order.  pages: page, html."""
    df = settle(shred(spread(pages.select("page", "html"), "page"), "html"), "trees")
    blocks = df.select("page", "nodes", F.explode(with_class(F.col("nodes"), "etymology")).alias("b"))

    def level(own: Column, k: int) -> Column:
        return F.filter(own, lambda n: F.exists(n["cls"], lambda c: c.contains("treePart")) & F.exists(n["cls"], lambda c: c.contains(f"etymology_{k}")))

    def components(own: Column, word: Column, parts: Column) -> Column:
        """Roots, then affixes, of each part in turn; the word itself is none."""

        def of(part: Column) -> Column:
            inner = with_tag(below(own, part), "span")
            told = lambda name: F.filter(F.transform(with_class(inner, name), lambda n: F.trim(n["text"])), lambda t: t != "")
            return F.concat(F.filter(told("rootWord"), lambda t: F.lower(t) != word), told("affixWord"))

        return F.flatten(F.transform(parts, of))

    def read(own: Column) -> Column:
        sections = F.filter(with_class(own, "wordSection"), lambda s: F.exists(with_class(below(own, s), "title"), lambda t: t["text"].contains("词根词缀")))
        section = first_text(inside(with_class(own, "sectionCont"), F.slice(sections, 1, 1)))
        told = lambda word: F.struct(word.alias("word"), components(own, word, level(own, 1)).alias("level1"), components(own, word, level(own, 2)).alias("level2"), section.alias("section"))
        return let(F.lower(F.trim(first_text(inside(with_class(own, "rootWord"), level(own, 0))))), told)

    # a condition on columns would be pushed below them and compute them again: each block is read once, as a value
    kept = F.filter(F.array(let(below(F.col("nodes"), F.col("b")), read)), lambda x: (x["word"] != "") & (F.length(x["word"]) <= 60) & (F.size(x["level1"]) > 0))
    return blocks.select("page", F.col("b.i").alias("at"), F.explode_outer(kept).alias("x")).where("x IS NOT NULL").select("page", "at", "x.*")


def choose_components(level1: Column, level2: Column, resolved: Column) -> Column:
    """Level 1; where it has one root (`resolved` false: without a meaning of its own) the components of level 2 and the suffixes that they lack; each once."""
    single = (F.size(F.filter(level1, lambda c: ~c.startswith("-"))) == 1) & ~resolved & (F.size(level2) > 0)
    fine = let(F.transform(level2, roots.bare), lambda low: F.concat(level2, F.filter(level1, lambda c: c.startswith("-") & ~F.array_contains(low, roots.bare(c)))))
    return F.array_distinct(F.when(single, fine).otherwise(level1))


def word_roots(pages: DataFrame, root_map: DataFrame) -> DataFrame:
    """word, roots (array of root, meaning), breakdown of the first tree of each word.  pages: page, html; root_map: root, meaning, ord.

    A component's meaning is the one of the word's own root section, else that of the map.
    """
    trees = tree_components(pages)
    first = trees.withColumn("rn", F.row_number().over(Window.partitionBy("word").orderBy("page", "at"))).where("rn = 1").drop("rn", "page", "at")
    lone = F.try_element_at(F.filter("level1", lambda c: ~c.startswith("-")), F.lit(1))
    first = settle(first.withColumn("lone", roots.bare(lone)), "first-trees")
    known = root_map.select(F.regexp_replace("root", "-$", "").alias("lone")).distinct().withColumn("resolved", F.lit(True))
    chosen = choose_components(F.col("level1"), F.col("level2"), F.coalesce("resolved", F.lit(False)))
    each = settle(first.join(known, "lone", "left").select("word", "section", F.posexplode(chosen).alias("i", "component")), "components")
    local = root_definitions(first.where("section <> ''").select("word", "section"), "section").select("word", "root", "meaning")
    local = roots.match_components_by("word", each.select("word", "component"), local.withColumn("ord", F.lit(0)))
    common = roots.match_components(each, root_map)
    df = each.join(local.withColumnRenamed("meaning", "own"), ["word", "component"], "left").join(common, "component", "left")
    df = df.withColumn("meaning", F.coalesce(F.nullif("own", F.lit("")), "meaning", F.lit("")))
    return _regrouped(df.select("word", "i", F.col("component").alias("root"), "meaning"))


def _regrouped(parts: DataFrame) -> DataFrame:
    """word, roots, breakdown from rows (word, i, root, meaning)."""
    df = parts.groupBy("word").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "root", "meaning"))), lambda x: F.struct(x["root"].alias("root"), x["meaning"].alias("meaning"))).alias("roots"))
    told = F.transform("roots", lambda r: F.when(r["meaning"] != "", F.concat(r["root"], F.lit("（"), r["meaning"], F.lit("）"))).otherwise(r["root"]))
    return df.select("word", "roots", F.array_join(told, " + ").alias("breakdown"))


def _decomposed(parts: DataFrame) -> DataFrame:
    """parts (word, i, piece, gloss) with `subs`: array of (part, meaning) of the piece as a known compound or affix, else the piece without a meaning."""
    found = roots.decompose(parts.select("word", F.col("piece").alias("component")).distinct()).groupBy("word", "component").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "part", "meaning"))), lambda x: F.struct(x["part"].alias("part"), x["meaning"].alias("meaning"))).alias("subs"))
    return parts.join(found.withColumnRenamed("component", "piece"), ["word", "piece"])


def _expanded(rows: DataFrame, shown) -> DataFrame:  # noqa: ANN001
    """Compounds become their parts; another piece keeps its gloss or takes the known meaning.  shown: how a root is written (part, piece, whether of a compound)."""
    many = F.size("subs") > 1
    one = F.array(F.struct(F.col("piece").alias("part"), F.when(F.col("gloss") != "", F.col("gloss")).otherwise(F.col("subs")[0]["meaning"]).alias("meaning")))
    df = rows.select("word", "i", "piece", many.alias("many"), F.posexplode(F.when(many, F.col("subs")).otherwise(one)).alias("j", "p"))
    return _regrouped(df.select("word", F.struct("i", "j").alias("i"), shown(F.col("p.part"), F.col("word"), F.col("many")).alias("root"), F.col("p.meaning").alias("meaning")))


def from_morphemes(rows: DataFrame) -> DataFrame:
    """word, etymology, roots, breakdown.  rows: word, morphemes (array of piece, gloss), origin."""
    each = rows.select("word", F.posexplode("morphemes").alias("i", "m")).select("word", "i", F.trim(F.coalesce("m.piece", F.lit(""))).alias("piece"), F.trim(F.coalesce("m.gloss", F.lit(""))).alias("gloss")).where("piece <> ''")
    built = _expanded(_decomposed(each), lambda part, word, many: roots.shown_component(part, part))
    told = rows.select("word", F.nullif("origin", F.lit("")).alias("etymology")).join(built, "word", "left")
    return told.where("etymology IS NOT NULL OR roots IS NOT NULL").select("word", "etymology", "roots", "breakdown")


def from_mindmap(rows: DataFrame) -> DataFrame:
    """word, roots, breakdown.  rows: word, nodes (array of topic, describe).  A known affix has its known meaning, another node the shortened one of its description."""
    topic = F.col("n.topic")
    piece = F.when(topic.endswith("-") & ~topic.startswith("-"), F.regexp_replace(topic, "-+$", "")).otherwise(topic)
    gloss = let(described_meaning(F.coalesce("n.describe", F.lit(""))), lambda m: roots.shorten(m))  # noqa: PLW0108  (a second parameter would be the index)
    each = rows.select("word", F.posexplode("nodes").alias("i", "n")).where("trim(n.topic) <> ''").select("word", "i", piece.alias("piece"), gloss.alias("gloss"))
    df = _decomposed(each)
    first = F.col("subs")[0]["meaning"]
    return _regrouped(df.select("word", "i", F.col("piece").alias("root"), F.when(first != "", first).otherwise(F.col("gloss")).alias("meaning")))


def from_sections(rows: DataFrame) -> DataFrame:
    """word, etymology, roots, breakdown.  rows: word, etymology, breakdown (a sum of roots, meanings in brackets, with an arrow at its end).

    Without a sum the quoted glosses of the etymology are the roots.
    """
    arrow = F.trim(F.regexp_extract("breakdown", r"((?:->|→)[^＋+]*)$", 1))
    df = settle(rows.select("word", "etymology", F.coalesce("breakdown", F.lit("")).alias("sum"), F.when(F.col("breakdown") != "", arrow).otherwise("").alias("arrow")), "sections")
    body = F.expr("left(sum, length(sum) - length(arrow))")
    parts = df.where("sum <> ''").select("word", F.posexplode(F.split(body, "[＋+]")).alias("i", "p")).where("trim(p) <> ''")
    parts = parts.select("word", "i", F.trim(F.regexp_replace("p", r"[(（][^)）]*[)）]", "")).alias("piece"), F.regexp_extract("p", r"[(（]([^)）]+)[)）]", 1).alias("gloss")).where("piece <> ''")
    ending = lambda part, word, many: F.when(~many & (part == "ent") & word.endswith("ence"), "-ence").when(~many & (part == "ant") & word.endswith("ance"), "-ance").otherwise(part)
    summed = _expanded(_decomposed(parts), ending).withColumn("kind", F.lit("sum"))
    quoted = df.where("sum = '' AND etymology <> ''").select("word", F.posexplode(quoted_glosses(F.col("etymology"))).alias("i", "g")).select("word", "i", F.col("g.root").alias("root"), F.col("g.meaning").alias("meaning"))
    built = summed.unionByName(_regrouped(quoted).withColumn("kind", F.lit("quoted")))
    df = df.join(built, "word", "left").where("etymology <> '' OR roots IS NOT NULL")
    line = F.when((F.col("kind") == "sum") & (F.col("arrow") != ""), F.concat("breakdown", F.lit(" "), "arrow")).otherwise(F.col("breakdown"))
    return df.select("word", F.nullif("etymology", F.lit("")).alias("etymology"), "roots", line.alias("breakdown"))
